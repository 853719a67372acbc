import json

import pytest

from symloom.plans import store_run
from symloom.plans.index_run import Inputs, index_run
from symloom.plans.store_run import DONE, FAILED, NOT_SET_UP, blank_tables, changed_parts, counters_of, run_into_store
from symloom.schemas import EXTRACTED_CLAIMS, META
from symloom.sources.artifact import export_artifact
from symloom.sources.snapshots import FORMAT, SnapshotStore, open_tables

SYMBOL = "id string, name string, kind string, path string, line int"


def inputs(spark, answered=("new.md", "ADR-3-x.md", "same.md"), head="head", sha="2"):
    return Inputs(
        files=spark.createDataFrame([("same.md", "1", ""), ("new.md", sha, "---\nid: ADR-9\n---\n"), ("bad.md", "2", ""), ("ADR-3-x.md", "1", "")], "path string, sha string, text string"),
        symbols=spark.createDataFrame([("sym:ts:a:Foo", "Foo", "class", "a", 9), ("sym:ts:b:Bar", "Bar", "class", "b", 1)], SYMBOL),
        extracted=spark.createDataFrame([("new.md", 0, ["Foo", "None"], "n0", "hard", "r", "e"), ("new.md", 1, ["None"], "n1", "soft", "r", "e"), ("same.md", 0, ["Foo"], "s", "soft", "r", "e")], EXTRACTED_CLAIMS),
        answered=spark.createDataFrame([(a,) for a in answered], "path string"),
        frontmatter=spark.createDataFrame([("new.md", ["Bar", "Lost"])], "source_path string, symbols array<string>"),
        commits=spark.createDataFrame([("x", "d", "m", "e")], "sha string, date string, message string, author_email string"),
        file_commits=spark.createDataFrame([("f", "x"), ("f", "x")], "file_path string, commit_sha string"),
        usage=spark.createDataFrame([(1_000_000, 0), (None, 5)], "input_tokens long, output_tokens long"),
        head_sha=head,
    )


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def plain(tables):
    return {n: sorted(map(str, t.select(*sorted(t.columns)).collect())) for n, t in tables.items() if not n.startswith("run_")}


def test_tables_and_counters_equal_the_plans(spark, store, tmp_path):
    """Two runs, the second against the tables of the first; a run over tables gives the same."""
    tables = blank_tables(store)
    errors = spark.createDataFrame([("bad.md", "no answer")], "source_path string, error string")
    for number, given in enumerate((inputs(spark), inputs(spark, answered=("new.md",), sha="4", head="later"))):
        whole = Inputs(**vars(given) | {"symbols": given.symbols.selectExpr(*given.symbols.columns, "CAST(NULL AS string) signature", "CAST(NULL AS string) parent_id", "CAST(NULL AS string) file_sha", "CAST(NULL AS string) language")})
        want = index_run(tables, whole, f"t{number}", budget=1.0)
        got = run_into_store(store, given, f"t{number}", budget=1.0, errors=errors, export_to=str(tmp_path / "artifact.json"))
        assert got.exit_code == DONE and got.error is None
        assert plain(open_tables(store)) == plain(want.tables)
        skipped = {"wall_clock_ms"}
        assert {k: v for k, v in want.counters.items() if k not in skipped} == {k: got.counters[k] for k in want.counters if k not in skipped}
        assert (got.counters["api_calls"], got.counters["extraction_errors"], got.counters["atlas_exported"]) == (2, 1, True)
        assert counters_of(got.manifest)["claims_written"] == got.counters["claims_written"]
        assert (tmp_path / "artifact.json").read_text() == export_artifact(open_tables(store))
        tables = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in want.tables.items()}
    assert store.versions() == [1, 2]


def test_every_table_is_computed_once(spark, store, monkeypatch):
    """No plan is run to be counted: only written parts and small lookups are counted or collected."""
    asked, kind = [], type(spark.range(1))
    for name in ("count", "collect"):
        kept = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, kept=kept, name=name: asked.append((name, self._jdf.queryExecution().optimizedPlan().toString())) or kept(self))
    report = run_into_store(store, inputs(spark), "now")
    assert report.exit_code == DONE
    heavy = [p for _, p in asked if "Join" in p or "explode" in p.lower()]
    assert heavy == []
    assert {n for n in report.manifest.tables if n.startswith("run_")} == {"run_files", "run_claims", "run_unresolved", "run_hints"}
    assert {(r.source_path, r.n_unresolved) for r in store.table("run_unresolved").collect()} == {("new.md", 2)}


def test_exit_codes(spark, store, monkeypatch):
    assert run_into_store(store, inputs(spark), "now", attribution="maybe").exit_code == NOT_SET_UP
    assert run_into_store(store, inputs(spark), "now", budget=-1).exit_code == NOT_SET_UP
    failed = run_into_store(store, inputs(spark, answered=()), "now")
    assert failed.exit_code == FAILED and "4 documents" in failed.error and store.versions() == []
    assert run_into_store(store, inputs(spark), "now").exit_code == DONE
    monkeypatch.setattr(store_run, "check_links", lambda tables: (_ for _ in ()).throw(RuntimeError("lost")))
    assert run_into_store(store, inputs(spark, sha="9"), "now").exit_code == FAILED and store.versions() == [1]
    monkeypatch.undo()
    store.commit(store.manifest(), {}, FORMAT + 1)
    assert run_into_store(store, inputs(spark), "now").exit_code == NOT_SET_UP


def test_a_run_that_changes_nothing_exports_nothing(spark, store, tmp_path):
    given = inputs(spark, answered=("same.md", "new.md", "bad.md", "ADR-3-x.md"))
    first = run_into_store(store, given, "one")
    second = run_into_store(store, given, "two", export_to=str(tmp_path / "a.json"))
    assert (first.counters["modified"], second.counters["modified"], second.counters["atlas_exported"]) == (True, False, False)
    assert not (tmp_path / "a.json").exists() and {r.key: r.value for r in open_tables(store)["meta"].collect()}["generated_at"] == "one"
    assert "symbols" in changed_parts(first.manifest, second.manifest)


def test_export_is_the_document_in_canonical_form(spark, store):
    run_into_store(store, inputs(spark), "now")
    tables = open_tables(store)
    text = export_artifact(tables)
    found = json.loads(text)
    assert text == json.dumps(found, indent=2, ensure_ascii=False) + "\n"
    assert list(found) == ["version", "generated_at", "extracted_at_sha", "generator", "source_shas", "symbols", "claims", "git_commits"]
    empty = json.loads(export_artifact(blank_tables(store) | {"meta": spark.createDataFrame([("version", "1.3")], META)}))
    assert (empty["source_shas"], empty["symbols"], empty["claims"]) == ({}, [], []) and "git_commits" not in empty
