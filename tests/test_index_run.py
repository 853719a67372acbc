import pytest

from symloom.plans.index_run import Inputs, index_run
from symloom.schemas import CLAIM_SYMBOLS, CLAIMS, EXTRACTED_CLAIMS, META, SOURCE_SHAS


@pytest.fixture()
def state(spark):
    symbol = "id string, name string, kind string, path string, line int"
    tables = {
        "symbols": spark.createDataFrame([("s1", "Old", "class", "a", 1), ("s2", "Foo", "class", "a", 1)], symbol),
        "claims": spark.createDataFrame([(1, "A", "gone.md", "0", "hard", "c1", None, None), (2, "B", "same.md", "1", "soft", "c2", None, None), (3, "C", "new.md", "0", "soft", "c3", None, None), (4, "D", "bad.md", "0", "soft", "c4", None, None)], CLAIMS),
        "claim_symbols": spark.createDataFrame([(1, "s1"), (2, "s1"), (3, "s1"), (4, "s1")], CLAIM_SYMBOLS),
        "source_shas": spark.createDataFrame([("gone.md", "0"), ("same.md", "1"), ("new.md", "0"), ("bad.md", "0")], SOURCE_SHAS),
        "meta": spark.createDataFrame([("version", "1.3"), ("extracted_at_sha", "old")], META),
    }
    inputs = Inputs(
        files=spark.createDataFrame([("same.md", "1", ""), ("new.md", "2", "---\nid: ADR-9\n---\n"), ("bad.md", "2", ""), ("ADR-3-x.md", "1", "")], "path string, sha string, text string"),
        symbols=spark.createDataFrame([("s2", "Foo", "class", "a", 9), ("s3", "Bar", "class", "b", 1)], symbol),
        extracted=spark.createDataFrame([("new.md", 0, ["Foo", "None"], "n0", "hard", "r", "e"), ("new.md", 1, ["None"], "n1", "soft", "r", "e"), ("same.md", 0, ["Foo"], "ignored", "soft", "r", "e")], EXTRACTED_CLAIMS),
        answered=spark.createDataFrame([("new.md",), ("ADR-3-x.md",), ("same.md",)], "path string"),
        frontmatter=spark.createDataFrame([("new.md", ["Bar"])], "source_path string, symbols array<string>"),
        commits=spark.createDataFrame([("x", "d", "m", "e")], "sha string, date string, message string, author_email string"),
        file_commits=spark.createDataFrame([("f", "x"), ("f", "x")], "file_path string, commit_sha string"),
        usage=spark.createDataFrame([(1_000_000, 0)], "input_tokens long, output_tokens long"),
        head_sha="head",
    )
    return tables, inputs


def test_run(state):
    out = index_run(*state, now="now", budget=1.0)
    assert {(r.source, r.claim) for r in out.tables["claims"].collect()} == {("B", "c2"), ("D", "c4"), ("ADR-9", "n0"), ("ADR-9", "n1")}
    named = {r.claim: r.claim_id for r in out.tables["claims"].collect()}
    assert {(r.claim_id, r.symbol_id) for r in out.tables["claim_symbols"].collect()} == {(2, "s1"), (4, "s1"), (named["n0"], "s2"), (named["n1"], "s3")}
    assert {(r.source_path, r.source_sha) for r in out.tables["source_shas"].collect()} == {("same.md", "1"), ("new.md", "2"), ("bad.md", "0"), ("ADR-3-x.md", "1")}
    assert {r.id: r.line for r in out.tables["symbols"].collect()} == {"s1": 1, "s2": 9, "s3": 1}
    c = out.counters
    assert (c["files_unchanged"], c["files_extracted"], c["files_failed"], c["files_deleted"]) == (1, 3, 1, 1)
    assert (c["claims_written"], c["unresolved_candidates"], c["cost_usd"], c["over_budget"], c["modified"]) == (2, 2, 15.0, True, True)
    assert {r.key: r.value for r in out.tables["meta"].collect()} == {"version": "1.3", "extracted_at_sha": "head", "generated_at": "now"}


def test_second_run_is_quiet(state, spark):
    tables, inputs = state
    inputs.head_sha, inputs.files = "old", inputs.files.where("path = 'same.md'")
    tables["source_shas"] = tables["source_shas"].where("source_path = 'same.md'")
    out = index_run(tables, inputs, now="now")
    assert not out.counters["modified"] and out.counters["claims_written"] == 0 and out.tables["meta"].count() == 2


def test_full_run_drops_nothing_and_failure_of_all_is_an_error(state, spark):
    tables, inputs = state
    out = index_run(tables, inputs, now="now", full=True, attribution="drop")
    assert out.counters["files_deleted"] == 0 and ("A", "c1") in {(r.source, r.claim) for r in out.tables["claims"].collect()}
    inputs.answered = inputs.answered.limit(0)
    with pytest.raises(RuntimeError):
        index_run(tables, inputs, now="now")
