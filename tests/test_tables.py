import json

import pytest
from pyspark.sql import functions as F

from symloom.operators import diff, history, resolve
from symloom.sources.artifact import ArtifactError, export_artifact, import_artifact, read_artifact, read_tables, write_tables
from symloom.sources.config import ConfigError, load_config, read_config, setting
from symloom.sources.extraction import explode_claims, parse_answers
from symloom.sources.files import scan_markdown, scan_prose, scan_sources
from symloom.sources.gitlog import parse_git_log

# ---- history


@pytest.fixture(scope="module")
def commits(spark):
    rows = [("a", "2026-01-01T00:00:00Z", "one", "x@e", ["x.ts", "y.ts"]), ("b", "2026-01-02T00:00:00Z", "two", "y@e", ["x.ts", "y.ts", "z.ts"]), ("c", "2026-01-03T00:00:00Z", "three", "x@e", ["x.ts", "y.ts", "y.ts"]), ("d", "2026-01-03T00:00:00Z", "four", "z@e", [])]
    return history.pivot_files(spark.createDataFrame(rows, "sha string, date string, message string, author_email string, files array<string>"))


def test_co_change(spark, commits):
    assert [(r.other_path, r.commits) for r in history.co_change_top(commits[1], "x.ts").collect()] == [("y.ts", 3), ("z.ts", 1)]
    assert {(r.file_path, r.other_path): r.place for r in history.co_change_top(commits[1]).collect()}[("z.ts", "x.ts")] == 1
    assert history.co_change_pairs(commits[1], max_files=2).count() == 2
    some = spark.createDataFrame([("z.ts",)], "file_path string")
    assert {(r.file_path, r.other_path) for r in history.co_change_top(commits[1], some).collect()} == {("z.ts", "x.ts"), ("z.ts", "y.ts")}


def test_recent_and_activity(commits):
    assert [r.sha for r in history.recent_commits(*commits, 2).where("file_path = 'x.ts'").orderBy("place").collect()] == ["c", "b"]
    rows = {r.file_path: r for r in history.file_activity(*commits, 3).collect()}
    assert rows["x.ts"].hot and not rows["z.ts"].hot and rows["y.ts"].last_author == "x@e" and rows["z.ts"].commit_count == 1
    assert history.file_activity(*commits, 0).count() == 0


def test_commits_without_files_keep_an_empty_list(commits):
    rows = {r.sha: r.files for r in history.commit_files(*commits).collect()}
    assert rows["d"] == [] and rows["c"] == ["x.ts", "y.ts"]


def test_git_log(spark):
    text = "s1\x1f2026-01-01\x1fa@e\x1fsub\x1fject\r\nb.ts\r\n a.ts \r\n\r\ns2\x1fd\x1fe\x1fno files\n\nbroken header\nx.ts\n\n\n"
    rows = parse_git_log(spark.createDataFrame([(text,), ("",)], "value string")).orderBy("sha").collect()
    assert [(r.sha, r.message, r.files) for r in rows] == [("s1", "sub\x1fject", ["a.ts", "b.ts"]), ("s2", "no files", [])]


# ---- resolution

SYMBOL = "id string, name string, path string"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([("sym:ts:src/a.ts:Foo", "Foo", "src/a.ts"), ("sym:ts:src/b.ts:Foo", "Foo", "src/b.ts"), ("sym:ts:lib/c.ts:Bar", "Bar", "lib/c.ts")], SYMBOL)


@pytest.mark.parametrize("given, hint, status, ids", [("Foo", None, "disambiguation", 2), ("Foo", "src/a", "resolved", 1), ("Foo", "b.ts", "resolved", 1), ("Bar", "nowhere", "disambiguation", 1), ("Bar", None, "resolved", 1), ("sym:ts:src/b.ts:Foo", "lib", "resolved", 1), ("sym:ts:x:Y", None, "not_found", 0), ("None", "", "not_found", 0)])
def test_resolve(spark, symbols, given, hint, status, ids):
    rows = resolve.resolve_symbols(spark.createDataFrame([(0, given, hint)], "input_pos int, input string, file_hint string"), symbols).collect()
    assert {r.status for r in rows} == {status} and sum(r.symbol_id is not None for r in rows) == ids


def test_requests():
    assert resolve.request_inputs([" A ", "B", "A"]) == [(0, "A"), (1, "B")]
    for wrong in ([], [""], ["x"] * 11):
        with pytest.raises(ValueError):
            resolve.request_inputs(wrong)


def test_attribution(spark, symbols):
    extracted = spark.createDataFrame([(1, "d1", ["Foo", "Foo", "Nope"]), (2, "d1", ["Nope"]), (3, "d2", [])], "claim_id long, source_path string, symbol_candidates array<string>")
    front = spark.createDataFrame([("d1", ["Bar"]), ("d3", [])], "source_path string, symbols array<string>")
    back = {r.claim_id: r.symbol_ids for r in resolve.attribute_claims(extracted, symbols, front).collect()}
    drop = {r.claim_id: r.symbol_ids for r in resolve.attribute_claims(extracted, symbols, front, "drop").collect()}
    assert len(back[1]) == 2 and back[2] == ["sym:ts:lib/c.ts:Bar"] and back[3] == [] and drop[2] == [] and drop[1] == back[1]
    assert [(r.source_path, r.n_unresolved) for r in resolve.unresolved_by_file(extracted, symbols).collect()] == [("d1", 2)]
    with pytest.raises(ValueError):
        resolve.attribute_claims(extracted, symbols, front, "off")
    documented = extracted.withColumn("documented_id", F.lit("sym:ts:own"))
    assert {r.claim_id: r.symbol_ids for r in resolve.documented_claims(documented, symbols).collect()}[3] == ["sym:ts:own"]


def test_enclosing(spark):
    ranges = spark.createDataFrame([("a", "outer", 0, 0, 0, 10, 1), ("a", "inner", 1, 2, 0, 4, 5)], "path string, symbol_id string, depth int, start_line int, start_character int, end_line int, end_character int")
    at = spark.createDataFrame([("a", 3, 0), ("a", 4, 6), ("a", 11, 0), ("b", 3, 0)], "path string, line int, character int")
    assert {(r.line, r.character): r.symbol_id for r in resolve.enclosing_symbols(at, ranges).collect()} == {(3, 0): "inner", (4, 6): "outer"}


def test_base_types(spark):
    bases = spark.createDataFrame([("a.py", "Base", None), ("a.py", "Near", "Base"), ("b.py", "Far", "m.Base"), ("b.py", "Both", "Proto"), ("b.py", "Both", "Base")], "path string, name string, base string")
    assert {(r.name, r.used_by) for r in resolve.used_by_types(bases).where("name = 'Base'").collect()} == {("Base", "Far"), ("Base", "Both")}
    rows = {r.name: r for r in resolve.split_bases(bases, spark.createDataFrame([("Proto",)], "name string")).collect()}
    assert rows["Both"].extends == ["Base"] and rows["Both"].implements == ["Proto"]


# ---- diffs


def test_sha_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha string")
    assert {r.path: r.status for r in diff.sha_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    assert {r.path: r.status for r in diff.sha_diff(old, new, full=True).collect()} == {"a": "changed", "b": "changed", "d": "added"}
    assert {r.path for r in diff.to_extract(diff.sha_diff(old, new)).collect()} == {"b", "d"}


def test_merges_and_deletes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {(r.k, r.v) for r in diff.merge_latest(old, new, ["k"], ["seq"]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {(r.k, r.v) for r in diff.merge_values(old, new.where("seq = 1"), "k", "v").collect()} == {("a", 1), ("b", 3), ("c", 5)}
    claims = spark.createDataFrame([(1, "p"), (2, "q")], "claim_id long, source_path string")
    links = spark.createDataFrame([(1, "s"), (2, "t")], "claim_id long, symbol_id string")
    kept = diff.delete_by_path(claims, links, spark.createDataFrame([("p",)], "path string"))
    assert [r.claim_id for r in kept[0].collect()] == [2] and [r.symbol_id for r in kept[1].collect()] == ["t"]
    added = spark.createDataFrame([("q", 1, "y", ["s", "s"]), ("p", 0, "x", []), ("q", 0, "z", ["t"])], "source_path string, ordinal int, claim string, symbol_ids array<string>")
    more, linked = diff.insert_claims(*kept, added)
    assert sorted((r.claim_id, r.source_path) for r in more.collect()) == [(2, "q"), (3, "p"), (4, "q"), (5, "q")]
    assert {(r.claim_id, r.symbol_id) for r in linked.collect()} == {(2, "t"), (4, "t"), (5, "s")}


def test_budget_usage_staleness(spark):
    batches = spark.createDataFrame([(1, 0.5), (2, 0.4), (2, 0.2), (3, 9.0)], "batch int, cost double")
    assert [(r.batch, round(r.spent, 6)) for r in diff.budget_crossing(batches, 1.0).collect()] == [(2, 1.1)]
    assert diff.budget_crossing(batches, 100.0).count() == 0
    used = diff.usage_totals(spark.createDataFrame([(1000, None), (None, 2000)], "input_tokens long, output_tokens long")).first()
    assert (used.input_tokens, used.output_tokens, used.cost_usd) == (1000, 2000, 0.165)
    assert [diff.staleness(a, b) for a, b in (("x", "x"), ("x", "y"), (None, "y"), ("x", ""))] == [("current", 0), ("stale", 1), ("unknown", 2), ("unknown", 2)]
    rows = diff.staleness_of(spark.createDataFrame([("x", "x"), ("x", "y"), (None, "y")], "extracted_sha string, head_sha string")).collect()
    assert [r.exit_code for r in rows] == [0, 1, 2]


# ---- sources


def document(**changes):
    doc = {
        "version": "1.3", "generated_at": "2026-01-01T00:00:00.000Z", "extracted_at_sha": "f" * 40,
        "generator": {"tool_version": "0.1.0", "tool_commit_sha": "e" * 40, "extraction_model": "none"},
        "source_shas": {"docs/ADR-01.md": "1" * 8, "docs/é.md": "2" * 8},
        "symbols": [{"id": "sym:py:b.py:B", "name": "B", "kind": "class", "path": "b.py", "line": 2, "signature": "class B", "parent_id": "sym:py:b.py:A", "file_sha": "x"}, {"id": "sym:ts:a.ts:A", "name": "A", "kind": "class", "path": "a.ts", "line": 1, "file_sha": "y"}],
        "claims": [{"source": "ADR-01", "source_path": "docs/ADR-01.md", "source_sha": "1", "severity": "hard", "claim": "one", "rationale": "why", "symbol_ids": ["sym:py:b.py:B", "sym:ts:a.ts:A"]}, {"source": "ADR-02", "source_path": "docs/é.md", "source_sha": "2", "severity": "soft", "claim": "zwei — “q”", "symbol_ids": []}],
        "git_commits": [{"sha": "b", "date": "2026-01-02", "message": "m", "author_email": "e", "files": []}, {"sha": "a", "date": "2026-01-01", "message": "m", "author_email": "e", "files": ["x", "y"]}],
    }
    doc.update(changes)
    return {k: v for k, v in doc.items() if v is not None}


def saved(tmp_path, doc):
    path = tmp_path / "artifact.json"
    path.write_text(json.dumps(doc, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return str(path)


def test_artifact_round_trip(spark, tmp_path):
    path = saved(tmp_path, document())
    tables = import_artifact(read_artifact(spark, path))
    assert tables["symbols"].orderBy("id").first().language == "python"
    assert export_artifact(tables) == open(path, encoding="utf-8").read()
    write_tables(tables, str(tmp_path / "tables"))
    assert export_artifact(read_tables(spark, str(tmp_path / "tables"))) == open(path, encoding="utf-8").read()


def test_old_artifact_stays_old(spark, tmp_path):
    path = saved(tmp_path, document(version="1.0", extracted_at_sha=None, git_commits=None))
    assert export_artifact(import_artifact(read_artifact(spark, path))) == open(path, encoding="utf-8").read()


@pytest.mark.parametrize("changes", [{"version": "9.9"}, {"generator": {"extraction_model": "x"}}, {"symbols": None}, {"claims": [{"source": "s", "source_path": "p", "source_sha": "h", "severity": "hard", "claim": "c", "symbol_ids": ["sym:ts:no:No"]}]}])
def test_bad_artifacts(spark, tmp_path, changes):
    with pytest.raises(ArtifactError):
        import_artifact(read_artifact(spark, saved(tmp_path, document(**changes))))


def test_answers(spark):
    good = {"symbol_candidates": ["A"], "claim": "c", "severity": "hard", "rationale": "r", "excerpt": "e"}
    bad = [good | {"severity": "maybe"}, good | {"symbol_candidates": [1]}, good | {"claim": 5}, {"claim": "c"}, "text", None]
    raws = [json.dumps({"claims": [good, *bad, good]}), "{broken", json.dumps([good]), json.dumps({"claims": "x"}), json.dumps({"claims": []}), None]
    rows = parse_answers(spark.createDataFrame(list(enumerate(raws)), "n int, raw_json string"))
    assert {r.n: (r.ok, None if r.claims is None else len(r.claims)) for r in rows.collect()} == {0: (True, 2), 1: (False, None), 2: (False, None), 3: (False, None), 4: (True, 0), 5: (False, None)}
    assert [(r.ordinal, r.claim) for r in explode_claims(rows, "n").collect()] == [(0, "c"), (1, "c")]


def test_scans(spark, tmp_path):
    for name, text in {"docs/adr/ADR-01.md": "a", "docs/guide.MD": "g", "docs/.draft/x.md": "no", "docs/x.txt": "no", "src/a.ts": "a", "src/node_modules/b.ts": "no", "src/c.py": "c"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.rel_path for r in scan_markdown(spark, f"{tmp_path}/docs").collect()} == {"adr/ADR-01.md", "guide.MD"}
    prose = scan_prose(spark, [f"{tmp_path}/docs/adr"], [f"{tmp_path}/docs"], str(tmp_path)).collect()
    assert {(r.rel_path, r.bucket) for r in prose} == {("docs/adr/ADR-01.md", "adr"), ("docs/guide.MD", "doc")}
    assert {r.rel_path for r in scan_sources(spark, f"{tmp_path}/src").collect()} == {"a.ts", "c.py"}
    assert scan_markdown(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("given", [None, [], {}, {"languages": []}, {"languages": ["ruby"]}, {"languages": ["go", "go"]}, {"languages": ["go"], "x": 1}, {"languages": ["go"], "git": {"recent_commits": -1}}, {"languages": ["go"], "git": {"recent_commits": True}}, {"languages": ["go"], "adrs": "docs"}, {"languages": ["go"], "extraction": {"narrow_attribution": "off"}}, {"languages": ["go"], "serving": {"nope": 1}}, {"languages": ["go"], "version": 2}])
def test_bad_config(given):
    with pytest.raises(ConfigError):
        load_config(given)


def test_config():
    config = load_config({"version": 1, "languages": ["go", "python"], "git": {"recent_commits": 0}, "docs": {"include": ["docs/*.md"]}, "extraction": {"narrow_attribution": "drop", "budget_warn_usd": 2}})
    assert config.git.recent_commits == 0 and config.docs.include == ("docs/*.md",) and config.extraction.narrow_attribution == "drop" and config.adrs.path == "docs/adr"
    assert setting(None, 0, 5) == 0


FULL = """version: 1
languages:
  - typescript
  - python
adrs:
  path: docs/adr/   # where decisions are
  format: markdown-frontmatter
docs:
  include:
    - README.md
    - "docs/**/*.md"
git: {recent_commits: 10}
index:
  model: some-model
atlas:
  committed: false
  path: .a/b.json
"""


def test_a_configuration_file(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text(FULL)
    config = read_config(str(path))
    assert (config.languages, config.adrs.path, config.docs.include, config.git.recent_commits) == (("typescript", "python"), "docs/adr/", ("README.md", "docs/**/*.md"), 10)
    assert (config.artifact.committed, config.artifact.path, config.index.model) == (False, ".a/b.json", "some-model")
    for text, told in ((FULL + "extra: 1\n", "extra"), ("languages: [go\n", "line 1"), (FULL.replace("- python", " python: x: y"), "line 4"), (FULL + "artifact: {}\n", "twice"), ("", "mapping")):
        path.write_text(text)
        with pytest.raises(ConfigError, match=told):
            read_config(str(path))
    with pytest.raises(ConfigError, match="no such file"):
        read_config(str(tmp_path / "none.yml"))
