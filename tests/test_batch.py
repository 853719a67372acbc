import json

import pytest
from pyspark.sql import functions as F

from symloom.operators.fusion import Knowledge, readable
from symloom.operators.resolve import symbols_of_paths, symbols_where
from symloom.operators.types import known_kinds
from symloom.plans.batch import UnknownTool, call, context_batch
from symloom.plans.render import SUMMARY, run_summary, summary_text_of
from symloom.sources.artifact import cleared, is_empty, same_content, setting_of, source_sha_of, write_artifact
from symloom.schemas import CLAIM_SYMBOLS, CLAIMS, COMMITS, FILE_COMMITS, META, SOURCE_SHAS, SYMBOLS


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [(f"sym:ts:src/{f}.ts:{n}", n, "class", f"src/{f}.ts", 3, None, None, "0", "typescript") for f, n in (("a", "One"), ("a", "Two"), ("b", "Two"))]
    return spark.createDataFrame(rows, SYMBOLS)


@pytest.fixture(scope="module")
def tables(spark, symbols):
    claims = [(1, "d", "d.md", "0", "hard", "c", None, None)]
    return {
        "symbols": symbols, "claims": spark.createDataFrame(claims, CLAIMS), "claim_symbols": spark.createDataFrame([(1, "sym:ts:src/a.ts:One")], CLAIM_SYMBOLS), "commits": spark.createDataFrame([], COMMITS),
        "file_commits": spark.createDataFrame([], FILE_COMMITS), "source_shas": spark.createDataFrame([("d.md", "abc")], SOURCE_SHAS), "meta": spark.createDataFrame([("version", "1.2"), ("generator.x_version", "1")], META),
    }


def test_batch_in_order_with_its_errors(spark, symbols):
    know = Knowledge(symbols)
    row = context_batch(spark, ["Two", "One", " One", "None"], know).first()
    assert not row.is_error
    heads = [line for line in row.text.split("\n") if line.startswith("---")]
    assert heads == [f"--- get_symbol_context: {n} ({k} of 3) ---" for k, n in enumerate(("Two", "One", "None"), 1)]
    assert "ERR disambiguation_required" in row.text and "ERR not_found" in row.text and "SYM One@src/a.ts:3 class" in row.text
    assert context_batch(spark, ["Two"], know, file_hint="src/b").first().text.startswith("--- get_symbol_context: Two (1 of 1) ---\nSYM Two@src/b.ts")
    assert context_batch(spark, ["None"], know).first().is_error


def test_batch_as_json(spark, symbols):
    done = json.loads(context_batch(spark, ["Two", "One"], Knowledge(symbols), output="json").first().json)["results"]
    assert [r["symbol"] for r in done] == ["Two", "One"]
    assert done[0]["bundle"] is None and done[0]["error"]["code"] == "disambiguation_required"
    assert done[1]["error"] is None and done[1]["bundle"]["path"] == "src/a.ts"


def test_requests_are_checked_before_any_plan(spark, symbols):
    know = Knowledge(symbols)
    for wrong in ({"depth": "most"}, {"output": "xml"}, {"include": ["all"]}):
        with pytest.raises(ValueError):
            context_batch(spark, ["One"], know, **wrong)
    with pytest.raises(ValueError):
        context_batch(spark, [], know)
    with pytest.raises(ValueError):
        context_batch(spark, [f"n{k}" for k in range(11)], know)
    with pytest.raises(ValueError):
        call(spark, "find_by_intent", know, query="  ")
    with pytest.raises(UnknownTool):
        call(spark, "drop_everything", know)
    with pytest.raises(RuntimeError):
        call(spark, "get_symbol_context", None, symbols=["One"])
    assert call(spark, "impact_of_change", know, symbol="One").first().text.startswith("IMPACT sym:ts:src/a.ts:One\n")
    assert call(spark, "impact_of_change", know, symbol="Two").first().is_error


def test_claims_are_ranked_only_where_ranking_is_on(spark, symbols):
    claims = spark.createDataFrame([(k, "d", "d.md", "0", s, t, None, None) for k, s, t in ((1, "hard", "other words"), (2, "soft", "retry policy"), (3, "soft", "nothing"), (4, "soft", "more"))], CLAIMS)
    links = spark.createDataFrame([(k, "sym:ts:src/a.ts:One") for k in (1, 2, 3, 4)], CLAIM_SYMBOLS)
    know = Knowledge(symbols, claims, links)
    texts = [context_batch(spark, ["One"], know, query="retry", ranking=on).first().text for on in (True, False)]
    first = [next(line for line in t.split("\n") if "INTENT" in line) for t in texts]
    assert "retry policy" in first[0] and "other words" in first[1]


def test_known_kinds(spark):
    rows = spark.createDataFrame([("a", "class"), ("b", "other")], "name string, kind string")
    assert [r.name for r in known_kinds(rows).collect()] == ["a"]


def test_summary_has_its_lines_and_details():
    lines = run_summary({"claims_written": 3, "cost_usd": 0.5}).splitlines()
    assert [line.split("=")[0] for line in lines] == list(SUMMARY) and "cost_usd=0.5000" in lines and "extracted_at_sha=null" in lines and "atlas_exported=false" in lines
    done = json.loads(run_summary({"cost_usd": 0.123456}, True, [("a.md", ["x"]), ("b.md", [])], ["boom"]))
    assert done["frontmatter_unresolved_by_file"] == [{"source_path": "a.md", "symbols": ["x"]}]
    assert done["cost_usd"] == 0.1235 and done["extraction_errors"] == ["boom"] and done["extracted_at_sha"] is None


def test_summary_of_columns(spark):
    counters = {"files_extracted": 3, "cost_usd": 1.23456, "atlas_exported": True, "extracted_at_sha": None, "input_tokens": 7}
    row = spark.createDataFrame([(3, 1.23456, True, None, 7)], "files_extracted int, cost_usd double, atlas_exported boolean, extracted_at_sha string, input_tokens long")
    told = {n: F.col(n) if n in counters else F.lit(0) for n in SUMMARY}
    assert row.select(summary_text_of(told).alias("t")).first().t == run_summary(counters)


def test_stored_tables(spark, tables, tmp_path):
    assert not is_empty(tables) and is_empty(cleared(tables, "symbols"))
    less = cleared(tables, "claims")
    assert less["claims"].isEmpty() and less["claim_symbols"].isEmpty() and not less["symbols"].isEmpty()
    assert [setting_of(tables, "version", *a) for a in ((), ("9",))] == ["1.2", "9"] and setting_of(tables, "none", None, "d") == "d"
    asked = spark.createDataFrame([("d.md",), ("e.md",)], "path string")
    assert {r.path: r.source_sha for r in source_sha_of(tables, asked).collect()} == {"d.md": "abc", "e.md": None}
    write_artifact(tables, str(tmp_path / "a.json"), generated_at="now")
    write_artifact(tables, str(tmp_path / "b.json"), generated_at="later")
    one, two = ((tmp_path / f).read_text() for f in ("a.json", "b.json"))
    assert one != two and same_content(one, two) and one.endswith("}\n")
    assert not same_content(one, one.replace("hard", "soft"))


@pytest.mark.parametrize("wrong", [{"max_refs": -1}, {"max_refs": 1.5}, {"max_refs": True}, {"max_refs": "3"}, {"include": "refs"}, {"include": ["refs", "colour"]}, {"include": [1]}])
def test_values_of_requests_are_checked(spark, symbols, wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        context_batch(spark, ["One"], Knowledge(symbols), **wrong)
    assert not context_batch(spark, ["One"], Knowledge(symbols), max_refs=0, include=[]).first().is_error


def test_limits_are_whole_numbers(spark, symbols, tables):
    know = Knowledge(symbols, tables["claims"], tables["claim_symbols"])
    for limit in (2.5, None, True, "5"):
        with pytest.raises(ValueError, match="limit"):
            call(spark, "find_by_intent", know, query="c", limit=limit)
    assert "One" in call(spark, "find_by_intent", know, query="c", limit=9999).first().text
    with pytest.raises(ValueError, match="recent"):
        call(spark, "impact_of_change", know, symbol="One", recent=-1)


def test_lookups(spark, symbols):
    assert [r.id for r in symbols_where(symbols, path="src/a.ts").collect()] == ["sym:ts:src/a.ts:One", "sym:ts:src/a.ts:Two"]
    assert [r.path for r in symbols_where(symbols, name="Two").collect()] == ["src/a.ts", "src/b.ts"] and symbols_where(symbols, id="no").count() == 0
    assert symbols_of_paths(symbols, spark.createDataFrame([("src/b.ts",), ("src/b.ts",), ("none",)], "path string")).count() == 1


def test_a_failing_signal_is_absent(spark, symbols, tables, tmp_path):
    """One that is not there, one whose rows cannot be read, one that its source refuses."""
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")

    def refused():
        raise RuntimeError("the server is gone")

    know, failed = readable({
        "symbols": lambda: symbols, "claims": lambda: tables["claims"], "claim_symbols": lambda: tables["claim_symbols"],
        "refs": lambda: spark.read.parquet(f"{tmp_path}/none"), "type_edges": refused, "diagnostics": lambda: spark.read.schema("path string, line int").parquet(f"{tmp_path}/bad"), "commits": lambda: spark.range(1).select(F.raise_error(F.lit("broken"))),
    })
    assert set(failed) == {"refs", "type_edges", "diagnostics", "commits"} and failed["type_edges"] == "the server is gone"
    text = context_batch(spark, ["One"], know).first().text
    assert "SYM One@src/a.ts:3 class" in text and "d.md" not in text and "c" in text
    with pytest.raises(RuntimeError):
        readable({"symbols": refused})
