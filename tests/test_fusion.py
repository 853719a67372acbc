import json

import pytest
from pyspark.sql import functions as F

from symloom.operators.fusion import Knowledge, impact_of_change, impact_risks, reference_clusters, symbol_contexts
from symloom.operators.history import pivot_files
from symloom.operators.intent import find_by_intent
from symloom.operators.resolve import resolve_symbols
from symloom.plans import render
from symloom.schemas import SIGNALS

QUEUE = "sym:ts:src/orders/queue.ts:Queue"


@pytest.fixture(scope="module")
def know(spark):
    symbols = spark.createDataFrame([(QUEUE, "Queue", "class", "src/orders/queue.ts", 7, "class Queue extends Base"), ("sym:ts:src/x.ts:Bare", "Bare", "function", "src/x.ts", 1, None)], "id string, name string, kind string, path string, line int, signature string")
    claims = spark.createDataFrame([(1, "ADR-02", "d", "s", "soft", "prefer batches", None, None), (2, "ADR-01", "d", "s", "hard", 'must be "safe"', "retries", "quoted text")], "claim_id long, source string, source_path string, source_sha string, severity string, claim string, rationale string, excerpt string")
    links = spark.createDataFrame([(1, QUEUE), (2, QUEUE)], "claim_id long, symbol_id string")
    paths = ["src/billing/a.ts", "src/billing/b.ts", "src/orders/queue.test.ts", "src/billing/a.ts", "src/admin/c.ts"]
    refs = spark.createDataFrame([(i, f"ref:ts:{p}:{i}", QUEUE, p, i, None) for i, p in enumerate(paths)], "ordinal int, ref_id string, symbol_id string, path string, line int, col int")
    edges = spark.createDataFrame([(QUEUE, "extends", "Base", 0), (QUEUE, "used_by", "B", 1), (QUEUE, "used_by", "A", 0)], "symbol_id string, relation string, name string, ordinal int")
    notes = spark.createDataFrame([("src/orders/queue.ts", 3, None, "warning", "unused")], "path string, line int, col int, severity string, message string")
    commits, files = pivot_files(spark.createDataFrame([("a" * 40, "2026-01-02T03:04:05Z", "fix", "p@e", ["src/orders/queue.ts", "src/long/name.ts", "z.ts"]), ("b" * 40, "2026-01-01T00:00:00Z", "add", "q@e", ["src/orders/queue.ts", "z.ts"])], "sha string, date string, message string, author_email string, files array<string>"))
    return Knowledge(symbols, claims, links, refs, edges, notes, commits, files)


def wanted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "symbol_id string")


def test_clusters(know):
    rows = reference_clusters(know.refs, 2).orderBy("place").collect()
    assert [(r.module, r["count"], len(r.top_ids)) for r in rows] == [("billing", 3, 2), ("orders", 1, 1), ("admin", 1, 1)]


def test_bundle(spark, know):
    row = {r.name: r for r in symbol_contexts(wanted(spark, QUEUE, "sym:ts:src/x.ts:Bare"), know, recent=2).collect()}
    q, bare = row["Queue"], row["Bare"]
    assert [c.claim_id for c in q.intent] == [2, 1] and q.refs["count"] == 5 and q.tests.files == ["src/orders/queue.test.ts"]
    assert q.types.used_by == ["A", "B"] and q.git.hot and q.git.last_author == "p@e" and q.diagnostics[0].message == "unused"
    assert bare.intent == [] and bare.refs is None and bare.git is None and bare.tests is None and bare.diagnostics is None


def test_include_gates_signals_but_not_diagnostics(spark, know):
    row = symbol_contexts(wanted(spark, QUEUE), know, include=["git"]).first()
    assert row.intent is None and row.refs is None and row.git is not None and len(row.diagnostics) == 1
    with pytest.raises(ValueError):
        symbol_contexts(wanted(spark, QUEUE), know, include=["nope"])


def test_compact_text(spark, know):
    bundles = symbol_contexts(wanted(spark, QUEUE), know, recent=5)
    text = {d: bundles.select(render.compact(bundles, d).alias("t")).first().t for d in ("summary", "standard", "deep")}
    head = "SYM Queue@src/orders/queue.ts:7 class\n  SIG class Queue extends Base\n"
    git = "  GIT last=2026-01-02T03:04:05Z by p@e cold (2<5 commits)\n"
    diag = '  DIAG warning "unused" @line:3\n'
    assert text["summary"] == head + '  INTENT hard:1 soft:1 context:0; top="must be \\"safe\\"" (ADR-01)\n' + git + diag
    commits = f'    COMMIT {"a" * 7} 2026-01-02 "fix"\n    COMMIT {"b" * 7} 2026-01-01 "add"\n'
    claims = '  INTENT ADR-01 hard "must be \\"safe\\""\n    RATIONALE "retries"\n'
    tops = "".join(f"    TOP ref:ts:{p}\n" for p in ("src/billing/a.ts:0", "src/billing/b.ts:1", "src/billing/a.ts:3"))
    assert text["standard"] == head + claims + '  INTENT ADR-02 soft "prefer batches"\n  REFS 5 [billing:3 orders:1 admin:1]\n' + tops + "  TESTS src/orders/queue.test.ts\n" + git + commits + diag
    assert "    EXCERPT \"quoted text\"\n" in text["deep"] and "  TYPES extends=Base implements=[] used_by=[A, B]\n" in text["deep"] and text["deep"].count("    REF ") == 5
    few = bundles.select(render.compact(bundles, "deep", 2).alias("t")).first().t
    assert few.count("    REF ") == 2 and "    ... +3 more\n" in few


def test_impact(spark, know):
    rows = impact_of_change(wanted(spark, QUEUE), know, recent=2)
    row = rows.first()
    assert [(c.other_path, c.commits) for c in row.co_change] == [("z.ts", 2), ("src/long/name.ts", 1)]
    assert row.risk.asDict() == {"hot": True, "commit_count": 2, "hot_threshold": 2, "test_files": 1, "diagnostics": 1, "hard_claims": 1, "soft_claims": 1, "context_claims": 0}
    text = rows.select(render.compact_impact(rows).alias("t")).first().t
    assert text.startswith(f"IMPACT {QUEUE}\n  GIT_COCHANGE (top 2)\n    z.ts              2 commits\n    src/long/name.ts  1 commits\n  RISK_SIGNALS\n    hot: yes (2≥2 commits)\n    test_coverage: 1 test file(s) referenced\n    diagnostics: 1\n    intent_density: 1 hard / 1 soft / 0 context\nSYM Queue@")


@pytest.mark.parametrize("recent", [0, 2, 5])
def test_risks_are_those_of_the_bundles_without_their_lists(spark, know, recent):
    every = know.symbols.select(F.col("id").alias("symbol_id"))
    for tables, include in ((know, SIGNALS), (know, ["tests"]), (Knowledge(know.symbols), SIGNALS)):
        told = impact_risks(every, tables, include, recent)
        want = impact_of_change(every, tables, include, recent).select("symbol_id", "risk", "co_change")
        assert sorted(told.select("symbol_id", "risk", "co_change").collect()) == sorted(want.collect())
        plan = told.drop("co_change")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_" not in plan and "Window" not in plan


def test_missing_tables_are_missing_sections(spark, know):
    row = impact_of_change(wanted(spark, QUEUE), Knowledge(know.symbols)).first()
    assert row.co_change == [] and row.risk.commit_count == 0 and row.intent is None


def test_matches_and_errors(spark, know):
    found = find_by_intent(know.claims, know.claim_symbols, know.symbols, "prefer batches")
    assert render.compact_matches(found, 'say "x"').first().text == f'MATCHES 1 [query="say \\"x\\""]\n  SYM {QUEUE} src/orders/queue.ts:7 class\n    SIG class Queue extends Base\n    INTENT ADR-02 soft "prefer batches"\n'
    assert render.compact_matches(found.limit(0), "x").first().text == 'MATCHES 0 [query="x"]\n'
    two = know.symbols.unionByName(know.symbols.withColumn("id", F.concat("id", F.lit("2"))))
    asked = spark.createDataFrame([(0, "Queue", None), (1, "None", None)], "input_pos int, input string, file_hint string")
    errors = {r.input_pos: r for r in render.error_text(resolve_symbols(asked, two), two).collect()}
    assert errors[0].text.startswith("ERR disambiguation_required\n  MESSAGE Symbol 'Queue' matches 2 candidates.") and errors[0].text.count("  CAND ") == 2
    assert errors[1].text.startswith("ERR not_found\n  MESSAGE Symbol 'None' not found. Try")


def test_envelopes(spark):
    rows = spark.createDataFrame([(1, "B", "b\n", True), (0, "A", "a\n", False)], "input_pos int, input string, text string, failed boolean")
    one = render.envelope(rows).first()
    assert one.text == "--- get_symbol_context: A (1 of 2) ---\na\n\n--- get_symbol_context: B (2 of 2) ---\nb\n" and not one.is_error
    failed = render.envelope(rows.where("failed")).first()
    assert failed.is_error and failed.text.startswith("ERR all_symbols_failed\n  COUNT 1\n\n---")
    both = spark.createDataFrame([(0, "A", (1,), None), (1, "B", None, ("not_found",))], "input_pos int, input string, bundle struct<x:int>, error struct<code:string>")
    assert json.loads(render.envelope_json(both).first().json) == {"results": [{"symbol": "A", "bundle": {"x": 1}, "error": None}, {"symbol": "B", "bundle": None, "error": {"code": "not_found"}}]}


def test_summary():
    assert render.summary_text({"files": 2, "cost": 0.5, "full": False}) == "files=2\ncost=0.5000\nfull=false\n"
