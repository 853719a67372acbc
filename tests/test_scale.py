"""Plans that must not grow a single task or the driver with the input."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from symloom.operators import history, types
from symloom.operators.resolve import attribute_claims, documented_claims, resolved_sets


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def parts(spark, tmp_path):
    """Parts in one small file, as a scan of the tables has them."""
    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["python_heritage", "python_used_by", "docstring_lookup", "go_lookup"])
def test_tables_that_grow_with_the_files_are_not_broadcast(spark, parts, name):
    plan = plan_of(queries()[name](spark, parts))
    assert "BroadcastExchange" not in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["python_symbol_kinds", "python_shapes"])
def test_texts_of_symbols_are_not_broadcast_and_go_to_python_once(spark, parts, name):
    found = queries()[name](spark, parts)
    plan = plan_of(found)
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_a_file_is_parsed_once_for_all_of_its_symbols(spark):
    text = "class A(B):\n    pass\nx = 1\n"
    files = spark.createDataFrame([("f", text), ("g", None), ("h", text)], "path string, text string")
    flat = spark.createDataFrame([("f", "A", 5, 0), ("f", "x", 13, 2), ("f", "x", 13, 2), ("f", "?", 99, 0), ("g", "x", 14, 7), ("none", "x", 14, 0)], "path string, name string, kind int, line int")
    got = sorted(tuple(r) for r in types.python_symbols(flat, files).collect())
    assert got == [("f", "A", "class", 0, "class A(B)"), ("f", "x", "variable", 2, None), ("f", "x", "variable", 2, None), ("g", "x", "variable", 7, None)]


def test_an_exported_document_reaches_its_file_in_pieces(spark, tmp_path, monkeypatch):
    """No task and no local row holds the text: the Python worker that had the text of 1.2 million symbols failed."""
    spark.range(3000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    held, made = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: held.append(len(str(data))) or made(self, data, *a, **k))
    assert queries()["artifact_file"](spark, str(tmp_path)).where("signature = 'class b'").count() == 1000
    assert max(held) < 1000


def test_imports_are_those_of_all_statements():
    from symloom.functions.parsers import import_aliases

    text = "def f():\n    import a as x\n    try:\n        from b import c as y\n    except E:\n        from d import e as z\nfrom g import h as y\nmatch v:\n    case 1:\n        from i import j as w\n"
    assert {k: v for k, v in import_aliases(text).items() if len(k) == 1} == {"y": "c", "z": "e", "w": "j"}


def test_claims_with_the_same_candidates_are_resolved_once(spark):
    n, m = 300, 400
    symbols = spark.range(m).select(F.col("id").cast("string").alias("id"), F.lit("same").alias("name"))
    claims = spark.range(n).select(F.col("id").alias("claim_id"), F.concat(F.lit("own"), "id").alias("documented_id"), F.lit("d").alias("source_path"), F.array(F.lit("same"), F.lit("same"), F.lit("none")).alias("symbol_candidates"))
    sets = resolved_sets(claims, symbols).collect()
    every = sorted(map(str, range(m)))
    assert [r.resolved for r in sets] == [every]  # one row, not n * m links
    blank = spark.createDataFrame([(n, "7", "d", ["same"]), (n + 1, None, "d", ["none"]), (n + 2, "z", "d", None), (n + 3, None, "d", None)], "claim_id long, documented_id string, source_path string, symbol_candidates array<string>")
    told = {r.claim_id: r.symbol_ids for r in documented_claims(claims.unionByName(blank), symbols).collect()}
    assert told[5] == sorted([*every, "own5"]) and told[n] == every and told[n + 1] == [] and told[n + 2] == ["z"] and told[n + 3] == [] and len(told) == n + 4
    front = spark.createDataFrame([("d", ["same"])], "source_path string, symbols array<string>")
    out = attribute_claims(claims.unionByName(blank), symbols, front, "drop")
    assert {r.claim_id: r.symbol_ids for r in out.collect()}[n + 1] == [] and out.columns == [*claims.columns, "symbol_ids"]


def test_tasks_that_pair_files_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(history, "PAIRED", 50)
    table = spark.range(2000).select((F.col("id") % 40).alias("file_path"), (F.col("id") / 4).cast("int").alias("commit_sha"))
    found = history.co_change_pairs(table)
    assert "40), REPARTITION_BY_NUM" in plan_of(found)
    assert found.agg(F.sum("commits").alias("n")).first().n == 2000 * 3


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_elements_of_a_document_are_read_in_pieces(size):
    import io
    import json

    from symloom.sources.artifact import ArtifactError, _members

    document = {"version": "1.3", "n": 12345, "source_shas": {"a\\": "é]}", 'b"': "2"}, "symbols": [{"id": 'x"}],[{', "line": 12}, None, {"l": [1, [2]]}], "claims": [], "generator": {"x_version": "1"}}
    for text in (json.dumps(document), json.dumps(document, indent=2, ensure_ascii=False) + "\n"):
        read = io.BytesIO(text.encode()).read
        held = []
        rows = list(_members(lambda n: held.append(n) or read(n), size))
        head = {}
        for section, _, part in rows:
            head |= json.loads(part) if section == "" else {}
        assert head == document | {"symbols": [], "source_shas": []}
        assert [json.loads(t) for s, _, t in rows if s == "symbols"] == document["symbols"] and [a for s, a, _ in rows if s == "symbols"] == [0, 1, 2]
        assert [json.loads(t) for s, _, t in rows if s == "source_shas"] == [{"source_path": k, "source_sha": v} for k, v in document["source_shas"].items()]
    for text in ("", "{", "[]", '{"symbols": [1,]}', '{"symbols": [1 2]}', '{"a": 1,}', "{} x", '{"a": 1, "a": 2}', '{"symbols": [{]}', "{1: 2}"):
        with pytest.raises(ArtifactError):
            list(_members(io.BytesIO(text.encode()).read, size))


def test_no_row_has_an_imported_document(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    found = queries()["artifact_file"](spark, str(tmp_path))
    assert "Generate" not in plan_of(found) and sorted(r.place for r in found.collect()) == list(range(1, 301))
