"""Operators whose rows must stay in proportion: positions in ranges, files that change together."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from __spark_entry__ import queries
from symloom.operators import history
from symloom.operators.fusion import Knowledge, symbol_contexts
from symloom.operators.history import co_change_candidates, co_change_pairs, co_change_top, file_activity, file_history, recent_commits
from symloom.operators.resolve import dealt_ranges, enclosing_symbols
from tests.sqlcheck import SF_DIR

RANGES = "path string, symbol_id string, depth int, start_line int, start_character int, end_line int, end_character int"
POSITIONS = "path string, line int, character int"


def plain_enclosing(positions, ranges):
    out = set()
    for path, line, character in positions:
        inside = [(-r[2], -r[3], -r[4], r[1]) for r in ranges if r[0] == path and (r[3], r[4]) <= (line, character) <= (r[5], r[6])]
        if inside:
            out.add((path, line, character, min(inside)[3]))
    return out


def nested(rng, path, first, last, depth=0, found=None):
    found = [] if found is None else found
    found.append((path, f"s{len(found)}{path}", depth, first, rng.randint(0, 3), last, rng.randint(4, 9)))
    while depth < 5 and first + 1 < last and rng.random() < 0.8:
        end = rng.randint(first + 1, last - 1)
        nested(rng, path, first + 1, end, depth + 1, found)
        first = end + 1
    return found


@pytest.mark.parametrize("lines", [1, 7, 512])
def test_sweep_equals_plain_containment(spark, lines):
    rng = random.Random(lines)
    ranges = [r for p in "abc" for r in nested(rng, p, 0, 120)]
    ranges += [("d", f"o{i}", rng.randint(0, 2), a := rng.randint(0, 40), rng.randint(0, 9), a + rng.randint(0, 30), rng.randint(0, 9)) for i in range(60)]  # overlapping in any way
    ranges += [("d", "o1", 0, 3, 3, 3, 3), ("only-ranges", "x", 0, 0, 0, 9, 9), (None, "y", 0, 0, 0, 9, 9)]
    positions = [(rng.choice("abcd"), rng.randint(0, 130), rng.randint(0, 9)) for _ in range(600)] + [("no-ranges", 1, 1), ("d", 3, 3), ("d", 3, 3), (None, 1, 1), ("a", None, 1)]
    got = enclosing_symbols(spark.createDataFrame(positions, POSITIONS).repartition(3), spark.createDataFrame(ranges, RANGES), lines)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["path", "line", "character", "symbol_id"] and len(rows) == len(set(rows))
    assert set(rows) == plain_enclosing([p for p in positions if None not in p], ranges)


def test_a_file_of_many_positions_and_ranges_is_linear(spark):
    n = 100_000
    ranges = spark.range(n).select(F.lit("f").alias("path"), F.concat(F.lit("s"), "id").alias("symbol_id"), F.lit(1).alias("depth"), (2 * F.col("id")).cast("int").alias("start_line"), F.lit(0).alias("start_character"), (2 * F.col("id") + 1).cast("int").alias("end_line"), F.lit(9).alias("end_character"))
    ranges = ranges.union(spark.createDataFrame([("f", "outer", 0, 0, 0, 3 * n, 0)], RANGES))
    positions = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 2 + F.col("id") % 2).cast("int").alias("line"), F.lit(5).alias("character"))
    assert dealt_ranges(positions, ranges).count() <= 1.01 * n + 2 * n / 512 + 1
    got = enclosing_symbols(positions, ranges)
    assert got.where(F.col("symbol_id") == F.concat(F.lit("s"), (F.col("line") / 2).cast("int"))).count() == n == got.count()


def plain_top(pairs, k):
    order = W.partitionBy("file_path").orderBy(F.desc("commits"), "other_path")
    return {(r.file_path, r.other_path, r.commits, r.place) for r in pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).collect()}


def top_of(df):
    return {(r.file_path, r.other_path, r.commits, r.place) for r in df.collect()}


@pytest.mark.parametrize(("seed", "large", "k"), [(1, 4, 3), (2, 6, 5), (3, 1, 2), (4, 10, 1)])
def test_bounded_co_change_equals_all_pairs(spark, seed, large, k):
    rng = random.Random(seed)
    files = [f"f{i:02d}" for i in range(40)]
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 9, 25])
        core = files[: rng.choice([6, 20, 40])]
        rows += [(f, f"c{c}") for f in rng.sample(core, min(n, len(core)))]
    table = spark.createDataFrame(rows + rows[:5], "file_path string, commit_sha string")
    assert top_of(co_change_top(table, None, k, large=large)) == plain_top(co_change_pairs(table), k)
    some = spark.createDataFrame([("f03",), ("f11",), ("f11",), ("none",)], "file_path string")
    assert top_of(co_change_top(table, some, k, large=large)) == plain_top(co_change_pairs(table, some), k)
    assert top_of(co_change_top(table, None, k, max_files=9, large=large)) == plain_top(co_change_pairs(table, max_files=9), k)


def test_a_commit_of_many_files_costs_rows_in_proportion(spark):
    """A first commit of 20,000 files, a second of half of them, and small ones."""
    n = 20_000
    name = F.format_string("f%05d", F.col("id"))
    all_files = spark.range(n).select(name.alias("file_path"), F.lit("first").alias("commit_sha"))
    half = spark.range(0, n, 2).select(name.alias("file_path"), F.lit("second").alias("commit_sha"))
    small = spark.range(n).where("id % 5 < 2").select(name.alias("file_path"), F.format_string("s%d", F.floor(F.col("id") / 5)).alias("commit_sha"))
    table = all_files.union(half).union(small)
    found = co_change_candidates(table, None, 5)
    assert found.count() < 8 * n
    top = {(r.file_path, r.place): (r.other_path, r.commits) for r in co_change_top(table).where(F.col("file_path").isin("f00005", "f00006", "f00004", "f19999")).collect()}
    assert top[("f00005", 1)] == ("f00006", 2) and [top[("f00005", p)][0] for p in range(2, 6)] == ["f00000", "f00001", "f00002", "f00003"]
    assert [top[("f00006", p)] for p in range(1, 6)] == [("f00000", 2), ("f00002", 2), ("f00004", 2), ("f00005", 2), ("f00008", 2)]
    assert [top[("f19999", p)] for p in range(1, 6)] == [(f"f0000{i}", 1) for i in range(5)]
    assert [top[("f00004", p)][1] for p in range(1, 6)] == [2] * 5


@pytest.mark.parametrize("few", [0, 256])
def test_pairs_beside_large_commits_are_shuffled_once(spark, monkeypatch, few):
    """Classes come into the pairs with the files; the same rows where classes are too many for that."""
    monkeypatch.setattr(history, "FEW_CLASSES", few)
    rng = random.Random(few)
    rows = [(f"f{i:03}", f"all{c}") for c in range(3) for i in range(90) if rng.random() < 0.8] + [(f"f{rng.randint(0, 99):03}", f"s{rng.randint(0, 120)}") for _ in range(500)]
    table = spark.createDataFrame(rows, "file_path string, commit_sha string")
    top = co_change_top(table, None, 5, large=40)
    assert top_of(top) == plain_top(co_change_pairs(table), 5)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression [file_path" in line]
    assert len(moved) == (1 if few else 0)


def test_pairs_of_files_are_shuffled_once_for_their_tops(spark):
    """Windows over a file's pairs need no second shuffle of them."""
    files = spark.range(400).select((F.col("id") % 40).cast("string").alias("file_path"), (F.col("id") % 23).cast("string").alias("commit_sha"))
    wanted = spark.range(9).select(F.col("id").cast("string").alias("file_path"))
    top = co_change_top(files, wanted)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_path" in plan and not [line for line in plan.splitlines() if "hashpartitioning(file_path" in line and "other_path" in line]
    names = {r.file_path for r in wanted.collect()}
    assert {tuple(r) for r in top.select("file_path", "other_path", "commits", "place").collect()} == {t for t in plain_top(co_change_pairs(files), 5) if t[0] in names}


@pytest.mark.parametrize("n", [0, 2, 5])
def test_history_of_files_is_read_in_one_pass(spark, n):
    rng = random.Random(n)
    commits = spark.createDataFrame([(f"s{i:02}", f"2024-01-{rng.randint(1, 9):02}", f"m{i}", f"a{i % 4}") for i in range(40)], "sha string, date string, message string, author_email string")
    files = spark.createDataFrame([(f"f{rng.randint(0, 9)}", f"s{rng.randint(0, 45):02}") for _ in range(150)], "file_path string, commit_sha string")
    got = file_history(commits, files, n)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 1
    assert sorted(got.drop("recent_commits").collect()) == sorted(file_activity(commits, files, n).collect())
    listed = {(r.file_path, c.sha, c.date, c.message, c.author_email, i + 1) for r in got.collect() for i, c in enumerate(r.recent_commits)}
    assert listed == {(r.file_path, r.sha, r.date, r.message, r.author_email, r.place) for r in recent_commits(commits, files, n).collect()}


def test_bundles_read_commits_once(spark):
    commits = spark.createDataFrame([("s1", "2024-01-01", "m", "a")], "sha string, date string, message string, author_email string")
    files = spark.createDataFrame([("f", "s1")], "file_path string, commit_sha string")
    symbols = spark.createDataFrame([("i", "n", "class", "f", 1, None)], "id string, name string, kind string, path string, line int, signature string")
    got = symbol_contexts(symbols.select(F.col("id").alias("symbol_id")), Knowledge(symbols, commits=commits, file_commits=files), ["git"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[sha#") == 1
    assert got.first().git.asDict(True) == {"commit_count": 1, "last_touched": "2024-01-01", "last_author": "a", "hot": False, "hot_threshold": 5, "recent_commits": [{"sha": "s1", "date": "2024-01-01", "message": "m", "author_email": "a"}]}


def test_bundles_of_types_stay_dealt(spark):
    """Small bytes are many rows: the last joins are not put into one task."""
    found = queries()["compact_types"](spark, SF_DIR)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
