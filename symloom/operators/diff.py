"""Incremental maintenance: four-way diffs, merges, cascading deletes and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.text import cost_usd


#: Ranges of batch numbers whose running totals are taken apart.
_RANGES = 64


def sha_diff(baseline: DataFrame, current: DataFrame, full: bool = False) -> DataFrame:
    """(path, status) for two tables (path, sha): unchanged, changed, added or deleted.

    A ``full`` run takes every current path as changed or added and reports no deletions.
    """
    old, new = baseline.select("path", F.col("sha").alias("old")), current.select("path", F.col("sha").alias("new"))
    if full:
        return new.join(old, "path", "left").select("path", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("status"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", status.alias("status"))


def to_extract(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("changed", "added")).select("path")


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` replacing those of equal keys; of repeated new rows the last in ``order`` wins."""
    if order:
        last = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        new = new.withColumn("__n", F.row_number().over(last).cast("long")).where("__n = 1").drop("__n")
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def merge_values(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value upsert: a full outer join in which new values win."""
    a, b = old.select(key, F.col(value).alias("__old")), new.select(key, F.col(value).alias("__new"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("__new", "__old").alias(value))


def delete_by_path(claims: DataFrame, claim_symbols: DataFrame, paths: DataFrame, column: str = "source_path") -> tuple[DataFrame, DataFrame]:
    """Claims and links without those of the given paths (path)."""
    gone = paths.select(F.col("path").alias(column)).distinct()
    kept = claims.join(gone, column, "left_anti")
    return kept, claim_symbols.join(kept.select("claim_id"), "claim_id", "left_semi")


def delete_symbols_by_path(symbols: DataFrame, claim_symbols: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = symbols.join(paths.select("path").distinct(), "path", "left_anti")
    return kept, claim_symbols.join(kept.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")


def _begins(sizes: DataFrame, column: str, ranges: int = _RANGES) -> list[str]:
    """Values that cut a column of texts into about equal ranges: at most ``ranges`` of them."""
    dealt = sizes.select(column).repartitionByRange(ranges, column).groupBy(F.spark_partition_id()).agg(F.min(column).alias("begin"))
    return sorted(r.begin for r in dealt.collect())[1:]


def numbered_claims(claims: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (source_path, ordinal, claim, ...) with ``claim_id``, numbered on from ``claims`` by (source_path, ordinal).

    No task sorts all new claims or all paths: rows are numbered within their path,
    paths are summed up within ranges of them, and ranges over each other.
    """
    top = claims.agg(F.coalesce(F.max("claim_id"), F.lit(0)).alias("top"))
    sizes = new.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    part = sum((F.when(F.col("source_path") >= F.lit(b), 1).otherwise(0) for b in _begins(sizes, "source_path")), F.lit(0))
    sizes = sizes.withColumn("part", part)
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    ranges = sizes.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("skipped"))
    before = W.partitionBy("part").orderBy("source_path").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.join(F.broadcast(ranges), "part").select("source_path", (F.col("skipped") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset"))
    within = F.row_number().over(W.partitionBy("source_path").orderBy("ordinal", "claim"))
    return new.join(offsets, "source_path").join(F.broadcast(top)).withColumn("claim_id", F.col("top") + F.col("offset") + within).drop("top", "offset")


def insert_claims(claims: DataFrame, claim_symbols: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append claims (with ``ordinal`` and ``symbol_ids``), numbered by ``numbered_claims``."""
    rows = numbered_claims(claims, new)
    links = rows.select("claim_id", F.explode(F.array_distinct("symbol_ids")).alias("symbol_id"))
    return claims.unionByName(rows.select(*claims.columns)), claim_symbols.unionByName(links.select(*claim_symbols.columns))


def usage_totals(usage: DataFrame) -> DataFrame:
    """One row: input_tokens, output_tokens, cost_usd; missing counts are 0."""
    one = usage.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")])
    return one.withColumn("cost_usd", cost_usd("input_tokens", "output_tokens"))


def budget_crossing(batches: DataFrame, budget: float) -> DataFrame:
    """(batch, spent): the first batch after which the summed cost exceeds the budget; empty if none.

    ``batches``: (batch, cost), summed by batch.  Running totals are taken within
    ranges of the batch number and added to the totals of the ranges before, so no
    task orders all batches.
    """
    per = batches.groupBy("batch").agg(F.sum("cost").alias("cost"))
    cuts = sorted(set(per.select(F.col("batch").cast("double").alias("batch")).approxQuantile("batch", [k / _RANGES for k in range(1, _RANGES)], 0.01)))
    part = sum((F.when(F.col("batch") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    per = per.withColumn("part", part)
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    totals = per.groupBy("part").agg(F.sum("cost").alias("total")).select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("part").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    running = per.join(F.broadcast(totals), "part").withColumn("spent", F.col("before") + F.sum("cost").over(within))
    return running.where(F.col("spent") > budget).orderBy("batch").limit(1).select("batch", "spent")


def staleness(extracted_sha: str | None, head_sha: str | None) -> tuple[str, int]:
    """Status and exit code of an artifact against the current revision."""
    if not extracted_sha or not head_sha:
        return "unknown", 2
    return ("current", 0) if extracted_sha == head_sha else ("stale", 1)


def staleness_of(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` (extracted_sha, head_sha, ...) with ``status`` and ``exit_code``."""
    missing = (F.coalesce("extracted_sha", F.lit("")) == "") | (F.coalesce("head_sha", F.lit("")) == "")
    status = F.when(missing, "unknown").when(F.col("extracted_sha") == F.col("head_sha"), "current").otherwise("stale")
    code = F.when(missing, 2).when(F.col("extracted_sha") == F.col("head_sha"), 0).otherwise(1)
    return artifacts.withColumns({"status": status, "exit_code": code})
