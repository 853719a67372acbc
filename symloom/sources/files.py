"""File scans: Markdown and source trees with their content hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.paths import EXTENSIONS, is_skipped
from symloom.sources.trees import located, scan_tree

SCANNED = "abs_path string, rel_path string, sha string, text string"


def _scan(spark: SparkSession, root: str, extensions: Sequence[str], skip: str) -> DataFrame:
    """(abs_path, rel_path, sha, text) of the files of a tree; a missing tree is empty."""
    top = "/" + located(root)[1].lstrip("/")
    return scan_tree(spark, root, extensions, skip).select(F.concat(F.lit(f"{top}/"), "rel_path").alias("abs_path"), "rel_path", "sha", "text")


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(abs_path, rel_path, sha, text) of the Markdown files below a folder, without dot entries."""
    return _scan(spark, root, [".md"], "dots")


def scan_prose(spark: SparkSession, adr_roots: Sequence[str], doc_roots: Sequence[str] = (), source_root: str | None = None) -> DataFrame:
    """Decision records and other documents with ``bucket``; a file in both is a decision record.

    Paths are told below ``source_root`` where they are in it, else below their own folder.
    """
    parts = [scan_markdown(spark, r).withColumn("bucket", F.lit(b)) for b, roots in (("adr", adr_roots), ("doc", doc_roots)) for r in roots]
    if not parts:
        return spark.createDataFrame([], SCANNED + ", bucket string")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = W.partitionBy("abs_path").orderBy("bucket", "rel_path")
    one = every.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if source_root is not None:
        top = source_root.rstrip("/") + "/"
        below = F.col("abs_path").startswith(top)
        one = one.withColumn("rel_path", F.when(below, F.substring("abs_path", len(top) + 1, 1 << 20)).otherwise(F.col("rel_path")))
    return one


def scan_sources(spark: SparkSession, root: str, extensions: Sequence[str] = tuple(EXTENSIONS)) -> DataFrame:
    """(abs_path, rel_path, sha, text) of source files, without left-out folders and dot entries."""
    named = reduce(Column.__or__, [F.col("rel_path").endswith(e) for e in extensions])
    return _scan(spark, root, extensions, "sources").where(named & ~is_skipped("rel_path"))
