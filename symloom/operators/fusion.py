"""Fused context of many symbols in one plan, and the impact of a change."""

from __future__ import annotations

import logging
from collections.abc import Callable, Collection
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.paths import is_test_file, module_key
from symloom.operators.history import CO_CHANGE_LIMIT, RECENT, co_change_top, file_history
from symloom.operators.intent import ranked_claims, severity_histogram
from symloom.schemas import SIGNALS

_LOG = logging.getLogger(__name__)

DEFAULT_REFS = 20


@dataclass
class Knowledge:
    """The tables of a code base; a missing one means that its signal is absent."""

    symbols: DataFrame
    claims: DataFrame | None = None
    claim_symbols: DataFrame | None = None
    refs: DataFrame | None = None
    type_edges: DataFrame | None = None
    diagnostics: DataFrame | None = None
    commits: DataFrame | None = None
    file_commits: DataFrame | None = None


def readable(signals: dict[str, Callable[[], DataFrame]]) -> tuple[Knowledge, dict[str, str]]:
    """The tables of a code base from what loads each, and why some could not be read.

    A signal whose source fails, when it is opened or when its first row is read, is
    absent from the bundles and does not fail them; without symbols there is nothing to tell.
    """
    tables: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, load in signals.items():
        try:
            table = load()
            table.limit(1).collect()
            tables[name] = table
        except (PySparkException, Py4JJavaError, OSError, RuntimeError) as error:
            if name == "symbols":
                raise
            failed[name] = str(error).splitlines()[0] if str(error) else type(error).__name__
            _LOG.warning("%s cannot be read: %s", name, failed[name])
    return Knowledge(**tables), failed


def reference_clusters(refs: DataFrame, max_refs: int = DEFAULT_REFS) -> DataFrame:
    """(symbol_id, module, count, top_ids, place): references by module, largest first, ties by appearance.

    Ids are numbered before they are collected, so a cluster's array has ``max_refs`` entries at most.
    """
    rows = refs.withColumn("module", module_key("path"))
    order = W.partitionBy("symbol_id", "module").orderBy("ordinal", "ref_id")
    numbered = rows.withColumn("n", F.row_number().over(order).cast("long"))
    kept = F.sort_array(F.collect_list(F.when(F.col("n") <= max_refs, F.struct("n", "ref_id"))))
    grouped = numbered.groupBy("symbol_id", "module").agg(F.count(F.lit(1)).alias("count"), F.min("ordinal").alias("first"), F.transform(kept, lambda x: x["ref_id"]).alias("top_ids"))
    place = F.row_number().over(W.partitionBy("symbol_id").orderBy(F.desc("count"), "first", "module")).cast("long")
    return grouped.withColumn("place", place).drop("first")


def _refs_block(refs: DataFrame, max_refs: int) -> DataFrame:
    clusters = reference_clusters(refs, max_refs)
    listed = F.sort_array(F.collect_list(F.struct("place", "module", "count", "top_ids")))
    plain = F.transform(listed, lambda c: F.struct(c["module"].alias("module"), c["count"].alias("count"), c["top_ids"].alias("top_ids")))
    return clusters.groupBy("symbol_id").agg(F.struct(F.sum("count").alias("count"), plain.alias("clusters")).alias("refs"))


def _tests_block(refs: DataFrame) -> DataFrame:
    files = F.sort_array(F.collect_set("path"))
    return refs.where(is_test_file("path")).groupBy("symbol_id").agg(F.struct(files.alias("files"), F.count(F.lit(1)).alias("related_count")).alias("tests"))


def _types_block(edges: DataFrame) -> DataFrame:
    def names(relation: str):
        rows = F.sort_array(F.collect_list(F.when(F.col("relation") == relation, F.struct("ordinal", "name"))))
        return F.transform(rows, lambda r: r["name"]).alias(relation)

    return edges.groupBy("symbol_id").agg(F.struct(names("extends"), names("implements"), names("used_by")).alias("types"))


def _intent_block(claims: DataFrame, claim_symbols: DataFrame, query: str | None) -> DataFrame:
    rows = ranked_claims(claims, claim_symbols, query)
    listed = F.sort_array(F.collect_list(F.struct("place", "claim_id", "source", "severity", "claim", "rationale", "excerpt")))
    return rows.groupBy("symbol_id").agg(F.transform(listed, lambda c: c.dropFields("place")).alias("intent"))


def _git_block(commits: DataFrame, file_commits: DataFrame, n: int) -> DataFrame:
    wanted = commits.select("sha", "date", "message", "author_email")
    activity = file_history(wanted, file_commits, n)
    return activity.select(F.col("file_path").alias("path"), F.struct("commit_count", "last_touched", "last_author", "hot", F.lit(n).alias("hot_threshold"), "recent_commits").alias("git"))


def symbol_contexts(wanted: DataFrame, know: Knowledge, include: Collection[str] = SIGNALS, max_refs: int = DEFAULT_REFS, query: str | None = None, recent: int = RECENT) -> DataFrame:
    """One bundle for each row (symbol_id, ...) of ``wanted``: the symbol and its signals as nested columns.

    Every signal is cut to the wanted symbols by a semi-join, aggregated on its
    own and joined once.  Null means that a section is absent; ``intent`` is an
    empty list where it is asked for and nothing is known.  Diagnostics do not
    depend on ``include``.
    """
    if unknown := set(include) - set(SIGNALS):
        raise ValueError(f"unknown signals: {', '.join(sorted(unknown))}")
    symbols = know.symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "path", "line", "signature")
    out = wanted.join(symbols, "symbol_id")
    ids, paths = wanted.select("symbol_id").distinct(), out.select("path").distinct()
    none = {"intent": "array<string>", "refs": "string", "tests": "string", "types": "string", "git": "string", "diagnostics": "string"}
    blocks: dict[str, tuple[DataFrame, str] | None] = dict.fromkeys(none)
    if "intent" in include and know.claims is not None and know.claim_symbols is not None:
        blocks["intent"] = (_intent_block(know.claims, know.claim_symbols.join(ids, "symbol_id", "left_semi"), query), "symbol_id")
    if know.refs is not None:
        refs = know.refs.join(ids, "symbol_id", "left_semi")
        if "refs" in include:
            blocks["refs"] = (_refs_block(refs, max_refs), "symbol_id")
        if "tests" in include:
            blocks["tests"] = (_tests_block(refs), "symbol_id")
    if "types" in include and know.type_edges is not None:
        blocks["types"] = (_types_block(know.type_edges.join(ids, "symbol_id", "left_semi")), "symbol_id")
    if "git" in include and know.commits is not None and know.file_commits is not None:
        own = know.file_commits.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        blocks["git"] = (_git_block(know.commits, own, recent), "path")
    if know.diagnostics is not None:
        listed = F.sort_array(F.collect_list(F.struct("line", "col", "severity", "message")))
        own = know.diagnostics.join(paths, "path", "left_semi")
        blocks["diagnostics"] = (own.groupBy("path").agg(listed.alias("diagnostics")), "path")
    for name, block in blocks.items():
        if block is None:
            out = out.withColumn(name, F.lit(None).cast(none[name]))
        else:
            out = out.join(block[0], block[1], "left")
    if blocks["intent"] is not None:
        kind = out.schema["intent"].dataType
        out = out.withColumn("intent", F.coalesce("intent", F.array().cast(kind)))
    return out


def _with_co_change(rows: DataFrame, know: Knowledge, limit: int) -> DataFrame:
    """``rows`` (path, ...) with ``co_change``, the files that most often change with the path."""
    if know.file_commits is None:
        return rows.withColumn("co_change", F.array().cast("array<struct<other_path:string,commits:bigint>>"))
    top = co_change_top(know.file_commits, rows.select(F.col("path").alias("file_path")).distinct(), limit)
    listed = F.sort_array(F.collect_list(F.struct("place", "other_path", "commits")))
    grouped = top.groupBy(F.col("file_path").alias("path")).agg(F.transform(listed, lambda c: c.dropFields("place")).alias("co_change"))
    rows = rows.join(grouped, "path", "left")
    return rows.withColumn("co_change", F.coalesce("co_change", F.array().cast(rows.schema["co_change"].dataType)))


def impact_risks(wanted: DataFrame, know: Knowledge, include: Collection[str] = SIGNALS, recent: int = RECENT, limit: int = CO_CHANGE_LIMIT) -> DataFrame:
    """``co_change`` and ``risk`` of ``impact_of_change`` for each row of ``wanted``, counted without the bundles' lists.

    A symbol of many claims, notes or commits is a few numbers in every task.
    """
    if unknown := set(include) - set(SIGNALS):
        raise ValueError(f"unknown signals: {', '.join(sorted(unknown))}")
    out = wanted.join(know.symbols.select(F.col("id").alias("symbol_id"), "path"), "symbol_id")
    ids, paths = wanted.select("symbol_id").distinct(), out.select("path").distinct()
    counts = ("commit_count", "test_files", "diagnostics", "hard_claims", "soft_claims", "context_claims")
    if "git" in include and know.commits is not None and know.file_commits is not None:
        own = know.file_commits.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").dropDuplicates()
        own = own.join(know.commits.select(F.col("sha").alias("commit_sha")), "commit_sha")
        out = out.join((own if recent > 0 else own.limit(0)).groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("commit_count")), "path", "left")
    if "tests" in include and know.refs is not None:
        own = know.refs.where(is_test_file("path")).join(ids, "symbol_id", "left_semi").select("symbol_id", "path").distinct()
        out = out.join(own.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("test_files")), "symbol_id", "left")
    if know.diagnostics is not None:
        own = know.diagnostics.join(paths, "path", "left_semi")
        out = out.join(own.groupBy("path").agg(F.count(F.lit(1)).alias("diagnostics")), "path", "left")
    if "intent" in include and know.claims is not None and know.claim_symbols is not None:
        own = know.claim_symbols.join(ids, "symbol_id", "left_semi").distinct().join(know.claims.select("claim_id", "severity"), "claim_id")
        out = out.join(severity_histogram(own, "symbol_id"), "symbol_id", "left")
    told = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in out.columns else F.lit(0).cast("long") for c in counts}
    hot = (told["commit_count"] >= recent) if "commit_count" in out.columns else F.lit(False)
    known = F.col("commit_count").isNotNull() if "commit_count" in out.columns else F.lit(False)
    risk = F.struct((hot & known).alias("hot"), told["commit_count"].alias("commit_count"), F.lit(recent).alias("hot_threshold"), *[told[c].alias(c) for c in counts if c != "commit_count"])
    return _with_co_change(out.select(*wanted.columns, "path", risk.alias("risk")), know, limit)


def impact_of_change(wanted: DataFrame, know: Knowledge, include: Collection[str] = SIGNALS, recent: int = RECENT, limit: int = CO_CHANGE_LIMIT) -> DataFrame:
    """``symbol_contexts`` with ``co_change`` (path, commits) and the struct ``risk`` of eight scalars."""
    bundle = symbol_contexts(wanted, know, include, recent=recent)
    bundle = _with_co_change(bundle, know, limit)

    def has(name: str) -> bool:
        return "struct" in bundle.schema[name].dataType.simpleString()

    def severity(s: str):
        return F.size(F.filter("intent", lambda c: c["severity"] == s)) if has("intent") else F.lit(0)

    zero = F.lit(0)
    git = {k: F.coalesce(F.col(f"git.{k}"), d) if has("git") else d for k, d in (("hot", F.lit(False)), ("commit_count", F.lit(0).cast("long")), ("hot_threshold", F.lit(recent)))}
    tests = F.coalesce(F.size("tests.files"), zero) if has("tests") else zero
    notes = F.coalesce(F.size("diagnostics"), zero) if has("diagnostics") else zero
    risk = F.struct(
        *[git[k].alias(k) for k in git],
        F.greatest(tests, zero).cast("long").alias("test_files"),
        F.greatest(notes, zero).cast("long").alias("diagnostics"),
        *[severity(s).cast("long").alias(f"{s}_claims") for s in ("hard", "soft", "context")],
    )
    return bundle.withColumn("risk", risk)
