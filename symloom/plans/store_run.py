"""An indexing run into a versioned store: every table is computed once and counted as it is written.

The counters of a run come from metrics observed on the tables that it writes, so
no plan runs a second time to be counted.  The version appears with its commit;
a run that fails leaves the version before.  Beside the knowledge tables a version
keeps what the run found: ``run_files`` (path, status, asked, done), ``run_claims``
(the new claims with their candidates and symbols), ``run_unresolved`` and
``run_hints``, each of which later tables are made from.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from symloom.functions.text import source_name
from symloom.operators.diff import delete_by_path, merge_latest, numbered_claims, sha_diff, usage_totals
from symloom.operators.resolve import ATTRIBUTION_MODES, attribute_claims, unresolved_by_file, unresolved_frontmatter
from symloom.plans.index_run import Inputs
from symloom.schemas import CLAIM_SYMBOLS, CLAIMS, COMMITS, META, SOURCE_SHAS, SYMBOLS
from symloom.sources.artifact import ArtifactError, empty_history, write_artifact
from symloom.sources.snapshots import FORMAT, Manifest, Part, SnapshotStore, check_links, migrate, open_tables

# What a run tells its caller.
DONE, FAILED, NOT_SET_UP = 0, 1, 2
STATUSES = ("unchanged", "changed", "added", "deleted")


class SetupError(ValueError):
    """A run cannot begin."""


@dataclass
class Report:
    exit_code: int
    counters: dict[str, Any] = field(default_factory=dict)
    error: str | None = None
    manifest: Manifest | None = None


class _Writer:
    """Writes tables into a store and keeps what was observed on them."""

    def __init__(self, store: SnapshotStore):
        self.store, self.parts, self.seen = store, {}, {}

    def write(self, name: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        observation = Observation(name)
        observed = rows.observe(observation, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])
        hidden = [c for c in rows.columns if c.startswith("__")]  # columns that only metrics look at
        part = self.store.write(name, observed.drop(*hidden))
        self.parts[name] = [part]
        self.seen[name] = observation.get
        return self.store.rows([part])


def blank_tables(store: SnapshotStore) -> dict[str, DataFrame]:
    make, history = store.spark.createDataFrame, empty_history(store.spark)
    return {"symbols": make([], SYMBOLS), "claims": make([], CLAIMS), "claim_symbols": make([], CLAIM_SYMBOLS), "source_shas": make([], SOURCE_SHAS), "meta": make([], META), "commits": history[0], "file_commits": history[1]}


def _base(store: SnapshotStore, attribution: str, budget: float | None) -> Manifest | None:
    if attribution not in ATTRIBUTION_MODES:
        raise SetupError(f"attribution: one of {', '.join(ATTRIBUTION_MODES)}")
    if budget is not None and budget <= 0:
        raise SetupError("budget: more than 0 is needed")
    base = store.manifest()
    try:
        return migrate(store) if base is not None and base.format != FORMAT else base
    except ArtifactError as error:
        raise SetupError(str(error)) from error


def _written(writer: _Writer, tables: dict[str, DataFrame], inputs: Inputs, now: str, full: bool, attribution: str) -> bool:
    """Write all tables of the version; whether anything but the history is new."""
    shas = tables["source_shas"]
    diff = sha_diff(shas.select(F.col("source_path").alias("path"), F.col("source_sha").alias("sha")), inputs.files.select("path", "sha"), full)
    answered = inputs.answered.select("path").distinct().withColumn("answered", F.lit(True))
    asked = F.col("status").isin("changed", "added")
    told = diff.join(answered, "path", "left").select("path", "status", asked.alias("asked"), (asked & F.coalesce("answered", F.lit(False))).alias("done"))
    files = writer.write("run_files", told, asked=F.count_if("asked"), done=F.count_if("done"), **{s: F.count_if(F.col("status") == s) for s in STATUSES})
    seen = writer.seen["run_files"]
    if seen["asked"] and not seen["done"]:
        raise RuntimeError(f"none of {seen['asked']} documents could be extracted")
    done, gone = files.where("done").select("path"), files.where("status = 'deleted'").select("path")

    own = inputs.symbols.select(*[c for c in tables["symbols"].columns if c in inputs.symbols.columns])
    for missing in set(tables["symbols"].columns) - set(own.columns):
        own = own.withColumn(missing, F.lit(None).cast(tables["symbols"].schema[missing].dataType))
    flagged = merge_latest(tables["symbols"].withColumn("__new", F.lit(False)), own.withColumn("__new", F.lit(True)), ["id"])
    symbols = writer.write("symbols", flagged, new=F.count_if("__new"))

    kept, kept_links = delete_by_path(tables["claims"], tables["claim_symbols"], gone.union(done))
    known = inputs.files.select(F.col("path").alias("source_path"), F.col("sha").alias("source_sha"), source_name("path", "text").alias("source"))
    fresh = inputs.extracted.join(done.withColumnRenamed("path", "source_path"), "source_path", "left_semi").join(known, "source_path").withColumn("claim_id", F.xxhash64("source_path", "ordinal"))
    attributed = attribute_claims(fresh, symbols, inputs.frontmatter, attribution).drop("claim_id")
    drawn = writer.store.write("drawn", attributed)  # numbers are taken from what is written
    claims = writer.write("run_claims", numbered_claims(kept, writer.store.rows([drawn])))
    writer.store.files.remove(drawn.folder)
    writer.write("claims", kept.unionByName(claims.select(*kept.columns)))
    links = claims.select("claim_id", F.explode(F.array_distinct("symbol_ids")).alias("symbol_id"))
    writer.write("claim_symbols", kept_links.unionByName(links.select(*kept_links.columns)))
    writer.write("run_unresolved", unresolved_by_file(claims, symbols), names=F.coalesce(F.sum("n_unresolved"), F.lit(0)))
    writer.write("run_hints", unresolved_frontmatter(inputs.frontmatter, symbols), names=F.coalesce(F.sum(F.size("symbols")), F.lit(0)))

    dropped = shas.join(gone.union(done).withColumnRenamed("path", "source_path"), "source_path", "left_anti")
    writer.write("source_shas", dropped.unionByName(inputs.files.join(done, "path", "left_semi").select(F.col("path").alias("source_path"), F.col("sha").alias("source_sha"))))
    writer.write("commits", inputs.commits)
    writer.write("file_commits", inputs.file_commits.dropDuplicates())

    meta = {r.key: r.value for r in tables["meta"].collect()}  # some ten rows
    modified = bool(seen["changed"] or seen["added"] or seen["deleted"] or meta.get("extracted_at_sha") != inputs.head_sha)
    if modified:
        meta |= {"generated_at": now, "extracted_at_sha": inputs.head_sha or ""}
    writer.write("meta", writer.store.spark.createDataFrame([(k, v) for k, v in meta.items() if v], META))
    return modified


def run_into_store(
    store: SnapshotStore, inputs: Inputs, now: str, full: bool = False, attribution: str = ATTRIBUTION_MODES[0], budget: float | None = None, export_to: str | None = None, errors: DataFrame | None = None, after: Callable[[Manifest], None] | None = None,
) -> Report:
    """One run over the newest version; ``errors`` (source_path, error) are the documents that could not be extracted.

    The exit code is 0 for a committed run, 1 for one that failed on the way and 2
    for one that could not begin; only the first leaves a version.  ``export_to``
    gets the artifact, if the run changed anything that it holds.
    """
    began = time.monotonic()
    writer = _Writer(store)
    try:
        base = _base(store, attribution, budget)
    except SetupError as error:
        return Report(NOT_SET_UP, error=str(error))
    try:
        tables = open_tables(store) if base is not None else blank_tables(store)
        modified = _written(writer, tables, inputs, now, full, attribution)
        check_links({name: store.rows(writer.parts[name]) for name in ("symbols", "claims", "claim_symbols")})
        counters = _counters(writer.seen, inputs, budget, modified, _count(errors))
        manifest = store.commit(base, writer.parts, FORMAT, {"counters": json.dumps(counters)})
        if export_to is not None and modified:
            write_artifact(open_tables(store, manifest.version), export_to)
            counters["atlas_exported"] = True
        if after is not None:
            after(manifest)
    except (ArtifactError, RuntimeError, PySparkException, Py4JJavaError) as error:  # what a run can meet; anything else is a mistake of this code
        return Report(FAILED, error=str(error))
    counters["wall_clock_ms"] = int((time.monotonic() - began) * 1000)
    return Report(DONE, counters, manifest=manifest)


def _count(rows: DataFrame | None) -> int:
    return 0 if rows is None else rows.count()


def _counters(seen: dict[str, dict[str, int]], inputs: Inputs, budget: float | None, modified: bool, errors: int) -> dict[str, Any]:
    files = seen["run_files"]
    used = usage_totals(inputs.usage).first() if inputs.usage is not None else None
    return {
        "files_unchanged": files["unchanged"], "files_extracted": files["changed"] + files["added"], "files_failed": files["asked"] - files["done"], "files_deleted": files["deleted"],
        "symbols_indexed": seen["symbols"]["new"], "claims_written": seen["run_claims"]["rows"], "unresolved_candidates": seen["run_unresolved"]["names"], "unresolved_frontmatter_hints": seen["run_hints"]["names"],
        "git_commits_indexed": seen["commits"]["rows"], "extracted_at_sha": inputs.head_sha, "api_calls": _count(inputs.usage), "extraction_errors": errors,
        "input_tokens": used.input_tokens if used else 0, "output_tokens": used.output_tokens if used else 0, "cost_usd": used.cost_usd if used else 0.0,
        "over_budget": bool(used and budget is not None and used.cost_usd > budget), "modified": modified, "atlas_exported": False,
    }


def counters_of(manifest: Manifest) -> dict[str, Any]:
    """The counters that a version's run left; empty for versions that no run made."""
    return json.loads(manifest.properties.get("counters", "{}"))


def changed_parts(before: Manifest | None, after: Manifest) -> dict[str, list[Part]]:
    """The parts of a version that the one before does not name."""
    old = {p.folder for parts in (before.tables.values() if before else ()) for p in parts}
    return {name: new for name, parts in after.tables.items() if (new := [p for p in parts if p.folder not in old])}
