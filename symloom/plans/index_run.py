"""One indexing run: what changed is extracted again, the rest is kept, the history is replaced."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import source_name
from symloom.operators.diff import delete_by_path, insert_claims, merge_latest, sha_diff, to_extract, usage_totals
from symloom.operators.resolve import ATTRIBUTION_MODES, attribute_claims, resolve_candidates, unresolved_frontmatter
from symloom.schemas import META


@dataclass
class Inputs:
    """What the sources produced: files (path, sha, text), symbols, extracted claims, frontmatter and history.

    ``extracted`` has the schema of extracted claims; ``answered`` (path) are the
    documents whose answer could be read, even if it held no claim.
    """

    files: DataFrame
    symbols: DataFrame
    extracted: DataFrame
    answered: DataFrame
    frontmatter: DataFrame
    commits: DataFrame
    file_commits: DataFrame
    usage: DataFrame | None = None
    head_sha: str | None = None


@dataclass
class Outcome:
    tables: dict[str, DataFrame]
    counters: dict[str, int | float | bool | str | None] = field(default_factory=dict)


def _counted(status: DataFrame, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows by status and rows of each table, in one job that shares their exchanges."""
    every = status.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name, table in tables.items():
        every = every.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return {row.name: row.n for row in every.collect()}


def index_run(tables: dict[str, DataFrame], inputs: Inputs, now: str, full: bool = False, attribution: str = ATTRIBUTION_MODES[0], budget: float | None = None) -> Outcome:
    """The tables after the run and its counters.

    Symbols are upserted and never removed.  Documents without a readable
    answer keep their old claims and their old sha, so the next run asks again.
    Meta data change only if documents, deletions or the revision did.
    """
    began = time.monotonic()
    shas = tables["source_shas"]
    diff = sha_diff(shas.select(F.col("source_path").alias("path"), F.col("source_sha").alias("sha")), inputs.files.select("path", "sha"), full)
    wanted = to_extract(diff)
    done = wanted.join(inputs.answered.select("path").distinct(), "path", "left_semi")
    gone = diff.where("status = 'deleted'").select("path")

    symbols = merge_latest(tables["symbols"], inputs.symbols.select(*tables["symbols"].columns), ["id"])
    claims, links = delete_by_path(tables["claims"], tables["claim_symbols"], gone.union(done))

    known = inputs.files.select(F.col("path").alias("source_path"), F.col("sha").alias("source_sha"), source_name("path", "text").alias("source"))
    fresh = inputs.extracted.join(done.withColumnRenamed("path", "source_path"), "source_path", "left_semi").join(known, "source_path")
    fresh = fresh.withColumn("claim_id", F.xxhash64("source_path", "ordinal"))
    attributed = attribute_claims(fresh, symbols, inputs.frontmatter, attribution).drop("claim_id")
    claims, links = insert_claims(claims, links, attributed)

    dropped = shas.join(gone.union(done).withColumnRenamed("path", "source_path"), "source_path", "left_anti")
    new_shas = dropped.unionByName(inputs.files.join(done, "path", "left_semi").select(F.col("path").alias("source_path"), F.col("sha").alias("source_sha")))

    hints = unresolved_frontmatter(inputs.frontmatter, symbols).select(F.explode("symbols").alias("name"))
    counts = _counted(diff, {
        "asked": wanted, "done": done, "symbols": inputs.symbols, "claims": fresh, "unresolved": resolve_candidates(fresh, symbols)[1], "commits": inputs.commits, "hints": hints,
    })
    used = usage_totals(inputs.usage).first() if inputs.usage is not None else None
    meta = {r.key: r.value for r in tables["meta"].collect()}
    changed = counts.get("changed", 0) + counts.get("added", 0)
    modified = bool(changed or counts.get("deleted", 0) or meta.get("extracted_at_sha") != inputs.head_sha)
    if modified:
        meta |= {"generated_at": now, "extracted_at_sha": inputs.head_sha or ""}
    out = {
        "symbols": symbols, "claims": claims, "claim_symbols": links, "source_shas": new_shas,
        "commits": inputs.commits, "file_commits": inputs.file_commits.dropDuplicates(),
        "meta": tables["meta"].sparkSession.createDataFrame([(k, v) for k, v in meta.items() if v], META),
    }
    n_asked, n_done = counts["asked"], counts["done"]
    if n_asked and not n_done:
        raise RuntimeError(f"none of {n_asked} documents could be extracted")
    counters = {
        "files_unchanged": counts.get("unchanged", 0), "files_extracted": changed, "files_failed": n_asked - n_done, "files_deleted": counts.get("deleted", 0),
        "symbols_indexed": counts["symbols"], "claims_written": counts["claims"], "unresolved_candidates": counts["unresolved"], "unresolved_frontmatter_hints": counts["hints"], "git_commits_indexed": counts["commits"],
        "extracted_at_sha": inputs.head_sha, "wall_clock_ms": int((time.monotonic() - began) * 1000),
        "input_tokens": used.input_tokens if used else 0, "output_tokens": used.output_tokens if used else 0, "cost_usd": used.cost_usd if used else 0.0,
        "over_budget": bool(used and budget is not None and used.cost_usd > budget), "modified": modified,
    }
    return Outcome(out, counters)
