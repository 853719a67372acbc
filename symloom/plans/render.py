"""Renderers: the compact line grammar and JSON, as expressions over bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.text import name_list, quote, short_date, short_sha
from symloom.operators.fusion import DEFAULT_REFS
from symloom.schemas import DEPTHS


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _lines(*parts: Column) -> Column:
    """Arrays of lines one after the other; null arrays are empty."""
    return F.flatten(F.array(*[F.coalesce(p, _nothing()) for p in parts]))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _is_struct(df: DataFrame, name: str) -> bool:
    return name in df.columns and "struct" in df.schema[name].dataType.simpleString()


def _of_severity(severity: str):
    return lambda claim: claim["severity"] == severity


def _intent(depth: str) -> Column:
    intent = F.col("intent")
    some = F.size(intent) > 0
    if depth == "summary":
        counts = [F.size(F.filter(intent, _of_severity(s))) for s in ("hard", "soft", "context")]
        top = F.get(intent, F.lit(0))
        line = _text("  INTENT hard:", counts[0], " soft:", counts[1], " context:", counts[2], "; top=", quote(top["claim"]), " (", top["source"], ")")
        return F.when(some, F.array(line))

    def lines(c: Column) -> Column:
        has = lambda f: F.coalesce(c[f], F.lit("")) != ""
        own = [F.array(_text("  INTENT ", c["source"], " ", c["severity"], " ", quote(c["claim"]))), F.when(has("rationale"), F.array(_text("    RATIONALE ", quote(c["rationale"]))))]
        if depth == "deep":
            own.append(F.when(has("excerpt"), F.array(_text("    EXCERPT ", quote(c["excerpt"])))))
        return _lines(*own)

    return F.when(some, F.flatten(F.transform(intent, lines)))


def _refs(depth: str, max_refs: Column) -> Column:
    refs = F.col("refs")
    heads = F.array_join(F.transform(refs["clusters"], lambda c: _text(c["module"], ":", c["count"])), " ")
    ids = F.flatten(F.transform(refs["clusters"], lambda c: c["top_ids"]))
    head = F.array(_text("  REFS ", refs["count"], " [", heads, "]"))
    if depth == "standard":
        top = F.slice(ids, F.lit(1), F.least(F.lit(3), max_refs))
        return F.when(refs.isNotNull(), _lines(head, F.transform(top, lambda i: _text("    TOP ", i))))
    shown = F.slice(ids, F.lit(1), max_refs)
    more = F.when(refs["count"] > F.size(shown), F.array(_text("    ... +", refs["count"] - F.size(shown), " more")))
    return F.when(refs.isNotNull(), _lines(head, F.transform(shown, lambda i: _text("    REF ", i)), more))


def _types() -> Column:
    t = F.col("types")
    line = _text("  TYPES extends=", name_list(t["extends"], single_bare=True), " implements=", name_list(t["implements"]), " used_by=", name_list(t["used_by"]))
    return F.when(t.isNotNull(), F.array(line))


def _tests(depth: str) -> Column:
    files = F.col("tests.files")
    more = F.when(F.size(files) > 1, _text(" (+", F.size(files) - 1, ")")).otherwise("")
    own = [F.array(_text("  TESTS ", F.get(files, F.lit(0)), more))]
    if depth == "deep":
        own.append(F.transform(files, lambda f: _text("    TEST ", f)))
    return F.when(F.size(files) > 0, _lines(*own))


def _git(depth: str) -> Column:
    g = F.col("git")
    heat = F.when(g["hot"], _text("hot (", g["commit_count"], "≥")).otherwise(_text("cold (", g["commit_count"], "<"))
    own = [F.array(_text("  GIT last=", g["last_touched"], " by ", g["last_author"], " ", heat, g["hot_threshold"], " commits)"))]
    if depth != "summary":
        own.append(F.transform(g["recent_commits"], lambda c: _text("    COMMIT ", short_sha(c["sha"]), " ", short_date(c["date"]), " ", quote(c["message"]))))
    return F.when(g.isNotNull(), _lines(*own))


def _diagnostics() -> Column:
    return F.transform("diagnostics", lambda d: _text("  DIAG ", d["severity"], " ", quote(d["message"]), " @line:", d["line"]))


def compact(bundles: DataFrame, depth: str = "standard", max_refs: int | Column = DEFAULT_REFS) -> Column:
    """The compact text of each bundle of ``symbol_contexts``."""
    if depth not in DEPTHS:
        raise ValueError(f"depth: one of {', '.join(DEPTHS)}")
    most = F.lit(max_refs) if isinstance(max_refs, int) else max_refs
    parts = [F.array(_text("SYM ", F.col("name"), "@", F.col("path"), ":", F.col("line"), " ", F.col("kind")))]
    parts.append(F.when(F.coalesce("signature", F.lit("")) != "", F.array(_text("  SIG ", F.col("signature")))))
    if _is_struct(bundles, "intent"):
        parts.append(_intent(depth))
    if _is_struct(bundles, "refs") and depth != "summary":
        parts.append(_refs(depth, most))
    if _is_struct(bundles, "types") and depth == "deep":
        parts.append(_types())
    if _is_struct(bundles, "tests") and depth != "summary":
        parts.append(_tests(depth))
    if _is_struct(bundles, "git"):
        parts.append(_git(depth))
    if _is_struct(bundles, "diagnostics"):
        parts.append(_diagnostics())
    return F.concat(F.array_join(_lines(*parts), "\n"), F.lit("\n"))


def compact_impact(impacts: DataFrame) -> Column:
    """The compact text of each row of ``impact_of_change``."""
    risk, shared = F.col("risk"), F.col("co_change")
    wide = F.array_max(F.transform(shared, lambda c: F.length(c["other_path"])))
    listed = F.transform(shared, lambda c: _text("    ", F.rpad(c["other_path"], wide, F.lit(" ")), "  ", c["commits"], " commits"))
    head = F.when(F.size(shared) > 0, _lines(F.array(_text("  GIT_COCHANGE (top ", F.size(shared), ")")), listed))
    heat = F.when(risk["hot"], _text("yes (", risk["commit_count"], "≥")).otherwise(_text("no (", risk["commit_count"], "<"))
    signals = F.array(
        F.lit("  RISK_SIGNALS"),
        _text("    hot: ", heat, risk["hot_threshold"], " commits)"),
        _text("    test_coverage: ", risk["test_files"], " test file(s) referenced"),
        _text("    diagnostics: ", risk["diagnostics"]),
        _text("    intent_density: ", risk["hard_claims"], " hard / ", risk["soft_claims"], " soft / ", risk["context_claims"], " context"),
    )
    every = F.coalesce(F.col("refs.count").cast("int"), F.lit(0)) if _is_struct(impacts, "refs") else F.lit(0)
    return F.concat(F.array_join(_lines(F.array(_text("IMPACT ", F.col("symbol_id"))), head, signals), "\n"), F.lit("\n"), compact(impacts, "deep", every))


def compact_matches(matches: DataFrame, query: str) -> DataFrame:
    """One row: the compact text of the matches of ``find_by_intent`` (50 at most)."""
    has = F.coalesce("signature", F.lit("")) != ""
    own = _lines(
        F.array(_text("  SYM ", F.col("symbol_id"), " ", F.col("path"), ":", F.col("line"), " ", F.col("kind"))),
        F.when(has, F.array(_text("    SIG ", F.col("signature")))),
        F.array(_text("    INTENT ", F.col("source"), " ", F.col("severity"), " ", quote("claim"))),
    )
    one = matches.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(F.col("rank"), own.alias("own")))).alias("rows"))
    head = F.array(_text("MATCHES ", F.col("n"), " [query=", quote(F.lit(query)), "]"))
    body = F.flatten(F.transform("rows", lambda r: r["own"]))
    return one.select(F.concat(F.array_join(_lines(head, body), "\n"), F.lit("\n")).alias("text"))


# The messages of failed requests.
NOT_FOUND = "Symbol '{}' not found."
NOT_FOUND_HINT = " Try find_by_intent if you're searching by concept rather than name."
AMBIGUOUS = "Symbol '{}' matches {} candidates. Pass file_hint to disambiguate."
NO_SOURCE = "Symbol '{}' uses language '{}' but no adapter is registered for that language in the current config."


def _message(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    return _text(*[x for pair in zip(pieces, [*values, F.lit("")], strict=True) for x in pair])


def error_text(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(input_pos, text, code, message) of the requests that did not resolve to one symbol."""
    known = symbols.select(F.col("id").alias("symbol_id"), "path", "line", "kind")
    rows = resolved.where("status <> 'resolved'").join(known, "symbol_id", "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("symbol_id").isNotNull(), F.struct("symbol_id", "path", "line", "kind"))))
    one = rows.groupBy("input_pos", "input", "status").agg(listed.alias("found"))
    lines = F.transform("found", lambda c: _text("  CAND ", c["symbol_id"], " ", c["path"], ":", c["line"], " ", c["kind"]))
    missing, many = _message(NOT_FOUND, F.col("input")), _message(AMBIGUOUS, F.col("input"), F.size("found"))
    none = F.col("status") == "not_found"
    text = F.concat(F.array_join(_lines(F.array(F.lit("ERR disambiguation_required"), _text("  MESSAGE ", many)), lines), "\n"), F.lit("\n"))
    text = F.when(none, _text("ERR not_found\n  MESSAGE ", missing, NOT_FOUND_HINT, "\n")).otherwise(text)
    return one.select("input_pos", text.alias("text"), F.when(none, "not_found").otherwise("disambiguation_required").alias("code"), F.when(none, missing).otherwise(many).alias("message"), "found")


def no_source_text(symbol_id: Column, language: Column) -> Column:
    return _text("ERR no_adapter\n  MESSAGE ", _message(NO_SOURCE, symbol_id, language), "\n")


def envelope(results: DataFrame) -> DataFrame:
    """One row (text, is_error) for a batch: results (input_pos, input, text, failed), in order.

    Each has a delimiter line with its number; the batch fails where all of it does.
    """
    order = W.orderBy("input_pos")  # at most 10 rows
    rows = results.withColumn("n", F.row_number().over(order).cast("long")).withColumn("m", F.count(F.lit(1)).over(W.partitionBy()))
    part = _text("--- get_symbol_context: ", F.col("input"), " (", F.col("n"), " of ", F.col("m"), ") ---\n", F.col("text"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("n"), part.alias("part"))))
    failed = F.bool_and("failed")
    head = F.when(failed, _text("ERR all_symbols_failed\n  COUNT ", F.count(F.lit(1)), "\n\n")).otherwise("")
    return rows.agg(F.concat(head, F.array_join(F.transform(listed, lambda r: r["part"]), "\n")).alias("text"), failed.alias("is_error"))


def envelope_json(results: DataFrame) -> DataFrame:
    """The batch as one JSON text: results (input_pos, input, bundle, error)."""
    item = F.struct("input_pos", F.struct(F.col("input").alias("symbol"), "bundle", "error").alias("item"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("input_pos", F.to_json(item["item"], {"ignoreNullFields": "false"}).alias("j")))), lambda r: r["j"])
    return results.agg(F.concat(F.lit('{"results":['), F.array_join(listed, ","), F.lit("]}")).alias("json"))


def summary_text(counters: dict) -> str:
    """``key=value`` lines of a run's counters; floats with 4 places."""
    return "".join(f"{k}={v:.4f}\n" if isinstance(v, float) else f"{k}={str(v).lower() if isinstance(v, bool) else v}\n" for k, v in counters.items())


def summary_text_of(counters: dict[str, Column]) -> Column:
    """``summary_text`` over columns, for many runs; null counters are told as null."""

    def line(name: str, value: Column) -> Column:
        kind = F.typeof(value)
        text = F.when(kind == "double", F.format_string("%.4f", value.cast("double"))).otherwise(value.cast("string"))
        return F.concat(F.lit(f"{name}="), F.coalesce(text, F.lit("null")), F.lit("\n"))

    return F.concat(*[line(name, value) for name, value in counters.items()])


# The lines of a run's summary, in order.
SUMMARY = (
    "files_extracted", "files_unchanged", "files_deleted", "claims_written", "symbols_indexed", "unresolved_candidates", "unresolved_frontmatter_hints", "git_commits_indexed",
    "extracted_at_sha", "atlas_exported", "wall_clock_ms", "api_calls", "input_tokens", "output_tokens", "cost_usd", "extraction_errors",
)


def run_summary(counters: dict, as_json: bool = False, frontmatter: Sequence[tuple[str, list[str]]] = (), errors: Sequence[str] = ()) -> str:
    """The summary of an indexing run in 16 lines, or as JSON with the details; counters that are missing are 0, the revision null."""
    blank = {"extracted_at_sha": None, "atlas_exported": False}
    known = {name: counters.get(name, blank.get(name, 0)) for name in SUMMARY} | {"cost_usd": round(float(counters.get("cost_usd", 0.0)), 4), "extraction_errors": len(errors)}
    if not as_json:
        known["extracted_at_sha"] = known["extracted_at_sha"] or "null"
        return summary_text(known)
    detail = [{"source_path": path, "symbols": names} for path, names in frontmatter if names]
    items = []
    for name in SUMMARY:
        items.append((name, list(errors) if name == "extraction_errors" else known[name]))
        if name == "unresolved_frontmatter_hints":
            items.append(("frontmatter_unresolved_by_file", detail))
    return json.dumps(dict(items), indent=2, ensure_ascii=False) + "\n"
