"""Context of a batch of requests: names resolved, bundles rendered, failures told, in one plan."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.text import DEFAULT_MATCHES, match_limit
from symloom.operators.fusion import DEFAULT_REFS, Knowledge, impact_of_change, symbol_contexts
from symloom.operators.history import RECENT
from symloom.operators.intent import find_by_intent
from symloom.operators.resolve import request_inputs, resolve_symbols
from symloom.plans.render import compact, compact_impact, compact_matches, envelope, envelope_json, error_text
from symloom.schemas import DEPTHS, SIGNALS

FORMATS = ("compact", "json")


def context_batch(
    spark: SparkSession, requests: Sequence[str], know: Knowledge, file_hint: str | None = None, depth: str = "standard", include: Collection[str] = SIGNALS,
    max_refs: int = DEFAULT_REFS, query: str | None = None, ranking: bool = True, output: str = "compact",
) -> DataFrame:
    """One row (text, is_error) in compact form or (json) for at most 10 names or ids, in the order asked.

    What does not resolve is told in its place; the batch is an error where all
    requests fail.  ``query`` ranks claims only where ``ranking`` is on.
    """
    if output not in FORMATS:
        raise ValueError(f"format: one of {', '.join(FORMATS)}")
    if depth not in DEPTHS:
        raise ValueError(f"depth: one of {', '.join(DEPTHS)}")
    if isinstance(include, str) or (unknown := [s for s in include if s not in SIGNALS]):
        raise ValueError(f"include: a list of {', '.join(SIGNALS)}" + ("" if isinstance(include, str) else f"; not {', '.join(map(str, unknown))}"))
    checked_int("max_refs", max_refs, 0)
    inputs = spark.createDataFrame([(k, name, file_hint) for k, name in request_inputs(list(requests))], "input_pos long, input string, file_hint string")
    resolved = resolve_symbols(inputs, know.symbols)
    wanted = resolved.where("status = 'resolved'").select("input_pos", "input", "symbol_id")
    bundles = symbol_contexts(wanted, know, include, max_refs, query if ranking else None)
    errors = error_text(resolved, know.symbols)
    if output == "compact":
        good = bundles.select("input_pos", "input", compact(bundles, depth, max_refs).alias("text"), F.lit(False).alias("failed"))
        bad = errors.join(inputs.select("input_pos", "input"), "input_pos").select("input_pos", "input", "text", F.lit(True).alias("failed"))
        return envelope(good.unionByName(bad))
    body = F.struct(*[c for c in bundles.columns if c not in ("input_pos", "input")])
    good = bundles.select("input_pos", "input", body.alias("bundle"))
    bad = errors.select("input_pos", F.struct("code", "message").alias("error"))
    return envelope_json(inputs.select("input_pos", "input").join(good.drop("input"), "input_pos", "left").join(bad, "input_pos", "left"))


def checked_int(name: str, value: object, least: int | None = None) -> int:
    """A whole number of ``least`` or more; other values are an error before any plan is made."""
    if isinstance(value, bool) or not isinstance(value, int) or (least is not None and value < least):
        raise ValueError(f"{name}: a whole number{'' if least is None else f' of {least} or more'} is needed, not {value!r}")
    return value


def intent_matches(spark: SparkSession, query: str, know: Knowledge, limit: int = DEFAULT_MATCHES) -> DataFrame:
    """One row (text): the symbols whose claims match a query."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("query must be a non-empty string")
    return compact_matches(find_by_intent(know.claims, know.claim_symbols, know.symbols, query, match_limit(checked_int("limit", limit))), query)


def change_impact(spark: SparkSession, request: str, know: Knowledge, file_hint: str | None = None, recent: int = RECENT) -> DataFrame:
    """(text, is_error) of the impact of changing one symbol."""
    checked_int("recent", recent, 0)
    inputs = spark.createDataFrame([(k, name, file_hint) for k, name in request_inputs([request])], "input_pos long, input string, file_hint string")
    resolved = resolve_symbols(inputs, know.symbols)
    impacts = impact_of_change(resolved.where("status = 'resolved'").select("symbol_id"), know, recent=recent)
    good = impacts.select(compact_impact(impacts).alias("text"), F.lit(False).alias("is_error"))
    return good.unionByName(error_text(resolved, know.symbols).select("text", F.lit(True).alias("is_error")))


#: What a caller can ask for by name.
TOOLS: dict[str, Callable[..., DataFrame]] = {"get_symbol_context": context_batch, "find_by_intent": intent_matches, "impact_of_change": change_impact}


class UnknownTool(LookupError):
    """No tool has the name that was asked for."""


def call(spark: SparkSession, tool: str, know: Knowledge | None, **arguments) -> DataFrame:
    """The answer of a tool; an unknown name, missing tables and wrong arguments are errors before any plan is made."""
    if tool not in TOOLS:
        raise UnknownTool(f"unknown tool: {tool}")
    if know is None:
        raise RuntimeError("no tables are loaded")
    if tool == "get_symbol_context":
        return context_batch(spark, arguments.pop("symbols"), know, **arguments)
    if tool == "find_by_intent":
        return intent_matches(spark, arguments.pop("query"), know, **arguments)
    return change_impact(spark, arguments.pop("symbol"), know, **arguments)
