"""Reader of extraction answers: JSON texts with a list of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from symloom.schemas import SEVERITIES

_FIELDS = ("symbol_candidates", "claim", "severity", "rationale", "excerpt")


def _is_string(value: Column) -> Column:
    """Whether a JSON value is a string: variants keep the kind of each value."""
    return F.schema_of_variant(value) == "STRING"


def parse_answers(answers: DataFrame, raw: str = "raw_json") -> DataFrame:
    """``answers`` with ``ok`` and ``claims``: array of structs of the valid entries.

    An answer that is no JSON object or has no array of claims is not ok and has
    no claims; entries of the wrong shape are left out.
    """
    parsed = F.try_parse_json(F.col(raw))
    rows = answers.withColumn("__v", parsed).withColumn("__c", F.try_variant_get("__v", "$.claims", "array<variant>"))
    is_object = F.schema_of_variant("__v").startswith("OBJECT")
    is_list = F.schema_of_variant(F.try_variant_get("__v", "$.claims", "variant")).startswith("ARRAY")
    ok = F.coalesce(is_object & is_list, F.lit(False))

    def valid(c: Column) -> Column:
        part = {f: F.try_variant_get(c, f"$.{f}", "variant") for f in _FIELDS}
        names = F.try_variant_get(c, "$.symbol_candidates", "array<variant>")
        strings = [_is_string(part[f]) for f in _FIELDS[1:]]
        shape = names.isNotNull() & F.forall(names, lambda n: F.coalesce(_is_string(n), F.lit(False)))
        for s in strings:
            shape = shape & s
        known = F.try_variant_get(c, "$.severity", "string").isin(*SEVERITIES)
        return F.coalesce(shape & known, F.lit(False))

    def read(c: Column) -> Column:
        names = F.try_variant_get(c, "$.symbol_candidates", ArrayType(StringType()).simpleString())
        return F.struct(names.alias("symbol_candidates"), *[F.try_variant_get(c, f"$.{f}", "string").alias(f) for f in _FIELDS[1:]])

    entries = F.transform(F.filter("__c", valid), read)
    return rows.withColumns({"ok": ok, "claims": F.when(ok, entries)}).drop("__v", "__c")


def explode_claims(answers: DataFrame, path: str = "source_path") -> DataFrame:
    """(source_path, ordinal, symbol_candidates, claim, severity, rationale, excerpt) of parsed answers."""
    return answers.where("ok").select(path, F.posexplode("claims").alias("ordinal", "c")).select(path, "ordinal", "c.*")
