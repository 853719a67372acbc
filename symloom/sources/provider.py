"""Language sources: whoever can list symbols, references, type edges and diagnostics as tables.

A language server, an index file or a test table are all the same to the engine.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.paths import SHORT_CODES, parse_symbol_id
from symloom.schemas import DIAGNOSTICS, KINDS, REFS, SYMBOLS, TYPE_EDGES, dangling, outside_domain

RELATIONS = ("extends", "implements", "used_by")


class LanguageSource(Protocol):
    """Tables of one language; an empty table stands for what a source cannot tell."""

    language: str

    def symbols(self, spark: SparkSession) -> DataFrame: ...

    def refs(self, spark: SparkSession) -> DataFrame: ...

    def type_edges(self, spark: SparkSession) -> DataFrame: ...

    def diagnostics(self, spark: SparkSession) -> DataFrame: ...


class TableSource:
    """A source over given tables."""

    def __init__(self, language: str, symbols: DataFrame, refs: DataFrame | None = None, type_edges: DataFrame | None = None, diagnostics: DataFrame | None = None):
        self.language = language
        self._tables = {"symbols": symbols, "refs": refs, "type_edges": type_edges, "diagnostics": diagnostics}

    def _get(self, spark: SparkSession, name: str, schema) -> DataFrame:
        table = self._tables[name]
        return spark.createDataFrame([], schema) if table is None else table

    def symbols(self, spark: SparkSession) -> DataFrame:
        return self._get(spark, "symbols", SYMBOLS)

    def refs(self, spark: SparkSession) -> DataFrame:
        return self._get(spark, "refs", REFS)

    def type_edges(self, spark: SparkSession) -> DataFrame:
        return self._get(spark, "type_edges", TYPE_EDGES)

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        return self._get(spark, "diagnostics", DIAGNOSTICS)


class Registry(dict):
    """Sources by language; each language once, unknown ones are errors."""

    def register(self, source: LanguageSource) -> None:
        if source.language not in SHORT_CODES.values():
            raise ValueError(f"unknown language: {source.language}")
        if source.language in self:
            raise ValueError(f"{source.language} has a source already")
        self[source.language] = source

    def symbols(self, spark: SparkSession) -> DataFrame:
        every = spark.createDataFrame([], SYMBOLS)
        for source in self.values():
            every = every.unionByName(source.symbols(spark).select(*every.columns))
        return every


def conformance(spark: SparkSession, source: LanguageSource) -> list[str]:
    """What a source does wrong; empty where it keeps the contract.  Counts run on the cluster."""
    wrong: list[str] = []

    def check(what: str, bad: DataFrame) -> None:
        if not bad.isEmpty():
            wrong.append(what)

    symbols, refs, edges, notes = source.symbols(spark), source.refs(spark), source.type_edges(spark), source.diagnostics(spark)
    for name, table, schema in (("symbols", symbols, SYMBOLS), ("refs", refs, REFS), ("type_edges", edges, TYPE_EDGES), ("diagnostics", notes, DIAGNOSTICS)):
        if missing := [c for c in spark.createDataFrame([], schema).columns if c not in table.columns]:
            wrong.append(f"{name} lacks {', '.join(missing)}")
    if wrong:
        return wrong
    code = next(k for k, v in SHORT_CODES.items() if v == source.language)
    parsed = parse_symbol_id("id")
    check("ids do not parse", symbols.where(parsed.isNull()))
    check("ids disagree with language, path or name", symbols.where((parsed["code"] != code) | (parsed["path"] != F.col("path")) | (parsed["name"] != F.col("name"))))
    check("ids repeat", symbols.groupBy("id").count().where("count > 1"))
    check("kinds are unknown", outside_domain(symbols, "kind", KINDS))
    check("lines start below 1", symbols.where("line < 1").select("line").union(refs.where("line < 1").select("line")))
    check("paths are absolute or have backslashes", symbols.where(F.col("path").startswith("/") | F.col("path").contains("\\")))
    check("names are empty", symbols.where(F.trim("name") == ""))
    check("languages differ", symbols.where(~F.col("language").eqNullSafe(F.lit(source.language))))
    check("parents are unknown", dangling(symbols.where("parent_id is not null").select("parent_id"), "parent_id", symbols, "id"))
    check("references lead nowhere", dangling(refs, "symbol_id", symbols, "id"))
    check("reference ids have another form", refs.where(F.col("ref_id") != F.concat_ws(":", F.lit("ref"), F.lit(code), "path", F.col("line").cast("string"))))
    check("type edges lead nowhere", dangling(edges, "symbol_id", symbols, "id"))
    check("relations are unknown", outside_domain(edges, "relation", RELATIONS))
    check("severities are unknown", outside_domain(notes, "severity", ("error", "warning", "info")))
    return wrong
