"""Symbols and type relations as language sources tell them, from trees, declarations and class tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from symloom.functions.parsers import (
    alias_signature, body_docstring_of, callable_signature, class_bases, class_header, go_docstring, import_aliases,
    is_alias_line, is_module_assignment, is_protocol, module_docstring_of, ts_docstring, ts_heritage_of,
)

_CLASS, _METHOD, _FUNCTION, _VARIABLE, _CONSTANT = 5, 6, 12, 13, 14


def known_kinds(symbols: DataFrame) -> DataFrame:
    """Symbols of a kind that the engine knows."""
    return symbols.where("kind <> 'other'")


def _python_symbol(text: str, kind: int, line: int, name: str, aliases: dict[str, str]) -> tuple[str | None, str | None]:
    lines = text.splitlines()
    own = lines[line] if line < len(lines) else ""
    if kind == _VARIABLE:
        if is_alias_line(own, name):
            return "type", alias_signature(own, name)
        return ("variable", None) if is_module_assignment(own, name) else (None, None)
    if kind == _CLASS:
        bases, signature = class_bases(class_header(text, line))
        return "interface" if any(is_protocol(b, aliases) for b in bases) else "class", signature
    if kind in (_METHOD, _FUNCTION):
        return "method" if kind == _METHOD else "function", callable_signature(text, line)
    return ("variable", None) if kind == _CONSTANT else (None, None)


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("signature", StringType())])))
def _python_symbols_of(text: pd.Series, listed: pd.Series) -> pd.Series:
    out = []
    for own, symbols in zip(text, listed, strict=True):
        own = own or ""
        aliases = import_aliases(own) if any(s["kind"] == _CLASS for s in symbols) else {}
        out.append([dict(zip(("kind", "signature"), _python_symbol(own, s["kind"], s["line"], s["name"], aliases), strict=True)) for s in symbols])
    return pd.Series(out, dtype=object)


def python_symbols(flat: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, kind, line, signature) of flat Python symbols (path, name, kind of the protocol, line from 0) and files (path, text).

    Classes with a Protocol base are interfaces, assignments in alias form are
    types, other assignments inside functions and all unknown kinds are dropped.
    A text goes to Python once, with all symbols of its file, and is never broadcast.
    """
    listed = flat.groupBy("path").agg(F.collect_list(F.struct("name", "kind", "line")).alias("listed"))
    rows = files.select("path", "text").hint("merge").join(listed, "path").withColumn("told", _python_symbols_of("text", "listed"))
    every = rows.select("path", F.explode(F.arrays_zip("listed", "told")).alias("s")).where("s.told.kind is not null")
    return every.select("path", "s.listed.name", "s.told.kind", "s.listed.line", "s.told.signature")


def protocol_classes(classes: DataFrame) -> DataFrame:
    """(path, name) of the classes of ``class_table`` that name Protocol as a base."""
    return classes.where("is_protocol and base is not null").select("path", "name").distinct()


def classes_extending(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path, name): classes of which a base, bare or as written, is a target (target)."""
    bases = classes.where("base is not null")
    named = bases.select("path", "name", F.explode(F.array_distinct(F.array("base", F.element_at(F.split("base", r"\."), -1)))).alias("target"))
    return named.join(targets.select("target").distinct(), "target").distinct()


def direct_children(candidates: DataFrame) -> DataFrame:
    """The candidates (target, name, declaration, ...) whose own declaration names the target."""
    heritage = ts_heritage_of("declaration")
    rows = candidates.withColumn("__h", heritage)
    return rows.where(F.array_contains("__h.extends", F.col("target")) | F.array_contains("__h.implements", F.col("target"))).drop("__h")


def go_relations(implementations: DataFrame) -> DataFrame:
    """(path, name, relation, target, ordinal) of (path, name, kind, line, ordinal, target, target_path, target_line).

    What answers for an interface uses it; what answers for another kind is an
    interface that it implements.  A symbol is no answer to itself, and a name
    counts once, at its first place.
    """
    others = implementations.where((F.col("target_path") != F.col("path")) | (F.col("target_line") != F.col("line")))
    relation = F.when(F.col("kind") == "interface", "used_by").otherwise("implements")
    return others.groupBy("path", "name", relation.alias("relation"), "target").agg(F.min("ordinal").alias("ordinal"))


def docstrings(symbols: DataFrame, files: DataFrame, hovers: DataFrame | None = None) -> DataFrame:
    """(symbol_id, docstring) of symbols (id, language, name, path, line from 1); null where there is none.

    Python texts are read from files (path, text); the other languages from
    hovers (symbol_id, hover).
    """
    rows = symbols.select(F.col("id").alias("symbol_id"), "language", "name", "path", "line")
    python = rows.where("language = 'python'").join(files.select("path", "text").hint("merge"), "path", "left")
    module = F.col("name") == "<module>"
    modules = python.where(module).select("symbol_id", module_docstring_of("text").alias("docstring"))
    bodies = python.where(~module).select("symbol_id", body_docstring_of("text", "line").alias("docstring"))
    others = rows.where("language <> 'python'")
    others = others.join(hovers.hint("merge"), "symbol_id", "left") if hovers is not None else others.withColumn("hover", F.lit(None).cast("string"))
    text = F.when(F.col("language") == "go", go_docstring("hover")).otherwise(ts_docstring("hover"))
    return modules.unionByName(bodies).unionByName(others.select("symbol_id", text.alias("docstring")))


def find_go_symbol(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, wanted, kind, line) for wanted names (path, wanted): a top-level name, else ``Parent.Child`` cut at its first dot."""
    top = tree.select("path", "ord", F.lit(0).alias("level"), F.col("name").alias("wanted"), "kind", "line")
    kids = tree.select("path", "ord", "name", F.explode("children").alias("c"))
    below = kids.where(~F.col("name").contains(".")).select("path", "ord", F.lit(1).alias("level"), F.concat("name", F.lit("."), F.col("c.name")).alias("wanted"), F.col("c.kind").alias("kind"), F.col("c.line").alias("line"))
    first = W.partitionBy("path", "wanted").orderBy("level", "ord", "line")
    found = top.unionByName(below).join(wanted.select("path", "wanted").distinct().hint("merge"), ["path", "wanted"])
    return found.withColumn("__n", F.row_number().over(first).cast("long")).where("__n = 1").select("path", "wanted", "kind", "line")
