"""From names to symbols: requests, claim candidates, attribution, positions and base types."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.text import MAX_BATCH

ATTRIBUTION_MODES = ("drop-with-fallback", "drop")
#: Lines of a block in which positions and ranges meet.
BLOCK_LINES = 512


def request_inputs(requests: list[str]) -> list[tuple[int, str]]:
    """Trimmed requests in order without repetitions; more than 10 are an error, counted before."""
    if not requests or any(not isinstance(r, str) or not r.strip() for r in requests):
        raise ValueError("symbols must be non-empty strings")
    if len(requests) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} symbols in a request")
    return list(enumerate(dict.fromkeys(r.strip() for r in requests)))


def resolve_symbols(inputs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(input_pos, input, status, n_candidates, symbol_id) for inputs (input_pos, input, file_hint).

    ``sym:`` inputs are ids, others names.  A hint keeps the candidates whose
    path starts with it, else those whose path contains it, else all.  One row
    for each candidate; status is resolved, disambiguation or not_found.
    """
    asked = inputs.select("input_pos", "input", F.coalesce("file_hint", F.lit("")).alias("hint"))
    one = symbols.select(F.col("id").alias("symbol_id"), "name", "path")
    by_id = asked.where(F.col("input").startswith("sym:")).join(one, F.col("input") == F.col("symbol_id"))
    by_name = asked.where(~F.col("input").startswith("sym:")).join(one, F.col("input") == F.col("name"))
    own = W.partitionBy("input_pos")
    starts, holds = (F.col("path").startswith(F.col("hint")) & (F.col("hint") != "")), (F.col("path").contains(F.col("hint")) & (F.col("hint") != ""))
    flagged = by_name.withColumns({"starts": starts, "holds": holds}).withColumns({"any_starts": F.max("starts").over(own), "any_holds": F.max("holds").over(own)})
    kept = flagged.where(F.when(F.col("any_starts"), F.col("starts")).when(F.col("any_holds"), F.col("holds")).otherwise(True))
    # A hint that leaves nothing gives all candidates back, even a single one, as a choice.
    unhelpful = (F.col("hint") != "") & ~F.col("any_holds") & ~F.col("any_starts")
    found = by_id.select("input_pos", "symbol_id", F.lit(False).alias("unhelpful")).unionByName(kept.select("input_pos", "symbol_id", unhelpful.alias("unhelpful")))
    found = found.withColumn("n_candidates", F.count(F.lit(1)).over(own))
    joined = asked.join(found, "input_pos", "left")
    n = F.coalesce("n_candidates", F.lit(0))
    status = F.when(n == 0, "not_found").when((n == 1) & ~F.col("unhelpful"), "resolved").otherwise("disambiguation")
    return joined.select("input_pos", "input", status.alias("status"), n.alias("n_candidates"), "symbol_id")


def symbols_where(symbols: DataFrame, **values: str) -> DataFrame:
    """The symbols whose id, name or path (any columns) are those given, by id; equality reaches the scan."""
    for column, value in values.items():
        symbols = symbols.where(F.col(column) == F.lit(value))
    return symbols.orderBy("id")


def symbols_of_paths(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """The symbols of some paths (path)."""
    return symbols.join(paths.select("path").distinct(), "path", "left_semi")


def resolve_candidates(extracted: DataFrame, symbols: DataFrame, key: str = "claim_id") -> tuple[DataFrame, DataFrame]:
    """Links (key, symbol_id) of candidate names to all symbols of that name, and names (key, candidate) without any."""
    names = extracted.select(key, F.explode(F.array_distinct("symbol_candidates")).alias("candidate"))
    links = names.join(symbols.select(F.col("name").alias("candidate"), F.col("id").alias("symbol_id")), "candidate")
    missing = names.join(symbols.select(F.col("name").alias("candidate")).distinct(), "candidate", "left_anti")
    return links.select(key, "symbol_id").distinct(), missing


def resolved_sets(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_candidates, resolved): the sorted symbols of each list of candidates that has any, told once for all claims with it."""
    wanted = extracted.select("symbol_candidates").distinct()
    names = wanted.select("symbol_candidates", F.explode("symbol_candidates").alias("name"))
    found = names.join(symbols.select("name", F.col("id").alias("symbol_id")), "name")
    return found.groupBy("symbol_candidates").agg(F.sort_array(F.collect_set("symbol_id")).alias("resolved"))


def attribute_claims(extracted: DataFrame, symbols: DataFrame, frontmatter: DataFrame, mode: str = ATTRIBUTION_MODES[0]) -> DataFrame:
    """``extracted`` (claim_id, source_path, symbol_candidates, ...) with sorted ``symbol_ids``.

    A claim none of whose candidates resolve gets the symbols that its
    document's frontmatter (source_path, symbols) names, unless the mode is ``drop``.
    """
    if mode not in ATTRIBUTION_MODES:
        raise ValueError(f"attribution: one of {', '.join(ATTRIBUTION_MODES)}")
    own = resolved_sets(extracted, symbols).withColumnRenamed("resolved", "own")
    named = frontmatter.select("source_path", F.explode("symbols").alias("name")).join(symbols.select("name", F.col("id").alias("symbol_id")), "name")
    named = named.groupBy("source_path").agg(F.sort_array(F.collect_set("symbol_id")).alias("named"))
    none = F.array().cast("array<string>")
    fallback = none if mode == "drop" else F.coalesce("named", none)
    joined = extracted.join(own, "symbol_candidates", "left").join(named, "source_path", "left")
    return joined.select(*extracted.columns, F.coalesce("own", fallback).alias("symbol_ids"))


def documented_claims(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """Docstring claims (claim_id, documented_id, symbol_candidates): the documented symbol and what the candidates resolve to."""
    joined = extracted.join(resolved_sets(extracted, symbols), "symbol_candidates", "left")
    resolved, own = F.coalesce("resolved", F.array().cast("array<string>")), F.col("documented_id")
    ids = F.when(own.isNull() | F.array_contains(resolved, own), resolved).otherwise(F.sort_array(F.array_append(resolved, own)))
    return joined.select(*extracted.columns, ids.alias("symbol_ids"))


def unresolved_by_file(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_path, n_unresolved, candidates) of the files with an unresolved candidate."""
    _, missing = resolve_candidates(extracted, symbols)
    rows = missing.join(extracted.select("claim_id", "source_path"), "claim_id")
    return rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_unresolved"), F.sort_array(F.collect_set("candidate")).alias("candidates"))


def unresolved_frontmatter(frontmatter: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_path, symbols): the names of a document's frontmatter (source_path, symbols) that no symbol has, in order."""
    names = frontmatter.select("source_path", F.posexplode("symbols").alias("place", "name"))
    missing = names.join(symbols.select("name").distinct(), "name", "left_anti").groupBy("source_path", "name").agg(F.min("place").alias("place"))
    listed = F.sort_array(F.collect_list(F.struct("place", "name")))
    return missing.groupBy("source_path").agg(F.transform(listed, lambda n: n["name"]).alias("symbols"))


def frontmatter_warning(source_path: Column, names: Column) -> Column:
    return F.concat(F.lit("warning: "), source_path, F.lit(": frontmatter names unknown symbols: "), F.array_join(names, ", "))


def dealt_ranges(positions: DataFrame, ranges: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """``ranges`` with ``block``: each once for every block of lines that it meets and that has positions.

    A range inside a block is one row; one that reaches over blocks is open in all
    that it crosses, and of nested ranges at most the depth are open at any place.
    """
    block = lambda line: F.floor(F.col(line) / lines).cast("long")
    filled = positions.groupBy("path").agg(F.sort_array(F.collect_set(block("line"))).alias("blocks"))
    met = F.filter("blocks", lambda b: (b >= block("start_line")) & (b <= block("end_line")))
    return ranges.join(filled, "path").withColumn("block", F.explode(met)).drop("blocks")


def enclosing_symbols(positions: DataFrame, ranges: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """The innermost range (path, symbol_id, depth, start/end line and character) around each position (path, line, character).

    A sweep: ranges and positions are sorted by place within a path and block of
    lines, ranges are opened as they come, and a position is told the deepest one
    that is open; of equally deep ones the last begun, then the smallest symbol.
    Time and rows are in proportion to positions and ranges, not to their product.
    Ranges may overlap in any way.  Positions and ranges without a path or place are
    not told; repeated positions are one.
    """
    at = positions.select("path", "line", "character").distinct()
    none = {c: F.lit(None).cast(t) for c, t in (("symbol_id", "string"), ("depth", "int"), ("end_line", "int"), ("end_character", "int"))}
    asked = at.select("path", F.floor(F.col("line") / lines).cast("long").alias("block"), "line", "character", *[c.alias(n) for n, c in none.items()])
    opened = dealt_ranges(at, ranges, lines).select("path", "block", F.col("start_line").alias("line"), F.col("start_character").alias("character"), "symbol_id", "depth", "end_line", "end_character")
    every = opened.where("symbol_id IS NOT NULL").unionByName(asked).where("path IS NOT NULL AND line IS NOT NULL AND character IS NOT NULL")
    dealt = every.repartition("path", "block").sortWithinPartitions("path", "block", "line", "character", F.col("symbol_id").isNull())
    return dealt.selectExpr("path", "block", "CAST(line AS long) line", "CAST(character AS long) character", "symbol_id", "CAST(depth AS long) depth", "CAST(end_line AS long) end_line", "CAST(end_character AS long) end_character").mapInArrow(_sweep, "path string, line long, character long, symbol_id string").select(
        "path", *[F.col(c).cast(at.schema[c].dataType).alias(c) for c in ("line", "character")], "symbol_id",
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path, block and place: those with a symbol open a range, the others ask."""
    schema = pa.schema([("path", pa.string()), ("line", pa.int64()), ("character", pa.int64()), ("symbol_id", pa.string())])
    group, is_open = None, []
    for batch in batches:
        told = []
        for path, block, line, character, symbol, depth, end_line, end_character in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if group != (path, block):
                group, is_open = (path, block), []
            if symbol is not None:
                heapq.heappush(is_open, (-depth, -line, -character, symbol, end_line, end_character))
                continue
            while is_open and is_open[0][4:] < (line, character):  # over before this place
                heapq.heappop(is_open)
            if is_open:
                told.append((path, line, character, is_open[0][3]))
        columns = list(zip(*told, strict=True)) if told else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def used_by_types(bases: DataFrame) -> DataFrame:
    """(path, name, used_by): classes of other files that name a class as a base, bare or dotted.

    ``bases``: (path, name, base), one row for each class and base; base is null without one.
    """
    targets = bases.select(F.col("path"), F.col("name")).distinct()
    users = bases.where("base is not null").select(F.element_at(F.split("base", r"\."), -1).alias("name"), F.col("path").alias("user_path"), F.col("name").alias("used_by"))
    return targets.join(users.hint("merge"), "name").where("path <> user_path").select("path", "name", "used_by").distinct()


def split_bases(bases: DataFrame, protocols: DataFrame) -> DataFrame:
    """(path, name, extends, implements): bases that are protocols (name) are implemented, others extended."""
    known = protocols.select(F.col("name").alias("short")).distinct().withColumn("is_protocol", F.lit(True))
    rows = bases.where("base is not null").withColumn("short", F.element_at(F.split("base", r"\."), -1)).join(known.hint("merge"), "short", "left")
    pick = lambda flag: F.sort_array(F.collect_set(F.when(F.coalesce("is_protocol", F.lit(False)) == flag, F.col("base"))))
    return rows.groupBy("path", "name").agg(pick(False).alias("extends"), pick(True).alias("implements"))
