"""The reviewable JSON artifact: import, validation and deterministic export.

An artifact is one document of a code base; its arrays are exploded into tables
on import and collected again, in canonical order, on export.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.paths import language_of_id
from symloom.operators.history import commit_files, pivot_files
from symloom.schemas import ARTIFACT, ARTIFACT_VERSIONS, CLAIM_SYMBOLS, COMMITS, META, dangling
from symloom.sources.folders import shared_folder
from symloom.sources.trees import located

_OPTIONAL_SYMBOL = ("signature", "parent_id")
_OPTIONAL_CLAIM = ("rationale", "excerpt")
#: Bytes of a document that are written at a time.
_BUFFER = 1 << 20
_REQUIRED = ("symbols", "claims", "source_shas")
_ARRAYS = ("symbols", "claims", "git_commits")
_BLANK = re.compile(r"[ \t\r\n]*")


class ArtifactError(ValueError):
    """The document is not a valid artifact."""


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row of nested columns; fails on malformed JSON."""
    return spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def import_artifact(document: DataFrame) -> dict[str, DataFrame]:
    """The tables symbols, claims, claim_symbols, commits, file_commits, source_shas and meta.

    Fails on an unknown version, a missing generator version, missing arrays and
    links to symbols that do not exist.  Claims are numbered in document order.
    """
    head = document.select("version", "generator", "extracted_at_sha", "generated_at", *[F.col(c).isNull().alias(f"no_{c}") for c in _REQUIRED]).first()
    told = {} if head is None else {c: head[c] for c in ("version", "generator", "extracted_at_sha", "generated_at")} | {c: None if head[f"no_{c}"] else () for c in _REQUIRED}
    _checked(told)
    claims = document.select(F.posexplode("claims").alias("at", "c"))
    shas = document.select(F.explode("source_shas").alias("source_path", "source_sha"))
    return _tables(told, document.select(F.explode("symbols").alias("s")).select("s.*"), claims, document.select(F.explode("git_commits").alias("g")).select("g.*"), shas)


def _checked(head: dict) -> None:
    """Fails on an unknown version, a missing generator version and missing arrays; ``head`` has the members of a document."""
    if head.get("version") not in ARTIFACT_VERSIONS:
        raise ArtifactError(f"unsupported artifact version: {head.get('version')}")
    if not any(k.endswith("_version") and v for k, v in (head.get("generator") or {}).items()):
        raise ArtifactError("the generator names no version")
    for name in _REQUIRED:
        if head.get(name) is None:
            raise ArtifactError(f"{name} is missing")


def _tables(head: dict, symbols: DataFrame, claims: DataFrame, history: DataFrame, shas: DataFrame) -> dict[str, DataFrame]:
    """The tables of a document's symbols, claims (at, c), commits with files and source shas; links are checked."""
    symbols = symbols.withColumn("language", language_of_id("id"))
    rows = claims.select((F.col("at") + 1).cast("long").alias("claim_id"), "c.*")
    links = rows.select("claim_id", F.explode(F.array_distinct("symbol_ids")).alias("symbol_id"))
    lost = dangling(links, "symbol_id", symbols, "id").limit(1).collect()
    if lost:
        raise ArtifactError(f"claim {lost[0].claim_id} links to unknown symbol {lost[0].symbol_id}")
    commits, file_commits = pivot_files(history)
    meta = {c: head.get(c) for c in ("version", "generated_at", "extracted_at_sha")}
    meta |= {f"generator.{k}": v for k, v in (head.get("generator") or {}).items()}
    return {
        "symbols": symbols,
        "claims": rows.drop("symbol_ids"),
        "claim_symbols": links,
        "commits": commits,
        "file_commits": file_commits,
        "source_shas": shas,
        "meta": symbols.sparkSession.createDataFrame([(k, v) for k, v in meta.items() if v], META),
    }


def _members(read: Callable[[int], bytes], size: int = _BUFFER) -> Iterator[tuple[str, int, str]]:
    """(section, place, JSON text) of a document's elements, and its other members as objects of one member in section ''; one element at a time is held."""
    decoder, decode = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")().decode
    text, at, ended, step = "", 0, False, size

    def more() -> bool:
        nonlocal text, at, ended
        if ended:
            return False
        data = read(step)
        ended = not data
        text, at = text[at:] + decode(data, ended), 0
        return True

    def peek() -> str:
        nonlocal at
        while True:
            at = _BLANK.match(text, at).end()
            if at < len(text) or not more():
                return text[at : at + 1]

    def take(wanted: str) -> str:
        nonlocal at
        found = peek()
        if not found or found not in wanted:
            raise ArtifactError(f"{found or 'the end'!r} in place of {wanted!r}")
        at += 1
        return found

    def value() -> tuple[object, str]:
        nonlocal at, step
        peek()
        while True:
            try:
                found, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError as error:
                if not more():
                    raise ArtifactError(str(error)) from error
                step *= 2  # a long element is not read again for each buffer
                continue
            if end == len(text) and more():  # a number may go on
                continue
            step, raw = size, text[at:end]
            at = end
            return found, raw

    def listed(closing: str) -> Iterator[int]:
        nonlocal at
        if peek() == closing:
            at += 1
            return
        n, found = 0, ","
        while found == ",":
            yield n
            n, found = n + 1, take("," + closing)

    def name() -> str:
        if peek() != '"':
            take('"')
        key, _ = value()
        take(":")
        return key

    seen = set()
    take("{")
    for n in listed("}"):
        key = name()
        if key in seen:
            raise ArtifactError(f"{key} is told twice")
        seen.add(key)
        opening = peek()
        if (key in _ARRAYS and opening == "[") or (key == "source_shas" and opening == "{"):
            take(opening)
            yield "", n, json.dumps({key: []})
            for k in listed("]" if opening == "[" else "}"):
                yield key, k, value()[1] if opening == "[" else json.dumps({"source_path": name(), "source_sha": value()[0]})
        else:
            yield "", n, json.dumps({key: value()[0]})
    if peek():
        raise ArtifactError("text behind the document")


def scan_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(section, at, text): a document's elements with their places, written as it is read, so that no row has the document; fails on malformed JSON."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, inner = located(path)
            with system.open_input_stream(inner) as stream:
                found = _members(stream.read)
                while rows := list(itertools.islice(found, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["section", "at", "text"])

    folder = shared_folder(spark, "elements")
    spark.range(0, 1, 1, 1).mapInArrow(scan, "section string, at long, text string").write.option("parquet.block.size", 16 * _BUFFER).parquet(folder)
    return spark.read.schema("section string, at long, text string").parquet(folder)


def section_of(elements: DataFrame, name: str) -> DataFrame:
    """(at, s): the elements of an array of a scanned document, parsed where they lie."""
    kind = T.StructType.fromDDL(ARTIFACT)[name].dataType.elementType if name in _ARRAYS else T.StructType.fromDDL("source_path string, source_sha string")
    return elements.where(F.col("section") == name).select("at", F.from_json("text", kind, {"mode": "FAILFAST"}).alias("s"))


def import_elements(elements: DataFrame) -> dict[str, DataFrame]:
    """The tables of a scanned document, as ``import_artifact`` has them."""
    head: dict = {}
    for row in elements.where("section = ''").collect():  # members that are no elements
        head |= json.loads(row.text)
    _checked(head)
    head = head | {"generator": {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in head["generator"].items()}}
    return _tables(head, section_of(elements, "symbols").select("s.*"), section_of(elements, "claims").select("at", F.col("s").alias("c")), section_of(elements, "git_commits").select("s.*"), section_of(elements, "source_shas").select("s.*"))


def empty_history(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], COMMITS), spark.createDataFrame([], "file_path string, commit_sha string")


def nest(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Canonically ordered symbols, claims, commits and source shas with '' as null."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    symbols = tables["symbols"].select("id", "name", "kind", "path", "line", *[blank(c) for c in _OPTIONAL_SYMBOL], F.coalesce("file_sha", F.lit("")).alias("file_sha")).orderBy("id")
    ids = tables["claim_symbols"].groupBy("claim_id").agg(F.sort_array(F.collect_set("symbol_id")).alias("symbol_ids"))
    claims = tables["claims"].join(ids, "claim_id", "left").withColumn("symbol_ids", F.coalesce("symbol_ids", F.array().cast("array<string>")))
    first = F.coalesce(F.get("symbol_ids", F.lit(0)), F.lit(""))
    claims = claims.orderBy("source", first, "claim", "claim_id").select("source", "source_path", "source_sha", "severity", "claim", *[blank(c) for c in _OPTIONAL_CLAIM], "symbol_ids")
    commits = commit_files(tables["commits"], tables["file_commits"]).orderBy(F.desc("date"), "sha").select("sha", "date", "message", "author_email", "files")
    return {"symbols": symbols, "claims": claims, "git_commits": commits, "source_shas": tables["source_shas"].orderBy("source_path")}


def _elements(rows: DataFrame, optional: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """(text): each row as an element of the document, rendered where the row is; in the order of ``rows``.

    Optional members without a value are left out; with a ``key``, a row (key, value) is a member.
    """
    names = rows.columns

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.to_pylist():
                if key is not None:
                    texts.append(f"    {json.dumps(row[key], ensure_ascii=False)}: {json.dumps(row[names[1]], ensure_ascii=False)}")
                    continue
                kept = {k: v for k, v in row.items() if k not in optional or v not in (None, "")}
                texts.append("    " + json.dumps(kept, indent=2, ensure_ascii=False).replace("\n", "\n    "))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return rows.mapInArrow(render, "text string")


def _joined(elements: DataFrame, opening: str, closing: str) -> Iterator[str]:
    """The elements between brackets; one partition of them at a time is on the driver."""
    before = f"{opening}\n"
    for row in elements.toLocalIterator():
        yield before + row.text
        before = ",\n"
    yield f"\n  {closing}" if before == ",\n" else opening + closing


def _generator_order(key: str) -> tuple[int, str]:
    return (0 if key.endswith("_version") else 1 if key.endswith("_commit_sha") else 2, key)


def artifact_pieces(tables: dict[str, DataFrame], **overrides: str) -> Iterator[str]:
    """The canonical JSON text in pieces, two spaces of indent and one final newline.

    ``overrides`` replace stored values of version, generated_at or extracted_at_sha.
    Elements are sorted by range and rendered in the tasks; the driver hands on
    their texts, one partition at a time, as the document is one file by its nature.
    """
    meta = {r.key: r.value for r in tables["meta"].collect()} | {k: v for k, v in overrides.items() if v is not None}
    parts = nest(tables)
    document = {"version": meta.get("version", ARTIFACT_VERSIONS[-1]), "generated_at": meta.get("generated_at", "")}
    if meta.get("extracted_at_sha"):
        document["extracted_at_sha"] = meta["extracted_at_sha"]
    generator = {k.removeprefix("generator."): v for k, v in meta.items() if k.startswith("generator.")}
    document["generator"] = {k: generator[k] for k in sorted(generator, key=_generator_order)}
    yield json.dumps(document, indent=2, ensure_ascii=False).removesuffix("\n}")
    yield ',\n  "source_shas": '
    yield from _joined(_elements(parts["source_shas"].select("source_path", "source_sha"), key="source_path"), "{", "}")
    for name, optional in (("symbols", _OPTIONAL_SYMBOL), ("claims", _OPTIONAL_CLAIM), ("git_commits", ())):
        pieces = _joined(_elements(parts[name], optional), "[", "]")
        first = next(pieces)
        if name == "git_commits" and first == "[]":
            continue
        yield f',\n  "{name}": {first}'
        yield from pieces
    yield "\n}\n"


def export_artifact(tables: dict[str, DataFrame], **overrides: str) -> str:
    """The whole text, for documents that are small enough to hold; ``write_artifact`` holds none."""
    return "".join(artifact_pieces(tables, **overrides))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as Parquet below a new folder; links are checked first."""
    if not dangling(tables.get("claim_symbols", None) or tables["symbols"].sparkSession.createDataFrame([], CLAIM_SYMBOLS), "symbol_id", tables["symbols"], "id").isEmpty():
        raise ArtifactError("links to unknown symbols")
    for name, table in tables.items():
        table.write.mode("error").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = ("symbols", "claims", "claim_symbols", "commits", "file_commits", "source_shas", "meta")
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_artifact(tables: dict[str, DataFrame], path: str, **overrides: str) -> None:
    """The exported document as one UTF-8 file (a path or URI); it is written piece by piece and takes its place when it is whole."""
    system, inner = located(path)
    draft = f"{inner}.{uuid.uuid4().hex}.draft"
    try:
        with system.open_output_stream(draft, buffer_size=_BUFFER) as out:
            for piece in artifact_pieces(tables, **overrides):
                out.write(piece.encode())
        system.move(draft, inner)
    finally:
        with suppress(FileNotFoundError):
            system.delete_file(draft)


def same_content(one: str, two: str) -> bool:
    """Whether two exported documents differ in nothing but when they were generated."""
    plain = [{k: v for k, v in json.loads(text).items() if k != "generated_at"} for text in (one, two)]
    return plain[0] == plain[1]


def cleared(tables: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """The tables with those of the given names empty; links go with the claims or the symbols."""
    gone = {*names, *(["claim_symbols"] if {"claims", "symbols"} & set(names) else [])}
    return {name: table.limit(0) if name in gone else table for name, table in tables.items()}


def is_empty(tables: dict[str, DataFrame]) -> bool:
    """Whether no symbols are stored."""
    return tables["symbols"].isEmpty()


def setting_of(tables: dict[str, DataFrame], key: str, override: str | None = None, default: str | None = None) -> str | None:
    """A value of the meta data: what the caller names, else what is stored, else the default."""
    if override is not None:
        return override
    row = tables["meta"].where(F.col("key") == key).select("value").first()
    return row.value if row else default


def source_sha_of(tables: dict[str, DataFrame], paths: DataFrame) -> DataFrame:
    """(path, source_sha) of paths (path); null for those without one."""
    return paths.join(tables["source_shas"].withColumnRenamed("source_path", "path"), "path", "left")
