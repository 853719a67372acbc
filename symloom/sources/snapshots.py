"""Versioned snapshots of tables: immutable parts, and one manifest for each version that names them.

    <root>/data/<table>-<id>/     Parquet, written once and never changed
    <root>/versions/<number>.json  format, parts of each table, properties

A commit writes parts first and then its manifest, under a temporary name that
is renamed: the version is there from that moment on, whole.  Whatever fails
before leaves the version before as the newest.  A manifest never replaces
another, so of two writers that start from one version the second fails.  Tables
that a commit does not touch keep their parts: writing is in proportion to the
change.  Readers name a version or take the newest; what they read cannot change
under them until ``vacuum`` removes it.

``save_tables`` and ``open_tables`` keep the knowledge tables in such a store, with
links checked before the commit and older formats brought up step by step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symloom.functions.paths import language_of_id
from symloom.schemas import dangling
from symloom.sources.artifact import ArtifactError, empty_history
from symloom.sources.folders import Folder


class ConflictError(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Part:
    """One immutable folder of rows; ``notes`` are the writer's."""

    folder: str
    rows: int
    schema: str
    notes: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    version: int
    format: int
    tables: dict[str, list[Part]]
    properties: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        tables = {name: [vars(p) for p in parts] for name, parts in self.tables.items()}
        return json.dumps({"format": self.format, "tables": tables, "properties": self.properties}, indent=1, sort_keys=True) + "\n"

    @staticmethod
    def of(version: int, text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(version, found["format"], {n: [Part(**p) for p in parts] for n, parts in found["tables"].items()}, found["properties"])


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Folder(spark, root)

    # reading

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """That of a version, or the newest; None where nothing was committed."""
        known = self.versions()
        if version is None and not known:
            return None
        number = known[-1] if version is None else version
        if number not in known:
            raise KeyError(f"no version {number}")
        return Manifest.of(number, self.files.read(f"versions/{number:09d}.json"))

    def rows(self, parts: Iterable[Part]) -> DataFrame:
        """The rows of some parts of one table."""
        parts = list(parts)
        schema = StructType.fromJson(json.loads(parts[0].schema))
        filled = [self.files.path(p.folder) for p in parts]
        return self.spark.read.schema(schema).parquet(*filled)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.rows(self.manifest(version).tables[name])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.rows(parts) for name, parts in self.manifest(version).tables.items()}

    # writing

    def write(self, name: str, rows: DataFrame, **notes: Any) -> Part:
        """A new part; it belongs to no version until a commit names it."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(self.files.path(folder))
        written = self.spark.read.schema(rows.schema).parquet(self.files.path(folder))
        return Part(folder, written.count(), rows.schema.json(), notes)  # counted from the footers

    def commit(self, base: Manifest | None, tables: dict[str, list[Part]], format: int = 1, properties: dict[str, str] | None = None) -> Manifest:
        """The version after ``base``, with the tables given; the others stay as they are."""
        kept = {} if base is None else base.tables
        told = ({} if base is None else base.properties) | (properties or {})
        made = Manifest(1 if base is None else base.version + 1, format, kept | tables, told)
        newest = self.versions()
        if newest and newest[-1] >= made.version:
            raise ConflictError(f"version {made.version} is there already")
        try:
            self.files.create(f"versions/{made.version:09d}.json", made.text())
        except FileExistsError as error:
            raise ConflictError(f"version {made.version} is there already") from error
        return made

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the newest ``keep`` versions, and data that no version left names; what was removed.

        Parts of a commit under way are named by no version yet: run it while nobody writes.
        """
        known = self.versions()
        old = known[: max(len(known) - max(keep, 1), 0)]
        for number in old:
            self.files.remove(f"versions/{number:09d}.json")
        named = {p.folder for n in known[len(old) :] for parts in self.manifest(n).tables.values() for p in parts}
        lost = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in named]
        lost += [f"versions/{n}" for n in self.files.names("versions") if n.endswith(".draft")]
        for name in lost:
            self.files.remove(name)
        return [f"versions/{n:09d}.json" for n in old] + lost


# ---- the knowledge tables

Tables = dict[str, DataFrame]


def _with_history(tables: Tables) -> Tables:
    commits, file_commits = empty_history(tables["symbols"].sparkSession)
    return {"commits": commits, "file_commits": file_commits}


def _with_parents(tables: Tables) -> Tables:
    return {"symbols": tables["symbols"].withColumn("parent_id", F.lit(None).cast("string"))}


def _with_languages(tables: Tables) -> Tables:
    return {"symbols": tables["symbols"].withColumn("language", language_of_id("id"))}


#: What brings the tables of a format to the next: the tables that change, from those that are there.
MIGRATIONS: dict[int, Callable[[Tables], Tables]] = {1: _with_history, 2: _with_parents, 3: _with_languages}
FORMAT = max(MIGRATIONS) + 1


def check_links(tables: Tables) -> None:
    for column, target, key in (("symbol_id", "symbols", "id"), ("claim_id", "claims", "claim_id")):
        if not dangling(tables["claim_symbols"], column, tables[target], key).isEmpty():
            raise ArtifactError(f"links to unknown {target}")


def save_tables(store: SnapshotStore, tables: Tables, base: Manifest | None = None, **properties: str) -> Manifest:
    """Replace the given tables in one version; ``base`` is what the writer read, the newest if not told.

    Links are checked on what the version will hold, before it is committed.
    """
    base = base or store.manifest()
    if base is not None and base.format != FORMAT:
        base = migrate(store)
    parts = {name: [store.write(name, rows)] for name, rows in tables.items()}
    after = ({} if base is None else base.tables) | parts
    check_links({name: store.rows(after[name]) for name in ("symbols", "claims", "claim_symbols")})
    return store.commit(base, parts, FORMAT, properties)


def migrate(store: SnapshotStore) -> Manifest:
    """Bring the newest version to the present format, one commit for each step; only changed tables are written."""
    base = store.manifest()
    if base is None:
        raise KeyError("nothing is stored")
    if base.format > FORMAT:
        raise ArtifactError(f"format {base.format} is newer than {FORMAT}")
    while base.format < FORMAT:
        changed = MIGRATIONS[base.format]({name: store.rows(parts) for name, parts in base.tables.items()})
        base = store.commit(base, {name: [store.write(name, rows)] for name, rows in changed.items()}, base.format + 1)
    return base


def open_tables(store: SnapshotStore, version: int | None = None) -> Tables:
    """The tables of a version as the present format has them; older ones are brought up in the plan, nothing is written."""
    found = store.manifest(version)
    if found is None:
        raise KeyError("nothing is stored")
    tables = {name: store.rows(parts) for name, parts in found.tables.items()}
    return reduce(lambda t, step: t | MIGRATIONS[step](t), range(found.format, FORMAT), tables)


def append_rows(store: SnapshotStore, name: str, rows: DataFrame, base: Manifest | None = None) -> Manifest:
    """A version with one more part of a table; the parts that are there stay."""
    base = base or store.manifest()
    return store.commit(base, {name: [*base.tables[name], store.write(name, rows)]}, base.format)


