"""Incremental runs as a stream: file events arrive in a folder, each micro-batch is diffed against the baseline.

The baseline is a table (path, sha, batch) of a snapshot store, in parts sorted by
path: a batch looks up the paths it touches, and writes a part with those that
changed and their changes, in one commit that carries the number of the batch.  A
batch that is run again after a failure finds its number committed and does
nothing, so every batch counts once.  Parts of like size are merged when ``FANOUT``
of them have come together; writing is in proportion to what changes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.operators.diff import merge_latest, sha_diff
from symloom.sources.snapshots import Manifest, Part, SnapshotStore

FILE_EVENTS = "path string, sha string, seq long"
#: Parts of a tier that are merged into one; rows of the smallest tier.
FANOUT, SMALLEST = 4, 1024
#: Batches whose changes a version names; those of earlier ones are in the versions before.
NAMED = 64
#: Paths up to which the baseline is looked up by value, so that the scan skips what does not hold them.
LOOKED_UP = 1000


def apply_batch(baseline: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new baseline, changes) after events (path, sha, seq); a null sha is a deletion, the last event of a path counts."""
    last = last_events(events)
    touched = baseline.join(last.select("path"), "path", "left_semi")
    changes = sha_diff(touched, last.where("sha is not null")).where("status <> 'unchanged'")
    merged = merge_latest(baseline, last, ["path"]).where("sha is not null")
    return merged, changes


def last_events(events: DataFrame) -> DataFrame:
    return events.groupBy("path").agg(F.max_by("sha", "seq").alias("sha"))


class Baseline:
    """The baseline of a store, with the changes of each batch."""

    def __init__(self, store: SnapshotStore):
        self.store = store

    def _parts(self, manifest: Manifest | None, name: str = "baseline") -> list[Part]:
        return [] if manifest is None else manifest.tables.get(name, [])

    def batch(self) -> int:
        """The number of the last batch that was committed, -1 before the first."""
        manifest = self.store.manifest()
        return -1 if manifest is None else int(manifest.properties.get("batch", -1))

    def rows(self, paths: DataFrame | None = None, manifest: Manifest | None = None) -> DataFrame:
        """(path, sha) of what there is, of all paths or of some (path)."""
        parts = self._parts(manifest or self.store.manifest())
        if not parts:
            return self.store.spark.createDataFrame([], "path string, sha string")
        every = self.store.rows(parts)
        if paths is not None:
            few = [r.path for r in paths.limit(LOOKED_UP + 1).collect()]
            every = every.where(F.col("path").isin(few)) if len(few) <= LOOKED_UP else every.join(paths, "path", "left_semi")
        return _latest(every).where("sha IS NOT NULL").select("path", "sha")

    def changes(self, batch: int) -> DataFrame:
        """(path, status) of a batch; nothing for one that changed nothing, or that the newest version names no more."""
        parts = [p for p in self._parts(self.store.manifest(), "changes") if p.notes["batch"] == batch]
        return self.store.rows(parts) if parts else self.store.spark.createDataFrame([], "path string, status string")

    def apply(self, events: DataFrame, batch: int) -> Manifest | None:
        """Commit a batch of events, unless it is committed already."""
        base = self.store.manifest()
        if base is not None and int(base.properties.get("batch", -1)) >= batch:
            return base
        last = self.store.write("events", last_events(events.where("path IS NOT NULL")))
        wanted = self.store.rows([last])
        changes = sha_diff(self.rows(wanted.select("path"), base), wanted.where("sha IS NOT NULL")).where("status <> 'unchanged'")
        changed = self.store.write("changes", changes, batch=batch)
        told = self.store.rows([changed]).join(wanted, "path", "left").select("path", F.when(F.col("status") != "deleted", F.col("sha")).alias("sha"), F.lit(batch).cast("long").alias("batch"))
        tables = {"changes": [*self._parts(base, "changes"), changed][-NAMED:]}
        parts = list(self._parts(base))
        if changed.rows:
            parts = self._merged([*parts, self._written(told, batch)])
        made = self.store.commit(base, tables | {"baseline": parts}, properties={"batch": str(batch)})
        self.store.files.remove(last.folder)
        return made

    def _written(self, rows: DataFrame, batch: int) -> Part:
        return self.store.write("baseline", rows.repartitionByRange("path").sortWithinPartitions("path"), batch=batch)

    def _merged(self, parts: list[Part]) -> list[Part]:
        """Parts with full tiers merged; a deletion stays as long as an older part may hold its path."""
        while True:
            tiers: dict[int, list[Part]] = {}
            for part in parts:
                tiers.setdefault(int(math.log(max(part.rows, SMALLEST) / SMALLEST, FANOUT)), []).append(part)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FANOUT), None)
            if full is None:
                return parts
            rest = [p for p in parts if p not in full]
            rows = _latest(self.store.rows(full))
            if not rest:
                rows = rows.where("sha IS NOT NULL")
            parts = [*rest, self._written(rows, max(p.notes["batch"] for p in full))]


def _latest(rows: DataFrame) -> DataFrame:
    one = rows.groupBy("path").agg(F.max(F.struct("batch", "sha")).alias("last"))
    return one.select("path", "last.sha", "last.batch")


def follow(spark: SparkSession, inbox: str, state: str, checkpoint: str) -> StreamingQuery:
    """Process what lies in ``inbox`` (JSON lines of ``FILE_EVENTS``) and stop; ``state`` is the folder of the store."""
    baseline = Baseline(SnapshotStore(spark, state))

    def step(batch: DataFrame, number: int) -> None:
        baseline.apply(batch, number)

    events = spark.readStream.schema(FILE_EVENTS).json(inbox)
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
