"""Connected components of an edge table, without collecting links or labels.

Links are contracted in chunks of bounded size: a task replaces its links by
the stars of their components.  Where one chunk holds all links, that is the
result.  Beyond that, rounds of large and small stars join the chunks' stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import written
from symloom.llm.worker import lean

#: Links that a task contracts at once (about 60 bytes each).
CHUNK_LINKS = 1_000_000
#: Alternating rounds end by themselves; this is an alarm, not a cap on the result.
_ROUNDS = 60


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the links a - b."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def _contract(chunk: int):
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in range(2))
        node, label = stars(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, chunk: int = CHUNK_LINKS) -> DataFrame:
    """(id, label): the smallest reachable id for every node that has an edge; ``edges``: (a, b), written."""
    links = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    n = links.count()
    near = links.coalesce(max(1, -(-n // chunk))).mapInArrow(lean(_contract(chunk)), "u long, v long")
    if n <= chunk:
        return written(near.toDF("id", "label"), "components")
    now = written(near.where("u <> v").distinct(), "edges")
    for _ in range(_ROUNDS):
        # Done when each node points at one smaller node that points at nothing.
        centre = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        loose = now.join(centre.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or centre.where("n > 1").limit(1).count()
        if not loose:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())
        now = written(_small_star(_large_star(now)), "edges")
    raise RuntimeError("components did not settle")
