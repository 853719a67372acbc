"""MinHash near-dedup with odd sketches.

Each text's set of word shingles is reduced to ``BANDS * ROWS`` min-hashes.
They give band keys, which propose pairs, and an odd sketch: a bitmap in which
every min-hash flips one bit.  The population count of two sketches' XOR
estimates their similarity most precisely where it is high, so it sorts out
nearly all false proposals; what is left is confirmed on the full sets.

Texts with equal sets form a class first and take part once.  Every bucket has a
leader, and the buckets of one leader make a star.  First each text is compared
with the leader that it shares most buckets with: one pair for each text.  What
is then still in different components of a star is compared in tiles: the
star's rows are dealt into blocks of bounded size, and a task gets two blocks,
skips pairs of one component, sorts out the others by sketches and confirms on
full sets.  It gives out links only, and only those that join components, so no
row stands for a pair that is not a link and no link between two components is
lost.  Rows of a star's largest component meet the other rows only, so the work
grows with the rows outside of it times the star.

Words are runs of other characters than space and \\t to \\r, with A-Z
lower-cased.  A text with fewer than ``k`` words is one shingle; texts without
words (or null) have an empty set and are linked with nothing.  Repeated rows
share a class; rows with a null id are in no component and are kept; an empty
table gives an empty result and extra columns are ignored.

At similarity 0.8, a pair shares no band with probability (1 - 0.8**5)**32 =
3e-6, and both sketch filters err at the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import broadcast_if_small, written
from symloom.llm.graph import components
from symloom.llm.kernels import Words, mix, ngrams, seeds, text_blocks
from symloom.llm.worker import lean

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: Pairs whose sketches estimate a lower similarity are not confirmed.
SKETCH_FLOOR = 0.5
#: The finer sketches of the last pass, more than 4 standard deviations below 0.8.
FINE_SAMPLES, FINE_BITS, FINE_FLOOR = 640, 2048, 0.72
#: A block of a tile has about so many shingles (8 bytes each), or rows where only sketches are compared.
TILE_SHINGLES, TILE_ROWS = 400_000, 4096

_SKETCH = "id long, n_shingles long, s1 long, s2 long, bands array<long>, odd array<long>"


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    grams = ngrams(words.hashes, k)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(ngrams(words.hashes[a:b], b - a, salt=100 + b - a))
        else:
            sets.append(grams[:0])
    return sets


def max_xor(bits: int = SKETCH_BITS, samples: int = BANDS * ROWS, floor: float = SKETCH_FLOOR) -> int:
    """The XOR count at which two odd sketches estimate the similarity ``floor``."""
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - floor) / bits)))


def odd_sketches(minima: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps (as 64-bit words) of rows of min-hashes."""
    n, samples = minima.shape
    at = mix(minima + seeds(samples, 5)) % np.uint64(bits)
    flat = (np.arange(n, dtype=np.int64)[:, None] * bits + at.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def _sketch(k: int, bands: int, rows: int):
    factors = seeds(bands * rows, 3)
    band_salt = seeds(bands, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(Words(data, offsets), k)
                yield _sketched(batch.column(0).slice(i, j - i), sets)

    def _sketched(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        full = np.flatnonzero(size)
        out = {"s1": np.zeros(len(sets), np.int64), "s2": np.zeros(len(sets), np.int64), "bands": np.zeros((len(sets), bands), np.int64), "odd": np.zeros((len(sets), SKETCH_BITS // 64), np.int64)}
        if len(full):
            flat = np.concatenate([sets[k] for k in full])
            start = np.r_[0, np.cumsum(size[full])[:-1]]
            minima = np.empty((len(full), bands * rows), dtype=np.uint64)
            for m, a in enumerate(factors):
                minima[:, m] = np.minimum.reduceat(flat * a, start)
            out["s1"][full] = np.add.reduceat(mix(flat), start).view(np.int64)
            out["s2"][full] = np.add.reduceat(mix(flat ^ np.uint64(0xABCDEF)), start).view(np.int64)
            parts = minima.reshape(len(full), bands, rows)
            keys = np.zeros((len(full), bands), dtype=np.uint64)
            for r, a in enumerate(seeds(rows, 6)):
                keys += mix(parts[:, :, r]) * a
            out["bands"][full] = mix(keys + band_salt).view(np.int64)
            out["odd"][full] = odd_sketches(minima)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(out[c].ravel()), out[c].shape[1]).cast(pa.list_(pa.int64())) for c in ("bands", "odd")]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(size), pa.array(out["s1"]), pa.array(out["s2"]), *lists], names=["id", "n_shingles", "s1", "s2", "bands", "odd"])

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return plain.mapInArrow(lean(_sketch(k, bands, rows)), _SKETCH)


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _close(name: str, bits: int, most: int) -> Column:
    """Whether the sketches ``name``_a and ``name``_b differ in at most ``most`` bits."""
    each = [F.bit_count(F.get(f"{name}_a", F.lit(i)).bitwiseXOR(F.get(f"{name}_b", F.lit(i)))) for i in range(bits // 64)]
    return sum(each[1:], each[0]) <= most


def _alike(percent: int) -> Column:
    """Sizes allow the similarity and the sketches do not rule it out."""
    return _sizes_fit(percent) & _close("odd", SKETCH_BITS, max_xor())


def _sets(k: int, fine: bool):
    """(id, grams, sketch): a text's sorted shingle hashes and, with ``fine``, its finer odd sketch, as bytes."""
    factors = seeds(FINE_SAMPLES, 8)

    def sketched(sets: list[np.ndarray]) -> np.ndarray:
        size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        minima = np.zeros((len(sets), FINE_SAMPLES), dtype=np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            flat, start = np.concatenate([sets[k] for k in full]), np.cumsum(size[full]) - size[full]
            for m, a in enumerate(factors):
                minima[full, m] = np.minimum.reduceat(flat * a, start)
        return odd_sketches(minima, FINE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(Words(data, offsets), k)
                sketch = [row.tobytes() for row in sketched(sets)] if fine else [b""] * len(sets)
                columns = [batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "grams", "sketch"])

    return run


def shingles_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, fine: bool) -> DataFrame:
    """(id, grams, sketch) of the documents in ``ids`` (id, distinct and written), written."""
    small = broadcast_if_small(ids, ids.count(), 16)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).join(small, "id", "left_semi")
    return written(texts.dropDuplicates(["id"]).mapInArrow(lean(_sets(k, fine)), "id long, grams binary, sketch binary"), "shingles")


def tiles(rows: DataFrame, group: str, minor: str, weight: Column, most: int) -> DataFrame:
    """Deal the rows of each group into blocks and the blocks into tiles, so that no task holds a group.

    Rows marked ``minor`` meet all others of their group; the rest meet minor ones
    only.  A tile (i, j) is two blocks of about ``most`` in ``weight`` each, side 0
    of which is minor; (i, i) is a minor block with itself.
    """
    total = [F.sum(F.when(side, weight)).alias(name) for side, name in ((F.col(minor), "low"), (~F.col(minor), "high"))]
    sizes = rows.groupBy(group).agg(*total).where("low is not null")
    parts = [F.ceil(F.coalesce(F.col(c), F.lit(0)) / F.lit(most)).alias(c) for c in ("low", "high")]
    # Written, so that the join by group is not tied to the sums' partitions and hot groups can be split.
    dealt = rows.join(written(sizes.select(group, *parts), "tile-sizes"), group)
    own = F.when(F.col(minor), F.pmod(F.xxhash64("id"), "low")).otherwise(F.col("low") + F.pmod(F.xxhash64("id"), "high"))
    dealt = dealt.withColumn("block", own)
    before = F.transform(F.sequence(F.lit(0).cast("long"), F.least("block", F.col("low") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    after = F.transform(F.sequence("block", F.col("low") + F.col("high") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    every = F.when(F.col(minor), F.array_distinct(F.concat(before, after))).otherwise(before)
    out = dealt.withColumn("tile", F.explode(every))
    return out.select(*[c for c in rows.columns if c != minor], "tile.i", "tile.j", F.when(F.col("tile.i") == F.col("block"), 0).otherwise(1).alias("side"))


@dataclass
class Tile:
    """Two blocks of rows of one group; ``one`` is the number of rows of side 0."""

    ids: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    sketches: np.ndarray
    grams: pa.Array
    one: int
    itself: bool

    def close(self, k: int, most: int, percent: int) -> np.ndarray:
        """Rows that row ``k`` of side 0 is to be compared with: other label, fitting size, near sketch."""
        start = k + 1 if self.itself else self.one
        apart = self.labels[start:] != self.labels[k]
        low, high = np.minimum(self.sizes[start:], self.sizes[k]), np.maximum(self.sizes[start:], self.sizes[k])
        at = np.flatnonzero(apart & (100 * low >= percent * high)) + start
        if self.sketches.shape[1]:
            far = np.bitwise_count(self.sketches[at] ^ self.sketches[k]).sum(axis=1)
            near = far <= most
            at = at[near][np.argsort(far[near], kind="stable")]
        return at

    def set_of(self, k: int) -> np.ndarray:
        return np.frombuffer(self.grams[k].as_buffer(), dtype=np.uint64)


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    """The tiles of sorted rows (group, i, j, side, id, label, n_shingles, sketch, grams)."""

    def built(parts: list[pa.RecordBatch]) -> Tile:
        table = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)
        grams = table.column("grams").combine_chunks()
        one = int((column("side") == 0).sum())
        return Tile(column("id"), column("label").copy(), column("n_shingles"), sketch, grams, one, bool(column("i")[0] == column("j")[0]))

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield built(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield built(held)


def _active(most: int, percent: int):
    """(id) of rows with a near sketch of another label in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles_of(batches):
            active = np.zeros(len(tile.ids), dtype=bool)
            for k in range(tile.one):
                near = tile.close(k, most, percent)
                active[near] = True
                active[k] |= len(near) > 0
            yield pa.RecordBatch.from_arrays([pa.array(tile.ids[active])], names=["id"])

    return run


#: Rows whose sets are intersected with one set at a time.
_AT_ONCE = 32


def _linked(most: int, percent: int):
    """(a, b): links that join rows of different labels, fewer than the rows of the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles_of(batches):
            links: list[tuple[int, int]] = []
            for k in range(tile.one):
                left = tile.close(k, most, percent)
                own = tile.set_of(k) if len(left) else None
                while len(left):
                    now, left = left[:_AT_ONCE], left[_AT_ONCE:]
                    shared = _shared(own, [tile.set_of(i) for i in now.tolist()])
                    similar = 100 * shared >= percent * (len(own) + tile.sizes[now] - shared)
                    for i in now[similar].tolist():
                        if tile.labels[i] != tile.labels[k]:
                            links.append((int(tile.ids[k]), int(tile.ids[i])))
                            tile.labels[tile.labels == tile.labels[i]] = tile.labels[k]
                    left = left[tile.labels[left] != tile.labels[k]]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted ``own`` are in each of the ``others``, none of which is empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    size = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)


def _in_tiles(rows: DataFrame, weight: Column, most: int, payload: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the tiles of (leader, id, label, n_shingles, minor); ``payload``: (id, sketch, grams)."""
    full = tiles(rows, "leader", "minor", weight, most).join(payload, "id")
    dealt = full.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side", "id")
    return dealt.select("leader", "i", "j", "side", "id", "label", "n_shingles", "sketch", "grams").mapInArrow(lean(run), schema)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) of every row; links have similarity ``percent`` / 100 or more."""
    every = written(sketches(docs, id_col, text_col, k), "sketches")
    ided = every.where("n_shingles > 0 and id is not null")
    classes = written(ided.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    reps = ided.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    reps = written(reps.select("id", "n_shingles", "bands", "odd"), "reps")
    light, size = reps.select("id", "n_shingles", "odd"), reps.select("id", "n_shingles")
    stars = written(_stars(reps.select("id", F.explode("bands").alias("key"))), "stars")

    # One pair for each text: with the leader that it shares most buckets with.
    pairs = stars.where("id <> leader").groupBy("id").agg(F.max(F.struct("shared", (-F.col("leader")).alias("minus"))).alias("best"))
    pairs = pairs.select("id", (-F.col("best.minus")).alias("leader")).join(light.toDF("id", "n_a", "odd_a"), "id").join(light.toDF("leader", "n_b", "odd_b"), "leader")
    pairs = written(pairs.where(_alike(percent)).select("leader", "id", F.lit(False).alias("minor")), "pairs")
    led = pairs.union(pairs.select("leader", F.col("leader").alias("id"), F.lit(True)).distinct())
    grams = shingles_of(written(led.select("id").distinct(), "pair-ids"), docs, id_col, text_col, k, fine=False)
    rows = led.join(size, "id").withColumn("label", F.col("id"))
    links = written(_in_tiles(rows, F.col("n_shingles"), TILE_SHINGLES, grams, _linked(0, percent), "a long, b long"), "links")
    labels = components(links)

    # What is in different components of a star: sketches tell who may be linked, full sets who is.
    packed = light.select("id", _packed("odd").alias("sketch"), F.lit(b"").alias("grams"))
    active = _in_tiles(_mixed(stars, labels).join(size, "id"), F.lit(1), TILE_ROWS, packed, _active(max_xor(), percent), "id long")
    active = written(active.distinct(), "active")
    n = active.count()
    if n:
        fine = shingles_of(active, docs, id_col, text_col, k, fine=True)
        rows = _mixed(stars.join(broadcast_if_small(active, n, 16), "id", "left_semi"), labels).join(size, "id")
        most = max_xor(FINE_BITS, FINE_SAMPLES, FINE_FLOOR)
        more = _in_tiles(rows, F.col("n_shingles"), TILE_SHINGLES, fine, _linked(most, percent), "a long, b long")
        labels = components(written(links.union(more), "links"))

    classed = every.select("id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    classed = classed.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    labels = labels.select(F.col("id").alias("rep"), "label")
    return classed.join(labels, "rep", "left").select("id", "n_shingles", F.coalesce("label", "rep").alias("component"))


def _packed(column: str) -> Column:
    """An array of longs as the little-endian bytes that NumPy reads."""
    hexed = [F.lpad(F.hex(F.get(column, F.lit(i))), 16, "0") for i in range(SKETCH_BITS // 64)]
    return F.unhex(F.concat(*hexed))


def _stars(keys: DataFrame) -> DataFrame:
    """(leader, id, shared): the members of all buckets that an id leads, and how many buckets they share.

    A bucket is led by the member that is in most shared buckets, which in a
    group of near copies is one for nearly all buckets.  Members of a bucket have
    its leader in common, so every pair that shares a bucket is in one star.
    """
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(keys.join(shared, "key"), "members")
    degree = members.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = members.join(degree, "id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("best"))
    led = members.join(leaders.select("key", (-F.col("best.minus")).alias("leader")), "key")
    return led.groupBy("leader", "id").agg(F.count(F.lit(1)).alias("shared"))


def _mixed(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(leader, id, label, minor) of the stars with members of different components.

    A row is minor unless its star has most members of its label.
    """
    placed = written(stars.select("leader", "id").join(labels, "id", "left").select("leader", "id", F.coalesce("label", "id").alias("label")), "placed")
    counted = placed.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("n"))
    major = counted.groupBy("leader").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    major = written(major.select("leader", F.col("most.label").alias("major")), "mixed-stars")
    return placed.join(major, "leader").select("leader", "id", "label", (F.col("label") != F.col("major")).alias("minor"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): the smallest id of each component is kept."""
    found = near_components(docs, id_col, text_col, k, percent)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id; columns stay as they are."""
    gone = written(near_dedup(docs, id_col, text_col, k, percent).where("not kept").select(F.col(id_col).alias("__gone")).distinct(), "near-duplicates")
    small = broadcast_if_small(gone, gone.count(), 16)
    return docs.join(small, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
