"""Repeated strings of at least ``min_bytes`` bytes, by threshold-bounded interval expansion.

Inside a task the method is this: the Burrows-Wheeler transform of a text is
searched backward, all strings of one length at a time.  An interval of the
suffix order that stands for a string w is extended to one for each byte c before
it, and where the interval of cw ends, the common prefix of the suffixes on both
sides is as long as w, unless a shorter one is known there.  Common prefixes come
out by increasing value; at ``min_bytes`` the search ends, and what has no value by
then shares ``min_bytes`` or more.

No text of the whole corpus is sorted, as equal strings are brought together
first.  Every window of ``min_bytes`` bytes has an anchor: its run of ``GRAM`` bytes
with the least hash, the leftmost of equal ones, so equal windows have equal
anchors at equal places.  Consecutive windows of one anchor are a stretch, some
77 bytes apart.  What has an anchor that occurs once is settled.  Stretches that
are equal byte by byte are settled too, covered as they repeat each other, and one
of them goes on for all, so that copies in whatever number cost one stretch.  Only
where an anchor has several stretches that differ do their bytes meet in a task.

An anchor with more than ``FEW`` of them is split: into windows whose anchor lies
in their first and in their second half, each keyed by the longer run of bytes that
all of them contain.  The halves are halved again as long as a key has too many; in
the end a window is its own key, so no key stays hot and nothing is capped.

Windows are judged on the input, never cross texts, and overlap freely.  Nulls
are empty texts; texts shorter than ``min_bytes`` keep everything.  Repeated rows and
equal texts repeat each other, whatever their ids, and lose all bytes where they are
long enough.  Null ids stay.  An empty table has no rows; other columns are ignored,
whatever they are called.  128-bit hashes stand for equal texts and stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import Scratch, broadcast_if_small, text_or_empty
from symloom.llm.kernels import mix, powers, seeds, text_blocks
from symloom.llm.worker import lean

MIN_BYTES = 200
#: Bytes of an anchor.
GRAM = 48
#: Stretches of a key that may meet in a task.
FEW = 512
#: Bytes of stretches that are transformed together, unless one key has more.
TOGETHER = 1 << 20
#: Bytes of text that are hashed at a time.
_BLOCK = 2 << 20
_PLACE = 24
#: Rows of a batch that goes back to Spark.
_ROWS = 20_000

_BYTE = seeds(256, 12)
#: No byte of a UTF-8 text is 0xFF; texts are moved up by one, so that 0 ends the whole.
_GAP = 0xFF

#: ``shape`` packs the bytes of a stretch and the place of its anchor; ``reach`` is the bytes from it to the end of its last repetition, or 0.
_STRETCH = "anchor long, t1 long, t2 long, lo int, shape int, reach int, ctx long"
_CANDIDATE = "t1 long, t2 long, body binary, begins array<int>, ends array<int>, parts array<struct<key:bigint,lo:int,at:int,body:binary>>"
_SPAN = "t1 long, t2 long, lo int, hi int"


# The transform


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` (whose last entry is its only 0) in order of their first ``depth`` bytes at least."""
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(min(8, n)):
        key[: n - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    done = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        steps = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if done >= depth or steps[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = steps.astype(np.uint64)
        key = rank * np.uint64(n + 1)
        key[: n - done] += rank[done:] + np.uint64(1)
        done *= 2


def bounded_lcp(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of neighbours in ``order`` by increasing value; -1 where they have ``limit`` bytes or more."""
    n = len(text)
    before = text[order - 1]  # the transform: the byte before each suffix
    by_byte = np.argsort(before, kind="stable")
    to = np.empty(n, dtype=np.int64)
    to[by_byte] = np.arange(n)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    following, previous = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    lcp = np.full(n + 1, -1, dtype=np.int32)
    lcp[[0, n]] = 0
    left, right = np.array([0]), np.array([n - 1])
    for length in range(limit):
        sizes = right - left + 1
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) + np.repeat(left - ends + sizes, sizes)
        # The first and the last of each byte in an interval bound the interval of the longer string.
        first = np.sort(to[inside[previous[inside] < np.repeat(left, sizes)]])
        last = np.sort(to[inside[following[inside] > np.repeat(right, sizes)]])
        known = lcp[last + 1] >= 0
        left, right = first[~known], last[~known]
        lcp[right + 1] = length
        if not len(left):
            break
    return lcp[:n]


def repeated_starts(stretches: list[bytes], min_bytes: int) -> list[np.ndarray]:
    """For each stretch, where its strings of ``min_bytes`` begin that begin elsewhere too."""
    text = np.frombuffer(b"".join(b + bytes([_GAP - 1]) for b in stretches) + bytes([_GAP]), dtype=np.uint8) + np.uint8(1)
    order = suffix_order(text, min_bytes)
    far = np.flatnonzero(bounded_lcp(text, order, min_bytes) < 0)
    starts = np.unique(np.concatenate((order[far], order[far - 1])))
    begins = np.concatenate(([0], np.cumsum([len(b) + 1 for b in stretches])))
    owner = np.searchsorted(begins, starts, side="right") - 1
    whole = starts + min_bytes < begins[np.minimum(owner + 1, len(stretches))]  # what runs over a gap is no string of a text
    starts, owner = starts[whole], owner[whole]
    cuts = np.searchsorted(owner, np.arange(len(stretches) + 1))
    return [starts[a:b] - at for a, b, at in zip(cuts[:-1], cuts[1:], begins[:-1], strict=True)]


def joined_spans(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap, in order."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    return begins[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


# Anchors


def stretches_of(data: np.ndarray, offsets: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor hash, place of the anchor, hash of the bytes) of the stretches of a block of texts."""
    wide = min_bytes - gram + 1
    n = len(data)
    if n < min_bytes:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    power, inverse = powers(n + 1)
    upto = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=upto[1:])
    grams = mix((upto[gram:] - upto[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << _PLACE) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(grams) - wide + 1], least[wide - reach :])
    at = (least & low).astype(np.int64)  # the anchor of each window of the block
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - min_bytes + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    own = at[place]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(own)) - 1 if len(begin) else begin
    first, last, anchor = place[begin], place[end], own[begin]
    body = mix((upto[last + min_bytes] - upto[first]) * inverse[first] ^ np.uint64(min_bytes) * (last - first + 1).astype(np.uint64))
    return text[begin], first, last, grams[anchor], anchor, body


def repeated_runs(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, last): of neighbours that are equal in all columns, the first and the last are kept; for each row, the last of its neighbours."""
    n = len(same[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = np.any([c[1:] != c[:-1] for c in same], axis=0)
    begin = np.flatnonzero(new[:n])
    last = np.repeat(np.append(begin[1:], n) - 1, np.diff(np.append(begin, n)))
    return np.flatnonzero(new[:n] | new[1:]), last


def _segments(texts: pa.Array, min_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, byte of it, bytes, offsets); a text beyond the block is cut so that no window is lost or doubled."""
    for i, _, data, offsets in text_blocks(texts, _BLOCK):
        if len(data) <= 2 * _BLOCK:
            yield i, 0, data, offsets
            continue
        for at in range(0, max(len(data) - min_bytes + 1, 1), _BLOCK):
            piece = data[at : at + _BLOCK + min_bytes - 1]
            yield i, at, piece, np.array([0, len(piece)], dtype=np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchored(min_bytes: int, gram: int) -> Callable[[Iterator], Iterator]:
    """The stretches of (t1, t2, body).

    Where a text repeats a few bytes on and on, a stretch follows itself; of such a
    run the first and the last are given, and the first reaches to the end, so rows
    stay in proportion to bytes whatever the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            for i, shift, data, offsets in _segments(batch.column(2), min_bytes):
                text, first, last, anchor, at, body = stretches_of(data, offsets, min_bytes, gram)
                lo, size = first - offsets[text] + shift, last - first + min_bytes
                kept, end = repeated_runs(text, anchor, body, at - first, size)
                reach = np.where(end > np.arange(len(end)), last[end] - first + min_bytes, 0)
                for a in range(0, len(kept), _ROWS):
                    b = kept[a : a + _ROWS]
                    columns = [_signed(anchor[b]), pa.array(t1[i + text[b]]), pa.array(t2[i + text[b]]), pa.array(lo[b].astype(np.int32)), pa.array((size[b] * min_bytes + at[b] - first[b]).astype(np.int32)), pa.array(reach[b].astype(np.int32)), _signed(body[b])]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "t1", "t2", "lo", "shape", "reach", "ctx"])

    return lean(run)


def _cut(min_bytes: int) -> Callable[[Iterator], Iterator]:
    """Of each text, the covered spans and the bytes of its stretches that others of their anchor are held against."""
    part = pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("body", pa.binary())])
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("body", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("parts", pa.list_(part))])

    def one(body: bytes, entries: list[dict]) -> tuple:
        covered = [(e["lo"], e["lo"] + max(e["reach"], e["shape"] // min_bytes)) for e in entries if e["covered"]]
        begins, ends = joined_spans(*(np.array([c[k] for c in covered], dtype=np.int64) for k in (0, 1)))
        parts = [{"key": e["anchor"], "lo": e["lo"], "at": e["shape"] % min_bytes, "body": body[e["lo"] : e["lo"] + e["shape"] // min_bytes]} for e in entries if e["wanted"]]
        whole = len(begins) == 1 and begins[0] == 0 and ends[0] == len(body)
        return None if whole else body, begins.tolist(), ends.tolist(), parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for t1, t2, body, entries in zip(*(batch.column(k) for k in range(4)), strict=True):
                rows.append((t1.as_py(), t2.as_py(), *one(body.as_buffer().to_pybytes(), entries.as_py())))
                held += len(body.as_buffer())
                if held > _BLOCK:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    return lean(run)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SPANS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _expand(min_bytes: int, together: int) -> Callable[[Iterator], Iterator]:
    """Spans of repeated strings among the stretches of each key; rows come sorted by key."""

    def spans(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (_, t1, t2, lo, _), starts in zip(held, repeated_starts([h[4] for h in held], min_bytes), strict=True):
            begins, ends = joined_spans(starts, starts + min_bytes)
            rows += [(t1, t2, lo + a, lo + b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return _batch(rows, _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("key", "t1", "t2", "lo", "body")), strict=True):
                if size >= together and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(held)

    return lean(run)


def _halve(min_bytes: int) -> Callable[[Iterator], Iterator]:
    """Each stretch as up to two: windows with the anchor in the first and in the second half of [x, y).

    A window that begins d bytes before the anchor contains what lies from x bytes
    before it to ``min_bytes`` - y + 1 bytes behind it, for all d in [x, y).
    """
    schema = pa.schema([("key", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("body", pa.binary()), ("x", pa.int32()), ("y", pa.int32()), ("ctx", pa.int64())])

    def digest(*parts: bytes) -> int:
        return int.from_bytes(blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, t1, t2, lo, at, body, x, y in zip(*(batch.column(k).to_pylist() for k in ("key", "t1", "t2", "lo", "at", "body", "x", "y")), strict=True):
                middle = (x + y) // 2
                for a, b in ((x, middle), (middle, y)):
                    first, last = max(at - b + 1, 0), min(at - a, len(body) - min_bytes)  # windows of the stretch with d in [a, b)
                    if a >= b or first > last:
                        continue
                    core = body[at - a : at - b + 1 + min_bytes]
                    own = body[first : last + min_bytes]
                    rows.append((digest(key.to_bytes(8, "little", signed=True), a.to_bytes(4), b.to_bytes(4), core), t1, t2, lo + first, at - first, own, a, b, digest(b"own", own)))
            yield _batch(rows, schema)

    return lean(run)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept", pa.string())])
    for batch in batches:
        rows = []
        for t1, t2, body, begins, ends, found in zip(*(batch.column(k) for k in range(6)), strict=True):
            found = found.as_py() or []
            begin = np.array(begins.as_py() + [s["lo"] for s in found], dtype=np.int64)
            begin, end = joined_spans(begin, np.array(ends.as_py() + [s["hi"] for s in found], dtype=np.int64))
            data = body.as_buffer() if body.is_valid else b""  # null: covered from end to end
            kept = sha256()
            if body.is_valid:
                for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True):
                    kept.update(memoryview(data)[a:b])
            rows.append((t1.as_py(), t2.as_py(), int((end - begin).sum()), len(begin), kept.hexdigest()))
        yield _batch(rows, schema)


def _settled_halves(pending: DataFrame, scratch: Scratch, min_bytes: int, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """Halve keys of more than ``few`` stretches until none is left: (stretches to hold against each other, spans found on the way)."""
    cool: list[DataFrame] = []
    spans: list[DataFrame] = []
    while True:
        hot = scratch.write(pending.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("key"), "suffix-hot")
        n = hot.count()
        if not n:
            cool.append(pending)
            break
        keys = broadcast_if_small(hot, n, 16)
        cool.append(pending.join(keys, "key", "left_anti"))
        halves = scratch.write(pending.join(keys, "key", "left_semi").mapInArrow(_halve(min_bytes), "key long, t1 long, t2 long, lo int, at int, body binary, x int, y int, ctx long"), "suffix-halves")
        same = halves.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "lo")).alias("rep"))
        kinds = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
        told = halves.join(same, ["key", "ctx"]).join(kinds, "key")
        told = scratch.write(told.withColumn("chosen", F.struct("t1", "t2", "lo") == F.col("rep")), "suffix-told")
        spans.append(told.where("n > 1").select("t1", "t2", "lo", (F.col("lo") + F.octet_length("body")).alias("hi")))
        pending = scratch.write(told.where("chosen AND kinds > 1").select("key", "t1", "t2", "lo", "at", "body", "x", "y"), "suffix-pending")
    return reduce(DataFrame.unionByName, cool), spans


def repeated_spans(docs: DataFrame, text_col: str = "text", min_bytes: int = MIN_BYTES, gram: int = GRAM, few: int = FEW, together: int = TOGETHER) -> DataFrame:
    """(t1, t2, removed, spans, kept) of every text that holds repeated strings; see ``text_key``."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(*text_key(text_col), text_or_empty(text_col).alias("body")).where(F.octet_length("body") >= min_bytes)
    found = scratch.write(texts.mapInArrow(_anchored(min_bytes, gram), _STRETCH), "suffix-stretches")
    # Counts are written before they are joined: the exchanges of a join of written tables can be split where a key is hot.
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("ctx") == F.max("ctx")).alias("same")).where("n > 1").select("anchor", "same")
    twice = scratch.write(twice, "suffix-twice")
    shared = scratch.write(found.join(twice, "anchor"), "suffix-shared")
    scratch.drop(found, twice)
    mixed = shared.where("NOT same")
    kinds = mixed.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "lo")).alias("rep"))
    kinds = scratch.write(kinds, "suffix-kinds")
    told = mixed.join(kinds, ["anchor", "ctx"]).select("anchor", "t1", "t2", "lo", "shape", "reach", (F.col("n") > 1).alias("covered"), (F.struct("t1", "t2", "lo") == F.col("rep")).alias("wanted"))
    told = told.unionByName(shared.where("same").select("anchor", "t1", "t2", "lo", "shape", "reach", F.lit(True).alias("covered"), F.lit(False).alias("wanted")))
    by_text = told.where("covered OR wanted").groupBy("t1", "t2").agg(F.collect_set(F.struct("anchor", "lo", "shape", "reach", "covered", "wanted")).alias("entries"))
    one = texts.groupBy("t1", "t2").agg(F.first("body").alias("body"))  # copies are one text before the shuffle
    touched = one.join(by_text, ["t1", "t2"]).select("t1", "t2", F.col("body").cast("binary").alias("body"), "entries")
    candidates = scratch.write(touched.mapInArrow(_cut(min_bytes), _CANDIDATE), "suffix-candidates")
    scratch.drop(shared, kinds)
    pending = candidates.select("t1", "t2", F.explode("parts").alias("p")).select("p.key", "t1", "t2", "p.lo", "p.at", "p.body", F.lit(0).alias("x"), F.lit(min_bytes - gram + 1).alias("y"))
    cool, spans = _settled_halves(pending, scratch, min_bytes, few)
    met = cool.select("key", "t1", "t2", "lo", "body").repartition("key").sortWithinPartitions("key")
    spans.append(met.mapInArrow(_expand(min_bytes, together), _SPAN))
    more = reduce(DataFrame.unionByName, spans).groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    final = candidates.select("t1", "t2", "body", "begins", "ends").join(more, ["t1", "t2"], "left").where("size(begins) > 0 OR found IS NOT NULL")
    return scratch.write(final.mapInArrow(lean(_finish), "t1 long, t2 long, removed long, spans long, kept string"), "suffix-kept")


def text_key(text_col: str) -> list:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text_or_empty(text_col)).alias("t1"), F.xxhash64(F.lit("text"), text_or_empty(text_col)).alias("t2")]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, gram: int = GRAM, few: int = FEW, together: int = TOGETHER) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    kept = repeated_spans(docs, text_col, min_bytes, gram, few, together)
    body = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *text_key(text_col), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(kept, ["t1", "t2"], "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("removed", none).alias("n_removed"),
        F.coalesce("spans", none).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"),
    )
