"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the hash of a position takes the
words under the mask's ones and ignores the others, so it survives
substitutions there.  Hashes of test items and of training texts are joined;
each hit names a diagonal of a text and an item, along which the overlap is
verified: its longest stretch with at least ``percent`` % equal words must
have ``min_words`` words, or all words of a shorter item.

Where the items have at most ``BROADCAST_WORDS`` words, their seeds are
broadcast as sorted arrays and every task joins on its own.  Beyond that a
bitmap of their hashes, whose size is fixed, is broadcast, and only the seeds of
texts that it lets through are joined by a shuffle.  Rows are told apart by
hashes of id and text, so both ways give the same rows.

Words are compared in lower case without ASCII punctuation.  Items of fewer
than 5 words (and null items) match nothing.  An item that lies in a text as a
whole is held against ``percent`` as a whole, whatever its length.  Null or
empty texts overlap with nothing; repeated rows and repeated items each give
their rows, also under one id; rows and items with a null id are reported with
it; an empty table gives an empty result and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import broadcast_if_small, written
from symloom.llm.kernels import Words, mix, plain, seeds, stretches, text_blocks
from symloom.llm.worker import lean

# The masks, each of weight 5.  A substitution in every third or
# every fifth word leaves one of them whole.
MASKS = ("11111", "111101", "1101101", "11100011")
SEED_WORDS = 5
MIN_WORDS = 13
PERCENT = 80
#: Words of all items together up to which their seeds are broadcast (about 100 bytes a word).
BROADCAST_WORDS = 200_000

#: Bits of a hash by which the bitmap of the items' seeds is addressed (4 MB).
_BITS = 22
_HITS = "id long, item_id long, begin_word long, end_word long, n_matched long, item_words long"


def _seeds_of(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: hash, text number and word position in the text, of every place it fits."""
    last = words.first[1:]
    owner = np.repeat(np.arange(words.n), words.counts())
    for m, mask in enumerate(MASKS):
        span = len(mask)
        n = len(words.hashes) - span + 1
        if n <= 0:
            continue
        value = np.zeros(n, dtype=np.uint64)
        ones = [i for i, c in enumerate(mask) if c == "1"]
        for i, a in zip(ones, seeds(len(ones), 40 + m), strict=True):
            value += words.hashes[i : n + i] * a
        at = np.flatnonzero(np.arange(n) + span <= last[owner[:n]])
        yield mix(value[at]), owner[at], at - words.first[owner[at]]


@dataclass
class Items:
    """Test items and their seeds in sorted arrays."""

    ids: list[int]
    words: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        data, offsets = _joined(texts)
        words = Words(data, offsets)
        found = list(_seeds_of(words))
        hashes, item, place = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(3))
        order = np.argsort(hashes, kind="stable")
        own = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        return cls(ids, own, hashes[order], item[order], place[order])

    def maybe(self) -> np.ndarray:
        """A bitmap over ``_BITS`` bits of the hashes."""
        bitmap = np.zeros(1 << _BITS, dtype=bool)
        bitmap[_cell(self.hashes)] = True
        return bitmap


def _cell(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _BITS)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    for _, _, data, offsets in text_blocks(pa.array([t or "" for t in texts], pa.large_string()), 1 << 62):
        return plain(data, offsets)
    return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)


def overlap(text: np.ndarray, item: np.ndarray, diagonal: int, min_words: int, percent: int) -> tuple[int, int, int] | None:
    """(begin, end, equal words) of the longest good stretch on a diagonal, in words of the text."""
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if high <= low:
        return None
    equal = text[low + diagonal : high + diagonal] == item[low:high]
    if len(item) >= SEED_WORDS and len(equal) == len(item) and 100 * equal.sum() >= percent * len(item):
        return diagonal, diagonal + len(item), int(equal.sum())
    runs = stretches(equal, 100 - percent, percent)
    if not runs:
        return None
    a, b = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    if b - a < max(SEED_WORDS, min(min_words, len(item))):
        return None
    return low + diagonal + a, low + diagonal + b, int(equal[a:b].sum())


def _best(rows: list[tuple]) -> list[tuple]:
    """The overlap of each (text, item) with most equal words, the first of equal ones."""
    best: dict[tuple, tuple] = {}
    for key, found in rows:
        if key not in best or (found[2], -found[0]) > (best[key][2], -best[key][0]):
            best[key] = found
    return [(*key, *found) for key, found in best.items()]


def _matches(items: Items, maybe: np.ndarray, words: Words, min_words: int, percent: int) -> list[tuple]:
    """(text number, item number, begin, end, equal words): the longest overlap of each text of a block and item."""
    tried, rows = set(), []
    for hashes, owner, place in _seeds_of(words):
        at = np.flatnonzero(maybe[_cell(hashes)])
        low, high = (np.searchsorted(items.hashes, hashes[at], side=s) for s in ("left", "right"))
        for k, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
            for s in range(a, b):
                tried.add((int(owner[k]), int(items.item[s]), int(place[k] - items.place[s])))
    for text, item, diagonal in tried:
        own = words.hashes[words.first[text] : words.first[text + 1]]
        if found := overlap(own, items.words[item], diagonal, min_words, percent):
            rows.append(((text, item), found))
    return _best(rows)


def _scan(shared, min_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        maybe = items.maybe()
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1)):
                ids = batch.column(0).slice(i, j - i).to_pylist()
                found = _matches(items, maybe, Words(*plain(data, offsets)), min_words, percent)
                yield _hits([(ids[t], items.ids[m], a, b, n, len(items.words[m])) for t, m, a, b, n in found])

    return run


def _clean(shared, min_words: int, percent: int):
    """Whether each text overlaps with no item."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items: Items = shared.value
        maybe = items.maybe()
        for column in columns:
            clean = np.ones(len(column), dtype=bool)
            for i, _, data, offsets in text_blocks(column):
                clean[[i + row[0] for row in _matches(items, maybe, Words(*plain(data, offsets)), min_words, percent)]] = False
            yield pa.array(clean)

    return run


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 6
    names = ["id", "item_id", "begin_word", "end_word", "n_matched", "item_words"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _emit(maybe):
    """(hash, r1, r2, place) of the seeds of texts (r1, r2, body); with a broadcast bitmap, of those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if maybe is None else np.unpackbits(np.frombuffer(maybe.value, dtype=np.uint8)).astype(bool)
        for batch in batches:
            one, two = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, _, data, offsets in text_blocks(batch.column(2)):
                for hashes, owner, place in _seeds_of(Words(*plain(data, offsets))):
                    if bitmap is not None:
                        at = bitmap[_cell(hashes)]
                        hashes, owner, place = hashes[at], owner[at], place[at]
                    columns = [hashes.view(np.int64), one[i + owner], two[i + owner], place]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "r1", "r2", "place"])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = np.unique(_cell(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])


def _verify(min_words: int, percent: int):
    """Overlaps of (r1, r2, t1, t2, diagonal, body, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            rows = []
            for key, text, item in zip(keys, batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                words = Words(*_joined([text, item]))
                own, other = words.hashes[: words.first[1]], words.hashes[words.first[1] :]
                if found := overlap(own, other, key[4], min_words, percent):
                    rows.append((*key[:4], *found, len(other)))
            columns = zip(*rows, strict=True) if rows else [()] * 8
            names = ["r1", "r2", "t1", "t2", "begin_word", "end_word", "n_matched", "item_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _keyed(rows: DataFrame, key: Column, text: Column, one: str, two: str) -> DataFrame:
    """(one, two, key, body): 128 bits of hash tell rows of other key or text apart."""
    key, text = key.cast("long"), text.cast("string")
    parts = [key.isNull(), F.coalesce(key, F.lit(0)), text]
    return rows.select(F.xxhash64(*parts).alias(one), F.xxhash64(F.lit("row"), *parts).alias(two), key.alias("key"), text.alias("body"))


def _is_small(tests: DataFrame, broadcast_words: int) -> bool:
    size = tests.agg(F.sum(F.size(F.split("item", r"\s+")))).first()[0] or 0
    return size <= broadcast_words


def _shared_items(tests: DataFrame):
    rows = sorted(tests.collect(), key=lambda r: (r.item_id is None, r.item_id, r.item))
    return tests.sparkSession.sparkContext.broadcast(Items.of([r.item_id for r in rows], [r.item for r in rows]))


def _shared_bitmap(seeds_of_items: DataFrame):
    """The items' bitmap, whose size does not grow with them."""
    bitmap = np.zeros(1 << _BITS, dtype=bool)
    for row in seeds_of_items.select("hash").mapInArrow(lean(_cells), "cell long").distinct().toLocalIterator():
        bitmap[row.cell] = True
    return seeds_of_items.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())


def _tests(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item is not null")


def _by_shuffle(texts: DataFrame, tests: DataFrame, min_words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlaps (r1, r2, t1, t2, ...), the rows with hits (r1, r2, key, body) and the items (t1, t2, key, body); copies once."""
    seed = "hash long, r1 long, r2 long, place long"
    items = written(_keyed(tests, F.col("item_id"), F.col("item"), "t1", "t2"), "items")
    theirs = written(items.select("t1", "t2", "body").distinct().mapInArrow(lean(_emit(None)), seed).toDF("hash", "t1", "t2", "item_place"), "item-seeds")
    mine = texts.select("r1", "r2", "body").mapInArrow(lean(_emit(_shared_bitmap(theirs))), seed)
    tried = mine.join(theirs, "hash").select("r1", "r2", "t1", "t2", (F.col("place") - F.col("item_place")).alias("diagonal"))
    tried = written(tried.distinct(), "seed-hits")
    ids = written(tried.select("r1", "r2").distinct(), "hit-rows")
    hit = written(texts.join(broadcast_if_small(ids, ids.count(), 24), ["r1", "r2"], "left_semi"), "hit-texts")
    once = hit.select("r1", "r2", "body").dropDuplicates(["r1", "r2"])
    both = tried.join(once, ["r1", "r2"]).join(items.select("t1", "t2", F.col("body").alias("item")).dropDuplicates(["t1", "t2"]), ["t1", "t2"])
    found = both.select("r1", "r2", "t1", "t2", "diagonal", "body", "item").mapInArrow(lean(_verify(min_words, percent)), "r1 long, r2 long, t1 long, t2 long, begin_word long, end_word long, n_matched long, item_words long")
    best = F.max_by(F.struct("begin_word", "end_word", "n_matched", "item_words"), F.struct("n_matched", -F.col("begin_word")))
    return found.groupBy("r1", "r2", "t1", "t2").agg(best.alias("x")), hit, items


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, item_id, begin_word, end_word, n_matched, item_words): the overlap of each text and item with most equal words."""
    tests = _tests(items, item_col, item_text_col)
    if _is_small(tests, broadcast_words):
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
        return texts.mapInArrow(lean(_scan(_shared_items(tests), min_words, percent)), _HITS).withColumnRenamed("id", id_col)
    texts = _keyed(docs, F.col(id_col), F.col(text_col), "r1", "r2")
    best, hit, known = _by_shuffle(texts, tests, min_words, percent)
    # Every copy of a row and of an item gives its row.
    out = best.join(hit.select("r1", "r2", F.col("key").alias(id_col)), ["r1", "r2"]).join(known.select("t1", "t2", F.col("key").alias("item_id")), ["t1", "t2"])
    return out.select(id_col, "item_id", "x.*")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item, whatever their id; columns stay as they are."""
    tests = _tests(items, item_col, item_text_col)
    if _is_small(tests, broadcast_words):
        clean = lean(_clean(_shared_items(tests), min_words, percent))
        clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return docs.where(F.arrow_udf(clean, "boolean")(F.col(text_col).cast("string")))
    texts = _keyed(docs, F.col(id_col), F.col(text_col), "r1", "r2")
    hit = written(_by_shuffle(texts, tests, min_words, percent)[0].select("r1", "r2").distinct(), "contaminated").toDF("__r1", "__r2")
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    parts = [key.isNull(), F.coalesce(key, F.lit(0)), text]
    same = (F.xxhash64(*parts) == F.col("__r1")) & (F.xxhash64(F.lit("row"), *parts) == F.col("__r2"))
    return docs.join(broadcast_if_small(hit, hit.count(), 24), same, "left_anti")
