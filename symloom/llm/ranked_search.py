"""Ranked lexical search by impact-ordered postings, score at a time.

The queries are taken in blocks of a bounded number of terms, each against all
documents.  One pass over the texts keeps, for each document, its length in terms
and how often it holds the terms asked for; counts of that give the statistics of
the whole corpus and with them the impact of every posting: the exact part of a
score that it is worth.

Every task then turns its documents into shards of bounded size.  In a shard the
postings of a term lie in falling order of impact, grouped by exact impact.  A
query takes whole groups off the fronts of its terms' lists, highest impacts
first, and adds them to the documents' sums.  What is left of a list is worth at
most its next impact, so a document can at most reach its sum plus the next
impacts of all lists.  Only when that proves all but a few documents to stay
below the k-th best sum does the query stop; the sums of those few are completed
from their own terms.  The best k of the shards are ranked once more.

Terms are the runs of digits, letters and characters beyond ASCII, with A-Z
lower-cased; a 64-bit hash and the length stand for a term.

Null and empty texts hold no term; queries without terms have no results.  Equal
scores go by ascending id, null ids behind all others; repeated rows are
documents of their own.  Queries are rows: a repeated row of one id and text
counts once, other texts of one id are queries of their own.  Empty tables have no
results.  Columns that are not named are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.llm.common import written
from symloom.llm.kernels import LOWER, Words, text_blocks
from symloom.llm.worker import lean

#: Terms of the queries that are answered in one pass over the documents.
BLOCK_TERMS = 50_000
#: Postings and documents of a shard, unless one document has more.
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 15
#: A query stops when so many documents besides the best k can still be among them.
OPEN = 64

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_A_TO_Z = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True

_FORWARD = "id long, n long, terms array<int>, tfs array<int>"
_BEST = "query int, id long, score long"


def terms_of(text: str | None) -> list[str]:
    return [t.decode() for t in _TERM.findall((text or "").encode().translate(_A_TO_Z))]


class TermTable:
    """Numbers of a block's terms, found by hash and length."""

    def __init__(self, terms: list[str]):
        data = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
        words = _split(data, np.array([0, len(data)], dtype=np.int64))
        order = np.argsort(words.hashes, kind="stable")
        self.hashes, self.lengths, self.numbers = words.hashes[order], (words.end - words.begin)[order], order.astype(np.int32)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places of words that are terms of the block, their numbers)."""
        if not len(self.hashes) or not len(words.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == words.hashes) & (self.lengths[at] == words.end - words.begin))
        return hit, self.numbers[at[hit]]


def _split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The terms of a block of texts: whatever parts them becomes a space, A-Z are lower-cased."""
    return Words(np.where(_BREAK[data], np.uint8(0x20), LOWER[data]), offsets, lower=False)


def _forward(terms: list[str]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(terms)
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1)):
                words = _split(data, offsets)
                hit, numbers = table.find(words)
                doc = np.searchsorted(words.first, hit, side="right") - 1
                pairs, tfs = np.unique(doc.astype(np.int64) << 32 | numbers, return_counts=True)
                ends = np.searchsorted(pairs >> 32, np.arange(j - i + 1)).astype(np.int32)
                columns = [batch.column(0).slice(i, j - i), pa.array(words.counts().astype(np.int64)), *[pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, tfs)]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])

    return lean(run)


@dataclass
class Corpus:
    """Statistics of the whole corpus and of a block's terms."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """What a posting adds to a score; ``n`` is the length of its document."""
        m = 10 + 90 * n * self.documents // max(self.length, 1)
        return self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Impact-ordered postings of some documents.

    ``docs`` and ``impacts`` are sorted by term and falling impact; those of term t
    are ``first[t]:first[t + 1]``.  ``own``, ``own_impacts`` and ``own_first`` hold
    the same postings by document.  ``touched`` counts the postings taken off.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, corpus: Corpus):
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.ids, self.own = ids, terms
        self.own_impacts = corpus.impacts(n.astype(np.int64)[doc], terms, tfs.astype(np.int64))
        self.own_first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        order = np.lexsort((-self.own_impacts, terms))
        self.docs, self.impacts = doc[order], self.own_impacts[order]
        self._falling = -self.impacts
        self.first = np.searchsorted(terms[order], np.arange(len(corpus.weights) + 1))
        self.touched = 0

    def best(self, query: np.ndarray, k: int, open_docs: int = OPEN) -> list[tuple[int, int]]:
        """(document of the shard, score) of the best ``k``, ties by id; and more where they are needed to tell."""
        lists = [[int(a), int(b)] for a, b in zip(self.first[query], self.first[query + 1], strict=True) if a < b and self.impacts[a] > 0]
        sums = np.zeros(len(self.ids), dtype=np.int64)
        level = max((int(self.impacts[a]) for a, _ in lists), default=0)
        some = np.zeros(0, dtype=np.int64)
        while lists:
            level //= 2
            for part in lists:
                end = part[0] + int(np.searchsorted(self._falling[part[0] : part[1]], -level, side="left"))  # whole groups above the level
                sums[self.docs[part[0] : end]] += self.impacts[part[0] : end]
                self.touched += end - part[0]
                part[0] = end
            lists = [p for p in lists if p[0] < p[1] and self.impacts[p[0]] > 0]
            rest = sum(int(self.impacts[a]) for a, _ in lists)
            kth = int(np.partition(sums, -k)[-k]) if len(sums) > k else 0
            if rest >= kth and lists:
                continue
            some = np.flatnonzero((sums + rest >= kth) & (sums > 0))
            if len(some) <= k + open_docs:
                break
        return self._complete(some, query, k) if len(some) else []

    def _complete(self, docs: np.ndarray, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        wanted = np.zeros(len(self.first) - 1, dtype=bool)
        wanted[query] = True
        scores = []
        for d in docs.tolist():
            a, b = self.own_first[d], self.own_first[d + 1]
            scores.append(int(self.own_impacts[a:b][wanted[self.own[a:b]]].sum()))
        ranked = sorted((-s, self.ids[d] is None, self.ids[d] or 0, d) for s, d in zip(scores, docs.tolist(), strict=True) if s > 0)
        return [(d, -s) for s, _, _, d in ranked[:k]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of forward lists gathered into shards of bounded size."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        ends = batch.column("terms").offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            last = first
            while last < batch.num_rows and (last == first or (docs + last - first < SHARD_DOCS and postings + ends[last + 1] - ends[first] <= SHARD_POSTINGS)):
                last += 1
            held.append(batch.slice(first, last - first))
            docs, postings, first = docs + last - first, postings + int(ends[last] - ends[first]), last
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS or first < batch.num_rows:
                yield _arrays(held)
                held, docs, postings = [], 0, 0
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    tfs = table.column("tfs").combine_chunks()
    return np.array(table.column("id").to_pylist(), dtype=object), table.column("n").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), tfs.flatten().to_numpy()


def _search(queries: list[np.ndarray], corpus: Corpus, k: int) -> Callable[[Iterator], Iterator]:
    schema = pa.schema([("query", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in _shards(batches):
            shard = Shard(*arrays, corpus)
            rows = [(q, shard.ids[d], score) for q, query in enumerate(queries) for d, score in shard.best(query, k)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return lean(run)


def _blocks(items: DataFrame, item_id: str, item_text: str, block_terms: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The queries (id, distinct terms) in blocks of at most ``block_terms`` terms, unless one has more."""
    block, held = [], 0
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("body")).dropDuplicates()
    for row in rows.toLocalIterator():
        terms = sorted(set(terms_of(row.body)))
        if not terms:
            continue
        if block and held + len(terms) > block_terms:
            yield block
            block, held = [], 0
        block.append((row.item, terms))
        held += len(terms)
    if block:
        yield block


def _answer(rows: DataFrame, block: list[tuple[int | None, list[str]]], k: int, item_id: str, id_col: str) -> DataFrame:
    spark = rows.sparkSession
    terms = sorted({t for _, own in block for t in own})
    number = {t: i for i, t in enumerate(terms)}
    forward = written(rows.mapInArrow(_forward(terms), _FORWARD), "search-forward")
    whole = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = {r.term: r.df for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each term of the block
    corpus = Corpus(whole.documents, whole.length, np.array([weight(whole.documents, df.get(i, 0)) for i in range(len(terms))], dtype=np.int64))
    queries = [np.array(sorted(number[t] for t in own), dtype=np.int64) for _, own in block]
    found = forward.where(F.size("terms") > 0).mapInArrow(_search(queries, corpus, k), _BEST)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, `{item_id}` long")
    return best.join(F.broadcast(names), "query").select(item_id, "rank", F.col("id").alias(id_col), "score")  # a row for each query of the block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item id, rank, id, score) of the best ``k`` documents with a score above 0 for each query."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    found: DataFrame | None = None
    for block in _blocks(items, item_id, item_text, block_terms):
        answer = _answer(rows, block, k, item_id, id_col)
        found = answer if found is None else found.unionByName(answer)
    return docs.sparkSession.createDataFrame([], f"`{item_id}` long, rank int, `{id_col}` long, score long") if found is None else found
