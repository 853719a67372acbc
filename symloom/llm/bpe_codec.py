"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent words of the corpus are encoded once and compiled into a
minimal acyclic automaton (words share prefixes and suffixes).  Its edges carry
counts whose sum along a path is the word's number, which leads to the ids.
The automaton is one flat file of integers that every worker maps into memory;
words that it lacks are merged exactly, in n log n steps for n bytes.  Its size is
bounded by ``LEXICON_WORDS`` words of ``LEXICON_BYTES`` bytes and affects speed only;
its words are merged in the tasks.

Null or empty texts have no ids and decode to an empty text; repeated rows are
encoded one by one; an empty table gives an empty result and extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import written
from symloom.llm.token_counts import share_vocabulary
from symloom.llm.wordbpe import MEMO_BYTES, MEMO_WORDS, Memo, WordBpe, digest
from symloom.llm.worker import held, lean, rows_of

#: The most frequent words of the whole corpus that the lexicon holds, and the bytes that they have at most.
LEXICON_WORDS, LEXICON_BYTES = 50_000, 64
#: Distinct words that a task counts before it hands them on.
_COUNTED_AT_ONCE = 400_000
#: Counts up to this one are told apart, larger ones by a logarithmic scale, so that levels are few.
_FINE = 1000


def _minimal(words: Iterable[bytes]) -> tuple[list[list[tuple[int, int]]], list[int], int]:
    """States (edges, finality) of the minimal automaton of sorted distinct words, and the start."""
    edges: list[list[tuple[int, int]]] = []
    final: list[int] = []
    known: dict[tuple, int] = {}

    def settle(node: list) -> int:
        key = (node[1], *node[0])
        if key not in known:
            known[key] = len(edges)
            edges.append(list(node[0]))
            final.append(node[1])
        return known[key]

    path: list[list] = [[[], 0, -1]]  # settled edges, finality, label that leads here
    before = b""
    for word in words:
        shared = len(os.path.commonprefix([before, word]))
        while len(path) - 1 > shared:
            done = path.pop()
            path[-1][0].append((done[2], settle(done)))
        path.extend([[], 0, label] for label in word[shared:])
        path[-1][1] = 1
        before = word
    while len(path) > 1:
        done = path.pop()
        path[-1][0].append((done[2], settle(done)))
    return edges, final, settle(path[0])


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The transducer of word -> ids as one array of 32-bit integers."""
    coded = sorted((w.encode("utf-8"), ids) for w, ids in entries.items() if w)
    edges, final, start = _minimal(w for w, _ in coded)
    below = [0] * len(edges)
    for s in range(len(edges)):  # targets are settled before their sources
        below[s] = final[s] + sum(below[t] for _, t in edges[s])
    first, label, target, out = [0], [], [], []
    for s, own in enumerate(edges):
        skipped = final[s]
        for byte, t in own:
            label.append(byte)
            target.append(t)
            out.append(skipped)
            skipped += below[t]
        first.append(len(label))
    id_first, ids = [0], []
    for _, own in coded:
        ids.extend(own)
        id_first.append(len(ids))
    head = [len(edges), len(label), len(coded), len(ids), start]
    return array("i", [*head, *first, *label, *target, *out, *final, *id_first, *ids]).tobytes()


class Lexicon:
    """A compiled transducer over any buffer of 32-bit integers, such as a memory map."""

    def __init__(self, buffer):
        data = memoryview(buffer).cast("B").cast("i")
        states, n_edges, words, n_ids, self.start = data[:5]
        at = 5
        parts = []
        for n in (states + 1, n_edges, n_edges, n_edges, states, words + 1, n_ids):
            parts.append(data[at : at + n])
            at += n
        self.first, self.label, self.target, self.out, self.final, self.id_first, self.ids = parts

    def get(self, word: str) -> list[int] | None:
        state, number = self.start, 0
        first, label = self.first, self.label
        for byte in word.encode("utf-8", "replace"):
            low, high = first[state], first[state + 1]
            at = bisect_left(label, byte, low, high)
            if at == high or label[at] != byte:
                return None
            number += self.out[at]
            state = self.target[at]
        if not self.final[state]:
            return None
        return self.ids[self.id_first[number] : self.id_first[number + 1]].tolist()


class Codec:
    """Encodes and decodes whole texts; words come from the lexicon or are merged."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None = None):
        self.bpe, self.lexicon = bpe, lexicon
        self._coded = Memo(self._code, MEMO_WORDS)
        self._shown: dict[str, str] = {}
        self._bytes = 0

    def _code(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian unsigned 32-bit integers; the memo of their pieces follows."""
        if len(self._shown) > MEMO_WORDS or self._bytes > MEMO_BYTES:
            self._shown.clear()
            self._bytes = 0
        self._bytes += sum(map(len, words))
        out: list = [None] * len(words)
        unseen = []
        for k, word in enumerate(words):
            ids = self.lexicon.get(word) if self.lexicon is not None and word not in self.bpe.special else None
            if ids is None:
                unseen.append(k)
            else:
                out[k] = ids
        for k, ids in zip(unseen, self.bpe.merge_many([words[k] for k in unseen]), strict=True):
            out[k] = ids.tolist()
        piece = self.bpe.piece.__getitem__
        for word, ids in zip(words, out, strict=True):
            self._shown[word] = " ".join(map(piece, ids))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in out]

    def learn(self, words: list[str]) -> None:
        """Look up or merge what is new among the words of a block of texts."""
        if any(w not in self._shown for w in words):
            if len(self._shown) > MEMO_WORDS or self._bytes > MEMO_BYTES:
                self._coded.clear()
            self._coded.learn(words)

    def encode_bytes(self, words: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``learn`` has seen the words."""
        return b"".join(map(self._coded.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        words = self.bpe.split(text)
        self.learn(words)
        return np.frombuffer(self.encode_bytes(words), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined by a space: the vocabulary names no decoder of its own."""
        return " ".join(self.bpe.piece[int(i)] for i in ids if int(i) in self.bpe.piece)

    def decode_words(self, words: list[str]) -> str:
        """``decode`` of the ids of ``words``, a word at a time."""
        return " ".join(map(self._shown.__getitem__, words))


def _count_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = held(f"words {digest(shared.value)}", lambda: WordBpe(shared.value)).split, Counter()
        for _, texts in rows_of(batches):
            for text in texts:
                counts.update(split(text))
            if len(counts) > _COUNTED_AT_ONCE:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """(word) of the most frequent words of all texts, at most ``size``: all above the count that this allows.

    The driver gets how many words have each count.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    counted = rows.mapInArrow(lean(_count_words(share_vocabulary(docs, vocabulary))), "word string, n long")
    short = counted.where(F.octet_length("word") <= LEXICON_BYTES)
    counted = written(short.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    level = F.least(F.col("n"), F.lit(_FINE) + F.floor(F.log2(F.col("n")) * 64)).cast("long")
    left, above = size, None
    for row in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).toLocalIterator():
        left -= row.words
        if left < 0:
            break
        above = row.level
    return counted.where(F.lit(False) if above is None else level >= above).select("word")


def _merge_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(f"words {digest(shared.value)}", lambda: WordBpe(shared.value))
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w not in bpe.special]
            ids = pa.array([m.astype(np.int32) for m in bpe.merge_many(words)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), ids], names=["word", "ids"])

    return run


def build_lexicon(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    words = frequent_words(docs, vocabulary, id_col, text_col, size)
    merged = words.mapInArrow(lean(_merge_words(share_vocabulary(docs, vocabulary))), "word string, ids array<int>")
    return compile_lexicon({r.word: r.ids for r in merged.toLocalIterator()})


def share_lexicon(docs: DataFrame, compiled: bytes) -> str:
    """Hand the compiled file to every executor, also to those that come later; its name there.

    Equal lexicons are handed out once for each context.
    """
    name = f"symloom-lexicon-{hashlib.sha256(compiled).hexdigest()[:16]}.bin"
    sc = docs.sparkSession.sparkContext
    shared = sc.__dict__.setdefault("_symloom_lexicons", set())
    if name in shared:
        return name
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as file:
        file.write(compiled)
    sc.addFile(path)
    shared.add(name)
    return name


def _codec(raw: str, name: str) -> Codec:
    return held(f"codec {digest(raw)} {name}", lambda: Codec(WordBpe(raw), Lexicon(np.memmap(SparkFiles.get(name), dtype="<i4", mode="r"))))


def _encode(shared, name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, name)
        for ids, texts in rows_of(batches):
            rows = []
            split = list(map(codec.bpe.split, texts))
            codec.learn(list(chain.from_iterable(split)))
            for words in split:
                coded, decoded = codec.encode_bytes(words), codec.decode_words(words)
                if with_ids:
                    rows.append((len(coded) // 4, np.frombuffer(coded, dtype="<u4").astype(np.int32), decoded))
                else:
                    rows.append((len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            kind, names = (pa.list_(pa.int32()), ["ids", "decoded"]) if with_ids else (pa.string(), ["ids_sha256", "decoded_sha256"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, kind), pa.array(b, pa.string())], names=["id", "n_tokens", *names])

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None, digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row, or SHA-256 digests of ids and decoded text.

    ``lexicon``: a compiled one; without it, it is built from ``docs``.
    """
    compiled = lexicon if lexicon is not None else build_lexicon(docs, vocabulary, id_col, text_col)
    name = share_lexicon(docs, compiled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, n_tokens long, ids array<int>, decoded string"
    out = rows.mapInArrow(lean(_encode(share_vocabulary(docs, vocabulary), name, not digests)), kinds)
    return out.withColumnRenamed("id", id_col)
