"""Token counts by prefix dynamic programming.

For each prefix of a word the table holds the last token of the prefix's
encoding and its length in tokens.  The last token at position i is the one
vocabulary entry t that ends there and may follow the last token of the prefix
before it: "may follow" means that no merge would have taken symbols on both
sides of their boundary before they were finished, which the two tokens' merge
histories decide.  Exactly one entry qualifies, so the table is exact without
running the merges.  Summed over words this gives the exact token count at
every prefix of a text, and questions of truncation or budget are look-ups.

Null or empty texts have 0 tokens; repeated rows are counted one by one; an
empty table gives an empty result and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.kernels import BASE, powers
from symloom.llm.wordbpe import Memo, WordBpe, digest
from symloom.llm.worker import held, lean, rows_of

#: The budget in tokens that ``over_limit`` and ``fit_words`` speak of.
LIMIT = 2048

_NEVER = 1 << 40
#: Mixed into the hash of entries that end a word.
_ENDS = 0x5851F42D4C957F2D
#: Longer words (in bytes) are counted one by one.
_WIDE = 64


class PrefixTable:
    """Exact token counts of prefixes under a word-level BPE vocabulary."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.longest = max(map(len, bpe.vocab))
        halves = {made: (a, b, k) for ((a, b), k), made in zip(bpe.rank.items(), bpe.made, strict=True)}
        self._right, self._left = {}, {}
        for token in bpe.vocab.values():
            self._right[token] = self._spine(token, halves, 1)
            self._left[token] = self._spine(token, halves, 0)
        self._follows: dict[tuple[int, int], bool] = {}
        self._index()

    @staticmethod
    def _spine(token: int, halves: dict, side: int) -> list[tuple[int, int, int]]:
        """(part, rank that made it, rank that consumed it) down one edge of a token's merge tree."""
        spine, consumed = [], _NEVER
        while token in halves:
            rank = halves[token][2]
            spine.append((token, rank, consumed))
            token, consumed = halves[token][side], rank
        spine.append((token, -1, consumed))
        return spine

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's texts together is a, b."""
        known = self._follows.get((a, b))
        if known is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            known = self._follows[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        rank = self.bpe.rank.get
        for x, made_x, gone_x in self._right[a]:
            for y, made_y, gone_y in self._left[b]:
                k = rank((x, y))
                # Both are there together and their merge comes before either is consumed.
                if k is not None and max(made_x, made_y) < min(gone_x, gone_y) and k < gone_x and k <= gone_y:
                    return False
        return True

    def table(self, word: str) -> tuple[list[int], list[int]]:
        """Last token and token count of each prefix (without word end); the empty prefix first."""
        shown = "".join(self.bpe.shown[b] for b in word.encode("utf-8", "replace"))
        last, count = [-1], [0]
        for i in range(1, len(shown) + 1):
            self._extend(shown, i, "", last, count)
        return last, count

    def _extend(self, shown: str, i: int, suffix: str, last: list[int], count: list[int]) -> None:
        token, start = self._step(shown, i, suffix, last)
        last.append(token)
        count.append(count[start] + 1)

    def _step(self, shown: str, i: int, suffix: str, last: list[int]) -> tuple[int, int]:
        find, follows = self.bpe.vocab.get, self.follows
        for start in range(max(0, i - self.longest), i):
            token = find(shown[start:i] + suffix)
            if token is not None and (start == 0 or follows(last[start], token)):
                return token, start
        raise ValueError(f"no token ends at byte {i} of {shown!r}")

    def count(self, word: str) -> int:
        """Tokens of a whole word."""
        if word in self.bpe.special:
            return 1
        shown = "".join(self.bpe.shown[b] for b in word.encode("utf-8", "replace"))
        whole = self.bpe.vocab.get(shown + self.bpe.end)
        if whole is not None:
            return 1
        last, count = [-1], [0]
        for i in range(1, len(shown)):
            self._extend(shown, i, "", last, count)
        return count[self._step(shown, len(shown), self.bpe.end, last)[1]] + 1

    def _index(self) -> None:
        """Vocabulary entries by the hash of their bytes, for look-ups of many at a time."""
        byte = {c: b for b, c in enumerate(self.bpe.shown)}
        hashes, tokens = [], []
        self.longest_bytes = 1
        for piece, token in self.bpe.vocab.items():
            ends = piece.endswith(self.bpe.end)
            raw = bytes(byte[c] for c in (piece.removesuffix(self.bpe.end) if ends else piece) if c in byte)
            if len(raw) + len(self.bpe.end) * ends != len(piece) or not raw:
                continue
            value = sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(raw)) % (1 << 64)
            hashes.append(value ^ (_ENDS if ends else 0))
            tokens.append(token)
            self.longest_bytes = max(self.longest_bytes, len(raw))
        order = np.argsort(np.array(hashes, dtype=np.uint64))
        self._hash, self._token = np.array(hashes, dtype=np.uint64)[order], np.array(tokens, dtype=np.int64)[order]
        self._maybe = np.zeros(1 << 22, dtype=bool)
        self._maybe[self._cell(self._hash)] = True

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def _follow_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(a << 32 | b, return_inverse=True)
        left, right = (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()
        return np.fromiter(map(self.follows, left, right), dtype=bool, count=len(pairs))[back]

    def count_many(self, words: list[str]) -> list[int]:
        """``count`` of each word: the same table, a position of all words at a time."""
        out = np.zeros(len(words), dtype=np.int64)
        coded = [w.encode("utf-8", "replace") for w in words]
        short = []
        for k, (word, raw) in enumerate(zip(words, coded, strict=True)):
            if word in self.bpe.special or len(raw) > _WIDE:
                out[k] = self.count(word)
            else:
                short.append(k)
        short.sort(key=lambda k: -len(coded[k]))
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            out[some] = self._count_block([coded[k] for k in some])
        return out.tolist()

    def _count_block(self, coded: list[bytes]) -> np.ndarray:
        """``coded``: longest first."""
        size = np.fromiter(map(len, coded), dtype=np.int64)
        n, wide = len(coded), int(size[0])
        data = np.frombuffer(b"".join(raw.ljust(wide, b"\0") for raw in coded), dtype=np.uint8).reshape(n, wide)
        power, inverse = powers(wide + 1)
        upto = np.zeros((n, wide + 1), dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:wide], axis=1, out=upto[:, 1:])
        last = np.full((n, wide + 1), -1, dtype=np.int64)
        count = np.zeros((n, wide + 1), dtype=np.int64)
        for i in range(1, wide + 1):
            rows = int(np.searchsorted(-size, -i, side="right"))
            starts = np.arange(max(0, i - self.longest_bytes), i)
            hashes = (upto[:rows, i, None] - upto[:rows, starts]) * inverse[starts]
            hashes[size[:rows] == i] ^= np.uint64(_ENDS)
            row, col = np.nonzero(self._maybe[self._cell(hashes)])
            found = hashes[row, col]
            at = np.minimum(np.searchsorted(self._hash, found), len(self._hash) - 1)
            real = self._hash[at] == found
            row, token, start = row[real], self._token[at[real]], starts[col[real]]
            fits = start == 0
            fits[~fits] = self._follow_many(last[row[~fits], start[~fits]], token[~fits])
            row, token, start = row[fits], token[fits], start[fits]
            last[row, i] = token
            count[row, i] = count[row, start] + 1
        return count[np.arange(n), size]

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of the word, taken as a word of its own; index 0 is the empty prefix.

        Positions count bytes; a cut inside a character counts its bytes so far.
        """
        if word in self.bpe.special:
            return [0] * len(word) + [1]
        last, count = self.table(word)
        shown = "".join(self.bpe.shown[b] for b in word.encode("utf-8", "replace"))
        return [0] + [count[self._step(shown, i, self.bpe.end, last)[1]] + 1 for i in range(1, len(shown) + 1)]


class TextPrefixes:
    """Token counts at every prefix of one text; positions are words of its normalised form."""

    def __init__(self, table: PrefixTable, text: str, counts: Memo | None = None):
        self.table = table
        self.words = table.bpe.split(text)
        counts = Memo(table.count_many) if counts is None else counts
        counts.learn(self.words)
        self.totals = [0, *accumulate(map(counts.__getitem__, self.words))]

    def tokens(self, n_words: int | None = None, n_bytes: int = 0) -> int:
        """Tokens of the first ``n_words`` words and the first ``n_bytes`` bytes of the next."""
        n = len(self.words) if n_words is None else n_words
        return self.totals[n] + (self.table.word_prefixes(self.words[n])[n_bytes] if n_bytes else 0)

    def fit(self, budget: int) -> tuple[int, int]:
        """The longest prefix within a budget, as whole words and bytes of the next word."""
        n = int(np.searchsorted(self.totals, budget, side="right")) - 1
        if n == len(self.words):
            return n, 0
        rest = budget - self.totals[n]
        inside = self.table.word_prefixes(self.words[n])
        return n, max(i for i, c in enumerate(inside) if c <= rest)


def _table(raw: str) -> tuple[PrefixTable, Memo]:
    def make() -> tuple[PrefixTable, Memo]:
        table = PrefixTable(WordBpe(raw))
        return table, Memo(table.count_many)

    return held(f"prefixes {digest(raw)}", make)


def _count(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = _table(shared.value)
        known, split = memo.__getitem__, table.bpe.split
        for ids, texts in rows_of(batches):
            size, total, fits = [], [], []
            words = list(map(split, texts))
            memo.learn(list(chain.from_iterable(words)))
            for text, own in zip(texts, words, strict=True):
                totals = np.cumsum(np.fromiter(map(known, own), dtype=np.int64, count=len(own)))
                size.append(len(text.encode("utf-8", "replace")))
                total.append(int(totals[-1]) if len(totals) else 0)
                fits.append(int(np.searchsorted(totals, limit, side="right")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([t > limit for t in total], pa.bool_()), pa.array(fits, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "fit_words"],
            )

    return run


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = _table(shared.value)
        for ids, texts in rows_of(batches, 64):
            totals = [TextPrefixes(table, t, memo).totals for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.list_(pa.int64()))], names=["id", "prefix_tokens"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))


def share_vocabulary(docs: DataFrame, vocabulary: str):
    """The vocabulary file (a few MB, read by the driver) as a broadcast."""
    with open(vocabulary, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_words) of every row; one scan, no shuffle."""
    shared = share_vocabulary(docs, vocabulary)
    out = _rows(docs, id_col, text_col).mapInArrow(lean(_count(shared, limit)), "id long, n_bytes long, n_tokens long, over_limit boolean, fit_words long")
    return out.withColumnRenamed("id", id_col)


def prefix_tables(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens): the token count after 0, 1, 2, ... words of every text."""
    shared = share_vocabulary(docs, vocabulary)
    return _rows(docs, id_col, text_col).mapInArrow(lean(_prefixes(shared)), "id long, prefix_tokens array<long>").withColumnRenamed("id", id_col)
