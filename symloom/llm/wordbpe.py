"""The parts of a word-level BPE vocabulary that both token operators share.

Reads a ``tokenizers`` JSON file with an end-of-word suffix: NFC, lower case,
words split by a pattern, bytes shown as printable characters, merges in rank
order.  Special strings inside a text are matched before anything else.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable
from functools import cached_property

import numpy as np
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Entries of a worker's word memo and bytes of its words; it is emptied when full.
MEMO_WORDS, MEMO_BYTES = 300_000, 32 << 20
#: Bytes of a word from which it is merged alone, by a heap: passes over many words take a merge of each at a time.
LONG = 64

# The usual word pattern for lower-cased texts below U+0180, which are in NFC.
_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS, _WHITE = "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_FAST_WORD = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_WHITE}{_DIGITS}{_LETTERS}]+")
_HIGH = re.compile("[^\x00-ſ]")


def printable_bytes() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class WordBpe:
    """Vocabulary, merges and special strings."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with an end-of-word suffix is needed")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece = {i: p for p, i in self.vocab.items()} | {i: p for p, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.shown = printable_bytes()
        # Other texts are normalised and split by the library, whose Unicode tables decide.
        self._normalise = Tokenizer.from_str(raw).normalizer.normalize_str
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._mark = next(iter(self.special), "")[:2]

    def words_of(self, text: str) -> list[str]:
        """The normalised words of a text without special strings."""
        if text.isascii() or not _HIGH.search(text):
            return _FAST_WORD.findall(text.lower())
        return [word for word, _ in self._pieces(self._normalise(text))]

    def split(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self._split is None or self._mark not in text:
            return self.words_of(text)
        out: list[str] = []
        for k, part in enumerate(self._split.split(text)):
            out.extend([part] if k % 2 else self.words_of(part))
        return out

    def symbols(self, word: str) -> list[str]:
        """The word's bytes as printable characters, the last with the end-of-word suffix."""
        shown = [self.shown[b] for b in word.encode("utf-8", "replace")]
        shown[-1] += self.end
        return shown

    @cached_property
    def _bases(self) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the 256 bytes inside a word and at its end."""
        return tuple(np.array([self.vocab[c + end] for c in self.shown], dtype=np.int64) for end in ("", self.end))

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge pairs as sorted integers with their ranks; what each rank makes."""
        keys = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        ranks = np.fromiter(self.rank.values(), dtype=np.int64)
        return keys[order], ranks[order], np.array(self.made, dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks, made = self._pairs
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], len(made))

    def merge_many(self, words: list[str]) -> list[np.ndarray]:
        """``merge`` of each word; short ones a merge of every unfinished word at a time."""
        done: list = [None] * len(words)
        for k, word in enumerate(words):
            if word in self.special:
                done[k] = np.array([self.special[word]], dtype=np.uint32)
            elif len(word) >= LONG:
                done[k] = np.array(self.merge(word), dtype=np.uint32)
        which = [k for k, ids in enumerate(done) if ids is None]
        if not which:
            return done
        coded = [words[k].encode("utf-8", "replace") for k in which]
        size = np.fromiter(map(len, coded), dtype=np.int64)
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        inside, last = self._bases
        ids, stop = inside[data], np.cumsum(size)
        ids[stop - 1] = last[data[stop - 1]]
        owner = np.repeat(np.array(which, dtype=np.int64), size)
        none = len(self.made)
        rank = np.full(len(ids), none, dtype=np.int64)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self._ranks(ids[:-1][same], ids[1:][same])
        while len(ids):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(ids)])
            over = best == none
            for a, n in zip(start[over].tolist(), length[over].tolist(), strict=True):
                done[owner[a]] = ids[a : a + n].astype(np.uint32)
            if over.all():
                break
            stay = np.repeat(~over, length)
            low = np.repeat(best, length)
            hit = np.flatnonzero((rank == low) & stay)
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            ids[hit] = self._pairs[2][rank[hit]]
            stay[hit + 1] = False
            shift = np.cumsum(stay) - 1
            hit = shift[hit]
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            rank[hit] = none
            for at in (hit, hit[hit > 0] - 1):
                at = at[at + 1 < len(ids)]
                at = at[owner[at] == owner[at + 1]]
                rank[at] = self._ranks(ids[at], ids[at + 1])
        return done

    def merge(self, word: str) -> list[int]:
        """Token ids of a word: the lowest-ranked pair merges first, the leftmost of equal ones.

        Pairs wait in a heap by (rank, place) and symbols are linked, so n bytes take
        n log n steps.  A pair that a merge has taken apart is passed over when it comes up.
        """
        if word in self.special:
            return [self.special[word]]
        ids = [self.vocab[s] for s in self.symbols(word)]
        n, rank, made = len(ids), self.rank.get, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [r << 40 | i for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        place = (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i, r = top & place, top >> 40
            j = after[i]
            if ids[i] is None or j >= n or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], k = made[r], None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (s := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, s << 40 | i)
            if (h := before[i]) >= 0 and (s := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, s << 40 | h)
        return [x for x in ids if x is not None]


class Memo(dict):
    """A bounded memo of a function of words, which is asked for many at a time."""

    def __init__(self, make_many: Callable[[list[str]], list], size: int = MEMO_WORDS):
        super().__init__()
        self.make_many, self.size = make_many, size

    def learn(self, words: list[str]) -> None:
        """Make sure that all of ``words`` are known."""
        new = {w for w in words if w not in self}
        if new:
            if len(self) + len(new) > self.size:
                self.clear()
                new = set(words)
            new = list(new)
            self.update(zip(new, self.make_many(new), strict=True))


def digest(raw: str) -> str:
    """A key for what is made from a vocabulary."""
    return hashlib.sha256(raw.encode("utf-8")).hexdigest()
