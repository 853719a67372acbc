"""Language identification by interpolated Kneser-Ney character models.

A model of order ``ORDER`` over the letters of padded words is trained for each
language.  The interpolated log-probabilities of all n-grams of any language
and the back-off weights of all contexts lie in sorted arrays of n-gram hashes,
one pair for each order and a column for each language; scoring a block of new
words is a few binary searches in them.  A text's words are looked up in a
bounded memo, so a text costs one sum over its words.  The language with the
lowest cross-entropy per character wins.

Training takes whole texts of a bounded sample: about ``TRAIN_DOCS`` documents
of each language (by a hash of the id) whose crc32(id) mod 5 is not 0.  A fifth
of the sample is left out of the counts and calibrates rejection: a text is
rejected where its cross-entropy lies further above the language's median than
``REJECT_Z`` (or 1.5 times the distance that ``CALIBRATED`` of the language's
calibration texts keep) standard deviations for its length, or where it has no
letter.  Medians and quantiles over the calibration texts whose best language is
their label keep a few mislabelled or garbage rows from moving the limit.

A letter is a character of a Unicode category L.  Null texts and texts without a
letter get ``und`` and score 0 and are rejected; where nothing could be learned,
all texts get ``und`` and score 0 and those with a letter are not rejected.  Ties
go to the language that sorts first; repeated rows are predicted one by one; rows
with a null id are never trained on and not held out; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import written
from symloom.llm.kernels import mix, seeds
from symloom.llm.wordbpe import Memo
from symloom.llm.worker import blocks, held, lean, rows_of

ORDER = 5
#: Bound of the training sample: documents of a language.
TRAIN_DOCS = 400
REJECT_Z = 6.0
#: Share of a language's calibration texts that its limit is taken from; the rest may be garbage.
CALIBRATED = 0.9
#: Texts of a language are taken to differ by so much cross-entropy at least, as mixed and noisy ones do.
MIN_SPREAD = 0.25
#: Characters that an unknown character is taken to be one of.
ALPHABET = 4096
#: Texts are not taken as surer than one of so many characters.
_SURE_CHARS = 40



def _other_numbers() -> str:
    """What a regular expression takes for a word character although it is no letter, mark or digit: Nl and No, as ranges."""
    found = [c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    runs: list[list[str]] = []
    for c in found:
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{a}-{b}" for a, b in runs)


_WORD = re.compile(r"[^\W\d_]+")
_EXACT_WORD = re.compile(rf"[^\W\d_{_other_numbers()}]+")
#: Where such numbers may be: the exact pattern is much slower.
_MAY_HOLD_NUMBERS = re.compile("[²³¹¼-¾\u0180-\U0010ffff]")
_PAD = " " * (ORDER - 1)


def words_of(text: str) -> list[str]:
    """The lower-cased letter runs of a text."""
    text = text.lower()
    exact = not text.isascii() and _MAY_HOLD_NUMBERS.search(text)
    return (_EXACT_WORD if exact else _WORD).findall(text)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 5


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def grams_of(words: list[str]) -> Counter:
    """Counts of the n-grams of highest order in padded words."""
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        padded = f"{_PAD}{word} "
        for i in range(len(padded) - ORDER + 1):
            counts[padded[i : i + ORDER]] += n
    return counts


class _Order:
    """Counts of one order of one language: n-grams, context totals and followers, and the discount."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in counts.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        self.discount = once / (once + 2 * twice) if once and twice else 0.5

    def back_off(self, context: str) -> float:
        total = self.total.get(context)
        return self.discount * self.kinds[context] / total if total else 1.0


def _orders(top: dict[str, int]) -> list[_Order]:
    """Order 1 to ``ORDER``: below the highest, a count is the number of characters seen before the n-gram."""
    orders = [_Order(top)]
    while len(orders) < ORDER:
        before: Counter = Counter(gram[1:] for gram in orders[0].counts)
        orders.insert(0, _Order(before))
    return orders


def _hash_grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position of an array of code points, from n - 1 on."""
    out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for i, a in enumerate(seeds(n, 20 + n)):
        out += (codes[i : len(codes) - n + 1 + i].astype(np.uint64) + np.uint64(1)) * a
    return mix(out)


def _hash_strings(grams: list[str], n: int) -> np.ndarray:
    if not grams:
        return np.zeros(0, dtype=np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _hash_grams(codes, n)[::n] if n else np.zeros(len(grams), dtype=np.uint64)


@dataclass
class Model:
    """Sorted hash arrays: ``grams[n - 1]`` and ``contexts[n - 1]`` are (hashes, log values by language)."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    spread: np.ndarray
    char_spread: np.ndarray
    z: float | np.ndarray = REJECT_Z  # for each language once calibrated

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each padded word in each language; its characters with the final pad."""
        padded = [f"{_PAD}{w} " for w in words]
        size = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.cumsum(size) - size
        inside = np.arange(len(codes)) - np.repeat(first, size) >= ORDER - 1
        ends = np.flatnonzero(inside)
        total = np.zeros((len(ends), len(self.langs)), dtype=np.float64)
        left = np.arange(len(ends))
        for n in range(ORDER, 0, -1):
            at = ends[left]
            hashes = _hash_grams(codes, n)[at - n + 1]
            row, found = _find(self.grams[n - 1][0], hashes)
            total[left[found]] += self.grams[n - 1][1][row[found]]
            left = left[~found]
            if not len(left):
                break
            if n > 1:
                context = _hash_grams(codes, n - 1)[ends[left] - n + 1]
                row, found = _find(self.contexts[n - 1][0], context)
                total[left[found]] += self.contexts[n - 1][1][row[found]]
        if len(left):
            total[left] += self.contexts[0][1][0] - math.log(ALPHABET)
        chars = size - (ORDER - 1)
        return np.add.reduceat(total, np.cumsum(chars) - chars), chars

    def limit(self, best: np.ndarray, chars: np.ndarray, z: float | np.ndarray) -> np.ndarray:
        z = z[best] if isinstance(z, np.ndarray) else z
        return self.mean[best] + z * (self.spread[best] + self.char_spread[best] / np.sqrt(np.maximum(chars, 1)))


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


def _sorted_rows(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def build_model(counts: dict[str, dict[str, int]]) -> Model:
    """The arrays from counts of highest-order n-grams by language."""
    langs = sorted(counts)
    orders = [_orders(counts[lang]) for lang in langs]
    grams, contexts = [], []
    below: dict[str, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        own = [o[n - 1] for o in orders]
        every = sorted(set(chain.from_iterable(o.counts for o in own)))
        around = sorted(set(chain.from_iterable(o.total for o in own)))
        weight = {c: np.array([o.back_off(c) for o in own]) for c in around}
        now = {}
        for gram in every:
            context = gram[:-1]
            lower = below[gram[1:]] if n > 1 else np.full(len(langs), 1.0 / ALPHABET)
            seen = np.array([max(o.counts.get(gram, 0) - o.discount, 0.0) / (o.total.get(context) or 1) for o in own])
            now[gram] = seen + weight[context] * lower
        grams.append(_sorted_rows(_hash_strings(every, n), np.log(np.array([now[g] for g in every]).reshape(len(every), len(langs)))))
        contexts.append(_sorted_rows(_hash_strings(around, n - 1), np.log(np.array([weight[c] for c in around]).reshape(len(around), len(langs)))))
        below = now
    nothing = np.zeros(len(langs))
    return Model(langs, grams, contexts, nothing, nothing + 1, nothing + 1)


class Scorer:
    """Scores whole texts; word scores are kept in a bounded memo of row numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.scores = np.zeros((0, len(model.langs)))
        self.chars = np.zeros(0, dtype=np.int64)
        self.memo = Memo(self._rows)

    def _rows(self, words: list[str]) -> list[int]:
        if not self.memo:
            self.scores, self.chars = self.scores[:0], self.chars[:0]
        scores, chars = self.model.word_scores(words)
        start = len(self.chars)
        self.scores, self.chars = np.concatenate([self.scores, scores]), np.concatenate([self.chars, chars])
        return list(range(start, start + len(words)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, and the characters, of each text."""
        split = [words_of(t) for t in texts]
        self.memo.learn(list(chain.from_iterable(split)))
        out = np.zeros((len(texts), len(self.model.langs)))
        chars = np.zeros(len(texts), dtype=np.int64)
        for k, words in enumerate(split):
            if words:
                rows = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
                chars[k] = self.chars[rows].sum()
                out[k] = -self.scores[rows].sum(axis=0) / chars[k]
        return out, chars


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[lang].update(grams_of(words_of(text)))
    rows = [(lang, gram, n) for lang, counts in held.items() for gram, n in counts.items()]
    lang, gram, n = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TRAIN_DOCS) -> DataFrame:
    """(lang, body, calibrates): the bounded sample, written to the shared folder."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where((fold(F.col("id")) != 0) & F.col("lang").isNotNull() & F.col("body").isNotNull())
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sizes.items()], F.lit(0.0))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.where(drawn < chance).select("lang", "body", (F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id").cast("string")), F.lit(5)) == 0).alias("calibrates"))
    return written(sample, "language-sample")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS) -> Model | None:
    """A calibrated model, or None where there is nothing to learn from."""
    sample = training_rows(docs, id_col, text_col, lang_col, per_language)
    counted = sample.where("not calibrates").select("lang", "body").mapInArrow(lean(_counted), "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for row in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.lang][row.gram] = row.n
    if not counts:
        return None
    model = build_model(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    checked = sample.where("calibrates").select("lang", "body").mapInArrow(lean(_calibration(shared)), "lang string, chars long, entropy double, spread double, best boolean").toArrow()
    _calibrate(model, checked)
    return model


def _calibration(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        column = {lang: k for k, lang in enumerate(shared.value.langs)}
        for langs, texts in rows_of(batches):
            entropy, chars = scorer.entropies(texts)
            own = np.array([column.get(lang, -1) for lang in langs])
            keep = np.flatnonzero((own >= 0) & (chars > 0))
            spread = []
            for k in keep.tolist():
                rows = np.fromiter(map(scorer.memo.__getitem__, words_of(texts[k])), dtype=np.int64)
                length = scorer.chars[rows]
                away = -scorer.scores[rows, own[k]] - entropy[k, own[k]] * length
                spread.append(float(np.sqrt((away**2).sum() / length.sum())))
            best = entropy[keep].argmin(axis=1) == own[keep]
            columns = [pa.array([langs[k] for k in keep.tolist()], pa.string()), pa.array(chars[keep]), pa.array(entropy[keep, own[keep]]), pa.array(spread, pa.float64()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "chars", "entropy", "spread", "best"])

    return run


def _calibrate(model: Model, checked: pa.Table) -> None:
    """Middle and spread of the cross-entropy of each language's calibration texts, and the distance that rejects."""
    lang, chars, entropy, spread, best = (np.array(checked[c].to_pylist()) for c in ("lang", "chars", "entropy", "spread", "best"))
    mean, doc, char, z = (np.zeros(len(model.langs)) for _ in range(4))
    for k, name in enumerate(model.langs):
        own = (lang == name) & best if len(lang) else np.zeros(0, dtype=bool)
        if not own.any():  # nothing to judge by: never reject
            mean[k], doc[k], char[k] = math.inf, 0.0, 0.0
            continue
        mean[k] = np.median(entropy[own])
        char[k] = np.median(spread[own])
        long = entropy[own & (chars >= 500)]
        # 1.4826 times the median distance is the standard deviation of normal values.
        doc[k] = max(MIN_SPREAD, float(1.4826 * np.median(np.abs(long - np.median(long)))) if len(long) > 1 else 0.0)
        away = (entropy[own] - mean[k]) / (doc[k] + char[k] / np.sqrt(chars[own]))
        z[k] = max(REJECT_Z, 1.5 * float(np.quantile(away, CALIBRATED)))
    model.mean, model.spread, model.char_spread, model.z = mean, doc, char, z


def _scorer(shared) -> Scorer:
    return held(f"scorer {shared.id}", lambda: Scorer(shared.value))


def _judged(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, whether there is no letter, score, lowest cross-entropy and rejection of each text."""
    entropy, chars = scorer.entropies(texts)
    best = entropy.argmin(axis=1)
    lowest = entropy[np.arange(len(texts)), best]
    sure = 1 / np.exp(-(entropy - lowest[:, None]) * np.minimum(chars, _SURE_CHARS)[:, None]).sum(axis=1)
    none = chars == 0
    rejected = none | (lowest > scorer.model.limit(best, chars, scorer.model.z))
    return best, none, np.where(none, 0.0, sure), np.where(none, 0.0, lowest), rejected


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for ids, texts in rows_of(batches):
            best, none, sure, lowest, rejected = _judged(scorer, texts)
            names = ["und" if n else scorer.model.langs[b] for n, b in zip(none.tolist(), best.tolist(), strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sure), pa.array(lowest), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, cross_entropy, rejected) of every row, from the text alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    if model is None:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), (~_has_letter(F.col("body"))).alias("rejected"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        out = rows.mapInArrow(lean(_predict(_Named(shared, uuid.uuid4().hex))), "id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; one scan, columns stay as they are.

    Only the texts go to Python, and a flag comes back.  Without a model, only
    texts without a letter are rejected.
    """
    text = F.col(text_col).cast("string")
    if model is None:
        return docs.where(_has_letter(text))
    named = _Named(docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex)

    def flags(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(named)
        for column in texts:
            parts = [_judged(scorer, [t or "" for t in column.slice(i, n).to_pylist()])[4] for i, n in blocks(column)]
            yield pa.array(~np.concatenate(parts) if parts else [], pa.bool_())

    flags = lean(flags)
    flags.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(flags, "boolean")(text))


@dataclass
class _Named:
    """A broadcast with a key by which workers keep their scorer."""

    broadcast: object
    id: str

    @property
    def value(self) -> Model:
        return self.broadcast.value


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS) -> DataFrame:
    """Train on ``docs`` and predict every row of it."""
    return identify(docs, train(docs, id_col, text_col, lang_col, per_language), id_col, text_col)
