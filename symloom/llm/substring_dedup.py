"""Substring dedup by compact windows.

A text's tokens are its shingles of ``k`` words.  Under a hash function, the
min-hash of a token interval is its smallest value, and the Cartesian tree over
the values groups all intervals by where that is: the node at c stands for
every interval that contains c inside the node's span [l, r], a compact window.
Only windows that can hold a passage of ``min_words`` words are kept; these are
the top of the tree, since every ancestor of a wide node is wide, and about one
token in 23 is one under each hash function.

A window's key is its minimum with the words next to it on one side inside the
window; both sides give a key where they fit.  Two texts that share a passage
share the passage's minimum and at least one of its sides under every hash
function; near copies share some of them under one of ``HASHES`` functions.
Windows with equal keys are joined as intervals on a diagonal (the difference
of their places).  A pair's passages are verified word by word: runs of equal
shingles are followed over substitutions and over insertions or deletions of up
to ``SHIFT`` words at one place.  A passage has ``min_words`` words in both texts
and a similarity of ``percent`` / 100 or more on its shingle sets; one whose
spans both lie in another's is not told.

Every task first joins its own windows and hands on one for each key, so a
passage in a third of all rows costs one row a task behind the shuffle; all
windows of a key are then linked to the first of it by (id, place), whatever the
partitions.  Where a key has more than two windows, the first need not hold what
two others share: every run of ``side`` equal words of such a link hands on all
intervals of ``min_words`` words that contain as much of it but reach beyond it.
In a second round these intervals are joined to the first with the same words,
which holds all of them, so an exact passage is never lost to a frequent phrase
inside it.  Near copies around such a run are found by the shingles that the first
text lacks beside it: of each interval the first ones in an order of the phrase's that
puts common shingles last, one more than similar intervals may differ in.  All texts
of several classes that have one are paired.

Words are compared in lower case without ASCII punctuation.  Texts of fewer
than ``min_words`` words (null and empty ones too) have no passages; repeated
rows with different ids share passages as other copies do, rows with one id are
one document; what a document repeats is told at its first place; rows with a null id are left out; an empty table gives an empty
result and extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import broadcast_if_small, written
from symloom.llm.graph import components
from symloom.llm.kernels import Runs, Words, joined, mix, ngrams, plain, seeds, text_blocks
from symloom.llm.worker import lean

HASHES = 3
SHINGLE = 5
MIN_WORDS = 50
PERCENT = 80
#: Words next to a minimum that its key takes in.
SIDE_WORDS = 16
#: Words less than an interval's in the runs of words by which intervals are first compared.
_SHORTER = 16
#: Words inserted or deleted at one place that a passage is followed over.
SHIFT = 8
#: Diagonals of a pair that are followed together.
_DIAGONALS = 64
#: Ends of runs whose next runs are sought together.
_ENDS = 4096
#: Words of diagonals that are searched for intervals together, unless one is longer.
_TOGETHER = 1 << 20
#: Windows that a task folds at a time.
_FOLDED = 1_000_000
#: Windows, sorted by key, that a task links at a time, unless one key has more.
_TURNED = 1 << 16
#: Bits of each half of a span, which is cut there.
_SPAN = 15
_MOST = (1 << _SPAN) - 1
#: Windows of a key in a task beyond which they are dealt evenly and not by key.
_FEW = 8
#: Pairs of a head from which it is counted which shingles beside its phrase are common.
_LINKED = 16
#: Texts of a head that have a shingle from which it is common.
_COMMON = 4
#: Rows of a shingle beside a phrase that are met by as many others in a task.
_TILE = 512
#: Least bits of a place in a block; the rest of a packed value orders the hashes.
_PLACE = 24

#: Members of a pair table that are verified against one text at a time.
_MEMBERS = 200
#: The same where only shingles are sought; keys of a head's only block are settled in its task.
_HEARD = 1000

_WINDOW = "deal long, key long, id long, place long, span int, n long, head_id long, head_place long"
_JOINED = "key long, id long, place long, other long, other_place long, crowded long, head_id long, head_place long"
_BESIDE = "key long, id long, place long, label long, around long"
_HELD = "other long, common array<long>"
_FOUND = "id long, other_id long, begin_word long, end_word long, other_begin long, other_end long, key long, keys array<long>"


def wide_nodes(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and spans [l, r) of the Cartesian-tree nodes at least ``width`` wide.

    ``values``: hashes of the tokens of many texts; text i has ``first[i]:first[i + 1]``.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(values) < width:
        return none, none, none
    place = np.arange(len(values), dtype=np.uint64)
    low = np.uint64((1 << max(_PLACE, len(values).bit_length())) - 1)  # a text of more shingles than usual blocks takes more bits
    packed = (values & ~low) | place
    least, n = packed, 1
    while n * 2 <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[: len(values) - width + 1], least[width - n :])
    size = np.diff(first)
    starts = np.repeat(first[:-1], np.maximum(size - width + 1, 0))
    run = np.arange(len(starts)) - np.repeat(np.cumsum(np.maximum(size - width + 1, 0)) - np.maximum(size - width + 1, 0), np.maximum(size - width + 1, 0))
    nodes = (least[starts + run] & low).astype(np.int64)  # ascending, as the least of a moving stretch only moves on
    nodes = nodes[_starts(nodes)]
    owner = np.searchsorted(first, nodes, side="right") - 1
    before, after = _nearest_smaller(packed[nodes], owner)
    left = np.where(before >= 0, nodes[before] + 1, first[owner])
    right = np.where(after >= 0, nodes[after], first[owner + 1])
    return nodes, left, right


def _nearest_smaller(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest smaller one before and behind it with the same owner, or -1; values differ, owners ascend."""
    n = len(values)
    values = np.append(values, values.dtype.type(0))  # nothing is smaller than what -1 points at
    found = []
    for step in (-1, 1):
        at = np.arange(n) + step
        inside = (at >= 0) & (at < n)
        inside[inside] = owner[at[inside]] == owner[inside]
        at[~inside] = -1
        # What lies between a greater one and what it points at is greater still.
        todo = np.flatnonzero(values[at] > values[:n])
        while len(todo):
            at[todo] = at[at[todo]]
            todo = todo[values[at[todo]] > values[todo]]
        found.append(at)
    return found[0], found[1]


def _order(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by key and then by the others, which are looked at for equal keys only."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else order
    few = order[tied]
    order[tied] = few[np.lexsort((*(c[few] for c in reversed(then)), key[few]))]
    return order


def window_keys(words: Words, hashes: int = HASHES, k: int = SHINGLE, min_words: int = MIN_WORDS, side: int = SIDE_WORDS) -> tuple[np.ndarray, ...]:
    """(key, text number, place of the key's first word, span) of all compact windows.

    A span packs how many words the window has before that place and from it on.
    """
    counts = words.counts()
    own = np.maximum(counts - k + 1, 0)
    grams = ngrams(words.hashes, k)
    first = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum(own, out=first[1:])
    shift = words.first[:-1] - first[:-1]  # from shingle places to word places
    at = np.arange(first[-1]) + np.repeat(shift, own)
    tokens = grams[at] if len(at) else grams[:0]
    runs = Runs(words.hashes)
    found = []
    for h, a in enumerate(seeds(hashes, 60)):
        node, left, right = wide_nodes(mix(tokens * a), first, min_words - k + 1)
        text = np.searchsorted(first, node, side="right") - 1
        begin, low, high = node + shift[text], left + shift[text], right + shift[text] + k - 1
        for way in (0, 1):
            a0, b0 = (begin, begin + side) if way == 0 else (begin + k - side, begin + k)
            fits = (a0 >= low) & (b0 <= high)
            key = runs.of(a0[fits], b0[fits]) * np.uint64(2 * h + way + 1)
            span = (np.minimum((a0 - low)[fits], _MOST) << _SPAN | np.minimum((high - a0)[fits], _MOST)).astype(np.int32)
            found.append((mix(key), text[fits], a0[fits] - words.first[text[fits]], span))
    key, text, place, span = (np.concatenate([f[i] for f in found]) for i in range(4))
    kept = _first_of_their_words(words, runs, key, text, place, side, min_words)
    return key[kept], text[kept], place[kept], span[kept]


def _first_of_their_words(words: Words, runs: Runs, key: np.ndarray, text: np.ndarray, place: np.ndarray, side: int, min_words: int) -> np.ndarray:
    """The windows that are first in their text with a key and all words that a passage of ``min_words`` around it may have.

    What a text says again, such as one word for pages, it shares with others at its first place.
    """
    at = place + words.first[text]
    begin = np.maximum(at + side - min_words, words.first[text])
    end = np.minimum(at + min_words, words.first[text + 1])
    around = mix(runs.of(begin, end) + (end - begin).astype(np.uint64)) ^ key
    around += mix(text.astype(np.uint64))
    order = _order(around, place)
    return np.sort(order[_starts(around[order])])


def _windows(options: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, data, offsets in text_blocks(batch.column(1)):
                key, text, place, span = window_keys(Words(*plain(data, offsets)), *options)
                held.append((key.view(np.int64), ids[i + text], place, span))
                n += len(key)
                if n > _FOLDED:
                    yield from _folded(held)
                    held, n = [], 0
        yield from _folded(held)

    return run


def _folded(held: list) -> Iterator[pa.RecordBatch]:
    """Windows dealt by key, the first of each key with their number; of many equal keys the others go evenly, with that first one."""
    if not held:
        return
    key, ids, place, span = (np.concatenate([h[i] for h in held]) for i in range(4))
    order = _order(key, ids, place)
    key, ids, place, span = key[order], ids[order], place[order], span[order]
    first = _starts(key)
    n = np.diff(np.append(first, len(key)))
    head, many = np.repeat(first, n), np.repeat(n > _FEW, n)
    count = np.zeros(len(key), dtype=np.int64)
    count[first] = n
    by_key = np.flatnonzero(~many | (count > 0))
    none = pa.nulls(len(by_key), pa.int64())
    yield _rows(_WINDOW, key[by_key], key[by_key], ids[by_key], place[by_key], span[by_key], count[by_key], none, none)
    rest = np.flatnonzero(many & (count == 0))
    deal = mix(key[rest].view(np.uint64) + ids[rest].view(np.uint64) * np.uint64(31) + place[rest].view(np.uint64)).view(np.int64)
    yield _rows(_WINDOW, deal, key[rest], ids[rest], place[rest], span[rest], pa.nulls(len(rest), pa.int64()), ids[head[rest]], place[head[rest]])


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)


def _edges(equal: np.ndarray) -> np.ndarray:
    """Begin and end of each run of true values, in turn."""
    padded = np.zeros(len(equal) + 2, dtype=bool)
    padded[1:-1] = equal
    return np.flatnonzero(padded[1:] != padded[:-1])


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of spans [begin, end) whose begins ascend, each once."""
    begin = np.append(begin[:1], np.maximum(begin[1:], np.maximum.accumulate(end)[:-1]))
    size = np.maximum(end - begin, 0)
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _rows(schema: str, *columns) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _headed(min_words: int):
    """Links of windows sorted by key to the first of it by (id, place); what a task dealt evenly passes, and finds the first by the task's own first window."""

    def closed(key: np.ndarray, ids: np.ndarray, place: np.ndarray, span: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = key[1:] == key[:-1]
        told = np.flatnonzero(np.append(same, False) | np.append(False, same) | (n > _FEW))
        if not len(told):
            return
        told = told[np.lexsort((place[told], ids[told], key[told]))]
        key, ids, place, span, n = key[told], ids[told], place[told], span[told], n[told]
        first = _starts(key)
        head = np.repeat(first, np.diff(np.append(first, len(key))))
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(key))))
        room = np.minimum(span >> _SPAN, span[head] >> _SPAN) + np.minimum(span & _MOST, span[head] & _MOST)
        at = np.flatnonzero((ids != ids[head]) & ((total > 2) | (room + 2 * SHIFT >= min_words)))
        none = pa.nulls(len(at), pa.int64())
        yield _rows(_JOINED, none, ids[at], place[at], ids[head[at]], place[head[at]], (total[at] > 2).astype(np.int64), none, none)
        at = np.flatnonzero(n > _FEW)
        none = pa.nulls(len(at), pa.int64())
        yield _rows(_JOINED, key[at], ids[at], place[at], ids[head[at]], place[head[at]], np.ones(len(at), dtype=np.int64), none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, most = 0, _TURNED
        for batch in batches:
            columns = [batch.column(k) for k in range(1, 8)]
            evenly = columns[4].is_null()
            if columns[4].null_count:
                key, ids, place, _, _, head, head_place = (c.filter(evenly) for c in columns)
                none = pa.nulls(len(key), pa.int64())
                yield _rows(_JOINED, key, ids, place, none, none, none, head, head_place)
                columns = [c.filter(pc.invert(evenly)) for c in columns[:5]]
            rows = [c.to_numpy(zero_copy_only=False) for c in columns[:5]]
            if not len(rows[0]):
                continue
            held.append(rows)
            size += len(rows[0])
            if size < most:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from closed(*(c[:last] for c in rows))
            held = [[c[last:] for c in rows]]
            size -= last
            most = max(_TURNED, 2 * size)
        if held:
            yield from closed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _equal_runs(a: np.ndarray, b: np.ndarray, diagonals: list[int], side: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Equal words of diagonals, one behind the other; the first word in ``a`` and the place of each diagonal; begin and end of runs of ``side`` words or more."""
    gap = 2 * min_words
    low = np.array([max(0, d) for d in diagonals], dtype=np.int64)
    size = np.array([max(min(len(a), len(b) + d) - max(0, d), 0) for d in diagonals], dtype=np.int64)
    offset = gap + np.cumsum(size + gap) - (size + gap)
    equal = np.zeros(int((size + gap).sum()) + gap, dtype=bool)
    for d, x, m, at in zip(diagonals, low.tolist(), size.tolist(), offset.tolist(), strict=True):
        np.equal(a[x : x + m], b[x - d : x - d + m], out=equal[at : at + m])
    edge = _edges(equal)
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= side
    return equal, low, offset, begin[long], end[long]


def shingles_beyond(a: np.ndarray, b: np.ndarray, diagonals: list[int], side: int, min_words: int, k: int = SHINGLE, percent: int = PERCENT, common: np.ndarray | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words in ``a``, their places on the diagonal in ``b`` and keys of shingles that ``b`` lacks there, beside runs of ``side`` equal words.

    An interval that holds ``side`` words of a run gives those of the least hashes,
    one more than two similar intervals may differ in.  So of two texts with similar
    intervals of which one is not similar to ``b``'s, both give the least that they share.
    That holds for any order that is the same for both: keys in ``common`` come behind
    all others, in its order.  With ``every``, all shingles are told.
    """
    none = np.zeros(0, dtype=np.int64)
    n = min_words - k + 1
    equal, low, offset, begin, end = _equal_runs(a, b, diagonals, side, min_words)
    if not len(begin):
        return none, none, none.astype(np.uint64)
    total = len(equal) - k + 1
    start = _spans(begin + side - min_words, end - side + 1)
    start = start[start + n <= total]
    at = _spans(begin + side - min_words, np.minimum(end - side + n, total))  # what the intervals hold
    beyond = ~np.logical_and.reduce([equal[at + i] for i in range(k)])
    at = at[beyond]
    own = np.searchsorted(offset - min_words, at, side="right") - 1
    first = at - offset[own] + low[own]
    fits = (own >= 0) & (first >= 0) & (first <= len(a) - k)
    at, own, first = at[fits], own[fits], first[fits]
    other = first - np.array(diagonals, dtype=np.int64)[own]
    key = mix(ngrams(a, k)[first] + mix(other.view(np.uint64)))
    if every:
        return first, other, key
    rank = np.empty(len(at), dtype=np.int32)
    order = np.argsort(key)
    if common is not None and len(common):
        by_key = np.argsort(common)
        found = np.minimum(np.searchsorted(common, key, sorter=by_key), len(common) - 1)
        behind = np.where(common[by_key[found]] == key, by_key[found] + 1, 0)
        order = order[np.argsort(behind[order], kind="stable")]
    rank[order] = np.arange(len(at), dtype=np.int32)
    value = np.full(total, np.iinfo(np.int32).max, dtype=np.int32)
    value[at] = rank
    few = min(n * (100 - percent) // (100 + percent) + 1, n)
    held = np.lib.stride_tricks.sliding_window_view(value, n)
    # The greatest rank that any interval with a shingle takes.
    taken = np.full(total + n, -1, dtype=np.int32)
    for part in range(0, len(start), _ENDS):
        now = start[part : part + _ENDS]
        taken[now + n - 1] = np.partition(held[now], few - 1, axis=1)[:, few - 1]
    size = 1
    while size < n:
        step = min(size, n - size)
        taken = np.maximum(taken[:-step], taken[step:])
        size += step
    kept = rank <= taken[at]
    return first[kept], other[kept], key[kept]


def intervals_beyond(a: np.ndarray, b: np.ndarray, diagonals: list[int], side: int, min_words: int, k: int = SHINGLE, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """First words, in ``a`` and in ``b``, of the intervals that hold ``side`` words of an equal run but are no passage of the two on one of the diagonals.

    Where an interval begins and ends on equal shingles and is similar, any text
    that has its words shares a passage with the other text too.  The diagonals lie
    one behind the other in one array, with room for an interval between them.
    """
    n = min_words - k + 1
    equal, low, offset, begin, end = _equal_runs(a, b, diagonals, side, min_words)
    if not len(begin):
        return begin, begin
    inner = np.maximum(end - min_words + 1, begin)  # intervals from begin to here lie in the run
    low_ends, high_ends = np.concatenate([begin + side - min_words, inner]), np.concatenate([begin, end - side + 1])
    order = np.argsort(low_ends, kind="stable")
    at = _spans(low_ends[order], high_ends[order])
    grams = equal[: len(equal) - k + 1].copy()
    for i in range(1, k):
        grams &= equal[i : len(equal) - k + 1 + i]
    total = np.zeros(len(grams) + 1, dtype=np.int64)
    np.cumsum(grams, out=total[1:])
    hits = total[at + n] - total[at]
    passage = (100 * hits >= percent * (2 * n - hits)) & grams[at] & grams[at + n - 1]
    at = at[~passage]
    own = np.searchsorted(offset - min_words, at, side="right") - 1
    first = at - offset[own] + low[own]
    other = first - np.array(diagonals, dtype=np.int64)[own]
    return first[(first >= 0) & (first <= len(a) - min_words)], other[(other >= 0) & (other <= len(b) - min_words)]


def _resync(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, way: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest equal shingles from each (i, j) on, forwards or backwards, over a shift of diagonal: (which of them, place in a, place in b)."""
    step = np.arange(reach)
    cost = ((step[:, None] + step[None, :]) * reach * reach + step[:, None] * reach + step[None, :]).astype(np.int32)
    x, y = i[:, None] + way[:, None] * step, j[:, None] + way[:, None] * step
    in_a, in_b = (x >= 0) & (x < len(a)), (y >= 0) & (y < len(b))
    same = (a[np.where(in_a, x, 0)][:, :, None] == b[np.where(in_b, y, 0)][:, None, :]) & in_a[:, :, None] & in_b[:, None, :]
    hit = np.flatnonzero(same.any(axis=(1, 2)))
    best = np.where(same[hit], cost, np.iinfo(np.int32).max).reshape(len(hit), reach * reach).argmin(axis=1)
    return hit, x[hit, best // reach], y[hit, best % reach]


def _run_at(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The run of equal shingles on the diagonal of (i, j), which are equal: first and last + 1 in ``a``."""
    ends = []
    for one, two in ((a[i:], b[j:]), (a[: i + 1][::-1], b[: j + 1][::-1])):
        n, step = min(len(one), len(two)), 64
        at = 0
        while at < n:
            differ = np.flatnonzero(one[at : min(at + step, n)] != two[at : min(at + step, n)])
            if len(differ):
                at += int(differ[0])
                break
            at, step = min(at + step, n), step * 4
        ends.append(at)
    return i - ends[1] + 1, i + ends[0]


def _runs_on(a: np.ndarray, b: np.ndarray, diagonals: list[int]) -> dict[int, list[tuple[int, int]]]:
    """(first, last + 1) of the equal runs on each diagonal; the diagonals lie one behind the other in one array."""
    spans = [(max(0, d), max(0, d, min(len(a), len(b) + d))) for d in diagonals]
    offset = np.cumsum([1] + [high - low + 1 for low, high in spans])
    equal = np.zeros(int(offset[-1]), dtype=bool)
    for (low, high), d, at in zip(spans, diagonals, offset.tolist(), strict=False):
        if high > low:
            np.equal(a[low:high], b[low - d : high - d], out=equal[at : at + high - low])
    edge = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    own = np.searchsorted(offset, edge, side="right") - 1
    place = (edge - offset[own] + np.array([low for low, _ in spans], dtype=np.int64)[own]).tolist()
    cut = np.searchsorted(own, np.arange(len(diagonals) + 1)).tolist()
    return {d: list(zip(place[x:y:2], place[x + 1 : y : 2], strict=True)) for d, x, y in zip(diagonals, cut[:-1], cut[1:], strict=True)}


def _segments(a: np.ndarray, b: np.ndarray, diagonals: dict[int, list[tuple[int, int]]], reach: int) -> list[tuple[int, int, int]]:
    """(first, last + 1, diagonal) of the diagonals' equal runs and of those that their ends lead to."""
    runs = {d: sorted(found) for d, found in diagonals.items()}
    todo = [(x, y, d, way) for d, found in diagonals.items() for x, y in found for way in (1, -1)]
    seen = set(todo)
    while todo:
        now, todo = todo[:_ENDS], todo[_ENDS:]
        x, y, d, way = (np.array(c, dtype=np.int64) for c in zip(*now, strict=True))
        i = np.where(way == 1, y, x - 1)
        hit, at, other = _resync(a, b, i, i - d, way, reach)
        for k, p, q in zip(hit.tolist(), at.tolist(), other.tolist(), strict=True):
            known = runs.setdefault(p - q, [])
            place = bisect.bisect(known, (p, len(a) + 1))
            if place and p < known[place - 1][1]:
                run = known[place - 1]
            else:
                run = _run_at(a, b, p, q)
                known.insert(place, run)
            new = (*run, p - q, now[k][3])
            if new not in seen:
                seen.add(new)
                todo.append(new)
    return sorted((x, y, d) for d, found in runs.items() for x, y in found)


def passages_of(a: np.ndarray, b: np.ndarray, diagonals: list[int], k: int, min_words: int, percent: int, grams: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Passages [begin, end) in words of ``a`` and their places [begin, end) in ``b``.

    Runs of equal shingles are chained along a diagonal and over to diagonals at
    most ``SHIFT`` away while the chain stays similar.  Equal texts are one passage.
    ``grams`` are the shingles of ``b`` where they are known.
    """
    if min(len(a), len(b)) < min_words:
        return []
    if len(a) == len(b) and np.array_equal(a, b):
        return [(0, len(a), 0, len(b))]
    one, two = ngrams(a, k), ngrams(b, k) if grams is None else grams
    found: list[tuple[int, int, int, int]] = []
    ahead = sorted(diagonals, key=lambda d: (abs(d), d))
    while ahead:
        now, ahead = ahead[:_DIAGONALS], ahead[_DIAGONALS:]
        found = _outermost([*found, *_chained(one, two, now, k, min_words, percent)])
        ahead = [d for d in ahead if not _inside((max(0, d), min(len(a), len(b) + d), max(0, -d), min(len(b), len(a) - d)), found)]
    return found


def _inside(part: tuple[int, int, int, int], found: list[tuple[int, int, int, int]]) -> bool:
    """Whether a passage holds both spans."""
    x, y, u, v = part
    return any(p <= x and y <= q and r <= u and v <= t for p, q, r, t in found)


def _outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The passages whose spans are not both inside another's, which also settles texts that repeat themselves."""
    kept: list[tuple[int, int, int, int]] = []
    for one in sorted(set(found), key=lambda f: (f[0] - f[1], f)):
        if not _inside(one, kept):
            kept.append(one)
    return sorted(kept)


def _chained(one: np.ndarray, two: np.ndarray, diagonals: list[int], k: int, min_words: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages along some diagonals of two texts' shingles."""
    chains: list[list[int]] = []  # first, last + 1 in a; first, last + 1 in b; equal shingles; whether on several diagonals
    opened: list[list[list[int]]] = []
    runs = _runs_on(one, two, diagonals)
    for x, y, d in _segments(one, two, runs, k + SHIFT):
        piece = [x, y, x - d, y - d, y - x, 0]
        for parts in opened:
            last = parts[-1]
            if not -SHIFT <= last[1] - last[3] - d <= SHIFT or x < last[0] or x - d < last[2]:
                continue
            gone = max(last[1] - x, last[3] - (x - d), 0)  # of the piece, already in the chain
            if gone < y - x:
                parts.append([x + gone, y, x - d + gone, y - d, y - x - gone, 0])
                break
        else:
            opened.append([piece])
    for parts in opened:
        out: list[list[int]] = []
        for part in parts:
            out.append(part)
            while len(out) > 1:
                u, v = out[-2:]
                hits = u[4] + v[4]
                if not similar(hits, v[1] - u[0], v[3] - u[2], percent):
                    break
                out[-2:] = [[u[0], v[1], u[2], v[3], hits, int(u[5] or v[5] or u[1] - u[3] != v[1] - v[3])]]
        chains.extend(out)
    found = set()
    for x, y, u, v, _, moved in chains:
        if min(y - x, v - u) + k - 1 < min_words:
            continue
        if moved:
            left, right = np.unique(one[x:y]), np.unique(two[u:v])
            same = len(np.intersect1d(left, right, assume_unique=True))
            if not similar(same, len(left), len(right), percent):
                continue
        found.add((x, y + k - 1, u, v + k - 1))
    # A stretch of one diagonal counts by itself where no chain holds it.
    n = min_words - k + 1
    for d in diagonals:
        hits = sum(y - x for x, y in runs[d])
        if not similar(min(hits, n), n, n, percent):  # too few for the shortest passage
            continue
        # hits / (2 * all - hits) >= p  <=>  hits * (1 - p) >= misses * 2 * p
        for x, y in joined(runs[d], 100 - percent, 2 * percent):
            y += k - 1
            if y - x >= min_words and not any(p <= x and y <= q and r <= x - d and y - d <= t for p, q, r, t in found):
                found.add((x, y, x - d, y - d))
    return sorted(found)


def similar(same: int, left: int, right: int, percent: int) -> bool:
    return 100 * same >= percent * (left + right - same)


def _word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_blocks(texts):
        words = Words(*plain(data, offsets))
        for x, y in zip(words.first[:-1], words.first[1:], strict=True):
            yield words.hashes[x:y]


def _shared_runs(words: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of intervals, one word apart, with one least hash among the shorter runs of words in them: (first, that hash, size; the keys of all intervals).

    ``at``: ascending first words.  Equal intervals have equal hashes, so that those of one text only go by these few.
    """
    width = max(min_words - _SHORTER, 1)
    runs = Runs(words)
    begin = np.arange(len(words) - width + 1)
    least = runs.of(begin, begin + width)
    size, n = 1, min_words - width + 1
    while size < n:
        step = min(size, n - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    least = least[at]
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)))
    return first, least[first], np.diff(np.append(first, len(at))), runs.of(at, at + min_words)


def _verify(k: int, min_words: int, percent: int, side: int):
    """Passages of pairs, sorted by (other, block, head first); for diagonals of a crowded key also the intervals beyond their runs, as (id, first word, common hash, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_words, head_grams = None, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            rows = []
            beyond: dict[int, list[np.ndarray]] = {}
            texts: dict[int, np.ndarray] = {}
            columns = (batch.column(i).to_pylist() for i in range(4))
            for two, one, diagonals, crowded, words in zip(*columns, _word_hashes(batch.column(4)), strict=True):
                if one is None:
                    head, head_words, head_grams = two, words, ngrams(words, k)
                    continue
                if head != two:
                    raise ValueError(f"the text of document {two} is missing")
                rows.extend((one, two, *place) for place in passages_of(words, head_words, diagonals, k, min_words, percent, head_grams))
                if 0 in crowded and np.array_equal(words, head_words):
                    crowded = [d for d in crowded if d]  # each interval of equal texts is in both
                most = max(1, _TOGETHER // (min(len(words), len(head_words)) + 2 * min_words))
                for first in range(0, len(crowded), most):
                    for own, text, at in zip((one, two), (words, head_words), intervals_beyond(words, head_words, crowded[first : first + most], side, min_words, k, percent), strict=True):
                        texts[own] = text
                        beyond.setdefault(own, []).append(at)
            out = zip(*rows, strict=True) if rows else [()] * 6
            yield _rows(_FOUND, *[pa.array(c, pa.int64()) for c in out], pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64())))
            places = {own: np.unique(np.concatenate(parts)) for own, parts in beyond.items()}
            held = [(np.full(len(first), own), at[first], key, size, keys) for own, at in places.items() if len(at) for first, key, size, keys in (_shared_runs(texts[own], at, min_words),)]
            if held:
                ids, at, key, size, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                none = pa.nulls(len(ids), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(keys.view(np.int64)))
                yield _rows(_FOUND, ids, none, at, none, none, none, key.view(np.int64), lists)

    return run


def _beside(k: int, min_words: int, percent: int, side: int):
    """Keys of the shingles that the head of a crowded key lacks beside equal runs; pairs as in ``_verify``, with the class of ``id``.

    ``around`` tells the words that an interval with the shingle may have.  Where a
    head's pairs are one block, keys of one class end here, as no other row has them.
    """

    def settled(found: list[tuple[np.ndarray, ...]], whole: bool) -> Iterator[pa.RecordBatch]:
        """Of a head's rows the first of each key, class and words around; ``whole``: these are all of the head."""
        if not found:
            return
        key, ids, place, label, around = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, ids, around, label, key))
        key, ids, place, label, around = (c[order] for c in (key, ids, place, label, around))
        new = np.append(True, (key[1:] != key[:-1]) | (label[1:] != label[:-1]))
        kept = new.copy()
        kept[1:] |= around[1:] != around[:-1]
        if whole:
            first = _starts(key)
            kept &= np.repeat(np.add.reduceat(new, first, dtype=np.int64) > 1, np.diff(np.append(first, len(key))))
        if kept.any():
            yield _rows(_BESIDE, *(c[kept] for c in (key, ids, place, label, around)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, whole, common = np.zeros(0, dtype=np.uint64), False, None
        found: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            held = batch.column(6) if batch.num_columns > 6 else pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            for two, one, diagonals, label, blocks, keys, words in zip(*columns, held, _word_hashes(batch.column(4)), strict=True):
                if one is None:
                    yield from settled(found, whole)
                    head_words, whole, found, n = words, blocks == 1, [], 0
                    common = keys.values.to_numpy(zero_copy_only=False).view(np.uint64) if keys.is_valid else None
                    continue
                if n > _FOLDED:
                    yield from settled(found, False)
                    whole, found, n = False, [], 0
                most = max(1, _TOGETHER // (min(len(words), len(head_words)) + 2 * min_words))
                for first in range(0, len(diagonals), most):
                    at, _, key = shingles_beyond(words, head_words, diagonals[first : first + most], side, min_words, k, percent, common)
                    if len(at):
                        key = mix(key + mix(np.array([two]).view(np.uint64)))
                        begin, end = np.maximum(at + k - min_words, 0), np.minimum(at + min_words, len(words))
                        around = mix(Runs(words).of(begin, end) + (end - begin).astype(np.uint64))
                        order = np.lexsort((at, key ^ around))
                        kept = order[_starts((key ^ around)[order])]
                        found.append((key[kept].view(np.int64), np.full(len(kept), one), at[kept], np.full(len(kept), label), around[kept].view(np.int64)))
                        n += len(kept)
        yield from settled(found, whole)

    return run


def _held(k: int, min_words: int, percent: int, side: int):
    """Of each head the keys that ``_COMMON`` or more of its texts have beside its phrase, the most common last; rows as in ``_beside``.

    They only order the shingles, so texts that are not counted cost time, not passages.
    """

    def told(head: int | None, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        key, n = key[n >= _COMMON], n[n >= _COMMON]
        if len(key):
            key = key[np.argsort(n, kind="stable")].view(np.int64)
            yield _rows(_HELD, pa.array([head], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), pa.array(key)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_words, keys, n = None, np.zeros(0, dtype=np.uint64), [], 0
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for two, one, diagonals, words in zip(*columns, _word_hashes(batch.column(4)), strict=True):
                if one is None:
                    yield from told(head, keys)
                    head, head_words, keys, n = two, words, [], 0
                    continue
                most = max(1, _TOGETHER // (min(len(words), len(head_words)) + 2 * min_words))
                if n <= _FOLDED:
                    keys.append(np.unique(shingles_beyond(words, head_words, diagonals[:most], side, min_words, k, percent, every=True)[2]))
                    n += len(keys[-1])
        yield from told(head, keys)

    return run


def window_links(windows: DataFrame, min_words: int) -> DataFrame:
    """(id, other, diagonal, crowded): each window with the first of its key, by (id, place), whatever the partitions.

    The intervals of two windows are joined: they must have room for a passage in
    common, but where a key has more than two windows (it is crowded), as the first
    then stands for the others.  ``id`` is the larger one.
    """
    found = written(windows.repartition("deal").sortWithinPartitions("deal").mapInArrow(lean(_headed(min_words)), _JOINED), "windows")
    heads = found.where("key is not null and other is not null").select("key", F.col("id").alias("head_id"), F.col("place").alias("head_place"), "other", "other_place", "crowded")
    rest = found.where("key is not null and other is null").select("key", "id", "place", "head_id", "head_place").join(heads.distinct(), ["key", "head_id", "head_place"])
    columns = ["id", "place", "other", "other_place", "crowded"]
    every = found.where("key is null").select(*columns).union(rest.where("id <> other").select(*columns))
    diagonal = F.when(F.col("id") > F.col("other"), F.col("place") - F.col("other_place")).otherwise(F.col("other_place") - F.col("place"))
    links = every.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other"), diagonal.alias("diagonal"), "crowded")
    return links.groupBy("id", "other", "diagonal").agg(F.max("crowded").alias("crowded"))


def _with_texts(pairs: DataFrame, bodies: DataFrame, members: int = _MEMBERS, held: DataFrame | None = None) -> DataFrame:
    """(other, id, the further columns of pairs, body, blocks), sorted: blocks of pairs behind the text of ``other``, which has no id but the number of blocks.

    The pairs of a popular document are dealt into blocks, and its text comes once for each,
    with what ``held`` (other, common) has for it.
    """
    more = [f for f in pairs.schema.fields if f.name not in ("id", "other")]
    sizes = written(pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / F.lit(members)).alias("blocks")), "pair-blocks")
    dealt = pairs.join(sizes, "other").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    heads = sizes.select("other", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(bodies.withColumnRenamed("id", "other"), "other").select("other", "block", F.lit(None).cast("long").alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in more], "body", "blocks")
    paired = dealt.join(bodies, "id").select("other", "block", "id", *[f.name for f in more], "body", F.lit(None).cast("long").alias("blocks"))
    if held is not None:
        heads, paired = heads.join(held, "other", "left"), paired.withColumn("common", F.lit(None).cast("array<long>"))
    rows = heads.unionByName(paired).repartition("other", "block").sortWithinPartitions("other", "block", F.col("id").asc_nulls_first())
    return rows.drop("block").select("other", "id", *[f.name for f in more], "body", "blocks", *([] if held is None else ["common"]))


def _common_keys(asked: DataFrame, bodies: DataFrame, options: tuple) -> DataFrame:
    """(other, common): of heads of more than ``_LINKED`` pairs, the common keys beside their phrases, told by about ``_HEARD`` texts of each."""
    large = asked.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / F.lit(_HEARD)).alias("parts"), F.count(F.lit(1)).alias("n")).where(F.col("n") > _LINKED).drop("n")
    some = asked.join(written(large, "passage-large"), "other").where(F.pmod(F.xxhash64("id"), "parts") == 0).drop("parts")
    told = written(_with_texts(some, bodies, 8 * _HEARD).mapInArrow(lean(_held(*options)), _HELD), "passage-common")
    return written(told.groupBy("other").agg(F.min("common").alias("common")), "passage-common")


def _classes(done: DataFrame) -> DataFrame:
    return components(written(done.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct(), "passage-classes"))


def _asked(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, other, diagonals, label) of crowded links whose head has them with texts of several classes; ``label`` is the class of ``id``."""
    pairs = links.groupBy("id", "other").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"))
    own = written(pairs.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "passage-crowded")
    several = own.groupBy("other").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("other")
    return own.join(several, "other", "left_semi").select("id", "other", "diagonals", "label")


def _beside_links(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(id, other, diagonal): new links between texts of several classes that have a key.

    Of a class's rows with the same words around, the first stands for all.  The rows
    outside of a key's largest class are paired with all of the key, in tiles of
    ``_TILE`` by ``_TILE`` rows where there are more.
    """
    several = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rows = keys.join(written(several, "passage-keys"), "key", "left_semi").groupBy("key", "label", "around").agg(F.min(F.struct("id", "place", "label")).alias("row"))
    rows = written(rows.select("key", "row"), "passage-beside")
    sizes = rows.groupBy("key", F.col("row.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tiles = lambda n: F.ceil(n / F.lit(_TILE))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    most = most.select("key", F.col("most.label").alias("most"), tiles(F.col("all") - F.col("most.n")).alias("outside"), tiles(F.col("all")).alias("tiles"))
    own = lambda n: F.pmod(F.xxhash64("row.id", "row.place"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = rows.join(written(most, "passage-tiles"), "key")
    left = dealt.where("row.label <> most").select("key", "row", "most", own(F.col("outside")).alias("i"), every("tiles").alias("j"))
    right = dealt.select("key", F.col("row").alias("top"), own(F.col("tiles")).alias("j"), every("outside").alias("i"))
    pairs = left.join(right, ["key", "i", "j"]).where("row.label <> top.label and row.id <> top.id and (top.label = most or row.id > top.id)")
    pairs = pairs.select(F.greatest("row", "top").alias("row"), F.least("row", "top").alias("top"))  # by id
    new = pairs.select(F.col("row.id").alias("id"), F.col("top.id").alias("other"), (F.col("row.place") - F.col("top.place")).alias("diagonal")).distinct()
    return new.join(links, ["id", "other", "diagonal"], "left_anti")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, min_words: int = MIN_WORDS, percent: int = PERCENT, hashes: int = HASHES, side: int = SIDE_WORDS) -> DataFrame:
    """(id, other_id, begin_word, end_word, other_begin, other_end, class_id): passages that a document shares with an earlier one.

    Documents that share a passage are told with one of them; all that are linked
    so have the smallest of their ids as ``class_id``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).where("id is not null and body is not null")
    links = written(window_links(texts.mapInArrow(lean(_windows((hashes, k, min_words, side))), _WINDOW), min_words), "passage-links")
    pairs = written(links.groupBy("id", "other").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"), F.sort_array(F.collect_set(F.when(F.col("crowded") == 1, F.col("diagonal")))).alias("crowded")), "passage-pairs")
    ids = written(pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct(), "passage-ids")
    bodies = written(texts.join(broadcast_if_small(ids, ids.count(), 16), "id", "left_semi").dropDuplicates(["id"]), "passage-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return _with_texts(pairs, bodies).mapInArrow(lean(_verify(k, min_words, percent, side)), _FOUND)

    found = written(verified(pairs), "passages")
    # Every interval of words with the first that has the same words.
    beyond = found.where("key is not null").select("key", "id", "begin_word", "keys")
    several = beyond.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    beyond = beyond.join(written(several, "passage-shared"), "key", "left_semi").select("id", "begin_word", F.posexplode("keys").alias("n", "key"))
    beyond = written(beyond.select("key", "id", (F.col("begin_word") + F.col("n")).alias("place")), "passage-beyond")
    first = beyond.groupBy("key").agg(F.min(F.struct("id", "place")).alias("top"), F.max("id").alias("high")).where("high <> top.id").select("key", "top")
    more = beyond.join(written(first, "passage-intervals"), "key").where("id <> top.id")
    more = more.select("id", F.col("top.id").alias("other"), (F.col("place") - F.col("top.place")).alias("diagonal")).distinct()
    more = written(more.join(links, ["id", "other", "diagonal"], "left_anti").groupBy("id", "other").agg(F.collect_set("diagonal").alias("more")), "passage-more-pairs")
    # A pair's diagonals are verified together, so those of the first round come along and its rows are replaced.
    diagonals = F.sort_array(F.array_union("more", F.coalesce("diagonals", F.array().cast("array<long>"))))
    again = more.join(pairs.drop("crowded"), ["id", "other"], "left").select("id", "other", diagonals.alias("diagonals"), F.array().cast("array<long>").alias("crowded"))
    kept = found.where("key is null").join(more.select("id", F.col("other").alias("other_id")), ["id", "other_id"], "left_anti")
    done = written(kept.unionByName(verified(again)).drop("key", "keys"), "passages")
    # Near copies around a crowded key: texts of other classes with the same shingle at one place beside it.
    labels = _classes(done)
    asked = written(_asked(links.where("crowded = 1"), labels), "passage-asked")
    held = _common_keys(asked, bodies, (k, min_words, percent, side))
    keys = written(_with_texts(asked, bodies, _HEARD, held).mapInArrow(lean(_beside(k, min_words, percent, side)), _BESIDE), "passage-keys-beside")
    near = _beside_links(keys, links).groupBy("id", "other").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals")).withColumn("crowded", F.array().cast("array<long>"))
    near = written(verified(written(near, "passage-pairs-beside")).drop("key", "keys"), "passages")
    if near.count():
        done = done.unionByName(near.select(done.columns))
        labels = _classes(done)
    return done.join(labels.withColumnRenamed("label", "class_id"), "id").withColumnRenamed("id", id_col)
