import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symloom.llm import minhash_dedup
from symloom.llm.exact_dedup import RadixTrie, exact_dedup
from symloom.llm.graph import components, stars
from symloom.llm.kernels import Words, ngrams, stretches, text_blocks
from symloom.llm.line_dedup import RunStore, build_runs, drop_common_lines, line_dedup, line_hashes
from symloom.llm.minhash_dedup import drop_near_duplicates, near_dedup
from symloom.llm.substring_dedup import intervals_beyond, passages_of

DOCS = "doc_id long, text string, kept string, group_size int"
SPACE = " \t\n\x0b\x0c\r"


def docs_of(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)


def split_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({ord(c): " " for c in SPACE}).split(" ") if w]


# ---- kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b,日", max_size=30), max_size=6))
def test_words_equal_plain_splitting(texts):
    plain = [split_words(t) for t in texts]
    seen = {}
    for _, _, data, offsets in text_blocks(pa.array(texts, pa.string()), 1 << 30):
        words = Words(data, offsets)
        assert words.counts().tolist() == [len(p) for p in plain]
        for h, w in zip(words.hashes.tolist(), [w for p in plain for w in p], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_blocks_cover_all_rows_whatever_their_size():
    array = pa.array(["a" * 50, None, "", "b" * 3, "c" * 200, "d"], pa.string()).slice(1)
    got = [(i, j, bytes(d)) for i, j, d, _ in text_blocks(array, 10)]
    assert [g[:2] for g in got] == [(0, 3), (3, 4), (4, 5)] and b"".join(g[2] for g in got) == b"bbb" + b"c" * 200 + b"d"
    assert list(text_blocks(pa.array([], pa.string()))) == []


def test_segments_do_not_change_hashes():
    long = ("word " * 200_000 + "z" * 600_000).encode()
    words = Words(np.frombuffer(long, np.uint8), np.array([0, len(long)]))
    assert len(set(words.hashes[:-1].tolist())) == 1 and len(words.hashes) == 200_001


def test_ngrams_and_stretches():
    h = np.array([1, 2, 1, 2, 3], np.uint64)
    g = ngrams(h, 2)
    assert len(g) == 4 and g[0] == g[2] != g[1] and len(ngrams(h, 6)) == 0
    assert stretches(np.array([1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1], bool), 20, 80) == [(0, 9), (12, 13)]
    assert stretches(np.zeros(3, bool), 1, 1) == []


# ---- exact dedup


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=40), st.booleans())
def test_trie_equals_a_dictionary(keys, largest):
    trie, plain = RadixTrie(largest), defaultdict(list)
    for i, k in enumerate(keys):
        trie.insert(k, i)
        plain[k].append(i)
    assert {k: (o, n) for k, o, n in trie.terminals()} == {k: ((max if largest else min)(v), len(v)) for k, v in plain.items()}


@pytest.mark.parametrize("keep, budget", [("largest", 16 << 20), ("smallest", 1), ("largest", 1)])
def test_exact_dedup(spark, keep, budget):
    rng = random.Random(3)
    texts = [rng.choice(["", None, "a", "ab", "abc", "A", "é" * 4000, "x" * 300_000]) for _ in range(200)]
    found = {r.doc_id: r for r in exact_dedup(docs_of(spark, enumerate(texts)).repartition(5), keep=keep, subtree_bytes=budget).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        own = groups[t or ""]
        owner = (max if keep == "largest" else min)(own)
        assert (found[i].keep_id, found[i].group_size, found[i].kept) == (owner, len(own), i == owner)
        assert found[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_empty_null_ids_and_repeated_rows(spark):
    assert exact_dedup(docs_of(spark, [])).count() == 0
    rows = exact_dedup(docs_of(spark, [(None, "a"), (1, "a"), (1, "a"), (None, "b")])).collect()
    assert sorted((r.text_sha256[:4], r.keep_id or -1, r.group_size) for r in rows) == sorted([(hashlib.sha256(b"a").hexdigest()[:4], 1, 3)] * 3 + [(hashlib.sha256(b"b").hexdigest()[:4], -1, 1)])


# ---- line dedup


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    lost = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if i >= lost.get(key(x), i)]
        out[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["A line that is long enough", "  a LINE that is long enough \t", "short", "", "ÉÉ" * 10 + " x", "éé" * 10 + " x", "exactly twenty chars", "nineteen characters", "\x0bA line that is long enough\r"]
    rows = [(i * 3, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) or None) for i in range(60)]
    rows += [(500, ""), (501, "long " * 40_000), (502, "long " * 40_000), (503, "long " * 40_000)]
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs_of(spark, rows), batches=3).collect()}
    assert found == plain_lines(rows)
    kept = drop_common_lines(docs_of(spark, rows), batches=2)
    assert kept.columns == ["doc_id", "text", "kept", "group_size"]
    assert {r.doc_id: r.text or "" for r in kept.collect()} == {i: v[2] for i, v in found.items()}


def test_line_dedup_empty_and_null_ids(spark):
    assert line_dedup(docs_of(spark, [])).count() == 0
    line = "a line that everybody has"
    rows = {r.doc_id: r.n_dropped for r in line_dedup(docs_of(spark, [(None, line), (1, line), (2, line), (3, line)])).collect()}
    assert rows == {None: 0, 1: 1, 2: 1, 3: 0}


def test_line_dedup_of_far_ids_repeated_rows_and_many_lines(spark):
    """Ids at both ends of a long, equal rows, one id with two texts, and 20,000 common lines in each of three texts."""
    many = "\n".join(f"this is the common line {k}" for k in range(20_000))
    rows = [(-(2**63), many), (5, many + "\nshort"), (2**63 - 1, many)]
    found = {r.doc_id: r for r in line_dedup(docs_of(spark, rows)).collect()}
    assert {i: r.n_dropped for i, r in found.items()} == {-(2**63): 20_000, 5: 20_000, 2**63 - 1: 0}
    assert found[5].kept_text == "short" and found[2**63 - 1].kept_text == many and found[5].n_lines == 20_001
    line = "a line that everybody has"
    rows = [(1, line), (1, line), (1, f"own\n{line}"), (2, line), (3, f"{line}\nend")]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs_of(spark, rows)).collect()) == [(1, 1, 1, ""), (1, 1, 1, ""), (1, 2, 1, "own"), (2, 1, 1, ""), (3, 2, 0, f"{line}\nend")]


def test_the_query_compacts_its_runs(spark):
    docs = docs_of(spark, [(i, f"this line is in all of them\nthis one has a number {i}") for i in range(40)])
    store, _ = build_runs(docs)
    assert len(store.levels) == 2 and len(store.levels[1]) == 1 and len(store.runs) == 2
    assert max((r.n_docs, r.top_doc) for r in store.totals().collect()) == (40, 39)


def test_runs_are_levelled(spark):
    store = RunStore(spark, fanout=2)
    docs = docs_of(spark, [(i, f"this line is in all of them\nthis one has a number {i}") for i in range(5)])
    for i in (4, 3, 2, 1, 0):
        batch = line_hashes(docs.where(F.col("doc_id") == i), "doc_id", "text")
        assert store.unseen(batch).count() == (2 if i == 4 else 1)
        store.add(batch)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    totals = store.totals().collect()
    assert len(totals) == 6 and max((r.n_docs, r.top_doc) for r in totals) == (5, 4)


# ---- near dedup


def plain_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = split_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_all_pairs(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(260):
        if base and rng.random() < 0.7:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 3, 40, 120]))
            base.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "z " * 30_000), (1006, "z " * 29_000)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs_of(spark, rows), k=k).collect()}
    assert found == plain_components(rows, k)
    left = drop_near_duplicates(docs_of(spark, rows), k=k)
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in found.items() if i == c} and left.columns == ["doc_id", "text", "kept", "group_size"]


def edited(rng, base, n, edits):
    """Copies of ``base`` with as many words replaced as ``edits`` draws."""
    rows = []
    for i in range(n):
        words = list(base)
        for j in range(edits(rng)):
            words[rng.randrange(len(words))] = f"own{i}x{j}"
        rows.append(" ".join(words))
    return rows


@pytest.mark.parametrize("least, most", [(0, 24), (16, 18)])
def test_near_dedup_of_one_group_on_both_sides_of_the_threshold(spark, monkeypatch, least, most):
    """Dealt into many small tiles, with one pivot for a star; a task gives fewer links than it has rows."""
    monkeypatch.setattr(minhash_dedup, "TILE_SHINGLES", 6_000)
    monkeypatch.setattr(minhash_dedup, "TILE_ROWS", 50)
    given = []
    real = minhash_dedup.components
    monkeypatch.setattr(minhash_dedup, "components", lambda links: given.append(links.count()) or real(links))
    rng = random.Random(least)
    base = [f"w{rng.randrange(5000)}" for _ in range(240)]
    rows = list(enumerate(edited(rng, base, 220, lambda r: r.randrange(least, most))))
    rng.shuffle(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs_of(spark, rows), k=2).collect()}
    assert found == plain_components(rows, 2)
    assert max(given) < 3 * len(rows)


def test_near_dedup_empty_null_ids_and_repeated_rows(spark):
    assert near_dedup(docs_of(spark, [])).count() == 0
    rows = [(r.doc_id, r.component_id, r.kept) for r in near_dedup(docs_of(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (5, "a b c")]), k=2).collect()]
    assert sorted(rows, key=str) == sorted([(None, None, True), (2, 2, True), (2, 2, True), (5, 2, False)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_stars(links):
    a, b = (np.array([x[i] for x in links]) for i in range(2))
    label = {int(n): int(n) for n in {*a.tolist(), *b.tolist()}}
    for _ in links:
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    nodes, low = stars(a, b)
    assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == label


def test_components_beyond_a_chunk(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 103), (7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(4)
    for chunk in (1_000_000, 3):
        found = {r.id: r.label for r in components(edges, chunk).collect()}
        assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def _plain_intervals(a, b, diagonals, side, n_words, k, percent):
    """Every start of an interval around equal words that is no passage, one by one."""
    mine, others = set(), set()
    for d in diagonals:
        same = {i for i in range(max(0, d), min(len(a), len(b) + d)) if a[i] == b[i - d]}
        grams = {i for i in same if all(j in same for j in range(i, i + k))}
        n = n_words - k + 1
        for at in range(-n_words, len(a) + n_words):
            inside = [i in same for i in range(at, at + n_words)]
            runs = "".join("1" if x else "0" for x in inside).split("0")
            if max(map(len, runs)) < side:
                continue
            hits = sum(i in grams for i in range(at, at + n))
            if 100 * hits >= percent * (2 * n - hits) and at in grams and at + n - 1 in grams:
                continue
            mine |= {at} if 0 <= at <= len(a) - n_words else set()
            others |= {at - d} if 0 <= at - d <= len(b) - n_words else set()
    return mine, others


def test_intervals_of_many_diagonals_are_those_of_each():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.integers(0, 40, 70).astype(np.uint64)
        b = np.concatenate([rng.integers(40, 80, rng.integers(0, 9)).astype(np.uint64), a[rng.integers(0, 20) :]])
        b[rng.integers(0, len(b), 5)] = 99
        diagonals = [0, int(rng.integers(-9, 20)), 3, len(a) - len(b)]
        got = intervals_beyond(a, b, sorted(set(diagonals)), 6, 14, 3, 80)
        want = _plain_intervals(a.tolist(), b.tolist(), sorted(set(diagonals)), 6, 14, 3, 80)
        assert tuple(set(g.tolist()) for g in got) == want


def test_equal_texts_are_one_passage_and_self_repeats_end():
    words = np.tile(np.arange(7, dtype=np.uint64), 20)
    assert passages_of(words, words.copy(), [0, 7, -7], 5, 50, 80) == [(0, 140, 0, 140)]
    one = np.full(3000, 4, dtype=np.uint64)
    assert passages_of(one, one[:2000], [0], 5, 50, 80)[0][1] == 2000


def beside(texts, labels, blocks):
    """Rows of one head's pairs, each with the head's first words."""
    from symloom.llm.substring_dedup import _beside

    n = len(texts)
    columns = [pa.array([0] * n), pa.array([None, *range(1, n)], pa.int64()), pa.array([None] + [[0]] * (n - 1), pa.list_(pa.int64())), pa.array([None, *labels], pa.int64()), pa.array(texts), pa.array([blocks] + [None] * (n - 1), pa.int64())]
    batch = pa.RecordBatch.from_arrays(columns, names=["other", "id", "diagonals", "label", "body", "blocks"])
    return [row for b in _beside(5, 50, 80, 16)(iter([batch])) for row in b.to_pylist()]


def test_shingles_beside_a_phrase_of_one_class_end_in_the_task_of_all_their_head():
    texts = [" ".join(f"{x}{i}" for x, n in (("p", 40), (own, 60)) for i in range(n)) for own in "haab"]
    assert beside(texts, [1, 1, 2], 1) == [] and {r["id"] for r in beside(texts, [1, 1, 2], 2)} == {1, 3}
    both = beside(texts, [1, 2, 3], 1)
    assert {r["id"] for r in both} == {1, 2} and both == [r for r in beside(texts, [1, 2, 3], 2) if r["id"] != 3]


def test_runs_of_intervals_keep_all_keys_and_meet_where_words_are_equal():
    from symloom.llm.kernels import Runs
    from symloom.llm.substring_dedup import _shared_runs

    rng = np.random.default_rng(3)
    one, two = (rng.integers(0, 1 << 60, 300).astype(np.uint64) for _ in range(2))
    two[100:190] = one[20:110]
    met = []
    for words, at in ((one, np.arange(0, 200)), (two, np.append(np.arange(3, 30), np.arange(90, 250)))):
        first, near, size, keys = _shared_runs(words, at, 50)
        assert keys.tolist() == Runs(words).of(at, at + 50).tolist() and size.sum() == len(at) and len(first) < len(at) / 4
        met.append(dict(zip(keys.tolist(), np.repeat(near, size).tolist(), strict=True)))
    shared = met[0].keys() & met[1].keys()
    assert len(shared) == 41 and all(met[0][k] == met[1][k] for k in shared)


def test_nearest_smaller_and_order_equal_plain_ones():
    from symloom.llm.substring_dedup import _nearest_smaller, _order

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 400):
        values, owner = rng.permutation(n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        before, after = _nearest_smaller(values, owner)
        for k in range(n):
            smaller = [j for j in range(n) if owner[j] == owner[k] and values[j] < values[k]]
            assert before[k] == max([j for j in smaller if j < k], default=-1) and after[k] == min([j for j in smaller if j > k], default=-1)
        key, then, last = (rng.integers(0, 6, n) for _ in range(3))
        order, want = _order(key, then, last), np.lexsort((last, then, key))
        assert all(c[order].tolist() == c[want].tolist() for c in (key, then, last))


@pytest.mark.parametrize("tile", [512, 3])
def test_all_rows_of_a_shingle_beside_a_phrase_are_paired(spark, monkeypatch, tile):
    """40 texts in 21 classes: none is linked with the first only."""
    from symloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "_TILE", tile)
    rows = [(7, i, 100 * i, min(i, 20), i) for i in range(40)] + [(8, 1, 0, 1, 0), (8, 2, 0, 1, 1)]
    keys = spark.createDataFrame(rows, "key long, id long, place long, label long, around long")
    links = spark.createDataFrame([(3, 1, 200)], "id long, other long, diagonal long")
    got = [tuple(r) for r in substring_dedup._beside_links(keys, links).collect()]
    want = {(a, b, 100 * (a - b)) for a in range(40) for b in range(a) if b < 20} - {(3, 1, 200)}
    assert len(got) == len(set(got)) and set(got) == want


def test_shingles_that_are_common_beside_a_phrase_come_last():
    import numpy as np

    from symloom.llm.substring_dedup import shingles_beyond

    rng = np.random.default_rng(5)
    b = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    a = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    a[25:65] = b[25:65]
    every = shingles_beyond(a, b, [0], 16, 50, every=True)[2]
    first = shingles_beyond(a, b, [0], 16, 50)[2]
    assert set(first) < set(every)
    last = shingles_beyond(a, b, [0], 16, 50, common=first)[2]
    assert set(last) <= set(every) and set(first) - set(last) and set(last) - set(first)
    assert set(shingles_beyond(a, b, [0], 16, 50, common=every[:0])[2]) == set(first)
