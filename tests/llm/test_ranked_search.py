import math
import random
import re

import numpy as np
import pytest

from symloom.llm.ranked_search import Corpus, Shard, _shards, ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score long, rank int, item_id string"


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    bags = [(i, plain_terms(t)) for i, t in docs]
    filled = [b for _, b in bags if b]
    n_docs, total = len(filled), sum(map(len, filled))
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for i, bag in bags:
            s = 0
            for t in set(plain_terms(text)):
                if tf := bag.count(t):
                    m = 100 - 90 + (90 * len(bag) * n_docs) // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["É", "é", "straße", "x_y", "a-b", "Tab\tcut", "10", "日本", "nul\x00nul"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 60])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "!? --"), (None, rows[0][1]), (3, rows[5][1]), (3, rows[5][1]), (n + 3, "W1 " * 3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "nowhere at all"), (1, "W1 w1 straße"), (1, "W1 w1 straße"), (None, "10 é")]
    return rows, items


@pytest.mark.parametrize(("n", "block_terms"), [(300, 50_000), (120, 7)])
def test_ranks_equal_plain_scores(spark, n, block_terms):
    rows, items = corpus(n)
    docs = spark.createDataFrame([r + (7, 7, "x") for r in rows], DOCS).repartition(5)
    asked = spark.createDataFrame([i + ("x", 1) for i in items], "item_id long, text string, doc_id string, score int")
    got = sorted((tuple(r) for r in ranked_search(docs, asked, block_terms=block_terms).collect()), key=str)
    assert got == plain_search(rows, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, 1, "")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs, items.limit(0)).count() == 0
    empty = ranked_search(docs.limit(0), items)
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == [(1, 1, 1, plain_search([(1, "a b")], [(1, "a")])[0][3])]


def made_shard(n=20_000, seed=2):
    """Documents of few common terms; term 0 is rare."""
    rng = np.random.default_rng(seed)
    sizes = np.full(n, 6)
    terms = np.concatenate([np.sort(np.append(rng.choice(np.arange(1, 40), 5, replace=False), 0 if i % 500 == 0 else 40)) for i in range(n)]).astype(np.int32)
    tfs = rng.integers(1, 4, len(terms)).astype(np.int32)
    weights = np.array([6000, *[60 + t for t in range(1, 41)]], dtype=np.int64)
    return Shard(np.arange(n).astype(object), rng.integers(5, 900, n), sizes, terms, tfs, Corpus(n, 450 * n, weights)), terms.reshape(n, 6)


def test_a_query_stops_before_the_long_lists():
    shard, terms = made_shard()
    query = np.array([0, 3, 9, 17])
    own = shard.own_impacts.reshape(-1, 6)
    scores = np.where(np.isin(terms, query), own, 0).sum(axis=1)
    want = sorted(((-int(s), d) for d, s in enumerate(scores) if s > 0))[:10]
    assert shard.best(query, 10) == [(d, -s) for s, d in want]
    all_postings = sum(int(shard.first[t + 1] - shard.first[t]) for t in query)
    assert 0 < shard.touched < all_postings / 10


def test_groups_are_taken_whole_and_ties_are_complete():
    n = 500
    shard = Shard(np.arange(n)[::-1].astype(object), np.full(n, 10), np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int32), np.ones(n, dtype=np.int32), Corpus(n, 10 * n, np.array([5], dtype=np.int64)))
    assert [d for d, _ in shard.best(np.array([0]), 10)] == [n - 1 - i for i in range(10)] and shard.touched == n


def test_shards_are_bounded(monkeypatch):
    import pyarrow as pa

    import symloom.llm.ranked_search as r

    monkeypatch.setattr(r, "SHARD_DOCS", 7)
    monkeypatch.setattr(r, "SHARD_POSTINGS", 20)
    lists = [[1] * k for k in (3, 0, 50, 5, 5, 5, 5, 5, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
    whole = pa.RecordBatch.from_pydict({"id": list(range(len(lists))), "n": [9] * len(lists), "terms": lists, "tfs": lists})
    got = list(_shards(iter([whole.slice(0, 4), whole.slice(4, 0), whole.slice(4)])))
    assert [i for s in got for i in s[0]] == list(range(len(lists))) and [int(x) for s in got for x in s[2]] == [len(x) for x in lists]
    assert all(len(s[0]) <= 7 and (len(s[3]) <= 20 or len(s[0]) == 1) for s in got)


def test_terms():
    assert terms_of("Ab_c-É9\x7fx y") == plain_terms("Ab_c-É9\x7fx y") == ["ab", "c", "É9", "x y"]
