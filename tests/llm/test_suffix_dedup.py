import random
from hashlib import sha256

import numpy as np
import pytest

from symloom.llm.suffix_dedup import bounded_lcp, joined_spans, repeated_runs, repeated_starts, stretches_of, suffix_dedup, suffix_order

DOCS = "doc_id long, text string, t1 string, anchor int, lo string, body int, key string"


def plain_removed(texts, k):
    """For each text the flags of its bytes covered by a string of ``k`` bytes that begins elsewhere too."""
    seen = {}
    for t in texts:
        for p in range(len(t) - k + 1):
            seen[t[p : p + k]] = seen.get(t[p : p + k], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, dtype=np.int64)
        for p in range(len(t) - k + 1):
            if seen[t[p : p + k]] > 1:
                hit[p] += 1
                hit[min(p + k, len(t))] -= 1
        out.append(np.cumsum(hit)[:-1] > 0)
    return out


def plain_rows(rows, k=200):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, gone in zip(rows, texts, plain_removed(texts, k), strict=True):
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out.append((i, len(t), int(gone.sum()), spans, sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(n))


def corpus(seed=4):
    """Exact and near copies, shared passages of 199 to 203 bytes, a line around which texts differ, repeats in one text, periods."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([5, 60, 150])) for _ in range(60)]
    passages = [prose(rng, 60)[:n] for n in (199, 200, 201, 203, 320)]
    for k in range(40):
        p = passages[k % 5]
        texts.append(prose(rng, rng.randint(0, 40)) + p + prose(rng, rng.randint(0, 40)))
    line = prose(rng, 40)[:160]
    for _ in range(60):
        texts.append(prose(rng, 20) + rng.choice(["x", "y"]) * 20 + line + rng.choice(["u", "v"]) * 20 + prose(rng, 20))
    for k in range(12):
        words = texts[70].split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[50], "a" * 199, "a" * 200, "a" * 201, "ab" * 500, "é" * 130, "", "日本" * 40 + passages[4], prose(rng, 50) * 2, "\x00" * 300, passages[1] + passages[1]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, texts[10]), (3, texts[3]), (7, "lone"), (None, None)]
    return rows


@pytest.mark.parametrize(("few", "together"), [(2048, 1 << 20), (3, 2000), (1, 1)])
def test_rows_equal_brute_force(spark, few, together):
    rows = corpus()
    docs = spark.createDataFrame([r + ("x", 1, "y", 2, "z") for r in rows], DOCS).repartition(5)
    got = sorted((tuple(r) for r in suffix_dedup(docs, few=few, together=together).collect()), key=str)
    assert got == plain_rows(rows)


@pytest.mark.parametrize("k", [60, 90])
def test_other_lengths(spark, k):
    rows = corpus(9)[:130]
    docs = spark.createDataFrame([r + ("x", 1, "y", 2, "z") for r in rows], DOCS)
    assert sorted((tuple(r) for r in suffix_dedup(docs, min_bytes=k, gram=20, few=4).collect()), key=str) == plain_rows(rows, k)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    import symloom.llm.suffix_dedup as s

    monkeypatch.setattr(s, "_BLOCK", 500)  # takes effect in this process only
    rng = random.Random(2)
    shared = prose(rng, 300)
    texts = [prose(rng, 400) + shared + prose(rng, 100), shared[100:900] + prose(rng, 500)]
    import pyarrow as pa

    found = []
    for t in texts:
        whole = {}
        for i, at, data, offsets in s._segments(pa.array([t]), 200):
            text, first, last, _, _, _ = stretches_of(data, offsets, 200, 48)
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                for p in range(a, b + 1):
                    assert at + p not in whole and i == 0
                    whole[at + p] = 1
        found.append(len(whole))
    assert found == [len(t) - 199 for t in texts]


def test_texts_that_repeat_a_few_bytes_have_few_rows(spark):
    """A row for each byte of such a text would be more than its bytes."""
    import symloom.llm.suffix_dedup as s

    rng = random.Random(3)
    texts = ["a" * 300_000, "ab" * 100_000 + "x" + "ab" * 50_000, "=-" * 90 + prose(rng, 60) + "\n" * 5000, "".join("line of a table\n" for _ in range(4000)), prose(rng, 3000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5), pa.array(range(5)), pa.array(texts)], names=["t1", "t2", "body"])
    rows = sum(b.num_rows for b in s._anchored(200, 48)(iter([batch])))
    assert rows < sum(map(len, texts[4:])) / 60 + 100
    got = sorted((tuple(r) for r in suffix_dedup(spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in enumerate(texts)], DOCS)).collect()), key=str)
    assert got == plain_rows(list(enumerate(texts)))


def test_runs_of_equal_neighbours():
    kept, last = repeated_runs(np.array([1, 1, 1, 2, 3, 3]), np.array([0, 0, 0, 0, 0, 1]))
    assert kept.tolist() == [0, 2, 3, 4, 5] and last.tolist() == [2, 2, 2, 3, 4, 5]
    assert [x.tolist() for x in repeated_runs(np.zeros(0))] == [[], []]


def test_an_empty_table(spark):
    empty = suffix_dedup(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_common_prefixes_come_from_interval_expansion():
    rng = random.Random(7)
    for limit in (1, 3, 8, 20):
        body = bytes(rng.choices(b"ab", k=150)) + bytes(rng.choices(b"abc", k=50)) * 3
        text = np.frombuffer(body + b"\xff", dtype=np.uint8) + np.uint8(1)
        order = suffix_order(text, limit)
        t = text.tobytes()
        assert [t[i : i + limit] for i in order] == sorted(t[i : i + limit] for i in range(len(t)))
        want = []
        for a, b in zip(order[:-1], order[1:], strict=True):
            k = 0
            while k < limit and t[a + k : a + k + 1] == t[b + k : b + k + 1] != b"":
                k += 1
            want.append(k if k < limit else -1)
        assert bounded_lcp(text, order, limit)[1:].tolist() == want


def test_starts_do_not_cross_gaps():
    a, b = bytes(range(65, 91)), bytes(range(97, 123))
    assert [s.tolist() for s in repeated_starts([a + b, b, a, b[:9], a[5:] + b], 10)] == [list(range(0, 43)), list(range(17)), list(range(17)), [], list(range(38))]
    assert [s.tolist() for s in repeated_starts([b"aaaaaaa"], 5)] == [[0, 1, 2]]


def test_spans_are_joined():
    begin, end = joined_spans(np.array([9, 0, 3, 20]), np.array([12, 5, 9, 21]))
    assert (begin.tolist(), end.tolist()) == ([0, 20], [12, 21])


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    shared = prose(rng, 80)
    texts = [(prose(rng, 5) + shared + prose(rng, 9)).encode(), (prose(rng, 30) + shared).encode(), b"q" * 400]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, first, last, anchor, at, _ = stretches_of(data, offsets, 200, 48)
    of = {}
    for k in range(len(text)):
        assert last[k] - first[k] < 153 and first[k] <= at[k]
        for p in range(first[k], last[k] + 1):
            of.setdefault(bytes(data[p : p + 200]), set()).add((int(anchor[k]), int(at[k] - p)))
    assert all(len(v) == 1 for v in of.values())
