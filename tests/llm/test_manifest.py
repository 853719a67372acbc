import random
import zlib
from hashlib import sha256

import pytest

from symloom.llm.merkle_manifest import Mountains, Node, digest_of, grow, leaf_of, manifest, proofs, tampered_leaf

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, number long, run string, total int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout=3):
    """(root, the siblings of each leaf by level) of one tree."""
    paths, where, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf, at in enumerate(where):
            run = runs[at // fanout]
            paths[leaf].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
            where[leaf] = at // fanout
        level = [h(*run) for run in runs]
    return level[0], paths


def plain_leaf(row, text):
    values = (*row[:4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_proofs(rows, fanout=3):
    groups = {}
    for row in rows:
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
        text = row[4].replace("\n", "") if hit else row[4]
        groups.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), plain_leaf(row, row[4]), row[0], plain_leaf(row, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s])], fanout) for s in names}
    if not rows:
        return []
    root, tops = plain_tree([trees[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, leaf, doc_id, changed), own in zip(sorted(groups[s]), trees[s][1], strict=True):
            path = own + top
            reached = changed
            for left, right in path:
                reached = h(left, reached, right)
            out.append((doc_id, leaf, trees[s][0], root, h(*[x for level in path for x in level]), reached, reached == root))
    return sorted(out, key=str)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "é", "b", "", None]), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["x\ny", "", None, "ß\n\n" * 9, "plain"])) for i in rng.sample(range(10 * n + 1), n)]
    rows += [rows[0], rows[0], (None, "a", None, None, "n\nn"), (None, None, None, None, None), (-7, "lone", "en", 1, "one\nline")] if n else []
    return [r + ("x", 4, "y", 5) for r in rows]


@pytest.mark.parametrize(("n", "run", "fanout", "step"), [(60, 5, 3, 1), (200, 7, 3, 1), (200, 4, 2, 2), (90, 2048, 3, 5), (0, 5, 3, 1)])
def test_proofs_equal_plain_trees(spark, n, run, fanout, step):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    made = manifest(docs, changed=tampered_leaf(), run=run, fanout=fanout, step=step)
    got = sorted((tuple(r) for r in proofs(made).collect()), key=str)
    assert got == plain_proofs(rows, fanout)
    assert n == 0 or {r[6] for r in got} == {True, False}


def test_node_records_are_all_nodes_above_the_leaves(spark):
    n, run = 100, 9
    leaves = spark.createDataFrame([("g", i, h(str(i))) for i in range(n)] + [("one", 0, h("x"))], "grp string, id long, leaf string")
    forest = grow(leaves, ["id"], run=run, step=1)
    got = {(r.grp, r.level, r.number): r.digest for r in forest.nodes.collect()}
    want, level, k = {}, [h(str(i)) for i in range(n)], 0
    while len(level) > 1:
        level, k = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], k + 1
        want |= {("g", k, i): d for i, d in enumerate(level)}
    assert got == want and forest.nodes.count() == len(want)
    assert {(r.grp, r.digest, r.total) for r in forest.roots.collect()} == {("g", level[0], n), ("one", h("x"), 1)}


def test_indexed_partitions_hold_few_peaks():
    """However many leaves a stack takes, what it leaves to merge grows with the height alone."""
    for total, begin in ((5000, 1), (50_000, 12_345)):
        stack = Mountains(total)
        for i in range(begin, begin + 2048):
            if i < total:
                stack.push(Node(0, i, "d"))
        assert len(stack.peaks) <= 4 * len(stack.widths)


def test_last_runs_are_hashed_short():
    stack = Mountains(4)
    for i, d in enumerate("abcd"):
        stack.push(Node(0, i, d))
    assert [n.digest for n in stack.peaks] == [h(h("abc"), h("d"))] == [digest_of([h("abc"), digest_of(["d"])])]


def test_a_leaf_tells_null_from_empty(spark):
    rows = [(1, None), (2, ""), (3, "-"), (4, "é")]
    got = {r.i: r.d for r in spark.createDataFrame(rows, "i long, t string").select("i", leaf_of(["t"]).alias("d")).collect()}
    assert got == {1: h("-"), 2: h("0:"), 3: h("1:-"), 4: h("2:é")}
