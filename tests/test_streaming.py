import json
import random

import pytest

from symloom.sources.snapshots import SnapshotStore
from symloom.streaming import incremental
from symloom.streaming.incremental import FILE_EVENTS, Baseline, apply_batch, follow


@pytest.fixture()
def stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        query = follow(spark, str(inbox), f"file://{tmp_path}/state", str(tmp_path / "checkpoint"))
        query.awaitTermination()

    def send(name, *events):
        (inbox / name).write_text("".join(json.dumps(dict(zip(("path", "sha", "seq"), e, strict=True))) + "\n" for e in events))
        run()

    return send, run, Baseline(SnapshotStore(spark, f"file://{tmp_path}/state"))


def shas(df):
    return {r.path: r.sha for r in df.collect()}


def test_batches_follow_each_other(stream):
    send, _, baseline = stream
    send("1.json", ("a", "1", 1), ("a", "2", 2), ("b", "1", 1))
    send("2.json", ("a", "2", 3), ("b", None, 4), ("c", "1", 5), (None, "x", 6))
    assert shas(baseline.rows()) == {"a": "2", "c": "1"} and baseline.batch() == 1
    assert {(r.path, r.status) for r in baseline.changes(1).collect()} == {("b", "deleted"), ("c", "added")}
    assert {(r.path, r.status) for r in baseline.changes(0).collect()} == {("a", "added"), ("b", "added")}


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_batch_that_is_run_again_counts_once(stream, monkeypatch, where):
    """A failure before the commit, and one after it but before the stream knows."""
    send, run, baseline = stream
    send("1.json", ("a", "1", 1), ("b", "1", 1))
    commit = SnapshotStore.commit

    def failing(self, *args, **options):
        if where == "after":
            commit(self, *args, **options)
        raise RuntimeError("lost")

    monkeypatch.setattr(SnapshotStore, "commit", failing)
    with pytest.raises(Exception, match="lost"):
        send("2.json", ("a", "2", 2), ("b", None, 2), ("c", "1", 2))
    monkeypatch.undo()
    assert baseline.batch() == (0 if where == "before" else 1)
    run()
    assert shas(baseline.rows()) == {"a": "2", "c": "1"} and baseline.batch() == 1
    assert {(r.path, r.status) for r in baseline.changes(1).collect()} == {("a", "changed"), ("b", "deleted"), ("c", "added")}
    assert len(baseline.store.versions()) == 2


def test_a_small_batch_writes_little(spark, tmp_path):
    baseline = Baseline(SnapshotStore(spark, f"file://{tmp_path}/s"))
    baseline.apply(spark.range(100_000).selectExpr("concat('p', id) path", "'0' sha", "id seq"), 0)
    before = {p.folder for parts in baseline.store.manifest().tables.values() for p in parts}
    baseline.apply(spark.createDataFrame([(f"p{i * 9999}", "1", i) for i in range(9)] + [("new", "1", 1)], FILE_EVENTS), 1)
    new = [p for parts in baseline.store.manifest().tables.values() for p in parts if p.folder not in before]
    assert sum(p.rows for p in new) == 20 and baseline.rows().where("sha = '1'").count() == 10 and baseline.rows().count() == 100_001


def test_random_batches_equal_plain_merging(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SMALLEST", 4)
    rng = random.Random(3)
    baseline, state, most = Baseline(SnapshotStore(spark, f"file://{tmp_path}/s")), {}, 0
    for number in range(14):
        events = [(f"p{rng.randrange(40)}", rng.choice([None, "1", "2", "3"]), s) for s in range(rng.randint(0, 6))]
        baseline.apply(spark.createDataFrame(events, FILE_EVENTS), number)
        for path, sha, _ in events:
            state[path] = sha
        state = {p: s for p, s in state.items() if s is not None}
        most = max(most, len(baseline.store.manifest().tables["baseline"]))
        if number in (5, 13):
            assert shas(baseline.rows()) == state
    assert most <= 3 * incremental.FANOUT
    some = spark.createDataFrame([("p1",), ("p2",), ("nowhere",)], "path string")
    assert shas(baseline.rows(some)) == {p: s for p, s in state.items() if p in ("p1", "p2")}


def test_a_version_names_the_changes_of_the_last_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "NAMED", 2)
    baseline = Baseline(SnapshotStore(spark, f"file://{tmp_path}/s"))
    for number in range(3):
        baseline.apply(spark.createDataFrame([("p", str(number), 0)], FILE_EVENTS), number)
    assert [baseline.changes(n).count() for n in range(3)] == [0, 1, 1]
    assert len(baseline.store.manifest(1).tables["changes"]) == 1 and shas(baseline.rows()) == {"p": "2"}


def test_empty_batch_changes_nothing(spark):
    base = spark.createDataFrame([("a", "1")], "path string, sha string")
    merged, changes = apply_batch(base, spark.createDataFrame([], "path string, sha string, seq long"))
    assert merged.count() == 1 and changes.count() == 0
