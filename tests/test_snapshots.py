import pytest
from pyspark.sql import functions as F

from symloom.schemas import CLAIM_SYMBOLS, CLAIMS, COMMITS, META, SOURCE_SHAS, SYMBOLS
from symloom.sources.artifact import ArtifactError
from symloom.sources.snapshots import FORMAT, ConflictError, SnapshotStore, append_rows, migrate, open_tables, save_tables

OLD_SYMBOLS = "id string, name string, kind string, path string, line int, signature string, file_sha string"


def knowledge(spark, n=3, line=1):
    ids = [f"sym:{'py' if i % 2 else 'ts'}:p{i}.x:N{i}" for i in range(n)]
    return {
        "symbols": spark.createDataFrame([(s, f"N{i}", "class", f"p{i}.x", line, None, None, "0", "typescript") for i, s in enumerate(ids)], SYMBOLS),
        "claims": spark.createDataFrame([(i, "A", "a.md", "0", "hard", f"c{i}", None, None) for i in range(n)], CLAIMS),
        "claim_symbols": spark.createDataFrame([(i, s) for i, s in enumerate(ids)], CLAIM_SYMBOLS),
        "commits": spark.createDataFrame([("x", "d", "m", "e")], COMMITS),
        "file_commits": spark.createDataFrame([("f", "x")], "file_path string, commit_sha string"),
        "source_shas": spark.createDataFrame([("a.md", "0")], SOURCE_SHAS),
        "meta": spark.createDataFrame([("version", "1.3")], META),
    }


def contents(tables):
    return {name: sorted(map(str, rows.collect())) for name, rows in tables.items()}


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def test_versions_stay_readable(spark, store):
    assert store.versions() == [] and store.manifest() is None
    first = save_tables(store, one := knowledge(spark), run="1")
    second = save_tables(store, two := knowledge(spark, 5, line=9), run="2")
    assert store.versions() == [1, 2] and (first.version, second.version, second.format) == (1, 2, FORMAT)
    assert contents(open_tables(store, 1)) == contents(one) and contents(open_tables(store)) == contents(two)
    assert store.manifest(1).properties == {"run": "1"} and store.manifest().properties == {"run": "2"}
    assert [p.rows for p in store.manifest().tables["symbols"]] == [5]
    with pytest.raises(KeyError):
        open_tables(store, 3)


def test_a_run_killed_after_any_table_reads_as_the_old_version(spark, store, monkeypatch):
    """After so many written tables, before the commit, and while the manifest is written."""
    save_tables(store, knowledge(spark))
    before = contents(open_tables(store))
    write, create = SnapshotStore.write, type(store.files).create
    new = knowledge(spark, 6)
    for after in range(9):
        done = []

        def killed(self, name, rows, **notes):
            if len(done) == after:
                raise KeyboardInterrupt
            done.append(name)
            return write(self, name, rows, **notes)

        def not_renamed(self, name, text):
            create(self, name.replace("versions/", "versions/x.") + ".draft", text[: len(text) // 2])
            raise KeyboardInterrupt

        monkeypatch.setattr(SnapshotStore, "write", killed)
        if after >= 7:
            monkeypatch.setattr(type(store.files), "create", not_renamed)
        with pytest.raises(KeyboardInterrupt):
            save_tables(store, new)
        monkeypatch.undo()
        assert store.versions() == [1]
        lost = store.vacuum()
        assert len(lost) == min(after, 7) + (after >= 7)
        if after in (3, 8):
            assert contents(open_tables(store)) == before
    save_tables(store, new)
    assert open_tables(store)["symbols"].count() == 6 and store.versions() == [1, 2]


def test_a_commit_with_broken_links_never_appears(spark, store):
    tables = knowledge(spark)
    save_tables(store, tables)
    with pytest.raises(ArtifactError):
        save_tables(store, {"symbols": tables["symbols"].limit(1)})
    with pytest.raises(ArtifactError):
        save_tables(store, {"claims": tables["claims"].limit(0)})
    assert store.versions() == [1] and len(store.vacuum()) == 2


def test_of_two_writers_the_second_fails(spark, store):
    base = save_tables(store, knowledge(spark))
    won = store.commit(base, {"meta": [store.write("meta", spark.createDataFrame([("a", "1")], META))]}, FORMAT)
    with pytest.raises(ConflictError):
        store.commit(base, {"meta": [store.write("meta", spark.createDataFrame([("a", "2")], META))]}, FORMAT)
    assert store.versions() == [1, 2] and [r.value for r in open_tables(store)["meta"].collect()] == ["1"] and won.version == 2
    # Also where the other's manifest appears between the look and the rename.
    store.files.create("versions/000000003.json", won.text())
    known = store.versions
    store.versions = lambda: known()[:-1]
    with pytest.raises(ConflictError):
        store.commit(won, {}, FORMAT)
    assert not [n for n in store.files.names("versions") if n.endswith(".draft")]


def test_untouched_tables_keep_their_parts(spark, store):
    one = save_tables(store, knowledge(spark))
    two = save_tables(store, {"source_shas": spark.createDataFrame([("a.md", "1")], SOURCE_SHAS)})
    assert {n for n in one.tables if one.tables[n] != two.tables[n]} == {"source_shas"}
    three = append_rows(store, "source_shas", spark.createDataFrame([("b.md", "2")], SOURCE_SHAS))
    assert three.tables["source_shas"][:1] == two.tables["source_shas"] and open_tables(store)["source_shas"].count() == 2


def old_store(spark, store):
    """A store of the first format: no history, no parents, no languages."""
    t = knowledge(spark)
    t["symbols"] = t["symbols"].select(*[c.split()[0] for c in OLD_SYMBOLS.split(", ")])
    parts = {n: [store.write(n, t[n])] for n in ("symbols", "claims", "claim_symbols", "source_shas", "meta")}
    return store.commit(None, parts, 1)


def test_an_old_store_is_migrated_step_by_step(spark, store):
    first = old_store(spark, store)
    in_plan = open_tables(store)
    assert store.versions() == [1] and set(in_plan) == set(knowledge(spark))
    last = migrate(store)
    assert store.versions() == [1, 2, 3, 4] and last.format == FORMAT == 4
    assert last.tables["claims"] == first.tables["claims"] and last.tables["symbols"] != first.tables["symbols"]
    new = open_tables(store)
    assert contents(new) == contents(in_plan)
    assert {(r.language, r.parent_id) for r in new["symbols"].collect()} == {("typescript", None), ("python", None)}
    assert new["commits"].count() == 0 and migrate(store) == last


def test_a_migration_that_is_cut_off_goes_on(spark, store, monkeypatch):
    old_store(spark, store)
    write, calls = SnapshotStore.write, []

    def killed(self, name, rows, **notes):
        calls.append(name)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return write(self, name, rows, **notes)

    monkeypatch.setattr(SnapshotStore, "write", killed)
    with pytest.raises(KeyboardInterrupt):
        migrate(store)
    monkeypatch.undo()
    assert store.manifest().format == 3
    assert migrate(store).format == 4 and calls == ["commits", "file_commits", "symbols", "symbols"]


def test_saving_into_an_old_store_migrates_it_first(spark, store):
    old_store(spark, store)
    made = save_tables(store, {"meta": spark.createDataFrame([("k", "v")], META)})
    assert (made.version, made.format) == (5, 4) and set(open_tables(store)) == set(knowledge(spark))


def test_a_newer_format_is_not_touched(spark, store):
    store.commit(None, {"meta": [store.write("meta", spark.createDataFrame([], META))]}, FORMAT + 1)
    with pytest.raises(ArtifactError):
        migrate(store)


def test_vacuum_keeps_what_kept_versions_name(spark, store):
    for n in (1, 2, 3):
        save_tables(store, knowledge(spark, n) if n != 2 else {"meta": knowledge(spark)["meta"]})
    gone = store.vacuum(keep=2)
    assert store.versions() == [2, 3] and gone[0] == "versions/000000001.json" and len(gone) == 2
    assert open_tables(store, 2)["symbols"].count() == 1 and open_tables(store, 3)["symbols"].count() == 3
    assert store.vacuum(keep=0) and store.versions() == [3] and open_tables(store)["claims"].agg(F.max("claim_id")).first()[0] == 2
