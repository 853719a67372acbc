import os
import subprocess
import time
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from symloom.sources.files import scan_markdown, scan_sources
from symloom.sources.trees import TASKS, Rules, listed, read_git, read_tree, register, write_tree


@pytest.fixture()
def tree(spark, tmp_path):
    files = {"docs/adr/ADR-1.md": "one", "docs/adr/ADR-2.MD": "zwei ß", "docs/guide.md": "", "docs/.hidden/x.md": "h", ".top.md": "t", "src/a.ts": "let a", "src/node_modules/b.ts": "no", "src/deep/er/c.py": "c = 1"}
    rows = spark.createDataFrame(list(files.items()), "rel_path string, text string").repartition(3)
    assert write_tree(rows, f"file://{tmp_path}/t") == len(files)
    return f"{tmp_path}/t", files


def paths(df):
    return sorted(r.rel_path for r in df.select("rel_path").collect())


def test_what_is_written_is_read(spark, tree):
    root, files = tree
    rows = {r.rel_path: r for r in read_tree(spark, root, skip="none").collect()}
    assert {p: r.text for p, r in rows.items()} == files
    assert all((r.sha, r.size) == (sha256(files[p].encode()).hexdigest(), len(files[p].encode())) for p, r in rows.items())
    assert all(abs(r.modified.timestamp() - os.path.getmtime(f"{root}/{p}")) < 1 for p, r in rows.items())
    assert paths(read_tree(spark, f"file://{root}", [".md"])) == ["docs/adr/ADR-1.md", "docs/adr/ADR-2.MD", "docs/guide.md"]
    assert paths(read_tree(spark, root, [".ts", ".py"], skip="sources")) == ["src/a.ts", "src/deep/er/c.py"]
    assert read_tree(spark, f"{root}/nowhere").count() == 0


def test_options_reach_the_listing(spark, tree):
    root, files = tree
    for options, folders, kept in (({"below": "docs/adr/"}, 1, lambda p, n: p.startswith("docs/adr/")), ({"below": "src/a"}, 1, lambda p, n: p == "src/a.ts"), ({"min_bytes": 5, "skip": "none"}, 3, lambda p, n: n >= 5), ({"max_bytes": 0}, 1, lambda p, n: n == 0)):
        found = read_tree(spark, root, **options)
        assert found.rdd.getNumPartitions() == folders, options
        assert paths(found) == sorted(p for p, t in files.items() if kept(p, len(t.encode()))), options
    assert read_tree(spark, root, skip="none", partition_files=1).rdd.getNumPartitions() == len(files)


def test_a_filter_of_one_query_does_not_stay(spark, tree):
    df = read_tree(spark, tree[0])
    before = paths(df)
    assert paths(df.where(F.col("rel_path").startswith("docs/adr/"))) == ["docs/adr/ADR-1.md", "docs/adr/ADR-2.MD"] and paths(df) == before


def test_folders_that_cannot_hold_a_file_are_not_listed(tree, monkeypatch):
    root, _ = tree
    rules = Rules(skip="none", below="docs/adr/")
    entered = []
    enters = Rules.enters
    monkeypatch.setattr(Rules, "enters", lambda self, folder: (r := enters(self, folder)) and not entered.append(folder) or r)
    assert [f for f, _ in listed(root, rules)] == ["docs/adr/"] and entered == ["docs/", "docs/adr/"]


def test_files_arrive_as_a_stream(spark, tmp_path):
    register(spark)
    root, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    os.makedirs(root)

    def put(name, text, at):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{root}/{name}", (at, at))

    def run():
        query = spark.readStream.format("symloom_tree").option("extensions", ".md").load(root).select("rel_path", "text").writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(once=True).start()
        query.awaitTermination()
        return sorted((r.rel_path, r.text) for r in spark.read.parquet(out).collect())

    now = time.time() - 100
    put("a.md", "1", now)
    put("b.md", "1", now)
    put("c.txt", "1", now)
    assert run() == [("a.md", "1"), ("b.md", "1")]
    assert run() == [("a.md", "1"), ("b.md", "1")]
    put("c.md", "1", now + 1)
    put("a.md", "2", now + 2)
    assert run() == [("a.md", "1"), ("a.md", "2"), ("b.md", "1"), ("c.md", "1")]


def test_options_and_paths_are_checked(spark, tree):
    root, _ = tree
    register(spark)
    with pytest.raises(Exception, match="skip"):
        spark.read.format("symloom_tree").option("skip", "some").load(root).count()
    for bad in ("/abs", "a/../../b", None):
        with pytest.raises(Exception, match="no file of a tree"):
            write_tree(spark.createDataFrame([(bad, "x")], "rel_path string, text string"), root)


def test_git_repositories(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()

    def git(*words):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=n@e", *words], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "plain").mkdir()
    (tmp_path / "empty").mkdir()
    subprocess.run(["git", "-C", str(tmp_path / "empty"), "init", "-q"], check=True, capture_output=True)
    for n, names in enumerate((["x.ts"], ["x.ts", "y é.ts"], ["z.ts"])):
        for name in names:
            (repo / name).write_text(str(n))
        git("add", ".")
        git("commit", "-qm", f"subject {n} \x1f of it")
    commits, heads = read_git(spark, [str(repo), str(tmp_path / "plain"), str(tmp_path / "none"), str(tmp_path / "empty")])
    rows = {r.message: r for r in commits.collect()}
    assert set(rows) == {f"subject {n} \x1f of it" for n in range(3)} and rows["subject 0 \x1f of it"].files == ["x.ts"]
    assert {r.author_email for r in rows.values()} == {"n@e"}
    head = subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    assert {r.repository: r.head_sha for r in heads.collect()} == {str(repo): head, str(tmp_path / "empty"): None}
    assert read_git(spark, [str(repo)], commits=1)[0].count() == 1


def test_small_files_are_dealt_to_few_tasks_and_listed_in_one(spark, tmp_path):
    """Rows of one partition are written by many tasks, and a scan has no task for every few files."""
    rows = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("src/d"), F.col("id") % 3, F.lit("/_f"), "id", F.lit(".py")).alias("rel_path"), F.col("id").cast("string").alias("text"))
    seen = rows.repartition(1)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tree-write", "")
    assert write_tree(seen, str(tmp_path)) == 3000
    tasks = [jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("tree-write") for s in jobs.getJobInfo(j).stageIds if jobs.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) >= spark.sparkContext.defaultParallelism
    found = scan_sources(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= TASKS * spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in found.collect()} == {(f"{tmp_path}/{r.rel_path}", r.rel_path, sha256(r.text.encode()).hexdigest(), r.text) for r in rows.collect()}
    assert scan_sources(spark, str(tmp_path / "none")).count() == 0 == scan_markdown(spark, str(tmp_path)).count()
