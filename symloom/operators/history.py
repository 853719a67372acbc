"""Commit history: recent commits, hot and cold files, and files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.sources.folders import shared_folder

#: Threshold of a hot file and length of a list of recent commits: one setting.
RECENT = 5
CO_CHANGE_LIMIT = 5
#: Files of a commit beyond which its pairs are not counted one by one.
LARGE = 256
#: Rows (file, commit) of a task that pairs them.
PAIRED = 200_000
#: Classes of a large commit that all of its classes meet first.
LEADERS = 8
#: Classes up to which what each two of them share is broadcast, and large commits up to which their names are.
FEW_CLASSES = 256
FEW_COMMITS = 50_000


def pivot_files(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits with ``files`` as the two tables (commits, file_commits); repeated pairs are one."""
    pairs = commits.select(F.explode("files").alias("file_path"), F.col("sha").alias("commit_sha")).dropDuplicates()
    return commits.drop("files"), pairs


def commit_files(commits: DataFrame, file_commits: DataFrame) -> DataFrame:
    """Commits with their sorted files; those without files have an empty list."""
    files = file_commits.dropDuplicates().groupBy(F.col("commit_sha").alias("sha")).agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    return commits.join(files, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def recent_commits(commits: DataFrame, file_commits: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest ``n`` commits of every file with their place; dates are ordered as text, ties by sha."""
    order = W.partitionBy("file_path").orderBy(F.col("date").desc(), "sha")
    joined = file_commits.dropDuplicates().join(commits, F.col("commit_sha") == F.col("sha")).drop("commit_sha")
    return joined.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def file_activity(commits: DataFrame, file_commits: DataFrame, n: int = RECENT) -> DataFrame:
    """One row for each file: commit_count, last_touched, last_author, hot (``n`` commits or more).

    One partial aggregation; with ``n`` = 0 there is no list of commits and so no row.
    """
    joined = file_commits.dropDuplicates().join(commits, F.col("commit_sha") == F.col("sha"))
    newest = F.max(F.struct("date", "sha")).alias("newest")
    if n <= 0:
        joined = joined.limit(0)
    # The newest date wins, and among equal dates the smallest sha.
    one = joined.groupBy("file_path").agg(F.count(F.lit(1)).alias("commit_count"), F.max("date").alias("last_touched"), newest)
    same = joined.select("file_path", F.col("date").alias("last_touched"), "sha", "author_email")
    author = same.groupBy("file_path", "last_touched").agg(F.min(F.struct("sha", "author_email")).alias("a"))
    out = one.join(author, ["file_path", "last_touched"])
    return out.select("file_path", "commit_count", "last_touched", F.col("a.author_email").alias("last_author"), (F.col("commit_count") >= n).alias("hot"))


def file_history(commits: DataFrame, file_commits: DataFrame, n: int = RECENT) -> DataFrame:
    """``file_activity`` with ``recent_commits``, the list of a file's newest ``n`` commits, from one pass over the commits of files."""
    if n <= 0:
        file_commits = file_commits.limit(0)
    order = W.partitionBy("file_path").orderBy(F.col("date").desc(), "sha")
    joined = file_commits.dropDuplicates().join(commits, F.col("commit_sha") == F.col("sha")).drop("commit_sha")
    placed = joined.withColumn("place", F.row_number().over(order).cast("long"))
    commit = F.struct(*commits.columns)
    listed = F.sort_array(F.collect_list(F.when(F.col("place") <= n, F.struct("place", commit.alias("commit")))))
    newest = F.max(F.when(F.col("place") == 1, F.struct("date", "author_email")))
    told = placed.groupBy("file_path").agg(F.count(F.lit(1)).alias("commit_count"), newest.alias("newest"), F.transform(listed, lambda c: c["commit"]).alias("recent_commits"))
    return told.select("file_path", "commit_count", F.col("newest.date").alias("last_touched"), F.col("newest.author_email").alias("last_author"), (F.col("commit_count") >= n).alias("hot"), "recent_commits")


def _fitting(file_commits: DataFrame, max_files: int | None) -> DataFrame:
    if max_files is None:
        return file_commits
    fit = file_commits.groupBy("commit_sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_files).select("commit_sha")
    return file_commits.join(fit, "commit_sha", "left_semi")


def _tasks(file_commits: DataFrame, rows: int | None = None) -> int:
    """Tasks that pair files, in proportion to the rows, so that the pairs that one holds stay as many."""
    rows = file_commits.count() if rows is None else rows
    return max(file_commits.sparkSession.sparkContext.defaultParallelism, -(-rows // PAIRED))


def co_change_pairs(file_commits: DataFrame, file_path=None, max_files: int | None = None, tasks: int | None = None, by_file: bool = False) -> DataFrame:
    """(file_path, other_path, commits) for pairs of files with a commit in common.

    ``file_path`` (a path, or a DataFrame of them) restricts the left side before
    the join.  Pairs grow with the square of a commit's files; ``max_files`` (off by default) leaves out larger commits.
    With ``by_file``, all pairs of a file come to one of ``tasks`` places before they are
    counted, so that windows over a file's pairs move none of them again.
    """
    own = _fitting(file_commits.dropDuplicates(), max_files)
    if file_path is None:
        own = own.repartition(tasks or _tasks(file_commits), "commit_sha")
    if isinstance(file_path, DataFrame):
        left = own.join(file_path.select("file_path").distinct(), "file_path", "left_semi")
    else:
        left = own if file_path is None else own.where(F.col("file_path") == F.lit(file_path))
    right = own.select("commit_sha", F.col("file_path").alias("other_path"))
    both = left.join(right, "commit_sha").where("file_path <> other_path")
    if by_file:
        both = both.select("file_path", "other_path").repartition(tasks or _tasks(file_commits), "file_path")
    return both.groupBy("file_path", "other_path").agg(F.count(F.lit(1)).alias("commits"))


def co_change_top(file_commits: DataFrame, file_path=None, limit: int = CO_CHANGE_LIMIT, max_files: int | None = None, large: int = LARGE) -> DataFrame:
    """The files that most often change with a file (or with each file), ties by path.

    For one file its pairs are counted.  For many, commits of more than ``large``
    files are not paired out, and the result is still that of all pairs: see ``co_change_candidates``.
    """
    if file_path is not None and not isinstance(file_path, DataFrame):
        return co_change_pairs(file_commits, file_path, max_files).orderBy(F.desc("commits"), "other_path").limit(limit)
    order = W.partitionBy("file_path").orderBy(F.desc("commits"), "other_path")
    pairs = co_change_candidates(file_commits, file_path, limit, max_files, large)
    return pairs.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def co_change_candidates(file_commits: DataFrame, file_path: DataFrame | None, limit: int, max_files: int | None = None, large: int = LARGE) -> DataFrame:
    """(file_path, other_path, commits) that holds the best ``limit`` partners of each file, with exact counts.

    Pairs are counted in commits of up to ``large`` files.  The larger commits of a
    file are its signature, and files with one signature are a class.  What two files
    share in large commits is what their classes share.  Of partners that share
    nothing else, a class offers its first paths only, as the others count the same
    and come later; so each class gets one list of the best offers, which holds for
    all of its files, and a commit of n files costs rows in proportion to n.
    """
    own = _fitting(file_commits.dropDuplicates(), max_files)
    sizes = own.groupBy("commit_sha").agg(F.count(F.lit(1)).alias("n"))
    huge = sizes.where(F.col("n") > large).select("commit_sha")
    told = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col("n") > large).alias("large")).first()
    tasks = _tasks(file_commits, told.rows)
    if told.most <= large:
        return co_change_pairs(own, file_path, tasks=tasks, by_file=True)
    if told.large <= FEW_COMMITS:
        huge = F.broadcast(huge)
    small, big = own.join(huge, "commit_sha", "left_anti"), own.join(huge, "commit_sha", "left_semi")
    signed = big.groupBy("file_path").agg(F.sort_array(F.collect_set("commit_sha")).alias("signature"))
    # One row a file, read many times below.
    signed = _kept(signed.withColumn("class", F.md5(F.to_json("signature"))))
    classes = signed.groupBy("class").agg(F.first("signature").alias("signature"))
    first = W.partitionBy("class").orderBy("file_path")
    heads = signed.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= limit + 1).select("class", F.col("file_path").alias("other_path"))
    offers = _kept(_offers(classes, heads, limit + 1))
    wanted = signed.select("file_path", "class")
    if file_path is not None:
        wanted = wanted.join(file_path.select("file_path").distinct(), "file_path", "left_semi")
    offered = wanted.join(offers, "class").where("file_path <> other_path").select("file_path", "other_path", "commits")

    n = classes.count()
    if n <= FEW_CLASSES:
        return _best_of(small, file_path, signed, classes, tasks, limit).unionByName(offered).groupBy("file_path", "other_path").agg(F.max("commits").alias("commits"))
    pairs = co_change_pairs(small, file_path, tasks=tasks)
    classed = pairs.join(signed.select("file_path", "class"), "file_path", "left").join(signed.select(F.col("file_path").alias("other_path"), F.col("class").alias("other")), "other_path", "left")
    shared = _shared(classed.where("class IS NOT NULL AND other IS NOT NULL").select("class", "other").distinct(), classes)
    whole = classed.join(shared, ["class", "other"], "left").select("file_path", "other_path", (F.col("commits") + F.coalesce("common", F.lit(0))).alias("commits"))
    # An offer that has small commits in common too is among the pairs, with its whole count.
    return whole.unionByName(offered).groupBy("file_path", "other_path").agg(F.max("commits").alias("commits"))


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back."""
    path = shared_folder(rows.sparkSession, "history")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _best_of(small: DataFrame, file_path: DataFrame | None, signed: DataFrame, classes: DataFrame, tasks: int, limit: int) -> DataFrame:
    """(file_path, other_path, commits): the best ``limit`` partners of each file among those of its small commits, where classes are few.

    Files come into their pairs with their class, so that pairs are shuffled once; an offer
    whose pair is not among the best here counts less there, and is not among the best at all.
    """
    numbered = classes.withColumn("own", F.row_number().over(W.orderBy("class")))  # few rows
    every = numbered.select("class").crossJoin(numbered.select(F.col("class").alias("other")))
    names = lambda c, n: F.broadcast(numbered.select(F.col("class").alias(c), F.col("own").alias(n)))
    shared = _shared(every, classes).join(names("class", "own"), "class").join(names("other", "theirs"), "other").select("own", "theirs", "common")
    rows = small.join(signed.join(names("class", "own"), "class").select("file_path", "own"), "file_path", "left").repartition(tasks, "commit_sha")
    left = rows if file_path is None else rows.join(file_path.select("file_path").distinct(), "file_path", "left_semi")
    both = left.join(rows.select("commit_sha", F.col("file_path").alias("other_path"), F.col("own").alias("theirs")), "commit_sha").where("file_path <> other_path")
    dealt = both.select("file_path", "other_path", "own", "theirs").repartition(tasks, "file_path")
    pairs = dealt.groupBy("file_path", "other_path").agg(F.count(F.lit(1)).alias("commits"), F.first("own").alias("own"), F.first("theirs").alias("theirs"))
    whole = pairs.join(F.broadcast(shared), ["own", "theirs"], "left").select("file_path", "other_path", (F.col("commits") + F.coalesce("common", F.lit(0))).alias("commits"))
    order = W.partitionBy("file_path").orderBy(F.desc("commits"), "other_path")
    return whole.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def _shared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, other, common) for pairs of classes: how many large commits they share."""
    left, right = classes.withColumnRenamed("signature", "__a"), classes.select(F.col("class").alias("other"), F.col("signature").alias("__b"))
    return pairs.join(left, "class").join(right, "other").select("class", "other", F.size(F.array_intersect("__a", "__b")).cast("long").alias("common"))


def _offers(classes: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """(class, other_path, commits): the best ``n`` partners of each class by large commits alone.

    A first round meets the ``LEADERS`` classes with the most commits in each commit
    and gives a mark: the n-th best count so far.  To share as many, another class has
    to hold one of a class's rarest commits, all but (mark - 1) of them; only those
    are joined.
    """
    members = classes.select("class", F.size("signature").alias("size"), F.explode("signature").alias("commit_sha"))
    spread = members.groupBy("commit_sha").agg(F.count(F.lit(1)).alias("spread"))
    by_size = W.partitionBy("commit_sha").orderBy(F.desc("size"), "class")
    leaders = members.withColumn("__n", F.row_number().over(by_size)).where(F.col("__n") <= LEADERS).select("commit_sha", F.col("class").alias("other"))
    ranked = W.partitionBy("class").orderBy(F.desc("commits"), "other_path")

    def best(pairs: DataFrame) -> DataFrame:
        told = _shared(pairs, classes).join(heads.withColumnRenamed("class", "other"), "other")
        return told.select("class", "other_path", F.col("common").alias("commits")).withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") <= n)

    early = best(members.select("class", "commit_sha").join(leaders, "commit_sha").select("class", "other").distinct())
    mark = early.groupBy("class").agg(F.when(F.count(F.lit(1)) == n, F.min("commits")).otherwise(1).alias("mark"))
    rare = W.partitionBy("class").orderBy("spread", "commit_sha")
    prefix = members.join(spread, "commit_sha").withColumn("__n", F.row_number().over(rare)).join(mark, "class").where(F.col("__n") <= F.col("size") - F.col("mark") + 1)
    others = members.select(F.col("class").alias("other"), F.col("size").alias("other_size"), "commit_sha")
    later = prefix.select("class", "mark", "commit_sha").join(others, "commit_sha").where(F.col("other_size") >= F.col("mark"))
    return best(later.select("class", "other").distinct()).drop("__n")
