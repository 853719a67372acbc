"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, top_doc) sorted by hash in each of its files.
A batch of documents is reduced to one row for each line key; ``RunStore.add``
merge-joins that with the runs: keys not met before (the anti-join) become the
batch's own run, keys met before become increments of that run.  When a level
holds ``fanout`` runs they are merged into one run of the next level, so a key
is rewritten once for each level.  ``RunStore.totals`` merges what is there.

A line's key is the line without white space (space, \\t, \\n, \\v, \\f, \\r) at
both ends and with A-Z lower-cased.  Keys of at least ``min_chars`` code points
in at least ``min_docs`` documents lose all their lines except in the largest
doc_id that holds the key.  128 bits of hash stand for a key.

A null or empty text is one empty line.  Repeated lines of a document count
once and are kept or dropped together.  Equal rows are one document; rows of one
id with other texts are documents of their own.  Rows with a null id count for
nothing and keep all their lines.  Ids may lie anywhere in the range of a long.
An empty table gives an empty result and extra columns are ignored.

Hashes carry the numbers of their lines, so a text is cut by the sorted numbers
of what it loses, in time linear in its lines.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import scratch_path, text_or_empty, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Runs of a level that are merged into one of the next level.
FANOUT = 4
#: Batches that the whole-table query feeds to the run store: more than a level holds, so runs are compacted.
BATCHES = 5
#: Error of the quantiles of ids that cut the batches.
_CUT_ERROR = 0.01

_TRIMMED = " \t\n\x0b\x0c\r"
RUN_SCHEMA = "h1 long, h2 long, n_docs long, top_doc long"


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, ascii_uppercase, ascii_lowercase), F.lit(_TRIMMED))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def _document(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text_or_empty(text_col))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, id, text_hash, places): one row for each document and distinct long key in it, with its line numbers from 0."""
    whole = F.translate(text_or_empty(text_col), ascii_uppercase, ascii_lowercase)
    keys = F.transform(F.split(whole, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(_TRIMMED)).alias("key"), i.alias("place")))
    long_keys = F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _document(text_col).alias("text_hash"), F.explode(long_keys).alias("line"))
    rows = rows.select(*_hashes(F.col("line.key")), "id", "text_hash", "line.place")
    return rows.groupBy("h1", "h2", "id", "text_hash").agg(F.collect_set("place").alias("places"))


class RunStore:
    """Levelled sorted runs of line hashes in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(path)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{self._made:06d}"
        self._made += 1
        rows.repartition("h1").sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(path)
        return path

    @property
    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, top_doc) over all runs."""
        if not self.runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        if len(self.runs) == 1:
            return self._read(self.runs[0])
        return _merged(self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key (h1, h2) no run holds: a merge-anti-join with the runs."""
        if not self.runs:
            return keys
        return keys.join(self.spark.read.schema(RUN_SCHEMA).parquet(*self.runs).select("h1", "h2"), ["h1", "h2"], "left_anti")

    def add(self, hashes: DataFrame) -> None:
        """Add the documents of a batch: rows (h1, h2, id), one for each document and key.

        Batches come in falling order of id, so the first batch that holds a key
        settles its ``top_doc``: unseen keys bring theirs, the others only their count.
        """
        batch = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("top_doc"))
        if not self.runs:
            self.levels[0].append(self._write(batch))
        else:
            batch = written(batch, "line-batch")
            new = self.unseen(batch).select("h1", "h2", F.lit(0).cast("long").alias("n_docs"), "top_doc")
            counts = batch.select("h1", "h2", "n_docs", F.lit(None).cast("long").alias("top_doc"))
            self.levels[0].append(self._write(_merged(counts.unionByName(new))))
        self._compact()

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) < self.fanout:
                break
            run = self._write(_merged(self.spark.read.schema(RUN_SCHEMA).parquet(*self.levels[depth])))
            self.levels[depth] = []
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(run)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))


def build_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> tuple[RunStore, DataFrame]:
    """Feed a table to a new store in ``batches`` batches of falling id; also the hashes (h1, h2, id, batch)."""
    spark = docs.sparkSession
    store = RunStore(spark)
    ided = docs.where(F.col(id_col).isNotNull())
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted({int(min(max(c, -(2.0**62)), 2.0**62)) for c in ided.select(F.col(id_col).cast("long").cast("double").alias("id")).approxQuantile("id", shares, _CUT_ERROR)})
    number = sum((F.when(F.col("id") < F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    rows = written(line_hashes(ided, id_col, text_col, min_chars).withColumn("batch", number), "line-hashes", "batch")
    for b in range(len(cuts) + 1):
        store.add(rows.where(F.col("batch") == b).select("h1", "h2", "id"))
    return store, rows


def lost_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(id, text_hash, lost): sorted numbers of the lines that a document loses."""
    store, rows = build_runs(docs, id_col, text_col, min_chars, batches)
    common = store.totals().where(F.col("n_docs") >= min_docs)
    common = written(common.select("h1", "h2", "top_doc"), "common-lines")
    lost = rows.join(common, ["h1", "h2"]).where(F.col("id") < F.col("top_doc"))
    return lost.groupBy("id", "text_hash").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("lost"))


def _left(lines: Column, lost: Column) -> Column:
    """The lines before, between and after the lost ones."""
    begin = F.concat(F.array(F.lit(0)), F.transform(lost, lambda p: p + 1))
    end = F.concat(lost, F.array(F.size(lines)))
    return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(lines, b + 1, e - b)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) of every row of ``docs``."""
    lost = lost_lines(docs, id_col, text_col, min_chars, min_docs, batches)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _document(text_col).alias("text_hash"), text_or_empty(text_col).alias("body"))
    # The lines are split once: a generator of one row keeps the split out of the expressions over it.
    joined = texts.join(lost, ["id", "text_hash"], "left").withColumn("lines", F.explode(F.array(F.split("body", "\n"))))
    touched = F.col("lost").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(touched, F.size("lost")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(touched, F.array_join(_left(F.col("lines"), F.col("lost")), "\n")).otherwise(F.col("body")).alias("kept_text"),
    )


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the texts shortened; all rows and all other columns stay, nulls too."""
    lost = lost_lines(docs, id_col, text_col, min_chars, min_docs, batches).toDF("__id", "__text_hash", "__lost")
    joined = docs.join(lost, (docs[id_col].cast("long") == F.col("__id")) & (_document(text_col) == F.col("__text_hash")), "left")
    joined = joined.withColumn("__lines", F.explode(F.array(F.split(F.col(text_col).cast("string"), "\n"))))
    left = F.array_join(_left(F.col("__lines"), F.col("__lost")), "\n")
    kept = F.when(F.col("__lost").isNotNull(), left).otherwise(F.col(text_col))
    return joined.withColumn(text_col, kept).select(docs.columns)
