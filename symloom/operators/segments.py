"""A text index of immutable segments: changes are written alone, the best k are found without scoring all.

An index is a snapshot store of four tables, each in parts that carry the number
of the run that wrote them:

* ``forward`` (id, dl, t0, t1, ...): the tokenised fields of a row, sorted by id;
* ``blocks`` (term, salt, block, n, max_tf, min_dl, ids): postings in falling order
  of what they are worth, in blocks of ``BLOCK``; whatever the mean length of the
  corpus becomes, ``max_tf`` and ``min_dl`` bound what a posting of the block can be
  worth then.  A term with many postings is ordered in salted shares;
* ``terms`` (term, df): how many rows hold a term, added up over the parts;
* ``gone`` (id, upto): rows of runs before ``upto`` that were replaced or deleted.

An update writes a segment of the new rows, a part of ``gone``, and the counts that
the old rows take with them, so counts, lengths and scores are those of an index
built anew.  Segments of like size are merged when ``FANOUT`` of them have come
together, without what is gone; a row is written again once for each tier.  All of it
is one commit at a time, so a reader sees a whole version, and a run that dies none.

``top`` is exact.  The rows that hold the rarest word are scored first: any row with
the whole query as a phrase is among them, and their k-th best score is the mark.
A row without that word can at most reach the sum of the largest values of its
words.  Words whose largest values together stay below the mark are not read at
all; of the others, only blocks are read whose bound with the largest values of the
other words reaches it.  Few rows are left to be scored from ``forward``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.operators.textindex import DIGITS, LEAST_IDF, _once, idf, n_tokens, occurrences, phrases, spaced, weight
from symloom.sources.folders import shared_folder
from symloom.sources.snapshots import Manifest, Part, SnapshotStore

#: Postings of a block.
BLOCK = 128
#: Postings that are ordered together; a term with more is dealt to several shares.
SHARE = 1 << 20
#: Segments of a tier that are merged into one; rows of the smallest tier.
FANOUT, SMALLEST = 4, 1024
#: Blocks of each word that are read first where no phrase can occur.
FIRST_BLOCKS = 2
#: Ids up to which rows are looked up by value, so that the scan skips what does not hold them.
LOOKED_UP = 1000
#: What bounds and scores may differ by.
_SLACK = 1e-9


def _forward(corpus: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    toks = [spaced(f).alias(f"t{i}") for i, f in enumerate(fields)]
    rows = _once(corpus.where(F.col(id_col).isNotNull()), F.col(id_col).alias("id"), *toks)
    return rows.withColumn("dl", sum((n_tokens(F.col(f"t{i}")) for i in range(len(fields))), F.lit(0)).cast("double"))


def _postings(forward: DataFrame) -> DataFrame:
    """(term, id, dl, tf) of tokenised rows."""
    fields = [c for c in forward.columns if c not in ("id", "dl")]
    toks = F.flatten(F.array(*[F.split(F.trim(F.col(c)), "  ") for c in fields]))
    terms = forward.select("id", "dl", F.explode(toks).alias("term")).where("term <> ''")
    return terms.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def _blocks(postings: DataFrame, terms: DataFrame, mean: float) -> DataFrame:
    """Postings in blocks, the most valuable first, in ranges of terms.

    Only terms with several shares are joined, of which there are few; one shuffle by
    range serves the order within a term, its blocks and the files.
    """
    shared = F.broadcast(terms.where(F.col("df") > SHARE).select("term", F.ceil(F.col("df") / SHARE).alias("shares")))
    salted = postings.join(shared, "term", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    order = W.partitionBy("term", "salt").orderBy(weight(F.col("tf"), F.col("dl"), F.lit(mean)).desc(), "id")
    placed = salted.repartitionByRange("term", "salt").withColumn("place", F.row_number().over(order) - 1).withColumn("block", F.expr(f"CAST(place div {BLOCK} AS int)"))
    blocks = placed.groupBy("term", "salt", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list("id")).alias("ids"))
    return blocks.sortWithinPartitions("term", "salt", "block")


class SegmentIndex:
    """The newest version of an index, or the one that ``version`` names."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.store = SnapshotStore(spark, root)
        self.manifest = self.store.manifest(version)

    # statistics

    def _notes(self, name: str) -> float:
        return sum(p.notes[name] for table in ("forward", "gone") for p in self._parts(table))

    def _parts(self, table: str) -> list[Part]:
        return [] if self.manifest is None else self.manifest.tables.get(table, [])

    @property
    def n(self) -> int:
        return int(self._notes("n"))

    @property
    def mean(self) -> float:
        return self._notes("dl") / self.n if self.n else 0.0

    def _tagged(self, table: str) -> DataFrame:
        """The rows of a table with ``run``, the number of the run that wrote them."""
        return reduce(DataFrame.unionByName, [self.store.rows([p]).withColumn("run", F.lit(p.notes["run"])) for p in self._parts(table)])

    def live(self, rows: DataFrame | None = None) -> DataFrame:
        """Tokenised rows (of ``rows`` with run, or all) that no later run replaced or deleted."""
        rows = self._tagged("forward") if rows is None else rows
        if self._parts("gone"):
            gone = self.store.rows(self._parts("gone")).groupBy("id").agg(F.max("upto").alias("upto"))
            rows = rows.join(gone, "id", "left").where(F.coalesce(F.col("upto") <= F.col("run"), F.lit(True))).drop("upto")
        return rows.drop("run")

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """The live tokenised rows of some ids (id)."""
        few = [r.id for r in ids.limit(LOOKED_UP + 1).collect()]
        forward = self._tagged("forward")
        found = forward.where(F.col("id").isin(few)) if len(few) <= LOOKED_UP else forward.join(ids, "id", "left_semi")
        return self.live(found)

    def document_frequencies(self, words: Sequence[str]) -> dict[str, int]:
        counts = self.store.rows(self._parts("terms")).where(F.col("term").isin(list(words))).groupBy("term").agg(F.sum("df").alias("df"))
        return {r.term: r.df for r in counts.collect()}  # a row for each word of a query

    # writing

    def _segment(self, forward: DataFrame, run: int) -> dict[str, Part]:
        """The parts of a segment of tokenised rows in ranges of ids."""
        rows = self.store.write("forward", forward)
        back = self.store.rows([rows])
        length = back.agg(F.coalesce(F.sum("dl"), F.lit(0.0)).alias("dl")).first().dl
        notes = {"run": run, "n": rows.rows, "dl": length}
        counted = self.store.write("postings", _postings(back))  # for the terms and the blocks
        postings = self.store.rows([counted])
        terms = self.store.write("terms", postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term"), run=run)
        blocks = _blocks(postings, self.store.rows([terms]), length / rows.rows if rows.rows else 1.0)
        blocks = self.store.write("blocks", blocks, run=run)
        self.store.files.remove(counted.folder)
        return {"forward": Part(rows.folder, rows.rows, rows.schema, notes), "blocks": blocks, "terms": terms}

    def update(self, changed: DataFrame, id_col: str, fields: Sequence[str], deleted: DataFrame | None = None) -> Manifest:
        """One version in which ``changed`` rows are new or replace those of their id, and ``deleted`` (id) are no more.

        Ids are unique; rows with a null id are left out.
        """
        run = 1 + max((p.notes["run"] for p in self._parts("forward")), default=0)
        tables = {name: list(self._parts(name)) for name in ("forward", "blocks", "terms", "gone")}
        if tables["forward"]:
            ids = changed.select(F.col(id_col).alias("id"))
            old = self.rows_of(ids if deleted is None else ids.union(deleted.select("id")).distinct())
            taken = self.store.write("taken", old)
            if taken.rows:
                back = self.store.rows([taken])
                dl = back.agg(F.sum("dl").alias("dl")).first().dl
                gone = self.store.write("gone", back.select("id", F.lit(run).alias("upto")))
                tables["gone"].append(Part(gone.folder, gone.rows, gone.schema, {"run": run, "n": -taken.rows, "dl": -dl}))
                tables["terms"].append(self.store.write("terms", _postings(back).groupBy("term").agg((-F.count(F.lit(1))).alias("df")), run=run))
            self.store.files.remove(taken.folder)
        # Rows are placed before they are tokenised: the sample that ranges are taken from would do that once more.
        parts = [] if tables["forward"] else [int(changed.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
        placed = changed.select(id_col, *fields).repartitionByRange(*parts, id_col).sortWithinPartitions(id_col)
        for name, part in self._segment(_forward(placed, id_col, fields), run).items():
            tables[name].append(part)
        self.manifest = self.store.commit(self.manifest, tables)
        return self._merged()

    def _merged(self) -> Manifest:
        """Merge segments of like size until no tier has ``FANOUT`` of them; what is gone is left out."""
        while True:
            tiers: dict[int, list[Part]] = {}
            for part in self._parts("forward"):
                tiers.setdefault(int(math.log(max(part.rows, SMALLEST) / SMALLEST, FANOUT)), []).append(part)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FANOUT), None)
            if full is None:
                return self.manifest
            self._merge(full)

    def _merge(self, segments: list[Part]) -> None:
        """One segment of the live rows of some, with the highest of their numbers.

        A row that lives in a segment was not replaced by a later one, so no tombstone reaches it there.
        """
        runs = {p.notes["run"] for p in segments}
        forward = reduce(DataFrame.unionByName, [self.store.rows([p]).withColumn("run", F.lit(p.notes["run"])) for p in segments])
        made = self._segment(self.live(forward).repartitionByRange("id").sortWithinPartitions("id"), max(runs))
        tables = {name: [p for p in self._parts(name) if p.notes["run"] not in runs] for name in ("forward", "blocks")}
        tables["forward"].append(made["forward"])
        tables["blocks"].append(made["blocks"])
        tables["terms"] = [self._summed_terms(made["terms"])]
        oldest = min(p.notes["run"] for p in tables["forward"])
        tables["gone"] = self._needed_tombstones(oldest, segments, made["forward"])
        self.manifest = self.store.commit(self.manifest, tables)

    def _summed_terms(self, made: Part) -> Part:
        """Counts over all parts as one; those of the merged rows are among them already."""
        self.store.files.remove(made.folder)
        every = self.store.rows(self._parts("terms")).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        return self.store.write("terms", every.repartitionByRange("term").sortWithinPartitions("term"), run=made.notes["run"])

    def _needed_tombstones(self, oldest: int, before: list[Part], after: Part) -> list[Part]:
        """Tombstones that reach a segment that is left, as one part; its notes keep the sums right."""
        if not self._parts("gone"):
            return []
        kept = self.store.rows(self._parts("gone")).groupBy("id").agg(F.max("upto").alias("upto")).where(F.col("upto") > oldest)
        part = self.store.write("gone", kept)
        notes = {"run": after.notes["run"]}
        for name in ("n", "dl"):
            notes[name] = sum(p.notes[name] for p in [*self._parts("gone"), *before]) - after.notes[name]
        return [Part(part.folder, part.rows, part.schema, notes)] if part.rows or notes["n"] or notes["dl"] else []

    # searching

    def _counted(self, rows: DataFrame, terms: list[list[str]]) -> DataFrame:
        """(id, dl, tf0, tf1, ...) of tokenised rows that hold a term."""
        toks = [F.col(c) for c in rows.columns if c not in ("id", "dl")]
        counted = _once(rows, F.col("id"), F.col("dl"), *[sum((occurrences(t, p) for t in toks), F.lit(0)).cast("double").alias(f"tf{k}") for k, p in enumerate(terms)])
        return counted.where(sum((F.col(f"tf{k}") for k in range(len(terms))), F.lit(0)) > 0)

    def _scored(self, counted: DataFrame, df: list[float]) -> DataFrame:
        """(id, bm25) of counted rows, by the statistics of the whole index."""
        total = sum((idf(F.lit(float(self.n)), F.lit(float(d))) * weight(F.col(f"tf{k}"), F.col("dl"), F.lit(self.mean)) for k, d in enumerate(df)), F.lit(0.0))
        return counted.select("id", F.round(-total, DIGITS).alias("bm25"))

    def _bounded(self, words: Counter[str], df: dict[str, int]) -> DataFrame:
        """The blocks of some words with ``bound``, the most that a posting of theirs adds to a score."""
        blocks = self._tagged("blocks").where(F.col("term").isin(list(words)))
        worth = [F.when(F.col("term") == w, F.lit(times * _idf(self.n, df[w]))) for w, times in words.items()]
        return blocks.withColumn("bound", F.coalesce(*worth) * weight(F.col("max_tf"), F.col("min_dl"), F.lit(self.mean)))

    def top(self, query: str, limit: int, read: dict[str, int] | None = None) -> DataFrame:
        """(id, bm25) of the best ``limit`` rows; more negative is better, ties by id.

        ``read``, if given, is told how many blocks the words have and how many were read.
        """
        terms = phrases(query)
        words = Counter(t[0] for t in terms if len(t) == 1)
        df = {w: n for w, n in self.document_frequencies(list(words)).items() if n} if self._parts("terms") and words else {}
        if not df:
            return self._tagged("forward").select("id", F.lit(0.0).alias("bm25")).limit(0)
        known = Counter({w: n for w, n in words.items() if w in df})
        whole = next((t for t in terms if len(t) > 1), None)
        rarest = min(df, key=lambda w: (df[w], w)) if whole and len(df) == len(words) else ""
        best = W.partitionBy("term").orderBy(F.desc("bound"), "run", "salt", "block")
        blocks = self._bounded(known, df).withColumn("first", (F.col("term") == rarest) | (F.row_number().over(best) <= FIRST_BLOCKS))
        first = blocks.where("first")
        # Texts are read once: a few numbers of a row are written, and the phrase's count, the mark and the scores come from them.
        path = shared_folder(self.store.spark, "seen")
        self._counted(self.rows_of(_ids(first)), terms).write.parquet(path)
        seen = self.store.spark.read.parquet(path)
        phrase_df = 0
        if rarest:
            phrase_df = seen.where(F.col(f"tf{terms.index(whole)}") > 0).count()
        counts = [float(phrase_df if len(t) > 1 else df.get(t[0], 0)) for t in terms]
        scores = self._scored(seen, counts)
        kth = scores.orderBy("bm25", "id").limit(limit).agg(F.count(F.lit(1)).alias("n"), F.max("bm25").alias("last")).first()
        rest = self._rest(blocks, rarest, -kth.last - _SLACK if kth.n == limit else -math.inf)
        if read is not None:
            read |= {"blocks": blocks.count(), "read": first.count() + rest.count()}
        found = scores.unionByName(self._scored(self._counted(self.rows_of(_ids(rest)), terms), counts)).distinct()
        return found.orderBy("bm25", "id").limit(limit)

    def _rest(self, blocks: DataFrame, rarest: str, mark: float) -> DataFrame:
        """The blocks not read yet that can hold a row, without the rarest word, that reaches the mark."""
        largest = {r.term: r.most for r in blocks.where(F.col("term") != rarest).groupBy("term").agg(F.max("bound").alias("most")).collect()}
        others, idle, total = sum(largest.values()), [], 0.0
        for word in sorted(largest, key=largest.__getitem__):
            if total + largest[word] >= mark:
                break
            total += largest[word]
            idle.append(word)
        needed = [F.when(F.col("term") == w, F.col("bound") + F.lit(others - most) >= mark) for w, most in largest.items() if w not in idle]
        return blocks.where(~F.col("first") & F.coalesce(*needed, F.lit(False)))


def _idf(n: int, df: int) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else LEAST_IDF


def _ids(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode("ids").alias("id")).distinct()


def build_segments(corpus: DataFrame, root: str, id_col: str, fields: Sequence[str]) -> SegmentIndex:
    """A new index of one segment."""
    index = SegmentIndex(corpus.sparkSession, root)
    index.update(corpus, id_col, fields)
    return index
