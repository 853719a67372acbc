"""Ranked text search: BM25 over identifier-aware tokens, with the whole query as one more phrase.

Two ways to the same scores, and ``segments`` as a third.  ``score`` scans a corpus
once for one query and needs no index: terms are counted inside each row by plain
text search, the counts are written, and statistics and scores are taken from them.  ``build_index`` writes postings
(term, id, field, positions) clustered by term for batches of queries;
``search`` then reads the terms asked for only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.text import TOKEN_BREAK, dual_form, fold, fold_text, query_words, sanitize_query, tokens
from symloom.sources.folders import shared_folder

# The published constants, and the weight of terms in half the rows or more.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Decimals of a score: equal scores stay equal whatever order their terms are added in.
DIGITS = 12


def phrases(query: str) -> list[list[str]]:
    """The terms that are scored: the whole query, then its words (repeated ones again)."""
    words = [fold_text(w) for w in sanitize_query(query)]
    return [] if not words else [words] if len(words) == 1 else [words, *[[w] for w in words]]


def _parted(text: Column) -> Column:
    """The folded text with two spaces between its tokens."""
    return F.trim(F.regexp_replace(fold(text), TOKEN_BREAK, "  "))


def spaced(text: Column | str) -> Column:
    """The tokens of the dual form, each with a space before and after it: plain text search finds phrases.

    Both halves of the dual form are equal where nothing joins words, so it is parted once.
    """
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    joined = column.contains("_") | column.contains("-")
    twice = F.trim(F.repeat(F.concat(_parted(column), F.lit("  ")), F.lit(2)))
    return F.concat(F.lit(" "), F.when(joined, _parted(dual_form(column))).otherwise(twice), F.lit(" "))


def n_tokens(spaced_text: Column) -> Column:
    return F.when(F.trim(spaced_text) == "", 0).otherwise((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit("  "), F.lit("")))) / 2 + 1)


def overlaps_itself(phrase: Sequence[str]) -> bool:
    return any(list(phrase[:k]) == list(phrase[-k:]) for k in range(1, len(phrase)))


def occurrences(spaced_text: Column, phrase: Sequence[str]) -> Column:
    """How often a phrase occurs in a spaced text."""
    wanted = " " + "  ".join(phrase) + " "
    if not overlaps_itself(phrase):
        return (F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(wanted), F.lit("")))) / len(wanted)
    toks, k = F.split(F.trim(spaced_text), "  "), len(phrase)
    places = F.filter(F.sequence(F.lit(0), F.size(toks) - k), lambda i: _run_at(toks, i, phrase))
    return F.when(spaced_text.contains(wanted), F.size(places)).otherwise(0)


def _run_at(toks: Column, at: Column, phrase: Sequence[str]) -> Column:
    fits = F.get(toks, at) == phrase[0]
    for n, word in enumerate(phrase[1:], 1):
        fits = fits & (F.get(toks, at + n) == word)
    return fits


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(LEAST_IDF)


def weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / mean))


def score(corpus: DataFrame, query: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, bm25) of every row that matches; more negative is better.

    Statistics are those of the whole corpus.  Phrases do not cross fields.
    """
    terms = phrases(query)
    if not terms:
        return corpus.select(F.col(id_col).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    toks = [F.col(f"__t{i}") for i in range(len(fields))]
    rows = _once(corpus, F.col(id_col).alias("id"), *[spaced(f).alias(f"__t{i}") for i, f in enumerate(fields)])
    counted = _once(rows, F.col("id"), sum((n_tokens(t) for t in toks), F.lit(0)).cast("double").alias("dl"), *[sum((occurrences(t, p) for t in toks), F.lit(0)).cast("double").alias(f"tf{k}") for k, p in enumerate(terms)])
    counted = _stored(counted)
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).cast("double").alias(f"df{k}") for k in range(len(terms))])
    matching = counted.where(sum((F.col(f"tf{k}") for k in range(len(terms))), F.lit(0)) > 0)
    total = sum((idf(F.col("n"), F.col(f"df{k}")) * weight(F.col(f"tf{k}"), F.col("dl"), F.col("mean")) for k in range(len(terms))), F.lit(0.0))
    return matching.join(F.broadcast(stats)).select("id", F.round(-total, DIGITS).alias("bm25"))  # one row of statistics


def _stored(counted: DataFrame) -> DataFrame:
    """A few numbers for each row, written so that the texts are read once."""
    path = shared_folder(counted.sparkSession, "counted")
    counted.write.parquet(path)
    return counted.sparkSession.read.schema(counted.schema).parquet(path)


def _once(df: DataFrame, key: Column, *columns: Column) -> DataFrame:
    """``select`` whose costly columns are computed once for each row.

    Filters and projections above a plain projection are merged into it, which
    repeats its expressions; they stop at a generator of one row.
    """
    return df.select(key, F.inline(F.array(F.struct(*columns))))


class TextIndex:
    """Written postings of a corpus: ``postings`` (term, id, field, positions), ``lengths`` (id, dl)."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.lengths = spark.read.parquet(f"{path}/lengths")

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, id, bm25) for many queries (query_id, query) in one plan.

        Postings are joined with the terms of the queries; phrases are the
        positions that every word shares after shifting by its place.
        """
        stats = self.lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("mean"))
        words = queries.select("query_id", F.posexplode(F.transform(query_words("query"), lambda w: F.get(tokens(w), F.lit(0)))).alias("place", "term")).where("term is not null")
        sizes = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
        hits = self.postings.join(words, "term")
        single = hits.groupBy("query_id", F.concat(F.lit("w"), F.col("place")).alias("phrase"), "id").agg(F.sum(F.size("positions")).cast("double").alias("tf"))
        shifted = hits.select("query_id", "id", "field", "place", F.explode("positions").alias("p")).join(sizes.where("k > 1"), "query_id")
        whole = shifted.groupBy("query_id", "id", "field", (F.col("p") - F.col("place")).alias("start"), "k").agg(F.count_distinct("place").alias("found")).where("found = k")
        whole = whole.groupBy("query_id", F.lit("whole").alias("phrase"), "id").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        tf = single.unionByName(whole)
        df = tf.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).cast("double").alias("df"))
        scored = tf.join(df, ["query_id", "phrase"]).join(self.lengths, "id").join(F.broadcast(stats))
        part = idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("mean"))
        found = scored.groupBy("query_id", "id").agg(F.round(-F.sum(part), DIGITS).alias("bm25"))
        if limit is None:
            return found
        order = W.partitionBy("query_id").orderBy("bm25", "id")
        return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def postings(corpus: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(term, id, field, positions) of a corpus."""
    sides = [F.struct(F.lit(i).alias("field"), tokens(dual_form(f)).alias("toks")) for i, f in enumerate(fields)]
    rows = corpus.select(F.col(id_col).alias("id"), F.explode(F.array(*sides)).alias("x")).select("id", "x.field", F.posexplode("x.toks").alias("p", "term"))
    return rows.groupBy("term", "id", "field").agg(F.sort_array(F.collect_list("p")).alias("positions"))


def build_index(corpus: DataFrame, path: str, id_col: str, fields: Sequence[str]) -> TextIndex:
    """Write postings clustered by term, so a search prunes row groups, and lengths for all rows."""
    lengths = corpus.select(F.col(id_col).alias("id"), sum((F.size(tokens(dual_form(f))) for f in fields), F.lit(0)).cast("double").alias("dl"))
    postings(corpus, id_col, fields).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    return TextIndex(corpus.sparkSession, path)


def update_index(corpus: DataFrame, changed_ids: DataFrame, path: str, new_path: str, id_col: str, fields: Sequence[str]) -> TextIndex:
    """A new index in which the rows of ``changed_ids`` (id) are those that ``corpus`` now holds."""
    old, spark = TextIndex(corpus.sparkSession, path), corpus.sparkSession
    fresh = corpus.join(changed_ids.select(F.col("id").alias(id_col)), id_col, "left_semi")
    kept = old.postings.join(changed_ids, "id", "left_anti").unionByName(postings(fresh, id_col, fields))
    kept.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{new_path}/postings")
    lengths = fresh.select(F.col(id_col).alias("id"), sum((F.size(tokens(dual_form(f))) for f in fields), F.lit(0)).cast("double").alias("dl"))
    old.lengths.join(changed_ids, "id", "left_anti").unionByName(lengths).write.mode("overwrite").parquet(f"{new_path}/lengths")
    return TextIndex(spark, new_path)
