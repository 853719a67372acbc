"""Search by intent: claims ranked by text, told by the symbols they speak of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.text import DEFAULT_MATCHES, match_limit, name_overlap, overfetch, sanitize_query, severity_rank
from symloom.operators.segments import SegmentIndex
from symloom.operators.textindex import score

CLAIM_FIELDS = ("claim", "rationale", "excerpt")


def find_by_intent(claims: DataFrame, claim_symbols: DataFrame, symbols: DataFrame, query: str, limit: int = DEFAULT_MATCHES, fields: Sequence[str] = CLAIM_FIELDS, index: SegmentIndex | None = None) -> DataFrame:
    """The best symbols for a query, each with its best claim; ``rank`` counts from 1.

    Claims are cut to 5 times the limit (200 at most) before they meet symbols,
    so claims without symbols take up places.  A symbol keeps the claim of best
    score, whatever its severity.  Order: score, words of the query in the
    symbol's name, severity, source, claim, symbol.  An ``index`` over the fields
    of the claims finds the same claims without reading all.
    """
    if not query.strip() or limit < 1:
        raise ValueError("a query needs words and a limit of 1 or more")
    wanted = match_limit(limit)
    scored = score(claims, query, "claim_id", fields).orderBy("bm25", "id").limit(overfetch(limit)) if index is None else index.top(query, overfetch(limit))
    best = scored.withColumnRenamed("id", "claim_id")
    text = claims.select("claim_id", "source", "severity", "claim", "rationale", "excerpt")
    linked = F.broadcast(best).join(text, "claim_id").join(claim_symbols.distinct(), "claim_id")  # at most 200 claims
    first = W.partitionBy("symbol_id").orderBy("bm25", "claim_id")
    one = linked.withColumn("__n", F.row_number().over(first).cast("long")).where("__n = 1").drop("__n")
    known = symbols.select(F.col("id").alias("symbol_id"), "name", "path", "line", "kind", "signature")
    order = [F.col("bm25"), F.col("name_overlap").desc(), severity_rank("severity"), F.col("source"), F.col("claim_id"), F.col("symbol_id")]
    ranked = one.join(known, "symbol_id").withColumn("name_overlap", name_overlap("name", sanitize_query(query)))
    top = ranked.orderBy(*order).limit(wanted)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))  # at most 50 rows


def ranked_claims(claims: DataFrame, claim_symbols: DataFrame, query: str | None = None, fields: Sequence[str] = CLAIM_FIELDS) -> DataFrame:
    """Claims of every symbol with their place: by severity and source, or by a query with unmatched ones last.

    Scores use the whole corpus; a query never removes a claim.
    """
    own = claim_symbols.distinct().join(claims, "claim_id")
    order = [severity_rank("severity"), F.col("source"), F.col("claim_id")]
    if query is not None and sanitize_query(query):
        scores = score(claims, query, "claim_id", fields).withColumnRenamed("id", "claim_id")
        own = own.join(scores, "claim_id", "left").withColumn("score", F.coalesce("bm25", F.lit(float("inf")))).drop("bm25")
        order.insert(0, F.col("score"))
    return own.withColumn("place", F.row_number().over(W.partitionBy("symbol_id").orderBy(*order)).cast("long"))


def severity_histogram(claims: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_claims") for s in ("hard", "soft", "context")]
    return claims.groupBy(*by).agg(*counts) if by else claims.agg(*counts)
