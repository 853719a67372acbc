"""The engine's operators as queries over the driver's tables, each with SQL for DuckDB.

Stand-ins: ``documents`` (with ``labels``) and ``part`` are claims, ``part`` is
also the symbol table, ``orders`` are commits and ``lineitem`` the files they
touch, ``pages`` are references, ``events`` diagnostics and ``conversations``
extraction batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.functions.paths import is_test_file, module_key, normalize_path
from symloom.functions.text import ACCENTED, FOLDED, cost_usd, name_overlap, sanitize_query, severity_rank
from symloom.operators.diff import budget_crossing, delete_by_path, merge_latest, merge_values, sha_diff
from symloom.operators.fusion import Knowledge, impact_risks, symbol_contexts
from symloom.operators.history import co_change_pairs, co_change_top, commit_files, file_activity, recent_commits
from symloom.operators.intent import find_by_intent, ranked_claims, severity_histogram
from symloom.operators.resolve import attribute_claims, resolve_candidates, resolve_symbols, unresolved_by_file
from symloom.operators.textindex import phrases, score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY, PHRASE_QUERY, IDENTIFIER_QUERY, SYMBOL_QUERY = "under the theron", "thing and", "blue_bolt economy", "blue bolt"
SINGLE = "theron"
FILE = 100
HOT = 25


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core where rows are dealt before texts are made of them and parsed.
TASKS = 4


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table that may be one small file, dealt over all cores by their keys."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, *keys)


# ---- stand-ins, in Spark and in SQL


def doc_claims(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels")
    severity = F.when(F.col("toxic") == 1, "hard").when(F.col("quality") == 1, "soft").otherwise("context")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("claim_id"), "source", F.col("source").alias("source_path"), severity.alias("severity"), F.col("text").alias("claim"), F.col("source").alias("rationale"), F.col("lang").alias("excerpt"),
    )


DOC_CLAIMS = """
claims AS (
  SELECT doc_id AS claim_id, source, source AS source_path, text AS claim, source AS rationale, lang AS excerpt,
    CASE WHEN toxic = 1 THEN 'hard' WHEN quality = 1 THEN 'soft' ELSE 'context' END AS severity
  FROM documents LEFT JOIN labels USING (doc_id)
)"""


def doc_links(claims: DataFrame, n_symbols: int = 2000) -> DataFrame:
    """Links of claims to parts: two for most, none for each eleventh."""
    ids = F.array_distinct(F.array(F.col("claim_id") % 64, (F.col("claim_id") * 7) % n_symbols))
    return claims.where("claim_id % 11 <> 0").select("claim_id", F.explode(ids.cast("array<string>")).alias("symbol_id"))


DOC_LINKS = """
claim_symbols AS (
  SELECT DISTINCT claim_id, CAST(unnest([claim_id % 64, (claim_id * 7) % 2000]) AS VARCHAR) AS symbol_id FROM claims WHERE claim_id % 11 <> 0
)"""


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".ts")).alias("path"), F.col("p_size").alias("line"), F.lit(None).cast("string").alias("signature"))


PART_SYMBOLS = """
symbols AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS kind, 'src/' || p_brand || '.ts' AS path, p_size AS line FROM part
)"""


def part_claims(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.translate("p_name", " ", "_"), F.lit(" "), F.lower("p_type"))
    return _read(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), text.alias("claim"), F.col("p_brand").alias("rationale"), F.lower("p_type").alias("excerpt"))


PART_CLAIMS = """
claims AS (
  SELECT p_partkey AS claim_id, replace(p_name, ' ', '_') || ' ' || lower(p_type) AS claim, p_brand AS rationale, lower(p_type) AS excerpt FROM part
)"""


def order_commits(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sha"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("o_orderpriority").alias("message"), F.col("o_custkey").cast("string").alias("author_email"))


def order_files(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_partkey").alias("file_path"), F.col("l_orderkey").alias("commit_sha")).dropDuplicates()


COMMITS = """
commits AS (
  SELECT o_orderkey AS sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, o_orderpriority AS message, CAST(o_custkey AS VARCHAR) AS author_email FROM orders
), files AS (
  SELECT DISTINCT l_partkey AS file_path, l_orderkey AS commit_sha FROM lineitem
)"""


def page_refs(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    return _read(spark, d, "pages").select((F.col("page_id") % 20).cast("string").alias("symbol_id"), F.col("page_id").alias("ordinal"), F.col("page_id").cast("string").alias("ref_id"), path.alias("path"))


PAGE_REFS = """
refs AS (
  SELECT CAST(page_id % 20 AS VARCHAR) AS symbol_id, page_id AS ordinal, CAST(page_id AS VARCHAR) AS ref_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages
)"""

SEVERITY_RANK = "CASE severity WHEN 'hard' THEN 0 WHEN 'soft' THEN 1 ELSE 2 END"
MODULE_KEY = """CASE WHEN string_split(path, '/')[1] IN ('src', 'lib', 'app', 'packages', 'source') AND len(string_split(path, '/')) > 1
  THEN string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"""


# ---- text search


def bm25_sql(query: str, fields: tuple[str, ...] = ("claim",), source: str = "claims") -> str:
    """CTEs that end in ``scored`` (claim_id, bm25 unrounded)."""
    terms = phrases(query)

    def toks(f: str) -> str:
        dual = f"coalesce({f}, '') || ' ' || translate(coalesce({f}, ''), '_-', '  ')"
        return f"' ' || trim(regexp_replace(translate(lower({dual}), '{ACCENTED}', '{FOLDED}'), '[^\\p{{L}}\\p{{N}}_-]+', '  ', 'g')) || ' '"

    def size(i: int) -> str:
        return f"CASE WHEN trim(t{i}) = '' THEN 0 ELSE (length(t{i}) - length(replace(t{i}, '  ', ''))) / 2 + 1 END"

    def tf(phrase: list[str], i: int) -> str:
        wanted = " " + "  ".join(phrase) + " "
        return f"(length(t{i}) - length(replace(t{i}, '{wanted}', ''))) / {len(wanted)}"

    n = range(len(fields))
    ks = range(len(terms))
    lists = ", ".join(f"{toks(f)} AS t{i}" for i, f in enumerate(fields))
    counts = ", ".join(f"CAST({' + '.join(tf(p, i) for i in n)} AS DOUBLE) AS tf{k}" for k, p in enumerate(terms))
    dfs = ", ".join(f"CAST(count(*) FILTER (WHERE tf{k} > 0) AS DOUBLE) AS df{k}" for k in ks)
    idf = [f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 0.000001 END" for k in ks]
    total = " + ".join(f"({idf[k]}) * (tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / mean)))" for k in ks)
    return f"""
toks AS (SELECT claim_id, {lists} FROM {source}),
tf AS (SELECT claim_id, CAST({" + ".join(map(size, n))} AS DOUBLE) AS dl, {counts} FROM toks),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {dfs} FROM tf),
scored AS (SELECT claim_id, round(-({total}), 12) AS bm25 FROM tf, st WHERE {" + ".join(f"tf{k}" for k in ks)} > 0)"""


def _top(scored: DataFrame, n: int = 20) -> DataFrame:
    rounded = scored.select(F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))
    return rounded.orderBy("bm25", "claim_id").limit(n)


_TOP_SQL = "SELECT claim_id, round(bm25, 6) AS bm25 FROM scored ORDER BY bm25, claim_id"


@_query(f"WITH {DOC_CLAIMS}, {bm25_sql(QUERY)} {_TOP_SQL} LIMIT 20")
def bm25_top_docs(spark: SparkSession, d: str) -> DataFrame:
    return _top(score(doc_claims(spark, d), QUERY, "claim_id", ["claim"]))


@_query(f"WITH {DOC_CLAIMS}, {bm25_sql(SINGLE)} {_TOP_SQL}")
def bm25_single_token(spark: SparkSession, d: str) -> DataFrame:
    return score(doc_claims(spark, d), SINGLE, "claim_id", ["claim"]).select(F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))


@_query(f"WITH {DOC_CLAIMS}, {bm25_sql(PHRASE_QUERY)} {_TOP_SQL}")
def bm25_phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    return score(doc_claims(spark, d), PHRASE_QUERY, "claim_id", ["claim"]).select(F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))


@_query(f"WITH {PART_CLAIMS}, {bm25_sql(IDENTIFIER_QUERY)} {_TOP_SQL}")
def bm25_identifier_dual_form(spark: SparkSession, d: str) -> DataFrame:
    return score(part_claims(spark, d), IDENTIFIER_QUERY, "claim_id", ["claim"]).select(F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))


@_query(f"WITH {PART_CLAIMS}, {bm25_sql(SYMBOL_QUERY, ('claim', 'rationale', 'excerpt'))} {_TOP_SQL}")
def bm25_three_fields(spark: SparkSession, d: str) -> DataFrame:
    return score(part_claims(spark, d), SYMBOL_QUERY, "claim_id", ["claim", "rationale", "excerpt"]).select(F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))


@_query(f"""WITH {DOC_CLAIMS}, {DOC_LINKS}, {bm25_sql(QUERY, ("claim", "rationale", "excerpt"))}
SELECT symbol_id, claim_id, CASE WHEN bm25 IS NULL THEN 'none' ELSE 'match' END AS matched,
  row_number() OVER (PARTITION BY symbol_id ORDER BY bm25 NULLS LAST, {SEVERITY_RANK}, source, claim_id) AS place
FROM claim_symbols JOIN claims USING (claim_id) LEFT JOIN scored USING (claim_id)""")
def bm25_unmatched_last(spark: SparkSession, d: str) -> DataFrame:
    claims = doc_claims(spark, d)
    rows = ranked_claims(claims, doc_links(claims), QUERY)
    return rows.select("symbol_id", "claim_id", F.when(F.col("score") == float("inf"), "none").otherwise("match").alias("matched"), "place")


def _intent_sql(query: str, limit: int) -> str:
    words = " + ".join(f"CAST(contains(lower(name), '{w.lower()}') AS INTEGER)" for w in sanitize_query(query))
    order = f"bm25, name_overlap DESC, {SEVERITY_RANK}, source, claim_id, symbol_id"
    return f"""WITH {DOC_CLAIMS}, {DOC_LINKS}, {PART_SYMBOLS}, {bm25_sql(query, ("claim", "rationale", "excerpt"))},
best AS (SELECT claim_id, bm25 FROM scored ORDER BY bm25, claim_id LIMIT {min(5 * limit, 200)}),
firsts AS (
  SELECT * FROM best JOIN claim_symbols USING (claim_id) JOIN claims USING (claim_id)
  QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY bm25, claim_id) = 1
), matches AS (SELECT f.*, s.name, s.path, {words} AS name_overlap FROM firsts f JOIN symbols s ON s.id = f.symbol_id)
SELECT row_number() OVER (ORDER BY {order}) AS rank, symbol_id, name, path, claim_id, severity, name_overlap, round(bm25, 6) AS bm25
FROM matches QUALIFY rank <= {limit}"""


@_query(_intent_sql(QUERY, 10))
def intent_search_symbols(spark: SparkSession, d: str) -> DataFrame:
    claims = doc_claims(spark, d)
    found = find_by_intent(claims, doc_links(claims), part_symbols(spark, d), QUERY, 10)
    return found.select("rank", "symbol_id", "name", "path", "claim_id", "severity", "name_overlap", F.round("bm25", 6).alias("bm25"))


@_query("""SELECT p_partkey AS id, CAST(contains(lower(p_name), 'blue') AS INTEGER) + CAST(contains(lower(p_name), 'bolt') AS INTEGER) + CAST(contains(lower(p_name), 'bolt') AS INTEGER) AS overlap
FROM part WHERE overlap > 0""")
def name_overlap_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), name_overlap("p_name", ["Blue", "bolt", "bolt"]).alias("overlap"))
    return rows.where("overlap > 0")


@_query(f"WITH {DOC_CLAIMS}, {DOC_LINKS} SELECT symbol_id, claim_id, severity, row_number() OVER (PARTITION BY symbol_id ORDER BY {SEVERITY_RANK}, source, claim_id) AS place FROM claim_symbols JOIN claims USING (claim_id)")
def claims_by_severity(spark: SparkSession, d: str) -> DataFrame:
    claims = doc_claims(spark, d)
    return ranked_claims(claims, doc_links(claims)).select("symbol_id", "claim_id", "severity", "place")


@_query(f"WITH {DOC_CLAIMS} SELECT source, count(*) FILTER (WHERE severity = 'hard') AS hard_claims, count(*) FILTER (WHERE severity = 'soft') AS soft_claims, count(*) FILTER (WHERE severity = 'context') AS context_claims FROM claims GROUP BY source")
def severity_by_source(spark: SparkSession, d: str) -> DataFrame:
    return severity_histogram(doc_claims(spark, d), "source")


# ---- history


@_query(f"""WITH {COMMITS} SELECT b.file_path AS other_path, count(*) AS commits FROM files a JOIN files b ON a.commit_sha = b.commit_sha AND b.file_path <> a.file_path
WHERE a.file_path = {FILE} GROUP BY 1 ORDER BY commits DESC, other_path LIMIT 5""")
def cochange_topk(spark: SparkSession, d: str) -> DataFrame:
    return co_change_top(order_files(spark, d), FILE).select("other_path", "commits")


_PAIRS = "SELECT a.file_path, b.file_path AS other_path, count(*) AS commits FROM files a JOIN files b ON a.commit_sha = b.commit_sha AND b.file_path <> a.file_path GROUP BY 1, 2"


@_query(f"WITH {COMMITS} {_PAIRS}")
def cochange_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return co_change_pairs(order_files(spark, d))


@_query(f"WITH {COMMITS} SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY commits DESC, other_path) AS place FROM ({_PAIRS}) QUALIFY place <= 5")
def cochange_topk_per_file(spark: SparkSession, d: str) -> DataFrame:
    return co_change_top(order_files(spark, d))


@_query(f"""WITH {COMMITS} SELECT file_path, count(*) AS commit_count, count(*) >= {HOT} AS hot FROM files JOIN commits ON commit_sha = sha GROUP BY 1""")
def hot_cold(spark: SparkSession, d: str) -> DataFrame:
    return file_activity(order_commits(spark, d), order_files(spark, d), HOT).select("file_path", "commit_count", "hot")


@_query(f"WITH {COMMITS} SELECT file_path, sha, date, row_number() OVER (PARTITION BY file_path ORDER BY date DESC, sha) AS place FROM files JOIN commits ON commit_sha = sha QUALIFY place <= 5")
def recent_commits_per_file(spark: SparkSession, d: str) -> DataFrame:
    return recent_commits(order_commits(spark, d), order_files(spark, d)).select("file_path", "sha", "date", "place")


@_query(f"WITH {COMMITS} SELECT file_path, date AS last_touched, author_email AS last_author FROM files JOIN commits ON commit_sha = sha QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY date DESC, sha) = 1")
def last_touched(spark: SparkSession, d: str) -> DataFrame:
    return file_activity(order_commits(spark, d), order_files(spark, d)).select("file_path", "last_touched", "last_author")


@_query(f"WITH {COMMITS} SELECT sha, coalesce(string_agg(CAST(file_path AS VARCHAR), ',' ORDER BY file_path), '') AS files FROM commits LEFT JOIN files ON commit_sha = sha GROUP BY sha")
def commit_file_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = commit_files(order_commits(spark, d), order_files(spark, d))
    return rows.select("sha", F.array_join("files", ",").alias("files"))


# ---- diff and maintenance


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    path = F.concat(F.lit("docs/"), F.col("doc_id")).alias("path")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.where("doc_id % 11 <> 0").select(path, F.sha2(old, 256).alias("sha")), docs.where("doc_id % 7 <> 0").select(path, F.sha2("text", 256).alias("sha"))


_DIFF = """
old AS (SELECT 'docs/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 11 <> 0),
new AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS sha FROM documents WHERE doc_id % 7 <> 0),
diff AS (SELECT path, CASE WHEN old.sha IS NULL THEN 'added' WHEN new.sha IS NULL THEN 'deleted' WHEN old.sha = new.sha THEN 'unchanged' ELSE 'changed' END AS status FROM old FULL JOIN new USING (path))"""


@_query(f"WITH {_DIFF} SELECT path, status FROM diff")
def sha_diff_status(spark: SparkSession, d: str) -> DataFrame:
    return sha_diff(*_versions(spark, d))


@_query(f"WITH {_DIFF} SELECT status, count(*) AS n FROM diff GROUP BY status")
def sha_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return sha_diff(*_versions(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {DOC_CLAIMS}, {DOC_LINKS} SELECT claim_id, symbol_id FROM claim_symbols WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE source IN ('src1', 'src4'))")
def deleted_cascade(spark: SparkSession, d: str) -> DataFrame:
    claims = doc_claims(spark, d)
    gone = spark.range(1).select(F.explode(F.array(F.lit("src1"), F.lit("src4"))).alias("path"))
    return delete_by_path(claims, doc_links(claims), gone)[1].select("claim_id", "symbol_id")


@_query("""WITH calls AS (SELECT conv_id AS batch, 15.0 * length(text) / 1e6 + 75.0 * length(text) / 4e6 AS cost FROM conversations),
per AS (SELECT batch, sum(cost) AS cost FROM calls GROUP BY batch), running AS (SELECT batch, sum(cost) OVER (ORDER BY batch) AS spent FROM per)
SELECT batch, round(spent, 6) AS spent FROM running WHERE spent > 0.25 ORDER BY batch LIMIT 1""")
def budget_threshold(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("text")
    calls = _read(spark, d, "conversations").select(F.col("conv_id").alias("batch"), cost_usd(size, size / 4).alias("cost"))
    return budget_crossing(calls, 0.25).select("batch", F.round("spent", 6).alias("spent"))


@_query("SELECT turn, CAST(sum(length(text)) AS BIGINT) AS input_tokens, round(sum(length(text)) * 15.0 / 1e6, 6) AS cost FROM conversations GROUP BY turn")
def usage_by_turn(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").groupBy("turn").agg(F.sum(F.length("text")).alias("input_tokens"))
    return rows.withColumn("cost", F.round(cost_usd("input_tokens", F.lit(0)), 6))


_MERGE = """
new AS (SELECT c_custkey AS id, max_by(c_name || '-' || k, k) AS name FROM customer, (VALUES (1), (2)) v(k) WHERE c_custkey % 3 = 0 GROUP BY 1
  UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 10 = 1)"""


@_query(f"WITH {_MERGE} SELECT id, name FROM new UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM new)")
def merge_latest_rows(spark: SparkSession, d: str) -> DataFrame:
    old = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    twice = old.where("id % 3 = 0").select("id", "name", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    fresh = twice.select("id", F.concat("name", F.lit("-"), F.col("k")).alias("name"), "k").unionByName(old.where("id % 10 = 1").select((F.col("id") + 1000000).alias("id"), "name", F.lit(1).alias("k")))
    return merge_latest(old, fresh, ["id"], ["k"])


@_query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) a
FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey > 9) b ON a.k = b.k""")
def merge_key_values(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return merge_values(n.where("k < 15"), n.where("k > 9").withColumn("v", F.lower("v")), "k", "v")


# ---- resolution


def _named_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols, four of each name."""
    return part_symbols(spark, d).withColumn("name", F.concat(F.lit("part "), F.floor(F.col("id").cast("long") / 4).cast("string")))


_NAMED = """
symbols AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'part ' || CAST(floor(p_partkey / 4) AS BIGINT) AS name, 'src/' || p_brand || '.ts' AS path FROM part)"""


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    hint = F.when(key % 3 == 0, F.concat(F.lit("src/Brand#"), key % 25)).when(key % 3 == 1, F.concat(F.lit("#"), key % 25, F.lit(".")))
    name = F.concat(F.lit("part "), F.floor(key / 8).cast("string"), F.when(key % 10 == 0, F.lit("?")).otherwise(F.lit("")))
    return _read(spark, d, "orders").select(key.alias("input_pos"), name.alias("input"), hint.alias("file_hint"))


@_query(f"""WITH {_NAMED}, inputs AS (
  SELECT o_orderkey AS input_pos, 'part ' || CAST(floor(o_orderkey / 8) AS BIGINT) || CASE WHEN o_orderkey % 10 = 0 THEN '?' ELSE '' END AS input,
    CASE o_orderkey % 3 WHEN 0 THEN 'src/Brand#' || (o_orderkey % 25) WHEN 1 THEN '#' || (o_orderkey % 25) || '.' ELSE '' END AS hint
  FROM orders
), found AS (
  SELECT input_pos, input, hint, id, path, hint <> '' AND starts_with(path, hint) AS s, hint <> '' AND contains(path, hint) AS c FROM inputs JOIN symbols ON name = input
), flagged AS (SELECT *, bool_or(s) OVER w AS any_s, bool_or(c) OVER w AS any_c FROM found WINDOW w AS (PARTITION BY input_pos)),
kept AS (SELECT * FROM flagged WHERE CASE WHEN any_s THEN s WHEN any_c THEN c ELSE TRUE END),
counted AS (SELECT *, count(*) OVER (PARTITION BY input_pos) AS n FROM kept)
SELECT i.input_pos, i.input, coalesce(n, 0) AS n_candidates, k.id AS symbol_id,
  CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 AND NOT (i.hint <> '' AND NOT any_s AND NOT any_c) THEN 'resolved' ELSE 'disambiguation' END AS status
FROM inputs i LEFT JOIN counted k ON k.input_pos = i.input_pos""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    return resolve_symbols(_inputs(spark, d), _named_symbols(spark, d))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    names = F.array(F.concat(F.when(key % 4 == 3, F.lit("nothing ")).otherwise(F.lit("part ")), (key % 1000).cast("string")), F.lit("no such name"))
    return _read(spark, d, "customer").select(key.alias("claim_id"), F.concat(F.lit("doc"), F.col("c_nationkey")).alias("source_path"), names.alias("symbol_candidates"))


_EXTRACTED = """
extracted AS (SELECT c_custkey AS claim_id, 'doc' || c_nationkey AS source_path, [CASE WHEN c_custkey % 4 = 3 THEN 'nothing ' ELSE 'part ' END || (c_custkey % 1000), 'no such name'] AS symbol_candidates FROM customer),
names AS (SELECT DISTINCT claim_id, source_path, unnest(symbol_candidates) AS candidate FROM extracted)"""


@_query(f"WITH {_NAMED}, {_EXTRACTED} SELECT DISTINCT claim_id, id AS symbol_id FROM names JOIN symbols ON name = candidate")
def candidate_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve_candidates(_extracted(spark, d), _named_symbols(spark, d))[0]


@_query(f"WITH {_NAMED}, {_EXTRACTED} SELECT source_path, count(*) AS n_unresolved, string_agg(DISTINCT candidate, ',' ORDER BY candidate) AS candidates FROM names WHERE candidate NOT IN (SELECT name FROM symbols) GROUP BY 1")
def unresolved_report(spark: SparkSession, d: str) -> DataFrame:
    return unresolved_by_file(_extracted(spark, d), _named_symbols(spark, d)).withColumn("candidates", F.array_join("candidates", ","))


@_query(f"""WITH {_NAMED}, {_EXTRACTED}, own AS (SELECT DISTINCT claim_id, id FROM names JOIN symbols ON name = candidate),
front AS (SELECT 'doc' || n_nationkey AS source_path, id FROM nation JOIN symbols ON name = 'part 3' WHERE n_nationkey % 2 = 0),
counts AS (SELECT claim_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM own GROUP BY 1),
fallback AS (SELECT source_path, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM front GROUP BY 1)
SELECT e.claim_id, coalesce(c.n, 0) AS n_drop, coalesce(c.n, f.n, 0) AS n_fallback, coalesce(c.ids, f.ids, '') AS ids_fallback
FROM extracted e LEFT JOIN counts c USING (claim_id) LEFT JOIN fallback f USING (source_path)""")
def attribution_modes(spark: SparkSession, d: str) -> DataFrame:
    symbols, extracted = _named_symbols(spark, d), _extracted(spark, d)
    front = _read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("doc"), F.col("n_nationkey")).alias("source_path"), F.array(F.lit("part 3")).alias("symbols"))
    drop = attribute_claims(extracted, symbols, front, "drop").select("claim_id", F.size("symbol_ids").cast("long").alias("n_drop"))
    back = attribute_claims(extracted, symbols, front).select("claim_id", F.size("symbol_ids").cast("long").alias("n_fallback"), F.array_join("symbol_ids", ",").alias("ids_fallback"))
    return drop.join(back, "claim_id")


# ---- fusion


@_query(f"""WITH {PAGE_REFS}, keyed AS (SELECT *, {MODULE_KEY} AS module FROM refs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol_id, module ORDER BY ordinal, ref_id) AS n FROM keyed)
SELECT symbol_id, module, count(*) AS count, string_agg(CASE WHEN n <= 3 THEN ref_id END, ',' ORDER BY n) AS top_ids,
  row_number() OVER (PARTITION BY symbol_id ORDER BY count(*) DESC, min(ordinal), module) AS place
FROM numbered GROUP BY symbol_id, module""")
def ref_clusters(spark: SparkSession, d: str) -> DataFrame:
    from symloom.operators.fusion import reference_clusters

    return reference_clusters(page_refs(spark, d), 3).withColumn("top_ids", F.array_join("top_ids", ","))


TEST_PATHS = ("src/foo.test.ts", "a/b.spec.tsx", "pkg/orders_test.py", "test_orders.py", "tests/anything.ts", "src/orders/test_helpers.ts", "spec/example.yml", "pkg/x_test.go", "test/a.ts", "A\\TESTS\\b.ts", "")
_TEST_VALUES = ", ".join(f"('{p}')" for p in TEST_PATHS)
_TEST_SQL = " OR ".join(f"regexp_matches(replace(path, '\\', '/'), '{p}', 'i')" for p in (r"(^|/)tests/", r"\.(test|spec)\.[cm]?[jt]sx?$", r"(^|/)test_[^/]*\.py$", r"_test\.py$"))


@_query(f"WITH {PAGE_REFS} SELECT path, {_TEST_SQL} AS is_test FROM (SELECT path FROM (VALUES {_TEST_VALUES}) v(path) UNION ALL SELECT path FROM refs)")
def test_file_classify(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, TEST_PATHS))).alias("path"))
    return fixed.unionByName(page_refs(spark, d).select("path")).select("path", is_test_file("path").alias("is_test"))


# Paths and their normal forms.
PATH_CASES = (
    ("src/a.ts", "src/a.ts"), ("./src/a.ts", "src/a.ts"), ("src//a.ts", "src/a.ts"), ("src\\a.ts", "src/a.ts"), ("src/dir/", "src/dir"), ("/", "/"), ("C:\\Users\\foo.ts", "c:/Users/foo.ts"),
    ("file:///home/user/foo%20bar.ts", "/home/user/foo bar.ts"), ("file:///c%3A/foo.ts", "c:/foo.ts"), ("\\\\server\\share\\foo.ts", "//server/share/foo.ts"), ("a+b.ts", "a+b.ts"), ("file:///a+b.ts", "/a+b.ts"),
)
_PATH_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PATH_CASES)


@_query(f"""SELECT 'part ' || p_partkey AS row_of, input, expected AS normal FROM part JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {_PATH_VALUES}) v(input, expected)) c ON p_partkey % {len(PATH_CASES)} = c.k
UNION ALL SELECT 'page ' || page_id, 'file:///C:/' || p || '//x\\', 'c:/' || p || '/x' FROM (SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1), '//', '/') AS p FROM pages)
UNION ALL SELECT 'name ' || p_partkey, './' || replace(p_name, ' ', '\\') || '/', replace(p_name, ' ', '/') FROM part""")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Fixed cases by row number, paths of pages as file URIs, and names as folders."""
    part, pages = _read(spark, d, "part"), _read(spark, d, "pages")
    case = F.element_at(F.array(*[F.lit(a) for a, _ in PATH_CASES]), (F.col("p_partkey") % len(PATH_CASES)).cast("int") + 1)
    below = F.replace(F.regexp_extract("url", "^[a-z]+://([^?#]*[^?#/])", 1), F.lit("//"), F.lit("/"))
    rows = part.select(F.concat(F.lit("part "), "p_partkey").alias("row_of"), case.alias("input"))
    rows = rows.unionByName(pages.select(F.concat(F.lit("page "), "page_id").alias("row_of"), F.concat(F.lit("file:///C:/"), below, F.lit("//x\\")).alias("input")))
    rows = rows.unionByName(part.select(F.concat(F.lit("name "), "p_partkey").alias("row_of"), F.concat(F.lit("./"), F.replace("p_name", F.lit(" "), F.lit("\\")), F.lit("/")).alias("input")))
    return rows.select("row_of", "input", normalize_path("input").alias("normal"))


def _knowledge(spark: SparkSession, d: str) -> tuple[DataFrame, Knowledge]:
    claims = doc_claims(spark, d)
    symbols = part_symbols(spark, d).withColumn("path", F.col("id"))
    files = order_files(spark, d).select(F.col("file_path").cast("string").alias("file_path"), "commit_sha")
    events = _read(spark, d, "events").where("event_type = 'error'")
    notes = events.select((F.col("user_id") % 64).cast("string").alias("path"), F.col("event_id").alias("line"), F.lit(None).cast("int").alias("col"), F.lit("error").alias("severity"), F.col("props").alias("message"))
    refs = page_refs(spark, d).withColumn("path", F.when(F.col("ordinal") % 4 == 0, F.concat(F.lit("tests/"), F.col("path"))).otherwise(F.col("path")))
    know = Knowledge(symbols, claims, doc_links(claims), refs, None, notes, order_commits(spark, d), files)
    return symbols.select(F.col("id").alias("symbol_id")), know


_KNOWN = f"""{DOC_CLAIMS}, {DOC_LINKS}, {PART_SYMBOLS}, {COMMITS}, {PAGE_REFS}, wanted AS (SELECT id AS symbol_id FROM symbols),
activity AS (SELECT CAST(file_path AS VARCHAR) AS symbol_id, count(*) AS commit_count FROM files JOIN commits ON commit_sha = sha GROUP BY 1),
intents AS (SELECT symbol_id, count(*) FILTER (WHERE severity = 'hard') AS hard, count(*) FILTER (WHERE severity = 'soft') AS soft, count(*) FILTER (WHERE severity = 'context') AS context FROM claim_symbols JOIN claims USING (claim_id) GROUP BY 1),
seen AS (SELECT symbol_id, count(*) AS n_refs, count(DISTINCT CASE WHEN ordinal % 4 = 0 THEN path END) AS test_files, count(DISTINCT CASE WHEN ordinal % 4 = 0 THEN 'tests' ELSE {MODULE_KEY} END) AS n_clusters FROM refs GROUP BY 1),
notes AS (SELECT CAST(user_id % 64 AS VARCHAR) AS symbol_id, count(*) AS diagnostics FROM events WHERE event_type = 'error' GROUP BY 1)"""


@_query(f"""WITH {_KNOWN}, pairs AS ({_PAIRS}), top AS (SELECT CAST(file_path AS VARCHAR) AS symbol_id, string_agg(other_path || ':' || commits, ',' ORDER BY place) AS co_change
  FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY commits DESC, CAST(other_path AS VARCHAR)) AS place FROM pairs) WHERE place <= 5 GROUP BY 1)
SELECT symbol_id, coalesce(commit_count, 0) >= 5 AS hot, coalesce(commit_count, 0) AS commit_count, coalesce(test_files, 0) AS test_files, coalesce(diagnostics, 0) AS diagnostics,
  coalesce(hard, 0) AS hard_claims, coalesce(soft, 0) AS soft_claims, coalesce(context, 0) AS context_claims, coalesce(co_change, '') AS co_change
FROM wanted LEFT JOIN activity USING (symbol_id) LEFT JOIN intents USING (symbol_id) LEFT JOIN seen USING (symbol_id) LEFT JOIN notes USING (symbol_id) LEFT JOIN top USING (symbol_id)""")
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    wanted, know = _knowledge(spark, d)
    shared = F.array_join(F.transform("co_change", lambda c: F.concat(c["other_path"], F.lit(":"), c["commits"].cast("string"))), ",")
    return impact_risks(wanted, know).select("symbol_id", "risk.*", shared.alias("co_change")).drop("hot_threshold")


@_query(f"""WITH {_KNOWN}, firsts AS (SELECT symbol_id, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY {SEVERITY_RANK}, source, claim_id) AS claim_ids FROM claim_symbols JOIN claims USING (claim_id) GROUP BY 1)
SELECT symbol_id, coalesce(claim_ids, '') AS claim_ids, n_refs, n_clusters, commit_count, diagnostics
FROM wanted LEFT JOIN firsts USING (symbol_id) LEFT JOIN seen USING (symbol_id) LEFT JOIN activity USING (symbol_id) LEFT JOIN notes USING (symbol_id)""")
def context_bundles(spark: SparkSession, d: str) -> DataFrame:
    wanted, know = _knowledge(spark, d)
    ids = F.array_join(F.transform("intent", lambda c: c["claim_id"].cast("string")), ",")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return symbol_contexts(wanted, know).select("symbol_id", ids.alias("claim_ids"), F.col("refs.count").alias("n_refs"), size("refs.clusters").alias("n_clusters"), F.col("git.commit_count").alias("commit_count"), size("diagnostics").alias("diagnostics"))


@_query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, row_number() OVER (PARTITION BY regexp_extract(url, '^([a-z]+)://', 1) ORDER BY url, page_id) AS first_seen FROM pages QUALIFY first_seen <= 3""")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"))
    order: Column = F.row_number().over(W.partitionBy("scheme").orderBy("url", "page_id")).cast("long")
    return rows.select("page_id", "scheme", order.alias("first_seen")).where("first_seen <= 3")


@_query(f"WITH {DOC_CLAIMS} SELECT claim_id, severity, {SEVERITY_RANK} AS rank, CASE WHEN length(claim) > 60 THEN left(claim, 57) || '...' ELSE claim END AS short, '\"' || replace(source, '\"', '\\\"') || '\"' AS quoted FROM claims")
def scalar_formats(spark: SparkSession, d: str) -> DataFrame:
    from symloom.functions.text import quote, truncate

    return doc_claims(spark, d).select("claim_id", "severity", severity_rank("severity").alias("rank"), truncate("claim").alias("short"), quote("source").alias("quoted"))


@_query(f"WITH {PAGE_REFS} SELECT path, {MODULE_KEY} AS module FROM (SELECT path FROM refs UNION ALL SELECT 'src/' || path FROM refs)")
def module_keys(spark: SparkSession, d: str) -> DataFrame:
    refs = page_refs(spark, d).select("path")
    every = refs.unionByName(refs.select(F.concat(F.lit("src/"), F.col("path")).alias("path")))
    return every.select("path", module_key("path").alias("module"))
