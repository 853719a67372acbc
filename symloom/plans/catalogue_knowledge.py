"""Queries of written indexes, documents, renderers and the maintenance of tables, each with SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.text import match_expression_of, match_limit_of
from symloom.operators.diff import delete_symbols_by_path, insert_claims, sha_diff, staleness_of, to_extract, usage_totals
from symloom.operators.fusion import Knowledge, impact_of_change, symbol_contexts
from symloom.operators.history import pivot_files
from symloom.operators.resolve import documented_claims, resolve_symbols
from symloom.operators.textindex import build_index, update_index
from symloom.plans.batch import context_batch, intent_matches
from symloom.plans.catalogue import PART_CLAIMS, SEVERITY_RANK, _query, _read, bm25_sql, dealt, part_claims
from symloom.plans.render import SUMMARY, compact, compact_impact, error_text, summary_text_of
from symloom.sources.artifact import nest
from symloom.sources.extraction import explode_claims, parse_answers
from symloom.sources.gitlog import FIELD, parse_git_log

# ---- the written index

_SEARCHES = ("blue bolt", "blue_bolt economy", "brushed", "no-such-word")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below the checkpoint folder, else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/symloom-index-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, *texts: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("query_id"), F.lit(t).alias("query")) for k, t in enumerate(texts)])
    return spark.range(1).select(F.inline(rows))


def _searches_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {source}, {bm25_sql(q)} SELECT {k} AS query_id, claim_id, round(bm25, 6) AS bm25 FROM scored)" for k, q in enumerate(_SEARCHES))


@_query(_searches_sql(PART_CLAIMS))
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Several texts in one plan over postings written once."""
    index = build_index(part_claims(spark, d), _folder(spark), "claim_id", ["claim"])
    return index.search(_texts(spark, *_SEARCHES)).select("query_id", F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))


_CHANGED = PART_CLAIMS.replace("replace(p_name, ' ', '_')", "CASE WHEN p_partkey % 10 = 3 THEN 'blue bolt' ELSE replace(p_name, ' ', '_') END") + "\n"


@_query(_searches_sql(_CHANGED))
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the rows gets another text; only their postings are made again."""
    old, path = part_claims(spark, d), _folder(spark)
    build_index(old, path, "claim_id", ["claim"])
    changed = F.col("claim_id") % 10 == 3
    new = old.withColumn("claim", F.when(changed, F.concat(F.lit("blue bolt "), F.col("excerpt"))).otherwise(F.col("claim")))
    index = update_index(new, new.where(changed).select(F.col("claim_id").alias("id")), path, _folder(spark), "claim_id", ["claim"])
    return index.search(_texts(spark, *_SEARCHES)).select("query_id", F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25"))


@_query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '"' || replace(p_name, ' ', '-') || '"' WHEN 2 THEN '"' || p_name || '" OR ' || replace(p_name, ' ', ' OR ')
  WHEN 3 THEN '"' || p_name || ' z-1" OR ' || replace(p_name, ' ', ' OR ') || ' OR "z-1"' ELSE 'é_' || p_partkey END AS expression, CAST(greatest(1, least(50, p_size * 3 - 30)) AS INTEGER) AS matches FROM part""")
def match_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as queries: none, one word, several words, words with joints and marks."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 5
    query = F.when(kind == 0, F.lit(" ?! ")).when(kind == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(kind == 2, F.replace(name, F.lit(" "), F.lit("  .")))
    query = query.when(kind == 3, F.concat(F.replace(name, F.lit(" "), F.lit("(")), F.lit(") z-1"))).otherwise(F.concat(F.lit("'é_"), F.col("p_partkey").cast("string"), F.lit("'")))
    return _read(spark, d, "part").select("p_partkey", match_expression_of(query).alias("expression"), match_limit_of(F.col("p_size") * 3 - 30).cast("int").alias("matches"))


# ---- renderers


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: names come up to twice, each third has a signature."""
    key = F.col("p_partkey")
    sig = F.when(key % 3 == 0, F.concat(F.lit("class "), F.col("p_brand")))
    name = F.concat(F.lit("part"), F.when(key % 10 == 7, key - 1).otherwise(key).cast("string"))
    return _read(spark, d, "part").select(
        F.concat(F.lit("sym:ts:src/p"), key.cast("string"), F.lit(".ts:"), name).alias("id"), name.alias("name"), F.lit("class").alias("kind"),
        F.concat(F.lit("src/p"), key.cast("string"), F.lit(".ts")).alias("path"), F.col("p_size").alias("line"), sig.alias("signature"),
    )


_SYMBOLS = """sy AS (SELECT p_partkey AS k, 'part' || CASE WHEN p_partkey % 10 = 7 THEN p_partkey - 1 ELSE p_partkey END AS name, 'src/p' || p_partkey || '.ts' AS path, p_size AS line,
  CASE WHEN p_partkey % 3 = 0 THEN 'class ' || p_brand END AS signature FROM part), symbols AS (SELECT *, 'sym:ts:' || path || ':' || name AS id FROM sy)"""
_HEAD = "'SYM ' || name || '@' || path || ':' || line || ' class' || chr(10) || coalesce('  SIG ' || signature || chr(10), '')"


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as claims of the parts of their number."""
    c, key = _read(spark, d, "customer"), F.col("c_custkey")
    severity = F.when(key % 3 == 0, "hard").when(key % 3 == 1, "soft").otherwise("context")
    claims = c.select(key.cast("long").alias("claim_id"), F.concat(F.lit("doc"), F.col("c_nationkey").cast("string")).alias("source"), F.lit("d.md").alias("source_path"), F.lit("0").alias("source_sha"), severity.alias("severity"), F.concat(F.lit('say "'), F.col("c_name"), F.lit('"')).alias("claim"), F.when(key % 2 == 0, "why").alias("rationale"), F.lit("").alias("excerpt"))
    return claims, c.select(key.cast("long").alias("claim_id"), (key % 100).alias("k"))


_CLAIMS = """claims AS (SELECT c_custkey AS claim_id, c_custkey % 100 AS k, 'doc' || c_nationkey AS source, ['hard', 'soft', 'context'][c_custkey % 3 + 1] AS severity, 'say \\"' || c_name || '\\"' AS claim,
  CASE WHEN c_custkey % 2 = 0 THEN 'why' END AS rationale FROM customer)"""


def _links(links: DataFrame, symbols: DataFrame) -> DataFrame:
    ids = symbols.select(F.regexp_extract("path", r"p(\d+)\.ts", 1).cast("long").alias("k"), F.col("id").alias("symbol_id"))
    return links.join(ids, "k").select("claim_id", "symbol_id")


def _knowledge(spark: SparkSession, d: str) -> Knowledge:
    symbols, (claims, links) = _symbols(spark, d), _claims(spark, d)
    return Knowledge(symbols, claims, _links(links, symbols))


@_query(f"""WITH {_SYMBOLS}, {_CLAIMS}, tops AS (SELECT k, count(*) FILTER (WHERE severity = 'hard') AS h, count(*) FILTER (WHERE severity = 'soft') AS s, count(*) FILTER (WHERE severity = 'context') AS c,
  arg_min(claim, (({SEVERITY_RANK}), source, claim_id)) AS claim, arg_min(source, (({SEVERITY_RANK}), source, claim_id)) AS source FROM claims GROUP BY k)
SELECT id, {_HEAD} || coalesce('  INTENT hard:' || h || ' soft:' || s || ' context:' || c || '; top="' || claim || '" (' || source || ')' || chr(10), '') AS text FROM symbols LEFT JOIN tops USING (k)""")
def compact_summaries(spark: SparkSession, d: str) -> DataFrame:
    know = _knowledge(spark, d)
    bundles = symbol_contexts(know.symbols.select(F.col("id").alias("symbol_id")), know, ["intent"])
    return bundles.select(F.col("symbol_id").alias("id"), compact(bundles, "summary").alias("text"))


@_query(f"""WITH {_SYMBOLS}, {_CLAIMS}, listed AS (SELECT k, string_agg('  INTENT ' || source || ' ' || severity || ' "' || claim || '"' || chr(10) || coalesce('    RATIONALE "' || rationale || '"' || chr(10), ''), '' ORDER BY {SEVERITY_RANK}, source, claim_id) AS body FROM claims GROUP BY k)
SELECT id, {_HEAD} || coalesce(body, '') AS text FROM symbols LEFT JOIN listed USING (k)""")
def compact_claims(spark: SparkSession, d: str) -> DataFrame:
    know = _knowledge(spark, d)
    bundles = symbol_contexts(know.symbols.select(F.col("id").alias("symbol_id")), know, ["intent"])
    return bundles.select(F.col("symbol_id").alias("id"), compact(bundles).alias("text"))


_TYPES_LINE = "CASE k % 3 WHEN 0 THEN '  TYPES extends=Base implements=[I, J] used_by=[]' ELSE '  TYPES extends=[A, B] implements=[] used_by=[U]' END || chr(10)"


@_query(f"WITH {_SYMBOLS} SELECT id, {_HEAD} || {_TYPES_LINE} AS text FROM symbols")
def compact_types(spark: SparkSession, d: str) -> DataFrame:
    symbols = dealt(_symbols(spark, d), "id")  # joins by id keep these tasks, where few bytes would be put into one
    edge = lambda relation, name, n: F.struct(F.lit(relation).alias("relation"), F.lit(name).alias("name"), F.lit(n).alias("ordinal"))
    third = F.regexp_extract("path", r"p(\d+)\.ts", 1).cast("long") % 3 == 0
    edges = F.when(third, F.array(edge("extends", "Base", 0), edge("implements", "I", 0), edge("implements", "J", 1))).otherwise(F.array(edge("extends", "A", 0), edge("extends", "B", 1), edge("used_by", "U", 0)))
    know = Knowledge(symbols, type_edges=symbols.select(F.col("id").alias("symbol_id"), F.inline(edges)))
    bundles = symbol_contexts(symbols.select(F.col("id").alias("symbol_id")), know, ["types"])
    return bundles.select(F.col("symbol_id").alias("id"), compact(bundles, "deep").alias("text"))


@_query(f"""WITH {_SYMBOLS}, {_CLAIMS}, n AS (SELECT k, count(*) FILTER (WHERE severity = 'hard') AS h, count(*) FILTER (WHERE severity = 'soft') AS s, count(*) FILTER (WHERE severity = 'context') AS c FROM claims GROUP BY k)
SELECT id, 'IMPACT ' || id || chr(10) || '  RISK_SIGNALS' || chr(10) || '    hot: no (0<5 commits)' || chr(10) || '    test_coverage: 0 test file(s) referenced' || chr(10) || '    diagnostics: 0' || chr(10)
  || '    intent_density: ' || coalesce(h, 0) || ' hard / ' || coalesce(s, 0) || ' soft / ' || coalesce(c, 0) || ' context' AS text FROM symbols LEFT JOIN n USING (k)""")
def compact_impacts(spark: SparkSession, d: str) -> DataFrame:
    know = _knowledge(spark, d)
    impacts = impact_of_change(know.symbols.select(F.col("id").alias("symbol_id")), know, ["intent"])
    head = F.array_join(F.slice(F.split(compact_impact(impacts), "\n"), 1, 6), "\n")
    return impacts.select(F.col("symbol_id").alias("id"), head.alias("text"))


@_query(f"""WITH {_SYMBOLS}, asked AS (SELECT p_partkey AS input_pos, 'part' || p_partkey AS input FROM part), found AS (SELECT input_pos, input, id, path, line FROM asked LEFT JOIN symbols ON name = input),
told AS (SELECT input_pos, input, count(id) AS n, string_agg('  CAND ' || id || ' ' || path || ':' || line || ' class' || chr(10), '' ORDER BY id) AS listed FROM found GROUP BY 1, 2)
SELECT input_pos, CASE n WHEN 0 THEN 'not_found' ELSE 'disambiguation_required' END AS code, CASE n WHEN 0 THEN 'ERR not_found' || chr(10) || '  MESSAGE Symbol ''' || input || ''' not found. Try find_by_intent if you''re searching by concept rather than name.' || chr(10)
  ELSE 'ERR disambiguation_required' || chr(10) || '  MESSAGE Symbol ''' || input || ''' matches ' || n || ' candidates. Pass file_hint to disambiguate.' || chr(10) || listed END AS text FROM told WHERE n <> 1""")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    symbols = _symbols(spark, d)
    asked = _read(spark, d, "part").select(F.col("p_partkey").alias("input_pos"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("input"), F.lit(None).cast("string").alias("file_hint"))
    return error_text(resolve_symbols(asked, symbols), symbols).select("input_pos", "code", "text")


def _part_of(n: int, of: int, name: str) -> str:
    return f"'--- get_symbol_context: {name} ({n} of {of}) ---' || chr(10)"


_MISSING = "'ERR not_found' || chr(10) || '  MESSAGE Symbol ''nothing'' not found. Try find_by_intent if you''re searching by concept rather than name.' || chr(10)"


@_query(f"""WITH {_SYMBOLS}, one AS (SELECT name, {_HEAD} AS text FROM symbols WHERE name IN ('part3', 'part5'))
SELECT false AS is_error, {_part_of(1, 3, "part5")} || max(text) FILTER (WHERE name = 'part5') || chr(10) || {_part_of(2, 3, "nothing")} || {_MISSING} || chr(10) || {_part_of(3, 3, "part3")} || max(text) FILTER (WHERE name = 'part3') AS text FROM one
UNION ALL SELECT true, 'ERR all_symbols_failed' || chr(10) || '  COUNT 1' || chr(10) || chr(10) || {_part_of(1, 1, "nothing")} || {_MISSING}""")
def context_batches(spark: SparkSession, d: str) -> DataFrame:
    know = _knowledge(spark, d)
    some = context_batch(spark, [" part5 ", "nothing", "part3", "part5"], know, include=[])
    return some.unionByName(context_batch(spark, ["nothing"], know, include=[])).select("text", "is_error")


@_query(f"""WITH {_SYMBOLS}, {_CLAIMS} SELECT 'MATCHES 1 [query="000000001"]' || chr(10) || '  SYM ' || id || ' ' || path || ':' || line || ' class' || chr(10) || coalesce('    SIG ' || signature || chr(10), '')
  || '    INTENT ' || source || ' ' || severity || ' "' || claim || '"' || chr(10) AS text FROM claims JOIN symbols USING (k) WHERE claim_id = 1""")
def intent_match_text(spark: SparkSession, d: str) -> DataFrame:
    return intent_matches(spark, "000000001", _knowledge(spark, d))


_RUN_SQL = " || ".join(f"'{name}=' || {value} || chr(10)" for name, value in (
    ("files_extracted", "count(*)"), ("files_unchanged", "count(*) FILTER (WHERE o_orderstatus = 'O')"), ("files_deleted", "count(*) FILTER (WHERE o_orderstatus = 'F')"), ("claims_written", "count(*) FILTER (WHERE o_orderpriority = '1-URGENT')"),
    ("symbols_indexed", "0"), ("unresolved_candidates", "0"), ("unresolved_frontmatter_hints", "0"), ("git_commits_indexed", "count(DISTINCT o_orderdate)"), ("extracted_at_sha", "coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END), 'null')"),
    ("atlas_exported", "CAST(count(*) > 10 AS VARCHAR)"), ("wall_clock_ms", "0"), ("api_calls", "0"), ("input_tokens", "sum(o_orderkey)"), ("output_tokens", "0"), ("cost_usd", "printf('%.4f', CAST(sum(o_orderkey) AS DOUBLE) / 16)"), ("extraction_errors", "0"),
))


@_query(f"SELECT o_custkey, {_RUN_SQL} AS text FROM orders GROUP BY o_custkey")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a run."""
    nothing = F.lit(0)
    revision = F.max(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))))
    told = {
        "files_extracted": F.count(F.lit(1)), "files_unchanged": F.count_if(F.col("o_orderstatus") == "O"), "files_deleted": F.count_if(F.col("o_orderstatus") == "F"), "claims_written": F.count_if(F.col("o_orderpriority") == "1-URGENT"),
        "git_commits_indexed": F.count_distinct("o_orderdate"), "extracted_at_sha": revision, "atlas_exported": F.count(F.lit(1)) > 10, "input_tokens": F.sum("o_orderkey"), "cost_usd": F.sum("o_orderkey").cast("double") / 16,
    }
    runs = _read(spark, d, "orders").groupBy("o_custkey").agg(*[c.alias(n) for n, c in told.items()])
    return runs.select("o_custkey", summary_text_of({name: F.col(name) if name in told else nothing for name in SUMMARY}).alias("text"))


# ---- maintenance


@_query("""WITH new AS (SELECT s_suppkey, 'doc' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS source_path FROM supplier),
numbered AS (SELECT s_suppkey, source_path, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY source_path, s_suppkey) AS claim_id FROM new)
SELECT claim_id, source_path, 's' || s_suppkey AS claim, 'x,y' || s_suppkey AS symbols FROM numbered""")
def claim_numbers(spark: SparkSession, d: str) -> DataFrame:
    old = _read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("claim_id"), F.lit("old").alias("source_path"), F.col("c_name").alias("claim"))
    links = old.select("claim_id", F.lit("z").alias("symbol_id"))
    key = F.col("s_suppkey")
    ids = F.array(F.lit("x"), F.concat(F.lit("y"), key.cast("string")), F.lit("x"))
    new = _read(spark, d, "supplier").select(F.concat(F.lit("doc"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("source_path"), key.alias("ordinal"), F.concat(F.lit("s"), key.cast("string")).alias("claim"), ids.alias("symbol_ids"))
    claims, linked = insert_claims(old, links, new)
    named = linked.groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_list("symbol_id")), ",").alias("symbols"))
    return claims.where("source_path <> 'old'").join(named, "claim_id")


@_query("""SELECT o_orderkey, ['unknown', 'unknown', 'current', 'stale'][o_orderkey % 4 + 1] AS status, [2, 2, 0, 1][o_orderkey % 4 + 1] AS exit_code FROM orders""")
def staleness_status(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    sha = key.cast("string")
    rows = _read(spark, d, "orders").select("o_orderkey", F.when(key % 4 != 0, sha).alias("extracted_sha"), F.when(key % 4 == 1, "").when(key % 4 == 3, F.lit("head")).otherwise(sha).alias("head_sha"))
    return staleness_of(rows).select("o_orderkey", "status", "exit_code")


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS BIGINT) AS claim_id FROM part WHERE p_size > 10")
def symbols_deleted(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part")
    symbols = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("path"))
    links = part.select(F.col("p_partkey").cast("long").alias("claim_id"), F.col("p_partkey").cast("string").alias("symbol_id"))
    gone = part.where("p_size <= 10").select(F.col("p_size").cast("string").alias("path"))
    kept, linked = delete_symbols_by_path(symbols, links, gone)
    return kept.join(linked, F.col("id") == F.col("symbol_id")).select("id", "claim_id")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 3 <> 0")
def paths_to_extract(spark: SparkSession, d: str) -> DataFrame:
    """Each third order is unchanged, each third is changed and each third is new; others are gone."""
    key = F.col("o_orderkey")
    now = _read(spark, d, "orders").select(key.cast("string").alias("path"), key.cast("string").alias("sha"))
    then = _read(spark, d, "orders").where(key % 3 < 2).select(key.cast("string").alias("path"), F.when(key % 3 == 0, key).otherwise(-key).cast("string").alias("sha"))
    old = then.unionByName(then.select(F.concat(F.lit("gone"), F.col("path")).alias("path"), "sha"))
    return to_extract(sha_diff(old, now))


@_query("""WITH c AS (SELECT c_custkey AS claim_id, 'part ' || c_custkey % 300 AS candidate, 'own' || c_custkey AS documented FROM customer)
SELECT claim_id, documented || coalesce(',' || string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)), '') AS symbols FROM c LEFT JOIN part ON 'part ' || p_partkey % 250 = candidate GROUP BY claim_id, documented""")
def docstring_attribution(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    extracted = _read(spark, d, "customer").select(key.alias("claim_id"), F.concat(F.lit("own"), key.cast("string")).alias("documented_id"), F.array(F.concat(F.lit("part "), (key % 300).cast("string")), F.lit("no such name")).alias("symbol_candidates"))
    part = F.col("p_partkey")
    symbols = _read(spark, d, "part").select(part.cast("string").alias("id"), F.concat(F.lit("part "), (part % 250).cast("string")).alias("name"))
    rows = documented_claims(dealt(extracted, "symbol_candidates"), symbols)
    others = F.array_remove("symbol_ids", F.col("documented_id"))
    return rows.select("claim_id", F.array_join(F.concat(F.array("documented_id"), others), ",").alias("symbols"))


@_query("""SELECT CAST(sum(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE turn + 1 END) AS BIGINT) AS input_tokens, CAST(sum(turn * 2) AS BIGINT) AS output_tokens,
  round((sum(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE turn + 1 END) * 15.0 + sum(turn * 2) * 75.0) / 1e6, 6) AS cost_usd FROM conversations""")
def usage_sums(spark: SparkSession, d: str) -> DataFrame:
    usage = _read(spark, d, "conversations").select(F.when(F.col("conv_id") % 5 != 0, F.col("turn") + 1).cast("long").alias("input_tokens"), (F.col("turn") * 2).cast("long").alias("output_tokens"))
    return usage_totals(usage).withColumn("cost_usd", F.round("cost_usd", 6))


# ---- sources


def _log(spark: SparkSession, d: str) -> DataFrame:
    """One log for each customer with the customer's orders as commits and their parts as files."""
    files = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("\n"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"))), asc=False), "\n")).alias("files"))
    o = _read(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat_ws(FIELD, F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.col("o_custkey").cast("string"), F.lit("@x")), F.concat(F.col("o_orderpriority"), F.lit(f"{FIELD}y")))
    blocks = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(head, F.coalesce("files", F.lit("")))), "\n\n").alias("value"))
    return parse_git_log(blocks.select(F.concat(F.col("value"), F.lit("\n\nbroken header\nfile\n")).alias("value")))


@_query("""WITH f AS (SELECT l_orderkey, string_agg(DISTINCT 'src/' || l_partkey, ',' ORDER BY 'src/' || l_partkey) AS files FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS sha, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey || '@x' AS author_email, o_orderpriority || chr(31) || 'y' AS message, coalesce(files, '') AS files FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def git_log_commits(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).withColumn("files", F.array_join("files", ","))


@_query("SELECT DISTINCT 'src/' || l_partkey AS file_path, CAST(l_orderkey AS VARCHAR) AS commit_sha FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey")
def git_log_files(spark: SparkSession, d: str) -> DataFrame:
    return pivot_files(_log(spark, d))[1]


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS source_path, 0 AS ordinal, 'part ' || c_custkey AS candidates, 'claim of ' || c_custkey AS claim, 'hard' AS severity FROM customer WHERE c_custkey % 5 < 2""")
def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    """Good answers, one with a second entry of a wrong severity, a text, a list and a cut answer."""
    key = F.col("c_custkey").cast("string")
    good = F.concat(F.lit('{"symbol_candidates":["part '), key, F.lit('"],"claim":"claim of '), key, F.lit('","severity":"hard","rationale":"r","excerpt":"e"}'))
    bad = F.lit(',{"symbol_candidates":[],"claim":"x","severity":"fatal","rationale":"r","excerpt":"e"}')
    whole = F.concat(F.lit('{"claims":['), good, F.when(F.col("c_custkey") % 5 == 1, bad).otherwise(F.lit("")), F.lit("]}"))
    raw = F.when(F.col("c_custkey") % 5 < 2, whole).when(F.col("c_custkey") % 5 == 2, F.lit("Sorry.")).when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("["), good, F.lit("]"))).otherwise(F.substring(whole, 1, 40))
    answers = _read(spark, d, "customer").select(key.alias("source_path"), raw.alias("raw_json"))
    return explode_claims(parse_answers(answers)).select("source_path", "ordinal", F.array_join("symbol_candidates", ",").alias("candidates"), "claim", "severity")


def _artifact(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    symbols, (claims, links) = _symbols(spark, d), _claims(spark, d)
    blank: Column = F.lit("")
    return {
        "symbols": symbols.withColumns({"parent_id": blank, "file_sha": F.lit(None).cast("string")}), "claims": claims, "claim_symbols": _links(links, symbols),
        "commits": _log(spark, d).drop("files"), "file_commits": pivot_files(_log(spark, d))[1], "source_shas": spark.createDataFrame([], "source_path string, source_sha string"),
    }


@_query(f"""WITH {_SYMBOLS}, {_CLAIMS} SELECT c.source, c.severity, replace(c.claim, '\\"', '"') AS claim, c.rationale, CAST(NULL AS VARCHAR) AS excerpt, coalesce(s.id, '') AS symbol_ids FROM claims c LEFT JOIN symbols s USING (k)""")
def artifact_claims(spark: SparkSession, d: str) -> DataFrame:
    return nest(_artifact(spark, d))["claims"].select("source", "severity", "claim", "rationale", "excerpt", F.array_join("symbol_ids", ",").alias("symbol_ids"))


@_query(f"WITH {_SYMBOLS} SELECT id, name, signature, CAST(NULL AS VARCHAR) AS parent_id, '' AS file_sha FROM symbols")
def artifact_symbols(spark: SparkSession, d: str) -> DataFrame:
    return nest(_artifact(spark, d))["symbols"].select("id", "name", "signature", "parent_id", "file_sha")


# ---- a run


@_query("""WITH old AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 < 3), found AS (SELECT c_custkey AS k, 'part' || c_custkey % 30 AS name FROM customer WHERE c_custkey % 4 > 0)
SELECT source, claim, coalesce(string_agg(symbol_id, ',' ORDER BY symbol_id), '') AS symbols FROM (
  SELECT 'd' || k AS source, 'new ' || k AS claim, 'p' || p_partkey AS symbol_id FROM found LEFT JOIN part ON 'part' || p_partkey = name AND p_partkey % 2 = 0 WHERE k % 4 <> 1
  UNION ALL SELECT 'old', 'old ' || k, 'p0' FROM old WHERE k % 4 = 1) GROUP BY 1, 2""")
def index_runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a run drops (0), keeps (1), reads again (2) and finds new (3), with the symbols of their claims afterwards."""
    from symloom.plans.index_run import Inputs, index_run
    from symloom.schemas import CLAIM_SYMBOLS, CLAIMS, META

    key = F.col("c_custkey").cast("long")
    name = F.concat(F.lit("d"), key.cast("string"), F.lit(".md"))
    c = _read(spark, d, "customer").select(key.alias("k"), name.alias("path"))
    old, found, part = c.where("k % 4 < 3"), c.where("k % 4 > 0"), _read(spark, d, "part")
    blank = {"source_sha": "0", "severity": "soft", "rationale": "", "excerpt": ""}
    claims = old.select(F.col("k").alias("claim_id"), F.lit("old").alias("source"), F.col("path").alias("source_path"), F.concat(F.lit("old "), F.col("k")).alias("claim"), *[F.lit(v).alias(n) for n, v in blank.items()])
    symbols = part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.concat(F.lit("part"), F.col("p_partkey")).alias("name"))
    tables = {
        "symbols": symbols.where("id = 'p0'"), "claims": claims.select(*spark.createDataFrame([], CLAIMS).columns), "claim_symbols": claims.select("claim_id", F.lit("p0").alias("symbol_id")).select(*spark.createDataFrame([], CLAIM_SYMBOLS).columns),
        "source_shas": old.select(F.col("path").alias("source_path"), F.when(F.col("k") % 4 == 1, "same").otherwise("before").alias("source_sha")), "meta": spark.createDataFrame([("version", "1.3")], META),
    }
    wanted = F.array(F.concat(F.lit("part"), (F.col("k") % 30).cast("string")), F.lit("nothing"))
    extracted = found.select(F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), wanted.alias("symbol_candidates"), F.concat(F.lit("new "), F.col("k")).alias("claim"), F.lit("soft").alias("severity"), F.lit("").alias("rationale"), F.lit("").alias("excerpt"))
    files = found.select("path", F.when(F.col("k") % 4 == 1, "same").otherwise("after").alias("sha"), F.lit("").alias("text"))
    history = _log(spark, d)
    inputs = Inputs(files, symbols.where("cast(substring(id, 2) as long) % 2 = 0"), extracted, found.select("path"), spark.createDataFrame([], "source_path string, symbols array<string>"), history.drop("files"), pivot_files(history)[1], head_sha="head")
    out = index_run(tables, inputs, "now").tables
    linked = out["claim_symbols"].groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_list("symbol_id")), ",").alias("symbols"))
    return out["claims"].join(linked, "claim_id", "left").select("source", "claim", F.coalesce("symbols", F.lit("")).alias("symbols"))
