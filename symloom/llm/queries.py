"""The corpus operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.bpe_codec import bpe_encode
from symloom.llm.decontaminate import overlaps
from symloom.llm.exact_dedup import exact_dedup
from symloom.llm.html_extract import extract_text
from symloom.llm.language_id import language_id
from symloom.llm.line_dedup import line_dedup
from symloom.llm.merkle_manifest import manifest, proofs, tampered_leaf
from symloom.llm.minhash_dedup import near_dedup
from symloom.llm.ranked_search import ranked_search
from symloom.llm.sharding import assign_shards, lookup_table
from symloom.llm.substring_dedup import repeated_passages
from symloom.llm.suffix_dedup import suffix_dedup
from symloom.llm.token_counts import token_counts
from symloom.llm.worker import bound_batches
from symloom.session import ship_package

#: Shards of the sharding query.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def word_vocabulary() -> str:
    """The vocabulary file of the token queries."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), word_vocabulary())


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_documents(spark, sf_dir), word_vocabulary(), digests=True)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir), k=2, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id")
    return assign_shards(docs, "doc_id", lookup_table(SHARDS)).select("doc_id", "slot", "shard")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="largest")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(manifest(_documents(spark, sf_dir), changed=tampered_leaf()))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_html_extract": op5_html_extract,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_ranked_search": op13_ranked_search,
}

_STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _line_sql() -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, p, line, translate(regexp_replace(line, {_STRIP}), {_LOWER}) AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS top_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.p, a.line, c.k IS NOT NULL AND a.doc_id < c.top_doc AS lost FROM keyed a LEFT JOIN common c ON a.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _near_sql() -> str:
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
    WHEN len(ws) = 1 THEN ws ELSE [] END)) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
  SELECT s.doc_id, s.s, z.n FROM shingles s JOIN sizes z USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id"""


def _shard_sql() -> str:
    table = lookup_table(SHARDS)
    hashed = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"
    return f"""
SELECT doc_id, slot, CAST(([{",".join(map(str, table))}])[slot + 1] AS BIGINT) AS shard
FROM (SELECT doc_id, {hashed} % {len(table)} AS slot FROM documents)"""


def _merkle_sql() -> str:
    """Trees as lists that shrink level by level; a proof is followed level by level, with a bitwise CRC-32."""
    shift = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    steps = ", ".join(f"s{k} AS (SELECT b, {shift} AS c FROM s{k - 1})" for k in range(1, 9))
    framed = " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR) END" for f in ("doc_id", "source", "lang", "n_chars", "{t}"))
    of = lambda text: "sha256(" + framed.replace("{t}", text) + ")"
    run = "list_slice(hs, (i // 3) * 3 + 1, least((i // 3) * 3 + 3, len(hs)))"
    return f"""
WITH RECURSIVE s0 AS (SELECT range AS b, range AS c FROM range(256)), {steps},
crc_table AS (SELECT list(c ORDER BY b) AS t FROM s8),
crc(doc_id, p, c) AS (
  SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, p + 1, xor(c >> 8, t[xor(c & 255, ascii(substr(CAST(doc_id AS VARCHAR), p + 1, 1))) + 1])
  FROM crc, crc_table WHERE p < length(CAST(doc_id AS VARCHAR))
), hit AS (
  SELECT doc_id, xor(c, 4294967295::BIGINT) % 2 = 0 AS hit FROM crc WHERE p = length(CAST(doc_id AS VARCHAR))
), leaves AS (
  SELECT d.doc_id, d.source, {of("text")} AS leaf, CASE WHEN hit THEN {of("replace(text, chr(10), '')")} ELSE {of("text")} END AS changed,
         row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS i
  FROM documents d JOIN hit USING (doc_id)
), levels(source, k, hs) AS (
  SELECT source, 0, list(leaf ORDER BY i) FROM leaves GROUP BY source
  UNION ALL
  SELECT source, k + 1, list_transform(range(0, (len(hs) + 2) // 3), lambda j: sha256(array_to_string(list_slice(hs, j * 3 + 1, least(j * 3 + 3, len(hs))), '')))
  FROM levels WHERE len(hs) > 1
), subroots AS (
  SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM levels WHERE len(hs) = 1
), tops(k, hs) AS (
  SELECT 0, list(subroot ORDER BY i) FROM subroots
  UNION ALL
  SELECT k + 1, list_transform(range(0, (len(hs) + 2) // 3), lambda j: sha256(array_to_string(list_slice(hs, j * 3 + 1, least(j * 3 + 3, len(hs))), '')))
  FROM tops WHERE len(hs) > 1
), heights AS (SELECT source, max(k) AS h FROM levels GROUP BY source),
sides AS (
  SELECT doc_id, k, array_to_string(list_slice(hs, j - j % 3 + 1, j), '') AS l, array_to_string(list_slice(hs, j + 2, least(j - j % 3 + 3, len(hs))), '') AS r
  FROM (SELECT x.doc_id, v.k, v.hs, x.i // CAST(power(3, v.k) AS BIGINT) AS j FROM leaves x JOIN levels v ON v.source IS NOT DISTINCT FROM x.source WHERE len(v.hs) > 1)
  UNION ALL
  SELECT doc_id, k, array_to_string(list_slice(hs, j - j % 3 + 1, j), ''), array_to_string(list_slice(hs, j + 2, least(j - j % 3 + 3, len(hs))), '')
  FROM (SELECT x.doc_id, e.h + v.k AS k, v.hs, s.i // CAST(power(3, v.k) AS BIGINT) AS j
        FROM leaves x JOIN subroots s ON s.source IS NOT DISTINCT FROM x.source JOIN heights e ON e.source IS NOT DISTINCT FROM x.source, tops v WHERE len(v.hs) > 1)
), proofs AS (
  SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs FROM sides GROUP BY doc_id
), climb(doc_id, k, h, ls, rs) AS (
  SELECT x.doc_id, 0, changed, ls, rs FROM leaves x JOIN proofs USING (doc_id)
  UNION ALL
  SELECT doc_id, k + 1, sha256(ls[k + 1] || h || rs[k + 1]), ls, rs FROM climb WHERE k < len(ls)
)
SELECT x.doc_id, x.leaf, s.subroot, t.hs[1] AS root, p.proof_sha256, c.h AS folded_root, c.h = t.hs[1] AS verified
FROM leaves x JOIN subroots s ON s.source IS NOT DISTINCT FROM x.source JOIN proofs p USING (doc_id)
JOIN climb c ON c.doc_id = x.doc_id AND c.k = len(c.ls), (SELECT hs FROM tops WHERE len(hs) = 1) t"""


def _ranked_sql() -> str:
    terms = f"unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms} AS term FROM documents) GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, {terms} AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, whole WHERE term IN (SELECT term FROM wanted) GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def _suffix_sql() -> str:
    """Every string of 200 bytes by its hash, out of hexadecimal pieces of 2000 starts; bytes are two digits."""
    return """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT *, length(h) // 2 AS n_bytes FROM texts
), pieces AS (
  SELECT r, c * 2000 AS base, substr(h, c * 4000 + 1, 4398) AS h FROM (SELECT r, h, unnest(range((n_bytes - 200) // 2000 + 1)) AS c FROM sized WHERE n_bytes >= 200)
), strings AS (
  SELECT r, base + p AS p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, base, h, unnest(range(least(2000, length(h) // 2 - 199))) AS p FROM pieces)
), twice AS (
  SELECT k FROM strings GROUP BY k HAVING count(*) > 1
), starts AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM strings WHERE k IN (SELECT k FROM twice)
), spans AS (
  SELECT r, g, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM starts) GROUP BY r, g
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_byte FROM spans
), cut AS (
  SELECT g.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps g JOIN sized s ON s.r = g.r GROUP BY g.r
)
SELECT s.doc_id, s.n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, s.h))) AS kept_sha256
FROM sized s LEFT JOIN cut c ON c.r = s.r"""


ORACLE_SQL: dict[str, str] = {
    "op12_suffix_dedup": _suffix_sql(),
    "op13_ranked_search": _ranked_sql(),
    "op11_merkle_manifest": _merkle_sql(),
    "op2_minhash_dedup": _near_sql(),
    "op3_line_dedup": _line_sql(),
    "op7_sharding": _shard_sql(),
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
