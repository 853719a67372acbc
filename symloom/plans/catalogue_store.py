"""Queries of versioned stores and segmented indexes, each with SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.fusion import Knowledge
from symloom.operators.history import co_change_top
from symloom.operators.resolve import symbols_of_paths, symbols_where
from symloom.operators.segments import SegmentIndex, build_segments
from symloom.plans.batch import context_batch
from symloom.plans.catalogue import DOC_CLAIMS, PART_CLAIMS, PHRASE_QUERY, QUERY, SINGLE, _query, _read, bm25_sql, doc_claims, part_claims
from symloom.plans.catalogue_knowledge import _CLAIMS, _SEARCHES, _SYMBOLS, _claims, _links, _symbols
from symloom.plans.index_run import Inputs
from symloom.plans.store_run import blank_tables, run_into_store
from symloom.schemas import META
from symloom.sources.artifact import empty_history, import_elements, scan_artifact, section_of, setting_of, write_artifact
from symloom.sources.config import read_configs
from symloom.sources.files import scan_prose, scan_sources
from symloom.sources.folders import shared_folder
from symloom.sources.provider import TableSource, conformance
from symloom.sources.snapshots import SnapshotStore, migrate, open_tables, save_tables
from symloom.sources.trees import make_folder, read_tree, write_tree
from symloom.streaming.incremental import Baseline

_TOP = 20
_DOC_SEARCHES = (QUERY, PHRASE_QUERY, SINGLE, "nowhere the", "the")


def _tops_sql(source: str, searches: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {source}, {bm25_sql(q)} SELECT {k} AS query_id, claim_id, round(bm25, 6) AS bm25 FROM scored ORDER BY scored.bm25, claim_id LIMIT {_TOP})" for k, q in enumerate(searches))


def _tops(index: SegmentIndex, searches: tuple[str, ...]) -> DataFrame:
    each = [index.top(q, _TOP).select(F.lit(k).alias("query_id"), F.col("id").alias("claim_id"), F.round("bm25", 6).alias("bm25")) for k, q in enumerate(searches)]
    return reduce(DataFrame.unionByName, each)


# ---- the segmented index


@_query(_tops_sql(DOC_CLAIMS, _DOC_SEARCHES))
def segment_top(spark: SparkSession, d: str) -> DataFrame:
    """The best of several texts, from blocks that can hold them."""
    index = build_segments(doc_claims(spark, d), shared_folder(spark, "segments"), "claim_id", ["claim"])
    return _tops(index, _DOC_SEARCHES)


_UPDATED = PART_CLAIMS.replace("replace(p_name, ' ', '_')", "CASE WHEN p_partkey % 10 = 3 THEN 'blue bolt' ELSE replace(p_name, ' ', '_') END").replace("FROM part", "FROM part WHERE p_partkey % 10 <> 7")


@_query(_tops_sql(_UPDATED, _SEARCHES))
def segment_updates(spark: SparkSession, d: str) -> DataFrame:
    """Rows come, change twice and go, each time as a segment of their own."""
    rows, last = part_claims(spark, d), F.col("claim_id") % 10
    index = build_segments(rows.where(last != 1), shared_folder(spark, "segments"), "claim_id", ["claim"])
    edited = lambda text: rows.where(last == 3).withColumn("claim", F.concat(F.lit(text), F.col("excerpt")))
    index.update(rows.where(last == 1).unionByName(edited("bolt economy blue ")), "claim_id", ["claim"])
    index.update(edited("blue bolt "), "claim_id", ["claim"], rows.where(last == 7).select(F.col("claim_id").alias("id")))
    return _tops(index, _SEARCHES)


# ---- versioned stores


@_query(f"""WITH {_SYMBOLS}, {_CLAIMS}, n AS (SELECT k, count(*) AS claims FROM claims GROUP BY k)
SELECT 1 AS version, id, line, coalesce(claims, 0) AS claims FROM symbols LEFT JOIN n USING (k)
UNION ALL SELECT 2, id, line + 1, coalesce(claims, 0) FROM symbols LEFT JOIN n USING (k) WHERE k % 3 <> 0""")
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a store, read side by side after the second was committed."""
    symbols, (claims, links) = _symbols(spark, d), _claims(spark, d)
    links = _links(links, symbols)
    store = SnapshotStore(spark, shared_folder(spark, "store"))
    first = save_tables(store, {"symbols": symbols, "claims": claims, "claim_symbols": links})
    kept = symbols.where(F.regexp_extract("path", r"p(\d+)\.ts", 1).cast("long") % 3 != 0).withColumn("line", (F.col("line") + 1).cast("int"))
    save_tables(store, {"symbols": kept, "claim_symbols": links.join(kept.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")}, first)

    def told(version: int) -> DataFrame:
        tables = open_tables(store, version)
        counts = tables["claim_symbols"].groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("claims"))
        return tables["symbols"].join(counts, "id", "left").select(F.lit(version).alias("version"), "id", "line", F.coalesce("claims", F.lit(0)).alias("claims"))

    return told(1).unionByName(told(2))


@_query(f"WITH {_SYMBOLS} SELECT id, line, 'typescript' AS language, CAST(NULL AS VARCHAR) AS parent_id, 4 AS format, 4 AS versions FROM symbols")
def snapshot_migrated(spark: SparkSession, d: str) -> DataFrame:
    """A store of the first format, brought to the present one step by step."""
    symbols, (claims, links) = _symbols(spark, d), _claims(spark, d)
    store = SnapshotStore(spark, shared_folder(spark, "store"))
    tables = {"symbols": symbols, "claims": claims, "claim_symbols": _links(links, symbols), "meta": _read(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_name").alias("value"))}
    store.commit(None, {name: [store.write(name, rows)] for name, rows in tables.items()}, 1)
    last = migrate(store)
    return open_tables(store)["symbols"].select("id", "line", "language", "parent_id", F.lit(last.format).alias("format"), F.lit(len(store.versions())).alias("versions"))


# ---- trees of files


@_query("""SELECT 'docs/d' || page_id % 7 || '/p' || page_id || CASE WHEN page_id % 3 = 0 THEN '.MD' ELSE '.md' END AS rel_path, strlen(html) AS size, sha256(html) AS sha,
  CASE WHEN page_id % 7 < 2 THEN 'adr' ELSE 'doc' END AS bucket FROM pages WHERE page_id % 4 <> 1""")
def tree_prose(spark: SparkSession, d: str) -> DataFrame:
    """A tree written from pages, dot entries and other files among them; two of its folders hold decision records."""
    root = shared_folder(spark, "tree")
    kind = F.when(F.col("page_id") % 4 == 1, ".html").when(F.col("page_id") % 3 == 0, ".MD").otherwise(".md")
    rows = _read(spark, d, "pages").select(F.concat(F.lit("docs/d"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), kind).alias("rel_path"), F.col("html").alias("text"))
    write_tree(rows.unionByName(rows.select(F.concat(F.lit("docs/.git/"), "rel_path").alias("rel_path"), "text")), root)
    top = root
    found = scan_prose(spark, [f"{top}/docs/d0", f"{top}/docs/d1"], [f"{top}/docs"], top)
    return found.select("rel_path", F.octet_length("text").cast("long").alias("size"), "sha", "bucket")


@_query("""SELECT 'src/d' || p_partkey % 9 || '/f' || p_partkey || '.py' AS rel_path, strlen(p_name) AS size, sha256(p_name) AS sha, p_name AS text FROM part WHERE p_partkey % 9 = 4""")
def tree_source(spark: SparkSession, d: str) -> DataFrame:
    """One folder of a tree, by a source of Spark's that lists no other."""
    root = shared_folder(spark, "tree")
    rows = _read(spark, d, "part").select(F.concat(F.lit("src/d"), (F.col("p_partkey") % 9).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("rel_path"), F.col("p_name").alias("text"))
    write_tree(rows.unionByName(rows.withColumn("rel_path", F.replace("rel_path", F.lit("/f"), F.lit("/node_modules/f")))), root)
    return read_tree(spark, root, [".py"], skip="sources", below="src/d4/").select("rel_path", "size", "sha", "text")


@_query("""SELECT 'src/d' || p_partkey % 9 || '/f' || p_partkey || '.ts' AS rel_path, sha256(p_name) AS sha FROM part WHERE p_partkey % 9 <> 0""")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Source files of a tree without folders of foreign code."""
    root, folder = shared_folder(spark, "tree"), F.when(F.col("p_partkey") % 9 == 0, "dist").otherwise(F.concat(F.lit("d"), (F.col("p_partkey") % 9).cast("string")))
    rows = _read(spark, d, "part").select(F.concat(F.lit("src/"), folder, F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("rel_path"), F.col("p_name").alias("text"))
    write_tree(rows, root)
    return scan_sources(spark, root).select("rel_path", "sha")


# ---- large commits

_SWEEPS = "SELECT DISTINCT l_partkey AS file_path, CASE WHEN l_linenumber = 1 THEN 'all ' || l_returnflag ELSE 'order ' || l_orderkey END AS commit_sha FROM lineitem"


@_query(f"""WITH files AS ({_SWEEPS}), pairs AS (
  SELECT a.file_path, b.file_path AS other_path, count(*) AS commits FROM files a JOIN files b ON a.commit_sha = b.commit_sha AND a.file_path <> b.file_path GROUP BY ALL
) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY commits DESC, other_path) AS place FROM pairs) WHERE place <= 5""")
def cochange_sweeping_commits(spark: SparkSession, d: str) -> DataFrame:
    """Three commits touch nearly all files; their pairs are not counted one by one."""
    commit = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("all "), "l_returnflag")).otherwise(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    return co_change_top(_read(spark, d, "lineitem").select(F.col("l_partkey").alias("file_path"), commit.alias("commit_sha")))


# ---- runs and streams over stores


@_query("""SELECT source, claim, symbols, n.c AS claims_written, n.f AS files_extracted, n.s AS symbols_indexed FROM (
  SELECT 'old' AS source, 'old ' || c_custkey AS claim, 'p0' AS symbols FROM customer WHERE c_custkey % 4 = 1
  UNION ALL SELECT 'd' || c_custkey, 'new ' || c_custkey, CASE WHEN 'p' || c_custkey % 30 IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 2 = 0 OR p_partkey = 1) THEN 'p' || c_custkey % 30 ELSE '' END FROM customer WHERE c_custkey % 4 > 1
), (SELECT count(*) AS c, count(*) AS f, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS s FROM customer WHERE c_custkey % 4 > 1) n""")
def store_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into a store: the second drops documents, keeps some, reads others again and finds new ones."""
    key = F.col("c_custkey").cast("long")
    c = _read(spark, d, "customer").select(key.alias("k"), F.concat(F.lit("d"), key.cast("string"), F.lit(".md")).alias("path"))
    part = _read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.concat(F.lit("part"), F.col("p_partkey")).alias("name"), F.lit("class").alias("kind"), F.lit("a.ts").alias("path"), F.lit(1).alias("line"), F.lit("0").alias("file_sha"), F.col("p_partkey").alias("n"))

    def inputs(found: DataFrame, sha: Column, word: str, symbols: DataFrame, wanted: Column) -> Inputs:
        texts = [F.lit(v).alias(n) for n, v in (("severity", "soft"), ("rationale", ""), ("excerpt", ""))]
        extracted = found.select(F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), wanted.alias("symbol_candidates"), F.concat(F.lit(f"{word} "), F.col("k")).alias("claim"), *texts)
        front = F.concat(F.lit("---\nid: "), F.when(F.lit(word) == "old", "old").otherwise(F.concat(F.lit("d"), F.col("k"))), F.lit("\n---\n"))
        blank = spark.createDataFrame([], "source_path string, symbols array<string>")
        history = empty_history(spark)
        return Inputs(found.select("path", sha.alias("sha"), front.alias("text")), symbols.drop("n"), extracted, found.select("path"), blank, *history, head_sha=word)

    store = SnapshotStore(spark, shared_folder(spark, "runs"))
    zero = part.where("n = 1").withColumns({"id": F.lit("p0"), "name": F.lit("part0")})
    run_into_store(store, inputs(c.where("k % 4 < 3"), F.when(F.col("k") % 4 == 1, "same").otherwise("before"), "old", zero.unionByName(part.where("n = 1")), F.array(F.lit("part0"))), "one")
    again = inputs(c.where("k % 4 > 0"), F.when(F.col("k") % 4 == 1, "same").otherwise("after"), "new", part.where("n % 2 = 0"), F.array(F.concat(F.lit("part"), (F.col("k") % 30).cast("string")), F.lit("nothing")))
    done = run_into_store(store, again, "two")
    out = open_tables(store, done.manifest.version)
    linked = out["claim_symbols"].groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_list("symbol_id")), ",").alias("symbols"))
    counts = [F.lit(done.counters[n]).cast("long").alias(n) for n in ("claims_written", "files_extracted", "symbols_indexed")]
    return out["claims"].join(linked, "claim_id", "left").select("source", "claim", F.coalesce("symbols", F.lit("")).alias("symbols"), *counts)


@_query("""WITH e AS (SELECT 'p' || l_partkey AS path, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus || l_suppkey END AS sha, l_linenumber AS batch, l_orderkey * 1000 + l_suppkey AS seq FROM lineitem),
last AS (SELECT path, arg_max(struct_pack(sha := sha), struct_pack(b := batch, s := seq)).sha AS sha FROM e GROUP BY path)
SELECT path, sha FROM last WHERE sha IS NOT NULL""")
def baseline_batches(spark: SparkSession, d: str) -> DataFrame:
    """Seven batches of file events, each committed once; the fourth is sent twice."""
    sha = F.when(F.col("l_returnflag") != "R", F.concat("l_linestatus", F.col("l_suppkey").cast("string")))
    events = _read(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), sha.alias("sha"), F.col("l_linenumber").alias("batch"), (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("seq"))
    baseline = Baseline(SnapshotStore(spark, shared_folder(spark, "baseline")))
    for number in (1, 2, 3, 4, 4, 5, 6, 7):
        baseline.apply(events.where(F.col("batch") == number).drop("batch"), number)
    return baseline.rows()


@_query("""SELECT * FROM (SELECT row_number() OVER (ORDER BY path DESC) AS place, path, name, line, signature FROM (SELECT 'sym:ts:src/p' || p_partkey || '.ts:part' || p_partkey AS path, 'pärt "' || p_partkey || '"' AS name, p_size AS line,
  CASE WHEN p_partkey % 3 = 0 THEN 'class ' || p_brand END AS signature FROM part))""")
def artifact_file(spark: SparkSession, d: str) -> DataFrame:
    """Symbols exported as a document and imported again, with their places in it."""
    key, none = F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    symbols = _read(spark, d, "part").select(
        F.concat(F.lit("sym:ts:src/p"), key, F.lit(".ts:part"), key).alias("id"), F.concat(F.lit('pärt "'), key, F.lit('"')).alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("src/p"), key, F.lit(".ts")).alias("path"), F.col("p_size").alias("line"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("class "), "p_brand")).alias("signature"), none.alias("parent_id"), F.lit("0").alias("file_sha"), F.lit("typescript").alias("language"),
    )
    tables = blank_tables(SnapshotStore(spark, shared_folder(spark, "none"))) | {"symbols": symbols, "meta": spark.createDataFrame([("version", "1.3"), ("generator.symloom_version", "1")], META)}
    root = shared_folder(spark, "artifact")
    make_folder(root)
    write_artifact(tables, f"{root}/a.json")
    elements = scan_artifact(spark, f"{root}/a.json")
    import_elements(elements)  # it is valid
    n = elements.where("section = 'symbols'").count()
    return section_of(elements, "symbols").select((n - F.col("at")).cast("long").alias("place"), F.col("s.id").alias("path"), "s.name", "s.line", "s.signature")


# ---- configurations, sources, batches as JSON

_CONFIGS = (
    "version: 1\nlanguages: [python, go]\ngit: {recent_commits: {n}}\n", "languages:\n  - typescript\nadrs:\n  path: docs/{n}/  # decisions\ndocs:\n  include:\n    - README.md\n    - 'docs/**/*.md'\natlas:\n  committed: false\n",
    "languages: [go]\nextraction:\n  narrow_attribution: drop\n", "languages: [go]\ncolour: {n}\n", "languages: [go\n", "languages: [cobol{n}]\n", "", "languages: [go]\ngit:\n  recent_commits: -{n}\n", "languages: [go]\nversion: 2\n",
)


@_query(f"""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % {len(_CONFIGS)} WHEN 0 THEN 'python,go' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' END AS languages,
  CASE p_partkey % {len(_CONFIGS)} WHEN 0 THEN 'docs/adr' WHEN 1 THEN 'docs/' || p_partkey || '/' WHEN 2 THEN 'docs/adr' END AS adr_path, CASE p_partkey % {len(_CONFIGS)} WHEN 0 THEN '' WHEN 1 THEN 'README.md,docs/**/*.md' WHEN 2 THEN '' END AS include,
  CASE p_partkey % {len(_CONFIGS)} WHEN 0 THEN p_partkey WHEN 1 THEN 5 WHEN 2 THEN 5 END AS recent_commits, CASE p_partkey % {len(_CONFIGS)} WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS committed,
  CASE WHEN p_partkey % {len(_CONFIGS)} = 2 THEN 'drop' END AS attribution, CASE p_partkey % {len(_CONFIGS)} WHEN 3 THEN 'unknown keys colour' WHEN 4 THEN 'line 1: ] is missing' WHEN 5 THEN 'languages: unknown cobol' || p_partkey
  WHEN 6 THEN 'a mapping is needed, not null' WHEN 7 THEN 'git.recent_commits: int is needed, not int' WHEN 8 THEN 'version: 1 is needed' END AS error FROM part""")
def config_files(spark: SparkSession, d: str) -> DataFrame:
    """Configuration files of many code bases, right and wrong ones."""
    key = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, _CONFIGS)), (key % len(_CONFIGS)).cast("int") + 1)
    found = read_configs(_read(spark, d, "part").select(key.cast("string").alias("path"), F.replace(text, F.lit("{n}"), key.cast("string")).alias("text")))
    return found.withColumns({c: F.array_join(c, ",") for c in ("languages", "include")}).withColumn("recent_commits", F.col("recent_commits").cast("long"))


@_query("""SELECT * FROM (VALUES ('ids repeat'), ('kinds are unknown'), ('lines start below 1'), ('names are empty'), ('languages differ'), ('ids disagree with language, path or name'), ('references lead nowhere'), ('severities are unknown')) v(wrong)
WHERE (SELECT count(*) FROM part) > 20""")
def source_conformance(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a source whose rows are spoilt by their number."""
    key = F.col("p_partkey")
    part = _read(spark, d, "part")
    name = F.when(key == 7, F.lit(" ")).otherwise(F.concat(F.lit("N"), key.cast("string")))
    path = F.concat(F.lit("src/p"), key.cast("string"), F.lit(".go"))
    rows = part.select(
        F.concat(F.lit("sym:go:"), path, F.lit(":"), name).alias("id"), F.when(key == 11, "other").otherwise(name).alias("name"), F.when(key == 5, "thing").otherwise("class").alias("kind"), path.alias("path"), F.when(key == 3, 0).otherwise(F.col("p_size")).alias("line"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("parent_id"), F.lit("0").alias("file_sha"), F.when(key == 9, "python").otherwise("go").alias("language"), key.alias("n"),
    )
    symbols = rows.unionByName(rows.where("n = 2")).drop("n")
    pages = _read(spark, d, "pages")
    refs = pages.select(F.lit(0).alias("ordinal"), F.lit("ref:go:b.go:3").alias("ref_id"), F.concat(F.lit("sym:go:gone:"), F.col("page_id").cast("string")).alias("symbol_id"), F.lit("b.go").alias("path"), F.lit(3).alias("line"), F.lit(None).cast("int").alias("col"))
    notes = _read(spark, d, "events").select(F.lit("a.go").alias("path"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("col"), F.col("event_type").alias("severity"), F.col("props").alias("message"))
    wrong = conformance(spark, TableSource("go", symbols, refs, None, notes))
    return spark.createDataFrame([(w,) for w in wrong], "wrong string")


@_query(f"""WITH {_SYMBOLS} SELECT '{{"results":[{{"symbol":"part3","bundle":{{"symbol_id":"' || a.id || '","name":"part3","kind":"class","path":"' || a.path || '","line":' || a.line || ',"signature":"' || a.signature
  || '","intent":null,"refs":null,"tests":null,"types":null,"git":null,"diagnostics":null}},"error":null}},{{"symbol":"nothing","bundle":null,"error":{{"code":"not_found","message":"' AS head, true AS closed FROM symbols a WHERE name = 'part3'""")
def json_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch of two names as JSON: one bundle, one error, up to the error's message."""
    found = context_batch(spark, ["part3", "nothing"], Knowledge(_symbols(spark, d)), include=[], output="json")
    return found.select(F.concat(F.substring_index("json", '"message":"', 1), F.lit('"message":"')).alias("head"), F.col("json").endswith("]}").alias("closed"))


@_query(f"""WITH {_SYMBOLS} SELECT 'path' AS way, id FROM symbols WHERE path IN (SELECT 'src/p' || page_id || '.ts' FROM pages)
UNION ALL SELECT 'name', id FROM symbols WHERE name = 'part6' UNION ALL SELECT 'both', id FROM symbols WHERE name = 'part6' AND path = 'src/p7.ts'""")
def symbol_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the paths of a table, of one name, and of a name at a path."""
    symbols = _symbols(spark, d)
    paths = _read(spark, d, "pages").select(F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"))
    found = (("path", symbols_of_paths(symbols, paths)), ("name", symbols_where(symbols, name="part6")), ("both", symbols_where(symbols, name="part6", path="src/p7.ts")))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(way).alias("way"), "id") for way, rows in found])


@_query("""SELECT n_name AS key, stored, coalesce(stored, 'none') AS told FROM (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) END AS stored FROM nation n)""")
def stored_settings(spark: SparkSession, d: str) -> DataFrame:
    """Values of the meta data of a store: what is stored, else the default."""
    counts = _read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nations = _read(spark, d, "nation")
    meta = nations.where("n_nationkey % 2 = 0").join(counts, "n_nationkey", "left").select(F.col("n_name").alias("key"), F.concat(F.lit("v"), F.coalesce("n", F.lit(0)).cast("string")).alias("value"))
    store = SnapshotStore(spark, shared_folder(spark, "settings"))
    save_tables(store, blank_tables(store) | {"meta": meta})
    tables = open_tables(store)
    told = [(r.n_name, setting_of(tables, r.n_name), setting_of(tables, r.n_name, default="none")) for r in nations.select("n_name").collect()]  # 25 nations
    return spark.createDataFrame(told, "key string, stored string, told string")
