"""Queries of paths, identifiers, parsers and type relations, each with SQL for DuckDB.

Every part stands for a source file whose text is made from its columns, so the
parsers run over as many texts as the table has rows and SQL can say what they find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import paths, text
from symloom.functions.parsers import class_table, flatten_symbols, frontmatter_symbols_of, go_embedded, module_symbols, ts_heritage_of, ts_signature_of
from symloom.operators import types
from symloom.operators.resolve import enclosing_symbols, split_bases, unresolved_frontmatter, used_by_types
from symloom.plans.catalogue import _query, _read, dealt


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def _pick_sql(n: str, *values: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{n} % {len(values)} + 1]"


def _fill(template: str, **values: Column) -> Column:
    """A template with columns in place of ``{name}``."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out



def _key() -> Column:
    return F.col("p_partkey")


_ENDS = (".ts", ".tsx", ".py", ".pyi", ".go", ".md", "")
_TOPS = ("src/", "node_modules/", "src/.git/", "a/dist/", "lib/distant/")
_LANGUAGE = "CASE p_partkey % 7 WHEN 0 THEN 'typescript' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'python' WHEN 4 THEN 'go' END"


@_query(f"""SELECT p_partkey, {_LANGUAGE} AS language, p_partkey % 5 IN (1, 2, 3) AS skipped, 'file:///repo/' || replace(p_name, ' ', '%20') || '.ts' AS uri,
  p_name || '.ts' AS below, p_partkey % 5 = 0 AS is_source FROM part""")
def path_facts(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(_pick(_key(), *_TOPS), F.replace("p_name", F.lit(" "), F.lit("_")), _pick(_key(), *_ENDS))
    whole = F.concat(F.lit("/repo/"), F.col("p_name"), F.lit(".ts"))
    facts = _read(spark, d, "part").select("p_partkey", path.alias("path"), whole.alias("whole"))
    return facts.select("p_partkey", paths.language_of_path("path").alias("language"), paths.is_skipped("path").alias("skipped"), paths.file_uri("whole").alias("uri"), paths.relative_path("whole", "/repo").alias("below"), F.col("path").startswith("src/").__and__(~paths.is_skipped("path")).alias("is_source"))


_ID_SQL = """ids AS (SELECT p_partkey, ['ts', 'py', 'go'][p_partkey % 3 + 1] AS code, CASE WHEN p_partkey % 3 = 2 THEN 'pkg/' || p_size || '.go' ELSE 'a:b/' || p_size || '.x' END AS path,
  CASE p_partkey % 6 WHEN 0 THEN 'Name' WHEN 1 THEN '_hidden' WHEN 2 THEN 'Store.Get' WHEN 3 THEN '_own' WHEN 4 THEN '__init__' ELSE 'Store.get' END AS name FROM part)"""


@_query(f"""WITH {_ID_SQL} SELECT p_partkey, 'sym:' || code || ':' || path || ':' || name AS id, 'ref:' || code || ':' || path || ':' || p_partkey AS ref, code, path, name,
  CASE code WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE 'go' END AS language, p_partkey % 6 NOT IN (1, 5) AS exported FROM ids""")
def symbol_id_facts(spark: SparkSession, d: str) -> DataFrame:
    code, name = _pick(_key(), "ts", "py", "go"), _pick(_key(), "Name", "_hidden", "Store.Get", "_own", "__init__", "Store.get")
    path = F.when(_key() % 3 == 2, F.concat(F.lit("pkg/"), F.col("p_size").cast("string"), F.lit(".go"))).otherwise(F.concat(F.lit("a:b/"), F.col("p_size").cast("string"), F.lit(".x")))
    rows = _read(spark, d, "part").select("p_partkey", paths.symbol_id(code, path, name).alias("id"), paths.ref_id(code, path, _key()).alias("ref"))
    rows = rows.select("*", paths.parse_symbol_id("id").alias("s"), paths.language_of_id("id").alias("language"))
    return rows.select("p_partkey", "id", "ref", "s.*", "language", paths.exported("language", "s.name").alias("exported"))


@_query("""SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS short, o_orderkey % 2 = 0 AS whole,
  CASE o_orderkey % 4 WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity,
  CASE o_orderkey % 30 WHEN 5 THEN 'class' WHEN 6 THEN 'method' WHEN 12 THEN 'function' WHEN 13 THEN 'variable' WHEN 14 THEN 'variable' ELSE 'other' END AS python_kind,
  o_orderkey % 7 IN (0, 1, 4) AS again, CAST(least(500 * power(2, o_orderkey % 9), 30000) AS DOUBLE) AS wait, o_orderkey + 1 AS line,
  CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN 'a' ELSE '[a, b]' END AS bases, CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[a]' ELSE '[a, b]' END AS names, substr(strftime(o_orderdate, '%Y-%m-%dT'), 1, 10) AS day
FROM orders""")
def value_formats(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    digest = F.md5(key.cast("string"))
    sha = F.concat(digest, F.when(key % 2 == 0, F.substring(digest, 1, 8)).otherwise(F.lit("zzzzzzzz")))
    status = F.element_at(F.array(*[F.lit(s).cast("int") for s in (None, 429, 400, 404, 503, 200, 401)]), (key % 7).cast("int") + 1)
    names = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (key % 3).cast("int"))
    rows = _read(spark, d, "orders").select("o_orderkey", sha.alias("sha"), status.alias("status"), names.alias("of"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return rows.select(
        "o_orderkey", text.short_sha("sha").alias("short"), text.full_sha("sha").alias("whole"), paths.diagnostic_severity(key % 4).alias("severity"), paths.symbol_kind(F.lit("python"), key % 30).alias("python_kind"),
        text.retryable("status").alias("again"), text.backoff_ms(key % 9 + 1, 500, 30000).alias("wait"), paths.one_based("o_orderkey").alias("line"),
        text.name_list("of", single_bare=True).alias("bases"), text.name_list("of").alias("names"), text.short_date("at").alias("day"),
    )


# ---- TypeScript

_TS_CLASS = "import x from 'y';\nexport class Part{n}<T extends Base<U>> extends ns.Base{a}<T>\n  implements Shape, api.Thing{b} {\n  run(): void;\n}\n"
_TS_ALIAS = "const z = 1;\nexport type Alias{n} =\n  | 'a'\n  | 'b';\nexport const w = 2;\n"
_TS_SIGNATURE = "'class Part' || p_partkey || '<T extends Base<U>> extends ns.Base' || p_partkey % 5 || '<T> implements Shape, api.Thing' || p_partkey % 3"


def _ts(template: str) -> Column:
    return _fill(template, n=_key(), a=_key() % 5, b=_key() % 3)


@_query(f"""SELECT p_partkey, 'class' AS kind, {_TS_SIGNATURE} AS signature, 'Base' || p_partkey % 5 AS extends, 'Shape,Thing' || p_partkey % 3 AS implements FROM part
UNION ALL SELECT p_partkey, 'type', 'type Alias' || p_partkey || ' = | ''a'' | ''b''', '', '' FROM part""")
def ts_declarations(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part")
    rows = part.select("p_partkey", F.lit("class").alias("kind"), _ts(_TS_CLASS).alias("text")).unionByName(part.select("p_partkey", F.lit("variable").alias("kind"), _ts(_TS_ALIAS).alias("text")))
    rows = rows.select("p_partkey", ts_signature_of("kind", "text", F.lit(1)).alias("s")).select("p_partkey", "s.*")
    rows = rows.withColumn("h", ts_heritage_of("signature"))
    return rows.select("p_partkey", "kind", "signature", F.array_join("h.extends", ",").alias("extends"), F.array_join("h.implements", ",").alias("implements"))


@_query("SELECT 'Base' || n AS target, 'Part' || p_partkey AS name FROM part JOIN (SELECT unnest(range(5)) AS n) ON p_partkey % 5 = n WHERE p_partkey % 2 = 0")
def ts_direct_children(spark: SparkSession, d: str) -> DataFrame:
    """Candidates name the class itself or, where the key is odd, a class in between."""
    declared = F.when(_key() % 2 == 0, _fill("class Part{n} extends Base{a}", n=_key(), a=_key() % 5)).otherwise(_fill("class Part{n} extends Between{a}<Base{a}>", n=_key(), a=_key() % 5))
    rows = _read(spark, d, "part").select(F.concat(F.lit("Base"), (_key() % 5).cast("string")).alias("target"), F.concat(F.lit("Part"), _key().cast("string")).alias("name"), declared.alias("declaration"))
    return types.direct_children(rows).select("target", "name")


# ---- Python

_PY = '''from typing import Protocol as P

class Shape{n}(P):
    """Shape {n}."""
    pass

class Box{n}(Shape{s}, pkg.Base):
    def area(self, a: int = (1, 2)) -> float:
        """Area of {n}.

        More.
        """
        return 1

Alias{n} = Union[int, str]
LIMIT{n} = 3
'''
#: Name, kind of the protocol and line (from 0) of what a language server lists for such a file.
_PY_LISTED = (("Shape{n}", 5, 2), ("Box{n}", 5, 6), ("area", 6, 7), ("a", 13, 7), ("Alias{n}", 13, 14), ("LIMIT{n}", 13, 15), ("event", 24, 0))


def _py_files(spark: SparkSession, d: str) -> DataFrame:
    return dealt(_read(spark, d, "part").select("p_partkey"), "p_partkey").select(_key().cast("string").alias("path"), _fill(_PY, n=_key(), s=_key() % 7).alias("text"))


_PY_SQL = "py AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS n, p_partkey % 7 AS s FROM part)"


@_query(f"""WITH {_PY_SQL}
SELECT path, 'Shape' || n AS name, 'interface' AS kind, 2 AS line, 'class Shape' || n || '(P)' AS signature FROM py UNION ALL
SELECT path, 'Box' || n, 'class', 6, 'class Box' || n || '(Shape' || s || ', pkg.Base)' FROM py UNION ALL
SELECT path, 'area', 'method', 7, 'def area(self, a: int = (1, 2)) -> float' FROM py UNION ALL
SELECT path, 'Alias' || n, 'type', 14, 'Alias' || n || ' = Union[int, str]' FROM py UNION ALL
SELECT path, 'LIMIT' || n, 'variable', 15, NULL FROM py""")
def python_symbol_kinds(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array(*[F.struct(_fill(name, n=F.col("path")).alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line")) for name, kind, line in _PY_LISTED])
    files = _py_files(spark, d)
    return types.python_symbols(files.select("path", F.inline(listed)), files)


@_query(f"WITH {_PY_SQL} SELECT a.path, 'Shape' || a.n AS name, 'Box' || b.n AS used_by FROM py a JOIN py b ON a.n = b.s AND a.n <> b.n")
def python_used_by(spark: SparkSession, d: str) -> DataFrame:
    return used_by_types(class_table(_py_files(spark, d)).select("path", "name", "base"))


@_query(f"""WITH {_PY_SQL} SELECT path, 'Shape' || n AS name, 'P' AS extends, '' AS implements FROM py UNION ALL
SELECT path, 'Box' || n, CASE WHEN s IN (SELECT n FROM py) THEN 'pkg.Base' ELSE 'Shape' || s || ',pkg.Base' END, CASE WHEN s IN (SELECT n FROM py) THEN 'Shape' || s ELSE '' END FROM py""")
def python_heritage(spark: SparkSession, d: str) -> DataFrame:
    classes = class_table(_py_files(spark, d))
    done = split_bases(classes.select("path", "name", "base"), types.protocol_classes(classes).select("name"))
    return done.withColumns({c: F.array_join(c, ",") for c in ("extends", "implements")})


@_query(f"WITH {_PY_SQL} SELECT target, path, 'Box' || n AS name FROM py, (VALUES ('Base'), ('pkg.Base')) t(target) UNION ALL SELECT 'Shape3', path, 'Box' || n FROM py WHERE s = 3")
def python_extending(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.range(1).select(F.explode(F.array(*map(F.lit, ("Base", "pkg.Base", "Shape3")))).alias("target"))
    return types.classes_extending(class_table(_py_files(spark, d)), targets)


@_query(f"WITH {_PY_SQL} SELECT path, '<module>' AS name, 'module' AS kind, 1 AS line FROM py")
def python_modules(spark: SparkSession, d: str) -> DataFrame:
    return module_symbols(_py_files(spark, d))


_TS_HOVER = "```typescript\nfunction f(): void\n```\nDoes {n}.\n\n*@param* x"
_GO_HOVER = "func F{n}()\n---\nGo doc {n}\n---\nlink"


@_query(f"""WITH {_PY_SQL}
SELECT 'shape' || n AS symbol_id, 'Shape ' || n || '.' AS docstring FROM py UNION ALL
SELECT 'area' || n, 'Area of ' || n || '.' || chr(10) || chr(10) || 'More.' FROM py UNION ALL
SELECT 'box' || n, NULL FROM py UNION ALL SELECT 'module' || n, NULL FROM py UNION ALL
SELECT 'ts' || n, 'Does ' || n || '.' || chr(10) || chr(10) || '@param x' FROM py UNION ALL
SELECT 'go' || n, 'Go doc ' || n FROM py""")
def docstring_lookup(spark: SparkSession, d: str) -> DataFrame:
    files = _py_files(spark, d)
    asked = (("shape", "python", "Shape", 3), ("area", "python", "area", 8), ("box", "python", "Box", 7), ("module", "python", "<module>", 1), ("ts", "typescript", "f", 1), ("go", "go", "F", 1))
    listed = F.array(*[F.struct(F.concat(F.lit(i), F.col("path")).alias("id"), F.lit(lang).alias("language"), F.lit(name).alias("name"), F.lit(line).alias("line")) for i, lang, name, line in asked])
    symbols = files.select("path", F.inline(listed))
    hovers = F.array(*[F.struct(F.concat(F.lit(i), F.col("path")).alias("symbol_id"), _fill(t, n=F.col("path")).alias("hover")) for i, t in (("ts", _TS_HOVER), ("go", _GO_HOVER))])
    return types.docstrings(symbols, files, files.select(F.inline(hovers)))


# ---- Go


def _go_tree(spark: SparkSession, d: str) -> DataFrame:
    def child(name: str, kind: int, detail: str, line: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), F.lit(line).alias("line"))

    def node(order: int, name: str, kind: int, line: int, *children: Column) -> Column:
        return F.struct(F.lit(order).alias("ord"), _fill(name, n=_key()).alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), F.array(*children).alias("children"))

    nodes = F.array(node(0, "Store{n}", 23, 1, child("Base", 8, "Base", 2), child("size", 8, "int", 3)), node(1, "Reader{n}", 11, 5, child("Read", 6, "func()", 6)))
    return dealt(_read(spark, d, "part").select("p_partkey"), "p_partkey").select(_key().cast("string").alias("path"), F.inline(nodes))


@_query(f"""WITH {_PY_SQL} SELECT path, 'Store' || n AS name, NULL AS parent, 'class' AS kind, 1 AS line FROM py UNION ALL
SELECT path, 'Reader' || n, NULL, 'interface', 5 FROM py UNION ALL SELECT path, 'Reader' || n || '.Read', 'Reader' || n, 'method', 6 FROM py""")
def go_symbols(spark: SparkSession, d: str) -> DataFrame:
    flat = flatten_symbols(_go_tree(spark, d), "go").select("path", "name", "parent", paths.symbol_kind(F.lit("go"), "kind").alias("kind"), "line")
    return types.known_kinds(flat)


@_query(f"WITH {_PY_SQL} SELECT path, 'Store' || n AS name, 'Base' AS extends FROM py UNION ALL SELECT path, 'Reader' || n, '' FROM py")
def go_embedded_types(spark: SparkSession, d: str) -> DataFrame:
    return go_embedded(_go_tree(spark, d)).withColumn("extends", F.array_join("extends", ","))


@_query(f"WITH {_PY_SQL} SELECT path, 'Store' || n || '.size' AS wanted, 8 AS kind, 3 AS line FROM py UNION ALL SELECT path, 'Reader' || n, 11, 5 FROM py")
def go_lookup(spark: SparkSession, d: str) -> DataFrame:
    tree = _go_tree(spark, d)
    wanted = _read(spark, d, "part").select(_key().cast("string").alias("path"), F.explode(F.array(_fill("Store{n}.size", n=_key()), _fill("Reader{n}", n=_key()), F.lit("None.such"))).alias("wanted"))
    return types.find_go_symbol(tree, wanted)


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS path, 'T' || l_orderkey AS name, CASE WHEN l_orderkey % 2 = 0 THEN 'used_by' ELSE 'implements' END AS relation,
  'U' || l_partkey % 50 AS target, min(l_linenumber) AS ordinal FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2, 3, 4""")
def go_type_relations(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey")
    rows = _read(spark, d, "lineitem").select(
        key.cast("string").alias("path"), F.concat(F.lit("T"), key.cast("string")).alias("name"), F.when(key % 2 == 0, "interface").otherwise("class").alias("kind"), F.lit(2).alias("line"),
        F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("U"), (F.col("l_partkey") % 50).cast("string")).alias("target"), key.cast("string").alias("target_path"), F.col("l_linenumber").alias("target_line"),
    )
    return types.go_relations(rows)


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line, CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN 'inner' ELSE 'outer' END AS symbol_id, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def position_symbols(spark: SparkSession, d: str) -> DataFrame:
    at = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n")).withColumn("character", F.lit(3))
    span = lambda name, depth, a, b: F.struct(F.lit(name).alias("symbol_id"), F.lit(depth).alias("depth"), F.lit(a).alias("start_line"), F.lit(0).alias("start_character"), F.lit(b).alias("end_line"), F.lit(9).alias("end_character"))
    ranges = _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.inline(F.array(span("outer", 0, 0, 90), span("inner", 1, 2, 4))))
    found = enclosing_symbols(at.drop("n"), ranges)
    return found.join(at, ["path", "line", "character"]).drop("character")


# ---- documents

_FRONT = "---\nid: {i}\ntitle: \"x\"\nsymbols:\n  - part {a}\n  - \"no {b}\"  # unknown\n---\nBody {n}\n"


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'DOC-' || p_partkey ELSE 'ADR-' || p_partkey END AS source, 'Body ' || p_partkey || chr(10) AS body,
  'part ' || p_partkey % 9 || ',no ' || p_partkey % 3 AS names FROM part""")
def frontmatter_facts(spark: SparkSession, d: str) -> DataFrame:
    path = _fill("docs/adr-{n}-choice.md", n=_key())
    own = F.when(_key() % 2 == 0, F.concat(F.lit("DOC-"), _key().cast("string"))).otherwise("")
    rows = _read(spark, d, "part").select("p_partkey", path.alias("path"), _fill(_FRONT, i=own, a=_key() % 9, b=_key() % 3, n=_key()).alias("text"))
    return rows.select("p_partkey", text.source_name("path", "text").alias("source"), text.strip_frontmatter("text").alias("body"), F.array_join(frontmatter_symbols_of("text"), ",").alias("names"))


@_query("SELECT 'doc' || p_partkey AS source_path, CASE WHEN p_partkey % 9 IN (SELECT p_partkey FROM part) THEN '' ELSE 'part ' || p_partkey % 9 || ',' END || 'no ' || p_partkey % 3 AS symbols FROM part")
def frontmatter_unresolved(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part")
    front = part.select(F.concat(F.lit("doc"), _key().cast("string")).alias("source_path"), F.array(_fill("part {a}", a=_key() % 9), _fill("no {b}", b=_key() % 3)).alias("symbols"))
    known = part.select(_fill("part {n}", n=_key()).alias("name"))
    return unresolved_frontmatter(front, known).withColumn("symbols", F.array_join("symbols", ","))
