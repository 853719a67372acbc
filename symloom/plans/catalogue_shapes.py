"""Queries of declarations in many shapes, each with SQL for DuckDB.

A row takes the shape of its number; what each shape holds is written out below,
beside its text, and SQL reads it from there as VALUES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import paths
from symloom.functions.parsers import class_table, flatten_symbols, frontmatter_symbols_of, ts_heritage_of, ts_signature_of
from symloom.operators import types
from symloom.plans.catalogue import _query, _read, dealt


def _literal(value: str | int | None) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "replace('" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{n}', CAST(n AS VARCHAR))"


def _values(rows: list[tuple]) -> str:
    """Rows (shape, ...) for every part of the shape; ``{n}`` is its number."""
    return " UNION ALL ".join(f"SELECT n, {', '.join(_literal(v) for v in row[1:])} FROM parts WHERE shape = {row[0]}" for row in rows)


def _shaped(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    """(n, shape, text) of every part."""
    shape = F.col("p_partkey") % len(texts)
    text = F.element_at(F.array(*map(F.lit, texts)), (shape + 1).cast("int"))
    return dealt(_read(spark, d, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("n"), shape.alias("shape"), F.replace(text, F.lit("{n}"), F.col("p_partkey").cast("string")).alias("text"))


def _of_shape(column: str, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) + 1).cast("int"))


# ---- TypeScript: kind that a server tells, line, text; kind, signature, extends, implements

_TS: list[tuple[str, int, str, str, str | None, str, str]] = [
    ("class", 0, "export class Own{n} {\n  readonly id: string;\n}", "class", "class Own{n}", "", ""),
    ("class", 1, "// a note\nclass Own{n} extends Base {", "class", "class Own{n} extends Base", "Base", ""),
    ("class", 0, "export abstract class Own{n} extends ns.deep.Base<T, U> implements A, b.C<D> {", "class", "abstract class Own{n} extends ns.deep.Base<T, U> implements A, b.C<D>", "Base", "A,C"),
    ("class", 0, "export class Own{n}<\n  T extends Shape,\n  S extends Schema = {},\n  U = string,\n> {\n  stored: T;", "class", "class Own{n}< T extends Shape, S extends Schema = {}, U = string, >", "", ""),
    ("class", 0, "export default class Own{n} implements\n  One,\n  Two {", "class", "default class Own{n} implements One, Two", "", "One,Two"),
    ("class", 0, "class Own{n} extends Map<string, Array<{ a: number }>> {", "class", "class Own{n} extends Map<string, Array<{ a: number }>>", "Map", ""),
    ("class", 0, "export class Own{n} extends", "class", None, "", ""),
    ("interface", 0, "export interface Own{n} {\n  requiredProp: string;\n}", "interface", "interface Own{n}", "", ""),
    ("interface", 0, "export interface Own{n} extends A, B<C>, d.E {", "interface", "interface Own{n} extends A, B<C>, d.E", "A,B,E", ""),
    ("interface", 2, "\n\ninterface Own{n}<T = {}> extends Base<T>\n{", "interface", "interface Own{n}<T = {}> extends Base<T>", "Base", ""),
    ("function", 0, "export function own{n}(a: string): number {", "function", "function own{n}(a: string): number", "", ""),
    ("function", 0, "export async function own{n}<T>(\n  a: T,\n  b: number,\n): Promise<T> {", "function", "async function own{n}<T>( a: T, b: number, ): Promise<T>", "", ""),
    ("function", 0, "declare function own{n}(x: number): void;\nconst y = 1;", "function", "declare function own{n}(x: number): void", "", ""),
    ("method", 1, "class A {\n  static own{n}(): number {\n    return 42;", "method", "static own{n}(): number", "", ""),
    ("method", 1, "interface A {\n  own{n}(arg: string): boolean;\n}", "method", "own{n}(arg: string): boolean", "", ""),
    ("variable", 0, "export type Own{n} = Record<string, number>\n\nexport type Next = {\n  x: number\n}", "type", "type Own{n} = Record<string, number>", "", ""),
    ("variable", 0, "export type Own{n} = {\n  x: number\n  y: number\n}\nexport const z = 1;", "type", "type Own{n} = { x: number y: number }", "", ""),
    ("variable", 0, "type Own{n} =\n  | 'a'\n  | 'b';\nlet q;", "type", "type Own{n} = | 'a' | 'b'", "", ""),
    ("variable", 0, "type Own{n} = string\nasync function next() {}", "type", "type Own{n} = string", "", ""),
    ("variable", 0, "export const own{n} = (x: number): number => x * 2;", "variable", None, "", ""),
    ("variable", 0, "let type{n} = 3;", "variable", None, "", ""),
    ("enum", 0, "export enum Own{n} { A, B }", "enum", None, "", ""),
    ("module", 0, "export namespace Own{n} {\n  export interface Inner {", "module", None, "", ""),
    ("class", 9, "class Own{n} {}", "class", None, "", ""),
]


@_query(f"WITH parts AS (SELECT p_partkey AS n, p_partkey % {len(_TS)} AS shape FROM part), t(n, kind, signature, extends, implements) AS ({_values([(k, *row[3:]) for k, row in enumerate(_TS)])}) SELECT * FROM t")
def ts_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = _shaped(spark, d, [row[2] for row in _TS]).select("n", ts_signature_of(_of_shape("shape", [row[0] for row in _TS]), "text", _of_shape("shape", [row[1] for row in _TS])).alias("s"))
    rows = rows.select("n", "s.kind", "s.signature", ts_heritage_of("s.signature").alias("h"))
    return rows.select("n", "kind", "signature", F.array_join("h.extends", ",").alias("extends"), F.array_join("h.implements", ",").alias("implements"))


# ---- Python: text, what a server lists (name, kind of the protocol, line from 0); the symbols (name, kind, line, signature)

_PY: list[tuple[str, list[tuple[str, int, int]], list[tuple[str, str, int, str | None]]]] = [
    ("class Own{n}:\n    pass\n", [("Own{n}", 5, 0)], [("Own{n}", "class", 0, "class Own{n}")]),
    ("class Own{n}(Base, pkg.Other[T]):\n    pass\n", [("Own{n}", 5, 0)], [("Own{n}", "class", 0, "class Own{n}(Base, pkg.Other)")]),
    ("class Own{n}(\n    Base,\n    metaclass=Meta,\n):\n    pass\n", [("Own{n}", 5, 0)], [("Own{n}", "class", 0, "class Own{n}(Base)")]),
    ("from typing import Protocol\n\nclass Own{n}(Protocol):\n    def run(self) -> None: ...\n", [("Own{n}", 5, 2), ("run", 6, 3)], [("Own{n}", "interface", 2, "class Own{n}(Protocol)"), ("run", "method", 3, "def run(self) -> None")]),
    ("import typing as t\n\nclass Own{n}(t.Protocol[T]):\n    pass\n", [("Own{n}", 5, 2)], [("Own{n}", "interface", 2, "class Own{n}(t.Protocol)")]),
    ("class Protocol: pass\nclass Own{n}(Protocol):\n    pass\n", [("Own{n}", 5, 1)], [("Own{n}", "interface", 1, "class Own{n}(Protocol)")]),
    ("from abc import ABC\n\nclass Own{n}(ABC):\n    pass\n", [("Own{n}", 5, 2)], [("Own{n}", "class", 2, "class Own{n}(ABC)")]),
    ("def own{n}(a, b=(1, 2), *c, **d):\n    return a\n", [("own{n}", 12, 0), ("a", 13, 0)], [("own{n}", "function", 0, "def own{n}(a, b=(1, 2), *c, **d)")]),
    ("async def own{n}(\n    a: dict[str, int],\n    b: str = ':',\n) -> list[int]:\n    pass\n", [("own{n}", 12, 0)], [("own{n}", "function", 0, "async def own{n}( a: dict[str, int], b: str = ':', ) -> list[int]")]),
    ("class A:\n    async def __aenter__(self) -> \"A{n}\":\n        return self\n", [("__aenter__", 6, 1)], [("__aenter__", "method", 1, 'async def __aenter__(self) -> "A{n}"')]),
    ("class A:\n    @property\n    def own{n}(self) -> int:\n        return 1\n", [("own{n}", 6, 2)], [("own{n}", "method", 2, "def own{n}(self) -> int")]),
    ("__all__ = [\"Own{n}\"]\n", [("__all__", 13, 0)], [("__all__", "variable", 0, None)]),
    ("class State(Enum):\n    CLOSED{n} = 0\n", [("State", 5, 0), ("CLOSED{n}", 14, 1)], [("State", "class", 0, "class State(Enum)"), ("CLOSED{n}", "variable", 1, None)]),
    ("LIMIT{n}: int = 3\n", [("LIMIT{n}", 14, 0)], [("LIMIT{n}", "variable", 0, None)]),
    ("Own{n} = Union[int, str]\n", [("Own{n}", 13, 0)], [("Own{n}", "type", 0, "Own{n} = Union[int, str]")]),
    ("Own{n}: TypeAlias = int\n", [("Own{n}", 13, 0)], [("Own{n}", "type", 0, "Own{n}: TypeAlias = int")]),
]


def _py_rows() -> list[tuple]:
    return [(k, *symbol) for k, (_, _, symbols) in enumerate(_PY) for symbol in symbols]


@_query(f"WITH parts AS (SELECT p_partkey AS n, p_partkey % {len(_PY)} AS shape FROM part), t(n, name, kind, line, signature) AS ({_values(_py_rows())}) SELECT CAST(n AS VARCHAR) AS path, name, kind, line, signature FROM t")
def python_shapes(spark: SparkSession, d: str) -> DataFrame:
    files = _shaped(spark, d, [text for text, _, _ in _PY]).withColumn("path", F.col("n").cast("string"))
    lists = [F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line")) for name, kind, line in listed]) for _, listed, _ in _PY]
    listed = files.select("path", F.inline(F.element_at(F.array(*lists), (F.col("shape") + 1).cast("int"))))
    listed = listed.withColumn("name", F.replace("name", F.lit("{n}"), F.col("path")))
    return types.python_symbols(listed, files.select("path", "text"))


# ---- Python bases: text; (class, base) as read, '' without one

_BASES: list[tuple[str, list[tuple[str, str]]]] = [
    ("class A{n}: pass\n", [("A{n}", "")]),
    ("class A{n}(): pass\n", [("A{n}", "")]),
    ("class A{n}(B): pass\n", [("A{n}", "B")]),
    ("class A{n}(b.C, D[E, F]): pass\n", [("A{n}", "b.C"), ("A{n}", "D")]),
    ("class A{n}(\n    B,\n    C[\n        D\n    ],\n): pass\n", [("A{n}", "B"), ("A{n}", "C")]),
    ("class A{n}(B, metaclass=M): pass\n", [("A{n}", "B")]),
    ("class A{n}(B):\n    class Inner(A{n}):\n        pass\n", [("A{n}", "B"), ("Inner", "A{n}")]),
    ("x = 1\n\nclass A{n}(B):\n    pass\n\nclass C(A{n}, B):\n    pass\n", [("A{n}", "B"), ("C", "A{n}"), ("C", "B")]),
    ("def f():\n    pass\n", []),
]


@_query(f"WITH parts AS (SELECT p_partkey AS n, p_partkey % {len(_BASES)} AS shape FROM part), t(n, name, base) AS ({_values([(k, *b) for k, (_, bases) in enumerate(_BASES) for b in bases])}) SELECT CAST(n AS VARCHAR) AS path, name, base FROM t")
def python_bases(spark: SparkSession, d: str) -> DataFrame:
    files = _shaped(spark, d, [text for text, _ in _BASES]).select(F.col("n").cast("string").alias("path"), "text")
    return class_table(files).select("path", "name", F.coalesce("base", F.lit("")).alias("base"))


# ---- Go: nodes (name, kind of the protocol, line, children (name, kind, detail, line)); the symbols (name, parent, kind, line)

_GO: list[tuple[list[tuple[str, int, int, list[tuple[str, int, str, int]]]], list[tuple[str, str | None, str, int]]]] = [
    ([("Own{n}", 23, 1, [("Width", 8, "float64", 2), ("name", 8, "string", 3)])], [("Own{n}", None, "class", 1)]),
    ([("Own{n}", 11, 1, [("Area", 6, "func() float64", 2), ("Render", 6, "func() string", 3)])], [("Own{n}", None, "interface", 1), ("Own{n}.Area", "Own{n}", "method", 2), ("Own{n}.Render", "Own{n}", "method", 3)]),
    ([("Own{n}", 11, 1, [("Shape", 8, "Shape", 2), ("Render", 6, "func() string", 3)])], [("Own{n}", None, "interface", 1), ("Own{n}.Shape", "Own{n}", "other", 2), ("Own{n}.Render", "Own{n}", "method", 3)]),
    ([("own{n}", 12, 4, [])], [("own{n}", None, "function", 4)]),
    ([("(*Own{n}).Area", 6, 7, [])], [("(*Own{n}).Area", None, "method", 7)]),
    ([("Default{n}", 14, 2, []), ("logger{n}", 13, 3, [])], [("Default{n}", None, "variable", 2), ("logger{n}", None, "variable", 3)]),
    ([("UserID{n}", 5, 2, [])], [("UserID{n}", None, "class", 2)]),
]


def _go_nodes(nodes: list[tuple[str, int, int, list[tuple[str, int, str, int]]]]) -> Column:
    def child(name: str, kind: int, detail: str, line: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), F.lit(line).alias("line"))

    none = "array<struct<name:string,kind:int,detail:string,line:int>>"
    return F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), F.array(*[child(*c) for c in children]).cast(none).alias("children")) for k, (name, kind, line, children) in enumerate(nodes)])


@_query(f"WITH parts AS (SELECT p_partkey AS n, p_partkey % {len(_GO)} AS shape FROM part), t(n, name, parent, kind, line) AS ({_values([(k, *s) for k, (_, symbols) in enumerate(_GO) for s in symbols])}) SELECT CAST(n AS VARCHAR) AS path, name, parent, kind, line FROM t")
def go_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % len(_GO)).alias("shape"))
    tree = rows.select("path", F.inline(F.element_at(F.array(*[_go_nodes(nodes) for nodes, _ in _GO]), (F.col("shape") + 1).cast("int"))))
    tree = tree.withColumn("name", F.replace("name", F.lit("{n}"), F.col("path")))
    return flatten_symbols(tree, "go").select("path", "name", "parent", paths.symbol_kind(F.lit("go"), "kind").alias("kind"), "line")


# ---- frontmatter: text; the names

_FRONT: list[tuple[str, str]] = [
    ("---\nid: ADR-{n}\nsymbols:\n  - One{n}\n  - Two\n---\nbody", "One{n},Two"), ("---\nsymbols: [A{n}, 'B C', \"D\"]  # three\n---\n", "A{n},B C,D"), ("---\nsymbols: []\n---\n", ""), ("---\nsymbols: just{n}\n---\n", ""),
    ("# none {n}\n", ""), ("---\nid: {n}\n---\n", ""), ("---\nsymbols:\n  - Valid{n}\n  - 42\n  - null\n  - true\n---\n", "Valid{n}"), ("---\nsymbols:\n  - [unclosed{n}\n---\n", ""), ("---\nstatus: ok\nsymbols:\n- Foo{n}\nid: ADR-9\n---\n", "Foo{n}"),
    ("---\nsymbols:\n  - A{n}\ntitle: x: y\n---\n", ""), ("---\nsymbols:\n  # a note\n  - 'it''s {n}'\n\n  - \"q\\\"{n}\"\n---\n", "it's {n},q\"{n}"), ("---\nmeta:\n  symbols:\n    - A{n}\n---\n", ""), ("---\nid: {n}\nno end", ""),
    ("---\nsymbols: [A{n},\n  B,\n  C]\n---\n", "A{n},B,C"), ("---\nsymbols:\n  - |\n    A{n}\n  - B\n---\n", "A{n}\n,B"), ("---\ntext: >\n  symbols:\n    - X\nsymbols: [Y{n}]\n---\n", "Y{n}"), ("---\n- symbols\n- A{n}\n---\n", ""),
    ("---\nsymbols:\n  - a.b{n}\n  - 1.2.3\n  - 1.5\n  - 2024-01-02\n---\n", "a.b{n},1.2.3"), ("---\nsymbols:\n\t- A{n}\n---\n", ""), ("---\nsymbols: [A{n}]\nsymbols: [B]\n---\n", ""),
]


@_query(f"WITH parts AS (SELECT p_partkey AS n, p_partkey % {len(_FRONT)} AS shape FROM part), t(n, names) AS ({_values([(k, names) for k, (_, names) in enumerate(_FRONT)])}) SELECT * FROM t")
def frontmatter_shapes(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(spark, d, [text for text, _ in _FRONT]).select("n", F.array_join(frontmatter_symbols_of("text"), ",").alias("names"))
