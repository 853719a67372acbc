import pytest
from pyspark.sql import functions as F

from symloom.functions import parsers as P


@pytest.mark.parametrize("text, bare", [("A<B<C>> x", "A x"), ("a > b", "a > b"), ("f<T", "f")])
def test_generics(text, bare):
    assert P.strip_generics(text) == bare


def test_typescript_headers():
    text = "export class A<\n  S extends X = {}\n> extends B<S>\n  implements C, D {\n  x;\n}\n"
    assert P.clean_signature(P.declaration_header(text, 0)) == "class A< S extends X = {} > extends B<S> implements C, D"
    assert P.ts_heritage(P.declaration_header(text, 0)) == (["B"], ["C", "D"])
    assert P.ts_heritage("interface X extends ns.Y, Z {") == (["Y", "Z"], []) and P.ts_heritage("const x = 1") == ([], [])
    assert P.ts_signature("variable", "export type T =\n  | A\n  | B\nexport const x = 1", 0) == ("type T = | A | B", "type")
    assert P.ts_signature("variable", "const x = 1;", 0) == (None, "variable")
    assert P.ts_signature("function", "function f(a: string): void {", 0) == ("function f(a: string): void", "function")
    assert P.clean_signature("class A extends") is None and P.clean_signature("  ") is None


def test_python_classes():
    text = "from typing import Protocol as P\nimport typing as t\nclass A(Base, metaclass=M, *args):\n    pass\nclass B(Generic[T, U],\n        m.Base):\n    pass\nclass C(P): pass\nclass D(t.Protocol[X]): pass\nclass E: pass\n"
    assert P.python_classes(text) == [("A", ["Base"], "class A(Base)", False), ("B", ["Generic", "m.Base"], "class B(Generic, m.Base)", False), ("C", ["P"], "class C(P)", True), ("D", ["t.Protocol"], "class D(t.Protocol)", True), ("E", [], "class E", False)]
    assert P.class_header("x = 1", 0) == "" and P.class_header("", 5) == ""


@pytest.mark.parametrize("line, alias", [("type X = int", True), ("X: TypeAlias = int", True), ("X = dict[str, int]", True), ("X = Union[int, str]", True), ("X = f(1)", False), ("X = 3", False), ("Y = int", False), ("type X[T] = list[T]", True), ("X: typing.TypeAlias = int", True), ("X = a.b.C", True), ("X = Callable[", True), ("X = a + b", False), ("X = dict[str,", False), ("X: int = int", False), ("X = 'text'", False)])
def test_aliases(line, alias):
    assert P.is_alias_line(line, "X") is alias


def test_alias_signatures():
    assert P.alias_signature("X:  TypeAlias =  int", "X") == "X: TypeAlias = int" and P.alias_signature("Y = 1", "X") is None
    assert P.is_module_assignment("X: int = 3", "X") and not P.is_module_assignment("  X = 3", "X")


@pytest.mark.parametrize("declaration, extends, implements", [("class A extends mixin(B, C) implements D {", [], ["D"]), ("abstract class A<T extends X> extends n.m.B<T, U> {", ["B"], []), ("interface I extends J<K, L>, M {", ["J", "M"], []), ("class A { extends B", [], []), (None, [], [])])
def test_heritage(declaration, extends, implements):
    assert P.ts_heritage(declaration) == (extends, implements)


def test_imports_of_files_that_do_not_parse():
    text = "from typing import Protocol as P, Any\nimport typing_extensions as te\nif True:\n    from a.b import C as D  # note\n"
    want = {"P": "Protocol", "te.Protocol": "Protocol", "D": "C"}
    for source in (text, text + "def broken(:\n"):
        found = P.import_aliases(source)
        assert {k: found.get(k) for k in want} == want and "Any" not in found


def test_callables():
    text = "    async def run(self, a: dict[str, int],\n            b=(1, 2)) -> int:\n        pass"
    assert P.callable_signature(text, 0) == "async def run(self, a: dict[str, int], b=(1, 2)) -> int" and P.callable_signature("x = 1", 0) is None


def test_docstrings():
    assert P.module_docstring('#!/usr/bin/python\n# -*- coding: utf-8 -*-\n\nfrom __future__ import (a,\n  b)\n"""One.\n\n    Two.\n"""\n') == "One.\n\nTwo."
    assert P.module_docstring("import x\n'''no'''") is None and P.module_docstring("") is None
    body = "def f(a: int = {1: 2},\n      b=3):  # note: x\n    '''Does.\n\n    More.\n    '''\n"
    assert P.body_docstring(body, 1) == "Does.\n\nMore." and P.body_docstring("class A:\n    x = 1", 1) is None and P.body_docstring(body, 99) is None


@pytest.mark.parametrize("text, names", [("---\nid: x\nsymbols:\n  - Foo\n  - \"Bar\"\n  - 3\nother: 1\n---\n", ["Foo", "Bar"]), ("---\nsymbols: [A, 'B']\n---\n", ["A", "B"]), ("---\nid: x\n---\n", []), ("no", []), ("---\nsymbols: text\n---\n", [])])
def test_frontmatter(text, names):
    assert P.frontmatter_symbols(text) == names


def test_columns(spark):
    df = spark.createDataFrame([("class", "class A extends B {", 0, "def f(x): pass", '"""Doc."""\n')], "kind string, ts string, line int, py string, mod string")
    row = df.select(P.ts_signature_of("kind", "ts", "line").alias("s"), P.ts_heritage_of("ts").alias("h"), P.callable_signature_of("py", "line").alias("c"), P.module_docstring_of("mod").alias("d"), P.body_docstring_of("py", F.lit(1)).alias("b")).first()
    assert row.s.signature == "class A extends B" and row.h.extends == ["B"] and row.c == "def f(x)" and row.d == "Doc." and row.b is None
    hover = spark.createDataFrame([("```typescript\nclass A\n```\nText.\n*@param* x", "sig\n---\nGo doc.\n---\nlink"), ("```typescript\nx\n```", "only")], "ts string, go string")
    assert [tuple(r) for r in hover.select(P.ts_docstring("ts"), P.go_docstring("go")).collect()] == [("Text.\n@param x", "Go doc."), (None, None)]


def test_trees(spark):
    kids = [("Area", 6, "()", 2), ("Base", 8, "Base", 3)]
    tree = spark.createDataFrame([("a.go", 0, "Shape", 11, 1, kids), ("a.go", 1, "Other", 23, 9, kids)], "path string, ord int, name string, kind int, line int, children array<struct<name:string,kind:int,detail:string,line:int>>")
    assert {r.name for r in P.flatten_symbols(tree, "go").collect()} == {"Shape", "Other", "Shape.Area", "Shape.Base"}
    assert {r.name: r.extends for r in P.go_embedded(tree).collect()}["Other"] == ["Base"]
    assert P.find_in_tree(P.flatten_symbols(tree, "go"), "Shape.Area").first().line == 2
    files = spark.createDataFrame([("a.py", "class A(B): pass"), ("b.py", "  ")], "path string, text string")
    assert [r.path for r in P.module_symbols(files).collect()] == ["a.py"] and P.class_table(files).first().base == "B"
