import pytest
from pyspark.sql import functions as F

from symloom.functions import paths as P
from symloom.plans.catalogue import PATH_CASES


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("given, normal", PATH_CASES)
def test_normalize(spark, given, normal):
    assert one(spark, P.normalize_path(F.lit(given))) == normal


def test_empty_path_fails(spark):
    with pytest.raises(Exception, match="must not be empty"):
        one(spark, P.normalize_path(F.lit("")))


@pytest.mark.parametrize("path, uri", [("C:\\Users\\foo.ts", "file:///c:/Users/foo.ts"), ("/home/u/foo.ts", "file:///home/u/foo.ts"), ("/home/with space.ts", "file:///home/with%20space.ts"), ("\\\\server\\share\\f.ts", "file://server/share/f.ts")])
def test_uri(spark, path, uri):
    assert one(spark, P.file_uri(F.lit(path))) == uri


def test_relative(spark):
    assert one(spark, P.relative_path(F.lit("/repo/src\\a.ts"), "/repo")) == "src/a.ts"
    assert one(spark, P.relative_path(F.lit("/repo"), "/repo")) == ""
    with pytest.raises(Exception, match="outside"):
        one(spark, P.relative_path(F.lit("/repository/a"), "/repo"))


@pytest.mark.parametrize("path, key", [("src/orders/a.ts", "orders"), ("src/a.ts", "a.ts"), ("src", "src"), ("billing/x.ts", "billing"), ("packages/core/x.ts", "core")])
def test_module_key(spark, path, key):
    assert one(spark, P.module_key(F.lit(path))) == key


@pytest.mark.parametrize("path, test", [("src/foo.test.ts", True), ("a.spec.mjs", True), ("orders_test.py", True), ("src/test_x.py", True), ("tests/anything.ts", True), ("A\\Tests\\b.ts", True), ("src/orders/test_helpers.ts", False), ("spec/example.yml", False), ("x_test.go", False), ("", False)])
def test_test_files(spark, path, test):
    assert one(spark, P.is_test_file(F.lit(path))) is test


@pytest.mark.parametrize("symbol, parts", [("sym:ts:src/a:b.ts:Foo", ("ts", "src/a:b.ts", "Foo")), ("sym:go:a.go:Shape.Area", ("go", "a.go", "Shape.Area")), ("sym:go:a.go:x:y", ("go", "a.go", "x:y")), ("sym:ts:a.ts", None), ("ref:ts:a.ts:1", None)])
def test_parse_id(spark, symbol, parts):
    found = one(spark, P.parse_symbol_id(F.lit(symbol)))
    assert (found and tuple(found)) == parts


def test_build_id_and_language(spark):
    assert one(spark, P.symbol_id(F.lit("py"), F.lit("a.py"), F.lit("F"))) == "sym:py:a.py:F"
    assert one(spark, P.ref_id(F.lit("py"), F.lit("a.py"), F.lit(3))) == "ref:py:a.py:3"
    assert one(spark, P.language_of_id(F.lit("sym:py:a.py:F"))) == "python"
    for wrong in ("sym:py:a", "sym:rb:a:b", "x:py:a:b"):
        with pytest.raises(Exception, match="not a symbol id"):
            one(spark, P.language_of_id(F.lit(wrong)))


@pytest.mark.parametrize("language, name, seen", [("go", "Area", True), ("go", "Shape.area", False), ("python", "_x", False), ("python", "__init__", True), ("python", "__x", False), ("python", "<module>", True), ("python", "C.run", True), ("typescript", "_x", True)])
def test_exported(spark, language, name, seen):
    assert one(spark, P.exported(F.lit(language), F.lit(name))) is seen


@pytest.mark.parametrize("language, kind, name", [("typescript", 23, "type"), ("go", 23, "class"), ("python", 11, "other"), ("typescript", 10, "enum"), ("go", 99, "other")])
def test_kinds(spark, language, kind, name):
    assert one(spark, P.symbol_kind(F.lit(language), F.lit(kind))) == name
    assert one(spark, P.diagnostic_severity(F.lit(kind))) == "info"


def test_skipped(spark):
    df = spark.createDataFrame([("src/a.ts",), ("node_modules/x.ts",), ("src/.hid/a.ts",), ("dist/a.ts",), ("src/build.ts",)], "p string")
    assert [r[0] for r in df.select(P.is_skipped("p")).collect()] == [False, True, True, True, False]
