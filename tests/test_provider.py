import pytest

from symloom.schemas import DIAGNOSTICS, REFS, SYMBOLS, TYPE_EDGES
from symloom.sources.provider import Registry, TableSource, conformance


def symbol(path="a.go", name="A", kind="class", line=1, parent=None, language="go", **changes):
    row = {"id": f"sym:go:{path}:{name}", "name": name, "kind": kind, "path": path, "line": line, "signature": None, "parent_id": parent, "file_sha": None, "language": language}
    return tuple((row | changes).values())


def test_a_good_source(spark):
    good = TableSource("go", spark.createDataFrame([symbol(), symbol(name="A.B", kind="method", parent="sym:go:a.go:A")], SYMBOLS), spark.createDataFrame([(0, "ref:go:b.go:3", "sym:go:a.go:A", "b.go", 3, None)], REFS), spark.createDataFrame([("sym:go:a.go:A", "extends", "X", 0)], TYPE_EDGES), spark.createDataFrame([("a.go", 1, None, "error", "m")], DIAGNOSTICS))
    assert conformance(spark, good) == []
    registry = Registry()
    registry.register(good)
    assert registry.symbols(spark).count() == 2
    with pytest.raises(ValueError):
        registry.register(good)
    with pytest.raises(ValueError):
        registry.register(TableSource("ruby", good.symbols(spark)))


def test_what_is_wrong_is_told(spark):
    rows = [symbol(), symbol(), symbol(id="nonsense"), symbol(path="/abs.go"), symbol(name="K", kind="thing"), symbol(name="L", line=0), symbol(name="M", language="python"), symbol(name="P", parent="sym:go:no:No"), symbol(name="Q", id="sym:py:a.go:Q")]
    bad = TableSource("go", spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame([(0, "ref:go:b.go:4", "sym:go:x:X", "b.go", 3, None)], REFS), spark.createDataFrame([("sym:go:x:X", "likes", "X", 0)], TYPE_EDGES), spark.createDataFrame([("a.go", 1, None, "fatal", "m")], DIAGNOSTICS))
    assert len(conformance(spark, bad)) == 13
    assert conformance(spark, TableSource("go", bad.symbols(spark).drop("kind"))) == ["symbols lacks kind"]
