import os
import random

import pytest

from tests.llm.test_dedup import plain_components, plain_lines
from tests.sqlcheck import SF_DIR, connect, same

pytest.importorskip("public_tokenizers")
from symloom.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, connect(), queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    """Every stage against its operator's plain meaning, on the smallest tables."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for (name, stage), number in zip(p.STAGES, range(5), strict=True):
        after = stage(spark, before, SF_DIR)
        if number < 4:
            assert sorted(after.columns) == sorted(docs.columns), name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        old = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= old and len(ids) > 0.6 * len(old), name
        if number in (1, 4):
            assert ids == old, name
        before = after
    assert after.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, label string, batch string"


def mixed_documents():
    """Texts of three languages with common lines, near and exact copies, benchmark items, null ids, null and empty texts."""
    from tests.llm.test_text_ops import corpus

    rng = random.Random(8)
    rows = [(i, t, lang) for i, t, lang in corpus(150)]
    item = " ".join(rows[0][1].split()[:18])
    line = "Ka lo mi tan this line is common to many"
    rows += [(200 + k, f"{rows[k][1]}\n{line}", rows[k][2]) for k in range(6)]
    for k in range(8):
        words = rows[10 + k][1].split() * 3
        words[rng.randrange(len(words))] = "other"
        rows += [(300 + 2 * k, " ".join(rows[10 + k][1].split() * 3), rows[10 + k][2]), (301 + 2 * k, " ".join(words), None)]
    rows += [(400, f"Mi lo {item} ka tan", "xa"), (401, None, "xa"), (402, "", None), (403, "12 ²", "xa"), (None, rows[3][1], "xa"), (None, f"{line}\nkalo mitan", "xa")]
    return [(i, t, lang, "src", len(t) if t else 0, "x", "x", "x", "x") for i, t, lang in rows], item


def test_pipeline_equals_plain_stages(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline as p
    from symloom.llm.language_id import identify, train
    from tests.llm.test_text_ops import plain_overlaps

    rows, item = mixed_documents()
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOCS)
    stages = [stage for _, stage in p.STAGES]

    def after(number, before):
        df = stages[number](spark, before, str(tmp_path))
        assert number == 4 or df.columns == docs.columns
        return spark.createDataFrame(df.collect(), df.schema)

    def texts(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    one = after(0, docs)
    left = {r.text for r in docs.collect()} - {r.text for r in one.collect()}
    rejected = {r.id for r in identify(docs.withColumnRenamed("doc_id", "key").selectExpr("hash(text) AS doc_id", "text"), train(docs)).withColumnRenamed("doc_id", "id").collect() if r.rejected}
    assert {None, "", "12 ²"} <= left and len(left) < 8 and len(rejected) >= len(left) - 1
    two = after(1, one)
    known = [(i, t) for i, t in texts(one) if i is not None]
    cut = plain_lines(known)
    assert texts(two) == sorted([(i, cut[i][2]) for i, _ in known] + [(i, t) for i, t in texts(one) if i is None], key=str) and any(v[1] for v in cut.values())
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = after(2, two)
    groups = plain_components([(i, t) for i, t in texts(two) if i is not None], 5)
    assert texts(three) == [(i, t) for i, t in texts(two) if i is None or groups[i][1] == i] and len(texts(three)) < len(texts(two))
    four = after(3, three)
    dirty = [n for n, d in enumerate(texts(three)) if plain_overlaps([d], [(1, item)])]
    assert dirty and texts(four) == [d for n, d in enumerate(texts(three)) if n not in dirty]
    library = tokenizers.Tokenizer.from_file(queries.word_vocabulary())
    coded = sorted(((r.doc_id, r.ids) for r in after(4, four).collect()), key=str)
    assert coded == sorted(((i, library.encode(t, add_special_tokens=False).ids) for i, t in texts(four)), key=str)


def test_pipeline_of_an_empty_and_of_an_unlabelled_table(spark):
    import corpus_pipeline as p

    rows, _ = mixed_documents()
    docs = spark.createDataFrame(rows[:20], DOCS)
    for before, least in ((docs.limit(0), 0), (docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars"), 15)):
        for _, stage in p.STAGES:
            before = stage(spark, before, SF_DIR)
        assert before.count() >= least and before.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
