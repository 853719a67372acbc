import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from symloom.functions import text as T
from symloom.operators.intent import find_by_intent, ranked_claims
from symloom.operators.textindex import build_index, phrases, score, update_index

CLAIM = "claim_id long, source string, source_path string, source_sha string, severity string, claim string, rationale string, excerpt string"
SYMBOL = "id string, name string, kind string, path string, line int, signature string"


def claims_of(spark, rows):
    full = [(i, s, "docs/x.md", "sha", sev, c, r, e) for i, (s, sev, c, r, e) in enumerate(rows, 1)]
    return spark.createDataFrame(full, CLAIM)


def symbols_of(spark, names):
    return spark.createDataFrame([(f"sym:ts:{n}.ts:{n}", n, "class", f"{n}.ts", 1, None) for n in names], SYMBOL)


def links_of(spark, pairs):
    return spark.createDataFrame([(c, f"sym:ts:{n}.ts:{n}") for c, n in pairs], "claim_id long, symbol_id string")


@pytest.mark.parametrize("query, words", [("payment idempotency", ["payment", "idempotency"]), ("a.b(c)", ["a", "b", "c"]), ("find-by_intent!", ["find-by_intent"]), ("  ?! ", []), ("Naïve café", ["Naïve", "café"])])
def test_sanitize(spark, query, words):
    assert T.sanitize_query(query) == words
    assert spark.range(1).select(T.query_words(F.lit(query)).alias("w")).first().w == words


@pytest.mark.parametrize("query, expected", [("?", None), ("one", "one"), ("a-b", '"a-b"'), ("a b-c", '"a b-c" OR a OR "b-c"')])
def test_match_expression(query, expected):
    assert T.match_expression(query) == expected


def test_match_expressions_of_a_column(spark):
    queries = ["?", "one", "a-b", "a b-c", "", "x(y) z-1", "é_1 É", " two  words "]
    rows = spark.createDataFrame(list(enumerate(queries)), "i int, q string").select("i", T.match_expression_of("q").alias("e"), T.match_limit_of(F.col("i") * 20 - 10).alias("n")).collect()
    assert {queries[r.i]: r.e for r in rows} == {q: T.match_expression(q) for q in queries}
    assert [r.n for r in sorted(rows)] == [T.match_limit(i * 20 - 10) for i in range(len(queries))]


def test_limits():
    assert [T.match_limit(n) for n in (-1, 0, 5, 9999)] == [1, 1, 5, 50]
    assert [T.overfetch(n) for n in (1, 5, 50)] == [5, 25, 200]


CORPUS = [
    ("narrow_attribution is set by a flag", None, None),
    ("narrow the scope; attribution of claims matters narrow attribution", "why", ""),
    ("find-by-intent ranks claims", "find by intent", "beta"),
    ("alpha beta", None, "alpha"),
    ("Naïve café über alles", "cafe", None),
    ("", "", ""),
    (None, None, None),
    ("a a a a b", "a b a b", "b a"),
    ("the quick brown fox the fox", "jumps", "over"),
    ("payment flow; payment idempotency", None, "idempotency"),
]


@pytest.mark.parametrize("query", ["narrow_attribution", "narrow attribution", "find-by-intent", "beta alpha", "cafe naive", "a a", "a b a", "fox the fox", "payment idempotency", "nothing here", "quick brown fox jumps"])
def test_bm25_equals_a_full_text_engine(spark, query, tmp_path):
    """sqlite's FTS5 is the judge: same rows, same scores."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(claim, rationale, excerpt, tokenize=\"unicode61 tokenchars '_-'\")")
    dual = lambda s: f"{s or ''} {(s or '').replace('_', ' ').replace('-', ' ')}"
    for i, row in enumerate(CORPUS, 1):
        db.execute("insert into t(rowid, claim, rationale, excerpt) values (?, ?, ?, ?)", (i, *map(dual, row)))
    expected = {r: round(s, 9) for r, s in db.execute("select rowid, bm25(t) from t where t match ?", (T.match_expression(query),))}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(CORPUS, 1)], "id long, claim string, rationale string, excerpt string")
    found = {r.id: round(r.bm25, 9) for r in score(df, query, "id", ["claim", "rationale", "excerpt"]).collect()}
    assert found == pytest.approx(expected, abs=1e-8)


def test_letters_and_marks_fold_as_in_a_full_text_engine(spark):
    """All letters of the Latin, Greek and Cyrillic blocks, and marks that stand alone; the engine's case tables are older than five of them."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize=\"unicode61 tokenchars '_-'\")")
    db.execute("create virtual table v using fts5vocab(t, row)")
    newer = "ͿԨԪԬԮ"
    letters = [c for c in map(chr, [*range(0xB5, 0x530), *range(0x1E00, 0x2000)]) if unicodedata.category(c)[0] == "L" and c not in newer]
    texts = [f"q{c}z" for c in letters] + [f"e{m}x" for m in T.MARKS] + ["Crème BRÛLÉE e\u0301te\u0301 ΣΊΣΥΦΟΣ ё Й"]
    want = []
    for text in texts:
        db.execute("delete from t")
        db.execute("insert into t(x) values (?)", (text,))
        want.append(sorted(r[0] for r in db.execute("select term from v")))
    got = {r.i: sorted(set(r.t)) for r in spark.createDataFrame(list(enumerate(texts)), "i long, x string").select("i", T.tokens("x").alias("t")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != want[i]] == []
    assert all([T.fold_text(t)] == w for t, w in zip(texts[:-1], want[:-1], strict=True))


def test_index_equals_scan_and_follows_changes(spark, tmp_path):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(CORPUS, 1)], "id long, claim string, rationale string, excerpt string")
    fields = ["claim", "rationale", "excerpt"]
    index = build_index(df, str(tmp_path / "a"), "id", fields)
    queries = spark.createDataFrame([(0, "narrow attribution"), (1, "beta alpha"), (2, "fox the fox"), (3, "find-by-intent")], "query_id long, query string")
    rows = index.search(queries).collect()
    for q, text in [(r.query_id, r.query) for r in queries.collect()]:
        want = {r.id: round(r.bm25, 8) for r in score(df, text, "id", fields).collect()}
        assert {r.id: round(r.bm25, 8) for r in rows if r.query_id == q} == want
    assert max(r["rank"] for r in index.search(queries, 2).collect()) == 2
    changed = df.withColumn("claim", F.when(F.col("id") == 4, "gamma delta").otherwise(F.col("claim"))).where("id <> 9")
    new = update_index(changed, spark.createDataFrame([(4,), (9,)], "id long"), str(tmp_path / "a"), str(tmp_path / "b"), "id", fields)
    got = {r.id: round(r.bm25, 8) for r in new.search(queries.where("query_id = 1")).collect()}
    assert got == {r.id: round(r.bm25, 8) for r in score(changed, "beta alpha", "id", fields).collect()}


def test_terms_of_a_query():
    assert phrases("one") == [["one"]]
    assert phrases("A a") == [["a", "a"], ["a"], ["a"]]
    assert phrases("...") == []


def test_phrase_ranks_first(spark):
    claims = claims_of(spark, [("ADR-01", "soft", "must handle payment idempotency correctly", None, None), ("ADR-02", "soft", "payment flow has stages; idempotency of writes matters", None, None), *[("ADR-03", "soft", f"filler {i}", None, None) for i in range(6)]])
    found = find_by_intent(claims, links_of(spark, [(1, "Alpha"), (2, "Beta")]), symbols_of(spark, ["Alpha", "Beta"]), "payment idempotency")
    assert [r.name for r in found.orderBy("rank").collect()] == ["Alpha", "Beta"]


def test_ties_by_severity_then_source(spark):
    text = "retries everywhere"
    claims = claims_of(spark, [("ADR-02", "soft", text, None, None), ("ADR-99", "hard", text, None, None), ("ADR-05", "hard", text, None, None)])
    found = find_by_intent(claims, links_of(spark, [(1, "A"), (2, "B"), (3, "C")]), symbols_of(spark, "ABC"), text)
    assert [r.name for r in found.orderBy("rank").collect()] == ["C", "B", "A"]


def test_name_overlap_breaks_ties_and_limits_clamp(spark):
    names = ["LANG_CODES", "Symbol", "SymbolId", "normalizePath"]
    claims = claims_of(spark, [("ADR-01", "hard", "normalizePath is canonical", None, None)])
    found = find_by_intent(claims, links_of(spark, [(1, n) for n in names]), symbols_of(spark, names), "normalizePath")
    assert found.orderBy("rank").first().name == "normalizePath"
    many = claims_of(spark, [("ADR-01", "soft", "idempotency required", None, None)] * 55)
    links = links_of(spark, [(i + 1, f"S{i}") for i in range(55)])
    assert find_by_intent(many, links, symbols_of(spark, [f"S{i}" for i in range(55)]), "idempotency", 9999).count() == 50
    with pytest.raises(ValueError):
        find_by_intent(claims, links, symbols_of(spark, names), "x", 0)


def test_best_scored_claim_wins_over_severity(spark):
    rows = [("ADR-01", "hard", "payment words among many others that dilute the score of this claim", None, None), ("ADR-02", "context", "payment", None, None), *[("Z", "soft", f"other {i}", None, None) for i in range(5)]]
    found = find_by_intent(claims_of(spark, rows), links_of(spark, [(1, "A"), (2, "A")]), symbols_of(spark, "A"), "payment").first()
    assert (found.claim_id, found.severity) == (2, "context")


def test_unmatched_claims_stay_last(spark):
    rows = [("ADR-01", "hard", "nothing of the kind", None, None), ("ADR-02", "soft", "payment only", None, None), ("ADR-03", "context", "payment idempotency here", None, None), *[("Z", "soft", f"x{i}", None, None) for i in range(6)]]
    claims, links = claims_of(spark, rows), links_of(spark, [(1, "A"), (2, "A"), (3, "A")])
    assert [r.claim_id for r in ranked_claims(claims, links, "payment idempotency").orderBy("place").collect()] == [3, 2, 1]
    assert [r.claim_id for r in ranked_claims(claims, links).orderBy("place").collect()] == [1, 2, 3]


def test_small_formats(spark):
    row = spark.createDataFrame([('say "hi" to', "x" * 61, ["a"], [], "abcdefghij", 3)], "q string, long string, one array<string>, none array<string>, sha string, n int").select(
        T.quote("q").alias("q"), T.truncate("long").alias("t"), T.name_list("one", True).alias("one"), T.name_list("one").alias("listed"), T.name_list("none").alias("none"), T.short_sha("sha").alias("sha"),
        T.backoff_ms("n", 100, 350).alias("b"), T.cost_usd(F.lit(1_000_000), F.lit(2_000_000)).alias("c"), T.full_sha(F.lit("a" * 40)).alias("f"),
    ).first()
    assert row.q == '"say \\"hi\\" to"' and row.t == "x" * 57 + "..." and (row.one, row.listed, row.none) == ("a", "[a]", "[]")
    assert row.sha == "abcdefg" and row.b == 350 and row.c == 165 and row.f


@pytest.mark.parametrize("path, text, name", [("docs/ADR-07-x.md", "---\nid: ADR-99\n---\nbody", "ADR-99"), ("docs/adr-07-x.md", "no frontmatter", "ADR-07"), ("docs/guide.md", "", "guide"), (".hidden", "", ".hidden"), ("a/xADR-1.md", "", "xADR-1")])
def test_source_name(spark, path, text, name):
    df = spark.createDataFrame([(path, text)], "p string, t string")
    assert df.select(T.source_name("p", "t")).first()[0] == name


def test_strip_frontmatter(spark):
    df = spark.createDataFrame([("---\nid: 1\n---\nbody\n---\nmore",), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.strip_frontmatter("t")).collect()] == ["body\n---\nmore", "plain"]
