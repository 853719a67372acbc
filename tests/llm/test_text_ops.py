import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from symloom.llm.bpe_codec import Codec, Lexicon, bpe_encode, compile_lexicon  # noqa: E402
from symloom.llm.decontaminate import decontaminate, overlaps  # noqa: E402
from symloom.llm.html_extract import Page, extract_text, style_trees  # noqa: E402
from symloom.llm.kernels import Words, stretches, text_blocks  # noqa: E402
from symloom.llm.language_id import _calibrate, build_model, grams_of, identify, keep_identified, language_id, train, words_of  # noqa: E402
from symloom.llm.sharding import assign_shards, lookup_table, next_prime, write_shards  # noqa: E402
from symloom.llm.substring_dedup import repeated_passages, wide_nodes  # noqa: E402
from symloom.llm.token_counts import PrefixTable, TextPrefixes, prefix_tables, token_counts  # noqa: E402
from symloom.llm.wordbpe import WordBpe  # noqa: E402

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, id string, n_tokens string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, "clash", "clash") for i, t, l in (r if len(r) == 3 else (*r, None) for r in rows)], DOCS)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(open(VOCABULARY, encoding="utf-8").read())


def odd_texts():
    rng = random.Random(7)
    ranges = [(32, 127), (160, 600), (0x300, 0x370), (0x370, 0x1000), (0x2000, 0x3100), (0x4E00, 0x9000), (0x1F300, 0x1F700)]
    pool = [chr(rng.randrange(*rng.choice(ranges))) for _ in range(1500)] + list("\t\n\r\x1c\x85ΣİƱȺ")
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*made, "", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "aaaaaaaaa aaaa", "ΑΣ Σ don't they'll 'sabc 12½ ²", "_a_ -- <|", "x" * 5000, "word " * 3000, "İstanbul"]


# ---- tokens


def test_counts_and_codes_equal_the_library(spark, library):
    texts = odd_texts()
    docs = docs_of(spark, [*enumerate(texts), (10_000, None), (None, "null id")])
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    counted = {r.doc_id: r for r in token_counts(docs, VOCABULARY, limit=20).collect()}
    assert {i: counted[i].n_tokens for i in want} == {i: len(v) for i, v in want.items()}
    assert all(counted[i].n_bytes == len(t.encode()) and counted[i].over_limit == (len(want[i]) > 20) for i, t in enumerate(texts))
    assert (counted[10_000].n_tokens, counted[10_000].n_bytes, counted[10_000].over_limit) == (0, 0, False) and None in counted
    coded = {r.doc_id: r for r in bpe_encode(docs, VOCABULARY).collect()}
    assert {i: coded[i].ids for i in want} == want and coded[10_000].ids == []
    assert all(coded[i].decoded == library.decode(v, skip_special_tokens=False) for i, v in want.items())


def test_empty_table(spark):
    assert token_counts(docs_of(spark, []), VOCABULARY).count() == 0 and bpe_encode(docs_of(spark, []), VOCABULARY).count() == 0


def test_prefixes_answer_without_encoding(spark, library, bpe):
    table = PrefixTable(bpe)
    text = "Unbelievable internationalisation of tokenizers don't stop at 123 words"
    prefixes = TextPrefixes(table, text)
    cut = library.encode(text, add_special_tokens=False)
    assert prefixes.tokens() == len(cut.ids)
    words = bpe.split(text)
    for n, word in enumerate(words):
        for b in range(len(word) + 1):
            want = len(library.encode(" ".join([*words[:n], word[:b]]), add_special_tokens=False).ids)
            if "'" not in word:
                assert prefixes.tokens(n, b) == want
    n, b = prefixes.fit(5)
    assert prefixes.tokens(n, b) <= 5 and prefixes.fit(10_000) == (len(words), 0)
    rows = prefix_tables(docs_of(spark, [(1, text), (2, None)]), VOCABULARY).collect()
    assert {r.doc_id: r.prefix_tokens[-1] for r in rows} == {1: len(cut.ids), 2: 0}


def test_lexicon_is_a_minimal_acyclic_automaton(bpe):
    words = ["run", "runs", "running", "sun", "suns", "é", "sunning", "a"]
    compiled = compile_lexicon({w: bpe.merge(w) for w in words})
    lexicon = Lexicon(np.frombuffer(compiled, np.int32))
    assert {w: lexicon.get(w) for w in words} == {w: bpe.merge(w) for w in words}
    assert lexicon.get("su") is None and lexicon.get("sunny") is None and lexicon.get("") is None
    # States are told apart by what may follow them; the minimal automaton has one for each such set.
    raw = [w.encode() for w in words]
    futures = {frozenset(x[i:] for x in raw if x.startswith(w[:i])) for w in raw for i in range(len(w) + 1)}
    assert len(lexicon.final) == len(futures)
    assert Lexicon(np.frombuffer(compile_lexicon({}), np.int32)).get("a") is None
    codec = Codec(bpe, lexicon)
    assert codec.encode("Running suns unseenword") == [i for w in ("running", "suns", "unseenword") for i in bpe.merge(w)]


def plain_merge(bpe, word):
    """One merge after the other over the whole word."""
    ids = [bpe.vocab[s] for s in bpe.symbols(word)]
    while len(ids) > 1:
        ranks = [bpe.rank.get(p, len(bpe.made)) for p in zip(ids, ids[1:])]
        if (best := min(ranks)) == len(bpe.made):
            break
        at = ranks.index(best)
        ids[at : at + 2] = [bpe.made[best]]
    return ids


def test_nodes_of_a_text_beyond_the_usual_bits_of_a_place(monkeypatch):
    """As if a place had few bits: nodes are those of the whole text."""
    import symloom.llm.substring_dedup as s

    values = np.random.default_rng(4).integers(0, 1 << 63, 5000, dtype=np.uint64)
    first = np.array([0, 2000, 5000])
    want = [x.tolist() for x in wide_nodes(values, first, 40)]
    monkeypatch.setattr(s, "_PLACE", 6)
    assert [x.tolist() for x in wide_nodes(values, first, 40)] == want and max(want[0]) > 4000


def test_merging_by_a_heap_equals_plain_merging(bpe):
    rng = random.Random(5)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("a", "ab", "etaoinshr", "thé日x") for n in (1, 2, 3, 7, 40, 63, 64, 65, 200)]
    assert [bpe.merge(w) for w in words] == [plain_merge(bpe, w) for w in words]
    assert [m.tolist() for m in bpe.merge_many(words * 2)] == [plain_merge(bpe, w) for w in words] * 2


def test_a_word_of_a_million_letters_is_merged_in_seconds(spark, bpe, library):
    """In the lexicon's build and in the tasks, among usual texts, and as the library has it."""
    rng = random.Random(6)
    word = "".join(rng.choices("etaoinshrdlu", k=1_000_000))
    texts = [(i, "usual words of a usual text") for i in range(50)] + [(99, f"before {word} after")]
    began = time.monotonic()
    got = {r.doc_id: r.ids for r in bpe_encode(docs_of(spark, texts), VOCABULARY).collect()}
    assert time.monotonic() - began < 60
    assert got[99] == library.encode(texts[-1][1], add_special_tokens=False).ids and got[0] == library.encode(texts[0][1], add_special_tokens=False).ids


def test_merging_many_equals_merging_one(bpe):
    words = [w for t in odd_texts() for w in bpe.split(t)]
    assert [m.tolist() for m in bpe.merge_many(words)] == [bpe.merge(w) for w in words] and bpe.merge_many([]) == []


# ---- html


def test_comments_go_and_a_section_of_an_article_stays():
    def text(page):
        return Page(page).text()

    assert text('<article><p>Own</p><ol class="commentlist"><li>Reader says</li></ol><div class="comment-list">x</div></article>') == "Own"
    assert text('<article><p>Eat</p><section class="menu"><p>Menu of the restaurant: soup</p></section></article>') == "Eat Menu of the restaurant: soup"
    assert text('<article><p>Own</p><ul class="menu"><li>Home</li></ul><nav><section class="menu">x</section></nav></article><section class="menu">y</section>') == "Own"



def test_page_text():
    page = "<!DOCTYPE html><html><head><title>no</title><script>var t='</p>';</script></head><body><header>menu</header><nav><ul><li><a href='/'>x</a></ul></nav><div class='ad'>buy</div><article><h1>T &eacute;&amp;</h1><p>one  <b>two</b>\n three<p>four<br>five<!-- no --><div class='post-comments'><p>bad</div><aside>no</aside></article><footer>&copy; no</footer></body></html>"
    assert Page(page).text() == "T é& one two three four five"
    assert Page("<p>cut off &am").text() == "cut off &am" and Page("").text() == "" and Page("<article><p>a</p><p").text() == "a"
    assert Page("<div title='a>b'>x</div><form>f</form><p hidden>h</p><div role=navigation>n</div>").text() == "x"
    assert Page("plain").text() == "plain" and Page("a < b <3").text() == "a < b <3"


def test_style_tree_finds_what_repeats(spark):
    rows = [(i, "https://Host.example:80/p", f"<body><div class=top>same on every page</div><div class=body><p>own text number {i}</p></div><div class=end><span>bye</span></div></body>") for i in range(12)]
    rows += [(100, "http://u@other/x", "<div class=top>only here</div>"), (101, None, None), (102, "bad url", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in extract_text(pages).collect()}
    assert all(found[i].text == f"own text number {i}" and found[i].n_chars == len(found[i].text) for i in range(12))
    assert found[100].text == "only here" and found[101].text == "" and found[102].n_chars == 0 and found[101].url is None
    tree = {r.path: r.importance for r in style_trees(pages).where("host = 'host.example'").collect()}
    assert tree[">body>div.top"] < 0.2 < 0.8 < tree[">body>div.body>p"]
    assert extract_text(pages.limit(0)).count() == 0


def test_class_names_are_taken_whole():
    for name in ("has-sidebar", "no-sidebar", "social-history", "with-comments", "adverse", "page"):
        assert Page(f"<div class='x {name}'><p>own</p></div>").text() == "own"
    for name in ("post-comments", "comments-area", "cookie-banner", "sidebar", "ad_slot", "related-list"):
        assert Page(f"<p>own</p><div class='x {name}'><p>other</p></div>").text() == "own"
    assert Page("<div class='widget'><article><p>Main story</p></article></div>").text() == "Main story"
    assert Page("<div class=related><article>card</article></div><article>story</article>").text() == "story"
    assert Page("<article><p>if <math><mi>x</mi> = 1</math> then</p></article>").text() == "if x = 1 then"


def test_the_style_tree_cuts_what_repeats_inside_articles(spark):
    """No class or tag tells these notices from the text; copies of one page keep theirs."""
    note = "<p>Read our terms before you go on.</p>"
    rows = [(i, "http://a.example/x", f"<article><h1>Title {i}</h1><p>own text of page {i}, long enough to count</p>{note}</article>") for i in range(12)]
    rows += [(100 + i, "http://b.example/x", "<article><h1>One</h1><p>the same page again</p></article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on, off = ({r.page_id: r.text for r in extract_text(pages, min_pages=n).collect()} for n in (4, 10**9))
    assert all(on[i] == f"Title {i} own text of page {i}, long enough to count" and off[i] == f"{on[i]} Read our terms before you go on." for i in range(12))
    assert all(on[100 + i] == off[100 + i] == "One the same page again" for i in range(6))


def test_very_deep_pages(spark):
    deep = "<div class=level>" * 40_000 + "text" + "</div>" * 40_000
    page = Page(deep, features=True)
    assert page.text() == "text" and max(len(f[0]) for f in page.features) < 64 * 12
    pages = spark.createDataFrame([(i, "http://a.example", deep) for i in range(5)], "page_id long, url string, html string")
    assert [r.text for r in extract_text(pages).collect()] == ["text"] * 5


# ---- language


def corpus(n=240):
    rng = random.Random(1)
    parts = {"xa": ["ka", "lo", "mi", "tan", "ru"], "yb": ["sch", "ö", "ten", "ber", "ü"], "zc": ["que", "ión", "os", "ña", "el"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))).capitalize() + ".", lang))
    return rows


def test_language_id(spark):
    rows = corpus() + [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 !?", "xa"), (1003, "KALO mitan", None), (1004, "ka " * 30_000, "xa"), (1005, "zxqj wvkq pqzx " * 30, None), (1006, "² ½ ① Ⅷ", None), (None, "kalo mitan", "xa")]
    found = {r.doc_id: r for r in language_id(docs_of(spark, rows)).collect()}
    held = [(i, l) for i, _, l in rows[:240] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(found[i].lang_pred == l and found[i].held_out for i, l in held)
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1006)] == ["und"] * 4 and found[None].held_out is False and found[1003].lang_pred == found[1004].lang_pred == "xa"
    assert all(0 <= r.score <= 1 for r in found.values()) and not any(found[i].rejected for i in range(240)) and found[1005].rejected
    model = train(docs_of(spark, rows))
    kept = keep_identified(docs_of(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "lang", "id", "n_tokens"] and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.rejected}


def test_garbage_among_the_calibration_texts_does_not_end_rejection():
    rng = np.random.default_rng(4)
    model = build_model({lang: grams_of([lang * 3]) for lang in ("ab", "cd")})
    own = [(lang, 600, e, 0.5, True) for lang in model.langs for e in rng.normal(1.4, 0.1, 80)]
    odd = [("ab", 600, 11.6, 0.5, False), ("ab", 600, 5.8, 0.5, True), ("ab", 600, 5.8, 0.5, True)]
    names = ["lang", "chars", "entropy", "spread", "best"]
    _calibrate(model, pa.table([list(c) for c in zip(*(own + odd), strict=True)], names=names))
    limits = model.limit(np.array([0, 1]), np.array([600, 600]), model.z)
    assert (limits < 4).all() and (limits > 1.9).all()


def test_nothing_to_learn(spark):
    empty = docs_of(spark, [(1, "text", None)])
    assert train(empty) is None and language_id(empty).first().lang_pred == "und" and keep_identified(empty, None).count() == 1
    assert keep_identified(docs_of(spark, [(1, "12", None), (2, None, None), (3, "²", None), (None, "é", None)]), None).count() == 1
    assert identify(docs_of(spark, []), None).count() == 0


def plain_kneser_ney(words, order=5, alphabet=4096):
    """p(character, context) straight from the definition, without arrays or hashes."""
    pad = " " * (order - 1)
    top = Counter(f"{pad}{w} "[i : i + order] for w in words for i in range(len(w) + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(c, context):
        if len(context) == 0:
            own, lower = counts[1], 1 / alphabet
        else:
            own, lower = counts[len(context) + 1], p(c, context[1:])
        once, twice = (sum(n == k for n in own.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        after = [n for g, n in own.items() if g[:-1] == context]
        if not after:
            return lower
        return (max(own.get(context + c, 0) - discount, 0) + discount * len(after) * lower) / sum(after)

    return p


def test_model_is_interpolated_kneser_ney():
    words = words_of("the cat sat on the mat the hat that ate it all at the tea")
    p = plain_kneser_ney(words)
    known = set("".join(words)) | {" "}
    for context in ("    ", "   t", "  th", "zzzz", " the", "xxxt"):
        assert abs(sum(p(c, context) for c in known) + (4096 - len(known)) * p("#", context) - 1) < 1e-9
    model = build_model({"en": dict(grams_of(words))})
    tried = ["the", "xyz", "tea", "hatter", "a", "zt"]
    scores, size = model.word_scores(tried)
    for k, word in enumerate(tried):
        padded = f"    {word} "
        want = sum(math.log(p(padded[i], padded[i - 4 : i])) for i in range(4, len(padded)))
        assert abs(scores[k, 0] - want) < 1e-4 and size[k] == len(word) + 1


# ---- sharding


def plain_table(shards, size):
    """The turns, with each preference order written out."""
    import hashlib

    number = lambda n, s: int(hashlib.md5(f"{s}:{n}".encode()).hexdigest()[:15], 16)
    orders = [iter([(number(s, "offset") % size + k * (number(s, "skip") % (size - 1) + 1)) % size for k in range(size)]) for s in shards]
    table = [-1] * size
    while -1 in table:
        for n, order in enumerate(orders):
            if -1 in table:
                table[next(s for s in order if table[s] < 0)] = n
    return table


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = lookup_table(shards, slots=101)
    assert table == plain_table(shards, 101) and len(table) == 101 and max(np.bincount(table)) - min(np.bincount(table)) <= 1
    fewer = lookup_table(shards[:-1], slots=101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 20
    assert np.bincount(lookup_table(["a", "b"], [3, 1], 1000))[0] > 740 and next_prime(90) == 97
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            lookup_table(wrong)
    with pytest.raises(ValueError):
        lookup_table(["a"], [0])


def test_assign_and_write(spark, tmp_path):
    table = lookup_table([f"s{i}" for i in range(4)])
    df = spark.createDataFrame([(i, 9) for i in range(500)] + [(None, 9), (None, 9), (3, 9)], "k long, shard int")
    rows = assign_shards(df, "k", table).collect()
    where = defaultdict(set)
    for r in rows:
        where[r.k].add((r.slot, r.shard))
    assert len(rows) == 503 and all(len(v) == 1 for v in where.values()) and all(table[s] == n for v in where.values() for s, n in v)
    assert assign_shards(df.limit(0), "k", table).count() == 0
    write_shards(df, "k", table, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 503
    plan = assign_shards(df, "k", table)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


# ---- decontamination


def test_overlaps(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [(1, make(30)), (2, make(16)), (3, make(7)), (4, make(3)), (5, None), (6, make(60))]
    third = list(items[0][1])
    third[2::5] = ["x"] * len(third[2::5])
    half = list(items[0][1])
    half[::2] = ["x"] * 15
    docs = [(0, make(50) + items[0][1] + make(9)), (1, make(3) + third + make(3)), (2, make(5) + half), (3, make(9) + items[1][1][:10] + make(9)), (4, items[2][1] + make(5)), (5, items[3][1] + make(40)), (6, make(900)), (7, items[5][1][20:40] + make(2) + items[1][1]), (8, [])]
    texts = [(i, ", ".join(w.upper() if k % 3 else w for k, w in enumerate(words))) for i, words in docs] + [(9, None)]
    tests = spark.createDataFrame([(i, w and " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(0, 1), (1, 1), (4, 3), (7, 6), (7, 2)}
    both = [overlaps(docs_of(spark, texts), tests, broadcast_words=n).collect() for n in (10_000, 0)]
    assert {(r.doc_id, r.item_id) for r in both[0]} == want and sorted(both[0]) == sorted(both[1])
    assert next((r.begin_word, r.end_word, r.n_matched) for r in both[0] if r.doc_id == 0) == (50, 80, 30)
    left = decontaminate(docs_of(spark, texts), tests)
    assert {r.doc_id for r in left.collect()} == {2, 3, 5, 6, 8, 9} and len(left.columns) == 5
    assert overlaps(docs_of(spark, []), tests).count() == 0 and overlaps(docs_of(spark, texts), tests.limit(0)).count() == 0


def plain_overlaps(docs, items, masks=("11111", "111101", "1101101", "11100011"), min_words=13, percent=80):
    """Pairs (document, item) that share a seed on a diagonal with a good stretch, all diagonals tried."""
    split = lambda t: re.sub("[!-/:-@\\[-`{-~]", "", (t or "").lower()).split()
    out = set()
    for n, (i, text) in enumerate(docs):
        a = split(text)
        for m, (j, item) in enumerate(items):
            b = split(item)
            for d in range(1 - len(b), len(a)):
                low, high = max(0, -d), min(len(b), len(a) - d)
                same = [a[d + x] == b[x] for x in range(low, high)]
                seeded = any(all(same[x + y] for y, c in enumerate(mask) if c == "1") for mask in masks for x in range(len(same) - len(mask) + 1))
                if not seeded:
                    continue
                whole = len(same) == len(b) >= 5 and 100 * sum(same) >= percent * len(b)
                best = max((y - x for x, y in stretches(np.array(same), 100 - percent, percent)), default=0)
                if whole or best >= max(5, min(min_words, len(b))):
                    out.add((n, i, m, j))
    return sorted(((i, j) for _, i, _, j in out), key=str)


def test_overlaps_equal_all_diagonals_with_null_and_repeated_ids(spark):
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(7, make(20)), (None, make(15)), (8, make(40)), (8, make(13)), (9, make(6)), (7, make(12)), (10, make(4)), (11, None)]
    docs = []
    for n in range(70):
        words = make(rng.randrange(0, 60))
        if n % 2:
            own = list(rng.choice(items[:-1])[1])
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "x"
            words += own[rng.randrange(3) :] + make(rng.randrange(5))
        docs.append((rng.choice([None, 1, 2, n]), " ".join(words)))
    docs += [docs[1], (1, None), (None, ""), docs[3], docs[3]]
    whole = list(items[3][1])
    whole[0] = "y"
    docs.append((300, " ".join(whole)))
    texts = [(i, w and " ".join(w)) for i, w in items]
    tests = spark.createDataFrame(texts, "item_id long, text string")
    want = plain_overlaps(docs, texts)
    rows = [overlaps(docs_of(spark, docs).repartition(n), tests, broadcast_words=words).collect() for n, words in ((1, 10_000), (5, 10_000), (3, 0))]
    assert sorted(((r.doc_id, r.item_id) for r in rows[0]), key=str) == want and (300, 8) in want
    assert sorted(rows[0], key=str) == sorted(rows[1], key=str) == sorted(rows[2], key=str)
    dirty = {n for n, d in enumerate(docs) if plain_overlaps([d], texts)}
    left = sorted(((i, t) for n, (i, t) in enumerate(docs) if n not in dirty), key=str)
    for words in (10_000, 0):
        assert sorted(((r.doc_id, r.text) for r in decontaminate(docs_of(spark, docs), tests, broadcast_words=words).collect()), key=str) == left


# ---- passages


def test_wide_nodes_are_the_top_of_the_cartesian_tree():
    rng = np.random.default_rng(4)
    values = (rng.integers(1, 40, 300).astype(np.uint64)) << np.uint64(24)
    first = np.array([0, 90, 90, 100, 300])
    nodes, left, right = wide_nodes(values, first, 12)
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        for c in range(a, b):
            key = lambda i: (values[i], i)
            lo, hi = c, c + 1
            while lo > a and key(lo - 1) > key(c):
                lo -= 1
            while hi < b and key(hi) > key(c):
                hi += 1
            if hi - lo >= 12:
                want.append((c, lo, hi))
    assert list(zip(nodes.tolist(), left.tolist(), right.tolist(), strict=True)) == want


def test_passages(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    shared, near, short = make(51), make(90), make(30)
    edited = list(near)
    edited[45] = "changed"
    rows = {i: make(rng.randrange(0, 200)) for i in range(60)}
    for i in (3, 11, 40):
        rows[i] = make(70) + shared + make(rng.randrange(60))
    rows[5], rows[50] = make(40) + near + make(20), make(5) + edited
    rows[7], rows[8] = make(80) + short + make(80), make(10) + short + make(90)
    rows[20], rows[21] = rows[12] + make(60), make(60)
    rows[22] = list(rows[21])
    texts = [(i, ". ".join(w)) for i, w in rows.items()] + [(70, None), (71, ""), (None, " ".join(shared))]
    found = repeated_passages(docs_of(spark, texts).repartition(4)).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in found}
    linked = set().union(*pairs)
    want = {3, 11, 40, 5, 50, 21, 22} | ({12, 20} if len(rows[12]) >= 50 else set())
    assert linked == want and frozenset((5, 50)) in pairs and {frozenset((21, 22))} <= pairs
    exact = next(r for r in found if {r.doc_id, r.other_id} <= {3, 11, 40})
    assert exact.end_word - exact.begin_word == 51 and rows[exact.doc_id][exact.begin_word : exact.end_word] == shared
    assert repeated_passages(docs_of(spark, [])).count() == 0


def test_passages_around_a_frequent_phrase(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = {}, set()
    for group in range(120):
        phrase, before, after = make(46), make(5), make(5)
        for k in range(12):
            rows[12 * group + k] = make(45) + (before + phrase + after if k in (7, 9) else make(5) + phrase + make(5)) + make(45)
        want.add((12 * group + 9, 12 * group + 7, 45, 101))
    found = repeated_passages(docs_of(spark, [(i, " ".join(w)) for i, w in rows.items()]).repartition(4)).collect()
    assert {tuple(r)[:4] for r in found} == want and len(found) == len(want)


def test_near_passages_around_a_frequent_phrase(spark):
    """Pairs with one word changed behind a phrase of a dozen texts, some of whose other words are beside it in earlier texts."""
    rng = random.Random(14)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = {}, set()
    for group in range(60):
        phrase, before, after = make(34 + group % 9), make(4), make(22)
        own = {k: [*make(4), *phrase, *make(23)] for k in range(12)}
        own[7], own[9] = ([*before, *phrase, word, *after] for word in ("one", "other"))
        if group % 2:  # all that is beside the phrase is also in an earlier text, but no passage
            own[1] = [*before, *phrase[:20], *make(40)]
            own[3] = [*make(13), *phrase[-25:], *make(1), *after[:13], *make(9)]
            own[5] = [*make(13), *phrase[-25:], *make(10), *after[9:]]
        for k in range(12):
            rows[12 * group + k] = make(45) + own[k] + make(45)
        want.add((12 * group + 9, 12 * group + 7))
    found = repeated_passages(docs_of(spark, [(i, " ".join(w)) for i, w in rows.items()]).repartition(4)).collect()
    label = {i: r.class_id for r in found for i in (r.doc_id, r.other_id)}
    truth = plain_passages(rows)
    assert want <= truth and {(r.doc_id, r.other_id) for r in found} <= truth
    caught = {(a, b) for a, b in truth if a in label and label[a] == label.get(b)}
    assert len(caught & want) >= 0.95 * len(want) and len(caught) >= 0.95 * len(truth)


def plain_passages(rows, min_words=50, k=5, percent=80):
    """Pairs of documents with a window of ``min_words`` words in both that is similar enough, all pairs and places tried."""
    grams = {i: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] for i, w in rows.items()}
    n = min_words - k + 1
    pairs = set()
    for a, b in combinations(sorted(rows), 2):
        where = defaultdict(list)
        for j, g in enumerate(grams[b]):
            where[g].append(j)
        for d in {i - j for i, g in enumerate(grams[a]) for j in where[g]}:
            hits = [grams[a][i] == grams[b][i - d] for i in range(max(0, d), min(len(grams[a]), len(grams[b]) + d))]
            if any(100 * sum(hits[i : i + n]) >= percent * (2 * n - sum(hits[i : i + n])) for i in range(len(hits) - n + 1)):
                pairs.add((b, a))
    return pairs


def test_passages_against_all_pairs_whatever_the_partitions(spark):
    """220 documents with planted passages, exact ones and ones at 0.8 or more, some of them around one phrase."""
    rng = random.Random(21)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = {i: make(rng.randrange(20, 120)) for i in range(220)}
    exact = set()
    for g in range(12):
        passage = make(rng.randrange(52, 90))
        for i in rng.sample(range(220), 4):
            rows[i] = [*make(10), *rows[i][:30], *passage, *make(10)]
    for g in range(20):
        passage = make(rng.randrange(70, 110))
        for n, i in enumerate(rng.sample(range(220), 2)):
            own = list(passage)
            if n:
                own[rng.randrange(len(own))] = "changed"
            rows[i] = [*rows[i], *own]
    phrase, longer = make(30), make(90)
    for i in range(0, 60, 3):
        rows[i] = [*rows[i], *phrase]
    longer[30:60] = phrase
    decoys = [[w if j % 30 else f"other{i}" for j, w in enumerate(longer)] for i in range(6)]
    for i, own in zip((1, 2, 4, 5, 7, 8), decoys, strict=True):
        rows[i] = [*rows[i], *own]
    for i in (10, 31):
        rows[i] = [*rows[i], *longer]
    texts = [(i, " ".join(w)) for i, w in rows.items()]
    found = [sorted(tuple(r) for r in repeated_passages(docs_of(spark, texts).repartition(n)).collect()) for n in (1, 7, 40)]
    assert found[0] == found[1] == found[2]
    want = plain_passages(rows)
    label = {i: r[-1] for r in found[0] for i in r[:2]}
    caught = {(a, b) for a, b in want if a in label and label[a] == label.get(b)}
    assert len(caught) >= 0.9 * len(want) and (31, 10) in caught
    told = {r[:2] for r in found[0]}
    assert len(told & want) >= 0.95 * len(told)
    for r in found[0]:
        same = lambda i, x, y: {tuple(rows[i][j : j + 5]) for j in range(x, y - 4)}
        a, b = same(r[0], r[2], r[3]), same(r[1], r[4], r[5])
        assert r[3] - r[2] >= 50 <= r[5] - r[4] and 100 * len(a & b) >= 80 * len(a | b)


def test_texts_that_repeat_themselves(spark):
    rows = [(i, "z " * 3000) for i in range(6)] + [(9, "q r " * 200), (10, "q r " * 200 + "end")]
    found = repeated_passages(docs_of(spark, rows)).collect()
    assert len(found) < 40 and {r.doc_id for r in found} == {1, 2, 3, 4, 5, 10} and {r.class_id for r in found} == {0, 9}


@pytest.mark.parametrize("edit", ["insert", "delete", "insert three", "both"])
def test_passages_with_insertions_and_deletions(spark, edit):
    rng = random.Random(12)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = {}, set()
    for k in range(30):
        own, other = make(90), None
        if edit == "insert":
            other = own[:45] + make(1) + own[45:]
        elif edit == "delete":
            other = own[:45] + own[46:]
        elif edit == "insert three":
            other = own[:45] + make(3) + own[45:]
        else:
            other = own[:30] + make(1) + own[30:60] + own[61:]
        rows[2 * k], rows[2 * k + 1] = make(40) + own + make(40), make(30) + other + make(50)
        want.add((2 * k + 1, 2 * k, 30, 30 + len(other), 40, 130))
    # Halves that are far apart are no passage.
    half, rest = make(40), make(40)
    rows[100], rows[101] = half + make(30) + rest, half + rest
    found = {tuple(r)[:6] for r in repeated_passages(docs_of(spark, [(i, " ".join(w)) for i, w in rows.items()]).repartition(4)).collect()}
    assert found <= want and len(found) >= 28


def test_blocks_of_words_follow_the_pattern():
    text = "A b\x0bc d e f"
    for _, _, data, offsets in text_blocks(pa.array([text])):
        assert len(Words(data, offsets).hashes) == len(re.findall("[^\x20\x09-\x0d]+", text))
