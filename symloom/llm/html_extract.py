"""HTML main text by site style trees.

The DOMs of a host's pages are merged: an element is known by the path of tags
and classes that leads to it.  For each path the tree holds how many pages have
it, which child sequences (presentation) and which texts (content) occur there
and on how many pages.  A path's importance is the entropy of its features as a
share of the largest that so many occurrences could have: what repeats all over
the site goes towards 0, what is a page's own goes towards 1.  A branch's
importance is the best content importance inside it, tempered by the importance of
its presentation.

Tags and roles that say what they hold (navigation, footers, forms, ...) need no
statistics; nor do classes, where a whole class name says it.  A compound name
goes by its last word that is not just a container, so that ``post-comments`` is
noise and ``has-sidebar`` or ``social-history`` is not; an article inside of an
element that only its class condemns is kept if the page has no other.  The style
tree decides on everything else, also inside an article: branches of low
importance go, and so does a text that stands at the same path on ``REPEATED`` of
the pages that have it.  Where that would leave less than ``OWN_SHARE`` of an
article, the pages are copies of one another and the article stays whole.

Where a page has an article (or a main element), its text comes from there, else
from all branches.  Elements below ``MAX_DEPTH`` count for the one at that depth
in the tree (their text is extracted as any other), so paths are bounded.

Character references are decoded, white space in a block becomes one space and
blocks are joined in page order by one space.  Null or empty html gives an
empty text; a null url counts as the host ''; repeated rows are extracted one
by one; cut-off pages are read to their end; an empty table gives an empty
result and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import broadcast_if_small, written
from symloom.llm.worker import lean

#: Branches below this importance are removed ...
THRESHOLD = 0.5
#: ... where at least so many pages of the host have them.
MIN_PAGES = 4
#: A text is boilerplate that stands at one path on this share of the pages with the path, and on so many pages.
REPEATED, REPEATED_PAGES = 0.5, 3
#: An article is not cut below this share of its characters.
OWN_SHARE = 1 / 3
#: Depth and length of a label from which paths are cut short.
MAX_DEPTH, MAX_LABEL = 64, 100
#: Weight of the content against the presentation of a branch.
CONTENT_WEIGHT = 0.9
#: (host, path, feature) counts that a task holds before it hands them on.
_HELD = 200_000

# Element names and words of class names, by what HTML uses them for.
RAW = "script style noscript template svg iframe object canvas textarea select title head"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br"
)
NOISE_TAGS = "nav footer aside form button dialog menu search label input option"
NOISE_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
NOISE_WORDS = (
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent notice gdpr popup modal newsletter subscribe signup login share sharing social related recommended comment comments "
    "commentlist commentform disqus respond replies widget pagination pager search toolbar masthead skip"
)
# Words that make a class name one of a state, and words of mere containers.
STATE_WORDS = "has no with without is not hide show"
CONTAINER_WORDS = "area block box container inner list outer section slot wrap wrapper"
CLOSES_P = set(BLOCKS.split()) - {"br"}
CLOSES_SELF = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_RAW, _VOID, _BLOCKS = (frozenset(x.split()) for x in (RAW, VOID, BLOCKS))
_NOISE_TAGS, _NOISE_ROLES, _NOISE_WORDS = (frozenset(x.split()) for x in (NOISE_TAGS, NOISE_ROLES, NOISE_WORDS))
_STATES, _CONTAINERS = frozenset(STATE_WORDS.split()), frozenset(CONTAINER_WORDS.split())
_LISTS = frozenset("ul ol dl table tbody thead tfoot".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:--!?>|\Z)
    |<(?P<raw>{"|".join(sorted(_RAW - {"head"}))})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"']+)*+)(?:>|\Z)
    |<(?:/?[a-zA-Z]|[!?/])[^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


@lru_cache(maxsize=10_000)
def is_noise_name(name: str) -> bool:
    """Whether a class or id, by its last word that is no container, names what is not content."""
    words = [w for w in re.split("[-_]+", name) if w]
    while len(words) > 1 and words[-1] in _CONTAINERS:
        words.pop()
    return bool(words) and words[-1] in _NOISE_WORDS and _STATES.isdisjoint(words[:-1])


class _Element:
    """``noise`` is 2 by tag or role, 1 by a class name, which an article inside can undo; ``low`` is the style tree's."""

    __slots__ = ("children", "depth", "inside", "low", "noise", "path", "soft", "tag")

    def __init__(self, tag: str, path: str, depth: int, noise: int, inside: str, soft: bool, low: bool):
        self.tag, self.path, self.depth, self.noise, self.inside, self.soft, self.low = tag, path, depth, noise, inside, soft, low
        self.children: list[str] = []


def _opened(tag: str, rest: str, parent: _Element) -> _Element:
    label, inside, soft = tag, parent.inside, parent.soft
    noise = 2 if tag in _NOISE_TAGS or (tag == "header" and not inside) else parent.noise
    for name, a, b, c in _ATTRIBUTE.findall(rest) if rest else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            label += "." + ".".join(sorted(value.split())) if name == "class" else "#" + re.sub(r"\d+", "0", value)
            named = [v for v in value.split() if is_noise_name(v) and not (inside and tag == "section" and v == "menu")]  # a section of an article may hold a restaurant's
            if named and tag not in ("html", "body"):
                noise = max(noise, 1)
        elif name == "role":
            noise = 2 if value in _NOISE_ROLES else noise
            inside = inside or ("main" if value == "main" else "")
        elif name == "hidden" or value == "true":
            noise = 2
    if tag == "article" or (tag == "main" and not inside):
        inside = tag
        if noise == 1:
            noise, soft = 0, True
    if len(label) > MAX_LABEL:
        label = tag + "." + hashlib.md5(label.encode("utf-8", "replace")).hexdigest()
    parent.children.append(label)
    path = f"{parent.path}>{label}" if parent.depth < MAX_DEPTH else parent.path
    return _Element(tag, path, parent.depth + 1, noise, inside, soft, parent.low)


def _mark(path: str, text: str) -> str:
    """Names a text at a path."""
    return hashlib.md5(f"{path}\0{text}".encode("utf-8", "replace")).hexdigest()[:16]


class _Block(NamedTuple):
    path: str
    text: str
    noise: int
    inside: str  # innermost of article or main
    soft: bool
    low: bool


class Page:
    """One walk over a page: its blocks of text and, if asked for, the features of its elements."""

    def __init__(self, source: str, low: frozenset[str] = frozenset(), repeated: frozenset[str] = frozenset(), features: bool = False):
        self.blocks: list[_Block] = []
        #: (path, "style" or "text", feature)
        self.features: set[tuple[str, str, str]] = set()
        self._low, self._repeated, self._want, self._buffer = low, repeated, features, []
        self._stack = [_Element("", "", 0, 0, "", False, False)]
        self._walk(source)

    def _walk(self, source: str) -> None:
        at = 0
        for token in _TOKEN.finditer(source):
            if token.start() > at:
                self._buffer.append(source[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                self._close(tag)
            else:
                self._open(tag, token["rest"])
        self._buffer.append(source[at:])
        self._flush()
        while len(self._stack) > 1:
            self._pop()

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            self._buffer = []
            if text:
                here = self._stack[-1]
                mark = _mark(here.path, text) if self._want or self._repeated else ""
                self.blocks.append(_Block(here.path, text, here.noise, here.inside, here.soft, here.low or mark in self._repeated))
                if self._want:
                    self.features.add((here.path, "text", mark))

    def _pop(self) -> None:
        gone = self._stack.pop()
        if self._want and gone.tag:
            runs = " ".join(k for k, _ in groupby(gone.children))
            self.features.add((gone.path, "style", hashlib.md5(runs.encode("utf-8", "replace")).hexdigest()[:16]))

    def _pop_to(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k].tag in stop:
                return

    def _open(self, tag: str, rest: str) -> None:
        if tag in _BLOCKS:
            self._flush()
            if tag in CLOSES_P:
                self._pop_to(("p",), _BLOCKS - {"p"})
            if tag in CLOSES_SELF:
                self._pop_to(tuple(CLOSES_SELF[tag].split()), _LISTS)
        if tag not in _VOID and not rest.endswith("/"):
            new = _opened(tag, rest, self._stack[-1])
            new.low = new.low or new.path in self._low
            self._stack.append(new)

    def _close(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._flush()
        stop = frozenset() if tag in ("article", "main", "body", "html", "nav", "footer", "div", "section") else frozenset({"article", "main", "body"})
        self._pop_to((tag,), stop)

    def text(self) -> str:
        plain = [b for b in self.blocks if not b.noise]
        for container in ("article", "main"):
            for soft in (False, True):
                inner = [b for b in plain if b.inside == container and b.soft <= soft]
                if inner:
                    own = [b for b in inner if not b.low]
                    whole = sum(len(b.text) for b in own) < OWN_SHARE * sum(len(b.text) for b in inner)
                    return " ".join(b.text for b in (inner if whole else own))
        own = [b for b in plain if not b.low]
        return " ".join(b.text for b in own or plain)


_TREE = "host string, path string, kind string, feature string, pages long"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host, found = host_of(url), Page(source or "", features=True).features
            held.update((host, *f) for f in found)
            held.update((host, path, "page", "") for path in {f[0] for f in found})
            if len(held) > _HELD:
                yield _held(held)
                held = Counter()
    yield _held(held)


def _held(held: Counter) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], pa.string()) for i in range(4)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], names=["host", "path", "kind", "feature", "pages"])


def merged_features(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, kind, feature, d): on how many pages of a host a path has a feature, written.

    Counts are folded in each task, then over (host, path, feature), so a host
    with most of the pages is spread over its features.
    """
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    counts = rows.mapInArrow(lean(_features), _TREE).groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("d"))
    return written(counts, "style-features")


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, importance) of every element path of every host."""
    return _importance(merged_features(pages, url_col, html_col))


def _importance(counts: DataFrame) -> DataFrame:
    one = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "page", F.col("d"))).alias("pages"),
        *[F.sum(F.when(F.col("kind") == k, F.col("d") * F.log("d"))).alias(f"{k}_log") for k in ("style", "text")],
        *[F.sum(F.when(F.col("kind") == k, F.col("d"))).alias(f"{k}_n") for k in ("style", "text")],
    )

    def importance(kind: str):
        """The entropy of the features over its largest value, log(n): log(n) - sum(d log d) / n."""
        n = F.col(f"{kind}_n")
        spread = F.when(n > 1, 1 - F.col(f"{kind}_log") / n / F.log(n)).otherwise(1.0)
        return F.when(n.isNotNull(), F.when(F.col("pages") > 1, spread).otherwise(1.0))

    one = written(one.select("host", "path", "pages", importance("style").alias("style"), importance("text").alias("content")), "style-trees")
    steps = F.split(F.substring("path", 2, 1 << 20), ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit(">"), F.array_join(F.slice(steps, 1, i), ">")))
    best = one.where("content is not null").select("host", F.explode(above).alias("path"), "content").groupBy("host", "path").agg(F.max("content").alias("best"))
    joined = one.join(best, ["host", "path"], "left")
    mixed = CONTENT_WEIGHT * F.coalesce("best", F.lit(0.0)) + (1 - CONTENT_WEIGHT) * F.coalesce("style", F.lit(1.0))
    return joined.select("host", "path", "pages", mixed.alias("importance"))


def repeated_texts(counts: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, feature) of texts that stand at one path on most pages that have it."""
    pages = counts.where("kind = 'page'").select("host", "path", F.col("d").alias("pages")).where(F.col("pages") >= min_pages)
    texts = counts.where("kind = 'text'").where(F.col("d") >= REPEATED_PAGES).select("host", "path", "feature", "d")
    return texts.join(pages, ["host", "path"]).where(F.col("d") >= REPEATED * F.col("pages")).select("host", "feature")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            known: dict[tuple, frozenset] = {}
            kept = lambda names: known.setdefault(key := tuple(names or ()), frozenset(key))
            lists = zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
            texts = [Page(source or "", kept(low), kept(repeated)).text() for source, low, repeated in lists]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    counts = merged_features(pages, url_col, html_col)
    low = _importance(counts).where((F.col("pages") >= min_pages) & (F.col("importance") < threshold)).select("host", "path", F.lit(None).cast("string").alias("feature"))
    told = low.unionByName(repeated_texts(counts, min_pages).withColumn("path", F.lit(None).cast("string")))
    low = written(told.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"), F.sort_array(F.collect_set("feature")).alias("repeated")), "low-branches")
    size = low.agg(F.sum(F.length(F.concat_ws(",", "low", "repeated")) + 64)).first()[0] or 0
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST.pattern, 1))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    joined = rows.join(broadcast_if_small(low, 1, size), "host", "left").select("id", "url", "html", "low", "repeated")
    return joined.mapInArrow(lean(_extract), "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
