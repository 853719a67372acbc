"""Text expressions: query words, the dual form, tokens, ranks and small formats.

All of them are built-in functions over columns; nothing leaves the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that are dropped where they stand alone, and letters that count as another one.
MARKS = "".join(map(chr, (*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331)))
VARIANTS, PLAIN = "ſẛµςϐϑϕϖϰϱϵ\u1fbe", "ssμσβθφπκρει"


def _marked_letters() -> dict[str, str]:
    """Lower-case letters that are a letter of a to z with one mark, by the decompositions of Unicode; others keep their marks."""
    low = {chr(c).lower() for c in range(0xC0, 0x2000)}
    parts = {c: unicodedata.normalize("NFD", c) for c in low if len(c) == 1}
    return {c: d[0] for c, d in sorted(parts.items()) if len(d) == 2 and d[0] in ascii_lowercase and unicodedata.combining(d[1])}


#: What folding replaces, as ``translate`` takes it: letters and what they become, then marks, which become nothing.
FOLDED = "".join(_marked_letters().values()) + PLAIN
ACCENTED = "".join(_marked_letters()) + VARIANTS + MARKS
#: What separates tokens of indexed text.
TOKEN_BREAK = r"[^\p{L}\p{N}_-]+"
#: What a query may not contain.
QUERY_NOISE = r"[^\p{L}\p{N}\s_-]"

#: At most 10 requests in a batch; 1 to 50 matches; 5 times as many claims are scored, 200 at most.
MAX_BATCH, DEFAULT_MATCHES, MAX_MATCHES, OVERFETCH, MAX_OVERFETCH = 10, 5, 50, 5, 200


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def sanitize_query(query: str) -> list[str]:
    """The words of a query: letters, digits, ``_`` and ``-``; case is kept."""
    return re.sub(r"[^\w\s-]", " ", query).split()


def query_words(query: Column | str) -> Column:
    """``sanitize_query`` over a column."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(_column(query), QUERY_NOISE, " "), r"\s+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def match_expression(query: str) -> str | None:
    """The query in the notation of full-text engines: the phrase or any word; None without words."""
    words = sanitize_query(query)
    if not words:
        return None
    quoted = [f'"{w}"' if "-" in w else w for w in words]
    return quoted[0] if len(words) == 1 else " OR ".join([f'"{" ".join(words)}"', *quoted])


def match_expression_of(query: Column | str) -> Column:
    """``match_expression`` over a column."""
    words = query_words(query)
    quoted = F.transform(words, lambda w: F.when(w.contains("-"), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w))
    phrase = F.array(F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"')))
    return F.when(F.size(words) == 1, F.get(quoted, F.lit(0))).when(F.size(words) > 1, F.array_join(F.concat(phrase, quoted), " OR "))


def match_limit_of(limit: Column | str) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MAX_MATCHES), _column(limit)))


def dual_form(text: Column | str) -> Column:
    """The text, and once more with ``_`` and ``-`` as spaces; null counts as empty."""
    plain = F.coalesce(_column(text), F.lit(""))
    joined = plain.contains("_") | plain.contains("-")
    return F.concat(plain, F.lit(" "), F.when(joined, F.translate(plain, "_-", "  ")).otherwise(plain))


def fold(text: Column | str) -> Column:
    """Lower case without the accents of the table; texts of one byte a character have none."""
    column = _column(text)
    low = F.lower(column)
    return F.when(F.octet_length(column) == F.length(column), low).otherwise(F.translate(low, ACCENTED, FOLDED))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(fold(text), TOKEN_BREAK), lambda t: t != "")


def fold_text(text: str) -> str:
    n = len(FOLDED)
    return text.lower().translate(str.maketrans(ACCENTED[:n], FOLDED, ACCENTED[n:]))


def name_overlap(name: Column | str, words: list[str]) -> Column:
    """How many of the query's words the lower-cased name contains; repeated words count again."""
    low = F.lower(_column(name))
    return sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))


def severity_rank(severity: Column | str) -> Column:
    column = _column(severity)
    return F.when(column == "hard", 0).when(column == "soft", 1).otherwise(2)


def match_limit(limit: int) -> int:
    return max(1, min(MAX_MATCHES, limit))


def overfetch(limit: int) -> int:
    """Claims that are scored for a number of matches."""
    return min(OVERFETCH * match_limit(limit), MAX_OVERFETCH)


def quote(text: Column | str) -> Column:
    """In double quotes; only double quotes are escaped."""
    return F.concat(F.lit('"'), F.replace(_column(text), F.lit('"'), F.lit('\\"')), F.lit('"'))


def short_sha(sha: Column | str) -> Column:
    return F.substring(_column(sha), 1, 7)


def short_date(date: Column | str) -> Column:
    return F.substring(_column(date), 1, 10)


def truncate(text: Column | str, width: int = 60) -> Column:
    column = _column(text)
    return F.when(F.length(column) > width, F.concat(F.substring(column, 1, width - 3), F.lit("..."))).otherwise(column)


def name_list(names: Column | str, single_bare: bool = False) -> Column:
    """``[a, b]``; with ``single_bare`` one name stands alone."""
    column = F.coalesce(_column(names), F.array().cast("array<string>"))
    listed = F.concat(F.lit("["), F.array_join(column, ", "), F.lit("]"))
    return F.when(F.size(column) == 1, F.get(column, F.lit(0))).otherwise(listed) if single_bare else listed


def full_sha(text: Column | str) -> Column:
    return _column(text).rlike("^[0-9a-f]{40}$")


def source_name(path: Column | str, text: Column | str) -> Column:
    """A document's name: the frontmatter's id, else ADR-n in the file name (upper case), else the file name."""
    base = F.element_at(F.split(_column(path), "/"), -1)
    opened, rest = _column(text).startswith("---\n"), F.substring(_column(text), 5, 1 << 30)
    front = F.when(opened & rest.contains("\n---\n"), F.substring_index(rest, "\n---\n", 1))
    entries = F.filter(F.split(front, "\n"), lambda line: line.startswith("id:"))
    values = F.filter(F.transform(entries, lambda line: F.btrim(F.substring(line, 4, 1 << 30), F.lit(" \t\r"))), lambda value: value != "")
    numbered = F.upper(F.regexp_extract(base, r"(?i)(?<![a-z0-9_])adr-[0-9]+(?![a-z0-9_])", 0))
    bare = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.get(values, F.lit(0)), F.nullif(numbered, F.lit("")), bare)


def strip_frontmatter(text: Column | str) -> Column:
    return F.regexp_replace(_column(text), r"\A---\n(?s:.*?)\n---\n", "")


# Prices in US dollars for a million tokens.
INPUT_PRICE, OUTPUT_PRICE = 15.0, 75.0


def cost_usd(input_tokens: Column | str, output_tokens: Column | str) -> Column:
    return (_column(input_tokens) * INPUT_PRICE + _column(output_tokens) * OUTPUT_PRICE) / 1e6


def backoff_ms(attempt: Column | str, base: int, most: int, retry_after: Column | None = None) -> Column:
    """Wait before a retry: what the server names, else doubling from ``base`` up to ``most``."""
    own = F.least(F.lit(base) * F.pow(F.lit(2.0), _column(attempt) - 1), F.lit(float(most)))
    return own if retry_after is None else F.coalesce(retry_after.cast("double"), own)


def retryable(status: Column | str) -> Column:
    """Whether a failed call may be tried again: no answer, too many requests, or a server error."""
    column = _column(status)
    return column.isNull() | (column == 429) | (column >= 500)
