"""Path and identifier expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from symloom.functions.text import _column

# First path segments that do not name a module, and the folders that scans leave out.
SOURCE_ROOTS = ("src", "lib", "app", "packages", "source")
SKIPPED_FOLDERS = ("node_modules", "dist", "build", "coverage")
# What a test file is called, without regard to case.
TEST_PATTERNS = (r"(^|/)tests/", r"\.(test|spec)\.[cm]?[jt]sx?$", r"(^|/)test_[^/]*\.py$", r"_test\.py$")
EXTENSIONS = {".ts": "typescript", ".tsx": "typescript", ".py": "python", ".pyi": "python", ".go": "go"}
SHORT_CODES = {"ts": "typescript", "py": "python", "go": "go"}


def _choose(column: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in table.items()])


def normalize_path(path: Column | str) -> Column:
    """One form of a path: no file scheme, forward and single slashes, no ``./`` or last slash, lower-case drive.

    Fails on an empty path.  A leading double slash (a network share) stays.
    """
    raw = _column(path)
    rest = F.substring(raw, 8, 1 << 20)
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    bare = F.when(raw.startswith("file://"), F.regexp_replace(decoded, r"^/(?=[A-Za-z]:)", "")).otherwise(raw)
    slashed = F.replace(bare, F.lit("\\"), F.lit("/"))
    single = F.regexp_replace(slashed, "/+", "/")
    single = F.when(slashed.startswith("//"), F.concat(F.lit("/"), single)).otherwise(single)
    plain = F.regexp_replace(single, r"^\./", "")
    plain = F.regexp_replace(plain, "(?<=.)/$", "")
    drive = F.when(plain.rlike("^[A-Za-z]:/"), F.concat(F.lower(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20))).otherwise(plain)
    return F.when(raw == "", F.raise_error(F.lit("a path must not be empty"))).otherwise(drive)


def relative_path(path: Column | str, root: str) -> Column:
    """The path below ``root`` (in normal form); '' for the root itself; fails outside of it."""
    normal = normalize_path(path)
    inside = F.when(normal == root, F.lit("")).when(normal.startswith(root + "/"), F.substring(normal, len(root) + 2, 1 << 20))
    return F.coalesce(inside, F.raise_error(F.concat(normal, F.lit(f" is outside {root}"))))


# The marks that a URI keeps.
URI_MARKS = "/:;,?@&=+$!~'()#"


def _encode_uri(path: Column) -> Column:
    """Form encoding, with spaces as %20 and the marks of a URI as they are."""
    coded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for mark in URI_MARKS:
        coded = F.replace(coded, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return coded


def file_uri(path: Column | str) -> Column:
    coded = _encode_uri(normalize_path(path))
    scheme = F.when(coded.rlike("(?i)^[a-z]:/"), "file:///").when(coded.startswith("//"), "file:").otherwise("file://")
    return F.concat(scheme, coded)


def module_key(path: Column | str) -> Column:
    """The second segment below a source root, else the first."""
    parts = F.split(F.regexp_replace(_column(path), "^/+", ""), "/")
    return F.when(F.get(parts, F.lit(0)).isin(*SOURCE_ROOTS) & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def is_test_file(path: Column | str) -> Column:
    slashed = F.replace(_column(path), F.lit("\\"), F.lit("/"))
    found = F.lit(False)
    for pattern in TEST_PATTERNS:
        found = found | slashed.rlike(f"(?i){pattern}")
    return F.coalesce(found, F.lit(False))


def is_skipped(path: Column | str) -> Column:
    """Whether a path goes through a left-out folder or a dot entry."""
    parts = F.split(_column(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) | F.exists(parts, lambda p: p.startswith("."))


def language_of_path(path: Column | str) -> Column:
    """The language of a file by its extension, null for others."""
    return _choose(F.regexp_extract(_column(path), r"(\.[^./]+)$", 1), EXTENSIONS)


# ---- identifiers: sym:<code>:<path>:<name>, ref:<code>:<path>:<line>


def language_of_id(symbol_id: Column | str) -> Column:
    """The language of a symbol id; fails where it has fewer than 4 parts or an unknown code."""
    column = _column(symbol_id)
    parts = F.split(column, ":")
    known = F.when((F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "sym"), _choose(F.get(parts, F.lit(1)), SHORT_CODES))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("not a symbol id: "), column)))


def symbol_id(code: Column | str, path: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", F.lit("sym"), _column(code), _column(path), _column(name))


def ref_id(code: Column | str, path: Column | str, line: Column | str) -> Column:
    return F.concat_ws(":", F.lit("ref"), _column(code), _column(path), _column(line).cast("string"))


def parse_symbol_id(symbol_id: Column | str) -> Column:
    """struct(code, path, name), null where it does not parse.

    Paths may hold colons, so the name starts after the last one; Go paths may
    not, and Go names start after the second.
    """
    column = _column(symbol_id)
    general, go = r"^sym:([^:]*):(.+):([^:]+)$", r"^sym:(go):([^:]+):(.+)$"

    def cut(pattern: str) -> Column:
        part = [F.regexp_extract(column, pattern, k) for k in (1, 2, 3)]
        return F.when(column.rlike(pattern), F.struct(part[0].alias("code"), part[1].alias("path"), part[2].alias("name")))

    return F.when(column.startswith("sym:go:"), cut(go)).otherwise(cut(general))


def exported(language: Column | str, name: Column | str) -> Column:
    """Whether a name is visible outside its module."""
    lang, own = _column(language), _column(name)
    last = F.element_at(F.split(own, r"\."), -1)
    dunder = last.rlike("^__.+__$")
    python = (own == "<module>") | dunder | ~last.startswith("_")
    return F.when(lang == "go", last.rlike("^[A-Z]")).when(lang == "python", python).otherwise(True)


# Symbol kinds of the language server protocol, by language; others are "other".
LSP_KINDS = {
    "typescript": {2: "module", 5: "class", 6: "method", 10: "enum", 11: "interface", 12: "function", 13: "variable", 14: "variable", 23: "type", 26: "type"},
    "python": {5: "class", 6: "method", 12: "function", 13: "variable", 14: "variable"},
    "go": {5: "class", 6: "method", 11: "interface", 12: "function", 13: "variable", 14: "variable", 23: "class"},
}


def symbol_kind(language: Column | str, kind: Column | str) -> Column:
    lang, number = _column(language), _column(kind)
    cases = [F.when((lang == name) & (number == k), F.lit(v)) for name, table in LSP_KINDS.items() for k, v in table.items()]
    return F.coalesce(*cases, F.lit("other"))


def diagnostic_severity(number: Column | str) -> Column:
    column = _column(number)
    return F.when(column == 1, "error").when(column == 2, "warning").otherwise("info")


def one_based(line: Column | str) -> Column:
    return _column(line) + 1
