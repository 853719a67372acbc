"""Parsers of declarations and docstrings in source text.

Brackets have to be balanced, which regular expressions cannot do, so these run
as Arrow-batched pandas UDFs over (text, line) columns; what a pattern can
express stays a built-in expression.  Lines count from 0 unless stated.
"""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from symloom.functions.text import _column
from symloom.functions.yamltext import YamlError, parse_yaml

HEADER_LINES, CLASS_LINES, CALLABLE_LINES = 6, 20, 10
SIGNATURE_KINDS = ("class", "interface", "function", "method")

_NAME = r"[A-Za-z_$][\w$]*"
_DOTTED = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")
_TOKEN = re.compile(r"[\w$]+|[^\w$\s]")
# The words that begin a TypeScript declaration.
DECLARING = frozenset("const let var type function class interface enum namespace module declare async abstract".split())
# Names whose subscript is a Python type.
TYPE_FORMS = frozenset("Union Optional List Dict Tuple Callable Literal".split())


def _tokens(text: str) -> list[str]:
    """Words and single marks, without white space."""
    return _TOKEN.findall(text)


def _lines(text: str) -> list[str]:
    return re.split(r"\r?\n", text)


def _depths(text: str, opening: str, closing: str, start: int = 0) -> Iterator[tuple[int, str, int]]:
    """(position, character, depth before it); closing without opening leaves the depth at 0."""
    depth = start
    for at, ch in enumerate(text):
        yield at, ch, depth
        if ch in opening:
            depth += 1
        elif ch in closing and depth:
            depth -= 1


# ---- TypeScript


def strip_generics(text: str) -> str:
    """The text without balanced ``<...>``; a lone ``>`` stays."""
    return "".join(ch for _, ch, depth in _depths(text, "<", ">") if not (depth or ch == "<"))


def declaration_header(text: str, line: int, most: int = HEADER_LINES) -> str:
    """What stands before the ``{`` or ``;`` outside of generics, over some lines."""
    joined = " ".join(_lines(text)[line : line + most])
    for at, ch, depth in _depths(joined, "<", ">"):
        if not depth and ch in "{;":
            return joined[:at].strip()
    return joined.strip()


def _declares(line: str) -> bool:
    """Whether a line begins, without indentation, a declaration that goes on."""
    words = [] if line[:1].isspace() else line.split()
    if words[:1] == ["export"]:
        words = words[1:]
    return len(words) > 1 and words[0] in DECLARING


def alias_header(text: str, line: int, most: int = HEADER_LINES) -> str:
    """A type alias up to its ``;`` or the next top-level declaration."""
    own = _lines(text)[line : line + most]
    last = next((k for k, one in enumerate(own) if k and _declares(one)), len(own))
    return " ".join(own[:last]).partition(";")[0].strip()


def clean_signature(header: str) -> str | None:
    """One line without ``export``; None where it is empty or cut short."""
    words = header.split()
    if words[:1] == ["export"] and len(words) > 1:
        del words[0]
    if not words or words[-1] in ("extends", "implements") or words[-1][-1] in "=,":
        return None
    return " ".join(words)


def ts_signature(kind: str, text: str, line: int) -> tuple[str | None, str]:
    """Signature and kind of a symbol; variables that declare a type are types."""
    if kind in SIGNATURE_KINDS:
        return clean_signature(declaration_header(text, line)), kind
    if kind == "variable":
        lines = _lines(text)
        tokens = _tokens(lines[line]) if line < len(lines) else []
        start = 1 if tokens[:1] == ["export"] else 0
        if tokens[start : start + 1] == ["type"] and _is_name(*tokens[start + 1 : start + 2]):
            return clean_signature(alias_header(text, line)), "type"
    return None, kind


def _is_name(token: str = "") -> bool:
    return re.fullmatch(_NAME, token) is not None


def _last_of_dotted(tokens: list[str]) -> str | None:
    """The last name of ``a.b.c``; None of anything else."""
    names, dots = tokens[::2], tokens[1::2]
    return names[-1] if len(names) == len(dots) + 1 and all(map(_is_name, names)) and set(dots) <= {"."} else None


def ts_heritage(declaration: str) -> tuple[list[str], list[str]]:
    """Names after ``extends`` and ``implements``, without generics and qualifiers."""
    tokens = _tokens(strip_generics(declaration or ""))
    clauses: dict[str, list[str]] = {"extends": [], "implements": []}
    if "class" in tokens or "interface" in tokens:
        clause, part = None, []
        for token in [*tokens, "{"]:
            if token not in clauses and token not in ("{", ","):
                part.append(token)
                continue
            name = _last_of_dotted(part)
            if clause and name:
                clauses[clause].append(name)
            part = []
            if token == "{":
                break
            clause = token if token in clauses else clause
    return clauses["extends"], clauses["implements"]


def ts_docstring(hover: Column | str) -> Column:
    """The description below a hover's code fence, with ``*@tag*`` as ``@tag``; null if blank."""
    bare = F.regexp_replace(F.trim(_column(hover)), r"\A```typescript\n(?s:.*?)\n```\s*", "")
    return F.nullif(F.btrim(F.regexp_replace(bare, r"(?m)^\*@(\w+)\*", "@$1"), F.lit(" \t\r\n")), F.lit(""))


def go_docstring(hover: Column | str) -> Column:
    """The second section of a hover whose sections are parted by ``---``; null if blank."""
    return F.nullif(F.btrim(F.get(F.split(_column(hover), r"\n---\n"), F.lit(1)), F.lit(" \t\r\n")), F.lit(""))


# ---- Python


def class_header(text: str, line: int, most: int = CLASS_LINES) -> str:
    """``class Name(bases)`` in one line, '' where no class starts."""
    lines = _lines(text)[line : line + most]
    at = lines[0].find("class ") if lines else -1
    if at < 0:
        return ""
    first = lines[0][at:]
    if "(" not in first:
        return first.partition(":")[0].strip()
    joined = "\n".join([first, *lines[1:]])
    for k, ch, depth in _depths(joined, "(", ")"):
        if ch == ")" and depth == 1:
            joined = joined[: k + 1]
            break
    return re.sub(r"\s+", " ", joined).strip()


def split_top(text: str, opening: str = "[(", closing: str = "])") -> list[str]:
    """Parts between the commas outside of brackets."""
    cuts = [at for at, ch, depth in _depths(text, opening, closing) if ch == "," and not depth]
    return [text[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]


def class_bases(header: str) -> tuple[list[str], str | None]:
    """Dotted base names (no keywords, subscripts or unpacking) and the short signature."""
    found = re.match(r"class\s+([A-Za-z_]\w*)", header.strip())
    if not found:
        return [], None
    inner = re.search(r"\((.*)\)", header, re.S)
    bases = [re.sub(r"\[.*?\]\s*$", "", p.strip()).strip() for p in split_top(inner[1])] if inner else []
    bases = [b for b in bases if _DOTTED.fullmatch(b)]
    return bases, f"class {found[1]}({', '.join(bases)})" if bases else f"class {found[1]}"


# The modules that define Protocol.
PROTOCOL_MODULES = ("typing", "typing_extensions")


def _statements(tree: ast.AST) -> Iterator[ast.AST]:
    """All statements below a node in the order of ``ast.walk``, without their expressions."""
    level = [tree]
    while level:
        level = [node for above in level for field in ("body", "handlers", "orelse", "finalbody", "cases") for node in getattr(above, field, ())]
        yield from level


def _imports(text: str) -> list[ast.Import | ast.ImportFrom]:
    """The import statements of a file; of one that does not parse, those of single lines."""

    def of(code: str) -> list[ast.Import | ast.ImportFrom] | None:
        try:
            return [node for node in _statements(ast.parse(code)) if isinstance(node, ast.Import | ast.ImportFrom)]
        except (SyntaxError, ValueError):
            return None

    whole = of(text)
    if whole is not None:
        return whole
    return [node for line in map(str.strip, _lines(text)) if line.startswith(("import ", "from ")) for node in of(line) or ()]


def import_aliases(text: str) -> dict[str, str]:
    """Local names of imports that are renamed, and every local name of Protocol, with the original."""
    known = {"Protocol": "Protocol", **{f"{m}.Protocol": "Protocol" for m in PROTOCOL_MODULES}}
    for node in _imports(text):
        for name in node.names:
            if name.asname and isinstance(node, ast.ImportFrom):
                known[name.asname] = name.name
            elif name.asname and name.name in PROTOCOL_MODULES:
                known[f"{name.asname}.Protocol"] = "Protocol"
    return known


def is_protocol(base: str, aliases: dict[str, str]) -> bool:
    return aliases.get(base) == "Protocol"


def python_classes(text: str) -> list[tuple[str, list[str], str, bool]]:
    """(name, bases, signature, is_protocol) of the classes of a file, the first of equal names."""
    aliases, out = import_aliases(text), {}
    for k, line in enumerate(_lines(text)):
        if "class " in line:
            header = class_header(text, k)
            bases, signature = class_bases(header)
            if signature:
                name = re.match(r"class\s+(\w+)", header)[1]
                out.setdefault(name, (name, bases, signature, any(is_protocol(b, aliases) for b in bases)))
    return list(out.values())


def _assignment(line: str, name: str) -> tuple[str, str]:
    """How a line assigns to ``name`` and the right side.

    The forms are ``type`` (a type statement), ``TypeAlias`` (so annotated),
    ``plain`` and ``annotated``; '' where it does not assign to the name.
    """
    head, equals, right = line.partition("=")
    left = _tokens(head)
    if not equals:
        return "", ""
    if left[:2] == ["type", name]:
        return "type", right.strip()
    if left[:1] != [name]:
        return "", ""
    if left[1:] in ([":", "TypeAlias"], [":", "typing", ".", "TypeAlias"]):
        return "TypeAlias", right.strip()
    form = "plain" if len(left) == 1 else "annotated" if left[1] == ":" and len(left) > 2 else ""
    return form, right.strip()


def _looks_like_type(right: str) -> bool:
    """A dotted name, alone or with one subscript to the end, or the subscript of a type form that may go on."""
    if not TYPE_FORMS.isdisjoint(_tokens(right)[:1]):
        return True
    name, bracket, rest = right.partition("[")
    dotted = name[:1].isascii() and (name[:1].isalpha() or name[:1] == "_") and all(c.isalnum() or c in "_." for c in name)
    return dotted and (not bracket or rest.endswith("]"))


def is_alias_line(line: str, name: str) -> bool:
    """Whether a line makes ``name`` a type: ``type``, ``TypeAlias``, or a plain type on the right."""
    tokens = _tokens(line)
    if tokens[:2] == ["type", name] and tokens[2:3] in (["="], ["["], [":"]):
        return True
    form, right = _assignment(line, name)
    return form == "TypeAlias" or (form == "plain" and _looks_like_type(right))


def is_module_assignment(line: str, name: str) -> bool:
    return not line[:1].isspace() and _assignment(line, name)[0] in ("plain", "annotated", "TypeAlias")


def alias_signature(line: str, name: str) -> str | None:
    form, right = _assignment(line, name)
    generic = form == "type" and "[" in line.partition("=")[0]
    return " ".join(line.split()) if right and form in ("type", "TypeAlias", "plain") and not generic else None


def callable_signature(text: str, line: int, most: int = CALLABLE_LINES) -> str | None:
    """``def name(...) -> type`` in one line, up to the colon outside of parentheses."""
    lines = _lines(text)[line : line + most]
    start = re.search(r"\b(?:async\s+def|def)\s+", lines[0]) if lines else None
    if not start:
        return None
    joined = "\n".join([lines[0][start.start() :], *lines[1:]])
    for at, ch, depth in _depths(joined, "(", ")"):
        if ch == ":" and not depth:
            joined = joined[:at]
            break
    return re.sub(r"\s+", " ", joined).strip() or None


_BLANK = re.compile(r"\s*(#|$)")
_QUOTED = re.compile(r"\s*[rRuUbBfF]{0,2}(\"\"\"|''')")


def _quoted(lines: list[str], at: int) -> str | None:
    """The triple-quoted text that starts in a line, dedented; None without one or when blank."""
    start = _QUOTED.match(lines[at]) if at < len(lines) else None
    if not start:
        return None
    body = "\n".join([lines[at][start.end() :], *lines[at + 1 :]])
    end = body.find(start[1])
    return inspect.cleandoc(body[:end]).strip() or None if end >= 0 else None


def _skip_blank(lines: list[str], at: int) -> int:
    while at < len(lines) and _BLANK.match(lines[at]):
        at += 1
    return at


def module_docstring(text: str) -> str | None:
    """The docstring of a file, after comments and ``__future__`` imports."""
    lines = _lines(text)
    at = _skip_blank(lines, 0)
    while at < len(lines) and re.match(r"\s*from\s+__future__\s+import\b", lines[at]):
        open_ = 0
        while at < len(lines):
            open_ += lines[at].count("(") - lines[at].count(")")
            at += 1
            if open_ <= 0:
                break
        at = _skip_blank(lines, at)
    return _quoted(lines, at)


def body_docstring(text: str, line: int) -> str | None:
    """The docstring of the class or function declared in ``line`` (from 1)."""
    lines = _lines(text)
    if not 1 <= line <= len(lines):
        return None
    depth = 0
    for at in range(line - 1, len(lines)):
        code = re.sub(r"#.*$", "", lines[at])
        for k, ch, inner in _depths(code, "([{", ")]}", depth):
            if ch == ":" and not inner:
                rest = code[k + 1 :].strip()
                return _quoted([lines[at][k + 1 :], *lines[at + 1 :]], 0) if rest else _quoted(lines, _skip_blank(lines, at + 1))
        depth = max(0, depth + sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}"))
    return None


# ---- columns

_HERITAGE = StructType([StructField("extends", ArrayType(StringType())), StructField("implements", ArrayType(StringType()))])
_SIGNATURE = StructType([StructField("signature", StringType()), StructField("kind", StringType())])
_CLASS = ArrayType(StructType([StructField("name", StringType()), StructField("bases", ArrayType(StringType())), StructField("signature", StringType())]))


@F.pandas_udf(_SIGNATURE)
def ts_signature_of(kind: pd.Series, text: pd.Series, line: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ts_signature(k, t or "", int(n)) for k, t, n in zip(kind, text, line, strict=True)], columns=["signature", "kind"])


@F.pandas_udf(_HERITAGE)
def ts_heritage_of(declaration: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ts_heritage(d) for d in declaration], columns=["extends", "implements"])


@F.pandas_udf(StringType())
def callable_signature_of(text: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([callable_signature(t or "", int(n)) for t, n in zip(text, line, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def module_docstring_of(text: pd.Series) -> pd.Series:
    return pd.Series([module_docstring(t or "") for t in text], dtype=object)


@F.pandas_udf(StringType())
def body_docstring_of(text: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([body_docstring(t or "", int(n)) for t, n in zip(text, line, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def frontmatter_symbols_of(text: pd.Series) -> pd.Series:
    return pd.Series([frontmatter_symbols(t or "") for t in text], dtype=object)


def frontmatter_symbols(text: str) -> list[str]:
    """The strings of the frontmatter's list ``symbols``; [] without one, and where the frontmatter is malformed."""
    end = text.find("\n---\n", 4) if text.startswith("---\n") else -1
    if end < 0:
        return []
    try:
        found = parse_yaml(text[4:end])
    except YamlError:
        return []
    names = found.get("symbols") if isinstance(found, dict) else None
    return [n for n in names if isinstance(n, str) and n] if isinstance(names, list) else []


def class_table(files: DataFrame) -> DataFrame:
    """(path, name, signature, base, is_protocol): a row for each class and base of Python files (path, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n, s, b, proto) for p, t in zip(frame.path, frame.text, strict=True) for n, bases, s, proto in python_classes(t or "") for b in bases or [None]]
            yield pd.DataFrame(rows, columns=["path", "name", "signature", "base", "is_protocol"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, signature string, base string, is_protocol boolean")


# ---- symbol trees: (path, ord, name, kind, line, children array<struct<name, kind, detail, line>>)

# Protocol kinds of containers whose children become symbols.
CONTAINERS = {"typescript": (2, 5, 11), "python": (5,), "go": (11,)}


def flatten_symbols(tree: DataFrame, language: str) -> DataFrame:
    """Top-level symbols and one level of children; Go interface methods are named ``Interface.Method``."""
    container = F.col("kind").isin(*CONTAINERS[language])
    kids = tree.where(container).select("path", "ord", F.col("name").alias("parent"), F.posexplode("children").alias("child_ord", "c"))
    name = F.concat("parent", F.lit("."), F.col("c.name")) if language == "go" else F.col("c.name")
    kids = kids.select("path", "ord", F.col("child_ord").cast("int").alias("child_ord"), "parent", name.alias("name"), F.col("c.kind").alias("kind"), F.col("c.line").alias("line"))
    top = tree.select("path", "ord", F.lit(-1).alias("child_ord"), F.lit(None).cast("string").alias("parent"), "name", "kind", "line")
    return top.unionByName(kids)


def module_symbols(files: DataFrame) -> DataFrame:
    """The synthetic symbol ``<module>`` in line 1 of every Python file with text."""
    return files.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("path", F.lit("<module>").alias("name"), F.lit("module").alias("kind"), F.lit(1).alias("line"))


def go_embedded(tree: DataFrame) -> DataFrame:
    """(path, name, extends): embedded fields, which are children of kind 8 whose detail is their name."""
    own = F.transform(F.filter("children", lambda c: (c["kind"] == 8) & (c["detail"] == c["name"])), lambda c: c["name"])
    return tree.select("path", "name", own.alias("extends"))


def find_in_tree(flat: DataFrame, name: str) -> DataFrame:
    """The first symbol of a name in each file, in document order."""
    return flat.where(F.col("name") == name).groupBy("path").agg(F.min_by(F.struct("name", "kind", "line"), F.struct("ord", "child_ord")).alias("s")).select("path", "s.*")
