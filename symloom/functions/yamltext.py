"""Reader of the YAML that configurations and frontmatter use.

Block and flow mappings and lists, plain and quoted scalars over one line, literal
and folded texts, comments.  Scalars become what the core schema makes of them.
Anchors, tags, several documents and keys that are not scalars are errors, as is
what is malformed; an error names the line.
"""

from __future__ import annotations

import json
import re
from datetime import date
from typing import Any


class YamlError(ValueError):
    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line = line


_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_INT, _FLOAT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+"), re.compile(r"[-+]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")


def scalar(text: str) -> Any:
    """What a plain scalar stands for."""
    if text in _WORDS:
        return _WORDS[text]
    if _INT.fullmatch(text):
        digits = text.replace("_", "")
        return int(digits, 0) if digits.lstrip("+-")[:2] in ("0x", "0o", "0b") else int(digits)
    if text in (".inf", "+.inf", "-.inf", ".nan"):
        return float(text.replace(".", ""))
    if any(c.isdigit() for c in text) and _FLOAT.fullmatch(text):
        return float(text.replace("_", ""))
    if found := _DATE.fullmatch(text):
        return date(*map(int, found.groups()))
    return text


class _Flow:
    """One flow value, ``[...]``, ``{...}``, quoted or plain, read from a text."""

    def __init__(self, text: str, line: int):
        self.text, self.at, self.line = text, 0, line

    def fail(self, reason: str) -> YamlError:
        return YamlError(self.line, reason)

    def skip(self) -> str:
        """The next character that is no white space or comment; '' at the end."""
        while self.at < len(self.text):
            here = self.text[self.at]
            if here == "#" and (self.at == 0 or self.text[self.at - 1].isspace()):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif here.isspace():
                self.at += 1
            else:
                return here
        return ""

    def value(self, inside: bool) -> Any:
        here = self.skip()
        if here in ("[", "{"):
            self.at += 1
            return self.items("]", list) if here == "[" else self.items("}", dict)
        if here in ('"', "'"):
            return self.quoted(here)
        if here and here in "&*!%@`":
            raise self.fail(f"{here} is not read")
        stop = re.compile(r"[,\[\]{}]|:(?=\s|$|[,\[\]{}])|\s#|\n" if inside else r"\s#|\n").search(self.text, self.at)
        end = stop.start() if stop else len(self.text)
        text, self.at = self.text[self.at : end].strip(), end
        return scalar(text)

    def quoted(self, mark: str) -> str:
        pattern = r'"(?:[^"\\]|\\.)*"' if mark == '"' else r"'(?:[^']|'')*'"
        found = re.compile(pattern, re.S).match(self.text, self.at)
        if not found:
            raise self.fail("a quotation without an end")
        self.at = found.end()
        folded = re.sub(r"[ \t]*\n[ \t]*", " ", found[0][1:-1])
        if mark == "'":
            return folded.replace("''", "'")
        try:
            return json.loads('"' + re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", folded).replace("\\0", "\\u0000").replace("\\e", "\\u001b").replace("\t", "\\t") + '"')
        except ValueError:
            raise self.fail("an escape that is not known") from None

    def items(self, end: str, kind: type) -> Any:
        out: Any = kind()
        while True:
            here = self.skip()
            if here == end:
                self.at += 1
                return out
            if here in ("", "]", "}", ","):
                raise self.fail(f"{end} is missing")
            key = self.value(True)
            if kind is dict:
                if self.skip() == ":":
                    self.at += 1
                    out[key] = self.value(True) if self.skip() not in (",", end) else None
                else:
                    out[key] = None
            else:
                out.append(key)
            if self.skip() == ",":
                self.at += 1
            elif self.skip() != end:
                raise self.fail(f"{end} is missing")

    def whole(self) -> Any:
        value = self.value(False)
        if self.skip():
            raise self.fail("text behind a value")
        return value


class _Blocks:
    """Lines (number, indent, text) of a document, taken block by block."""

    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.lines: list[tuple[int, int, str]] = []
        for n, line in enumerate(self.raw, 1):
            bare = line.strip()
            if bare and not bare.startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise YamlError(n, "a tab in the indent")
                self.lines.append((n, len(line) - len(line.lstrip()), line.rstrip().lstrip()))
        self.at = 0

    def peek(self) -> tuple[int, int, str] | None:
        return self.lines[self.at] if self.at < len(self.lines) else None

    def node(self, least: int) -> Any:
        """The value that begins in the next line, indented by ``least`` at least; None if it is not."""
        head = self.peek()
        if head is None or head[1] < least:
            return None
        if head[2] == "-" or head[2].startswith("- "):
            return self.listed(head[1])
        if _KEY.match(head[2]):
            return self.mapped(head[1])
        self.at += 1
        return self.inline(head[2], head[0], head[1] - 1)

    def listed(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[1] == indent and (head[2] == "-" or head[2].startswith("- ")):
            n, _, text = head
            rest = text[1:].lstrip()
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
                continue
            # What follows the dash is a node of its own, as far in as it stands.
            self.lines[self.at] = (n, indent + len(text) - len(rest), rest)
            if _KEY.match(rest) or rest == "-" or rest.startswith("- "):
                out.append(self.node(indent + 1))
            else:
                self.at += 1
                out.append(self.inline(rest, n, indent))
        self.ends(indent + 1)  # a key may stand as far in as the list that it follows
        return out

    def mapped(self, indent: int) -> dict:
        out: dict = {}
        while (head := self.peek()) and head[1] == indent and (found := _KEY.match(head[2])):
            n, _, text = head
            key = _Flow(found[1], n).whole()
            if key in out:
                raise YamlError(n, f"{key} is there twice")
            rest = text[found.end() :].strip()
            self.at += 1
            if rest and not rest.startswith("#"):
                out[key] = self.inline(rest, n, indent)
            else:
                below = self.peek()
                deep = indent if below and below[1] == indent and (below[2] == "-" or below[2].startswith("- ")) else indent + 1
                out[key] = self.node(deep)
        self.ends(indent)
        return out

    def ends(self, indent: int) -> None:
        """What is indented by ``indent`` or more has to be taken."""
        if (head := self.peek()) and head[1] >= indent:
            raise YamlError(head[0], "an indent or a line that fits nowhere")

    def inline(self, text: str, n: int, indent: int) -> Any:
        """A value in the rest of a line, and what of it is in the deeper lines below."""
        if found := re.match(r"([|>])([-+]?)\s*(?:#.*)?$", text):
            return self.text_block(found[1], found[2], n, indent)
        value = [text]
        while (head := self.peek()) and head[1] > indent:
            if text[0] not in "[{\"'" and (_KEY.match(head[2]) or head[2].startswith("- ")):
                raise YamlError(head[0], "an indent that fits nowhere")
            value.append(head[2])
            self.at += 1
        if text[0] in "[{\"'":
            return _Flow("\n".join(value), n).whole()
        if _KEY.search(text) and ": " in text.split(" #")[0]:
            raise YamlError(n, "a mapping inside of a value")
        return _Flow(" ".join(v.split(" #")[0].strip() for v in value), n).whole()

    def text_block(self, style: str, keep: str, n: int, indent: int) -> str:
        rows = []
        for line in self.raw[n:]:
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            rows.append(line)
        while self.at < len(self.lines) and self.lines[self.at][0] <= n + len(rows):
            self.at += 1
        first = next((len(r) - len(r.lstrip()) for r in rows if r.strip()), 0)
        body = "\n".join(r[first:] for r in rows)
        bare = body.rstrip("\n ")
        if style == ">":
            bare = re.sub(r"(?<=\S)\n(?=\S)", " ", bare).replace("\n\n", "\n")
        return bare + {"-": "", "+": body[len(body.rstrip("\n ")) :] or "\n"}.get(keep, "\n" if bare else "")


def parse_yaml(text: str) -> Any:
    """The value of a document; None for an empty one."""
    blocks = _Blocks(text.removeprefix("\ufeff").replace("\r\n", "\n"))
    if blocks.lines and blocks.lines[0][2] == "---":
        blocks.at = 1
    value = blocks.node(0)
    if rest := blocks.peek():
        raise YamlError(rest[0], "text behind the document")
    return value
