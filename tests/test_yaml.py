from datetime import date

import pytest

from symloom.functions.parsers import frontmatter_symbols
from symloom.functions.yamltext import YamlError, parse_yaml


@pytest.mark.parametrize(("text", "value"), [
    ("", None), ("# only\n", None), ("just text", "just text"), ("---\na: 1\n", {"a": 1}),
    ("a: [x, 'y z', \"q\\n\", 1, {b: c, d}]", {"a": ["x", "y z", "q\n", 1, {"b": "c", "d": None}]}),
    ("a: [x,\n  y, # note\n  z]\nb: 1", {"a": ["x", "y", "z"], "b": 1}),
    ("a:\n- b\n- 'it''s'\nc: d", {"a": ["b", "it's"], "c": "d"}),
    ("a:\n  b:\n    - c: 1\n      d: 2\n    - e\n    -\n      - f\n    - - g\n      - h", {"a": {"b": [{"c": 1, "d": 2}, "e", ["f"], ["g", "h"]]}}),
    ("a: |\n  x\n   y\n\nb: >-\n  p\n  q\nc: |+\n  z\n\n", {"a": "x\n y\n", "b": "p q", "c": "z\n\n"}),
    ("x: just # c\ny: \"a # b\"\nz:\nw: a#b", {"x": "just", "y": "a # b", "z": None, "w": "a#b"}),
    ("k: a\n  b\n  c", {"k": "a b c"}), ("u: http://x:8/y\n'k k': v\n\"q\": \"\\u00e9\\x41\"", {"u": "http://x:8/y", "k k": "v", "q": "éA"}),
    ("d: 2024-01-02\nf: -1.5e3\ng: -3\nh: 0x1F\ni: 1_000\nn: ~\nt: true\ns: '1'\nv: 1.2.3\ny: yes\no: 010", {"d": date(2024, 1, 2), "f": -1500.0, "g": -3, "h": 31, "i": 1000, "n": None, "t": True, "s": "1", "v": "1.2.3", "y": "yes", "o": 10.0}),
    ("a: {}\nb: []\r\nc: {x: [1, {y: 2}]}", {"a": {}, "b": [], "c": {"x": [1, {"y": 2}]}}),
    ("- a\n- b: 1\n  c: 2\n- [d]\n-\n", ["a", {"b": 1, "c": 2}, ["d"], None]),
])
def test_documents(text, value):
    assert parse_yaml(text) == value


@pytest.mark.parametrize(("text", "line"), [
    ("a: 1\na: 2", 2), ("a: b: c", 1), ("x: 1\na: [1, 2", 2), ("a:\n   b: 1\n  c: 2", 3), ("a: 'x", 1), ("a: *b", 1), ("a: &b c", 1), ("\t- a", 1), ("a: 1\n  b: 2", 2), ("- a\nb: 1", 2), ("a: [1]] ", 1), ("a: {b: 1", 1), ('a: "\\q"', 1), ("a\nb: 1", 2),
])
def test_what_is_malformed_is_told_by_line(text, line):
    with pytest.raises(YamlError) as error:
        parse_yaml(text)
    assert error.value.line == line


@pytest.mark.parametrize(("front", "symbols"), [
    ("id: ADR-01\nsymbols:\n  - SymbolId\n  - Symbol\n  - LANG_CODES", ["SymbolId", "Symbol", "LANG_CODES"]), ("id: ADR-02\ntitle: Some title", []), ("symbols: []", []), ("symbols: just-a-string", []),
    ("symbols:\n  - Valid\n  - 42\n  - null\n  - 2024-01-02\n  - ''\n  - '42'", ["Valid", "42"]), ("symbols:\n  - [unclosed", []), ("status: accepted\nsymbols:\n  - Foo\nid: ADR-99", ["Foo"]),
    ("symbols: [A, \"B C\", 'D']  # three", ["A", "B C", "D"]), ("symbols:\n- A\n- B\ntitle: x: y", []), ("symbols:\n  # none yet\n  - A # first\n\n  - B", ["A", "B"]), ("- symbols", []), ("a:\n  symbols:\n    - A", []),
])
def test_frontmatter(front, symbols):
    assert frontmatter_symbols(f"---\n{front}\n---\nbody") == symbols


def test_text_without_frontmatter():
    assert [frontmatter_symbols(t) for t in ("# just a body\n", "---\nid: foo\nno end", "", " ---\nsymbols: [A]\n---\n")] == [[]] * 4
