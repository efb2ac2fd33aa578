"""The part of YAML that configuration files are written in.

Mappings and lists by indentation, ``[a, b]`` and ``{a: b}`` in one line, plain and quoted scalars, comments. What is
beyond that (anchors, tags, block scalars, several documents) is an error that names its line.
"""

from __future__ import annotations

import re
from typing import Any

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*)|$)""")
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0"}
_CONSTANTS = {
    "": None, "~": None, "null": None, "true": True, "false": False, "yes": True, "no": False, "on": True, "off": False,
}


class _Lines:
    def __init__(self, text: str) -> None:
        self.rows: list[tuple[int, int, str]] = []  # line number, indentation, content
        for number, line in enumerate(text.splitlines(), 1):
            bare = _without_comment(line).rstrip()
            if not bare.strip() or bare == "---" and not self.rows:
                continue
            indent = len(bare) - len(bare.lstrip(" "))
            if bare[indent] == "\t":
                raise ValueError(f"line {number}: tabs can't indent")
            self.rows.append((number, indent, bare.strip()))
        self.at = 0

    @property
    def row(self) -> tuple[int, int, str] | None:
        return self.rows[self.at] if self.at < len(self.rows) else None


def plain_yaml(text: str) -> Any:
    """The value that ``text`` describes; ``ValueError`` where it is not understood."""
    lines = _Lines(text)
    if lines.row is None:
        return None
    value = _block(lines, lines.row[1])
    if lines.row is not None:
        raise ValueError(f"line {lines.row[0]}: unexpected indentation")
    return value


def _without_comment(line: str) -> str:
    quote = None
    for i, c in enumerate(line):
        if quote:
            if c == quote and not (quote == '"' and line[i - 1] == "\\"):
                quote = None
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _block(lines: _Lines, indent: int) -> Any:
    number, _, content = lines.row
    if content == "-" or content.startswith("- "):
        return _list(lines, indent)
    if _KEY.fullmatch(content):
        return _mapping(lines, indent)
    lines.at += 1
    return _inline(content, number)


def _nested(lines: _Lines, indent: int, same_level_list: bool) -> Any:
    """What follows a key or a dash that has nothing behind it."""
    row = lines.row
    if row and (row[1] > indent or same_level_list and row[1] == indent and (row[2] == "-" or row[2].startswith("- "))):
        return _block(lines, row[1])
    return None


def _mapping(lines: _Lines, indent: int) -> dict:
    out: dict = {}
    while lines.row and lines.row[1] == indent:
        number, _, content = lines.row
        match = _KEY.fullmatch(content)
        if not match:
            raise ValueError(f"line {number}: expected 'key: value', found {content!r}")
        key = _scalar(match[1], number)
        if key in out:
            raise ValueError(f"line {number}: {key!r} is there twice")
        lines.at += 1
        rest = (match[2] or "").strip()
        out[key] = _inline(rest, number) if rest else _nested(lines, indent, True)
    return out


def _list(lines: _Lines, indent: int) -> list:
    out = []
    while lines.row and lines.row[1] == indent and (lines.row[2] == "-" or lines.row[2].startswith("- ")):
        number, _, content = lines.row
        rest = content[1:].strip()
        if rest and (_KEY.fullmatch(rest) or rest.startswith("- ")):
            # A mapping or list that begins behind the dash.
            inner = indent + len(content) - len(content[1:].lstrip())
            lines.rows[lines.at] = (number, inner, rest)
            out.append(_block(lines, inner))
            continue
        lines.at += 1
        out.append(_inline(rest, number) if rest else _nested(lines, indent, False))
    return out


def _inline(text: str, number: int) -> Any:
    value, rest = _flow(text, number) if text[0] in "[{" else (_scalar(text, number), "")
    if rest.strip():
        raise ValueError(f"line {number}: {rest.strip()!r} after the end of a value")
    return value


def _flow(text: str, number: int) -> tuple[Any, str]:
    """(value, what is left) of a value between brackets."""
    text = text.lstrip()
    if text[:1] not in ("[", "{"):
        match = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*?)\s*(?=[,\]}]|:\s)""", text)
        if not match:
            raise ValueError(f"line {number}: a bracket is not closed")
        return _scalar(match[1], number), text[match.end():]
    mapping, close = text[0] == "{", "}" if text[0] == "{" else "]"
    out: Any = {} if mapping else []
    rest = text[1:].lstrip()
    while not rest.startswith(close):
        value, rest = _flow(rest, number)
        rest = rest.lstrip()
        if mapping:
            if not rest.startswith(":"):
                raise ValueError(f"line {number}: expected 'key: value' between braces")
            out[value], rest = _flow(rest[1:], number)
            rest = rest.lstrip()
        else:
            out.append(value)
        if rest.startswith(","):
            rest = rest[1:].lstrip()
        elif not rest.startswith(close):
            raise ValueError(f"line {number}: a bracket is not closed")
    return out, rest[1:]


def _scalar(text: str, number: int) -> Any:
    if text[:1] == '"':
        if len(text) < 2 or text[-1] != '"':
            raise ValueError(f"line {number}: a quote is not closed")
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1])
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise ValueError(f"line {number}: a quote is not closed")
        return text[1:-1].replace("''", "'")
    if text.lower() in _CONSTANTS:
        return _CONSTANTS[text.lower()]
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?", text):
        return float(text)
    if text[0] in "&*!|>%@`":
        raise ValueError(f"line {number}: {text[0]!r} is not supported")
    return text
