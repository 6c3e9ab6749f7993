"""Value definition grammar of style properties, to a tree of plain objects."""

from __future__ import annotations

import re
from typing import Any

_TOKEN = re.compile(r"\s*(?:(<(?:[^<>\[]|\[[^\]]*\])*>)|('[^']*')|(\|\||&&|\||\[|\]|\(|\)|,|/|[*+?!]|#|\{[^}]*\})|([-_a-zA-Z][-\w]*)(\()?)")
# The types of the language's own data.
PRIMITIVES = frozenset(
    "ident ident-token declaration-value number-token hash-token any-value string-token function-token dimension-token zero custom-ident string url integer number percentage number-percentage length-percentage frequency-percentage "
    "angle-percentage time-percentage dimension length angle time frequency resolution color image position".split()
)
_MULTIPLIER = re.compile(r"[*+?!#]|\{.*\}")


class GrammarError(ValueError):
    """The text is no value definition."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token: type, quoted, mark, function (a name before a parenthesis) or word."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GrammarError(f"unknown token in {text!r} at {at}")
        at = m.end()
        kind, value = next((k, g) for k, g in zip(("type", "quoted", "mark", "word"), m.groups()) if g is not None)
        out.append(("function" if m[5] else kind, value))
    return out


def _terminal(name: str) -> dict[str, Any]:
    """A terminal in angle brackets: a primitive with an optional range, a quoted property, or the name of another value."""
    inner = name[1:-1].strip()
    quoted = re.fullmatch("'([-_a-zA-Z][^'>]*)'", inner)
    if quoted:
        return {"type": "propertyref", "name": quoted[1]}
    m = re.fullmatch(r"([\w-]+)\s*(?:\[([^,\]]*),([^,\]]*)\])?", inner)
    if m and m[1] in PRIMITIVES:
        return {"type": "primitive", "name": m[1]} | ({"range": [m[2].strip(), m[3].strip()]} if m[2] is not None else {})
    return {"type": "valuespace", "name": inner}


def _multiply(item: dict[str, Any], mark: str, group: bool) -> dict[str, Any]:
    if mark == "?":
        return {"type": "array", "items": item, "maxItems": 1} if group else item | {"optional": True}
    if mark == "!":
        if not group:
            raise GrammarError("! after something that is no group")
        return {"type": "array", "items": item, "minItems": 1}
    out: dict[str, Any] = {"type": "array", "items": item}
    if mark == "+":
        out["minItems"] = 1
    elif mark == "#":
        out["separator"] = ","
    elif mark != "*":
        counts = re.fullmatch(r"\{\s*(\d+)\s*(,)?\s*(\d+)?\s*\}", mark)
        if not counts:
            raise GrammarError(f"unknown range {mark}")
        out["minItems"] = int(counts[1])
        if counts[3] or not counts[2]:
            out["maxItems"] = int(counts[3] or counts[1])
    return out


#: Combinators, loosest first, with the key of the node they make; juxtaposition binds tightest.
COMBINATORS = (("&&", "allOf"), ("||", "anyOf"), ("|", "oneOf"))
_MARKS = tuple(mark for mark, _ in COMBINATORS)


def parse_value(text: str) -> dict[str, Any]:
    """The tree of a value definition; GrammarError if it is none."""
    stream = tokens(text)
    at = 0

    def combined(level: int, ends: tuple[str, ...]) -> dict[str, Any]:
        nonlocal at
        if level == len(COMBINATORS):
            items = []
            while at < len(stream) and not (stream[at][0] == "mark" and stream[at][1] in (*ends, *_MARKS)):
                items.append(single())
            if not items:
                raise GrammarError(f"nothing to combine in {text!r}")
            return items[0] if len(items) == 1 else {"type": "array", "items": items}
        mark, key = COMBINATORS[level]
        parts = [combined(level + 1, ends)]
        while at < len(stream) and stream[at] == ("mark", mark):
            at += 1
            parts.append(combined(level + 1, ends))
        return parts[0] if len(parts) == 1 else {key: parts}

    def closing(end: str) -> None:
        nonlocal at
        if at >= len(stream) or stream[at] != ("mark", end):
            raise GrammarError(f"{end} is missing in {text!r}")
        at += 1

    def single() -> dict[str, Any]:
        nonlocal at
        kind, value = stream[at]
        at += 1
        group = False
        if kind == "type":
            out = _terminal(value)
        elif kind == "function":
            empty = at < len(stream) and stream[at] == ("mark", ")")
            inner = {} if empty else combined(0, (")",))
            closing(")")
            out = {"type": "function", "name": value, "arguments": [] if empty else inner["items"] if set(inner) == {"type", "items"} and isinstance(inner["items"], list) else [inner]}
        elif kind == "mark" and value == "[":
            out, group = combined(0, ("]",)), True
            closing("]")
        elif kind == "mark" and value not in (",", "/", "(", ")"):
            raise GrammarError(f"unexpected {value} in {text!r}")
        elif kind == "word":
            out = {"type": "keyword", "name": value}
        else:
            out = {"type": "string", "content": value.strip("'") if kind == "quoted" else value}
        while at < len(stream) and stream[at][0] == "mark" and _MULTIPLIER.fullmatch(stream[at][1]):
            mark = stream[at][1]
            at += 1
            if mark == "#" and at < len(stream) and stream[at][0] == "mark" and stream[at][1].startswith("{"):  # a list of so many items
                out = {"separator": ","} | _multiply(out, stream[at][1], group)
                at += 1
            else:
                out = _multiply(out, mark, group)
            group = False
        return out

    if not stream:
        raise GrammarError("empty value definition")
    tree = combined(0, ())
    if at < len(stream):
        raise GrammarError(f"unexpected {stream[at][1]} in {text!r}")
    return tree
