"""Strict JSON reading and writing for Python workers, at any depth of nesting."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


def _number(digits: str) -> int | float:
    return int(digits) if len(digits) < 4000 else float(digits)  # Python reads no longer integers


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=_number)
UNREADABLE = object()
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _read_deep(text: str) -> Any:
    """The value of a JSON text by an explicit stack; ValueError if it is none."""
    top: list[Any] = []
    stack: list[tuple[Any, str | None]] = []  # open containers, each with the key its next value takes
    into: Any = top
    key: str | None = None
    skip = lambda i: _BLANK.match(text, i).end()
    at = skip(0)

    def read_key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"a name expected at {at}")
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"a colon expected at {at}")
        return name, skip(at + 1)

    while True:
        mark, opened = text[at : at + 1], None
        if mark == "{" or mark == "[":
            opened = {} if mark == "{" else []
            value, at = opened, skip(at + 1)
        elif mark == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (float(m[0]) if m[2] or m[3] else _number(m[0])), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"a value expected at {at}")
            value, at = _WORDS[word], at + len(word)
        if isinstance(into, dict):
            into[key] = value
        else:
            into.append(value)
        if opened is not None and text[at : at + 1] != ("}" if mark == "{" else "]"):
            stack.append((into, key))
            into, key = opened, None
            if mark == "{":
                key, at = read_key(at)
            continue
        if opened is not None:
            at += 1
        while True:  # after a value: a comma, or the ends of containers
            at = skip(at)
            if into is top:
                if at < len(text):
                    raise ValueError(f"more text at {at}")
                return top[0]
            end = text[at : at + 1]
            if end == ",":
                at = skip(at + 1)
                if isinstance(into, dict):
                    key, at = read_key(at)
                break
            if end != ("}" if isinstance(into, dict) else "]"):
                raise ValueError(f"an end expected at {at}")
            at += 1
            into, key = stack.pop()


def read_json(text: str | None) -> Any:
    """The value of a JSON text, or UNREADABLE for null and for what is not valid JSON."""
    if text is None:
        return UNREADABLE
    try:
        return _decoder.decode(text)
    except RecursionError:
        try:
            return _read_deep(text)
        except ValueError:
            return UNREADABLE
    except ValueError:
        return UNREADABLE


def write_json(value: Any, ensure_ascii: bool = True, sort_keys: bool = False, comma: str = ", ", colon: str = ": ") -> str:
    """The JSON text of a value, as ``json.dumps`` writes it."""
    try:
        return json.dumps(value, ensure_ascii=ensure_ascii, sort_keys=sort_keys, separators=(comma, colon))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[Any] = [(value,)]  # texts, and values in tuples
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (x,) = x
        if isinstance(x, dict):
            parts: list[Any] = ["{"]
            for k in sorted(x) if sort_keys else x:
                parts += [("" if len(parts) == 1 else comma) + json.dumps(k, ensure_ascii=ensure_ascii) + colon, (x[k],)]
            todo += reversed([*parts, "}"])
        elif isinstance(x, list):
            parts = ["["]
            for y in x:
                parts += ["" if len(parts) == 1 else comma, (y,)]
            todo += reversed([*parts, "]"])
        else:
            out.append(json.dumps(x, ensure_ascii=ensure_ascii))
    return "".join(out)


def clean(text: str) -> str:
    """``text`` with lone surrogates, which no UTF-8 can hold, replaced by U+FFFD."""
    if text.isascii():
        return text
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def held_json(text: str) -> Any:
    """The object or array that a string holds as JSON, or UNREADABLE."""
    start = text.lstrip(" \t\r\n")[:1]
    if start in ("{", "["):
        value = read_json(text)
        if isinstance(value, (dict, list)):
            return value
    return UNREADABLE
