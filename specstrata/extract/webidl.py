"""Interface definitions: a recursive-descent parser and the names a text defines, extends and needs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"[^"]*")|(?P<num>-?(?:0[xX][0-9A-Fa-f]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?|Infinity\b))|(?P<id>[_-]?[A-Za-z][\w-]*)|(?P<dots>\.\.\.)|(?P<other>[^\s])', re.S)
# Fixed values of the language: generic types, and the types that are nobody's dependency.
GENERICS = frozenset(["FrozenArray", "ObservableArray", "Promise", "record", "sequence", "async_sequence"])
WELL_KNOWN = frozenset([
    "undefined", "any", "boolean", "byte", "octet", "short", "unsigned short", "long", "unsigned long", "long long", "unsigned long long",
    "float", "unrestricted float", "double", "unrestricted double", "bigint", "DOMString", "ByteString", "USVString", "object",
])
# Constructs of the first level of the language and what stands for them now.
OBSOLETE = ((r"attribute +([^\[ ]*)\[\]", "attribute FrozenArray<{}>"), (r"serializer\s*=\s*\{[^}]*\}", "[Default] object toJSON()"))
PREFIXES = ("static", "readonly", "inherit", "stringifier", "getter", "setter", "deleter", "legacycaller")


class IdlError(ValueError):
    """The text is no interface definition."""


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.at = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise IdlError(f"{want or 'more'} expected, found {got or 'the end'} at token {self.at}")
        self.at += 1
        return got

    def maybe(self, want: str) -> bool:
        if self.peek() == want:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "id":
            raise IdlError(f"a name expected, found {self.peek() or 'the end'} at token {self.at}")
        return self.take().removeprefix("_")

    def ext_attrs(self) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        if not self.maybe("["):
            return out
        while not self.maybe("]"):
            attr: dict[str, Any] = {"name": self.name(), "values": []}
            if self.maybe("="):
                if self.maybe("("):
                    while not self.maybe(")"):
                        attr["values"].append(self.take().strip('"'))
                        self.maybe(",")
                else:
                    attr["values"].append(self.take().strip('"'))
            if self.peek() == "(":
                attr["arguments"] = self.arguments()
            out.append(attr)
            self.maybe(",")
        return out

    def type(self) -> dict[str, Any]:
        ext = self.ext_attrs()
        if self.maybe("("):
            parts = [self.type()]
            while self.maybe("or"):
                parts.append(self.type())
            self.take(")")
            out: dict[str, Any] = {"union": parts}
        elif self.peek() in GENERICS and self.peek(1) == "<":
            generic = self.take()
            self.take("<")
            parts = [self.type()]
            while self.maybe(","):
                parts.append(self.type())
            self.take(">")
            out = {"generic": generic, "types": parts}
        else:
            name = self.name()
            if name in ("unsigned", "unrestricted"):
                name += " " + self.name()
            if name.endswith("long") and self.peek() == "long":
                name += " " + self.take()
            out = {"name": name}
        if self.maybe("?"):
            out["nullable"] = True
        return out | ({"extAttrs": ext} if ext else {})

    def value(self) -> Any:
        if self.maybe("["):
            self.take("]")
            return []
        if self.maybe("{"):
            self.take("}")
            return {}
        return self.take().strip('"')

    def arguments(self) -> list[dict[str, Any]]:
        self.take("(")
        out = []
        while not self.maybe(")"):
            ext = self.ext_attrs()
            optional = self.maybe("optional")
            kind = self.type()
            variadic = self.maybe("...")
            arg = {"name": self.name(), "type": kind, "optional": optional, "variadic": variadic} | ({"extAttrs": ext} if ext else {})
            if self.maybe("="):
                arg["default"] = self.value()
            out.append(arg)
            if self.peek() != ")":
                self.take(",")
        return out

    def member(self, ext: list) -> dict[str, Any]:
        out: dict[str, Any] = {"extAttrs": ext}
        if self.maybe("constructor"):
            out |= {"type": "constructor", "arguments": self.arguments()}
        elif self.maybe("const"):
            out |= {"type": "const", "idlType": self.type(), "name": self.name()}
            self.take("=")
            out["value"] = self.value()
        else:
            special = None
            while self.peek() in PREFIXES and self.peek(1) not in ("(", ""):
                word = self.take()
                out["readonly"] = out.get("readonly", False) or word == "readonly"
                if word != "readonly":
                    special = word
                if word == "stringifier" and self.peek() == ";":
                    self.take()
                    return out | {"type": "operation", "special": "stringifier", "name": "", "arguments": [], "idlType": None}
            is_async = self.maybe("async")
            if is_async or self.peek() in ("iterable", "async_iterable", "maplike", "setlike") and self.peek(1) == "<":
                kind = self.take()
                self.take("<")
                types = [self.type()]
                while self.maybe(","):
                    types.append(self.type())
                self.take(">")
                if self.peek() == "(":
                    out["arguments"] = self.arguments()
                out |= {"type": "async_iterable" if is_async else kind, "types": types}
            elif self.maybe("attribute"):
                out |= {"type": "attribute", "idlType": self.type(), "name": self.name(), "special": special}
            else:
                out |= {"type": "operation", "idlType": self.type(), "special": special}
                out["name"] = self.name() if self.peek() != "(" else ""
                out["arguments"] = self.arguments()
        self.take(";")
        return out

    def body(self, kind: str) -> list[dict[str, Any]]:
        self.take("{")
        out = []
        while not self.maybe("}"):
            ext = self.ext_attrs()
            if kind == "dictionary":
                required = self.maybe("required")
                m = {"type": "field", "extAttrs": ext, "required": required, "idlType": self.type(), "name": self.name()}
                if self.maybe("="):
                    m["default"] = self.value()
                self.take(";")
                out.append(m)
            else:
                out.append(self.member(ext))
        return out

    def definition(self) -> dict[str, Any]:
        ext = self.ext_attrs()
        out: dict[str, Any] = {"extAttrs": ext, "partial": self.maybe("partial")}
        word = self.take()
        if word == "callback":
            if self.maybe("interface"):
                out |= {"type": "callback interface", "name": self.name(), "members": self.body("interface")}
            else:
                out |= {"type": "callback", "name": self.name()}
                self.take("=")
                out |= {"idlType": self.type(), "arguments": self.arguments()}
        elif word in ("interface", "dictionary", "namespace"):
            kind = "interface mixin" if word == "interface" and self.maybe("mixin") else word
            out |= {"type": kind, "name": self.name(), "inheritance": self.name() if self.maybe(":") else None, "members": self.body(word)}
        elif word == "enum":
            out |= {"type": "enum", "name": self.name(), "values": []}
            self.take("{")
            while not self.maybe("}"):
                out["values"].append(self.take().strip('"'))
                self.maybe(",")
        elif word == "typedef":
            out |= {"type": "typedef", "idlType": self.type(), "name": self.name()}
        else:
            self.at -= 1
            out |= {"type": "includes", "target": self.name()}
            if self.take() not in ("includes", "implements"):
                raise IdlError(f"no definition at token {self.at}")
            out["includes"] = self.name()
        self.take(";")
        return out


def parse_idl(text: str) -> list[dict[str, Any]]:
    """The definitions of a text; IdlError if it has an error."""
    p = _Parser(text)
    out = []
    while p.at < len(p.tokens):
        out.append(p.definition())
    return out


def modern_idl(text: str) -> str:
    """First-level constructs rewritten."""
    for pattern, now in OBSOLETE:
        text = re.sub(pattern, now.format(r"\1"), text)
    return text


def type_names(kind: dict[str, Any] | None) -> list[str]:
    """The names a type refers to, well-known ones left out."""
    if kind is None:
        return []
    parts = kind.get("union") or kind.get("types")
    if parts:
        return [n for p in parts for n in type_names(p)]
    return [] if kind["name"] in WELL_KNOWN else [kind["name"]]


@dataclass
class Report:
    """What a text defines: definitions and extensions by name, globals, exposure, constructors and functions by global, dependencies."""

    idl_names: dict[str, dict] = field(default_factory=dict)
    extended: dict[str, list[dict]] = field(default_factory=dict)
    globals: dict[str, list[str]] = field(default_factory=dict)
    exposed: dict[str, list[str]] = field(default_factory=dict)
    constructors: dict[str, list[str]] = field(default_factory=dict)
    functions: dict[str, list[str]] = field(default_factory=dict)
    dependencies: dict[str, list[str]] = field(default_factory=dict)
    external: list[str] = field(default_factory=list)
    has_obsolete: bool = False


def _put(into: dict[str, list[str]], key: str, value: str) -> None:
    own = into.setdefault(key, [])
    if value not in own:
        own.append(value)


def idl_report(text: str) -> Report:
    """The names of a text; IdlError if it has an error."""
    modern = modern_idl(text)
    report = Report(has_obsolete=modern != text)
    needed: list[str] = []

    def need(owner: str, names: list[str], external: bool = True) -> None:
        for n in names:
            _put(report.dependencies, owner, n)
            if external and n not in needed:
                needed.append(n)

    for d in parse_idl(modern):
        if d["type"] == "includes":
            need(d["target"], [d["includes"]], external=False)
            report.extended.setdefault(d["target"], []).append(d)
            continue
        name = d["name"]
        report.dependencies.setdefault(name, [])
        if d["partial"]:
            report.extended.setdefault(name, []).append(d)
            if name not in needed:
                needed.append(name)
        else:
            report.idl_names[name] = d
        if d.get("inheritance"):
            need(name, [d["inheritance"]])
        need(name, type_names(d.get("idlType")))
        for a in d.get("arguments", ()):
            need(name, type_names(a["type"]))
        attrs = {e["name"]: e for e in d["extAttrs"]}
        if "Global" in attrs:
            for g in attrs["Global"]["values"] or [name]:
                _put(report.globals, g, name)
        places = attrs["Exposed"]["values"] if "Exposed" in attrs else []
        for g in places:
            _put(report.exposed, g, name)
            if d["type"] == "interface" and "LegacyNoInterfaceObject" not in attrs and "NoInterfaceObject" not in attrs:
                makes = "Constructor" in attrs or any(m["type"] == "constructor" for m in d["members"])
                _put(report.constructors if makes else report.functions, g, name)
        for e in d["extAttrs"]:
            if e["name"] in ("NamedConstructor", "LegacyFactoryFunction"):
                for g in places:
                    _put(report.constructors, g, e["values"][0])
            for a in e.get("arguments", ()):
                need(name, type_names(a["type"]))
        for m in d.get("members", ()):
            if m["type"] == "const":
                continue
            need(name, type_names(m.get("idlType")))
            for t in m.get("types", ()):
                need(name, type_names(t))
            for a in m.get("arguments", ()):
                need(name, type_names(a["type"]))
    report.external = [n for n in needed if n not in report.idl_names]
    return report


def member_names(member: dict[str, Any], overload: int) -> list[str]:
    """Texts under which a document may define a member, likeliest first."""
    if member["type"] in ("operation", "constructor"):
        if member.get("special") in ("getter", "setter", "stringifier", "deleter"):
            return []
        name = "constructor" if member["type"] == "constructor" else member["name"]
        args = [a["name"] for a in member["arguments"]]
        dots = ["..." + a["name"] if a["variadic"] else a["name"] for a in member["arguments"]]
        return list(dict.fromkeys([f"{name}!overload-{overload}({', '.join(args)})", f"{name}({', '.join(dots)})", f"{name}({', '.join(args)})", f"{name}()"]))
    return [member["name"]] if "name" in member else []
