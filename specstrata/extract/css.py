"""Style-language facts of a document: properties, at-rules with descriptors, selectors, values, and what does not add up."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from specstrata.extract.dom import Node, squash
from specstrata.extract.modules import HEADINGS, Page

Definition = dict[str, Any]
# Where one production rule ends and the next begins, what makes a text one, comments, and calls with arguments.
_SPLIT = re.compile(r"\s(?=(?:[^\]\s]+?|<.*?\[\s*<.*?>\s*\]>)\s*?=[^'])", re.S)
_RULE = re.compile(r"\s?=\s")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_CALL = re.compile(r"^([:a-zA-Z_][:a-zA-Z0-9_\-]+)\([^)]*\)$")
_PARAMETER = re.compile(r"\[[^\]]+\]")
# Types of definitions that the language has syntax for.
_TYPED = ("at-rule", "selector", "value", "function", "type")
_KINDS = ("dfn", *HEADINGS[1:])


def _key(label: str) -> str:
    """The key of a row's label; a new value counts among new values."""
    words = [w for w in re.split(r"[\s-]+", squash(label).rstrip(":")) if w]
    key = words[0].lower() + "".join(w[:1].upper() + w[1:] for w in words[1:]) if words else ""
    return "newValues" if key == "newValue" else key


def _normal(text: str) -> str:
    return squash(text).replace("−", "-")


def _aside(n: Node) -> bool:
    return n.tag in ("sup", "aside") or "mdn-anno" in n.classes


def _value(node: Node) -> str:
    return _normal(node.text(_aside))


def _fields(rows: list[Node]) -> list[tuple[str, Node]]:
    """(key, cell) of two-column rows."""
    out = []
    for tr in rows:
        cells = tr.elements()
        last = next((c for c in reversed(cells) if c.tag == "td"), None)
        if len(cells) > 1 and last is not None and (key := _key(cells[0].text(_aside))):
            out.append((key, last))
    return out


def table_definitions(page: Page, table: Node) -> list[Definition]:
    """The definitions of a two-column table, one per name."""
    fields = _fields(table.select("tr"))
    names: list[Definition] = []
    for key, cell in fields:
        if key == "name":
            dfns = cell.select("dfn[id]")
            names = [{"name": _normal(n.text()), "href": page.absolute(n)} for n in dfns] or [{"name": x.strip()} for x in _value(cell).split(",") if x.strip()]
    common = {key: _value(cell) for key, cell in fields if key != "name"}
    return [n | common for n in names]


def list_definitions(page: Page, dl: Node) -> list[Definition]:
    """The definitions of a list: names in its first term, the other fields in a table below."""
    dt = dl.first("dt")
    if dt is None:
        return []
    named = dt.select("dfn[id], a[name]") or ([dt] if dt.attrs.get("id") else [])
    names: list[Definition] = [{"name": _normal(n.text().replace("'", "")), "href": page.absolute(n, "id" if n.attrs.get("id") else "name")} for n in named]
    names = names or [{"name": _normal(x.replace("'", ""))} for x in dt.text().split(",") if x.strip()]
    common = {key: _value(cell) for key, cell in _fields(dl.select("dd table tr"))}
    return [n | common for n in names]


def merge_definitions(a: Definition, b: Definition) -> Definition | None:
    """One definition of two of the same name: a base one that the other adds new values to; None if they do not go together."""
    if a.get("value") and b.get("value"):
        return None
    base, more = (b, a) if b.get("value") else (a, b)
    field = "value" if base.get("value") else "newValues"
    if not base.get(field) or not more.get("newValues") or more.get("initial") and more["initial"] != base.get("initial"):
        return None
    return base | {field: f"{base[field]} | {more['newValues']}"}


def production(rule: str) -> tuple[str, str] | None:
    """(name, value) of a production rule, without comments and the parameter of the name."""
    name, *value = _RULE.split(_COMMENT.sub("", rule))
    return (_PARAMETER.sub("", squash(name)), _normal(value[0])) if value else None


def production_rules(page: Page) -> dict[str, str]:
    """Name -> value of the rules written in blocks for them, or in blocks that hold a definition of the language; another value of a name is an alternative."""
    out: dict[str, str] = {}
    for pre in page.doc.select("pre"):
        inside = list(pre.walk())
        ours = "prod" in pre.classes or not {"prod", "idl"} & set(pre.classes) and not any("idl" in n.classes for n in inside) and any(n.tag == "dfn" and n.attrs.get("data-dfn-type") in _TYPED for n in inside)
        if not ours or any(n.tag in ("del", "ins") for n in inside) or page.is_informative(pre):
            continue
        for text in map(str.strip, _SPLIT.split(_COMMENT.sub("", pre.text(_aside)))):
            found = production(text) or ((text.split(" ")[0], _normal(text)) if text.startswith("@") else None)
            if found is not None:
                name, value = found
                if name in out and value != out[name] and value not in out[name].split(" | "):
                    out[name] += f" | {value}"
                else:
                    out.setdefault(name, value)
    return out


def _names(dfn: Node) -> list[str]:
    """The texts of a definition, or of several the ones that are syntax."""
    names = [squash(x) for x in dfn.attrs["data-lt"].split("|")] if dfn.attrs.get("data-lt") else [dfn.text().strip()]
    calls = any(n.endswith("()") for n in names)
    syntax = [n for n in names if n.startswith("@") or n.endswith("()") or n.startswith("<") and n.endswith(">") or n.startswith(":") and not calls]
    word = not any(n.startswith(("@", ":")) or n.endswith("()") or n.startswith("<") and n.endswith(">") for n in names)
    return names if word else syntax


def typed_definitions(page: Page, dfn: Node) -> list[Definition]:
    """What a marked-up definition says: its value from a rule in its text, from its arguments, or from the description of its term; or its prose."""
    kind, scope = dfn.attrs["data-dfn-type"], dfn.attrs.get("data-dfn-for")
    link = next((a for a in dfn.select("a[data-link-type]")), None)
    if scope and kind in ("function", "type") and link is not None and dfn.text().strip() == link.text().strip() and page.resolve(link) != f"{page.base(dfn).split('#')[0]}#{dfn.attrs.get('id', '')}":
        return []  # another construct, only mentioned here
    alone = dfn.tag in HEADINGS or dfn.parent is None or dfn.parent.tag in ("body", "main")
    around = dfn if alone else dfn.parent
    text, own = around.text(_aside).strip(), dfn.text().strip()
    in_block = any(n.tag == "pre" for n in dfn.up())
    out = []
    for name in _names(dfn):
        d: Definition = {"name": name}
        call = _CALL.match(name)
        spelled = (f"{call[1]}()", _normal(own)) if call and own.startswith(call[1] + "(") and own != f"{call[1]}()" else None
        rule: tuple[str, str] | None = None
        prose = None
        if _RULE.search(text):
            part = next((r for r in _SPLIT.split(text) if r.strip().startswith(own)), None)
            if in_block:
                rule = spelled
            elif part is not None:
                rule = production(part)
            else:
                prose = squash(text)
        elif call:
            rule = spelled
        elif around.tag == "dt":
            dd = next((n for n in around.parent.elements()[around.parent.elements().index(around) + 1 :] if n.tag == "dd"), None)
            if dd is None:
                continue
            code = dd.first("code.prod, pre.prod")
            if code is not None and not page.is_informative(code):
                written = code.text()
                rule = production(written) if written.startswith((f"{name} = ", f"<{name}> = ")) else (name, _normal(written)) if not _RULE.search(written) else None
            else:
                prose = squash(dd.text(lambda n, dd=dd: _aside(n) or n.parent is dd and (n.tag in ("details", "dl") or "note" in n.classes)))
        if rule is not None:
            d = {"name": rule[0], "value": rule[1]}
        elif around.tag == "p":
            prose = squash(text)
        out.append(d | ({"prose": prose} if prose else {}) | ({"href": page.absolute(dfn)} if dfn.attrs.get("id") else {}) | {"type": kind} | ({"value": _normal(d["name"])} if kind == "value" else {}) | ({"for": scope} if scope else {}))
    return out


def legacy_aliases(page: Page) -> list[Definition]:
    """Properties said to be another name of a property: in a sentence that links to the term, or in a table of two columns after it."""
    out = []
    for a in page.doc.select("a[href$='#legacy-name-alias']"):
        holders = [a.parent]
        if a.parent.first("dfn[data-dfn-type=property]") is None or a.parent.first("a[data-link-type=property]") is None:
            table = a.parent.next_element()
            holders = [tr for tr in table.select("tr") if tr.first("td") is not None] if table is not None and table.tag == "table" else []
        for box in holders:
            dfn, alias = box.first("dfn[data-dfn-type=property]"), box.first("a[data-link-type=property]")
            if dfn is not None and alias is not None:
                out.append({"name": _normal(dfn.text()), "href": page.absolute(dfn), "legacyAliasOf": _normal(alias.text())})
    return out


def _quoted(name: str) -> str | None:
    """The syntax of a selector that is its name: signs quoted, words as they are, none for a call."""
    if "(" in name:
        return None
    return name if re.match("[:a-z]", name, re.I) else " ".join(f"'{c}'" for c in name)


def css(page: Page) -> dict[str, list[Definition]]:
    """properties, atrules (with descriptors), selectors, values and warnings."""
    warnings: list[Definition] = []

    def gather(nodes: list[Node], read: Callable[[Page, Node], list[Definition]], duplicates: str, typed: bool = False) -> list[Definition]:
        """Definitions in order; those of a name that is there are merged, kept beside it, or left out, and told."""
        out: list[Definition] = []
        first: dict[str, int] = {}
        for node in nodes:
            if page.is_informative(node) or node.first("ins, del") is not None:
                continue
            for d in read(page, node):
                if not d.get("name"):
                    continue
                if not typed:
                    d.pop("type", None)
                at = first.setdefault(d["name"], len(out))
                merged = merge_definitions(out[at], d) if duplicates == "merge" and at < len(out) else None
                if at == len(out):
                    out.append(d)
                elif merged is not None:
                    out[at] = merged
                else:
                    warnings.append({"msg": "Unmergeable definition" if duplicates == "merge" else "Duplicate definition"} | d)
                    if duplicates == "push":
                        out.append(d)
        return out

    marked: dict[tuple[str, bool], list[Node]] = {}
    for n in page.doc.walk():
        kind = n.attrs.get("data-dfn-type")
        if kind in _TYPED and n.tag in _KINDS:
            marked.setdefault((kind, bool(n.attrs.get("data-dfn-for"))), []).append(n)

    def of(*kinds: str, scoped: bool = False) -> list[Node]:
        return sorted((n for k in kinds for n in marked.get((k, scoped), ())), key=lambda n: n.pre)

    out: dict[str, list[Definition]] = {
        "properties": gather(page.doc.select("table.propdef:not(.attrdef)"), table_definitions, "merge") + legacy_aliases(page),
        "atrules": gather(of("at-rule"), typed_definitions, "reject"),
        "selectors": gather([n for n in of("selector") if "data-export" in n.attrs], typed_definitions, "reject"),
        "values": gather(of("function", "type"), typed_definitions, "reject", typed=True),
    }
    descriptors = gather(page.doc.select("table.descdef:not(.attrdef)"), table_definitions, "push", typed=True)
    if not out["properties"] and not descriptors:  # documents of an older form
        out["properties"] = gather(page.doc.select("div.propdef dl"), list_definitions, "merge")
        descriptors = gather(page.doc.select("div.descdef dl"), list_definitions, "push")
    descriptors += gather(of("at-rule", scoped=True), typed_definitions, "reject", typed=True)  # rules within rules
    for d in descriptors:
        rule = next((r for r in out["atrules"] if r["name"] == d.get("for")), None)
        if rule is None:
            out["atrules"].append(rule := {"name": d.get("for")})
        rule.setdefault("descriptors", []).append(d)
    for rule in out["atrules"]:
        rule.setdefault("descriptors", [])
    roots = [d for k in ("properties", "atrules", "selectors", "values") for d in out[k]] + descriptors
    scoped = gather(of("value", "function", "type", "selector", scoped=True), typed_definitions, "push", typed=True)

    def named(name: str, among: list[Definition]) -> list[Definition]:
        """Definitions of a name, or of a descriptor written as rule/name; else those whose name in angle brackets it is."""
        rule, _, inner = name.partition("/")
        exact = [d for d in among if d["name"] == name or name.startswith("@") and inner and d["name"] == inner and d.get("for") == rule]
        return exact or [d for d in among if f"<{d['name']}>" == name]

    for name, value in production_rules(page).items():
        targets = named(name, roots)[:1] or named(name, scoped)
        for d in targets:
            d["value"] = value
        if not targets:
            lost = {"msg": "Missing definition", "name": name, "value": value}
            warnings.append(lost)
            roots.append(lost)

    # what a construct stands below: its scopes, and what has it in its value
    above: dict[str, list[str]] = {}
    for d in scoped:
        above.setdefault(d["name"], []).extend(x.strip() for x in d["for"].split(","))
    for t in out["values"]:
        above.setdefault(t["name"], []).extend(d["name"] for d in (*scoped, *roots) if t["name"] in (d.get("value") or ""))

    def below(name: str, other: str) -> bool:
        """Whether ``other`` is reached from ``name`` on the way up; the ways may go round, so they are followed for ten steps."""
        level = {name}
        for _ in range(10):
            if other in level:
                return True
            level = {p for x in level for p in above.get(x, ())}
        return False

    for d in scoped:
        scopes = list(dict.fromkeys(x.strip() for x in d["for"].split(",")))
        for ref in [r for r in scopes if all(o == r or not below(o, r) for o in scopes)]:
            targets = named(ref, roots)[:1] or named(ref, scoped)
            for t in targets:
                t.setdefault("values", []).append(d)
            if not targets:
                warnings.append({"msg": "Dangling value"} | d | {"for": ref})
    for d in (*out["selectors"], *(v for s in out["selectors"] for v in s.get("values", ()))):
        if not d.get("value") and (value := _quoted(d["name"])) is not None:
            d["value"] = value

    def copy(d: Definition, drop: tuple[str, ...], seen: frozenset[int] = frozenset()) -> Definition:
        """A definition without its scopes, with its values; a value that holds itself ends there."""
        kept = {k: v for k, v in d.items() if k not in ("values", *drop)}
        inner = [copy(v, ("for",), seen | {id(d)}) for v in d.get("values", ()) if id(v) not in seen and v is not d]
        if "descriptors" in d:
            kept["descriptors"] = [copy(x, (), seen | {id(d)}) for x in d["descriptors"]]
        return kept | ({"values": inner} if inner else {})

    return {k: [copy(d, ()) for d in v] for k, v in out.items()} | {"warnings": [copy(w, ()) for w in warnings]}
