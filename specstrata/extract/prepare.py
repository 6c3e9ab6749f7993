"""Documents with markup of their own for definitions, brought to the common form before definitions are read.

Each preparation marks elements of a page's own copy of its tree: it wraps or
replaces what stands for a definition by one with id, type, scope and texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from specstrata.extract.dom import Node, squash
from specstrata.extract.modules import HEADINGS, MODEL, Page, idl
from specstrata.extract.webidl import IdlError, parse_idl


def _mark(dfn: Node, kind: str | None = None, scope: str | None = None, terms: str | None = None) -> None:
    for name, value in (("data-dfn-type", kind), ("data-dfn-for", scope), ("data-lt", terms)):
        if value is not None:
            dfn.attrs[name] = value


def _wrapped(el: Node, anchor: str | None) -> Node:
    """A definition around all that an element holds."""
    dfn = el.wrap("dfn")
    if anchor:
        dfn.attrs["id"] = anchor
    return dfn


def _standing_for(el: Node, text: str, anchor: str, kind: str, scope: str | None = None, terms: str | None = None) -> None:
    """Put a definition with a text of its own in an element's place."""
    dfn = Node("dfn", {"id": anchor})
    dfn.add(Node(None, data=text))
    _mark(dfn, kind, scope, terms)
    el.replace(dfn)


def _idl_items(page: Page) -> list[dict[str, Any]]:
    try:
        return parse_idl(idl(page))
    except IdlError:
        return []


def html(page: Page) -> None:
    """A definition without an id in a heading that is no definition itself takes the heading's id."""
    for head in page.doc.select(",".join(f"{h}[id]" for h in HEADINGS[1:])):
        if not any(a in head.attrs for a in (*MODEL, "data-lt")):
            for dfn in head.select("dfn"):
                if not dfn.attrs.get("id"):
                    dfn.attrs["id"] = head.attrs["id"]


# Classes of anchors in style documents of level 2, and what marks index terms there.
_PROPERTY, _VALUE = "propdef-title", "value-def"
_SUFFIX = re.compile(r"(::|, )definition of$")


def css2(page: Page) -> None:
    """Index terms with a named anchor around or in them become exported definitions."""
    for span in page.doc.select("span.index-def"):
        anchor = span.first("a[name]") or span.closest("a[name]")
        dfn = span.first("dfn") or span.closest("dfn")
        if anchor is None or dfn is not None and dfn.attrs.get("id"):
            continue
        if dfn is None:
            dfn = span.wrap("dfn")
        source = span.attrs["title"] if "title" in span.attrs else dfn.text()
        terms = [re.sub("^'(.*)'$", r"\1", _SUFFIX.sub("", squash(t))) for t in source.split("|")]
        dfn.attrs |= {"id": anchor.attrs["name"], "data-export": "", "data-lt": "|".join(dict.fromkeys(terms))}
        cls = anchor.attrs.get("class", "")
        if cls == _PROPERTY:
            _mark(dfn, "property")
        elif cls == _VALUE:
            _mark(dfn, "type" if re.fullmatch("<.*>", dfn.attrs["data-lt"]) else "value")


def _index_link(page: Page, name: str, within: str, anchor: str) -> Node | None:
    """The row of an index page that links to an anchor."""
    pages = [s for s in page.doc.walk() if s.attrs.get("data-page", "").endswith(name)]
    link = next((a for s in pages for a in s.select(within) if a.attrs.get("href", "").endswith("#" + anchor)), None)
    return link.closest("tr") if link is not None else None


def svg2(page: Page) -> None:
    """Attributes, properties, interfaces and their members, marked by class, by index pages or by the form of their ids."""
    items = _idl_items(page)
    by_name = {d["name"]: d for d in reversed(items) if "name" in d}
    link = page.doc.first("#LinkElement")
    if link is not None and "data-dfn-type" not in link.attrs:
        _mark(link, "element", terms="link")
    for dfn in page.doc.select(".attrdef dfn[id]:not([data-dfn-type]):not([data-skip])"):
        row = _index_link(page, "attindex.html", "th span.attr-name a", dfn.attrs["id"])
        _mark(dfn, "element-attr", row.first("td").text() if row is not None and row.first("td") is not None else None)
    for term in page.doc.select("dt[id] > .adef, dt[id] > .property"):
        dt = term.parent
        attribute = "adef" in term.classes
        row = _index_link(page, "attindex.html" if attribute else "propidx.html", "th a", dt.attrs["id"])
        scope = ",".join(a.text() for a in row.select("span.element-name a")) if row is not None else None
        plain = Node("dt")
        plain.add(term := Node("i"))
        dt.replace(plain)
        _standing_for(term, dt.text() if len(dt.elements()) == 1 and not dt.children[1:] else dt.first(".adef, .property").text(), dt.attrs["id"], "element-attr" if attribute else "property", scope)
    for b in page.doc.select("b[id^=__svg__]"):
        _, _, holder, member = ([*b.attrs["id"].split("__"), "", ""])[:4]
        found = next((m for m in by_name.get(holder, {}).get("members", ()) if m.get("name") == member), None)
        if found is not None:
            _standing_for(b, b.text(), b.attrs["id"], "method" if found["type"] == "operation" else found["type"], holder)
    for head in page.doc.select("h3[id^=Interface]:not([data-dfn-type])"):
        name = head.attrs["id"].removeprefix("Interface")
        if by_name.get(name, {}).get("type") == "interface":
            _mark(head, "interface", terms=name)
    for b in page.doc.select("b[id]:not([data-dfn-type])"):
        if b.text() in by_name:
            _standing_for(b, b.text(), b.attrs["id"], by_name[b.text()]["type"])


# Where the prelude of the data language begins and ends, and the form of its rules.
_PRELUDE, _PRELUDE_END, _PRELUDE_RULE = re.compile(r"Appendix .\.\s+Standard Prelude"), re.compile(r"Figure \d+: CDDL Prelude"), re.compile(r"^\s+([a-z0-9\-]+) = .*$", re.M)


def rfc8610(page: Page) -> None:
    """The heading of the prelude becomes one definition with all its types as texts."""
    pages = page.doc.select("pre.newpage")
    begin = next((k for k, pre in enumerate(pages) if _PRELUDE.search(pre.text()) and pre.first("a[id]") is not None), None)
    end = next((k for k, pre in enumerate(pages) if begin is not None and k >= begin and _PRELUDE_END.search(pre.text())), None)
    if end is None:
        return
    types = [m for pre in pages[begin : end + 1] for m in _PRELUDE_RULE.findall(pre.text())]
    a = pages[begin].first("a[id]")
    dfn = Node("dfn", {"id": a.attrs["id"], "data-export": ""})
    dfn.add(Node(None, data=a.text()))
    _mark(dfn, "cddl-type", terms="|".join(types))
    a.replace(dfn)


def webgl1(page: Page) -> None:
    """Anchors of attributes and methods become definitions in the scope of the one interface that has such a member."""
    items = _idl_items(page)
    for a in page.doc.select(".attribute-name a[id^=DOM-]"):
        name = a.text().strip()
        owners = [d for d in items if any(m["type"] == "attribute" and m.get("name") == name for m in d.get("members", ()))]
        if len(owners) == 1:
            _standing_for(a, name, a.attrs["id"], "attribute", owners[0]["name"])
    for a in page.doc.select(".idl-code a[name]"):
        name = a.text().split(" ")[-1]
        call = re.search(r"\((.*?)\)", a.parent.text(), re.S)
        if call is None:
            continue
        args = [x.split(" ")[-1] for x in call[1].split(",")]
        owner = next((d for d in items if any(m["type"] == "operation" and m.get("name") == name and len(m["arguments"]) == len(args) for m in d.get("members", ()))), None)
        if owner is not None:
            _standing_for(a, a.text(), a.attrs["name"], "method", owner["name"], f"{name}({', '.join(args)})")


# Headings of the script language that look like objects but are none, ids of objects of more than one word, and
# names that other documents define as well.
_NO_OBJECTS = ("sec-global-object", "sec-fundamental-objects", "sec-waiterlist-objects")
_OBJECTS = ("sec-regexp-regular-expression-objects", "sec-weak-ref-objects", "sec-aggregate-error-objects", "sec-finalization-registry-objects", "sec-async-function-objects")
_ELSEWHERE = ("Promise", "DataView", "ArrayBuffer")
_SECTION = re.compile(r"^([A-Z]\.)?[0-9.]+ ")
_SCOPED = re.compile(r"^[a-z0-9]+\.[a-z0-9]+", re.I)
_CALL = re.compile(r"^([a-z0-9]+)+ *\(", re.I)
_ABSTRACT = re.compile(r"^[A-Z][a-zA-Z0-9]+ *\(")


def _call(name: str) -> str:
    """A call without brackets around optional arguments and blanks within."""
    return re.sub(" *,", ",", re.sub(r" *\)", ")", re.sub(r" \( *", "(", name.translate({91: None, 93: None}), count=1), count=1))


class _Script:
    """Definitions of the script language, from headings, equations, tables, grammar and plain definitions."""

    def __init__(self, page: Page) -> None:
        self.doc = page.doc
        self.names: set[str] = set()
        self.types: dict[str, str] = {}
        self.abstract: dict[str, str] = {}
        for caption in self.doc.select("figcaption"):
            owner = caption.parent.first("emu-xref") if re.search("(abstract|additional) method", caption.text(), re.I) else None
            if owner is not None:
                scope = "Environment Records" if owner.text().endswith("Environment Records") else owner.text()
                for tr in caption.parent.select("tr"):
                    td = next((c for c in tr.elements()[:1] if c.tag == "td"), None)
                    if td is not None:
                        self.abstract[td.text().split("(")[0].strip()] = scope

    def run(self) -> None:
        live = lambda nodes: [n for n in nodes if not any("legacy" in a.attrs for a in n.up())]
        for head in live(self.doc.select("h1")):
            name = _SECTION.sub("", head.text()).strip()
            anchor = head.parent.attrs.get("id", "")
            if re.search("-objects?$", anchor) and re.search(" Objects?$", name):
                self.object(head, name, anchor)
            elif re.search("-[a-z]+error$", anchor) and "(" not in name:
                _mark(self.heading(head), "exception", terms=name)
                self.names.add(name)
                self.types[name] = "exception"
            elif re.search("[-.]prototype[-.]", anchor):
                self.member(head, name)
            elif any(a.attrs.get("id") == "sec-value-properties-of-the-global-object" for a in head.up()):
                _mark(self.heading(head), "attribute", "globalThis", name)
            else:
                self.operation(head, name)
        for eqn in live(self.doc.select("emu-eqn[aoid]")):
            if "=" not in eqn.text():
                _mark(_wrapped(eqn, eqn.attrs.get("id")), "abstract-op", terms=eqn.attrs["aoid"])
        for table in live(self.doc.select("figure > table")):
            caption = table.parent.first("figcaption")
            m = re.match(r".*state components for", caption.text(), re.I | re.S) if caption is not None else None
            if m:
                box = next((n for n in table.up() if n.tag in ("emu-table", "emu-clause") and n.attrs.get("id")), None)
                for tr in table.select("tr"):
                    for td in [c for c in tr.elements()[:1] if c.tag == "td"]:
                        _mark(_wrapped(td, box.attrs["id"] if box is not None else None), scope=caption.text()[m.end() :].strip())
        for rule in self.doc.select("emu-grammar[type=definition] emu-production"):
            dfn = _wrapped(rule, rule.attrs.get("id"))
            annex = any(a.attrs.get("data-page", "").endswith("additional-ecmascript-features-for-web-browsers.html") for a in rule.up())
            _mark(dfn, "grammar", "Web browsers" if annex else None, rule.attrs.get("name", ""))
            dfn.attrs["data-noexport"] = ""
        for dfn in live(self.doc.select("dfn")):
            self.term(dfn)
        for dfn in live(self.doc.select("dfn[id][data-export]")):
            m = re.fullmatch("(.*) prototype( object)?", dfn.text().strip())
            if m and f"%{m[1].strip()}.prototype%" in self.names:
                del dfn.attrs["id"], dfn.attrs["data-export"]

    def heading(self, head: Node) -> Node:
        dfn = _wrapped(head, head.parent.attrs.get("id"))
        if "aoid" in head.parent.attrs:
            dfn.attrs["aoid"] = head.parent.attrs["aoid"]
        return dfn

    def object(self, head: Node, name: str, anchor: str) -> None:
        if anchor in _NO_OBJECTS or not re.search("sec-[a-z]+-objects?", anchor) and anchor not in _OBJECTS:
            return
        name = re.sub(r" \([^)]*\)", "", re.sub(" Objects?$", "", name.removeprefix("The ")), count=1)
        dfn = self.heading(head)
        _mark(dfn, terms=name)
        if name in _ELSEWHERE:
            dfn.attrs["data-noexport"] = ""
        if re.match("[A-Z]", name):
            made = any(n.attrs.get("id", "").endswith("constructor") for n in head.parent.walk())
            self.types[name] = "exception" if name.endswith("Error") else "interface" if made else "namespace"
            _mark(dfn, self.types[name])
        self.names.add(name)

    def member(self, head: Node, name: str) -> None:
        """A method or attribute of an object's prototype."""
        spoken = "(" not in name and " " in name and not re.match("[gs]et ", name)
        if spoken or "[[" in name or "@@" in name or name.endswith(".constructor"):
            return
        scope = re.sub("^[gs]et ", "", re.sub(r"\.prototype\..*", "", name))
        name = re.sub(r".*\.prototype\.", "", name)
        is_call = "(" in name
        _mark(self.heading(head), "method" if is_call else "attribute", scope, _call(name) if is_call else name)

    def operation(self, head: Node, name: str) -> None:
        """A member of a global object, an abstract operation, a constructor or a function of the global object."""
        known = _SCOPED.match(name) or _CALL.match(name)
        if head.first("dfn") is not None or not known or "@@" in name or name.endswith(".prototype") or "(" not in name and " " in name or ". . ." in name:
            return
        dfn = self.heading(head)
        is_call = "(" in name
        if _SCOPED.match(name):
            scope, _, name = name.partition(".")
            name = _call(name) if is_call else name
            _mark(dfn, "method" if is_call else "const" if re.fullmatch("[A-Z]+", name) else "attribute", scope, name)
        elif _ABSTRACT.match(name):
            name = _call(name)
            op = name.split("(")[0]
            if op in self.types:
                _mark(dfn, "constructor", op, name)
            else:
                _mark(dfn, "abstract-op", self.scope(head, self.abstract[op]) if op in self.abstract else None, f"{dfn.attrs['aoid']}|{name}" if dfn.attrs.get("aoid") else name)
        else:
            name = _call(name)
            _mark(dfn, "method", "globalThis", name)
        self.names.add(name)

    def scope(self, head: Node, base: str) -> str:
        """The title of the nearest clause that ends like the class of an abstract method, else the class."""
        for clause in head.up():
            title = clause.first("h1") if clause.tag == "emu-clause" else None
            text = _SECTION.sub("", title.text()).strip() if title is not None else ""
            if text.lower().endswith(base.lower()):
                return text
        return base

    def term(self, dfn: Node) -> None:
        pages = [a.attrs["data-page"] for a in dfn.up() if "data-page" in a.attrs]
        if any(p.endswith(("conformance.html", "notational-conventions.html")) for p in pages):
            dfn.attrs.pop("id", None)
            return
        text = dfn.text()
        if dfn.attrs.get("aoid"):
            _mark(dfn, "abstract-op")
        if re.match("%[A-Z].*%$", text):
            _mark(dfn, self.types.get(text.replace("%", ""), "interface"))
            self.names.add(text.strip())
        if re.match("%[a-z]+%", text, re.I) and any(p.endswith("global-object.html") for p in pages):
            _mark(dfn, "method", "globalThis")
        if re.fullmatch("@@[a-z]*", text, re.I):
            _mark(dfn, "const")
        if dfn.attrs.get("variants"):
            dfn.attrs["data-lt"] = f"{dfn.attrs.get('data-lt', text.strip())}|{dfn.attrs['variants']}"
        if not dfn.attrs.get("data-dfn-type") and text.strip() in self.names:
            return
        if not dfn.attrs.get("id"):
            clause = next((n for n in dfn.up() if n.tag == "emu-clause" and n.attrs.get("id")), None)
            if clause is not None:
                dfn.attrs["id"] = clause.attrs["id"]
        if not dfn.attrs.get("data-dfn-type"):
            dfn.attrs.setdefault("data-dfn-for", "ECMAScript")
            dfn.attrs["data-export"] = ""


def ecmascript(page: Page) -> None:
    _Script(page).run()


#: Preparation by the shortname of the document.
PREPARATIONS: dict[str, Callable[[Page], None]] = {"CSS2": css2, "html": html, "ecmascript": ecmascript, "SVG2": svg2, "rfc8610": rfc8610, "webgl1": webgl1}
