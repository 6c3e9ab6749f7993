"""Extraction modules: one parsed document to rows of facts.

Each takes a ``Page`` and gives plain values; they share the document and the
map from ids to headings, which is made once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from email.utils import parsedate_to_datetime
from functools import cached_property
from typing import Any
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from specstrata.extract.dom import Node, inner_html, parse_html, squash

# What marks a part of a document as informative.
INFORMATIVE = (
    ".informative,.informative-bg,.note,.issue,.example,.ednote,.annotation,.practice,.introductory,.non-normative,aside,.idlHeader,"
    "[id^=dfn-panel-],.mdn-anno,.wpt-tests-block,details.respec-tests-details"
)
#: Characters that stay as they are in an anchor, beside letters, digits, "-", "_" and "." (fixed value).
ANCHOR_SAFE = "!~*()'"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MONTHS = "January February March April May June July August September October November December".split()
# Fixed values of the outline algorithm.
SECTIONING = frozenset(["article", "aside", "nav", "section"])
SECTIONING_ROOTS = frozenset(["blockquote", "body", "details", "dialog", "fieldset", "figure", "td"])
# Types a definition may have.
DFN_TYPES = frozenset(
    "property descriptor value type at-rule function selector namespace interface constructor method argument attribute callback dictionary dict-member enum enum-value exception const typedef stringifier serializer iterator maplike setlike "
    "extended-attribute event permission element element-state element-attr attr-value cddl-module cddl-type cddl-parameter cddl-key cddl-value scheme http-header grammar abstract-op dfn".split()
)
_NUMBER = re.compile(r"^((?:Appendix +)?(?:[A-Z]|\d+)(?:\.[\dA-Z]+)*[.:]?)\s+(?=\S)")
_FOR = re.compile(r",(?![^(]*\))")


def serialize_url(url: str) -> str:
    """A URL as browsers serialize it: lower-case scheme and host, a path, non-ASCII percent-encoded."""
    p = urlsplit(url.strip())
    if not p.scheme or not p.netloc:
        return url
    safe = "!$&'()*+,/:;=@%~-._[]"
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), quote(p.path or "/", safe=safe), quote(p.query, safe=safe + "?"), quote(p.fragment, safe=safe + "?")))


def split_number(title: str) -> tuple[str | None, str]:
    """The number of a heading, without a last dot or colon and the word Appendix, and the rest."""
    m = _NUMBER.match(title)
    if not m or not re.search(r"\d|^Appendix|[.:]$", m[1]):
        return None, title
    return re.sub(r"^Appendix +", "", re.sub(r"[.:]$", "", m[1])), title[m.end() :]


@dataclass
class Section:
    """A section of the outline; ``heading`` is None where it is only implied."""

    root: Node | None
    heading: Node | None
    level: int
    parent: Section | None = None
    children: list[Section] = field(default_factory=list)


@dataclass
class Page:
    """A document with what the modules share. spec: url, shortname, title."""

    html: str
    spec: dict[str, str | None]

    @cached_property
    def doc(self) -> Node:
        return parse_html(self.html)

    @cached_property
    def prepared(self) -> Page:
        """The page with the definitions of documents that use markup of their own brought to the common form; itself for all others."""
        from specstrata.extract.prepare import PREPARATIONS

        run = PREPARATIONS.get(self.spec.get("shortname") or "")
        if run is None:
            return self
        page = Page(self.html, self.spec)
        run(page)
        page.renumber()
        return page

    def renumber(self) -> None:
        from specstrata.extract.dom import number

        number(self.doc)

    @cached_property
    def prose(self) -> dict[str, Node]:
        """Reference ("#id") -> the first element that says it defines it in prose."""
        out: dict[str, Node] = {}
        for node in self.doc.walk():
            if "data-defines" in node.attrs:
                out.setdefault(node.attrs["data-defines"], node)
        return out

    @cached_property
    def by_id(self) -> dict[str, Node]:
        out: dict[str, Node] = {}
        for node in self.doc.walk():
            if node.attrs.get("id"):
                out.setdefault(node.attrs["id"], node)
        return out

    def resolve(self, node: Node, attribute: str = "href") -> str:
        """The absolute URL a link leads to."""
        return urljoin(self.base(node), node.attrs.get(attribute, ""))

    @cached_property
    def informative(self) -> set[int]:
        out: set[int] = set()
        for node in self.doc.walk():
            if node.matches(INFORMATIVE) or id(node.parent) in out:
                out.add(id(node))
        return out

    def base(self, node: Node) -> str:
        """The URL of the page a node is on."""
        page = next((n.attrs["data-page"] for n in node.up() if "data-page" in n.attrs), None)
        return page or self.spec.get("url") or "about:blank"

    def absolute(self, node: Node, attribute: str = "id") -> str:
        """The absolute URL of a node's anchor."""
        name = node.attrs.get(attribute, "")
        if attribute == "href" and name.startswith("#"):
            name = name[1:]
        return f"{self.base(node).split('#')[0]}#{quote(name, safe=ANCHOR_SAFE)}"

    def is_informative(self, node: Node) -> bool:
        return id(node) in self.informative

    def clean_text(self, node: Node) -> str:
        """Text without informative parts and self-links."""
        return squash(node.text(lambda n: self.is_informative(n) and not self.is_informative(node) or n.matches(".self-link,.secno-link")))

    @cached_property
    def sections(self) -> dict[int, Section]:
        """Node -> its section, by the outline algorithm: an explicit stack of sectioning elements, headings opening implied sections by rank."""
        body = self.doc.first("body") or self.doc
        owner: dict[int, Section] = {}
        top = Section(body, None, 0)

        def visit(node: Node, current: Section, floor: Section) -> Section:
            for child in node.elements():
                if "hidden" in child.attrs or child.tag in ("script", "style", "template"):
                    continue
                if child.tag in SECTIONING or child.tag in SECTIONING_ROOTS:
                    inner = Section(child, None, 0, current)
                    if child.tag in SECTIONING:
                        current.children.append(inner)
                    owner[id(child)] = inner
                    visit(child, inner, inner)
                    continue
                if child.tag in HEADINGS or child.tag == "hgroup" and child.first("h1,h2,h3,h4,h5,h6"):
                    head = child if child.tag in HEADINGS else min(child.select("h1,h2,h3,h4,h5,h6"), key=lambda n: n.tag)
                    level = int(head.tag[1])
                    if current is floor and floor.heading is None and not floor.children:
                        floor.heading, floor.level = head, level
                    else:
                        up = current
                        while up is not floor and up.level >= level:
                            up = up.parent
                        if up is floor and floor.heading is not None and floor.level >= level and floor.parent is None:
                            floor_parent = floor
                        else:
                            floor_parent = up
                        current = Section(None, head, level, floor_parent)
                        floor_parent.children.append(current)
                    owner[id(child)] = current
                    for n in child.walk():
                        owner[id(n)] = current
                    continue
                owner[id(child)] = current
                current = visit(child, current, floor)
            return current

        visit(body, top, top)
        self.outline_root = top
        return owner

    @cached_property
    def headings_by_id(self) -> dict[str, dict[str, Any]]:
        """Absolute URL of an id -> the heading it stands under; of a heading's several ids the section's comes first, the others are alternates."""
        if self.doc.first("emu-clause") is not None:
            return self._clauses_by_id()
        sections = self.sections
        out: dict[str, dict[str, Any]] = {}
        for node in [self.doc.first("body") or self.doc, *(self.doc.first("body") or self.doc).walk()]:
            if not (node.attrs.get("id") or node.tag == "a" and node.attrs.get("name")):
                continue
            section = sections.get(id(node))
            if section is None and node.parent is not None:
                section = next((sections[id(n)] for n in node.up() if id(n) in sections), None)
            while section is not None and section.heading is None:
                section = section.parent
            if section is None:
                continue
            head = section.heading
            anchors = [n.attrs.get("id") or n.attrs.get("name") for n in head.walk() if n.attrs.get("id") or n.tag == "a" and n.attrs.get("name")]
            ids = [x for x in dict.fromkeys([section.root.attrs.get("id") if section.root is not None and section.root.tag in SECTIONING else None, head.attrs.get("id"), *anchors]) if x]
            number, title = split_number(self.clean_text(head))
            info: dict[str, Any] = {"href": f"{self.base(head).split('#')[0]}#{quote(ids[0], safe=ANCHOR_SAFE)}" if ids else self.base(head), "title": title}
            if ids:
                info["id"] = ids[0]
            if number:
                info["number"] = number
            if len(ids) > 1:
                info["alternateIds"] = ids[1:]
            name = node.attrs.get("id") or node.attrs.get("name")
            out.setdefault(f"{self.base(node).split('#')[0]}#{quote(name, safe=ANCHOR_SAFE)}", info)
        return out


    def _clauses_by_id(self) -> dict[str, dict[str, Any]]:
        """The map for documents made of clauses: the nearest clause with an id, by its first heading."""
        out: dict[str, dict[str, Any]] = {}
        known: dict[int, dict[str, Any]] = {}
        for node in self.doc.walk():
            if not node.attrs.get("id") or node.tag == "emu-xref":
                continue
            clause = next((n for n in node.up() if n.tag in ("emu-intro", "emu-clause", "emu-annex") and n.attrs.get("id")), None)
            if clause is None:
                continue
            if id(clause) not in known:
                head = clause.first("h1")
                number, text = split_number(self.clean_text(head)) if head is not None else (None, "")
                known[id(clause)] = {"id": clause.attrs["id"], "href": self.absolute(clause), "title": text} | ({"number": number} if number else {})
            out[self.absolute(node)] = known[id(clause)]
        return out


def title(page: Page) -> str:
    node = page.doc.first("title")
    text = squash(node.text()) if node else ""
    return text or page.spec.get("title") or f"[No title found for {page.spec.get('url')}]"


def generator(page: Page) -> str | None:
    meta = page.doc.first("meta[name=generator]")
    content = (meta.attrs.get("content", "") if meta else "").lower()
    if "bikeshed" in content:
        return "bikeshed"
    if "respec" in content or (body := page.doc.first("body")) is not None and body.attrs.get("id") == "respecDocument":
        return "respec"
    return None


def last_modified(page: Page) -> str | None:
    """The date of the document's head, as written; else the date the document was served with, as day, month and year."""
    head = page.doc.first(".head time")
    if head:
        return head.text().strip()
    status = " ".join(n.text() for n in page.doc.select(".head h2")).split()
    if status:
        return " ".join(status[-3:])
    served = page.spec.get("last_modified")
    if not served:
        return None
    try:
        at = datetime.fromisoformat(served)
    except ValueError:
        try:
            at = parsedate_to_datetime(served)
        except ValueError:
            return None
    return f"{at.day} {MONTHS[at.month - 1]} {at.year}"


def revision(page: Page) -> str | None:
    node = page.doc.first('meta[name="revision"]')
    content = node.attrs.get("content", "") if node else ""
    return content if re.search(r"[0-9a-fA-F]{40}", content) else None


def links(page: Page) -> dict[str, dict[str, list[str]]]:
    """Links written as absolute, by kind and URL, with distinct anchors in the order first seen."""
    out: dict[str, dict[str, list[str]]] = {"rawlinks": {}, "autolinks": {}}
    for a in page.doc.select("a[href^=http]"):
        if a.closest(".head, del, .dfn-panel"):
            continue
        kind = "autolinks" if "data-link-type" in a.attrs or "data-xref-type" in a.attrs else "rawlinks"
        parts = serialize_url(a.attrs["href"]).split("#")
        anchors = out[kind].setdefault(parts[0], [])
        if len(parts) > 1 and parts[1] and parts[1] not in anchors:
            anchors.append(parts[1])
    return {k: dict(sorted(v.items())) for k, v in out.items()}


def ids(page: Page) -> list[str]:
    named = [page.absolute(n) for n in page.doc.select("[id]") if n.attrs["id"] and not n.attrs["id"].startswith(("respec-", "dfn-panel-"))]
    return named + [page.absolute(n, "name") for n in page.doc.select("a[name]") if n.attrs["name"] and n.attrs["name"] != n.attrs.get("id")]


def headings(page: Page) -> list[dict[str, Any]]:
    """Headings of clauses, numbered spans, headings with ids, and headings around a named anchor, in that order."""
    found = [(n.parent, n) for n in page.doc.select("emu-clause[id] > h1")]
    found += [(n, n) for k in range(1, 7) for n in page.doc.select(f"span.h{k} a.selflink[id]")]
    found += [(n, n) for n in page.doc.select(",".join(f"{h}[id]" for h in HEADINGS)) if n.attrs["id"] and not (n.tag == "h1" and n.parent is not None and n.parent.tag == "emu-clause")]
    found += [(n, n.parent) for n in page.doc.select("a[name]") if n.parent is not None and n.parent.tag in HEADINGS and "id" not in n.parent.attrs]
    out = []
    for holder, head in found:
        name = "id" if holder.attrs.get("id") else "name"
        href = page.absolute(holder, name)
        info = dict(page.headings_by_id.get(href) or {})
        if not info:
            number, text = split_number(page.clean_text(head))
            info = {"id": holder.attrs[name], "href": href, "title": text} | ({"number": number} if number else {})
        level = int(head.tag[1]) if head.tag in HEADINGS else next((int(c[1]) for c in (head.parent.classes if head.parent else []) if re.fullmatch(r"h[1-6]", c)), 1)
        if holder.tag == "emu-clause":
            level = sum(a.tag == "emu-clause" for a in holder.up())
        out.append(info | {"level": level})
    return out


#: Where a document's generator puts its lists of references (fixed values).
REFERENCE_LISTS = {"bikeshed": "#{} + dl", "respec": "#{}-references > dl"}
_NORMATIVE = re.compile(r"^\s*((\w|\d+)(\.\d+)*\.?)?\s*normative\s+references\s*$", re.I)
_INFORMATIVE = re.compile(r"^\s*((\w|\d+)(\.\d+)*\.?)?\s*(informative|non-normative)\s+references\s*$", re.I)
Reference = dict[str, str]


def _reference(name: str, url: str | None) -> Reference:
    return {"name": name} | ({"url": url} if url else {})


def _listed(root: Node, told_apart: bool = False) -> tuple[list[Reference], list[Reference]]:
    """(references, those said to be non-normative, if they are to be told apart) of a list, nested lists left out."""
    own: list[Reference] = []
    apart: list[Reference] = []
    items = root.elements()
    for k, item in enumerate(items):
        if root.tag == "dl" and item.tag == "dt":
            name = re.sub(r"[\[\] \n]", "", item.text())
            dd = next((n for n in items[k + 1 :] if n.tag == "dd"), None)
            if name and dd is not None:
                link = next((a for a in dd.select("a[href]") if "://" in a.attrs["href"]), None)
                into = apart if told_apart and re.search("non-normative", dd.text(), re.I) else own
                into.append(_reference(name, serialize_url(link.attrs["href"]) if link is not None else None))
        elif root.tag == "ul" and item.tag == "li":
            link = next((a for a in item.select("a[href]") if not any(n.tag == "ul" and n is not root and item.contains(n) for n in a.up())), None)
            own.append(_reference(squash(link.text()), link.attrs["href"]) if link is not None else _reference(squash(item.text(lambda n: n.tag == "ul")), None))
    return own, apart


def _list_after(head: Node, stop: Node | None, tags: tuple[str, ...] = ("dl", "ul")) -> Node | None:
    """The first description list among the following siblings up to ``stop``, else the first bulleted list."""
    after = head.parent.elements() if head.parent is not None else []
    after = after[after.index(head) + 1 :]
    after = after[: next((k for k, n in enumerate(after) if n is stop), len(after))]
    return next((n for tag in tags for n in after if n.tag == tag), None)


def _after(head: Node, tags: tuple[str, ...], stop: Node | None = None) -> list[Node]:
    """The following siblings of some tags, up to ``stop``."""
    after = head.parent.elements() if head.parent is not None else []
    after = after[after.index(head) + 1 :]
    return [n for n in after[: next((k for k, n in enumerate(after) if n is stop), len(after))] if n.tag in tags]


def _references_by_clauses(page: Page) -> dict[str, list[Reference]]:
    """References in paragraphs of clauses named for them: a name up to the first comma or dot, with a link or a title."""
    out: dict[str, list[Reference]] = {}
    for kind in ("normative", "informative"):
        clause = page.doc.first(f"emu-clause#sec-references-{kind}, emu-clause#sec-{kind}-references")
        if clause is not None:
            out[kind] = []
            for p in clause.select("p"):
                name = re.match(r"(.+?)(,|\.)", p.text().strip())
                link = p.first("a[href]")
                if name and (link is not None or p.first("i") is not None):
                    out[kind].append(_reference(name[1].strip(), link.attrs["href"] if link is not None and re.match("https?://", link.attrs["href"]) else None))
    return out


def references(page: Page) -> dict[str, list] | None:
    """Normative and informative references, from the generator's lists or the sections named so; None if there are none."""
    out: dict[str, list[Reference]] = {"normative": [], "informative": []}
    selector = REFERENCE_LISTS.get(generator(page) or "")
    if selector is not None:
        for kind in ("normative", "informative"):
            root = page.doc.first(selector.format(kind))
            if root is not None:
                own, apart = _listed(root, told_apart=kind == "normative")
                out[kind] += own
                out["informative"] += apart
        return out if out["normative"] or out["informative"] else None
    out |= _references_by_clauses(page)
    heads = page.doc.select("h1, h2, h3")[::-1]
    found = False
    for kind, pattern in (("normative", _NORMATIVE), ("informative", _INFORMATIVE)):
        head = next((h for h in heads if pattern.match(h.text())), None)
        if head is not None:
            found = True
            root = _list_after(head, next(iter(_after(head, (*HEADINGS, "hgroup"))), None))
            if root is not None:
                out[kind] = _listed(root)[0]
    head = None if found else next((h for h in heads if re.search("references", h.text(), re.I)), None)
    if head is not None:
        stop = next(iter(_after(head, (head.tag,))), None)
        for sub in _after(head, (f"h{int(head.tag[1]) + 1}",), stop):
            root = _list_after(sub, stop)
            if root is not None and re.search("normative|informative", sub.text(), re.I):
                out["normative" if re.search("normative", sub.text(), re.I) else "informative"] = _listed(root)[0]
        if not out["normative"] and not out["informative"] and (root := _list_after(head, stop)) is not None:
            out["normative"], out["informative"] = _listed(root, told_apart=True)
    return out if out["normative"] or out["informative"] else None


def trim_block(code: str) -> str:
    lines = code.replace("\r", "").strip().split("\n")
    indents = [len(x) - len(x.lstrip(" \t")) for x in lines[1:] if x.strip()]
    cut = min(indents, default=0)
    return "\n".join([lines[0].rstrip(), *(x[cut:].rstrip() for x in lines[1:])])


def _code(page: Page, selector: str, exclude: str) -> list[Node]:
    found = [n for n in page.doc.select(selector) if not page.is_informative(n) and not any(a.tag and a.matches(exclude) for a in n.up())]
    return [n for n in found if not any(o is not n and o.contains(n) for o in found)]


def idl(page: Page) -> str:
    """Blocks of interface definitions, trimmed, a blank line between them; an index at the end of the document holds them all."""
    if squash(title(page)).startswith("Web IDL"):
        return ""
    index = page.doc.first("#idl-index")
    if index is not None:
        node = index.next_element()
        return trim_block(node.text()) if node is not None else ""
    blocks = _code(page, "pre.idl:not(.language-webidl), pre > code.idl-code:not(.language-webidl), pre > code.idl:not(.language-webidl), div.idl-code > pre, pre.widl", ".exclude,.extract,#actual-idl-index,.chapter-idl")
    return "\n\n".join(t for t in (trim_block(n.text(lambda x: x.matches(".idlHeader"))) for n in blocks) if t)


def cddl(page: Page) -> list[dict[str, str]]:
    """Data definitions per module; a block without a module belongs to each, ``all`` is their union, one anonymous module has no name."""
    blocks = []
    for n in _code(page, "pre.cddl, pre > code.cddl", ".exclude,.extract,#cddl-index"):
        names = [squash(x) for x in n.attrs.get("data-cddl-module", "").split(",") if squash(x)]
        if not names:
            names = [m[1] or m[2] for c in n.classes if (m := re.fullmatch(r"(.+)-cddl|cddl-(.+)", c))]
        if text := trim_block(n.text()):
            blocks.append(([x for x in names if x != "all"], not names, text))
    if not blocks:
        return []
    modules = list(dict.fromkeys(x for names, _, _ in blocks for x in names))

    def tidy(texts: list[str]) -> str:
        return re.sub(r"\s+$", "\n", "\n\n".join(texts), flags=re.M).replace("\t", "  ").strip()

    whole = {"name": "all" if modules else "", "cddl": tidy([t for _, _, t in blocks])}
    return [whole] + [{"name": m, "cddl": tidy([t for names, shared, t in blocks if shared or m in names])} for m in modules]


def _list(text: str, sep: str = "|") -> list[str]:
    return [squash(x) for x in text.split(sep) if squash(x)]


# Elements that prose keeps, and the attributes they keep beside the link.
PROSE_TAGS = frozenset("blockquote dd div dl dt figcaption figure hr li ol p pre ul a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr".split())
PROSE_ATTRIBUTES = ("dir", "lang", "title")
#: Attributes by which a document takes part in the model of definitions (fixed value).
MODEL = ("data-dfn-type", "data-dfn-for", "data-export", "data-noexport")
#: A definition that is a link as a whole is one all the same if it leads here (fixed value).
LINKED_TERM = "https://www.w3.org/TR/CSS2/syndata.html#vendor-keywords"


def prose_html(page: Page, node: Node) -> str:
    """The markup of a definition in prose: plain grouping and text elements only, links made absolute."""

    def attributes(n: Node) -> dict[str, str]:
        return {k: page.resolve(n) if k == "href" else v for k, v in n.attrs.items() if k == "href" or k in PROSE_ATTRIBUTES}

    inside = page.is_informative(node)
    return inner_html(node, lambda n: n.tag not in PROSE_TAGS or page.is_informative(n) and not inside, attributes)


def _place(node: Node) -> str:
    """Where a definition stands: the nearest term, block, table, heading, note or example, else prose."""
    for n in node.up():
        if n.tag in ("dt", "pre", "table"):
            return n.tag
        if n.tag in HEADINGS:
            return "heading"
        if n.tag and "note" in n.classes:
            return "note"
        if n.tag and "example" in n.classes:
            return "example"
    return "prose"


def definition(page: Page, node: Node, own_model: bool) -> dict[str, Any]:
    """One definition. ``own_model``: the document marks its definitions' types and exports itself."""
    text = squash(node.text(lambda n: "secno" in n.classes))
    terms = [squash(x) for x in node.attrs["data-lt"].split("|")] if "data-lt" in node.attrs else [text]
    kind = node.attrs.get("data-dfn-type") or "dfn"
    if kind == "idl":
        kind = "method" if terms[0].endswith(")") else "attribute"
    scope = node.attrs.get("data-dfn-for", "")
    typed = "data-dfn-type" in node.attrs and kind != "dfn" and not kind.startswith("cddl-")
    exported = "data-export" in node.attrs or typed and "data-noexport" not in node.attrs
    href = page.absolute(node)
    out = {
        "id": node.attrs["id"], "href": href, "linkingText": terms, "localLinkingText": _list(node.attrs.get("data-local-lt", "")), "type": kind, "for": [squash(p) for p in _FOR.split(scope)] if scope else [],
        "access": "public" if not own_model or exported else "private", "informative": page.is_informative(node), "heading": page.headings_by_id.get(href) or {"href": page.base(node), "title": title(page)}, "definedIn": _place(node), "links": [],
    }
    prose = page.prose.get(f"#{node.attrs['id']}")
    html = prose_html(page, prose) if prose is not None else ""
    return out | ({"htmlProse": html} if html else {})


def dfns(page: Page) -> list[dict[str, Any]]:
    """Definitions; of public ones with the same type, texts and scope the first counts. Developer notes link to the definition they explain."""
    page = page.prepared
    nodes = []
    for n in page.doc.walk():
        marked = n.tag == "dfn" or n.tag in HEADINGS[1:] and any(a in n.attrs for a in (*MODEL, "data-lt"))
        if marked and n.attrs.get("id") and n.attrs.get("data-lt") != "":
            nodes.append(n)
    own_model = any(a in n.attrs for n in nodes for a in MODEL)

    def outside(n: Node) -> bool:
        """Whether the whole term is a link to another document, and so only imported."""
        link = next((x for x in (*n.walk(), *n.up()) if x.tag == "a" and x.attrs.get("href", "").startswith("http")), None)
        return link is not None and n.text().strip() == link.text().strip() and page.resolve(link) != LINKED_TERM

    out, seen = [], set()
    for n in nodes:
        if (n.attrs.get("data-dfn-type") or "dfn") not in DFN_TYPES | {"idl"} or any(a.tag == "del" or "exclude" in a.classes for a in n.up() if a.tag) or outside(n):
            continue
        d = definition(page, n, own_model)
        key = (d["type"], frozenset(d["linkingText"]), frozenset(d["for"]))
        if d["access"] == "public":
            if key in seen:
                continue
            seen.add(key)
        out.append(d)
    by_href: dict[str, dict] = {}
    for d in out:
        by_href.setdefault(d["href"], d)
    for dt in page.doc.select(".domintro dt"):
        if dt.first("dfn") is not None:
            continue
        for a in dt.select("a[id]"):
            d = by_href.get(page.absolute(a, "href"))
            if d is not None:
                href = page.absolute(a)
                d["links"].append({"type": "dev", "id": a.attrs["id"], "name": squash(dt.text()), "href": href, "heading": page.headings_by_id.get(href) or {"href": page.base(a), "title": title(page)}})
    return out


#: Headings of lists that look like an element's summary but are none (fixed values).
NO_ELEMENTS = re.compile("Core concepts|Common behaviours", re.I)


def _labelled(box: Node, label_tag: str, value_tag: str, label: str) -> Node | None:
    """The value beside the last label of a text."""
    found = None
    for n in box.select(label_tag):
        if squash(n.text()).removesuffix(":") == label:
            own = n.parent.elements()
            found = next((x for x in own[own.index(n) + 1 :] if x.tag == value_tag), None)
    return found


def elements(page: Page) -> list[dict[str, Any]]:
    """Markup elements: from lists below their headings, else from summaries and tables, else from definitions of type element."""
    out: list[dict[str, Any]] = []

    def put(name: str, dfn: Node | None, iface: str | None) -> None:
        href = {"href": page.absolute(dfn)} if dfn is not None and dfn.attrs.get("id") else {}
        out.append({"name": name} | href | ({"interface": iface} if iface else {}))

    for dl in page.doc.select("dl.element"):
        head = next((n for n in reversed(dl.siblings_before()) if n.tag in HEADINGS), None)
        if head is None:
            raise ValueError("no heading above the summary of an element")
        names = head.select("dfn")
        if not names and not NO_ELEMENTS.search(squash(head.text())):
            raise ValueError(f"no definition in the heading {squash(head.text())!r}")
        dd = _labelled(dl, "dt", "dd", "DOM interface")
        iface = None
        if dd is not None:
            link = dd.first("dfn[data-dfn-type=interface], a[data-link-type=idl]")
            uses = re.match(r"Uses? (.*?)[,.\s]", dd.text())
            if link is None and uses is None:
                raise ValueError(f"no interface in {squash(dd.text())!r}")
            iface = link.text().strip() if link is not None else uses[1]
        for n in names:
            put(squash(n.text()), n, iface)
    if out:
        return out
    for box in page.doc.select("div.element-summary"):
        name = box.first(".element-name")
        if name is None:
            raise ValueError("a summary without the name of an element")
        dfn = box.first("dfn") or (box.parent if box.parent is not None and box.parent.attrs.get("id") else next((n for n in reversed(box.siblings_before()) if n.tag in HEADINGS), None))
        dd = _labelled(box, "dt", "dd", "DOM Interfaces")
        put(squash(name.text()).translate({8216: None, 8217: None}), dfn, squash(dd.text()) if dd is not None else None)
    for box in page.doc.select("table.definition-table"):
        dfn = box.first("dfn")
        if dfn is None:
            raise ValueError("a table without the definition of an element")
        td = _labelled(box, "th", "td", "DOM Interfaces")
        put(squash(dfn.text()), dfn, squash(td.text()) if td is not None else None)
    if out:
        return out
    interfaces: dict[str, list[str]] = {}
    for n in page.doc.select("dfn[data-dfn-type=interface]"):
        interfaces.setdefault(n.text().strip().lower(), []).append(n.text().strip())
    for n in page.doc.select("dfn[data-dfn-type=element]"):
        name = n.text().strip()
        known = ["MathMLElement"] if page.spec.get("shortname") == "mathml-core" else interfaces.get(f"html{name}element", [])
        put(name, n, known[0] if len(known) == 1 else None)
    return out


def outline(page: Page) -> list[dict[str, Any]]:
    """Sections with their depth and heading, in document order."""
    page.sections
    out: list[dict[str, Any]] = []
    todo = [(page.outline_root, 0)]
    while todo:
        section, depth = todo.pop()
        head = section.heading
        out.append({"depth": depth, "title": page.clean_text(head) if head is not None else None, "level": section.level or None})
        todo.extend((c, depth + 1) for c in reversed(section.children))
    return out
