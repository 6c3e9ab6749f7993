"""Events of a document: from tables, prose, handlers in interface definitions and marked-up definitions."""

from __future__ import annotations

import re
from typing import Any

from specstrata.extract.dom import Node, squash
from specstrata.extract.modules import HEADINGS, Page, idl
from specstrata.extract.webidl import IdlError, parse_idl

# The concepts that firing an event links to.
FIRING = frozenset([
    "https://dom.spec.whatwg.org/#concept-event-fire",
    "https://w3c.github.io/ServiceWorker/#fire-functional-event",
    "https://www.w3.org/TR/service-workers-1/#fire-functional-event-algorithm",
    "https://www.w3.org/TR/service-workers-1/#fire-functional-event",
    "https://www.w3.org/TR/service-workers/#fire-functional-event-algorithm",
    "https://www.w3.org/TR/service-workers/#fire-functional-event",
    "https://w3c.github.io/pointerevents/#dfn-fire-a-pointer-event",
])
# Words that stand for an event's name, and what a way of firing says of the interface.
PLACEHOLDERS = frozenset(["eventName", "type", "e", "event", "name"])
PHRASES = (
    (re.compile(r"fir(?:e|ing)\s+an\s+event\s+named\s+\"?([a-z]+)", re.I), "Event"),
    (re.compile(r"fir(?:e|ing)\s+a\s+pointer\s+event\s+named\s+\"?([a-z]+)", re.I), "PointerEvent"),
    (re.compile(r"fir(?:e|ing)\sa?\s*functional\s+event\s+(?:(?:named|given)\s+)?\"?([a-z]+)", re.I), "ExtendableEvent"),
)
_INTERFACE = re.compile(r"^([A-Z]+[a-z0-9]*)+Event$")


def _annotation(n: Node) -> bool:
    return n.tag == "aside" or "mdn-anno" in n.classes


def _plain(node: Node) -> str:
    return node.text(_annotation).strip()


def _words(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


class _Events:
    """The events found so far and what decides whether another one is the same."""

    def __init__(self, page: Page) -> None:
        self.page = page
        self.found: list[dict[str, Any]] = []
        self.structured = False
        self.handlers: dict[str, list[str]] = {}
        try:
            for d in parse_idl(idl(page)):
                if d["type"] in ("interface", "interface mixin"):
                    for m in d["members"]:
                        if m["type"] == "attribute" and m["idlType"].get("name") == "EventHandler" and m["name"].startswith("on"):
                            self.handlers.setdefault(m["name"][2:], []).append(d["name"])
        except IdlError:
            self.handlers = {}

    def anchor(self, node: Node | None) -> str | None:
        """The URL of the nearest element with an id."""
        own = next((n for n in node.up() if n.attrs.get("id")), None) if node is not None else None
        return self.page.absolute(own) if own is not None else None

    def targets(self, node: Node | None) -> list[str] | None:
        """The interfaces an element that names an event says it goes to."""
        if node is None:
            return None
        scope = node.attrs.get("data-dfn-for") or node.attrs.get("data-link-for")
        if not scope and node.attrs.get("href", "").startswith("#"):
            dfn = self.page.by_id.get(node.attrs["href"][1:])
            return _words(dfn.attrs["data-dfn-for"]) if dfn is not None and dfn.attrs.get("data-dfn-for") else None
        if scope:
            return _words(scope)
        known = self.handlers.get(node.text(), [])
        return list(known) if len(known) == 1 else None

    def same(self, event: dict[str, Any]) -> dict[str, Any] | None:
        """The first event found that ``event`` is: of one type, and with one anchor, the same targets, or known from an event table."""

        def alike(other: dict[str, Any]) -> bool:
            a, b = event.get("targets"), other.get("targets")
            return bool(event.get("href")) and event["href"] == other.get("href") or (sorted(a) if a is not None else None) == (sorted(b) if b is not None else None) or other["src"]["format"] == "event table"

        return next((o for o in self.found if o["type"] == event["type"] and alike(o)), None)

    def summary_table(self, table: Node, heads: list[str]) -> None:
        col = {}
        for name, pattern in (("bubbles", r"^bubbl"), ("cancelable", r"^cancel"), ("interface", r"^(dom )?interface"), ("targets", r"target")):
            col[name] = next((k for k, h in enumerate(heads) if re.search(pattern, h, re.I)), None)
        for tr in table.select("tr"):
            cells = tr.elements()
            if not cells or all(c.tag == "th" for c in cells) or tr.parent is not None and tr.parent.tag == "thead":
                continue
            cell = cells[0]
            named = [n for n in cell.walk() if not any(_annotation(a) for a in n.up())]
            el = next((n for n in named if n.tag in ("dfn", "a")), None) or next((n for n in named if n.tag == "code"), None)
            if el is None:
                continue
            event: dict[str, Any] = {"type": _plain(cell), "src": {"format": "summary table", "href": self.anchor(el)}}
            if el.tag == "dfn" and el.attrs.get("id"):
                event["href"] = self.page.absolute(el)
            elif el.tag == "a":
                href = el.attrs.get("href", "")
                target = self.page.by_id.get(href.partition("#")[2])
                event["href"] = href if href.startswith("https://") else self.page.absolute(target) if target is not None else None
            event["targets"] = self.targets(next((n for n in named if n.tag == "dfn" or n.tag == "a" and n.attrs.get("href", "").startswith("#")), None))
            at = {name: cells[k] for name, k in col.items() if k is not None and k < len(cells)}
            if "bubbles" in at:
                event["bubbles"] = at["bubbles"].text().strip() == "Yes"
            if "cancelable" in at:
                event["cancelable"] = bool(re.search("yes|✓|varies", at["cancelable"].text(), re.I))
            if "interface" in at:
                name = at["interface"].first("a") or at["interface"].first("code")
                event["interface"] = name.text() if name is not None else None
            if "targets" in at and not event["targets"]:
                event["targets"] = _words(at["targets"].text())
            self.found.append(event)

    def side_table(self, table: Node) -> None:
        """A table whose first column names the properties of one event."""
        rows = {squash(th.text()): tr.first("td") for tr in table.select("tr") if (th := tr.first("th")) is not None}
        if "Bubbles" not in rows:
            return

        def cell(pattern: str) -> str | None:
            return next((td.text().strip() for name, td in rows.items() if td is not None and re.search(pattern, name, re.I)), None)

        if name := cell("^type"):
            own = self.anchor(table)
            flags = {k: None if cell(f"^{k}$") is None else cell(f"^{k}$") == "Yes" for k in ("bubbles", "cancelable")}
            self.found.append({"type": name, "interface": cell("^interface"), **flags, "src": {"format": "css definition table", "href": own}, "href": own})

    def event_table(self, table: Node) -> None:
        event: dict[str, Any] = {"src": {"format": "event table", "href": self.anchor(table)}}
        for tr in table.select("tr"):
            head, value = tr.first("th"), tr.first("td")
            if head is None or value is None:
                continue
            name, text = head.text().strip().lower(), value.text().strip()
            if name in ("type", "interface"):
                event[name] = text
            elif name in ("targets", "trusted targets"):
                event["targets"] = _words(text)
            elif name in ("bubbles", "cancelable"):
                event[name] = text.lower() == "yes"
        if event.get("type") and self.same(event) is None:
            self.found.append(event)

    def fires(self, a: Node) -> bool:
        return a.tag == "a" and self.page.resolve(a) in FIRING

    def firing(self, a: Node) -> None:
        """An event fired in prose: the text from the link to the next such link beside it, or to the end of what holds both."""
        around = a.parent.children
        rest = around[around.index(a) + 1 :]
        stop = next((k for k, n in enumerate(rest) if n.tag and self.fires(n)), len(rest))
        rest = [n for n in rest[:stop] if not (n.tag and _annotation(n))]
        text = a.text() + "".join(n.data if n.tag is None else n.text(_annotation) for n in rest)
        name, iface = next(((m[1], iface) for pattern, iface in PHRASES if (m := pattern.search(text))), (None, None))
        if name is None or name in PLACEHOLDERS:
            return
        own = self.anchor(a)
        event: dict[str, Any] = {"type": name, "src": {"format": "fire an event phrasing", "href": own}, "href": own}
        beside = a.next_element()
        if beside is not None and beside.text().strip() == name:
            el = beside.first("a,dfn") or beside
            if el.tag == "a" and el.attrs.get("href"):
                event["href"] = self.page.resolve(el)
            elif el.tag == "dfn" and el.attrs.get("id"):
                event["href"] = self.page.absolute(el)
            event["targets"] = self.targets(el)
        old = self.same(event)
        event = event if old is None else old
        if not event.get("interface"):
            event["interface"] = next((n.text().strip() for n in rest if n.tag and _INTERFACE.match(n.text())), iface)
        for flag, value in self.flags(text).items():
            if event.get(flag) is None:
                event[flag] = value
        if old is None:
            self.found.append(event)

    @staticmethod
    def flags(text: str) -> dict[str, bool]:
        """What a sentence says of bubbling and cancelling."""
        said = True if "true" in text else False if "false" in text else None
        out: dict[str, bool | None] = {}
        if "bubbles and cancelable attributes" in text and said is not None:
            return {"bubbles": said, "cancelable": said}
        if "bubbles attribute" in text:
            out["bubbles"] = said
        elif "bubbles" in text or "bubbling" in text:
            out["bubbles"] = True
        elif "not bubble" in text:
            out["bubbles"] = False
        if "cancelable attribute" in text:
            out["cancelable"] = said
        elif "not cancelable" in text or "not be cancelable" in text:
            out["cancelable"] = False
        elif "cancelable" in text:
            out["cancelable"] = True
        return {k: v for k, v in out.items() if v is not None}

    def handled(self) -> None:
        """Handlers in interface definitions: new events, or the targets of the one event of that name."""
        body = self.page.doc.first("body")
        for name, interfaces in self.handlers.items():
            known = [e for e in self.found if e["type"] == name]
            if not known and not self.structured:
                src = {"format": "IDL eventHandler", "href": self.page.absolute(body) if body is not None and body.attrs.get("id") else None}
                self.found += [{"type": name, "targets": [i], "interface": None, "src": dict(src)} for i in interfaces]
            elif len(known) == 1 and known[0].get("targets") is None:
                known[0]["targets"] = list(interfaces)

    def defined(self, dfn: Node) -> None:
        event: dict[str, Any] = {"type": dfn.text().strip(), "targets": self.targets(dfn), "src": {"format": "dfn", "href": self.anchor(dfn)}, "href": self.page.absolute(dfn) if dfn.attrs.get("id") else None}
        said: dict[str, Any] = {}
        term = dfn.parent
        if term is not None and term.tag == "dt":
            dd = term.next_element()
            for li in dd.select("li") if dd is not None else []:
                for flag in ("Bubbles", "Cancelable"):
                    if li.text().startswith(f"{flag}:"):
                        said.setdefault(flag.lower(), bool(re.search("yes", li.text(), re.I)))
            before = [term.parent, *reversed(term.parent.siblings_before())] if term.parent is not None else []
            head = next((n for n in before if n.tag in HEADINGS), None)
            code = head.first("code") if head is not None else None
            if code is not None and re.fullmatch("[A-Z][a-z]+Event", code.text()):
                said["interface"] = code.text()
        old = self.same(event)
        if old is None:
            self.found.append(event | said)
        else:
            old |= said
            if not old.get("href") and event["href"]:
                old["href"] = event["href"]


def events(page: Page) -> list[dict[str, Any]]:
    """Events in the order found: summary tables, definition tables, firing in prose, handlers, definitions of type event."""
    all_ = _Events(page)
    if page.spec.get("shortname") != "dom":
        for table in page.doc.select("table"):
            row = next((tr for tr in table.select("tr") if tr.first("th") is not None), None)
            heads = [squash(c.text()) for c in row.elements()] if row is not None and all(c.tag == "th" for c in row.elements()) else []
            if heads and heads[0].startswith("Event") and heads[0] != "Event handler":
                all_.structured = True
                all_.summary_table(table, heads)
            elif table.classes == ["def"]:
                all_.side_table(table)
    for table in page.doc.select("table.event-definition"):
        all_.event_table(table)
    for a in page.doc.select("a[href]"):
        if not page.is_informative(a) and all_.fires(a):
            all_.firing(a)
    all_.handled()
    for dfn in page.doc.select("dfn[data-dfn-type=event]"):
        all_.defined(dfn)
    own = page.spec.get("url") or ""
    out = []
    for e in all_.found:
        e["src"] = {k: v for k, v in e["src"].items() if v}
        e = {k: v for k, v in e.items() if v is not None}
        out.append(e | ({"isExtension": True} if e.get("href") and not e["href"].startswith(own) else {}))
    return out
