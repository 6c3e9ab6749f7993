"""A small document tree with selectors, built on the standard HTML tokenizer.

Covers what rendered specifications need: void and raw-text elements, end tags
that may be left out, stray and mis-nested end tags. Nodes carry pre- and
post-order numbers, so containment is a comparison of intervals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset("tr tbody thead tfoot".split()), "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": {"html"}}
CONTAINERS = frozenset("article aside blockquote body button dd details div dl dt fieldset figure footer form header li main nav ol section table td th tr ul".split())
BLANKS = re.compile("[\t\n\x0b\f\r    -     　﻿]+")


def squash(text: str) -> str:
    """Blanks trimmed, runs of them made one."""
    return BLANKS.sub(" ", text).strip(" ")


class Node:
    """An element (tag, attrs, children) or a text (tag None, data)."""

    __slots__ = ("tag", "attrs", "children", "parent", "data", "pre", "post")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, data: str = "") -> None:
        self.tag, self.attrs, self.children, self.parent, self.data, self.pre, self.post = tag, attrs or {}, [], None, data, 0, 0

    def wrap(self, tag: str) -> Node:
        """A new element that takes all children and stands in their place."""
        inner = Node(tag)
        for c in self.children:
            inner.add(c)
        self.children = []
        self.add(inner)
        return inner

    def replace(self, other: Node) -> None:
        """Put another node in this one's place."""
        if self.parent is not None:
            self.parent.children[self.parent.children.index(self)] = other
            other.parent = self.parent

    def add(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag]

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        todo = self.elements()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if c.tag)

    def text(self, skip: Callable[[Node], bool] | None = None) -> str:
        out: list[str] = []
        todo = [self]
        while todo:
            node = todo.pop()
            if node.tag is None:
                out.append(node.data)
            elif skip is None or node is self or not skip(node):
                todo.extend(reversed(node.children))
        return "".join(out)

    def up(self) -> Iterator[Node]:
        """The node itself and its ancestors."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def contains(self, other: Node) -> bool:
        return self.pre <= other.pre and other.post <= self.post

    def siblings_before(self) -> list[Node]:
        own = self.parent.elements() if self.parent else []
        return own[: own.index(self)] if self in own else []

    def next_element(self) -> Node | None:
        own = self.parent.elements() if self.parent else []
        at = own.index(self) + 1
        return own[at] if at < len(own) else None

    def matches(self, selector: str) -> bool:
        return any(_fits(self, chain) for chain in parse_selector(selector))

    def closest(self, selector: str) -> Node | None:
        return next((n for n in self.up() if n.tag and n.matches(selector)), None)

    def select(self, selector: str) -> list[Node]:
        chains = parse_selector(selector)
        return [n for n in self.walk() if any(_fits(n, c, self) for c in chains)]

    def first(self, selector: str) -> Node | None:
        chains = parse_selector(selector)
        return next((n for n in self.walk() if any(_fits(n, c, self) for c in chains)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        scope = SCOPES.get(tag, CONTAINERS)
        k = len(self.open) - 1
        while k > 0:
            name = self.open[k].tag
            if tag in CLOSED_BY.get(name, ()):
                del self.open[k:]
                k = len(self.open)
            elif name in scope:
                break
            k -= 1
        node = Node(tag, {k: (v or "") for k, v in reversed(attrs)})
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        last = self.open[-1]
        if last.children and last.children[-1].tag is None:
            last.children[-1].data += data
        else:
            last.add(Node(None, data=data))


def number(root: Node) -> Node:
    """Give the nodes of a tree their pre- and post-order numbers."""
    count = 0
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        count += 1
        if done:
            node.post = count
            continue
        node.pre = count
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children))
    return root


def parse_html(html: str) -> Node:
    """The document of a text, with pre- and post-order numbers."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return number(builder.root)


def quoted(value: str) -> str:
    """An attribute's value as it stands between quotation marks."""
    return value.replace("&", "&amp;").replace('"', "&quot;")


def inner_html(node: Node, skip: Callable[[Node], bool] | None = None, attributes: Callable[[Node], dict[str, str]] | None = None) -> str:
    """The markup of what a node holds, without skipped elements and with the attributes that ``attributes`` gives."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag is None:
            out.append(x.data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\u00a0", "&nbsp;"))
        elif skip is None or not skip(x):
            attrs = x.attrs if attributes is None else attributes(x)
            written = "".join(f' {k}="{quoted(v)}"' for k, v in attrs.items())
            out.append(f"<{x.tag}{written}>")
            if x.tag not in VOID:
                todo.append(f"</{x.tag}>")
                todo.extend(reversed(x.children))
    return "".join(out).strip()


_PART = re.compile(
    r"""\s*(?P<comb>[>+~,])\s*|(?P<desc>\s+)|(?P<tag>[a-zA-Z*][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^\]\s]+))\s*(?P<i>i)?\s*)?\]|:(?P<pseudo>[\w-]+)(?P<arg>\()?"""
)


@lru_cache(maxsize=2000)
def parse_selector(selector: str) -> tuple:
    """A selector list as chains of (combinator, tests), read from the right."""
    chains, chain, tests, comb, at = [], [], [], " ", 0
    selector = selector.strip()
    while at < len(selector):
        m = _PART.match(selector, at)
        if not m:
            raise ValueError(f"selector {selector!r} at {at}")
        at = m.end()
        if m["comb"] or m["desc"]:
            c = m["comb"] or " "
            if tests:
                chain.append((comb, tuple(tests)))
                tests = []
            comb = c
            if c == ",":
                chains.append(tuple(chain))
                chain, comb = [], " "
        elif m["tag"]:
            if m["tag"] != "*":
                tests.append(("tag", m["tag"].lower()))
            else:
                tests.append(("any",))
        elif m["id"]:
            tests.append(("attr", "id", "=", m["id"]))
        elif m["cls"]:
            tests.append(("class", m["cls"]))
        elif m["attr"]:
            tests.append(("attr", m["attr"].lower(), m["op"], next((x for x in (m["q"], m["s"], m["v"]) if x is not None), None)))
        else:
            arg = None
            if m["arg"]:
                depth, start = 1, at
                while depth:
                    depth += {"(": 1, ")": -1}.get(selector[at], 0)
                    at += 1
                arg = selector[start : at - 1]
            tests.append(("pseudo", m["pseudo"], arg))
    if tests:
        chain.append((comb, tuple(tests)))
    if chain:
        chains.append(tuple(chain))
    return tuple(chains)


def _test(node: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "any":
        return True
    if kind == "tag":
        return node.tag == test[1]
    if kind == "class":
        return test[1] in node.classes
    if kind == "attr":
        value, (_, name, op, want) = node.attrs.get(test[1]), test
        if value is None:
            return False
        return {None: True, "=": value == want, "^=": bool(want) and value.startswith(want or ""), "$=": bool(want) and value.endswith(want or ""), "*=": bool(want) and (want or "") in value, "~=": want in value.split(), "|=": value == want or value.startswith(f"{want}-")}[op]
    _, name, arg = test
    if name == "not":
        return not node.matches(arg)
    if name in ("is", "where"):
        return node.matches(arg)
    if name == "has":
        if arg.lstrip().startswith(">"):
            return any(c.matches(arg.lstrip()[1:]) for c in node.elements())
        return node.first(arg) is not None
    own = node.parent.elements() if node.parent else [node]
    if name == "first-child":
        return own[0] is node
    if name == "last-child":
        return own[-1] is node
    if name == "nth-child":
        return own.index(node) + 1 == int(arg)
    raise ValueError(f"pseudo-class {name}")


def _fits(node: Node, chain: tuple, scope: Node | None = None) -> bool:
    comb, tests = chain[-1]
    if not node.tag or node.tag == "#document" or not all(_test(node, t) for t in tests):
        return False
    rest = chain[:-1]
    if not rest:
        return comb != ">" or scope is None or node.parent is scope
    if comb == ">":
        return node.parent is not None and _fits(node.parent, rest, scope)
    if comb in "+~":
        before = node.siblings_before()
        return any(_fits(b, rest, scope) for b in (before[-1:] if comb == "+" else before))
    return any(_fits(a, rest, scope) for a in list(node.up())[1:])
