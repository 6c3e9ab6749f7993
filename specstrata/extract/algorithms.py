"""Algorithms of a document: lists of steps, with their name, introduction and nested steps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from specstrata.extract.dom import Node, inner_html, squash
from specstrata.extract.modules import _FOR, HEADINGS, Page

# Verbs and words that begin the steps of an algorithm.
STEP_VERBS = (
    "abort acknowledge activate add adopt advance append apply ask assert assign attach attempt batch block branch call check cancel cause change choose clamp clean clear close collect complete compute consume continue convert copy create "
    "deactivate decrease decrement decrypt define delete dequeue destroy determine discard dismiss dispatch display down-mix do dump emit empty end enqueue ensure error establish execute extend extract fail fetch finalize find finish fire "
    "gather generate give handle hand-off increase increment initialize insert interpret invoke issue jump let load make mark match move multiply navigate paint parse perform place pop populate prepare prepend process prompt push query queue "
    "recalculate rectify reference register reinitialize reject release remove replace reset resolve restore render remap report return run score scroll send serialize set shuffle skip sort split spin start stop store strip suspend switch "
    "take terminate throw trap try undisplay unset up-mix update upgrade use validate verify visit wait for if while"
).split()
# Words anywhere in a step that tell of an algorithm, and patterns that do.
STEP_PHRASES = ("abort all these steps", "abort these steps", "fire a simple event", "fire an event", "in parallel", "reject", "resolve", "run the following steps", "run these steps", "terminate these steps")
STEP_PATTERNS = ((r"queue a( \w+)? task", "i"), ("^⌛", ""), (r"^otherwise(\,| )", "i"))
_first_word = re.compile(rf"({'|'.join(sorted(map(re.escape, dict.fromkeys(STEP_VERBS)), key=len, reverse=True))})[.: ]")
_patterns = [(re.compile(p), f"/{p}/{flags}") for p, flags in STEP_PATTERNS]
_DEFINING = ("dfn", *(f"{h}[data-dfn-type]" for h in HEADINGS[1:]))


@dataclass
class Found:
    """A list of steps, why it counts as one (None if it does not), and the paragraph that introduces it."""

    root: Node
    why: str | None
    intro: Node | None = None


def _up(node: Node, tags: tuple[str, ...] = (), cls: str | None = None) -> Node | None:
    return next((n for n in node.up() if n.tag and (n.tag in tags or cls is not None and cls in n.classes)), None)


def _text(page: Page, node: Node) -> str:
    inside = page.is_informative(node)
    return squash(node.text(lambda n: page.is_informative(n) and not inside))


def _html(page: Page, node: Node, stop: Node | None = None) -> str:
    """The markup of a step or introduction without its lists of steps (and without what begins at ``stop``), links made absolute."""
    inside = page.is_informative(node)

    def attributes(n: Node) -> dict[str, str]:
        return {k: page.resolve(n, k) if k in ("href", "src") and not v.startswith("http") else v for k, v in n.attrs.items()}

    held = node
    if stop is not None:
        held = Node("div")
        held.children = node.children[: node.children.index(stop)]
    return inner_html(held, lambda n: n.tag == "ol" or page.is_informative(n) and not inside, attributes)


def rationale(page: Page, ol: Node) -> str | None:
    """What tells that a list is one of steps: its class, or the first of its items that begins like a step or says so."""
    if "algorithm" in ol.classes:
        return ".algorithm"
    for li in ol.select("li"):
        text = _text(page, li).lower()
        if m := _first_word.match(text):
            return m[1]
        if phrase := next((p for p in STEP_PHRASES if p in text), None):
            return phrase
        if pattern := next((name for p, name in _patterns if p.search(text)), None):
            return pattern
    return None


def _intro(root: Node, page: Page) -> Node | None:
    """The paragraph of the nearest definition in the same item or container, else the last paragraph before the list."""
    box = _up(root, ("li",), "algorithm")
    while box is not None:
        dfn = box.first("dfn")
        if dfn is not None and not root.contains(dfn):
            return _up(dfn, ("p", "div", "li"))
        if box.tag == "li" or box.parent is None:
            break
        box = _up(box.parent, ("li",), "algorithm")
    own = root if root.tag == "p" and not page.is_informative(root) else None
    return own or next((n for n in reversed(root.siblings_before()) if n.tag == "p" and not page.is_informative(n)), None)


def find_algorithms(page: Page, section: Node, with_others: bool = False) -> list[Found]:
    """Outermost lists of steps within a section, in document order; with ``with_others`` also ordered lists that are none."""
    found: dict[int, Found] = {}
    for box in section.select(".algorithm, .switch"):
        if page.is_informative(box):
            continue
        root = box if box.tag in ("dl", "ol") else box.first("ol")
        if root is not None:
            found.setdefault(id(root), Found(root, ".algorithm" if "algorithm" in box.classes else ".switch"))
    marked = [f.root for f in found.values()]
    for ol in section.select("ol"):
        if page.is_informative(ol) or any(a.tag == "nav" or "toc" in a.classes or a.attrs.get("id") == "toc" for a in ol.up() if a.tag) or any(r.contains(ol) for r in marked):
            continue
        why = rationale(page, ol)
        if why is not None or with_others:
            found.setdefault(id(ol), Found(ol, why))
    outer: list[Found] = []
    for f in sorted(found.values(), key=lambda f: f.root.pre):  # containers come before what they contain
        if not outer or not outer[-1].root.contains(f.root):
            outer.append(f)
    for f in outer:
        f.intro = _intro(f.root, page)
    introducing = {id(f.intro) for f in outer}
    for p in section.select("p"):
        dfn = next((n for n in p.select("dfn[data-export]") if n.attrs.get("data-dfn-type") in ("dfn", "abstract-op")), None)
        if dfn is not None and id(p) not in introducing and p.text().startswith("To " + dfn.text()):
            outer.append(Found(p, "To <dfn>", p))
    return sorted(outer, key=lambda f: f.root.pre)


def _name(page: Page, node: Node) -> dict[str, str]:
    """Name and anchor of the first definition in a node, else of its first heading with an id."""
    dfn = node if node.tag == "dfn" else node.first(",".join(_DEFINING))
    if dfn is not None:
        scope = dfn.attrs.get("data-dfn-for")
        term = squash(dfn.attrs["data-lt"].split("|")[0]) if dfn.attrs.get("data-lt") else _text(page, dfn)
        return {"name": (squash(_FOR.split(scope)[0]) + "/" if scope else "") + term} | ({"href": page.absolute(dfn)} if dfn.attrs.get("id") else {})
    head = node.first(",".join(f"{h}[id]" for h in HEADINGS[1:]))
    return {"name": _text(page, head), "href": page.absolute(head)} if head is not None else {}


def _serialize(page: Page, algo: Found, nested: bool) -> dict[str, Any]:
    out: dict[str, Any] = {}
    box = None if nested else _up(algo.root, cls="algorithm")
    while box is not None:
        if box.attrs.get("data-algorithm"):
            scope = box.attrs.get("data-algorithm-for")
            out["name"] = (squash(scope) + "/" if scope else "") + squash(box.attrs["data-algorithm"])
            href = page.absolute(box) if box.attrs.get("id") else _name(page, box).get("href")
            if href:
                out["href"] = href
        else:
            out = _name(page, box)
            if out:
                break
        box = _up(box.parent, cls="algorithm") if box.parent is not None else None

    def named() -> bool:
        return nested or bool(out.get("name") and out.get("href"))

    holder = algo.root.parent
    if algo.intro is not None:
        if not named():
            out = _name(page, algo.intro) | out
        out["html"] = _html(page, algo.intro)
    elif holder is not None and holder.tag in ("li", "dd", "div"):
        if not named():
            before = Node("div")
            before.children = holder.children[: holder.children.index(algo.root)]
            out = _name(page, before) | out
        out["html"] = _html(page, holder, algo.root)
    if not named() and holder is not None and holder.tag == "dd":
        dt = next((n for n in reversed(holder.siblings_before()) if n.tag == "dt"), None)
        if dt is not None:
            out = _name(page, dt) | out
    out["rationale"] = algo.why
    steps = _steps(page, algo.root)
    return out | ({"steps": steps} if steps else {})


def _steps(page: Page, root: Node) -> list[dict[str, Any]]:
    if root.tag == "ol":
        return [_step(page, li) for li in root.elements() if li.tag == "li"]
    if root.tag != "dl":
        return []
    cases = []
    own = root.elements()
    for k, dt in enumerate(own):
        if dt.tag == "dt":
            dd = next((n for n in own[k + 1 :] if n.tag == "dd"), None)
            cases.append({"case": _text(page, dt)} | (_step(page, dd) if dd is not None else {}))
    return [{"operation": "switch", "steps": cases}]


def _step(page: Page, li: Node) -> dict[str, Any]:
    """A step: its first nested algorithm, further ones as additional, and lists that are none as ignored."""
    lists = find_algorithms(page, li, with_others=True)
    algos = [f for f in lists if f.why is not None]
    out = _serialize(page, algos[0], nested=True) if algos else {}
    if not out.get("html"):
        out["html"] = _html(page, li)
    if len(algos) > 1:
        out["additional"] = [_serialize(page, f, nested=True) for f in algos[1:]]
    if ignored := [_text(page, f.root) for f in lists if f.why is None]:
        out["ignored"] = ignored
    return out


def algorithms(page: Page) -> list[dict[str, Any]]:
    """Algorithms in document order; documents made of clauses have their own form, which is not read."""
    if page.doc.first("emu-clause") is not None:
        return []
    return [_serialize(page, f, nested=False) for f in find_algorithms(page, page.doc)]
