"""Links from the parts of interface definitions to the documents' definitions of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specstrata.extract.webidl import IdlError, idl_report, member_names

# The definition types of the parts of interface definitions.
DEFINITION_TYPES = {"interface mixin": "interface", "callback interface": "callback"}
MEMBER_TYPES = {"operation": "method", "constructor": "constructor", "attribute": "attribute", "const": "const", "field": "dict-member"}


def idl_parts(text: str) -> list[tuple[str, str | None, int, str, list[str]]]:
    """(definition, member or None, position, definition type, texts to try in order) of every part that can be linked.

    Of a partial definition only the members can. A text with an error has no parts.
    """
    try:
        report = idl_report(text)
    except IdlError:
        return []
    out = []
    for name, partial, d in [(n, False, d) for n, d in report.idl_names.items()] + [(n, True, d) for n, ds in report.extended.items() for d in ds if d["type"] != "includes"]:
        if not partial:
            out.append((name, None, -1, DEFINITION_TYPES.get(d["type"], d["type"]), [name]))
        seen: dict[str, int] = defaultdict(int)
        for k, m in enumerate(d.get("members", ())):
            kind = MEMBER_TYPES.get(m["type"])
            label = "constructor" if m["type"] == "constructor" else m.get("name", "")
            if kind:
                names = member_names(m, seen[label])
                seen[label] += m["type"] in ("operation", "constructor")
                if names:
                    out.append((name, label, k, kind, names))
        for k, value in enumerate(d.get("values", ())):
            out.append((name, value, k, "enum-value", [value, f'"{value}"']))
    return out


def linked_parts(texts: DataFrame, definitions: DataFrame) -> DataFrame:
    """spec, definition, member, pos, href: parts of each spec's interface definitions with the definition they link to.

    texts: spec, idl. definitions: spec, linking_text, dfn_type, dfn_for, href.
    The first text with a definition of the right type (and, for a member, in
    the scope of its parent) decides: one such definition gives the link,
    several give none. One equi-join on spec, type and text.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(spec, *part[:4], k, n) for spec, text in zip(pdf["spec"], pdf["idl"]) if text for part in idl_parts(text) for k, n in enumerate(part[4])]
            yield pd.DataFrame(rows, columns=["spec", "definition", "member", "pos", "type", "rank", "name"])

    wanted = texts.select("spec", "idl").mapInPandas(scan, "spec string, definition string, member string, pos int, type string, rank int, name string")
    known = definitions.select("spec", F.explode("linking_text").alias("name"), F.col("dfn_type").alias("type"), F.coalesce("dfn_for", F.array().cast("array<string>")).alias("_for"), "href").distinct()
    hits = wanted.join(known, ["spec", "type", "name"]).where("member is null or array_contains(_for, definition)")
    part = ["spec", "definition", "member", "pos"]
    by_rank = hits.groupBy(*part, "rank").agg(F.count_distinct("href").alias("n"), F.min("href").alias("href"))
    best = by_rank.groupBy(*part).agg(F.min_by(F.when(F.col("n") == 1, F.col("href")), "rank").alias("href"))
    every = wanted.select(*part).distinct()
    on = [every[c].eqNullSafe(best[c]) for c in part]
    return every.join(best, on[0] & on[1] & on[2] & on[3], "left").select(*[every[c] for c in part], best["href"])


def expected_parts(text: str) -> list[tuple[str, str, str | None]]:
    """(term, definition type, scope) of every part of interface definitions that a document should define; of a partial definition only the members.

    Listings of values, texts and accessors without a name have no definition
    of their own, nor have constructors of elements; a text with an error
    expects none.
    """
    try:
        report = idl_report(text)
    except IdlError:
        return []
    out: list[tuple[str, str, str | None]] = []
    for partial, d in [(False, d) for d in report.idl_names.values()] + [(True, d) for ds in report.extended.values() for d in ds if d["type"] != "includes"]:
        name = d["name"]
        if not partial:
            out.append((name, DEFINITION_TYPES.get(d["type"], d["type"]), None))
        for m in d.get("members", ()):
            kind, label = MEMBER_TYPES.get(m["type"]), m.get("name", "")
            args = ", ".join(("..." if a["variadic"] else "") + a["name"] for a in m.get("arguments", ()))
            default = label == "toJSON" and any(a["name"] == "Default" for a in m["extAttrs"])
            if m.get("special") == "stringifier":
                out.append(("stringification behavior", "dfn", name))
            elif kind == "constructor":
                if not name.startswith("HTML"):
                    out.append((f"constructor({args})", kind, name))
            elif kind == "method":
                if label and not default:
                    out.append((f"{label}({args})", kind, name))
            elif kind:
                out.append((label, kind, name))
        out += [(f'"{v}"', "enum-value", name) for v in d.get("values", ())]
    return out


def expected_idl_definitions(texts: DataFrame) -> DataFrame:
    """spec, term, type, scope: what the interface definitions (spec, idl) of each document want defined."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(spec, *part) for spec, text in zip(pdf["spec"], pdf["idl"]) if text for part in expected_parts(text)], columns=["spec", "term", "type", "scope"])

    return texts.select("spec", "idl").mapInPandas(scan, "spec string, term string, type string, scope string").distinct()


def mixin_users(texts: DataFrame) -> DataFrame:
    """mixin, interface: which interfaces the interface definitions (idl) of a corpus say include which mixins."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["idl"]:
                try:
                    rows += [(d["includes"], d["target"]) for ds in idl_report(text or "").extended.values() for d in ds if d["type"] == "includes"]
                except IdlError:
                    continue
            yield pd.DataFrame(rows, columns=["mixin", "interface"])

    return texts.select("idl").mapInPandas(scan, "mixin string, interface string").distinct()
