"""Nested records to related flat tables, by shared inlining.

A pass over the payloads collects the schema graph: element types and the
fields by which they hold other elements. The driver walks it from the roots,
so it sees as much as the schema has and never what data put into names.
Elements that occur once below one parent are inlined as columns of that
parent; repeated, shared and recursive elements get tables. One further pass
shreds every payload into rows of these tables, each with the record, its own
place, and the table and place of its parent as foreign key.

Every walk through a record keeps its own stack, so nesting may be as deep as
memory allows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specstrata.functions.jsontext import UNREADABLE, clean, held_json, read_json, write_json
from specstrata.session import materialize, table

ROOT = "spec"
WRAPPER = "crawl"
#: An undeclared element with more distinct fields than this that hold elements, over all data, has data for names: it becomes a table of entries.
#: A declared element never does; if it has so many, only its declared fields are elements and its other fields stay JSON texts of the row.
MANY_KEYS = 1000

#: What the crawl format says of its own fields: (element, field) -> repeated or single.
CRAWL_FIELDS = {
    (WRAPPER, "results"): "repeated", (ROOT, "nightly"): "single", (ROOT, "dfns"): "repeated", (ROOT, "refs"): "single", ("nightly", "pages"): "repeated",
    ("dfns", "heading"): "single", ("dfns", "linkingText"): "repeated", ("dfns", "links"): "repeated", ("links", "heading"): "single", ("refs", "informative"): "repeated", ("refs", "normative"): "repeated",
}
ALIASES = {"results": ROOT}
#: Elements the crawl format names; however many fields they have, these are fields and never entries.
DECLARED = {element for element, _ in CRAWL_FIELDS} | {ALIASES.get(name, name) for _, name in CRAWL_FIELDS}
#: Declared elements that are values, not objects.
VALUES = {"pages", "linkingText"}


def entry_of(element: str) -> str:
    """The element an entry of ``element`` makes."""
    return element + "_entry"


@dataclass
class Graph:
    """fields: (element, field) -> repeated or single, all others being scalar; tables: elements with a table of their own; entries: elements whose field names are data; objects: elements that are objects."""

    fields: dict[tuple[str, str], str]
    objects: set[str] = field(default_factory=set)
    tables: set[str] = field(default_factory=set)
    entries: set[str] = field(default_factory=set)

    def plan(self) -> Graph:
        """Choose the tables: roots, repeated, shared and recursive elements."""
        parents: dict[str, set[str]] = defaultdict(set)
        below: dict[str, set[str]] = defaultdict(set)
        self.tables = {ROOT, WRAPPER} | {entry_of(e) for e in self.entries}
        for (element, name), how in self.fields.items():
            child = ALIASES.get(name, name)
            if how == "repeated":
                self.tables.add(child)
            parents[child].add(element)
            below[element].add(child)
        for e in self.entries:
            below[e].add(entry_of(e))
        self.tables |= {e for e, p in parents.items() if len(p) > 1}
        for e in list(below):
            seen, todo = set(), list(below[e])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += below.get(x, ())
            if e in seen:
                self.tables.add(e)
        return self


def root_of(value: Any) -> tuple[str, dict] | None:
    """The root element of a payload: a crawl object with results, or a bare spec row."""
    if isinstance(value, str):
        value = held_json(value)
    if not isinstance(value, dict):
        return None
    return (WRAPPER if value.get("results") is not None else ROOT), value


def _edges(payloads: Iterable[str | None], entries: frozenset[str] = frozenset(), followed: frozenset[tuple[str, str]] = frozenset(CRAWL_FIELDS)) -> dict[tuple[str, str], int]:
    """(element, field) -> bits: 1 it holds an object, 2 an array, 8 an array with an object in it, 4 a text that holds one of these, which is read only in ``followed`` fields."""
    found: dict[tuple[str, str], int] = {}
    for text in payloads:
        root = root_of(read_json(text))
        todo = [] if root is None else [root]
        while todo:
            element, obj = todo.pop()
            into = element in entries
            for name, value in obj.items():
                at = (element, name)
                if isinstance(value, str):
                    if value[:1] not in "{[ \n\t\r" or value == "" or (held := held_json(value)) is UNREADABLE:
                        continue
                    if at not in followed and not into:
                        found[at] = found.get(at, 0) | 4
                        continue
                    value = held
                if isinstance(value, dict):
                    inner, bit = [value], 1
                elif isinstance(value, list):
                    inner = [y for x in value if isinstance(y := held_json(x) if isinstance(x, str) and at in followed and ALIASES.get(name, name) not in VALUES else x, dict)]
                    bit = 10 if inner else 2
                else:
                    continue
                if not into:
                    found[at] = found.get(at, 0) | bit
                child = entry_of(element) if into else ALIASES.get(name, name)
                todo += [(child, x) for x in inner]
    return found


def schema_graph(df: DataFrame, payload: str, many: int = MANY_KEYS) -> Graph:
    """The schema graph of a column of JSON texts; the declared crawl fields keep their declared kind.

    The graph depends on the data alone, not on their order or partitions. A
    pass is repeated only where it met elements of entries or fields that hold
    elements in some records and texts of such elements in others.
    """
    entries: frozenset[str] = frozenset()
    followed = frozenset(CRAWL_FIELDS)
    while True:

        def scan(batches: Iterator[pd.DataFrame], entries=entries, followed=followed) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(clean(e), clean(n), bits) for (e, n), bits in _edges(pdf[payload], entries, followed).items()], columns=["element", "name", "bits"])

        rows = materialize(df.select(payload).mapInPandas(scan, "element string, name string, bits int").groupBy("element", "name").agg(F.bit_or("bits").alias("bits")))
        fields = {at: (2 if how == "repeated" else 1) for at, how in CRAWL_FIELDS.items()}
        wide: set[str] = set()
        seen: set[str] = set()
        frontier = {ROOT, WRAPPER}
        while frontier:  # as many rounds as the schema is deep; each element brings at most ``many`` fields and those declared
            seen |= frontier
            own = rows.where(F.col("element").isin(*frontier))
            wide |= {r[0] for r in own.where("bits & 3 > 0").groupBy("element").count().where(F.col("count") > many).collect()}
            for r in own.where(~F.col("element").isin(*wide, "") & (F.col("bits") > 0)).collect():
                at = (r["element"], r["name"])
                fields[at] = fields.get(at, 0) | r["bits"]
            frontier = {ALIASES.get(n, n) for (e, n), bits in fields.items() if e in frontier and bits & 3} | {entry_of(e) for e in entries & frontier}
            frontier -= seen
        texts = frozenset(at for at, bits in fields.items() if bits & 4 and bits & 3)
        if wide - DECLARED <= entries and texts <= followed:
            graph = Graph({at: "repeated" if bits & 2 else "single" for at, bits in fields.items() if bits & 3 and at[0] not in entries}, entries=set(entries))
            graph.fields |= CRAWL_FIELDS
            graph.objects = ({ALIASES.get(n, n) for (_, n), bits in fields.items() if bits & 9} | {entry_of(e) for e in entries} | DECLARED) - VALUES
            return graph.plan()
        entries, followed = entries | (wide - DECLARED), followed | texts


ROWS = "rec_id long, table_name string, row_key string, parent_table string, parent_key string, pos int, texts map<string,string>, others map<string,string>, field_path string"


def shred_payload(text: str | None, graph: Graph) -> Iterator[tuple]:
    """The rows of one payload: table, row key, parent table, parent key, position, text fields, other scalar fields, field path.

    Keys are the zero-based places on the way, null items counted. A value
    alone where an array belongs is an array of one; a string that holds a
    JSON object or array where one belongs is that. The field path holds the
    names on the way from the spec row (from the root outside of one), joined
    by "/" and escaped as in a JSON pointer, whatever elements have tables.
    """
    root = root_of(read_json(text))
    if root is None:
        return
    kind, value = root

    def put(texts: dict, others: dict, name: str, value: Any) -> None:
        if isinstance(value, str):
            texts[clean(name)] = clean(value)
        elif value is not None:
            others[clean(name)] = write_json(value)

    def items(value: Any) -> list:
        if isinstance(value, str) and (held := held_json(value)) is not UNREADABLE:
            value = held
        return value if isinstance(value, list) else [] if value is None else [value]

    Row = tuple[str, str, str | None, str | None, int, dict, dict, str]

    def row(element: str, key: str, parent: str | None, parent_key: str | None, pos: int, entry: str | None, path: str, value: Any) -> tuple[Row, list]:
        """A row and what is still to be read for it: frames (element, items of the object, owner, key, prefix, texts, others, path)."""
        texts: dict[str, str] = {}
        others: dict[str, str] = {}
        if entry is not None:
            texts["key"] = clean(entry)
        if isinstance(value, dict):
            return (element, key, parent, parent_key, pos, texts, others, clean(path)), [(element, iter(value.items()), element, key, "", texts, others, path)]
        put(texts, others, "value", value)
        return (element, key, parent, parent_key, pos, texts, others, clean(path)), []

    first, todo = row(kind, "0" if kind == ROOT else "", None, None, 0, None, "" if kind == ROOT else "/", value)
    out: list[Row] = [first]
    while todo:
        element, fields, owner, key, prefix, texts, others, path = todo[-1]
        name, value = next(fields, (None, None))
        if name is None:
            todo.pop()
            continue
        into = element in graph.entries
        how = "repeated" if into else graph.fields.get((element, name), "scalar")
        child = entry_of(element) if into else ALIASES.get(name, name)
        if how == "scalar":
            put(texts, others, prefix + name, value)
            continue
        many = how == "repeated"
        step = name.replace("~", "~0").replace("/", "~1")
        at = "" if kind == WRAPPER and path == "/" and name == "results" else f"{path.rstrip('/')}/{step}" if path else step
        pending: list = []
        for pos, x in enumerate(items(value)):
            if isinstance(x, str) and child in graph.objects and (held := held_json(x)) is not UNREADABLE:
                x = held
            place = (f"{key}/{pos}" if key else str(pos)) if many else key
            if x is None:
                continue
            if many or child in graph.tables:
                made, more = row(child, place, owner, key, pos if many else 0, name if into else None, at, x)
                out.append(made)
                pending += more
            elif isinstance(x, dict):
                pending.append((child, iter(x.items()), owner, key, prefix + name + ".", texts, others, at))
            else:
                put(texts, others, prefix + name, x)
        todo += reversed(pending)
    yield from out


def shred(df: DataFrame, rec_id: str, payload: str, graph: Graph, tables: set[str] | None = None) -> DataFrame:
    """The rows of all flat tables (or of ``tables``) in one long table; copies of a record give their rows again."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["rec_id", *(part.split()[0] for part in ROWS.split(", ")[1:])]
        buffer: list[tuple] = []
        for pdf in batches:
            for rec, text in zip(pdf["_rec"], pdf["_payload"]):
                buffer += [(rec, *row) for row in shred_payload(text, graph) if tables is None or row[0] in tables]
                if len(buffer) >= 10_000:
                    yield pd.DataFrame(buffer, columns=names)
                    buffer = []
        if buffer:
            yield pd.DataFrame(buffer, columns=names)

    return df.select(F.col(rec_id).cast("long").alias("_rec"), F.col(payload).alias("_payload")).where("_payload is not null and _rec is not null").mapInPandas(rows, ROWS)


def flat_table(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One table of the long form with ``columns`` (text or other scalars, as text) and its keys; copies count once."""
    wanted = [F.coalesce(F.col("texts")[c], F.col("others")[c]).alias(c.replace(".", "_")) for c in columns]
    return rows.where(F.col("table_name") == name).select("rec_id", "row_key", "parent_table", "parent_key", "pos", *wanted).distinct()


#: child of p4_found -> table, field path and text field.
FOUND = {"page": ("pages", "nightly/pages", "value"), "heading": ("heading", "dfns/heading", "href"), "text": ("linkingText", "dfns/linkingText", "value"), "ref": ("informative", "refs/informative", "url")}


def _shredded(spark, sf_dir: str, tables: set[str] | None) -> DataFrame:
    records = table(spark, sf_dir, "crawl_results")
    return shred(records, "rec_id", "payload", schema_graph(records, "payload"), tables)


def p4_found(spark, sf_dir: str) -> DataFrame:
    rows = _shredded(spark, sf_dir, {t for t, _, _ in FOUND.values()})
    child, val = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (t, path, field_name) in FOUND.items():
        of = (F.col("table_name") == t) & (F.col("field_path") == path)
        child, val = F.when(of, F.lit(name)).otherwise(child), F.when(of, F.col("texts")[field_name]).otherwise(val)
    return rows.select("rec_id", child.alias("child"), F.col("row_key").alias("item_path"), val.alias("val")).where("child is not null and val is not null").distinct()


def p4_rows(spark, sf_dir: str) -> DataFrame:
    """The rows of all flat tables with their columns, each tied to its record, place and parent row; copies count once."""
    maps = ["texts", "others"]
    rows = _shredded(spark, sf_dir, None).withColumns({m: F.array_sort(F.map_entries(m)) for m in maps}).distinct()
    return rows.withColumns({m: F.map_from_entries(m) for m in maps})


def p4_tables(spark, sf_dir: str) -> DataFrame:
    """Rows, text fields and distinct parents of every flat table of crawl_results."""
    rows = _shredded(spark, sf_dir, None).select("table_name", "parent_table", "rec_id", "row_key", "parent_key", F.size("texts").alias("n")).distinct()
    return rows.groupBy("table_name", "parent_table").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_text_fields"), F.countDistinct("rec_id").alias("n_records"))


def p4_definitions(spark, sf_dir: str) -> DataFrame:
    """The table of definitions, tied to its record and spec row."""
    return flat_table(_shredded(spark, sf_dir, {"dfns"}), "dfns", ["id", "href", "type"])
