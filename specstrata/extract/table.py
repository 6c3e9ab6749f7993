"""Documents to fact tables: every wanted module runs on one parse of a document."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specstrata.extract import modules as m
from specstrata.extract.algorithms import algorithms
from specstrata.extract.css import css
from specstrata.extract.events import events
from specstrata.extract.webidl import IdlError, idl_report

ITEM = {"heading": "struct<id:string,href:string,title:string,number:string,alternateIds:array<string>>"}
#: Registered modules: name -> (function, type of its column). Open or recursive results stay JSON.
REGISTRY: dict[str, tuple[Callable[[m.Page], Any], str]] = {
    "title": (m.title, "string"), "generator": (m.generator, "string"), "date": (m.last_modified, "string"), "revision": (m.revision, "string"),
    "links": (m.links, "struct<rawlinks:map<string,array<string>>,autolinks:map<string,array<string>>>"), "ids": (m.ids, "array<string>"),
    "headings": (m.headings, "array<struct<id:string,href:string,title:string,number:string,alternateIds:array<string>,level:int>>"),
    "refs": (m.references, "struct<normative:array<struct<name:string,url:string>>,informative:array<struct<name:string,url:string>>>"),
    "idl": (m.idl, "string"), "cddl": (m.cddl, "array<struct<name:string,cddl:string>>"), "elements": (m.elements, "array<struct<name:string,href:string,interface:string,obsolete:boolean>>"),
    "events": (events, "array<struct<type:string,interface:string,targets:array<string>,bubbles:boolean,cancelable:boolean,isExtension:boolean,href:string,src:struct<format:string,href:string>>>"),
    "dfns": (m.dfns, "array<struct<id:string,href:string,linkingText:array<string>,localLinkingText:array<string>,type:string,`for`:array<string>,access:string,informative:boolean,heading:" + ITEM["heading"] + ",definedIn:string,links:array<struct<type:string,id:string,name:string,href:string,heading:" + ITEM["heading"] + ">>,htmlProse:string>>"),
    "css": (css, "string"), "algorithms": (algorithms, "string"), "outline": (m.outline, "array<struct<depth:int,title:string,level:int>>"),
}
# The files modules are known by, where these differ from the column.
_FILES = {
    "get-title": "title", "get-generator": "generator", "get-lastmodified-date": "date", "get-revision": "revision", "extract-links": "links", "extract-ids": "ids", "extract-headings": "headings", "extract-references": "refs",
    "extract-webidl": "idl", "extract-cddl": "cddl", "extract-elements": "elements", "extract-events": "events", "extract-dfns": "dfns", "extract-cssdfn": "css", "extract-algorithms": "algorithms",
}
FILES = _FILES | {re.sub("-(.)", lambda x: x[1].upper(), name): column for name, column in _FILES.items()}
CORE = tuple(n for n in REGISTRY if n != "outline")


def select_modules(wanted: list[str] | None) -> list[str]:
    """Names of the modules to run: all core ones by default; ``core`` stands for them; an unknown name is an error.

    A module is named by its column, by its file (path, with or without
    suffix) or by the file's name in camel case.
    """
    out: list[str] = []
    for name in wanted or ["core"]:
        name = FILES.get(re.sub(r"\.m?js$", "", name.rsplit("/", 1)[-1]), name)
        if name != "core" and name not in REGISTRY:
            raise ValueError(f"unknown module {name}")
        out += [n for n in (CORE if name == "core" else (name,)) if n not in out]
    return out


def extract(pages: DataFrame, wanted: list[str] | None = None, custom: dict[str, Callable[[m.Page], Any]] | None = None) -> DataFrame:
    """pages (url, shortname, title, html, and last_modified if they have it) with a column per module and ``error``.

    Filter pages before: filters on the result are not pushed through Python.
    A document that cannot be read keeps its row, with the error and null
    extracts; a null html is an empty document. Results of ``custom``
    functions are JSON.
    """
    names = select_modules(wanted)
    runs = {n: REGISTRY[n][0] for n in names} | (custom or {})
    kinds = {n: REGISTRY[n][1] for n in names} | {n: "string" for n in custom or {}}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, shortname, title, html, served in zip(pdf["url"], pdf["shortname"], pdf["title"], pdf["html"], pdf["last_modified"]):
                row: dict[str, Any] = {"url": url, "shortname": shortname, "error": None} | dict.fromkeys(runs)
                try:
                    page = m.Page(html or "", {"url": url, "shortname": shortname, "title": title, "last_modified": served})
                    head = page.doc.first("h1")
                    if head is not None and head.text().strip().startswith("Index of "):
                        raise ValueError("the document is a listing of a folder")
                    for n, run in runs.items():
                        found = run(page)
                        row[n] = found if found is None or kinds[n] == "string" and isinstance(found, str) else json.dumps(found)
                except Exception as e:  # the row survives
                    row |= dict.fromkeys(runs) | {"error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            yield pd.DataFrame(rows, columns=["url", "shortname", "error", *runs])

    served = F.col("last_modified") if "last_modified" in pages.columns else F.lit(None)
    raw = pages.select("url", "shortname", "title", "html", served.cast("string").alias("last_modified")).mapInPandas(scan, "url string, shortname string, error string, " + ", ".join(f"`{n}` string" for n in runs))
    typed = [F.col(n) if kinds[n] == "string" else F.from_json(n, kinds[n]).alias(n) for n in runs]
    return raw.select("url", "shortname", "error", *typed)


def items(extracts: DataFrame, module: str) -> DataFrame:
    """One row per item of an array column: url, shortname, pos and the item's fields."""
    out = extracts.select("url", "shortname", F.posexplode(module).alias("pos", "item"))
    return out.select("url", "shortname", "pos", "item.*") if dict(extracts.dtypes)[module].startswith("array<struct") else out


def idl_reports(texts: DataFrame, idl: str = "idl") -> DataFrame:
    """texts with ``report`` (JSON of names, exposure and dependencies) and ``idl_error`` of their interface definitions."""

    @F.pandas_udf("report string, idl_error string")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for text in column:
            try:
                rows.append((None if text is None else json.dumps(asdict(idl_report(text))), None))
            except IdlError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["report", "idl_error"])

    return texts.withColumn("_r", run(F.col(idl))).select(*texts.columns, "_r.report", "_r.idl_error")
