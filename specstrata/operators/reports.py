"""Checks of extracts against constraints, and reports in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.extract.modules import DFN_TYPES

# Patterns of the fields of extracts, and the types of their links.
URL = "^(https?|file|about|wss?):[^ ]*$"
SHORTNAME = "^[\\w\\-]+((?<=-v?\\d{1,9})\\.\\d+)?$"
INTERFACE = "^[A-Z]([A-Za-z0-9_])*$|^console$"
NUMBER = "^(\\d+|[A-Z])(\\.\\d+)*$"
ACCESS = ("private", "public")

#: Types of events' sources, access and compositions (fixed values).
EVENT_SOURCES = ("summary table", "css definition table", "event table", "fire an event phrasing", "IDL eventHandler", "dfn")


def _texts(c: str) -> Column:
    """Whether a list holds no empty text."""
    return ~F.exists(c, lambda x: x == "")


def constraints(name: str) -> dict[str, Column] | None:
    """The constraints of an extract by name (extract-x, x.json or x), None if there are none; what is null holds."""
    stem = name.removeprefix("extract-").removesuffix(".json")
    url = lambda c: F.col(c).rlike(URL)
    filled = lambda c: F.length(c) > 0
    return {
        "title": {"title": filled("title")},
        "dfns": {"id": filled("id"), "href": url("href"), "linkingText": (F.size("linkingText") > 0) & _texts("linkingText"), "type": F.col("type").isin(*sorted(DFN_TYPES)), "access": F.col("access").isin(*ACCESS), "heading": url("heading.href")},
        "headings": {"id": filled("id"), "href": url("href"), "title": F.col("title").isNotNull(), "level": F.col("level") >= 1, "number": F.col("number").rlike(NUMBER)},
        "ids": {"col": url("col")},
        "links": {"link_url": url("link_url"), "anchors": _texts("anchors")},
        "refs": {"name": filled("name"), "url": url("url")},
        "cddl": {"name": F.col("name").isNotNull(), "cddl": F.col("cddl").isNotNull()},
        "elements": {"name": filled("name"), "href": url("href"), "interface": F.col("interface").rlike(INTERFACE)},
        "events": {"type": filled("type"), "href": url("href"), "interface": F.col("interface").rlike(INTERFACE), "src": F.col("src.format").isin(*EVENT_SOURCES)},
        "css": {"name": filled("name"), "href": url("href"), "value": filled("value")},
        "backrefs": {"href": url("href"), "referrers": F.size("referrers") > 0},
        "idlnames": {"name": filled("name"), "inheritance": filled("inheritance")},
        "specs": {"shortname": F.col("shortname").rlike(SHORTNAME), "url": url("url")},
    }.get(stem)


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and constraint of every rule a row breaks; one pass, no shuffle."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    return rows.select(*keys, F.explode(F.array_compact(failed)).alias("broken"))


def spec_reports(extracts: DataFrame) -> DataFrame:
    """shortname, report: what each spec defines, in Markdown."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    public = F.filter("dfns", lambda d: d["access"] == "public")
    terms = F.array_join(F.array_sort(F.flatten(F.transform(public, lambda d: F.transform(d["linkingText"], lambda t: F.concat(F.lit("- "), t))))), "\n")

    def count(c: str, word: str) -> Column:
        return F.when(n(c) == 0, F.lit(f"- No {word} found")).otherwise(F.concat(F.lit("- "), n(c).cast("string"), F.lit(f" {word}")))

    lines = [
        F.concat(F.lit("# "), F.coalesce("title", "shortname")), F.lit(""), F.concat(F.lit("- URL: "), F.col("url")), F.when(F.col("generator").isNotNull(), F.concat(F.lit("- Generator: "), F.col("generator"))), F.lit(""), F.lit("## Spec defines"), F.lit(""),
        count("headings", "headings"), count("ids", "ids"), count("dfns", "definitions"), count("elements", "elements"), count("events", "events"),
        F.when(n(public) > 0, F.concat(F.lit("\n<details><summary>Exported definitions</summary>\n\n"), terms, F.lit("\n\n</details>"))), F.when(F.col("idl") != "", F.concat(F.lit("\n<details><summary>Interface definitions</summary>\n\n```idl\n"), F.col("idl"), F.lit("\n```\n\n</details>"))),
    ]
    return extracts.select("shortname", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("report"))


def missing_report(missing: DataFrame) -> DataFrame:
    """spec, report: expected definitions that are missing (errors) or only nearly found (warnings). missing: spec, term, match."""
    bad = missing.where("match <> 'exact'")
    line = F.concat(F.lit("- "), F.when(F.col("match") == "missing", F.lit("missing: ")).otherwise(F.concat(F.col("match"), F.lit(": "))), F.col("term"))
    grouped = bad.groupBy("spec").agg(F.count_if(F.col("match") == "missing").alias("errors"), F.count_if(F.col("match") != "missing").alias("warnings"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return grouped.select("spec", F.concat(F.lit("<details><summary>"), "spec", F.lit(": "), "errors", F.lit(" errors, "), "warnings", F.lit(" warnings</summary>\n\n"), "lines", F.lit("\n\n</details>")).alias("report"))
