"""Writing extracts, indexes and reports. Documents are rows of a file's name below the output folder and its body."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.functions.jsontext import read_json, write_json
from specstrata.session import located, opened


def _filled(extracts: DataFrame, column: str) -> Column:
    """Whether an extract holds anything: null, empty texts, lists and objects do not."""
    kind = dict(extracts.dtypes)[column]
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(column), F.lit(0)) > 0
    return F.coalesce(~F.col(column).isin("", "[]", "{}"), F.lit(False)) if kind == "string" else F.col(column).isNotNull()


def _header() -> Column:
    return F.struct(F.col("title"), F.col("url")).alias("spec")


def _file(column: str, ending: str = ".json") -> Column:
    return F.concat(F.lit(f"{column}/"), F.col("shortname"), F.lit(ending))


def extract_documents(extracts: DataFrame, column: str) -> DataFrame:
    """file, body: one JSON document per spec with a header (spec title and URL) and the extract; specs without it give none."""
    return extracts.where(_filled(extracts, column)).select(_file(column).alias("file"), F.to_json(F.struct(_header(), F.col(column))).alias("body"))


def with_files(extracts: DataFrame, column: str, ending: str = ".json") -> DataFrame:
    """The extracts after a column is written: the name of its file in its place, null where it is empty."""
    return extracts.withColumn(column, F.when(_filled(extracts, column), _file(column, ending)))


def _source(mark: str) -> Column:
    return F.concat(F.lit(f"{mark} Extracted, do not edit\n{mark} Source: "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("url"), F.lit(")\n\n"))


def idl_documents(extracts: DataFrame) -> DataFrame:
    """file, body: the interface definitions of each spec below a header that names their source."""
    return extracts.where("idl is not null and idl <> ''").select(_file("idl", ".idl").alias("file"), F.concat(_source("//"), F.col("idl"), F.lit("\n")).alias("body"))


#: Keys of style extracts that are not written, and the lists of which one must hold something (fixed values).
CSS_DROPPED = ("parsedValue", "valueParseError")
CSS_LISTS = ("properties", "atrules", "selectors", "values", "warnings")


def css_body(title: str | None, url: str | None, css: str | None) -> str | None:
    """A style extract as written: the header and its lists on one level, without parsed values; None if all lists are empty."""
    found = read_json(css)
    if not isinstance(found, dict) or not any(found.get(k) for k in CSS_LISTS):
        return None

    def kept(x):
        if isinstance(x, dict):
            return {k: kept(v) for k, v in x.items() if k not in CSS_DROPPED}
        return [kept(v) for v in x] if isinstance(x, list) else x

    return write_json({"spec": {"title": title, "url": url}} | kept(found), ensure_ascii=False, comma=",", colon=":") + "\n"


def css_documents(extracts: DataFrame) -> DataFrame:
    """file, body: the style extract (css as JSON) of each spec that has one."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"css/{s}.json", css_body(t, u, c)) for s, t, u, c in zip(pdf["shortname"], pdf["title"], pdf["url"], pdf["css"])]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["file", "body"])

    return extracts.select("shortname", "title", "url", "css").mapInPandas(scan, "file string, body string")


def cddl_documents(extracts: DataFrame) -> DataFrame:
    """file, body: one file per module of data definitions; the anonymous module has the spec's name."""
    modules = extracts.select("shortname", "title", "url", F.explode("cddl").alias("m"))
    stem = F.concat("shortname", F.when(F.col("m.name") == "", F.lit("")).otherwise(F.concat(F.lit("-"), F.col("m.name"))))
    return modules.select(F.concat(F.lit("cddl/"), stem, F.lit(".cddl")).alias("file"), F.concat(_source(";"), F.col("m.cddl"), F.lit("\n")).alias("body"))


def post_documents(results: DataFrame, column: str, per_spec: bool) -> DataFrame:
    """file, body of a processing step's result: one document named after it for the whole crawl, or one per spec below a header.

    A result for the whole crawl is one row; per spec rows without a shortname
    or result give none.
    """
    if not per_spec:
        body = F.col(column) if dict(results.dtypes)[column] == "string" else F.to_json(column)
        return results.select(F.lit(f"{column}.json").alias("file"), body.alias("body"))
    return extract_documents(results.where("shortname is not null"), column)


def name_documents(fragments: DataFrame) -> DataFrame:
    """file, body per interface name: its definition, then its extensions in order, each below the line of its source. fragments: name, spec_title, spec_url, partial, ord, fragment."""
    part = F.concat(F.lit("// Source: "), F.coalesce("spec_title", F.lit("")), F.lit(" ("), F.col("spec_url"), F.lit(")\n"), F.col("fragment"))
    ordered = F.array_sort(F.collect_list(F.struct("partial", "ord", part.alias("part"))))
    return fragments.groupBy("name").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("body")).select(F.concat(F.lit("idlnames/"), "name", F.lit(".idl")).alias("file"), "body")


def parsed_name_documents(names: DataFrame) -> DataFrame:
    """file, body per interface name: all that is known of it (name and further columns) as JSON."""
    return names.select(F.concat(F.lit("idlnamesparsed/"), "name", F.lit(".json")).alias("file"), F.to_json(F.struct(*names.columns)).alias("body"))


def name_index(names: DataFrame) -> DataFrame:
    """file, body of the one index of names (name, type) in the order of code units: where their definitions and what is known of them are."""
    entry = F.struct(F.concat(F.lit("idlnames/"), "name", F.lit(".idl")).alias("fragment"), F.concat(F.lit("idlnamesparsed/"), "name", F.lit(".json")).alias("parsed"), F.col("type"))
    key = F.to_json(F.array("name"))
    line = F.concat(F.substr(key, F.lit(2), F.length(key) - 2), F.lit(":"), F.to_json(entry))
    lines = names.select("name", line.alias("line"))
    return lines.agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("x")).select(F.lit("idlnames.json").alias("file"), F.concat(F.lit("{"), F.array_join(F.transform("x", lambda r: r["line"]), ","), F.lit("}")).alias("body"))


def backref_documents(terms: DataFrame, specs: DataFrame) -> DataFrame:
    """file, body per document with terms others refer to. terms: owner, href, referrers and further fields; specs: shortname, title, url."""
    fields = [c for c in terms.columns if c != "owner"]
    of_spec = terms.groupBy(F.col("owner").alias("shortname")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("backrefs"))
    return extract_documents(of_spec.join(specs.select("shortname", "title", "url"), "shortname"), "backrefs")


def rewritten_index(index: DataFrame, documents: DataFrame, column: str) -> DataFrame:
    """The rows of an index (shortname, ...) with ``column`` naming the document written for them, null for those without one."""
    files = documents.select(F.regexp_extract("file", "([^/]+)\\.[^./]+$", 1).alias("shortname"), F.col("file").alias(f"_{column}"))
    return index.drop(column).join(files, "shortname", "left").withColumnRenamed(f"_{column}", column)


def crawl_index(specs: DataFrame, title: str, options: str = "{}", error: Column | None = None, order: str = "shortname") -> DataFrame:
    """One row: a crawl's type, title, date, options, counts and its documents in order, to be written as its index. A registry bounds its size."""
    failed = F.col("error").isNotNull() if error is None else error
    results = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*specs.columns).alias("r"))))
    counted = specs.agg(F.struct(F.count("*").alias("crawled"), F.count_if(failed).alias("errors")).alias("stats"), results.alias("_results"))
    return counted.select(F.lit("crawl").alias("type"), F.lit(title).alias("title"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("date"), F.lit(options).alias("options"), "stats", F.transform("_results", lambda x: x["r"]).alias("results"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Write (file, body) rows, each task its own files, through the file system that the folder's scheme names.

    A folder without a scheme is one of this machine, so it serves a local
    session only. Every form that Spark reads is understood (``file:/a b``).
    """
    spark = documents.sparkSession
    if not urlsplit(folder).scheme and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} names no file system that all executors share")
    scheme, root = located(spark, folder)

    def put(rows) -> None:
        system, base = opened(scheme, root)
        for row in rows:
            path = f"{base}/{row['file']}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(row["body"].encode())

    documents.foreachPartition(put)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, for the console."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def terse(extracts: DataFrame, column: str) -> str:
    """One extract of all documents as text for the console: a list, or of a single document the extract itself, texts as they are."""
    rows = [r[0] for r in extracts.select(F.col(column) if dict(extracts.dtypes)[column] == "string" else F.to_json(column)).collect()]
    plain = dict(extracts.dtypes)[column] == "string"
    if len(rows) == 1:
        return rows[0] if rows[0] is not None else "null"
    return "[" + ",".join("null" if r is None else write_json(r) if plain else r for r in rows) + "]"


def markdown(reports: DataFrame) -> DataFrame:
    """part: the headed report of each document (title, report), below one heading for all."""
    return reports.select(F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("report", F.lit("")), F.lit("\n")).alias("part"))


def returned(index: DataFrame, post: dict[str, DataFrame]) -> dict:
    """A crawl as an object: its index and, under post, the results of the steps for the whole crawl in their order."""
    row = index.first().asDict(recursive=True)
    return row | {"post": [{"mod": name, "result": [r.asDict(recursive=True) for r in df.collect()]} for name, df in post.items()]}
