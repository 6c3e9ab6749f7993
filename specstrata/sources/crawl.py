"""Reading documents and stored crawls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specstrata.functions.text import strip_header
from specstrata.session import located, opened

#: Resources a document needs no reading of (fixed values).
SKIPPED = r"\.(?:png|jpe?g|gif|webp|ico|svg|woff2?|ttf|otf|eot|css)(?:[?#].*)?$"


def read_registry(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """A JSON registry of documents; discontinued ones drop out unless asked for."""
    rows = spark.read.json(path, multiLine=True)
    return rows.where("standing is distinct from 'discontinued'") if active_only and "standing" in rows.columns else rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files, one row each: url (of the file), html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def relevant(resources: DataFrame) -> DataFrame:
    """Resources (url, html) worth reading; a PDF is an empty document."""
    kept = resources.where(~F.col("url").rlike(SKIPPED))
    return kept.withColumn("html", F.when(F.lower("url").rlike(r"\.pdf(?:[?#].*)?$"), F.lit("")).otherwise(F.col("html")))


def unite_pages(pages: DataFrame) -> DataFrame:
    """The pages of a document (url, page_url, ord, html) as one: each further page is a section that names its URL."""
    part = F.when(F.col("ord") == 0, F.col("html")).otherwise(F.concat(F.lit('<section data-page="'), F.replace("page_url", F.lit('"'), F.lit("%22")), F.lit('">'), F.col("html"), F.lit("</section>")))
    return pages.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x["part"]), "\n").alias("html"))


def readiness_error(title: str = "title"):
    """The error of a document that is only a listing of a folder, else null."""
    return F.when(F.col(title).rlike("^Index of "), F.lit("the document is a listing of a folder"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a stored crawl with the crawl's date."""
    index = spark.read.json(path, multiLine=True)
    return index.select(F.to_timestamp("date").alias("crawl_date"), F.posexplode("results").alias("spec_ord", "spec")).select("crawl_date", "spec_ord", "spec.*")


def expand_extract(specs: DataFrame, folder: str, column: str) -> DataFrame:
    """specs with the files that ``column`` names under ``folder`` in place of their names.

    Only the files of the asked column are read. Interface and data
    definitions lose the header that was put before them; of a JSON document
    the extract itself is taken, of a style document all but its header. A
    value that names no file stays.
    """
    scheme, root = located(specs.sparkSession, folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(scheme, root)
        for pdf in batches:
            names = [name for name in pdf["_name"] if ".." not in name.split("/")]
            there = system.get_file_info([f"{base}/{name}" for name in names])
            rows = [(name, system.open_input_stream(info.path).readall().decode(errors="replace")) for name, info in zip(names, there) if info.is_file]
            yield pd.DataFrame(rows, columns=["_name", "_text"])

    # opened by their names: a listing leaves out names that begin with a dot or underscore, and can't open those with a colon
    named = specs.select(F.col(column).alias("_name")).where(F.col("_name").startswith(f"{column}/") & (F.octet_length("_name") < 256)).distinct()
    files = named.mapInPandas(read, "_name string, _text string")
    inner = F.get_json_object("_text", f"$.{column}")
    if column == "css":
        parts = F.map_filter(F.from_json("_text", "map<string,string>"), lambda k, v: k != "spec")
        inner = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(parts), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    text = F.when(F.col("_name").rlike(r"\.(idl|cddl)$"), strip_header(F.col("_text"))).when(F.col("_name").endswith(".json"), inner).otherwise(F.col("_text"))
    joined = specs.join(files.select("_name", text.alias("_text")), specs[column] == F.col("_name"), "left")
    return joined.withColumn(column, F.coalesce("_text", F.col(column))).drop("_name", "_text")
