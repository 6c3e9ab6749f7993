"""Every query of the general problems over empty tables, rows of nulls, repeated rows, columns of clashing names and very long texts."""

import json

import pytest
from pyspark.sql import functions as F

from specstrata.plans.training import QUERIES

TABLES = {"p1": ("dfns", "headings", "ids", "backrefs", "core_dfns"), "p2": ("backrefs", "dfns", "core_dfns"), "p3": ("dfn_snapshots",), "p4": ("crawl_results",), "p5": ("idlnames", "headings"), "p6": ("extract_files",)}
CLASHES = ("k1", "_k1", "at", "ref", "path", "v", "parent", "label", "kind", "step", "_key", "h", "table_name", "_payload")


def write(spark, data, folder, change):
    for name in {t for ts in TABLES.values() for t in ts}:
        change(spark.read.parquet(f"{data}/{name}.parquet")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def nulls(df):
    """Five rows of nulls, and five that have only their keys."""
    keys = {"dfn_no", "heading_no", "id_no", "backref_id", "core_no", "idl_no", "rec_id", "row_no", "snapshot_no", "feed", "seq"}
    return df.limit(5).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).unionByName(df.limit(5).select(*[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    clash = lambda df: df.limit(150).unionByName(df.limit(60)).select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])
    made = {"empty": lambda df: df.limit(0), "nulls": nulls, "clash": clash, "plain": lambda df: df.limit(150)}
    return {name: write(spark, data, tmp_path_factory.mktemp(name), change) for name, change in made.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0
    for row in QUERIES[name](spark, folders["nulls"]).collect():
        assert name.startswith(("p1", "p2", "p5")) or row is None, row
    a, b = (sorted(map(str, QUERIES[name](spark, folders[k]).collect())) for k in ("plain", "clash"))
    assert a == b


def test_very_long_texts(spark, data, tmp_path):
    long = "x" * 2_000_000
    folder = write(spark, data, tmp_path, lambda df: df.limit(20))
    href = f"https://a.example/#{long}"
    for name, column, value in (("backrefs", "href", href), ("dfns", "href", href), ("ids", "href", href), ("dfn_snapshots", "href", href), ("idlnames", "idl_name", long), ("crawl_results", "payload", json.dumps({"nightly": {"pages": [long]}})), ("extract_files", "payload", json.dumps({"url": "u", "a": long}))):
        df = spark.read.parquet(f"{data}/{name}.parquet").limit(20).withColumn(column, F.lit(value))
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    assert {r["key_value"] for r in QUERIES["p2_hot_keys"](spark, folder).where("key_kind = 'definition' and n_backrefs > 0").collect()} == {href}
    for name in ("p1_found", "p3_found", "p5_found", "p6_found"):
        QUERIES[name](spark, folder).count()
    assert {len(r["val"]) for r in QUERIES["p4_found"](spark, folder).collect()} == {2_000_000}
