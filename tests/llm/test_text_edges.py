"""Every query of the text problems over empty tables, rows of nulls, repeated rows, columns of clashing names and very long texts."""

import pytest
from pyspark.sql import functions as F

from specstrata.llm.queries import QUERIES

CLASHES = ("n_tokens", "_item", "_shard", "form", "own", "_rank", "_h", "start_token", "capacity", "slot_no")


def write(spark, data, folder, change):
    for name in ("documents", "pack_limits", "mix_targets"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        change(df).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def nulls(df):
    return df.limit(4).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).unionByName(df.limit(4).select(*[F.col(f.name) if f.name == "doc_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, tmp_path, name):
    assert QUERIES[name](spark, write(spark, data, tmp_path, lambda df: df.limit(0))).count() == 0
    for row in QUERIES[name](spark, write(spark, data, tmp_path, nulls)).collect():
        assert name == "p9_forms" and row["form"] is None
    plain = sorted(map(str, QUERIES[name](spark, write(spark, data, tmp_path, lambda df: df.limit(120))).collect()))
    clash = sorted(map(str, QUERIES[name](spark, write(spark, data, tmp_path, lambda df: df.limit(120).select("*", *[F.lit(1).alias(c) for c in CLASHES if c not in df.columns]))).collect()))
    assert plain == clash


def test_very_long_texts(spark, data, tmp_path):
    long = ("page " * 400_000, "раge " * 400_000, "x" * 300_000)
    folder = write(spark, data, tmp_path, lambda df: df.limit(3) if "text" in df.columns else df)
    docs = spark.createDataFrame([(i, t, "harbour_scans") for i, t in enumerate(long)], "doc_id long, text string, source string")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    placed = QUERIES["p7_containers"](spark, folder).groupBy("limit_id", "doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert len({(r["doc_id"], r["n"]) for r in placed}) == 3 and all(r["n"] >= 400_000 for r in placed if r["doc_id"] == 0)
    assert [tuple(r) for r in QUERIES["p9_found"](spark, folder).collect()] == [(0, 1)]
    assert QUERIES["p8_mixture"](spark, folder).count() > 0
