from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from specstrata.operators.snapshots import _differ, might_hold, p3_changes, p3_found

SCHEMA = "snapshot_no int, snapshot_on date, shortname string, href string, linking_text array<string>, dfn_type string, dfn_for array<string>, access_mode string, informative boolean, heading_href string, crawled string, last_modified string, crawled_at timestamp, loaded_at timestamp, k1 int, h string, _key string"
DAY = date(2024, 1, 1)


def row(no, href, text=("a",), scope=(), changed="2024-01-01T00:00:00Z", at=1, kind="dfn", informative=False):
    t = datetime(2024, 1, at)
    return (no, DAY, "s", href, None if text is None else list(text), kind, None if scope is None else list(scope), "public", informative, None, "c", changed, t, t, 1, "x", "x")


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).drop("k1", "h", "_key").write.mode("overwrite").parquet(f"{tmp_path}/dfn_snapshots.parquet")
    return sorted(tuple(r) for r in p3_found(spark, str(tmp_path)).collect())


def test_changes(spark, tmp_path):
    rows = [
        row(1, "https://a/#same"), row(3, "https://A/#s%61me", text=(" a ",), scope=None), row(1, "https://a/#gone"), row(3, "https://a/#new"), row(3, "https://a/#new"),
        row(1, "https://a/#text", text=("a  b",)), row(3, "https://a/#text", text=("b", "a")), row(1, "https://a/#set", scope=("x", "y", "x")), row(3, "https://a/#set", scope=("y", "x")),
        row(1, "https://a/#time"), row(3, "https://a/#time", changed="Mon, 01 Jan 2024 00:00:00 GMT"), row(1, "https://a/#late", kind="b"), row(3, "https://a/#late", kind="b", at=2), row(3, "https://a/#late", kind="c", at=1),
        row(1, "https://a/#nulls", text=None), row(3, "https://a/#nulls", text=()), row(1, "https://a/#info", informative=None), row(3, "https://a/#info"), row(1, None), row(None, "https://a/#none"),
    ]
    assert run(spark, tmp_path, rows) == [(3, "https://a/#gone", "removed"), (3, "https://a/#info", "changed"), (3, "https://a/#new", "added"), (3, "https://a/#text", "changed")]


def test_one_or_no_snapshot(spark, tmp_path):
    assert run(spark, tmp_path, [row(1, "https://a/#x")]) == []
    assert run(spark, tmp_path, []) == []


def test_differ():
    kind = np.dtype([("a", "<i8"), ("b", "<i8")])
    left = np.array([(1, 1), (2, 2), (3, -1)], kind), np.array([1, 2, 3])
    right = np.array([(-5, 0), (2, 2), (3, -1), (3, 0)], kind), np.array([0, 9, 3, 4])
    added, removed, changed = _differ(left, right)
    assert (added.tolist(), removed.tolist(), changed.tolist()) == ([0, 3], [0], [1])


def test_fields_before_and_after(spark, tmp_path):
    rows = [row(1, "https://a/#gone", kind="g"), row(2, "https://a/#new", kind="n"), row(1, "https://a/#k", kind="old", at=1), row(1, "https://a/#k", kind="x", at=2), row(2, "https://A/#%6b", kind="y", text=("b",)), row(3, "https://a/#new", kind="n"), row(3, "https://a/#k", kind="y", text=("b",)), row(1, "https://a/#same"), row(2, "https://a/#same"), row(3, "https://a/#same")]
    spark.createDataFrame(rows, SCHEMA).drop("k1", "h", "_key").write.parquet(f"{tmp_path}/dfn_snapshots.parquet")
    got = {(r["snapshot_no"], r["href"], r["change_kind"]): tuple(x and (x["dfn_type"], x["linking_text"]) for x in (r["before"], r["after"])) for r in p3_changes(spark, str(tmp_path)).collect()}
    assert got == {(2, "https://a/#gone", "removed"): (("g", ["a"]), None), (2, "https://a/#new", "added"): (None, ("n", ["a"])), (2, "https://a/#k", "changed"): (("x", ["a"]), ("y", ["b"]))}
    spark.createDataFrame([row(1, "https://a/#k")], SCHEMA).drop("k1", "h", "_key").write.mode("overwrite").parquet(f"{tmp_path}/dfn_snapshots.parquet")
    assert p3_changes(spark, str(tmp_path)).count() == 0


def test_filter_holds_back_no_key(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("k1"), "id", F.lit(1).alias("_word"), F.lit("x").alias("_spot_"))
    keys = rows.where("id % 7 = 0").select("k1")
    for bits in (1 << 26, 4096):
        got = {r["id"] for r in might_hold(rows, keys, "k1", bits).collect()}
        assert {i for i in range(0, 3000, 7)} <= got and (bits == 4096 or len(got) < 800)
    assert might_hold(rows, keys.limit(0), "k1").count() == 0 and might_hold(rows.limit(0), keys, "k1").count() == 0
