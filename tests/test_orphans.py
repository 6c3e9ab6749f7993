import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from specstrata.functions.urls import moment, plain_href, utc_month
from specstrata.operators.orphans import child_row, long_form, orphan_references, parent_row

DAY = 86_400
CHILD = "id long, k string, at timestamp, key string, target string, _h long"
PARENT = "k string, born timestamp, gone timestamp"


def at(s):
    return None if s is None else datetime.fromtimestamp(s, timezone.utc)


def run(spark, children, parents):
    c = spark.createDataFrame([(i, k, at(t), "clash", "clash", 1) for i, k, t in children], CHILD)
    p = spark.createDataFrame([(k, at(b), at(g)) for k, b, g in parents], PARENT)
    long = long_form(c, child_row("p", F.col("k"), "id", "at", 1)).unionByName(long_form(p, parent_row("p", F.col("k"), "born", F.col("gone"))))
    return sorted(r["row_id"] for r in orphan_references(long).collect())


def brute(children, parents):
    return sorted({i for i, k, t in children if k is not None and not any(p == k and t is not None and b is not None and b <= t and (g is None or g > t) for p, b, g in parents)})


def test_against_brute_force_with_and_without_hot_keys(spark):
    rng = random.Random(5)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(30)]
    parents = [(rng.choice(keys), rng.randrange(0, 90 * DAY), rng.choice([None, rng.randrange(0, 120 * DAY)])) for _ in range(120)]
    parents += [("ends", 5 * DAY, 9 * DAY), (None, 0, None), ("k1", None, None)]
    children = [(i, rng.choice(keys), rng.randrange(0, 120 * DAY)) for i in range(400)]
    children += [(1000, "ends", 5 * DAY), (1001, "ends", 9 * DAY), (1002, None, DAY), (1003, "hot", None), (1004, "nowhere", DAY)]
    children += children[:50]
    assert run(spark, children, parents) == brute(children, parents)


def test_one_key_of_most_rows_at_one_instant(spark):
    parents = [("hot", 3, 5), ("hot", 4, 10), ("other", 3, 4)] + [("hot", 1, 2)] * 100
    children = [(i, "hot", 7) for i in range(300)] + [(i, "hot", 10) for i in range(300, 700)] + [(i, "hot", 2) for i in range(700, 900)] + [(i, f"k{i}", 1) for i in range(900, 930)] + [(940, "other", 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert run(spark, children + children[:450], parents) == brute(children, parents)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", 0)], []) == [1]


def test_plain_href(spark):
    cases = {
        "https://A.Example/Path#do%6D-x": "https://a.example/Path#dom-x",
        "https://a.example/x#g+1": "https://a.example/x#g+1",
        "https://a.example/x%20y#%C3%A9": "https://a.example/x%20y#é",
        "HTTPS://User@A.Example:80/#a#B%23": "HTTPS://User@a.example:80/#a#B#",
        "https://a.example/#100%": "https://a.example/#100%",
        "#Only%41": "#OnlyA",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r[0]: r[1] for r in df.select("h", plain_href(F.col("h"))).collect()} == cases


def test_month_and_moment(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 30, tzinfo=timezone.utc),)], "t timestamp")
    assert df.select(utc_month(F.col("t"))).first()[0] == "2024-01"
    same = ["Fri, 02 Dec 2022 19:48:49 GMT", "Friday, 02-Dec-22 19:48:49 GMT", "Fri Dec  2 19:48:49 2022", "2022-12-02T19:48:49Z", "2022-12-02T21:48:49+02:00", "2022-12-02T14:18:49.000-05:30", " 2022-12-02 19:48:49 ", "1670010529"]
    got = spark.createDataFrame([(s,) for s in same], "s string").select(moment(F.col("s"))).collect()
    assert {r[0] for r in got} == {1670010529000000}
    assert spark.createDataFrame([("soon",), (None,), ("2022-13-45T00:00:00Z",)], "s string").select(moment(F.col("s"))).collect() == [(None,)] * 3
