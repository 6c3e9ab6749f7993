import random
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from specstrata.operators.hotkeys import KEY, key_hash, key_states, numbered

SCHEMA = "k string, sub string, at timestamp, _c int, _part int, _n int"


def states(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    keyed = df.select("*", *key_hash(F.col("k")))
    return keyed.select("k", *KEY).distinct().join(key_states(keyed, "sub", "at"), KEY)


def test_states_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.choice([None, *"abcdefgh"]), datetime(2024, 1, 1 + rng.randrange(28)), 7, 7, 7) for _ in range(1500)]
    rows += [("none", None, None, 7, 7, 7), (None, "a", None, 7, 7, 7)]
    got = {r["k"]: (r["_w"], r["_subs"], r["_first"], r["_last"]) for r in states(spark, rows).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {k: (len(g), len({r[1] for r in g} - {None}), min((r[2] for r in g if r[2]), default=None), max((r[2] for r in g if r[2]), default=None)) for k, g in groups.items()}
    assert got == want


def test_numbers_are_dense_and_keys_contiguous(spark):
    rows = [(("hot" if i % 3 else f"k{i % 17}"), str(i // 5)) for i in range(500)]
    df, total = numbered(spark.createDataFrame(rows, "k string, sub string").repartition(5), ["k", "sub"])
    got = sorted((r["_n"], r["k"], r["sub"]) for r in df.collect())
    assert total == 500 and [n for n, *_ in got] == list(range(500)) and [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_keys_with_nulls_are_told_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("a", "a"), ("", None)], "a string, b string")
    assert df.select(*key_hash(F.col("a"), F.col("b"))).distinct().count() == 5


def test_empty(spark):
    assert states(spark, []).count() == 0
