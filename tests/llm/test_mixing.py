import random
from collections import Counter
from fractions import Fraction

import pytest

from specstrata.llm.mixing import mix_plan, mixture, pfair, schedule
from specstrata.session import materialize


def test_deviation_stays_below_one_block():
    rng = random.Random(1)
    for _ in range(200):
        counts = {f"s{k}": rng.randrange(0, 40) for k in range(rng.randrange(1, 7))}
        total = sum(counts.values())
        slots = {s: [] for s in counts}
        for t, (s, j) in enumerate(pfair(counts)):
            assert j == len(slots[s])
            slots[s].append(t)
        assert sorted(x for v in slots.values() for x in v) == list(range(total))
        for s, n in counts.items():
            done = 0
            for t in range(total + 1):
                assert abs(done - Fraction(n * t, max(1, total))) < 1
                done += t in slots[s]


def test_blocks_have_bounded_size_and_schedule_covers_them(spark):
    plan = mix_plan([(1, "a", 0.75, 1), (1, "b", 0.25, 1), (2, "none", 1.0, 2)], {"a": 3_000, "b": 1_000}, blocks=4, block_tokens=10)
    assert {p["block"] for p in plan if p["mix_id"] == 1} == {10} and sum(p["blocks"] for p in plan) == 400
    rows = schedule(spark, plan, frame=7).collect()
    assert sorted(r["slot_no"] for r in rows) == list(range(400)) and sorted(r["_block_no"] for r in rows if r["source"] == "a") == list(range(300))


def test_plan():
    plan = {p["source"]: p for p in mix_plan([(1, "a", 0.5, 2), (1, "b", 0.25, 1), (1, "gone", 0.25, 3)], {"a": 100, "b": 1000})}
    assert plan["a"]["quota"] == 200 and plan["b"]["quota"] == 100 and plan["gone"]["quota"] == 0 and plan["a"]["passes"] == 2
    fixed = {p["source"]: p["quota"] for p in mix_plan([(1, "a", 0.5, 2), (1, "b", 0.5, 1)], {"a": 100, "b": 1000}, total_tokens=1000)}
    assert fixed == {"a": 200, "b": 500}
    assert mix_plan([], {}) == []


@pytest.mark.parametrize("blocks", [7, 500])
def test_mixture(spark, blocks):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "none", None]), rng.randrange(0, 60)) for i in range(600)]
    sizes = materialize(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"))
    targets = [(1, "big", 0.5, 1), (1, "small", 0.5, 3), (2, "big", 1.0, 2)]
    chosen, plan = mixture(sizes, targets, blocks=blocks, shard_rows=50, frame=16)
    got = chosen.collect()
    used = Counter((r["mix_id"], r["source"], r["doc_id"]) for r in got)
    caps = {(m, s): c for m, s, _, c in targets}
    assert all(n <= caps[m, s] for (m, s, _), n in used.items()) and len({(r["mix_id"], r["doc_id"], r["pass_no"]) for r in got}) == len(got)
    quota = {(p["mix_id"], p["source"]): p["quota"] for p in plan}
    real = Counter()
    for r in got:
        real[r["mix_id"], r["source"]] += r["n_tokens"]
    assert all(abs(real[k] - q) <= 30 for k, q in quota.items())
    for (m, s), _ in quota.items():
        own = sorted((r["start_token"], r["n_tokens"], r["slot_no"]) for r in got if (r["mix_id"], r["source"]) == (m, s))
        assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(own, own[1:]))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert mixture(none, [(1, "a", 1.0, 1)])[0].count() == 0 and mixture(none, [])[0].count() == 0
