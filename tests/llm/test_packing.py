import random
from collections import Counter, defaultdict

from specstrata.llm.packing import pack, pack_sizes, step_starts


def test_patterns_place_everything():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 500):
        for n in (0, 1, 5, 400):
            counts = Counter(rng.randrange(1, capacity + 1) for _ in range(n))
            patterns = pack_sizes(capacity, counts)
            placed = Counter()
            for p in patterns:
                assert 0 < p.fill <= capacity and p.times > 0
                for s, k in p.items:
                    placed[s] += k * p.times
            assert placed == counts
            starts = step_starts(patterns)
            assert sorted(x for p, a in zip(patterns, starts) for x in range(a, a + p.times)) == list(range(sum(p.times for p in patterns)))


def test_little_space_is_unused():
    rng = random.Random(2)
    counts = Counter(min(500, int(rng.expovariate(1 / 90)) + 1) for _ in range(20_000))
    patterns = pack_sizes(512, counts)
    used = sum(p.times for p in patterns)
    total = sum(s * n for s, n in counts.items())
    assert used * 512 < total * 1.005


def test_tiers_shape_the_packing():
    rng = random.Random(5)
    counts = Counter(min(512, int(rng.expovariate(1 / 60)) + 1) for _ in range(3_000))
    by = {tiers: [(p.times, p.items) for p in pack_sizes(512, counts, tiers)] for tiers in (1, 2, 3, 4)}
    assert len({str(x) for x in by.values()}) == 4
    total = sum(s * n for s, n in counts.items())
    assert all(sum(t for t, _ in x) * 512 < total * 1.01 for x in by.values())
    for p in pack_sizes(512, {200: 4, 100: 1, 60: 3, 30: 5}, 3):  # windows of 256 hold a 200 and a gap filled from shorter tiers
        assert 200 not in dict(p.items) or p.tier == 1 and dict(p.items)[200] == 2


def test_groups_have_their_share_of_every_tier(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.randrange(1, 700)) for i in range(900)], "doc_id long, n_tokens long")
    rows = pack(df, [(1, 512)], "doc_id", step=8, shard_rows=100).select("container_no", "window_length", "step_group").distinct().collect()
    groups = {r["step_group"] for r in rows}
    for length in {r["window_length"] for r in rows}:
        held = Counter(r["step_group"] for r in rows if r["window_length"] == length)
        assert max(held.values()) - min(held[g] for g in groups) <= 2


def test_pack(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([0, 1, 30, 64, 65, 200, rng.randrange(1, 90)]), "x", 1) for i in range(300)] + [(1000, 0, "x", 1)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, capacity string, _rank int")
    rows = pack(df.select("doc_id", "n_tokens"), [(1, 64), (2, 128)], "doc_id", step=4, shard_rows=40).collect()
    for limit, capacity in ((1, 64), (2, 128)):
        own = [r for r in rows if r["limit_id"] == limit]
        pieces = defaultdict(list)
        fill = Counter()
        for r in own:
            pieces[r["doc_id"]].append((r["piece_no"], r["n_tokens"]))
            fill[r["container_no"]] += r["n_tokens"]
        for i, n, *_ in items:
            got = [s for _, s in sorted(pieces[i])]
            assert sum(got) == n and (len(got) == 1 if n <= capacity else got[:-1] == [capacity] * (len(got) - 1) and 0 < got[-1] <= capacity)
        assert max(fill.values()) <= capacity
        assert all(r["container_fill"] == fill[r["container_no"]] for r in own if r["n_tokens"])
        groups = Counter(g for _, g in {(r["container_no"], r["step_group"]) for r in own if r["n_tokens"]})
        assert max(groups.values()) - min(groups.values()) <= 1


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(none, [(1, 8)], "doc_id").count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), [], "doc_id").count() == 0
    only = pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, n_tokens long"), [(1, 8)], "doc_id").collect()
    assert {(r["container_no"], r["container_fill"]) for r in only} == {(0, -1)}
