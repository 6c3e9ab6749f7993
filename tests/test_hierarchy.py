import random
from collections import defaultdict

from pyspark.sql import functions as F

from specstrata.operators import hierarchy as H


def brute_paths(nodes, edges):
    up = defaultdict(set)
    for v, p in edges:
        up[v].add(p)

    def endless(v, seen=()):
        return v in seen or any(endless(p, (*seen, v)) for p in up[v])

    def ways(v):
        return [[v]] if not up[v] else [w + [v] for p in sorted(up[v]) for w in ways(p)]

    return sorted((v, "cycle") if endless(v) else (v, "/".join(map(str, w))) for v in nodes for w in ([[v]] if endless(v) else ways(v)))


def forest_rows(spark, nodes, edges, stretch, at_once=H.AT_ONCE, homes=7):
    up = dict(edges)
    df = spark.createDataFrame([(v, up.get(v), v, v // homes) for v in nodes], "v long, parent long, label long, home long")
    ends = H.peel(df.select("v"), df.where("parent is not null").select("v", "parent"), at_once)
    iv = H.euler_intervals(df.join(ends, "v", "left_semi"), at_once)
    paths = H.tour_paths(iv.withColumn("label", F.col("v")).withColumn("kind", F.lit(0)), stretch)
    good = [tuple(r) for r in paths.select("v", "path").collect()]
    return sorted(good + [(r[0], "cycle") for r in df.join(ends, "v", "left_anti").select("v").collect()]), {r["v"]: r for r in iv.collect()}


def test_forests_with_cycles_and_cut_tours(spark):
    rng = random.Random(1)
    nodes = list(range(60))
    edges = [(v, rng.randrange(v)) for v in range(1, 40) if rng.random() < 0.9] + [(v, v - 1) for v in range(45, 55)] + [(40, 41), (41, 42), (42, 40), (43, 42), (44, 44)]
    want = brute_paths(nodes, edges)
    rows = {}
    for at_once in (1_000_000, 12):  # 12: several rounds of peeling, many blocks, splitters of splitters
        got, iv = forest_rows(spark, nodes, edges, 7, at_once)
        assert got == want
        assert all(iv[v]["depth"] == p.count("/") and iv[v]["root"] == int(p.split("/")[0]) for v, p in got if p != "cycle")
        rows[at_once] = sorted(tuple(r) for r in iv.values())
    assert rows[1_000_000] == rows[12]
    ends = {v: iv[v] for v, p in want if p != "cycle"}
    assert {r["exit"] for r in ends.values() if r["v"] == r["root"]} == {-1}


def test_a_long_chain_in_no_order(spark):
    rng = random.Random(2)
    ids = rng.sample(range(1000), 60)
    edges = list(zip(ids[1:], ids))
    got, iv = forest_rows(spark, ids, edges, 40, at_once=30, homes=90)
    assert got == brute_paths(ids, edges) and iv[ids[-1]]["depth"] == 59 and iv[ids[0]]["entry"] == -120


def test_star_wider_than_a_shard(spark):
    df = spark.createDataFrame([(0, None, 0, 0)] + [(i, 0, i % 50, 0) for i in range(1, 60)] + [(70, 3, 70, 1), (71, 3, 71, 1)], "v long, parent long, label long, home long")
    tours = []
    for wide in (10, 1000):
        arcs = {}
        for r in H._next_arcs(df, wide).collect():
            arcs |= {2 * r["v"]: r["down_next"], 2 * r["v"] + 1: r["up_next"]}
        at, seen = 0, []
        while at is not None:
            seen.append(at)
            at = arcs[at]
        tours.append(seen)
    assert tours[0] == tours[1] and len(seen) == 124 and [x // 2 for x in seen if x % 2 == 0][1:4] == [50, 1, 51]


def test_graph_with_many_parents(spark):
    nodes = list(range(12))
    edges = [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (5, 3), (5, 2), (6, 7), (7, 6), (8, 7), (8, 0), (9, 8), (10, 10)]
    n, e = spark.createDataFrame([(v,) for v in nodes], "v long"), spark.createDataFrame(edges, "v long, parent long")
    ends = H.peel(n, e)
    ways = H.unfold(ends, e.join(ends, "v", "left_semi")).collect()
    by = {r["way"]: r for r in ways}

    def path(w):
        r = by[w]
        return (path(r["above"]) + "/" if r["above"] is not None else "") + str(r["v"])

    got = sorted((r["v"], path(r["way"])) for r in ways) + [(v, "cycle") for v in sorted(set(nodes) - {r[0] for r in ends.collect()})]
    assert sorted(got) == brute_paths(nodes, edges)


def test_heading_parents(spark):
    rng = random.Random(4)
    rows = [(i, f"page{i % 3}" if i < 90 else "long", rng.randrange(40) if i < 90 else i, rng.randrange(1, 7)) for i in range(200)] + [(900, None, 1, 1), (901, "page0", None, 1), (902, "page0", 5, None)]
    want = {}
    for v, page, pos, lev in rows:
        above = [(p, n) for n, q, p, m in rows if page is not None and pos is not None and lev is not None and q == page and p is not None and m is not None and p < pos and m < lev]
        # of rows at one pos only those not shadowed by a later push count
        want[v] = max(above)[0] if above else None
    df = spark.createDataFrame(rows + rows[:20], "heading_no long, page_url string, pos int, level_no int")
    pos_of = {r[0]: r[2] for r in rows}
    for part in (100_000, 13):
        got = {r["v"]: None if r["parent"] is None else pos_of[r["parent"]] for r in H.heading_parents(df, part).collect()}
        assert got == want
    assert H.heading_parents(df.limit(0)).count() == 0


def test_descendants_and_nodes_of_all_kinds(spark, tmp_path):
    names = [(i, f"n{i}") for i in range(1, 12)]
    ups = {2: "n1", 3: " n2 ", 4: "n4", 5: "n4", 6: "n5", 7: "n8", 8: "n7", 9: "none"}
    adds = {2: ["n1"], 3: ["n1"], 4: ["n2", "n3", "n2"], 6: ["n7", "n4"], 7: ["n6"], 8: ["n6", "n10"], 9: ["n4"], 11: ["n11"]}
    spark.createDataFrame([(i, n, ups.get(i), adds.get(i)) for i, n in names], "idl_no long, idl_name string, inheritance string, includes array<string>").write.parquet(f"{tmp_path}/idlnames.parquet")
    spark.createDataFrame([(1, "p", 1, 1), (2, "p", 2, 2), (3, "p", 3, 3), (4, "p", 4, 2), (5, "q", 1, 2)], "heading_no long, page_url string, pos int, level_no int").write.parquet(f"{tmp_path}/headings.parquet")
    no = {n: i for i, n in names}
    links = [("inheritance", v, no[u.strip()]) for v, u in ups.items() if u.strip() in no] + [("includes", v, no[u]) for v, us in adds.items() for u in us] + [("headings", 2, 1), ("headings", 3, 2), ("headings", 4, 1)]
    want = {(k, p, v) for k, v, p in links}
    while more := {(k, a, d) for k, a, m in want for j, n, d in want if (k, m) == (j, n)} - want:
        want |= more
    pairs = [tuple(r) for r in H.p5_descendants(spark, str(tmp_path)).collect()]
    assert sorted(pairs) == sorted(want)

    rows = H.p5_nodes(spark, str(tmp_path)).collect()
    assert all(r["n_descendants"] == sum(k == r["hierarchy"] and a == r["node_id"] for k, a, _ in want) for r in rows)
    endless = sorted((r["hierarchy"], r["node_id"], r["root_id"], r["depth"], r["entry_no"], r["exit_no"], r["node_path"]) for r in rows if r["is_endless"])
    assert endless == [(k, v, *[None] * 4, "cycle") for k, vs in (("includes", (6, 7, 8, 11)), ("inheritance", (4, 5, 6, 7, 8))) for v in vs]
    whole = [r for r in rows if not r["is_endless"]]
    assert len({(r["hierarchy"], r["node_path"]) for r in whole}) == len(whole)
    assert sorted(r["depth"] for r in whole if r["hierarchy"] == "includes" and r["node_id"] in (4, 9)) == [2, 2, 3, 3]
    inside = {(a["hierarchy"], a["node_id"], b["node_id"]) for a in whole for b in whole if (a["hierarchy"], a["root_id"]) == (b["hierarchy"], b["root_id"]) and a["entry_no"] < b["entry_no"] and b["exit_no"] < a["exit_no"]}
    ended = {(r["hierarchy"], r["node_id"]) for r in whole}
    assert inside == {p for p in want if (p[0], p[2]) in ended}
