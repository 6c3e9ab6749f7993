"""Parent-child links to full hierarchies.

Links are peeled first: whatever has all its parents taken off is taken off
too, and what is left hangs on a cycle. The rest form forests; a graph with
several parents per node is unfolded into the forest of its ways. The
forest's Euler tours are linked lists of arcs, two per node. They are ranked
in parallel: every task walks the stretches of the lists that lie within its
own block of nodes; the arcs at which the blocks are entered are the splitters
of a much shorter list, which is ranked in turn (in one task if its size, which
is checked, allows, else by sampled splitters again), and the ranks are spread
back over the stretches. Ranks give entry and exit of each node, the balance of
arcs its depth, and a scan over equal stretches of the tours, each with the
nodes open at its start, the paths. The paths give each node's descendants;
below nodes without an end, where there is no tour, they come from the closure
of the links by doubled steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specstrata.session import materialize, table

STRETCH = 50_000
#: Rows of a few numbers that one task works on at once; larger lists are cut.
AT_ONCE = 1_000_000
KINDS = {"inheritance": 0, "headings": 1, "includes": 2}


def _next_arcs(nodes: DataFrame, wide: int = 200_000) -> DataFrame:
    """v, home, down_next, up_next: the arcs that follow the two arcs of each node, down(v) = 2v and up(v) = 2v + 1. nodes: v, parent, label, home; siblings are ordered by label.

    The children of a node that has more than ``wide`` are ordered in shards of
    equal size, as many as needed.
    """
    kids = nodes.where("parent is not null").select("v", "parent", "label")
    sizes = kids.groupBy("parent").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= wide:
        of_parent = Window.partitionBy("parent").orderBy("label", "v")
        placed = kids.withColumn("sibling", F.lead("v").over(of_parent)).withColumn("k", F.row_number().over(of_parent)).select("v", "parent", "sibling", (F.col("k") == 1).alias("is_first"))
    else:
        shards = -(-most // wide)
        crowded = kids.join(sizes.where(F.col("n") > wide).select("parent"), "parent", "left_semi")
        bounds = materialize(crowded.groupBy("parent").agg(F.percentile_approx("label", F.array(*[F.lit(k / shards) for k in range(1, shards)]), 100 * shards).alias("cuts")))
        cut = kids.join(bounds, "parent", "left").withColumn("s", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("label")))))
        of_shard = Window.partitionBy("parent", "s").orderBy("label", "v")
        inner = cut.withColumn("sibling", F.lead("v").over(of_shard)).withColumn("k", F.row_number().over(of_shard))
        firsts = inner.where("k = 1").select("parent", "s", "v").withColumn("after", F.lead("v").over(Window.partitionBy("parent").orderBy("s"))).withColumn("first_s", F.min("s").over(Window.partitionBy("parent"))).select("parent", "s", "after", "first_s")
        placed = inner.join(firsts, ["parent", "s"]).select("v", "parent", F.coalesce("sibling", "after").alias("sibling"), ((F.col("k") == 1) & (F.col("s") == F.col("first_s"))).alias("is_first"))
    child = placed.where("is_first").select(F.col("parent").alias("v"), F.col("v").alias("child"))
    after = placed.select("v", F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("up_next"))
    return nodes.select("v", "home").join(child, "v", "left").join(after, "v", "left").select("v", "home", F.coalesce(2 * F.col("child"), 2 * F.col("v") + 1).alias("down_next"), "up_next")


def walk(arc: np.ndarray, nxt: np.ndarray, steps: np.ndarray, sums: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next, steps, sums, last) of arcs (next -1 at an end) after walking as far as the given arcs go. The lists have no cycle."""
    order = np.argsort(arc)
    at = np.searchsorted(arc, nxt, sorter=order)
    at[at == len(arc)] = 0
    ahead = order[at] if len(arc) else at
    ahead = np.where((nxt >= 0) & (arc[ahead] == nxt), ahead, -1) if len(arc) else ahead
    nxt, steps, sums, last = nxt.copy(), steps.copy(), sums.copy(), last.copy()
    going = np.flatnonzero(ahead >= 0)
    while len(going):
        to = ahead[going]
        steps[going], sums[going], last[going], nxt[going], ahead[going] = steps[going] + steps[to], sums[going] + sums[to], last[to], nxt[to], ahead[to]
        going = going[ahead[going] >= 0]
    return nxt, steps, sums, last


LIST = "arc long, nxt long, steps long, sums long, last long"


def rank_list(arcs: DataFrame, at_once: int = AT_ONCE, every: int = 16, level: int = 0) -> DataFrame:
    """Linked lists without cycles (arc, nxt, steps, sums, last) walked to their ends: nxt is null, steps and sums are totals, last is the last arc.

    Up to ``at_once`` arcs one task walks them. Beyond, about one in ``every``
    arcs is a splitter: all arcs jump until they reach one, by doubling, the
    splitters form a shorter list, which is ranked, and every arc adds the
    rank of the splitter it reached.
    """
    arcs = materialize(arcs)
    if arcs.count() <= at_once:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if parts:
                pdf = pd.concat(parts)
                kept = walk(pdf["arc"].to_numpy(), pdf["nxt"].fillna(-1).to_numpy(dtype="int64"), *(pdf[c].to_numpy() for c in ("steps", "sums", "last")))
                yield pd.DataFrame({"arc": pdf["arc"].to_numpy(), "nxt": pd.array([pd.NA] * len(pdf), "Int64"), **dict(zip(("steps", "sums", "last"), kept[1:]))})

        return arcs.coalesce(1).mapInPandas(whole, LIST)

    def splits(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(level)), F.lit(every)) == 0

    done, going = arcs.where(F.col("nxt").isNull() | splits("nxt")), arcs.where(F.col("nxt").isNotNull() & ~splits("nxt"))
    going = materialize(going)
    while not going.isEmpty():
        ahead = done.unionByName(going).select(F.col("arc").alias("nxt"), F.col("nxt").alias("n"), F.col("steps").alias("st"), F.col("sums").alias("su"), F.col("last").alias("la"))
        moved = materialize(going.join(ahead, "nxt").select("arc", F.col("n").alias("nxt"), (F.col("steps") + F.col("st")).alias("steps"), (F.col("sums") + F.col("su")).alias("sums"), F.col("la").alias("last")))
        done, going = done.unionByName(moved.where(F.col("nxt").isNull() | splits("nxt"))), moved.where(F.col("nxt").isNotNull() & ~splits("nxt"))
    ranks = materialize(rank_list(done.where(splits("arc")), at_once, every, level + 1)).select(F.col("arc").alias("nxt"), F.col("steps").alias("st"), F.col("sums").alias("su"), F.col("last").alias("la"))
    ended = done.where("nxt is null and not " + f"pmod(xxhash64(arc, {level}), {every}) = 0")
    reached = done.where(F.col("nxt").isNotNull() & ~splits("arc")).join(ranks, "nxt").select("arc", F.lit(None).cast("long").alias("nxt"), (F.col("steps") + F.col("st")).alias("steps"), (F.col("sums") + F.col("su")).alias("sums"), F.col("la").alias("last"))
    return ended.unionByName(reached).unionByName(ranks.select(F.col("nxt").alias("arc"), F.lit(None).cast("long").alias("nxt"), F.col("st").alias("steps"), F.col("su").alias("sums"), F.col("la").alias("last")))


def euler_intervals(nodes: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """v, root, entry, exit and depth of every node of a forest (v, parent, label, home).

    Nodes of one ``home`` are ranked in one task; a home should hold what lies
    close in the tree and no more than some 100,000 nodes. Entries and exits
    count down to -1 at the end of the tour of a tree, so a descendant's
    interval lies within its ancestor's.
    """
    follow = materialize(_next_arcs(nodes))
    blocks = max(1, -(-2 * follow.count() // at_once))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts)
        v = pdf["v"].to_numpy()
        n = len(v)
        arc = np.concatenate([2 * v, 2 * v + 1])
        nxt = np.concatenate([pdf["down_next"].to_numpy(), pdf["up_next"].fillna(-1).to_numpy(dtype="int64")])
        nxt, steps, sums, last = walk(arc, nxt, np.ones(2 * n, np.int64), np.repeat(np.array([1, -1]), n), arc)
        out = {"v": v}
        for side, part in (("d", slice(0, n)), ("u", slice(n, 2 * n))):
            out |= {f"{side}_next": pd.Series(nxt[part]).astype("Int64").where(nxt[part] >= 0), f"{side}_steps": steps[part], f"{side}_sums": sums[part], f"{side}_last": last[part]}
        yield pd.DataFrame(out)

    sides = ", ".join(f"{s}_next long, {s}_steps long, {s}_sums long, {s}_last long" for s in "du")
    local = materialize(follow.repartition(blocks, "home").select("v", "down_next", "up_next").mapInPandas(within, f"v long, {sides}"))
    entered = local.select(F.explode(F.array("d_next", "u_next")).alias("arc")).where("arc is not null").distinct().withColumn("v", F.shiftright("arc", 1))
    down = F.col("arc") % 2 == 0
    pick = [F.when(down, F.col(f"d_{c}")).otherwise(F.col(f"u_{c}")).alias(name) for c, name in (("next", "nxt"), ("steps", "steps"), ("sums", "sums"), ("last", "last"))]
    ranks = materialize(rank_list(entered.join(local, "v").select("arc", *pick), at_once))
    whole = local.where("d_next is null and u_next is null")
    for side in "du":
        far = ranks.select(F.col("arc").alias(f"{side}_next"), F.col("steps").alias(f"_{side}s"), F.col("sums").alias(f"_{side}w"), F.col("last").alias(f"_{side}l"))
        local = (local.where("d_next is not null or u_next is not null") if side == "d" else local).join(far, f"{side}_next", "left")
    add = {f"{s}_steps": F.col(f"{s}_steps") + F.coalesce(f"_{s}s", F.lit(0)) for s in "du"} | {"d_sums": F.col("d_sums") + F.coalesce("_dw", F.lit(0)), "d_last": F.coalesce("_dl", "d_last")}
    every = whole.unionByName(local.withColumns(add).select(*whole.columns))
    return every.select("v", F.shiftright("d_last", 1).alias("root"), (-F.col("d_steps")).alias("entry"), (-F.col("u_steps")).alias("exit"), (-F.col("d_sums")).alias("depth"))


def tour_paths(intervals: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """v, label, kind and path (labels from the root joined by "/") of intervals with root, entry, exit, label, kind."""
    at = intervals.select("v", "root", "entry", "exit", "label", "kind", F.floor(F.col("entry") / stretch).alias("part"), F.floor(F.col("exit") / stretch).alias("upto"))
    carried = at.where("upto > part").withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("upto"))))
    both = at.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("carried", F.lit(True))).drop("upto")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ends, paths = None, [], []
        for pdf in batches:
            out = []
            for v, kind, root, part, entry, leave, label, carry in zip(pdf["v"].tolist(), pdf["kind"].tolist(), pdf["root"].tolist(), pdf["part"].tolist(), pdf["entry"].tolist(), pdf["exit"].tolist(), pdf["label"].tolist(), pdf["carried"].tolist()):
                if now != (root, part):
                    now, ends, paths = (root, part), [], []
                while ends and ends[-1] < entry:
                    ends.pop()
                    paths.pop()
                path = f"{paths[-1]}/{label}" if paths else str(label)
                ends.append(leave)
                paths.append(path)
                if not carry:
                    out.append((v, label, kind, path))
            yield pd.DataFrame(out, columns=["v", "label", "kind", "path"])

    return both.repartition("root", "part").sortWithinPartitions("root", "part", "entry").mapInPandas(scan, "v long, label long, kind int, path string")


def peel(nodes: DataFrame, edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """The nodes (v) all of whose ways up the edges (v, parent) end.

    What has no parent left is taken off, again and again. Up to ``at_once``
    edges one task does it; beyond, as many rounds as the graph is deep, each
    over the edges that are left.
    """
    left = materialize(edges.select("v", "parent").join(nodes.select(F.col("v").alias("parent")), "parent", "left_semi"))
    n = left.count()
    while n > at_once:
        stuck = left.select("v").distinct()
        still = materialize(left.join(stuck.select(F.col("v").alias("parent")), "parent", "left_semi").select("v", "parent"))
        m = still.count()
        if m == n:
            return nodes.join(stuck, "v", "left_anti")
        left, n = still, m

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts)
        ids, codes = np.unique(np.concatenate([pdf["v"].to_numpy(), pdf["parent"].to_numpy()]), return_inverse=True)
        v, parent = codes[: len(pdf)], codes[len(pdf) :]
        order = np.argsort(parent, kind="stable")
        starts = np.searchsorted(parent[order], np.arange(len(ids) + 1))
        waits = np.bincount(v, minlength=len(ids))
        free = np.flatnonzero(waits == 0)
        while len(free):
            sizes = starts[free + 1] - starts[free]
            edge = np.repeat(starts[free] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            below = v[order[edge]]
            np.subtract.at(waits, below, 1)
            free = np.unique(below[waits[below] == 0])
        yield pd.DataFrame({"v": ids[waits > 0]})

    return nodes.join(left.coalesce(1).mapInPandas(whole, "v long"), "v", "left_anti")


def unfold(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The forest of ways of an acyclic graph: way, parent way (null at a root), v."""
    tops = nodes.join(edges.select("v"), "v", "left_anti")
    layer = materialize(tops.select(F.monotonically_increasing_id().alias("way"), F.lit(None).cast("long").alias("above"), "v"))
    layers, base = layer, (layer.agg(F.max("way")).first()[0] or 0) + 1
    while True:
        step = edges.join(layer.select(F.col("v").alias("parent"), F.col("way").alias("above")), "parent").select("above", "v")
        layer = materialize(step.select((F.monotonically_increasing_id() + base).alias("way"), "above", "v"))
        top = layer.agg(F.max("way")).first()[0]
        if top is None:
            return layers
        layers, base = layers.unionByName(layer), top + 1


def closure(links: DataFrame) -> DataFrame:
    """All v and above of links (v, parent), cycles included, in as many rounds as the longest way without a repeat has binary digits."""
    pairs = jumps = materialize(links.select("v", F.col("parent").alias("above")).distinct())
    n = pairs.count()
    while n:
        step = jumps.select("v", F.col("above").alias("mid"))
        wider = materialize(pairs.unionByName(step.join(pairs.withColumnRenamed("v", "mid"), "mid").select("v", "above")).distinct())
        m = wider.count()
        if m == n:
            break
        jumps = materialize(step.join(jumps.withColumnRenamed("v", "mid"), "mid").select("v", "above").distinct())
        pairs, n = wider, m
    return pairs


def heading_parents(headings: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """v, parent and home (a stretch of a page) of headings: the parent is the nearest earlier row by pos of the page with a smaller level.

    Rows without page, pos or level are roots and parents of none. Of rows at
    the same pos, none is earlier than another; the one with the highest
    number counts as nearest.
    """
    rows = headings.select(F.col("heading_no").cast("long").alias("v"), "page_url", F.col("pos").cast("long").alias("pos"), F.col("level_no").cast("long").alias("lev")).where("v is not null").distinct()
    whole = rows.where("page_url is not null and pos is not null and lev is not null").withColumn("part", F.floor(F.col("pos") / part_rows))
    schema = "v long, parent long, page_url string, part long, pos long, lev long, open boolean"

    def scan(batches: Iterator[pd.DataFrame], stacks: bool) -> Iterator[pd.DataFrame]:
        now, stack, wait = None, [], []  # stack of (level, v), levels rising; wait: rows of the present pos
        out: list[tuple] = []

        def push() -> None:
            for lev, v, pos in wait:
                while stack and stack[-1][0] >= lev:
                    stack.pop()
                stack.append((lev, v, pos))
            wait.clear()

        def close() -> None:
            push()
            if stacks and now is not None:
                out.extend((v, None, now[0], now[1], pos, lev, True) for lev, v, pos in stack)

        for pdf in batches:
            for v, page, part, pos, lev, carry in zip(pdf["v"].tolist(), pdf["page_url"].tolist(), pdf["part"].tolist(), pdf["pos"].tolist(), pdf["lev"].tolist(), pdf["carry"].tolist()):
                if now != (page, part):
                    close()
                    now, stack = (page, part), []
                elif wait and wait[0][2] != pos:
                    push()
                if not carry and not stacks:
                    parent = next((s[1] for s in reversed(stack) if s[0] < lev), None)
                    out.append((v, parent, page, part, pos, lev, False))
                wait.append((lev, v, pos))
            yield pd.DataFrame(out, columns=["v", "parent", "page_url", "part", "pos", "lev", "open"]).astype({"parent": "Int64"})
            out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["v", "parent", "page_url", "part", "pos", "lev", "open"]).astype({"parent": "Int64"})

    def scanned(df: DataFrame, stacks: bool) -> DataFrame:
        return df.repartition("page_url", "part").sortWithinPartitions("page_url", "part", "pos", "v").mapInPandas(lambda it: scan(it, stacks), schema)

    plain = whole.withColumn("carry", F.lit(False))
    span = whole.agg(F.max("part") - F.min("part")).first()[0]
    if span:  # pages cut into parts: what is still open at the end of a part is carried to the later ones
        ends = scanned(plain, True).select("page_url", "part", "pos", "v", "lev")
        starts = whole.select("page_url", "part").distinct()

        def carry(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = sorted(set(pdf["start"].dropna().astype(int)))
            own = pdf[pdf["v"].notna()].sort_values(["part", "pos", "v"])
            rows, stack, k = [], [], 0
            seq = list(own[["part", "pos", "v", "lev"]].itertuples(index=False, name=None))
            for part in parts:
                while k < len(seq) and seq[k][0] < part:
                    while stack and stack[-1][3] >= seq[k][3]:
                        stack.pop()
                    stack.append(seq[k])
                    k += 1
                rows += [(int(s[2]), pdf["page_url"].iloc[0], part, int(s[1]), int(s[3])) for s in stack]
            return pd.DataFrame(rows, columns=["v", "page_url", "part", "pos", "lev"])

        known = ends.withColumn("start", F.lit(None).cast("long")).unionByName(starts.select("page_url", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("lev"), F.col("part").alias("start")))
        carried = known.groupBy("page_url").applyInPandas(lambda pdf: carry(pdf), "v long, page_url string, part long, pos long, lev long")
        plain = plain.unionByName(carried.withColumn("carry", F.lit(True)))
    found = scanned(plain, False).select("v", "parent", F.xxhash64("page_url", "part").alias("home"))
    rest = rows.where("page_url is null or pos is null or lev is null").select("v", F.lit(None).cast("long").alias("parent"), F.xxhash64("v").alias("home"))
    return found.unionByName(rest)


def idl_links(idlnames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (v), inheritance links and includes links (v, parent) of idlnames; a name is matched trimmed, case mattering."""

    def trim(c):
        return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    rows = idlnames.select(F.col("idl_no").cast("long").alias("v"), trim(F.col("idl_name")).alias("name"), trim(F.col("inheritance")).alias("up"), F.col("includes").alias("ups")).where("v is not null").distinct()
    rows = materialize(rows)
    names = rows.where("name is not null and name <> ''").groupBy(F.col("name").alias("up")).agg(F.min("v").alias("parent"))
    inherits = rows.where("up is not null and up <> ''").select("v", "up").join(names, "up").select("v", "parent")
    includes = rows.select("v", F.explode("ups").alias("up")).select("v", trim(F.col("up")).alias("up")).where("up is not null and up <> ''").join(names, "up").select("v", "parent").distinct()
    return rows.select("v").distinct(), inherits, includes


def crawl_forest(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One forest of all three hierarchies (v, parent, label, kind, home), the nodes below or on a cycle (v, label, kind), and the links of inheritance and includes (v, parent).

    Ids are coded as 4 id + kind, ways as 4 way + kind.
    """
    nodes, inherits, includes = idl_links(table(spark, sf_dir, "idlnames"))

    def code(df: DataFrame, kind: str, *columns: str) -> DataFrame:
        return df.select(*[(F.col(c) * 4 + KINDS[kind]).alias(c) for c in columns])

    every = materialize(code(nodes, "inheritance", "v").unionByName(code(nodes, "includes", "v")))
    edges = materialize(code(inherits, "inheritance", "v", "parent").unionByName(code(includes, "includes", "v", "parent")))
    ends = materialize(peel(every, edges))
    own = [F.shiftright("v", 2).alias("label"), (F.col("v") % 4).cast("int").alias("kind")]
    looped = materialize(every.join(ends, "v", "left_anti").select("v", *own))
    within = edges.join(ends, "v", "left_semi")
    of_kind = {kind: F.col("v") % 4 == KINDS[kind] for kind in ("inheritance", "includes")}
    ways = unfold(ends.where(of_kind["includes"]), within.where(of_kind["includes"])).withColumn("label", F.shiftright("v", 2))
    single = ends.where(of_kind["inheritance"]).join(within.where(of_kind["inheritance"]), "v", "left").select("v", "parent", *own)
    headings = heading_parents(table(spark, sf_dir, "headings"))
    forest = single.withColumn("home", F.xxhash64("v")).unionByName(ways.select((F.col("way") * 4 + KINDS["includes"]).alias("v"), (F.col("above") * 4 + KINDS["includes"]).alias("parent"), "label", F.lit(KINDS["includes"]).alias("kind"), F.xxhash64("way").alias("home")))
    forest = forest.unionByName(headings.select((F.col("v") * 4 + KINDS["headings"]).alias("v"), (F.col("parent") * 4 + KINDS["headings"]).alias("parent"), F.col("v").alias("label"), F.lit(KINDS["headings"]).alias("kind"), "home"))
    return materialize(forest), looped, edges


def forest_intervals(forest: DataFrame) -> DataFrame:
    return materialize(euler_intervals(forest).join(forest.select("v", "label", "kind"), "v"))


def _kind_name():
    code = F.col("kind")
    return F.when(code == 0, "inheritance").when(code == 1, "headings").otherwise("includes").alias("hierarchy")


def p5_found(spark, sf_dir: str) -> DataFrame:
    forest, looped, _ = crawl_forest(spark, sf_dir)
    paths = tour_paths(forest_intervals(forest))
    good = paths.select(_kind_name(), F.col("label").alias("node_id"), F.col("path").alias("node_path"))
    return good.unionByName(looped.select(_kind_name(), F.col("label").alias("node_id"), F.lit("cycle").alias("node_path")))


def _descendants(paths: DataFrame, looped: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (kind, ancestor_id, descendant_id), each once; a node on a cycle is among its own descendants.

    A descendant all of whose ways up end has only such ancestors, which its
    paths name. What is above any other node is the closure of the links
    between endless nodes, and what is above the ended nodes they lead to.
    """
    steps = F.split("path", "/")
    above = paths.select("label", "kind", F.explode(F.slice(steps, 1, F.size(steps) - 1).cast("array<long>")).alias("above"))
    ended = materialize(above.select((F.col("above") * 4 + F.col("kind")).alias("above"), (F.col("label") * 4 + F.col("kind")).alias("v")).distinct())

    endless = looped.select("v")
    links, ends = edges.join(endless, "v", "left_semi"), endless.select(F.col("v").alias("parent"))
    within, leaving = closure(links.join(ends, "parent", "left_semi")), links.join(ends, "parent", "left_anti")
    left = leaving.select("v", F.col("parent").alias("above"))
    left = left.unionByName(within.join(leaving.withColumnRenamed("v", "above"), "above").select("v", F.col("parent").alias("above")))
    further = left.withColumnRenamed("above", "mid").join(ended.withColumnRenamed("v", "mid"), "mid").select("v", "above")
    pairs = ended.unionByName(within).unionByName(left.unionByName(further).distinct())
    return pairs.select((F.col("v") % 4).cast("int").alias("kind"), F.shiftright("above", 2).alias("ancestor_id"), F.shiftright("v", 2).alias("descendant_id"))


def p5_descendants(spark, sf_dir: str) -> DataFrame:
    """Every node with each of its descendants, once however many ways lead from one to the other; a node on a cycle descends from itself."""
    forest, looped, edges = crawl_forest(spark, sf_dir)
    return _descendants(tour_paths(forest_intervals(forest)), looped, edges).select(_kind_name(), "ancestor_id", "descendant_id")


def p5_nodes(spark, sf_dir: str) -> DataFrame:
    """Root, depth and interval of every node on each of its ways (node_path), and its number of distinct descendants.

    Entry and exit count the arcs of the tour of a tree from 0, children in
    the order of their ids: within a hierarchy and root, what is below a row
    are the rows with entry and exit between its own. A node with a way up
    that never ends gets one row with is_endless, and neither root, depth nor
    interval.
    """
    forest, looped, edges = crawl_forest(spark, sf_dir)
    intervals = forest_intervals(forest)
    paths = materialize(tour_paths(intervals))
    numbers = _descendants(paths, looped, edges).groupBy("kind", F.col("ancestor_id").alias("label")).agg(F.count("*").alias("n"))
    tops = intervals.where("depth = 0").select(F.col("v").alias("root"), F.col("label").alias("root_id"), F.col("entry").alias("begin"))
    whole = intervals.join(paths.select("v", F.col("path").alias("node_path")), "v").join(tops, "root")
    whole = whole.select("kind", "label", "node_path", "root_id", "depth", (F.col("entry") - F.col("begin")).alias("entry_no"), (F.col("exit") - F.col("begin")).alias("exit_no"), F.lit(False).alias("is_endless"))
    ends = looped.select("kind", "label", F.lit("cycle").alias("node_path"), F.lit(True).alias("is_endless"))
    rows = whole.unionByName(ends, allowMissingColumns=True).join(numbers, ["kind", "label"], "left")
    return rows.select(_kind_name(), F.col("label").alias("node_id"), "node_path", "root_id", "depth", "entry_no", "exit_no", F.coalesce("n", F.lit(0)).alias("n_descendants"), "is_endless")
