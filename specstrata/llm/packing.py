"""Filling containers of fixed capacity with items.

Hierarchical multi-length packing on the histogram of sizes, which is at most
as long as the capacity, whatever the number of items. Items are routed to
tiers of window lengths, the capacity and its halves, each to the shortest
window that holds it. From the longest tier to the shortest, a tier's items
are packed into windows of its own length, largest first, and the gaps of the
windows are filled from shorter tiers; as many windows as fit make a container,
and what space those leave together is filled from shorter tiers once more.
Equal containers are repeated as often as the histogram allows. Items then
find their place by their rank within their size, without meeting in a task.

Step groups get the containers of each tier in turn, forth and back in order
of cost, so every group has its share of every tier.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specstrata.llm.tokens import VOCABULARY, token_counts
from specstrata.session import materialize, table

#: Items of about so many documents are ranked in one window.
SHARD_ROWS = 100_000
STEP = 16
#: Window lengths: the capacity, its half, a quarter and an eighth.
TIERS = 4


@dataclass
class Pattern:
    """``times`` containers of windows of one tier, numbered from ``first``, each holding items as (size, how many)."""

    times: int
    items: list[tuple[int, int]]
    first: int = 0
    tier: int = 0

    @property
    def fill(self) -> int:
        return sum(s * k for s, k in self.items)

    @property
    def cost(self) -> int:
        return sum(s * s * k for s, k in self.items)


class Stock:
    """The items not yet placed: how many of each size, the sizes in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.left)

    def largest(self, most: int) -> int | None:
        """The largest size up to ``most``."""
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else None

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def fill(self, room: int, most: int, times: int) -> tuple[Counter, int]:
        """Items for a gap of ``room``, largest first and none above ``most``, and how many of ``times`` such gaps they serve; they are not taken yet."""
        items: Counter = Counter()
        size = self.largest(min(room, most))
        while size is not None:
            k = min(room // size, self.left[size])
            items[size] += k
            room -= k * size
            times = min(times, self.left[size] // k)
            size = self.largest(min(room, size - 1))
        return items, times


def pack_sizes(capacity: int, counts: dict[int, int], tiers: int = TIERS) -> list[Pattern]:
    """Patterns that place all items of ``counts`` (size from 1 to capacity -> number)."""
    stock = Stock(counts)
    lengths = [capacity >> k for k in range(tiers) if capacity >> k]
    patterns: list[Pattern] = []
    number = 0

    def put(items: Counter, times: int, tier: int) -> None:
        nonlocal number
        patterns.append(Pattern(times, sorted(items.items(), reverse=True), number, tier))
        number += times

    for tier, length in enumerate(lengths):
        shorter = lengths[tier + 1] if tier + 1 < len(lengths) else 0  # the tier's own items are longer than this
        windows: list[tuple[Counter, int]] = []
        while (size := stock.largest(length)) is not None and size > shorter:
            items, times = stock.fill(length, length, stock.left[size])
            for s, k in items.items():
                stock.take(s, k * times)
            windows.append((items, times))
        # windows to containers: whole ones of one kind, then the odd windows, fullest first
        per = capacity // length
        whole = [(Counter({s: k * per for s, k in items.items()}), times // per) for items, times in windows]
        odd = [items for items, times in windows for _ in range(times % per)]
        odd.sort(key=lambda items: -sum(s * k for s, k in items.items()))
        for at in range(0, len(odd), per):
            whole.append((sum(odd[at : at + per], Counter()), 1))
        for items, times in whole:
            room = capacity - sum(s * k for s, k in items.items())
            while times:
                more, n = stock.fill(room, shorter, times)
                for s, k in more.items():
                    stock.take(s, k * n)
                put(items + more, n, tier)
                times -= n
    return patterns


def step_starts(patterns: list[Pattern]) -> list[int]:
    """For each pattern the place of its first container in the order of tiers and, within one, of descending cost."""
    order = sorted(range(len(patterns)), key=lambda i: (patterns[i].tier, -patterns[i].cost, i))
    starts, at = [0] * len(patterns), 0
    for i in order:
        starts[i] = at
        at += patterns[i].times
    return starts


def pack(sizes: DataFrame, limits: list[tuple[int, int]], item: str, step: int = STEP, tiers: int = TIERS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Place the items (``item``, n_tokens) in containers of each (limit_id, capacity).

    An item larger than the capacity is split into full containers and a rest,
    which is packed like any item; no other item is split. Items of size 0
    (null or empty texts) are dealt over the containers. Without limits or
    items the result is empty. ``sizes`` must be fixed.
    """
    spark = sizes.sparkSession
    if not limits:
        limits = [(0, 1)]
        sizes = sizes.limit(0)
    shards = -(-sizes.count() // shard_rows) or 1
    caps = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in limits])
    every = sizes.select(F.col(item).alias("_item"), "n_tokens", F.pmod(F.xxhash64(F.col(item)), F.lit(shards)).cast("int").alias("_shard"), F.explode(caps).alias("_l"))
    every = every.select("_item", "n_tokens", "_shard", "_l.limit_id", "_l.capacity").withColumn("_full", F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)))
    rests = every.select("limit_id", "capacity", "_shard", "_item", F.col("_full").alias("piece_no"), (F.col("n_tokens") - F.col("_full") * F.col("capacity")).alias("_size"))
    split = every.where("_full > 0").select("limit_id", "capacity", "_shard", "_item", "_full")

    counts = materialize(rests.groupBy("limit_id", "_size", "_shard").agg(F.count("*").alias("_n")).unionByName(split.groupBy("limit_id", F.lit(-1).cast("long").alias("_size"), "_shard").agg(F.sum("_full").alias("_n"))))
    histogram: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("limit_id", "_size").agg(F.sum("_n").alias("n")).collect():  # at most as many rows as the capacities have sizes
        histogram.setdefault(r["limit_id"], {})[r["_size"]] = r["n"]
    segments: dict[int, dict[str, np.ndarray]] = {}
    totals: dict[int, int] = {}
    for limit_id, capacity in limits:
        counted = histogram.get(limit_id, {})
        patterns = pack_sizes(capacity, counted, tiers)
        if full := counted.get(-1, 0):  # pieces that fill a container each; they are numbered like items of a size of their own
            patterns.append(Pattern(full, [(capacity, 1)], sum(p.times for p in patterns)))
        order = step_starts(patterns)
        totals[limit_id] = sum(p.times for p in patterns)
        used: dict[int, int] = {}
        rows = []
        for i, (p, at) in enumerate(zip(patterns, order)):
            for s, k in p.items:
                s = -1 if full and i == len(patterns) - 1 else s
                rows.append((s, used.get(s, 0), p.first, k, at, p.fill, capacity >> p.tier))
                used[s] = used.get(s, 0) + p.times * k
        rows.sort()
        segments[limit_id] = dict(zip(("size", "rank", "first", "per", "order", "fill", "window"), np.array(rows, dtype=np.int64).reshape(-1, 7).T))
    plan = spark.sparkContext.broadcast((segments, totals, step))  # grows with the capacities, not with the data

    before = Window.partitionBy("limit_id", "_size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("limit_id", "_size", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("limit_id", "_size", "_shard").orderBy("_item")
    ranked = rests.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["limit_id", "_size", "_shard"])
    ranked = ranked.select("limit_id", "capacity", "_item", "piece_no", F.col("_size").alias("n_tokens"), "_size", (F.col("_r") + F.col("_offset")).alias("_rank"))
    # full pieces need no window of their own: an item's follow each other, so one row an item is summed
    upto = Window.partitionBy("limit_id", "_shard").orderBy("_item").rowsBetween(Window.unboundedPreceding, 0)
    begun = split.withColumn("_r", F.sum("_full").over(upto) - F.col("_full")).join(offsets.where("_size = -1").select("limit_id", "_shard", "_offset"), ["limit_id", "_shard"])
    begun = begun.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    full_pieces = begun.select("limit_id", "capacity", "_item", "piece_no", F.col("capacity").alias("n_tokens"), F.lit(-1).cast("long").alias("_size"), (F.col("_r") + F.col("_offset") + F.col("piece_no")).alias("_rank"))
    placed = ranked.unionByName(full_pieces).withColumnRenamed("_item", item)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments, totals, step = plan.value
        for pdf in batches:
            for limit_id, part in pdf.groupby("limit_id", sort=False):
                seg, total = segments[limit_id], max(1, totals[limit_id])
                size, rank = part["_size"].to_numpy(), part["_rank"].to_numpy()
                key = ((seg["size"] + 1) << 40) + seg["rank"]
                at = np.searchsorted(key, ((size + 1) << 40) + rank, side="right") - 1
                empty = size == 0
                at[empty] = 0
                if len(key):
                    container = seg["first"][at] + (rank - seg["rank"][at]) // seg["per"][at]
                    place_no = seg["order"][at] + container - seg["first"][at]
                    fill, window = seg["fill"][at], seg["window"][at]
                else:
                    container = place_no = fill = window = np.zeros(len(part), np.int64)
                container = np.where(empty, rank % total, container)
                groups = -(-total // step)
                turn, k = np.divmod(place_no, groups)
                group = np.where(turn % 2 == 0, k, groups - 1 - k)
                out = part.drop(columns=["_rank", "_size"]).assign(container_no=container, step_group=np.where(empty, -1, group), container_fill=np.where(empty, -1, fill), window_length=np.where(empty, -1, window))
                yield out[["limit_id", "capacity", "container_no", "window_length", "step_group", item, "piece_no", "n_tokens", "container_fill"]]

    kind = sizes.schema[item].dataType.simpleString()
    return placed.mapInPandas(place, f"limit_id int, capacity long, container_no long, window_length long, step_group long, `{item}` {kind}, piece_no long, n_tokens long, container_fill long")


def read_limits(limits: DataFrame) -> list[tuple[int, int]]:
    """The (limit_id, capacity) of a table of container sizes, a handful by its nature."""
    return sorted({(r["limit_id"], r["capacity"]) for r in limits.select("limit_id", "capacity").where("limit_id is not null and capacity > 0").collect()})


def p7_containers(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every page's container for each capacity, with the length of the container's windows; pages of size 0 have step_group, container_fill and window_length -1."""
    sizes = materialize(token_counts(table(spark, sf_dir, "documents").where("doc_id is not null"), ["doc_id"], vocabulary=vocabulary).distinct())
    return pack(sizes, read_limits(table(spark, sf_dir, "pack_limits")), "doc_id")


def p7_fill(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers, tokens and unused share per capacity and window length; a row with window_length null sums up a capacity."""
    placed = p7_containers(spark, sf_dir, vocabulary).where("n_tokens > 0")
    containers = placed.groupBy("limit_id", "capacity", "window_length", "container_no").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("pieces"))
    by_tier = containers.groupBy("limit_id", "capacity", "window_length").agg(F.count("*").alias("n"), F.sum("pieces").alias("p"), F.sum("fill").alias("f"), F.max("fill").alias("m"))
    both = by_tier.withColumn("window_length", F.explode(F.array("window_length", F.lit(None).cast("long"))))  # a row for its tier and one for the sum
    sums = [F.sum("n").alias("n_containers"), F.sum("p").alias("n_pieces"), F.sum("f").alias("n_tokens"), F.max("m").alias("fullest"), (1 - F.sum("f") / (F.sum("n") * F.first("capacity"))).alias("unused_share")]
    return both.groupBy("limit_id", "capacity", "window_length").agg(*sums)
