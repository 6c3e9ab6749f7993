"""Mixing sources to target weights.

Each source's records lie in one seeded order, repeated pass by pass, and
their running sizes (a prefix sum over hash shards, so no source meets in one
task) say which records the source's quota takes and in which block each
falls. Blocks are released and due by the source's weight, and
earliest-deadline-first puts them in slots, so at no time is a source a block
or more away from its share. A block has a bounded number of tokens, so there
are as many as the data need; a task for each mix runs through them, one step a
block (some 4 MB of text) and with no more in memory than the sources, and
streams the slots into a table that is joined like any other. The driver sees
the totals of the sources, never shards, blocks or records.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specstrata.llm.tokens import VOCABULARY, token_counts
from specstrata.session import materialize, table

#: About so many records are summed up in one window.
SHARD_ROWS = 100_000
#: Most tokens of a block; a mix of less than BLOCKS such blocks has BLOCKS smaller ones.
BLOCK_TOKENS = 1 << 20
BLOCKS = 4096
#: Slots written at once.
FRAME = 100_000


def pfair(counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block number) of each slot in turn.

    Block j of a source with n of N blocks is released at floor(jN/n) and due
    at ceil((j+1)N/n); in each slot the released block due first runs.
    """
    total = sum(counts.values())
    done = dict.fromkeys(counts, 0)
    ready: list[tuple[int, int, str]] = []
    waiting = sorted((0, s) for s, n in counts.items() if n)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heappop(waiting)
            heappush(ready, (-(-(done[s] + 1) * total // counts[s]), -counts[s], s))
        _, _, s = heappop(ready)
        yield s, done[s]
        done[s] += 1
        if done[s] < counts[s]:
            heappush(waiting, (done[s] * total // counts[s], s))


def mix_plan(targets: list[tuple[int, str, float, int]], sizes: dict[str, int], blocks: int = BLOCKS, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> list[dict]:
    """Quota, passes, block size and number of blocks of every (mix_id, source).

    A mix is the largest in which every source that has text meets its share
    within its cap on repeats; a source without text gives nothing, and the
    others keep their proportions. With ``total_tokens`` the mix has that size
    instead: a source that its cap keeps below its share gives all it may, so
    the whole shrinks and the real shares tell.
    """
    plan: list[dict] = []
    for mix_id in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == mix_id]
        whole = total_tokens or min((cap * sizes[s] / share for _, s, share, cap in own if sizes.get(s)), default=0)
        quota = {s: min(round(share * whole), cap * sizes.get(s, 0)) for _, s, share, cap in own}
        block = min(block_tokens, max(1, -(-sum(quota.values()) // blocks)))
        for _, s, share, cap in own:
            plan.append({"mix_id": mix_id, "source": s, "share": share, "cap": cap, "size": sizes.get(s, 0), "quota": quota[s], "block": block, "passes": -(-quota[s] // max(1, sizes.get(s, 0))), "blocks": -(-quota[s] // block)})
    return plan


def schedule(spark, plan: list[dict], frame: int = FRAME) -> DataFrame:
    """mix_id, source, _block_no, slot_no of every block of every mix, made by one task a mix."""
    counts: dict[int, dict[str, int]] = {}
    for p in plan:
        counts.setdefault(p["mix_id"], {})[p["source"]] = p["blocks"]
    mixes = spark.createDataFrame([(m,) for m in counts], "mix_id int").repartitionById(max(1, len(counts)), F.col("mix_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mix_id in pdf["mix_id"].tolist():
                slots = enumerate(pfair(counts[mix_id]))
                while rows := [(mix_id, s, j, t) for t, (s, j) in islice(slots, frame)]:
                    yield pd.DataFrame(rows, columns=["mix_id", "source", "_block_no", "slot_no"])

    return mixes.mapInPandas(run, "mix_id int, source string, _block_no long, slot_no long")


def read_targets(targets: DataFrame) -> list[tuple[int, str, float, int]]:
    """(mix_id, source, share, cap) of the table of wanted shares, a handful by its nature; rows without a positive share or cap ask for nothing."""
    rows = targets.select("mix_id", "source", "target_share", "max_repeats").where("mix_id is not null and source is not null and target_share > 0 and max_repeats > 0").distinct().collect()
    return sorted(tuple(r) for r in rows)


def mixture(
    sizes: DataFrame, targets: list[tuple[int, str, float, int]], seed: int = 7, blocks: int = BLOCKS, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, frame: int = FRAME
) -> tuple[DataFrame, list[dict]]:
    """The chosen records (mix_id, source, doc_id, pass_no, n_tokens, slot_no, start_token) and the plan.

    ``sizes`` (doc_id, source, n_tokens) must be fixed. Records of no size, no
    source or a source no mix names are never chosen. The record at which a
    quota ends is taken if that comes nearer to the quota than leaving it.
    """
    spark = sizes.sparkSession
    named = sorted({t[1] for t in targets})
    known = sizes.where(F.col("source").isin(named) & (F.col("n_tokens") > 0)).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    of_source = known.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    shards = -(-max((r["rows"] for r in of_source), default=0) // shard_rows) or 1
    known = known.withColumn("_shard", F.pmod(F.xxhash64("_h"), F.lit(shards)).cast("int"))
    plan = mix_plan(targets, {r["source"]: r["n"] for r in of_source}, blocks, total_tokens, block_tokens)
    passes = [(p["mix_id"], p["source"], k, k * p["size"], p["quota"], p["block"]) for p in plan for k in range(p["passes"])]
    before = Window.partitionBy("source").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # over shards, not records
    totals = known.groupBy("source", "_shard").agg(F.sum("n_tokens").alias("n"))
    offsets = materialize(totals.select("source", "_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_start")))
    wanted = spark.createDataFrame(passes, "mix_id int, source string, pass_no int, _pass_start long, _quota long, _block long")
    within = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.withColumn("_in_shard", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(offsets, ["source", "_shard"])
    every = placed.join(F.broadcast(wanted), "source").withColumn("start_token", F.col("_pass_start") + F.col("_shard_start") + F.col("_in_shard"))  # passes are bounded by the caps
    over = F.col("start_token") + F.col("n_tokens") - F.col("_quota")
    chosen = every.where((F.col("start_token") < F.col("_quota")) & (over <= F.col("_quota") - F.col("start_token")))
    chosen = chosen.withColumn("_block_no", F.floor(F.col("start_token") / F.col("_block")))
    slots = materialize(schedule(spark, plan, frame))
    return chosen.join(slots, ["mix_id", "source", "_block_no"]).select("mix_id", "slot_no", "source", "doc_id", "pass_no", "n_tokens", "start_token"), plan


def _pages(spark, sf_dir: str, vocabulary: str) -> DataFrame:
    return materialize(token_counts(table(spark, sf_dir, "documents").where("doc_id is not null and source is not null"), ["doc_id", "source"], vocabulary=vocabulary).distinct())


def p8_mixture(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The chosen pages of every mix; slot_no orders the blocks, start_token the pages of a source."""
    return mixture(_pages(spark, sf_dir, vocabulary), read_targets(table(spark, sf_dir, "mix_targets")))[0]


def p8_shares(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Target and real share of every source of every mix, with pages, tokens and the most often a page is used."""
    chosen, plan = mixture(_pages(spark, sf_dir, vocabulary), read_targets(table(spark, sf_dir, "mix_targets")))
    real = chosen.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pages"), F.max(F.col("pass_no") + 1).alias("most_used"))
    wanted = spark.createDataFrame([(p["mix_id"], p["source"], p["share"], p["cap"], 0 < p["size"] and p["quota"] == p["cap"] * p["size"]) for p in plan], "mix_id int, source string, target_share double, max_repeats int, capped boolean")
    joined = wanted.join(real, ["mix_id", "source"], "left").fillna(0, ["n_tokens", "n_pages", "most_used"])
    return joined.withColumn("real_share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("mix_id")))
