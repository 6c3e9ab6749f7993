"""References to records that do not exist when they are made.

Parent and child keys are unioned, tagged, in long form and grouped by parent
table and key; within a group the parent flag is the running maximum of the
parents' ends of life in time order, so a child row lacks the flag exactly
when no parent row is alive at its time. The rows that lack it are summed by
referring table and month.

The long form is narrow (key hashes of 128 bits, time, row number) and written
once, so every table is read once and every key normalised once. Rows are
range-partitioned by key and time: the ranges are equal shares of the rows, so
a key that owns a third of them, even at one instant, is spread over many
tasks. What a task cannot know, whether an earlier range leaves the key at its
start alive, is told by one number a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.functions.urls import plain_href, utc_month
from specstrata.session import materialize, shuffle_partitions, table

FOREVER = (1 << 63) - 1
NEVER = -(1 << 63)
#: The references of the crawl tables with the table each points into; number k is that of the k-th, 0 stands for targets.
REFERENCES = (("dfns.href", "ids"), ("headings.href", "ids"), ("dfns.heading", "headings"), ("backrefs.href", "dfns"))
ROW = ["k1", "k2", "at", "ref", "row_id", "gone"]


def _row(target: str, key: Column, at: str, ref: int, row_id: Column, gone: Column) -> Column:
    return F.struct(
        F.when(key.isNotNull(), F.xxhash64(F.lit(target), key)).alias("k1"), F.xxhash64(F.lit(target + " again"), key).alias("k2"), F.unix_micros(at).alias("at"), F.lit(ref).alias("ref"), row_id.cast("long").alias("row_id"), gone.alias("gone")
    )


def child_row(target: str, key: Column, row_id: str, at: str, ref: int) -> Column:
    """A referring row in long form; ``ref`` is 1 or more. A null key refers to nothing."""
    return _row(target, key, at, ref, F.col(row_id), F.lit(NEVER))


def parent_row(target: str, key: Column, born: str, gone: Column | None = None) -> Column:
    """A target row in long form; a row without a key or a start of life is never alive."""
    return _row(target, key, born, 0, F.lit(0), F.lit(FOREVER) if gone is None else F.coalesce(F.unix_micros(gone), F.lit(FOREVER)))


def long_form(df: DataFrame, *rows: Column) -> DataFrame:
    """The rows in long form that each row of a table makes."""
    every = df.select(F.inline(F.array(*rows))).where("k1 is not null and (ref > 0 or at is not null)")
    return every.withColumn("at", F.coalesce("at", F.lit(NEVER)))


def orphan_references(long: DataFrame) -> DataFrame:
    """The child rows of ``long`` without a parent alive at their time: ref, row_id, at.

    Exact copies of a child row (same key, time, ref and row_id) count once. A
    child without a time has no living parent. An empty input gives an empty
    result.
    """
    spark = long.sparkSession
    order = ROW[:5]
    ranged = materialize(long).repartitionByRange(2 * shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Orphans as far as this range knows (``open``: of its first key), and one row with the range's boundary state: first and last key, end of life at the end."""
        first = last = before = None
        until, part = NEVER, -1
        for pdf in batches:
            if not len(pdf):
                continue
            k1, k2, at, ref, row_id, gone = (pdf[c].to_numpy() for c in ROW)
            part, n = int(pdf["part"].iloc[0]), len(pdf)
            new = np.ones(n, bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new[0] = last != (k1[0], k2[0])
            group = np.cumsum(new)
            values, rank = np.unique(gone, return_inverse=True)
            running = np.maximum.accumulate(rank + group * len(values)) - group * len(values)
            alive = values[running]
            alive[group == 0] = np.maximum(alive[group == 0], until)
            copy = np.zeros(n, bool)
            copy[1:] = ~new[1:] & (at[1:] == at[:-1]) & (ref[1:] == ref[:-1]) & (row_id[1:] == row_id[:-1])
            copy[0] = before == (k1[0], k2[0], at[0], ref[0], row_id[0])
            if first is None:
                first = k1[0], k2[0]
            out = (ref > 0) & ~copy & (alive <= at)
            opened = (k1[out] == first[0]) & (k2[out] == first[1])
            last, until, before = (k1[-1], k2[-1]), alive[-1], (k1[-1], k2[-1], at[-1], ref[-1], row_id[-1])
            yield pd.DataFrame({"part": part, "open": opened, "ref": ref[out], "row_id": row_id[out], "at": at[out]})
        if first is not None:
            yield pd.DataFrame({"part": [part], "open": [False], "ref": [0], "f1": [first[0]], "f2": [first[1]], "l1": [last[0]], "l2": [last[1]], "until": [until]}).astype({"part": "int32"})

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["part", "open", "ref", "row_id", "at", "f1", "f2", "l1", "l2", "until"]
        for out in scan(batches):
            yield out.reindex(columns=columns).astype({c: "Int64" for c in columns[3:]})

    judged = materialize(ranged.mapInPandas(frames, "part int, open boolean, ref int, row_id long, at long, f1 long, f2 long, l1 long, l2 long, until long"))
    carried: dict[int, int] = {}
    key, until = None, NEVER
    for r in sorted(judged.where("ref = 0").collect(), key=lambda r: r["part"]):  # one a range
        if key == (r["f1"], r["f2"]):
            carried[r["part"]] = until
        else:
            until = NEVER
        until = max(until, r["until"]) if (r["f1"], r["f2"]) == (r["l1"], r["l2"]) else r["until"]
        key = r["l1"], r["l2"]
    orphans = judged.where("ref > 0")
    if carried:
        alive = F.create_map(*[F.lit(x) for item in carried.items() for x in item])
        orphans = orphans.where(~F.col("open") | F.coalesce(alive[F.col("part")], F.lit(NEVER)).__le__(F.col("at")))
    return orphans.select("ref", "row_id", F.when(F.col("at") != NEVER, F.timestamp_micros("at")).alias("at"))


def _in_page(page: str, anchor: Column) -> Column:
    """A key for an id within a page; no page means a key that no heading has."""
    return F.when(anchor.isNotNull(), F.concat(F.coalesce(F.col(page), F.lit("\x02")), F.lit("\x01"), anchor))


def crawl_references(spark, sf_dir: str) -> DataFrame:
    """All references of the crawl tables with their targets in long form."""
    plain = plain_href(F.col("href")).alias("_h")
    dfns = table(spark, sf_dir, "dfns").select("dfn_no", "page_url", F.col("heading.id").alias("_a"), "crawled_at", "first_seen", "removed_at", plain)
    headings = table(spark, sf_dir, "headings").select("heading_no", "page_url", "id", "alternate_ids", "crawled_at", "first_seen", "removed_at", plain)
    none = F.array().cast("array<string>")
    anchors = F.when(F.col("page_url").isNotNull(), F.array_union(F.array("id"), F.coalesce("alternate_ids", none)))
    gone, h = F.col("removed_at"), F.col("_h")
    parts = [
        long_form(dfns, child_row("ids", h, "dfn_no", "crawled_at", 1), child_row("headings", _in_page("page_url", F.col("_a")), "dfn_no", "crawled_at", 3), parent_row("dfns", h, "first_seen", gone)),
        long_form(headings, child_row("ids", h, "heading_no", "crawled_at", 2)),
        long_form(headings.withColumn("_a", F.explode(anchors)), parent_row("headings", _in_page("page_url", F.col("_a")), "first_seen", gone)),
        long_form(table(spark, sf_dir, "backrefs").select("backref_id", "crawled_at", plain), child_row("dfns", h, "backref_id", "crawled_at", 4)),
        long_form(table(spark, sf_dir, "ids").select("first_seen", "removed_at", plain), parent_row("ids", h, "first_seen", gone)),
        long_form(table(spark, sf_dir, "core_dfns").select("first_seen", plain), parent_row("dfns", h, "first_seen")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _names(k: int) -> Column:
    return F.element_at(F.array(*[F.lit(r[k]) for r in REFERENCES]), F.col("ref"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    orphans = orphan_references(crawl_references(spark, sf_dir))
    return orphans.select(_names(0).alias("ref_table"), "row_id", utc_month(F.col("at")).alias("month_key"))


def p1_counts(spark, sf_dir: str) -> DataFrame:
    """Dangling references per referring table, target table and month."""
    orphans = orphan_references(crawl_references(spark, sf_dir))
    counts = orphans.groupBy("ref", utc_month(F.col("at")).alias("month_key")).agg(F.count("*").alias("n_dangling"))
    return counts.select(_names(0).alias("ref_table"), _names(1).alias("target_table"), "month_key", "n_dangling")
