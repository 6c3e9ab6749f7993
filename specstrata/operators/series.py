"""Levels of a series of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specstrata.session import materialize

COLUMNS = ["shortname", "current", "composition", "previous", "next"]


def registry_levels(specs: DataFrame) -> DataFrame:
    """shortname, series, current, version, composition, previous, next of a registry whose levels are ordered by version, then name."""
    in_series = Window.partitionBy("series").orderBy(F.expr("try_cast(version as double)"), "version", "shortname")
    rows = specs.select("shortname", F.col("series.shortname").alias("series"), F.col("series.current_specification").alias("current"), F.col("series_version").alias("version"), F.col("series_composition").alias("composition")).where("shortname is not null").distinct()
    return rows.withColumn("previous", F.lag("shortname").over(in_series)).withColumn("next", F.lead("shortname").over(in_series))


def _walk(levels: DataFrame, link: str, until_current: bool) -> DataFrame:
    """(start, node): the levels visited along ``link``; a walk ends at a missing link, in a cycle after one round, or at the current level if asked."""
    nodes = levels.select(*COLUMNS)
    step = nodes.select(F.col("shortname").alias("start"), F.col("current").alias("goal"), F.col("shortname").alias("node"), F.col(link).alias("to"), F.array("shortname").alias("seen"))
    visited = step.select("start", "node", F.lit(0).alias("hops"))
    hops = 0
    while True:
        hops += 1
        going = step.where("to is not null" + (" and node <> goal" if until_current else ""))
        there = nodes.select(F.col("shortname").alias("to"), F.col(link).alias("further"))
        step = materialize(going.join(there, "to").where("not array_contains(seen, to)").select("start", "goal", F.col("to").alias("node"), F.col("further").alias("to"), F.concat("seen", F.array("to")).alias("seen")))
        if step.isEmpty():
            return visited
        visited = visited.unionByName(step.select("start", "node", F.lit(hops).alias("hops")))


def latest_levels(levels: DataFrame, passes: Column) -> DataFrame:
    """``levels`` with ``is_latest``: whether a level is the latest of its series that passes.

    A delta is, unless a full level between it and the current one passes. Any
    other level is if no later full level passes and the current level is
    itself or an earlier one. ``levels`` holds COLUMNS; the registry of
    documents bounds the number of rounds by the longest series.
    """
    judged = materialize(levels.withColumn("_ok", F.coalesce(passes, F.lit(False))))
    full = judged.where("_ok and composition = 'full'").select(F.col("shortname").alias("node"))
    back = _walk(judged, "previous", until_current=True)
    ahead = _walk(judged, "next", until_current=False)
    beaten_back = back.where("hops > 0").join(full, "node", "left_semi").select(F.col("start").alias("shortname"), F.lit(True).alias("_beaten_back")).distinct()
    beaten_ahead = ahead.where("hops > 0").join(full, "node", "left_semi").select(F.col("start").alias("shortname"), F.lit(True).alias("_beaten_ahead")).distinct()
    goal = judged.select(F.col("shortname").alias("start"), F.col("current").alias("node"))
    reached = back.join(goal, ["start", "node"], "left_semi").select(F.col("start").alias("shortname"), F.lit(True).alias("_reached")).distinct()
    out = judged.join(beaten_back, "shortname", "left").join(beaten_ahead, "shortname", "left").join(reached, "shortname", "left")
    delta = F.col("composition") == "delta"
    verdict = F.when(delta, F.col("_beaten_back").isNull()).otherwise(F.col("_beaten_ahead").isNull() & F.col("_reached").isNotNull())
    return out.withColumn("is_latest", F.col("_ok") & verdict).drop("_ok", "_beaten_back", "_beaten_ahead", "_reached")


def series_adjusted(levels: DataFrame, has_extract: Column) -> DataFrame:
    """Extract files per series: the latest level that has the extract takes the series' name, deltas keep theirs, the rest drops out."""
    judged = latest_levels(levels, has_extract)
    keep = judged.where(has_extract & (F.col("is_latest") | (F.col("composition") == "delta")) & (F.col("composition") != "fork"))
    return keep.withColumn("file_stem", F.when(F.col("composition") == "delta", F.col("shortname")).otherwise(F.coalesce("series", "shortname")))
