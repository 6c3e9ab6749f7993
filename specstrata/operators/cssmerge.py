"""Style features of a corpus merged into one definition each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURE = ["category", "name", "scope"]


def merge_features(features: DataFrame, numeric_versions: bool = False) -> DataFrame:
    """One row per feature: category, name, scopes, href, syntax, extended, alias_of, error.

    features: category, name, scope (null if none), href, syntax, new_values,
    alias_of, series, version, spec, spec_ord, pos.

    Base definition: rows with href and syntax, else with href and no new
    values; none, no feature. Of several, a later one of another series wins,
    of the same series only one of a greater version (compared as text unless
    ``numeric_versions``). The fold over them is ordered, per feature, and a
    feature has as many definitions as documents define it. New values are
    appended once each. Other definitions of functions and types override the
    syntax and count as extensions. Scoped rows with an unscoped twin drop out
    unless their syntax differs; rows of one href become one with all scopes.
    """
    version = F.expr("try_cast(version as double)") if numeric_versions else F.coalesce("version", F.lit(""))
    rows = features.where("name is not null").withColumn("_v", version)
    has_base = F.col("href").isNotNull() & F.col("syntax").isNotNull()
    rank = F.when(has_base, 0).when(F.col("href").isNotNull() & F.col("new_values").isNull(), 1)
    entry = F.struct("spec_ord", "pos", "href", "syntax", "series", "_v", "alias_of", "spec")
    best = Window.partitionBy(*FEATURE)
    ranked = rows.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(best))
    grouped = ranked.where("_best is not null").groupBy(*FEATURE).agg(
        F.array_sort(F.collect_list(F.when(F.col("_rank") == F.col("_best"), entry))).alias("bases"),
        F.array_sort(F.collect_list(F.when(F.col("new_values").isNotNull(), F.struct("spec_ord", "pos", "new_values", "spec")))).alias("news"),
    )
    fold = F.aggregate(
        F.slice("bases", 2, F.greatest(F.size("bases") - 1, F.lit(0))), F.element_at("bases", 1),
        lambda a, b: F.when(~a["series"].eqNullSafe(b["series"]) | (a["_v"] < b["_v"]), b).otherwise(a),
    )
    merged = grouped.withColumn("b", fold)
    is_property = F.col("category") == "properties"
    added = F.array_distinct(F.transform("news", lambda x: x["new_values"]))
    syntax = F.when(is_property & (F.size(added) > 0), F.array_join(F.concat(F.array(F.coalesce("b.syntax", F.lit(""))), added), " | ")).otherwise(F.col("b.syntax"))
    others = F.array_distinct(F.transform(F.filter("bases", lambda x: ~x["spec"].eqNullSafe(F.col("b.spec"))), lambda x: x["spec"]))
    extended = F.when(is_property, F.array_distinct(F.transform("news", lambda x: x["spec"]))).otherwise(others)
    flat = merged.select(*FEATURE, F.col("b.href").alias("href"), F.regexp_replace(syntax, "^ \\| ", "").alias("syntax"), extended.alias("extended"), F.col("b.alias_of").alias("alias_of"))

    twins = flat.where("scope is null").select("category", "name", F.col("syntax").alias("_plain"), F.lit(True).alias("_twin"))
    kept = flat.join(twins, ["category", "name"], "left").where("scope is null or _twin is null or (syntax is not null and not syntax <=> _plain)").drop("_plain", "_twin")
    targets = flat.where("scope is null").select("category", F.col("name").alias("alias_of"), F.col("syntax").alias("_target"), F.lit(True).alias("_known")).dropDuplicates(["category", "alias_of"])
    aliased = kept.join(targets, ["category", "alias_of"], "left")
    error = F.when(F.col("alias_of").isNotNull() & F.col("_known").isNull(), F.concat(F.lit("no feature "), F.col("alias_of"), F.lit(" to be an alias of")))
    done = aliased.withColumn("syntax", F.coalesce("_target", "syntax")).withColumn("error", error)
    return done.groupBy("category", "name", "href").agg(
        F.array_sort(F.collect_set("scope")).alias("scopes"), F.min_by("syntax", F.coalesce("scope", F.lit(""))).alias("syntax"), F.array_distinct(F.flatten(F.collect_list("extended"))).alias("extended"), F.min("alias_of").alias("alias_of"), F.min("error").alias("error")
    )


def merge_descriptors(descriptors: DataFrame, numeric_versions: bool = False) -> DataFrame:
    """Descriptors (rule, name, syntax, series, version, spec_ord, pos) of an at-rule over all documents, the newest of each name."""
    version = F.expr("try_cast(version as double)") if numeric_versions else F.coalesce("version", F.lit(""))
    return descriptors.groupBy("rule", "name").agg(F.max_by("syntax", F.struct(version, "spec_ord", "pos")).alias("syntax"))
