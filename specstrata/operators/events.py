"""Events of a corpus merged over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specstrata.operators.idlgraph import ancestors, tree_info


def merge_events(events: DataFrame, mixins: DataFrame, names: DataFrame, trees: DataFrame) -> DataFrame:
    """One row per event and target: event_id, type, interface, href, target, bubbles, bubbling_path, extended_in.

    events: type, interface, targets, bubbles, href, is_extension, spec, ord,
    and cancelable and spec_url if known. mixins: mixin, interface (which
    include it). names: name, inheritance.

    Events with one href and cancelable flag (or, without a href, one type and
    document) are one. An extension adds its targets to the original with its
    href, else to the first one of its type whose document its href lies in,
    and is listed there; it stays an event of its own if there is none or if
    both name different interfaces. Mixin targets stand for the interfaces
    that include them. A target bubbles as the event says that names it first,
    and only within a tree and below its root; there an event that says nothing
    does not bubble. A target is left out if
    an ancestor of it is a target with the same flag, or if a deeper one of its
    tree is a target that bubbles.
    """
    for c, kind in (("cancelable", "boolean"), ("spec_url", "string")):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(kind))
    rows = events.where("type is not null").withColumn("_ext", F.coalesce("is_extension", F.lit(False)))
    own_id = F.concat_ws("|", F.coalesce("href", F.concat_ws("|", "spec", "type")), F.col("cancelable").cast("string"))
    originals = rows.where("not _ext").withColumn("event_id", own_id)
    known = originals.groupBy("event_id", "type", "href", "spec_url").agg(F.min("ord").alias("_ord"), F.min("interface").alias("_iface"))
    extra = rows.where("_ext")
    near = extra.select("type", "href", "spec", "ord").distinct()
    by_href = near.join(known.select("event_id", "_ord", "_iface", F.col("href").alias("_h")), F.col("href") == F.col("_h")).withColumn("_far", F.lit(0)).drop("_h")
    in_spec = near.join(known.select("event_id", "_ord", "_iface", F.col("type").alias("_t"), "spec_url"), (F.col("type") == F.col("_t")) & F.col("href").startswith(F.col("spec_url"))).withColumn("_far", F.lit(1)).drop("_t", "spec_url")
    best = by_href.unionByName(in_spec).groupBy("type", "href", "spec", "ord").agg(F.min_by(F.struct("event_id", "_iface"), F.struct("_far", "_ord")).alias("_o"))
    best = best.select(*[F.col(c).alias(f"_b_{c}") for c in ("type", "href", "spec", "ord")], "_o")
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in ("type", "href", "spec", "ord")]
    found = extra.join(best, on[0] & on[1] & on[2] & on[3], "left").select(*extra.columns, "_o")
    fits = F.col("_o").isNotNull() & F.coalesce(F.col("interface") == F.col("_o._iface"), F.lit(True))
    joined = found.withColumn("event_id", F.when(fits, F.col("_o.event_id")).otherwise(F.concat_ws("|", F.lit("extension"), "spec", "href", "type"))).drop("_o")
    keyed = originals.unionByName(joined)

    order = F.struct("_ext", "ord")
    base = keyed.groupBy("event_id").agg(
        F.min_by("type", order).alias("type"), F.min_by("interface", F.struct(F.col("interface").isNull(), "_ext", "ord")).alias("interface"),
        F.min_by("href", F.struct(F.col("href").isNull(), order)).alias("href"), F.array_sort(F.collect_set(F.when(F.col("_ext") & ~F.col("event_id").startswith("extension|"), F.col("spec")))).alias("extended_in"),
    )
    targets = keyed.select("event_id", F.explode("targets").alias("target"), "bubbles", order.alias("_at"))
    users = mixins.select(F.col("mixin").alias("target"), F.col("interface").alias("_user")).distinct()
    spread = targets.join(users, "target", "left").groupBy("event_id", F.coalesce("_user", "target").alias("target")).agg(F.min_by("bubbles", "_at").alias("bubbles"))
    info = tree_info(names.select("name", "inheritance").unionByName(trees.select(F.col("interface").alias("name"), F.lit(None).cast("string").alias("inheritance")).join(names.select("name"), "name", "left_anti")).distinct(), trees)
    placed = spread.join(info.select(F.col("name").alias("target"), "tree", "depth", "bubbling_path"), "target", "left").join(base, "event_id")
    flag = F.when(F.col("tree").isNotNull() & (F.col("depth") > 0), F.coalesce("bubbles", F.lit(False)))
    flagged = placed.withColumn("bubbles", flag).withColumn("bubbling_path", F.when(flag, F.col("bubbling_path")))
    above = ancestors(names).select(F.col("name").alias("target"), "ancestor")
    covered = flagged.select("event_id", "target", "bubbles").join(above, "target").join(flagged.select("event_id", F.col("target").alias("ancestor"), F.col("bubbles").alias("_b")), ["event_id", "ancestor"]).where("bubbles <=> _b").select("event_id", "target").distinct()
    kept = flagged.join(covered, ["event_id", "target"], "left_anti")
    deepest = kept.where("bubbles").groupBy("event_id", "tree").agg(F.max("depth").alias("_deepest"))
    kept = kept.join(deepest, ["event_id", "tree"], "left").where("_deepest is null or tree is null or depth >= _deepest").drop("tree", "depth", "_deepest")
    bare = base.join(kept.select("event_id"), "event_id", "left_anti").withColumn("target", F.lit(None).cast("string")).withColumn("bubbles", F.lit(None).cast("boolean")).withColumn("bubbling_path", F.lit(None).cast("array<string>"))
    return kept.unionByName(bare).select("event_id", "type", "interface", "href", "target", "bubbles", "bubbling_path", "extended_in")
