"""Per-key results without imbalance, by exact offset chunking.

Rows are first reduced to one state per key and sub-key (map-side combined),
so a hot key leaves at most as many rows as it has sub-keys. The states are
put in the order of key and sub-key, in ranges that are fixed by writing them.
Then the states are counted per range, prefix sums turn the counts into
offsets, every state has its number in the global order, equal runs of numbers
form the chunks, and the states that chunks leave at their boundaries are
merged per key.

Keys and sub-keys travel as hashes (of 128 and 64 bits), so rows are narrow;
the texts of the keys are joined to the results at the end. Only as many
numbers as there are ranges reach the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.functions.urls import plain_href
from specstrata.session import materialize, shuffle_partitions, table

KEY = ["_k1", "_k2"]


def key_hash(*parts: Column) -> list[Column]:
    """Two hashes that stand for a key; a null is unlike any text, and unlike a null in another place."""
    marked = [c for p in parts for c in (p.isNull(), p)]
    return [F.xxhash64(F.lit(salt), *marked).alias(name) for salt, name in enumerate(KEY)]


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``_n``, a dense number from 0 in the given order, and their count.

    Ranges of the order hold equal shares of the rows, whatever values repeat;
    a range's offset is the sum of the counts before it.
    """
    parts = shuffle_partitions(rows.sparkSession)
    ranged = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33).cast("int"))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    starts = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=-1) + 1))]
    begin = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_range") + 1)
    return ranged.withColumn("_n", begin + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range"), starts[-1]


def key_states(rows: DataFrame, sub: str, at: str) -> DataFrame:
    """Per key (_k1, _k2): rows (_w), distinct non-null sub-keys (_subs), first and last time (_first, _last).

    The work is split into chunks of equal size, so that no key, however hot,
    and no pair of key and sub-key makes one task work more than another.
    Empty input, empty output.
    """
    states = rows.groupBy(*KEY, F.col(sub).alias("_s")).agg(F.count("*").alias("_w"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    states, total = numbered(states, [*KEY, "_s"])
    chunks = 2 * shuffle_partitions(rows.sparkSession)
    size = max(1, -(-total // chunks))
    chunked = states.withColumn("_chunk", F.floor(F.col("_n") / size).cast("int")).drop("_n").repartitionById(chunks, F.col("_chunk"))
    merge = [F.sum("_w").alias("_w"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    boundary = chunked.groupBy("_chunk", *KEY).agg(F.count("_s").alias("_subs"), *merge)
    return boundary.groupBy(*KEY).agg(F.sum("_subs").alias("_subs"), *merge)


def p2_hot_keys(spark, sf_dir: str) -> DataFrame:
    """For each defining spec and each definition: back-references, distinct referring specs, first and last crawl.

    Definitions without a back-reference have count 0 and no times; hrefs that
    no definition has are no keys, and rows without a key count nowhere.
    """
    spec, definition = F.lit("spec"), F.lit("definition")
    backrefs = table(spark, sf_dir, "backrefs")
    sub = F.when(F.col("ref_shortname").isNotNull(), F.xxhash64("ref_shortname")).alias("_sub")
    h = F.col("_h")
    keyed = backrefs.select("backref_id", "defining_shortname", plain_href(F.col("href")).alias("_h"), sub, "crawled_at")
    pairs = [F.when(c.isNotNull(), F.struct(*key_hash(kind, c))).alias(name) for kind, c, name in ((spec, F.col("defining_shortname"), "_a"), (definition, h, "_b"))]
    once = keyed.select("backref_id", *pairs, "_sub", "crawled_at").distinct()  # exact copies of a row count once
    rows = once.select(F.explode(F.array("_a", "_b")).alias("_k"), "_sub", "crawled_at").where("_k is not null").select("_k.*", "_sub", "crawled_at")
    states = key_states(rows, "_sub", "crawled_at")

    defined = table(spark, sf_dir, "dfns").select("href").unionByName(table(spark, sf_dir, "core_dfns").select("href")).select(definition.alias("key_kind"), plain_href(F.col("href")).alias("key_value"))
    names = defined.unionByName(backrefs.select(spec.alias("key_kind"), F.col("defining_shortname").alias("key_value"))).where("key_value is not null").distinct()
    found = names.select("*", *key_hash(F.col("key_kind"), F.col("key_value"))).join(states, KEY, "left")
    return found.select("key_kind", "key_value", F.coalesce("_w", F.lit(0)).alias("n_backrefs"), F.coalesce("_subs", F.lit(0)).alias("n_ref_specs"), F.col("_first").alias("first_crawled"), F.col("_last").alias("last_crawled"))
