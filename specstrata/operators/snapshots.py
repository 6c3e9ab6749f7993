"""What changed between full snapshots.

Every row becomes a compact record: two 64-bit key hashes, a row hash and its
time. The records are reduced to one per key and snapshot (map-side combined),
dealt into hash buckets, and each bucket is compared in numpy: key arrays are
sorted and searched with ``searchsorted`` for keys on one side only, and row
hashes are compared for keys on both. The keys that differ are written, so
their number is known, and a filter of bounded size lets few other rows of the
table through to the join with them: p3_found retrieves the spelled key and
p3_changes the fields before and after of these records only.

The number of buckets follows the number of rows, so a bucket stays small at
any size, and a key with very many rows in a snapshot is reduced before it is
shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.functions.urls import moment, plain_href
from specstrata.session import materialize, shuffle_partitions, table

#: The fields of a record beside its key; other columns of a table play no part.
FIELDS = ["linking_text", "dfn_type", "dfn_for", "access_mode", "informative", "heading_href", "crawled", "last_modified", "crawled_at", "loaded_at"]
_NULL = "\x00"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(_NULL))


def _list(c: Column, as_set: bool = False) -> Column:
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(_NULL)))
    if as_set:
        items = F.array_sort(F.array_distinct(items))
    return F.concat(F.size(items).cast("string"), F.lit("\x01"), F.array_join(items, "\x01"))


def tidy_words(c: Column) -> Column:
    """A list of texts with blanks trimmed and runs of them made one."""
    return F.transform(c, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def snapshot_content() -> list[Column]:
    """What counts as the content of a row of dfn_snapshots, in comparable form."""
    modified = F.col("last_modified")
    return [
        _list(tidy_words(F.col("linking_text"))), _text(F.col("dfn_type")), _list(F.col("dfn_for"), as_set=True), _text(F.col("access_mode")), _text(F.col("informative")),
        _text(plain_href(F.col("heading_href"))), _text(F.col("crawled")), _text(F.coalesce(moment(modified).cast("string"), F.trim(modified))),
    ]


def _differ(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows added (in right), removed (in left) and changed (in right) of two sorted (key, hash) pairs."""
    (a, ha), (b, hb) = left, right
    at = np.searchsorted(a, b)
    hit = np.zeros(len(b), bool)
    inside = at < len(a)
    hit[inside] = a[at[inside]] == b[inside]
    back = np.searchsorted(b, a)
    kept = np.zeros(len(a), bool)
    inside = back < len(b)
    kept[inside] = b[back[inside]] == a[inside]
    changed = np.flatnonzero(hit)
    changed = changed[ha[at[changed]] != hb[changed]]
    return np.flatnonzero(~hit), np.flatnonzero(~kept), changed


def snapshot_changes(compact: DataFrame, numbers: list[int], buckets: int) -> DataFrame:
    """Differences between consecutive ``numbers`` of ``compact`` (snapshot_no, k1, k2, h): snapshot_no, source_no, k1, k2, change_kind."""
    pairs = list(zip(numbers, numbers[1:]))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = np.dtype([("a", "<i8"), ("b", "<i8")])
        sides = {}
        for no, part in pdf.groupby("snapshot_no", sort=False):
            keys = np.empty(len(part), kind)
            keys["a"], keys["b"] = part["k1"].to_numpy(), part["k2"].to_numpy()
            order = np.lexsort((keys["b"], keys["a"]))
            sides[no] = keys[order], part["h"].to_numpy()[order]
        none = np.empty(0, kind), np.empty(0, "<i8")
        out = []
        for before, after in pairs:
            left, right = sides.get(before, none), sides.get(after, none)
            for name, source, keys, rows in zip(("added", "removed", "changed"), (after, before, after), (right[0], left[0], right[0]), _differ(left, right)):
                if len(rows):
                    out.append(pd.DataFrame({"snapshot_no": after, "source_no": source, "k1": keys["a"][rows], "k2": keys["b"][rows], "change_kind": name}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["snapshot_no", "source_no", "k1", "k2", "change_kind"])

    schema = "snapshot_no int, source_no int, k1 long, k2 long, change_kind string"
    return compact.withColumn("_bucket", F.pmod("k2", F.lit(buckets))).groupBy("_bucket").applyInPandas(lambda pdf: compare(pdf), schema)


def changed_keys(snapshots: DataFrame, rows_per_bucket: int = 400_000) -> tuple[DataFrame, DataFrame]:
    """The differing keys of a table of snapshots, and the table's rows with their key hashes.

    Rows without a snapshot number or key are in no snapshot. Of several rows
    of a key in a snapshot the latest crawled_at holds; a tie goes to the later
    loaded_at, then to the larger row hash.
    """
    spark = snapshots.sparkSession
    key = plain_href(F.col("href"))
    keyed = snapshots.where("snapshot_no is not null and href is not null").select("snapshot_no", "shortname", "href", *FIELDS, key.alias("_key")).select("*", F.xxhash64("_key").alias("k1"), F.xxhash64(F.lit("k2"), F.reverse("_key")).alias("k2"))
    latest = F.max(F.struct(F.coalesce(F.unix_micros("crawled_at"), F.lit(-(1 << 62))).alias("t"), F.coalesce(F.unix_micros("loaded_at"), F.lit(-(1 << 62))).alias("l"), F.xxhash64(*snapshot_content()).alias("h")))
    compact = keyed.groupBy("snapshot_no", "k1", "k2").agg(latest.alias("_s")).select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "k1", "k2", "_s.h")
    numbers = sorted(r[0] for r in snapshots.select("snapshot_no").distinct().collect() if r[0] is not None)  # one per delivery
    buckets = max(shuffle_partitions(spark), -(-snapshots.count() // rows_per_bucket))
    return snapshot_changes(compact, numbers, buckets), keyed


#: Bits of the largest filter, 8 MB whatever the number of keys.
FILTER_BITS = 1 << 26
_WORD, _ROW = 64, 4096


def might_hold(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key``, a hash, may be among those of ``keys``: all that are, and few others while keys are fewer than bits.

    The filter is a table of bits, some 16 a key and at most ``most_bits``, so
    its size is bounded and it may be sent to all executors. With more keys it
    lets more rows through, and never holds one back that it should not.
    """
    n = keys.count()
    rows_of_bits = max(1, min(most_bits, 16 * n) // _ROW)
    spot = F.pmod(F.col(key), F.lit(rows_of_bits * _ROW))
    words = keys.select(F.floor(spot / _ROW).cast("int").alias("_f_row"), F.floor(spot % _ROW / _WORD).cast("int").alias("_f_word"), F.expr(f"shiftleft(1L, cast(pmod({key}, {rows_of_bits * _ROW}) % {_WORD} as int))").alias("_f_bit"))
    bits = words.groupBy("_f_row", "_f_word").agg(F.bit_or("_f_bit").alias("_f_bits")).groupBy("_f_row").agg(F.map_from_entries(F.collect_list(F.struct("_f_word", "_f_bits"))).alias("_f_words"))
    marked = rows.withColumn("_f_spot", spot).withColumn("_f_row", F.floor(F.col("_f_spot") / _ROW).cast("int")).join(F.broadcast(bits), "_f_row")
    word = F.try_element_at("_f_words", F.floor(F.col("_f_spot") % _ROW / _WORD).cast("int"))
    return marked.where(F.getbit(word, (F.col("_f_spot") % _WORD).cast("int")) == 1).drop("_f_row", "_f_words", "_f_spot")


def p3_found(spark, sf_dir: str) -> DataFrame:
    differing, keyed = changed_keys(table(spark, sf_dir, "dfn_snapshots"))
    differing = materialize(differing)
    rows = keyed.select(F.col("snapshot_no").cast("int").alias("source_no"), "k1", "k2", "_key")
    # a record may have several rows in its snapshot, so one key is kept of those that match
    return might_hold(rows, differing, "k1").join(differing, ["source_no", "k1", "k2"]).groupBy("snapshot_no", "k1", "k2", "change_kind").agg(F.min("_key").alias("href")).select("snapshot_no", "href", "change_kind")


def p3_changes(spark, sf_dir: str) -> DataFrame:
    """The records added, removed and changed with their fields as delivered before and after (null where there is no record)."""
    snapshots = table(spark, sf_dir, "dfn_snapshots")
    differing, keyed = changed_keys(snapshots)
    numbers = sorted(r[0] for r in snapshots.select("snapshot_no").distinct().collect() if r[0] is not None)
    earlier = F.create_map(*[F.lit(n).cast("int") for pair in zip(numbers[1:], numbers) for n in pair]) if len(numbers) > 1 else F.lit(None).cast("map<int,int>")
    differing = materialize(differing.select("snapshot_no", "k1", "k2", "change_kind", earlier[F.col("snapshot_no")].alias("before_no")))
    sides = F.explode(F.array(F.struct(F.col("before_no").alias("source_no"), F.lit(False).alias("after")), F.struct(F.col("snapshot_no").alias("source_no"), F.lit(True).alias("after"))))
    wanted = differing.select("snapshot_no", "k1", "k2", "change_kind", sides.alias("s")).select("snapshot_no", "k1", "k2", "change_kind", "s.source_no", "s.after")
    # the row that holds is the one whose hash was compared
    low = F.lit(-(1 << 62))
    content = F.struct(F.coalesce(F.unix_micros("crawled_at"), low).alias("t"), F.coalesce(F.unix_micros("loaded_at"), low).alias("l"), F.xxhash64(*snapshot_content()).alias("h"), F.struct("href", "shortname", *FIELDS).alias("row"))
    rows = keyed.select(F.col("snapshot_no").cast("int").alias("source_no"), "k1", "k2", "_key", content.alias("_s"))
    both = might_hold(rows, differing, "k1").join(wanted, ["source_no", "k1", "k2"]).groupBy("snapshot_no", "k1", "k2", "change_kind").agg(F.min("_key").alias("href"), F.max(F.when(~F.col("after"), F.col("_s"))).alias("b"), F.max(F.when(F.col("after"), F.col("_s"))).alias("a"))
    return both.select("snapshot_no", "href", "change_kind", F.col("b.row").alias("before"), F.col("a.row").alias("after"))


def p3_counts(spark, sf_dir: str) -> DataFrame:
    """Number of definitions added, removed and changed per snapshot."""
    differing, _ = changed_keys(table(spark, sf_dir, "dfn_snapshots"))
    return differing.groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_records"))
