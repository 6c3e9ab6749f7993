"""Names of interface definitions over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specstrata.operators.hierarchy import closure
from specstrata.session import materialize, shuffle_partitions

#: Bytes of names, links and definitions that are sent to every task; larger graphs are joined.
SENT = 64 << 20
#: Rows that a task makes at once.
AT_ONCE = 2_000_000

#: Interface trees along which events bubble, root first (fixed values).
BUBBLING_TREES = {
    "dom": ["Window", "Document", "Node", "Node"],
    "IndexedDB": ["IDBDatabase", "IDBTransaction", "IDBRequest"],
    "web-bluetooth": ["Bluetooth", "BluetoothDevice", "BluetoothRemoteGATTService", "BluetoothRemoteGATTCharacteristic", "BluetoothRemoteGATTDescriptor"],
    "serial": ["Serial", "SerialPort"],
}


def bubbling_trees(spark) -> DataFrame:
    """tree, interface, depth (the last place of a repeated name), bubbling_path (upwards)."""
    rows = []
    for tree, nodes in BUBBLING_TREES.items():
        for name in dict.fromkeys(nodes):
            depth = len(nodes) - 1 - nodes[::-1].index(name)
            rows.append((tree, name, depth, nodes[:depth][::-1]))
    return spark.createDataFrame(rows, "tree string, interface string, depth int, bubbling_path array<string>")


def merge_names(definitions: DataFrame, includes: DataFrame | None = None) -> DataFrame:
    """One row per name: its first definition in document order, the specs that extend it, what it includes.

    definitions: name, type, spec, spec_ord, pos, partial, inheritance, fragment.
    includes: target, mixin. A name that is only extended has no definition;
    mixins nobody defines drop out.
    """
    order = F.struct("spec_ord", "pos")
    base = definitions.where("not partial").groupBy("name").agg(F.min_by(F.struct("type", "spec", "fragment", "inheritance"), order).alias("b"))
    extended = definitions.where("partial").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("spec_ord", "pos", "spec"))).alias("e"))
    out = base.join(extended, "name", "full").select("name", F.col("b.type").alias("type"), F.col("b.spec").alias("defined_in"), F.col("b.inheritance").alias("inheritance"), F.col("b.fragment").alias("fragment"), F.transform(F.coalesce("e", F.array().cast("array<struct<spec_ord:int,pos:int,spec:string>>")), lambda x: x["spec"]).alias("extended_in"))
    if includes is not None:
        known = base.select(F.col("name").alias("mixin"))
        mixed = includes.distinct().join(known, "mixin", "left_semi").groupBy(F.col("target").alias("name")).agg(F.array_sort(F.collect_set("mixin")).alias("includes"))
        out = out.join(mixed, "name", "left")
    return out


def ancestors(names: DataFrame) -> DataFrame:
    """name, ancestor, depth along inheritance (name, inheritance), by doubling; a way that comes round stops before it repeats a name.

    Every round joins chains of up to 2^k steps, so there are as many rounds as the longest chain has binary digits.
    """
    step = names.where("inheritance is not null").groupBy("name").agg(F.min("inheritance").alias("up")).join(names.select(F.col("name").alias("up")).distinct(), "up", "left_semi")
    chain = materialize(step.select("name", F.array("up").alias("path")))
    while True:
        tail = chain.select(F.col("name").alias("end"), F.col("path").alias("more"))
        joined = chain.withColumn("end", F.element_at("path", -1)).join(tail, "end", "left")
        fresh = F.filter(F.coalesce("more", F.array().cast("array<string>")), lambda x: (x != F.col("name")) & ~F.array_contains(F.col("path"), x))
        longer = materialize(joined.select("name", F.concat("path", fresh).alias("path"), F.size("path").alias("was")))
        chain = longer.select("name", "path")
        if longer.where("size(path) > was").isEmpty():
            break
    return chain.select("name", F.posexplode("path").alias("k", "ancestor")).where("ancestor <> name").select("name", "ancestor", (F.col("k") + 1).alias("depth"))


def tree_info(names: DataFrame, trees: DataFrame) -> DataFrame:
    """name, tree, interface, depth, bubbling_path of the nearest interface, itself or an ancestor, that belongs to a tree; others drop out."""
    every = names.select("name", F.col("name").alias("interface"), F.lit(0).alias("far")).unionByName(ancestors(names).select("name", F.col("ancestor").alias("interface"), F.col("depth").alias("far")))
    nearest = Window.partitionBy("name").orderBy("far", "tree")
    return every.distinct().join(trees, "interface").withColumn("_k", F.row_number().over(nearest)).where("_k = 1").select("name", "tree", "interface", "depth", "bubbling_path")


def _links(names: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All names (name) and the links between them (v, parent), each once, written."""
    known = materialize(names.select("name").where("name is not null").distinct())
    links = names.select(F.col("name").alias("v"), F.col("inheritance").alias("parent")).unionByName(includes.select(F.col("target").alias("v"), F.col("mixin").alias("parent"))).where("v is not null and parent is not null").distinct()
    links = links.join(known.withColumnRenamed("name", "v"), "v", "left_semi").join(known.withColumnRenamed("name", "parent"), "parent", "left_semi").select("v", "parent")
    return known, materialize(links)


def _bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of texts and of a number for each row and column."""
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(F.sum(each + 8 * max(1, len(columns)))).first()[0] or 0


def _lists(of: np.ndarray, items: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, items): the items of k = 0 to n - 1 are items[first[k] : first[k + 1]]."""
    order = np.argsort(of, kind="stable")
    return np.searchsorted(of[order], np.arange(n + 1)), items[order]


def _spread(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all items of the lists ``at``, and for each the place in ``at`` of its list."""
    sizes = first[at + 1] - first[at]
    of = np.repeat(np.arange(len(at)), sizes)
    return np.arange(len(of)) + np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes), of


def reached(first: np.ndarray, above: np.ndarray, starts: np.ndarray, rows: np.ndarray | None = None, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, node) in parts, of every start with itself and all that lies above it; the parts hold whole starts.

    A part stands for ``at_once`` rows at most, or is one start; rows: those
    that a node stands for, else one each.
    """
    n = len(first) - 1
    cut = max(1, 8 * at_once // max(n, 1))
    if len(starts) > cut:
        for k in range(0, len(starts), cut):
            yield from reached(first, above, starts[k : k + cut], rows, at_once)
        return
    seen = np.zeros(len(starts) * n, bool)
    codes = np.arange(len(starts)) * n + starts
    found, total = [], 0
    while len(codes):
        seen[codes] = True
        found.append(codes)
        total += len(codes) if rows is None else max(len(codes), int(rows[codes % n].sum()))
        if total > at_once and len(starts) > 1:
            half = len(starts) // 2
            yield from reached(first, above, starts[:half], rows, at_once)
            yield from reached(first, above, starts[half:], rows, at_once)
            return
        node = codes % n
        at, of = _spread(first, node)
        codes = (codes - node)[of] + above[at]
        codes = np.unique(codes[~seen[codes]])
    every = np.concatenate(found) if found else codes
    yield starts[every // max(n, 1)], every % max(n, 1)


def _graph_arrays(known: DataFrame, links: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The names, and by their places the lists of what lies directly above each."""
    names, pairs = known.toArrow()["name"].combine_chunks(), links.toArrow()
    v, parent = (pc.index_in(pairs[c], value_set=names).to_numpy().astype(np.int64) for c in ("v", "parent"))
    return names, *_lists(v, parent.astype(np.int32), len(names))


def _over_names(spark, n: int, scan, schema: str) -> DataFrame:
    """``scan`` over the places of n names."""
    parts = max(shuffle_partitions(spark), -(-n // 10_000))
    return spark.range(0, n, numPartitions=parts).mapInArrow(scan, schema)


def name_graph(names: DataFrame, includes: DataFrame) -> DataFrame:
    """name, related: every name with itself and all that it inherits from or includes, over any number of steps; chains that go round end.

    names: name, inheritance. includes: target, mixin. Names nobody defines
    are left out. Names and links of up to SENT bytes are sent to every task,
    which walks up from its share of the names; larger ones are joined.
    """
    known, links = _links(names, includes)
    if _bytes(known, "name") + _bytes(links) > SENT:
        return _graph(known, links)
    sent = names.sparkSession.sparkContext.broadcast(arrays := _graph_arrays(known, links))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, first, above = sent.value
        for batch in batches:
            for start, node in reached(first, above, batch.column(0).to_numpy()):
                for k in range(0, len(start), 50_000):
                    yield pa.RecordBatch.from_arrays([texts.take(pa.array(x[k : k + 50_000])) for x in (start, node)], names=["name", "related"])

    return _over_names(names.sparkSession, len(arrays[0]), scan, "name string, related string")


def _graph(known: DataFrame, links: DataFrame) -> DataFrame:
    above = closure(links).select(F.col("v").alias("name"), F.col("above").alias("related"))
    return known.withColumn("related", F.col("name")).unionByName(above).distinct()


def name_definitions(graph: DataFrame, definitions: DataFrame) -> DataFrame:
    """name, url, hrefs: for each name the definitions (name, url, href) of what it defines, inherits and includes, by document."""
    found = graph.join(definitions.select(F.col("name").alias("related"), "url", "href").where("href is not null"), "related")
    return found.groupBy("name", "url").agg(F.array_sort(F.collect_set("href")).alias("hrefs"))


def reached_definitions(names: DataFrame, includes: DataFrame, definitions: DataFrame) -> DataFrame:
    """What ``name_definitions`` makes of the ``name_graph`` of names and includes.

    Names, links and definitions of up to SENT bytes are sent to every task,
    which walks up from its share of the names and gathers what it meets;
    nothing is shuffled. Larger ones are joined.
    """
    known, links = _links(names, includes)
    own = materialize(definitions.where("href is not null").select("name", "url", "href").join(known, "name", "left_semi").distinct())
    if _bytes(known, "name") + _bytes(links) + _bytes(own, "url", "href") > SENT:
        return name_definitions(_graph(known, links), own)
    spark = names.sparkSession
    texts, first, above = _graph_arrays(known, links)
    given = own.toArrow()
    urls = given["url"].combine_chunks().dictionary_encode(null_encoding="encode")
    hrefs = pc.unique(given["href"].combine_chunks())
    hrefs = hrefs.take(pc.sort_indices(hrefs))
    key = urls.indices.to_numpy().astype(np.int64) * len(hrefs) + pc.index_in(given["href"].combine_chunks(), value_set=hrefs).to_numpy()
    sent = spark.sparkContext.broadcast((texts, first, above, urls.dictionary, hrefs, *_lists(pc.index_in(given["name"].combine_chunks(), value_set=texts).to_numpy(), key, len(texts))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, first, above, urls, hrefs, firsts, keys = sent.value
        width, h = len(urls) * len(hrefs), len(hrefs)
        for batch in batches:
            for start, node in reached(first, above, batch.column(0).to_numpy(), np.diff(firsts)):
                at, of = _spread(firsts, node)
                ids, place = np.unique(start, return_inverse=True)
                rows = np.unique(place[of] * width + keys[at])
                groups, begins = np.unique(rows // h, return_index=True) if h else (rows, rows)
                ends = np.append(begins, len(rows))
                for k in range(0, len(groups), 50_000):
                    g, e = groups[k : k + 50_000], ends[k : k + 50_001]
                    lists = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), hrefs.take(pa.array(rows[e[0] : e[-1]] % h)))
                    yield pa.RecordBatch.from_arrays([texts.take(pa.array(ids[g // len(urls)])), urls.take(pa.array(g % len(urls))), lists], names=["name", "url", "hrefs"])

    return _over_names(spark, len(texts), scan, "name string, url string, hrefs array<string>")
