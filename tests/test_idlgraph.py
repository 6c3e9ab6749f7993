from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from specstrata import session
from specstrata.operators import idlgraph
from specstrata.plans import registry

RING = 300


@pytest.fixture
def ring(spark, tmp_path):
    """A data folder in which every name inherits from the next, the last from the first."""
    k = F.col("id").cast("string")
    rows = spark.range(RING).select(F.col("id").alias("idl_no"), F.concat(F.lit(" N"), k).alias("idl_name"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("shortname"), F.concat(F.lit("N"), ((F.col("id") + 1) % RING).cast("string")).alias("inheritance"), F.array(F.lit("gone"), F.lit(None).cast("string")).alias("includes"))
    rows.unionByName(rows.limit(3)).write.parquet(str(tmp_path / "idlnames.parquet"))
    return str(tmp_path)


def rows_written(spark, run):
    """What ``run`` returns, and the rows of the intermediate tables it writes."""
    folder = Path(session.shared_folder(spark).removeprefix("file:")) / "specstrata"
    old = set(folder.glob("*"))
    got = run()
    return got, sum(spark.read.parquet(f"file:{p}").count() for p in set(folder.glob("*")) - old)


def test_definitions_without_writing_the_pairs(spark, ring):
    got, written = rows_written(spark, lambda: registry.queries()["ref_c4_definitions"](spark, ring).collect())
    hrefs = [" ".join(sorted(f"#{k}" for k in range(s, RING, 2))) for s in (0, 1)]
    assert sorted(tuple(r) for r in got) == sorted((f"N{k}", f"s{s}", hrefs[s]) for k in range(RING) for s in (0, 1))
    assert written <= 5 * RING


def test_graph_without_writing_the_pairs(spark, ring):
    got, written = rows_written(spark, lambda: registry.queries()["ref_c4_graph"](spark, ring).collect())
    assert sorted(tuple(r) for r in got) == sorted((f"N{a}", f"N{b}") for a in range(RING) for b in range(RING))
    assert written <= 5 * RING


def test_graph_sent_and_joined_agree(spark, monkeypatch):
    names = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "C"), ("C", None), ("D", "E"), ("E", "D"), ("M", "gone"), ("", "A"), (None, "A")], "name string, inheritance string")
    includes = spark.createDataFrame([("B", "M"), ("A", "lost"), ("lost", "A"), ("C", None), (None, "C"), ("M", "")], "target string, mixin string")

    def rows(*of):
        return sorted(tuple(r) for r in idlgraph.name_graph(*of).collect())

    sent, empty = rows(names, includes), rows(names.limit(0), includes)
    assert ("A", "M") in sent and ("M", "A") in sent and ("D", "D") in sent and not any("lost" in r for r in sent) and empty == []
    monkeypatch.setattr(idlgraph, "SENT", -1)
    assert rows(names, includes) == sent and rows(names.limit(0), includes) == []


def test_definitions_sent_and_joined_agree(spark, monkeypatch):
    names = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", None), ("D", "E"), ("E", "D"), ("M", "gone"), ("", "A"), (None, "A")], "name string, inheritance string")
    includes = spark.createDataFrame([("B", "M"), ("A", "lost"), ("C", None), (None, "C"), ("C", "")], "target string, mixin string")
    dfns = spark.createDataFrame([("M", "u", "#m"), ("M", "u", "#m"), ("C", "u", "#é"), ("C", "u", "#z"), ("C", None, "#d"), ("A", "u", None), ("lost", "u", "#l"), (None, "u", "#n"), ("D", "w", "")], "name string, url string, href string")

    def rows():
        return sorted((r["name"], r["url"] or "∅", r["hrefs"]) for r in idlgraph.reached_definitions(names, includes, dfns).collect())

    sent = rows()
    assert ("A", "u", ["#m", "#z", "#é"]) in sent and ("A", "∅", ["#d"]) in sent and ("E", "w", [""]) in sent and not any(r[0] == "lost" for r in sent)
    monkeypatch.setattr(idlgraph, "SENT", 0)
    assert rows() == sent
    assert idlgraph.reached_definitions(names.limit(0), includes.limit(0), dfns.limit(0)).collect() == []
    monkeypatch.undo()
    for none in (dfns.limit(0), dfns.where("name = 'lost'")):
        assert idlgraph.reached_definitions(names, includes, none).collect() == []
    assert idlgraph.reached_definitions(names.limit(0), includes, dfns).collect() == []


@pytest.mark.parametrize("at_once", [1, 40, 10**6])
def test_reached_in_parts(at_once):
    rng = np.random.default_rng(7)
    n, of, to = 60, rng.integers(0, 60, 80), rng.integers(0, 60, 80)
    first, above = idlgraph._lists(of, to, n)
    want = set()
    for s in range(n):
        met, todo = {s}, [s]
        while todo:
            new = set(to[of == todo.pop()].tolist()) - met
            met |= new
            todo += new
        want |= {(s, x) for x in met}
    parts = list(idlgraph.reached(first, above, np.arange(n), np.full(n, 3), at_once))
    got = [pair for s, x in parts for pair in zip(s.tolist(), x.tolist())]
    assert len(got) == len(want) and set(got) == want
    assert all(len(set(s.tolist())) == 1 or 3 * len(s) <= at_once for s, _ in parts)
