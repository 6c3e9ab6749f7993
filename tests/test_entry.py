import __spark_entry__ as entry


def test_contract(spark, data):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(entry.queries())
    assert entry.queries()["p1_counts"](spark, data).columns == ["ref_table", "target_table", "month_key", "n_dangling"]
