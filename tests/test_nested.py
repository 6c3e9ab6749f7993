import json

from specstrata.operators import nested
from specstrata.operators.nested import Graph, p4_found, schema_graph, shred_payload


def found(spark, tmp_path, payloads):
    rows = [(i, p, 1) for i, p in enumerate(payloads)]
    spark.createDataFrame(rows, "rec_id long, payload string, table_name int").write.mode("overwrite").parquet(f"{tmp_path}/crawl_results.parquet")
    return sorted(tuple(r) for r in p4_found(spark, str(tmp_path)).collect())


def test_places_and_lenient_shapes(spark, tmp_path):
    spec = {"nightly": {"pages": [None, "p", ""]}, "dfns": [None, {"linkingText": "alone", "heading": {"href": "h"}}, {"linkingText": ["a", None, 3, "b"], "heading": None}], "refs": {"informative": {"url": "u"}, "normative": [{"url": "no"}]}}
    held = {"nightly": json.dumps({"pages": json.dumps(["q"])}), "dfns": json.dumps([{"linkingText": ["x"], "links": [{"heading": {"href": "no"}}]}]), "refs": json.dumps({"informative": [json.dumps({"url": "v"}), {"url": None}]})}
    got = found(spark, tmp_path, [json.dumps(spec), json.dumps({"type": "crawl", "results": [None, held, spec]}), None, "{", '{"a": NaN}', "[]", '"x"', json.dumps({"type": "crawl", "results": None})])
    one = [(0, "heading", "0/1", "h"), (0, "page", "0/1", "p"), (0, "page", "0/2", ""), (0, "ref", "0/0", "u"), (0, "text", "0/1/0", "alone"), (0, "text", "0/2/0", "a"), (0, "text", "0/2/3", "b")]
    two = [(1, "page", "1/0", "q"), (1, "ref", "1/0", "v"), (1, "text", "1/0/0", "x")] + [(1, c, "2" + p[1:], v) for _, c, p, v in one]
    assert got == sorted(one + two)


def test_copies_and_surrogates_and_empty(spark, tmp_path):
    text = '{"nightly": {"pages": ["\\ud800x"]}}'
    spark.createDataFrame([(1, text, 0), (1, text, 0)], "rec_id long, payload string, pos int").write.mode("overwrite").parquet(f"{tmp_path}/crawl_results.parquet")
    assert [tuple(r) for r in p4_found(spark, str(tmp_path)).collect()] == [(1, "page", "0/0", "�x")]
    assert found(spark, tmp_path, []) == []


def test_graph_inlines_single_and_shares_repeated(spark):
    df = spark.createDataFrame([(json.dumps({"dfns": [{"heading": {"href": "a"}, "links": [{"heading": {"href": "b"}}]}], "only": {"deep": {"x": 1}}, "node": {"node": {"node": None}}}),)], "p string")
    graph = schema_graph(df, "p")
    assert {"dfns", "links", "heading", "node"} <= graph.tables and not {"only", "deep"} & graph.tables
    rows = list(shred_payload(df.first()[0], graph))
    spec = next(r for r in rows if r[0] == "spec")
    assert spec[6] == {"only.deep.x": "1"}
    assert sorted((r[2], r[3], r[5]["href"]) for r in rows if r[0] == "heading") == [("dfns", "0/0", "a"), ("links", "0/0/0", "b")]


def records(spark, values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "rec_id long, p string")


def long_rows(df, graph):
    return sorted((r["rec_id"], r["table_name"], r["row_key"], str(r["texts"]), str(r["others"])) for r in nested.shred(df, "rec_id", "p", graph).collect())


def test_names_that_are_data_become_entries_however_the_data_are_cut(spark):
    values = [{"map": {f"k{i}": {"x": i, "deep": {"y": [1]}}}, "plain": {f"s{i}": i}} for i in range(40)]
    got = {}
    for parts in (1, 5, 50):
        df = records(spark, values).repartition(parts)
        graph = schema_graph(df, "p", many=20)
        assert graph.entries == {"map"} and ("map_entry", "deep") in graph.fields and not any(e == "map" or e.startswith("k") for e, _ in graph.fields)
        got[parts] = graph.fields, graph.tables, long_rows(df, graph)
    assert got[1] == got[5] == got[50]
    assert ("map_entry", "0/0", "{'key': 'k3'}") in {(t, k, x) for i, t, k, x, _ in got[1][2] if i == 3}
    assert any(t == "y" and k == "0/0/0" for i, t, k, _, _ in got[1][2] if i == 3)


def test_a_spec_row_keeps_its_fields_however_many_there_are(spark, tmp_path):
    spec = {f"f{i}": {"x": i} for i in range(1200)} | {f"g{i}": "t" for i in range(1000)} | {"nightly": {"pages": ["p"]}}
    assert found(spark, tmp_path, [json.dumps(spec)]) == [(0, "page", "0/0", "p")]
    df = records(spark, [spec])
    row = next(r for r in nested.shred(df, "rec_id", "p", schema_graph(df, "p")).collect() if r["table_name"] == "spec")
    assert len(row["texts"]) == 1000 and row["others"]["f7"] == '{"x": 7}' and len(row["others"]) == 1200


def test_texts_of_elements_are_read_wherever_they_stand(spark):
    values = [{"a": json.dumps({"b": [{"c": "1"}]})}, {"a": {"b": [{"c": "2"}]}}, {"t": '{"no": 1}'}]
    got = set()
    for order in (values, values[::-1]):
        df = records(spark, order).coalesce(1)
        graph = schema_graph(df, "p")
        assert {("spec", "a"), ("a", "b")} <= set(graph.fields) and ("spec", "t") not in graph.fields
        got.add(tuple(sorted(r[1:] for r in long_rows(df, graph))))
    assert len(got) == 1 and sum(r[1] == "b" for r in next(iter(got))) == 0 and sum(r[0] == "b" for r in next(iter(got))) == 2


def test_deep_nesting(spark, tmp_path):
    for depth in (1_200, 5_000):
        node = '{"n": ' * depth + '"end"' + "}" * depth
        text = '{"nightly": {"pages": ["p"]}, "dfns": [{"linkingText": ["t"]}], "x": ' + node + ', "y": ' + "[" * depth + "]" * depth + "}"
        assert found(spark, tmp_path, [text, '{"nightly": {"pages": ["q"]}}', "[" * 20_000, '{"a": ' * depth + "}"]) == [(0, "page", "0/0", "p"), (0, "text", "0/0/0", "t"), (1, "page", "0/0", "q")]
    df = records(spark, [text])
    rows = nested.shred(df, "rec_id", "p", schema_graph(df, "p")).where("table_name = 'n'").agg({"*": "count"}).first()
    assert rows[0] == depth


def test_deep_reading_and_writing_agree_with_the_plain_way():
    from specstrata.functions import jsontext

    for text in ('{"a": [1, -2.5e3, true, false, null, "x\\u00e9\\n", {"b": {}}, []], "": ""}', " [ ] ", "0", '"a"', '{"a":1,"a":2}', "[1,[2,[3]]]"):
        assert jsontext._read_deep(text) == json.loads(text)
    for text in ("", "{", "[1,]", '{"a":}', "[1 2]", '{"a" 1}', "01", "+1", "nul", "[1]]", '{"a":1,}', '{1:2}', "NaN", '"a\nb"', "-"):
        for read in (json.loads, jsontext._read_deep):
            try:
                read(text)
            except ValueError:
                continue
            assert text == "NaN" and read is json.loads
    deep = jsontext.read_json("[" * 6_000 + '{"b": 1, "a": [2, "\u00e9"]}' + "]" * 6_000)
    assert jsontext.write_json(deep, ensure_ascii=False, sort_keys=True) == "[" * 6_000 + '{"a": [2, "é"], "b": 1}' + "]" * 6_000


def test_found_goes_by_path_whatever_else_the_data_hold(spark, tmp_path):
    spec = {"nightly": {"pages": ["p"]}, "refs": {"informative": [{"url": "u"}]}, "dfns": [{"linkingText": ["t"], "heading": {"href": "h"}}]}
    other = {"x": {"nightly": {"pages": ["no"]}, "refs": {"informative": [{"url": "no"}]}, "dfns": [{"heading": {"href": "no"}}]}, "nightly/pages": ["no"], "dfns": [{f"k{i}": i for i in range(1005)} | {"linkingText": ["w"], "heading": {f"k{i}": i for i in range(1000)} | {"href": "wide"}}]}
    got = found(spark, tmp_path, [json.dumps(spec), json.dumps(other), json.dumps({"results": [spec], "y": {"refs": {"informative": [{"url": "no"}]}}})])
    one = [("heading", "0/0", "h"), ("page", "0/0", "p"), ("ref", "0/0", "u"), ("text", "0/0/0", "t")]
    assert got == sorted([(i, *r) for i in (0, 2) for r in one] + [(1, "heading", "0/0", "wide"), (1, "text", "0/0/0", "w")])


def test_rows_of_all_tables_join_to_their_parents(spark, tmp_path):
    spec = {"nightly": {"pages": ["p", "q"]}, "dfns": [{"id": "d", "heading": {"href": "h", "title": "t"}, "links": [{"heading": {"href": "l"}}]}], "refs": {"normative": [{"url": "n"}], "informative": [{"name": "i", "n": 1}]}}
    text = json.dumps(spec)
    spark.createDataFrame([(1, text, 1), (1, text, 2)], "rec_id long, payload string, x int").write.parquet(f"{tmp_path}/crawl_results.parquet")
    rows = nested.p4_rows(spark, str(tmp_path)).collect()
    got = sorted((r["table_name"], r["row_key"], r["parent_table"] or "", r["parent_key"] or "", r["pos"], *sorted((r["texts"] | r["others"]).items())) for r in rows)
    assert got == [
        ("dfns", "0/0", "spec", "0", 0, ("id", "d")), ("heading", "0/0", "dfns", "0/0", 0, ("href", "h"), ("title", "t")), ("heading", "0/0/0", "links", "0/0/0", 0, ("href", "l")), ("informative", "0/0", "spec", "0", 0, ("n", "1"), ("name", "i")),
        ("links", "0/0/0", "dfns", "0/0", 0), ("normative", "0/0", "spec", "0", 0, ("url", "n")), ("pages", "0/0", "spec", "0", 0, ("value", "p")), ("pages", "0/1", "spec", "0", 1, ("value", "q")), ("spec", "0", "", "", 0),
    ]
