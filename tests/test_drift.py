import json

from specstrata.operators.drift import drift, field_spans, leaves, p6_changes, p6_fields, p6_found

SCHEMA = "row_no long, feed string, seq int, file_name string, rec_pos int, payload string, path string, step int"


def files(spark, rows):
    return spark.createDataFrame([(i, f, s, "x", 0, p if p is None or isinstance(p, str) else json.dumps(p), "clash", 0) for i, (f, s, p) in enumerate(rows)], SCHEMA)


def run(spark, rows):
    return sorted(tuple(r) for r in drift(files(spark, rows)).select("feed", "seq", "field_path", "change_kind").collect())


def rec(url, **more):
    return {"url": url, **more}


def test_kinds_of_change(spark):
    rows = [
        ("f", 1, rec("a", x=1, y="t", dfns=[{"id": "1", "old": ["q"], "n": 1}, {"id": "2", "old": None}])), ("f", 1, rec("b", x=None, z=True)),
        ("f", 4, rec("a", x="1", y=None, dfns=[{"id": "1", "new": ["q"], "n": 2.5}, {"id": "2"}], e=[])), ("f", 4, rec("c", z=False)),
        ("g", 1, rec("a", m="v")), ("g", 2, rec("a", k="w")), ("h", 1, None), ("h", 2, "{bad"), ("h", 3, rec("a")),
        ("i", 1, rec("a", p="v")), ("i", 1, rec("a", p="v2")), ("i", 2, rec("a", q="v")), ("i", 2, rec("a", q="v2")),
    ]
    want = [
        ("f", 4, "dfns.new", "renamed"), ("f", 4, "e", "added"), ("f", 4, "x", "retyped"), ("f", 4, "y", "removed"),
        ("g", 2, "k", "added"), ("g", 2, "m", "removed"), ("h", 3, "url", "added"), ("i", 2, "q", "renamed"),
    ]
    assert run(spark, rows) == sorted(want)
    assert run(spark, rows + rows) == sorted(want)
    assert run(spark, []) == []


def spans(spark, rows):
    return sorted((r["feed"], r["path"], r["from_seq"] or 0, r["to_seq"] or 99, r["field_name"]) for r in field_spans(drift(files(spark, rows))).collect())


def test_names_follow_a_field_through_its_renames(spark):
    rows = [("f", k, rec("a", **{n: "v"})) for k, n in enumerate(("a1", "a2", "a3", "a1", "a2"))]
    rows += [("g", k, rec("a", **{n: "v"})) for k, n in enumerate("zyz")]
    assert spans(spark, rows) == [("f", "a2", 1, 2, "a1"), ("f", "a2", 4, 99, "a1"), ("f", "a3", 2, 3, "a1"), ("g", "y", 1, 2, "z")]
    assert field_spans(drift(files(spark, rows[:1]))).count() == 0


def test_a_name_taken_over_is_another_field(spark, tmp_path):
    rows = [("f", 1, rec("u", a="v")), ("f", 2, rec("u", b="v")), ("f", 3, rec("u", b="v", c="w")), ("f", 4, rec("u", b="v", a="w")), ("f", 5, rec("u", b="v")), ("f", 6, rec("u", b="v", a=1)), ("h", 1, rec("u", a="v")), ("h", 2, rec("u", b="v")), ("h", 3, rec("u", b="v", a="n"))]
    assert spans(spark, rows) == [("f", "a", 4, 5, "c"), ("f", "a", 6, 99, "c"), ("f", "b", 2, 99, "a"), ("h", "a", 3, 99, "a@3"), ("h", "b", 2, 99, "a")]
    files(spark, rows).write.parquet(f"{tmp_path}/extract_files.parquet")
    got = p6_fields(spark, str(tmp_path)).where("val_text_form <> 'u'").collect()
    assert sorted((r["feed"], r["seq"], r["field_path"], r["val_text_form"]) for r in got) == [
        ("f", 1, "a", "v"), ("f", 2, "a", "v"), ("f", 3, "a", "v"), ("f", 3, "c", "w"), ("f", 4, "a", "v"), ("f", 4, "c", "w"), ("f", 5, "a", "v"), ("f", 6, "a", "v"), ("f", 6, "c", "1"), ("h", 1, "a", "v"), ("h", 2, "a", "v"), ("h", 3, "a", "v"), ("h", 3, "a@3", "n"),
    ]


def test_alternatives_that_appear_are_told(spark, tmp_path):
    rows = [("f", 1, rec("u", x=1, g="s")), ("f", 2, rec("u", x=1, h="s")), ("f", 2, rec("v", x="t", y=[]))]
    files(spark, rows).write.parquet(f"{tmp_path}/extract_files.parquet")
    got = sorted((r["field_path"], r["change_kind"], r["old_path"], r["types_before"], r["types_now"], r["types_come"], r["types_gone"]) for r in p6_changes(spark, str(tmp_path)).collect())
    assert got == [("h", "renamed", "g", "string", "string", None, None), ("x", "retyped", None, "number", "string|number", "string", None), ("y", "added", None, None, "array", "array", None)]


def test_alike_fields_are_partnered_once_and_deep_records_read(spark):
    rows = [("f", 1, rec("u", p="v", q="v", r="v")), ("f", 2, rec("u", s="v", t="v")), ("d", 1, '{"url": "u", "x": ' + '{"y": ' * 3_000 + "1" + "}" * 3_001), ("d", 2, '{"url": "u", "n": 12345678901234567890123}')]
    got = [r for r in run(spark, rows) if r[0] == "f"]
    assert got == [("f", 2, "r", "removed"), ("f", 2, "s", "renamed"), ("f", 2, "t", "renamed")]
    assert {r[3] for r in run(spark, rows) if r[0] == "d"} == {"added", "removed"}


def test_whole_table_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/extract_files.parquet").select("feed", "seq", "payload").distinct().collect()
    held: dict = {}
    for f, s, p in rows:
        vals, types, items = held.setdefault((f, s), ({}, {}, set()))
        value = json.loads(p)
        for path, item, leaf in leaves(value):
            items.add((value["url"], item))
            if leaf is not None:
                vals.setdefault(path, {})[value["url"], item] = leaf
                types.setdefault(path, set()).add("b" if isinstance(leaf, bool) else "n" if isinstance(leaf, (int, float)) else type(leaf).__name__)
    want = set()
    for feed in {f for f, _ in held}:
        seqs = sorted(s for f, s in held if f == feed)
        for a, b in zip(seqs, seqs[1:]):
            (va, ta, ia), (vb, tb, ib) = held[feed, a], held[feed, b]
            gone, come = set(va) - set(vb), set(vb) - set(va)
            for g in sorted(gone):
                for c in sorted(come):
                    x, y = ({i: v for i, v in d.items() if i in ia & ib} for d in (va[g], vb[c]))
                    if x and x == y:
                        want.add((feed, b, c, "renamed"))
                        gone, come = gone - {g}, come - {c}
            want |= {(feed, b, p, "removed") for p in gone} | {(feed, b, p, "added") for p in come} | {(feed, b, p, "retyped") for p in ta if p in tb and ta[p] != tb[p]}
    assert {tuple(r) for r in p6_found(spark, data).collect()} == want and want
    assert p6_fields(spark, data).where("val_text_form is null").count() == 0
