import json

import pytest
from pyspark.sql import functions as F

from specstrata.functions import text

from specstrata.operators import corpus, cssmerge, events, idlgraph, reports, series
from specstrata.operators.idllinks import expected_idl_definitions, mixin_users
from specstrata.sources import crawl, sinks
from specstrata.streaming.ingest import upsert_stream

LEVELS = "shortname string, current string, composition string, previous string, next string, ok boolean"


def latest(spark, rows):
    got = series.latest_levels(spark.createDataFrame(rows, LEVELS), F.col("ok")).collect()
    return {r["shortname"]: r["is_latest"] for r in got}


def test_latest_levels(spark):
    chain = [("s1", "s2", "full", None, "s2", True), ("s2", "s2", "full", "s1", "s3", True), ("s3", "s2", "full", "s2", None, False)]
    assert latest(spark, chain) == {"s1": False, "s2": True, "s3": False}
    assert latest(spark, chain[:2] + [("s3", "s2", "full", "s2", None, True)]) == {"s1": False, "s2": False, "s3": True}
    delta = [("s1", "s1", "full", None, None, True), ("s2", "s1", "delta", "s1", None, True), ("s3", "s3", "delta", "s1", None, True)]
    assert latest(spark, delta) == {"s1": True, "s2": False, "s3": True}
    assert latest(spark, [("a", "a", "full", "b", "b", False), ("b", "c", "full", "a", "a", True)]) == {"a": False, "b": False}
    assert latest(spark, []) == {}


def test_referenced_terms(spark):
    terms = spark.createDataFrame([("h", "a", 1, "x"), ("h", "b", 2, "y"), ("h", "b", 3, "z"), ("i", "a", 3, "x"), (None, "a", 4, "x")], "href string, owner string, ord int, kind string")
    links = spark.createDataFrame([("h", "c", 5, "c5"), ("h", "a", 4, "a4"), ("h", "c", 1, "c1"), ("h", "b", 0, "b"), ("i", "a", 1, "a1"), ("h", None, 1, None)], "href string, referrer string, pos int, referrer_url string")
    assert [tuple(r) for r in corpus.referenced_terms(terms, links).collect()] == [("b", "h", "y", ["c", "a"], ["c1", "a4"])]


def test_links_into_editions_of_several_pages(spark):
    one, many = "https://tc39.es/ecma262/#x", "https://tc39.es/ecma262/multipage/p.html#x"
    other = "https://html.spec.whatwg.org/multipage/q.html#y"
    terms = spark.createDataFrame([(one, "es", 1), (other, "html", 2), ("https://tc39.es/else/#x", "else", 3)], "href string, owner string, ord int")
    links = spark.createDataFrame([(many, "a", 1), (one, "a", 2), (one, "b", 3), ("https://html.spec.whatwg.org/#y", "c", 4), (other, "c", 5), ("https://html.spec.whatwg.org/multipage/r.html#y", "d", 6), ("https://tc39.es/else/multipage/p.html#x", "e", 7)], "href string, referrer string, pos int")
    got = sorted((r["owner"], r["href"], r["referrers"]) for r in corpus.referenced_terms(terms, links).collect())
    assert got == [("es", one, ["a", "b"]), ("html", other, ["c", "d"])]
    assert corpus.referenced_terms(terms.limit(0), links).count() == 0


def test_annotated_links(spark):
    specs = spark.createDataFrame([("a", 1, "https://www.w3.org/TR/a/", None, "a", ["https://www.w3.org/TR/ser/"]), ("b", 0, None, "https://www.w3.org/TR/a/", "c", ["https://www.w3.org/TR/no/"])], "shortname string, ord int, release_url string, nightly_url string, current string, series_urls array<string>")
    urls = corpus.registry_urls(specs, spark.createDataFrame([("b", "https://x.example/p.html"), ("gone", "https://y.example/")], "shortname string, url string"))
    links = spark.createDataFrame([(u,) for u in ("http://www.w3.org/TR/a#z", "https://www.w3.org/TR/ser/Overview.html", "https://www.w3.org/TR/no/", "https://x.example/p.html#q", None)], "url string")
    assert {r["url"]: r["spec_shortname"] for r in corpus.annotate_links(links, urls).collect()} == {"http://www.w3.org/TR/a#z": "b", "https://www.w3.org/TR/ser/Overview.html": "a", "https://www.w3.org/TR/no/": None, "https://x.example/p.html#q": "b", None: None}


def test_names_and_what_they_need(spark):
    names = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", None), ("D", "E"), ("E", "D"), ("M", "gone")], "name string, inheritance string")
    includes = spark.createDataFrame([("B", "M"), ("A", "lost")], "target string, mixin string")
    graph = idlgraph.name_graph(names, includes)
    got = {}
    for r in graph.collect():
        got.setdefault(r["name"], set()).add(r["related"])
    assert got == {"A": set("ABCM"), "B": set("BCM"), "C": {"C"}, "D": set("DE"), "E": set("DE"), "M": {"M"}}
    dfns = spark.createDataFrame([("M", "u", "#m"), ("C", "u", "#c"), ("C", "v", "#d"), ("A", "u", None)], "name string, url string, href string")
    assert sorted(tuple(r) for r in idlgraph.name_definitions(graph, dfns).where("name = 'A'").collect()) == [("A", "u", ["#c", "#m"]), ("A", "v", ["#d"])]


def test_what_documents_should_define(spark):
    idl = "interface A { constructor(long a); attribute long b; undefined f(long c, long... d); stringifier; iterable<long>; [Default] object toJSON(); getter long (long i); const long X = 1; }; partial interface P { attribute long q; }; enum E { \"v\" }; interface HTMLX { constructor(); }; dictionary D { long m; }; A includes M;"
    got = {(r["term"], r["type"], r["scope"]) for r in expected_idl_definitions(spark.createDataFrame([("s", idl), ("t", "interface {"), ("u", None)], "spec string, idl string")).collect()}
    assert got == {("A", "interface", None), ("constructor(a)", "constructor", "A"), ("b", "attribute", "A"), ("f(c, ...d)", "method", "A"), ("stringification behavior", "dfn", "A"), ("X", "const", "A"), ("q", "attribute", "P"), ("E", "enum", None), ('"v"', "enum-value", "E"), ("HTMLX", "interface", None), ("D", "dictionary", None), ("m", "dict-member", "D")}
    assert [tuple(r) for r in mixin_users(spark.createDataFrame([(idl,)], "idl string")).collect()] == [("M", "A")]
    css = json.dumps({"warnings": [{"msg": "Missing definition", "name": "<f()>"}, {"msg": "Missing definition", "name": "<g>", "type": "type"}, {"msg": "Missing definition", "name": "h"}, {"msg": "other", "name": "i"}]})
    want = corpus.expected_style_definitions(spark.createDataFrame([("s", css)], "spec string, css string"))
    have = spark.createDataFrame([("s", "f()", "function", []), ("s", "<g>", "value", []), ("t", "h", "type", [])], "spec string, term string, type string, scopes array<string>")
    assert {(r["term"], r["match"]) for r in corpus.missing_style_definitions(want, have).collect()} == {("<g>", "other type"), ("h", "missing")}


def test_requests_by_time_tag_and_origin(spark):
    served = spark.createDataFrame([("a", "t2", "x"), ("b", "t1", "y"), ("c", None, "x"), ("d", "t1", "x"), ("new", None, None)], "url string, last_modified string, etag string")
    stored = spark.createDataFrame([("a", "t1", "x", None), ("b", "t1", "x", None), ("c", None, "x", None), ("d", "t1", "x", "boom")], "url string, last_modified string, etag string, error string")
    assert sorted(r["url"] for r in corpus.changed_since(served, stored).collect()) == ["a", "d", "new"]
    urls = spark.createDataFrame([(u,) for u in ("https://a.csswg.org/1", "https://b.csswg.org/2", "https://www.w3.org/a", "https://www.w3.org/b", "https://x.example/")], "url string")
    got = {r["url"]: r["start_ms"] for r in corpus.request_plan(urls, text.origin(F.col("url"))).collect()}
    assert got == {"https://a.csswg.org/1": 0, "https://b.csswg.org/2": 2000, "https://www.w3.org/a": 0, "https://www.w3.org/b": 1000, "https://x.example/": 0}


def test_merge_crawls(spark):
    kind = "url string, title string, versions array<string>"
    old = spark.createDataFrame([("u1", "A", ["x"]), ("u2", "B", []), ("u3", "", ["y"]), (None, "D", None), (None, "D", None)], kind)
    new = spark.createDataFrame([("u1", "Z", []), ("u9", "", ["y", ""]), ("u9", "", None)], kind)
    got = sorted((r["url"] or "", r["title"]) for r in corpus.merge_crawls(new, old, ["url", "title"], ("versions",)).collect())
    assert got == [("", "D"), ("", "D"), ("u1", "Z"), ("u2", "B"), ("u9", ""), ("u9", "")]


def test_missing_definitions(spark):
    want = spark.createDataFrame([("f(a)", "method", "X"), ("g", "attribute", "X"), ("g", "method", None), ("h", None, "Y"), ("n", None, None)], "term string, type string, scope string")
    have = spark.createDataFrame([("f(b)", "method", ["X"]), ("g", "attribute", ["X", "Z"]), ("h", "dfn", None)], "term string, type string, scopes array<string>")
    got = {(r["term"], r["type"]): r["match"] for r in corpus.missing_definitions(want, have).collect()}
    assert got == {("f(a)", "method"): "other arguments", ("g", "attribute"): "exact", ("g", "method"): "other type", ("h", None): "other scope", ("n", None): "missing"}
    report = reports.missing_report(corpus.missing_definitions(want, have).withColumn("spec", F.lit("s"))).first()["report"]
    assert "s: 1 errors, 3 warnings" in report


def test_fallback_requests_versions(spark):
    new = spark.createDataFrame([("u", "boom", None), ("v", None, "n"), ("w", "boom", None)], "url string, error string, idl string")
    old = spark.createDataFrame([("u", "o"), ("v", "o")], "url string, idl string")
    assert {r["url"]: r["idl"] for r in corpus.with_fallback(new, old, ["idl"]).collect()} == {"u": "o", "v": "n", "w": None}
    specs = spark.createDataFrame([("s-1", "https://s/1", "s", "s-2"), ("s-2", "https://s/2", "s", "s-2")], "shortname string, url string, series string, current string")
    asked = spark.createDataFrame([("s-1", 0), ("https://s/2", 1), ("s", 2), ("https://n.x/", 3), ("a.html", 4), ("what", 5)], "request string, pos int")
    got = {r["request"]: (r["shortname"], r["url"], r["error"] is None) for r in corpus.resolve_requests(asked, specs).collect()}
    assert got == {"s-1": ("s-1", "https://s/1", True), "https://s/2": ("s-2", "https://s/2", True), "s": ("s-2", "https://s/2", True), "https://n.x/": ("httpsnx", "https://n.x/", True), "a.html": ("ahtml", "file:a.html", True), "what": (None, None, False)}
    pages = spark.createDataFrame([("u", "x"), ("v", "y")], "url string, html string")
    known = pages.select("url", F.sha2("html", 256).alias("html_hash"), F.lit("1").alias("version"), F.when(F.col("url") == "v", "e").alias("error"))
    assert [r["url"] for r in corpus.changed_documents(pages, known, "1").collect()] == ["v"] and corpus.changed_documents(pages, known, "2").count() == 2


KIND = "category string, name string, scope string, href string, syntax string, new_values string, alias_of string, series string, version string, spec string, spec_ord int, pos int"


def test_css_merge(spark):
    rows = [
        ("properties", "w", None, "h1", "a", None, None, "s", "1", "s1", 1, 0), ("properties", "w", None, "h2", "a b", None, None, "s", "2", "s2", 2, 0), ("properties", "w", None, "h3", None, "c", None, "t", "1", "t", 3, 0), ("properties", "w", None, "h4", None, "c", None, "u", "1", "u", 4, 0),
        ("types", "x", None, "h5", "q", None, None, "s", "1", "s1", 1, 1), ("types", "x", "w", "h6", "q", None, None, "s", "1", "s1", 1, 2), ("types", "x", "z", "h7", "r", None, None, "s", "1", "s1", 1, 3),
        ("types", "y", "a", "h8", "q", None, None, "s", "1", "s1", 1, 4), ("types", "y", "b", "h8", "q", None, None, "s", "1", "s1", 1, 5), ("properties", "only", None, None, "q", None, None, "s", "1", "s1", 1, 6),
        ("properties", "alias", None, "h9", None, None, "w", "s", "1", "s1", 1, 7), ("properties", "lost", None, "h10", None, None, "none", "s", "1", "s1", 1, 8),
    ]
    got = {(r["name"], tuple(r["scopes"])): r for r in cssmerge.merge_features(spark.createDataFrame(rows, KIND)).collect()}
    assert set(got) == {("w", ()), ("x", ()), ("x", ("z",)), ("y", ("a", "b")), ("alias", ()), ("lost", ())}
    assert got["w", ()]["syntax"] == "a b | c" and got["w", ()]["href"] == "h2" and got["w", ()]["extended"] == ["t", "u"]
    assert got["alias", ()]["syntax"] == "a b | c" and "none" in got["lost", ()]["error"]


def test_events_and_trees(spark):
    names = spark.createDataFrame([("Node", None), ("Element", "Node"), ("Div", "Element"), ("Loop", "Pool"), ("Pool", "Loop"), ("Window", None)], "name string, inheritance string")
    trees = idlgraph.bubbling_trees(spark)
    assert {r["name"]: r["depth"] for r in idlgraph.tree_info(names, trees).collect()} == {"Node": 3, "Element": 3, "Div": 3, "Window": 0}
    kind = "type string, interface string, targets array<string>, bubbles boolean, href string, is_extension boolean, spec string, ord int"
    rows = [("e", None, ["Element", "Div", "Mix"], True, "h", None, "a", 1), ("e", "E", ["Window"], None, "h", True, "b", 2), ("bare", None, None, None, None, None, "a", 3)]
    mixins = spark.createDataFrame([("Mix", "Window")], "mixin string, interface string")
    got = {(r["type"], r["target"]): r for r in events.merge_events(spark.createDataFrame(rows, kind), mixins, names, trees).collect()}
    assert set(got) == {("e", "Element"), ("bare", None)}  # what reaches the window by bubbling is not listed
    assert got["e", "Element"]["bubbles"] and got["e", "Element"]["bubbling_path"] == ["Node", "Document", "Window"]
    assert got["e", "Element"]["interface"] == "E" and got["e", "Element"]["extended_in"] == ["b"]
    still = [(*rows[0][:3], False, *rows[0][4:]), *rows[1:]]
    got = {(r["type"], r["target"]): r["bubbles"] for r in events.merge_events(spark.createDataFrame(still, kind), mixins, names, trees).collect()}
    assert got == {("e", "Element"): False, ("e", "Window"): None, ("bare", None): None}


def test_extended_and_split_events(spark):
    names = spark.createDataFrame([("Node", None), ("Element", "Node"), ("Window", None), ("Document", None)], "name string, inheritance string")
    kind = "type string, interface string, targets array<string>, bubbles boolean, href string, is_extension boolean, spec string, ord int, cancelable boolean, spec_url string"
    rows = [
        ("e", "E", ["Element"], True, "https://a/#e", False, "a", 1, None, "https://a/"), ("e", None, ["Window", "Document"], None, "https://a/#e2", True, "b", 2, None, "https://b/"), ("e", "F", ["Node"], None, "https://a/#e", True, "c", 3, None, "https://c/"), ("lost", None, ["Node"], None, "https://z/#l", True, "c", 4, None, "https://c/"),
        ("f", None, ["Window"], None, "https://a/#f", False, "a", 5, True, "https://a/"), ("f", None, ["Other"], None, "https://a/#f", False, "a", 6, True, "https://a/"), ("f", None, ["Third"], None, "https://a/#f", False, "a", 7, False, "https://a/"),
    ]
    mixins = spark.createDataFrame([], "mixin string, interface string")
    merged = events.merge_events(spark.createDataFrame(rows, kind), mixins, names, idlgraph.bubbling_trees(spark)).collect()
    got = {}
    for r in merged:
        got.setdefault((r["type"], r["interface"], tuple(r["extended_in"])), set()).add(r["target"])
    assert got == {("e", "E", ("b",)): {"Element"}, ("e", "F", ()): {"Node"}, ("lost", None, ()): {"Node"}, ("f", None, ()): {"Window", "Other", "Third"}}
    assert len({r["event_id"] for r in merged if r["type"] == "f"}) == 2


def test_patches(spark):
    d = spark.createDataFrame([("https://x/deviceorientation/", ["PermissionState"], [], "public"), ("https://x/deviceorientation/", ["y"], ["PermissionState"], "public"), ("https://x/portals/", ["MessageEventSource"], [], "public"), ("https://x/portals/", ["o", "MessageEventSource"], [], "public"), ("https://x/TR/audiobooks/", ["z"], None, "public"), (None, None, None, None)], "url string, linking_text array<string>, dfn_for array<string>, access_mode string")
    got = corpus.patch_definitions(d, corpus.patches(spark)).collect()
    assert [(r["linking_text"], r["access_mode"]) for r in got] == [(["o", "MessageEventSource"], "public"), (["z"], "private"), (None, None)]


def test_files_round_trip(spark, tmp_path):
    extracts = spark.createDataFrame([("T", "https://a/", "a", "interface A {};", [("m", "x = 1")]), ("U", "https://b/", "b", "", [])], "title string, url string, shortname string, idl string, cddl array<struct<name:string,cddl:string>>")
    for documents in (sinks.idl_documents(extracts), sinks.cddl_documents(extracts), sinks.extract_documents(extracts, "cddl")):
        sinks.write_documents(documents, str(tmp_path))
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.*")) == ["cddl/a-m.cddl", "cddl/a.json", "idl/a.idl"]
    back = crawl.expand_extract(spark.createDataFrame([("idl/a.idl",), ("kept",)], "idl string"), str(tmp_path), "idl")
    assert sorted(r["idl"] for r in back.collect()) == ["interface A {};", "kept"]
    row = sinks.crawl_index(extracts.select("shortname", F.lit(None).cast("string").alias("error")), "C").first()
    assert row["stats"].crawled == 2 and [r["shortname"] for r in row["results"]] == ["a", "b"]
    linked = sinks.with_files(extracts, "cddl").select("shortname", "cddl")
    assert sorted(tuple(r) for r in linked.collect()) == [("a", "cddl/a.json"), ("b", None)]
    assert sorted(r["cddl"] or "" for r in crawl.expand_extract(linked, str(tmp_path), "cddl").collect()) == ["", '[{"name":"m","cddl":"x = 1"}]']
    (tmp_path / "index.json").write_text('{"date": "2024-01-01T00:00:00Z", "results": [{"url": "u"}, {"url": "v"}]}')
    assert [r["spec_ord"] for r in crawl.read_index(spark, str(tmp_path / "index.json")).collect()] == [0, 1]


def test_files_of_styles_names_steps_and_the_console(spark, tmp_path):
    full = json.dumps({"properties": [{"name": "p", "parsedValue": {}, "values": [{"valueParseError": 1, "name": "v"}]}], "warnings": []})
    styles = spark.createDataFrame([("a", "T", "u", full), ("b", "T", "u", '{"properties": []}'), ("c", "T", "u", None), ("d", "T", "u", "{")], "shortname string, title string, url string, css string")
    assert [(r["file"], json.loads(r["body"])) for r in sinks.css_documents(styles).collect()] == [("css/a.json", {"spec": {"title": "T", "url": "u"}, "properties": [{"name": "p", "values": [{"name": "v"}]}], "warnings": []})]
    sinks.write_documents(sinks.css_documents(styles), f"file://{tmp_path}")
    back = crawl.expand_extract(spark.createDataFrame([("css/a.json",)], "css string"), str(tmp_path), "css").first()["css"]
    assert json.loads(back) == {"properties": [{"name": "p", "values": [{"name": "v"}]}], "warnings": []}
    parts = spark.createDataFrame([("N", "S", "s", True, 0, "partial interface N {};"), ("N", "R", "r", False, 5, "interface N {};")], "name string, spec_title string, spec_url string, partial boolean, ord int, fragment string")
    assert sinks.name_documents(parts).first()["body"] == "// Source: R (r)\ninterface N {};\n\n// Source: S (s)\npartial interface N {};"
    index = sinks.name_index(spark.createDataFrame([("b", "x"), ("B", "y")], "name string, type string")).first()
    assert index["file"] == "idlnames.json" and list(json.loads(index["body"])) == ["B", "b"] and json.loads(index["body"])["b"] == {"fragment": "idlnames/b.idl", "parsed": "idlnamesparsed/b.json", "type": "x"}
    assert sinks.post_documents(spark.range(1).select(F.array(F.lit(1)).alias("events")), "events", False).first()["body"] == "[1]"
    terms = spark.createDataFrame([("a", "h", ["r"])], "owner string, href string, referrers array<string>")
    documents = sinks.backref_documents(terms, styles)
    assert json.loads(documents.first()["body"])["backrefs"] == [{"href": "h", "referrers": ["r"]}]
    assert {r["shortname"]: r["backrefs"] for r in sinks.rewritten_index(styles.select("shortname", F.lit("old").alias("backrefs")), documents, "backrefs").collect()} == {"a": "backrefs/a.json", "b": None, "c": None, "d": None}
    assert sinks.terse(styles.limit(1), "title") == "T" and json.loads(sinks.terse(styles.limit(2), "title")) == ["T", "T"] and sinks.terse(terms, "referrers") == '["r"]'
    assert sinks.markdown(styles.limit(1).select("title", F.lit("r").alias("report"))).first()["part"] == "## T\nr\n"
    assert sinks.returned(styles.limit(1).select("title"), {"events": terms})["post"] == [{"mod": "events", "result": [{"owner": "a", "href": "h", "referrers": ["r"]}]}]


def test_intermediate_folder_must_be_shared(spark, monkeypatch):
    from specstrata import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://far:7077"})

    with pytest.raises(ValueError):
        session.shared_folder(Far)


def test_pages_and_reports(spark):
    pages = spark.createDataFrame([("u", "u", 0, "<h1>a</h1>"), ("u", "u2", 1, "<p id=x>")], "url string, page_url string, ord int, html string")
    assert crawl.unite_pages(pages).first()["html"] == '<h1>a</h1>\n<section data-page="u2"><p id=x></section>'
    assert [tuple(r) for r in crawl.relevant(spark.createDataFrame([("a.png", "x"), ("b.PDF", "x")], "url string, html string")).collect()] == [("b.PDF", "")]
    bad = reports.violations(spark.createDataFrame([(1, "ok-1", "https://a/"), (2, "no no", None)], "i int, shortname string, url string"), ["i"], reports.constraints("specs"))
    assert [tuple(r) for r in bad.collect()] == [(2, "shortname")] and reports.constraints("unknown") is None


def test_stream_upsert(spark, tmp_path):
    for k, rows in enumerate([[("u", "1")], [("u", "2"), ("v", "1")]]):
        spark.createDataFrame(rows, "url string, title string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("url string, title string").parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["url"]).awaitTermination()
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/v={k}")).collect()) == sorted(rows)
