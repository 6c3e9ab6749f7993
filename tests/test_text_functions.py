from pyspark.sql import functions as F

from specstrata.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_functions(spark):
    cases = [
        (t.normalize_text, "  a \n b ", "a b"), (t.normalize_css_value, " −1 ", "-1"), (t.css_idl_names, "-webkit-line-clamp", ["-webkit-line-clamp", "WebkitLineClamp", "webkitLineClamp"]), (t.css_idl_names, "color", ["color"]),
        (t.canonical_url, "http://www.w3.org/TR/x/index.html#a", "https://www.w3.org/TR/x/"), (t.canonical_url, "https://www.w3.org/TR/x", "https://www.w3.org/TR/x/"), (t.canonical_url, "https://html.spec.whatwg.org/multipage/a.html", "https://html.spec.whatwg.org/"),
        (t.origin, "https://Drafts.CSSWG.org/x", "https://csswg.org"), (t.origin, "", ""), (t.origin, "https://a.example:8/x", "https://a.example:8"),
        (t.single_page_form, "https://html.spec.whatwg.org/multipage/dom.html#x", "https://html.spec.whatwg.org/#x"), (t.encode_fragment, "a b(c)", "a%20b(c)"), (t.trim_block, "\n a {\n    b  \n   \n  }\n", "a {\n  b\n\n}"),
        (t.split_for, "a, b(c, d),e", ["a", "b(c, d)", "e"]), (t.heading_number, "2.1. Model", "2.1"), (t.heading_number, "Appendix A: Notes", "A"), (t.heading_number, "A tale", None), (t.heading_title, "2.1. Model", "Model"),
        (t.label_key, "Computed value:", "computedValue"), (t.label_key, "New values", "newValues"), (t.camel_module, "src/get-last-modified.mjs", "getLastModified"), (t.synthetic_shortname, "https://a.b/c", "httpsabc"),
        (t.unwrap_name, "<x>", "x"), (t.modern_idl, "attribute Foo[] x;", "attribute FrozenArray<Foo> x;"), (t.strip_header, "// h\n\nbody\n", "body"),
    ]
    for f, value, want in cases:
        assert one(spark, value, f) == want, (f.__name__, value)
    for f in (t.normalize_text, t.canonical_url, t.trim_block, t.heading_number):
        assert one(spark, None, f) is None
