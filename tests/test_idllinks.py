from specstrata.operators.idllinks import linked_parts

IDL = 'interface A { constructor(long x); attribute long b; undefined f(long y); undefined f(long y, long z); iterable<long>; }; partial interface P { attribute long q; }; enum E { "v" };'


def test_links(spark):
    texts = spark.createDataFrame([("s", IDL), ("t", "interface {"), ("u", None)], "spec string, idl string")
    rows = [
        ("s", ["A"], "interface", [], "#A"), ("s", ["b"], "attribute", ["A"], "#b"), ("s", ["b"], "attribute", ["B"], "#no"), ("s", ["f()"], "method", ["A"], "#f"), ("s", ["f(y, z)"], "method", ["A"], "#f2"),
        ("s", ["A()", "constructor(x)"], "constructor", ["A"], "#c"), ("s", ["q"], "attribute", ["P"], "#q1"), ("s", ["q"], "attribute", ["P"], "#q2"), ("s", ['"v"'], "enum-value", ["E"], "#v"), ("x", ["E"], "enum", [], "#no"),
    ]
    known = spark.createDataFrame(rows, "spec string, linking_text array<string>, dfn_type string, dfn_for array<string>, href string")
    got = {(r["definition"], r["member"], r["pos"]): r["href"] for r in linked_parts(texts, known).collect()}
    assert got == {("A", None, -1): "#A", ("A", "constructor", 0): "#c", ("A", "b", 1): "#b", ("A", "f", 2): "#f", ("A", "f", 3): "#f2", ("P", "q", 0): None, ("E", None, -1): None, ("E", "v", 0): "#v"}
    assert linked_parts(texts, known.limit(0)).where("href is not null").count() == 0
