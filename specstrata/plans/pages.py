"""Documents made of the test tables, for the extractors to read, and queries of all extractors with their SQL.

A page holds what a crawled URL (or a spec) has in a table. Pages are cut by
the rows' numbers into parts of at most PART rows, so they stay as large as
documents are, however large the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.extract.table import extract, items
from specstrata.session import table

PART = 5000


def none() -> Column:
    return F.array().cast("array<string>")


def escape(c) -> Column:
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(ch), F.lit(name))
    return c


def tag(name: str | Column, attributes: dict[str, Column | str], inner: Column) -> Column:
    """An element with attributes (left out where null) and what it holds."""
    name = F.lit(name) if isinstance(name, str) else name
    written = [F.coalesce(F.concat(F.lit(f' {k}="'), escape(F.lit(v) if isinstance(v, str) else v), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit("<"), name, *written, F.lit(">"), inner, F.lit("</"), name, F.lit(">"))


def pages(rows: DataFrame, url: Column, number: str, line: Column, order: tuple[str, ...] = (), head: str = "<title>T</title>", shortname: Column | None = None) -> DataFrame:
    """One document per URL and part, made of the lines of its rows in the order of their numbers (or of ``order``)."""
    part = F.floor(F.col(number) / PART)
    sort = [F.col(c).alias(f"o{k}") for k, c in enumerate((*order, number))]
    lines = rows.select(url.alias("url"), part.alias("part"), (F.lit(None).cast("string") if shortname is None else shortname).alias("shortname"), F.struct(*sort, line.alias("line")).alias("r")).where("url is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")
    return lines.groupBy("url", "part").agg(F.first("shortname").alias("shortname"), F.concat(F.lit(f"<html><head>{head}</head><body>"), body, F.lit("</body></html>")).alias("html")).select("url", "shortname", F.lit(None).cast("string").alias("title"), "html")


def spec_pages(spark, sf_dir: str) -> DataFrame:
    """A page per registered spec with its title, the tool that made it, its revision, its date in one of three places, references and an interface block."""
    s = table(spark, sf_dir, "specs").select("url", "shortname", "title", "spec_no", "organization", "release_url").distinct()
    k = F.col("spec_no") % 4
    day = F.concat((F.col("spec_no") % 28 + 1).cast("string"), F.lit(" May 20"), F.lpad((F.col("spec_no") % 24).cast("string"), 2, "0"))
    when = F.when(k == 0, F.concat(F.lit("<div class=head><time>"), day, F.lit("</time></div>"))).when(k == 1, F.concat(F.lit("<div class=head><h2>Draft of the group, "), day, F.lit("</h2></div>"))).otherwise(F.lit(""))
    made = F.when(k == 0, '<meta name="generator" content="Bikeshed version 1">').when(k == 1, '<meta name=generator content="ReSpec 3">').otherwise("")
    sha = F.substring(F.sha2(F.col("shortname"), 256), 1, 40)
    head = F.concat(F.when(F.col("title").isNull(), "").otherwise(tag("title", {}, escape(F.col("title")))), made, F.lit('<meta name="revision" content="'), F.when(k == 3, "none").otherwise(sha), F.lit('">'))
    own = F.concat(F.lit("<dl><dt>[ "), F.upper("shortname"), F.lit("]</dt><dd>"), F.coalesce(tag("a", {"href": F.col("release_url")}, F.lit("r")), F.lit("gone")), F.lit("</dd><dt>[NON]</dt><dd>Non-normative</dd></dl>"))
    more = F.concat(F.lit("<dl><dt>[X"), k.cast("string"), F.lit("]</dt><dd>x</dd></dl>"))
    refs = (
        F.when(k == 0, F.concat(F.lit("<h2 id=normative>N</h2>"), own, F.lit("<h2 id=informative>I</h2>"), more))
        .when(k == 1, F.concat(F.lit("<section id=normative-references><h3>N</h3>"), own, F.lit("</section><section id=informative-references>"), more, F.lit("</section>")))
        .when(k == 2, F.concat(F.lit("<h2>7.1. Normative References</h2><p>x</p>"), own, F.lit("<h2>7.2 Non-normative references</h2><ul><li>[1] "), tag("a", {"href": F.concat(F.lit("https://x.example/"), "shortname")}, F.lit("X2")), F.lit("<ul><li><a href=no>no</a></li></ul></li></ul>")))
        .otherwise(F.concat(F.lit("<h2>References</h2>"), own))
    )
    code = F.concat(F.lit("<pre class=idl>\n  interface I"), F.col("spec_no").cast("string"), F.lit(" {\n    attribute long a;\n  };\n</pre><aside><pre class=idl>interface No {};</pre></aside><pre class='cddl' data-cddl-module='m"), k.cast("string"), F.lit("'>a = "), F.col("spec_no").cast("string"), F.lit("</pre><pre class=cddl>all = 1</pre>"))
    served = F.when(k == 2, F.concat(F.lit("2022-0"), (F.col("spec_no") % 9 + 1).cast("string"), F.lit("-05T10:00:00Z")))
    return s.select("url", "shortname", F.lit(None).cast("string").alias("title"), served.alias("last_modified"), F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), when, refs, code, F.lit("</body></html>")).alias("html"))


def heading_pages(spark, sf_dir: str, sections: bool = False) -> DataFrame:
    """A page per crawled URL that holds its headings in order; with ``sections`` each in a section with an id and a paragraph with one."""
    h = table(spark, sf_dir, "headings").select("page_url", "pos", "heading_no", "level_no", "id", "title", "number_txt").where("page_url is not null and id is not null").distinct()
    level = F.concat(F.lit("h"), F.least("level_no", F.lit(6)).cast("string"))
    number = F.coalesce(F.concat("number_txt", F.lit(". ")), F.lit(""))
    line = tag(level, {"id": F.col("id")}, F.concat(number if sections else F.lit(""), escape(F.coalesce("title", F.lit("")))))
    if sections:
        line = F.concat(F.lit("<section>"), line, tag("p", {"id": F.concat(F.lit("p-"), F.col("heading_no").cast("string"))}, F.lit("x")), F.lit("</section>"))
    return pages(h, F.col("page_url"), "heading_no", line, ("pos",))


def _defined(spark, sf_dir: str, *types: str) -> DataFrame:
    d = table(spark, sf_dir, "dfns").select("dfn_no", "shortname", "page_url", "id", "linking_text", "local_linking_text", "dfn_type", "dfn_for", "access_mode").where("page_url is not null and id is not null").distinct()
    return d.where(F.col("dfn_type").isin(*types)) if types else d


def _dfn(inner: Column, **more: Column | str) -> Column:
    mark = F.when(F.col("access_mode") == "public", F.lit(" data-export")).otherwise(F.lit(" data-noexport"))
    element = tag("dfn", {"id": F.col("id"), "data-dfn-type": F.coalesce("dfn_type", F.lit("dfn")), "data-dfn-for": F.array_join(F.coalesce("dfn_for", none()), ", ")} | more, inner)
    return F.concat(F.lit("<dfn"), mark, F.substr(element, F.lit(5)))


def definition_pages(spark, sf_dir: str) -> DataFrame:
    """A page per crawled URL with its definitions as marked-up terms, prose that defines them, and developer notes."""
    line = F.concat(
        F.lit("<p>"), _dfn(F.lit("term"), **{"data-lt": F.array_join(F.coalesce("linking_text", none()), "|")}), F.lit("</p>"),
        tag("p", {"data-defines": F.concat(F.lit("#"), F.col("id"))}, F.concat(F.lit("It <b class=x>is</b> "), tag("a", {"href": F.concat(F.lit("#"), F.col("id"))}, F.col("dfn_no").cast("string")), F.lit("<img src=x>"))),
        tag("dl", {"class": "domintro"}, tag("dt", {}, tag("a", {"id": F.concat(F.lit("dev-"), F.col("dfn_no").cast("string")), "href": F.concat(F.lit("#"), F.col("id"))}, F.lit("  do  it")))),
    )
    return pages(_defined(spark, sf_dir), F.col("page_url"), "dfn_no", line)


def element_pages(spark, sf_dir: str) -> DataFrame:
    """A page per crawled URL that defines its attributes of elements as elements, and an interface for every second."""
    d = _defined(spark, sf_dir, "element-attr").where("size(linking_text) > 0").withColumn("dfn_type", F.lit("element"))
    name = F.element_at("linking_text", 1)
    iface = F.when(F.col("dfn_no") % 2 == 0, F.concat(F.lit("<p><dfn data-dfn-type=interface>HTML"), escape(F.initcap(name)), F.lit("Element</dfn></p>"))).otherwise("")
    return pages(d, F.col("page_url"), "dfn_no", F.concat(F.lit("<p>"), _dfn(escape(name)), F.lit("</p>"), iface))


def event_pages(spark, sf_dir: str) -> DataFrame:
    """A page per crawled URL with its events, named by their numbers: fired in prose, two of three defined as well."""
    d = _defined(spark, sf_dir, "event")
    name = F.concat(F.lit("ev"), F.translate(F.col("dfn_no").cast("string"), "0123456789", "abcdefghij"))
    plain = F.col("dfn_no") % 3 == 0
    fire = F.concat(tag("a", {"href": "https://dom.spec.whatwg.org/#concept-event-fire"}, F.lit("fire an event")), F.lit(" named "), F.when(plain, name).otherwise(tag("a", {"href": F.concat(F.lit("#"), F.col("id"))}, name)), F.when(F.col("dfn_no") % 2 == 0, ", with its bubbles attribute set to true.").otherwise(" using <code>GoEvent</code>."))
    term = F.when(plain, F.lit("")).otherwise(F.concat(F.lit("<p>"), _dfn(name), F.lit("</p>")))
    return pages(d, F.col("page_url"), "dfn_no", F.concat(tag("p", {"id": F.concat(F.lit("fire-"), F.col("dfn_no").cast("string"))}, fire), term))


def style_pages(spark, sf_dir: str) -> DataFrame:
    """A page per crawled URL with a table for each of its properties, and its values as definitions in their scopes."""
    d = _defined(spark, sf_dir, "property", "value").where("size(linking_text) > 0")
    name = F.element_at("linking_text", 1)
    own = F.concat(F.lit("<table class=propdef><tr><th>Name:</th><td>"), tag("dfn", {"id": F.col("id"), "data-dfn-type": "property"}, escape(name)), F.lit("</td></tr><tr><th>Value:</th><td>auto | &lt;length [0,"), F.col("dfn_no").cast("string"), F.lit("]></td></tr><tr><th>Animation type:</th><td>−1</td></tr></table>"))
    value = F.concat(F.lit("<p>"), _dfn(escape(name)), F.lit("</p>"))
    return pages(d, F.col("page_url"), "dfn_no", F.when(F.col("dfn_type") == "property", own).otherwise(value))


def algorithm_pages(spark, sf_dir: str) -> DataFrame:
    """A page per crawled URL that has an algorithm for each of its abstract operations, and a list that is none."""
    d = _defined(spark, sf_dir, "abstract-op").where("size(linking_text) > 0")
    name = F.element_at("linking_text", 1)
    steps = F.concat(F.lit("<ol><li>Let <var>x</var> be "), F.col("dfn_no").cast("string"), F.lit(".</li><li>If so:<ol><li>Return <a href='#r'>x</a>.</li></ol></li></ol><ul><li>no</li></ul><ol><li>pears</li></ol>"))
    return pages(d, F.col("page_url"), "dfn_no", F.concat(F.lit("<div><p>To "), tag("dfn", {"id": F.col("id")}, escape(name)), F.lit(":</p>"), steps, F.lit("</div>")))


def link_pages(spark, sf_dir: str) -> DataFrame:
    """A page per referring spec and month that holds its links."""
    b = table(spark, sf_dir, "backrefs").select("backref_id", "ref_shortname", "href", "link_kind", F.trunc("crawled_at", "month").alias("m")).where("ref_shortname is not null and href is not null").distinct()
    line = tag("a", {"data-link-type": F.when(F.col("link_kind") == "autolink", "dfn"), "href": F.col("href")}, F.lit("x"))
    page = F.concat("ref_shortname", F.lit("/"), F.date_format("m", "yyyy-MM"))
    return pages(b, F.concat(F.lit("https://pages.example/"), page), "backref_id", line, shortname=page)


def _anchor(c: str | Column) -> Column:
    """The anchor of a URL, decoded."""
    return F.url_decode(F.replace(F.regexp_extract(c, "#(.*)$", 1), F.lit("+"), F.lit("%2B")))


def ref_x1_title(spark, sf_dir: str) -> DataFrame:
    return extract(spec_pages(spark, sf_dir), ["title"]).select("shortname", "title")


def ref_x2_generator(spark, sf_dir: str) -> DataFrame:
    return extract(spec_pages(spark, sf_dir), ["generator"]).select("shortname", "generator")


def ref_x3_date(spark, sf_dir: str) -> DataFrame:
    return extract(spec_pages(spark, sf_dir), ["date"]).select("shortname", F.col("date").alias("written_on"))


def ref_x4_revision(spark, sf_dir: str) -> DataFrame:
    return extract(spec_pages(spark, sf_dir), ["revision"]).select("shortname", "revision")


def ref_x5_links(spark, sf_dir: str) -> DataFrame:
    """Links of every page: kind, URL, number of anchors."""
    found = extract(link_pages(spark, sf_dir), ["links"])
    kinds = [found.select("shortname", F.lit(k).alias("kind"), F.explode(f"links.{k}").alias("link_url", "anchors")) for k in ("rawlinks", "autolinks")]
    rows = kinds[0].unionByName(kinds[1]).select("shortname", "kind", "link_url", F.explode_outer("anchors").alias("anchor")).distinct()
    return rows.groupBy("shortname", "kind", "link_url").agg(F.count("anchor").alias("n_anchors"))


def ref_x6_ids(spark, sf_dir: str) -> DataFrame:
    found = items(extract(heading_pages(spark, sf_dir), ["ids"]), "ids")
    return found.select(F.col("url").alias("page_url"), _anchor("item").alias("anchor"), F.col("pos").cast("int").alias("place"))


def ref_x7_headings(spark, sf_dir: str) -> DataFrame:
    found = items(extract(heading_pages(spark, sf_dir, sections=True), ["headings"]), "headings")
    return found.select(F.col("url").alias("page_url"), "id", F.col("level"), "title", F.col("number").alias("number_txt"), F.expr("href = concat(url, '#', id)").cast("int").alias("plain_href"), F.col("pos").cast("int").alias("place")).where("id rlike '^[A-Za-z0-9_.-]+$'")


def ref_x8_references(spark, sf_dir: str) -> DataFrame:
    found = extract(spec_pages(spark, sf_dir), ["refs"])
    kinds = [found.select("shortname", F.lit(k).alias("kind"), F.explode(f"refs.{k}").alias("r")) for k in ("normative", "informative")]
    return kinds[0].unionByName(kinds[1]).select("shortname", "kind", F.col("r.name").alias("ref_name"), F.col("r.url").alias("ref_url"))


def ref_x9_idl(spark, sf_dir: str) -> DataFrame:
    return extract(spec_pages(spark, sf_dir), ["idl"]).select("shortname", "idl")


def ref_x10_cddl(spark, sf_dir: str) -> DataFrame:
    return extract(spec_pages(spark, sf_dir), ["cddl"]).select("shortname", F.explode("cddl").alias("m")).select("shortname", F.col("m.name").alias("module"), F.col("m.cddl").alias("cddl"))


def ref_x11_elements(spark, sf_dir: str) -> DataFrame:
    found = items(extract(element_pages(spark, sf_dir), ["elements"]), "elements")
    return found.select(F.col("url").alias("page_url"), _anchor("href").alias("dfn_id"), F.col("name").alias("element"), F.col("interface").isNotNull().cast("int").alias("has_interface"))


def ref_x12_events(spark, sf_dir: str) -> DataFrame:
    found = items(extract(event_pages(spark, sf_dir), ["events"]), "events")
    return found.select(F.col("url").alias("page_url"), "type", _anchor("href").alias("anchor"), "interface", F.array_join("targets", "|").alias("targets"), F.col("bubbles").cast("int").alias("bubbles"), F.col("src.format").alias("source"))


def ref_x13_dfns(spark, sf_dir: str) -> DataFrame:
    found = items(extract(definition_pages(spark, sf_dir), ["dfns"]), "dfns")
    return found.select(F.col("url").alias("page_url"), F.col("id").alias("dfn_id"), F.array_join("linkingText", "|").alias("texts"), F.col("type").alias("dfn_type"), F.array_join("for", "|").alias("scopes"), F.col("access").alias("access_mode"))


def ref_x14_css(spark, sf_dir: str) -> DataFrame:
    """Properties of style documents with their value and further fields."""
    found = extract(style_pages(spark, sf_dir), ["css"])
    kind = "struct<properties:array<struct<name:string,href:string,value:string,animationType:string>>>"
    rows = found.select("url", F.explode(F.from_json("css", kind)["properties"]).alias("p"))
    return rows.select(F.col("url").alias("page_url"), F.col("p.name").alias("name"), _anchor("p.href").alias("dfn_id"), F.col("p.value").alias("value"), F.col("p.animationType").alias("animation_type"))


def ref_x15_algorithms(spark, sf_dir: str) -> DataFrame:
    """Algorithms with name, anchor, why they count as one, and the markup of their steps."""
    found = extract(algorithm_pages(spark, sf_dir), ["algorithms"])
    step = "struct<html:string,rationale:string,steps:array<struct<html:string>>>"
    rows = found.select("url", F.explode(F.from_json("algorithms", f"array<struct<name:string,href:string,html:string,rationale:string,steps:array<{step}>>>")).alias("a"))
    last = F.element_at("a.steps", -1)
    return rows.select(F.col("url").alias("page_url"), F.col("a.name").alias("name"), _anchor("a.href").alias("dfn_id"), F.col("a.rationale").alias("rationale"), F.size("a.steps").alias("n_steps"), F.element_at("a.steps", 1)["html"].alias("first_step"), last["steps"][0]["html"].alias("inner_step"))


def ref_x16_outline(spark, sf_dir: str) -> DataFrame:
    """Depth, title and level of the sections of pages whose headings follow each other."""
    found = items(extract(heading_pages(spark, sf_dir), ["outline"]), "outline")
    return found.where("title is not null").select(F.col("url").alias("page_url"), F.col("pos").cast("int").alias("place"), "depth", "title", "level")


def ref_x17_id_headings(spark, sf_dir: str) -> DataFrame:
    """The heading above each paragraph with an id."""

    def above(page):
        return [(k, v.get("id"), v.get("number")) for k, v in page.headings_by_id.items() if "#p-" in k]

    found = extract(heading_pages(spark, sf_dir, sections=True), ["title"], {"above": above})
    rows = found.select("url", F.explode(F.from_json("above", "array<array<string>>")).alias("x"))
    return rows.select(F.col("url").alias("page_url"), _anchor(F.col("x")[0]).alias("anchor"), F.col("x")[1].alias("heading_id"), F.col("x")[2].alias("number_txt"))


def ref_x18_dev_links(spark, sf_dir: str) -> DataFrame:
    """Developer notes and the definition each is about."""
    found = items(extract(definition_pages(spark, sf_dir), ["dfns"]), "dfns").select("url", F.col("id").alias("dfn_id"), F.explode("links").alias("l"))
    return found.groupBy(F.col("url").alias("page_url"), "dfn_id", F.col("l.type").alias("link_type"), F.col("l.name").alias("link_name")).agg(F.count("*").alias("n_links"))


def ref_x19_prose(spark, sf_dir: str) -> DataFrame:
    """Markup of the prose that defines a term, with absolute links."""
    found = items(extract(definition_pages(spark, sf_dir), ["dfns"]), "dfns")
    return found.where("id rlike '^[A-Za-z0-9_.-]+$'").groupBy(F.col("url").alias("page_url"), F.col("id").alias("dfn_id")).agg(F.min("htmlProse").alias("prose"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("ref_")}

_S = "(SELECT DISTINCT url, shortname, title, spec_no, organization, release_url FROM specs)"
_DAY = "(spec_no % 28 + 1) || ' May 20' || lpad(CAST(spec_no % 24 AS VARCHAR), 2, '0')"
_T = "trim(regexp_replace({c}, '[\\s\u00a0]+', ' ', 'g'))"
_H = f"(SELECT *, row_number() OVER (PARTITION BY page_url, heading_no // {PART} ORDER BY pos, heading_no) - 1 AS k FROM (SELECT DISTINCT heading_no, page_url, pos, id, level_no, title, number_txt FROM headings WHERE page_url IS NOT NULL AND id IS NOT NULL))"
_D = "(SELECT DISTINCT dfn_no, shortname, page_url, id, linking_text AS lt, dfn_type, coalesce(dfn_for, CAST([] AS VARCHAR[])) AS df, access_mode FROM dfns WHERE page_url IS NOT NULL AND id IS NOT NULL)"
_X13 = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_url, dfn_no // {PART}, dfn_type, list_sort(list_distinct(lt)), list_sort(list_distinct(df)), access_mode = 'public' ORDER BY dfn_no) AS k
        FROM (SELECT * REPLACE (coalesce(lt, CAST([] AS VARCHAR[])) AS lt) FROM {_D}) WHERE len(lt) > 0) WHERE access_mode <> 'public' OR k = 1)"""
_PLAIN = "regexp_matches({c}, '^[A-Za-z0-9_.-]+$')"



def _as_written(c: str) -> str:
    """SQL of an anchor with what a URL cannot hold percent-encoded and all else as it is."""
    out = f"url_encode({c})"
    for ch in "!$&()*+,/:;=@[]?'%":
        literal = "''" if ch == "'" else ch
        out = f"replace({out}, '%{ord(ch):02X}', '{literal}')"
    return out


ORACLE = {
    "ref_x1_title": f"SELECT shortname, CASE WHEN coalesce({_T.format(c='title')}, '') = '' THEN '[No title found for ' || url || ']' ELSE {_T.format(c='title')} END AS title FROM {_S}",
    "ref_x2_generator": f"SELECT shortname, CASE spec_no % 4 WHEN 0 THEN 'bikeshed' WHEN 1 THEN 'respec' END AS generator FROM {_S}",
    "ref_x3_date": f"SELECT shortname, CASE WHEN spec_no % 4 < 2 THEN {_DAY} WHEN spec_no % 4 = 2 THEN '5 ' || ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September'][spec_no % 9 + 1] || ' 2022' END AS written_on FROM {_S}",
    "ref_x4_revision": f"SELECT shortname, CASE WHEN spec_no % 4 <> 3 THEN left(sha256(shortname), 40) END AS revision FROM {_S}",
    "ref_x5_links": r"""WITH b AS (SELECT DISTINCT ref_shortname || '/' || strftime(crawled_at AT TIME ZONE 'UTC', '%Y-%m') AS shortname, CASE WHEN link_kind = 'autolink' THEN 'autolinks' ELSE 'rawlinks' END AS kind, href FROM backrefs WHERE ref_shortname IS NOT NULL AND href IS NOT NULL AND starts_with(href, 'http')),
        p AS (SELECT shortname, kind, regexp_extract(href, '^([^:]+://)([^/?#]*)(.*)$', ['a', 'b', 'c']) AS x FROM b)
        SELECT shortname, kind, x.a || lower(x.b) || CASE WHEN split_part(x.c, '#', 1) = '' THEN '/' ELSE split_part(x.c, '#', 1) END AS link_url, count(DISTINCT nullif(@@, '')) AS n_anchors FROM p GROUP BY ALL""".replace("@@", _as_written("split_part(x.c, '#', 2)")),
    "ref_x6_ids": f"SELECT page_url, id AS anchor, CAST(k AS INTEGER) AS place FROM {_H}",
    "ref_x7_headings": f"SELECT page_url, id, CAST(least(level_no, 6) AS INTEGER) AS level, {_T.format(c='title')} AS title, number_txt, 1 AS plain_href, CAST(k AS INTEGER) AS place FROM {_H} WHERE {_PLAIN.format(c='id')}",
    "ref_x8_references": f"""SELECT shortname, 'normative' AS kind, upper(shortname) AS ref_name, release_url AS ref_url FROM {_S} UNION ALL SELECT shortname, CASE WHEN spec_no % 4 = 2 THEN 'normative' ELSE 'informative' END, 'NON', NULL FROM {_S}
        UNION ALL SELECT shortname, 'informative', 'X' || spec_no % 4, CASE WHEN spec_no % 4 = 2 THEN 'https://x.example/' || shortname END FROM {_S} WHERE spec_no % 4 < 3""",
    "ref_x9_idl": f"SELECT shortname, 'interface I' || spec_no || ' {{{{' || chr(10) || '  attribute long a;' || chr(10) || '}}}};' AS idl FROM {_S}".replace("{{", "{").replace("}}", "}"),
    "ref_x10_cddl": f"SELECT shortname, unnest(['all', 'm' || spec_no % 4]) AS module, 'a = ' || spec_no || chr(10) || chr(10) || 'all = 1' AS cddl FROM {_S}",
    "ref_x11_elements": f"SELECT page_url, id AS dfn_id, {_T.format(c='lt[1]')} AS element, CAST((SELECT count(*) = 1 FROM {_D} o WHERE o.dfn_type = 'element-attr' AND o.page_url = d.page_url AND o.dfn_no // {PART} = d.dfn_no // {PART} AND o.dfn_no % 2 = 0 AND lower(o.lt[1]) = d.lt[1]) AS INTEGER) AS has_interface FROM {_D} d WHERE dfn_type = 'element-attr' AND len(lt) > 0",
    "ref_x12_events": f"""SELECT page_url, 'ev' || translate(CAST(dfn_no AS VARCHAR), '0123456789', 'abcdefghij') AS type, CASE WHEN dfn_no % 3 = 0 THEN 'fire-' || dfn_no ELSE id END AS anchor, CASE WHEN dfn_no % 2 = 0 THEN 'Event' ELSE 'GoEvent' END AS interface,
        CASE WHEN dfn_no % 3 <> 0 AND len(f) > 0 THEN array_to_string(f, '|') END AS targets, CASE WHEN dfn_no % 2 = 0 THEN 1 END AS bubbles, 'fire an event phrasing' AS source
        FROM (SELECT *, first_value(df) OVER (PARTITION BY page_url, dfn_no // {PART}, id, dfn_no % 3 <> 0 ORDER BY dfn_no) AS f FROM {_D} WHERE dfn_type = 'event')""",
    "ref_x13_dfns": f"SELECT page_url, id AS dfn_id, array_to_string(lt, '|') AS texts, dfn_type, array_to_string(df, '|') AS scopes, CASE WHEN access_mode = 'public' THEN 'public' ELSE 'private' END AS access_mode FROM {_X13}",
    "ref_x15_algorithms": f"SELECT page_url, lt[1] AS name, id AS dfn_id, 'let' AS rationale, 2 AS n_steps, 'Let <var>x</var> be ' || dfn_no || '.' AS first_step, 'Return <a href=\"' || page_url || '#r\">x</a>.' AS inner_step FROM {_D} WHERE dfn_type = 'abstract-op' AND len(lt) > 0",
    "ref_x14_css": f"SELECT page_url, lt[1] AS name, id AS dfn_id, 'auto | <length [0,' || dfn_no || ']>' AS value, '-1' AS animation_type FROM (SELECT *, row_number() OVER (PARTITION BY page_url, dfn_no // {PART}, lt[1] ORDER BY dfn_no) AS k FROM {_D} WHERE dfn_type = 'property' AND len(lt) > 0) WHERE k = 1",
    "ref_x17_id_headings": f"SELECT page_url, 'p-' || heading_no AS anchor, id AS heading_id, number_txt FROM {_H}",
    "ref_x18_dev_links": f"SELECT d.page_url, d.id AS dfn_id, 'dev' AS link_type, 'do it' AS link_name, count(*) AS n_links FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_url, id, dfn_no // {PART} ORDER BY dfn_no) AS j FROM {_X13}) WHERE j = 1) d JOIN {_D} o ON o.page_url = d.page_url AND o.id = d.id AND o.dfn_no // {PART} = d.dfn_no // {PART} GROUP BY ALL",
    "ref_x19_prose": f"SELECT page_url, id AS dfn_id, min(p) AS prose FROM (SELECT d.page_url, d.id, 'It <b>is</b> <a href=\"' || d.page_url || '#' || d.id || '\">' || o.n || '</a>' AS p FROM {_X13} d JOIN (SELECT page_url, id, dfn_no // {PART} AS part, min(dfn_no) AS n FROM {_D} GROUP BY ALL) o ON o.page_url = d.page_url AND o.id = d.id AND o.part = d.dfn_no // {PART} WHERE {_PLAIN.format(c='d.id')}) GROUP BY ALL",
}
