"""Queries of the corpus operators on the test tables, and their SQL."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specstrata.extract.cssgrammar import GrammarError, parse_value
from specstrata.extract.table import extract, idl_reports
from specstrata.functions import text
from specstrata.functions.urls import plain_href
from specstrata.operators import corpus, cssmerge, events, idlgraph, reports, series
from specstrata.operators.idllinks import expected_idl_definitions, linked_parts, mixin_users
from specstrata.plans.pages import PART
from specstrata.plans.training import plain
from specstrata.session import qualified, shared_folder, table
from specstrata.sources import crawl, sinks


def _levels(spark, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "specs")
    return series.registry_levels(specs).join(specs.select("shortname", "standing", "release_url"), "shortname")


def ref_c1_latest_levels(spark, sf_dir: str) -> DataFrame:
    judged = series.latest_levels(_levels(spark, sf_dir), F.col("standing") != "discontinued")
    return judged.select("shortname", "series", "composition", "is_latest")


def ref_k6_series_files(spark, sf_dir: str) -> DataFrame:
    return series.series_adjusted(_levels(spark, sf_dir), F.col("release_url").isNotNull()).select("shortname", "file_stem")


def ref_c2_features(spark, sf_dir: str) -> DataFrame:
    """Definitions of all specs as style features, one per text and scope; every third has no syntax, of which every second brings new values."""
    levels = series.registry_levels(table(spark, sf_dir, "specs"))
    d = table(spark, sf_dir, "dfns").select("dfn_no", "shortname", "href", "linking_text", "dfn_type", "dfn_for").distinct()
    named = d.join(levels, "shortname").withColumn("name", F.explode(F.array_distinct("linking_text"))).withColumn("scope", F.explode_outer(F.array_distinct("dfn_for")))
    k = F.col("dfn_no")
    rows = named.select(
        F.when(F.col("dfn_type") == "property", "properties").otherwise("types").alias("category"), "name", "scope", plain_href(F.col("href")).alias("href"), F.when(k % 3 > 0, F.concat(F.lit("v"), (k % 5).cast("string"))).alias("syntax"),
        F.when(k % 6 == 0, F.concat(F.lit("n"), (k % 7).cast("string"))).alias("new_values"), F.lit(None).cast("string").alias("alias_of"), "series", "version", F.col("shortname").alias("spec"), k.alias("spec_ord"), F.lit(0).alias("pos"),
    )
    return cssmerge.merge_features(rows).select("category", "name", "href", F.array_join("scopes", "|").alias("scopes"), "syntax", F.size("extended").alias("n_extended"))


def ref_c4_names(spark, sf_dir: str) -> DataFrame:
    """Names with what they include, by way of their parsed fragments."""
    rows = table(spark, sf_dir, "idlnames").select(F.trim("idl_name").alias("name"), F.col("idl_type").alias("type"), F.col("shortname").alias("spec"), F.col("idl_no").cast("int").alias("spec_ord"), F.lit(0).alias("pos"), F.lit(False).alias("partial"), F.trim("inheritance").alias("inheritance"), "fragment", "includes").distinct()
    mixed = rows.select(F.col("name").alias("target"), F.explode("includes").alias("mixin")).select("target", F.trim("mixin").alias("mixin")).where("mixin <> ''")
    merged = idlgraph.merge_names(rows.drop("includes"), mixed)
    return merged.select("name", "type", "defined_in", F.coalesce(F.size("includes"), F.lit(0)).cast("int").alias("n_includes"))


def ref_c4_graph(spark, sf_dir: str) -> DataFrame:
    """Every name with all it inherits from or includes, over any number of steps."""
    return idlgraph.name_graph(*_names_and_mixins(spark, sf_dir)).select("name", "related")


def ref_c4_definitions(spark, sf_dir: str) -> DataFrame:
    """The fragments of all that a name defines, inherits and includes, by spec."""
    rows = table(spark, sf_dir, "idlnames").select(F.trim("idl_name").alias("name"), F.col("shortname").alias("url"), F.concat(F.lit("#"), F.col("idl_no").cast("string")).alias("href")).distinct()
    found = idlgraph.reached_definitions(*_names_and_mixins(spark, sf_dir), rows)
    return found.select("name", F.col("url").alias("spec"), F.array_join("hrefs", " ").alias("hrefs"))


def _names_and_mixins(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "idlnames").select(F.trim("idl_name").alias("name"), F.trim("inheritance").alias("inheritance"), "includes").distinct()
    return rows.select("name", "inheritance"), rows.select(F.col("name").alias("target"), F.explode("includes").alias("mixin")).select("target", F.trim("mixin").alias("mixin"))


def ref_c3_mixins(spark, sf_dir: str) -> DataFrame:
    """Which interfaces include which mixins, by the statements of a corpus."""
    _, mixed = _names_and_mixins(spark, sf_dir)
    texts = mixed.where("mixin rlike '^[A-Za-z][A-Za-z0-9]*$' and target rlike '^[A-Za-z][A-Za-z0-9]*$'").select(F.concat("target", F.lit(" includes "), "mixin", F.lit(";")).alias("idl"))
    return mixin_users(texts)


def ref_c3_events(spark, sf_dir: str) -> DataFrame:
    """Events of all specs merged, going to the interfaces of their scopes and to every interface or mixin of their spec."""
    d = table(spark, sf_dir, "dfns").where("dfn_type = 'event' and size(linking_text) > 0").select("dfn_no", "shortname", "href", "linking_text", "dfn_for").distinct()
    names, mixed = _names_and_mixins(spark, sf_dir)
    own = table(spark, sf_dir, "idlnames").groupBy("shortname").agg(F.array_sort(F.collect_set(F.trim("idl_name"))).alias("own"))
    rows = d.join(own, "shortname", "left").select(
        F.element_at("linking_text", 1).alias("type"), F.when(F.col("dfn_no") % 2 == 0, "Event").alias("interface"), F.array_union(F.coalesce("dfn_for", F.array().cast("array<string>")), F.coalesce("own", F.array().cast("array<string>"))).alias("targets"),
        (F.col("dfn_no") % 3 == 0).alias("bubbles"), plain_href(F.col("href")).alias("href"), F.lit(False).alias("is_extension"), F.col("shortname").alias("spec"), F.col("dfn_no").alias("ord"),
    )
    merged = events.merge_events(rows, mixed.select("mixin", F.col("target").alias("interface")), names.dropDuplicates(["name"]), idlgraph.bubbling_trees(spark))
    return merged.select("event_id", "type", "interface", "target", F.array_join("extended_in", ",").alias("extended_in"))


def ref_l1_reports(spark, sf_dir: str) -> DataFrame:
    """Parsed interface definitions of the corpus, every ninth with an error: the name each fragment defines, or that it failed."""
    rows = table(spark, sf_dir, "idlnames").select("idl_no", "idl_name", F.when(F.col("idl_no") % 9 == 0, F.concat("fragment", F.lit(" interface {"))).otherwise(F.col("fragment")).alias("fragment")).distinct()
    parsed = idl_reports(rows, "fragment")
    names = F.map_keys(F.from_json(F.get_json_object("report", "$.idl_names"), "map<string,string>"))
    return parsed.select("idl_no", F.array_join(names, "|").alias("names"), F.col("idl_error").isNotNull().cast("int").alias("failed"))


def _exposed(spark, sf_dir: str) -> DataFrame:
    """Interfaces and dictionaries with members, exposed in places by their numbers."""
    rows = table(spark, sf_dir, "idlnames").select("idl_no", F.trim("idl_name").alias("n"), F.trim("inheritance").alias("up")).where("n rlike '^[A-Za-z][A-Za-z0-9]*$'").distinct()
    k = F.col("idl_no")
    head = F.concat(F.lit("[Exposed=(Window,W"), (k % 3).cast("string"), F.lit(")"), F.when(k % 5 == 0, F.lit(", Global=G")).otherwise(F.lit("")), F.lit("] interface "), "n", F.when(F.col("up").rlike("^[A-Za-z][A-Za-z0-9]*$"), F.concat(F.lit(" : "), "up")).otherwise(F.lit("")))
    body = F.concat(F.lit(" { "), F.when(k % 2 == 0, F.lit("constructor(); ")).otherwise(F.lit("")), F.lit("attribute (T"), (k % 7).cast("string"), F.lit(" or sequence<Date>)? a; undefined f(DOMString s, optional unsigned long long x = 0, Promise<E> p); const octet c = 1; }; partial dictionary P { double d; D y; };"))
    return idl_reports(rows.select("idl_no", "n", F.concat(head, body).alias("idl")), "idl")


def ref_l2_exposure(spark, sf_dir: str) -> DataFrame:
    """Where each interface is exposed, as constructor or function, and of which global scope it is."""
    r = _exposed(spark, sf_dir)
    kinds = [r.select("idl_no", F.lit(k).alias("kind"), F.explode(F.from_json(F.get_json_object("report", f"$.{k}"), "map<string,array<string>>")).alias("place", "names")) for k in ("exposed", "globals", "constructors", "functions")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]).select("idl_no", "kind", "place", F.array_join("names", "|").alias("names"))


def ref_l3_dependencies(spark, sf_dir: str) -> DataFrame:
    """The types each interface depends on, and those of a text that it does not define."""
    r = _exposed(spark, sf_dir)
    needs = F.from_json(F.get_json_object("report", "$.dependencies"), "map<string,array<string>>")
    return r.select("idl_no", F.array_join(F.element_at(needs, F.col("n")), "|").alias("needs"), F.array_join(F.from_json(F.get_json_object("report", "$.external"), "array<string>"), "|").alias("external"))


def ref_l4_grammar(spark, sf_dir: str) -> DataFrame:
    """Value definitions made of the texts of properties, as trees."""
    d = table(spark, sf_dir, "dfns").where("dfn_type in ('property', 'value')").select("dfn_no", F.element_at("linking_text", 1).alias("t")).where("t rlike '^[A-Za-z][-A-Za-z0-9]*$'").distinct()
    k = (F.col("dfn_no") % 10).cast("string")
    value = F.concat("t", F.lit(" | <length [0,"), k, F.lit("]>{1,"), k, F.lit("} || [ <"), "t", F.lit("> , <'"), "t", F.lit("'> ]#"))

    @F.pandas_udf("string")
    def tree(values: pd.Series) -> pd.Series:
        def one(v: str) -> str:
            try:
                return json.dumps(parse_value(v), ensure_ascii=False, separators=(",", ":"))
            except GrammarError:
                return "error"

        return values.map(one)

    return d.select("dfn_no", tree(F.when(F.col("dfn_no") % 4 == 0, F.concat(value, F.lit(" ]"))).otherwise(value)).alias("tree"))


def _one_page(href: Column, multi: Column, page: str) -> Column:
    """Hrefs of one host as links into a standard that has a single page and several."""
    standard = F.lit("https://html.spec.whatwg.org/")
    return F.when(href.startswith("https://tr.quillmark.example/"), F.concat(standard, F.when(multi, F.lit(f"multipage/{page}.html")).otherwise(F.lit("")), F.lit("#"), F.substring_index(href, "#", -1))).otherwise(href)


def ref_c5_backrefs(spark, sf_dir: str) -> DataFrame:
    """Who refers to each definition, in the order first seen; one host stands for a standard of several pages."""
    d = table(spark, sf_dir, "dfns").select("href", F.col("shortname").alias("owner"), F.col("dfn_no").alias("ord"), "dfn_type").unionByName(table(spark, sf_dir, "core_dfns").select("href", F.col("shortname").alias("owner"), (-1 - F.col("core_no")).cast("long").alias("ord"), "dfn_type"))
    terms = d.withColumn("href", _one_page(plain_href(F.col("href")), F.col("ord") % 5 == 0, "terms"))
    links = table(spark, sf_dir, "backrefs").select(_one_page(plain_href(F.col("href")), F.col("backref_id") % 2 == 0, "links").alias("href"), F.col("ref_shortname").alias("referrer"), F.col("backref_id").alias("pos"), F.col("ref_url").alias("referrer_url"))
    found = corpus.referenced_terms(terms, links)
    return found.select("owner", "href", "dfn_type", F.array_join("referrers", ",").alias("referrers"), F.size(F.array_compact("referrer_urls")).alias("n_urls"))


def ref_c6_merge(spark, sf_dir: str) -> DataFrame:
    """The shared definitions merged over the crawled ones, by href or id."""
    columns = ["shortname", "id", "href", "dfn_type"]
    old = table(spark, sf_dir, "dfns").select(*columns).distinct().withColumn("origin", F.lit("old"))
    new = table(spark, sf_dir, "core_dfns").select(*columns).withColumn("origin", F.lit("new"))
    return corpus.merge_crawls(new, old, ["href", "id"])


def _members(spark, sf_dir: str) -> DataFrame:
    """dfn_no, spec, scope, n, kind, href of definitions of members, one per scope; names that cannot stand in interface definitions are left out."""
    d = table(spark, sf_dir, "dfns").where("dfn_type in ('attribute', 'method')").select("dfn_no", F.col("shortname").alias("spec"), F.explode("dfn_for").alias("scope"), F.element_at("linking_text", 1).alias("n"), F.col("dfn_type").alias("kind"), plain_href(F.col("href")).alias("href"))
    word = "rlike '^[A-Za-z][A-Za-z0-9]*$'"
    return d.where(f"n {word} and scope {word}").distinct()


def _member_definitions(spark, sf_dir: str) -> DataFrame:
    """The definitions of members, methods with parentheses."""
    d = table(spark, sf_dir, "dfns").where("dfn_type in ('attribute', 'method')")
    ends = F.when(F.col("dfn_type") == "method", F.lit("()")).otherwise(F.lit(""))
    return d.select(F.col("shortname").alias("spec"), F.transform("linking_text", lambda t: F.concat(t, ends)).alias("linking_text"), "dfn_type", "dfn_for", plain_href(F.col("href")).alias("href"))


def ref_c7_missing(spark, sf_dir: str) -> DataFrame:
    """Members that interface definitions want defined, by how they are found: as they are, with an argument, of another kind, on another interface, or under another name."""
    k, method = F.col("dfn_no") % 5, F.col("kind") == "method"
    scope = F.when(k == 2, F.concat(F.lit("X"), "scope")).otherwise(F.col("scope"))
    name = F.when(k == 3, F.concat("n", F.lit("x"))).otherwise(F.col("n"))
    call = F.concat(F.lit("undefined "), name, F.when((k == 4) & method, F.lit("(long a)")).otherwise(F.lit("()")))
    member = F.when(method & (k == 1) | ~method & (k != 1), F.concat(F.lit("attribute long "), name)).otherwise(call)
    texts = _members(spark, sf_dir).select("spec", F.concat(F.lit("partial interface "), scope, F.lit(" { "), member, F.lit("; };")).alias("idl"))
    have = _member_definitions(spark, sf_dir).select("spec", F.explode("linking_text").alias("term"), F.col("dfn_type").alias("type"), F.col("dfn_for").alias("scopes"))
    return corpus.missing_definitions(expected_idl_definitions(texts), have, ("spec",)).select("spec", "term", "type", "scope", F.col("match"))


def ref_c7_terms(spark, sf_dir: str) -> DataFrame:
    """Terms of the snapshots looked for among the crawled definitions, in each of their scopes."""
    wanted = table(spark, sf_dir, "dfn_snapshots").select(F.explode("linking_text").alias("t"), F.col("dfn_type").alias("type"), "dfn_for").select(text.normalize_text(F.col("t")).alias("term"), "type", F.explode_outer("dfn_for").alias("scope"))
    have = table(spark, sf_dir, "dfns").select(F.explode("linking_text").alias("term"), F.col("dfn_type").alias("type"), F.col("dfn_for").alias("scopes"))
    return corpus.missing_definitions(wanted, have).select("term", "type", "scope", F.col("match"))


def ref_c8_stats(spark, sf_dir: str) -> DataFrame:
    """Crawl records and those whose payload cannot be read."""
    rows = table(spark, sf_dir, "crawl_results").select("rec_id", "payload").distinct()
    bad = F.when(F.expr("payload is null or try_parse_json(payload) is null"), F.lit("unreadable"))
    return corpus.crawl_stats(rows, bad)


def ref_c9_trees(spark, sf_dir: str) -> DataFrame:
    """The nearest interface of each name in the trees that the names without inheritance make with their children."""
    names = table(spark, sf_dir, "idlnames").select(F.trim("idl_name").alias("name"), F.nullif(F.trim("inheritance"), F.lit("")).alias("inheritance")).where("name is not null").distinct()
    top = names.where("inheritance is null").select(F.concat(F.lit("tree of "), "name").alias("tree"), F.col("name").alias("interface"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("bubbling_path"))
    low = names.join(top.select("tree", F.col("interface").alias("inheritance")), "inheritance").select("tree", F.col("name").alias("interface"), F.lit(1).alias("depth"), F.array("inheritance").alias("bubbling_path"))
    return idlgraph.tree_info(names, top.unionByName(low)).select("name", "tree", "interface", "depth", F.array_join("bubbling_path", ">").alias("bubbling_path"))


def ref_p1_properties(spark, sf_dir: str) -> DataFrame:
    """Properties of the snapshots, those that specs only define, and their names for scripts."""
    d = table(spark, sf_dir, "dfns").select(F.col("shortname").alias("spec"), "linking_text", "dfn_type", "informative", "href", F.col("dfn_no").alias("pos")).distinct()
    listed = table(spark, sf_dir, "dfn_snapshots").where("dfn_type = 'property'").select(F.col("shortname").alias("spec"), F.explode("linking_text").alias("name")).where("name is not null").distinct().select("spec", "name", F.lit("listed").alias("href"), F.lit(0).alias("pos"))
    few = table(spark, sf_dir, "dfns").where("dfn_type = 'property' and dfn_no % 2 = 0").select(F.col("shortname").alias("spec"), F.explode("linking_text").alias("name")).distinct().select("spec", "name", F.lit("listed").alias("href"), F.lit(0).alias("pos"))
    done = corpus.complete_properties(listed.unionByName(few).distinct(), d)
    return done.select("spec", "name", (F.col("href") == "listed").cast("int").alias("is_listed"), F.array_join("style_declaration", "|").alias("style_names"))


def ref_p2_linked_names(spark, sf_dir: str) -> DataFrame:
    """Members of interfaces with the one definition of their spec, kind, scope and text; several give none."""
    kind = F.when(F.col("kind") == "method", F.concat(F.lit("undefined "), "n", F.lit("()"))).otherwise(F.concat(F.lit("attribute long "), "n"))
    rows = _members(spark, sf_dir).select("spec", "scope", F.floor(F.col("dfn_no") / PART).alias("part"), F.struct("dfn_no", F.concat(kind, F.lit("; ")).alias("m")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["m"]), "")
    texts = rows.groupBy("spec", "scope", "part").agg(body.alias("body")).select("spec", F.concat(F.lit("partial interface "), "scope", F.lit(" { "), "body", F.lit("};")).alias("idl"))
    found = linked_parts(texts, _member_definitions(spark, sf_dir))
    return found.groupBy("spec", "definition", "member").agg(F.count("*").alias("n_parts"), F.count("href").alias("n_linked"), F.min("href").alias("first_href"))


def ref_p3_annotated(spark, sf_dir: str) -> DataFrame:
    """The specs that back-references lead to, found by canonical URL among the registry's URLs, those of its series and its pages."""
    b = table(spark, sf_dir, "backrefs")
    links = b.select(F.explode(F.array("ref_url", "href")).alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n_links"))
    specs = table(spark, sf_dir, "specs").select("shortname", F.col("spec_no").alias("ord"), "release_url", F.col("nightly.url").alias("nightly_url"), F.col("series.current_specification").alias("current"), F.array(F.col("url")).alias("series_urls"))
    pages = table(spark, sf_dir, "headings").select("shortname", F.col("page_url").alias("url")).where("url is not null")
    return corpus.annotate_links(links, corpus.registry_urls(specs, pages))


def ref_p4_patched(spark, sf_dir: str) -> DataFrame:
    """Definitions after rules that drop one term of a site and hide another site's."""
    rules = spark.createDataFrame([("specs.orrery.example", None, "private"), ("living.wharf.example", "Plamfun", "drop")], "url_part string, term string, action string")
    d = table(spark, sf_dir, "dfns").select("dfn_no", F.col("page_url").alias("url"), "linking_text", "dfn_for", "access_mode").distinct()
    return corpus.patch_definitions(d, rules).select("dfn_no", "access_mode")


def ref_s2_requests(spark, sf_dir: str) -> DataFrame:
    """Referring specs and series names resolved to registry rows."""
    specs = table(spark, sf_dir, "specs").select("shortname", "url", F.col("series.shortname").alias("series"), F.col("series.current_specification").alias("current"))
    asked = table(spark, sf_dir, "backrefs").select(F.col("ref_shortname").alias("request")).unionByName(specs.select(F.col("series").alias("request"))).unionByName(table(spark, sf_dir, "ids").select(F.col("page_url").alias("request")))
    requests = asked.where("request is not null").distinct().withColumn("pos", F.lit(0))
    found = corpus.resolve_requests(requests, specs)
    return found.select("request", "shortname", F.coalesce("error", F.lit("")).alias("error"))


def ref_s13_versions(spark, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "specs").select("shortname", "url", "release_url", F.col("nightly.url").alias("nightly_url"))
    return corpus.known_versions(specs).select("shortname", F.array_join("versions", " ").alias("versions"))


def ref_s14_plan(spark, sf_dir: str) -> DataFrame:
    """When each page may be requested at the earliest, one at a time an origin."""
    urls = table(spark, sf_dir, "ids").select(F.col("page_url").alias("url")).where("url is not null").distinct()
    return corpus.request_plan(urls, text.origin(F.col("url"))).select("url", "turn", "start_ms")


def ref_s14_origins(spark, sf_dir: str) -> DataFrame:
    """Pages per origin."""
    return table(spark, sf_dir, "ids").select(text.origin(F.col("page_url")).alias("page_origin"), "page_url").distinct().groupBy("page_origin").agg(F.count("*").alias("n_pages"))


def ref_f4_canonical(spark, sf_dir: str) -> DataFrame:
    """Canonical URLs of all hrefs, with how many hrefs share one."""
    return table(spark, sf_dir, "ids").select("href").distinct().groupBy(text.canonical_url(F.col("href")).alias("url")).agg(F.count("*").alias("n_hrefs"))


def ref_f3_names(spark, sf_dir: str) -> DataFrame:
    """Script names of the ids of definitions, taken as property names."""
    return table(spark, sf_dir, "dfns").select(F.col("id").alias("name")).where("name is not null").distinct().select("name", F.array_join(text.css_idl_names(F.col("name")), "|").alias("style_names"))


def ref_u8_violations(spark, sf_dir: str) -> DataFrame:
    """Definitions, headings (every seventh number spoiled) and registry rows that break a constraint."""
    d = table(spark, sf_dir, "dfns").select(F.col("dfn_no").alias("row_no"), "id", "href", F.col("linking_text").alias("linkingText"), F.col("dfn_type").alias("type"), F.col("access_mode").alias("access"), "heading").distinct()
    h = table(spark, sf_dir, "headings").select(F.col("heading_no").alias("row_no"), "id", "href", "title", F.col("level_no").alias("level"), F.when(F.col("heading_no") % 7 == 0, F.concat("number_txt", F.lit("."))).otherwise(F.col("number_txt")).alias("number")).distinct()
    s = table(spark, sf_dir, "specs").select(F.col("spec_no").cast("long").alias("row_no"), F.when(F.col("spec_no") % 10 == 0, F.concat("shortname", F.lit("!"))).otherwise(F.col("shortname")).alias("shortname"), "url")
    parts = [reports.violations(rows, ["row_no"], reports.constraints(name)).select(F.lit(name).alias("extract"), "row_no", "broken") for name, rows in (("dfns", d), ("headings", h), ("specs", s))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ref_u9_reports(spark, sf_dir: str) -> DataFrame:
    """A report per spec of what it defines."""
    h = table(spark, sf_dir, "headings").select("shortname", "heading_no").distinct().groupBy("shortname").agg(F.collect_list("heading_no").alias("headings"))
    d = table(spark, sf_dir, "dfns").select("shortname", "dfn_no", "linking_text", "access_mode").distinct().groupBy("shortname").agg(F.collect_list(F.struct(F.col("access_mode").alias("access"), F.coalesce("linking_text", F.array().cast("array<string>")).alias("linkingText"))).alias("dfns"))
    specs = table(spark, sf_dir, "specs").select("shortname", F.lit(None).cast("string").alias("title"), "url").distinct()
    empty = {c: F.array().cast("array<string>") for c in ("ids", "elements", "events")}
    rows = specs.join(h, "shortname", "left").join(d, "shortname", "left").withColumns(empty).withColumn("generator", F.lit(None).cast("string")).withColumn("idl", F.lit(None).cast("string"))
    return reports.spec_reports(rows).select("shortname", "report")


def ref_u11_missing_report(spark, sf_dir: str) -> DataFrame:
    """What is missing in each spec, with the numbers of errors and warnings."""
    return reports.missing_report(ref_c7_missing(spark, sf_dir)).select("spec", "report")


def _extracts(spark, sf_dir: str) -> DataFrame:
    """Specs with interface, data and style definitions of their own."""
    s = table(spark, sf_dir, "specs").select("shortname", F.coalesce(text.normalize_text(F.col("title")), F.lit("")).alias("title"), "url", "spec_no").distinct()
    k = F.col("spec_no").cast("string")
    css = F.concat(F.lit('{"properties":[{"name":"p'), k, F.lit('","parsedValue":{"a":1},"value":"x"}],"atrules":[],"selectors":[],"values":[],"warnings":[]}'))
    none = F.lit('{"properties":[],"atrules":[],"selectors":[],"values":[],"warnings":[]}')
    modules = F.array(F.struct(F.when(F.col("spec_no") % 2 == 0, "").otherwise("m").alias("name"), F.concat(F.lit("a = "), k).alias("cddl")))
    return s.withColumns({"idl": F.when(F.col("spec_no") % 3 > 0, F.concat(F.lit("interface I"), k, F.lit(" {};"))).otherwise(""), "css": F.when(F.col("spec_no") % 4 == 0, none).otherwise(css), "cddl": F.when(F.col("spec_no") % 5 > 0, modules), "error": F.when(F.col("spec_no") % 7 == 0, "boom")})


def ref_k1_index(spark, sf_dir: str) -> DataFrame:
    rows = sinks.crawl_index(_extracts(spark, sf_dir).select("shortname", "error"), "Crawl")
    return rows.select("type", "title", "stats.crawled", "stats.errors", F.array_join(F.transform("results", lambda r: r["shortname"]), " ").alias("specs"))


def ref_k2_extracts(spark, sf_dir: str) -> DataFrame:
    """The documents of the data definitions, and the specs with the files' names in their place."""
    e = _extracts(spark, sf_dir)
    files = sinks.with_files(e, "cddl").select("shortname", F.col("cddl").alias("file"))
    return files.join(sinks.extract_documents(e, "cddl"), "file", "left").select("shortname", "file", "body")


def ref_k3_idl_files(spark, sf_dir: str) -> DataFrame:
    return sinks.idl_documents(_extracts(spark, sf_dir))


def ref_k4_css_files(spark, sf_dir: str) -> DataFrame:
    return sinks.css_documents(_extracts(spark, sf_dir).withColumn("title", F.lit("T")))


def ref_k5_cddl_files(spark, sf_dir: str) -> DataFrame:
    return sinks.cddl_documents(_extracts(spark, sf_dir))


def ref_k7_post_files(spark, sf_dir: str) -> DataFrame:
    """The result of a step for the whole crawl and of one for each spec."""
    e = _extracts(spark, sf_dir)
    whole = e.agg(F.struct(F.count("*").alias("n")).alias("totals"))
    each = e.select("shortname", F.lit("T").alias("title"), "url", F.when(F.col("spec_no") % 2 == 0, F.array("spec_no")).alias("numbers"))
    return sinks.post_documents(whole, "totals", False).unionByName(sinks.post_documents(each, "numbers", True))


def ref_k8_name_files(spark, sf_dir: str) -> DataFrame:
    """Definitions of every name below their sources, all that is known of it, and the index of names."""
    rows = table(spark, sf_dir, "idlnames").select("idl_no", F.trim("idl_name").alias("name"), F.col("idl_type").alias("type"), F.col("shortname").alias("spec"), "fragment").distinct()
    defined = rows.select("name", F.col("spec").alias("spec_title"), F.lit("u").alias("spec_url"), F.lit(False).alias("partial"), F.col("idl_no").alias("ord"), "fragment")
    more = rows.where("idl_no % 2 = 0").select("name", F.lit("more").alias("spec_title"), F.lit("v").alias("spec_url"), F.lit(True).alias("partial"), F.col("idl_no").alias("ord"), F.concat(F.lit("partial "), "fragment").alias("fragment"))
    known = rows.select("name", "type")
    return sinks.name_documents(defined.unionByName(more)).unionByName(sinks.parsed_name_documents(known)).unionByName(sinks.name_index(known))


def ref_k9_backref_files(spark, sf_dir: str) -> DataFrame:
    """Specs of the index with the document of who refers to them."""
    found = ref_c5_backrefs(spark, sf_dir).select("owner", "href", F.split("referrers", ",").alias("referrers"))
    specs = table(spark, sf_dir, "specs").select("shortname", F.lit("T").alias("title"), "url").distinct()
    documents = sinks.backref_documents(found, specs)
    index = sinks.rewritten_index(specs.select("shortname", F.lit("old").alias("backrefs")), documents, "backrefs")
    return index.join(documents.withColumnRenamed("file", "backrefs"), "backrefs", "left").select("shortname", F.col("backrefs").alias("file"), F.length("body").isNotNull().cast("int").alias("is_written"))


def ref_k10_console(spark, sf_dir: str) -> DataFrame:
    """Reports as one part each, and one extract of all specs as rows of JSON."""
    e = _extracts(spark, sf_dir)
    parts = sinks.markdown(e.select(F.col("shortname").alias("title"), F.col("idl").alias("report")))
    return parts.select("part").unionByName(sinks.json_rows(e.select("shortname", "error")).select(F.col("json").alias("part")))


def ref_s1_registry(spark, sf_dir: str) -> DataFrame:
    """The registry, written as one JSON list and read back without the discontinued."""
    folder = f"{shared_folder(spark).rstrip('/')}/specstrata/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "specs").select("shortname", "url", "standing")
    rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("shortname", "url", "standing")))), ","), F.lit("]"))).write.text(folder)
    return crawl.read_registry(spark, folder).select("shortname", "standing")


def ref_s5_changed(spark, sf_dir: str) -> DataFrame:
    """Pages of each snapshot's specs that changed since stored: by time, where none is stored by tag."""
    p = table(spark, sf_dir, "dfn_snapshots").where("crawled is not null").groupBy("crawled").agg(F.max("last_modified").alias("now"), F.min("last_modified").alias("then"), F.count("*").alias("n"))
    k = F.length("crawled") % 3
    served = p.select(F.col("crawled").alias("url"), F.col("now").alias("last_modified"), F.lit("tag").alias("etag"))
    stored = p.select(F.col("crawled").alias("url"), F.when(k > 0, F.col("then")).alias("last_modified"), F.when(k == 0, "tag").alias("etag"), F.when(F.col("n") % 5 == 0, "boom").alias("error"))
    return corpus.changed_since(served, stored).select("url")


def ref_s6_resources(spark, sf_dir: str) -> DataFrame:
    """Anchors taken as resources: those worth reading, a PDF being empty."""
    endings = F.element_at(F.array(*map(F.lit, ("/page", "/a.png", "/b.css?x=1", "/c.pdf", "/d.woff2#y"))), (F.col("id_no") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "ids").select("id_no", F.concat(F.regexp_replace("page_url", "[?#].*$", ""), endings).alias("url"), F.lit("<p>").alias("html")).where("url is not null").distinct()
    return crawl.relevant(rows).select("id_no", "url", F.col("html").alias("content"))


def ref_s7_pages(spark, sf_dir: str) -> DataFrame:
    """The pages of a spec as one document: ids keep the URL of their page."""
    p = table(spark, sf_dir, "headings").select("shortname", "page_url").where("page_url is not null").distinct().withColumn("k", F.expr("row_number() over (partition by shortname order by page_url) - 1"))
    united = crawl.unite_pages(p.select(F.col("shortname").alias("url"), "page_url", F.col("k").alias("ord"), F.concat(F.lit("<p id=n"), F.col("k").cast("string"), F.lit("></p>")).alias("html")))
    documents = united.select("url", F.lit(None).cast("string").alias("shortname"), F.lit(None).cast("string").alias("title"), "html")
    return extract(documents, ["ids"]).select(F.col("url").alias("shortname"), F.explode("ids").alias("href"))


def ref_s8_listings(spark, sf_dir: str) -> DataFrame:
    """Documents that are only listings of a folder, as errors."""
    s = table(spark, sf_dir, "specs").select("url", "shortname", F.lit(None).cast("string").alias("title"), F.concat(F.lit("<title>T</title><h1>"), F.when(F.col("spec_no") % 3 == 0, "Index of /").otherwise("About "), "shortname", F.lit("</h1>")).alias("html")).distinct()
    return extract(s, ["title"]).select("shortname", F.col("error").isNotNull().cast("int").alias("failed"), F.col("title").alias("found_title"))


def ref_s10_expanded(spark, sf_dir: str) -> DataFrame:
    """Interface, data and style definitions written to files and read back in place of the files' names."""
    folder = f"{qualified(spark, shared_folder(spark)).rstrip('/')}/specstrata/{uuid.uuid4().hex}"
    e = _extracts(spark, sf_dir).withColumn("url", F.regexp_replace(F.coalesce("url", F.lit("")), "\\s+", " "))  # headers end at a blank line
    for documents in (sinks.idl_documents(e), sinks.css_documents(e), sinks.extract_documents(e, "cddl")):
        sinks.write_documents(documents, folder)
    linked = sinks.with_files(sinks.with_files(e.withColumn("css", F.when(F.col("spec_no") % 4 > 0, F.col("css"))), "idl", ".idl"), "cddl")
    linked = sinks.with_files(linked, "css").select("shortname", "idl", "cddl", "css")
    for column in ("idl", "cddl", "css"):
        linked = crawl.expand_extract(linked, folder, column)
    return linked


def ref_s11_fallback(spark, sf_dir: str) -> DataFrame:
    """Failed specs with the stored extract of their URL; of every second there is none."""
    e = _extracts(spark, sf_dir)
    stored = e.where("spec_no % 2 = 0").select("url", F.concat(F.lit("old "), "shortname").alias("idl"))
    return corpus.with_fallback(e.select("shortname", "url", "error", "idl"), stored, ["idl"]).select("shortname", "error", "idl")


def ref_s12_editions(spark, sf_dir: str) -> DataFrame:
    """The URL to crawl of each spec, as published and as nightly edition."""
    specs = table(spark, sf_dir, "specs").select("shortname", "release_url", F.col("nightly.url").alias("nightly_url"))
    both = [corpus.pick_edition(specs, flag).select("shortname", F.lit(int(flag)).alias("published"), "crawl_url") for flag in (True, False)]
    return both[0].unionByName(both[1])


def ref_f_texts(spark, sf_dir: str) -> DataFrame:
    """Functions on texts, each on texts of the tables: which one, the row, its result."""
    d = table(spark, sf_dir, "dfns").select("dfn_no", "id", F.element_at("linking_text", 1).alias("t"), "dfn_for").distinct()
    h = table(spark, sf_dir, "headings").select("heading_no", "title", "number_txt").distinct()
    t, k = F.col("t"), F.col("dfn_no").cast("string")
    of_dfn = {
        "css_value": text.normalize_css_value(F.concat(F.lit(" \u2212"), t, F.lit("\u00a0\t x "))), "fragment": text.encode_fragment(F.concat(F.col("id"), F.lit(" (a)+'~!*"))), "block": text.trim_block(F.concat(F.lit("\n  a {  \r\n      "), t, F.lit("\n\n    }\n"))),
        "split": F.array_join(text.split_for(F.concat(t, F.lit("(a, b) ,  "), k)), "|"), "label": text.label_key(F.concat(F.lit(" New  value: ").substr(F.lit(1), F.when(F.col("dfn_no") % 2 == 0, 20).otherwise(0)), F.when(F.col("dfn_no") % 2 == 0, F.lit("")).otherwise(F.lit("Applies to:")))),
        "module": text.camel_module(F.concat(F.lit("src/get-"), t, F.lit("-name.mjs"))), "shortname": text.synthetic_shortname(F.concat(F.lit("https://a.b/"), t)), "unwrap": text.unwrap_name(F.concat(F.when(F.col("dfn_no") % 2 == 0, "<").otherwise(""), t, F.lit(">"))),
        "modern": text.modern_idl(F.concat(F.lit("attribute "), t, F.lit("[] x; serializer = { a };"))), "header": text.strip_header(F.concat(F.lit("// a\n// b\n\n"), t, F.lit("\n"))), "page": text.single_page_form(F.concat(F.lit("https://tc39.es/ecma262/multipage/a.html#"), k)),
    }
    rows = d.where("t rlike '^[a-z]+$'").select("dfn_no", F.explode(F.create_map(*[x for n, c in of_dfn.items() for x in (F.lit(n), c)])).alias("function", "result"))
    title = F.concat(F.when(F.col("heading_no") % 3 == 0, "Appendix ").otherwise(""), "number_txt", F.lit(".  "), "title")
    number = h.where("number_txt rlike '^[0-9.]+$' and title rlike '^[A-Z][a-z]'").select("heading_no", F.explode(F.create_map(F.lit("number"), text.heading_number(title), F.lit("title"), text.heading_title(title))).alias("function", "result"))
    return rows.select(F.col("dfn_no").alias("row_no"), "function", "result").unionByName(number.select(F.col("heading_no").alias("row_no"), "function", "result"))


def ref_f19_order(spark, sf_dir: str) -> DataFrame:
    """Texts of definitions in the order of readers: what comes after each."""
    t = table(spark, sf_dir, "dfns").select(F.col("dfn_type").alias("k"), F.explode("linking_text").alias("t")).where("t rlike '^[A-Za-z]+$'").distinct()
    mixed = t.unionByName(t.select("k", F.upper("t").alias("t"))).distinct()
    return mixed.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(text.locale_key(F.lower("t")).alias("a"), F.col("t").alias("t")))), lambda x: x["t"].cast("string")), " ").alias("ordered")).select(F.col("k").alias("dfn_type"), F.md5("ordered").alias("digest"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("ref_")}

_LEVELS = """
WITH RECURSIVE l AS (SELECT shortname, series.shortname AS series, series.current_specification AS cur, series_composition AS comp, standing, release_url,
  lag(shortname) OVER w AS prev, lead(shortname) OVER w AS nxt FROM specs
  WINDOW w AS (PARTITION BY series.shortname ORDER BY try_cast(series_version AS DOUBLE) NULLS FIRST, series_version NULLS FIRST, shortname)),
back AS (SELECT shortname AS start, shortname AS node, cur AS goal, 0 AS hops FROM l UNION ALL SELECT b.start, l.prev, b.goal, b.hops + 1 FROM back b JOIN l ON l.shortname = b.node WHERE l.prev IS NOT NULL AND b.node <> b.goal),
ahead AS (SELECT shortname AS start, shortname AS node, 0 AS hops FROM l UNION ALL SELECT a.start, l.nxt, a.hops + 1 FROM ahead a JOIN l ON l.shortname = a.node WHERE l.nxt IS NOT NULL),
ok AS (SELECT shortname FROM l WHERE comp = 'full' AND {passes}),
j AS (SELECT l.*, coalesce({passes}, false) AND CASE WHEN comp = 'delta' THEN NOT EXISTS (SELECT 1 FROM back b JOIN ok ON ok.shortname = b.node WHERE b.start = l.shortname AND b.hops > 0)
  ELSE NOT EXISTS (SELECT 1 FROM ahead a JOIN ok ON ok.shortname = a.node WHERE a.start = l.shortname AND a.hops > 0) AND EXISTS (SELECT 1 FROM back b WHERE b.start = l.shortname AND b.node = l.cur) END AS is_latest FROM l)
"""

_CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(split_part(regexp_replace({c}, '^http:', 'https:'), '#', 1), 'index.html', ''), 'Overview.html', ''), 'cover.html', ''), 'spec.whatwg.org/.*', 'spec.whatwg.org/'), 'w3.org/TR/(([^/]+/)+)[^/]+\.[^/]+$', 'w3.org/TR/\1'), 'w3.org/TR/([^/]+)$', 'w3.org/TR/\1/'), 'w3c.github.io/([^/]+)$', 'w3c.github.io/\1/')"
_CAMEL = "(split_part({c}, '-', 1) || coalesce(list_aggregate(list_transform(string_split({c}, '-')[2:], lambda x: upper(left(x, 1)) || substr(x, 2)), 'string_agg', ''), ''))"
_STYLE = f"{{c}} || CASE WHEN {_CAMEL} <> {{c}} THEN '|' || {_CAMEL} ELSE '' END"

ORACLE = {
    "ref_c1_latest_levels": _LEVELS.format(passes="(standing <> 'discontinued')") + "SELECT shortname, series, comp AS composition, is_latest FROM j",
    "ref_k6_series_files": _LEVELS.format(passes="(release_url IS NOT NULL)") + "SELECT shortname, CASE WHEN comp = 'delta' THEN shortname ELSE coalesce(series, shortname) END AS file_stem FROM j WHERE release_url IS NOT NULL AND (is_latest OR comp = 'delta') AND comp <> 'fork'",
    "ref_c4_names": "WITH r AS (SELECT DISTINCT idl_no, trim(idl_name) AS name, idl_type, shortname, includes FROM idlnames), m AS (SELECT DISTINCT name AS target, trim(unnest(includes)) AS mixin FROM r) SELECT name, idl_type AS type, shortname AS defined_in, CAST((SELECT count(*) FROM m JOIN r n ON n.name = m.mixin WHERE m.target = r.name AND m.mixin <> '') AS INTEGER) AS n_includes FROM r",
    "ref_c6_merge": "SELECT shortname, id, href, dfn_type, 'new' AS origin FROM core_dfns UNION ALL SELECT DISTINCT shortname, id, href, dfn_type, 'old' FROM dfns WHERE NOT EXISTS (SELECT 1 FROM core_dfns c WHERE c.href = dfns.href OR c.id = dfns.id)",
    "ref_c8_stats": "SELECT count(*) AS crawled, count(*) FILTER (payload IS NULL OR NOT json_valid(payload)) AS errors FROM (SELECT DISTINCT rec_id, payload FROM crawl_results)",
    "ref_p3_annotated": f"""
        WITH u AS (SELECT shortname, spec_no AS ord, unnest([release_url, nightly.url, CASE WHEN series.current_specification = shortname THEN url END]) AS u FROM specs
          UNION ALL SELECT DISTINCT s.shortname, s.spec_no, h.page_url FROM headings h JOIN specs s USING (shortname)),
        c AS (SELECT u AS c, arg_min(shortname, struct_pack(o := ord, s := shortname)) AS spec_shortname FROM u WHERE u IS NOT NULL GROUP BY 1)
        SELECT l.url, l.n_links, c.spec_shortname FROM (SELECT url, count(*) AS n_links FROM (SELECT ref_url AS url FROM backrefs UNION ALL SELECT href FROM backrefs) WHERE url IS NOT NULL GROUP BY ALL) l LEFT JOIN c ON c.c = {_CANON.format(c='l.url')}""",
    "ref_p4_patched": """SELECT DISTINCT dfn_no, CASE WHEN contains(page_url, 'specs.orrery.example') THEN 'private' ELSE access_mode END AS access_mode FROM dfns
        WHERE NOT (contains(coalesce(page_url, ''), 'living.wharf.example') AND list_contains(list_concat(coalesce(linking_text, CAST([] AS VARCHAR[])), coalesce(dfn_for, CAST([] AS VARCHAR[]))), 'Plamfun'))""",
    "ref_s2_requests": """
        WITH q AS (SELECT ref_shortname AS request FROM backrefs UNION SELECT series.shortname FROM specs UNION SELECT page_url FROM ids),
        e AS (SELECT request, any_value(shortname) AS s FROM (SELECT unnest([url, shortname]) AS request, shortname FROM specs) GROUP BY 1),
        r AS (SELECT series.shortname AS request, any_value(shortname) AS s FROM specs WHERE series.current_specification = shortname GROUP BY 1)
        SELECT q.request, coalesce(e.s, r.s, CASE WHEN regexp_matches(q.request, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]') OR ends_with(q.request, '.html') THEN replace(replace(replace(replace(q.request, ':', ''), '/', ''), '\\', ''), '.', '') END) AS shortname,
          CASE WHEN e.s IS NULL AND r.s IS NULL AND NOT (regexp_matches(q.request, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]') OR ends_with(q.request, '.html')) THEN 'no document is known as ' || q.request ELSE '' END AS error
        FROM q LEFT JOIN e USING (request) LEFT JOIN r USING (request) WHERE q.request IS NOT NULL""",
    "ref_s13_versions": "SELECT shortname, url || CASE WHEN release_url IS NOT NULL AND release_url <> url THEN ' ' || release_url ELSE '' END || CASE WHEN nightly.url IS NOT NULL AND nightly.url <> url AND nightly.url IS DISTINCT FROM release_url THEN ' ' || nightly.url ELSE '' END AS versions FROM specs",
    "ref_s14_origins": "SELECT CASE WHEN ends_with(o, '.github.io') THEN 'https://github.io' WHEN ends_with(o, '.whatwg.org') THEN 'https://whatwg.org' ELSE o END AS page_origin, count(*) AS n_pages FROM (SELECT DISTINCT page_url, lower(regexp_extract(page_url, '^[^:]+://[^/?#]*')) AS o FROM ids) GROUP BY ALL",
    "ref_f4_canonical": f"SELECT {_CANON.format(c='href')} AS url, count(*) AS n_hrefs FROM (SELECT DISTINCT href FROM ids) GROUP BY ALL",
    "ref_f3_names": f"SELECT DISTINCT id AS name, {_STYLE.format(c='id')} || CASE WHEN starts_with(id, '-webkit-') THEN '|' || {_CAMEL.format(c='substr(id, 2)')} ELSE '' END AS style_names FROM dfns WHERE id IS NOT NULL",
}

_ONE = "CASE WHEN starts_with({h}, 'https://tr.quillmark.example/') THEN 'https://html.spec.whatwg.org/' || CASE WHEN {m} THEN 'multipage/{p}.html' ELSE '' END || '#' || regexp_extract({h}, '[^#]*$') ELSE {h} END"
_SINGLE = "regexp_replace({c}, '^(https://html[.]spec[.]whatwg[.]org)/multipage/[^#]+#', '\\1/#')"
_C5 = f"""
        WITH t0 AS (SELECT {plain('href')} AS h, shortname AS owner, CAST(dfn_no AS BIGINT) AS ord, dfn_type FROM dfns WHERE href IS NOT NULL UNION ALL SELECT {plain('href')}, shortname, -1 - core_no, dfn_type FROM core_dfns),
        t AS (SELECT DISTINCT {_ONE.format(h='h', m='ord % 5 = 0', p='terms')} AS href, owner, ord, dfn_type FROM t0),
        f AS (SELECT DISTINCT unnest([href, {_SINGLE.format(c='href')}]) AS form, * FROM t),
        x AS (SELECT form, arg_max(owner, struct_pack(o := ord, w := form = href)) AS owner, arg_max(href, struct_pack(o := ord, w := form = href)) AS href FROM f GROUP BY form),
        n AS (SELECT owner, href, arg_min(dfn_type, ord) AS dfn_type FROM t GROUP BY ALL),
        l AS (SELECT h, r, min(pos) AS pos, min(u) AS u FROM (SELECT {_ONE.format(h='b.h', m='backref_id % 2 = 0', p='links')} AS h, r, backref_id AS pos, u FROM (SELECT {plain('href')} AS h, ref_shortname AS r, backref_id, ref_url AS u FROM backrefs WHERE href IS NOT NULL AND ref_shortname IS NOT NULL) b) GROUP BY h, r),
        g AS (SELECT coalesce(x.owner, y.owner) AS owner, coalesce(x.href, y.href) AS href, r, min(pos) AS pos, min(u) AS u FROM l LEFT JOIN x ON x.form = l.h LEFT JOIN x y ON y.form = {_SINGLE.format(c='l.h')} AND {_SINGLE.format(c='l.h')} <> l.h WHERE coalesce(x.owner, y.owner) IS NOT NULL GROUP BY 1, 2, 3),
        k AS (SELECT g.owner, g.href, n.dfn_type, string_agg(r, ',' ORDER BY pos) AS referrers, CAST(count(u) AS INTEGER) AS n_urls FROM g JOIN n ON n.owner = g.owner AND n.href = g.href WHERE r <> g.owner GROUP BY ALL)
"""
_M = """(SELECT DISTINCT * FROM (SELECT dfn_no, shortname AS spec, unnest(dfn_for) AS scope, lt[1] AS n, dfn_type AS kind, href FROM (SELECT dfn_no, shortname, dfn_for, linking_text AS lt, dfn_type, @@ AS href FROM dfns WHERE dfn_type IN ('attribute', 'method'))) WHERE regexp_matches(n, '^[A-Za-z][A-Za-z0-9]*$') AND regexp_matches(scope, '^[A-Za-z][A-Za-z0-9]*$'))""".replace("@@", plain("href"))
_MD = """(SELECT DISTINCT shortname AS spec, unnest(list_transform(linking_text, lambda x: x || CASE WHEN dfn_type = 'method' THEN '()' ELSE '' END)) AS term, dfn_type AS type, coalesce(dfn_for, CAST([] AS VARCHAR[])) AS scopes, @@ AS href FROM dfns WHERE dfn_type IN ('attribute', 'method'))""".replace("@@", plain("href"))
_PLAINER = "regexp_replace(regexp_replace({c}, '!overload-[0-9]+', ''), '\\(.*\\)$', '()')"


def _missing(wanted: str, have: str, keys: str) -> str:
    """SQL of the closest match of each row of ``wanted`` (keys, term, type, scope) in ``have`` (keys, term, type, scopes)."""
    level = "CASE WHEN h.p IS NULL THEN 4 WHEN w.scope IS NOT NULL AND NOT list_contains(h.scopes, w.scope) THEN 3 WHEN w.type <> h.type THEN 2 WHEN w.term <> h.term THEN 1 ELSE 0 END"
    own = "".join(f"w.{k}, " for k in keys.split())
    return f"""WITH w AS (SELECT *, {_PLAINER.format(c='term')} AS p FROM ({wanted})), h AS (SELECT *, {_PLAINER.format(c='term')} AS p FROM ({have})),
        b AS (SELECT {own}w.term, w.type, w.scope, min({level}) AS k FROM w LEFT JOIN h ON h.p = w.p{"".join(f" AND h.{k} = w.{k}" for k in keys.split())} GROUP BY ALL)
        SELECT {"".join(k + ", " for k in keys.split())}term, type, scope, ['exact', 'other arguments', 'other type', 'other scope', 'missing'][k + 1] AS match FROM b"""


_C7_WANTED = f"""SELECT DISTINCT spec, CASE WHEN call THEN n || CASE WHEN k = 4 AND kind = 'method' THEN '(a)' ELSE '()' END ELSE n END AS term, CASE WHEN call THEN 'method' ELSE 'attribute' END AS type, scope
        FROM (SELECT spec, dfn_no % 5 AS k, kind, CASE WHEN dfn_no % 5 = 2 THEN 'X' ELSE '' END || scope AS scope, n || CASE WHEN dfn_no % 5 = 3 THEN 'x' ELSE '' END AS n, NOT (kind = 'method' AND dfn_no % 5 = 1 OR kind <> 'method' AND dfn_no % 5 <> 1) AS call FROM {_M})"""
_C7 = _missing(_C7_WANTED, f"SELECT DISTINCT spec, term, type, scopes FROM {_MD}", "spec")
_NM = "(SELECT DISTINCT trim(idl_name) AS name, trim(inheritance) AS up, includes FROM idlnames)"
_GRAPH = f"""WITH RECURSIVE e AS (SELECT name AS v, up AS p FROM {_NM} UNION SELECT name, trim(unnest(includes)) FROM {_NM}), k AS (SELECT DISTINCT e.v, e.p FROM e WHERE p IN (SELECT name FROM {_NM})),
        up AS (SELECT v, p FROM k UNION SELECT up.v, k.p FROM up JOIN k ON k.v = up.p), g AS (SELECT v AS name, p AS related FROM up UNION SELECT name, name FROM {_NM})"""
_EX = "(SELECT DISTINCT idl_no, trim(idl_name) AS n, CASE WHEN regexp_matches(trim(inheritance), '^[A-Za-z][A-Za-z0-9]*$') THEN trim(inheritance) END AS up FROM idlnames WHERE regexp_matches(trim(idl_name), '^[A-Za-z][A-Za-z0-9]*$'))"
_SX = "(SELECT DISTINCT shortname, coalesce(trim(regexp_replace(title, '[\\s\u00a0]+', ' ', 'g')), '') AS title, url, spec_no FROM specs)"
_HEAD = "'{m} Extracted, do not edit' || chr(10) || '{m} Source: ' || title || ' (' || url || ')' || chr(10) || chr(10)"
_CSS = "'\"properties\":[{{\"name\":\"p' || spec_no || '\",{x}\"value\":\"x\"}}],\"atrules\":[],\"selectors\":[],\"values\":[],\"warnings\":[]}}'"
_W3 = "CASE WHEN dfn_no % 2 = 0 THEN {a} ELSE {b} END"
_TXT = "(SELECT DISTINCT dfn_no, id, linking_text[1] AS t FROM dfns WHERE regexp_matches(linking_text[1], '^[a-z]+$'))"
_NUM = "(SELECT DISTINCT heading_no, title, number_txt FROM headings WHERE regexp_matches(number_txt, '^[0-9.]+$') AND regexp_matches(title, '^[A-Z][a-z]'))"

ORACLE |= {
    "ref_c2_features": f"""
        WITH l AS (SELECT DISTINCT shortname, series.shortname AS series, coalesce(series_version, '') AS v FROM specs WHERE shortname IS NOT NULL),
        d AS (SELECT DISTINCT dfn_no, shortname, {plain('href')} AS href, unnest(list_distinct(linking_text)) AS name, dfn_type, CASE WHEN len(dfn_for) > 0 THEN list_distinct(dfn_for) ELSE [NULL] END AS df FROM dfns),
        r AS (SELECT CASE WHEN dfn_type = 'property' THEN 'properties' ELSE 'types' END AS category, name, unnest(df) AS scope, href, CASE WHEN dfn_no % 3 > 0 THEN 'v' || dfn_no % 5 END AS syntax, CASE WHEN dfn_no % 6 = 0 THEN 'n' || dfn_no % 7 END AS nv, series, v, shortname AS spec, dfn_no AS ord FROM d JOIN l USING (shortname) WHERE name IS NOT NULL),
        k AS (SELECT *, CASE WHEN href IS NOT NULL AND syntax IS NOT NULL THEN 0 WHEN href IS NOT NULL AND nv IS NULL THEN 1 END AS rk FROM r),
        b AS (SELECT *, min(rk) OVER (PARTITION BY category, name, scope) AS best FROM k),
        g AS (SELECT category, name, scope, list(struct_pack(ord, href, syntax, series, v, spec) ORDER BY ord, href, syntax) FILTER (rk = best) AS bases, coalesce(list(struct_pack(ord, nv, spec) ORDER BY ord, nv) FILTER (nv IS NOT NULL), []) AS news FROM b WHERE best IS NOT NULL GROUP BY ALL),
        m AS (SELECT *, list_reduce(bases, lambda x, y: CASE WHEN x.series IS DISTINCT FROM y.series OR x.v < y.v THEN y ELSE x END) AS w FROM g),
        n AS (SELECT category, name, scope, w.href AS href, CASE WHEN category = 'properties' AND len(news) > 0 THEN regexp_replace(array_to_string(list_concat([coalesce(w.syntax, '')], (SELECT list(q ORDER BY o) FROM (SELECT q, min(o) AS o FROM (SELECT unnest(news).nv AS q, unnest(range(len(news))) AS o) GROUP BY q))), ' | '), '^ [|] ', '') ELSE w.syntax END AS syntax,
          CASE WHEN category = 'properties' THEN list_distinct(list_transform(news, lambda x: x.spec)) ELSE list_distinct(list_transform(list_filter(bases, lambda x: x.spec <> w.spec), lambda x: x.spec)) END AS ext FROM m),
        f AS (SELECT n.* FROM n LEFT JOIN n t ON t.category = n.category AND t.name = n.name AND t.scope IS NULL WHERE n.scope IS NULL OR t.name IS NULL OR n.syntax IS NOT NULL AND n.syntax IS DISTINCT FROM t.syntax)
        SELECT category, name, href, coalesce(array_to_string(list_sort(list_distinct(list(scope) FILTER (scope IS NOT NULL))), '|'), '') AS scopes, arg_min(syntax, coalesce(scope, '')) AS syntax, CAST(len(list_distinct(flatten(list(ext)))) AS INTEGER) AS n_extended FROM f GROUP BY category, name, href""",
    "ref_c3_mixins": f"SELECT DISTINCT m AS mixin, name AS interface FROM (SELECT name, trim(unnest(includes)) AS m FROM {_NM}) WHERE regexp_matches(m, '^[A-Za-z][A-Za-z0-9]*$') AND regexp_matches(name, '^[A-Za-z][A-Za-z0-9]*$')",
    "ref_c4_graph": _GRAPH + "SELECT name, related FROM g",
    "ref_c4_definitions": _GRAPH + ", r AS (SELECT DISTINCT trim(idl_name) AS name, shortname AS spec, '#' || idl_no AS h FROM idlnames) SELECT g.name, r.spec, string_agg(DISTINCT r.h, ' ' ORDER BY r.h) AS hrefs FROM g JOIN r ON r.name = g.related GROUP BY ALL",
    "ref_c5_backrefs": _C5 + "SELECT * FROM k",
    "ref_c7_missing": _C7,
    "ref_c7_terms": _missing(
        r"SELECT DISTINCT trim(regexp_replace(t, '\s+', ' ', 'g')) AS term, type, unnest(s) AS scope FROM (SELECT unnest(linking_text) AS t, dfn_type AS type, CASE WHEN len(dfn_for) > 0 THEN dfn_for ELSE [NULL] END AS s FROM dfn_snapshots) WHERE t IS NOT NULL",
        "SELECT DISTINCT unnest(linking_text) AS term, dfn_type AS type, coalesce(dfn_for, CAST([] AS VARCHAR[])) AS scopes FROM dfns", ""),
    "ref_c9_trees": """
        WITH RECURSIVE n AS (SELECT DISTINCT trim(idl_name) AS name, nullif(trim(inheritance), '') AS up FROM idlnames),
        w AS (SELECT name, name AS root, CAST(NULL AS VARCHAR) AS child FROM n WHERE up IS NULL UNION ALL SELECT n.name, w.root, coalesce(w.child, n.name) FROM n JOIN w ON n.up = w.name)
        SELECT name, 'tree of ' || root AS tree, coalesce(child, root) AS interface, CASE WHEN child IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN child IS NULL THEN '' ELSE root END AS bubbling_path FROM w""",
    "ref_l1_reports": "SELECT DISTINCT idl_no, CASE WHEN idl_no % 9 > 0 THEN regexp_extract(fragment, '^(?:[^{]*?)(?:interface mixin|callback interface|interface|dictionary|enum|namespace|callback)\\s+(\\w+)', 1) END AS names, CAST(idl_no % 9 = 0 AND fragment IS NOT NULL AS INTEGER) AS failed FROM idlnames",
    "ref_l2_exposure": f"SELECT idl_no, k AS kind, p AS place, n AS names FROM (SELECT idl_no, n, unnest(['exposed', CASE WHEN idl_no % 2 = 0 THEN 'constructors' ELSE 'functions' END]) AS k FROM {_EX}) x, (SELECT unnest(['Window', 'W']) AS p0) y, LATERAL (SELECT CASE WHEN p0 = 'W' THEN 'W' || idl_no % 3 ELSE p0 END AS p) UNION ALL SELECT idl_no, 'globals', 'G', n FROM {_EX} WHERE idl_no % 5 = 0",
    "ref_l3_dependencies": f"SELECT idl_no, array_to_string(d, '|') AS needs, array_to_string(list_concat(list_filter(d, lambda x: x <> n), ['P', 'D']), '|') AS external FROM (SELECT idl_no, n, list_filter([up, 'T' || idl_no % 7, 'Date', 'E'], lambda x: x IS NOT NULL) AS d FROM {_EX})",
    "ref_l4_grammar": """SELECT dfn_no, CASE WHEN dfn_no % 4 = 0 THEN 'error' ELSE '{"anyOf":[{"oneOf":[{"type":"keyword","name":"' || t || '"},{"type":"array","items":{"type":"primitive","name":"length","range":["0","' || dfn_no % 10 || '"]},"minItems":1,"maxItems":' || dfn_no % 10 || '}]},{"type":"array","items":{"type":"array","items":['
        || CASE WHEN t IN ('color', 'image', 'position', 'length', 'angle', 'time', 'string', 'url', 'number', 'percentage') THEN '{"type":"primitive","name":"' ELSE '{"type":"valuespace","name":"' END || t || '"},{"type":"string","content":","},{"type":"propertyref","name":"' || t || '"}]},"separator":","}]}' END AS tree
        FROM (SELECT DISTINCT dfn_no, linking_text[1] AS t FROM dfns WHERE dfn_type IN ('property', 'value')) WHERE regexp_matches(t, '^[A-Za-z][-A-Za-z0-9]*$')""",
    "ref_p1_properties": f"""WITH d AS (SELECT DISTINCT shortname AS spec, unnest(linking_text) AS name FROM dfns WHERE dfn_type = 'property' AND NOT coalesce(informative, false)),
        l AS (SELECT shortname AS spec, unnest(linking_text) AS name FROM dfn_snapshots WHERE dfn_type = 'property' UNION SELECT shortname, unnest(linking_text) FROM dfns WHERE dfn_type = 'property' AND dfn_no % 2 = 0),
        a AS (SELECT spec, name, 1 AS is_listed FROM l WHERE name IS NOT NULL UNION ALL SELECT spec, name, 0 FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.spec = d.spec AND l.name = d.name))
        SELECT spec, name, is_listed, {_STYLE.format(c='name')} AS style_names FROM a WHERE name <> 'property-name' AND NOT starts_with(name, '--')""",
    "ref_p2_linked_names": f"""WITH p AS (SELECT *, row_number() OVER () AS pid FROM {_M}), c AS (SELECT p.pid, p.spec, p.scope, p.n, count(DISTINCT d.href) AS k, min(d.href) AS href
          FROM p LEFT JOIN {_MD} d ON d.spec = p.spec AND d.type = p.kind AND d.term = p.n || CASE WHEN p.kind = 'method' THEN '()' ELSE '' END AND list_contains(d.scopes, p.scope) GROUP BY ALL)
        SELECT spec, scope AS definition, n AS member, count(*) AS n_parts, count(*) FILTER (k = 1) AS n_linked, min(href) FILTER (k = 1) AS first_href FROM c GROUP BY ALL""",
    "ref_u8_violations": """
        WITH d AS (SELECT DISTINCT dfn_no, id, href, linking_text AS lt, dfn_type, access_mode, heading.href AS hh FROM dfns), h AS (SELECT DISTINCT heading_no, id, href, title, level_no, CASE WHEN heading_no % 7 = 0 THEN number_txt || '.' ELSE number_txt END AS n FROM headings),
        u AS (SELECT '^(https?|file|about|wss?):[^ ]*$' AS rx)
        SELECT 'dfns' AS extract, dfn_no AS row_no, unnest(list_filter([CASE WHEN id = '' THEN 'id' END, CASE WHEN NOT regexp_matches(href, rx) THEN 'href' END, CASE WHEN len(lt) = 0 OR list_contains(lt, '') THEN 'linkingText' END, CASE WHEN NOT regexp_matches(hh, rx) THEN 'heading' END, CASE WHEN access_mode NOT IN ('private', 'public') THEN 'access' END], lambda x: x IS NOT NULL)) AS broken FROM d, u
        UNION ALL SELECT 'headings', heading_no, unnest(list_filter([CASE WHEN id = '' THEN 'id' END, CASE WHEN NOT regexp_matches(href, rx) THEN 'href' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN level_no < 1 THEN 'level' END, CASE WHEN NOT regexp_matches(n, '^(\\d+|[A-Z])(\\.\\d+)*$') THEN 'number' END], lambda x: x IS NOT NULL)) FROM h, u
        UNION ALL SELECT 'specs', spec_no, unnest(list_filter([CASE WHEN spec_no % 10 = 0 THEN 'shortname' END, CASE WHEN NOT regexp_matches(url, rx) THEN 'url' END], lambda x: x IS NOT NULL)) FROM specs, u""",
    "ref_u9_reports": """WITH h AS (SELECT shortname, count(DISTINCT heading_no) AS nh FROM headings GROUP BY 1), d0 AS (SELECT DISTINCT shortname, dfn_no, linking_text AS lt, access_mode FROM dfns), d AS (SELECT shortname, count(*) AS nd FROM d0 GROUP BY 1),
        p AS (SELECT shortname, string_agg('- ' || t, chr(10) ORDER BY t) AS terms FROM (SELECT shortname, unnest(lt) AS t FROM d0 WHERE access_mode = 'public') GROUP BY 1), q AS (SELECT DISTINCT shortname FROM d0 WHERE access_mode = 'public')
        SELECT s.shortname, '# ' || s.shortname || chr(10) || chr(10) || '- URL: ' || s.url || chr(10) || chr(10) || '## Spec defines' || chr(10) || chr(10) || coalesce('- ' || nh || ' headings', '- No headings found') || chr(10) || '- No ids found' || chr(10) || coalesce('- ' || nd || ' definitions', '- No definitions found') || chr(10) || '- No elements found' || chr(10) || '- No events found'
          || CASE WHEN q.shortname IS NOT NULL THEN chr(10) || chr(10) || '<details><summary>Exported definitions</summary>' || chr(10) || chr(10) || coalesce(terms, '') || chr(10) || chr(10) || '</details>' ELSE '' END AS report
        FROM (SELECT DISTINCT shortname, url FROM specs) s LEFT JOIN h USING (shortname) LEFT JOIN d USING (shortname) LEFT JOIN p USING (shortname) LEFT JOIN q USING (shortname)""",
    "ref_u11_missing_report": f"""WITH r AS ({_C7}) SELECT spec, '<details><summary>' || spec || ': ' || count(*) FILTER (match = 'missing') || ' errors, ' || count(*) FILTER (match <> 'missing') || ' warnings</summary>' || chr(10) || chr(10) || string_agg('- ' || match || ': ' || term, chr(10) ORDER BY '- ' || match || ': ' || term) || chr(10) || chr(10) || '</details>' AS report
        FROM r WHERE match <> 'exact' GROUP BY spec""",
    "ref_k1_index": f"SELECT 'crawl' AS type, 'Crawl' AS title, count(*) AS crawled, count(*) FILTER (spec_no % 7 = 0) AS errors, string_agg(shortname, ' ' ORDER BY shortname) AS specs FROM {_SX}",
    "ref_k2_extracts": f"SELECT shortname, CASE WHEN spec_no % 5 > 0 THEN 'cddl/' || shortname || '.json' END AS file, CASE WHEN spec_no % 5 > 0 THEN '{{\"spec\":{{\"title\":' || to_json(title) || ',\"url\":' || to_json(url) || '}},\"cddl\":[{{\"name\":\"' || CASE WHEN spec_no % 2 = 0 THEN '' ELSE 'm' END || '\",\"cddl\":\"a = ' || spec_no || '\"}}]}}' END AS body FROM {_SX}",
    "ref_k3_idl_files": f"SELECT 'idl/' || shortname || '.idl' AS file, {_HEAD.format(m='//')} || 'interface I' || spec_no || ' {{}};' || chr(10) AS body FROM {_SX} WHERE spec_no % 3 > 0",
    "ref_k4_css_files": f"SELECT 'css/' || shortname || '.json' AS file, '{{\"spec\":{{\"title\":\"T\",\"url\":\"' || url || '\"}},' || {_CSS.format(x='')} || chr(10) AS body FROM {_SX} WHERE spec_no % 4 > 0",
    "ref_k5_cddl_files": f"SELECT 'cddl/' || shortname || CASE WHEN spec_no % 2 = 0 THEN '' ELSE '-m' END || '.cddl' AS file, {_HEAD.format(m=';')} || 'a = ' || spec_no || chr(10) AS body FROM {_SX} WHERE spec_no % 5 > 0",
    "ref_k7_post_files": f"SELECT 'totals.json' AS file, '{{\"n\":' || count(*) || '}}' AS body FROM {_SX} UNION ALL SELECT 'numbers/' || shortname || '.json', '{{\"spec\":{{\"title\":\"T\",\"url\":\"' || url || '\"}},\"numbers\":[' || spec_no || ']}}' FROM {_SX} WHERE spec_no % 2 = 0",
    "ref_k8_name_files": """WITH r AS (SELECT DISTINCT idl_no, trim(idl_name) AS name, idl_type AS type, shortname AS spec, fragment FROM idlnames)
        SELECT 'idlnames/' || name || '.idl' AS file, CASE WHEN fragment IS NULL THEN '' ELSE '// Source: ' || spec || ' (u)' || chr(10) || fragment || CASE WHEN idl_no % 2 = 0 THEN chr(10) || chr(10) || '// Source: more (v)' || chr(10) || 'partial ' || fragment ELSE '' END END AS body FROM r
        UNION ALL SELECT 'idlnamesparsed/' || name || '.json', '{"name":"' || name || '","type":"' || type || '"}' FROM r
        UNION ALL SELECT 'idlnames.json', '{' || string_agg('"' || name || '":{"fragment":"idlnames/' || name || '.idl","parsed":"idlnamesparsed/' || name || '.json","type":"' || type || '"}', ',' ORDER BY name) || '}' FROM r""",
    "ref_k9_backref_files": _C5 + "SELECT DISTINCT s.shortname, CASE WHEN k.owner IS NOT NULL THEN 'backrefs/' || s.shortname || '.json' END AS file, CAST(k.owner IS NOT NULL AS INTEGER) AS is_written FROM specs s LEFT JOIN (SELECT DISTINCT owner FROM k) k ON k.owner = s.shortname",
    "ref_k10_console": f"SELECT '## ' || shortname || chr(10) || CASE WHEN spec_no % 3 > 0 THEN 'interface I' || spec_no || ' {{}};' ELSE '' END || chr(10) AS part FROM {_SX} UNION ALL SELECT '{{\"shortname\":\"' || shortname || '\"' || CASE WHEN spec_no % 7 = 0 THEN ',\"error\":\"boom\"' ELSE '' END || '}}' FROM {_SX}",
    "ref_s1_registry": "SELECT shortname, standing FROM specs WHERE standing IS DISTINCT FROM 'discontinued'",
    "ref_s5_changed": "SELECT crawled AS url FROM (SELECT crawled, max(last_modified) AS now, min(last_modified) AS old, count(*) AS n FROM dfn_snapshots WHERE crawled IS NOT NULL GROUP BY 1) WHERE n % 5 = 0 OR length(crawled) % 3 > 0 AND (old IS NULL OR now IS DISTINCT FROM old)",
    "ref_s6_resources": "SELECT DISTINCT id_no, regexp_replace(page_url, '[?#].*$', '') || ['/page', '/a.png', '/b.css?x=1', '/c.pdf', '/d.woff2#y'][id_no % 5 + 1] AS url, CASE WHEN id_no % 5 = 3 THEN '' ELSE '<p>' END AS content FROM ids WHERE page_url IS NOT NULL AND id_no % 5 IN (0, 3)",
    "ref_s7_pages": "SELECT shortname, CASE WHEN k = 0 THEN shortname ELSE split_part(page_url, '#', 1) END || '#n' || k AS href FROM (SELECT shortname, page_url, row_number() OVER (PARTITION BY shortname ORDER BY page_url) - 1 AS k FROM (SELECT DISTINCT shortname, page_url FROM headings WHERE page_url IS NOT NULL))",
    "ref_s8_listings": "SELECT DISTINCT shortname, CAST(spec_no % 3 = 0 AS INTEGER) AS failed, CASE WHEN spec_no % 3 > 0 THEN 'T' END AS found_title FROM specs",
    "ref_s10_expanded": f"SELECT shortname, CASE WHEN spec_no % 3 > 0 THEN 'interface I' || spec_no || ' {{}};' END AS idl, CASE WHEN spec_no % 5 > 0 THEN '[{{\"name\":\"' || CASE WHEN spec_no % 2 = 0 THEN '' ELSE 'm' END || '\",\"cddl\":\"a = ' || spec_no || '\"}}]' END AS cddl, CASE WHEN spec_no % 4 > 0 THEN '{{' || {_CSS.format(x='')} END AS css FROM {_SX}",
    "ref_s11_fallback": f"SELECT shortname, CASE WHEN spec_no % 7 = 0 THEN 'boom' END AS error, CASE WHEN spec_no % 14 = 0 THEN 'old ' || shortname WHEN spec_no % 3 > 0 THEN 'interface I' || spec_no || ' {{}};' ELSE '' END AS idl FROM {_SX}",
    "ref_s12_editions": "SELECT shortname, 1 AS published, release_url AS crawl_url FROM specs WHERE release_url IS NOT NULL UNION ALL SELECT shortname, 0, nightly.url FROM specs",
    "ref_s14_plan": "SELECT url, CAST(row_number() OVER (PARTITION BY o ORDER BY url) - 1 AS INTEGER) AS turn, (row_number() OVER (PARTITION BY o ORDER BY url) - 1) * 100 AS start_ms FROM (SELECT url, CASE WHEN ends_with(o, '.github.io') THEN 'https://github.io' WHEN ends_with(o, '.whatwg.org') THEN 'https://whatwg.org' ELSE o END AS o FROM (SELECT DISTINCT page_url AS url, lower(regexp_extract(page_url, '^[^:]+://[^/?#]*')) AS o FROM ids WHERE page_url IS NOT NULL))",
    "ref_f_texts": f"""SELECT dfn_no AS row_no, unnest(['css_value', 'fragment', 'block', 'split', 'label', 'module', 'shortname', 'unwrap', 'modern', 'header', 'page']) AS function,
        unnest(['-' || t || ' x', CASE WHEN id IS NOT NULL THEN replace(replace(replace(replace(replace(replace(url_encode(id || ' (a)+''~!*'), '%28', '('), '%29', ')'), '%27', ''''), '%21', '!'), '%2A', '*'), '%7E', '~') END, 'a {{' || chr(10) || '  ' || t || chr(10) || chr(10) || '}}',
          t || '(a, b)|' || dfn_no, {_W3.format(a="'newValues'", b="'appliesTo'")}, 'get' || upper(left(t, 1)) || substr(t, 2) || 'Name', 'httpsab' || t, {_W3.format(a='t', b="t || '>'")}, 'attribute FrozenArray<' || t || '> x; [Default] object toJSON();', t, 'https://tc39.es/ecma262/#' || dfn_no]) AS result FROM {_TXT}
        UNION ALL SELECT heading_no, unnest(['number', 'title']), unnest([number_txt, title]) FROM {_NUM}""",
}