"""Corpus-wide operators on definitions, links and crawls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specstrata.functions.text import MULTIPAGE, canonical_url, css_idl_names, single_page_form


def referenced_terms(terms: DataFrame, links: DataFrame) -> DataFrame:
    """Terms with the documents that refer to them, in the order first seen.

    terms: href, owner, ord, and further fields of the term, which are kept; of
    several documents with one href the last owns it, of several terms of one
    document the first counts. links: href, referrer, pos, and referrer_url if
    known. A link into the multi-page edition of a standard that finds no term
    is taken as one into its single page, where terms of both editions are
    known. A document's own references do not count, and terms nobody refers
    to drop out. Links are reduced to one per href and referrer before the
    join, so a hot term meets as many rows as it has referring documents.
    """
    more = [c for c in terms.columns if c not in ("href", "owner", "ord")]
    known = terms.where("href is not null")
    forms = known.withColumn("form", F.explode(F.array_distinct(F.array("href", single_page_form(F.col("href"))))))
    index = forms.groupBy("form").agg(F.max_by(F.struct("owner", "href"), F.struct("ord", (F.col("form") == F.col("href")).alias("own"))).alias("_t"))
    first = known.groupBy("owner", "href").agg(F.min_by(F.struct("ord", *more), "ord").alias("_f"))
    url = F.min("referrer_url") if "referrer_url" in links.columns else F.lit(None).cast("string")
    pairs = links.where("href is not null and referrer is not null").groupBy(F.col("href").alias("form"), "referrer").agg(F.min("pos").alias("pos"), url.alias("referrer_url"))
    direct = pairs.join(index, "form")
    lost = pairs.where(F.col("form").rlike(MULTIPAGE)).join(index, "form", "left_anti").withColumn("form", single_page_form(F.col("form"))).join(index, "form")
    found = direct.unionByName(lost).where(~F.col("referrer").eqNullSafe(F.col("_t.owner"))).groupBy("_t", "referrer").agg(F.min("pos").alias("pos"), F.min("referrer_url").alias("url"))
    of_term = found.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("pos", "referrer", "url"))).alias("r")).select("_t.owner", "_t.href", "r")
    out = of_term.join(first, ["owner", "href"])
    return out.select("owner", "href", *[F.col(f"_f.{c}").alias(c) for c in more], F.transform("r", lambda x: x["referrer"]).alias("referrers"), F.transform("r", lambda x: x["url"]).alias("referrer_urls"))


def merge_crawls(new: DataFrame, old: DataFrame, keys: list[str], list_keys: tuple[str, ...] = ()) -> DataFrame:
    """All new rows and the old ones that no new row replaces.

    A new row replaces an old one if they agree on any of ``keys``, or share
    an item of one of ``list_keys``, non-empty on both sides. Each key is an
    equi semi-join, so the disjunction never becomes a nested loop. New rows
    are not compared with each other.
    """
    marked = old
    hit = []
    for k in keys:
        seen = new.select(F.col(k).alias(f"_k_{k}")).where(F.col(f"_k_{k}").cast("string") != "").distinct().withColumn(f"_hit_{k}", F.lit(True))
        marked = marked.join(seen, marked[k] == seen[f"_k_{k}"], "left").drop(f"_k_{k}")
        hit.append(f"_hit_{k}")
    kept = marked.where(reduce(lambda a, b: a & b, [F.col(h).isNull() for h in hit], F.lit(True))).drop(*hit)
    for k in list_keys:
        seen = new.select(F.explode(k).alias("_v")).where("_v <> ''").distinct()
        whole = F.to_json(F.struct(*old.columns))
        row = kept.withColumn("_row", F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("again"), whole).alias("b")))  # 128 bits: no two rows are taken for one
        gone = row.select("_row", F.explode(k).alias("_v")).join(seen, "_v", "left_semi").select("_row").distinct()
        kept = row.join(gone, "_row", "left_anti").drop("_row")
    return new.unionByName(kept, allowMissingColumns=True)


#: Relaxations of the search for a missing definition, in order.
RELAXATIONS = ("exact", "other arguments", "other type", "other scope", "missing")


def plain_term(c: Column) -> Column:
    """A term by which calls with other arguments agree."""
    return F.regexp_replace(F.regexp_replace(c, "!overload-[0-9]+", ""), "\\(.*\\)$", "()")


def missing_definitions(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each expected term (keys, term, type, scope) the closest definition's kind of match.

    actual: keys, term, type, scopes. A match is exact, or differs in its
    arguments, also in its type, also in its scope; else the term is missing.
    A null expected type or scope asks for none. Terms are looked for among
    definitions with the same ``keys`` (their document), by one equi-join on
    the plain term.
    """
    wanted = expected.select(*keys, "term", "type", "scope", plain_term(F.col("term")).alias("_p")).where("term is not null").distinct()
    have = actual.select(*keys, F.col("term").alias("_term"), F.col("type").alias("_type"), F.coalesce("scopes", F.array().cast("array<string>")).alias("_scopes"), plain_term(F.col("term")).alias("_p")).where("_term is not null").distinct()
    kinds = have.withColumn("_there", F.lit(1))
    joined = wanted.join(kinds, [*keys, "_p"], "left")
    same_type = F.col("type").isNull() | F.col("type").eqNullSafe(F.col("_type"))
    in_scope = F.col("scope").isNull() | F.expr("array_contains(_scopes, scope)")
    level = F.when(F.col("_there").isNull(), 4).when((F.col("term") == F.regexp_replace("_term", "!overload-[0-9]+", "")) & same_type & in_scope, 0).when(same_type & in_scope, 1).when(in_scope, 2).otherwise(3)
    best = joined.groupBy(*keys, "term", "type", "scope").agg(F.min(level).alias("_level"))
    return best.select(*keys, "term", "type", "scope", F.element_at(F.array(*map(F.lit, RELAXATIONS)), F.col("_level") + 1).alias("match"))


def expected_style_definitions(extracts: DataFrame) -> DataFrame:
    """spec, term, type, scope: what the style extracts (spec, css as JSON) use without a definition."""
    kind = "struct<warnings:array<struct<msg:string,name:string,type:string,`for`:string>>>"
    rows = extracts.select("spec", F.explode(F.from_json("css", kind)["warnings"]).alias("w")).where("w.msg = 'Missing definition'")
    return rows.select("spec", F.col("w.name").alias("term"), F.col("w.type").alias("type"), F.col("w.for").alias("scope")).distinct()


def missing_style_definitions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected style terms (spec, term, type, scope) without a definition of that text in their document; ``match`` tells a text of other type or scope apart.

    actual: spec, term, type, scopes. A call in angle brackets of no known type is found without them as well.
    """
    wanted = expected.withColumn("_t", F.explode(F.array_distinct(F.array("term", F.when(F.col("type").isNull(), F.regexp_replace("term", "^<(.*)\\(\\)>$", "$1()")).otherwise(F.col("term"))))))
    have = actual.select("spec", F.col("term").alias("_t"), F.col("type").alias("_type"), F.col("scopes").alias("_scopes"), F.lit(True).alias("_there")).distinct()
    joined = wanted.join(have, ["spec", "_t"], "left")
    fits = F.col("_there") & (F.col("type").isNull() | (F.col("type") == F.col("_type"))) & (F.col("scope").isNull() | (F.array_join("_scopes", ",") == F.col("scope")))
    best = joined.groupBy("spec", "term", "type", "scope").agg(F.max(F.when(fits, 2).when(F.col("_there"), 1).otherwise(0)).alias("k"))
    return best.where("k < 2").select("spec", "term", "type", "scope", F.when(F.col("k") == 1, "other type").otherwise("missing").alias("match"))


def crawl_stats(specs: DataFrame, error: Column) -> DataFrame:
    """Documents crawled and documents with an error."""
    return specs.agg(F.count("*").alias("crawled"), F.count_if(error.isNotNull()).alias("errors"))


def registry_urls(specs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """shortname, ord, url: the URLs by which a registry's documents are linked to.

    specs: shortname, ord, release_url, nightly_url, series, current, and
    series_urls of the series, which count for its current document. pages:
    shortname, url of the documents' further pages.
    """
    series = F.when(F.col("current") == F.col("shortname"), F.col("series_urls")) if "series_urls" in specs.columns else F.lit(None).cast("array<string>")
    own = specs.select("shortname", "ord", F.explode(F.concat(F.array("release_url", "nightly_url"), F.coalesce(series, F.array().cast("array<string>")))).alias("url"))
    if pages is not None:
        own = own.unionByName(pages.select("shortname", "url").distinct().join(specs.select("shortname", "ord"), "shortname"))
    return own.where("url is not null")


def annotate_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Links (url, ...) with the document whose URL their canonical form is; the first document in order wins.

    urls: shortname, ord, url, as ``registry_urls`` gives them.
    """
    lookup = urls.groupBy(F.col("url").alias("_c")).agg(F.min_by("shortname", F.struct("ord", "shortname")).alias("spec_shortname"))
    return links.withColumn("_c", canonical_url(F.col("url"))).join(lookup, "_c", "left").drop("_c")


def complete_properties(properties: DataFrame, definitions: DataFrame) -> DataFrame:
    """Style properties with those that documents only define, and the names scripts know them by.

    properties: spec, name, href, pos. definitions: spec, linking_text, dfn_type,
    informative, href, pos. A defined name a document already lists is not
    added; of several definitions the first counts. Place-holders drop out.
    """
    defined = definitions.where("dfn_type = 'property' and not coalesce(informative, false)").select("spec", F.posexplode("linking_text").alias("k", "name"), "href", "pos")
    first = defined.groupBy("spec", "name").agg(F.min_by("href", F.struct("pos", "k")).alias("href"))
    added = first.join(properties.select("spec", "name"), ["spec", "name"], "left_anti")
    every = properties.select("spec", "name", "href").unionByName(added).where("name <> 'property-name' and not startswith(name, '--')")
    return every.withColumn("style_declaration", css_idl_names(F.col("name")))


# Rules for documents whose definitions are known to clash with others: part of the URL, term, action.
PATCHES = (
    ("/deviceorientation/", "PermissionState", "drop"),
    ("/TR/orientation-event/", "PermissionState", "drop"),
    ("/portals/", "MessageEventSource", "drop first"),
    ("/TR/WebCryptoAPI/", None, "private"),
    ("/TR/pub-manifest/", None, "private"),
    ("/TR/audiobooks/", None, "private"),
)


def patches(spark) -> DataFrame:
    """The rules for documents that are known to need them."""
    return spark.createDataFrame(PATCHES, "url_part string, term string, action string")


def patch_definitions(definitions: DataFrame, rules: DataFrame) -> DataFrame:
    """Definitions after a table of rules (url_part, term, action): ``drop`` removes those of a term (any, if null) from documents whose URL holds the part, ``drop first`` those whose first text is the term, ``private`` makes them private.

    definitions: url, linking_text, dfn_for, access_mode. The rules are a short list by nature.
    """
    texts = F.concat(F.coalesce("linking_text", F.array().cast("array<string>")), F.coalesce("dfn_for", F.array().cast("array<string>")))
    dropped, private = F.lit(False), F.lit(False)
    for r in rules.select("url_part", "term", "action").distinct().collect():
        hit = F.coalesce(F.col("url").contains(r["url_part"]), F.lit(False))
        if r["term"] is not None:
            hit = hit & (F.coalesce(F.try_element_at("linking_text", F.lit(1)) == r["term"], F.lit(False)) if r["action"] == "drop first" else F.array_contains(texts, r["term"]))
        if r["action"] != "private":
            dropped = dropped | hit
        else:
            private = private | hit
    return definitions.where(~dropped).withColumn("access_mode", F.when(private, F.lit("private")).otherwise(F.col("access_mode")))


def resolve_requests(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """Requested documents (request, pos) to registry rows.

    By URL or shortname; else by series, taking its current level; else the
    request is itself a URL, or a path ending in .html, and gets a shortname
    made of it; else ``error`` says so. specs: shortname, url, series, current.
    """
    exact = specs.select(F.explode(F.array_distinct(F.array("url", "shortname"))).alias("request"), F.col("shortname").alias("_exact"), F.col("url").alias("_exact_url")).where("request is not null").dropDuplicates(["request"])
    series = specs.where("current = shortname and series is not null").select(F.col("series").alias("request"), F.col("shortname").alias("_series"), F.col("url").alias("_series_url")).dropDuplicates(["request"])
    joined = requests.join(exact, "request", "left").join(series, "request", "left")
    is_url = F.col("request").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]")
    is_file = F.col("request").endswith(".html")
    own = F.when(is_url | is_file, F.translate("request", ":/\\.", ""))
    url = F.coalesce("_exact_url", "_series_url", F.when(is_url, F.col("request")).when(is_file, F.concat(F.lit("file:"), F.col("request"))))
    return joined.select("request", "pos", F.coalesce("_exact", "_series", own).alias("shortname"), url.alias("url"), F.when(url.isNull(), F.concat(F.lit("no document is known as "), F.col("request"))).alias("error"))


def with_fallback(crawled: DataFrame, stored: DataFrame, extracts: list[str]) -> DataFrame:
    """Crawled rows (url, error, extracts) in which a failed document takes the stored extracts of its URL and keeps its error."""
    old = stored.select(F.col("url"), F.struct(*extracts).alias("_old")).dropDuplicates(["url"])
    joined = crawled.join(old, "url", "left")
    failed = F.col("error").isNotNull() & F.col("_old").isNotNull()
    return joined.withColumns({x: F.when(failed, F.col(f"_old.{x}")).otherwise(F.col(x)) for x in extracts}).drop("_old")


def changed_documents(pages: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Pages (url, html) that must be read again: new or other content, a stored error, or another engine version. stored: url, html_hash, version, error."""
    good = stored.where((F.col("version") == version) & F.col("error").isNull()).select("url", F.col("html_hash").alias("_h"))
    return pages.withColumn("_h", F.sha2("html", 256)).join(good, ["url", "_h"], "left_anti").drop("_h")


def changed_since(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages (url, last_modified, etag as served) that must be read again, by what the server says.

    A page is as stored (url, last_modified, etag, error) if its time is that
    of the stored one or, where no time is stored, its tag is. What has neither
    or failed is read again.
    """
    good = stored.where("error is null").select("url", F.col("last_modified").alias("_l"), F.col("etag").alias("_e")).dropDuplicates(["url"])
    same = F.when(F.col("_l").isNotNull(), F.col("last_modified") == F.col("_l")).otherwise(F.col("etag") == F.col("_e"))
    return pages.join(good, "url", "left").where(~F.coalesce(same, F.lit(False))).drop("_l", "_e")


#: Milliseconds to wait between requests to an origin, by the ending of its host, else to any other (fixed values).
PAUSES = ((".csswg.org", 2000), ("csswg.org", 2000), ("w3.org", 1000))
OTHER_PAUSE = 100


def request_plan(urls: DataFrame, origin: Column) -> DataFrame:
    """urls with their origin, turn and earliest start in milliseconds: one request at a time an origin, a pause after each."""
    pause = F.lit(OTHER_PAUSE)
    for ending, ms in reversed(PAUSES):
        pause = F.when(F.col("origin").endswith(ending), F.lit(ms)).otherwise(pause)
    turns = Window.partitionBy("origin").orderBy("url")
    return urls.withColumn("origin", origin).withColumn("turn", F.row_number().over(turns) - 1).withColumn("start_ms", F.col("turn").cast("long") * pause)


def known_versions(specs: DataFrame, equivalents: DataFrame | None = None) -> DataFrame:
    """specs (shortname, url, release_url, nightly_url) with ``versions``: its distinct URLs in order, then URLs equivalent to its own (url, urls)."""
    own = F.array_distinct(F.filter(F.array("url", "release_url", "nightly_url"), lambda x: x.isNotNull()))
    if equivalents is None:
        return specs.withColumn("versions", own)
    more = equivalents.select("url", F.col("urls").alias("_more")).dropDuplicates(["url"])
    return specs.join(more, "url", "left").withColumn("versions", F.array_distinct(F.concat(own, F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def pick_edition(specs: DataFrame, published: bool) -> DataFrame:
    """specs with the URL to crawl: the release (documents without one drop out) or the nightly edition (documents without one have no URL)."""
    if published:
        return specs.where("release_url is not null").withColumn("crawl_url", F.coalesce("release_url", "nightly_url"))
    return specs.withColumn("crawl_url", F.col("nightly_url"))
