"""Column functions on texts, names and URLs of specifications; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specstrata.extract.webidl import OBSOLETE

#: Blanks as browsers see them (fixed value): ASCII blanks, NBSP, BOM and the Unicode spaces.
BLANKS = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def normalize_text(c: Column) -> Column:
    """Blanks trimmed, runs of them made one."""
    return F.regexp_replace(F.regexp_replace(c, BLANKS + "+", " "), "^ | $", "")


def normalize_css_value(c: Column) -> Column:
    """``normalize_text`` with the minus sign made a hyphen."""
    return F.translate(normalize_text(c), "−", "-")


def _camel(c: Column) -> Column:
    words = F.split(c, "-")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    return F.concat(F.element_at(words, 1), F.array_join(rest, ""))


def css_idl_names(prop: Column) -> Column:
    """Attribute names of a style property: dashed, camel-cased if other, and for -webkit- the form with a small w."""
    camel = _camel(prop)
    names = F.array(prop, F.when(camel != prop, camel), F.when(prop.startswith("-webkit-"), _camel(F.substr(prop, F.lit(2)))))
    return F.filter(names, lambda x: x.isNotNull())


# What is rewritten in turn, and by what, to make the URLs of one document agree.
CANONICAL = (
    ("^http:", "https:"),
    ("(?s)^([^#]*)#.*$", "$1"),
    ("(?s)^(.*?)index\\.html", "$1"),
    ("(?s)^(.*?)Overview\\.html", "$1"),
    ("(?s)^(.*?)cover\\.html", "$1"),
    ("spec.whatwg.org/.*", "spec.whatwg.org/"),
    ("w3.org/TR/(([^/]+/)+)[^/]+\\.[^/]+$", "w3.org/TR/$1"),
    ("w3.org/TR/([^/]+)$", "w3.org/TR/$1/"),
    ("w3c.github.io/([^/]+)$", "w3c.github.io/$1/"),
)


def canonical_url(url: Column) -> Column:
    """A URL by which links to a document agree: https, no fragment, no index page, sub-pages folded, trailing slash."""
    for pattern, by in CANONICAL:
        url = F.regexp_replace(url, pattern, by)
    return url


#: Host endings that count as one origin (fixed values).
ORIGINS = ((".whatwg.org", "https://whatwg.org"), (".github.io", "https://github.io"), (".csswg.org", "https://csswg.org"), (".css-houdini.org", "https://csswg.org"), (".fxtf.org", "https://csswg.org"))


def origin(url: Column) -> Column:
    """The origin requests are throttled by; empty for an empty URL, null for one that has none."""
    base = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.regexp_extract(url, "^[^:]+://(?:[^/?#@]*@)?([^/?#]*)", 1)))
    out = F.when(F.coalesce(url, F.lit("")) == "", F.lit(""))
    for ending, name in ORIGINS:
        out = out.when(base.endswith(ending), F.lit(name))
    return out.otherwise(base)


# Fixed value: standards whose multi-page edition has its anchors in a single page too.
MULTIPAGE = "^(https://(?:html\\.spec\\.whatwg\\.org|tc39\\.es/ecma262))/multipage/[^#]+#"


def single_page_form(url: Column) -> Column:
    """A link into the multi-page edition of a standard as a link into its single page."""
    return F.regexp_replace(url, MULTIPAGE, "$1/#")


def encode_fragment(c: Column) -> Column:
    """Percent-encoding as for URI components."""
    out = F.regexp_replace(F.url_encode(c), "\\+", "%20")
    for code, ch in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.regexp_replace(out, code, ch)
    return out


def trim_block(code: Column) -> Column:
    """A block of code without outer blanks, the common indent of its later lines and blanks at line ends."""
    lines = F.split(F.regexp_replace(F.translate(code, "\r", ""), f"^{BLANKS}+|{BLANKS}+$", ""), "\n")
    later = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    filled = F.filter(later, lambda x: x.rlike("\\S"))
    indent = F.coalesce(F.array_min(F.transform(filled, lambda x: F.length(F.regexp_extract(x, "^[ \\t]*", 0)))), F.lit(0))
    cut = F.transform(later, lambda x: F.regexp_replace(F.substr(x, indent + 1), "\\s+$", ""))
    return F.array_join(F.concat(F.array(F.regexp_replace(F.element_at(lines, 1), "\\s+$", "")), cut), "\n")


def split_for(c: Column) -> Column:
    """Parts between commas that stand outside parentheses, trimmed."""
    return F.transform(F.split(c, ",(?![^(]*\\))"), normalize_text)


HEADING_NUMBER = "^((?:Appendix +)?(?:[A-Z]|[0-9]+)(?:\\.[0-9A-Z]+)*[.:]?)\\s+"


def heading_number(title: Column) -> Column:
    """The number a heading begins with, without a last dot or colon and the word Appendix; null if none."""
    found = F.regexp_extract(title, HEADING_NUMBER + "(?=\\S)", 1)
    plausible = found.rlike("[0-9]|^Appendix|[.:]$")
    return F.when((found != "") & plausible, F.regexp_replace(F.regexp_replace(found, "[.:]$", ""), "^Appendix +", ""))


def heading_title(title: Column) -> Column:
    """A heading without its number."""
    return F.when(heading_number(title).isNotNull(), F.regexp_replace(title, HEADING_NUMBER, "")).otherwise(title)


def label_key(label: Column) -> Column:
    """The camel-cased key of a table label; a new value counts among new values."""
    words = F.split(F.regexp_replace(normalize_text(label), ":$", ""), "[ -]")
    first = F.lower(F.element_at(words, 1))
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    key = F.concat(first, F.array_join(rest, ""))
    return F.when(F.lower(key) == "newvalue", F.lit("newValues")).when(F.lower(key) == "newvalues", F.lit("newValues")).otherwise(key)


def camel_module(name: Column) -> Column:
    """Camel-cased module name of a file path."""
    return _camel(F.regexp_extract(name, "([^/\\\\]*?)(?:\\.m?js)?$", 1))


def synthetic_shortname(url: Column) -> Column:
    """A shortname for a bare URL."""
    return F.translate(url, ":/\\.", "")


def unwrap_name(c: Column) -> Column:
    """``<x>`` as ``x``."""
    return F.regexp_replace(c, "^<(.*)>$", "$1")


def modern_idl(idl: Column) -> Column:
    """Interface definitions with first-level constructs rewritten."""
    for pattern, now in OBSOLETE:
        idl = F.regexp_replace(idl, pattern, now.format("$1"))
    return idl


def has_obsolete_idl(idl: Column) -> Column:
    return idl != modern_idl(idl)


def strip_header(text: Column) -> Column:
    """An extract without the comment before its first blank line and without its last newline."""
    at = F.instr(text, "\n\n")
    body = F.when(at > 0, F.substr(text, at + 2)).otherwise(text)
    return F.regexp_replace(body, "\\n$", "")


def is_empty(size: Column) -> Column:
    """Whether a size says there is nothing."""
    return F.coalesce(size, F.lit(0)) <= 0


def same_items(a: Column, b: Column) -> Column:
    """Array equality in order, null like empty."""
    none = F.array().cast("array<string>")
    return F.coalesce(a, none) == F.coalesce(b, none)


def locale_key(c: Column) -> Column:
    """A text to sort by as readers do: letters by alphabet, small before capital, signs first."""
    return F.collate(c, "UNICODE")
