"""Column functions on URLs and time, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?)([^/?#]*)"
_NEEDS_WORK = r"%|^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^a-z0-9./:\-]"


def plain_href(href: Column) -> Column:
    """The spelling by which two hrefs are compared.

    The host is lower-cased and the part after the first ``#`` is
    percent-decoded as UTF-8, a plus sign standing for itself; the rest stays.
    A ``%`` that starts no escape is kept. Null stays null.
    """
    at = F.instr(href, "#")
    head = F.when(at > 0, F.substr(href, F.lit(1), at - 1)).otherwise(href)
    fragment = F.when(at > 0, F.substr(href, at)).otherwise(F.lit(""))
    opening = F.regexp_extract(head, _AUTHORITY, 1)
    host = F.regexp_extract(head, _AUTHORITY, 2)
    rest = F.substr(head, F.length(opening) + F.length(host) + 1)
    escaped = F.regexp_replace(F.regexp_replace(fragment, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    decoded = F.when(fragment.contains("%"), F.coalesce(F.try_url_decode(escaped), fragment)).otherwise(fragment)
    return F.when(href.rlike(_NEEDS_WORK), F.concat(opening, F.lower(host), rest, decoded)).otherwise(href)


def utc_month(at: Column) -> Column:
    """``YYYY-MM`` of a timestamp in UTC, whatever the session's time zone."""
    days = F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_HTTP_DATE = r"^[A-Za-z]+,\s*(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*[ -](\d{4}|\d{2})\s+(\d{2}:\d{2}:\d{2})\s*(?:GMT|UTC|Z)?$"
_C_DATE = r"^[A-Za-z]+\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})$"
_ISO_DATE = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|[+-]\d{2}:?\d{2})?$"


def moment(text: Column) -> Column:
    """Microseconds since 1970 of a date in HTTP (two forms), C or ISO notation or in seconds, else null.

    A notation without a zone is taken as UTC.
    """
    s = F.trim(text)

    def month(name: Column) -> Column:
        return F.lpad((F.ceil(F.instr(F.lit(_MONTHS), F.initcap(name)) / 3)).cast("string"), 2, "0")

    year = F.regexp_extract(s, _HTTP_DATE, 3)
    full_year = F.when(F.length(year) == 4, year).when(year.cast("int") >= 70, F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    http = F.concat(full_year, F.lit("-"), month(F.regexp_extract(s, _HTTP_DATE, 2)), F.lit("-"), F.lpad(F.regexp_extract(s, _HTTP_DATE, 1), 2, "0"), F.lit("T"), F.regexp_extract(s, _HTTP_DATE, 4), F.lit("Z"))
    c = F.concat(F.regexp_extract(s, _C_DATE, 4), F.lit("-"), month(F.regexp_extract(s, _C_DATE, 1)), F.lit("-"), F.lpad(F.regexp_extract(s, _C_DATE, 2), 2, "0"), F.lit("T"), F.regexp_extract(s, _C_DATE, 3), F.lit("Z"))
    zone = F.regexp_replace(F.regexp_extract(s, _ISO_DATE, 3), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    iso = F.concat(F.regexp_extract(s, _ISO_DATE, 1), F.lit("T"), F.regexp_extract(s, _ISO_DATE, 2), F.when(zone == "", F.lit("Z")).otherwise(zone))
    stamp = F.when(s.rlike(_ISO_DATE), iso).when(s.rlike(_HTTP_DATE), http).when(s.rlike(_C_DATE), c)
    seconds = F.when(s.rlike(r"^\d{9,11}$"), s.cast("long") * 1_000_000)
    return F.coalesce(F.unix_micros(stamp.try_cast("timestamp")), seconds)
