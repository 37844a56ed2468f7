"""URL functions, by pattern: no call can fail on a bad URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# fixed values
DENIED_PORTS = ("22", "23", "25", "110", "143", "3306", "5432", "6379")
SUCCESS_PATHS = ("thank", "complete", "success", "finish", "done", "sent")
ERROR_PATHS = ("error", "fail", "invalid")
SECRET_PARAMS = "token|key|secret|password|auth"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.lower(url), PARTS, k)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(part(url, 2), r"^[^@]*@", ""), r":\d*$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, 2), r":(\d+)$", 1)


def private_ip(h: Column) -> Column:
    return h.rlike(r"^(0|10|127)\.\d+\.\d+\.\d+$|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\.")


def valid(url: Column) -> Column:
    """http(s), a public host with a top-level domain, an allowed port, and no over-long parts."""
    h = host(url)
    named = h.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$") | (h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~private_ip(h))
    return (
        part(url, 1).isin("http", "https") & (F.length(url) <= 2048) & ~url.rlike(r"[\s<>\"]") & named & ~port(url).isin(*DENIED_PORTS)
        & (F.length(part(url, 3)) <= 1000) & (F.length(part(url, 4)) <= 1000)
    )


def normalised(url: Column) -> Column:
    """For comparison: final slashes go first, then fragment, then query; lower case."""
    return F.lower(F.substring_index(F.substring_index(F.rtrim(url, F.lit("/")), "#", 1), "?", 1))


def external(link: Column, page: Column) -> Column:
    """The link's host is neither the page's nor a subdomain of it; www does not count."""
    a, b = F.regexp_replace(host(link), r"www\.", ""), F.regexp_replace(host(page), r"www\.", "")
    return (a != "") & (a != b) & ~F.endswith(a, F.concat(F.lit("."), b))


def kind(url: Column) -> Column:
    low = F.lower(url)
    some = lambda words: low.rlike("|".join(words))
    return F.when(some(ERROR_PATHS), "error").when(some(SUCCESS_PATHS), "success").otherwise("other")


def redact_params(url: Column) -> Column:
    return F.regexp_replace(url, rf"(?i)([?&](?:{SECRET_PARAMS})=)[^&#]*", "$1***")


# fixed values: endings under which domains are registered, of two parts
SECOND_LEVEL = "co|or|ne|ac|ad|ed|go|gr|lg|com|net|org|gov|edu"


def host_matches(h: Column, patterns: list[str]) -> Column:
    """The host is one of the domains, with or without a leading dot, or below one."""
    low, found = F.lower(h), F.lit(False)
    for p in (p.lower().lstrip(".") for p in patterns):
        if p:
            found = found | (low == p) | F.endswith(low, F.lit(f".{p}"))
    return found


def registrable(h: Column) -> Column:
    """The last two labels of a host, or three if the last two are an ending such as co.jp."""
    low = F.lower(F.coalesce(h, F.lit("")))
    three = F.regexp_extract(low, rf"([^.]+\.(?:{SECOND_LEVEL})\.[a-z]{{2}})$", 1)
    return F.when(three != "", three).otherwise(F.substring_index(low, ".", -2))


def changed(before: Column, after: Column, strict: bool = False) -> Column:
    """The address is another one; strictly, differences in query and fragment alone do not count."""
    bare = lambda c: F.rtrim(F.regexp_replace(c, r"[?#].*$", ""), F.lit("/"))
    return bare(before) != bare(after) if strict else before != after
