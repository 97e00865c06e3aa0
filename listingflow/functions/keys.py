"""Identity columns: URL parts, canonical URLs, stable ids and content hashes."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

# Generic URI syntax, appendix B of RFC 3986: scheme, authority, path, query, fragment.
_URI = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def url_part(url: Column, name: str) -> Column:
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[name]
    return F.regexp_extract(url, _URI, group)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url_part(url, "netloc"), r"(?:[^@]*@)?([^:@]*)", 1))


def url_port(url: Column) -> Column:
    port = F.regexp_extract(url_part(url, "netloc"), r":(\d+)\z", 1)
    return F.nullif(port, F.lit("")).try_cast("int")


def _decoded(c: Column) -> Column:
    """Every valid triplet and plus sign decoded; a percent sign that starts no triplet stays."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    out = F.url_encode(c)
    return F.replace(F.replace(out, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(url: Column) -> Column:
    """Array of (k, v) in URL order, decoded; a name without "=" has a blank value."""
    parts = F.filter(F.split(url_part(url, "query"), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        _decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
        _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))


def query_param(url: Column, name: str) -> Column:
    """First non-blank value of one parameter; null when the link lacks it."""
    hits = F.filter(query_pairs(url), lambda p: (p["k"] == name) & (p["v"] != ""))
    return F.try_element_at(hits, F.lit(1))["v"]


def canonical_url(url: Column) -> Column:
    """URL identity: lower-case scheme and host, tracking parameters dropped, rest sorted."""
    kept = F.filter(query_pairs(url), lambda p: ~(
        F.lower(p["k"]).startswith(V.DROPPED_PARAM_PREFIX) | p["k"].isin(*V.DROPPED_PARAMS)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(
        _encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    scheme, netloc, fragment = (url_part(url, p) for p in ("scheme", "netloc", "fragment"))
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), F.lower(netloc))).otherwise(""),
        url_part(url, "path"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page (RFC 3986 section 5.2)."""
    origin = F.concat(url_part(base, "scheme"), F.lit("://"), url_part(base, "netloc"))
    folder = F.regexp_extract(url_part(base, "path"), r"\A(.*/)", 1)
    href_path = url_part(href, "path")
    raw = F.when(href_path.startswith("/"), href_path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href_path))
    path = F.when(raw.rlike(r"(\A|/)\.\.?(/|\z)"), _without_dots(raw)).otherwise(raw)
    query, fragment = url_part(href, "query"), url_part(href, "fragment")
    q = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    f = F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise("")
    base_query = url_part(base, "query")
    same_page_q = F.when(query != "", q).when(
        base_query != "", F.concat(F.lit("?"), base_query)).otherwise("")
    return (F.when(url_part(href, "scheme") != "", href)
            .when(href.startswith("//"), F.concat(url_part(base, "scheme"), F.lit(":"), href))
            .when(href_path == "", F.concat(origin, url_part(base, "path"), same_page_q, f))
            .otherwise(F.concat(origin, path, q, f)))


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    closing = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise("")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(s == "..", acc)
        .otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.array_join(kept, "/"), closing)


def stable_key(group: Column, reference: Column, url: Column) -> Column:
    """Record id: source group and published reference, else the canonical URL."""
    ref = F.coalesce(reference, F.lit(""))
    identity = F.when(ref != "", F.replace(F.upper(ref), F.lit(" "), F.lit(""))).otherwise(canonical_url(url))
    return F.substring(F.sha2(F.concat(group.cast("string"), F.char(F.lit(0)), identity), 256), 1, 24)


CONTENT_FIELDS = ["title", "department", "employment_type", "posted_date", "deadline",
                  "deadline_type", "deadline_raw", "description", "match_text"]
LISTING_FIELDS = ["url", "reference", "title", "department", "posted_date", "deadline",
                  "deadline_type", "deadline_raw", "employment_type"]


def fields_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields; the unit separator and a null mark keep them apart."""
    cells = [F.coalesce(f.cast("string"), F.char(F.lit(30))) for f in fields]
    return F.sha2(F.array_join(F.array(*cells), "\x1f"), 256)


def content_hash(**fields: Column) -> Column:
    return fields_hash([fields.get(n, F.lit(None)) for n in CONTENT_FIELDS])


def listing_fingerprint(**fields: Column) -> Column:
    return fields_hash([fields.get(n, F.lit(None)) for n in LISTING_FIELDS])
