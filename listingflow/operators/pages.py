"""Extraction jobs over landed page tables: links, text, sections, quality, literals."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import html as H
from ..functions.dates import parse_date
from ..functions.keys import join_url

# The address of an anchor may stand in either kind of quotes or in none.
_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per anchor in page order: position, absolute URL, anchor text."""
    rows = pages.select(key, "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("pos", "a"))
    part = lambda n: F.regexp_extract("a", _ANCHOR, n)
    found = rows.select(key, "url", "pos", H.unescape(F.trim(F.concat(part(1), part(2), part(3)))).alias("href"),
                        H.inline_text(part(4)).alias("text"))
    return found.select(key, "url", "pos", "href", join_url(F.col("url"), F.col("href")).alias("target"), "text")


def with_targets(pages: DataFrame) -> DataFrame:
    """Pages with ``targets``, the absolute addresses of their anchors in page order, inside the row."""
    anchors = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))
    href = lambda a: H.unescape(F.trim(F.regexp_replace(a, rf"{_ANCHOR}", "$1$2$3")))
    hrefs = pages.withColumn("_hrefs", F.transform(anchors, href))
    return hrefs.withColumn("targets", F.transform("_hrefs", lambda h: join_url(F.col("url"), h))).drop("_hrefs")


def link_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Links with the reason a listing row would be refused: no address or no title."""
    return links(pages, key).withColumn(
        "reject", F.when(F.col("href") == "", "missing link").when(F.col("text") == "", "missing title"))


BOILERPLATE_BLOCKS = (r"<!--.*?-->", r"<nav\b[^>]*>.*?</nav>", r"<footer\b[^>]*>.*?</footer>",
                      r'<div\b[^>]*class="ad"[^>]*>.*?</div>')


def trim_body(html: Column, marker: str | None = None, blocks: tuple[str, ...] = BOILERPLATE_BLOCKS) -> Column:
    """Markup without boilerplate blocks, from the marker onward (all of it if absent)."""
    kept = F.regexp_replace(html, "(?is)" + "|".join(blocks), "")
    if marker is None:
        return kept
    at = F.locate(marker, kept)
    return F.when(at > 0, F.substr(kept, at)).otherwise(kept)


def sections(pages: DataFrame, key: str = "page_id", split_on: str = r"(?i)<p\b[^>]*>",
             min_body: int = 100) -> DataFrame:
    """Many records of one page, of all its articles: heading up to the first full stop, body after it.

    ``ok`` needs a heading and a long enough body; ``duplicate`` marks a heading that the
    page repeats, because the heading is the record's only identity.
    """
    articles = F.regexp_extract_all("html", F.lit(r"(?is)<article[^>]*>(.*?)</article>"), F.lit(1))
    # what stands before an article's first mark is no section
    parts = F.flatten(F.transform(articles, lambda a: F.slice(F.split(a, split_on), F.lit(2), F.size(F.split(a, split_on)))))
    # a projection of its own, or the optimiser would clean every part again for each use
    texts = pages.select(key, parts.alias("_parts")).select(key, F.transform("_parts", lambda x: H.inline_text(x)).alias("_texts"))
    heads = texts.withColumn("_heads", F.transform("_texts", lambda t: F.trim(F.regexp_extract(t, r"(?s)\A([^.]*)", 1))))
    # headings that stand next to an equal one once sorted: the page repeats them, and no other row has to be asked
    heads = heads.withColumn("_sorted", F.sort_array("_heads"))
    again = F.filter("_sorted", lambda h, i: (i > 0) & (h == F.try_element_at("_sorted", i)))
    rows = heads.withColumn("_again", again).select(
        key, "_again", F.posexplode(F.arrays_zip(F.col("_texts").alias("text"), F.col("_heads").alias("heading"))).alias("pos", "s"))
    body = F.trim(F.regexp_extract("s.text", r"(?s)\A[^.]*\.(.*)\z", 1))
    return rows.select(key, (F.col("pos") + 1).alias("pos"), F.col("s.heading").alias("heading"), body.alias("body"), "_again").select(
        key, "pos", "heading", "body", ((F.col("heading") != "") & (F.length("body") >= min_body)).alias("ok"),
        F.array_contains("_again", F.col("heading")).alias("duplicate"))


def quality(html: Column, min_text: int = 100) -> Column:
    """challenge / denied / empty / short / ok.  A challenge resource alone is not proof:
    it counts only when the body is empty."""
    low = F.lower(html)
    challenge = low.contains(V.CHALLENGE_RESOURCE) & low.rlike("(?is)" + V.EMPTY_BODY)
    for mark in V.CHALLENGE_MARKS:
        if mark != "<title>access denied":
            challenge = challenge | low.contains(mark)
    text = H.markup_to_text(html)
    return (F.when(challenge, "challenge").when(low.contains("<title>access denied"), "denied")
            .when(low.rlike("(?is)" + V.EMPTY_BODY) | (text == ""), "empty")
            .when(F.length(text) < min_text, "short").otherwise("ok"))


def explicit_empty(n_rows: Column, notice: Column, n_conflicts: Column) -> Column:
    """Zero rows is a result only with an exact notice and no conflicting vacancy link."""
    return (n_rows == 0) & notice & (n_conflicts == 0)


def script_literals(html: Column, function: str) -> Column:
    """Numbers passed to a page function, read from the script text, never run."""
    found = F.regexp_extract_all(html, F.lit(rf"\b{function}\(\s*(-?\d+)\s*\)"), F.lit(1))
    return F.transform(found, lambda v: v.try_cast("bigint"))


def script_string(html: Column, name: str) -> Column:
    """A quoted string literal of a script, decoded as JSON text."""
    literal = F.regexp_extract(html, rf'(?s)\b{name}\s*=\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")', 1)
    return F.when(literal != "", F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v"))


#: Parts of a literal that matter for its end, and everything between them; none of them loops inside.
_SCAN = r"""(?s)\\.|["{}\[\]]|[^"\\{}\[\]]++|\\"""


def balanced_prefix(text: Column) -> Column:
    """The object or array literal a text begins with, null if it never closes.

    A fold over the text's brackets, quotes and escapes: brackets inside strings and escaped quotes do not
    count, and the text between is one step however long it is.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(acc, t):
        opens, closes = ~acc["quoted"] & t.isin("{", "["), ~acc["quoted"] & t.isin("}", "]")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        after = F.struct(depth.alias("depth"), F.when(t == '"', ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
                         (acc["size"] + F.char_length(t)).alias("size"), (closes & (depth <= 0)).alias("done"))
        return F.when(acc["done"], acc).otherwise(after)

    end = F.aggregate(F.regexp_extract_all(text, F.lit(_SCAN), F.lit(0)), start, step,
                      lambda acc: F.when(acc["done"] & (acc["depth"] == 0), acc["size"]))
    return F.substring(text, F.lit(1), end)


def assigned_literals(pages: DataFrame, name: str, key: str = "page_id") -> DataFrame:
    """Every object or array literal that a page's scripts assign to a name: position, name, literal.

    ``name`` is a regular expression.  The literal is read as data, never run; one that does not close or is no JSON
    is refused with a reason, like a page whose layout changed.
    """
    head = rf"\b(?:{name})\s*=\s*(?=[\[{{])"
    at = pages.select(key, "html", F.split("html", head).alias("between"),
                      F.posexplode(F.regexp_extract_all("html", F.lit(head), F.lit(0))).alias("pos", "head"),
                      F.regexp_extract_all("html", F.lit(head), F.lit(0)).alias("heads"))
    chars = lambda parts: F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.char_length(x))
    start = chars(F.slice("between", F.lit(1), F.col("pos") + 1)) + chars(F.slice("heads", F.lit(1), F.col("pos") + 1))
    rows = at.select(key, "pos", F.regexp_extract("head", r"\A([\w.$]+)", 1).alias("name"),
                     balanced_prefix(F.substring("html", start + 1, F.char_length("html"))).alias("literal"))
    valid = F.try_parse_json("literal").isNotNull()
    return rows.withColumn("reject", F.when(F.col("literal").isNull(), "literal does not close").when(~valid, "literal is no data"))


def zipped_literals(keys: Column, values: Column) -> Column:
    """Two parallel literal arrays as (key, value) pairs; unequal lengths are no data."""
    return F.when(F.size(keys) == F.size(values), F.arrays_zip(keys.alias("k"), values.alias("v")))


def frontier(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Targets not yet visited, each once."""
    return found.select("target").distinct().join(visited.select("target"), "target", "left_anti")


# --- extractors by name ----------------------------------------------------

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(name: str):
    def add(fn):
        EXTRACTORS[name] = fn
        return fn
    return add


@dataclass(frozen=True)
class Patterns:
    """A source added by configuration only: one regular expression per field."""
    row: str
    title: str
    link: str | None = None
    reference: str | None = None
    posted: str | None = None
    body: str | None = None


def configured(pages: DataFrame, p: Patterns, key: str = "page_id") -> DataFrame:
    """Rows of a page by configured patterns; a row without a title or link is refused."""
    rows = pages.select(key, "url", F.posexplode(F.regexp_extract_all("html", F.lit(p.row), F.lit(0))).alias("pos", "row"))

    def value(pattern):
        return F.lit("") if pattern is None else H.inline_text(
            F.regexp_extract("row", pattern, 1))

    link = value(p.link)
    return rows.select(
        key, "pos", value(p.title).alias("title"),
        F.when(link != "", join_url(F.col("url"), link)).otherwise("").alias("target"),
        value(p.reference).alias("reference"), parse_date(value(p.posted)).alias("posted_date"),
        value(p.body).alias("body")).withColumn(
        "reject", F.when(F.col("target") == "", "missing link").when(F.col("title") == "", "missing title"))


def configured_by_table(pages: DataFrame, config: DataFrame, site: str = "site", key: str = "page_id") -> DataFrame:
    """Rows of pages by a table of patterns: site, row, title, link, reference.

    Pages meet their source's patterns by an equi-join and the patterns are applied as column values, so the plan is
    the same for any number of sources.  A page of an unknown site, a page without a row and a row without link or title
    come back with the reason they are refused.
    """
    patterns = config.select(site, F.struct("row", "title", "link", "reference").alias("_p"))
    met = pages.select(key, site, "url", "html").join(patterns, site, "left")
    found = F.when(F.col("_p").isNotNull(), F.regexp_extract_all("html", F.col("_p.row"), F.lit(0)))
    rows = met.select(key, site, "url", "_p", F.posexplode_outer(found).alias("pos", "part"))

    def value(field):
        cell = F.expr(f"regexp_extract(part, _p.{field}, 1)")
        return F.coalesce(F.when(F.col(f"_p.{field}") != "", H.inline_text(cell)), F.lit(""))

    cells = rows.select(key, site, "url", "_p", "pos", *[value(f).alias(f) for f in ("title", "link", "reference")])
    return cells.select(
        key, site, "pos", "title", F.when(F.col("link") != "", join_url(F.col("url"), F.col("link"))).otherwise("").alias("target"),
        "reference", F.when(F.col("_p").isNull(), "unknown source").when(F.col("pos").isNull(), "no rows")
        .when(F.col("link") == "", "missing link").when(F.col("title") == "", "missing title").alias("reject"))


def run_extractors(pages: DataFrame, adapter: str = "adapter") -> tuple[DataFrame, DataFrame]:
    """Route pages to their named extractor; pages naming an unknown one are rejects."""
    parts = [fn(pages.filter(F.col(adapter) == name)).withColumn("extractor", F.lit(name))
             for name, fn in sorted(EXTRACTORS.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    unknown = pages.filter(F.col(adapter).isNull() | ~F.col(adapter).isin(*EXTRACTORS))
    return rows, unknown.withColumn("reject", F.concat(F.lit("unknown extractor: "), F.coalesce(adapter, F.lit(""))))


@extractor("headings")
def _headings(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.lit(0).alias("pos"), H.inline_text(H.heading(F.col("html"))).alias("title"),
                        F.col("url").alias("target"))


@extractor("links")
def _links(pages: DataFrame) -> DataFrame:
    return link_rows(pages).filter("reject IS NULL").select("page_id", "pos", F.col("text").alias("title"), "target")
