"""Extraction by name and by configuration."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..registry import query
from ..sources.tables import table
from .common import sql_inline
from .extraction import LINKS

_ADAPTER = "CASE page_id % 3 WHEN 0 THEN 'headings' WHEN 1 THEN 'links' ELSE 'unheard-of' END"


@query("extractor_registry", f"""WITH {LINKS}
SELECT page_id, 'headings' AS extractor, 0 AS pos, {sql_inline("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, '' AS reject
FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'links', pos, text, '' FROM links WHERE page_id % 3 = 1 AND href <> '' AND text <> ''
UNION ALL SELECT page_id, '', 0, '', 'unknown extractor: unheard-of' FROM pages WHERE page_id % 3 = 2""")
def extractor_registry(spark, sf):
    pages = table(spark, sf, "pages").withColumn("adapter", F.expr(_ADAPTER))
    rows, unknown = P.run_extractors(pages)
    return rows.select("page_id", "extractor", "pos", "title", F.lit("").alias("reject")).unionByName(
        unknown.select("page_id", F.lit("").alias("extractor"), F.lit(0).alias("pos"), F.lit("").alias("title"), "reject"))


NAVIGATION = P.Patterns(
    row=r"(?is)<li\b[^>]*>.*?</li>", title=r"(?is)<a\b[^>]*>(.*?)</a>", link=r'(?i)href="([^"]*)"',
    reference=r'(?i)href="/([^"]*)"')


@query("config_extractor", f"""
WITH r AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '(?is)<li>.*?</li>') AS li FROM pages),
u AS (SELECT page_id, origin, li, unnest(range(len(li))) AS pos FROM r),
f AS (SELECT page_id, CAST(pos AS INT) AS pos, {sql_inline("regexp_extract(li[pos + 1], '(?is)<a[^>]*>(.*?)</a>', 1)")} AS title, origin,
             {sql_inline("regexp_extract(li[pos + 1], 'href=" + chr(34) + "([^" + chr(34) + "]*)', 1)")} AS href FROM u)
SELECT page_id, pos, title, origin || href AS target, substr(href, 2) AS reference, CASE WHEN href = '' THEN 'missing link' WHEN title = '' THEN 'missing title' ELSE '' END AS reject FROM f""")
def config_extractor(spark, sf):
    return P.configured(table(spark, sf, "pages"), NAVIGATION).select(
        "page_id", "pos", "title", "target", "reference", F.coalesce("reject", F.lit("")).alias("reject"))


# 30 sources, one per nation and region, and pages of two sites that nobody configured.
_SHAPES = [(r"(?is)<li\b[^>]*>.*?</li>", r"(?is)<a\b[^>]*>(.*?)</a>", r'(?i)href="([^"]*)"', r'(?i)href="/([^"]*)"'),
           (r"(?is)<h1\b[^>]*>.*?</h1>", r"(?is)<h1\b[^>]*>(.*?)</h1>", "", ""),
           (r"(?is)<p>[^<]*</p>", r"(?is)<p>([^<.]*)", r"(?is)(<)p>", "")]
_SITE = "concat('site-', CAST(page_id % 32 AS {}))"


def _shape(i: int, column: str) -> str:
    arms = " ".join(f"WHEN {k} THEN '{shape[i]}'" for k, shape in enumerate(_SHAPES))
    return f"CASE {column} % 3 {arms} END"


def site_patterns(spark, sf):
    """The configuration as a table."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).union(
        table(spark, sf, "region").select(F.col("r_regionkey") + 25))
    # literal columns, because a SQL string would read the backslashes of a pattern as its own
    pick = lambda i: F.element_at(F.array(*[F.lit(shape[i]) for shape in _SHAPES]), (F.col("k") % 3 + 1).cast("int"))
    return rows.select(F.concat(F.lit("site-"), F.col("k").cast("string")).alias("site"),
                       *[pick(i).alias(name) for i, name in enumerate(("row", "title", "link", "reference"))])


@query("config_table_extractor", f"""
WITH k AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey + 25 FROM region),
c AS (SELECT concat('site-', CAST(k AS VARCHAR)) AS site, {_shape(0, 'k')} AS row_p, {_shape(1, 'k')} AS title_p, {_shape(2, 'k')} AS link_p, {_shape(3, 'k')} AS ref_p FROM k),
m AS (SELECT page_id, {_SITE.format('VARCHAR')} AS site, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) AS folder, html FROM pages),
j AS (SELECT m.*, c.* EXCLUDE (site), regexp_extract_all(html, row_p) AS parts FROM m LEFT JOIN c USING (site)),
u AS (SELECT *, UNNEST(CASE WHEN len(parts) > 0 THEN range(len(parts)) ELSE [NULL] END) AS pos FROM j),
v AS (SELECT page_id, site, pos, origin, folder, row_p, {sql_inline("regexp_extract(parts[pos + 1], title_p, 1)")} AS title,
        CASE WHEN link_p <> '' THEN {sql_inline("regexp_extract(parts[pos + 1], link_p, 1)")} ELSE '' END AS link,
        CASE WHEN ref_p <> '' THEN {sql_inline("regexp_extract(parts[pos + 1], ref_p, 1)")} ELSE '' END AS reference FROM u)
SELECT page_id, site, CAST(COALESCE(pos, -1) AS INT) AS pos, COALESCE(title, '') AS title,
  CASE WHEN COALESCE(link, '') = '' THEN '' WHEN link LIKE '/%' THEN origin || link ELSE folder || link END AS target, COALESCE(reference, '') AS reference,
  CASE WHEN row_p IS NULL THEN 'unknown source' WHEN pos IS NULL THEN 'no rows' WHEN link = '' THEN 'missing link' WHEN title = '' THEN 'missing title' ELSE '' END AS reject FROM v""")
def config_table_extractor(spark, sf):
    pages = table(spark, sf, "pages").withColumn("site", F.expr(_SITE.format("STRING")))
    return P.configured_by_table(pages, site_patterns(spark, sf)).select(
        "page_id", "site", F.coalesce("pos", F.lit(-1)).alias("pos"), "title", "target", "reference",
        F.coalesce("reject", F.lit("")).alias("reject"))
