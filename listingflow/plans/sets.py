"""Set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixtures as X
from ..operators import crawl, landing, pages as P
from ..operators import reconcile
from ..registry import query
from ..session import work_path
from ..sources.tables import table
from .common import joined
from .extraction import LINKS


@query("batch_union", """
SELECT id, event_id, event_type, value FROM (SELECT user_id AS id, event_id, event_type, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events) x WHERE rn = 1""")
def batch_union(spark, sf):
    # Five lists, landed in folders of their own; each is read once and a record of several lists counts once.
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "value", "event_type")
    lists = landing.land(e, work_path(spark, "lists"), "event_type", "event_id")
    parts = [lists.filter(F.col("event_type") == t) for t in ("view", "click", "error", "purchase", "signup")]
    return reconcile.dedupe(reduce(DataFrame.unionByName, parts), "id", "event_id", "last")


@query("page_overlap", """
SELECT l_orderkey AS listing_id, l_suppkey AS ref, COUNT(DISTINCT l_linenumber) AS n_pages FROM lineitem GROUP BY 1, 2
HAVING COUNT(DISTINCT l_linenumber) > 1""")
def page_overlap(spark, sf):
    cells = X.listing_pages(spark, sf).groupBy("listing_id", F.col("l_suppkey").alias("ref"), "page").agg(F.lit(1).alias("x"))
    return cells.groupBy("listing_id", "ref").agg(F.count("*").alias("n_pages")).filter("n_pages > 1")


@query("link_set_equal", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x, regexp_extract_all(html, '<li><a href="([^",.]*)"', 1) AS y FROM pages),
c AS (SELECT page_id, CAST(len(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))) AS BIGINT) AS only_links,
             CAST(len(list_distinct(list_filter(y, lambda v: NOT list_contains(x, v)))) AS BIGINT) AS only_state FROM a)
SELECT page_id, only_links, only_state, only_links = 0 AND only_state = 0 AS equal FROM c""")
def link_set_equal(spark, sf):
    anchors = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    declared = F.regexp_extract_all("html", F.lit('<li><a href="([^",.]*)"'), F.lit(1))
    # Both sets come from one page, so the difference both ways stays inside its row.
    d = table(spark, sf, "pages").select(
        "page_id", F.size(F.array_except(anchors, declared)).cast("bigint").alias("only_links"),
        F.size(F.array_except(declared, anchors)).cast("bigint").alias("only_state"))
    return d.withColumn("equal", (F.col("only_links") == 0) & (F.col("only_state") == 0))


@query("distinct_ordered", f"""WITH {LINKS},
f AS (SELECT page_id, target, MIN(pos) AS first_pos FROM links GROUP BY 1, 2)
SELECT page_id, string_agg(target, ' ' ORDER BY first_pos) AS targets FROM f GROUP BY 1""")
def distinct_ordered(spark, sf):
    # A page's targets stand in its row, in page order; the first of equal ones stays.
    pages = P.with_targets(table(spark, sf, "pages"))
    return pages.where(F.size("targets") > 0).select("page_id", joined(F.array_distinct("targets"), " ").alias("targets"))


@query("frontier_diff", f"""WITH {LINKS}
SELECT DISTINCT target FROM links WHERE target NOT IN (SELECT url FROM pages)""")
def frontier_diff(spark, sf):
    p = table(spark, sf, "pages")
    return P.frontier(P.links(p), p.select(F.col("url").alias("target")))


SITE_LINKS = """
o AS (SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
site_links AS (SELECT a.o_custkey || '/' || a.r AS url, a.o_custkey || '/' || ((2 * a.r + b.k) % a.n + 1) AS target FROM o a CROSS JOIN (VALUES (0), (1)) b(k)
  UNION SELECT o_custkey || '/1', (o_custkey + 1) || '/1' FROM o WHERE r = 1 AND o_custkey % 8 <> 7)
"""


def site_links(spark, sf):
    """Sites of customers whose pages (orders) link on within the site, in cycles, and from some first pages to the next site."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf, "orders").select("o_custkey", F.row_number().over(w.orderBy("o_orderkey")).alias("r"), F.count("*").over(w).alias("n"))
    page = lambda site, r: F.concat_ws("/", site.cast("string"), r.cast("string"))
    site, r = F.col("o_custkey"), F.col("r")
    to = F.array(*[page(site, (2 * r + k) % F.col("n") + 1) for k in (0, 1)],
                 F.when((r == 1) & (site % 8 != 7), page(site + 1, F.lit(1))))
    return o.select(page(site, r).alias("url"), F.explode(F.array_distinct(F.array_compact(to))).alias("target"))


@query("crawl_depth", "WITH RECURSIVE " + SITE_LINKS.strip() + """,
reached AS (SELECT o_custkey || '/1' AS target, 0 AS depth FROM o WHERE r = 1 AND o_custkey % 8 = 0
            UNION SELECT l.target, x.depth + 1 FROM reached x JOIN site_links l ON l.url = x.target WHERE x.depth < 40)
SELECT target, MIN(depth) AS depth, TRUE AS complete FROM reached GROUP BY 1""")
def crawl_depth(spark, sf):
    """Least number of links from the seeds to every page that can be reached; also targets no table holds."""
    landed = work_path(spark, "links")
    site_links(spark, sf).write.parquet(landed)
    links = spark.read.schema("url string, target string").parquet(landed)
    seeds = table(spark, sf, "orders").where("o_custkey % 8 = 0").select(
        F.concat_ws("/", F.col("o_custkey").cast("string"), F.lit("1")).alias("target"))
    return crawl.discover(links, seeds)
