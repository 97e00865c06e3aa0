"""Sinks: archive, feed, history, CSV, metadata, consistency, generation commit."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..functions.keys import fields_hash
from ..operators import generations, publish
from ..registry import query
from ..session import work_path
from .common import ACC, CARRY, DENSE, as_of, cte, day
from .sequences import HISTORY, change_text, history_rows


def records(spark, sf):
    """Ads with private columns, as a canonical snapshot holds them."""
    return X.ads(spark, sf).withColumn("match_text", F.col("text")).withColumn(
        "content_hash", fields_hash([F.col("title"), F.col("text")])).withColumn(
        "eligible_new_notification", F.lit(True)).withColumn("listing_fingerprint", F.lit("x"))


def publish_all(spark, sf, root, generation=X.AS_OF, built_from=None, change=lambda tables: tables):
    """One generation of archive, feed, sources and metadata."""
    jobs = records(spark, sf).withColumn("last_seen", F.to_date("first_seen"))
    sources = jobs.groupBy("source_id").agg(F.count("*").alias("n_jobs"))
    return generations.publish(root, change(publish.publication(jobs, sources, as_of(), generation)), generation, built_from)


@query("publish_archive", cte(X.ADS) + """
SELECT id, doc_id, source_id, lang, title, text, status, employment_type, deadline_type,
       CAST(deadline AS VARCHAR) AS deadline, CAST(posted_date AS VARCHAR) AS posted_date, detail_complete, '2024-04-01' AS generation_id FROM ads""")
def publish_archive(spark, sf):
    root = work_path(spark, "publication")
    publish_all(spark, sf, root)
    a = generations.read(spark, root, "archive")
    return a.drop("first_seen", "last_seen").withColumn("deadline", day("deadline")).withColumn("posted_date", day("posted_date"))


# A stated date that no reader can parse must not fall back to the first sighting.
STATED = "CASE WHEN doc_id % 11 = 0 THEN '30+ days ago' ELSE CAST(posted_date AS {}) END"


@query("publish_recent_feed", cte(X.ADS) + f"""
, p AS (SELECT *, {STATED.format('VARCHAR')} AS posted FROM ads),
q AS (SELECT *, CASE WHEN posted IS NOT NULL THEN TRY_CAST(posted AS DATE)
                     ELSE CAST(first_seen + INTERVAL 8 HOUR AS DATE) END AS public_date FROM p)
SELECT id, posted, CAST(first_seen AS VARCHAR) AS first_seen FROM q
WHERE public_date IS NULL OR public_date >= DATE '2024-04-01' - 29""")
def publish_recent_feed(spark, sf):
    a = publish.public_columns(records(spark, sf)).withColumn("posted", F.expr(STATED.format("STRING")))
    return publish.recent_feed(a, as_of(), "posted").select(
        "id", "posted", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("publish_history", cte(*ACC, CARRY, DENSE, HISTORY) + """
SELECT source_id, job_key, CAST(happened AS VARCHAR) AS happened, kind, title, changes FROM history""")
def publish_history(spark, sf):
    # Appended in two publications, by day: a reader of some days opens only their folders.
    path = work_path(spark, "history")
    rows = history_rows(spark, sf).select("source_id", "job_key", day("at").alias("happened"), "kind", "title",
                                          change_text().alias("changes"))
    middle = "2024-01-16"
    for part in (rows.where(F.col("happened") < middle), rows.where(F.col("happened") >= middle)):
        part.repartitionByRange("happened", "source_id", "job_key").write.mode("append").partitionBy("happened").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


_CELLS = {"title": "CASE doc_id % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN ' +x' WHEN 2 THEN '-' || {t} WHEN 3 THEN '@\"a\"' ELSE title END"}


def csv_records(spark, sf):
    return X.ads(spark, sf).withColumn("title", F.expr(_CELLS["title"].format(t="title"))).withColumn(
        "institution", F.col("source_id")).withColumn("subjects", F.expr(
            "filter(array(named_struct('id', 'a', 'label', 'A' || lang), IF(doc_id % 2 = 0, named_struct('id', 'b', 'label', 'B'), NULL)), x -> x IS NOT NULL)")
        ).withColumn("description", F.col("text")).withColumn("score", F.expr("doc_id % 100")).drop("first_seen")


def _guard(expr: str) -> str:
    return f"CASE WHEN regexp_matches({expr}, '^\\s*[=+@-]') THEN '''' || {expr} ELSE {expr} END"


@query("publish_csv", cte(X.ADS, f"c AS (SELECT *, {_CELLS['title'].format(t='title')} AS t2 FROM ads)") + f"""
SELECT source_id AS institution, {_guard('t2')} AS title, '' AS department, employment_type, COALESCE(CAST(posted_date AS VARCHAR), '') AS posted_date,
       COALESCE(CAST(deadline AS VARCHAR), '') AS deadline, deadline_type, '' AS deadline_raw, '' AS url, '' AS reference,
       CASE WHEN doc_id % 2 = 0 THEN 'A' || lang || ', B' ELSE 'A' || lang END AS subjects, CAST(doc_id % 100 AS VARCHAR) AS score, '' AS matches,
       '' AS first_seen, '' AS last_seen, status, {_guard('text')} AS description FROM c""")
def publish_csv(spark, sf):
    path = work_path(spark, "csv")
    publish.write_csv(csv_records(spark, sf), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option(
        "emptyValue", "").option("nullValue", "\u0000").csv(path)
    back = back.withColumnRenamed(back.columns[0], "institution")
    return back.select(*V.CSV_COLUMNS)


@query("publish_metadata", cte(X.ADS) + """
SELECT COUNT(*) AS total_jobs, SUM(CASE WHEN status = 'open' THEN 1 ELSE 0 END)::BIGINT AS n_open,
       SUM(CASE WHEN status = 'closed' THEN 1 ELSE 0 END)::BIGINT AS n_closed,
       SUM(CASE WHEN status = 'missing' THEN 1 ELSE 0 END)::BIGINT AS n_missing,
       CAST(MAX(CAST(first_seen AS DATE)) AS VARCHAR) AS last_run, '2024-04-01' AS generation_id FROM ads""")
def publish_metadata(spark, sf):
    root = work_path(spark, "publication")
    publish_all(spark, sf, root)
    return generations.read(spark, root, "metadata").withColumn("last_run", day("last_run"))


_TAMPERED = """
feed AS (SELECT id FROM ads WHERE COALESCE(posted_date, CAST(first_seen + INTERVAL 8 HOUR AS DATE)) >= DATE '2024-04-01' - 29),
variant AS (SELECT * FROM (VALUES ('good'), ('other generation'), ('short'), ('repeated'), ('replaced')) v(variant)),
arch AS (SELECT variant, CASE WHEN variant = 'replaced' AND id < '8' THEN id || '-' ELSE id END AS id FROM ads, variant WHERE NOT (variant = 'short' AND id < '8')
         UNION ALL SELECT 'repeated', id FROM ads WHERE id < '8'),
cnt AS (SELECT variant, id, COUNT(*) AS n FROM arch GROUP BY 1, 2)
"""


@query("snapshot_consistency", cte(X.ADS, _TAMPERED) + """
SELECT *, same_generation AND count_ok AND n_duplicate = 0 AND n_outside = 0 AS consistent FROM (
  SELECT variant, (SELECT COUNT(*) FROM arch a WHERE a.variant = v.variant) AS archive_rows, (SELECT COUNT(*) FROM feed) AS feed_rows,
    (SELECT COUNT(*) FROM cnt c WHERE c.variant = v.variant AND n > 1) AS n_duplicate,
    (SELECT COUNT(*) FROM feed WHERE id NOT IN (SELECT id FROM arch a WHERE a.variant = v.variant)) AS n_outside,
    variant <> 'other generation' AS same_generation, (SELECT COUNT(*) FROM arch a WHERE a.variant = v.variant) = (SELECT COUNT(*) FROM ads) AS count_ok
  FROM variant v) x""")
def snapshot_consistency(spark, sf):
    """A reader's proof over published tables, and over publications in which one table was tampered with."""
    hit = F.col("id") < "8"
    damage = {
        "good": lambda t: t,
        "other generation": lambda t: t | {"feed": t["feed"].withColumn("generation_id", F.lit("2024-03-31"))},
        "short": lambda t: t | {"archive": t["archive"].where(~hit)},
        "repeated": lambda t: t | {"archive": t["archive"].unionByName(t["archive"].where(hit))},
        "replaced": lambda t: t | {"archive": t["archive"].withColumn("id", F.when(hit, F.concat("id", F.lit("-"))).otherwise(F.col("id")))}}
    out = None
    for variant, change in damage.items():
        root = work_path(spark, "publication")
        publish_all(spark, sf, root, change=change)
        part = publish.proof(*[generations.read(spark, root, name) for name in ("archive", "feed", "metadata")])
        part = part.withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out


@query("state_commit", cte(X.OBS) + """
SELECT source_id, job_key, CAST(MAX(run_date) AS VARCHAR) AS last_seen, COUNT(*) AS n_seen FROM obs GROUP BY 1, 2""")
def state_commit(spark, sf):
    """Two generations of the state; the second is built from the first, which it replaces."""
    root = work_path(spark, "state")
    o = X.obs(spark, sf)
    middle = F.lit("2024-01-16").cast("date")

    def folded(df):
        return df.groupBy("source_id", "job_key").agg(F.max("last_seen").alias("last_seen"), F.sum("n_seen").alias("n_seen"))

    rows = o.select("source_id", "job_key", F.col("run_date").alias("last_seen"), F.lit(1).cast("bigint").alias("n_seen"))
    place = {"state": ["source_id"]}
    first = generations.publish(root, {"state": folded(rows.filter(F.col("last_seen") < middle))}, "g1", None, place)
    merged = folded(generations.read(spark, root, "state").select(rows.columns).unionByName(rows.filter(F.col("last_seen") >= middle)))
    generations.publish(root, {"state": merged}, "g2", first, place)
    return generations.read(spark, root, "state").select(
        F.col("source_id").cast("bigint").alias("source_id"), "job_key", day("last_seen").alias("last_seen"), "n_seen")
