"""Publication: archive, recent feed, CSV, metadata and the reader's consistency proof."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.dates import utc_to_local_date
from ..functions.text import safe_cell


def public_columns(df: DataFrame) -> DataFrame:
    return df.drop(*V.PRIVATE_COLUMNS)


def public_date(posted: Column, first_seen: Column) -> Column:
    """Advertised date if any is stated, else first sighting.  A stated but unreadable
    date is unknown; it does not fall back to the sighting."""
    stated = posted.isNotNull() & (posted != "")
    return F.when(stated, F.to_date(F.try_to_timestamp(posted))).otherwise(utc_to_local_date(first_seen))


def recent_feed(archive: DataFrame, today: Column, posted: str = "posted_date") -> DataFrame:
    """Feed of the last days, today included; records without a usable date stay in."""
    day = public_date(F.col(posted), F.col("first_seen"))
    return archive.filter(day.isNull() | (day >= F.date_sub(today, V.FEED_DAYS - 1)))


def csv_frame(jobs: DataFrame) -> DataFrame:
    """CSV rows in publication order: stable columns, guarded cells, absent ones blank."""
    def cell(name):
        if name == "subjects":
            return F.array_join(F.transform("subjects", lambda s: s["label"]), ", ")
        return F.col(name) if name in jobs.columns else F.lit("")
    # Sorting by the two keys range-partitions the rows: part files are in global order.
    ordered = jobs.orderBy("institution", "id")
    return ordered.select(*[safe_cell(cell(c)).alias(c) for c in V.CSV_COLUMNS])


def write_csv(jobs: DataFrame, path: str) -> None:
    """Every part file starts with a byte-order mark, so spreadsheets read UTF-8."""
    frame = csv_frame(jobs)
    marked = frame.withColumnRenamed(V.CSV_COLUMNS[0], "﻿" + V.CSV_COLUMNS[0])
    marked.write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", "").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def metadata(jobs: DataFrame, generation: str) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("total_jobs"), F.count_if(F.col("status") == "open").alias("n_open"),
        F.count_if(F.col("status") == "closed").alias("n_closed"),
        F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.max("last_seen").alias("last_run")).withColumn("generation_id", F.lit(generation))


def publication(records: DataFrame, health: DataFrame, today: Column, generation: str, posted: str = "posted_date") -> dict[str, DataFrame]:
    """Archive, recent feed, sources and metadata of one generation; every table carries its id."""
    stamp = lambda df: df.withColumn("generation_id", F.lit(generation))
    archive = public_columns(records)
    feed = recent_feed(archive.withColumn("_posted", F.col(posted).cast("string")), today, "_posted").drop("_posted")
    return {"archive": stamp(archive), "feed": stamp(feed), "sources": stamp(health),
            "metadata": metadata(records, generation)}


def proof(archive: DataFrame, feed: DataFrame, meta: DataFrame, key: str = "id") -> DataFrame:
    """One row of proofs, read from published tables: one generation, the declared count, unique ids, feed within archive.

    An empty table has no generation of its own and contradicts none.
    """
    a = archive.groupBy(key).agg(F.count("*").alias("n_a"), F.min("generation_id").alias("a_lo"), F.max("generation_id").alias("a_hi"))
    f = feed.groupBy(key).agg(F.count("*").alias("n_f"), F.min("generation_id").alias("f_lo"), F.max("generation_id").alias("f_hi"))
    both = a.join(f, key, "full_outer").agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("archive_rows"), F.coalesce(F.sum("n_f"), F.lit(0)).alias("feed_rows"),
        F.count_if((F.col("n_a") > 1) | (F.col("n_f") > 1)).alias("n_duplicate"), F.count_if(F.col("n_a").isNull()).alias("n_outside"),
        F.least(F.min("a_lo"), F.min("f_lo")).alias("lo"), F.greatest(F.max("a_hi"), F.max("f_hi")).alias("hi"))
    told = meta.agg(F.struct(F.max("total_jobs").alias("declared"), F.min("generation_id").alias("lo"), F.max("generation_id").alias("hi"))).scalar()
    checks = both.withColumn("told", told).select(
        "archive_rows", "feed_rows", "n_duplicate", "n_outside",
        F.coalesce(F.least("lo", "told.lo") == F.greatest("hi", "told.hi"), F.lit(False)).alias("same_generation"),
        F.coalesce(F.col("told.declared") == F.col("archive_rows"), F.lit(False)).alias("count_ok"))
    return checks.withColumn("consistent", F.expr("same_generation AND count_ok AND n_duplicate = 0 AND n_outside = 0"))
