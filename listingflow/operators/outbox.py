"""Durable outbox of new-record events: queueing, gate, order, text, acknowledgement."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import escape_markdown, safe_link


def new_events(state: DataFrame, outbox: DataFrame | None = None) -> DataFrame:
    """Events to queue for eligible records.  The event id is the idempotence key: one that
    is pending or sent is never queued again, any other state may be."""
    wanted = state.filter("eligible AND matches AND detail_complete AND status = 'open'").select(
        F.concat(F.lit("new:"), "id").alias("event_id"), F.lit("new").alias("kind"), "id",
        F.col("last_seen").alias("created_at"))
    if outbox is None:
        return wanted
    held = outbox.filter(F.col("state").isin("pending", "sent")).select("event_id")
    return wanted.join(held, "event_id", "left_anti")


def enqueue(line: DataFrame, matches: Column) -> DataFrame:
    """One event per record of a timeline: its first sighting that is whole, open and matching.

    Records first seen in a baseline run never queue one.  Only two aggregates per record.
    """
    good = F.col("detail_complete") & (F.col("seen_status") == "open") & matches
    first = line.groupBy("source_id", "job_key").agg(
        F.min(F.when(good, F.col("run_date"))).alias("created_at"),
        F.min_by("baseline_run", "run_date").alias("baseline"))
    return first.where("created_at IS NOT NULL AND NOT baseline").drop("baseline")


def gate(events: DataFrame, jobs: DataFrame, key: str = "id") -> DataFrame:
    """Pending events with their current record: send, defer until details recover, suppress."""
    j = jobs.select(key, F.struct("matches", "status", "detail_complete").alias("job"))
    job = F.col("job")
    return events.join(j, key, "left").withColumn(
        "decision", F.when(job.isNotNull() & ~job["detail_complete"] & (job["status"] == "open"), "defer")
        .when(job.isNull() | ~job["matches"] | (job["status"] != "open"), "suppress").otherwise("send"))


def acknowledge(outbox: DataFrame, summaries: DataFrame) -> DataFrame:
    """Mark an acknowledged digest's pending child events as sent, with its id.

    A child named by several acknowledged digests belongs to the first one.
    """
    children = summaries.select("summary_id", F.explode("events").alias("event_id")).groupBy("event_id").agg(
        F.min("summary_id").alias("summary_id"))
    hit = (F.col("state") == "pending") & F.col("summary_id").isNotNull()
    joined = outbox.join(children, "event_id", "left").withColumn("_hit", hit)
    return joined.withColumn("state", F.when(F.col("_hit"), "sent").otherwise(F.col("state"))).withColumn(
        "summary_id", F.when(F.col("_hit"), F.col("summary_id"))).drop("_hit")


def new_job_message(institution: Column, title: Column, posted: Column, first_seen: Column, subjects: Column,
                    deadline_type: Column, deadline: Column, url: Column) -> Column:
    posted_text = F.coalesce(posted.cast("string"), F.lit(V.NEW_JOB_NO_POSTED))
    closing = F.when(deadline_type == "closing", F.coalesce(deadline.cast("string"), F.lit(V.NEW_JOB_SEE_PAGE))
                     ).otherwise(V.NEW_JOB_ONGOING)
    text = F.concat(
        F.lit(V.NEW_JOB_TITLE), escape_markdown(institution), F.lit("\n**"), escape_markdown(title), F.lit("**\n"),
        F.lit(V.NEW_JOB_POSTED), posted_text, F.lit(V.NEW_JOB_SEEN), F.substring(first_seen.cast("string"), 1, 10),
        F.lit("\n"), F.lit(V.NEW_JOB_SUBJECTS), subjects, F.lit("\n"), F.lit(V.NEW_JOB_DEADLINE), closing,
        F.lit("\n"), safe_link(url), F.lit("\n"), F.lit(V.NEW_JOB_FOOTER))
    return F.substring(text, 1, V.MESSAGE_LIMIT)
