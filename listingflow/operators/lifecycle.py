"""Record life cycle from the observation log.

Grain and bounds: ``obs`` holds at most one row per (source, record, run) and ``runs``
one per (source, run), both made by map-side aggregation.  Windows are keyed by one
record (as long as its run calendar) or by one source's runs; none is keyed by the
records of a source, so a hot source only means more keys.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.keys import CONTENT_FIELDS, content_hash
from .listing import said_empty

JOB = ["source_id", "job_key"]
#: Fields of a record as it is stored; ``HISTORY_FIELDS`` of them are compared in the log.
FIELDS = ["title", "department", "employment_type", "posted_date", "deadline", "deadline_type", "deadline_raw",
          "description", "match_text", "listing_fingerprint"]
FLAGS = ["detail_complete", "detail_refresh_failed", "source_closed"]
HISTORY_FIELDS = ["deadline", "deadline_type", "department", "description", "employment_type", "posted_date", "status",
                  "title"]
SEED_TYPE = "struct<first_seen:date,detail_verified_at:date,changed_at:date>"


def _history(df: DataFrame):
    return Window.partitionBy(*JOB).orderBy("run_date").rowsBetween(Window.unboundedPreceding, 0)


def _job_order():
    return Window.partitionBy(*JOB).orderBy("run_date")


def _kept(keep: Column, value: Column, over) -> Column:
    """Latest kept value; the struct lets a kept null stay a null."""
    return F.last(F.when(keep, F.struct(value.alias("v"))), ignorenulls=True).over(over)["v"]


def carry_forward(obs: DataFrame) -> DataFrame:
    """Observed fields with verified values carried through incomplete reads.

    Each field has its own keep rule; a record's first observation is always kept.
    A stored state row may lead a record's observations (``seed``: its first sighting,
    last verified date and last change); it then acts as the record those were merged into.
    """
    over = _history(obs)
    first = F.row_number().over(_job_order()) == 1
    sure = F.col("detail_complete") | first
    strong = sure | ~F.col("deadline_type").isin(*V.WEAK_DEADLINES)
    if "seed" not in obs.columns:
        obs = obs.withColumn("seed", F.lit(None).cast(SEED_TYPE))
    read_on = F.when(F.col("seed").isNotNull(), F.col("seed.detail_verified_at")).when(
        F.col("detail_complete"), F.col("run_date"))
    keep = {"department": sure | (F.col("department") != ""), "posted_date": sure | F.col("posted_date").isNotNull(),
            "listing_fingerprint": sure | (F.col("listing_fingerprint") != ""),
            "deadline": strong, "deadline_type": strong, "deadline_raw": strong}

    def latched(flag):
        # Once set it holds until a complete read says otherwise.
        said = F.last(F.when(F.col("detail_complete") | F.col(flag), F.col(flag)), ignorenulls=True).over(over)
        return F.coalesce(said, F.lit(False)).alias(flag)

    return obs.select(
        *JOB, "run_date", "event_id", "value", "detail_complete", "seed",
        *[_kept(keep.get(f, sure), F.col(f), over).alias(f) for f in FIELDS],
        F.max(read_on).over(over).alias("detail_verified_at"), latched("source_closed"), latched("detail_refresh_failed"))


def listing_days(runs: DataFrame, complete: str = "accepted") -> DataFrame:
    """One row per source and day of its calendar, from its first run to its last.

    ``upto`` counts the accepted listings up to the day, ``before`` those before it and
    ``in_all`` all of the source's; ``next_accepted`` and ``third_accepted`` date the first and the third accepted listing
    after it, ``baseline`` marks the days of baseline runs.  Bounded by sources times days.
    """
    by_day = Window.partitionBy("source_id").orderBy("run_date")
    by_count = Window.partitionBy("source_id").orderBy("upto")
    accepted = F.col(complete).cast("int")

    def later(n):
        # The first run of a count is the accepted one that reached it.
        return F.min("run_date").over(by_count.rangeBetween(n, n))

    counted = baseline_runs(runs).withColumn("upto", F.sum(accepted).over(by_day)).select(
        "source_id", "run_date", "upto", (F.col("upto") - accepted).alias("before"), "baseline",
        F.sum(accepted).over(Window.partitionBy("source_id")).alias("in_all"),
        later(1).alias("next_accepted"), later(V.MISSING_AFTER).alias("third_accepted"),
        F.lead("run_date").over(by_day).alias("_next_run"))
    last = F.greatest(F.coalesce(F.date_sub("_next_run", 1), F.col("run_date")), F.col("run_date"))
    days = counted.withColumn("day", F.explode(F.sequence("run_date", last)))
    on_run = F.col("day") == F.col("run_date")
    return days.select("source_id", "day", "upto", F.when(on_run, F.col("before")).otherwise(F.col("upto")).alias("before"),
                       "in_all", "next_accepted", "third_accepted", (on_run & F.col("baseline")).alias("baseline"))


def absence_spells(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Per observation: accepted listings without the record until it is seen again.

    ``missed`` stays as it is through runs that prove nothing and resets on sight; the
    third missed listing dates the "missing" status, the first one after a closing date
    (``closing_missed``) closes the record.  Both come from running counts of the source's
    accepted listings, so the work per observation does not grow with the calendar.
    """
    days = listing_days(runs)
    seen_on = days.withColumnRenamed("day", "run_date").withColumnRenamed("baseline", "baseline_run")
    closing = days.select("source_id", F.col("day").alias("deadline"), F.col("next_accepted").alias("closing_missed"))
    rows = records.join(seen_on, ["source_id", "run_date"], "left").join(closing, ["source_id", "deadline"], "left")
    order = _job_order()
    next_seen = F.lead("run_date").over(order)
    end = F.coalesce(F.lead("before").over(order), F.col("in_all"))
    rows = rows.withColumns({"next_seen": next_seen, "_end": end})

    def missed_day(c):
        return F.when(F.col("next_seen").isNull() | (F.col(c) < F.col("next_seen")), F.col(c))

    return rows.withColumns({
        "missed": F.coalesce(F.col("_end") - F.col("upto"), F.lit(0)).cast("int"),
        "missing_since": missed_day("third_accepted"), "closing_missed": missed_day("closing_missed"),
        "baseline_run": F.coalesce("baseline_run", F.lit(False))}).drop(
        "upto", "before", "next_accepted", "third_accepted", "in_all", "_end")


def with_status(spells: DataFrame) -> DataFrame:
    """Status on sight, what absence turned it into, and when.

    On sight: closed by the source or by a passed closing date, else open; the closing
    day itself is open.  While absent from accepted listings: closed outranks missing.
    """
    dated = F.col("deadline_type") == "closing"
    passed = dated & F.col("deadline").isNotNull()
    on_sight = F.when(F.col("source_closed") | (passed & (F.col("deadline") < F.col("run_date"))),
                      "closed").otherwise("open")
    close_day = F.when(passed, F.col("closing_missed"))
    return (spells.withColumn("seen_status", on_sight)
            .withColumn("closed_on", F.when(F.col("seen_status") == "open", close_day))
            .withColumn("missing_on", F.when(
                (F.col("seen_status") == "open")
                & (F.col("closed_on").isNull() | (F.col("missing_since") < F.col("closed_on"))),
                F.col("missing_since")))
            .withColumn("end_status", F.when(F.col("closed_on").isNotNull(), "closed")
                        .when(F.col("missing_on").isNotNull(), "missing").otherwise(F.col("seen_status"))))


def baseline_runs(runs: DataFrame) -> DataFrame:
    """True for runs before which the source had never produced a row or a whole list.

    Whether the *previous* runs were productive decides, so a failed empty run keeps the
    baseline pending and an explicit-empty complete run uses it up.
    """
    productive = (F.col("n_jobs") > 0) | (F.col("listing_complete") & said_empty(runs))
    earlier = Window.partitionBy("source_id").orderBy("run_date").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("baseline", ~F.coalesce(F.max(productive).over(earlier), F.lit(False)))


def timeline(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every observation with carried fields, status and the state it replaced."""
    t = with_status(absence_spells(carry_forward(obs), runs))
    order = _job_order()
    t = t.withColumn("content_hash", content_hash(**{c: F.col(c) for c in CONTENT_FIELDS}))
    before = F.struct(*[f for f in HISTORY_FIELDS if f != "status"], F.col("end_status").alias("status"), "content_hash")
    return t.withColumn("before", F.lag(before).over(order))


def change_history(line: DataFrame) -> DataFrame:
    """Append-only log: baseline/new, updated (with field changes), status rows.

    One observation yields up to three rows: what was seen, then "missing" and "closed"
    while it stayed away.  They are built in one pass over the timeline.
    """
    is_first = F.col("before").isNull()
    changed = (F.col("before.content_hash") != F.col("content_hash")) | (
        F.col("before.status") != F.col("seen_status"))
    after = {"status": F.col("seen_status")}
    changes = F.array_compact(F.array(*[
        F.when(~F.col(f"before.{f}").eqNullSafe(after.get(f, F.col(f))), F.struct(
            F.lit(f).alias("field"), F.col(f"before.{f}").cast("string").alias("before"),
            after.get(f, F.col(f)).cast("string").alias("after"))) for f in HISTORY_FIELDS]))
    none = F.array().cast("array<struct<field:string,before:string,after:string>>")
    seen_kind = F.when(~is_first, "updated").when(F.col("baseline_run"), "baseline").otherwise("new")

    def row(at, kind, diff):
        return F.struct(at.alias("at"), kind.alias("kind"), diff.alias("changes"))

    def turn(day, old, new):
        diff = F.array(F.struct(F.lit("status").alias("field"), old.alias("before"), F.lit(new).alias("after")))
        return F.when(F.col(day).isNotNull(), row(F.col(day), F.lit("status"), diff))

    was = F.when(F.col("missing_on").isNotNull(), "missing").otherwise("open")
    rows = F.array_compact(F.array(
        F.when(is_first | changed, row(F.col("run_date"), seen_kind, F.when(is_first, none).otherwise(changes))),
        turn("missing_on", F.lit("open"), "missing"), turn("closed_on", was, "closed")))
    return line.select(*JOB, "title", F.inline_outer(rows)).filter("kind IS NOT NULL").select(
        *JOB, "at", "kind", "title", "changes")


def current_state(line: DataFrame) -> DataFrame:
    """Latest state per record, by map-side aggregation over its timeline."""
    last = F.max_by(F.struct(
        *FIELDS, *FLAGS, "detail_verified_at", "missed", "end_status", "closed_on", "missing_on",
        "value", "content_hash"), "run_date")
    changed = F.col("before").isNull() | (F.col("before.content_hash") != F.col("content_hash")) | (
        F.col("before.status") != F.col("seen_status"))
    own_change = F.when(F.col("seed").isNotNull(), F.col("seed.changed_at")).when(changed, F.col("run_date"))
    last_change = F.greatest(own_change, F.col("missing_on"), F.col("closed_on"))
    first = F.coalesce("seed.first_seen", "run_date")
    g = line.groupBy(*JOB).agg(F.min(first).alias("first_seen"), F.max("run_date").alias("last_seen"),
                               F.max(last_change).alias("changed_at"), last.alias("s"))
    return g.select(*JOB, "first_seen", "last_seen", "changed_at", "s.*").withColumnRenamed(
        "end_status", "status").withColumnRenamed("missed", "missing_count")


def expire(state: DataFrame, today: Column) -> DataFrame:
    """A trusted closing date still closes records whose source was not read."""
    due = ((F.col("deadline_type") == "closing") & (F.col("deadline") < today)
           & (F.col("status") != "closed"))
    return state.withColumn("expired", F.coalesce(due, F.lit(False))).withColumn(
        "status", F.when(F.col("expired"), "closed").otherwise(F.col("status")))
