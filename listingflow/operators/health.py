"""Source health: severity table, state labels, transitions and daily digests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import escape_markdown


def severity_and_status(guarded: Column, listing_complete: Column, complete: Column, capability: Column,
                        n_jobs: Column, batch_severity: Column | None = None) -> Column:
    """Struct (severity, status) by the decision order of a reconcile."""
    silent = capability.isin(*V.SILENT_CAPABILITIES)
    limited = silent | (listing_complete & capability.isin("list_only", "partial"))
    given = batch_severity if batch_severity is not None else F.lit(None).cast("string")
    raw = (F.when(guarded | (~listing_complete & ~silent), "error")
           .when(given.isin("ok", "warning", "error"), given)
           .when(complete, "ok").when(limited, "warning").otherwise("error"))
    severity = F.when((raw == "ok") & ~complete,
                      F.when(listing_complete, "warning").otherwise("error")).otherwise(raw)
    base = (F.when(complete, "ok").when((n_jobs > 0) | listing_complete, "partial").otherwise("error"))
    return F.struct(severity.alias("severity"),
                    F.when((severity == "warning") & silent, capability).otherwise(base).alias("status"))


def graded(runs: DataFrame) -> DataFrame:
    """Judged runs with severity, status and signature; they hold accepted, guarded, err_ratio, capability, n_jobs, errors."""
    whole = F.col("accepted")
    verdict = severity_and_status(F.col("guarded"), whole, whole & (F.col("err_ratio") <= 0.15), F.col("capability"), F.col("n_jobs"))
    h = runs.withColumn("v", verdict).withColumn("severity", F.col("v.severity")).withColumn("status", F.col("v.status"))
    return h.withColumn("signature", signature(F.col("status"), F.col("severity"), F.col("capability"), F.col("errors"))).drop("v")


def state_label(enabled: Column, status: Column, capability: Column, severity: Column,
                listing_complete: Column, last_listing: Column, last_success: Column, now: Column) -> Column:
    """Label shown for a source: faults first, then manual/pending, staleness, coverage.

    Listing freshness counts; details need never have been complete.  Rows without an
    explicit severity or listing flag fall back to their status.
    """
    success = F.coalesce(last_listing, last_success)
    age_s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(success.cast("timestamp"))
    stale = success.isNotNull() & (age_s > V.STALE_AFTER_HOURS * 3600)
    return (F.when(~enabled, "pending")
            .when((severity == "error") | (status == "error"), "error")
            .when(capability.isin(*V.SILENT_CAPABILITIES), capability)
            .when(stale, "stale")
            .when(status == "ok", "ok")
            .when(F.coalesce(listing_complete, F.lit(False)) & capability.isin("list_only", "partial"), "limited")
            .otherwise("partial"))


def signature(status: Column, severity: Column, capability: Column, errors: Column) -> Column:
    """Short hash of what makes a health state different; counts and times do not."""
    error_set = F.array_join(F.array_sort(F.array_distinct(errors)), "|")
    return F.substring(F.sha2(F.array_join(F.array(status, severity, capability, error_set), "\x1f"), 256), 1, 16)


def transitions(health: DataFrame) -> DataFrame:
    """Health events: one row per source run whose signature differs from the run before."""
    w = Window.partitionBy("source_id").orderBy("run_date")
    h = health.withColumn("before", F.lag("signature").over(w))
    first = F.col("before").isNull()
    changed = ~F.col("signature").eqNullSafe(F.col("before")) & ~(first & (F.col("status") == "ok"))
    return h.filter(changed).select(
        F.concat_ws(":", F.lit("health"), "source_id", F.col("run_date").cast("string"), "signature").alias("event_id"),
        "source_id", "institution", F.col("run_date").alias("created_at"), "status", "severity", "capability",
        "errors", F.when(F.col("status") == "ok", "recovered").when(first, "started").otherwise("changed").alias("change"))


def settle_pending(events: DataFrame, current: DataFrame) -> DataFrame:
    """Newest pending event per source stays; older ones are superseded, and a source that
    is well again resolves an event that does not itself report the recovery."""
    newest = events.groupBy("source_id").agg(
        F.max(F.struct("created_at", "event_id")).alias("newest"))
    now = current.select("source_id", F.col("status").alias("now_status"))
    joined = events.join(newest, "source_id").join(now, "source_id", "left")
    state = (F.when(F.col("newest.event_id") != F.col("event_id"), "superseded")
             .when((F.col("now_status") == "ok") & (F.col("change") != "recovered"), "resolved")
             .otherwise("pending"))
    return joined.withColumn("state", state).drop("newest", "now_status")


def digests(health: DataFrame, events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Digest of every delivery attempt, in the order of the attempts.

    ``health`` has one row per source and run day, ``events`` its transitions, ``attempts`` one row per attempt: number
    (``attempt``, rising with time), ``day``, the last run day it knows of (``as_of``) and whether it was ``acked``.

    An event goes into the digests of its source's newest event until one of them is acknowledged.  The first acknowledged
    digest of a day names all problems; later ones of that day only the sources that changed, and only if one did.
    An attempt without problems and recoveries gives none.  A digest that was not acknowledged is replaced by the next one
    of the same id or superseded by any other attempt.  Work: sources times days and attempts, both bounded.
    """
    w = Window.partitionBy("source_id").orderBy("run_date")
    found = health.select("source_id", "run_date", "status", "institution").join(
        events.select("source_id", F.col("created_at").alias("run_date"), F.struct("event_id", "created_at", "change").alias("event")),
        ["source_id", "run_date"], "left")
    last_known = attempts.agg(F.max("as_of")).scalar()
    spans = (found.withColumn("newest", F.last("event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("next_run", F.lead("run_date").over(w)).withColumn("last_known", last_known))
    until = F.coalesce(F.date_sub("next_run", 1), F.col("last_known"))
    known = spans.where(until >= F.col("run_date")).select(
        "source_id", "status", "newest", F.explode(F.sequence("run_date", until)).alias("as_of"))
    before = Window.orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    seen = attempts.withColumn("acked_as_of", F.max(F.when(F.col("acked"), F.col("as_of"))).over(before))
    rows = seen.join(known, "as_of")
    well = F.col("status") == "ok"
    recovered = F.col("newest.change") == "recovered"
    unsent = F.col("newest").isNotNull() & (F.col("acked_as_of").isNull() | (F.col("newest.created_at") > F.col("acked_as_of")))
    rows = rows.withColumn("turned", F.coalesce(unsent & ~(well & ~recovered), F.lit(False))).withColumn(
        "back", F.col("turned") & recovered)
    per = rows.groupBy("attempt", "day", "acked").agg(
        F.count_if(~well).alias("n_all"), F.count_if(~well & F.col("turned")).alias("n_changed"), F.count_if("back").alias("n_recoveries"),
        F.array_sort(F.collect_list(F.when(F.col("turned"), F.col("newest.event_id")))).alias("events"))
    spoke = F.col("acked") & ((F.col("n_all") > 0) | (F.col("n_recoveries") > 0))
    same_day = Window.partitionBy("day").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("daily_sent", F.coalesce(F.max(spoke).over(same_day), F.lit(False)))
    made = per.where(((F.col("n_all") > 0) | (F.col("n_recoveries") > 0)) & ~(F.col("daily_sent") & (F.size("events") == 0)))
    made = made.withColumn("summary_id", aggregate_id(F.col("day"), F.col("daily_sent"), F.col("events")))
    again = F.lead("attempt").over(Window.partitionBy("summary_id").orderBy("attempt")).isNotNull()
    made = made.withColumn("final", attempts.agg(F.max("attempt")).scalar())
    outcome = (F.when(F.col("acked"), "sent").when(again, "replaced")
               .when(F.col("attempt") < F.col("final"), "superseded").otherwise("pending"))
    return made.select(
        "attempt", "day", "summary_id", F.when(F.col("daily_sent"), "health_changes").otherwise("health_digest").alias("kind"),
        F.when(F.col("daily_sent"), F.col("n_changed")).otherwise(F.col("n_all")).alias("n_problems"), "n_recoveries", "events",
        outcome.alias("outcome"))


def digest_lines(health: DataFrame, events: DataFrame) -> DataFrame:
    """Lines of each daily digest in order: recoveries, then problems, errors first."""
    problems = health.filter((F.col("status") != "ok") & F.col("status").isNotNull()).select(
        F.col("run_date").alias("day"), F.lit(1).alias("part"),
        F.when(F.col("severity") == "error", 0).otherwise(1).alias("grade"), "institution", "source_id",
        _problem_line().alias("line"))
    recoveries = events.filter("change = 'recovered'").select(
        F.col("created_at").alias("day"), F.lit(0).alias("part"), F.lit(0).alias("grade"), "institution",
        "source_id", F.concat(F.lit(V.RECOVERED_MARK), escape_markdown(F.col("institution"), 55),
                              F.lit(V.RECOVERED_TEXT)).alias("line"))
    return recoveries.unionByName(problems)


def _problem_line() -> Column:
    label = F.coalesce(F.element_at(F.create_map(*[
        F.lit(x) for kv in V.CAPABILITY_LABELS.items() for x in kv]), F.col("capability")), F.lit(""))
    reason = F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit(V.NO_REASON))
    return F.concat(
        F.when(F.col("severity") == "error", V.ERROR_MARK).otherwise(V.NOTICE_MARK),
        escape_markdown(F.col("institution"), 45), F.lit("："),
        F.when(label != "", F.concat(label, F.lit("；"))).otherwise(""), escape_markdown(reason, 85))


def within_budget(lines: DataFrame, header_length: Column, limit: int = V.DIGEST_LIMIT) -> DataFrame:
    """Lines of a digest that fit before the first overflow; later short lines stay out.

    All lines come back, with ``included``; a day has at most two lines per source.
    """
    order = [F.col("part"), F.col("grade"), F.col("institution"), F.col("source_id")]
    counted = lines.groupBy("day").agg(F.count("*").alias("n_lines"),
                                       F.count_if(F.col("part") == 1).alias("n_problems"),
                                       F.count_if(F.col("part") == 0).alias("n_recoveries"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(*order))
    front = lines.withColumn("pos", place).join(counted, "day")
    run = Window.partitionBy("day").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    used = header_length + F.sum(F.length("line") + 1).over(run) - 1
    ever = F.max(used > limit).over(run)
    return front.withColumn("included", ~ever)


def digest_header(daily: Column, day: Column) -> Column:
    title = F.when(daily, V.DAILY_TITLE).otherwise(V.CHANGES_TITLE)
    counts = F.format_string(V.DIGEST_COUNTS, F.col("n_problems"), F.col("n_recoveries"))
    return F.concat(title, F.lit("｜"), day.cast("string"), F.lit("\n"), counts)


def digest_messages(lines: DataFrame, daily: bool = True) -> DataFrame:
    """One message per day: header, the lines that fit, how many did not, footer."""
    header = digest_header(F.lit(daily), F.col("day"))
    fitted = within_budget(lines, F.length(header))
    kept = fitted.groupBy("day", "n_lines", "n_problems", "n_recoveries").agg(
        F.array_sort(F.collect_list(F.when(F.col("included"), F.struct("pos", "line")))).alias("kept"))
    more = F.col("n_lines") - F.size("kept")
    body = F.concat(
        header, F.array_join(F.transform("kept", lambda k: F.concat(k["line"], F.lit("\n"))), ""),
        F.when(more > 0, F.format_string(V.DIGEST_MORE, more)).otherwise(""), F.lit(V.DIGEST_FOOTER))
    return kept.select("day", "n_problems", "n_recoveries", F.size("kept").alias("n_shown"), more.alias("n_more"),
                       F.substring(body, 1, V.MESSAGE_LIMIT).alias("content"))


def aggregate_id(day: Column, already_sent: Column, event_ids: Column) -> Column:
    """Digest id per day; after it was sent, the hash of the sorted event ids."""
    joined = F.array_join(F.array_sort(F.array_distinct(event_ids)), "|")
    return F.when(~already_sent, F.concat(F.lit("health-digest:"), day.cast("string"))).otherwise(
        F.concat(F.lit("health-changes:"), F.substring(F.sha2(joined, 256), 1, 20)))


def run_rollup(summaries: DataFrame) -> DataFrame:
    """Status of one run over all its sources."""
    return summaries.groupBy("run_date").agg(
        F.max(F.col("severity") == "error").alias("any_error"),
        F.max(F.col("severity") == "warning").alias("any_warning"), F.count("*").alias("n_sources")).select(
        "run_date", "n_sources", F.when(F.col("any_error"), "partial").when(F.col("any_warning"), "degraded")
        .otherwise("ok").alias("run_status"))
