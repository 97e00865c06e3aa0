"""Streaming health: transitions by signature on keyed state, staleness by session windows."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V

EVENTS = "event_id string, source_id bigint, created_at string, status string, severity string, capability string, change string"


class Transitions(StatefulProcessor):
    """Keeps one source's last signature; a run that differs from it is an event.

    Rows reach it as one per source and run, so a key's batch is as long as its calendar whatever the
    volume of events behind it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "signature string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r.run_date):
            if r.signature != before and not (before is None and r.status == "ok"):
                yield Row(event_id=f"health:{key[0]}:{r.run_date}:{r.signature}", source_id=key[0], created_at=r.run_date,
                          status=r.status, severity=r.severity, capability=r.capability,
                          change="recovered" if r.status == "ok" else "started" if before is None else "changed")
            before = r.signature
        self.last.update((before,))

    def close(self) -> None:
        pass


def transitions(health: DataFrame) -> DataFrame:
    """Health events of a stream of runs with signature, status, severity and capability."""
    return health.select("source_id", "run_date", "signature", "status", "severity", "capability").groupBy(
        "source_id").transformWithState(Transitions(), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def stale_spells(runs: DataFrame, hours: int = V.STALE_AFTER_HOURS) -> DataFrame:
    """source_id, last_listing and stale_from (milliseconds) of every time a source went stale.

    ``runs`` are closed runs of a watermarked stream; only complete listings keep a source fresh.  A listing counts
    from the end of its run, when it is known to be whole.

    Listings at most ``hours`` apart are one session.  It ends when the watermark has passed its last listing by that time, whether the
    source lists again later or says nothing more, and is told once.  The state is one row per fresh source; no Python, no timer per source.
    """
    whole = runs.where("listing_complete").select("source_id", F.window_time("w").alias("at"), F.unix_millis("w.end").alias("listed"))
    spells = whole.groupBy("source_id", F.session_window("at", f"{hours} hours")).agg(F.max("listed").alias("last_listing"))
    return spells.select("source_id", "last_listing", (F.col("last_listing") + hours * 3_600_000).alias("stale_from"))


def daily_health(events: DataFrame) -> DataFrame:
    """Health of each source per local day (days start at 16:00 UTC) of a watermarked stream, once the day is closed."""
    w = F.window("ts", "1 day", "1 day", "16 hours")
    per_day = events.groupBy(w.alias("w"), "source_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    ratio = F.round(F.col("bad") / F.col("n"), 4)
    return per_day.select(
        "source_id", F.to_date(F.col("w.start") + F.expr("INTERVAL '8' HOUR")).cast("string").alias("day"),
        F.when(ratio <= 0.15, "ok").when(ratio <= 0.25, "partial").otherwise("error").alias("status"),
        ratio.alias("err_ratio"), F.col("w.end").alias("closed_at"))
