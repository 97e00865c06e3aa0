"""Outbox and health scenarios."""
import datetime as dt

from pyspark.sql import functions as F

from listingflow.functions import rules
from listingflow.operators import health, outbox

D = dt.date(2026, 9, 1)


def test_pending_or_sent_events_are_not_queued_again(spark):
    state = spark.createDataFrame(
        [("a", True, True, True, "open", D), ("b", True, True, True, "open", D), ("c", True, True, True, "open", D),
         ("d", True, True, True, "open", D), ("e", False, True, True, "open", D), ("f", True, True, False, "open", D),
         ("g", True, True, True, "closed", D)],
        "id string, eligible boolean, matches boolean, detail_complete boolean, status string, last_seen date")
    held = spark.createDataFrame([("new:a", "pending"), ("new:b", "sent"), ("new:c", "suppressed")], "event_id string, state string")
    assert {r["id"] for r in outbox.new_events(state, held).collect()} == {"c", "d"}
    assert {r["id"] for r in outbox.new_events(state).collect()} == {"a", "b", "c", "d"}


def test_gate(spark):
    jobs = spark.createDataFrame([("a", True, "open", True), ("b", True, "open", False), ("c", False, "open", True),
                                  ("d", True, "closed", False)], "id string, matches boolean, status string, detail_complete boolean")
    events = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = {r["id"]: r["decision"] for r in outbox.gate(events, jobs).collect()}
    assert got == {"a": "send", "b": "defer", "c": "suppress", "d": "suppress", "e": "suppress"}


def test_acknowledged_digest_covers_its_pending_events(spark):
    held = spark.createDataFrame([("1", "pending"), ("2", "superseded"), ("3", "pending")], "event_id string, state string")
    acks = spark.createDataFrame([("d1", ["1", "2"]), ("d2", ["1"])], "summary_id string, events array<string>")
    got = {r["event_id"]: (r["state"], r["summary_id"]) for r in outbox.acknowledge(held, acks).collect()}
    assert got == {"1": ("sent", "d1"), "2": ("superseded", None), "3": ("pending", None)}


HEALTH = "source_id int, run_date date, status string, severity string, capability string, errors array<string>, institution string"


def test_transitions_ignore_repeats_and_error_order(spark):
    rows = [(1, D, "ok", "ok", "full", [], "I"), (1, D + dt.timedelta(1), "partial", "error", "full", ["b", "a"], "I"),
            (1, D + dt.timedelta(2), "partial", "error", "full", ["a", "b", "a"], "I"),
            (1, D + dt.timedelta(3), "ok", "ok", "full", [], "I"), (2, D, "error", "error", "full", ["x"], "J")]
    h = spark.createDataFrame(rows, HEALTH).withColumn("signature", health.signature(
        F.col("status"), F.col("severity"), F.col("capability"), F.col("errors")))
    got = {(r["source_id"], r["created_at"], r["change"]) for r in health.transitions(h).collect()}
    assert got == {(1, D + dt.timedelta(1), "changed"), (1, D + dt.timedelta(3), "recovered"), (2, D, "started")}


def test_settling_keeps_the_newest_and_resolves_old_outages(spark):
    events = spark.createDataFrame([("health:z", 1, 1, "changed"), ("health:a", 1, 2, "changed"), ("health:q", 2, 1, "changed"),
                                    ("health:r", 3, 1, "recovered")], "event_id string, source_id int, created_at int, change string")
    now = spark.createDataFrame([(1, "partial"), (2, "ok"), (3, "ok")], "source_id int, status string")
    got = {r["event_id"]: r["state"] for r in health.settle_pending(events, now).collect()}
    assert got == {"health:z": "superseded", "health:a": "pending", "health:q": "resolved", "health:r": "pending"}


def test_digest_stops_at_the_first_overflow(spark):
    rows = [(D, 1, 0, f"i{n:02d}", n, "x" * size) for n, size in enumerate([20, 60, 5, 5])]
    lines = spark.createDataFrame(rows, "day date, part int, grade int, institution string, source_id int, line string")
    got = [r["included"] for r in health.within_budget(lines, F.lit(10), 60).orderBy("pos").collect()]
    assert got == [True, False, False, False]


def test_incomplete_record_without_body_is_not_published_as_match(spark):
    df = spark.createDataFrame([(True, False, ""), (True, False, "text"), (True, True, ""), (False, True, "x")],
                               "m boolean, c boolean, d string")
    got = [r[0] for r in df.select(rules.published_match(F.col("m"), F.col("c"), F.col("d"))).collect()]
    assert got == [False, True, True, False]
