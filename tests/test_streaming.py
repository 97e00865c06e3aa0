"""Streams against their batch twins: many batches, repeats and late runs."""
import datetime as dt

from pyspark.sql import functions as F

from listingflow import fixtures as X
from listingflow.operators import lifecycle, listing
from listingflow.streaming.reconcile import StreamingState



def place():
    return F.expr("user_id % 10"), F.to_date("ts")


T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, days):
    kinds = ["view", "click", "error", "purchase", "signup"]
    rows = [(n * 100 + i, T0 + dt.timedelta(days=n, minutes=i), (i * 7 + n) % 30, kinds[(i * i + n) % 5], float(i),
             '{"k": %d}' % ((i * 13 + n * 5) % 40)) for n in days for i in range(60)]
    return spark.createDataFrame(rows, EVENTS)


def batch_state(e):
    runs = listing.volume_fold(X.run_evidence(e))
    return lifecycle.current_state(lifecycle.timeline(X.observations(e), runs))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_daily_batches_equal_one_batch(spark, tmp_path):
    state = StreamingState(spark, str(tmp_path / "s"), X.observations, X.run_evidence, *place())
    for batch_id, days in enumerate(([0, 1], [2], [3, 4, 5], [6, 7])):
        state.apply(events(spark, days), batch_id)
        state.apply(events(spark, days), batch_id)      # delivered again after a failure
    expected = batch_state(events(spark, range(8)))
    got = state.read("state").select(expected.columns)
    # The run calendar of a source grows with it, so both hold the same dates.
    assert rows(got) == rows(expected)


def test_late_runs_are_counted_and_ignored(spark, tmp_path):
    state = StreamingState(spark, str(tmp_path / "s"), X.observations, X.run_evidence, *place())
    state.apply(events(spark, [0, 1, 2]), 0)
    before = rows(state.read("state"))
    state.apply(events(spark, [1]), 1)
    assert rows(state.read("state")) == before
    late = {r["late"]: r["n"] for r in state.late_counts().groupBy("late").agg(F.sum("n").alias("n")).collect()}
    assert late[True] == X.observations(events(spark, [1])).count()


def test_a_run_in_two_batches_equals_one_batch(spark, tmp_path):
    state = StreamingState(spark, str(tmp_path / "s"), X.observations, X.run_evidence, *place())
    whole = events(spark, range(5))
    for batch_id, hours in enumerate(("event_id < 130", "event_id BETWEEN 130 AND 220", "event_id > 220 AND event_id < 431", "event_id >= 431")):
        state.apply(whole.filter(hours), batch_id)
    expected = batch_state(whole)
    assert rows(state.read("state").select(expected.columns)) == rows(expected)
    assert not state.late_counts().filter("late").count()


def test_uncommitted_batch_is_not_read(spark, tmp_path):
    root = str(tmp_path / "s")
    state = StreamingState(spark, root, X.observations, X.run_evidence, *place())
    state.apply(events(spark, [0]), 0)
    before = rows(state.read("state"))
    state.read("state").limit(0).write.parquet(root + "/batch=1/state")     # lost before its commit
    assert rows(state.read("state")) == before
    state.apply(events(spark, [1]), 1)
    assert rows(state.read("state")) == rows(batch_state(events(spark, [0, 1])).select(state.read("state").columns))


def landed(spark, folder, make, steps):
    """What a stream gives over files that land step by step."""
    from listingflow.streaming.runner import add_to_table, stream_of, utc_events, with_rocksdb
    with with_rocksdb(spark):
        for step in steps:
            step.write.mode("append").parquet(str(folder / "in"))
            e = utc_events(stream_of(spark, str(folder / "in"), step)).withWatermark("ts", "1 hour")
            out = add_to_table(make(e), str(folder / "out"), [])
    return out


def test_a_source_that_stops_or_never_lists_goes_stale_once(spark, tmp_path):
    from listingflow.streaming import health
    at = lambda day: T0 + dt.timedelta(days=day, hours=3)
    row = lambda n, day, user, kind: (n, at(day), user, kind, 0.0, '{"k": 1}')
    # 1 lists every day, 2 stops after day 1, 3 never lists whole, 4 misses days 2 and 3, 5 lists again within the time
    step = lambda days: spark.createDataFrame([row(day * 10 + u, day, u, kind) for day in days for u, kind in (
        (1, "view"), (2, "view" if day < 2 else None), (3, "error"), (4, "error" if day in (2, 3) else "view"),
        (5, "view" if day % 2 == 0 or day > 4 else None)) if kind], EVENTS)
    got = landed(spark, tmp_path, lambda e: health.stale_spells(X.stream_runs(e, "user_id")), [step([0, 1]), step([2, 3]), step([4, 5, 6, 7])])
    hours = lambda ms: (ms / 3_600_000 - 24 * 19723)  # 2024-01-01
    found = sorted((r.source_id, hours(r.last_listing), hours(r.stale_from)) for r in got.collect())
    assert found == [(2, 48, 84), (4, 48, 84), (5, 24, 60), (5, 72, 108)]


def test_state_has_no_more_partitions_than_cores(spark):
    """Every partition of every keyed operator costs a store and a worker in each batch, also an empty one."""
    from listingflow.streaming.runner import PARTITIONS, with_rocksdb
    before = spark.conf.get(PARTITIONS)
    try:
        spark.conf.set(PARTITIONS, "200")
        with with_rocksdb(spark):
            assert int(spark.conf.get(PARTITIONS)) == max(spark.sparkContext.defaultParallelism, 8)
        assert spark.conf.get(PARTITIONS) == "200"
    finally:
        spark.conf.set(PARTITIONS, before)


def test_staleness_needs_no_python_worker(spark, tmp_path):
    from listingflow.streaming import health
    from listingflow.streaming.runner import stream_of, utc_events
    step = events(spark, range(2))
    step.write.parquet(str(tmp_path / "in"))
    e = utc_events(stream_of(spark, str(tmp_path / "in"), step)).withWatermark("ts", "1 hour")
    plan = health.stale_spells(X.stream_runs(e, "user_id"))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan


def test_reconcile_covers_the_last_day(spark, tmp_path):
    from listingflow.plans.streams import stream_reconcile
    whole = events(spark, [8, 9, 20])
    whole.write.parquet(str(tmp_path / "events.parquet"))
    got = stream_reconcile(spark, str(tmp_path)).select("source_id", "job_key", "last_seen", "status")
    expected = batch_state(whole).selectExpr("source_id", "job_key", "CAST(last_seen AS STRING) AS last_seen", "status")
    assert rows(got) == rows(expected)
    assert got.filter("last_seen = '2024-01-21'").count()


def test_runs_without_rows_are_known_by_their_reports(spark):
    e = events(spark, [3, 4, 7])
    # a report beside rows is no record and changes nothing of its run
    beside = spark.createDataFrame([(None, T0 + dt.timedelta(days=4, hours=5), u, X.REPORT, None, '{"explicit_empty": true, "listing_complete": true}')
                                    for u in range(10)], EVENTS)
    fields = ["source_id", "run_date", "n_jobs", "err_ratio", "listing_complete", "explicit_empty", "capability"]
    got = X.stream_runs(e.unionByName(X.zero_run_reports(e)).unionByName(beside)).select(fields)
    assert rows(got) == rows(X.with_zero_runs(X.run_evidence(e)).select(fields))
    assert {(r.listing_complete, r.explicit_empty) for r in got.filter("n_jobs = 0").collect()} == {(True, True), (True, False), (False, False)}


def test_stream_health_covers_runs_without_rows_and_the_last_day(spark, tmp_path):
    from listingflow.operators import health
    from listingflow.plans.streams import stream_health
    # the sources of odd number stop after the first day
    whole = events(spark, [8, 9, 20]).filter("user_id % 2 = 0 OR ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    whole.write.parquet(str(tmp_path / "events.parquet"))
    got = stream_health(spark, str(tmp_path))
    state = health.graded(listing.volume_fold(X.with_errors(X.with_zero_runs(X.run_evidence(whole)))))
    expected = health.transitions(state).withColumn("created_at", F.col("created_at").cast("string")).select(got.columns)
    assert rows(got) == rows(expected)
    found = {(r.source_id, r.created_at, r.status) for r in got.collect()}
    assert {s for s, at, status in found if status == "error" and at < "2024-01-09"}      # found nothing before its first row
    assert {s for s, at, _ in found if s % 2 and at > "2024-01-09"}                       # after its last one
    assert {s for s, at, _ in found if at > "2024-01-20"}
