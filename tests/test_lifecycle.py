"""Life-cycle scenarios on hand-made observations."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from listingflow.operators import crawl, generations, landing, lifecycle, listing, pages, publish, reconcile

D0 = dt.date(2026, 9, 1)
OBS = ("source_id bigint, job_key int, run_date date, event_id bigint, title string, value double, department string, "
       "posted_date date, deadline_type string, deadline date, detail_complete boolean, source_closed boolean, "
       "description string, match_text string, employment_type string, deadline_raw string, listing_fingerprint string, "
       "detail_refresh_failed boolean")
RUNS = "source_id bigint, run_date date, n_jobs bigint, listing_complete boolean"


def day(n):
    return D0 + dt.timedelta(days=n)


def seen(job, n, complete=True, title="Lecturer", department="Arts", posted=None, kind="unknown", deadline=None,
         closed=False, source=1, text="Duties", match="m", work="part-time", raw=None, finger="f", failed=False):
    return (source, job, day(n), n, title, 1.0, department, posted, kind, deadline, complete, closed,
            text, match, work, raw, finger, failed)


def state_of(spark, obs, runs):
    o, r = spark.createDataFrame(obs, OBS), listing.volume_fold(spark.createDataFrame(runs, RUNS))
    rows = lifecycle.current_state(lifecycle.timeline(o, r)).collect()
    return {row["job_key"]: row for row in rows}


def run(n, jobs=2, complete=True, source=1):
    return (source, day(n), jobs, complete)


def test_missing_needs_three_proven_listings(spark):
    obs = [seen(1, 0)] + [seen(2, n) for n in range(5)]
    for last, status in ((2, "open"), (3, "missing")):
        s = state_of(spark, [o for o in obs if o[2] <= day(last)], [run(n) for n in range(last + 1)])
        assert (s[1]["missing_count"], s[1]["status"]) == (last, status)


def test_unproven_listings_neither_count_nor_reset(spark):
    runs = [run(0), run(1), run(2, complete=False), run(3, complete=False), run(4)]
    s = state_of(spark, [seen(1, 0)] + [seen(2, n) for n in range(5)], runs)
    assert s[1]["missing_count"] == 2 and s[1]["status"] == "open"


def test_sight_resets_absence(spark):
    obs = [seen(1, 0), seen(1, 5)] + [seen(2, n) for n in range(6)]
    s = state_of(spark, obs, [run(n) for n in range(6)])
    assert s[1]["missing_count"] == 0 and s[1]["status"] == "open"


def test_volume_drop_is_recursive(spark):
    counts = [10, 3, 3, 5, 1, 2]
    r = spark.createDataFrame([run(n, c) for n, c in enumerate(counts)], RUNS)
    rows = listing.volume_fold(r).orderBy("run_date").collect()
    # 3 of 10 stays untrusted for ever; 5 is accepted, then 1 of 5 is a drop and 2 of 5 is not.
    assert [x["accepted"] for x in rows] == [True, False, False, True, False, True]
    assert [x["reference"] for x in rows] == [0, 10, 10, 10, 5, 5]


def test_empty_listing_needs_proof(spark):
    r = spark.createDataFrame([run(0, 3), run(1, 0), run(2, 0)], RUNS).withColumn(
        "explicit_empty", F.col("run_date") == day(2))
    rows = listing.volume_fold(r).orderBy("run_date").collect()
    assert [x["accepted"] for x in rows] == [True, False, True]


@pytest.mark.parametrize("kind", ["unknown", "screening-or-closing"])
def test_incomplete_read_keeps_verified_fields(spark, kind):
    old = seen(1, 0, posted=day(-9), kind="closing", deadline=day(1))
    new = seen(1, 3, complete=False, title="?", department="", kind=kind)
    s = state_of(spark, [old, new], [run(0, 1), run(3, 1)])[1]
    assert (s["title"], s["department"], s["posted_date"], s["deadline"]) == ("Lecturer", "Arts", day(-9), day(1))
    assert s["status"] == "closed" and s["detail_verified_at"] == day(0)


def test_complete_read_may_blank_a_field(spark):
    s = state_of(spark, [seen(1, 0), seen(1, 1, department="")], [run(0, 1), run(1, 1)])[1]
    assert s["department"] == ""


def test_closure_survives_incomplete_reads_only(spark):
    base = [seen(1, 0, closed=True), seen(1, 1, complete=False)]
    runs = [run(n, 1) for n in range(3)]
    assert state_of(spark, base, runs[:2])[1]["status"] == "closed"
    assert state_of(spark, base + [seen(1, 2)], runs)[1]["status"] == "open"


def test_deadline_day_is_open(spark):
    for n, status in ((4, "open"), (5, "closed")):
        s = state_of(spark, [seen(1, n, kind="closing", deadline=day(4))], [run(n, 1)])[1]
        assert s["status"] == status
    state = spark.createDataFrame([(1, "closing", day(4), "open"), (2, "review", day(4), "open")],
                                  "id int, deadline_type string, deadline date, status string")
    for today, first in ((4, "open"), (5, "closed")):
        got = {r["id"]: r["status"] for r in lifecycle.expire(state, F.lit(day(today))).collect()}
        assert got == {1: first, 2: "open"}


def test_closed_outranks_missing(spark):
    obs = [seen(1, 0, kind="closing", deadline=day(5))] + [seen(2, n) for n in range(8)]
    o = spark.createDataFrame(obs, OBS)
    runs = listing.volume_fold(spark.createDataFrame([run(n) for n in range(8)], RUNS))
    line = lifecycle.timeline(o, runs)
    log = lifecycle.change_history(line).filter("job_key = 1 AND kind = 'status'").orderBy("at").collect()
    assert [(r["at"], r["changes"][0]["before"], r["changes"][0]["after"]) for r in log] == [
        (day(3), "open", "missing"), (day(6), "missing", "closed")]


def test_baseline_then_new(spark):
    obs = [seen(1, 0), seen(1, 1), seen(2, 1)]
    runs = listing.volume_fold(spark.createDataFrame([run(0, 1), run(1, 2)], RUNS))
    log = lifecycle.change_history(lifecycle.timeline(spark.createDataFrame(obs, OBS), runs))
    assert {(r["job_key"], r["kind"]) for r in log.collect()} == {(1, "baseline"), (2, "new")}


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    obs = [seen(j, n, complete=(n + j) % 3 > 0, title=f"t{n % 2}", kind="closing" if j % 2 else "unknown",
                deadline=day(j)) for j in range(8) for n in range(0, 9, 1 + j % 3)]
    runs = listing.volume_fold(spark.createDataFrame([run(n, 8, n % 4 > 0) for n in range(9)], RUNS))
    first = lifecycle.current_state(lifecycle.timeline(spark.createDataFrame(obs, OBS), runs))
    second = lifecycle.current_state(lifecycle.timeline(
        spark.createDataFrame(obs[::-1], OBS).repartition(5, F.rand(3)), runs.repartition(4)))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_zero_rows_are_no_fault_of_a_manual_source(spark):
    r = spark.createDataFrame([run(0, 3), run(1, 0)], RUNS)
    for capability, guarded in (("full", True), ("list_only", True), ("manual", False), ("pending", False), (None, True)):
        rows = listing.volume_fold(r.withColumn("capability", F.lit(capability).cast("string"))).orderBy("run_date").collect()
        assert (rows[1]["accepted"], rows[1]["guarded"]) == (False, guarded), capability


@pytest.mark.parametrize("says_empty, kind", [(True, "new"), (False, "baseline")])
def test_only_a_stated_empty_list_uses_the_baseline_up(spark, says_empty, kind):
    runs = spark.createDataFrame([run(0, 0), run(1, 1)], RUNS).withColumn(
        "explicit_empty", F.lit(says_empty) & (F.col("run_date") == day(0)))
    line = lifecycle.timeline(spark.createDataFrame([seen(1, 1)], OBS), listing.volume_fold(runs))
    assert [r["kind"] for r in lifecycle.change_history(line).collect()] == [kind]


def test_stated_empty_lists_count_as_absence(spark):
    runs = spark.createDataFrame([run(0, 1), run(1, 0), run(2, 0), run(3, 0)], RUNS).withColumn(
        "explicit_empty", F.col("n_jobs") == 0)
    line = lifecycle.timeline(spark.createDataFrame([seen(1, 0)], OBS), listing.volume_fold(runs))
    state = lifecycle.current_state(line).first()
    assert (state["missing_count"], state["status"], state["missing_on"]) == (3, "missing", day(3))


def test_all_carried_fields(spark):
    old = seen(1, 0, kind="closing", deadline=day(9), raw="by day 9")
    new = seen(1, 1, complete=False, text="", match="", work="unknown", finger=None, failed=True)
    again = seen(1, 2, complete=False, text="x", finger="g")
    s = state_of(spark, [old, new, again], [run(n, 1) for n in range(3)])[1]
    assert (s["description"], s["match_text"], s["employment_type"], s["deadline_raw"]) == (
        "Duties", "m", "part-time", "by day 9")
    assert s["listing_fingerprint"] == "g" and s["detail_refresh_failed"]
    s = state_of(spark, [old, new, again, seen(1, 3, text="")], [run(n, 1) for n in range(4)])[1]
    assert s["description"] == "" and not s["detail_refresh_failed"] and s["listing_fingerprint"] == "f"


@pytest.mark.parametrize("change, fields", [({"text": "Other"}, ["description"]), ({"work": "full-time"}, ["employment_type"]),
                                            ({"match": "n"}, []), ({"raw": "soon"}, []), ({"finger": "g"}, None)])
def test_which_fields_make_an_update(spark, change, fields):
    runs = listing.volume_fold(spark.createDataFrame([run(0, 1), run(1, 1)], RUNS))
    obs = spark.createDataFrame([seen(1, 0), seen(1, 1, **change)], OBS)
    log = lifecycle.change_history(lifecycle.timeline(obs, runs)).filter("kind = 'updated'").collect()
    assert [[c["field"] for c in r["changes"]] for r in log] == ([] if fields is None else [fields])


def test_closing_date_between_runs_and_beyond_the_calendar(spark):
    obs = [seen(1, 0, kind="closing", deadline=day(2)), seen(2, 0, kind="closing", deadline=day(90))]
    runs = listing.volume_fold(spark.createDataFrame([run(0), run(5, complete=False), run(7), run(8)], RUNS))
    line = lifecycle.timeline(spark.createDataFrame(obs, OBS), runs)
    got = {r["job_key"]: (r["status"], r["closed_on"]) for r in lifecycle.current_state(line).collect()}
    assert got == {1: ("closed", day(7)), 2: ("open", None)}


def test_life_cycle_has_no_calendar_arrays(spark):
    line = lifecycle.timeline(spark.createDataFrame([seen(1, 0)], OBS),
                              listing.volume_fold(spark.createDataFrame([run(0)], RUNS)))
    assert not [f.name for f in line.schema.fields if f.dataType.typeName() == "array"]


def test_reuse_needs_a_body_and_brings_the_cached_fields(spark):
    kinds = {"description": "string", "detail_complete": "boolean", "refresh_failed": "boolean", "source_closed": "boolean",
             "status": "string", "fingerprint": "string", "detail_verified_at": "date", "deadline": "date",
             "deadline_type": "string", "title": "string", "department": "string", "match_text": "string",
             "employment_type": "string", "posted_date": "date", "deadline_raw": "string"}

    def old(text):
        return (text, True, False, False, "open", "f", day(0), None, "unknown", "Stored", "Arts", "m", "part-time", None, None)

    row = (1, "f", "Listed", "", None, "", "unknown", None, None, "unknown", None, None, False, True)
    shape = ("id int, fingerprint string, title string, department string, description string, match_text string, "
             "employment_type string, posted_date date, deadline date, deadline_type string, deadline_raw string, "
             "detail_verified_at date, detail_complete boolean, detail_refresh_failed boolean, old struct<"
             + ", ".join(f"{k}: {v}" for k, v in kinds.items()) + ">")
    rows = spark.createDataFrame([(*row, old("Body")), (2, *row[1:], old("")), (3, *row[1:], None)], shape)
    out = reconcile.with_cached_detail(rows, F.lit(day(1)), F.lit(7)).orderBy("id").collect()
    assert [(r["detail_from_cache"], r["title"], r["description"], r["detail_complete"], r["detail_refresh_failed"])
            for r in out] == [(True, "Stored", "Body", True, False), (False, "Listed", None, False, True),
                              (False, "Listed", None, False, True)]


def test_upsert_from_empty_state(spark):
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "source_id int, job_key int, title string")
    rows = reconcile.upsert(batch.limit(0), batch, ["source_id", "job_key"], ["title"]).collect()
    assert {r["action"] for r in rows} == {"insert"}
    again = reconcile.upsert(batch, batch, ["source_id", "job_key"], ["title"]).collect()
    assert {r["action"] for r in again} == {"keep"}


def test_generation_switch_is_the_last_step(spark, tmp_path):
    root = str(tmp_path / "state")
    one = spark.createDataFrame([(1,)], "id int")
    first = generations.publish(root, {"state": one}, "g1", None)
    # A job lost before its manifest leaves files nobody reads.
    one.union(one).write.parquet(root + "/data/1-lost/state")
    assert generations.read(spark, root, "state").count() == 1
    held = generations.read(spark, root, "state")
    assert generations.publish(root, {"state": held.union(one).union(one)}, "g2", first) == 1
    assert generations.read(spark, root, "state").count() == 3
    with pytest.raises(generations.GenerationConflict):  # built from the first one, which has a successor by now
        generations.publish(root, {"state": one}, "g2b", first)
    assert generations.read(spark, root, "state").count() == 3 and generations.read(spark, root, "state", first).count() == 1
    with pytest.raises(LookupError):
        generations.read(spark, str(tmp_path / "nothing"), "state")


def test_publication_of_unequal_generations_or_half_a_table_is_not_consistent(spark):
    table = lambda rows: spark.createDataFrame(rows, "id string, generation_id string")
    meta = lambda n, g="g1": spark.createDataFrame([(n, g)], "total_jobs long, generation_id string")
    good, feed = table([("a", "g1"), ("b", "g1")]), table([("a", "g1")])
    judge = lambda *t: publish.proof(*t).first().consistent
    assert judge(good, feed, meta(2)) and judge(good, feed.limit(0), meta(2)) and judge(good.limit(0), feed.limit(0), meta(0))
    assert not judge(good, table([("a", "g0")]), meta(2)) and not judge(good, feed, meta(2, "g2")) and not judge(good, feed, meta(3))
    assert not judge(good, table([("c", "g1")]), meta(2)) and not judge(good.union(good), feed, meta(4))


def test_one_day_is_read_from_its_own_files(spark, tmp_path):
    rows = spark.createDataFrame([(d, k) for d in range(5) for k in range(4)], "d int, k int")
    held = landing.land(rows, str(tmp_path / "days"), "d", "k")
    earlier, batch = landing.split_at(held, "d", landing.newest_day(held, "d"))
    assert earlier.count() == 16 and batch.count() == 4 and all("/d=4/" in f for r in batch.select("_metadata.file_path").collect() for f in r)
    assert "PartitionFilters: [isnotnull(d" in batch._jdf.queryExecution().executedPlan().toString()


def test_crawl_ends_at_cycles_and_goes_on_where_it_stopped(spark, tmp_path):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("x", "y"), ("c", None)], "url string, target string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "target string")
    rows = lambda df: sorted((r.target, r.depth, r.complete) for r in df.collect())
    assert rows(crawl.discover(links, seeds, 2, str(tmp_path / "c"))) == [("a", 0, False), ("b", 1, False), ("c", 2, False)]
    assert rows(crawl.discover(links, seeds, 9, str(tmp_path / "c"))) == [("a", 0, True), ("b", 1, True), ("c", 2, True), ("d", 3, True)]
    assert rows(crawl.discover(links, seeds.limit(0))) == []


def test_literals_end_at_their_own_bracket(spark):
    big = "x" * 1_000_000
    cases = [('{"a":"}"}rest', '{"a":"}"}'), ('[[1],[2]] ]', '[[1],[2]]'), ('{"q":"\\"}{"}', '{"q":"\\"}{"}'), ('{"q":"\\\\"}x', '{"q":"\\\\"}'),
             ('{"open":[1}', None), ('{"open":"', None), ('{"b":"' + big + '"} tail {', '{"b":"' + big + '"}'), ('{"e":"' + '\\"' * 50_000 + '"}', '{"e":"' + '\\"' * 50_000 + '"}')]
    frame = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.p for r in frame.select("i", pages.balanced_prefix(F.col("t")).alias("p")).collect()}
    for i, (text, want) in enumerate(cases):
        if i != 4:  # a closing brace of the wrong kind closes the count; the JSON check refuses it
            assert got[i] == want, text[:40]
    made = pages.assigned_literals(frame.select(F.col("i").alias("page_id"), F.concat(F.lit("v = "), "t").alias("html")), "v")
    assert {r.page_id for r in made.where("reject IS NOT NULL").collect()} == {4, 5}
