"""Hot keys: exact results from bucketed sums, and plans that keep them apart."""
import io
from contextlib import redirect_stdout

from pyspark.sql import Window, functions as F

from listingflow.operators.running import longest_streaks, range_rank, top_per_key


def hot(spark):
    """One source holds most rows."""
    return spark.range(6000).select(
        F.when(F.col("id") % 5 < 3, 0).otherwise(F.col("id") % 7).alias("source_id"), F.col("id").alias("event_id"),
        (F.col("id") * 7919 % 30).alias("day"), (F.col("id") % 3).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("hex"))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rank_equals_plain_window(spark):
    w = Window.partitionBy("source_id").orderBy("day", "event_id")
    plain = hot(spark).select("event_id", F.row_number().over(w).cast("bigint").alias("r"))
    same(range_rank(hot(spark), [F.col("day"), F.col("event_id")], "r", ["source_id"]).select("event_id", "r"), plain)


def test_rank_over_the_table_orders_numbers_as_numbers_and_keeps_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "k") for i in (2, 9, 10, 11, 100, 3)], "id long, k string")
    got = {r.id: r.r for r in range_rank(rows, [F.col("id")], "r").collect()}
    assert got == {2: 1, 3: 2, 9: 3, 10: 4, 11: 5, 100: 6}
    got = {r.id: r.r for r in range_rank(rows, [F.col("id")], "r", ["k"]).collect()}
    assert got == {2: 1, 10: 2, 11: 3, 100: 4, 3: 1, 9: 2}
    assert range_rank(rows.where("false"), [F.col("id")], "r").count() == 0


def test_streaks_across_ranges(spark):
    bad = lambda s, i: (i % 11 != 0 or 2000 < i < 5000) if s == 0 else i % 4 > 0
    rows = [(r.source_id, r.event_id, bad(r.source_id, r.event_id)) for r in hot(spark).collect()]
    want = {}
    for s in {r[0] for r in rows}:
        best = run = 0
        for _, _, b in sorted(r for r in rows if r[0] == s):
            run = run + 1 if b else 0
            best = max(best, run)
        want[s] = best
    frame = spark.createDataFrame(rows, "source_id long, event_id long, bad boolean").repartition(7)
    assert {r.source_id: r.longest for r in longest_streaks(frame, ["source_id"], ["event_id"], F.col("bad")).collect()} == want


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_rank_never_sorts_a_key_in_one_partition(spark):
    plan = plan_of(range_rank(hot(spark), [F.col("day"), F.col("event_id")], "r", ["source_id"]))
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(top_per_key(hot(spark), ["source_id"], [F.col("event_id")], 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan
