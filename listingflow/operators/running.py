"""Ranks and streaks that never put one key into one task.

A window over a hot source would sort a third of all rows in a single task.  Here rows are cut into ranges
of their order and written once; windows run inside a range and only counts or summaries per range and key
are lined up.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import work_path


def newest_first(day: Column) -> Column:
    """Ascending bucket for a descending date; unknown dates go last."""
    return F.coalesce(F.datediff(F.lit("9999-12-31").cast("date"), day), F.lit(2**31 - 1))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  The rank filter lets Spark keep only ``n`` rows per key
    and task before the shuffle, so a hot key sends n rows per task, not all of them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def into_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows cut into ranges of ``order`` and written once, with the number of their range.

    Equal values share a range and ranges follow the order, so a window may run inside a range whatever the
    skew; the input is read twice, once to find the cuts and once to be written.
    """
    path = work_path(df.sparkSession, name)
    cut = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    cut.write.parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def range_rank(df: DataFrame, order: list[Column], out: str, keys: list[str] = ()) -> DataFrame:
    """Row number in ascending ``order``, per key or over the whole table; the last order column tells rows apart.

    Only the counts per range and key are lined up, so neither a hot key nor the whole table meets in one task.
    """
    keys, names = list(keys), [f"_o{i}" for i in range(len(order))]
    rows = into_ranges(df.withColumns(dict(zip(names, order))), keys + names, f"rank-{out}")
    counts = rows.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*names))
    return rows.withColumn("_in", inside).join(offsets, same).withColumn(out, F.col("_in") + F.col("_before")).drop(
        "_range", "_r", "_in", "_before", *names, *[f"_k_{k}" for k in keys])


def longest_streaks(df: DataFrame, keys: list[str], order: list[str], bad: Column) -> DataFrame:
    """Longest run of bad rows per key, in order.

    Each range of a key gives a summary (bad rows at its head and tail, longest inside, all bad) and the summaries,
    as many as ranges hold the key, are folded in order: a streak across ranges is tail plus head.
    """
    rows = into_ranges(df.withColumn("_bad", bad), keys + order, "streaks")
    w = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = rows.withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w)).groupBy(
        "_range", *keys, "_island").agg(F.count_if("_bad").alias("_n"))
    part = islands.groupBy("_range", *keys).agg(
        F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("_n"))), F.lit(0)).alias("head"),
        F.max_by("_n", "_island").alias("tail"), F.max("_n").alias("longest"), (F.max("_island") == 0).alias("whole"))
    zero = F.struct(F.lit(0).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("best"))

    def fold(acc, p):
        return F.struct(F.when(p["whole"], acc["open"] + p["head"]).otherwise(p["tail"]).alias("open"),
                        F.greatest(acc["best"], acc["open"] + p["head"], p["longest"]).alias("best"))

    return part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "head", "tail", "longest", "whole"))).alias("_p")).select(
        *keys, F.aggregate("_p", zero, fold, lambda acc: acc["best"]).alias("longest"))
