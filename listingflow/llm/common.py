"""Helpers shared by the training-data operators."""
from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir

# functions of this folder travel to the executors with their code: no path has to be set there
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Fixed value: a word is a run of characters other than these six white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor recomputes nothing that was written, and two
    branches over the result do not repeat the work before it.  What was shuffled for it is
    garbage then; collecting it lets Spark delete those files before the next step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/listingflow-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Empty stored tables that nothing reads any more: what was made of them must be written before."""
    for used in tables:
        spark, files = used.sparkSession, used.inputFiles()
        for path in {file.rsplit("/", 1)[0] for file in files}:
            spark.createDataFrame([], used.schema).coalesce(1).write.mode("overwrite").parquet(path)


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, str], name: str) -> DataFrame:
    """Exclusive running totals over the whole table in the given order.

    ``values`` maps each new column to the long column it sums.  The rows are cut into
    ranges of the order and written once; windows run inside a range and only the totals
    of the ranges are lined up, so no key, however frequent, has to fit into one task as
    long as the last order column tells its rows apart.
    """
    part = "_range"
    ranges = stored(df.repartitionByRange(*[F.col(c) for c in order])
                    .withColumn(part, F.spark_partition_id()), name)
    totals = ranges.groupBy(part).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}")
                                    for k in values])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in values.items()])
    return (summed.join(offsets, part)
            .withColumns({k: F.col(k) + F.col(f"_base_{k}") for k in values})
            .drop(part, *[f"_base_{k}" for k in values]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of complete groups with the start and end of each, from rows sorted by the first ``keys`` columns (integers)."""
    held = None
    for batch in _and_end(batches):
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not held.num_rows:
            continue
        columns = [c.to_numpy() for c in held.columns[:keys]]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [held.num_rows]))
        if batch is not None:  # the last group may go on in the next batch
            starts, ends = starts[:-1], ends[:-1]
        if len(ends):
            yield held.slice(0, int(ends[-1])), starts, ends
            held = held.slice(int(ends[-1])).combine_chunks()


def _and_end(batches):
    yield from batches
    yield None
