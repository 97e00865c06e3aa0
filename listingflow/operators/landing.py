"""Observations landed by day: a reader of one day opens that day's files only."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def land(df: DataFrame, path: str, day: str, *spread: str) -> DataFrame:
    """Write rows into folders by ``day`` and read them back.

    The rows are cut into ranges of day and the ``spread`` columns, so a task writes few folders and a day with most
    rows is written by several tasks.
    """
    df.repartitionByRange(day, *spread).write.mode("append").partitionBy(day).parquet(path)
    return landed(df.sparkSession, path, df)


def landed(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def newest_day(rows: DataFrame, day: str):
    """The newest landed day; only folder names are read for it."""
    return rows.agg(F.max(day)).first()[0]


def split_at(rows: DataFrame, day: str, at) -> tuple[DataFrame, DataFrame]:
    """Rows of earlier days, and those of the batch day; both prune folders because the day is a given value."""
    given = F.lit(at).cast(rows.schema[day].dataType)
    return rows.where(F.col(day) < given), rows.where(F.col(day) == given)
