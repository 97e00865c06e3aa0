"""Generations of several tables under one root, published together.

A generation is written to folders of its own and becomes visible by one manifest, written last: a row per
table with its folder and number of rows.  Manifests are numbered; a writer names the number that its tables were built from
and may only write the next one, so of two writers that started from the same generation the second fails instead of undoing
the first.  No clock is read.  Files of a generation that never got its manifest are not seen by any reader.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "number int, generation string, built_from int, name string, folder string, n_rows bigint"


class GenerationConflict(RuntimeError):
    """Another writer has published a successor of the generation these tables were built from."""


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifests")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None  # nothing was published here yet


def current(spark: SparkSession, root: str) -> int | None:
    """Number of the newest generation, None before the first."""
    found = _manifests(spark, root)
    return None if found is None else found.agg(F.max("number")).first()[0]


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict[str, dict]:
    """The tables of a generation (the newest one) by name; one row per table."""
    number = current(spark, root) if number is None else number
    if number is None:
        raise LookupError(f"nothing was published below {root}")
    return {r.name: r.asDict() for r in _manifests(spark, root).where(F.col("number") == number).collect()}


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(manifest(spark, root, number)[name]["folder"])


def publish(root: str, tables: dict[str, DataFrame], generation: str, built_from: int | None,
            partition_by: dict[str, list[str]] | None = None) -> int:
    """Write all tables, then their manifest; returns the generation's number."""
    spark = next(iter(tables.values())).sparkSession
    number = 0 if built_from is None else built_from + 1
    place = f"{root}/data/{number}-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        columns = (partition_by or {}).get(name, [])
        if columns:  # few folders per task, and a folder of many rows still has several tasks
            df = df.repartitionByRange(*columns, F.xxhash64(*df.columns))
            df.write.partitionBy(*columns).parquet(f"{place}/{name}")
        else:
            df.write.parquet(f"{place}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{place}/{name}")
        rows.append((number, generation, built_from, name, f"{place}/{name}", written.count()))
    try:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/number={number}")
    except AnalysisException as taken:
        if "PATH_ALREADY_EXISTS" not in str(taken):
            raise
        raise GenerationConflict(f"generation {number} below {root} was published by another writer") from taken
    return number
