"""Readers for landed tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dear to work on: one that comes in fewer parts than the session has cores is dealt to all of
    them, on a laptop as on a cluster.  A table of many files is read as they are, without a shuffle."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


class SnapshotShapeError(ValueError):
    """The stored snapshot does not have the declared columns."""


def read_snapshot(spark: SparkSession, path: str, declared: dict[str, str]) -> DataFrame:
    """Read a snapshot only if every declared column is stored with the declared type.

    Reading with a schema alone would turn an unknown layout into nulls, which a later
    commit would then write over good data; the stored schema is compared first.
    """
    stored = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
    wrong = {c: (t, stored.get(c)) for c, t in declared.items() if stored.get(c) != t}
    if wrong:
        raise SnapshotShapeError(f"unexpected columns (declared, stored): {wrong}")
    schema = ", ".join(f"`{c}` {t}" for c, t in declared.items())
    return spark.read.schema(schema).parquet(path)


def require_version(df: DataFrame, version_col: str, version: int) -> DataFrame:
    """Fail the job on the first row of another version instead of skipping it."""
    return df.selectExpr(
        "*", f"CASE WHEN {version_col} <=> {version} THEN true ELSE "
             f"raise_error(concat('unexpected snapshot version ', {version_col})) END AS version_ok")
