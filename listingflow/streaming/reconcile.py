"""Streaming reconcile: record state folded run by run, with a counted late policy."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import lifecycle, listing
from ..operators.lifecycle import FIELDS, FLAGS, JOB, SEED_TYPE


class StreamingState:
    """State, run log and late counts of a stream, committed one generation per batch.

    A generation is named by its batch id, so a batch delivered again after a failure is
    recognised and skipped: no second insert, history row or event.  The commit record is
    written last; readers only follow committed generations.

    The newest run of every source stays open: its landed rows are kept and folded again
    with what later batches bring of it, so a result never depends on how a run falls into
    batches.  A run closes when its source shows a newer one; rows of closed runs are late,
    left out and counted.  ``source`` and ``run`` tell both from a landed row.
    """

    def __init__(self, spark: SparkSession, root: str, observe: Callable[[DataFrame], DataFrame],
                 measure: Callable[[DataFrame], DataFrame], source: Column, run: Column):
        self.spark, self.root, self.observe, self.measure = spark, root, observe, measure
        self.source, self.run = source, run

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch_id bigint").json(self.root + "/commits")
        except AnalysisException as missing:  # the very first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def last_batch(self) -> int | None:
        commits = self._commits()
        return None if commits is None else commits.agg(F.max("batch_id")).first()[0]

    def read(self, part: str, batch: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/batch={self.last_batch() if batch is None else batch}/{part}")

    def late_counts(self) -> DataFrame:
        """Applied and dropped rows of every committed batch."""
        rows = self.spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*/counts")
        return rows.join(self._commits().select(F.col("batch_id").alias("batch")), "batch", "left_semi")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        done = self.last_batch()
        if done is not None and batch_id <= done:
            return
        path = f"{self.root}/batch={batch_id}"
        keep = lambda df, part: df.write.mode("overwrite").parquet(f"{path}/{part}")
        back = lambda part: self.spark.read.parquet(f"{path}/{part}")
        landed = batch.withColumns({"_source": self.source, "_run": self.run})
        seen = self.observe(batch)
        if done is None:
            keep(seen.groupBy(F.lit(False).alias("late")).agg(F.count("*").alias("n")), "counts")
        else:
            # One row per source: its open run.
            newest = self.read("runs", done).groupBy("source_id").agg(F.max("run_date").alias("open_run"))
            late = F.coalesce(F.col("run_date") < F.col("open_run"), F.lit(False)).alias("late")
            keep(seen.join(newest, "source_id", "left").groupBy(late).agg(F.count("*").alias("n")), "counts")
            landed = (landed.join(newest, F.col("_source") == F.col("source_id"), "left")
                      .where("open_run IS NULL OR _run >= open_run").select(landed.columns))
            landed = self.read("open", done).select(landed.columns).unionByName(landed)
        keep(landed, "landed")
        landed = back("landed")
        newest = landed.groupBy("_source").agg(F.max("_run").alias("_newest"))
        keep(landed.join(newest, "_source").where("_run = _newest").select(landed.columns), "open")
        rows = landed.drop("_source", "_run")
        split = newest.withColumnRenamed("_source", "source_id")
        obs, runs = (df.join(split, "source_id").withColumn("_open", F.col("run_date") == F.col("_newest")).drop("_newest")
                     for df in (self.observe(rows), self.measure(rows)))
        closed_runs, closed = (df.where("NOT _open").drop("_open") for df in (runs, obs))
        seed = F.lit(None).cast(SEED_TYPE)
        closed = closed.withColumn("seed", seed)
        if done is not None:
            closed_runs = self.read("closed_runs", done).select(closed_runs.columns).unionByName(closed_runs)
            closed = self._as_observations(self.read("closed_state", done)).select(closed.columns).unionByName(closed)
        # The run logs have one row per source and run; later steps read them from storage.
        keep(closed_runs, "closed_runs")
        keep(back("closed_runs").unionByName(runs.where("_open").drop("_open")), "runs")
        fold = lambda seen, log: lifecycle.current_state(lifecycle.timeline(seen, listing.volume_fold(log)))
        keep(fold(closed, back("closed_runs")), "closed_state")
        fresh = obs.where("_open").drop("_open").withColumn("seed", seed)
        carried = self._as_observations(back("closed_state")).select(fresh.columns)
        keep(fold(carried.unionByName(fresh), back("runs")), "state")
        self.spark.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode("append").json(
            self.root + "/commits")

    @staticmethod
    def _as_observations(state: DataFrame) -> DataFrame:
        """Stored state as each record's leading observation."""
        return state.select(
            *JOB, F.col("last_seen").alias("run_date"), F.lit(None).cast("bigint").alias("event_id"), "value",
            *FIELDS, *FLAGS,
            F.struct("first_seen", "detail_verified_at", "changed_at").alias("seed"))
