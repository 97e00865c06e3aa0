"""Breadth-first discovery over landed link tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import work_path

SCHEMA = "target string, depth int"


def discover(links: DataFrame, seeds: DataFrame, max_rounds: int = 400, root: str | None = None) -> DataFrame:
    """Every target reachable from the seeds with its least number of links, and whether the search came to its end.

    ``links`` has url and target, ``seeds`` has target.  A round joins the newest frontier with the links and keeps
    what no earlier round holds; it is written whole before the next begins, so the plan of a round never grows and
    a job that starts again on the same ``root`` goes on after the last whole round.  Cycles end by the anti-join.
    At most ``max_rounds`` rounds are followed; ``complete`` is false if something was left to follow.
    """
    spark = links.sparkSession
    root = root or work_path(spark, "crawl")
    of = lambda k: f"{root}/round={k}"
    done = 0
    rounds = _rounds(spark, root)
    if rounds is None:
        seeds.select("target").where("target IS NOT NULL").distinct().withColumn("depth", F.lit(0)).write.mode("overwrite").parquet(of(0))
    else:
        done = rounds
    while True:
        frontier = spark.read.schema(SCHEMA).parquet(of(done))
        if frontier.isEmpty() or done >= max_rounds:
            break
        visited = spark.read.schema(SCHEMA).parquet(*[of(k) for k in range(done + 1)])
        found = (frontier.select(F.col("target").alias("url")).join(links.select("url", "target"), "url")
                 .select("target").where("target IS NOT NULL").distinct().join(visited.select("target"), "target", "left_anti"))
        found.withColumn("depth", F.lit(done + 1)).write.mode("overwrite").parquet(of(done + 1))
        done += 1
    complete = frontier.isEmpty()
    return spark.read.schema(SCHEMA).parquet(*[of(k) for k in range(done + 1)]).withColumn("complete", F.lit(complete))


def _rounds(spark, root: str) -> int | None:
    """The last round that was written whole; its marker file is the last thing a write leaves."""
    try:
        marks = spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").option("recursiveFileLookup", True).load(root)
        last = marks.agg(F.max(F.regexp_extract("path", r"round=(\d+)", 1).cast("int"))).first()[0]
    except Exception as missing:  # nothing was written below this root yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return last
