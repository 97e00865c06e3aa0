"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time 0..1 (straight lines between
knots).  Its integral is the source's share of the words; shares that would need a
source more than ``max_repeats`` times stop there and the excess is shared again by
weight.  A source's documents lie on a line of words in a fixed pseudo-random order;
the line is walked up to ``max_repeats`` times until the source's target is used up,
whole documents only.  The cumulative demand of the schedule, inverted, turns a place
on that line into a training position, and documents are range-sorted by position.

Defined results: a null text has size 0; a null source is a source of its own, last in
code point order; empty documents are taken like others but take no words; rows that
agree in id, source and size are interchangeable; an empty table gives an empty mix.
Columns of the input are carried in a struct, so their names cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, prefix_sums, stored


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_schedule(sizes: DataFrame, swing: float = 0.5) -> DataFrame:
    """Knots (source, t, weight): weights 1, 2, 3, repeating in code point order.

    Odd sources fade from (1 + swing) to (1 - swing) times their weight, even ones rise,
    so that each schedule's integral is its weight.  One row per source goes through the
    window: sources are a configured dimension, not data that grows with the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    tilt = F.when(F.col("rank") % 2 == 1, F.lit(swing)).otherwise(F.lit(-swing))
    return (sizes.select("source", rank.alias("rank"))
            .select("source", (1 + (F.col("rank") - 1) % 3).cast("double").alias("mean"), tilt.alias("tilt"))
            .select("source", F.explode(F.array(
                F.struct(F.lit(0.0).alias("t"), (F.col("mean") * (1 + F.col("tilt"))).alias("weight")),
                F.struct(F.lit(1.0).alias("t"), (F.col("mean") * (1 - F.col("tilt"))).alias("weight")))).alias("k"))
            .select("source", "k.t", "k.weight"))


def integrated(knots: DataFrame) -> DataFrame:
    """Per source: the integral of its schedule and its pieces with the integral before each."""
    after = Window.partitionBy("source").orderBy("t")
    pieces = (knots.select("source", F.col("t").alias("t0"), F.col("weight").alias("w0"),
                           F.lead("t").over(after).alias("t1"), F.lead("weight").over(after).alias("w1"))
              .where("t1 > t0")
              .withColumn("area", (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2)
              .withColumn("before", F.coalesce(F.sum("area").over(
                  Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    return pieces.groupBy("source").agg(
        F.sum("area").alias("weight"),
        F.sort_array(F.collect_list(F.struct("before", "area", "t0", "t1", "w0", "w1"))).alias("pieces"))


def targets(sizes: DataFrame, weights: DataFrame, max_repeats: int) -> DataFrame:
    """Share all words by weight, no source above ``max_repeats`` times its size.

    The level (words per unit of weight) is found on the sources sorted by the level at
    which each one is full; sources below it stand at their limit.
    """
    order = [F.col("full_at"), F.col("source").asc_nulls_last()]
    line = Window.orderBy(*order)
    every = Window.partitionBy()
    rows = (sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")))
            .select("s.source", "s.source_size", "w.weight", "w.pieces")
            .withColumn("limit", F.col("source_size") * F.lit(max_repeats).cast("long"))
            .withColumn("full_at", F.col("limit") / F.col("weight"))
            .withColumn("held", F.coalesce(F.sum("limit").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("open", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.sum("source_size").over(every) - F.col("held")) / F.col("open"))
            .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]))
    return rows.select(
        "source", "source_size", "weight", "pieces",
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        F.coalesce(F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_last())
                                             .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def position(need: Column, pieces: Column) -> Column:
    """Training time at which the integral of the schedule reaches ``need``."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= need), -1)
    rest, w0 = need - piece["before"], piece["w0"]
    slope = (piece["w1"] - w0) / (piece["t1"] - piece["t0"])
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    return F.when(rest <= 0, piece["t0"]).otherwise(piece["t0"] + 2 * rest / (w0 + root))


def _planned(rows: DataFrame, schedule, max_repeats: int) -> DataFrame:
    """Plan of stored rows (doc_id, source, size, copy_no); copy_no is carried along."""
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    # the row number only tells apart rows that agree in everything a result depends on
    lined = prefix_sums(rows.withColumns({"no_source": F.col("source").isNull(), "order_key": order_key}),
                        ["no_source", "source", "order_key", "size", "copy_no"], {"at": "size"}, "mix-line")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = stored(targets(sizes, integrated(schedule(sizes)), max_repeats), "mix-targets")
    middle = F.col("at") - F.col("base") + F.col("size") / 2
    joined = (lined.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
              .select("d.*", "p.source_size", "p.target", "p.weight", "p.pieces", middle.alias("middle")))
    passes = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)),
                      lambda e: F.col("middle") + e * F.col("source_size") < F.col("target"))
    spots = F.transform(F.col("passes"), lambda e: position(
        (F.col("middle") + e * F.col("source_size")) / F.col("target") * F.col("weight"), F.col("pieces")))
    return (joined.withColumn("passes", passes).withColumn("positions", spots)
            .select("doc_id", "copy_no", "size", "source_size", "target", F.size("passes").alias("copies"),
                    (F.size("passes") * F.col("size")).cast("long").alias("taken"), "positions"))


def plan_mix(docs: DataFrame, schedule=cyclic_schedule, max_repeats: int = 3) -> DataFrame:
    """doc_id, copy_no, size, source_size, target, copies, taken, positions of every document."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
                       F.monotonically_increasing_id().alias("copy_no"))
    return _planned(stored(rows, "mix-sizes"), schedule, max_repeats)


def mix(docs: DataFrame, schedule=cyclic_schedule, max_repeats: int = 3) -> DataFrame:
    """The mixed documents, each as often as it is taken, range-sorted by training position.

    Texts move twice: to the plan of their row, which is made without them, and to their place.
    """
    held = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("copy_no")), "mix-documents")
    rows = held.select("row.doc_id", F.col("row.source").cast("string").alias("source"), word_count("row.text").alias("size"), "copy_no")
    plan = stored(_planned(stored(rows, "mix-sizes"), schedule, max_repeats).where("copies > 0").select("copy_no", "positions"), "mix-plan")
    return (held.join(plan, "copy_no").select("row", F.explode("positions").alias("position"))
            .repartitionByRange("position").sortWithinPartitions("position").select("row.*"))
