"""Consistent-hash ring with virtual nodes and bounded loads.

Rows and ``replicas`` virtual nodes of every shard lie on one ring of md5 values.  A row
belongs to the first virtual node clockwise; a shard that is full passes the rest on, in
ring order, to the next virtual node whose shard has room.  The rooms add up to the
number of rows and differ by one at most (law ``rows``), so the balance is guaranteed;
only the overflow of full shards leaves its place on the plain ring.

Because rows queue in ring order, every virtual node takes one stretch of ring ranks.
The walk over the ring therefore needs only the rank at each virtual node (shards x
replicas numbers, whatever the data), and a row finds its shard and its slot by its rank.

Defined results: a null text counts as empty; a row's place is the hash of its id and
text checksum, so a null id is placed by its text and equal ids by theirs; rows equal in
both are interchangeable; an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import prefix_sums, stored

LAW = "rows"


def digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))


def ring(spark, shards: int, replicas: int) -> DataFrame:
    return spark.range(shards * replicas).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.md5(F.concat_ws("-", F.lit("shard"), (F.col("id") % shards).cast("string"),
                          F.floor(F.col("id") / shards).cast("string"))).alias("place"))


def stretches(nodes: DataFrame, total: int, shards: int) -> DataFrame:
    """Walk the ring twice: (lo, hi, shard, slot) of each stretch of ranks that a node takes."""
    node = "struct<reached: bigint, shard: int>"
    took = "struct<lo: bigint, hi: bigint, shard: int, slot: bigint>"
    quota = f"({total}L div {shards} + if(s < {total}L % {shards}, 1, 0))"
    walk = f"""
      aggregate(
        concat(way, transform(way, n -> named_struct('reached', {total}L, 'shard', n.shard))),
        named_struct('head', 0L,
                     'room', transform(sequence(0, {shards - 1}), s -> cast({quota} as bigint)),
                     'taken', cast(array() as array<{took}>)),
        (st, n) -> named_struct(
          'head', st.head + least(n.reached - st.head, st.room[n.shard]),
          'room', transform(st.room, (r, i) -> if(i = n.shard, r - least(n.reached - st.head, r), r)),
          'taken', if(least(n.reached - st.head, st.room[n.shard]) > 0,
            concat(st.taken, array(named_struct(
              'lo', st.head, 'hi', st.head + least(n.reached - st.head, st.room[n.shard]), 'shard', n.shard,
              'slot', cast({total}L div {shards} + if(n.shard < {total}L % {shards}, 1, 0) as bigint) - st.room[n.shard]))),
            st.taken)),
        st -> st.taken)"""
    return (nodes.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", "reached", "shard"))).alias("all"))
            .select(F.expr(f"transform(all, n -> cast(named_struct('reached', n.reached, 'shard', n.shard) as {node}))").alias("way"))
            .select(F.explode(F.expr(walk)).alias("t")).select("t.*"))


def assign(docs: DataFrame, shards: int = 24, replicas: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                              F.col("text_crc32").cast("string")))
    # the row number only tells apart rows that agree in id and text, so reruns give the same rows
    rows = digest(docs).withColumns({"place": place, "copy_no": F.monotonically_increasing_id(),
                                     "one": F.lit(1).cast("long"), "node": F.lit(None).cast("int")})
    marks = ring(spark, shards, replicas).select(
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("size"),
        F.lit(0).cast("long").alias("text_crc32"), "place", F.lit(-1).cast("long").alias("copy_no"),
        F.lit(0).cast("long").alias("one"), F.col("shard").alias("node"))
    ranked = stored(prefix_sums(stored(rows, "shard-digest").unionByName(marks), ["place", "size", "copy_no"],
                                {"at": "one"}, "shard-ring"), "shard-ranks")
    total = ranked.agg(F.sum("one")).first()[0]  # one number
    nodes = ranked.where("node IS NOT NULL").select("place", F.col("at").alias("reached"), F.col("node").alias("shard"))
    width = total // 4096 + 1
    # at most 2 x shards x replicas stretches over 4096 blocks: bounded by parameters, not by data
    blocks = (stretches(nodes, total, shards)
              .select("*", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("block")))
    return (ranked.where("node IS NULL").withColumn("block", F.expr(f"`at` div {width}"))
            .join(F.broadcast(blocks), "block").where("`at` >= lo AND `at` < hi")
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                    (F.col("slot") + F.col("at") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
