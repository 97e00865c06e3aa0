"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search.

Vectors are scaled by the largest norm and get one more component that makes all norms
equal, so the largest inner product is the nearest neighbour.  Rows are dealt by hash to
shards of about ``SHARD`` rows, and every shard gets a neighbour graph.  It starts from
nearest neighbours inside random cells (several partitions around random pivots) and is
improved by rounds of Spark joins: at every node the vectors of its neighbours, forward
and sampled reverse ones, meet, and each pair that would enter one of the two lists goes
back.  The stated query set, in broadcast blocks of ``ASKED`` vectors, walks the graph of
every shard greedily: the ``BEAM`` best unexpanded nodes are followed to their neighbours
until the ``POOL`` best are all expanded.  The best of all shards are rescored exactly in
double precision on the original vectors.

Equal vectors are one node, asked once.  A found node stands for its rows: the smallest ids
of each, one more than asked for, are enough for every query, its own row left out.

Bounds: a shard (vectors and lists) fits one task by its size; at most ``PIVOTS`` pivots and
one block of queries are collected.  Lists hold ``WIDTH`` neighbours.  Every row is indexed.
Reverse lists of hubs are sampled, which NN-descent allows; measured recall is in the README.

Defined results: vectors null, empty, zero, or with null or non-finite components take no
part, nor do those of another length than most; rows that share an id are rows of their
own; ties go to the smaller id; with fewer rows than asked for all candidates are returned; an empty table gives no row;
other columns are left out, so their names cannot clash.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType

from .common import stored, whole_groups

WIDTH, REVERSE, TRIALS, ROUNDS = 24, 24, 4, 2
SHARD, PIVOTS, CELL = 16_384, 16, 1024
POOL, BEAM, HOPS, ENTRIES, ASKED = 128, 16, 40, 128, 8192


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dims)


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, embedding (double) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
            .where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
                   & F.exists("embedding", lambda x: x != 0)))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count()
    common = lengths.orderBy(F.desc("count"), "dims").limit(1).select("dims")
    return rows.join(common, F.size("embedding") == F.col("dims"), "left_semi").withColumn("row", F.monotonically_increasing_id())


def packed(rows: DataFrame) -> DataFrame:
    """node, vec: scaled vectors with the levelling component, as 32-bit floats."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    largest = rows.select(F.max(square)).first()[0] or 1.0  # one number

    @F.pandas_udf(BinaryType())
    def pack(vectors: pd.Series, square: pd.Series) -> pd.Series:
        flat = np.stack(vectors.to_list()) / np.sqrt(largest)
        level = np.sqrt(np.maximum(0.0, 1.0 - square.to_numpy() / largest))
        return pd.Series([v.tobytes() for v in np.column_stack([flat, level]).astype(np.float32)])

    shards = max(1, -(-rows.count() // SHARD))
    return rows.select("node", F.pmod(F.xxhash64(F.col("node")), F.lit(shards)).alias("shard"), pack("embedding", square).alias("vec"))


def _top(edges: DataFrame, key: str, other: str, width: int, *more: str) -> DataFrame:
    """The best ``width`` rows of each key; cut per task before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), other)
    return (edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= width)
            .select(key, other, "score", *more))


def seeded(points: DataFrame, dims: int, trials: int = TRIALS) -> DataFrame:
    """Edges (u, v, score, fresh) inside random cells of each shard."""
    spark = points.sparkSession
    total = points.count()
    per_trial = max(1, min(PIVOTS, total // CELL))
    rank = F.xxhash64(F.col("node"), F.lit(17))
    pivots = [r.vec for r in points.orderBy(rank).limit(per_trial * trials).select("vec").collect()]
    shared = spark.sparkContext.broadcast(b"".join(pivots))

    def cell(trial: int) -> Column:
        @F.pandas_udf(IntegerType())
        def nearest(vecs: pd.Series) -> pd.Series:
            mine = np.frombuffer(shared.value, np.float32).reshape(-1, dims)[trial::trials]
            return pd.Series((_matrix(vecs, dims) @ mine.T).argmax(axis=1).astype(np.int32))
        return nearest("vec")

    placed = points.select("node", "shard", "vec", F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("trial"), cell(t).cast("long").alias("cell")) for t in range(trials)])).alias("c"))

    def nearest_inside(batches):
        for rows, starts, ends in whole_groups(batches, 3):
            node, vec = rows.column(3).to_numpy(), _matrix(rows.column(4).to_pylist(), dims)
            out = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.float32)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                k = min(WIDTH, e - s - 1)
                for lo in range(s, e if k > 0 else s, 512):
                    hi = min(e, lo + 512)
                    score = vec[lo:hi] @ vec[s:e].T
                    score[np.arange(hi - lo), np.arange(lo - s, hi - s)] = -np.inf
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    out[0].append(np.repeat(node[lo:hi], k))
                    out[1].append(node[s:e][best].ravel())
                    out[2].append(np.take_along_axis(score, best, axis=1).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["u", "v", "score"])

    found = (placed.select("c.trial", "shard", "c.cell", "node", "vec")
             .repartition("trial", "shard", "cell").sortWithinPartitions("trial", "shard", "cell", "node")
             .mapInArrow(nearest_inside, "u long, v long, score float"))
    best = found.groupBy("u", "v").agg(F.max("score").alias("score"))
    return _top(best, "u", "v", WIDTH).withColumn("fresh", F.lit(True))


def improved(edges: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """One NN-descent round: neighbours of a node meet there and offer each other."""
    indegree = edges.groupBy("v").agg(F.count("*").alias("n"))
    sampled = (edges.join(indegree, "v")
               .where(F.pmod(F.xxhash64("u", "v"), F.col("n")) < REVERSE)
               .select(F.col("v").alias("at"), F.col("u").alias("member"), "fresh"))
    meeting = (edges.select(F.col("u").alias("at"), F.col("v").alias("member"), "fresh").union(sampled)
               .groupBy("at", "member").agg(F.max("fresh").alias("fresh")))
    worst = edges.groupBy("u").agg(F.when(F.count("*") < WIDTH, -2.0).otherwise(F.min("score")).cast("float").alias("worst"))
    known = points.join(worst, points.node == worst.u, "left").select(F.col("node").alias("member"), "vec",
                                                                       F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))

    def offers(batches):
        for rows, starts, ends in whole_groups(batches, 1):
            member, fresh = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            worst, vec = rows.column(3).to_numpy(), _matrix(rows.column(4).to_pylist(), dims)
            out = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.float32)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                score = vec[s:e] @ vec[s:e].T
                better = (score > worst[s:e, None]) & (fresh[s:e, None] | fresh[None, s:e])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                out[0].append(member[s + i])
                out[1].append(member[s + j])
                out[2].append(score[i, j])
            u, v, score = map(np.concatenate, out)
            # an offer made at several nodes of this batch goes out once
            _, once = np.unique(np.stack([u, v], axis=1), axis=0, return_index=True) if len(u) else (None, np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(u[once]), pa.array(v[once]), pa.array(score[once])], ["u", "v", "score"])

    offered = (meeting.join(known, "member").select("at", "member", "fresh", "worst", "vec")
               .repartition("at").sortWithinPartitions("at", "member")
               .mapInArrow(offers, "u long, v long, score float"))
    merged = (edges.select("u", "v", "score", F.lit(False).alias("fresh"))
              .union(offered.withColumn("fresh", F.lit(True)))
              .groupBy("u", "v").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh")))
    return _top(merged, "u", "v", WIDTH, "fresh")


def build(points: DataFrame, dims: int, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph (u, v, score, fresh); each round is written to the shared folder."""
    graph = stored(seeded(points, dims), "neighbours-seed")
    for _ in range(rounds):
        graph = stored(improved(graph, points, dims), "neighbours-round")
    return graph


def walk(vec: np.ndarray, links: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, score) of the ``POOL`` best nodes found for each query by greedy search in one graph.

    ``links`` holds neighbour indices, -1 where there is none.
    """
    n, rows = len(vec), np.arange(len(asked))[:, None]
    score = np.full((len(asked), n), -np.inf, np.float32)
    open_score = score.copy()  # as score, but expanded nodes are closed
    entry = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))
    score[:, entry] = open_score[:, entry] = asked @ vec[entry].T
    pool, beam = min(POOL, n), min(BEAM, n)
    for _ in range(HOPS):
        ahead = np.argpartition(-open_score, beam - 1, axis=1)[:, :beam]
        worst = -np.partition(-score, pool - 1, axis=1)[:, pool - 1:pool]
        live = open_score[rows, ahead] >= np.maximum(worst, -1e30)
        if not live.any():
            break
        open_score[np.broadcast_to(rows, ahead.shape)[live], ahead[live]] = -np.inf
        near = np.where(live[:, :, None], links[ahead], -1)
        q, _, _ = np.nonzero(near >= 0)
        w = near[near >= 0]
        new = np.isneginf(score[q, w])
        q, w = q[new], w[new]
        for k in range(0, len(w), 1 << 17):
            i, j = q[k:k + (1 << 17)], w[k:k + (1 << 17)]
            score[i, j] = open_score[i, j] = np.einsum("ij,ij->i", asked[i], vec[j])
    best = np.argpartition(-score, pool - 1, axis=1)[:, :pool]
    return best, score[rows, best]


def _local_links(node: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Neighbour indices of each node of a shard, forward and up to REVERSE reverse ones."""
    place = np.argsort(node, kind="stable")
    u, v = (place[np.searchsorted(node[place], x)] for x in (u, v))
    out = np.full((len(node), WIDTH + REVERSE), -1, np.int64)
    for a, b, base, width in ((u, v, 0, WIDTH), (v, u, WIDTH, REVERSE)):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < width
        out[a[keep], base + rank[keep]] = b[keep]
    return out


def search(queries: DataFrame, graph: DataFrame, points: DataFrame, dims: int, count: int) -> DataFrame:
    """(query, node): the best nodes found for each query in the graph of each shard."""
    spark = points.sparkSession
    lists = graph.groupBy("u").agg(F.collect_list("v").alias("near"))  # at most WIDTH each
    shards = stored(points.join(lists, F.col("node") == F.col("u"), "left")
                    .select("shard", "node", "vec", F.coalesce("near", F.array().cast("array<long>")).alias("near")), "neighbours-shards")
    asked = stored(points.join(queries.select("node"), "node", "left_semi").select("node", "vec"), "neighbours-asked")
    blocks = max(1, -(-asked.count() // ASKED))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(blocks)) == block).orderBy("node").collect()
        shared = spark.sparkContext.broadcast((np.array([r.node for r in rows], np.int64), b"".join(r.vec for r in rows)))

        def walks(batches, shared=shared):
            ids, packed_queries = shared.value
            ask = np.frombuffer(packed_queries, np.float32).reshape(-1, dims).copy()
            ask[:, -1] = 0.0  # the levelling component counts on the side of the candidates only
            for rows, starts, ends in whole_groups(batches, 1):
                nodes = rows.column(1).to_numpy()
                for s, e in zip(starts.tolist(), ends.tolist()):
                    part = rows.slice(s, e - s)
                    near = part.column(3).combine_chunks()
                    links = _local_links(nodes[s:e], np.repeat(nodes[s:e], near.value_lengths().to_numpy()), near.flatten().to_numpy())
                    vec = _matrix(part.column(2).to_pylist(), dims)
                    for k in range(0, len(ids), 128):
                        at, score = walk(vec, links, ask[k:k + 128])
                        query, node = np.repeat(ids[k:k + 128], at.shape[1]), nodes[s:e][at.ravel()]
                        score = np.where(node == query, -np.inf, score.ravel()).reshape(at.shape)
                        best = np.argsort(-score, axis=1)[:, :2 * count]
                        keep = np.zeros(at.shape, bool)
                        np.put_along_axis(keep, best, True, axis=1)
                        keep &= ~np.isneginf(score)
                        yield pa.RecordBatch.from_arrays([pa.array(query[keep.ravel()]), pa.array(node[keep.ravel()]),
                                                          pa.array(score[keep])], ["query", "node", "score"])

        part = (shards.repartition("shard").sortWithinPartitions("shard", "node")
                .mapInArrow(walks, "query long, node long, score float"))
        found = part if found is None else found.union(part)
    return _top(found, "query", "node", 2 * count)


def nearest(vectors: DataFrame, is_query: Column, count: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for the rows that are queries."""
    rows = stored(usable(vectors), "neighbours-rows")
    nodes = stored(rows.select("embedding").distinct().withColumn("node", F.monotonically_increasing_id()), "neighbours-nodes")
    members = stored(rows.join(nodes, "embedding").select("node", "row", "vec_id", is_query.alias("asks")), "neighbours-members")
    points = stored(packed(nodes), "neighbours-points")
    first = points.select(F.octet_length("vec")).first()
    dims = first[0] // 4 if first else 1
    queries = members.where("asks").select("node").distinct()
    pool = search(queries, build(points, dims), points, dims, count).select("query", "node")
    own = queries.select(F.col("node").alias("query"), "node")
    asked = nodes.join(queries, "node", "left_semi").select(F.col("node").alias("query"), F.col("embedding").alias("a"))
    product = F.aggregate(F.zip_with("a", "embedding", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = pool.union(own).join(nodes, "node").join(asked, "query").select("query", "node", product.alias("score"))
    # one row more than asked for: the query's own may be among them
    by_id = Window.partitionBy("node").orderBy("vec_id", "row")
    smallest = members.withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= count + 1).select("node", "row", "vec_id")
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    listed = (exact.join(smallest, "node").withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= count + 1)
              .select("query", "row", "vec_id", "score"))
    listed = stored(listed, "neighbours-listed")
    asking = members.where("asks").select(F.col("node").alias("query"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (asking.join(listed, "query").where("row <> query_row").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score"))
