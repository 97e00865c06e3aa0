"""SimHash near-duplicates: exact pairs of fingerprints within a Hamming radius.

Fingerprint: A-Z lower-cased, words, shingles of four words joined by one space (fewer
words: all of them; none: fingerprint zero), XXH64 with seed 42; a bit is set if it is set
in over half of the shingles, repeats included.

Distances from a vantage point to unrelated fingerprints crowd around 32 bits, so a
vantage-point tree over all fingerprints would copy most points into most branches.
Sharding therefore starts with the pigeonhole rule: two fingerprints within ``RADIUS``
bits agree on two of six blocks, so each of the 15 pairs of blocks gives shards that
together hold every near pair.  A shard over ``LARGE`` fingerprints is cut by its distances
to vantage points into rings that overlap by the radius, so a pair across a boundary meets
in the upper ring.  Inside a shard a vantage-point tree prunes branches by triangle bounds.

Equal fingerprints are one node; a shard returns a spanning star of each of its linked
sets, never all pairs.  Defined results: null and empty texts have fingerprint zero and are
linked like any other; the component id is the smallest non-null doc_id reachable; equal
ids share a component only if their fingerprints are linked.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from . import near_copies
from .common import removed, stored, whole_groups
from .components import components

RADIUS, SHINGLE, SEED, LARGE, LEAF = 4, 4, 42, 200_000, 64
#: Comparisons held at a time.
BLOCK = 1 << 20
#: Vantage points of shard rings: any fixed bit patterns do.
VANTAGE = [0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F]


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(SHINGLE, len(words)) - 1
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[last:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k:k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t or b"") for t in batch], dtype="int64")


def fingerprint_of(text: Column) -> Column:
    return _fingerprints(text.cast("binary"))


# --- near pairs ----------------------------------------------------------------------

def _masks(radius: int) -> list[int]:
    """One mask for each pair of the radius + 2 blocks of the 64 bits."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(fps: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """(shard, bits, ring, fp): every pair within the radius shares a (shard, bits, ring)."""
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for k, m in enumerate(_masks(radius))])).alias("s")).select("s.shard", "s.bits", "fp")
    heavy = (keyed.groupBy("shard", "bits").count().where(F.col("count") > large)
             .select("shard", "bits", F.lit(True).alias("heavy")))
    width = 2 * radius

    def rings(point: int) -> Column:
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(point))))
        home = F.floor(d / width)
        # the first `radius` distances of a ring also belong to the ring below it
        return F.when((d % width < radius) & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))

    joined = keyed.join(heavy, ["shard", "bits"], "left")
    cut = joined.where("heavy")
    for k, point in enumerate(VANTAGE):
        cut = cut.withColumn(f"r{k}", F.explode(rings(point)))
    ring = sum((F.col(f"r{k}") * 16 ** k for k in range(len(VANTAGE))), F.lit(0))
    return (joined.where("heavy IS NULL").select("shard", "bits", F.lit(-1).cast("long").alias("ring"), "fp")
            .unionByName(cut.select("shard", "bits", ring.cast("long").alias("ring"), "fp")))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) within the radius, in blocks of bounded size."""
    for m in range(0, len(b), BLOCK):
        part = b[m:m + BLOCK]
        step = max(1, BLOCK // len(part))
        for k in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[k:k + step, None] ^ part[None, :]) <= radius)
            if len(i):
                yield i + k, j + m


def vantage_pairs(points: np.ndarray, radius: int = RADIUS, joined=lambda at: False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius of distinct points, by a vantage-point tree; points that
    ``joined`` says are of one set already are not compared with each other."""
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if joined(at):
            continue
        here = points[at]
        if len(at) > LEAF:
            d = np.bitwise_count(here ^ here[len(at) // 2]).astype(int)
            middle = int(np.median(d))
            inner = d <= middle
            if not inner.all():
                todo += [at[inner], at[~inner]]
                # triangle bound: only points near the boundary can have partners across it
                low, high = at[inner & (d > middle - radius)], at[~inner & (d <= middle + radius)]
                if not joined(np.concatenate((low, high))):
                    for i, j in _near(points[low], points[high], radius):
                        yield low[i], high[j]
                continue
        for i, j in _near(here, here, radius):
            yield at[i[i < j]], at[j[i < j]]


def spanning(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Each linked point and the smallest index of its linked set.

    Every block of pairs is joined to the labels as it comes and dropped, so the memory is that
    of the points and one block.
    """
    label = np.arange(len(points))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = _root(label, i), _root(label, j)
            low, high = np.minimum(i, j), np.maximum(i, j)
            apart = low < high
            i, j = high[apart], low[apart]
            np.minimum.at(label, i, j)

    def joined(at: np.ndarray) -> bool:
        roots = _root(label, at)
        return len(at) > 1 and bool((roots == roots[0]).all())

    if len(points) > LEAF:  # stars around some points first, so that the tree can pass over dense sets
        for p in np.linspace(0, len(points) - 1, LEAF).astype(int):
            near = np.flatnonzero(np.bitwise_count(points ^ points[p]) <= radius)
            join(near, np.full(len(near), p))
    for i, j in vantage_pairs(points, radius, joined):
        join(i, j)
    label = _root(label, np.arange(len(points)))
    moved = np.flatnonzero(label != np.arange(len(points)))
    return moved, label[moved]


def _root(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ends of the label chains from the given points; the points are hung on them."""
    root = label[at]
    while (label[root] != root).any():
        root = label[root]
    label[at] = root
    return root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, starts, ends in whole_groups(batches, 3):
        fps = rows.column(3).to_numpy()
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            a, b = spanning(fps[s:e].view(np.uint64))
            u.append(fps[s + a])
            v.append(fps[s + b])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all pairs within the radius."""
    return (shards(fps).select(F.col("shard").cast("long").alias("shard"), "bits", "ring", "fp")
            .repartition("shard", "bits", "ring").sortWithinPartitions("shard", "bits", "ring", "fp")
            .mapInArrow(_links, "u long, v long"))


def classes(marked: DataFrame, name: str = "simhash") -> DataFrame:
    """(fp, node) for a stored table with column fp: the smallest linked fingerprint."""
    fps = stored(marked.select("fp").distinct(), f"{name}-distinct")
    roots = components(near_links(fps), f"{name}-links")
    return fps.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    marked = stored(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "simhash-fingerprints")
    nodes = stored(classes(marked), "simhash-classes")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    smallest = (nodes.join(first, "fp").groupBy("node").agg(F.min("first").alias("component_id")))
    component = nodes.join(smallest, "node").select("fp", "component_id")
    return (marked.join(component, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each set of near copies, the one with the smallest id; all columns as they were.

    Near copies are those of ``near_copies`` (five words, similarity 0.8); the contract of the
    fingerprints binds the query only.  A null id comes after all others, equal ids are taken in the
    order of the table; all texts without words are copies of each other; other columns are carried
    along, whatever their names; an empty table stays empty.
    """
    marked = stored(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), near_copies.mark_of(F.col("text")).alias("mark"))
                    .withColumn("copy_no", F.monotonically_increasing_id()), "copies-documents")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy_no")
    nodes = stored(marked.select("doc_id", "copy_no", "mark.*").groupBy("key")
                   .agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("buckets").alias("buckets")), "copies-nodes")
    texts = (marked.select("copy_no", F.col("mark.key").alias("key"), F.col("row.text").cast("binary").alias("text"))
             .join(nodes.select("first.copy_no"), "copy_no", "left_semi").select("key", "text"))
    roots = near_copies.linked_sets(nodes.select("key", "n", "buckets"), texts)
    winners = (nodes.join(roots.select(F.col("u").alias("key"), "v"), "key", "left").groupBy(F.coalesce("v", "key").alias("node"))
               .agg(F.min("first").alias("first")).select("first.copy_no"))
    winners = stored(winners, "copies-kept")
    removed(nodes, roots)
    return marked.select("copy_no", "row").join(winners, "copy_no", "left_semi").select("row.*")
