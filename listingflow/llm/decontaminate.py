"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case (A-Z) without ASCII punctuation.  A test item longer than
``PASSAGE`` words is cut into passages.  A copy keeps at least ``SIMILARITY`` of the
passage's words in order and inserts at most ``INSERTED`` of its length.  A lost word costs two
of the passage's two-word grams and an inserted one costs one, so of the g = w - 1 grams of w words
t = g - 3 * 0.2 * w survive: 15 of 39 for 40 words.  A copy therefore holds one of the g - t + 1 rarest
grams by their counts over all documents; a document meets a passage by such a seed, has to hold t of
its grams close together, and only then is aligned.  Score 1 for an equal word, -1/2 for a different one or a gap.
A match needs ``SIMILARITY`` of the passage's words equal on the best path.

The benchmark is a stated query set: it is read in blocks of at most about ``BLOCK`` words
and each block is broadcast and held against all documents.  Defined results: null or
empty texts and items match nothing, nor do items of fewer than three words; repeated rows
match each for itself; an item that stands several times in a document counts once, with
its best alignment (of equal ones the first); an empty table of documents or items gives no row; texts of
any length are read whole; other columns are left out, or carried in a struct where rows are kept, so names cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from string import punctuation
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

GRAM, SIMILARITY, PASSAGE, BLOCK = 2, 0.8, 200, 500_000
#: Words of the shortest item that is looked for.
SHORTEST = 3
MISS, GAP = -0.5, -0.5
#: Words that a copy may insert, as a share of the passage.
INSERTED = 0.2
#: Least score of a copy: a fifth of the words replaced, each a lost match and a miss, and the inserted words.
LEAST = SIMILARITY + (1 - SIMILARITY) * MISS + INSERTED * GAP
_FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = punctuation.encode()


def word_codes(text: bytes) -> np.ndarray:
    words = text.lower().translate(None, _PUNCTUATION).split()
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def gram_codes(codes: np.ndarray) -> np.ndarray:
    n = max(0, len(codes) - GRAM + 1)
    mixed = codes[:n].copy()
    for k in range(1, GRAM):
        mixed = mixed * _MIX + codes[k:n + k]
    return mixed * _MIX ^ (mixed >> np.uint64(29))


def surviving(words: int) -> int:
    """Grams that a copy of a passage keeps at least."""
    lost, inserted = int((1 - SIMILARITY) * words + 1e-9), int(INSERTED * words + 1e-9)
    return max(1, words - GRAM + 1 - GRAM * lost - (GRAM - 1) * inserted)


class Seeds:
    """The passages of a block of test items and an index of their grams."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.item, self.codes, grams, owner, place = [], [], [], [], []
        for item_id, text in items:
            codes = word_codes(text or b"")
            parts = -(-len(codes) // PASSAGE) if len(codes) >= SHORTEST else 0
            for part in np.array_split(codes, parts) if parts else []:
                g = gram_codes(part)
                grams.append(g)
                owner.append(np.full(len(g), len(self.codes)))
                place.append(np.arange(len(g)))
                self.item.append(item_id)
                self.codes.append(part)
        empty = np.zeros(0, np.int64)
        grams = np.concatenate(grams) if grams else empty.astype(np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], *(np.concatenate(x or [empty])[order] for x in (owner, place))
        self.keys, self.first = np.unique(self.grams, return_index=True)
        self.last = np.append(self.first[1:], len(self.grams))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.rare = np.ones(len(self.grams), bool)
        self.need = np.array([surviving(len(c)) for c in self.codes], np.int64)

    @classmethod
    def restored(cls, state: dict) -> Seeds:
        """Seeds from their broadcast state: plain arrays, which need no module on the executors."""
        seeds = cls.__new__(cls)
        seeds.__dict__.update(state)
        return seeds

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text at which a gram of the block starts, and the number of that gram."""
        grams = gram_codes(codes)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        key = np.searchsorted(self.keys, grams[at])
        found = self.keys[np.minimum(key, len(self.keys) - 1)] == grams[at] if len(at) else np.zeros(0, bool)
        return at[found], key[found]

    def choose_rare(self, counts: dict[int, int]) -> None:
        """Seeds of a passage: its g - t + 1 rarest grams by the counts over all documents."""
        often = np.array([counts.get(int(g), 0) for g in self.grams], np.int64)
        order = np.lexsort((self.place, self.grams, often, self.owner))
        starts = np.searchsorted(self.owner[order], np.arange(len(self.codes)))
        rank = np.arange(len(order)) - starts[self.owner[order]]
        words = np.array([len(c) for c in self.codes], np.int64)
        self.rare[order] = rank < ((words - GRAM + 1) - self.need + 1)[self.owner[order]]

    def matches(self, text: bytes) -> list[tuple[object, float, int, int, int, int]]:
        """(item, similarity, equal words, words, first word, end word) of the items in a text."""
        codes = word_codes(text)
        at, key = self.hits(codes)
        if not len(at):
            return []
        count = self.last[key] - self.first[key]
        entry = np.repeat(self.first[key], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(at, count)
        best: dict = {}
        owners = self.owner[entry]
        # passages with a seed here and enough different grams in the text; most end at this count
        seeded = np.unique(owners[self.rare[entry]])
        if not len(seeded):
            return []
        held = np.bincount(self.owner[np.unique(entry)], minlength=len(self.codes))
        for p in seeded[held[seeded] >= self.need[seeded]]:
            mine = owners == p
            passage = self.codes[p]
            need = self.need[p]
            spots, grams = place[mine], self.place[entry[mine]]
            if len(np.unique(grams)) < need:
                continue
            reach = len(passage) * 2
            cuts = np.flatnonzero(np.diff(spots) > reach) + 1
            for near, theirs in zip(np.split(spots, cuts), np.split(grams, cuts)):
                if len(np.unique(theirs)) < need:
                    continue
                start, end = max(0, near[0] - reach), min(len(codes), near[-1] + GRAM + reach)
                for lo in range(start, max(start + 1, end - reach), 16 * reach):
                    found = align(passage, codes[lo:min(end, lo + 18 * reach)])
                    if found and found[0] >= SIMILARITY * len(passage):
                        equal, first, last = found
                        row = (equal / len(passage), equal, len(passage), int(lo + first), int(lo + last))
                        item = self.item[p]
                        if item not in best or row[0] > best[item][0]:
                            best[item] = row
        return [(item, *row) for item, row in sorted(best.items(), key=lambda x: str(x[0]))]


def align(passage: np.ndarray, window: np.ndarray) -> tuple[int, int, int] | None:
    """Equal words, first and end word in the window of the best local alignment, if it scores enough."""
    n = len(window)
    steps = -GAP * np.arange(n + 1, dtype=np.float32)
    table = np.zeros((len(passage) + 1, n + 1), np.float32)
    for i, word in enumerate(passage, 1):
        row = np.zeros(n + 1, np.float32)
        row[1:] = np.maximum(table[i - 1, :-1] + np.where(window == word, 1.0, MISS), table[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        table[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    if table[i, j] < LEAST * len(passage) - 1e-3:
        return None
    equal, end = 0, int(j)
    while i and j and table[i, j] > 1e-4:
        same = passage[i - 1] == window[j - 1]
        if abs(table[i, j] - table[i - 1, j - 1] - (1.0 if same else MISS)) < 1e-3:
            equal, i, j = equal + int(same), i - 1, j - 1
        elif abs(table[i, j] - table[i - 1, j] - GAP) < 1e-3:
            i -= 1
        else:
            j -= 1
    return equal, int(j), end


def blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Seeds]:
    """The benchmark in blocks of bounded size, each with its seeds chosen by corpus counts."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // (6 * BLOCK) + 1
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        seeds = Seeds([tuple(r) for r in mine.orderBy("item_id", "text").collect()])
        if len(seeds.codes):
            seeds.choose_rare(gram_counts(docs, seeds))
            yield seeds


def gram_counts(docs: DataFrame, seeds: Seeds) -> dict[int, int]:
    """How often each gram of the block occurs in all documents; summed per task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(seeds))

    def count(batches):
        known = Seeds.restored(shared.value)
        total = np.zeros(len(known.keys), np.int64)
        for batch in batches:
            for text in batch.column(0):
                at, key = known.hits(word_codes(text.as_py() or b""))
                np.add.at(total, key, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    rows = (docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n"))).collect()
    return {int(seeds.keys[r.gram]): r.n for r in rows}


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, similarity, places in words."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = (f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, similarity double, "
              "equal_words long, item_words long, first_word long, end_word long")
    found = spark.createDataFrame([], schema)
    for seeds in blocks(docs, benchmark):
        shared = spark.sparkContext.broadcast(vars(seeds))

        def search(batches, shared=shared):
            known = Seeds.restored(shared.value)
            for batch in batches:
                rows = [(k, *m) for k, text in enumerate(batch.column(1)) for m in known.matches(text.as_py() or b"")]
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])],
                        ["doc_id", "item_id", "similarity", "equal_words", "item_words", "first_word", "end_word"])

        found = found.union(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(search, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, all columns as they were."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("binary").alias("text"))
    for seeds in blocks(docs, benchmark):
        rows = rows.where(_clean(docs.sparkSession, seeds)("text"))
    return rows.select("row.*")


def _clean(spark, seeds: Seeds):
    shared = spark.sparkContext.broadcast(vars(seeds))

    @F.pandas_udf(BooleanType())
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Seeds.restored(shared.value)
        for batch in texts:
            yield pd.Series([not known.matches(t or b"") for t in batch], dtype=bool)

    return clean
