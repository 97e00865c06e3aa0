"""Removal of repeated passages with suffix arrays built by two-stage sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a document of
smaller id, or further left in the same one) goes; all strings are judged on the input.

Equal strings have to meet.  A string's key is its smallest 32-byte gram by hash, so equal
strings have equal keys, and the strings of a document that follow each other with one key
form a run of about 35.  Runs are shuffled by key as five numbers, without text:

* a run whose whole content stands earlier under the same key is a repeat;
* a key with one content that does not repeat inside itself is settled, too;
* only the first run of each content of the other keys is cut out of its text, and the
  contents of a key go into a suffix array, where strings that share ``LENGTH`` bytes are
  neighbours.

The suffix array is made in two stages: suffixes smaller than their successors are sorted
directly, the others are induced by one scan over the buckets of first bytes; then the
common prefixes of neighbours are compared.  Repeats inside one batch are settled before
the shuffle, so a passage of a third of the documents sends one run per batch and key; the
runs at its ends, which differ in what stands beside it, still meet under one key.

Whole contents are compared by 64-bit gram hash and 64-bit content hash together; strings
inside the arrays byte by byte.  Defined results: null is the empty text; texts shorter
than ``LENGTH`` keep everything; null ids come last; of rows that share an id but not the
text, the order is that of a text hash; rows equal in both are one document, each with its
result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, whole_groups

LENGTH, GRAM, LONGEST, CHUNK = 100, 32, 128, 1 << 16
_GRAMS = LENGTH - GRAM + 1  # grams of one string
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                               0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]
NO_ID = (1 << 63) - 1


# --- runs of strings with one key -------------------------------------------------------

def runs(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, content hash, start, strings, repeats inside) of the runs of one stretch of bytes."""
    hashed = data.astype(np.uint64) * _ODD[0] + _ODD[1]
    size = 1
    for odd in _ODD[1:6]:  # grams of 2, 4, 8, 16, 32 bytes
        hashed = hashed[:-size] * odd + hashed[size:]
        size *= 2
    gram = hashed * _ODD[0]
    gram ^= gram >> np.uint64(32)
    gram *= _ODD[5]
    least, size = gram, 1
    while size * 2 <= _GRAMS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < _GRAMS:
        least = np.minimum(least[:size - _GRAMS], least[_GRAMS - size:])
    # a string may equal a later one of its run only where a smallest gram leaves and the key stays
    stays = np.zeros(len(least), bool)
    stays[:-1] = (gram[:len(least) - 1] == least[:-1]) & (least[1:] == least[:-1])
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    count = np.diff(np.append(start, len(least)))
    if count.max() > LONGEST:
        pieces = -(-count // LONGEST)
        first = np.repeat(start, pieces)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first + nth * LONGEST
        count = np.diff(np.append(start, len(least)))
    last = start + count - 1 + LENGTH - GRAM  # where the last gram of the content starts
    content = count.astype(np.uint64)
    for offset in range(0, LONGEST + LENGTH, GRAM):
        content = (content + hashed[np.minimum(start + offset, last)]) * _ODD[2 + offset // GRAM % 3]
        content ^= content >> np.uint64(29)
    inside = np.logical_or.reduceat(stays, start)
    return least[start].view(np.int64), content.view(np.int64), start, count, inside


def _stretches(sizes: np.ndarray):
    """Documents (first, end) taken together up to CHUNK bytes; a longer one stands alone."""
    first, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > CHUNK:
            yield first, k
            first, held = k, 0
        held += size
    if held:
        yield first, len(sizes)


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of a binary column without nulls."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _batch_runs(offsets: np.ndarray, data: np.ndarray):
    """Runs of all documents of a batch: key, content, document, start, strings, inside."""
    out = []
    for a, b in _stretches(np.diff(offsets)):
        lo, hi = offsets[a], offsets[b]
        # a stretch longer than four chunks is one document, read in overlapping parts
        for part in range(lo, hi, 4 * CHUNK):
            piece = data[part:min(hi, part + 4 * CHUNK + LENGTH - 1)]
            if len(piece) < LENGTH:
                continue
            key, content, start, count, inside = runs(piece)
            if b - a > 1:  # cut runs at the ends of documents; their strings must not cross
                bounds = offsets[a + 1:b] - lo
                doc = np.searchsorted(bounds, start, side="right")
                end = np.append(bounds, hi - lo)[doc]
                whole = start + count + LENGTH - 1 <= end
                again = ~whole
                keep = [x[whole] for x in (key, content, start, count, inside)] + [doc[whole]]
                extra = [keep]
                for s, c, d in zip(start[again].tolist(), count[again].tolist(), doc[again].tolist()):
                    # the part in the first document, and what follows in later ones
                    while c > 0:
                        e = int(bounds[d]) if d < len(bounds) else hi - lo
                        mine = min(s + c, e) - s
                        fit = min(s + c, e - LENGTH + 1) - s
                        if fit > 0:
                            k2, c2, s2, n2, i2 = runs(piece[s:s + fit + LENGTH - 1])
                            extra.append([k2, c2, s2 + s, n2, i2, np.full(len(k2), d)])
                        s, c, d = s + mine, c - mine, d + 1
                key, content, start, count, inside, doc = (np.concatenate(x) for x in zip(*extra))
                start = start - np.concatenate(([0], bounds))[doc]
            else:
                doc = np.zeros(len(key), np.int64)
                start = start + (part - lo)
            out.append((key, content, doc + a, start, count, inside))
    if not out:
        return [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    return [np.concatenate(x) for x in zip(*out)]


def _run_rows(batches):
    """key, content, id, tie, span; a repeat within the batch gets a key of its own and the known flag."""
    for batch in batches:
        ids, ties = (batch.column(k).to_numpy() for k in (0, 1))
        key, content, doc, start, count, inside = _batch_runs(*_bytes(batch.column(2)))
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ties, ids))] = np.arange(len(ids))
        order = np.lexsort((start, rank[doc], content, key))
        key, content, doc, start, count, inside = (x[order] for x in (key, content, doc, start, count, inside))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        known = (ids[doc] != ids[doc[first]]) | (ties[doc] != ties[doc[first]]) | (start != start[first])
        keep = new | known  # the rest are rows equal in id and text
        span = (start << 16) | (count << 2) | (inside.astype(np.int64) << 1) | known
        spread = ((ids[doc] ^ (start << 20)).astype(np.uint64) * _ODD[0]).view(np.int64)
        columns = [np.where(known, spread, key), content, ids[doc], ties[doc], span]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["key", "content", "id", "tie", "span"])


def _judged(batches):
    """id, tie, span, key, open: repeats (open false) and first runs that need a look (open true)."""
    for rows, starts, _ in whole_groups(batches, 1):
        key, content, ids, ties, span = (c.to_numpy() for c in rows.columns)
        known = (span & 1).astype(bool)
        new = ~known
        new[1:] &= (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | known[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        again = known | (~new & ((ids != ids[first]) | (ties != ties[first]) | (span >> 16 != span[first] >> 16)))
        contents = np.add.reduceat(new.astype(np.int64), starts)
        several = np.repeat(contents > 1, np.diff(np.append(starts, len(key))))
        look = new & (several | ((span >> 1) & 1).astype(bool))
        keep = again | look
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (ids, ties, span, key, look)], ["id", "tie", "span", "key", "open"])


# --- the suffix array -------------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (bytes, 0 separates) in the order of their suffixes, to ``depth`` bytes."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    at = np.searchsorted(differs, np.arange(n))
    turn = np.append(differs, n - 1)[at]
    smaller = np.zeros(n, bool)  # smaller than the successor; the last suffix is larger than the end
    smaller[:-1] = text[turn[:-1]] < text[np.minimum(turn[:-1] + 1, n - 1)]
    raw = text.tobytes()
    mine = np.flatnonzero(smaller)
    heads = [raw[i:i + depth] for i in mine.tolist()]
    direct = mine[np.fromiter(sorted(range(len(heads)), key=heads.__getitem__), np.int64, len(heads))]
    direct_first = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Hand the larger predecessors of scanned suffixes to their buckets; those of this bucket come back."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        others = first != byte
        order = np.argsort(first[others], kind="stable")
        moved, byte_of = before[others][order], first[others][order]
        cuts = np.flatnonzero(byte_of[1:] != byte_of[:-1]) + 1
        if len(moved):
            for part in np.split(moved, cuts):
                waiting[text[part[0]]].append(part)
        return before[~others]

    waiting[text[n - 1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(wave):
            order.append(wave)
            wave = induce(wave, byte)
        own = direct[direct_first[byte]:direct_first[byte + 1]]
        if len(own):
            order.append(own)
            induce(own, byte)
    return np.concatenate(order)


def repeated_strings(contents: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(content, offset) of the strings of ``length`` bytes that stand earlier in the list or further left."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8) + np.uint8(1)  # 0xff is in no UTF-8 text
    begins = np.zeros(len(text), bool)
    for_each = sizes - length + 1
    starts = np.repeat(first, for_each) + np.arange(for_each.sum()) - np.repeat(np.cumsum(for_each) - for_each, for_each)
    begins[starts] = True
    order = suffix_order(text, length + 8)
    order = order[begins[order]]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)).view(np.uint64)[:, 0]
    same = np.ones(max(0, len(order) - 1), bool)
    for offset in [*range(0, length - 8, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = words[order[left] + offset] == words[order[left + 1] + offset]
    heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
    earliest = np.minimum.reduceat(order, heads)  # positions follow the order of the documents
    again = np.sort(order[order != np.repeat(earliest, np.diff(np.append(heads, len(order))))])
    content = np.searchsorted(first, again, side="right") - 1
    return content, again - first[content]


def _array_repeats(batches):
    """id, tie, span of strings that repeat among the contents of a key."""
    for rows, _, _ in whole_groups(batches, 1):
        ids, ties, starts = (rows.column(k).to_numpy() for k in (1, 2, 3))
        order = np.lexsort((starts, ties, ids))
        ids, ties, starts = ids[order], ties[order], starts[order]
        new = np.ones(len(ids), bool)  # rows equal in id and text cut out the same contents
        new[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (starts[1:] != starts[:-1])
        contents = rows.column(4).take(pa.array(order[new])).to_pylist()
        ids, ties, starts = ids[new], ties[new], starts[new]
        content, offset = repeated_strings(contents)
        if not len(content):
            continue
        cut = np.concatenate(([0], np.flatnonzero((content[1:] != content[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1))
        count = np.diff(np.append(cut, len(content)))
        at = content[cut]
        span = ((starts[at] + offset[cut]) << 16) | (count << 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ties[at]), pa.array(span)], ["id", "tie", "span"])


def _cut_out(batches):
    """The contents of the runs that need a look."""
    for batch in batches:
        ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [(key, i, t, span >> 16, text[span >> 16:(span >> 16) + ((span >> 2) & 0x3FFF) + LENGTH - 1])
               for i, t, text, spans in zip(ids, ties, batch.column(2).to_pylist(), batch.column(3).to_pylist())
               for span, key in ((s["span"], s["key"]) for s in spans)]
        for k in range(0, len(out), 20_000):
            columns = list(zip(*out[k:k + 20_000]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                                             ["key", "id", "tie", "start", "content"])


def removed_runs(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a document."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.sort(spans)
    start = spans >> 16
    end = np.maximum.accumulate(start + ((spans >> 2) & 0x3FFF) + LENGTH - 1)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _kept(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            start, end = removed_runs(spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64))
            digest, at = hashlib.sha256(), 0
            for s, e in zip(start.tolist(), end.tolist()):
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            out.append((len(text), int((end - start).sum()), len(start), digest.hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the keyed texts, and a stored table id, tie, span of repeated strings."""
    shared = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared_id"))
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if shared.isEmpty():
        texts = texts.withColumn("tie", F.lit(0).cast("long"))
    else:  # only where ids repeat does the text decide the order of rows
        texts = (texts.join(shared, F.col("doc_id").eqNullSafe(F.col("shared_id")), "left")
                 .withColumn("tie", F.when(F.col("shared_id").isNotNull() | F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))))
    texts = texts.select("doc_id", "id", "tie", F.col("text").cast("binary").alias("text"))
    found = stored(
        texts.where(F.octet_length("text") >= LENGTH).select("id", "tie", "text")
        .mapInArrow(_run_rows, "key long, content long, id long, tie long, span long")
        .repartition("key").sortWithinPartitions("key", "content", "id", "tie", "span")
        .mapInArrow(_judged, "id long, tie long, span long, key long, open boolean"), "suffix-judged")
    looks = found.where("open").groupBy("id", "tie").agg(F.collect_list(F.struct("span", "key")).alias("spans"))
    again = (texts.join(looks, ["id", "tie"]).select("id", "tie", "text", "spans")
             .mapInArrow(_cut_out, "key long, id long, tie long, start long, content binary")
             .repartition("key").sortWithinPartitions("key")
             .mapInArrow(_array_repeats, "id long, tie long, span long"))
    return texts, found.where("NOT open").select("id", "tie", "span").union(stored(again, "suffix-arrays"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts, spans = repeats(docs)
    by_doc = spans.groupBy("id", "tie").agg(F.collect_list("span").alias("spans"))
    return (texts.join(by_doc, ["id", "tie"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_kept, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
