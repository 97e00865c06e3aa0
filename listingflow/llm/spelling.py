"""Spelling variants: words within one edit, met by asymmetric q-chunks.

Of two near words the shorter one (equal lengths: the first in code-point order) gives two disjoint chunks,
its halves; the other gives its positional grams of those lengths.  One edit leaves one half intact, and what
stands behind an edit is moved by the difference of the lengths, zero or one, so a gram meets a chunk at its
own place or one further: an equi-join on length, place and gram, then an exact check of one edit.

A half that many words share (more than ``CROWD`` on both sides together) would try all pairs of them.
Its words are cut again: the other half without one code point, or whole where the longer word has the extra
one, becomes part of the key.  Words that meet there are near, so nothing is tried in vain and nothing lost.

Words are counted before anything is joined; joins see distinct words only.

Defined results: null and empty texts hold no word; a null doc_id counts as empty in the damage rule;
repeated rows count again; ties of forms go to the smaller word in code-point order; an empty table gives
no row; texts of any length are read whole; other columns are left out, so their names cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: What a run is, and which letters are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT, RATIO, DAMAGED = 6, 5, 5, 199
#: Words that may share one chunk before it is cut again.
CROWD = 256


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where the checksum of document and run says so."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (mark % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(mark % DAMAGED == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of whole texts that are long and frequent enough."""
    # the outer form: else Spark derives a filter on the array and extracts all runs twice
    runs = docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(word: Column, start: Column, size: Column) -> Column:
    return F.substring(word, start + 1, size)


def _halves() -> Column:
    """Of the chunk side: length, which half, the half and the rest."""
    size, cut = F.char_length("word"), F.floor(F.char_length("word") / 2).cast("int")
    first, second = _part(F.col("word"), F.lit(0), cut), _part(F.col("word"), cut, size - cut)
    return F.array(F.struct(size.alias("len"), F.lit(0).alias("half"), first.alias("chunk"), second.alias("rest")),
                   F.struct(size.alias("len"), F.lit(1).alias("half"), second.alias("chunk"), first.alias("rest")))


def _grams() -> Column:
    """Of the gram side, for chunk words as long (``more`` 0) and one shorter (``more`` 1): the grams at the places
    where such a word's half can stand, and the rest of the word."""
    word, out = F.col("word"), []
    for more in (0, 1):
        size = F.char_length("word") - more
        cut = F.floor(size / 2).cast("int")
        # a kept first half stands in front, or one further if the extra code point comes before it; likewise the second
        for half, start, span in ((0, F.lit(0), cut), (1, cut, size - cut)):
            for shift in range(more + 1):
                at = start + shift
                rest = F.concat(_part(word, F.lit(0), at), _part(word, at + span, F.char_length("word")))
                out.append(F.struct(size.alias("len"), F.lit(half).alias("half"), _part(word, at, span).alias("chunk"),
                                    rest.alias("rest"), F.lit(more).alias("more"), F.lit(shift).alias("shift")))
    return F.array(*out)


KEY = ["len", "half", "chunk"]


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: every pair of distinct words that differ by one inserted, deleted or replaced code point, once.

    ``words`` has one column word without repeats.
    """
    chunks = words.select("word", F.inline(_halves()))
    grams = words.select("word", F.inline(_grams()))
    sizes = (chunks.select(*KEY, F.lit(0).alias("side")).union(grams.select(*KEY, F.lit(1).alias("side")))
             .groupBy(*KEY).agg(F.sum(1 - F.col("side")).alias("na"), F.sum("side").alias("nb")).where("na > 0 AND nb > 0"))
    sizes = stored(sizes.select(*KEY, (F.col("na") + F.col("nb") > crowd).alias("crowded")), "spelling-chunks")
    a = chunks.join(sizes, KEY).withColumnRenamed("word", "a").withColumnRenamed("rest", "a_rest")
    b = grams.join(sizes, KEY).withColumnRenamed("word", "b").withColumnRenamed("rest", "b_rest")
    # shorter first, then code-point order: each pair has one chunk side
    later = (F.col("more") == 1) | (F.col("a") < F.col("b"))
    plain = (a.where("NOT crowded").drop("crowded").join(b.where("NOT crowded").drop("crowded"), KEY)
             .where(later & (F.levenshtein("a_rest", "b_rest", 1) == 1)))
    return plain.select("a", "b").union(_crowded(a, b, later)).where(F.levenshtein("a", "b", 1) == 1).distinct()


def _crowded(a: DataFrame, b: DataFrame, later: Column) -> DataFrame:
    """Pairs of crowded chunks: the rests meet without the code point in which they differ."""
    def without(rest):
        return F.transform(F.sequence(F.lit(1), F.char_length(rest)), lambda i: F.struct(
            i.alias("gap"), F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.char_length(rest))).alias("left")))
    a, b = a.where("crowded"), b.where("crowded")
    key = KEY + ["more", "gap", "left"]
    replaced_a = a.select(*KEY, "a", F.lit(0).alias("more"), F.inline(without(F.col("a_rest"))))
    replaced_b = b.where("more = 0").select(*KEY, "b", "more", F.inline(without(F.col("b_rest"))))
    longer_a = a.select(*KEY, "a", F.lit(1).alias("more"), F.lit(0).alias("gap"), F.col("a_rest").alias("left"))
    longer_b = b.where("more = 1").select(*KEY, "b", "more", F.inline(without(F.col("b_rest")))).withColumn("gap", F.lit(0))
    return (replaced_a.union(longer_a).join(replaced_b.union(longer_b).distinct(), key).where(later).select("a", "b"))


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(vocabulary(docs, least_chars, least_count), "spelling-words")
    pairs = stored(near_pairs(words.select("word")), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the largest n, then the smallest word: both are decided by aggregates that combine before the shuffle
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("is_form"), F.col("best.near")).alias("form"),
                                F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    return found.join(_roots(found), "word", "left").withColumn("root", F.coalesce("root", "word")) \
        .select("word", "form", "root", "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """word, root of the words that have a form.  Counts rise along the forms, so there is no cycle; each round
    doubles the steps taken, and the last one finds no word to move."""
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
