"""Evidence that a listing is whole, and the volume rule over its runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V


def listing_evidence(pages: DataFrame, listing: str = "listing_id", page: str = "page",
                     ref: str = "ref", total: Column | None = None,
                     page_size: Column | None = None, refused: Column | None = None) -> DataFrame:
    """One row per listing: reasons why its pages do not prove it whole (none = whole).

    Rows first shrink to (listing, page, ref) counts map-side, so neither a hot listing
    nor a distinct count over it meets one task.  ``total`` is the total that each page
    declares; without it the page range itself is the claim.  Every cell then counts once for its page and
    once for its ref in the same grouping, so the rows are computed once and not joined to themselves.

    ``refused`` marks rows that stand for a page that could not be read: a reason of its own, also of a listing without any other page.
    """
    claim = total if total is not None else F.lit(None).cast("bigint")
    size = page_size if page_size is not None else F.lit(None).cast("bigint")
    lost = refused if refused is not None else F.lit(False)
    cells = pages.select(
        F.col(listing).alias("listing_id"), F.col(page).alias("page"), F.col(ref).alias("ref"), lost.alias("refused"),
        claim.alias("declared"), size.alias("size")
    ).filter("refused OR listing_id IS NOT NULL").groupBy("listing_id", "page", "ref", "refused").agg(
        F.count("*").alias("n"), F.min("declared").alias("lo"), F.max("declared").alias("hi"),
        F.max("size").alias("size"))
    sides = F.when(F.col("refused"), F.array(F.lit("refused"))).otherwise(F.array(F.lit("page"), F.lit("ref")))
    by_side = cells.withColumn("side", F.explode(sides)).select(
        "listing_id", "side", F.when(F.col("side") != "ref", F.col("page")).alias("page"),
        F.when(F.col("side") == "ref", F.col("ref")).alias("ref"), "n", "lo", "hi", "size"
    ).groupBy("listing_id", "side", "page", "ref").agg(
        F.count("*").alias("n_on"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"))
    of_page = lambda c: F.when(F.col("side") == "page", F.col(c))
    e = by_side.groupBy("listing_id").agg(
        F.sum(of_page("n")).alias("n_rows"), F.count_if(F.col("side") == "page").alias("n_pages"), F.min(of_page("page")).alias("first_page"),
        F.max(of_page("page")).alias("last_page"), F.min(of_page("lo")).alias("lo"), F.max(of_page("hi")).alias("hi"),
        F.max(of_page("size")).alias("size"), F.max(of_page("n")).alias("largest_page"),
        F.count_if(F.col("side") == "ref").alias("n_refs"), F.count_if((F.col("side") == "ref") & (F.col("n_on") > 1)).alias("n_overlap"),
        F.coalesce(F.sum(F.when(F.col("side") == "refused", F.col("n"))), F.lit(0)).alias("n_refused"))
    read = F.col("n_rows").isNotNull()
    e = e.withColumns({c: F.when(read, F.col(c)) for c in ("n_pages", "n_refs", "n_overlap")})
    reasons = F.array_compact(F.array(
        F.when(F.col("lo") != F.col("hi"), "total changed"),
        F.when((F.col("first_page") != 1) | (F.col("last_page") != F.col("n_pages")), "pages missing"),
        F.when(F.col("n_overlap") > 0, "id repeated across pages"),
        F.when(F.col("n_refs") != F.coalesce("hi", "n_rows"), "count differs from total"),
        F.when((F.col("largest_page") > F.col("size"))
               | (F.ceil(F.col("hi") / F.col("size")) != F.col("n_pages")), "page size inconsistent"),
        F.when(F.col("n_refused") > 0, "page refused")))
    e = e.withColumn("reasons", reasons).withColumn("whole", F.size("reasons") == 0)
    return e if refused is not None else e.drop("n_refused")


def said_empty(runs: DataFrame) -> Column:
    """Whether a run states that its list is empty; runs without the column never do."""
    return F.coalesce("explicit_empty", F.lit(False)) if "explicit_empty" in runs.columns else F.lit(False)


def volume_fold(runs: DataFrame, source: str = "source_id", order: str = "run_date",
                count: str = "n_jobs", complete: str = "listing_complete") -> DataFrame:
    """Runs with ``accepted``, ``guarded`` and the ``reference`` count they were held against.

    Only accepted listings move the reference count, so the rule is recursive and ``lag``
    cannot state it.  Rows are one per run of a source: a source's array is as long as its
    calendar, however many records it publishes.  The runs travel through the fold whole,
    which spares computing them a second time for a join.

    Two optional columns of the runs count: ``explicit_empty`` (the page says that there
    is nothing, which proves a list without rows) and ``capability`` (zero rows of a
    manual or pending source prove nothing, but are no fault either).
    """
    empty = said_empty(runs)
    silent = (F.coalesce(F.col("capability").isin(*V.SILENT_CAPABILITIES), F.lit(False))
              if "capability" in runs.columns else F.lit(False))
    run = F.struct(F.col(order).alias("at"), F.col(count).cast("bigint").alias("n"),
                   F.col(complete).alias("complete"), empty.alias("empty"), silent.alias("silent"),
                   F.struct(*runs.columns).alias("row"))
    folded = f"array<struct<row:{runs.schema.simpleString()},accepted:boolean,guarded:boolean,reference:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast(folded).alias("out"))

    def fold(acc, r):
        unproved = (r["n"] == 0) & ~r["empty"]
        dropped = ((acc["last"] >= V.DROP_MIN_COUNT) & ~r["empty"]
                   & (r["n"] < acc["last"] * F.lit(V.DROP_KEEP_RATIO)))
        accepted = r["complete"] & ~unproved & ~dropped
        row = F.struct(r["row"].alias("row"), accepted.alias("accepted"),
                       (dropped | (unproved & ~r["silent"])).alias("guarded"), acc["last"].alias("reference"))
        return F.struct(F.when(accepted, r["n"]).otherwise(acc["last"]).alias("last"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    calendars = runs.groupBy(source).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return calendars.select(F.inline_outer(F.aggregate("runs", start, fold, lambda acc: acc["out"]))).select(
        "row.*", "accepted", "guarded", "reference")


def page_profile(pages: DataFrame, listing: str = "listing_id", page: str = "page", ref: str = "ref") -> DataFrame:
    """Rows per page in page order (a few dozen pages at most), all rows and distinct ids."""
    per_ref = pages.groupBy(listing, page, ref).agg(F.count("*").alias("n"))
    per_page = per_ref.groupBy(listing, page).agg(F.sum("n").alias("n"))
    sizes = per_page.groupBy(listing).agg(
        F.array_sort(F.collect_list(F.struct(page, "n"))).alias("sizes"), F.sum("n").alias("n_rows"))
    distinct = per_ref.groupBy(listing, ref).agg(F.lit(1).alias("x")).groupBy(listing).agg(
        F.count("*").alias("n_refs"))
    return sizes.join(distinct, listing)
