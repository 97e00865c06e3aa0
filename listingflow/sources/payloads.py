"""Landed JSON payloads: listing pages and detail bodies with declared schemas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import listing

LISTING_SCHEMA = ("struct<status:string,data:struct<totalCount:bigint,"
                  "requisitions:array<struct<id:string,title:string>>>>")
DETAIL_SCHEMA = ("struct<category:string,key:string,"
                 "components:array<struct<type:string,content:struct<text:string>>>>")


def _parsed(pages: DataFrame, payload: str) -> tuple[DataFrame, Column, Column]:
    """Pages with their payload read (``_p``), the total a page declares and whether it can be used."""
    total = F.col("_p.data.totalCount")
    good = (F.col("_p.status") == "Success") & total.isNotNull() & (total >= 0) & F.col(
        "_p.data.requisitions").isNotNull()
    return pages.withColumn("_p", F.from_json(payload, LISTING_SCHEMA)), total, good


def listing_rows(pages: DataFrame, payload: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of successful payload pages with the total each page declares; the rest are rejects."""
    parsed, total, good = _parsed(pages, payload)
    rows = parsed.filter(good).select(
        key, total.alias("declared_total"), F.posexplode("_p.data.requisitions").alias("pos", "r")).select(
        key, "declared_total", "pos", F.col("r.id").alias("reference"), F.col("r.title").alias("title"))
    return rows, parsed.filter(~F.coalesce(good, F.lit(False))).drop("_p")


def proved_listings(pages: DataFrame, payload: str, page_size: Column | None = None) -> DataFrame:
    """Evidence of listings that come as payload pages (listing_id, page): the totals that their pages declare count, and a
    page that was refused is a reason of its own, also where no page of the listing could be read."""
    parsed, total, good = _parsed(pages.select("listing_id", "page", payload), payload)
    # one row per reference, and one for a refused page, so that pages are read once
    ref = lambda r: F.struct(F.lit(False).alias("refused"), r["id"].alias("ref"))
    lost = F.array(F.struct(F.lit(True).alias("refused"), F.lit(None).cast("string").alias("ref")))
    rows = parsed.select("listing_id", "page", F.when(good, total).alias("declared_total"), F.explode(
        F.when(F.coalesce(good, F.lit(False)), F.transform("_p.data.requisitions", ref)).otherwise(lost)).alias("_r"))
    flat = rows.select("listing_id", F.when(~F.col("_r.refused"), F.col("page")).alias("page"), "_r.ref", "_r.refused", "declared_total")
    return listing.listing_evidence(flat, total=F.col("declared_total"), page_size=page_size, refused=F.col("refused"))


def merged_body(payload: Column, text_kind: str = "CustomText", skip_kind: str = "CustomSpace") -> Column:
    """Struct (key, body, unknown): text components joined in order; an unrecognised
    component kind makes the body unusable rather than silently shorter."""
    p = F.from_json(payload, DETAIL_SCHEMA)
    parts = p["components"]
    texts = F.transform(F.filter(parts, lambda c: c["type"] == text_kind), lambda c: c["content"]["text"])
    unknown = F.exists(parts, lambda c: ~c["type"].eqNullSafe(F.lit(text_kind))
                       & ~c["type"].eqNullSafe(F.lit(skip_kind)))
    return F.struct(p["key"].alias("key"), F.array_join(texts, "\n").alias("body"), unknown.alias("unknown"))


def variant_number(payload: Column, path: str) -> Column:
    """One number of a payload without a fixed layout."""
    return F.try_variant_get(F.try_parse_json(payload), path, "bigint")
