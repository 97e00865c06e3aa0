"""State x batch joins: upsert, absence, detail reuse, identity checks, generations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V


def latest_state(obs: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last row per key by map-side aggregation."""
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def dedupe(df: DataFrame, key: str, seq: str, keep: str) -> DataFrame:
    """First or last delivery per id; ``seq`` must be unique, rows have no order of their own."""
    pick = F.max if keep == "last" else F.min
    rest = [F.col(c) for c in df.columns if c not in (key, seq)]
    return df.groupBy(key).agg(pick(F.struct(F.col(seq), *rest)).alias("_r")).select(key, "_r.*")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer merge: insert, update, keep (seen, same) or absent (state row not in batch)."""
    s = state.select(*keys, F.struct(*fields).alias("old"))
    b = batch.select(*keys, F.struct(*fields).alias("new"))
    same = F.col("old").eqNullSafe(F.col("new"))
    action = (F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "absent")
              .when(same, "keep").otherwise("update"))
    merged = F.coalesce("new", "old")
    return s.join(b, keys, "full_outer").select(
        *keys, action.alias("action"), *[merged[f].alias(f) for f in fields])


def absent_from_batch(state: DataFrame, batch: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """State rows a proven listing did not contain; unproven listings show nothing absent."""
    whole = runs.filter("accepted").select("source_id").distinct()
    return state.join(whole, "source_id", "left_semi").join(batch.select(*keys), keys, "left_anti")


def reuse_detail(joined: DataFrame, today: Column, ttl_days: Column) -> Column:
    """Whether a cached detail may stand in for a new read of this listing row.

    ``joined`` holds the listing row and a nullable struct ``old`` of its stored record.
    """
    old = F.col("old")
    ttl = F.least(F.lit(V.DETAIL_TTL_MAX), F.greatest(F.lit(V.DETAIL_TTL_MIN), ttl_days))
    age = F.datediff(today, old["detail_verified_at"])
    near = (old["deadline_type"] == "closing") & (
        old["deadline"] <= F.date_add(today, V.DETAIL_NEAR_CLOSING_DAYS))
    ok = (old["detail_complete"] & (F.coalesce(old["description"], F.lit("")) != "") & ~old["refresh_failed"] & ~old["source_closed"]
          & ~old["status"].isin("missing", "closed")
          & (old["fingerprint"] == F.col("fingerprint"))
          & (age >= 0) & (age < ttl) & ~F.coalesce(near, F.lit(False)))
    return F.coalesce(ok, F.lit(False))


#: What a reused detail brings along from the stored record.
CACHED_FIELDS = ["title", "department", "description", "match_text", "employment_type", "posted_date", "deadline",
                 "deadline_type", "deadline_raw", "detail_verified_at"]


def with_cached_detail(joined: DataFrame, today: Column, ttl_days: Column) -> DataFrame:
    """Listing rows whose detail need not be read again, filled from the stored record.

    ``detail_from_cache`` marks them; such a row is complete and its refresh did not fail.
    """
    hit = F.col("detail_from_cache")
    rows = joined.withColumn("detail_from_cache", reuse_detail(joined, today, ttl_days))
    filled = {f: F.when(hit, F.col("old")[f]).otherwise(F.col(f)) for f in CACHED_FIELDS}
    return rows.withColumns(filled | {"detail_complete": hit | F.col("detail_complete"),
                                      "detail_refresh_failed": ~hit & F.col("detail_refresh_failed")})


def refresh_priority() -> Column:
    """New, then changed listing, then failed or incomplete, then oldest verified."""
    old = F.col("old")
    return (F.when(old.isNull(), 0)
            .when(~old["fingerprint"].eqNullSafe(F.col("fingerprint")), 1)
            .when(old["refresh_failed"] | ~old["detail_complete"], 2).otherwise(3))


def fill_from_edition(main: DataFrame, other: DataFrame, ref: str, fields: list[str],
                      complete: str = "detail_complete") -> DataFrame:
    """Fill incomplete records from a parallel edition with the same reference."""
    o = other.select(ref, F.struct(complete, *fields).alias("_o"))
    take = ~F.col(complete) & F.coalesce(F.col(f"_o.{complete}"), F.lit(False))
    out = main.join(o, ref, "left").withColumn("_take", take)
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_take"), F.col("_o")[f]).otherwise(F.col(f)))
    return (out.withColumn(complete, F.col(complete) | F.col("_take"))
            .withColumnRenamed("_take", "filled").drop("_o"))
