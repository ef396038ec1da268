"""Shortlists: listing, item upserts and patches applied as change batches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K

ITEM_KEY = ["shortlist_id", "facility_id"]


def open_shortlists(lists: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's shortlists, newest first; without a user, every user's."""
    if user_id is not None:
        return lists.filter(F.col("user_id") == user_id).orderBy(
            F.desc("created_at"), "shortlist_id")
    return lists.orderBy("user_id", F.desc("created_at"), "shortlist_id")


def shortlist_items(items: DataFrame, fac: DataFrame, shortlist_id: str | None = None) -> DataFrame:
    """Items with facility fields, by rank with unranked last, then by time added."""
    if shortlist_id is not None:
        items = items.filter(F.col("shortlist_id") == shortlist_id)
    shown = fac.select("facility_id", "name", "city", "state", "official_phone")
    return items.join(shown, "facility_id").orderBy(
        "shortlist_id", F.asc_nulls_last("rank"), "added_at", "facility_id")


def upsert_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply insert-or-rank changes(key, seq, rank, distance_km, score, match_reason, added_at).

    As if applied one by one in ``seq`` order: a new key takes all columns from its first change,
    and the rank, of new and old keys alike, comes from the last one. One aggregate finds both.
    """
    first_cols = ["distance_km", "score", "match_reason", "added_at"]
    batch = changes.groupBy(*ITEM_KEY).agg(
        F.min(F.struct("seq", *first_cols)).alias("_first"),
        F.max(F.struct("seq", "rank")).alias("_last"))
    joined = items.withColumn("_old", F.lit(True)).join(batch, ITEM_KEY, "full")
    old, changed = F.col("_old").isNotNull(), F.col("_last").isNotNull()

    def column(c):
        if c in ITEM_KEY:
            return F.col(c)
        if c == "rank":
            return F.when(changed, F.col("_last.rank")).otherwise(F.col(c)).alias(c)
        new = F.col(f"_first.{c}") if c in first_cols else (
            F.lit("candidate") if c == "status" else F.lit(None))
        return F.when(old, F.col(c)).otherwise(new).alias(c)

    return joined.select(*[column(c) for c in items.columns])


def patch_items(items: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated, unmatched) for changes(key, seq, status, note).

    A NULL field leaves the stored value; with several changes of a key the last given value wins.
    Changes with a status outside the four states, or of an unknown item, are unmatched.
    """
    legal = F.coalesce(F.col("status").isNull() | F.col("status").isin(*K.ITEM_STATUSES),
                       F.lit(False))

    def last(c):
        return F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(f"_{c}")

    batch = changes.filter(legal).groupBy(*ITEM_KEY).agg(last("status"), last("note"))
    joined = items.join(batch, ITEM_KEY, "left")
    updated = joined.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in ("status", "note") else F.col(c)
        for c in items.columns])
    known = items.select(*ITEM_KEY).withColumn("_known", F.lit(True))
    unmatched = (changes.withColumn("_legal", legal).join(known, ITEM_KEY, "left")
                 .filter(~F.col("_legal") | F.col("_known").isNull()).drop("_legal", "_known"))
    return updated, unmatched
