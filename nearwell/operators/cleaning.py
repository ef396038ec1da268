"""Row filters, casts, dedupe and nested normalisation of the scraped directory."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell.functions import cleaning as C
from nearwell.functions.geo import in_india
from nearwell.operators.skew import first_row, latest_row


def drop_misaligned_rows(df: DataFrame) -> DataFrame:
    """Keep rows whose type is missing or known; other words betray a column-shifted row."""
    return df.filter(C.has_known_type(F.col("facilityTypeId")))


def require_keys(df: DataFrame) -> DataFrame:
    return df.filter(F.col("unique_id").isNotNull() & F.col("name").isNotNull())


def safe_casts(df: DataFrame) -> DataFrame:
    """Loose strings to typed columns; what does not parse becomes NULL."""
    return df.withColumns({
        "year_established": F.col("yearEstablished").try_cast("int"),
        "beds": F.col("capacity").try_cast("int"),
        "num_doctors": F.col("numberDoctors").try_cast("int"),
        "recency_of_update": F.col("recency_of_page_update").try_cast("date"),
    })


def dedupe_latest(df: DataFrame, key: str = "unique_id",
                  order: Sequence[str] = ("recency_of_page_update",)) -> DataFrame:
    """Newest row per id, NULL recency last; equal recencies are settled by the row itself."""
    return latest_row(df, [key], [F.col(c) for c in order])


def dedupe_first_seen(df: DataFrame, keys: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """First row per derived key in input order, e.g. per (lower(name), lower(city))."""
    keyed = df.select("*", *[c.alias(f"_{name}") for name, c in keys.items()])
    picked = first_row(keyed, [f"_{name}" for name in keys], [F.col(c) for c in order])
    return picked.select(*df.columns)


def explode_terms(bronze: DataFrame, column: str) -> DataFrame:
    """JSON-array column to distinct non-blank (facility_id, txt)."""
    term = F.explode(C.json_strings(F.col(column))).alias("val")
    return (bronze.select(F.col("unique_id").alias("facility_id"), term)
            .filter(F.col("val").isNotNull() & (F.trim("val") != ""))
            .select("facility_id", C.clean_text(F.trim("val")).alias("txt"))
            .distinct())


def explode_phones(bronze: DataFrame) -> DataFrame:
    """(facility_id, phone, is_official); the flag is NULL when no official number is known."""
    return (bronze.select(
                F.col("unique_id").alias("facility_id"), "officialPhone",
                F.explode(C.json_strings(F.col("phone_numbers"))).alias("phone"))
            .filter(F.col("phone").isNotNull() & (F.trim("phone") != ""))
            .groupBy("facility_id", "phone")
            .agg(F.max(F.col("phone") == F.col("officialPhone")).alias("is_official")))


def explode_source_urls(bronze: DataFrame) -> DataFrame:
    return (bronze.select(F.col("unique_id").alias("facility_id"),
                          F.explode(C.json_strings(F.col("source_urls"))).alias("source_url"))
            .filter(F.col("source_url").isNotNull() & (F.trim("source_url") != ""))
            .distinct())


def drop_orphans(child: DataFrame, parent: DataFrame, key: str = "facility_id") -> DataFrame:
    """Child rows whose parent exists (the foreign key of the serving tables)."""
    return child.join(parent.select(key), key, "left_semi")


def pin_defanout(pins: DataFrame) -> DataFrame:
    """One row per PIN: first district and state, ambiguity, mean centroid of in-India points.

    min/max replace a distinct count, so the aggregate is one map-side-combined pass.
    """
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    inside = in_india(lat, lng)
    rows = pins.filter(F.col("pincode").cast("string").rlike("^[0-9]{6}$")).select(
        F.col("pincode").cast("string").alias("pincode"),
        C.titlecase_region(F.col("district")).alias("d"),
        C.titlecase_region(F.col("statename")).alias("s"),
        F.when(inside, lat).alias("lat"), F.when(inside, lng).alias("lng"))
    return rows.groupBy("pincode").agg(
        F.min("d").alias("primary_district"), F.min("s").alias("primary_state"),
        F.coalesce(F.min("d") != F.max("d"), F.lit(False)).alias("is_ambiguous"),
        F.avg("lat").alias("centroid_lat"), F.avg("lng").alias("centroid_lng"))


def pin_candidate_districts(pins: DataFrame) -> DataFrame:
    """Every district a PIN is listed under, as (pincode, district) rows."""
    return (pins.filter(F.col("pincode").cast("string").rlike("^[0-9]{6}$"))
            .select(F.col("pincode").cast("string").alias("pincode"),
                    C.titlecase_region(F.col("district")).alias("district"))
            .filter("district IS NOT NULL").distinct())
