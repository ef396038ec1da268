"""The offline job: bronze directory and PIN list to the serving tables."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwell.functions import cleaning as C
from nearwell.functions import geo as G
from nearwell.operators import cleaning as OC
from nearwell.operators import evidence as OE
from nearwell.operators import geo as OG
from nearwell.operators import search as OS
from nearwell.sources.sinks import full_refresh_sink


def clean_facility(bronze: DataFrame) -> DataFrame:
    """One cleaned row per facility: keys required, misaligned rows dropped, newest row kept."""
    rows = OC.dedupe_latest(OC.drop_misaligned_rows(OC.require_keys(bronze)))
    lat, lng = G.india_bbox_guard(F.col("latitude"), F.col("longitude"))
    return OC.safe_casts(rows).select(
        F.col("unique_id").alias("facility_id"),
        C.clean_text(F.col("name")).alias("name"),
        C.normalize_type(F.col("facilityTypeId")).alias("facility_type"),
        F.lower("operatorTypeId").alias("operator_type"),
        "year_established", "beds", "num_doctors",
        C.clean_text(F.col("address_city")).alias("city"),
        C.titlecase_region(F.col("address_stateOrRegion")).alias("state"),
        C.normalize_pin(F.col("address_zipOrPostcode")).alias("pincode"),
        lat.alias("lat"), lng.alias("lng"),
        G.geo_confidence(F.col("latitude"), F.col("longitude")).alias("geo_confidence"),
        F.col("officialPhone").alias("official_phone"),
        F.col("officialWebsite").alias("official_website"), "email",
        C.clean_text(F.col("description")).alias("description"), "recency_of_update")


def search_documents(bronze: DataFrame, facility: DataFrame) -> DataFrame:
    """(facility_id, doc) of the row that was kept for each cleaned facility."""
    rows = OC.dedupe_latest(OC.drop_misaligned_rows(OC.require_keys(bronze)))
    parts = [F.col(c) for c in ("name", "specialties", "procedure", "capability", "description")]
    docs = rows.select(F.col("unique_id").alias("facility_id"),
                       C.compose_search_document(*parts).alias("doc"))
    return OC.drop_orphans(docs, facility)


TABLES = ("facility", "facility_specialty", "facility_procedure", "facility_capability",
          "facility_phone", "facility_source_url", "pin_geo", "facility_validated",
          "facility_geo", "facility_vec", "search",
          "evidence")


def open_directory(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last finished refresh under ``out``; none before the first."""
    try:
        done = spark.read.schema("seq long, version string").parquet(f"{out}/versions")
        last = done.orderBy(F.desc("seq")).first()
    except AnalysisException:  # no such folder yet
        last = None
    if last is None:
        return {}
    return {t: spark.read.parquet(f"{out}/{last['version']}/{t}") for t in TABLES}


def refresh_directory(spark: SparkSession, bronze: DataFrame, pins: DataFrame, out: str,
                      known_vectors: DataFrame | None = None, geocodes: DataFrame | None = None,
                      ) -> dict[str, DataFrame]:
    """Write every serving table as a new version under ``out`` and return them, read from there.

    A version is a folder of its own, listed in ``out/versions`` when all of it is written, so a
    refresh may read any earlier one, and one that fails leaves the last as it was. Vectors of
    unchanged documents come from ``known_vectors``, or from the last version. ``geocodes``
    (facility_id, glat, glng) are the geocoder's results so far.

    Each table is one distributed write; children and geo checks start from the written facility
    table, so the bronze rows are cleaned once.
    """
    previous = open_directory(spark, out)
    if known_vectors is None:
        known_vectors = previous.get("facility_vec")
    version = f"v-{uuid.uuid4().hex}"

    def store(name: str, df: DataFrame) -> DataFrame:
        full_refresh_sink(df, f"{out}/{version}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{version}/{name}")

    tables = {"facility": store("facility", clean_facility(bronze))}
    fac = tables["facility"]
    for name, column in (("specialty", "specialties"), ("procedure", "procedure"),
                         ("capability", "capability")):
        terms = OC.drop_orphans(OC.explode_terms(bronze, column), fac)
        tables[f"facility_{name}"] = store(f"facility_{name}", terms)
    tables["facility_phone"] = store(
        "facility_phone", OC.drop_orphans(OC.explode_phones(bronze), fac))
    tables["facility_source_url"] = store(
        "facility_source_url", OC.drop_orphans(OC.explode_source_urls(bronze), fac))
    tables["pin_geo"] = store("pin_geo", OC.pin_defanout(pins))
    silver = store("facility_validated", OG.validate_internal(fac))
    tables["facility_validated"] = silver
    if geocodes is not None:
        checked = OG.validate_geocode(silver, geocodes)
    else:
        checked = spark.createDataFrame([], ", ".join(
            ["facility_id string", *(f"{c} {t}" for c, t in OG.GEOCODE_COLUMNS.items())]))
    tables["facility_geo"] = store(
        "facility_geo", OG.final_geo_valid(OG.merge_geocode(silver, checked)))
    docs = search_documents(bronze, fac)
    new = OS.batch_embed(docs, known=known_vectors)
    if known_vectors is not None:
        current = docs.select("facility_id", F.sha2("doc", 256).alias("doc_hash"))
        kept = known_vectors.join(current, ["facility_id", "doc_hash"], "left_semi")
        new = kept.select("facility_id", "doc_hash", "embedding").unionByName(new)
    tables["facility_vec"] = store("facility_vec", new)
    tables["search"] = OS.write_search_table(
        OS.search_table(fac, tables["facility_vec"], tables["facility_geo"],
                        tables["facility_procedure"]), f"{out}/{version}/search")
    terms = OE.union_terms(*(tables[f"facility_{n}"] for n in ("specialty", "procedure", "capability")))
    tables["evidence"] = OS.write_search_table(OE.evidence_index(terms, fac), f"{out}/{version}/evidence")
    seq = 1
    if previous:
        seq += spark.read.parquet(f"{out}/versions").agg(F.max("seq")).first()[0]
    spark.createDataFrame([(seq, version)], "seq long, version string").write.mode(
        "append").parquet(f"{out}/versions")
    return tables
