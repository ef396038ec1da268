"""Scans and sinks: each query writes the whole table to shared scratch space and reads it back."""

from pyspark.sql import functions as F

from nearwell.operators import cleaning as OC
from nearwell.operators import geo as OG
from nearwell.operators import registry as OR
from nearwell.operators import sessions as ON
from nearwell.plans.catalog.base import query
from nearwell.plans.catalog.geo import SILVER
from nearwell.plans.catalog.ledger import AS_OF, CLOSED, micros
from nearwell.plans.catalog.registry import PARSED, ROWS, registry_frame
from nearwell.session import scratch_path
from nearwell.sources import readers, sinks

BRONZE = ("unique_id, name, facilityTypeId, capacity, address_zipOrPostcode, latitude, longitude, "
          "recency_of_page_update, specialties, phone_numbers")


@query("scan_bronze", f"SELECT {BRONZE} FROM bronze_all", "bronze_all")
def scan_bronze(d):
    path = scratch_path(d.spark, "bronze")
    sinks.full_refresh_sink(d.bronze_all, path)
    return readers.scan_bronze(d.spark, path).select(*BRONZE.split(", "))


@query("scan_pin_directory", """
    SELECT * FROM pin_directory WHERE regexp_full_match(pincode, '[0-9]{6}')""", "pin_directory")
def scan_pin_directory(d):
    path = scratch_path(d.spark, "pins")
    sinks.full_refresh_sink(d.pin_directory, path)
    return readers.scan_pin_directory(d.spark, path)


REGISTRY = "source, registry_name, city, state, pincode, facility_type, services, accredited"


def _registry_path(d):
    path = scratch_path(d.spark, "registry")
    raw = d.registry.withColumns({
        "registry_name": F.concat("registry_name", F.lit('\t"x",\ny')),
        "accredited": F.col("accredited").cast("string")})
    sinks.registry_csv_sink(raw, path)
    return path


@query("scan_registry_csv", f"""SELECT {REGISTRY.replace('registry_name,',
    "registry_name || chr(9) || '\"x\",' || chr(10) || 'y' AS registry_name,").replace(
    'accredited', 'cast(accredited AS varchar) AS accredited')} FROM registry""",
       "facility registry")
def scan_registry_csv(d):
    return readers.scan_registry_csv(d.spark, _registry_path(d))


@query("dedupe_first_seen_registry", """
    SELECT registry_name, city, source, state FROM (
      SELECT *, row_number() OVER (PARTITION BY lower(registry_name), lower(city)
        ORDER BY s_suppkey % 4, s_suppkey) AS rn FROM registry) WHERE rn=1""", "facility registry")
def dedupe_first_seen_registry(d):
    """Registry rows in four files, in the order of their files and of the rows there."""
    path = scratch_path(d.spark, "registry")
    part = F.pmod("s_suppkey", F.lit(4))
    raw = d.registry.select(*REGISTRY.split(", "), "s_suppkey", part.alias("part"))
    (raw.repartition(4, "part").sortWithinPartitions("part", "s_suppkey").drop("s_suppkey")
     .write.option("header", True).option("escape", '"').partitionBy("part").csv(path))
    rows = readers.scan_registry_csv(d.spark, path, positions=True)
    keys = {"name": F.lower("registry_name"), "place": F.lower("city")}
    return OC.dedupe_first_seen(rows, keys, ["file", "pos"]).select("registry_name", "city", "source", "state")


@query("stage_registry", f"""SELECT {REGISTRY.replace('registry_name,',
    "registry_name || ' ' || '\"x\",' || ' ' || 'y' AS registry_name,")} FROM registry""",
       "facility registry")
def stage_registry(d):
    return OR.stage_registry(readers.scan_registry_csv(d.spark, _registry_path(d))).drop("row_id")


@query("full_refresh_sink", "SELECT facility_id, name, lat, lng, beds FROM facility", "facility")
def full_refresh_sink(d):
    path = scratch_path(d.spark, "facility")
    fac = d.facility.select("facility_id", "name", "lat", "lng", "beds")
    sinks.full_refresh_sink(fac.withColumn("beds", F.lit(0)), path)  # what the refresh replaces
    sinks.full_refresh_sink(fac, path)
    return d.spark.read.parquet(path)


@query("silver_ctas", f"""WITH {SILVER}
    SELECT facility_id, dist_from_city_km, geo_valid_internal FROM silver""", "facility")
def silver_ctas(d):
    path = scratch_path(d.spark, "silver")
    table = "nearwell_silver_" + path.rsplit("-", 1)[1]
    silver = OG.validate_internal(d.facility).select(
        "facility_id", "dist_from_city_km", "geo_valid_internal")
    sinks.silver_ctas(silver, table, path, bucket_by="facility_id", buckets=8)
    return d.spark.table(table)


@query("append_event_log", """
    SELECT event_id, kind, tokens, epoch_us(created_at) AS created_at FROM usage_event""",
       "usage_event")
def append_event_log(d):
    path = scratch_path(d.spark, "usage")
    even = (F.col("event_id") % 2).eqNullSafe(0)
    for part in (even, ~even):
        sinks.append_event_log(d.usage_event.filter(part), path)
    return d.spark.read.parquet(path).select("event_id", "kind", "tokens", micros("created_at"))


@query("archive_sink", f"""WITH {CLOSED}
    SELECT c.conversation_id, user_id, cast(count(*) AS int) AS turn_count,
      '2024-01-01' AS archived_date
    FROM done c JOIN turn t ON t.conversation_id=c.conversation_id GROUP BY ALL""",
       "turn conversation")
def archive_sink(d):
    path = scratch_path(d.spark, "archive")
    sinks.archive_sink(ON.archive_rollup(ON.archivable(d.conversation, AS_OF), d.turn, AS_OF), path)
    return d.spark.read.parquet(path).select(
        "conversation_id", "user_id", "turn_count",
        F.col("archived_date").cast("string").alias("archived_date"))


@query("registry_csv_sink", f"""WITH {PARSED}, {ROWS}
    SELECT source, registry_name, city, state, facility_type, accredited FROM rows""",
       "registry_text")
def registry_csv_sink(d):
    path = scratch_path(d.spark, "registry-rows")
    sinks.registry_csv_sink(registry_frame(d), path)
    return readers.scan_registry_csv(d.spark, path).drop("pincode", "services")


@query("append_dialogue", f"""
    SELECT sha256(conversation_id || '|' || cast(turn_no AS varchar)) AS turn_id, conversation_id, turn_no,
      coalesce(lang, 'en') AS lang, epoch_us(created_at) AS created_at,
      epoch_us(timestamp '{AS_OF}') AS loaded_at FROM turn""", "turn")
def append_dialogue(d):
    path = scratch_path(d.spark, "turns")
    filled = sinks.fill_dialogue_defaults(
        d.turn, AS_OF, ["conversation_id", "turn_no"], "turn_id",
        {"lang": "en", "created_at": "as_of", "loaded_at": "as_of"})
    asked = F.col("role").eqNullSafe("user")
    for part in (asked, ~asked):
        sinks.append_dialogue(filled.filter(part), path)
    return d.spark.read.parquet(path).select(
        "turn_id", "conversation_id", "turn_no", "lang", micros("created_at"), micros("loaded_at"))
