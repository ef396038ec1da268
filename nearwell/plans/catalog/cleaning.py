"""Cleaning scalars, filters, dedupe and nested normalisation."""

from pyspark.sql import functions as F

from nearwell.functions import cleaning as C
from nearwell.functions import geo as G
from nearwell.functions import messages as M
from nearwell.functions import presentation as P
from nearwell.functions import vectors as V
from nearwell.operators import cleaning as OC
from nearwell.operators import dialogue as OD
from nearwell.plans import build
from nearwell.plans.catalog.base import encode, in_india, initcap, query

SAN = "translate(coalesce({0},''), chr(10)||chr(13)||chr(9), '   ')"
VOCAB = "('hospital','clinic','dentist','doctor','pharmacy','farmacy','nursing_home')"


@query("clean_text", f"""
    SELECT c_custkey, copy, {SAN.format('name')} AS name, {SAN.format('description')} AS description
    FROM bronze_all""", "bronze_all")
def clean_text(d):
    return d.bronze_all.select("c_custkey", "copy", C.clean_text(F.col("name")).alias("name"),
                               C.clean_text(F.col("description")).alias("description"))


@query("strip_control", r"""
    SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') AS text FROM documents""")
def strip_control(d):
    return d.base("documents").select("doc_id", C.strip_control(F.col("text")).alias("text"))


@query("normalize_type", """
    SELECT c_custkey, copy, CASE WHEN lower(trim(facilityTypeId)) IN ('null','') THEN NULL
      WHEN lower(trim(facilityTypeId))='farmacy' THEN 'pharmacy'
      ELSE lower(trim(facilityTypeId)) END AS facility_type FROM bronze_all""", "bronze_all")
def normalize_type(d):
    return d.bronze_all.select("c_custkey", "copy", C.normalize_type(
        F.col("facilityTypeId")).alias("facility_type"))


@query("drop_misaligned_rows", f"""
    SELECT c_custkey, copy, facilityTypeId FROM bronze_all
    WHERE facilityTypeId IS NULL OR lower(trim(facilityTypeId)) IN ('null','')
      OR lower(trim(facilityTypeId)) IN {VOCAB}""", "bronze_all")
def drop_misaligned_rows(d):
    return OC.drop_misaligned_rows(d.bronze_all).select("c_custkey", "copy", "facilityTypeId")


@query("require_keys", """
    SELECT c_custkey, copy, unique_id, name FROM bronze_all
    WHERE unique_id IS NOT NULL AND name IS NOT NULL""", "bronze_all")
def require_keys(d):
    return OC.require_keys(d.bronze_all).select("c_custkey", "copy", "unique_id", "name")


INT = "CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]+') THEN try_cast({0} AS int) END"


@query("safe_casts", f"""
    SELECT c_custkey, copy, {INT.format('yearEstablished')} AS year_established,
      {INT.format('capacity')} AS beds, {INT.format('numberDoctors')} AS num_doctors,
      try_cast(recency_of_page_update AS date) AS recency_of_update FROM bronze_all""",
       "bronze_all")
def safe_casts(d):
    return OC.safe_casts(d.bronze_all).select(
        "c_custkey", "copy", "year_established", "beds", "num_doctors", "recency_of_update")


@query("normalize_pin", r"""
    SELECT c_custkey, copy, CASE WHEN regexp_full_match(regexp_replace(address_zipOrPostcode,
      '\s', '', 'g'), '[0-9]{6}') THEN regexp_replace(address_zipOrPostcode, '\s', '', 'g') END
      AS pincode FROM bronze_all""", "bronze_all")
def normalize_pin(d):
    return d.bronze_all.select("c_custkey", "copy", C.normalize_pin(
        F.col("address_zipOrPostcode")).alias("pincode"))


@query("india_bbox_guard", f"""
    SELECT c_custkey, copy, CASE WHEN {in_india('latitude', 'longitude')} THEN latitude END AS lat,
      CASE WHEN {in_india('latitude', 'longitude')} THEN longitude END AS lng
    FROM bronze_all""", "bronze_all")
def india_bbox_guard(d):
    lat, lng = G.india_bbox_guard(F.col("latitude"), F.col("longitude"))
    return d.bronze_all.select("c_custkey", "copy", lat.alias("lat"), lng.alias("lng"))


@query("geo_confidence", f"""
    SELECT c_custkey, copy, CASE WHEN {in_india('latitude', 'longitude')} THEN 'exact_spatial'
      ELSE 'unresolved' END AS geo_confidence FROM bronze_all""", "bronze_all")
def geo_confidence(d):
    return d.bronze_all.select("c_custkey", "copy", G.geo_confidence(
        F.col("latitude"), F.col("longitude")).alias("geo_confidence"))


@query("titlecase_region", f"""
    SELECT c_custkey, copy, {initcap('trim(address_stateOrRegion)')} AS state,
      lower(operatorTypeId) AS operator_type FROM bronze_all""", "bronze_all")
def titlecase_region(d):
    return d.bronze_all.select(
        "c_custkey", "copy", C.titlecase_region(F.col("address_stateOrRegion")).alias("state"),
        F.lower("operatorTypeId").alias("operator_type"))


@query("compose_address", f"""
    SELECT c_custkey, copy, concat_ws(', ', name, address_city,
      {initcap('trim(address_stateOrRegion)')}, 'India') AS address FROM bronze_all""",
       "bronze_all")
def compose_address(d):
    return d.bronze_all.select("c_custkey", "copy", C.compose_address(
        F.col("name"), F.col("address_city"),
        C.titlecase_region(F.col("address_stateOrRegion"))).alias("address"))


def _joined(c):
    return (f"coalesce(array_to_string(CASE WHEN json_valid({c}) THEN "
            f"from_json({c}, '[\"VARCHAR\"]') END, ' '), '')")


@query("compose_search_document", f"""
    SELECT c_custkey, copy, concat_ws(' ', name, {_joined('specialties')}, {_joined('procedure')},
      {_joined('capability')}, coalesce(description,'')) AS doc FROM bronze_all""", "bronze_all")
def compose_search_document(d):
    return d.bronze_all.select("c_custkey", "copy", C.compose_search_document(
        *[F.col(c) for c in ("name", "specialties", "procedure", "capability",
                             "description")]).alias("doc"))


@query("vector_literal", """
    SELECT vec_id, len(embedding) AS dims, true AS same,
      round(list_sum(embedding::double[]), 4) AS total FROM embeddings""")
def vector_literal(d):
    text = V.vector_literal(F.col("embedding"))
    back = d.base("embeddings").select("vec_id", "embedding", V.parse_vector(text).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("v").cast("bigint").alias("dims"),
                       (F.col("v") == F.col("embedding")).alias("same"),
                       F.round(total, 4).alias("total"))


@query("is_ascii", r"""
    SELECT doc_id, regexp_full_match(text, '(?s)[\x00-\x7F]*') AS ascii FROM documents""")
def is_ascii(d):
    return d.base("documents").select("doc_id", M.is_ascii(F.col("text")).alias("ascii"))


@query("extract_pin", """
    SELECT message_id, nullif(regexp_extract(text,
      '(^|[^A-Za-z0-9_])([0-9]{6})($|[^A-Za-z0-9_])', 2), '') AS pin FROM message""", "message")
def extract_pin(d):
    return d.message.select("message_id", M.extract_pin(F.col("text")).alias("pin"))


@query("pseudonymize_user", """
    SELECT c_custkey, copy, 'u_' || substr(sha256('test-salt:' || coalesce(CASE WHEN c_custkey % 8
      <> 0 THEN email END, 'local-dev')), 1, 32) AS user_id FROM bronze_all""", "bronze_all")
def pseudonymize_user(d):
    email = F.when(F.col("c_custkey") % 8 != 0, F.col("email"))
    return d.bronze_all.select("c_custkey", "copy",
                               P.pseudonymize_user(email, "test-salt").alias("user_id"))


@query("match_label", """
    SELECT event_id, cast(cast(round(100*sim) AS int) AS varchar) || '% '
      || CASE WHEN sim < 0.55 THEN 'related' ELSE 'match' END AS label
    FROM (SELECT event_id, cast(event_id % 1001 AS double)/1000 AS sim FROM events)""")
def match_label(d):
    sim = (F.col("event_id") % 1001).cast("double") / 1000
    return d.base("events").select("event_id", P.match_label(sim).alias("label"))


PLAIN = "regexp_replace(cast({0} AS varchar), '\\.0$', '')"
DIRECTIONS = f"""CASE WHEN lat IS NOT NULL AND lng IS NOT NULL
  THEN 'https://www.google.com/maps/dir/?api=1&destination=' || {PLAIN.format('lat')} || ','
       || {PLAIN.format('lng')}
  ELSE 'https://www.google.com/maps/search/?api=1&query='
       || {encode("name || ', ' || coalesce(city,'')")} END"""


def _points(d):
    return d.facility.withColumns({"lat": F.round("lat", 4), "lng": F.round("lng", 4)})


ROUNDED = """
    p AS (SELECT facility_id, c_custkey, name || ' (A&B) !~*' AS name, city, official_phone,
          round(lat,4) AS lat, round(lng,4) AS lng FROM facility)"""


@query("directions_url", f"WITH {ROUNDED} SELECT facility_id, {DIRECTIONS} AS url FROM p",
       "facility")
def directions_url(d):
    name = F.concat("name", F.lit(" (A&B) !~*"))
    return _points(d).select("facility_id", P.directions_url(
        F.col("lat"), F.col("lng"), name, F.col("city")).alias("url"))


@query("share_message", f"""WITH {ROUNDED},
    lines AS (SELECT facility_id, '*' || name || '*' || ' — ' || city || chr(10)
      || format('{{:.1f}}', cast(c_custkey % 500 AS double)/10) || ' km away'
      || CASE WHEN official_phone IS NOT NULL THEN chr(10) || '📞 ' || official_phone ELSE '' END
      || CASE WHEN c_custkey % 3 <> 0 THEN chr(10) || 'Why: near' ELSE '' END
      || chr(10) || '🗺️ Directions: ' || {DIRECTIONS} AS txt FROM p)
    SELECT facility_id, 'https://wa.me/?text=' || {encode('txt')} AS url FROM lines""", "facility")
def share_message(d):
    p = _points(d).withColumn("name", F.concat("name", F.lit(" (A&B) !~*")))
    reason = F.when(F.col("c_custkey") % 3 != 0, "near").otherwise("")
    return p.select("facility_id", P.share_message(
        F.col("name"), F.col("city"), (F.col("c_custkey") % 500).cast("double") / 10,
        F.col("official_phone"), reason,
        P.directions_url(F.col("lat"), F.col("lng"), F.col("name"), F.col("city"))).alias("url"))


@query("site_url", """
    SELECT facility_id, CASE WHEN starts_with(official_website, 'http') THEN official_website
      ELSE 'https://' || official_website END AS url FROM facility""", "facility")
def site_url(d):
    return d.facility.select("facility_id", C.site_url(F.col("official_website")).alias("url"))


@query("speech_locale", """
    SELECT doc_id, lang || '-IN' AS locale, CASE WHEN doc_id % 2 = 0 THEN 'hi-IN' ELSE 'ur-IN' END
      AS known FROM documents""")
def speech_locale(d):
    known = F.when(F.col("doc_id") % 2 == 0, "hi").otherwise("ur")
    return d.base("documents").select(
        "doc_id", P.speech_locale(F.col("lang")).alias("locale"),
        P.speech_locale(known).alias("known"))


@query("result_summary", """
    SELECT conversation_id, turn_no, CASE result_count WHEN 0 THEN 'No facilities'
      WHEN 1 THEN '1 facility' ELSE result_count || ' facilities' END
      || ' found for dialysis near Patna.' AS summary FROM turn""", "turn")
def result_summary(d):
    return d.turn.select("conversation_id", "turn_no", P.result_summary(
        F.col("result_count"), F.lit("dialysis"), F.lit("Patna")).alias("summary"))


@query("validate_request", """
    WITH c AS (SELECT *, CASE WHEN radius IS NULL THEN 50e0 ELSE try_cast(radius AS double) END AS r,
      CASE WHEN lim IS NULL THEN 20e0 ELSE try_cast(lim AS double) END AS l FROM raw_request),
    e AS (SELECT *, concat_ws(', ', CASE WHEN need='' THEN 'need' END,
      CASE WHEN try_cast(lat AS double) IS NULL THEN 'lat' END,
      CASE WHEN try_cast(lng AS double) IS NULL THEN 'lng' END,
      CASE WHEN NOT coalesce(r BETWEEN 1 AND 500, false) THEN 'radius' END,
      CASE WHEN NOT coalesce(l BETWEEN 1 AND 50, false) THEN 'limit' END,
      CASE WHEN operator NOT IN ('public','private') THEN 'operator' END) AS error FROM c)
    SELECT message_id, error, CASE WHEN error='' THEN r END AS radius,
      CASE WHEN error='' THEN cast(l AS int) END AS lim FROM e""", "raw_request")
def validate_request(d):
    raw = d.raw_request.withColumnRenamed("lim", "limit")
    good, bad = OD.validate_request(raw, check_operator=True)
    return good.select("message_id", F.lit("").alias("error"), "radius",
                       F.col("limit").alias("lim")).unionByName(bad.select(
        "message_id", "error", F.lit(None).cast("double").alias("radius"),
        F.lit(None).cast("int").alias("lim")))


@query("dedupe_latest", """
    SELECT unique_id, name, recency_of_page_update, copy FROM (
      SELECT *, row_number() OVER (PARTITION BY unique_id
        ORDER BY recency_of_page_update DESC NULLS LAST, copy DESC) AS rn
      FROM bronze_all WHERE unique_id IS NOT NULL AND name IS NOT NULL) WHERE rn=1""",
       "bronze_all")
def dedupe_latest(d):
    rows = OC.require_keys(d.bronze_all)
    return OC.dedupe_latest(rows, order=["recency_of_page_update", "copy"]).select(
        "unique_id", "name", "recency_of_page_update", "copy")


def _exploded(c):
    return (f"SELECT unique_id, {{0}} unnest(from_json({c}, '[\"VARCHAR\"]')) AS val "
            f"FROM bronze_all WHERE json_valid({c})")


@query("explode_terms", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS kind, unique_id AS facility_id, {SAN.format('trim(val)')} AS txt "
    f"FROM ({_exploded(c).format('')}) WHERE val IS NOT NULL AND trim(val) <> ''"
    for c in ("specialties", "procedure", "capability")), "bronze_all")
def explode_terms(d):
    parts = [OC.explode_terms(d.bronze_all, c).withColumn("kind", F.lit(c))
             for c in ("specialties", "procedure", "capability")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("explode_phones", f"""
    SELECT unique_id AS facility_id, val AS phone, bool_or(val = officialPhone) AS is_official
    FROM ({_exploded('phone_numbers').format('officialPhone,')})
    WHERE val IS NOT NULL AND trim(val) <> '' GROUP BY ALL""", "bronze_all")
def explode_phones(d):
    return OC.explode_phones(d.bronze_all)


@query("explode_source_urls", f"""
    SELECT DISTINCT unique_id AS facility_id, val AS source_url
    FROM ({_exploded('source_urls').format('')}) WHERE val IS NOT NULL AND trim(val) <> ''""",
       "bronze_all")
def explode_source_urls(d):
    return OC.explode_source_urls(d.bronze_all)


@query("drop_orphans", f"""
    SELECT DISTINCT unique_id AS facility_id, {SAN.format('trim(val)')} AS txt
    FROM ({_exploded('procedure').format('')}) WHERE val IS NOT NULL AND trim(val) <> ''
      AND unique_id IN (SELECT unique_id FROM bronze_all WHERE name IS NOT NULL
        AND (facilityTypeId IS NULL OR lower(trim(facilityTypeId)) IN ('null','')
             OR lower(trim(facilityTypeId)) IN {VOCAB}))""", "bronze_all")
def drop_orphans(d):
    parent = OC.drop_misaligned_rows(OC.require_keys(d.bronze_all)).select(
        F.col("unique_id").alias("facility_id"))
    return OC.drop_orphans(OC.explode_terms(d.bronze_all, "procedure"), parent)


@query("pin_defanout", f"""
    WITH p AS (SELECT pincode, {initcap('trim(district)')} AS d, {initcap('trim(statename)')} AS s,
      try_cast(latitude AS double) AS la, try_cast(longitude AS double) AS lo
      FROM pin_directory WHERE regexp_full_match(pincode, '[0-9]{{6}}'))
    SELECT pincode, min(d) AS primary_district, min(s) AS primary_state,
      count(DISTINCT d) > 1 AS is_ambiguous,
      round(avg(CASE WHEN {in_india('la', 'lo')} THEN la END), 6) AS centroid_lat,
      round(avg(CASE WHEN {in_india('la', 'lo')} THEN lo END), 6) AS centroid_lng
    FROM p GROUP BY pincode""", "pin_directory")
def pin_defanout(d):
    return OC.pin_defanout(d.pin_directory).withColumns({
        c: F.round(c, 6) for c in ("centroid_lat", "centroid_lng")})


@query("pin_candidate_districts", f"""
    SELECT DISTINCT pincode, {initcap('trim(district)')} AS district FROM pin_directory
    WHERE regexp_full_match(pincode, '[0-9]{{6}}') AND district IS NOT NULL""", "pin_directory")
def pin_candidate_districts(d):
    return OC.pin_candidate_districts(d.pin_directory)


@query("dedupe_first_seen", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn=1""")
def dedupe_first_seen(d):
    rows = d.base("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey",
                                     "l_suppkey")
    return OC.dedupe_first_seen(
        rows, {"order": F.col("l_orderkey"), "line": F.col("l_linenumber")},
        ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("clean_facility", f"""
    SELECT unique_id AS facility_id, {SAN.format('name')} AS name,
      CASE WHEN lower(trim(facilityTypeId)) IN ('null','') THEN NULL
           WHEN lower(trim(facilityTypeId))='farmacy' THEN 'pharmacy'
           ELSE lower(trim(facilityTypeId)) END AS facility_type,
      lower(operatorTypeId) AS operator_type, {INT.format('capacity')} AS beds,
      {SAN.format('address_city')} AS city, {initcap('trim(address_stateOrRegion)')} AS state,
      CASE WHEN {in_india('latitude', 'longitude')} THEN latitude END AS lat,
      {SAN.format('description')} AS description,
      try_cast(recency_of_page_update AS date) AS recency_of_update
    FROM (SELECT *, row_number() OVER (PARTITION BY unique_id
        ORDER BY recency_of_page_update DESC NULLS LAST, name DESC) AS rn
      FROM bronze_all WHERE unique_id IS NOT NULL AND name IS NOT NULL
        AND (facilityTypeId IS NULL OR lower(trim(facilityTypeId)) IN ('null','')
             OR lower(trim(facilityTypeId)) IN {VOCAB})) WHERE rn=1""", "bronze_all")
def clean_facility(d):
    return build.clean_facility(d.bronze_all.drop("c_custkey", "copy")).select(
        "facility_id", "name", "facility_type", "operator_type", "beds", "city", "state", "lat",
        "description", "recency_of_update")
