"""Distances, coordinate validation and origins."""

from pyspark.sql import functions as F

from nearwell.functions import geo as G
from nearwell.operators import geo as OG
from nearwell.operators.quality import validation_report as report
from nearwell.plans.catalog.base import hav, in_india, query, slc

PAIRED = """FROM facility f JOIN geocode_result g ON g.facility_id=f.facility_id"""


def _paired(d):
    return d.facility.join(d.geocode_result, "facility_id")


@query("distance_slc", f"""
    SELECT f.facility_id, round({slc('lat', 'lng', 'glat', 'glng')}, 4) AS km {PAIRED}""",
       "facility geocode_result")
def distance_slc(d):
    return _paired(d).select("facility_id", F.round(G.distance_slc(
        F.col("lat"), F.col("lng"), F.col("glat"), F.col("glng")), 4).alias("km"))


@query("distance_haversine", f"""
    SELECT f.facility_id, round({hav('lat', 'lng', 'glat', 'glng')}, 4) AS km {PAIRED}""",
       "facility geocode_result")
def distance_haversine(d):
    return _paired(d).select("facility_id", F.round(G.distance_haversine(
        F.col("lat"), F.col("lng"), F.col("glat"), F.col("glng")), 4).alias("km"))


WITHIN = f"""
    within AS (SELECT query_id, facility_id, dist FROM (
      SELECT q.query_id, f.facility_id, q.radius_km, {slc('q.lat', 'q.lng', 'f.lat', 'f.lng')} AS dist
      FROM search_query q JOIN facility f
        ON f.lat BETWEEN q.lat-q.radius_km/111.0 AND q.lat+q.radius_km/111.0
       AND f.lng BETWEEN q.lng-q.radius_km/(111.0*cos(radians(q.lat)))
                     AND q.lng+q.radius_km/(111.0*cos(radians(q.lat))))
    WHERE dist <= radius_km)"""


@query("radius_search", f"""WITH {WITHIN}
    SELECT query_id, facility_id, round(dist, 3) AS dist_km FROM within""", "search_query facility")
def radius_search(d):
    return OG.radius_search(d.search_query, d.facility).withColumn(
        "dist_km", F.round("dist_km", 3))


@query("radius_counts", f"""WITH {WITHIN}
    SELECT query_id, count(*)::bigint AS places FROM within GROUP BY query_id""",
       "search_query facility")
def radius_counts(d):
    return OG.radius_counts(d.search_query, d.facility)


CENTERS = """
    cc AS (SELECT lower(city) AS c, lower(coalesce(state,'')) AS s, median(lat) AS mlat,
      median(lng) AS mlng, count(*) AS n FROM facility
      WHERE lat IS NOT NULL AND nullif(city,'') IS NOT NULL GROUP BY 1, 2)"""
SILVER = f"""{CENTERS},
    dd AS (SELECT f.*, cc.n, {slc('mlat', 'mlng', 'lat', 'lng')} AS dist
      FROM facility f LEFT JOIN cc ON lower(f.city)=c AND lower(coalesce(f.state,''))=s),
    silver AS (SELECT *, round(dist,1) AS dist_from_city_km, n AS city_facility_count,
      coalesce({in_india('lat', 'lng')} AND (n < 5 OR dist IS NULL OR dist <= 80), false)
        AS geo_valid_internal FROM dd)"""
GEOCODED = f"""{SILVER},
    u AS (SELECT s.facility_id, round(glat,6) AS geocode_lat, round(glng,6) AS geocode_lng,
      round(km,1) AS geocode_dist_km, km <= 15 AS geo_valid_geocode
      FROM (SELECT s.facility_id, glat, glng, {hav('lat', 'lng', 'glat', 'glng')} AS km
            FROM silver s JOIN geocode_result g ON g.facility_id=s.facility_id) s)"""


@query("city_median_center", f"""WITH {CENTERS}
    SELECT c, s, round(mlat,6) AS mlat, round(mlng,6) AS mlng, n FROM cc""", "facility")
def city_median_center(d):
    return OG.city_median_center(d.facility).withColumns({
        c: F.round(c, 6) for c in ("mlat", "mlng")})


@query("validate_internal", f"""WITH {SILVER}
    SELECT facility_id, dist_from_city_km, city_facility_count, geo_valid_internal FROM silver""",
       "facility")
def validate_internal(d):
    return OG.validate_internal(d.facility).select(
        "facility_id", "dist_from_city_km", "city_facility_count", "geo_valid_internal")


@query("validate_geocode", f"WITH {GEOCODED} SELECT * FROM u", "facility geocode_result")
def validate_geocode(d):
    return OG.validate_geocode(d.facility, d.geocode_result)


def _merged(d):
    silver = OG.validate_internal(d.facility)
    return OG.merge_geocode(silver, OG.validate_geocode(silver, d.geocode_result))


@query("merge_geocode", f"""WITH {GEOCODED}
    SELECT s.facility_id, geo_valid_internal, geocode_lat, geocode_lng, geocode_dist_km,
      geo_valid_geocode FROM silver s LEFT JOIN u ON u.facility_id=s.facility_id""",
       "facility geocode_result")
def merge_geocode(d):
    return _merged(d).select("facility_id", "geo_valid_internal", *OG.GEOCODE_COLUMNS)


@query("final_geo_valid", f"""WITH {GEOCODED}
    SELECT s.facility_id, geo_valid_internal AND (geo_valid_geocode IS NULL OR geo_valid_geocode)
      AS geo_valid, coalesce(geocode_dist_km, dist_from_city_km) AS dist_km
    FROM silver s LEFT JOIN u ON u.facility_id=s.facility_id WHERE lat IS NOT NULL""",
       "facility geocode_result")
def final_geo_valid(d):
    return OG.final_geo_valid(_merged(d))


@query("geocode_requests", f"""WITH {SILVER}
    SELECT facility_id, concat_ws(', ', name, city, state, 'India') AS address, lat, lng
    FROM silver WHERE lat IS NOT NULL
      AND facility_id NOT IN (SELECT facility_id FROM geocode_result)""",
       "facility geocode_result")
def geocode_requests(d):
    return OG.geocode_requests(OG.validate_internal(d.facility), d.geocode_result)


VALID = """valid AS (SELECT f.* FROM facility f JOIN facility_geo g
      ON g.facility_id=f.facility_id AND g.geo_valid WHERE lat IS NOT NULL)"""


@query("geocode_city", f"""WITH {VALID}
    SELECT lower(city) AS city_key, round(median(lat),6) AS lat, round(median(lng),6) AS lng,
      count(*) AS n FROM valid GROUP BY 1""", "facility facility_geo")
def geocode_city(d):
    return OG.geocode_city(d.facility, d.facility_geo).withColumns({
        c: F.round(c, 6) for c in ("lat", "lng")})


@query("geocode_pin", f"""WITH {VALID}
    SELECT pincode, round(median(lat),6) AS lat, round(median(lng),6) AS lng,
      count(*) AS n FROM valid GROUP BY 1""", "facility facility_geo")
def geocode_pin(d):
    return OG.geocode_pin(d.facility, d.facility_geo).withColumns({
        c: F.round(c, 6) for c in ("lat", "lng")})


ORIGIN = f"""{VALID},
    cm AS (SELECT lower(city) AS k, median(lat) AS clat, median(lng) AS clng FROM valid GROUP BY 1),
    pm AS (SELECT pincode AS k, median(lat) AS plat, median(lng) AS plng FROM valid GROUP BY 1),
    j AS (SELECT a.*, plat, coalesce(plat, clat) AS alat, coalesce(plng, clng) AS alng, clat,
        pm.k AS pin
      FROM asked a LEFT JOIN cm ON cm.k = nullif(lower(place), '')
      LEFT JOIN pm ON pm.k = nullif(regexp_extract(message,
        '(^|[^A-Za-z0-9_])([0-9]{{6}})($|[^A-Za-z0-9_])', 2), '')),
    g AS (SELECT *, coalesce({in_india('device_lat', 'device_lng')} AND (alat IS NULL
      OR {hav('device_lat', 'device_lng', 'alat', 'alng')} <= 40), false) AS dev FROM j),
    origin AS (SELECT message_id, user_id, message, place, device_lat, device_lng,
      CASE WHEN dev THEN device_lat ELSE alat END AS lat,
      CASE WHEN dev THEN device_lng ELSE alng END AS lng,
      CASE WHEN dev THEN 'your location' WHEN plat IS NOT NULL THEN 'PIN ' || pin
           WHEN clat IS NOT NULL THEN place END AS label,
      CASE WHEN dev THEN 'gps' WHEN plat IS NOT NULL THEN 'pin' WHEN clat IS NOT NULL THEN 'city'
        END AS precision FROM g)"""


@query("resolve_origin", f"""WITH {ORIGIN}
    SELECT message_id, round(lat,6) AS lat, round(lng,6) AS lng, label, precision FROM origin""",
       "facility facility_geo asked")
def resolve_origin(d):
    return OG.resolve_origin(d.asked, d.facility, d.facility_geo).select(
        "message_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "label",
        "precision")


@query("validation_report", f"""WITH {SILVER}
    SELECT count(*) AS total, count(*) FILTER (WHERE geo_valid_internal) AS passing,
      count(*) FILTER (WHERE NOT geo_valid_internal) AS flagged FROM silver""", "facility")
def validation_report(d):
    return report(OG.validate_internal(d.facility))
