"""Coordinate validation, geocoding from the directory itself, and the grid join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.functions.cleaning import compose_address
from nearwell.functions.geo import distance_haversine, distance_of_parts, distance_slc, in_india
from nearwell.functions.messages import extract_pin
from nearwell.operators.skew import exact_median
from nearwell.session import materialize, spread

CELL_DEG = 1.0
# A block of the grid join: about this many places meet about this many queries in one task.
PLACE_ROWS = 16384
QUERY_ROWS = 2048
# Cells of a cover: one degree, halved up to this often where the circle's edge cuts them.
COVER_LEVELS = 4
# Closer than this to the circle a cell counts as cut by it (rounding of the distances).
COVER_SLACK_KM = 0.001
# Circles are convex, so corners decide for whole cells, up to a quarter of the globe.
COVER_MAX_KM = 9000.0


def city_median_center(fac: DataFrame) -> DataFrame:
    """Median coordinate and count per (lower city, lower state).

    A blank city counts as missing, so blank cities do not form one giant "city" per state.
    """
    located = fac.filter("lat IS NOT NULL AND lng IS NOT NULL").select(
        F.nullif(F.lower("city"), F.lit("")).alias("c"),
        F.lower(F.coalesce("state", F.lit(""))).alias("s"),
        F.col("lat").alias("mlat"), F.col("lng").alias("mlng"))
    return exact_median(located.filter("c IS NOT NULL"), ["c", "s"], ["mlat", "mlng"])


def validate_internal(fac: DataFrame, city_km: float = K.CITY_KM,
                      min_n: int = K.CITY_MIN_FACILITIES) -> DataFrame:
    """Add dist_from_city_km, city_facility_count and geo_valid_internal.

    Valid: inside India, and near the city's median centre unless the city is too small to judge
    or the distance is unknown. The test uses the unrounded distance.
    """
    centers = city_median_center(fac)
    keyed = fac.withColumns({
        "c": F.lower("city"), "s": F.lower(F.coalesce("state", F.lit("")))})
    joined = keyed.join(centers, ["c", "s"], "left")
    lat, lng = F.col("lat"), F.col("lng")
    dist = distance_slc(F.col("mlat"), F.col("mlng"), lat, lng)
    near = (F.col("n") < min_n) | dist.isNull() | (dist <= city_km)
    return joined.select(
        *fac.columns,
        F.round(dist, 1).alias("dist_from_city_km"),
        F.col("n").alias("city_facility_count"),
        F.coalesce(in_india(lat, lng) & near, F.lit(False)).alias("geo_valid_internal"))


def geocode_requests(silver: DataFrame, results: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows still to be geocoded, lowest ids first when the number of calls is capped."""
    todo = (silver.filter("lat IS NOT NULL")
            .join(results.select("facility_id"), "facility_id", "left_anti")
            .select("facility_id",
                    compose_address(F.col("name"), F.col("city"), F.col("state")).alias("address"),
                    "lat", "lng"))
    return todo if cap is None else todo.orderBy("facility_id").limit(cap)


def validate_geocode(silver: DataFrame, results: DataFrame, km: float = K.GEOCODE_KM) -> DataFrame:
    """Stored point against an external geocode (facility_id, glat, glng)."""
    found = silver.select("facility_id", "lat", "lng").join(results, "facility_id")
    dist = distance_haversine(F.col("lat"), F.col("lng"), F.col("glat"), F.col("glng"))
    return found.filter("glat IS NOT NULL AND lat IS NOT NULL").select(
        "facility_id",
        F.round("glat", 6).alias("geocode_lat"), F.round("glng", 6).alias("geocode_lng"),
        F.round(dist, 1).alias("geocode_dist_km"), (dist <= km).alias("geo_valid_geocode"))


GEOCODE_COLUMNS = {"geocode_lat": "double", "geocode_lng": "double",
                   "geocode_dist_km": "double", "geo_valid_geocode": "boolean"}


def merge_geocode(silver: DataFrame, updates: DataFrame) -> DataFrame:
    """Silver rows with their geocode columns replaced where the batch has the id."""
    have = silver.withColumns({
        c: F.lit(None).cast(t) for c, t in GEOCODE_COLUMNS.items() if c not in silver.columns})
    new = updates.select("facility_id", F.lit(True).alias("_hit"),
                         *[F.col(c).alias(f"_{c}") for c in GEOCODE_COLUMNS])
    base = [c for c in have.columns if c not in GEOCODE_COLUMNS]
    return have.join(new, "facility_id", "left").select(
        *base,
        *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
          for c in GEOCODE_COLUMNS])


def final_geo_valid(silver: DataFrame) -> DataFrame:
    """(facility_id, geo_valid, dist_km): internal check and, where known, the geocoder's."""
    geocoded = F.col("geo_valid_geocode").isNull() | F.col("geo_valid_geocode")
    return silver.filter("lat IS NOT NULL").select(
        "facility_id", (F.col("geo_valid_internal") & geocoded).alias("geo_valid"),
        F.coalesce("geocode_dist_km", "dist_from_city_km").alias("dist_km"))


def _valid_places(fac: DataFrame, geo: DataFrame) -> DataFrame:
    valid = geo.filter("geo_valid").select("facility_id")
    return fac.filter("lat IS NOT NULL").join(valid, "facility_id", "left_semi")


def geocode_city(fac: DataFrame, geo: DataFrame) -> DataFrame:
    """(city_key, lat, lng, n): median of the geo-valid facilities of each city."""
    named = _valid_places(fac, geo).select(F.lower("city").alias("city_key"), "lat", "lng")
    return exact_median(named.filter("city_key IS NOT NULL"), ["city_key"], ["lat", "lng"])


def geocode_pin(fac: DataFrame, geo: DataFrame) -> DataFrame:
    """(pincode, lat, lng, n): the same per PIN."""
    named = _valid_places(fac, geo).select("pincode", "lat", "lng")
    return exact_median(named.filter("pincode IS NOT NULL"), ["pincode"], ["lat", "lng"])


def resolve_origin(queries: DataFrame, fac: DataFrame, geo: DataFrame,
                   gps_km: float = K.GPS_KM) -> DataFrame:
    """Add lat, lng, label, precision to queries(message, place, device_lat, device_lng).

    A PIN in the message beats the named city; the device position wins when it lies in India and
    either nothing is named or the named anchor is near. Medians are taken only of the PINs and
    cities that the batch asks for.
    """
    asked = queries.withColumns({
        "_pin": extract_pin(F.col("message")),
        "_city": F.nullif(F.lower("place"), F.lit(""))})
    pins = asked.select(F.col("_pin").alias("pincode")).filter("pincode IS NOT NULL").distinct()
    cities = asked.select(F.col("_city").alias("k")).filter("k IS NOT NULL").distinct()
    pin_at = geocode_pin(fac.join(pins, "pincode", "left_semi"), geo).select(
        F.col("pincode").alias("_pin"), F.col("lat").alias("_plat"), F.col("lng").alias("_plng"))
    city_at = geocode_city(
        fac.join(cities, F.lower(fac["city"]) == cities["k"], "left_semi"), geo).select(
        F.col("city_key").alias("_city"), F.col("lat").alias("_clat"), F.col("lng").alias("_clng"))
    both = asked.join(pin_at, "_pin", "left").join(city_at, "_city", "left")
    by_pin, by_city = F.col("_plat").isNotNull(), F.col("_clat").isNotNull()
    alat, alng = F.coalesce("_plat", "_clat"), F.coalesce("_plng", "_clng")
    dlat, dlng = F.col("device_lat"), F.col("device_lng")
    device = F.coalesce(
        in_india(dlat, dlng)
        & (alat.isNull() | (distance_haversine(dlat, dlng, alat, alng) <= gps_km)), F.lit(False))
    return both.select(
        *queries.columns,
        F.when(device, dlat).otherwise(alat).alias("lat"),
        F.when(device, dlng).otherwise(alng).alias("lng"),
        F.when(device, "your location").when(by_pin, F.concat(F.lit("PIN "), "_pin"))
         .when(by_city, F.col("place")).alias("label"),
        F.when(device, "gps").when(by_pin, "pin").when(by_city, "city").alias("precision"))


def query_box(queries: DataFrame) -> DataFrame:
    """Add the bounding box of each query's circle."""
    dlat = F.col("radius_km") / K.KM_PER_DEGREE
    dlng = F.col("radius_km") / (K.KM_PER_DEGREE * F.cos(F.radians("lat")))
    return queries.withColumns({
        "lat_lo": F.col("lat") - dlat, "lat_hi": F.col("lat") + dlat,
        "lng_lo": F.col("lng") - dlng, "lng_hi": F.col("lng") + dlng})


def grid_cell(lat, lng, cell_deg: float = CELL_DEG) -> Column:
    """The number of a point's grid cell."""
    return _cell_number(F.floor(lat / cell_deg), F.floor(lng / cell_deg))


def _cell_number(cy, cx) -> Column:
    return ((cy + 1000) * 10000 + cx + 1000).cast("int")


def query_cells(queries: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """One row per query and ``cell`` that its box covers inside India; boxes elsewhere have none."""
    (lat0, lat1), (lng0, lng1) = K.INDIA["lat"], K.INDIA["lng"]

    def cells(lo, hi, low, high):
        lo, hi = F.greatest(F.col(lo), F.lit(low)), F.least(F.col(hi), F.lit(high))
        return F.when(lo <= hi, F.sequence(F.floor(lo / cell_deg), F.floor(hi / cell_deg)))

    return (query_box(queries).withColumn("_cy", F.explode(cells("lat_lo", "lat_hi", lat0, lat1)))
            .withColumn("_cx", F.explode(cells("lng_lo", "lng_hi", lng0, lng1)))
            .withColumn("cell", _cell_number(F.col("_cy"), F.col("_cx"))).drop("_cy", "_cx"))


BLOCK = ["cell", "pp", "qp"]


def cut_blocks(asked: DataFrame, here: DataFrame, place_rows: int = PLACE_ROWS,
               query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides, keyed by ``cell`` already, cut into place parts and query parts of bounded size.

    The counts table has at most one row per cell of the India box (960 at one degree, 245,760 at a
    sixteenth). It is written, so that Spark knows it as the small side; of rows per query and cell it
    only knows the size of the queries.
    """
    counts = materialize(here.groupBy("cell").agg(F.count("*").alias("np"))
              .join(asked.groupBy("cell").agg(F.count("*").alias("nq")), "cell")
              .select("cell", F.ceil(F.col("np") / place_rows).alias("pps"),
                      F.ceil(F.col("nq") / query_rows).alias("qps")), "block-counts")
    here = (here.join(counts, "cell")
            .withColumn("pp", F.pmod(F.xxhash64("facility_id"), F.col("pps")))
            .withColumn("qp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qps") - 1))))
    asked = (asked.join(counts, "cell")
             .withColumn("qp", F.pmod(F.xxhash64("query_id"), F.col("qps")))
             .withColumn("pp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pps") - 1))))
    return asked.drop("pps", "qps"), here.drop("pps", "qps")


def grid_blocks(queries: DataFrame, places: DataFrame, cell_deg: float = CELL_DEG,
                place_rows: int = PLACE_ROWS, query_rows: int = QUERY_ROWS):
    """Both sides keyed by (cell, pp, qp), so that the circle join is an equi-join.

    A query goes to the grid cells its box covers, a place to its own cell. Cells are then cut into
    place parts and query parts from their row counts, so a hot cell becomes many blocks of bounded
    work. Places must carry guarded coordinates (inside India or NULL), as the cleaned facility table
    does; others are left out.
    """
    here = places.filter(in_india(F.col("lat"), F.col("lng"))).withColumn(
        "cell", grid_cell(F.col("lat"), F.col("lng"), cell_deg))
    return cut_blocks(query_cells(queries, cell_deg), here, place_rows, query_rows)


def _pairs_within(asked: DataFrame, here: DataFrame, *keep: str) -> DataFrame:
    """(query_id, facility_id, dist_km, ``keep``) of the places flat, flng of each block within the box
    and the radius of its queries.

    The blocks are dealt to all tasks, as their work is high per byte, and merged: the side that Spark
    takes for the smaller one may hold a row per query and cell, too much for a broadcast.
    """
    def parts(df, lat, side):
        return df.withColumns({f"_sin{side}": F.sin(F.radians(lat)), f"_cos{side}": F.cos(F.radians(lat))})
    asked, here = spread(parts(asked, "lat", "q"), *BLOCK), spread(parts(here, "flat", "f"), *BLOCK)
    dist = distance_of_parts(F.col("_sinq"), F.col("_cosq"), F.col("lng"),
                             F.col("_sinf"), F.col("_cosf"), F.col("flng"))
    pairs = asked.hint("merge").join(here, BLOCK).filter(
        F.col("flat").between(F.col("lat_lo"), F.col("lat_hi"))
        & F.col("flng").between(F.col("lng_lo"), F.col("lng_hi")) & (dist <= F.col("radius_km")))
    return pairs.select("query_id", "facility_id", dist.alias("dist_km"), *keep)


def radius_search(queries: DataFrame, fac: DataFrame, wishes: tuple = (), kinds: tuple = (),
                  **grid) -> DataFrame:
    """(query_id, facility_id, dist_km) of every facility within each query's radius.

    The columns ``wishes`` of the queries and ``kinds`` of the facilities come with each pair, so that
    no pair needs a join to get them.
    """
    asked, here = grid_blocks(
        queries.select("query_id", "lat", "lng", "radius_km", *wishes),
        fac.select("facility_id", "lat", "lng", *kinds), **grid)
    return _pairs_within(asked, here.withColumnsRenamed({"lat": "flat", "lng": "flng"}),
                         *wishes, *kinds)


def _cover_cell(level: int, cy, cx) -> Column:
    """The number of a cell among all levels; each level's cells have sides of 2 ** -level degrees."""
    return (F.lit(level << 40).cast("long") + (cy + 20000) * 1048576 + cx + 20000).cast("long")


def circle_cells(queries: DataFrame, levels: int = COVER_LEVELS) -> DataFrame:
    """(query_id, lat, lng, radius_km, the box, level, cell, whole): the cells each circle takes up.

    One-degree cells inside India, of which those that the circle cuts are quartered up to ``levels``
    times. ``whole`` cells lie inside the circle and its box with all their points; the others, all of
    the last level, are cut. The rows grow with the circle's edge in cells of the last level. Null
    coordinates or radii have none.
    """
    (lat0, lat1), (lng0, lng1) = K.INDIA["lat"], K.INDIA["lng"]
    box = ["query_id", "lat", "lng", "radius_km", "lat_lo", "lat_hi", "lng_lo", "lng_hi"]

    def numbers(lo, hi, low, high):
        lo, hi = F.greatest(F.col(lo), F.lit(low)), F.least(F.col(hi), F.lit(high))
        return F.when(lo <= hi, F.sequence(F.floor(lo), F.floor(hi)))

    open_cells = (query_box(queries.select("query_id", "lat", "lng", "radius_km"))
                  .where("lat IS NOT NULL AND lng IS NOT NULL AND radius_km IS NOT NULL")
                  .withColumn("_cy", F.explode(numbers("lat_lo", "lat_hi", lat0, lat1)))
                  .withColumn("_cx", F.explode(numbers("lng_lo", "lng_hi", lng0, lng1)))
                  .withColumn("_level", F.lit(0)).withColumn("_done", F.lit(False)))
    for level in range(levels + 1):
        side = 2.0 ** -level
        south, west = F.col("_cy") * side, F.col("_cx") * side
        north, east = south + side, west + side
        far = F.greatest(*[distance_slc(F.col("lat"), F.col("lng"), y, x)
                           for y in (south, north) for x in (west, east)])
        inside = ((far <= F.least(F.col("radius_km"), F.lit(COVER_MAX_KM)) - COVER_SLACK_KM)
                  & (south >= F.col("lat_lo")) & (north <= F.col("lat_hi"))
                  & (west >= F.col("lng_lo")) & (east <= F.col("lng_hi")))
        meets = ((south <= F.col("lat_hi")) & (north >= F.col("lat_lo"))
                 & (west <= F.col("lng_hi")) & (east >= F.col("lng_lo")))
        open_cells = open_cells.where(F.col("_done") | meets).withColumn(
            "_done", F.col("_done") | inside)
        if level < levels:
            quarters = F.array(*[F.struct((F.col("_cy") * 2 + y).alias("_cy"),
                                          (F.col("_cx") * 2 + x).alias("_cx"),
                                          F.lit(level + 1).alias("_level"))
                                 for y in (0, 1) for x in (0, 1)])
            itself = F.array(F.struct("_cy", "_cx", "_level"))
            open_cells = open_cells.select(*box, "_done", F.inline(
                F.when(F.col("_done"), itself).otherwise(quarters)))
    cell = F.coalesce(*[F.when(F.col("_level") == v, _cover_cell(v, F.col("_cy"), F.col("_cx")))
                        for v in range(levels + 1)])
    return open_cells.select(*box, F.col("_level").alias("level"), cell.alias("cell"),
                             F.col("_done").alias("whole"))


def place_cells(places: DataFrame, levels: int = COVER_LEVELS) -> DataFrame:
    """The places inside India, each in its cell of every level."""
    here = places.where(in_india(F.col("lat"), F.col("lng")))
    cells = [F.struct(F.lit(v).alias("level"),
                      _cover_cell(v, F.floor(F.col("lat") * 2 ** v),
                                  F.floor(F.col("lng") * 2 ** v)).alias("cell"))
             for v in range(levels + 1)]
    return here.select("*", F.inline(F.array(*cells)))


def radius_cover(queries: DataFrame, fac: DataFrame, levels: int = COVER_LEVELS
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, edge, members): :func:`radius_search` without a row per pair.

    whole(query_id, level, cell, places): a cell that lies inside the circle, and how many facilities
    it has; empty ones are left out. edge(query_id, facility_id, dist_km): the facilities within the
    radius in cells that the circle cuts, by the exact distance. members(level, cell, facility_id)
    tells who the facilities of a whole cell are. ``whole`` joined with ``members``, and ``edge``, hold
    every pair once.
    """
    places = fac.select("facility_id", "lat", "lng")
    members = place_cells(places, levels)
    counts = materialize(members.groupBy("level", "cell").agg(F.count("*").alias("places")),
                         "cell-counts")
    # worked out once, by all tasks, and of known size: a circle is hundreds of rows
    cover = materialize(circle_cells(spread(queries, "query_id", "lat", "lng"), levels), "cover")
    whole = cover.where("whole").select("query_id", "level", "cell").join(counts, ["level", "cell"])
    cut = cover.where(~F.col("whole")).drop("whole", "level")
    cut, here = cut_blocks(cut, members.where(F.col("level") == levels).select(
        "cell", "facility_id", F.col("lat").alias("flat"), F.col("lng").alias("flng")))
    return (whole.select("query_id", "level", "cell", "places"),
            _pairs_within(cut, here),
            members.select("level", "cell", "facility_id"))


def radius_counts(queries: DataFrame, fac: DataFrame, levels: int = COVER_LEVELS) -> DataFrame:
    """(query_id, places): how many facilities each circle holds; circles without any have no row."""
    whole, edge, _ = radius_cover(queries, fac, levels)
    rows = whole.select("query_id", "places").unionByName(
        edge.groupBy("query_id").agg(F.count("*").alias("places")))
    return rows.groupBy("query_id").agg(F.sum("places").alias("places"))
