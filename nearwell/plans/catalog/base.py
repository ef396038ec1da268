"""Registration of a query with the SQL it is checked against, and shared SQL fragments."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearwell.plans.domain import Domain, duckdb_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register ``fn(domain)`` under ``name``; ``sql`` may start with its own WITH list."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            own = body.upper().startswith("WITH ")
            head = duckdb_ctes(tables.split()) if tables else ""
            if head:
                body = f"WITH {head}" + (",\n" + body[5:] if own else "\n" + body)
            ORACLES[name] = body
        return fn
    return register


# --- SQL fragments of the checks (DuckDB) ------------------------------------------------------

def initcap(x):
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def slc(lat1, lng1, lat2, lng2):
    c = (f"sin(radians({lat1}))*sin(radians({lat2}))+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*cos(radians({lng2}-{lng1}))")
    return f"CASE WHEN ({c}) IS NOT NULL THEN 6371*acos(least(1e0,greatest(-1e0,{c}))) END"


def hav(lat1, lng1, lat2, lng2):
    h = (f"pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians({lng2}-{lng1})/2),2)")
    return f"CASE WHEN ({h}) IS NOT NULL THEN 6371*2*asin(least(1e0,sqrt({h}))) END"


def in_india(lat, lng):
    return f"({lat} BETWEEN 6 AND 37.6 AND {lng} BETWEEN 68 AND 97.6)"


def grams(s):
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({s}), "
            f"'[^\\p{{L}}\\p{{N}}]+'), lambda w: w<>''), lambda w: list_transform("
            f"range(1, len(w)+2), lambda i: substr('  '||w||' ', i, 3)))))")


def gram_sim(a, b):
    i = f"len(list_intersect({a},{b}))"
    u = f"(len({a})+len({b})-{i})"
    return f"cast(CASE WHEN {u}=0 THEN 0e0 ELSE {i}::double/{u}::double END AS float)"


def encode(x):
    out = f"url_encode({x})"
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def suspect(name, txt):
    names = " OR ".join(f"{name} ILIKE '%{w}%'" for w in
                        ("dental", "eye", "ophthal", "diagnostic", "pathology", "physiother"))
    terms = " OR ".join(f"{txt} ILIKE '%{w}%'" for w in
                        ("bypass", "transplant", "open heart", "neurosurg", "cardiac surg",
                         "cancer surg"))
    return f"(({names}) AND ({terms}))"


QV = ("list_transform(range(1, len(ea)+1), "
      "lambda i: ea[i]::double + eb[i]::double + ec[i]::double)")


def hits_sql(limit="lim", geo=True):
    """WITH list giving hits(query_id, rank, facility_id, distance_km, similarity, score, lim)."""
    valid = "JOIN facility_geo g ON g.facility_id=f.facility_id AND g.geo_valid" if geo else ""
    return f"""
      qv AS (SELECT query_id, {QV} AS qv FROM query_parts),
      near AS (
        SELECT q.query_id, q.need, q.radius_km, q.lim, f.*, v.embedding, qv.qv,
          {slc('q.lat', 'q.lng', 'f.lat', 'f.lng')} AS dist
        FROM search_query q JOIN qv ON qv.query_id=q.query_id
        JOIN facility f ON f.lat BETWEEN q.lat-q.radius_km/111.0 AND q.lat+q.radius_km/111.0
          AND f.lng BETWEEN q.lng-q.radius_km/(111.0*cos(radians(q.lat)))
                        AND q.lng+q.radius_km/(111.0*cos(radians(q.lat)))
          AND (q.type IS NULL OR f.facility_type=q.type)
          AND (q.operator IS NULL OR f.operator_type=q.operator)
        JOIN facility_vec v ON v.facility_id=f.facility_id {valid}),
      scored AS (
        SELECT *, list_cosine_similarity(qv, embedding::double[]) AS sim
        FROM near WHERE dist <= radius_km),
      shown AS (
        SELECT *, round(dist,1) AS distance_km, round(sim,3) AS similarity,
          round(0.60e0*sim+0.25e0*(1-dist/radius_km)+0.10e0*least(1e0,coalesce(beds,0)/200e0)
                +0.05e0*least(1e0,coalesce(num_doctors,0)/30e0),4) AS score
        FROM scored),
      hits AS (
        SELECT *, cast(rn AS int) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, distance_km, facility_id) AS rn FROM shown)
        WHERE rn <= {limit})"""


SEARCH_TABLES = "facility facility_vec facility_geo search_query query_parts"
TERM_TABLES = "procedure_term capability_term specialty_term"
