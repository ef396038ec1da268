"""Registry matching and registry text extraction."""

from pyspark.sql import functions as F

from nearwell.functions.cleaning import split_services as split
from nearwell.operators import registry as OR
from nearwell.plans.catalog.base import gram_sim, grams, query

REGISTRY_TABLES = "facility registry"
PAIRS = f"""
    fg AS (SELECT facility_id, name, pincode, city, {grams('name')} AS a FROM facility),
    rg AS (SELECT *, {grams('registry_name')} AS b FROM registry),
    pairs AS (SELECT row_id, facility_id, source, registry_name, facility_type, accredited,
        services, score FROM (
      SELECT rg.*, fg.facility_id, fg.pincode=rg.pincode AS same_pin,
        lower(fg.city)=lower(rg.city) AS same_city, {gram_sim('a', 'b')} AS score
      FROM fg JOIN rg ON fg.pincode=rg.pincode OR lower(fg.city)=lower(rg.city))
      WHERE (same_pin AND score::double >= 0.40) OR (same_city AND score::double >= 0.62))"""
BEST = f"""{PAIRS},
    best AS (SELECT facility_id, source, registry_name, facility_type AS registry_type, accredited,
      array_to_string(string_split(lower(services), ';'), '|') AS services,
      round(score::double, 3) AS match_score
      FROM (SELECT *, row_number() OVER (PARTITION BY facility_id
              ORDER BY score DESC, row_id) AS rn FROM pairs) WHERE rn=1)"""


def matched(d):
    return OR.best_match(d.registry, d.facility)


@query("blocked_fuzzy_join", f"WITH {PAIRS} SELECT row_id, facility_id, score FROM pairs",
       REGISTRY_TABLES)
def blocked_fuzzy_join(d):
    return OR.blocked_fuzzy_join(d.registry, d.facility)


def _block_sql(table: str, name: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {c} AS block, {name} AS name, {key} AS id FROM {table} "
        f"WHERE {c} IS NOT NULL AND {name} IS NOT NULL"
        for kind, c in (("pin", "pincode"), ("city", "lower(city)")))


CLASSES = f"""
    fb AS ({_block_sql('facility', 'name', 'facility_id')}),
    rb AS ({_block_sql('registry', 'registry_name', 'row_id')}),
    fc AS (SELECT kind, block, name, count(*) AS n, min(id) AS id, {grams('name')} AS a
      FROM fb GROUP BY ALL),
    rc AS (SELECT kind, block, name, count(*) AS n, min(id) AS id, {grams('name')} AS b
      FROM rb GROUP BY ALL),
    classes AS (SELECT * FROM (
      SELECT fc.kind, fc.block, fc.name AS fname, rc.name AS rname, {gram_sim('a', 'b')} AS score,
        fc.n AS facilities, fc.id AS facility_id, rc.n AS entries, rc.id AS row_id
      FROM fc JOIN rc ON fc.kind = rc.kind AND fc.block = rc.block)
      WHERE score::double >= CASE kind WHEN 'pin' THEN 0.40 ELSE 0.62 END)"""


@query("match_classes", f"WITH {CLASSES} SELECT * FROM classes", REGISTRY_TABLES)
def match_classes(d):
    return OR.class_pairs(d.registry, d.facility)


@query("match_members", f"""WITH {CLASSES}
    SELECT 'facility' AS side, kind, block, name, id FROM fb
    WHERE (kind, block, name) IN (SELECT (kind, block, fname) FROM classes) UNION ALL
    SELECT 'registry' AS side, kind, block, name, id FROM rb
    WHERE (kind, block, name) IN (SELECT (kind, block, rname) FROM classes)""", REGISTRY_TABLES)
def match_members(d):
    _, facilities, entries = OR.match_classes(d.registry, d.facility)
    return (facilities.select(F.lit("facility").alias("side"), "kind", "block",
                              F.col("fname").alias("name"), F.col("facility_id").alias("id"))
            .unionAll(entries.select(F.lit("registry").alias("side"), "kind", "block",
                                     F.col("rname").alias("name"), F.col("row_id").alias("id"))))


@query("best_match", f"WITH {BEST} SELECT * FROM best", REGISTRY_TABLES)
def best_match(d):
    return matched(d).withColumn("services", F.array_join("verified_services", "|")).drop(
        "verified", "verified_services")


@query("upsert_verification", f"""WITH {BEST},
    old AS (SELECT cast(s_suppkey AS string) AS facility_id, 'OLD' AS source,
              s_name AS registry_name FROM supplier)
    SELECT facility_id, source, registry_name FROM best UNION ALL
    SELECT * FROM old WHERE facility_id NOT IN (SELECT facility_id FROM best)""",
       REGISTRY_TABLES)
def upsert_verification(d):
    old = d.base("supplier").select(F.col("s_suppkey").cast("string").alias("facility_id"),
                                    F.lit("OLD").alias("source"),
                                    F.col("s_name").alias("registry_name"))
    return OR.upsert_verification(old, matched(d).select("facility_id", "source", "registry_name"))


@query("split_services", """
    SELECT row_id, array_to_string(string_split(lower(services), ';'), '|') AS services,
      len(string_split(lower(services), ';')) AS n FROM registry""", REGISTRY_TABLES)
def split_services(d):
    return d.registry.withColumn("s", split(F.col("services"))).select(
        "row_id", F.array_join("s", "|").alias("services"),
        F.array_size("s").cast("bigint").alias("n"))


@query("verification_summary", f"""WITH {BEST}
    SELECT source, count(*) AS n FROM best GROUP BY source""", REGISTRY_TABLES)
def verification_summary(d):
    return OR.verification_summary(matched(d))


ANCHOR = '(?is)<a[^>]+href="(https://cdnbbsr[^"]+\\.pdf)"[^>]*>(.*?)</a>'
LABEL = ("trim(regexp_replace(replace(regexp_replace(label, '<[^>]+>', '', 'g'), '&nbsp;', ' '), "
         "'\\s+', ' ', 'g'))")


@query("extract_listing_links", f"""
    WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS url,
        unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS label,
        unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS pos FROM listing_page)
    SELECT page_id, cast(pos AS int) AS pos,
      trim(regexp_extract({LABEL}, '^([A-Za-z][A-Za-z .]+?)\\s*\\(PDF', 1)) AS district, url
    FROM m WHERE regexp_extract({LABEL}, '^([A-Za-z][A-Za-z .]+?)\\s*\\(PDF', 1) <> ''""",
       "listing_page")
def extract_listing_links(d):
    return OR.extract_listing_links(d.listing_page)


ENTRY = "(?s)HOSP\\w+\\s+(.+?)\\s+(Public|Private)\\b"
PARSED = f"""
    m AS (SELECT doc_id, label,
        trim(regexp_extract(text, 'District\\s+([\\w][\\w ]*?)\\s*\\(Haryana\\)', 1)) AS district,
        unnest(range(len(regexp_extract_all(text, '{ENTRY}', 1)))) AS pos,
        unnest(regexp_extract_all(text, '{ENTRY}', 1)) AS raw,
        unnest(regexp_extract_all(text, '{ENTRY}', 2)) AS type FROM registry_text),
    parsed AS (SELECT doc_id, label, district, cast(pos AS int) AS pos,
        trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS name, type FROM m)"""


@query("parse_registry_text", f"""WITH {PARSED}
    SELECT doc_id, district, pos, name, type FROM parsed WHERE name <> ''""", "registry_text")
def parse_registry_text(d):
    return OR.parse_registry_text(d.registry_text, "Haryana")


def registry_frame(d):
    parsed = OR.parse_registry_text(d.registry_text, "Haryana")
    labelled = parsed.join(d.registry_text.select("doc_id", "label"), "doc_id")
    return OR.registry_rows(labelled, "PMJAY", "Haryana")


ROWS = """
    rows AS (SELECT doc_id, pos, 'PMJAY' AS source, name AS registry_name,
      coalesce(nullif(district, ''), label) AS city, 'Haryana' AS state, '' AS pincode,
      type AS facility_type, '' AS services, 'false' AS accredited FROM parsed WHERE name <> '')"""


@query("registry_rows", f"WITH {PARSED}, {ROWS} SELECT * FROM rows", "registry_text")
def registry_rows(d):
    return registry_frame(d)
