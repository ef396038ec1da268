"""Directory tables derived from the benchmark tables, in SQL that Spark and DuckDB both run.

Facilities are customers, cities nations, states regions; terms come from orders, lineitem and
part; registry rows and search queries from suppliers; messages and usage from events.
``{name}`` stands for a base table, ``@ts(x)`` for a timestamp from microseconds.
"""

from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from nearwell.operators.evidence import evidence_index, union_terms
from nearwell.operators.search import search_table, write_search_table
from nearwell.session import FREE_SHUFFLES, scratch_path, settings, tune

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# name -> (tables it reads, SQL)
TABLES: dict[str, tuple[list[str], str]] = {
    "located": ([], """
        SELECT c_custkey, cast(c_custkey AS string) AS facility_id, c_name, c_mktsegment,
          n_name AS city, r_name AS state,
          CASE WHEN c_custkey % 29 = 0 THEN 0e0
               ELSE 8 + cast((c_nationkey * 113) % 280 AS double) / 10
                    + cast((c_custkey * 37) % 100 - 50 AS double) / 100
                    + CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END END AS raw_lat,
          70 + cast((c_nationkey * 71) % 250 AS double) / 10
             + cast((c_custkey * 53) % 100 - 50 AS double) / 100 AS raw_lng
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey"""),
    "facility": (["located"], """
        SELECT facility_id, c_custkey,
          c_name || CASE WHEN c_custkey % 11 = 0 THEN ' Dental Clinic'
                         WHEN c_custkey % 17 = 0 THEN ' Eye Hospital' ELSE ' Hospital' END AS name,
          CASE c_custkey % 7 WHEN 0 THEN 'hospital' WHEN 1 THEN 'clinic' WHEN 2 THEN 'dentist'
               WHEN 3 THEN 'doctor' WHEN 4 THEN 'pharmacy' WHEN 5 THEN 'nursing_home' END
            AS facility_type,
          CASE c_mktsegment WHEN 'FURNITURE' THEN 'public' WHEN 'HOUSEHOLD' THEN 'public'
               WHEN 'MACHINERY' THEN 'private' WHEN 'BUILDING' THEN 'private'
               ELSE 'government' END AS operator_type,
          city, state, cast(100000 + c_custkey % 700 AS string) AS pincode,
          CASE WHEN raw_lat BETWEEN 6 AND 37.6 AND raw_lng BETWEEN 68 AND 97.6
               THEN raw_lat END AS lat,
          CASE WHEN raw_lat BETWEEN 6 AND 37.6 AND raw_lng BETWEEN 68 AND 97.6
               THEN raw_lng END AS lng,
          CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE cast((c_custkey * 17) % 400 AS int) END AS beds,
          CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE cast((c_custkey * 3) % 60 AS int) END
            AS num_doctors,
          CASE WHEN c_custkey % 6 = 0 THEN NULL
               ELSE '+91' || cast(9000000000 + c_custkey AS string) END AS official_phone,
          CASE WHEN c_custkey % 4 = 0 THEN NULL
               WHEN c_custkey % 4 = 1 THEN 'http://f' || facility_id || '.example.org'
               ELSE 'f' || facility_id || '.example.org' END AS official_website
        FROM located"""),
    "facility_vec": ([], """
        SELECT cast(c_custkey AS string) AS facility_id, embedding
        FROM (SELECT c_custkey, c_custkey % (SELECT count(*) FROM {embeddings}) AS v FROM {customer}) c
        JOIN {embeddings} ON vec_id = v
        UNION ALL
        SELECT cast(vec_id AS string) AS facility_id, embedding FROM {embeddings}
        WHERE vec_id >= (SELECT count(*) FROM {customer})"""),
    # every customer has a part and every part a customer, whichever table is longer
    "listed_part": ([], """
        SELECT c_custkey AS owner, p_partkey, p_name, p_brand, p_type
        FROM (SELECT c_custkey, c_custkey % (SELECT count(*) FROM {part}) AS k FROM {customer}) c
        JOIN (SELECT p_partkey, p_name, p_brand, p_type,
                p_partkey % (SELECT count(*) FROM {customer}) AS k FROM {part}) p ON c.k = p.k"""),
    "facility_geo": ([], """
        SELECT cast(c_custkey AS string) AS facility_id,
          c_custkey % 13 <> 0 AND c_custkey % 29 <> 0 AS geo_valid
        FROM {customer}"""),
    "purchase": ([], """
        SELECT DISTINCT cast(o_custkey AS string) AS facility_id, p_name, p_type, p_brand
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
        JOIN {part} ON l_partkey = p_partkey"""),
    "procedure_term": (["purchase"], """
        SELECT DISTINCT facility_id, p_name || ' procedure' AS txt FROM purchase"""),
    "capability_term": (["purchase"], """
        SELECT DISTINCT facility_id,
          CASE p_type WHEN 'ECONOMY' THEN 'Organ transplant unit'
               WHEN 'SMALL' THEN 'Heart bypass surgery' ELSE lower(p_type) || ' care' END AS txt
        FROM purchase"""),
    "specialty_term": (["purchase"], """
        SELECT DISTINCT facility_id, p_brand AS txt FROM purchase"""),
    "bronze_once": (["located"], """
        SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE facility_id END AS unique_id, c_custkey,
          CASE WHEN c_custkey % 89 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN c_name || chr(9) || 'Unit'
               ELSE c_name || chr(10) || 'Hospital' END AS name,
          CASE c_custkey % 10 WHEN 0 THEN ' Hospital ' WHEN 1 THEN 'clinic' WHEN 2 THEN 'farmacy'
               WHEN 3 THEN 'null' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'DENTIST'
               WHEN 7 THEN 'We offer care, beds' WHEN 8 THEN 'nursing_home' ELSE 'doctor' END
            AS facilityTypeId,
          CASE WHEN c_custkey % 3 = 0 THEN 'Public' WHEN c_custkey % 3 = 1 THEN 'PRIVATE' END
            AS operatorTypeId,
          CASE WHEN c_custkey % 8 = 0 THEN 'unknown' ELSE cast(1950 + c_custkey % 70 AS string) END
            AS yearEstablished,
          CASE WHEN c_custkey % 9 = 0 THEN '12.7' WHEN c_custkey % 9 = 1 THEN NULL
               ELSE cast((c_custkey * 17) % 400 AS string) END AS capacity,
          CASE WHEN c_custkey % 7 = 0 THEN 'many' ELSE cast(c_custkey % 60 AS string) END
            AS numberDoctors,
          CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN '' ELSE city END
            AS address_city,
          ' ' || lower(state) || ' ' AS address_stateOrRegion,
          CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '1234' WHEN 2 THEN '12 34 5' || chr(9) || '6'
               ELSE cast(100000 + c_custkey % 700 AS string) END AS address_zipOrPostcode,
          raw_lat AS latitude, raw_lng AS longitude,
          CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '+91-' || facility_id END AS officialPhone,
          'f' || facility_id || '.example.org' AS officialWebsite,
          'f' || facility_id || '@example.org' AS email,
          CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'line one' || chr(13) || chr(10) || c_mktsegment END
            AS description,
          CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 12 = 1 THEN 'soon'
               ELSE '20' || cast(10 + c_custkey % 15 AS string) || '-0' || cast(1 + c_custkey % 9 AS string)
                    || '-1' || cast(c_custkey % 10 AS string) END AS recency_of_page_update
        FROM located"""),
    # JSON columns: repeated, padded, blank, null and malformed elements
    "bronze_facility": (["bronze_once", "listed_part"], """
        SELECT b.*, cast(2 * p_partkey AS int) AS copy,
          '["' || p_brand || '"," ' || p_brand || ' ","' || p_type || '",null,""]' AS specialties,
          CASE WHEN c_custkey % 15 = 0 THEN '[oops' WHEN c_custkey % 15 = 1 THEN NULL
               WHEN c_custkey % 15 = 2 THEN '[]'
               ELSE '["' || p_name || '","  ","Check up ' || p_name || '"]' END AS procedure,
          '["' || p_type || ' ward","icu"]' AS capability,
          '["+91-' || cast(c_custkey AS string) || '","+91-' || cast(c_custkey % 50 AS string)
            || '"," ",null]' AS phone_numbers,
          '["https://a.example.org/' || cast(c_custkey % 40 AS string) || '","https://a.example.org/'
            || cast(c_custkey % 40 AS string) || '",""]' AS source_urls
        FROM bronze_once b JOIN listed_part ON owner = c_custkey"""),
    # every facility is listed twice, with an older, missing or equal recency
    "bronze_all": (["bronze_facility"], """
        SELECT * FROM bronze_facility
        UNION ALL
        SELECT unique_id, c_custkey, name || ' (old)' AS name, facilityTypeId, operatorTypeId,
          yearEstablished, capacity, numberDoctors, address_city, address_stateOrRegion,
          address_zipOrPostcode, latitude, longitude, officialPhone, officialWebsite, email,
          description,
          CASE WHEN c_custkey % 3 = 0 THEN recency_of_page_update WHEN c_custkey % 3 = 1 THEN NULL
               ELSE '2009-01-01' END AS recency_of_page_update,
          copy + 1 AS copy, specialties, procedure, capability, phone_numbers, source_urls
        FROM bronze_facility"""),
    "pin_directory": ([], """
        SELECT CASE WHEN c_custkey % 19 = 0 THEN '12345' WHEN c_custkey % 23 = 0 THEN NULL
                    ELSE cast(100000 + c_custkey % 700 AS string) END AS pincode,
          ' ' || lower(CASE WHEN c_custkey % 3 = 0 THEN 'old ' ELSE '' END || n_name) AS district,
          upper(r_name) AS statename,
          CASE WHEN c_custkey % 10 = 0 THEN 'na' WHEN c_custkey % 10 = 1 THEN '99.5'
               ELSE cast(8 + c_custkey % 25 AS string) || '.5' END AS latitude,
          CASE WHEN c_custkey % 10 = 2 THEN NULL
               ELSE cast(70 + c_custkey % 25 AS string) || '.25' END AS longitude
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey"""),
    "geocode_result": (["facility"], """
        SELECT facility_id,
          lat + CASE WHEN c_custkey % 2 = 0 THEN 0.3e0 ELSE 0.01e0 END AS glat,
          lng + 0.02e0 AS glng
        FROM facility WHERE lat IS NOT NULL AND name NOT LIKE '%Dental%'"""),
    "search_query": ([], """
        SELECT cast(s_suppkey AS string) AS query_id, s_suppkey, p_name || ' procedure' AS need,
          8 + cast((c_nationkey * 113) % 280 AS double) / 10
            + cast((c_custkey * 37) % 100 - 50 AS double) / 100 + 0.013e0 AS lat,
          70 + cast((c_nationkey * 71) % 250 AS double) / 10
            + cast((c_custkey * 53) % 100 - 50 AS double) / 100 + 0.017e0 AS lng,
          CASE s_suppkey % 4 WHEN 0 THEN 50e0 WHEN 1 THEN 100e0 WHEN 2 THEN 200e0 ELSE 500e0 END
            AS radius_km,
          CASE WHEN s_suppkey % 5 = 1 THEN 'hospital' END AS type,
          CASE WHEN s_suppkey % 7 = 2 THEN 'public' END AS operator,
          cast(5 + s_suppkey % 16 AS int) AS lim
        FROM (SELECT s_suppkey, (s_suppkey * 197) % (SELECT count(*) FROM {part}) AS k FROM {supplier}) s
        JOIN {customer} ON c_custkey = s_suppkey JOIN {part} ON p_partkey = k"""),
    # a query vector is the sum of three facility vectors
    "query_parts": ([], """
        SELECT cast(s_suppkey AS string) AS query_id, a.embedding AS ea, b.embedding AS eb,
          c.embedding AS ec
        FROM (SELECT s_suppkey, (s_suppkey * 3) % n AS i, (s_suppkey * 7 + 13) % n AS j,
                (s_suppkey * 11 + 29) % n AS k
              FROM (SELECT s_suppkey, (SELECT count(*) FROM {embeddings}) AS n FROM {supplier}) t) s
        JOIN {embeddings} a ON a.vec_id = i JOIN {embeddings} b ON b.vec_id = j
        JOIN {embeddings} c ON c.vec_id = k"""),
    "registry": (["facility"], """
        SELECT cast(s_suppkey AS string) AS row_id, s_suppkey,
          CASE s_suppkey % 3 WHEN 0 THEN 'PMJAY' WHEN 1 THEN 'NABH' ELSE 'HFR' END AS source,
          CASE s_suppkey % 4 WHEN 0 THEN f.name WHEN 1 THEN f.name || ' Trust'
               WHEN 2 THEN upper(f.name) ELSE 'General ' || substring(f.name, 10, 40) END
            AS registry_name,
          CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE f.city END AS city, f.state,
          CASE WHEN s_suppkey % 2 = 0 THEN f.pincode END AS pincode,
          CASE WHEN s_suppkey % 2 = 0 THEN 'Public' ELSE 'Private' END AS facility_type,
          CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Dialysis;Cardiology' END AS services,
          s_suppkey % 3 = 1 AS accredited
        FROM (SELECT s_suppkey, (s_suppkey * 1009) % (SELECT count(*) FROM {customer}) AS k
              FROM {supplier}) s JOIN facility f ON f.c_custkey = k"""),
    "message": ([], """
        SELECT cast(event_id AS string) AS message_id, event_id, user_id,
          CASE WHEN event_id % 13 = 0 THEN need || ' please'
               WHEN event_id % 9 = 0 THEN need || ' near ' || cast(100000 + event_id % 900 AS string)
               WHEN event_id % 23 = 0 THEN '  ' || need || ' NEAR  clinic near 1234567 '
               ELSE need || ' near NATION_' || cast(user_id % 25 AS string) END AS text,
          CASE WHEN event_id % 11 <> 0 THEN NULL WHEN event_id % 2 = 0 THEN 20e0
               ELSE 8 + cast(((user_id % 25) * 113) % 280 AS double) / 10 + 0.1e0 END AS device_lat,
          CASE WHEN event_id % 11 <> 0 THEN NULL WHEN event_id % 2 = 0 THEN 80e0
               ELSE 70 + cast(((user_id % 25) * 71) % 250 AS double) / 10 + 0.1e0 END AS device_lng
        FROM (SELECT event_id, user_id,
                CASE event_type WHEN 'error' THEN 'severe chest pain' WHEN 'purchase' THEN 'दिल का दौरा'
                     WHEN 'signup' THEN 'strokes and eye care' WHEN 'click' THEN 'Dialysis'
                     ELSE 'Eye checkup' END AS need
              FROM {events}) e"""),
    "asked": (["message"], """
        SELECT message_id, event_id, user_id, text AS message, device_lat, device_lng,
          CASE WHEN event_id % 13 = 0 THEN ''
               WHEN event_id % 9 = 0 THEN cast(100000 + event_id % 900 AS string)
               WHEN event_id % 23 = 0 THEN 'clinic near 1234567'
               ELSE 'nation_' || cast(user_id % 25 AS string) END AS place
        FROM message"""),
    # raw request parameters as they arrive: text, some out of range or unreadable
    "raw_request": (["message"], """
        SELECT message_id, event_id, CASE WHEN event_id % 19 = 0 THEN '' ELSE text END AS need,
          CASE event_id % 7 WHEN 0 THEN '0.5' WHEN 1 THEN '501' WHEN 2 THEN 'far' WHEN 3 THEN '12.5'
               WHEN 4 THEN '500' WHEN 5 THEN '1' END AS radius,
          CASE event_id % 5 WHEN 0 THEN '51' WHEN 1 THEN '50' WHEN 2 THEN '1' WHEN 3 THEN 'x' END
            AS lim,
          CASE WHEN event_id % 17 = 0 THEN 'north' ELSE cast(8 + event_id % 25 AS string) END AS lat,
          CASE WHEN event_id % 23 = 0 THEN NULL ELSE cast(70 + event_id % 25 AS string) END AS lng,
          CASE event_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'government' END
            AS operator
        FROM message"""),
    "turn": ([], """
        SELECT cast(conv_id AS string) AS conversation_id, conv_id, cast(turn + 1 AS int) AS turn_no,
          role, text AS content,
          CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'need ' || cast(turn AS string) END
            AS parsed_need,
          CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN '800001'
               WHEN role = 'assistant' THEN 'Patna' END AS parsed_place,
          cast(NULL AS double) AS lat, cast(NULL AS double) AS lng, cast(turn % 3 AS int) AS result_count,
          cast(NULL AS string) AS results_json,
          CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' END AS lang,
          @ts((1704067200 + conv_id * 600 + turn * 90) * 1000000) AS created_at
        FROM {conversations}"""),
    "conversation": (["turn"], """
        SELECT conversation_id, 'u_' || cast(conv_id % 7 AS string) AS user_id,
          min(created_at) AS started_at, max(created_at) AS last_activity_at,
          CASE WHEN conv_id % 5 = 0 THEN 'closing' WHEN conv_id % 5 = 1 THEN 'closed'
               ELSE 'active' END AS status,
          CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'hi' END AS lang
        FROM turn GROUP BY conversation_id, conv_id"""),
    "intent_reply": (["message"], """
        SELECT message_id,
          CASE event_id % 5
            WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"need":" dialysis ","place":"Patna '
              || cast(event_id % 40 AS string) || '","lang":"HI-in"}}' || chr(10) || '```'
            WHEN 1 THEN '{{"need":"dialysis","pla' WHEN 2 THEN '{{"place":"Gaya","lang":""}}'
          END AS reply
        FROM message"""),
    "grounding_reply": ([], """
        SELECT cast(s_suppkey AS string) AS query_id,
          CASE s_suppkey % 4
            WHEN 0 THEN 'Here: {{"' || cast(s_suppkey AS string) || '": ["svc a","","svc b","svc c","svc d"]}}'
            WHEN 1 THEN '{{"' || cast(s_suppkey AS string) || '": ["svc'
            WHEN 2 THEN '{{"' || cast(s_suppkey AS string) || '": []}}' END AS reply
        FROM {supplier}"""),
    "answer": ([], """
        SELECT cast(conv_id AS string) || '-' || cast(turn AS string) AS query_id,
          CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE 'bn' END AS lang,
          '2 facilities found' AS summary, text AS reason_one, 'reason two' AS reason_two,
          CASE turn % 4
            WHEN 0 THEN '{{"summary":"x","reasons":["a","b"]}}'
            WHEN 1 THEN 'ok {{"summary":"do sansthan","reasons":["ek"]}}'
            WHEN 2 THEN '{{"summary":"","reasons":["",7]}}' END AS reply
        FROM {conversations}"""),
    "usage_event": ([], """
        SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'embed' ELSE 'llm' END AS kind,
          CASE WHEN event_id % 10 = 0 THEN NULL ELSE cast(floor(value) AS bigint) END AS tokens,
          cast(ts AS timestamp) AS created_at
        FROM {events}"""),
    "shortlist": ([], """
        SELECT cast(o_orderkey AS string) AS shortlist_id, 'u_' || cast(o_custkey AS string) AS user_id,
          o_orderpriority AS title, cast(o_orderdate AS timestamp) AS created_at
        FROM {orders}"""),
    "shortlist_item": ([], """
        SELECT cast(l_orderkey AS string) AS shortlist_id, cast(l_suppkey AS string) AS facility_id,
          nullif(min(l_linenumber), 3) AS rank, min(l_quantity) AS distance_km,
          min(l_discount) AS score, min(l_linestatus) AS match_reason, cast(NULL AS string) AS note,
          'candidate' AS status, cast(min(l_shipdate) AS timestamp) AS added_at
        FROM {lineitem} GROUP BY l_orderkey, l_suppkey"""),
    "item_change": ([], """
        SELECT cast(l_orderkey AS string) AS shortlist_id,
          CASE WHEN l_returnflag = 'N' THEN 'n' ELSE '' END || cast(l_suppkey AS string) AS facility_id,
          cast(l_linenumber AS bigint) * 100000000 + l_partkey AS seq,
          nullif(max(l_linenumber), 2) AS rank, max(l_quantity) AS distance_km,
          max(l_discount) AS score, max(l_linestatus) AS match_reason,
          cast(max(l_shipdate) AS timestamp) AS added_at
        FROM {lineitem}
        GROUP BY l_orderkey, l_suppkey, l_linenumber, l_partkey, l_returnflag"""),
    "item_patch": ([], """
        SELECT cast(l_orderkey AS string) AS shortlist_id, cast(l_suppkey AS string) AS facility_id,
          cast(l_linenumber AS bigint) * 100000000 + l_partkey AS seq,
          CASE max(l_linenumber) % 6 WHEN 0 THEN 'contacted' WHEN 1 THEN 'referred'
               WHEN 2 THEN 'rejected' WHEN 3 THEN 'bogus' END AS status,
          CASE WHEN max(l_quantity) > 25 THEN 'call ' || max(l_linestatus) END AS note
        FROM {lineitem}
        GROUP BY l_orderkey, l_suppkey, l_linenumber, l_partkey"""),
    "listing_page": ([], """
        SELECT page_id, html || '<p><a class="d" HREF="https://cdnbbsr.example.org/d'
          || cast(page_id AS string) || '.pdf" target="_blank">'
          || CASE page_id % 4 WHEN 0 THEN '<b>Gurugram</b>' || chr(10) || ' (PDF 169 KB)'
                  WHEN 1 THEN 'Charkhi  Dadri&nbsp;(PDF 20 KB)' WHEN 2 THEN 'User manual (PDF)'
                  ELSE '7th list (PDF 1 KB)' END
          || '</a> <a href="https://cdnbbsr.example.org/x.pdf">Hisar (PDF 3 KB)</a></p>' AS html
        FROM {pages}"""),
    "registry_text": ([], """
        SELECT doc_id, 'label ' || lang AS label,
          CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'List of Hospitals of District  Zone '
               || cast(doc_id % 22 AS string) || ' (Haryana) under scheme' END || chr(10)
          || '1 HOSP6G' || cast(doc_id AS string) || ' City' || chr(10) || '  Care ' || source
          || ' Public a@b.in' || chr(10) || text || chr(10) || '2 HOSP7P' || cast(doc_id AS string)
          || ' ' || lang || ' Nursing Home  Private x' AS text
        FROM {documents}"""),
}


@cache
def _order(names: tuple[str, ...]) -> tuple[str, ...]:
    out: list[str] = []

    def visit(name):
        for dep in TABLES[name][0]:
            visit(dep)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return tuple(out)


def ctes(names, ts: str) -> str:
    """The WITH list (without the keyword) that defines ``names``."""
    return ",\n".join(f"{n} AS ({TABLES[n][1].replace('@ts(', ts + '(')})"
                      for n in _order(tuple(names)))


def duckdb_ctes(names) -> str:
    return ctes(names, "make_timestamp").format(**{b: b for b in BASE})


# tables that many queries read: built once per application and data folder, like any ETL output
SHARED = {"facility", "facility_vec", "bronze_all", "procedure_term", "capability_term",
          "specialty_term", "registry", "message", "search_query", "query_parts"}
_BUILT: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}
_ROWS: dict[tuple[str, str, str], int] = {}
#: What a task of a build takes: rows of the longest base table at most, bytes that small partitions are joined to.
PART_ROWS, PART_BYTES = 250_000, "16m"


class Domain:
    """The directory tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in SHARED:
            return self._derive(name)
        return self._shared(name, lambda: self._derive(name), lambda df, path: self._write(name, df, path))

    def _rows(self, base: str) -> int:
        key = (self.spark.sparkContext.applicationId, self.dir, base)
        if key not in _ROWS:
            _ROWS[key] = self.base(base).count()
        return _ROWS[key]

    def _write(self, name: str, df: DataFrame, path: str):
        """Write a derived table in as many shuffle partitions as its base tables ask for, so that joins and
        distinct rows take no more memory of a task when these grow."""
        text = " ".join(TABLES[n][1] for n in _order((name,)))
        rows = max(self._rows(b) for b in BASE if "{" + b + "}" in text)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
        with settings(self.spark, FREE_SHUFFLES | {
                "spark.sql.shuffle.partitions": str(parts),
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": PART_BYTES}):
            df.write.parquet(path)

    @property
    def search_table(self) -> DataFrame:
        return self._shared("search_table", lambda: search_table(
            self.facility, self.facility_vec, self.facility_geo, self.procedure_term), write_search_table)

    @property
    def evidence_index(self) -> DataFrame:
        return self._shared("evidence_index", lambda: evidence_index(union_terms(
            self.specialty_term, self.procedure_term, self.capability_term), self.facility), write_search_table)

    def _shared(self, name: str, make, write) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        try:
            path, schema = _BUILT[key]
            return self.spark.read.schema(schema).parquet(path)
        except (KeyError, AnalysisException):  # not built yet, or cleaned up since
            df, path = make(), scratch_path(self.spark, name)
            write(df, path)
            _BUILT[key] = path, df.schema
            return self.spark.read.schema(df.schema).parquet(path)

    def _derive(self, name: str) -> DataFrame:
        own = [n for n in _order((name,)) if n == name or n not in SHARED]
        shared = {n: getattr(self, n) for n in _order((name,)) if n not in own}
        parts = [f"{n} AS (SELECT * FROM {{{n}}})" for n in shared]
        parts += [f"{n} AS ({TABLES[n][1].replace('@ts(', 'timestamp_micros(')})" for n in own]
        text = "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}"
        used = [b for b in BASE if "{" + b + "}" in text]
        return self.spark.sql(text, **{b: self.base(b) for b in used}, **shared)
