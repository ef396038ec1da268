"""Whole jobs: what they leave in their tables."""

from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.plans import jobs as J
from nearwell.plans.catalog.base import query
from nearwell.plans.catalog.ledger import AS_OF, CLOSED
from nearwell.plans.catalog.registry import ANCHOR, BEST, ENTRY, LABEL, REGISTRY_TABLES
from nearwell.session import scratch_path
from nearwell.sources.keyed import KeyedTable
from nearwell.sources.readers import scan_registry_csv
from nearwell.sources.sinks import registry_csv_sink

TEXT_URL = "'https://cdnbbsr.example.org/d' || cast(doc_id AS string) || '.pdf'"


@query("ingest_registry", f"""
    WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS url,
        unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS label,
        unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS link FROM listing_page),
    named AS (SELECT page_id, link, url,
        trim(regexp_extract({LABEL}, '^([A-Za-z][A-Za-z .]+?)\\s*\\(PDF', 1)) AS label FROM m),
    linked AS (SELECT * FROM named WHERE label <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, link) = 1),
    entry AS (SELECT page_id, link, l.label,
        trim(regexp_extract(text, 'District\\s+([\\w][\\w ]*?)\\s*\\(Haryana\\)', 1)) AS district,
        unnest(range(len(regexp_extract_all(text, '{ENTRY}', 1)))) AS pos,
        unnest(regexp_extract_all(text, '{ENTRY}', 1)) AS raw,
        unnest(regexp_extract_all(text, '{ENTRY}', 2)) AS type
      FROM registry_text r JOIN linked l ON l.url = {TEXT_URL.replace('doc_id', 'r.doc_id')}),
    named_entry AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS registry_name,
        coalesce(nullif(district, ''), label) AS city FROM entry)
    SELECT 'PMJAY' AS source, registry_name, city, 'Haryana' AS state, type AS facility_type,
      'false' AS accredited FROM named_entry WHERE registry_name <> ''
    QUALIFY row_number() OVER (PARTITION BY lower(registry_name), lower(city)
      ORDER BY page_id, link, pos) = 1""", "listing_page registry_text")
def ingest_registry(d):
    out = scratch_path(d.spark, "ingest")
    texts = d.registry_text.select(F.expr(TEXT_URL).alias("url"), "text")
    J.ingest_registry(d.listing_page, texts, out, "PMJAY", "Haryana")
    return scan_registry_csv(d.spark, out).select(
        "source", "registry_name", "city", "state", "facility_type", "accredited")


def _old(d):
    return d.base("supplier").select(
        F.col("s_suppkey").cast("string").alias("facility_id"), F.lit("OLD").alias("source"),
        F.col("s_name").alias("registry_name"), F.lit(None).cast("string").alias("registry_type"),
        F.lit(True).alias("verified"), F.lit(None).cast("boolean").alias("accredited"),
        F.lit(None).cast("array<string>").alias("verified_services"),
        F.lit(None).cast("double").alias("match_score"),
        F.lit(None).cast("timestamp").alias("verified_at"))


@query("verify_facilities", f"""WITH {BEST}
    SELECT facility_id, match_score, epoch_us(timestamp '{AS_OF}') AS verified_at FROM best
    UNION ALL
    SELECT cast(s_suppkey AS string), NULL, NULL FROM supplier
    WHERE cast(s_suppkey AS string) NOT IN (SELECT facility_id FROM best)""", REGISTRY_TABLES)
def verify_facilities(d):
    csvs = scratch_path(d.spark, "registry-csv")
    registry_csv_sink(d.registry.select(*[F.col(c).cast("string") for c in K.REGISTRY_COLUMNS]), csvs)
    old = _old(d)
    table = KeyedTable(d.spark, scratch_path(d.spark, "verified"), ("facility_id",), old.schema)
    table.replace(old)
    J.verify_facilities(csvs, d.facility, table, AS_OF, 0)
    return table.read().select("facility_id", "match_score", F.unix_micros("verified_at").alias("verified_at"))


@query("sweep_conversations", f"""WITH {CLOSED},
    gone AS (SELECT conversation_id FROM done UNION
      SELECT conversation_id FROM conversation WHERE started_at < timestamp '{AS_OF}')
    SELECT 'archived' AS kind, c.conversation_id AS id, count(t.turn_no) AS n
    FROM done c LEFT JOIN turn t ON t.conversation_id = c.conversation_id GROUP BY ALL
    UNION ALL SELECT 'conversation', conversation_id, 0 FROM conversation
      WHERE conversation_id NOT IN (SELECT conversation_id FROM gone)
    UNION ALL SELECT 'turn', conversation_id, turn_no FROM turn
      WHERE conversation_id NOT IN (SELECT conversation_id FROM gone)
    UNION ALL SELECT 'search', cast(event_id AS string), 0 FROM usage_event
      WHERE created_at IS NULL OR created_at >= timestamp '{AS_OF}'""",
       "turn conversation usage_event")
def sweep_conversations(d):
    log = d.usage_event.withColumn("created_date", F.to_date("created_at"))
    tables = []
    for name, key, rows in (("conversations", "conversation_id", d.conversation),
                            ("turns", "conversation_id", d.turn), ("searches", "created_date", log)):
        table = KeyedTable(d.spark, scratch_path(d.spark, name), (key,), rows.schema)
        table.replace(rows)
        tables.append(table)
    archived = J.sweep_conversations(*tables, scratch_path(d.spark, "archive"), AS_OF, 0, days=0)
    parts = [("archived", archived, "conversation_id", F.col("turn_count")),
             ("conversation", tables[0].read(), "conversation_id", F.lit(0)),
             ("turn", tables[1].read(), "conversation_id", F.col("turn_no")),
             ("search", tables[2].read(), "event_id", F.lit(0))]
    frames = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"),
                        n.cast("bigint").alias("n")) for kind, df, key, n in parts]
    # a conversation archived in several parts counts once
    out = frames[0].distinct()
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out
