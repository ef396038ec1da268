"""Sessions, retention, shortlists, usage and cost, counts."""


from pyspark.sql import functions as F

from nearwell.operators import cost as OM
from nearwell.operators import search as OS
from nearwell.operators import sessions as ON
from nearwell.operators import shortlists as OL
from nearwell.operators.quality import table_counts as counts
from nearwell.plans.catalog.base import SEARCH_TABLES, hits_sql, query
from nearwell.plans.catalog.search import batch_queries

AS_OF = "2024-01-01 12:00:00"
LATER = "2024-03-31 06:00:00"


def micros(c):
    return F.unix_micros(c).alias(c)


@query("number_turns", """
    SELECT conversation_id, seq, cast(row_number() OVER (PARTITION BY conversation_id
      ORDER BY created_at, seq) AS int) AS turn_no
    FROM (SELECT event_id AS seq, user_id AS conversation_id, ts AS created_at FROM events)""")
def number_turns(d):
    messages = d.base("events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("conversation_id"),
        F.col("ts").cast("timestamp").alias("created_at"))
    return ON.number_turns(messages).select("conversation_id", "seq", "turn_no")


def _plain(x):
    return f"regexp_replace(({x}::decimal(18,4))::varchar, '\\.?0+$', '')"


@query("compact_results", f"""WITH {hits_sql()}
    SELECT query_id, count(*) AS result_count, '[' || string_agg('{{"facility_id":"' || facility_id
      || '","name":"' || name || '","distance_km":' || {_plain('distance_km')} || ',"score":'
      || {_plain('score')} || ',"match_reason_en":"' || name || '","city":"' || city || '"}}', ','
      ORDER BY rank) || ']' AS results_json FROM hits GROUP BY query_id""", SEARCH_TABLES)
def compact_results(d):
    hits = OS.search_pairs(batch_queries(d), d.search_table)
    shown = hits.join(d.facility.select("facility_id", "name", "city"), "facility_id")
    return ON.compact_results(shown.withColumn("match_reason", F.col("name")))


@query("conversation_state", """
    SELECT conversation_id, epoch_us(max(created_at)) AS last_activity_at,
      arg_max(lang, turn_no) FILTER (WHERE lang IS NOT NULL) AS lang
    FROM turn GROUP BY conversation_id""", "turn")
def conversation_state(d):
    return ON.conversation_state(d.turn).select(
        "conversation_id", micros("last_activity_at"), "lang")


@query("idle_conversations", f"""
    SELECT conversation_id, status FROM conversation WHERE status='active'
      AND last_activity_at < timestamp '{AS_OF}' - interval 30 minutes""", "conversation")
def idle_conversations(d):
    return ON.idle_conversations(d.conversation, AS_OF).select("conversation_id", "status")


CLOSED = f"""
    done AS (SELECT * FROM conversation WHERE status='closing' OR (status='active'
      AND last_activity_at < timestamp '{AS_OF}' - interval 30 minutes))"""


@query("archive_rollup", f"""WITH {CLOSED}
    SELECT c.conversation_id, user_id, c.lang, epoch_us(started_at) AS started_at,
      epoch_us(timestamp '{AS_OF}') AS archived_at, cast(count(*) AS int) AS turn_count, 0 AS part,
      string_agg(role || ':' || content, '|' ORDER BY turn_no) AS turns
    FROM done c JOIN turn t ON t.conversation_id=c.conversation_id GROUP BY ALL""",
       "turn conversation")
def archive_rollup(d):
    rows = ON.archive_rollup(ON.archivable(d.conversation, AS_OF), d.turn, AS_OF)
    back = F.from_json("turns", "array<struct<role:string,content:string>>")
    text = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit(":"), t["content"])),
                        "|")
    return rows.select("conversation_id", "user_id", "lang", micros("started_at"),
                       micros("archived_at"), "turn_count", "part", text.alias("turns"))


@query("purge_archived", f"""WITH {CLOSED}
    SELECT 'conversation' AS kind, conversation_id, 0 AS turn_no FROM conversation
    WHERE conversation_id NOT IN (SELECT conversation_id FROM done)
    UNION ALL SELECT 'turn', conversation_id, turn_no FROM turn
    WHERE conversation_id NOT IN (SELECT conversation_id FROM done)""", "turn conversation")
def purge_archived(d):
    done = ON.archivable(d.conversation, AS_OF)
    convs = ON.purge_archived(d.conversation, done).select(
        F.lit("conversation").alias("kind"), "conversation_id", F.lit(0).alias("turn_no"))
    turns = ON.purge_archived(d.turn, done).select(
        F.lit("turn").alias("kind"), "conversation_id", "turn_no")
    return convs.unionByName(turns)


@query("retention_delete", f"""
    SELECT conversation_id FROM conversation
    WHERE started_at >= timestamp '{LATER}' - interval 90 days""", "conversation")
def retention_delete(d):
    return ON.retention_delete(d.conversation, "started_at", LATER).select("conversation_id")


@query("open_shortlists", """
    SELECT shortlist_id, user_id, title, epoch_us(created_at) AS created_at FROM shortlist""",
       "shortlist")
def open_shortlists(d):
    return OL.open_shortlists(d.shortlist).select(
        "shortlist_id", "user_id", "title", micros("created_at"))


@query("shortlist_items", """
    SELECT shortlist_id, i.facility_id, rank, score, name, city, state, official_phone
    FROM shortlist_item i JOIN facility f ON f.facility_id=i.facility_id""",
       "shortlist_item facility")
def shortlist_items(d):
    return OL.shortlist_items(d.shortlist_item, d.facility).select(
        "shortlist_id", "facility_id", "rank", "score", "name", "city", "state", "official_phone")


@query("upsert_items", """
    WITH b AS (SELECT shortlist_id, facility_id, first(rank ORDER BY seq DESC) AS rank,
        first(distance_km ORDER BY seq) AS distance_km, first(score ORDER BY seq) AS score,
        first(match_reason ORDER BY seq) AS match_reason, first(added_at ORDER BY seq) AS added_at
      FROM item_change GROUP BY 1, 2)
    SELECT coalesce(i.shortlist_id, b.shortlist_id) AS shortlist_id,
      coalesce(i.facility_id, b.facility_id) AS facility_id,
      CASE WHEN b.shortlist_id IS NOT NULL THEN b.rank ELSE i.rank END AS rank,
      CASE WHEN i.shortlist_id IS NULL THEN b.distance_km ELSE i.distance_km END AS distance_km,
      CASE WHEN i.shortlist_id IS NULL THEN b.score ELSE i.score END AS score,
      coalesce(i.match_reason, b.match_reason) AS match_reason, i.note,
      coalesce(i.status, 'candidate') AS status,
      epoch_us(coalesce(i.added_at, b.added_at)) AS added_at
    FROM shortlist_item i FULL JOIN b
      ON b.shortlist_id=i.shortlist_id AND b.facility_id=i.facility_id""",
       "shortlist_item item_change")
def upsert_items(d):
    return OL.upsert_items(d.shortlist_item, d.item_change).withColumn(
        "added_at", F.unix_micros("added_at"))


PATCHED = """
    legal AS (SELECT *, status IS NULL OR status IN ('candidate','contacted','referred','rejected')
      AS ok FROM item_patch),
    b AS (SELECT shortlist_id, facility_id,
      first(status ORDER BY seq DESC) FILTER (WHERE status IS NOT NULL) AS status,
      first(note ORDER BY seq DESC) FILTER (WHERE note IS NOT NULL) AS note
      FROM legal WHERE ok GROUP BY 1, 2)"""


@query("patch_items", f"""WITH {PATCHED}
    SELECT 'item' AS kind, i.shortlist_id, i.facility_id, cast(0 AS bigint) AS seq,
      coalesce(b.status, i.status) AS status, coalesce(b.note, i.note) AS note
    FROM shortlist_item i LEFT JOIN b USING (shortlist_id, facility_id)
    UNION ALL
    SELECT 'unmatched', p.shortlist_id, p.facility_id, p.seq, p.status, p.note FROM legal p
    LEFT JOIN shortlist_item i USING (shortlist_id, facility_id)
    WHERE NOT ok OR i.shortlist_id IS NULL""", "shortlist_item item_patch")
def patch_items(d):
    updated, unmatched = OL.patch_items(d.shortlist_item, d.item_patch)
    cols = ["kind", "shortlist_id", "facility_id", "seq", "status", "note"]
    return updated.withColumns({"kind": F.lit("item"), "seq": F.lit(0).cast("bigint")}).select(
        *cols).unionByName(unmatched.withColumn("kind", F.lit("unmatched")).select(*cols))


ROLLUP = """
    u AS (SELECT kind, count(*) AS calls, cast(coalesce(sum(tokens),0) AS bigint) AS tokens,
      min(created_at) AS first_at FROM usage_event GROUP BY kind),
    cost AS (SELECT min(first_at) AS since,
      coalesce(sum(CASE WHEN kind='embed' THEN tokens END),0)/1e6*0.10 AS e,
      coalesce(sum(CASE WHEN kind='llm' THEN tokens END),0)/1e6*1.50 AS l,
      cast(coalesce(sum(CASE WHEN kind='embed' THEN calls END),0) AS bigint) AS searches FROM u),
    measured AS (SELECT epoch_us(since) AS since, round(e,4) AS embed_usd, round(l,4) AS llm_usd,
      round(e+l,4) AS total_usd, searches,
      round(CASE WHEN searches=0 THEN 0 ELSE (e+l)/searches END,4) AS per_search_usd FROM cost)"""


@query("usage_rollup", f"""WITH {ROLLUP}
    SELECT kind, calls, tokens, epoch_us(first_at) AS first_at FROM u""", "usage_event")
def usage_rollup(d):
    return OM.usage_rollup(d.usage_event).withColumn("first_at", F.unix_micros("first_at"))


@query("measured_cost", f"WITH {ROLLUP} SELECT * FROM measured", "usage_event")
def measured_cost(d):
    return OM.measured_cost(OM.usage_rollup(d.usage_event)).withColumn(
        "since", F.unix_micros("since"))


@query("compute_estimate", """
    SELECT kind, rate_per_hour, round(rate_per_hour*730, 2) AS cost_usd
    FROM (SELECT p_brand AS kind, min(p_retailprice) AS rate_per_hour FROM part GROUP BY 1)""")
def compute_estimate(d):
    rates = d.base("part").groupBy(F.col("p_brand").alias("kind")).agg(
        F.min("p_retailprice").alias("rate_per_hour"))
    return OM.compute_estimate(rates)


@query("monthly_projection", f"""WITH {ROLLUP},
    grid AS (SELECT DISTINCT l_quantity AS searches_per_day FROM lineitem)
    SELECT searches_per_day, round(per_search_usd*searches_per_day*30,4) AS variable_usd,
      round(per_search_usd*searches_per_day*30+438,4) AS monthly_usd FROM grid, measured""",
       "usage_event")
def monthly_projection(d):
    grid = d.base("lineitem").select(F.col("l_quantity").alias("searches_per_day")).distinct()
    cost = OM.measured_cost(OM.usage_rollup(d.usage_event))
    return OM.monthly_projection(cost, grid, 438.0).withColumns({
        c: F.round(c, 4) for c in ("variable_usd", "monthly_usd")})


@query("table_counts", """
    SELECT 'facilities' AS label, count(*) AS n FROM facility
    UNION ALL SELECT 'with_coords', count(*) FROM facility WHERE lat IS NOT NULL
    UNION ALL SELECT 'specialties', count(*) FROM specialty_term
    UNION ALL SELECT 'procedures', count(*) FROM procedure_term
    UNION ALL SELECT 'capabilities', count(*) FROM capability_term
    UNION ALL SELECT 'pins', count(*) FROM pin_directory""",
       "facility specialty_term procedure_term capability_term pin_directory")
def table_counts(d):
    fac = d.facility
    return counts({"facilities": fac, "with_coords": fac.filter("lat IS NOT NULL"),
                   "specialties": d.specialty_term, "procedures": d.procedure_term,
                   "capabilities": d.capability_term, "pins": d.pin_directory})
