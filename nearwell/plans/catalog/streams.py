"""Streaming forms, run over the whole tables with the availableNow trigger."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell.operators.registry import upsert_verification
from nearwell.operators.sessions import TURN_FIELDS
from nearwell.plans.catalog.base import ORACLES, SEARCH_TABLES, hits_sql, query
from nearwell.plans.catalog.dialogue import PHRASES, WORDS
from nearwell.plans.catalog.registry import matched
from nearwell.plans.catalog.search import batch_queries
from nearwell.session import scratch_path
from nearwell.sources.keyed import KeyedTable
from nearwell.sources.sinks import full_refresh_sink
from nearwell.streaming import archive
from nearwell.streaming import streams as X


def _stream(d, df: DataFrame, name: str, per_batch: int | None = None) -> DataFrame:
    """``df`` written to scratch space and read back as a stream of its files."""
    path = scratch_path(d.spark, name)
    full_refresh_sink(df, path)
    reader = d.spark.readStream.schema(df.schema)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def _to_table(d, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to the end of its input into parquet and read the result."""
    path, state = scratch_path(d.spark, name), scratch_path(d.spark, name + "-state")
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    return d.spark.read.schema(stream.schema).parquet(path)


def _each_batch(d, stream: DataFrame, write, name: str) -> None:
    (stream.writeStream.foreachBatch(write)
     .option("checkpointLocation", scratch_path(d.spark, name + "-state"))
     .trigger(availableNow=True).start().awaitTermination())


# the watermark ends 10 minutes before the last event (in whole milliseconds)
MARK = "epoch_ms(max(ts)) - 600000"


@query("stream_idle_sessions", f"""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= interval 30 minutes
        OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts
        ROWS UNBOUNDED PRECEDING) AS n FROM g),
    mark AS (SELECT {MARK} AS m FROM events)
    SELECT user_id AS conversation_id, epoch_us(min(ts)) AS started_at,
      epoch_us(max(ts)) AS last_activity_at, count(*) AS turn_count
    FROM s GROUP BY user_id, n
    HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT m FROM mark) * 1000""")
def stream_idle_sessions(d):
    turns = d.base("events").select(F.col("user_id").alias("conversation_id"),
                                    F.col("ts").cast("timestamp").alias("created_at"))
    closed = _to_table(d, X.stream_idle_sessions(_stream(d, turns, "turns")), "sessions")
    return closed.select("conversation_id", F.unix_micros("started_at").alias("started_at"),
                         F.unix_micros("last_activity_at").alias("last_activity_at"),
                         "turn_count")


@query("stream_usage_rollup", f"""
    SELECT kind, epoch_us(hour) AS window_start, count(*) AS calls,
      cast(coalesce(sum(tokens),0) AS bigint) AS tokens
    FROM (SELECT *, date_trunc('hour', created_at) AS hour FROM usage_event)
    WHERE epoch_ms(hour) + 3600000 <= (SELECT {MARK} FROM events) GROUP BY kind, hour""", "usage_event")
def stream_usage_rollup(d):
    out = _to_table(d, X.stream_usage_rollup(_stream(d, d.usage_event, "usage")), "rollup")
    return out.withColumn("window_start", F.unix_micros("window_start"))


@query("stream_emergency_alerts", f"""
    SELECT message_id, text FROM message
    WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])({WORDS})($|[^A-Za-z0-9_])')
      OR regexp_matches(text, '(?i)({PHRASES})')""", "message")
def stream_emergency_alerts(d):
    messages = d.message.select("message_id", "text")
    return _to_table(d, X.stream_emergency_alerts(_stream(d, messages, "messages")), "alerts")


@query("stream_upsert", """
    SELECT coalesce(i.shortlist_id, b.shortlist_id) AS shortlist_id,
      coalesce(i.facility_id, b.facility_id) AS facility_id,
      CASE WHEN b.shortlist_id IS NOT NULL THEN b.rank ELSE i.rank END AS rank
    FROM shortlist_item i FULL JOIN (SELECT shortlist_id, facility_id,
        first(rank ORDER BY seq DESC) AS rank FROM item_change GROUP BY 1, 2) b
      ON b.shortlist_id=i.shortlist_id AND b.facility_id=i.facility_id""",
       "shortlist_item item_change")
def stream_upsert(d):
    table = _keyed(d, d.shortlist_item, ("shortlist_id", "facility_id"), "items")
    _each_batch(d, _stream(d, d.item_change, "changes"), X.stream_upsert(table, "changes"), "items")
    return table.read().select("shortlist_id", "facility_id", "rank")


def _keyed(d, rows: DataFrame, keys: tuple[str, ...], name: str) -> KeyedTable:
    table = KeyedTable(d.spark, scratch_path(d.spark, name), keys, rows.schema)
    table.replace(rows, 16)
    return table


@query("stream_upsert_verification", ORACLES["upsert_verification"])
def stream_upsert_verification(d):
    """The matches arrive in two files, one batch each, on top of what was verified before."""
    old = d.base("supplier").select(F.col("s_suppkey").cast("string").alias("facility_id"),
                                    F.lit("OLD").alias("source"), F.col("s_name").alias("registry_name"))
    table = _keyed(d, old, ("facility_id",), "verification")
    new = matched(d).select("facility_id", "source", "registry_name")
    stream = _stream(d, new.repartition(2, "facility_id"), "matches", per_batch=1)
    _each_batch(d, stream, X.stream_upsert(table, "matches", upsert_verification), "verification")
    return table.read()


@query("stream_archive", f"""
    WITH mark AS (SELECT epoch_ms(max(created_at)) - 600000 AS m FROM turn),
    done AS (SELECT conversation_id, count(*) AS n, epoch_us(max(created_at)) + 1800000000 AS closed_at
      FROM turn GROUP BY 1 HAVING (epoch_us(max(created_at)) + 1800000000) < (SELECT m FROM mark) * 1000)
    SELECT t.conversation_id, user_id, c.lang, epoch_us(started_at) AS started_at,
      closed_at AS archived_at, cast(n AS int) AS turn_count, cast((turn_no - 1) // 500 AS int) AS part,
      string_agg(role || ':' || content, '|' ORDER BY turn_no) AS turns
    FROM turn t JOIN done USING (conversation_id) JOIN conversation c USING (conversation_id)
    GROUP BY ALL""", "turn conversation")
def stream_archive(d):
    facts = d.conversation.select("conversation_id", "user_id", F.col("lang").alias("conversation_lang"),
                                  "started_at")
    turns = d.turn.select("conversation_id", *TURN_FIELDS).join(facts, "conversation_id")
    rows = _to_table(d, archive.stream_archive(_stream(d, turns, "turns")), "archive")
    back = F.from_json("turns", "array<struct<role:string,content:string>>")
    text = F.transform(back, lambda t: F.concat(t["role"], F.lit(":"), t["content"]))
    return rows.select("conversation_id", "user_id", "lang", F.unix_micros("started_at").alias("started_at"),
                       F.unix_micros("archived_at").alias("archived_at"), "turn_count", "part",
                       F.array_join(text, "|").alias("turns"))


@query("stream_search", f"""WITH {hits_sql()}
    SELECT query_id, rank, facility_id, score FROM hits""", SEARCH_TABLES)
def stream_search(d):
    path = scratch_path(d.spark, "answers")
    batch = batch_queries(d).select("query_id", "qv", "lat", "lng", "radius_km", "type",
                                    "operator", "limit")
    write = X.stream_search(path, d.search_table)
    _each_batch(d, _stream(d, batch, "queries"), write, "answers")
    return d.spark.read.parquet(path).select("query_id", "rank", "facility_id", "score")
