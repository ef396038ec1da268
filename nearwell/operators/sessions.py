"""Conversations: turn numbers, state, idle detection, archive and retention."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.operators.skew import running_number

TURNS_PER_ARCHIVE_ROW = 500


def number_turns(messages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add turn_no to messages(conversation_id, created_at, seq), after any existing turns.

    Numbered in ranges of time, so one busy conversation is spread over many tasks.
    """
    numbered = running_number(messages, "conversation_id", [F.col("created_at"), F.col("seq")], "turn_no")
    if existing is None:
        return numbered
    last = existing.groupBy("conversation_id").agg(F.max("turn_no").alias("_last"))
    return (numbered.join(last, "conversation_id", "left")
            .withColumn("turn_no", (F.col("turn_no") + F.coalesce("_last", F.lit(0))).cast("int"))
            .drop("_last"))


def _json_text(c: str) -> Column:
    """A string column as JSON; null stays the word null."""
    whole = F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _json_number(c: str) -> Column:
    """A measure as a plain decimal without an exponent or trailing zeros."""
    plain = F.regexp_replace(F.col(c).cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.coalesce(plain, F.lit("null"))


COMPACT = {"facility_id": _json_text, "name": _json_text, "distance_km": _json_number,
           "score": _json_number, "match_reason": _json_text, "city": _json_text}


def compact_results(hits: DataFrame) -> DataFrame:
    """(query_id, result_count, results_json): six fields per hit, by rank (at most 50 hits).

    Numbers are written as 85, 0.0005 or -0.0007, and a missing value as null.
    """
    parts: list = []
    for c, write in COMPACT.items():
        name = "match_reason_en" if c == "match_reason" else c
        parts += [F.lit(f'{"," if parts else "{"}"{name}":'), write(c)]
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.concat(*parts, F.lit("}")).alias("hit"))))
    return hits.groupBy("query_id").agg(
        F.count("*").alias("result_count"),
        F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["hit"]), ","),
                 F.lit("]")).alias("results_json"))


def conversation_state(turns: DataFrame) -> DataFrame:
    """Last activity (the latest turn) and last detected language per conversation."""
    return turns.groupBy("conversation_id").agg(
        F.max("created_at").alias("last_activity_at"),
        F.max(F.when(F.col("lang").isNotNull(), F.struct("turn_no", "lang")))["lang"]
        .alias("lang"))


def idle_conversations(conversations: DataFrame, as_of,
                       minutes: int = K.IDLE_MINUTES) -> DataFrame:
    """Active conversations silent for strictly longer than ``minutes`` before ``as_of``."""
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return conversations.filter((F.col("status") == "active")
                                & (F.col("last_activity_at") < edge))


def archivable(conversations: DataFrame, as_of, minutes: int = K.IDLE_MINUTES) -> DataFrame:
    """Idle conversations and those whose close was begun (and may have failed half-way)."""
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return conversations.filter(
        (F.col("status") == "closing")
        | ((F.col("status") == "active") & (F.col("last_activity_at") < edge)))


TURN_FIELDS = ["turn_no", "role", "content", "parsed_need", "parsed_place", "lat", "lng",
               "result_count", "results_json", "created_at"]


def archive_rollup(conversations: DataFrame, turns: DataFrame, as_of,
                   per_row: int = TURNS_PER_ARCHIVE_ROW) -> DataFrame:
    """Archive rows: conversation fields, turn_count, and the ordered turns as JSON.

    A conversation of more than ``per_row`` turns is given on several rows (``part``), each with
    the next stretch of turns, so no row has to hold an endless conversation.
    """
    pieces = (turns.join(conversations.select("conversation_id"), "conversation_id", "left_semi")
              .withColumn("part", F.floor((F.col("turn_no") - 1) / per_row).cast("int")))
    lists = pieces.groupBy("conversation_id", "part").agg(
        F.count("*").alias("_n"),
        F.to_json(F.sort_array(F.collect_list(F.struct(*TURN_FIELDS)))).alias("turns"))
    counts = pieces.groupBy("conversation_id").agg(F.count("*").alias("turn_count"))
    return (conversations.join(counts, "conversation_id", "left")
            .join(lists, "conversation_id", "left")
            .select("conversation_id", "user_id", "lang", "started_at",
                    F.lit(as_of).cast("timestamp").alias("archived_at"),
                    F.coalesce("turn_count", F.lit(0)).cast("int").alias("turn_count"),
                    F.coalesce("part", F.lit(0)).alias("part"),
                    F.coalesce("turns", F.lit("[]")).alias("turns")))


def purge_archived(df: DataFrame, archived: DataFrame, key: str = "conversation_id") -> DataFrame:
    """What is left after deleting archived conversations (use on both tables)."""
    return df.join(archived.select(key).distinct(), key, "left_anti")


def retention_delete(df: DataFrame, ts_col: str, as_of, days: int = K.RETENTION_DAYS) -> DataFrame:
    """Rows still inside the retention window; rows without a time stay."""
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return df.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= edge))
