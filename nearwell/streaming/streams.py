"""Streams. Each takes a streaming DataFrame and returns one, or a foreachBatch writer."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.functions.messages import emergency_flag
from nearwell.operators.search import search_facilities
from nearwell.operators.shortlists import upsert_items
from nearwell.sources.keyed import KeyedTable


def stream_idle_sessions(turns: DataFrame, gap: str = f"{K.IDLE_MINUTES} minutes",
                         delay: str = "10 minutes") -> DataFrame:
    """One row per conversation stretch once it has been silent for ``gap``.

    turns(conversation_id, created_at). State is one small row per open session;
    ``archive.stream_archive`` keeps the turns as well and emits the archive rows.
    """
    return (turns.withWatermark("created_at", delay)
            .groupBy("conversation_id", F.session_window("created_at", gap).alias("w"))
            .agg(F.count("*").alias("turn_count"),
                 F.max("created_at").alias("last_activity_at"))
            .select("conversation_id", F.col("w.start").alias("started_at"),
                    "last_activity_at", F.col("w.end").alias("closed_at"), "turn_count"))


def stream_usage_rollup(events: DataFrame, width: str = "1 hour",
                        delay: str = "10 minutes") -> DataFrame:
    """Calls and tokens per kind per tumbling window; rows later than the watermark are dropped."""
    return (events.withWatermark("created_at", delay)
            .groupBy("kind", F.window("created_at", width).alias("w"))
            .agg(F.count("*").alias("calls"),
                 F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
            .select("kind", F.col("w.start").alias("window_start"), "calls", "tokens"))


def stream_emergency_alerts(messages: DataFrame) -> DataFrame:
    """Messages that name an emergency, flagged before any search."""
    return messages.filter(emergency_flag(F.col("text")))


def stream_upsert(table: KeyedTable, writer: str,
                  apply: Callable[[DataFrame, DataFrame], DataFrame] = upsert_items,
                  ) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that merges each batch of changes into a keyed table.

    Only the buckets that a batch touches are rewritten, and a batch that is run again after a
    failure changes nothing. ``apply`` is ``upsert_items``, ``upsert_verification`` or another rule
    (rows, changes) -> rows. Name the ``writer`` after the stream and its checkpoint.
    """
    def write(changes: DataFrame, batch_id: int) -> None:
        changes.persist()
        try:
            table.merge(changes, apply, writer, batch_id)
        finally:
            changes.unpersist()
    return write


def stream_search(path: str, table: DataFrame, **kwargs) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that answers each batch of queries against a stored search table."""
    def write(queries: DataFrame, batch_id: int) -> None:
        hits = search_facilities(queries, table, **kwargs)
        hits.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write
