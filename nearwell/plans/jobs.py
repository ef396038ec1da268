"""Jobs over stored tables: registry ingest, verification, and the sweep of old conversations.

Each can be run again after a failure: merges of a batch that is done change nothing, and the files
of a batch replace those of its failed attempt.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.operators import cleaning as OC
from nearwell.operators import registry as OR
from nearwell.operators import sessions as ON
from nearwell.operators.skew import first_row
from nearwell.session import materialize
from nearwell.sources.keyed import KeyedTable
from nearwell.sources.readers import scan_registry_csv
from nearwell.sources.sinks import registry_csv_sink

VERIFICATION = ("facility_id string, source string, registry_name string, registry_type string, "
                "verified boolean, accredited boolean, verified_services array<string>, "
                "match_score double, verified_at timestamp")
SEARCHES = ("session_id string, user_id string, raw_query string, parsed_care_need string, "
            "parsed_location string, parsed_lat double, parsed_lng double, radius_km double, "
            "result_count int, created_at timestamp, created_date date")


def ingest_registry(pages: DataFrame, texts: DataFrame, out: str, source: str, state: str) -> None:
    """Write the registry rows of all documents that listing pages link to, as CSV under ``out``.

    pages(page_id, html) are the listings, texts(url, text) the extracted documents; a link without a
    text gives no rows. A document linked more than once belongs to its first link, whose label is the
    city where the document names no district. Of rows equal in lower-cased name and city the first
    stays, by page, link and place in the document.
    """
    links = first_row(OR.extract_listing_links(pages), ["url"], [F.col("page_id"), F.col("pos")]).select(
        F.col("url").alias("doc_id"), F.col("district").alias("label"), "page_id",
        F.col("pos").alias("link"))
    links = materialize(links, "links")
    linked = texts.select(F.col("url").alias("doc_id"), "text").join(links, "doc_id", "left_semi")
    parsed = OR.parse_registry_text(linked, state).join(links.select("doc_id", "label"), "doc_id")
    rows = OR.registry_rows(parsed, source, state).join(links.drop("label"), "doc_id")
    kept = OC.dedupe_first_seen(rows, {"name": F.lower("registry_name"), "city": F.lower("city")},
                                ["page_id", "link", "pos"])
    registry_csv_sink(kept, out)


def verify_facilities(csvs: str, facilities: DataFrame, table: KeyedTable, as_of, batch: int) -> DataFrame:
    """Match all registry CSVs with the facilities and merge the best matches into ``table``.

    ``table`` has the columns of ``VERIFICATION``, keyed by facility_id; facilities without a match
    keep the row they had. Returns the number of verified facilities per source.
    """
    staged = OR.stage_registry(scan_registry_csv(table.spark, csvs)).distinct()
    found = OR.best_match(materialize(staged, "registry"), facilities).withColumn(
        "verified_at", F.lit(as_of).cast("timestamp"))
    table.merge(materialize(found, "verification"), OR.upsert_verification, "verify", batch)
    return OR.verification_summary(table.read())


def log_searches(answers: DataFrame, requests: DataFrame, searches: KeyedTable, as_of, batch: int) -> None:
    """Add a row of ``SEARCHES`` per answered search to its day.

    ``answers`` are those of :mod:`nearwell.plans.ask`; requests(message_id, user_id, text, radius_km)
    tell who asked. Requests that were not searched (refused, without a need or place) leave none.
    ``searches`` is keyed by created_date, as the sweep expects it.
    """
    found = answers.where(F.col("route").isin("ok", "no_results"))
    stamp = F.lit(as_of).cast("timestamp")
    rows = found.join(requests.select("message_id", "user_id", "text", "radius_km"), "message_id").select(
        F.sha2(F.concat_ws("|", "message_id", F.lit(str(batch))), 256).alias("session_id"), "user_id",
        F.col("text").alias("raw_query"), F.col("need").alias("parsed_care_need"),
        F.col("label").alias("parsed_location"), F.col("lat").alias("parsed_lat"),
        F.col("lng").alias("parsed_lng"), F.col("radius_km").cast("double").alias("radius_km"),
        F.col("n_results").cast("int").alias("result_count"), stamp.alias("created_at"),
        F.to_date(stamp).alias("created_date"))
    searches.merge(rows, DataFrame.unionByName, "log", batch)


def sweep_conversations(conversations: KeyedTable, turns: KeyedTable, searches: KeyedTable, archive: str,
                        as_of, batch: int, minutes: int = K.IDLE_MINUTES,
                        days: int = K.RETENTION_DAYS) -> DataFrame:
    """Archive idle and closing conversations, delete them, and delete what is past its retention.

    ``conversations`` and ``turns`` are keyed by conversation_id, ``searches`` by created_date, the day
    of its created_at; only buckets that lose rows are rewritten. Archive rows lie in one folder per
    batch. A sweep that failed is run again under its batch and ``as_of``: its archive is written anew
    as long as the turns are there. Returns the archive rows of the batch.
    """
    path, writer = f"{archive}/batch={batch}", "sweep"
    before = conversations.read()
    done = materialize(ON.archivable(before, as_of, minutes), "closing")
    if turns.last_batch(writer) < batch:
        ON.archive_rollup(done, turns.read(), as_of).write.mode("overwrite").parquet(path)
    key = "conversation_id"
    kept = ON.retention_delete(before, "started_at", as_of, days)
    gone = done.select(key).union(before.select(key).exceptAll(kept.select(key))).distinct()
    gone = materialize(gone, "gone")
    # turns first: a conversation whose turns are left behind would never be found again
    for table in (turns, conversations):
        table.merge(gone, ON.purge_archived, writer, batch)
    log = searches.read()
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    expired = log.where(F.col("created_at") < edge).select("created_date").distinct()
    searches.merge(expired, lambda rows, _: ON.retention_delete(rows, "created_at", as_of, days),
                   writer, batch)
    return conversations.spark.read.parquet(path)
