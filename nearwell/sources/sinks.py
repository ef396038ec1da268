"""Sinks: distributed writes, the only functions here that run a job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K


def full_refresh_sink(df: DataFrame, path: str) -> None:
    """Replace a table's content."""
    df.write.mode("overwrite").parquet(path)


def silver_ctas(df: DataFrame, table: str, path: str | None = None,
                bucket_by: str | None = None, buckets: int = 0) -> None:
    """Create or replace a catalog table from a query, bucketed by a join key when asked."""
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    if bucket_by is not None:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(table)


def append_event_log(df: DataFrame, path: str) -> None:
    """Append usage events or search sessions, one folder per day of created_at."""
    (df.withColumn("created_date", F.to_date("created_at"))
     .write.mode("append").partitionBy("created_date").parquet(path))


def archive_sink(df: DataFrame, path: str) -> None:
    """Append archive rows, one folder per archive day."""
    (df.withColumn("archived_date", F.to_date("archived_at"))
     .write.mode("append").partitionBy("archived_date").parquet(path))


def registry_csv_sink(df: DataFrame, path: str) -> None:
    """Registry rows as CSV with a header, in the column order the matcher reads."""
    (df.select(*K.REGISTRY_COLUMNS).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("emptyValue", "").csv(path))


def fill_dialogue_defaults(df: DataFrame, as_of, natural_key: list[str], id_column: str,
                           defaults: dict) -> DataFrame:
    """Missing id (a digest of the natural key), created time and other defaults filled in."""
    stamp = F.lit(as_of).cast("timestamp")
    have = {c: F.col(c) for c in df.columns}
    out = {id_column: F.coalesce(
        have.get(id_column, F.lit(None)),
        F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                  for c in natural_key]), 256))}
    for c, value in defaults.items():
        value = stamp if value == "as_of" else F.lit(value)
        out[c] = F.coalesce(have.get(c, F.lit(None)), value)
    return df.withColumns(out)


def append_dialogue(df: DataFrame, path: str) -> None:
    """Append conversations, turns or shortlists with their defaults already filled."""
    df.write.mode("append").parquet(path)
