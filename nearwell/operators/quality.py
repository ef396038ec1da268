"""Counts and validation reports."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) per named table, one map-side count each."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
             for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def validation_report(silver: DataFrame) -> DataFrame:
    """(total, passing, flagged) of the internal check."""
    ok = F.coalesce(F.col("geo_valid_internal"), F.lit(False))
    return silver.agg(F.count("*").alias("total"), F.count_if(ok).alias("passing"),
                      F.count_if(~ok).alias("flagged"))
