"""Usage and cost rollups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K


def usage_rollup(events: DataFrame) -> DataFrame:
    """(kind, calls, tokens, first_at)."""
    return events.groupBy("kind").agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.min("created_at").alias("first_at"))


def price_table(spark, prices: dict[str, float], value: str) -> DataFrame:
    return spark.createDataFrame(sorted(prices.items()), f"kind string, {value} double")


def measured_cost(rollup: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """One row: cost per priced kind, total, searches, cost per search, first event time.

    One embedding call is one search; without any, the cost per search is 0. Sums are taken before
    rounding, as the figures shown are.
    """
    prices = K.PRICE_PER_MTOK if prices is None else prices

    def of(kind, c):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))

    raw = {k: of(k, "tokens") / 1e6 * p for k, p in prices.items()}
    one = rollup.agg(*[c.alias(f"_{k}") for k, c in raw.items()],
                     of("embed", "calls").alias("searches"), F.min("first_at").alias("since"))
    total = sum((F.col(f"_{k}") for k in prices), F.lit(0.0))
    per = F.coalesce(F.try_divide(total, F.col("searches")), F.lit(0.0))
    return one.select("since", *[F.round(f"_{k}", 4).alias(f"{k}_usd") for k in prices],
                      F.round(total, 4).alias("total_usd"), "searches",
                      F.round(per, 4).alias("per_search_usd"))


def compute_estimate(prices: DataFrame, hours: int = K.HOURS_PER_MONTH) -> DataFrame:
    """Monthly cost of prices(kind, rate_per_hour)."""
    return prices.withColumn("cost_usd", F.round(F.col("rate_per_hour") * hours, 2))


def monthly_projection(cost: DataFrame, grid: DataFrame, compute_usd: float,
                       days: int = K.DAYS_PER_MONTH) -> DataFrame:
    """Projected month for grid(searches_per_day) at the measured cost per search."""
    per = cost.select("per_search_usd").scalar()
    variable = per * F.col("searches_per_day") * days
    return grid.select("searches_per_day", variable.alias("variable_usd"),
                       (variable + compute_usd).alias("monthly_usd"))
