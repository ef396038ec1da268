"""Building blocks that stay whole and balanced when one key holds a large share of the rows.

Each one pre-aggregates map-side or splits a hot key into bounded pieces, so no task and no
aggregation buffer ever has to hold a whole hot group.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell.session import materialize

# Keys of several parts that are broadcast.
HEAVY_KEYS = 1 << 17


def _one_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordering = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    row = F.struct(*ordering, *[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(*keys).agg(pick(row).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, NULLs last.

    An aggregate over a struct instead of a window: it combines map-side, so a hot key costs one
    row per map task. The whole row ends the struct, which makes the choice among ties total.
    """
    return _one_row(df, keys, order, F.max)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the least ``order`` per key (NULLs first)."""
    return _one_row(df, keys, order, F.min)


def exact_median(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 width: float = 0.001) -> DataFrame:
    """Exact interpolated medians per key, plus the row count ``n``.

    ``median`` keeps every distinct value of a group in one buffer, which a hot city would blow
    up. Here values are first counted in buckets of ``width`` (combined map-side; coordinates are
    bounded, so a key has at most range/width buckets), the bucket or two holding the middle ranks
    are found, and only values inside those are ordered. Keys and values must not be NULL.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("v")) for c in columns
        ])).alias("p"),
    ).select(*keys, "p.dim", "p.v", F.floor(F.col("p.v") / width).alias("bucket"))
    buckets = long.groupBy(*keys, "dim", "bucket").agg(F.count("*").alias("in_bucket"))
    ordered = Window.partitionBy(*keys, "dim").orderBy("bucket")
    whole = Window.partitionBy(*keys, "dim")
    ranked = buckets.select(
        "*", F.sum("in_bucket").over(ordered).alias("upto"),
        F.sum("in_bucket").over(whole).alias("n"),
    ).select(
        "*", (F.col("upto") - F.col("in_bucket")).alias("before"),
        F.floor((F.col("n") + 1) / 2).alias("lo"), (F.floor(F.col("n") / 2) + 1).alias("hi"))
    middle = ranked.filter("upto >= lo AND before < hi").select(
        *keys, "dim", "bucket", "before", "n", "lo", "hi")
    values = (long.join(middle, [*keys, "dim", "bucket"])
              .groupBy(*keys, "dim", "bucket", "before", "n", "lo", "hi", "v")
              .agg(F.count("*").alias("same")))
    inside = Window.partitionBy(*keys, "dim", "bucket").orderBy("v")
    values = values.withColumn("last", F.col("before") + F.sum("same").over(inside)).withColumn(
        "prev", F.col("last") - F.col("same"))
    lo = F.max(F.when(F.expr("prev < lo AND lo <= last"), F.col("v")))
    hi = F.max(F.when(F.expr("prev < hi AND hi <= last"), F.col("v")))
    medians = values.groupBy(*keys, "dim").agg(
        (lo * 0.5 + hi * 0.5).alias("m"), F.max("n").alias("n"))
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("dim") == c, F.col("m"))).alias(c) for c in columns],
        F.max("n").alias("n"))


def running_number(df: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """1, 2, 3, ... per key in ``order``, however many rows a key has at one time.

    Rows are dealt by ranges of (key, order), so a hot key is as many pieces as its rows need; the
    pieces are written, numbered apart, and shifted by the counts of the pieces before them. Rows that
    agree in key and order are numbered by a hash of the row.
    """
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    pieces = materialize(
        df.repartitionByRange(F.col(key), *order, tie).withColumn("_piece", F.spark_partition_id()), "pieces")
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.groupBy(key, "_piece").agg(F.count("*").alias("_n")).select(
        F.col(key).alias("_key"), F.col("_piece").alias("_at"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    piece = Window.partitionBy(key, "_piece").orderBy(*order, tie)
    same = (F.col("_piece") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))
    return (pieces.join(shift, same)
            .withColumn(name, (F.row_number().over(piece) + F.col("_shift")).cast("int"))
            .drop("_piece", "_key", "_at", "_shift"))


def previous_value(df: DataFrame, key: str, order: Column, bucket: Column, value: Column,
                   name: str) -> DataFrame:
    """The last non-NULL ``value`` strictly before each row of its key, in ``order``.

    ``bucket`` must not decrease along ``order`` (a time slice of its first column, say). The last
    value of every bucket is a map-side aggregate, carried over the (few) buckets, and only rows of
    one bucket meet in a window.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    lasts = df.groupBy(key, "_bucket").agg(
        F.max(F.when(F.col("_value").isNotNull(),
                     F.struct(order.alias("o"), F.col("_value").alias("v")))).alias("_last"))
    earlier = (Window.partitionBy(key).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.select(
        key, "_bucket", F.last("_last", ignorenulls=True).over(earlier)["v"].alias("_carried"))
    piece = (Window.partitionBy(key, "_bucket").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (df.join(carried, [key, "_bucket"])
            .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(piece),
                                         F.col("_carried")))
            .drop("_bucket", "_value", "_carried"))


def split_groups(df: DataFrame, key: str, item: Column, max_rows: int, size: Column | None = None,
                 max_bytes: int = 64 << 20) -> DataFrame:
    """Add ``part`` and ``parts`` so that (key, part) holds about ``max_rows`` rows at most, and about
    ``max_bytes`` of ``size`` where that is given.

    Rows are counted map-side, and only keys that need several parts are joined: at most one for every
    ``max_rows`` rows and every ``max_bytes`` bytes. Up to ``HEAVY_KEYS`` of them are broadcast, so that no
    task gets a whole hot key; of more, each has a small share. A null key has its parts like any other.
    """
    weight = F.lit(0) if size is None else F.coalesce(size, F.lit(0))
    counts = df.groupBy(key).agg(F.count("*").alias("_n"), F.sum(weight).alias("_b"))
    needed = F.greatest(F.ceil(F.col("_n") / max_rows), F.ceil(F.col("_b") / max_bytes)).cast("int")
    # written first, so that Spark knows how few they are
    heavy = materialize(counts.select(F.col(key).alias("_key"), needed.alias("_parts")).where("_parts > 1"),
                        "group-parts")
    if heavy.count() <= HEAVY_KEYS:
        heavy = F.broadcast(heavy)
    return df.join(heavy, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        "parts", F.coalesce("_parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64(item, F.lit("part")), F.col("parts").cast("long")).cast("int")).drop(
        "_key", "_parts")
