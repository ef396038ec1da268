"""URL allow and block rules by a sort-merge sweep over reversed-host keys.

A host written label by label from the right and closed by a dot ("org.example.www.") turns "this
host and its subdomains" into a key prefix, that is into an interval of the sorted keys; a path
prefix under one rule host is an interval likewise. Prefix intervals nest or are disjoint, so a sweep
over the sorted keys needs one stack of open intervals. The sweep runs as window functions: a running
sum of opened less closed intervals is the stack's height, and the last interval opened at each
height is the stack. The keys are cut into ranges, and the stack left open by the ranges before
is carried into each.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearwell.session import scratch_path

START, POINT, END = 0, 1, 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules as (verdict, rule): verdict ``allow`` or ``block``, rule ``host`` or ``host/path``."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``point`` and ``stack``: per point the intervals whose key is a prefix of its key.

    ``points`` has ``key`` string and ``point`` struct, ``intervals`` has unique ``key`` string and
    ``interval`` struct. The stack goes from the outermost to the innermost. Equal points are one
    row each; no points or no intervals give empty stacks or no rows.
    """
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.encode("key", "UTF-8")
    kinds = {f.name: f.dataType for f in points.schema.fields + intervals.schema.fields}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in ("point", "interval")}
    # 0xFF, which no UTF-8 text contains, sorts after every continuation of a prefix
    close = F.concat(key, F.unhex(F.lit("FF")))
    events = (points.select(key.alias("key"), F.lit(POINT).alias("kind"), "point", none["interval"])
              .union(intervals.select(key, F.lit(START), none["point"], "interval"))
              .union(intervals.select(close, F.lit(END), none["point"], none["interval"])))
    # a written table fixes the ranges for everything below; the hash cuts runs of one key
    path = scratch_path(spark, "sweep")
    (events.repartitionByRange(n, "key", "kind", F.xxhash64("point"))
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    events = spark.read.parquet(path)

    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    edges = events.where(F.col("kind") != POINT)
    # at most one row per range here, and one per range and height below
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = events.groupBy("part").agg(F.sum(step).alias("net")).select(
        "part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("open"))
    inside = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    opened = (edges.withColumn("up", F.sum(step).over(inside)).join(parts, "part")
              .where(F.col("kind") == START)
              .select("part", "key", "interval", (F.col("open") + F.col("up")).alias("height")))
    height = opened.agg(F.max("height")).first()[0] or 0
    levels = range(1, int(height) + 1)
    last = opened.groupBy("part").agg(F.lit(0).alias("_"), *(
        F.max_by(F.when(F.col("height") == j, F.col("interval")),
                 F.when(F.col("height") == j, F.col("key"))).alias(f"last{j}") for j in levels))
    carried = parts.join(last, "part", "left").select("part", "open", *(
        F.last(f"last{j}", True).over(before).alias(f"carry{j}") for j in levels))

    rows = events.join(carried, "part")
    rows = rows.withColumn("height", F.col("open") + F.sum(step).over(inside))
    starts = F.col("kind") == START
    rows = rows.withColumns({f"level{j}": F.coalesce(
        F.last(F.when(starts & (F.col("height") == j), F.col("interval")), True).over(inside),
        F.col(f"carry{j}")) for j in levels})
    stack = (F.slice(F.array(*(F.col(f"level{j}") for j in levels)), F.lit(1),
                     F.col("height").cast("int")) if height
             else F.array().cast(f"array<{kinds['interval'].simpleString()}>"))
    return rows.where(F.col("kind") == POINT).select("point", stack.alias("stack"))


def match(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A rule ``host/path`` fits its host and all subdomains where the url's path starts with the
    rule's; the longest rule that fits wins (of equal lengths the one with the longer host), and of
    equal rules a block. Without one, ``rule`` is null and the verdict is ``default``. A null url, or
    one without ``://``, has an empty host and path. Repeated rows are judged each; columns besides
    page_id and url are ignored.

    Hosts are swept once each, then each distinct (host, path) below every rule host that covers it
    (no more than the host has labels), so repeated urls and busy hosts add no work to the sweep.
    """
    slash = F.instr("rule", "/")
    parsed = (rules.where(F.col("rule").isNotNull()).groupBy("rule")
              .agg(F.max("verdict").alias("verdict"))
              .withColumn("rule_host", F.when(slash > 0, F.expr("left(rule, instr(rule, '/') - 1)"))
                          .otherwise(F.col("rule")))
              .withColumn("rule_path", F.expr("substr(rule, length(rule_host) + 1)")))
    located = pages.select("page_id", host_of(F.col("url")).alias("host"),
                           path_of(F.col("url")).alias("path"))
    hosts = located.groupBy("host").agg(F.lit(1).alias("_"))
    over = sweep(hosts.select(reversed_host(F.col("host")).alias("key"),
                              F.struct("host").alias("point")),
                 parsed.select("rule_host").distinct().select(
                     reversed_host(F.col("rule_host")).alias("key"),
                     F.struct("rule_host").alias("interval")))
    covering = over.select("point.host", F.explode("stack.rule_host").alias("rule_host"))
    below = F.concat(reversed_host(F.col("rule_host")), F.col("path"))
    spots = located.select("host", "path").distinct().join(covering, "host").select(
        below.alias("key"), F.struct("host", "path").alias("point"))
    hits = sweep(spots, parsed.select(
        F.concat(reversed_host(F.col("rule_host")), F.col("rule_path")).alias("key"),
        F.struct("rule", "verdict", "rule_host").alias("interval")))
    inner = F.try_element_at("stack", F.lit(-1))
    best = (hits.where(F.size("stack") > 0)
            .select("point.host", "point.path", inner.alias("hit"))
            .groupBy("host", "path")
            .agg(F.max_by("hit", F.struct(F.length("hit.rule"), F.length("hit.rule_host")))
                 .alias("hit")))
    return located.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
