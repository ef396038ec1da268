"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents of equal text stay together. Differencing starts from one partial partition per group and
keeps combining the two of largest spread, oppositely ordered, until one is left. It runs in bounded
pieces: first over the heavy groups (at most ``2 * HEAVY`` by their definition), then over buckets of
light groups, each of which also combines its share of what the heavy groups left uneven, and at last
over one bucket held back, which combines the sums of all the others. Only groups' sizes are dealt
out, never texts, and no step holds a group's documents.
"""

from __future__ import annotations

import heapq
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell.session import materialize, scratch_path

SHARDS = 8
#: A group is heavy from 1/HEAVY of all bytes or of all rows.
HEAVY = 4096
#: Light groups expected in a bucket.
BUCKET = 1 << 15
#: Rows numbered in one piece, as a power of two.
PIECE_BITS = 16


def difference(sizes: np.ndarray, start: list[int]) -> np.ndarray:
    """The shard of each size, when the shards hold ``start`` already.

    A partial partition is its sums, largest first, with the tree of sizes behind each. Combining
    pairs the largest sum of one with the smallest of the other. The shards of ``start`` are leaves
    of the first partial partition, one in each tree at the end. Equal spreads go by position.
    """
    n, k = len(sizes), len(start)
    left, right = [], []  # children of the nodes after the leaves
    order = sorted(range(k), key=lambda i: (-start[i], i))
    sums = [start[i] for i in order]
    heap = [(sums[-1] - sums[0], -1, sums, [n + i for i in order])]
    rest = [0] * (k - 1)
    none = [-1] * (k - 1)
    heap += [(-s if k > 1 else 0, i, [s, *rest], [i, *none]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    top = n + k
    while len(heap) > 1:
        _, at, a, x = heapq.heappop(heap)
        _, other, b, y = heap[0]
        merged = []
        for s, t, u, v in zip(a, x, reversed(b), reversed(y)):
            if t < 0:
                merged.append((s + u, v))
            elif v < 0:
                merged.append((s + u, t))
            else:
                left.append(t)
                right.append(v)
                merged.append((s + u, top))
                top += 1
        merged.sort(key=itemgetter(0), reverse=True)
        sums, nodes = zip(*merged)
        heapq.heapreplace(heap, (sums[-1] - sums[0], min(at, other), sums, nodes))
    out = np.empty(n, np.int32)
    for root in heap[0][3]:
        shard, own, todo = 0, [], [root]
        while todo:
            node = todo.pop()
            if node >= n + k:
                todo += left[node - n - k], right[node - n - k]
            elif node >= n:
                shard = node - n
            else:
                own.append(node)
        out[own] = shard
    return out


PLACED = "key long, bytes long, shard int"


def _place(groups: DataFrame, by, start: list[int], light: int | None = None) -> DataFrame:
    """(key, bytes, shard) of groups differenced within each ``by``.

    A piece starts from ``start``, or from its share of it by bytes among ``light`` bytes.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        own = int(rows["bytes"].sum())
        first = start if light is None else [s * own // light for s in start]
        return rows[["key", "bytes"]].assign(shard=difference(rows["bytes"].to_numpy(), first))

    return groups.select(by.alias("piece"), "key", "bytes").groupBy("piece").applyInPandas(run, PLACED)


def _sums(placed: DataFrame, start: list[int]) -> list[int]:
    found = {r["shard"]: r["s"] for r in placed.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()}
    return [s + found.get(i, 0) for i, s in enumerate(start)]


def balance(groups: DataFrame, shards: int = SHARDS, heavy: int = HEAVY,
            bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Groups (key long, bytes long, n long), each key once, as placed (key, bytes, shard): the
    heavy ones, at most ``2 * heavy`` rows, and the light ones.

    Pass a written table: it is read by every step. Bytes are not negative. Equal input gives equal
    shards, whatever its order or partitions; no rows give no rows.
    """
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    is_heavy = (F.col("bytes") * heavy >= total[0]) | (F.col("n") * heavy >= total[1])
    start = [0] * shards
    large = materialize(_place(groups.where(is_heavy), F.lit(0), start), "shards-heavy")
    start = _sums(large, start)
    light = groups.where(~is_heavy)
    size = light.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-size[0] // bucket))
    dealt = F.pmod(F.xxhash64("key", F.lit(buckets)), F.lit(buckets))
    small = None
    if buckets > 1:
        small = materialize(_place(light.where(dealt > 0), dealt, start, size[1]), "shards-light")
        start = _sums(small, start)
    last = materialize(_place(light.where(dealt == 0), F.lit(0), start), "shards-last")
    return large, last if small is None else small.unionByName(last)


def assign(docs: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row (and, with ``carry``, the row itself as
    the struct ``doc``).

    size is the text's UTF-8 bytes plus 1. Rows of equal text are one group and share a shard; null
    counts as the empty text. Texts that agree in their 64-bit hash merely stay together. slot
    numbers each shard's rows from 0 without gaps. Repeated rows and null doc_ids are rows like any
    other, an empty table gives no rows, and further columns are ignored whatever their names.
    A group larger than a shard's fair share fills one shard by itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    nested = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    # once written, the row numbers stay what they are
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"), *nested), "shards-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")),
                         "shards-groups")
    large, small = balance(groups, shards)
    # at most 2 * HEAVY rows, and every key with more than 1/HEAVY of the rows is among them
    tagged = rows.join(F.broadcast(large.select("key", "shard")), "key", "left")
    rest = tagged.where("shard IS NULL").drop("shard").join(small.select("key", "shard"), "key")
    placed = materialize(tagged.where("shard IS NOT NULL").unionByName(rest).withColumn(
        "piece", F.shiftright("row", PIECE_BITS)), "shards-placed")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n")).select(
        "shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "piece").orderBy("row")
    return placed.join(counts, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("before") + F.row_number().over(inside) - 1).alias("slot"), *(["doc"] if carry else []))


def write_shards(docs: DataFrame, folder: str | None = None, shards: int = SHARDS) -> str:
    """Write the documents, all columns, as Parquet under ``folder/shard=<i>`` with their ``slot``.

    Returns the folder, by default a new one in the shared scratch space. The rows stay in as many
    tasks as hold them, so a shard is many files. A column named ``doc`` stays inside that struct.
    """
    folder = folder or scratch_path(docs.sparkSession, "shards")
    assign(docs, shards, carry=True).select("shard", "slot", "doc").write.partitionBy("shard").parquet(folder)
    return folder
