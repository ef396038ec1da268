"""Benchmark items inside documents: SimHash of item-sized windows, Hamming blocks, verification.

Every item, and every window of a document that has as many words as some item, is a multiset of
five-word shingles and gets a 64-bit SimHash. Fingerprints within ``RADIUS`` bits agree, in at least
one of ``BLOCKS`` blocks, in all but RADIUS / BLOCKS bits; items are listed under every block value
that close to their own, so an equality join by window size and block finds all of them. The exact
weighted similarity of the shingles then decides.

A window can only reach the similarity if nearly all of its shingles occur in some item, so windows
are fingerprinted where a bitmap of fixed size, of all items' shingles, allows it. The bitmap never
hides a match; beyond its size it only lets more windows through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell.llm.hashing import SHINGLE_WORDS, Words, chunks, mix, shingles
from nearwell.session import materialize

SIMILARITY = 0.8
RADIUS = 17
BLOCKS = 6
BITMAP_BITS = 24
WINDOW = "doc_id long, start long, size int, fingerprint long, items array<bigint>"


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of ``hashes[start:start + size]`` for every start, each shingle counted as often."""
    bits = np.unpackbits(mix(hashes, 7).view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts + sizes] - total[starts]
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.int64).reshape(-1)


def _multiset(rows: np.ndarray) -> np.ndarray:
    """Rows of hashes, sorted, with the k-th occurrence of a hash told apart from the others."""
    rows = np.sort(rows, axis=1)
    nth = np.zeros(rows.shape, np.uint64)
    for k in range(1, rows.shape[1]):
        same = rows[:, k] == rows[:, k - 1]
        if same.any():
            nth[same, k] = nth[same, k - 1] + np.uint64(1)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(rows + nth * np.uint64(0x9E3779B97F4A7C15), 8), rows)


def _rows(ids: pa.Array, starts, words: int, prints, rows: np.ndarray, names: list[str]):
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(starts, pa.int64()), pa.array(np.full(len(rows), words, np.int32)),
         pa.array(prints), lists], names)


def _item_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        width = np.minimum(words.counts, SHINGLE_WORDS)
        by_width = {int(w): shingles(words, int(w)) for w in np.unique(width[width > 0])}
        for i in np.flatnonzero(width):
            hashes, bounds = by_width[int(width[i])]
            own = hashes[bounds[i]:bounds[i + 1]]
            prints = _fingerprints(own, np.zeros(1, np.int64), np.array([len(own)]))
            yield _rows(batch.column("item_id").slice(int(i), 1), [0], int(words.counts[i]), prints,
                        _multiset(own[None, :]), ["item_id", "start", "size", "fingerprint", "items"])


def _windows(bitmap: np.ndarray, sizes: list[int], similarity: float):
    # of two multisets of m shingles each, this many must be common
    def need(m: int) -> int:
        return max(1, math.ceil(2 * similarity / (1 + similarity) * m - 1e-9))

    def known(hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - BITMAP_BITS)
        return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column("text"))
            for width in sorted({min(s, SHINGLE_WORDS) for s in sizes}):
                hashes, bounds = shingles(words, width)
                seen = known(hashes) > 0
                full = words.counts >= width
                hits = np.diff(np.concatenate(([0], np.cumsum(seen)))[bounds])
                own = [s for s in sizes if min(s, SHINGLE_WORDS) == width]
                least = min(need(s - width + 1) for s in own)
                docs = np.flatnonzero(full & (hits >= least))
                if not len(docs):
                    continue
                count = np.diff(bounds)[docs]
                first = np.concatenate(([0], np.cumsum(count)))
                at = np.arange(first[-1]) + np.repeat(bounds[docs] - first[:-1], count)
                hashes, seen = hashes[at], seen[at]
                total = np.concatenate(([0], np.cumsum(seen)))
                place = np.arange(first[-1]) - np.repeat(first[:-1], count)
                left = np.repeat(count, count) - place
                doc = np.repeat(docs, count)
                for size in own:
                    m = size - width + 1
                    end = np.minimum(np.arange(len(hashes)) + m, len(hashes))
                    begin = np.flatnonzero((left >= m) & (total[end] - total[:-1] >= need(m)))
                    for part in np.array_split(begin, max(1, len(begin) * m // 1_000_000 + 1)):
                        if len(part):
                            rows = hashes[part[:, None] + np.arange(m)]
                            base = part[0]
                            prints = _fingerprints(hashes[base:part[-1] + m], part - base,
                                                   np.full(len(part), m))
                            yield _rows(batch.column("doc_id").take(pa.array(doc[part])),
                                        place[part], size, prints, _multiset(rows),
                                        ["doc_id", "start", "size", "fingerprint", "items"])
    return run


def _blocks() -> list[tuple[int, int]]:
    """(shift, bits) of each block of the 64 bits."""
    widths = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _block_values(fingerprint: Column, radius: int) -> Column:
    """(block, value) for every block value within ``radius`` bits of the fingerprint's."""
    def close(block: int, shift: int, width: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, shift).bitwiseAND(F.lit((1 << width) - 1))
        flips = [sum(1 << i for i in c) for k in range(radius + 1)
                 for c in itertools.combinations(range(width), k)]
        return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(
            F.lit(block).alias("block"), value.bitwiseXOR(x.cast("long")).alias("value")))

    return F.concat(*(close(b, shift, width) for b, (shift, width) in enumerate(_blocks())))


def item_sketches(benchmark: DataFrame) -> DataFrame:
    """item_id, size in words, fingerprint and shingles of each distinct item that has words."""
    return benchmark.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct(
    ).mapInArrow(_item_sketch, "item_id long, start long, size int, fingerprint long, "
                               "items array<bigint>").drop("start")


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
               radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, size, similarity): each item that a document holds, at its best.

    An item is held where a window of as many words has a weighted Jaccard similarity of at least
    ``similarity`` over five-word shingles (all words of shorter items) and a SimHash within
    ``radius`` bits: at 0.8 the distance is 9.7 bits on average with a deviation of 2.9, so one
    aligned window is missed with a probability of 0.004, an exact copy never. ``start`` is the
    window's first word (from 0), the first of the best ones. Items and documents with null ids, or
    null or blank texts, match nothing; repeated rows match once. Other columns are ignored. Without
    items, or without documents, there are no rows.
    """
    spark = docs.sparkSession
    items = materialize(item_sketches(benchmark), "items")
    # distinct item sizes, and the bitmap's words: both bounded, whatever the number of items
    sizes = [r[0] for r in items.select("size").distinct().collect()]
    hashes = items.select(F.explode("items").alias("h"))
    index = f"shiftrightunsigned(h, {64 - BITMAP_BITS})"
    filled = hashes.groupBy(F.expr(f"shiftrightunsigned({index}, 6)").alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({index} & 63 AS int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[filled["at"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    windows = materialize(source.mapInArrow(_windows(bitmap, sizes, similarity), WINDOW), "windows")

    listed = items.select("item_id", "size", F.col("fingerprint").alias("other"), F.explode(
        _block_values(F.col("fingerprint"), radius // BLOCKS)).alias("k")).select(
        "item_id", "size", "other", "k.block", "k.value")
    near = windows.select("doc_id", "start", "size", "fingerprint", F.explode(
        _block_values(F.col("fingerprint"), 0)).alias("k")).select(
        "doc_id", "start", "size", "fingerprint", "k.block", "k.value").join(
        listed, ["size", "block", "value"]).where(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius).select(
        "doc_id", "start", "size", "item_id").distinct()
    both = F.size(F.array_intersect("x", "y"))
    score = both / (F.size("x") + F.size("y") - both)
    checked = (near.join(windows.select("doc_id", "start", "size", F.col("items").alias("x"))
                         .dropDuplicates(["doc_id", "start", "size"]), ["doc_id", "start", "size"])
               .join(items.select("item_id", "size", F.col("items").alias("y")),
                     ["item_id", "size"])
               .withColumn("similarity", score).where(F.col("similarity") >= similarity))
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("start"), "size")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.start")).alias("start"), "b.size",
                       "b.similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all columns, that hold no item; rows with a null doc_id stay."""
    found = find_items(docs, benchmark, similarity).select(F.col("doc_id").alias("__held"))
    return docs.join(found.distinct(), F.col("doc_id") == F.col("__held"), "left_anti")
