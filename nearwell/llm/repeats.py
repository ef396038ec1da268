"""Exact repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier. Every such string is filed
under one of its GRAM-byte grams, the one whose hash is smallest, so equal strings are filed alike;
neighbouring strings under the same gram are one extract of the text. Grams that occur once are left
out, equal extracts are counted once, and what remains is cut into blocks of bounded size by gram.

In a block, suffixes are sorted to depth LENGTH, and the lengths of their common prefixes are derived
breadth first in increasing order, from the greatest depth below LENGTH that the sort went through: a
boundary between neighbouring suffixes has common prefix l + 1 if the step back through the transform
(each suffix less its first byte) encloses a boundary of length l. Expansion stops at LENGTH: boundaries not reached lie inside groups of equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell.llm.bitmap import bitmap_of, in_bitmap, slot_of
from nearwell.llm.hashing import CACHED_BYTES, chunks, mix, rolling, span_hashes, text_bytes
from nearwell.llm.passages import compact_windows
from nearwell.session import materialize

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 256 << 10
#: A gram of more distinct extracts than this is compared string by string instead of in a block.
BUSY = 4096


def extracts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, text number, first string start, number of strings) of all extracts.

    The strings that start at first, first + 1, ... all have the gram of that hash as their
    smallest; every string of ``length`` bytes within a text belongs to exactly one extract.
    """
    span = length - GRAM + 1  # grams in one string
    values = rolling(data, GRAM) | np.uint64(1)
    # what reaches over the end of a text is no gram
    over = offsets[1:, None] - np.arange(1, GRAM)
    values[over[over >= offsets[:-1, None]]] = 0
    a, c, b = compact_windows(values, span)
    low = np.maximum(a, c - span + 1)
    high = np.minimum(c, b - span + 1)
    doc = np.searchsorted(offsets, c, "right") - 1
    return values[c], doc, low - offsets[doc], high - low + 1


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=CACHED_BYTES):
        key, *_ = extracts(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends


def _content(flat: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each slice."""
    with np.errstate(over="ignore"):
        n = np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends))
        terms = mix(flat.astype(np.uint64) + (n.astype(np.uint64) << np.uint64(8)), salt)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return mix(total[ends[1:]] - total[ends[:-1]], salt + 1)


def _shared(bitmap: np.ndarray):
    """Extracts under the grams of the bitmap, each with a hash of its content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CACHED_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            key, doc, first, count = extracts(data, offsets)
            keep = in_bitmap(bitmap, slot_of(key.view(np.int64), np.zeros(1, np.int64)))
            key, doc, first, count = key[keep], doc[keep], first[keep], count[keep]
            begin = offsets[doc] + first
            h = span_hashes(data, begin, begin + count + LENGTH - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)),
                 batch.column("doc_id").take(pa.array(doc)), pa.array(first.astype(np.int32)),
                 pa.array(count, pa.int32())],
                ["key", "h", "doc_id", "first", "count"])
    return run


def _contents(bitmap: np.ndarray):
    """The bytes of the extracts whose document and start are in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CACHED_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            key, doc, first, count = extracts(data, offsets)
            ids = batch.column("doc_id").to_numpy()[doc]
            keep = in_bitmap(bitmap, slot_of(ids, first))
            key, doc, first, count = key[keep], doc[keep], first[keep], count[keep]
            begin, size = offsets[doc] + first, count + LENGTH - 1
            h = span_hashes(data, begin, begin + size)
            flat, ends = _slices(data, begin, size)
            content = pa.Array.from_buffers(pa.binary(), len(key), [
                None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)),
                 pa.array(ids[keep]), pa.array(first.astype(np.int32)), content],
                ["key", "h", "doc_id", "first", "content"])
    return run


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    placed = keys[order]
    new = np.concatenate(([0], placed[1:] != placed[:-1]))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def equal_strings(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a block and the group of each place in it: suffixes of one group start alike.

    ``symbols`` has bytes plus one, and zeros where an extract ends; groups share ``length`` symbols.
    """
    n = len(symbols)
    packed = np.zeros(n, np.int64)
    depth = 7
    wide = np.append(symbols.astype(np.int64), np.zeros(depth, np.int64))
    for k in range(depth):
        packed = (packed << 9) | wide[k:k + n]
    order, rank = _ranks(packed)
    known, level = 1, symbols
    while depth < length:
        known, level = depth, rank
        ahead = np.append(rank[depth:], np.full(min(depth, n), -1)) + 1
        order, rank = _ranks((rank << 32) | ahead[:n])
        depth *= 2
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n)
    place[n] = 0
    # boundaries: reached[j] means that suffixes j - 1 and j share fewer than ``length`` symbols;
    # those that share fewer than ``known`` are told by the ranks of that depth
    head = level[order]
    reached = np.append(True, head[1:] != head[:-1])
    waiting = np.flatnonzero(~reached)
    back = place[order + 1]
    low = np.minimum(back[waiting - 1], back[waiting])
    high = np.maximum(back[waiting - 1], back[waiting])
    gone = 0  # of those waiting, reached since
    for _ in range(known, length):
        passed = np.cumsum(reached, dtype=np.int32)
        hit = passed[high] > passed[low]
        now = np.count_nonzero(hit)
        if now == gone:
            break  # no boundary of this length, so none of a greater one
        reached[waiting[hit]] = True
        gone = now
        if 8 * gone > len(waiting):
            waiting, low, high, gone = waiting[~hit], low[~hit], high[~hit], 0
    return order, np.cumsum(reached)


def _block(table: pa.Table) -> pa.Table:
    """Runs of string starts of a block's extracts that are not the first of their group."""
    column = table.column("content").combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    rows = len(column)
    size = np.diff(ends)
    symbols = np.zeros(len(data) + rows, np.uint16)
    at = np.arange(len(data)) + np.repeat(np.arange(rows), size)
    symbols[at] = data.astype(np.uint16) + 1
    order, group = equal_strings(symbols, LENGTH)
    begin = ends[:-1] + np.arange(rows)
    owner = np.repeat(np.arange(rows), size + 1)
    count = table.column("count").to_numpy()
    inside = np.arange(len(symbols)) - begin[owner] < count[owner]
    chosen = inside[order]
    order, group = order[chosen], group[chosen]
    doc = table.column("doc_id").to_numpy()[owner[order]]
    first = table.column("first").to_numpy().astype(np.int64)
    start = first[owner[order]] + order - begin[owner[order]]
    by = np.lexsort((start, doc, group))
    first = np.append(True, group[by][1:] != group[by][:-1])
    doc, start = doc[by][~first], start[by][~first]
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    lead = np.flatnonzero(new)
    tail = np.append(lead[1:], len(doc)) - 1
    return pa.table({"doc_id": pa.array(doc[lead], pa.int64()),
                     "low": pa.array(start[lead], pa.int64()),
                     "high": pa.array(start[tail] if len(lead) else start[:0], pa.int64())})


RUNS = "doc_id long, low long, high long"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the extracts by its content's hashes."""
    for batch in batches:
        for row in batch.to_pylist():
            data = np.frombuffer(row["content"], np.uint8)
            grid = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
            ends = np.arange(len(grid) + 1) * LENGTH
            flat = grid.reshape(-1)
            n = len(grid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_content(flat, ends, 40).view(np.int64)),
                 pa.array(_content(flat, ends, 50).view(np.int64)),
                 pa.array(np.full(n, row["doc_id"])), pa.array(row["first"] + np.arange(n))],
                ["s1", "s2", "doc_id", "start"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, low, high): runs of starts of strings that also start earlier; runs may overlap.

    Earlier is a smaller doc_id, or the same one and a smaller start. Extracts are told to be equal
    by their gram's and their content's 64-bit hashes together. Rows with a null doc_id are left out.
    """
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    keys = source.mapInArrow(_keys, "key long").groupBy("key").count().where("count > 1")
    bitmap = bitmap_of(keys.select("key", F.lit(0).alias("part")), "key", "part")
    found = materialize(source.mapInArrow(
        _shared(bitmap), "key long, h long, doc_id long, first int, count int"), "extracts")
    same = ["key", "h"]
    firsts = materialize(found.groupBy(*same).agg(
        F.min(F.struct("doc_id", "first")).alias("r"), F.max("count").alias("count"),
        F.count("*").alias("copies")), "firsts")
    later = found.join(firsts.where("copies > 1").select(*same, "r"), same).where(
        F.struct("doc_id", "first") > F.col("r")).select(
        "doc_id", F.col("first").cast("long").alias("low"),
        (F.col("first") + F.col("count") - 1).cast("long").alias("high"))
    # one extract of each content, under grams that have several; their bytes from another pass
    several = firsts.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.col("count") + LENGTH).alias("bytes")).where("n > 1")
    several = materialize(several, "grams")
    total = several.where(F.col("n") <= BUSY).agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    chosen = materialize(firsts.join(several, "key").select(
        *same, "r.doc_id", "r.first", "count", "n"), "chosen")
    content = source.mapInArrow(
        _contents(bitmap_of(chosen.select("doc_id", "first"), "doc_id", "first")),
        "key long, h long, doc_id long, first int, content binary")
    where = [*same, "doc_id", "first"]
    chosen = materialize(content.join(chosen, where).dropDuplicates(where), "contents")
    inside = chosen.where(F.col("n") <= BUSY).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.lit(blocks))).select(
        "block", "doc_id", "first", "count", "content").groupBy("block").applyInArrow(_block, RUNS)
    # strings of busy grams one by one: no task holds a gram's extracts together
    single = chosen.where(F.col("n") > BUSY).select("doc_id", "first", "content").mapInArrow(
        _strings, "s1 long, s2 long, doc_id long, start long")
    lowest = single.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "start")).alias("r"))
    busy = single.join(lowest, ["s1", "s2"]).where(F.struct("doc_id", "start") > F.col("r")).select(
        "doc_id", F.col("start").alias("low"), F.col("start").alias("high"))
    return later.union(inside).union(busy)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        change = np.zeros(len(data) + 1, np.int64)
        runs = batch.column("runs")
        own = np.repeat(np.arange(batch.num_rows), runs.value_lengths().fill_null(0).to_numpy())
        flat = runs.flatten()
        np.add.at(change, offsets[own] + flat.field("low").to_numpy(), 1)
        np.add.at(change, offsets[own] + flat.field("high").to_numpy() + LENGTH, -1)
        gone = np.cumsum(change)[:-1] > 0
        begin = gone & ~np.append(False, gone[:-1])
        inner = offsets[1:-1]
        inner = inner[inner < len(gone)]
        begin[inner] = gone[inner]  # a run never goes on from one text into the next

        def per_text(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

        removed = per_text(gone)
        kept = np.concatenate(([0], np.cumsum(np.diff(offsets) - removed)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed),
             pa.array(per_text(begin)),
             pa.Array.from_buffers(pa.large_binary(), batch.num_rows,
                                   [None, pa.py_buffer(kept), pa.py_buffer(data[~gone])]
                                   ).cast(pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every document.

    Removed is each byte covered by a string of ``LENGTH`` bytes that also starts earlier in the
    input; n_spans counts maximal removed runs. A null text is empty; a null doc_id, and texts
    shorter than ``LENGTH`` bytes, lose nothing. Repeated rows of one doc_id and text are each cut as
    that document. Other columns are ignored.
    """
    runs = repeated_runs(docs).groupBy("doc_id").agg(
        F.collect_list(F.struct("low", "high")).alias("runs"))
    source = docs.select(F.col("doc_id").cast("long"), "text").join(runs, "doc_id", "left")
    return source.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                      "kept binary")
