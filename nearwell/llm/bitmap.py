"""A bitmap of fixed size over keys, for passing over rows that nothing asks for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def slot_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The bit of each (id, part)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(1_000_003)
        x = (x + parts.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(64 - BITS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = slot_of(batch.column("id").to_numpy(), batch.column("part").to_numpy())
        bits = np.uint64(1) << (slots & np.uint64(63))
        yield pa.RecordBatch.from_arrays(
            [pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))],
            ["word", "bits"])


def bitmap_of(keys: DataFrame, id_name: str, part_name: str) -> np.ndarray:
    """2^BITS bits, set for every key; gathered from an aggregate of at most 2^(BITS - 6) rows.

    Keys that fall on one bit let rows through that nothing asks for, never the other way round.
    """
    rows = keys.select(F.col(id_name).cast("long").alias("id"),
                       F.col(part_name).cast("long").alias("part")).mapInArrow(
        _words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = rows.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    word = (slots >> np.uint64(6)).astype(np.int64)
    return ((bitmap[word] >> (slots & np.uint64(63))) & np.uint64(1)) > 0
