"""Packing of tokenised documents into sequences: best fit, then swaps between underfull bins.

Documents are tokenised where they are read. Pieces are dealt by a hash into groups of a fixed
expected size, and each group is packed by itself, so a group costs at most a last underfull
sequence or so however large the corpus is. In a group, pieces go by decreasing length into the
fullest sequence that still has room; then the emptiest sequences give documents away, by moves,
one-for-one and two-for-one exchanges, each of which raises the sum of squared fills, until
sequences become empty or nothing improves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell.llm.hashing import chunks
from nearwell.llm.tokens import encoder
from nearwell.session import materialize

CAPACITY = 2048
GROUP = 8192
END_ID = 0
#: Exchanges tried per emptied sequence, and how many of the emptiest sequences are tried.
ROUNDS = 4
DONORS = 256


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in chunks(batches):
            ids, bounds = own.encode(batch.column("text"))
            bounds = bounds + np.arange(len(bounds))  # every document ends in END_ID
            closed = np.full(bounds[-1], END_ID, np.int32)
            mask = np.ones(len(closed), bool)
            mask[bounds[1:] - 1] = False
            closed[mask] = ids
            length = np.diff(bounds)
            count = -(-length // capacity)
            row = np.repeat(np.arange(batch.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            # the first piece takes what is left over, all others are full
            first = (length - (count - 1) * capacity)[row]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            size = np.where(piece == 0, first, capacity)
            begin = bounds[row] + start
            raw = closed.astype("<u4")
            crc = np.fromiter((zlib.crc32(raw[b:b + n]) for b, n in zip(begin, size)), np.int64,
                              len(row))
            columns = {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece,
                       "start": start, "length": size, "ids_crc32": crc}
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(
                    np.append(begin, bounds[-1]).astype(np.int32), closed)
            yield pa.RecordBatch.from_pydict(
                columns | {"piece": pa.array(piece, pa.int32())})
    return run


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
             keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document's ids, closed by 0.

    Only documents longer than ``capacity`` are cut, into full pieces after a first one that may be
    shorter. A null or empty text is one piece of the closing id alone. Repeated rows give pieces
    each; other columns are ignored. ids_crc32 is over the ids as little-endian unsigned 32-bit.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pieces(tokenizer_path, capacity, keep_ids),
        schema + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length: longest first, into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin has room r
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Swap-based local search over the underfull bins; returns the new bin of each length.

    The emptiest bins give: a document moves, replaces a smaller one, or two replace one that is
    smaller than both together, wherever this raises the sum of squared fills most.
    """
    bins = bins.copy()
    fill = np.bincount(bins, lengths).astype(np.int64)
    items = np.flatnonzero(fill[bins] < capacity)
    donors = np.argsort(fill, kind="stable")
    donors = donors[fill[donors] < capacity][:DONORS]
    for donor in donors.tolist():
        for _ in range(ROUNDS * 4):
            own = np.flatnonzero(bins[items] == donor)
            if not len(own):
                break
            own = items[own]
            others = items[bins[items] != donor]
            best = (0, None)
            open_bins = np.flatnonzero((fill < capacity) & (fill > 0))
            open_bins = open_bins[open_bins != donor]
            gives = [(int(lengths[i]), (i,)) for i in own]
            if len(own) <= 16:
                gives += [(int(lengths[i] + lengths[j]), (i, j))
                          for k, i in enumerate(own) for j in own[:k]]
            for size, who in gives:
                if len(who) == 1 and len(open_bins):
                    to = fill[open_bins]
                    gain = np.where(to + size <= capacity, 2 * size * (to + size - fill[donor]), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (int(gain[k]), (who, None, int(open_bins[k])))
                if len(others):
                    more = size - lengths[others]
                    to = fill[bins[others]]
                    gain = np.where((more > 0) & (to + more <= capacity),
                                    2 * more * (to + more - fill[donor]), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (int(gain[k]), (who, int(others[k]), int(bins[others[k]])))
            if best[1] is None:
                break
            who, back, target = best[1]
            moved = int(lengths[list(who)].sum())
            bins[list(who)] = target
            if back is not None:
                bins[back] = donor
                moved -= int(lengths[back])
            fill[target] += moved
            fill[donor] -= moved
    return bins


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True],
                                ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = improve(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(rows), np.int64)
        offset[order] = ends - lengths[order] - base
        return rows.drop(columns="group").assign(sequence_id=(int(key[0]) << 32) + bins,
                                                 offset=offset)
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces, with all their columns, and sequence_id and offset.

    ``pieces`` has doc_id, piece and length (1 to ``capacity``), and no columns named ``group``,
    ``sequence_id`` or ``offset``; it is counted first, so pass a written table. Sequences hold no
    gaps. No pieces give no rows; repeated rows are packed each.
    """
    groups = max(1, -(-pieces.count() // group))
    salt = F.xxhash64("doc_id", "piece", "length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.withColumn("group", F.pmod(salt, F.lit(groups))).groupBy("group").applyInPandas(
        _pack(capacity), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces and their places, without the ids themselves."""
    return pack(materialize(tokenise(docs, tokenizer_path, capacity), "pieces"), capacity)
