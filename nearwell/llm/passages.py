"""Near-duplicate passages by compact windows.

For one hash function, the Cartesian tree over the min-hashes of a document's five-word shingles
groups its passages: every passage whose smallest hash stands at position c lies in one compact
window (a, c, b), and a document of n shingles has about 2n / t windows that are t or more wide.
Passages of two documents can only share a min-hash where windows with the same hash do, so windows
are joined by hash, and what two of them have in common, aligned at c, is an interval. Where intervals
of enough hash functions overlap on one alignment stands a candidate, and the shingles themselves
then decide.

A group of windows with one hash is never paired up: each window meets the first window of its group
only, and those of the subgroups that also agree on the 25 words to the right or left of c, or in how
far the window reaches, so that a widespread line doesn't hide the passages around it.

Where that first window is a fragment, it would hide whole copies in later documents. So windows of
the first hash carry nine digests of 45 words around c, from 40 words before it to 40 after it. Any
run of 50 words around c holds one of them, and reaches 25 words to the right or left of c. Where a
window of such a subgroup shares no digest with its first one, the subgroup is grouped once more, by
digest: the first window of such a group has those 45 words too, which already is a passage of the
similarity asked for.

An edited passage has no such 45 words. So where no passage found so far covers what lies around a root
of the first two hashes, that root meets every earlier one of its group that stands in other words, by
the shingles around both: one row for each wording of 45 shingles on either side (a copy of the same wording
meets it as above), in tasks of two parts of a group, so that no group has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearwell.llm.bitmap import bitmap_of, in_bitmap, slot_of
from nearwell.llm.hashing import CACHED_BYTES, SHINGLE_WORDS, Words, chunks, content_hashes, mix, shingles
from nearwell.session import discard, materialize

MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 4
VOTES = 2
BLOCK = 256
SLACK = 8
CONTEXT = (5, 10, 15, 20)
# Digests of 2 * len(CONTEXT) + 1 shingles, each five words after the other: 45 words around a root.
EXACT = HASHES
ROUNDS = 32
# Shingles on either side of a root that tell two wordings apart, hashes whose roots all meet, shingles
# from one block of them to the next, wordings of a group in one part, and postings looked at at once.
AROUND = 45
MEETING = 2
STEP = 64
PART = 8192
POSTINGS = 1 << 21
# Words of a sketch (one bit for each of these shingles, of 64 in a word), wordings of a group whose
# sketches meet in one task, and pairs of them tested at once.
SKETCH = 8
SKETCHES = 32768
PAIRS = 1 << 18
# Among the blocks of a document, itself.
WHOLE = -1


def _sliding(values: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every run of ``size`` values, from runs of doubled length."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = op(values[:-step], values[step:])
        done += step
    return values


def _nearest(vals: np.ndarray, step: int, beyond: np.ufunc) -> np.ndarray:
    """For each value but the outer two zeros, the next one that way that is not ``beyond`` it.

    All steps at once, each over what lies between; what takes more rounds is finished one by one,
    in an order in which it passes over finished ones.
    """
    near = np.arange(len(vals)) + step
    todo = np.flatnonzero(vals)
    for _ in range(ROUNDS):
        todo = todo[beyond(vals[near[todo]], vals[todo])]
        if not len(todo):
            return near
        near[todo] = near[near[todo]]
    for i in todo[::-step].tolist():
        j = near[i]
        while beyond(vals[j], vals[i]):
            j = near[j]
        near[i] = j
    return near


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, b) of the compact windows at least ``width`` wide; zeros in ``values`` end passages.

    A position roots such a window exactly if it holds the minimum of some run of ``width`` values,
    and the nearest smaller values of a root are roots too, so the tree is built over roots alone.
    Every zero is a root.
    """
    if len(values) < width:
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(width - 1, np.uint64)
    low = np.concatenate((edge, _sliding(values, width, np.minimum), edge))
    roots = np.flatnonzero(values == _sliding(low, width, np.maximum))
    at = np.concatenate(([-1], roots, [len(values)]))
    vals = np.zeros(len(at), np.uint64)
    vals[1:-1] = values[roots]
    after = at[_nearest(vals, 1, np.greater_equal)[1:-1]]
    before = at[_nearest(vals, -1, np.greater)[1:-1]]
    real = vals[1:-1] > 0
    a, c, b = before[real] + 1, roots[real], after[real] - 1
    wide = b - a + 1 >= width
    return a[wide], c[wide], b[wide]


def _digests(flat: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Array:
    """32-bit digests of the 45-word contexts of each root ``c`` that its window has room for.

    The first has ``max(0, 8 - right // 5)`` shingles before the root, the next ones each one more.
    """
    n = 2 * len(CONTEXT)
    first = np.maximum(0, n - right // SHINGLE_WORDS)
    count = np.maximum(0, np.minimum(n, left // SHINGLE_WORDS) - first + 1)
    row = np.repeat(np.arange(len(c)), count)
    before = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    total = before.astype(np.uint64)
    start = c[row] - before * SHINGLE_WORDS
    with np.errstate(over="ignore"):
        for step in range(n + 1):
            total = total * np.uint64(0x9E3779B97F4A7C15) + flat[start + step * SHINGLE_WORDS]
    digests = (mix(total) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    ends = np.concatenate(([0], np.cumsum(count)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(digests))


def _sketches(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, told: np.ndarray) -> pa.Array:
    """One bit for each shingle from lo to hi, by its first bits; null where not ``told``.

    Shingles of two windows that agree in 32 bits have the same bit.
    """
    rows = np.flatnonzero(told)
    bits = np.zeros((len(rows), SKETCH * 8), np.uint8)
    offset = np.arange(2 * AROUND + 1)
    slot = (flat >> np.uint64(64 - (SKETCH * 64).bit_length() + 1)).astype(np.uint16)
    for cut in range(0, len(rows), 4096):
        own = rows[cut:cut + 4096]
        at = lo[own, None] + offset
        at = np.minimum(at, hi[own, None])
        wide = np.zeros((len(own), SKETCH * 64), bool)
        np.put_along_axis(wide, slot[at].astype(np.int64), True, 1)
        bits[cut:cut + 4096] = np.packbits(wide, axis=1)
    ends = np.concatenate(([0], np.cumsum(told) * (SKETCH * 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(told), [
        pa.array(told).buffers()[1], pa.py_buffer(ends), pa.py_buffer(bits)])


def _inside_repeats(doc: np.ndarray, c: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a root stands between two equal ones at the same distance, of at most a shingle's words.

    Such words only repeat themselves; the first and the last root of their run stand for the others.
    """
    step = np.diff(c)
    near = (step <= SHINGLE_WORDS) & (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    inside = np.zeros(len(c), bool)
    inside[1:-1] = near[1:] & near[:-1] & (step[1:] == step[:-1])
    return inside


def _windows(width: int, shared: np.ndarray | None = None, firsts: np.ndarray | None = None,
             several: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CACHED_BYTES):
            words = Words(batch.column("text"))
            hashes, bounds = shingles(words)
            count = np.diff(bounds)
            docs = np.flatnonzero(count >= max(width, 1))
            if not len(docs):
                continue
            # documents side by side, each closed by a zero
            size = count[docs] + 1
            first = np.cumsum(size) - size
            own = np.repeat(np.arange(len(docs)), size)
            local = np.arange(size.sum()) - first[own]
            last = local == count[docs][own]
            flat = np.zeros(len(own), np.uint64)
            flat[~last] = hashes[(bounds[docs][own] + local)[~last]]
            if shared is not None:
                wording = content_hashes(flat)
            for k in range(HASHES):
                values = np.where(last, np.uint64(0), mix(flat, 50 + k) | np.uint64(1))
                a, c, b = compact_windows(values, width)
                key = mix(flat[c], 90 + k).view(np.int64)
                if shared is not None:
                    wanted = in_bitmap(shared, slot_of(key, np.zeros(len(key), np.int64)))
                    a, c, b, key = a[wanted], c[wanted], b[wanted], key[wanted]
                ids = batch.column("doc_id").take(pa.array(docs[own[c]]))
                out = {"key": pa.array(key), "doc_id": ids}
                if shared is not None:
                    out["early"] = pa.array(in_bitmap(firsts, slot_of(key, ids.to_numpy())))
                    sides = []
                    for sign, room in ((1, b - c), (-1, c - a)):
                        total = np.zeros(len(c), np.uint64)
                        have = room >= CONTEXT[-1]
                        with np.errstate(over="ignore"):
                            for step in CONTEXT:
                                near = flat[np.where(have, c + sign * step, 0)]
                                total = total * np.uint64(0x9E3779B97F4A7C15) + near
                        sides.append(pa.array((mix(total) >> np.uint64(32)).astype(np.uint32)
                                              .view(np.int32), mask=~have))
                    if k < MEETING:
                        lo, hi = np.maximum(a, c - AROUND), np.minimum(b, c + AROUND)
                        told = wording(lo, hi + 1) + (c - lo).astype(np.uint64)
                        pair = _inside_repeats(own[c], c, key) | ~in_bitmap(
                            several, slot_of(key, np.zeros(len(key), np.int64)))
                        out["wording"] = pa.array(told.view(np.int64), mask=pair)
                        out["sketch"] = _sketches(flat, lo, hi, ~pair)
                    else:
                        out["wording"] = pa.nulls(len(c), pa.int64())
                        out["sketch"] = pa.nulls(len(c), pa.binary())
                    out |= {"at": pa.array(local[c], pa.int32()),
                            "left": pa.array(c - a, pa.int32()),
                            "right": pa.array(b - c, pa.int32()),
                            "after": sides[0], "before": sides[1],
                            "hash": pa.array(np.full(len(c), k, np.int32)),
                            "digests": _digests(flat, c, c - a, b - c) if k == 0
                            else pa.nulls(len(c), pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(out)
    return run


ROWS = ("key long, doc_id long, early boolean, wording long, sketch binary, at int, left int, right int, after int, "
        "before int, hash int, digests array<int>")


def _blocks(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CACHED_BYTES):
            ids = batch.column("doc_id").to_numpy()
            batch = batch.filter(pa.array(in_bitmap(bitmap, slot_of(ids, np.full(len(ids), WHOLE)))))
            if not batch.num_rows:
                continue
            hashes, bounds = shingles(Words(batch.column("text")))
            hashes = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            count = -(-np.diff(bounds) // BLOCK)
            row = np.repeat(np.arange(batch.num_rows), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ids = batch.column("doc_id").to_numpy()[row]
            wanted = in_bitmap(bitmap, slot_of(ids, block))
            row, block, ids = row[wanted], block[wanted], ids[wanted]
            begin = bounds[row] + block * BLOCK
            size = np.minimum(BLOCK, bounds[row + 1] - begin)
            ends = np.concatenate(([0], np.cumsum(size)))
            take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(block, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[take]))],
                ["doc_id", "block", "hashes"])
    return run


def matching_spans(mine: np.ndarray, other: np.ndarray, width: int, similarity: float
                   ) -> list[tuple[int, int, int, float]]:
    """(start, end, start in other, similarity) of the stretches of ``mine`` that ``other`` has too.

    From each run of shingles found in ``other``, the farthest run up to which the similarity holds:
    gaps count on both sides. A stretch of less than ``width`` shingles takes neighbours on both
    sides up to ``width``. The shingle sets of the aligned stretches decide.
    """
    if len(mine) >= max(width, 1):
        # one whole copy
        for p in np.flatnonzero(other == mine[0])[:1].tolist():
            if np.array_equal(other[p:p + len(mine)], mine):
                return [(0, len(mine), p, 1.0)]
    order = np.argsort(other, kind="stable")
    at = np.searchsorted(other[order], mine)
    at[at == len(other)] = 0
    where = order[at] if len(other) else np.zeros(len(mine), np.int64)
    found = other[where] == mine if len(other) else np.zeros(len(mine), bool)
    if not found.any() or len(mine) < width:
        return []
    # shingles found and different ones not found, up to each
    new = np.zeros(len(mine), bool)
    new[np.unique(mine, return_index=True)[1]] = True
    have, lack = (np.concatenate(([0], np.cumsum(x))) for x in (found, new & ~found))
    # at most all found ones are shared, and those not found are in the union: is that enough anywhere?
    upto = have - similarity * (have + lack)
    if width > 0 and (upto[width:] - np.minimum.accumulate(upto[:len(upto) - width])).max() < -1e-6:
        return []
    have, lack = have.tolist(), lack.tolist()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], found.view(np.int8), [0])))).reshape(-1, 2)
    starts, ends = edges[:, 0], edges[:, 1]
    gap = starts[1:] - ends[:-1]
    theirs = where[starts[1:]] - where[ends[:-1] - 1] - 1
    theirs = np.where((theirs < 0) | (theirs > width), gap, theirs)
    gain = (1 - similarity) * (ends - starts)
    upto = np.cumsum(gain) - np.append(0, np.cumsum(similarity * (gap + theirs)))

    def best(i: int, j: int) -> tuple[int, int, int, float]:
        lo, hi = int(starts[i]), int(ends[j])
        if i == j and hi - lo >= width and (np.diff(where[lo:hi]) == 1).all():
            return lo, hi, int(where[lo]), 1.0
        pad = max(0, width - (hi - lo))
        top = (lo, hi, 0, 0.0)
        shift = None
        for right in {min(pad, len(mine) - hi), max(0, pad - lo)}:
            left = pad - right
            both, ours = have[hi + right] - have[lo - left], lack[hi + right] - lack[lo - left]
            if both < similarity * (both + ours) - 1e-9:
                continue
            if shift is None:
                shift = int(np.median((np.arange(lo, hi) - where[lo:hi])[found[lo:hi]]))
            ours = np.unique(mine[lo - left:hi + right])
            for r0, r1 in dict.fromkeys(((int(where[lo]), int(where[hi - 1]) + 1),
                                         (lo - shift, hi - shift))):
                r0 = max(0, r0 - left)
                them = np.unique(other[r0:max(r0, r1 + right)])
                both = len(np.intersect1d(ours, them, assume_unique=True))
                near = both / (len(ours) + len(them) - both)
                if near > top[3]:
                    top = (lo - left, hi + right, r0, near)
        return top

    out = []
    last = -1
    for i in range(len(starts)):
        for j in np.flatnonzero(upto[i:] - upto[i] + gain[i] >= -1e-9)[::-1] + i:
            if j <= last:
                break
            span = best(i, j)
            if span[3] >= similarity:
                out.append(span)
                last = j
                break
    return out


def _verify(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            parts = batch.column("parts")
            ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            flat = parts.flatten()
            side, begin = (flat.field(c).to_numpy() for c in ("side", "begin"))
            lists = flat.field("hashes")
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            docs, refs, los, his, ref_los, ref_his = (batch.column(c).to_numpy() for c in (
                "doc_id", "ref_doc_id", "lo", "hi", "ref_lo", "ref_hi"))

            def cut(which: int, own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, int]:
                """Shingles lo to hi of one side, and where they begin."""
                own = own[side[own] == which]
                if not len(own):
                    return values[:0], lo
                own = own[np.argsort(begin[own])]
                base = int(begin[own[0]])
                lo = max(lo, base)
                whole = values[at[own[0]]:at[own[0] + 1]] if len(own) == 1 else np.concatenate(
                    [values[at[i]:at[i + 1]] for i in own])
                return whole[lo - base:max(hi + 1 - base, 0)], lo

            for r in range(batch.num_rows):
                own = np.arange(ends[r], ends[r + 1])
                mine, lo = cut(0, own, int(los[r]), int(his[r]))
                other, ref_lo = cut(1, own, int(ref_los[r]), int(ref_his[r]))
                for s, e, o, near in matching_spans(mine, other, width, similarity):
                    out.append((int(docs[r]), lo + s, lo + e + SHINGLE_WORDS - 1, int(refs[r]),
                                ref_lo + o, near))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.int64(), pa.float64()))],
                ["doc_id", "start", "end", "ref_doc_id", "ref_start", "similarity"])
    return run


PASSAGES = ("doc_id long, start long, end long, ref_doc_id long, ref_start long, "
            "similarity double")


def _first(own: DataFrame, by: list[str]) -> DataFrame:
    """The first window of each group that more than one document has."""
    return own.groupBy(*by).agg(
        F.min(F.struct("doc_id", "at", "left", "right", "digests")).alias("r"),
        F.max("doc_id").alias("high")).where("r.doc_id < high").drop("high")


def _reach(name: str):
    """How far two windows agree to reach, bounded by the context of the digests."""
    around = (2 * len(CONTEXT) + 1) * SHINGLE_WORDS
    return F.least(name, f"r.{name}", F.lit(around))


def _interval(width: int, near) -> tuple:
    """What a window and the first one ``r`` of its group have in common, and whether that is wide.

    With 45 words in common (``near``) the interval is as good as enough votes.
    """
    lo, hi = F.col("at") - F.least("left", "r.left"), F.col("at") + F.least("right", "r.right")
    return (F.col("r.doc_id").alias("ref_doc_id"),
            F.when(near, EXACT).otherwise(F.col("hash")).alias("hash_id"),
            (F.col("at") - F.col("r.at")).alias("shift"), lo.alias("lo"), hi.alias("hi"),
            ((F.col("doc_id") > F.col("r.doc_id")) & (hi - lo + 1 >= width)).alias("meets"))


def _hidden_copies(rows: DataFrame, by: list[str], hidden: DataFrame, keep) -> DataFrame:
    """Intervals around roots of the first hash whose 45 words an earlier document has, though the first
    document of their group has not.

    Only groups that agree on the words after (or before) the root can share a digest that reaches
    that far, and only those where some window shares none with the first are looked at: ``hidden``.
    """
    n = len(CONTEXT)
    before = F.greatest(F.lit(0), 2 * n - F.floor(F.col("right") / SHINGLE_WORDS)) + F.col("pos")
    near = rows.where(F.col("hash") == 0).join(hidden, by, "left_semi").select(
        "key", "doc_id", "at", "left", "right", F.posexplode("digests").alias("pos", "digest")).where(
        before <= n if by[-1] == "after" else before >= n)
    same = ["key", "digest"]
    first = keep(near.groupBy(*same).agg(
        F.min(F.struct("doc_id", "at", "left", "right")).alias("r"),
        F.max("doc_id").alias("high")).where("r.doc_id < high"), "digests")
    return near.join(first, same).where("doc_id > r.doc_id").select(
        "doc_id", F.col("r.doc_id").alias("ref_doc_id"), F.lit(EXACT).alias("hash"),
        (F.col("at") - F.col("r.at")).alias("shift"),
        (F.col("at") - _reach("left")).alias("lo"), (F.col("at") + _reach("right")).alias("hi")).distinct()


def _met(source: DataFrame, width: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, ref_doc_id, hash, shift, lo, hi): what windows share with the first one of their group
    and with the first ones of its subgroups; the windows; and the tables that the first one reads.

    A window that agrees with the first one of its group on what makes a subgroup has that one as
    the first of its subgroup too, so only the others are grouped again.
    """
    used: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, name))
        return used[-1]

    # the keys of more than one document, from the keys alone
    keys = source.mapInArrow(_windows(width), "key long, doc_id long").groupBy("key").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    keys = keep(keys.where("low < high").select("key", "low", (F.col("n") > 2).alias("several")), "keys")
    # most windows of unshared keys end in the second pass, and most that are no first ones are told;
    # the joins decide
    shared = bitmap_of(keys.withColumn("part", F.lit(0)), "key", "part")
    firsts = bitmap_of(keys, "key", "low")
    several = bitmap_of(keys.where("several").withColumn("part", F.lit(0)), "key", "part")
    rows = materialize(source.mapInArrow(_windows(width, shared, firsts, several), ROWS), "windows")
    keys = keys.drop("several")
    early = rows.where("early").drop("early", "hash", "wording", "sketch").join(
        keys.withColumnRenamed("low", "doc_id"), ["key", "doc_id"])
    first = keep(early.groupBy("key").agg(F.min(F.struct(
        "doc_id", "at", "left", "right", "after", "before", "digests")).alias("r")), "first")

    near = F.coalesce((F.col("hash") == 0) & F.arrays_overlap("digests", "r.digests"), F.lit(False))
    shown = ["doc_id", "ref_doc_id", F.col("hash_id").alias("hash"), "shift", "lo", "hi"]
    agrees = {"after": F.coalesce(F.col("after") == F.col("r.after"), F.col("after").isNull()),
              "before": F.coalesce(F.col("before") == F.col("r.before"), F.col("before").isNull()),
              "reach": (F.col("left") == F.col("r.left")) & (F.col("right") == F.col("r.right"))}
    alike = agrees["after"] & agrees["before"]
    met = rows.join(first, "key").select(
        "key", "doc_id", "at", "left", "right", "after", "before", "hash",
        F.when(~alike, F.col("digests")).alias("digests"), *_interval(width, near),
        *[c.alias(f"same_{side}") for side, c in agrees.items()])
    met = keep(met, "met")

    found = [met.where("meets").select(*shown)]
    rest = met.where("NOT same_reach").select("key", "doc_id", "at", "left", "right", "hash", "digests")
    by = ["key", "left", "right"]
    first = keep(_first(rest, by), "first-reach")
    found.append(rest.join(first, by).select("doc_id", *_interval(width, F.lit(False))).where("meets")
                 .select(*shown))
    for side in ("after", "before"):
        by = ["key", side]
        rest = met.where(~F.col(f"same_{side}")).select(
            "key", "doc_id", "at", "left", "right", side, "hash", "digests")
        first = keep(_first(rest, by), f"first-{side}")
        again = keep(rest.join(first, by).select(
            *by, "doc_id", "hash", *_interval(width, near)), f"met-{side}")
        found.append(again.where("meets").select(*shown))
        missed = (F.col("hash") == 0) & (F.col("hash_id") != EXACT) & F.col(side).isNotNull() & (
            F.col("doc_id") > F.col("ref_doc_id"))
        hidden = met.where(missed & F.col(f"same_{side}")).select(*by).union(
            again.where(missed).select(*by)).distinct()
        found.append(_hidden_copies(rows, by, keep(hidden, "hidden"), keep))
    return reduce(DataFrame.union, found), rows, used


def _bitmap(need: DataFrame) -> np.ndarray:
    """The blocks (doc, block) asked for, and their documents."""
    return bitmap_of(need.distinct().select("doc", F.explode(F.array("block", F.lit(WHOLE))).alias("block")),
                     "doc", "block")


def _around(bitmap: np.ndarray):
    """Blocks of STEP shingles with AROUND more on either side; -1 beyond a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CACHED_BYTES):
            ids = batch.column("doc_id").to_numpy()
            batch = batch.filter(pa.array(in_bitmap(bitmap, slot_of(ids, np.full(len(ids), WHOLE)))))
            if not batch.num_rows:
                continue
            hashes, bounds = shingles(Words(batch.column("text")))
            hashes = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            count = -(-np.diff(bounds) // STEP)
            row = np.repeat(np.arange(batch.num_rows), count)
            block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ids = batch.column("doc_id").to_numpy()[row]
            wanted = in_bitmap(bitmap, slot_of(ids, block))
            row, block, ids = row[wanted], block[wanted], ids[wanted]
            begin = bounds[row] + block * STEP
            at = begin[:, None] + np.arange(-AROUND, STEP + AROUND)
            there = (at >= bounds[row][:, None]) & (at < bounds[row + 1][:, None])
            values = np.where(there, np.append(hashes, np.int32(-1))[np.where(there, at, 0)], np.int32(-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(block, pa.int32()),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(len(row) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))],
                ["doc_id", "block", "hashes"])
    return run


def _pairs_of(doc: np.ndarray, part: np.ndarray, across: bool, asks: np.ndarray, covered: np.ndarray,
              values: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(later, earlier) rows of one group whose shingles may be alike enough, an uncovered one in both.

    ``values`` holds a row's shingles, -1 where there is none; ``covered`` those inside found passages,
    which are all taken for shared. ``across`` asks for pairs of different parts only.
    """
    row, at = np.nonzero(values != -1)
    flat = values[row, at]
    order = np.lexsort((row, flat))
    flat, row = flat[order], row[order]
    new = np.append(True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1]))
    flat, row = flat[new], row[new]
    mine, at = np.nonzero(asks[:, None] & ~covered & (values != -1))
    if not len(mine):
        return
    begin = np.searchsorted(flat, values[mine, at], "left")
    count = np.searchsorted(flat, values[mine, at], "right") - begin
    tails = np.append(np.flatnonzero(mine[1:] != mine[:-1]) + 1, len(mine))
    upto = np.cumsum(count)[tails - 1] + np.arange(1, len(tails) + 1) * len(doc)
    same = covered.sum(1)
    done = cut = 0
    while done < len(tails):
        # whole rows, of a bounded number of postings and counts unless one alone has more
        base = upto[done - 1] if done else 0
        done = max(done + 1, int(np.searchsorted(upto, base + POSTINGS, "right")))
        stop = int(tails[done - 1])
        n = count[cut:stop]
        y = row[np.arange(n.sum()) + np.repeat(begin[cut:stop] - np.cumsum(n) + n, n)]
        x, own = np.unique(mine[cut:stop], return_inverse=True)
        shared = np.bincount(np.repeat(own * len(doc), n) + y, minlength=len(x) * len(doc)).reshape(len(x), -1)
        ok = (shared > 0) & (shared + same[x, None] >= least) & (doc < doc[x, None])
        if across:
            ok &= part != part[x, None]
        later, y = np.nonzero(ok)
        yield x[later], y
        cut = stop


def _meet(width: int, similarity: float):
    least = int(np.ceil(similarity * width))

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, at, left, right, part, asks, key, p, q = (table.column(c).to_numpy() for c in (
            "doc_id", "at", "left", "right", "part", "asks", "key", "p", "q"))
        lists = table.column("hashes").combine_chunks()
        values = lists.flatten().to_numpy().reshape(len(doc), -1)
        offset = np.arange(-AROUND, AROUND + 1)
        far = (offset < -left[:, None]) | (offset > right[:, None])
        values = np.where(far, np.int32(-1), values)
        covered = np.zeros(values.shape, bool)
        spans = table.column("covered").combine_chunks()
        ends = spans.offsets.to_numpy()
        who = np.repeat(np.arange(len(doc)), np.diff(ends))
        spans = spans.flatten()
        for i, lo, hi in zip(who.tolist(), spans.field("start").to_numpy().tolist(),
                             spans.field("end").to_numpy().tolist()):
            a = lo - int(at[i]) + AROUND
            b = hi - SHINGLE_WORDS + 1 - int(at[i]) + AROUND
            covered[i, max(a, 0):max(b, 0)] = True
        covered &= values != -1
        edge = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        for a, b in zip(np.append(0, edge).tolist(), np.append(edge, len(doc)).tolist()):
            for x, y in _pairs_of(doc[a:b], part[a:b], p[a] != q[a], asks[a:b], covered[a:b],
                                  values[a:b], least):
                x, y = x + a, y + a
                reach = 2 * AROUND
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc[x]), "ref_doc_id": pa.array(doc[y]),
                    "lo": pa.array(at[x] - np.minimum(left[x], reach), pa.int32()),
                    "hi": pa.array(at[x] + np.minimum(right[x], reach), pa.int32()),
                    "ref_lo": pa.array(at[y] - np.minimum(left[y], reach), pa.int32()),
                    "ref_hi": pa.array(at[y] + np.minimum(right[y], reach), pa.int32())})

    return _by_group(("key", "p", "q"), groups)


SPANS = "doc_id long, ref_doc_id long, lo int, hi int, ref_lo int, ref_hi int"


def _alike(least: int):
    """The wordings of each group that may share enough with an earlier or a later one, by their sketches.

    Two windows share at most as many shingles as their sketches share bits, and those of the later one
    that fell on a bit already set; covered ones are all taken for shared. So no pair that shares enough
    is missed. What found passages cover of a wording stands in a row of its own before it.
    """
    names = ("key", "p", "q")

    def groups(table: pa.Table) -> pa.RecordBatch:
        doc, left, right, part, wording, touched, key, p, q = (table.column(c).to_numpy() for c in (
            "doc_id", "left", "right", "part", "wording", "touched", *names))
        edge = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        same, done = (table.column(c).to_numpy() for c in ("same", "done"))
        own = np.flatnonzero(~touched)
        tells = np.flatnonzero(touched)
        # the wording that a row of coverage tells of follows it
        to = np.searchsorted(own, tells)
        group = np.cumsum(edge) - 1
        cover, over = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        there = to < len(own)
        tells, to = tells[there], to[there]
        fits = (group[own[to]] == group[tells]) & (wording[own[to]] == wording[tells])
        cover[to[fits]], over[to[fits]] = same[tells[fits]], done[tells[fits]]
        group, doc, part = group[own], doc[own], part[own]
        order = np.lexsort((doc, group))
        group, doc, part, cover, over = (x[order] for x in (group, doc, part, cover, over))
        sketch = table.column("sketch").combine_chunks().take(pa.array(own[order]))
        bits = np.frombuffer(sketch.buffers()[2], np.uint64, len(own) * SKETCH,
                             int(np.frombuffer(sketch.buffers()[1], np.int32, 1, sketch.offset * 4)[0]))
        bits = np.ascontiguousarray(bits.reshape(len(own), SKETCH).T)
        count = (np.minimum(left, AROUND) + np.minimum(right, AROUND) + 1)[own[order]].astype(np.int64)
        # what the sketches must share
        least_bits = least - cover - (count - np.bitwise_count(bits).sum(0, dtype=np.int64))
        begin = np.searchsorted(group, group, "left")
        asks = ~over & ((np.bincount(group)[group] > 2) | (table.column("parts").to_numpy()[own[order]] > 1))
        n = np.where(asks, np.arange(len(doc)) - begin, 0)
        upto = np.cumsum(n)
        alike = np.zeros(len(doc), bool)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            size = n[at:stop]
            x = np.repeat(np.arange(at, stop), size)
            y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + begin[x]
            both = np.zeros(len(x), np.uint16)
            for word in bits:
                both += np.bitwise_count(word[x] & word[y])
            ok = (both >= least_bits[x]) & (doc[y] < doc[x])
            ok &= (p[own[order[x]]] == q[own[order[x]]]) | (part[x] != part[y])
            alike[x[ok]] = alike[y[ok]] = True
            at = stop
        pick = np.flatnonzero(alike)
        back = pa.array(own[order[pick]])
        out = {c: table.column(c).combine_chunks().take(back) for c in ("key", "wording", "doc_id", "at", "left", "right")}
        return pa.RecordBatch.from_pydict(out | {"asks": pa.array(asks[pick])})

    return _by_group(names, lambda table: iter((groups(table),)))


def _by_group(names: tuple[str, ...], groups):
    """Rows that come sorted by ``names``, given to ``groups`` in tables of whole groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            same = np.logical_and.reduce([c == c[-1] for c in cols])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            last = [kept[-1].column(c)[kept[-1].num_rows - 1].as_py() for c in names] if kept else None
            if cut or (last is not None and last != [int(c[0]) for c in cols]):
                yield from groups(pa.Table.from_batches(kept + [batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from groups(pa.Table.from_batches(kept))
    return run


WORDINGS = "key long, wording long, doc_id long, at int, left int, right int, asks boolean"


def _in_parts(own: DataFrame, size: int) -> DataFrame:
    """The rows with ``part`` of their group, and once for every pair of parts ``p``, ``q`` they are in.

    Groups of more than ``size`` wordings are few, at most one for so many rows.
    """
    heavy = materialize(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size).select(
        "key", F.ceil(F.col("n") / size).alias("parts")), "heavy")
    parts = F.coalesce("parts", F.lit(1)).cast("long")
    own = own.join(F.broadcast(heavy), "key", "left").withColumns(
        {"parts": parts, "part": F.pmod(F.xxhash64("wording"), parts)})
    return own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).withColumns(
        {"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other")


def _by_parts(own: DataFrame, *order: str) -> DataFrame:
    return own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                           "key", "p", "q").sortWithinPartitions("key", "p", "q", *order)


def _others(source: DataFrame, rows: DataFrame, found: DataFrame, width: int,
            similarity: float) -> DataFrame:
    """Spans around roots that ``found`` doesn't cover and earlier ones of the same hash in other words.

    Most roots of one hash have nothing else in common, so their sketches meet first, and only the
    shingles of what they leave are fetched.
    """
    least = int(np.ceil(similarity * width))
    own = materialize(rows.where("wording IS NOT NULL").groupBy("key", "wording").agg(
        F.min(F.struct("doc_id", "at", "left", "right", "sketch")).alias("w")).select("key", "wording", "w.*"),
        "wordings")
    discard(rows)
    lo = F.col("at") - F.least("left", F.lit(AROUND))
    hi = F.col("at") + F.least("right", F.lit(AROUND)) + SHINGLE_WORDS
    cover = found.select(F.col("doc_id").alias("of"), "start", "end").distinct()
    # shingles that lie in found passages, those in several counted as often
    inside = F.greatest(F.lit(0), F.least("end", hi) - F.greatest("start", lo) - SHINGLE_WORDS + 1)
    touched = materialize(own.drop("sketch").join(
        cover, (F.col("doc_id") == F.col("of")) & (F.col("start") < hi) & (F.col("end") > lo)).groupBy(
        "key", "wording").agg(
        F.collect_list(F.struct("start", "end")).alias("covered"), F.sum(inside).alias("same"),
        F.max((F.col("start") <= lo) & (F.col("end") >= hi)).alias("done")), "touched")
    missing = F.lit(None)
    sides = own.select("*", F.lit(0).cast("long").alias("same"), F.lit(False).alias("done"),
                       F.lit(False).alias("touched")).union(touched.select(
        "key", "wording", F.lit(0).cast("long"), F.lit(0), F.lit(0), F.lit(0), missing.cast("binary"), "same",
        "done", F.lit(True)))
    alike = _by_parts(_in_parts(sides, SKETCHES), "wording", F.desc("touched")).mapInArrow(_alike(least), WORDINGS)
    alike = materialize(alike.groupBy("key", "wording", "doc_id", "at", "left", "right").agg(
        F.max("asks").alias("asks")).withColumn("block", F.floor(F.col("at") / STEP).cast("int")), "alike")
    discard(own)
    bitmap = _bitmap(alike.select(F.col("doc_id").alias("doc"), "block"))
    blocks = source.mapInArrow(_around(bitmap), "doc_id long, block int, hashes array<int>")
    blocks = blocks.dropDuplicates(["doc_id", "block"])
    none = F.array().cast(dict(touched.dtypes)["covered"])
    own = _in_parts(alike.join(touched.select("key", "wording", "covered"), ["key", "wording"], "left"), PART).join(
        blocks, ["doc_id", "block"]).select(
        "key", "doc_id", "at", "left", "right", "asks", "part", F.coalesce("covered", none).alias("covered"),
        F.slice("hashes", F.col("at") % STEP + 1, 2 * AROUND + 1).alias("hashes"), "p", "q")
    return _by_parts(own).mapInArrow(_meet(width, similarity), SPANS).groupBy("doc_id", "ref_doc_id", "lo", "hi").agg(
        F.min("ref_lo").alias("ref_lo"), F.max("ref_hi").alias("ref_hi"))


def _verified(source: DataFrame, spans: DataFrame, width: int, similarity: float) -> DataFrame:
    """The passages of the spans, by the shingles of both sides."""
    def cut(side: int, doc: str, lo: str, hi: str):
        return F.transform(F.sequence(F.floor(F.col(lo) / BLOCK), F.floor(F.col(hi) / BLOCK)),
                           lambda b: F.struct(F.lit(side).alias("side"), F.col(doc).alias("doc"),
                                              b.cast("int").alias("block")))

    need = spans.select(*spans.columns, F.inline(F.concat(
        cut(0, "doc_id", "lo", "hi"), cut(1, "ref_doc_id", "ref_lo", "ref_hi"))))
    # shingles of the blocks asked for, from another pass over the texts: no text is shuffled
    bitmap = _bitmap(need.select("doc", "block"))
    blocks = source.mapInArrow(_blocks(bitmap), "doc_id long, block int, hashes array<int>")
    blocks = blocks.select(F.col("doc_id").alias("doc"), "block", "hashes").dropDuplicates(
        ["doc", "block"])
    # of each block, only what its span needs
    first, last = F.when(F.col("side") == 0, F.col("lo")).otherwise(F.col("ref_lo")), F.when(
        F.col("side") == 0, F.col("hi")).otherwise(F.col("ref_hi"))
    begin = F.greatest(F.col("block") * BLOCK, first.cast("int"))
    size = F.least((F.col("block") + 1) * BLOCK, last.cast("int") + 1) - begin
    filled = need.join(blocks, ["doc", "block"]).select(
        *spans.columns, F.struct("side", begin.alias("begin"), F.slice(
            "hashes", begin - F.col("block") * BLOCK + 1, F.greatest(size, F.lit(0))).alias("hashes")).alias("part")).groupBy(
        *spans.columns).agg(F.collect_list("part").alias("parts"))
    return filled.mapInArrow(_verify(width, similarity), PASSAGES).distinct()


def find_passages(docs: DataFrame, min_words: int = MIN_WORDS,
                  similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, end, ref_doc_id, ref_start, similarity) of passages that stand earlier too.

    A passage is a run of at least ``min_words`` words (from word ``start`` up to ``end``) whose set
    of five-word shingles has a Jaccard similarity of at least ``similarity`` with a run of a
    document of smaller doc_id; that document's first word there is ``ref_start``. A passage may be
    found against more than one document. Every run of ``min_words`` words (50 or more, at a similarity of 0.8 or less) that stands in an
    earlier document word for word meets a passage, whatever fragments of it others hold. An edited
    passage that no passage found covers is compared with every earlier wording that shares the smallest
    of its shingles under one of two hashes, which one at the threshold does with a probability of 0.96,
    whatever fragments the first documents hold. Repeats within one document are
    not passages. Null, empty and short texts have none; rows with a null doc_id are
    left out, and rows that share a doc_id are never compared with each other: of different texts under
    one doc_id, one stands for the others as a reference. Other columns are ignored.
    """
    width = min_words - SHINGLE_WORDS + 1
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    found, rows, used = _met(source, width)
    lane = F.floor(F.col("shift") / SLACK).alias("lane")
    key = ["doc_id", "ref_doc_id", "lane"]
    # first each hash function's own union of intervals, then where enough of them overlap
    by_hash = Window.partitionBy(*key, "hash").orderBy("lo", "hi").rowsBetween(
        Window.unboundedPreceding, -1)
    runs = found.select("*", lane).withColumn("open", F.max("hi").over(by_hash))
    runs = runs.withColumn("run", F.sum(F.when(F.col("lo") <= F.col("open"), 0).otherwise(1)).over(
        Window.partitionBy(*key, "hash").orderBy("lo", "hi")))
    runs = runs.groupBy(*key, "hash", "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("shift").alias("low"),
        F.max("shift").alias("high"))
    weight = F.when(F.col("hash") == EXACT, VOTES).otherwise(1)
    step = F.inline(F.array(F.struct(F.col("lo").alias("at"), weight.alias("up")),
                            F.struct((F.col("hi") + 1).alias("at"), (-weight).alias("up"))))
    line = Window.partitionBy(*key).orderBy("at", "up")
    marks = runs.select(*key, "low", "high", step)
    marks = marks.withColumns({
        "votes": F.sum("up").over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "until": F.lead("at").over(line),
        "low": F.min("low").over(Window.partitionBy(*key)),
        "high": F.max("high").over(Window.partitionBy(*key))})
    marks = marks.where((F.col("votes") >= VOTES) & (F.col("until") > F.col("at"))).select(
        *key, "low", "high", F.col("at").alias("lo"), (F.col("until") - 1).alias("hi"))
    joined = Window.partitionBy(*key).orderBy("lo")
    marks = marks.withColumn("new", F.when(
        F.col("lo") <= F.lag("hi").over(joined) + 1, 0).otherwise(1))
    marks = marks.withColumn("run", F.sum("new").over(
        joined.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marks.groupBy(*key, "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("low").alias("low"),
        F.max("high").alias("high")).where(F.col("hi") - F.col("lo") + 1 >= width)
    spans = materialize(spans.select(
        "doc_id", "ref_doc_id", "lo", "hi",
        F.greatest(F.lit(0), F.col("lo") - F.col("high") - SLACK).alias("ref_lo"),
        (F.col("hi") - F.col("low") + SLACK).alias("ref_hi")), "spans")
    discard(*used)

    passages = materialize(_verified(source, spans, width, similarity), "passages")
    others = materialize(_others(source, rows, passages, width, similarity), "others")
    return passages.union(_verified(source, others, width, similarity)).distinct()


def _cut(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            column = batch.column("text")
            for i, spans in enumerate(batch.column(name).to_pylist()):
                words = Words(column.slice(i, 1))
                keep = np.ones(len(words.data), bool)
                starts = np.append(words.starts, len(words.data))
                for s in spans:
                    lo, hi = (min(s[c], len(words.starts)) for c in ("start", "end"))
                    keep[starts[lo]:starts[hi]] = False
                texts.append(words.data[keep].tobytes().decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([name])
    return run


def _free(name: str, taken: list[str]) -> str:
    """``name``, longer by as many underscores as it takes to clash with no column."""
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def drop_passages(docs: DataFrame, min_words: int = MIN_WORDS,
                  similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the passages that stand in an earlier document.

    All columns stay; ``n_chars``, if there is one, is counted anew for texts that change, and
    documents of which no word is left go. White space before a passage stays, that after it goes.
    Rows that share a doc_id lose the passages found in any of them, as far as their texts reach.
    """
    spans, key = _free("spans", docs.columns), _free("of_doc", docs.columns)
    found = find_passages(docs, min_words, similarity).groupBy(F.col("doc_id").alias(key)).agg(
        F.collect_set(F.struct("start", "end")).alias(spans))
    joined = docs.join(found, F.col("doc_id") == F.col(key), "left").drop(key)
    cut = F.col(spans).isNotNull()
    plain = joined.where(~cut).drop(spans)
    changed = joined.where(cut).mapInArrow(_cut(spans), docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return plain.unionByName(changed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))
