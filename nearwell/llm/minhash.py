"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its five-word shingles, weighted by how often each occurs. Every shingle is a Poisson
process whose rate is its weight; an arrival falls into one of ``SLOTS`` slots, and a slot keeps the
shingle that arrived first. Two documents agree in a slot with their probability Jaccard similarity,
which is the plain Jaccard similarity where no shingle repeats. Arrivals are generated in order
of time only up to the time by which all slots are filled, so long documents cost little more than
one number per shingle.

The plain Jaccard similarity of the shingle sets decides. Repeats of a line move the probability
similarity but not the plain one, so documents that repeat a shingle are banded by both: by their
weights, and with every weight 1, which for all other documents is the same signature.

Exact copies are one representative. A bucket first compares its members with its most central one;
where members then are in different classes, those outside the bucket's largest class meet all others
in blocks, so that every pair of a bucket is tested or already in one class. A block counts what its
sets share by matrix products; no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell.llm.bitmap import bitmap_of, in_bitmap, slot_of
from nearwell.llm.components import components
from nearwell.llm.hashing import Words, chunks, mix, shingles
from nearwell.session import materialize

SLOTS = 64
BAND = 4
SIMILARITY = 0.8
#: Bounds on the sets, and on their shingles, that one part of a block is expected to hold.
PART_ROWS = 1024
PART_ITEMS = 1 << 20
COLUMNS = 4096


def _exponential(keys: np.ndarray, salt: int) -> np.ndarray:
    """A standard exponential variate per key."""
    return -np.log(((mix(keys, salt) >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int,
               slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets: per set and slot the element first to arrive.

    ``owner`` says which set an element belongs to. Rows of sets without elements are zero.
    """
    out = np.zeros((n, slots), np.uint64)
    total = np.bincount(owner, weights, n)
    todo = np.flatnonzero(total > 0)
    # by this time all slots are filled with probability 0.95; the rest run on for twice as long
    until = np.full(n, np.inf)
    until[todo] = slots * (np.log(slots) + 3) / total[todo]
    live = np.arange(len(elements))
    while len(todo):
        at, times, cells, who = live, np.zeros(len(live)), [], []
        when, step = [], 0
        while len(at):
            times = times + _exponential(elements[at], 2 * step + 100) / weights[at]
            early = times <= until[owner[at]]
            at, times = at[early], times[early]
            slot = mix(elements[at], 2 * step + 101) % np.uint64(slots)
            cells.append(owner[at] * slots + slot.astype(np.int64))
            who.append(at)
            when.append(times)
            step += 1
        cell, by, time = map(np.concatenate, (cells, who, when))
        order = np.lexsort((time, cell))
        first = order[np.append(True, cell[order][1:] != cell[order][:-1])] if len(order) else order
        out.reshape(-1)[cell[first]] = elements[by[first]]
        filled = np.bincount(cell[first] // slots, minlength=n)
        todo = todo[filled[todo] < slots]
        until[todo] *= 2
        live = live[np.isin(owner[live], todo)]
    return out


def _bands(sig: np.ndarray, band: int) -> np.ndarray:
    groups = sig.reshape(len(sig), -1, band)
    key = np.zeros(groups.shape[:2], np.uint64) + np.arange(groups.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(band):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, k], 3)
    return key


def _sketch(slots: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, bounds = shingles(Words(batch.column("text")))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
            start = np.flatnonzero(new[:len(hashes)])
            counts = np.diff(np.append(start, len(hashes))).astype(np.float64)
            sig = signatures(hashes[start], counts, owner[start], batch.num_rows, slots)
            used = np.diff(bounds) > 0
            row = np.flatnonzero(used)
            keys = _bands(sig, band)[row].view(np.int64)
            # sets that repeat a shingle are banded once more, each shingle counted once
            again = np.unique(owner[start][counts > 1])
            if len(again):
                own = np.isin(owner[start], again)
                plain = signatures(hashes[start][own], np.ones(own.sum()), np.searchsorted(
                    again, owner[start][own]), len(again), slots)
                row = np.concatenate((row, again))
                keys = np.concatenate((keys, _bands(plain, band).view(np.int64)))
                order = np.argsort(row, kind="stable")
                row, keys = row[order], keys[order]
            ends = np.searchsorted(row, np.append(np.flatnonzero(used), batch.num_rows)).astype(
                np.int32) * keys.shape[1]
            keep = pa.array(used)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(keep), batch.column("digest").filter(keep),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                ["doc_id", "digest", "bands"])
    return run


def sketch(docs: DataFrame, slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """doc_id, SHA-256 of the text, and the band keys of each document that has words."""
    source = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return source.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))).mapInArrow(
        _sketch(slots, band), "doc_id long, digest binary, bands array<bigint>")


def _sets(bitmap: np.ndarray):
    """The distinct shingles of the documents in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            wanted = batch.filter(pa.array(in_bitmap(bitmap, slot_of(ids, np.zeros(1, np.int64)))))
            for part in chunks([wanted]):
                hashes, bounds = shingles(Words(part.column("text")))
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
                new = new[:len(hashes)]
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[new],
                                                                  minlength=part.num_rows))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(hashes[new].view(np.int64)))],
                    ["id", "items"])
    return run


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as asked for."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(
        both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).select("a", "b")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the ``left`` sets has in common with each of the ``right`` ones."""
    out = np.zeros((len(left), len(right)), np.int64)
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def coded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        code = np.searchsorted(known, flat)
        code[code == len(known)] = 0
        hit = known[code] == flat
        row, code = row[hit], code[hit]
        order = np.argsort(code, kind="stable")
        return row[order], code[order]

    if not len(known):
        return out
    sides = [(len(s), *coded(s)) for s in (left, right)]
    for begin in range(0, len(known), COLUMNS):
        width = min(COLUMNS, len(known) - begin)
        grids = []
        for n, row, code in sides:
            lo, hi = np.searchsorted(code, (begin, begin + width))
            grid = np.zeros((n, width), np.float32)
            grid[row[lo:hi], code[lo:hi] - begin] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def _block_links(similarity: float):
    """Links between the classes of a block; those that join classes joined already are left out."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        ids, classes = table["id"].to_numpy(), table["class_id"].to_numpy()
        lists = table["items"].chunk(0)
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        parts = [np.flatnonzero(side == k) for k in (0, 1)]
        links: list[tuple[int, int]] = []
        if len(parts[0]) and len(parts[1]):
            count = shared_counts(*([flat[at[i]:at[i + 1]] for i in part] for part in parts))
            size = np.diff(at)
            total = size[parts[0]][:, None] + size[parts[1]][None, :] - count
            near = (count >= similarity * total) & (
                classes[parts[0]][:, None] != classes[parts[1]][None, :])
            x, y = (part[k] for part, k in zip(parts, np.nonzero(near)))
            _, first = np.unique(np.column_stack((classes[x], classes[y])), axis=0,
                                 return_index=True)
            above: dict[int, int] = {}

            def root(c: int) -> int:
                while above.get(c, c) != c:
                    above[c] = c = above.get(above[c], above[c])
                return c

            for i in first.tolist():
                one, two = root(int(classes[x[i]])), root(int(classes[y[i]]))
                if one != two:
                    above[one] = two
                    links.append((int(ids[x[i]]), int(ids[y[i]])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _rest(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among ``members`` (bucket, id) that are in different classes so far.

    Of each bucket, members outside its largest class (side 0) meet all members (side 1). Both sides
    are dealt into parts, and a block is a part of one side with a part of the other.
    """
    sizes = sets.groupBy("id").agg(F.max(F.size("items")).alias("items"))
    named = members.join(classes, "id", "left").join(sizes, "id").select(
        "bucket", "id", F.coalesce("class_id", "id").alias("class_id"), "items")
    named = materialize(named, "named")
    by_class = named.groupBy("bucket", "class_id").agg(
        F.count("*").alias("rows"), F.sum("items").alias("items"))
    total = by_class.groupBy("bucket").agg(
        F.max_by("class_id", F.struct("rows", "class_id")).alias("main"),
        F.max(F.struct("rows", "class_id", "items")).alias("top"), F.count("*").alias("classes"),
        F.sum("rows").alias("rows"), F.sum("items").alias("items")).where("classes > 1")

    def parts(rows, items):
        return F.greatest(F.ceil(rows / PART_ROWS), F.ceil(items / PART_ITEMS)).cast("int")

    total = total.select("bucket", "main", parts(
        F.col("rows") - F.col("top.rows"), F.col("items") - F.col("top.items")).alias("lefts"),
        parts(F.col("rows"), F.col("items")).alias("rights"))
    split = named.drop("items").join(total, "bucket")
    salt = F.xxhash64("id")
    right = split.select("bucket", "id", "class_id", F.lit(1).alias("side"), F.explode(
        F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod(salt, "rights").alias("r"))
    left = split.where("class_id <> main").select(
        "bucket", "id", "class_id", F.lit(0).alias("side"), F.pmod(salt, "lefts").alias("l"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"))
    columns = ["bucket", "l", "r", "id", "class_id", "side"]
    blocks = left.select(columns).union(right.select(columns)).join(sets, "id")
    return blocks.groupBy("bucket", "l", "r").applyInArrow(
        _block_links(similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, slots: int = SLOTS,
                    band: int = BAND) -> DataFrame:
    """(doc_id, class_id) of every document; class_id is the smallest doc_id of its class.

    Classes are connected components of pairs whose sets of five-word shingles have a Jaccard
    similarity of at least ``similarity``, however often a shingle occurs: with the defaults a pair
    at 0.8 meets in no band with a probability of 0.0002. Every pair that meets in a band is tested,
    or in one class already. A word is a run of characters other than white space; a text of one to
    four words is one shingle. Documents with a null, empty or blank text are classes of their own;
    rows with a null doc_id are left out; repeated rows of one doc_id
    count once (of different texts under one id all links hold). Other columns are ignored.
    """
    spark = docs.sparkSession
    book = materialize(sketch(docs, slots, band), "minhash")
    # exact copies: one representative per text
    first = book.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = materialize(book.join(first, "digest").select("doc_id", "rep").distinct(), "copies")
    members = materialize(
        book.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
        .select(F.col("r.doc_id").alias("id"),
                F.explode(F.array_distinct("r.bands")).alias("bucket")), "members")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(members.join(sizes, "bucket"), "shared")
    # the member that shares buckets with most others stands in the middle of its group
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    shared = materialize(shared.join(weight, "id").select("bucket", "id", "weight"), "shared")
    # shingle sets of those documents alone, from another pass: no text is shuffled
    wanted = bitmap_of(shared.select("id", F.lit(0).alias("part")).distinct(), "id", "part")
    sets = materialize(docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(
        _sets(wanted), "id long, items array<bigint>"), "sets")

    centre = shared.groupBy("bucket").agg(
        F.max_by("id", F.struct("weight", -F.col("id"))).alias("a"))
    pairs = shared.join(centre, "bucket").where("id <> a").select("a", F.col("id").alias("b"))
    links = materialize(_near(pairs.distinct(), sets, similarity), "near")
    classes = materialize(components(links), "classes")
    # pairs without the centre that its links leave in different classes
    others = shared.join(centre, "bucket").where("id <> a").select("bucket", "id")
    rest = materialize(_rest(others, classes, sets, similarity), "rest")
    if not rest.isEmpty():
        classes = components(links.union(rest))

    # classes of representatives, then of all documents: copies, and the smallest id among them
    near = copies.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("class_id", "rep").alias("class_id"))
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    return ids.join(near.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "doc_id",
                    "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all columns, that have the smallest doc_id of their class.

    Rows with a null doc_id stay.
    """
    gone = near_duplicates(docs, similarity).where("doc_id <> class_id")
    return docs.join(gone.select(F.col("doc_id").alias("__gone")),
                     F.col("doc_id") == F.col("__gone"), "left_anti")
