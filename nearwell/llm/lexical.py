"""Ranked lexical search of a set of items over a corpus, by dense blocked matrix products.

Items go in blocks of bounded size. For each block the corpus is read once: every document keeps its
number of terms and the counts of the terms that the block's items hold. Scores are sums of products
of an item's term weights and a document's term impacts, so a tile of documents is scored against all
items of the block by float64 matrix products over tiles of the vocabulary. All factors are integers
and a tile's sums stay below 2^53, so the products are exact. Each task keeps the best documents per
item over its tiles, and two rounds of ranking join the tasks' lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell.llm.hashing import chunks, text_bytes
from nearwell.session import materialize

TOP = 50
#: Items, and terms of items, expected in a block. A longer item is a block of its own size.
BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 17
#: Documents and vocabulary terms of a tile. A weight is below 44,000 for any 64-bit N and an impact
#: below 10^6, so sums over a tile's terms stay below 2^53.
TILE_DOCS = 1024
TILE_TERMS = 2048
#: Bytes of text cut into terms at once; a longer text is cut by itself.
CHUNK_BYTES = 1 << 21
#: Lists of an item that the first of the two rankings keeps apart.
PARTS = 64

# The bytes of terms, and the constants of the score.
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TF_SCALE = 1000
LENGTH_SCALE = 20
LENGTH_FLOOR = 50
LENGTH_SLOPE = 50


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms, joined, and the n + 1 offsets of each text's terms.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A to Z are
    lower-cased. A null text has none.
    """
    data, offsets = text_bytes(texts)
    inside = _IS_TERM[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    at = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
    kept = _LOWER[data[inside]]
    starts = np.append((np.cumsum(inside) - 1)[at], len(kept)).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return terms, np.searchsorted(at, offsets)


# --- items -------------------------------------------------------------------------------------

def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        terms, bounds = terms_of(batch.column("text"))
        own = [pc.unique(terms.slice(x, y - x)).to_pylist() for x, y in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(own, pa.list_(pa.binary()))],
                                         ["item", "terms"])


def _blocks(items: DataFrame, n_items: int, n_terms: int) -> list[DataFrame]:
    """The items dealt into blocks by a hash."""
    n = max(-(-int(n_items) // BLOCK_ITEMS), -(-int(n_terms) // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item", F.lit(n)), F.lit(n))
    return [items.where(block == i) for i in range(n)]


class Postings:
    """Which items of a block hold each term of its vocabulary."""

    def __init__(self, block: pa.Table):
        block = block.sort_by("item")
        lists = block["terms"].combine_chunks()
        self.items = block["item"].to_numpy()
        coded = pc.dictionary_encode(lists.flatten())
        self.vocabulary = coded.dictionary
        ids = coded.indices.to_numpy().astype(np.int64)
        held = lists.value_lengths().fill_null(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.holders = np.repeat(np.arange(len(lists)), held)[order]
        self.starts = np.searchsorted(ids[order], np.arange(len(self.vocabulary) + 1))

    def tile(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The dense weights (terms x items) of some terms."""
        out = np.zeros((len(terms), len(self.items)))
        sizes = self.starts[terms + 1] - self.starts[terms]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        who = self.holders[np.repeat(self.starts[terms], sizes) + step]
        out[np.repeat(np.arange(len(terms)), sizes), who] = np.repeat(weights[terms], sizes)
        return out


# --- documents ---------------------------------------------------------------------------------

def _counts(vocabulary: pa.Array):
    """Per document its number of terms, and the counts of those in the vocabulary."""
    size = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.cast(pa.large_binary())
        for batch in chunks(batches, limit=CHUNK_BYTES):
            terms, bounds = terms_of(batch.column("text"))
            ids = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            asked = ids >= 0
            held, times = np.unique(row[asked] * size + ids[asked], return_counts=True)
            starts = pa.array(np.searchsorted(held // size, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)),
                 pa.ListArray.from_arrays(starts, pa.array(held % size, pa.int32())),
                 pa.ListArray.from_arrays(starts, pa.array(times, pa.int32()))],
                ["doc_id", "n", "ids", "times"])
    return run


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(WEIGHT_SCALE * np.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's m, in unbounded integers as 50 * n * N outgrows 64 bits on large corpora."""
    each, at = np.unique(n, return_inverse=True)
    return np.array([100 - LENGTH_FLOOR + LENGTH_SLOPE * x * n_docs // max(n_terms, 1)
                     for x in each.tolist()], np.int64)[at]


def scores(row: np.ndarray, ids: np.ndarray, impacts: np.ndarray, rows: int, postings: Postings,
           weights: np.ndarray) -> np.ndarray:
    """Items x documents; the documents' impacts are given as (row, id) entries.

    Only terms that some document of the tile holds take part, ``TILE_TERMS`` at a time.
    """
    out = np.zeros((len(postings.items), rows), np.int64)
    used, at = np.unique(ids, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at, impacts = row[order], at[order], impacts[order]
    for low in range(0, len(used), TILE_TERMS):
        terms = used[low:low + TILE_TERMS]
        x, y = np.searchsorted(at, (low, low + len(terms)))
        dense = np.zeros((len(terms), rows))
        dense[at[x:y] - low, row[x:y]] = impacts[x:y]
        out += (postings.tile(terms, weights).T @ dense).astype(np.int64)
    return out


class Best:
    """The best documents per item so far: score descending, then id ascending, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)
        self.least = np.ones(items, np.int64)  # scores below can't be among the best

    def add(self, found: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores (items x documents) of one more tile."""
        who, doc = np.nonzero(found >= self.least[:, None])
        item = np.concatenate((self.item, who))
        score = np.concatenate((self.score, found[who, doc]))
        own, blank = np.concatenate((self.id, ids[doc])), np.concatenate((self.null, null[doc]))
        order = np.lexsort((own, blank, -score, item))
        item = item[order]
        starts = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - starts[item]
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.item, self.score = item[place < self.k], score[kept]
        self.id, self.null = own[kept], blank[kept]
        self.least[item[place == self.k - 1]] = score[last]


def _search(postings: Postings, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(postings.items), k)
        for batch in batches:
            for low in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(low, TILE_DOCS)
                lists = tile.column("ids")
                row = np.repeat(np.arange(tile.num_rows), lists.value_lengths().to_numpy())
                times = tile.column("times").flatten().to_numpy().astype(np.int64)
                m = length_norms(tile.column("n").to_numpy(), n_docs, n_terms)
                impacts = IMPACT_SCALE * times // (TF_SCALE * times + LENGTH_SCALE * m[row])
                ids = tile.column("doc_id")
                best.add(scores(row, lists.flatten().to_numpy(), impacts, tile.num_rows, postings, weights),
                         ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        part = np.full(len(best.item), TaskContext.get().partitionId() % PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(postings.items[best.item]), pa.array(part),
             pa.array(best.id, mask=best.null), pa.array(best.score)], ["item", "part", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item, scores above 0.

    Equal scores go by ascending doc_id, null ones last; rank is 1 to k without gaps. Items without
    terms, or whose terms no document holds, give no rows. Every row of ``items`` is an item by
    itself, every row of ``docs`` a document; null and empty texts have no terms and don't count
    among the documents. Either table may be empty; further columns are ignored.
    """
    asked = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    asked = materialize(asked, "lexical-items")
    held = materialize(asked.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>"),
                       "lexical-item-terms")
    size = held.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in _blocks(held, *size):
        own = _search_block(texts, Postings(block.toArrow()), k)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return asked.where("false").selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):
        place = Window.partitionBy(*keys).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(texts: DataFrame, postings: Postings, k: int) -> DataFrame:
    counted = materialize(texts.mapInArrow(
        _counts(postings.vocabulary), "doc_id long, n long, ids array<int>, times array<int>"), "lexical-counts")
    n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most one row per term of the block's vocabulary
    rows = counted.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()
    df = np.zeros(len(postings.vocabulary), np.int64)
    df[rows["id"].to_numpy()] = rows["count"].to_numpy()
    return counted.where(F.size("ids") > 0).mapInArrow(
        _search(postings, weight(n_docs, df), n_docs, n_terms, k), "item long, part long, doc_id long, score long")
