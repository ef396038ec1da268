"""Alignment of two tokenizers over the same bytes, by lockstep merging.

Both tokenizers' tokens are byte ranges of the same string, in order. For all documents of a batch at
once, one NumPy state vector holds a pointer into the A tokens and one into the B tokens; every step
emits a link for each lane, advances the pointers whose token ends first, emits a cut where both end
together, and drops finished lanes. Long documents are several lanes, which begin where both
tokenizations have a token end, so the number of steps is bounded.

Link counts over the corpus are aggregated from one row per chunk of documents and distinct id pair,
and come back to the chunk the same way; links of single documents are never shuffled.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell.llm.hashing import chunks, text_bytes
from nearwell.llm.tokens import Encoder
from nearwell.session import materialize

#: A tokens of a lane before a long document goes on in another one.
LANE = 256
#: Bytes of text aligned at once; a longer text is aligned by itself.
CHUNK_BYTES = 1 << 19
#: Memory for text pieces remembered by one Python worker, in bytes, and what one takes besides its
#: text; only memory and time depend on it.
REMEMBERED = 24 << 20
PIECE_BYTES = 200


# --- tokenizers --------------------------------------------------------------------------------

class ByteTokens:
    """Ids of space + text by a byte-level BPE file, and the bytes of every id."""

    def __init__(self, path: str):
        self._own = Encoder(path)
        self._own.tokenizer.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        tok = self._own.tokenizer
        self.values = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                       for t in (tok.id_to_token(i) or "" for i in range(tok.get_vocab_size()))]

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self._own.known) * PIECE_BYTES > REMEMBERED:
            self._own._forget()
        return self._own.encode(spaced)


class PieceTokens:
    """The same by a sentencepiece file whose pieces hold the space mark at their start only.

    No piece reaches over the start of a run of spaces, so each distinct run with the characters
    after it is encoded once.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space mark after other characters")
        self.values = [bytes([int(p[3:5], 16)]) if self._own.is_byte(i)
                       else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._space = [self._own.piece_to_id("▁")]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _indices(self, units: list[bytes]) -> np.ndarray:
        if self.size > REMEMBERED:
            self._forget()
        new = [u for u in units if u not in self.known]
        if new:
            self.size += sum(map(len, new)) + PIECE_BYTES * len(new)
            # the model puts a space before every text, which stands for the unit's first one
            ids = self._own.encode([u[1:].decode() for u in new], num_threads=1)
            ids = [self._space if u == b" " else x for u, x in zip(new, ids)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            self.flat = np.concatenate((self.flat, flat))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        return np.fromiter((self.known[u] for u in units), np.int64, len(units))

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(spaced)
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        blank = data == 32
        first = blank & ~np.append(False, blank[:-1])
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        start = np.flatnonzero(first | begin[:n])
        units = pa.BinaryArray.from_buffers(
            pa.binary(), len(start), [None, pa.py_buffer(np.append(start, n).astype(np.int32)),
                                      pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(units)
        at = self._indices(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.starts[at + 1] - self.starts[at]
        owner = np.searchsorted(offsets, start, "right") - 1
        counts = np.bincount(owner, sizes, len(offsets) - 1).astype(np.int64)
        steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return (self.flat[np.repeat(self.starts[at], sizes) + steps],
                np.concatenate(([0], np.cumsum(counts))))


@functools.lru_cache(maxsize=2)
def _tokens(kind: type, path: str):
    own = kind(path)
    return own, pa.array(own.values, pa.binary()), np.array([len(v) for v in own.values], np.int64)


# --- lockstep merging --------------------------------------------------------------------------

def _lanes(a_end, b_end, a_bounds, b_bounds, lane: int) -> list[np.ndarray]:
    """Where lanes begin and end among the A and the B tokens.

    ``a_end`` and ``b_end`` ascend over all documents. A lane begins with each document that has
    tokens and, about every ``lane`` tokens, after an end that both have.
    """
    full = np.diff(a_bounds) > 0
    seeds = [np.arange(x + lane, y, lane) for x, y in zip(a_bounds[:-1], a_bounds[1:])
             if y - x > 2 * lane]
    after = np.concatenate(seeds) if seeds else np.empty(0, np.int64)
    stop = a_bounds[np.searchsorted(a_bounds, after, "right")]
    found = []
    while len(after):  # the next A token whose end is also a B token's
        at = np.minimum(np.searchsorted(b_end, a_end[after - 1]), len(b_end) - 1)
        same = b_end[at] == a_end[after - 1]
        found.append(after[same])
        after, stop = after[~same] + 1, stop[~same]
        after, stop = after[after < stop], stop[after < stop]
    inner = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    a_start = np.sort(np.concatenate((a_bounds[:-1][full], inner)))
    b_inner = np.searchsorted(b_end, a_end[inner - 1]) + 1 if len(inner) else inner
    b_start = np.sort(np.concatenate((b_bounds[:-1][full], b_inner)))
    return [a_start, np.append(a_start[1:], len(a_end)), b_start, np.append(b_start[1:], len(b_end))]


def merge(a_end: np.ndarray, b_end: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray,
          lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A position, B position) and cuts (last A position, last B position), in order.

    Ends are byte offsets over all documents joined; each document's tokens cover the same bytes on
    both sides, and bounds are its tokens' offsets.
    """
    if not len(a_end):
        none = np.empty(0, np.int64)
        return none, none, none, none
    i, i_stop, j, j_stop = _lanes(a_end, b_end, a_bounds, b_bounds, lane)
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        x, y = a_end[i], b_end[j]
        same = x == y
        cuts_a.append(i[same])
        cuts_b.append(j[same])
        i, j = i + (x <= y), j + (y <= x)
        live = i < i_stop
        if not live.all():
            i, j, i_stop, j_stop = i[live], j[live], i_stop[live], j_stop[live]
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.lexsort((b, a))
    return a[order], b[order], np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


@dataclass
class Aligned:
    """The alignment of a batch of texts; positions count over the batch."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def rows(self, positions: np.ndarray) -> np.ndarray:
        """The text of each A position."""
        return np.searchsorted(self.a_bounds, positions, "right") - 1


def _drop(ids, bounds, keep):
    counts = np.diff(bounds)
    return ids[np.repeat(keep, counts)], np.concatenate(([0], np.cumsum(np.where(keep, counts, 0))))


def _same_bytes(ids, bounds, values, sizes, data, offsets) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    joined = np.frombuffer(values.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[bounds]
    if np.array_equal(ends, offsets) and np.array_equal(joined, data):
        return np.ones(len(bounds) - 1, bool)
    return np.array([np.array_equal(joined[w:x], data[y:z]) for w, x, y, z in
                     zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])], bool)


def align_texts(texts: pa.Array, a_path: str, b_path: str) -> Aligned:
    """Tokenise and merge a batch; null and empty texts, and texts that either tokenizer doesn't give
    back, have no tokens."""
    a, a_values, a_sizes = _tokens(ByteTokens, a_path)
    b, b_values, b_sizes = _tokens(PieceTokens, b_path)
    texts = texts.cast(pa.large_string())
    empty = pc.fill_null(pc.equal(pc.binary_length(texts), 0), True)
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.if_else(empty, none, pc.binary_join_element_wise(none, texts.fill_null(""), space))
    data, offsets = text_bytes(spaced)
    a_ids, a_bounds = a.encode(spaced)
    b_ids, b_bounds = b.encode(spaced)
    good = (_same_bytes(a_ids, a_bounds, a_values, a_sizes, data, offsets)
            & _same_bytes(b_ids, b_bounds, b_values, b_sizes, data, offsets))
    if not good.all():
        a_ids, a_bounds = _drop(a_ids, a_bounds, good)
        b_ids, b_bounds = _drop(b_ids, b_bounds, good)
    return Aligned(a_ids, b_ids, a_bounds, b_bounds,
                   *merge(np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids]), a_bounds, b_bounds))


# --- whole corpora -----------------------------------------------------------------------------

def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, links (a, b) and groups (a_end, b_end) of every row.

    Links are the pairs of token positions, from 0 in each document, whose byte ranges overlap; groups
    end before these positions, where tokens of both end at one byte. Null and empty texts and texts
    that a tokenizer doesn't give back byte for byte have empty lists. Repeated rows are aligned each;
    other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            own = align_texts(batch.column("text"), a_path, b_path)
            row, cut = own.rows(own.link_a), own.rows(own.cut_a)
            n = np.arange(batch.num_rows + 1)
            pairs = [pa.array(x, pa.int32()) for x in (
                own.link_a - own.a_bounds[row], own.link_b - own.b_bounds[row],
                own.cut_a + 1 - own.a_bounds[cut], own.cut_b + 1 - own.b_bounds[cut])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "a_ids": _lists(own.a_ids, own.a_bounds),
                "b_ids": _lists(own.b_ids, own.b_bounds),
                "links": pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, n), pa.int32()),
                    pa.StructArray.from_arrays(pairs[:2], ["a", "b"])),
                "groups": pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(cut, n), pa.int32()),
                    pa.StructArray.from_arrays(pairs[2:], ["a_end", "b_end"]))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>, "
             "groups array<struct<a_end: int, b_end: int>>")


@functools.cache
def _decimals(bits: int) -> pa.Array:
    """Every id of so many bits in decimal with a comma, a bar and a semicolon after it."""
    size = 1 << bits
    return pa.array([f"{i}{mark}" for i in range(size) for mark in ",|;"], pa.binary())


def group_hashes(own: Aligned) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    na, nb = len(own.a_ids), len(own.b_ids)
    if not na:
        return [""] * (len(own.a_bounds) - 1)
    mark_a, mark_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    mark_a[own.cut_a], mark_b[own.cut_b] = 1, 2
    # A tokens of a group come before its B tokens, groups follow one another
    group_a = np.cumsum(mark_a) - mark_a
    group_b = (np.cumsum(mark_b) - mark_b) // 2
    before_a, before_b = np.append(0, own.cut_a + 1), np.append(0, own.cut_b + 1)
    codes = np.empty(na + nb, np.int64)
    codes[np.arange(na) + before_b[group_a]] = own.a_ids * 3 + mark_a
    codes[np.arange(nb) + before_a[group_b + 1]] = own.b_ids * 3 + mark_b
    text = _decimals(int(max(own.a_ids.max(), own.b_ids.max())).bit_length()).take(pa.array(codes))
    data = memoryview(text.buffers()[2])
    at = np.frombuffer(text.buffers()[1], np.int32)[own.a_bounds + own.b_bounds]
    return [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else ""
            for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


CHUNK_SCHEMA = ("chunk long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, "
                "n_links array<int>, groups_sha256 array<string>, a array<int>, b array<int>, "
                "docs array<int>, row binary, pair binary, times binary")


def _chunk_rows(a_path: str, b_path: str):
    """One row per chunk: what each document has, the distinct id pairs with the number of documents
    that hold them, and how often each document holds each pair."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            own = align_texts(batch.column("text"), a_path, b_path)
            rows, row = batch.num_rows, own.rows(own.link_a)
            width = int(own.b_ids.max(initial=0)) + 1
            pairs, at = np.unique(own.a_ids[own.link_a].astype(np.int64) * width
                                  + own.b_ids[own.link_b], return_inverse=True)
            n = max(len(pairs), 1)
            held, times = np.unique(row * n + at, return_counts=True)
            lists = {"n_a": np.diff(own.a_bounds), "n_b": np.diff(own.b_bounds),
                     "n_groups": np.bincount(own.rows(own.cut_a), minlength=rows),
                     "n_links": np.bincount(row, minlength=rows), "a": pairs // width,
                     "b": pairs % width, "docs": np.bincount(held % n, minlength=len(pairs))}
            blobs = {"row": held // n, "pair": held % n, "times": times}
            columns = {k: pa.array([v], pa.list_(pa.int32())) for k, v in lists.items()}
            columns |= {k: pa.array([v.astype("<i4").tobytes()]) for k, v in blobs.items()}
            columns |= {"chunk": batch.column("chunk")[:1],
                        "doc_id": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        "groups_sha256": pa.array([group_hashes(own)], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in names})
    return run


def _chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    # a chunk is named by its first row's number; once written, names stay what they are
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.monotonically_increasing_id().alias("chunk"))
    return materialize(rows.mapInArrow(_chunk_rows(a_path, b_path), CHUNK_SCHEMA), "align-chunks")


def _pairs(chunked: DataFrame) -> DataFrame:
    return chunked.select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pos", "p")).select(
        "chunk", "pos", "p.a", "p.b", "p.docs")


def _counts(pairs: DataFrame) -> DataFrame:
    # an A id meets at most as many B ids as that vocabulary has
    return pairs.groupBy("a", "b").agg(F.sum("docs").alias("documents")).withColumn(
        "best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, documents and best of every id pair linked in some document: how many rows hold it, and
    whether no B id is linked with its A id in more."""
    return _counts(_pairs(_chunks(docs, a_path, b_path)))


def _finish(chunked: pa.Table, counted: pa.Table) -> pa.Table:
    out = []
    for c in chunked.to_pylist():
        rows = len(c["doc_id"])
        row, pair, times = (np.frombuffer(c[k], "<i4").astype(np.int64) for k in ("row", "pair", "times"))
        n, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, bool)
        pos = counted["pos"].to_numpy()
        n[pos], best[pos] = counted["documents"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(row, np.arange(rows + 1))

        def total(x):
            return np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])

        out.append(pa.table({k: pa.array(c[k], pa.int64()) for k in
                             ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
                            | {"n_best": total(times * best[pair]), "count_sum": total(times * n[pair]),
                               "groups_sha256": pa.array(c["groups_sha256"], pa.string())}))
    return pa.concat_tables(out) if out else SUMMARY.empty_table()


SUMMARY = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                               "count_sum")] + [("groups_sha256", pa.string())])


def summaries(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    n_best counts the links whose pair is held by as many rows as any pair of its A id, ties included;
    count_sum adds up the pairs' numbers of rows over the links. Null and empty texts, and texts that
    a tokenizer doesn't give back byte for byte, have zeros and ''. Repeated rows count each, null
    doc_ids are rows like any other, an empty table gives no rows, and further columns are ignored.
    """
    chunked = _chunks(docs, a_path, b_path)
    pairs = _pairs(chunked)
    # written first: Spark then splits the join's hot pairs, which every chunk holds
    counts = materialize(_counts(pairs), "align-counts")
    counted = pairs.drop("docs").join(counts, ["a", "b"]).select("chunk", "pos", "documents", "best")
    per_doc = chunked.drop("a", "b", "docs").withColumn("of", F.col("chunk") + 0).drop("chunk")
    return per_doc.groupBy("of").cogroup(counted.groupBy("chunk")).applyInArrow(
        _finish, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in SUMMARY))
