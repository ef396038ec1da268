"""Embedding, exact vector scan and hybrid (distance + similarity + capacity) search.

Vector work runs as dense numpy blocks fed by Arrow: Spark partitions, shuffles and ranks, a task
multiplies one bounded block of queries with one bounded block of places. Per pair that is over an
order of magnitude cheaper than a higher-order function over two arrays.
"""

import hashlib
import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell import constants as K
from nearwell.constants import (BEDS_SCALE, DOCTORS_SCALE, EARTH_KM, WEIGHT_BEDS, WEIGHT_DISTANCE,
                                WEIGHT_DOCTORS, WEIGHT_SIMILARITY)
from nearwell.functions.geo import in_india
from nearwell.operators.geo import (BLOCK, CELL_DEG, PLACE_ROWS, QUERY_ROWS, cut_blocks, grid_cell,
                                    query_cells)
from nearwell.session import materialize, scratch_path, spread

# ship the task functions of this module by value: executors need numpy and pyarrow only
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- embedding ---------------------------------------------------------------------------------

def hashed_words(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The default model: unit vectors of hashed word counts, the same on every machine."""
    def slot(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim if word else dim

    def embed(texts: list[str]) -> np.ndarray:
        words = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.large_string())),
                                       r"[^\p{L}\p{N}]+")
        rows = pc.list_parent_indices(words).to_numpy()
        coded = pc.dictionary_encode(pc.list_flatten(words))
        slots = np.array([slot(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)
        at = rows * (dim + 1) + (slots[coded.indices.to_numpy()] if len(rows) else 0)
        # the last slot takes the empty strings at the texts' ends
        out = np.bincount(at, minlength=len(texts) * (dim + 1)).reshape(len(texts), dim + 1)
        out = out[:, :dim].astype(float)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)
    return embed


def batch_embed(docs: DataFrame, model: Callable[[], Callable] = hashed_words,
                known: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(facility_id, doc_hash, embedding) of docs(facility_id, doc).

    ``model`` is called once per partition and returns texts -> matrix. Documents already in
    ``known`` (facility_id, doc_hash) with the same text are left out, so only new or changed
    documents are embedded; union the result with what is stored. A model is heavy per byte, so
    ``partitions`` can spread few input files over more tasks.
    """
    todo = docs.select("facility_id", F.sha2("doc", 256).alias("doc_hash"), "doc")
    if known is not None:
        todo = todo.join(known.select("facility_id", "doc_hash"),
                         ["facility_id", "doc_hash"], "left_anti")

    if partitions is not None:
        todo = todo.repartition(partitions, "facility_id")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = model()
        for batch in batches:
            texts = batch.column("doc").to_pylist()
            vectors = pa.array(list(run(texts).astype("float32")), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("facility_id"), batch.column("doc_hash"), vectors],
                ["facility_id", "doc_hash", "embedding"])

    return todo.mapInArrow(embed, "facility_id string, doc_hash string, embedding array<float>")


# --- numpy blocks ------------------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    """A list<float> Arrow column as unit rows in double (a zero vector stays NaN)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = rows.reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _floats(column) -> np.ndarray:
    return column.to_numpy().astype("float64")


def _best(primary: np.ndarray, secondary: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows: primary descending, secondary ascending, id ascending."""
    keep = np.arange(len(primary))
    if len(primary) > k:
        kth = np.partition(primary, len(primary) - k)[len(primary) - k]
        keep = keep[primary >= kth]
    return keep[np.lexsort((ids[keep], secondary[keep], -primary[keep]))[:k]]


# --- exact scan --------------------------------------------------------------------------------

SCAN_SCHEMA = "query_id string, facility_id string, similarity double"


#: Queries and vectors scored at a time: their similarities stay in a core's cache.
SCAN_QUERIES, SCAN_VECTORS = 128, 4096


def _scan_top(q, q32, v, v32, order, k, best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, rounded similarity) of what can be among the ``k`` best of each query, by rounded
    similarity and ``order``, at most ``k`` a query.

    ``best`` holds the k best similarities of each query in the blocks before, and then with this one.
    All pairs are scored in floats, and those that can round to the least of the best again in doubles.
    """
    least = best.min(axis=1)
    new = np.flatnonzero(least == -np.inf)
    sims = q32 @ v32.T
    if len(new) and len(v) > k:
        first = np.nan_to_num(sims[new], nan=-np.inf)
        least[new] = np.partition(first, -k, axis=1)[:, -k]
    # half a digit each, and what floats are off for unit vectors
    least -= 0.0011 + v.shape[1] * 2.0 ** -21
    at = np.flatnonzero(sims >= least.astype("float32")[:, None])
    rows, cols = np.divmod(at, len(v))
    exact = np.empty(len(at))
    for cut in range(0, len(at), 8192):
        part = slice(cut, cut + 8192)
        exact[part] = np.einsum("ij,ij->i", q[rows[part]], v[cols[part]])
    near = np.round(exact, 3)

    def top(*by) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` hits of each query, and their ranks."""
        sort = np.lexsort((*by, rows))
        own = rows[sort]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        return sort[rank < k], rank[rank < k]

    hits, rank = top(-exact)
    found = np.full(best.shape, -np.inf)
    found[rows[hits], rank] = exact[hits]
    some = np.unique(rows)
    both = np.concatenate((best[some], found[some]), axis=1)
    best[some] = np.partition(both, -k, axis=1)[:, -k:]
    hits, _ = top(order[cols], -near)
    hits = hits[near[hits] >= np.round(best.min(axis=1), 3)[rows[hits]]]
    return rows[hits], cols[hits], near[hits]


def _scan_table(parts: list[tuple]) -> pa.Table:
    cols = [np.concatenate([p[c] for p in parts]) if parts else np.array([]) for c in range(3)]
    return pa.table({"query_id": pa.array(cols[0].astype(object), pa.string()),
                     "facility_id": pa.array(cols[1].astype(object), pa.string()),
                     "similarity": pa.array(cols[2].astype("float64"), pa.float64())})


def semantic_scan(queries: DataFrame, vec: DataFrame, k: int) -> DataFrame:
    """Top ``k`` facilities per query by cosine over all vectors: query_id, rank, facility_id,
    similarity (3 digits; ties by id).

    The vectors are read once, where they lie, whatever the batch: the queries come to them, in blocks
    of ``QUERY_ROWS``. One block goes with the task, more are files in shared scratch space, one of
    them in memory at a time. A task keeps the ``k`` best similarities of each query so far and gives
    on only what can be among them. Vectors of fewer splits than there are cores are spread first.
    """
    blocks = _query_blocks(queries.select(F.col("query_id").cast("string").alias("query_id"), "qv"))
    vec = vec.select("facility_id", "embedding")
    cores = vec.sparkSession.sparkContext.defaultParallelism
    if len(blocks) > 1 and vec._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        vec = vec.repartition(cores)
    best = vec.mapInArrow(_scan(blocks, k, PLACE_ROWS), SCAN_SCHEMA)
    rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "facility_id")
    return (best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "facility_id", "similarity"))


def _query_blocks(queries: DataFrame) -> list[pa.Table | str]:
    """The batch itself if it is one block, else the files of its blocks."""
    head = queries.limit(QUERY_ROWS + 1).toArrow()
    if head.num_rows <= QUERY_ROWS:
        return [head]
    path = scratch_path(queries.sparkSession, "scan-queries")
    queries.write.option("maxRecordsPerFile", QUERY_ROWS).parquet(path)
    return sorted(queries.sparkSession.read.schema(queries.schema).parquet(path).inputFiles())


def _scan(blocks: list[pa.Table | str], k: int, rows: int):
    def load(block: pa.Table | str) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block, str):
            system, name = fs.FileSystem.from_uri(block)
            block = pq.read_table(name, filesystem=system, partitioning=None)
        return np.array(block["query_id"].to_pylist(), dtype=object), _matrix(block["qv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        only = load(blocks[0]) if len(blocks) == 1 and len(blocks[0]) else None
        waiting, have = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
                have += batch.num_rows
            if not waiting or (batch is not None and have < rows):
                continue
            part = pa.Table.from_batches(waiting)
            waiting, have = [], 0
            ids, v = np.array(part["facility_id"].to_pylist(), dtype=object), _matrix(part["embedding"])
            v32, order = v.astype("float32"), pc.rank(part["facility_id"], tiebreaker="dense").to_numpy()
            for b, block in enumerate(blocks):
                if only is None and not isinstance(block, str):
                    continue  # no queries
                qids, q = only or load(block)
                if b not in best:
                    best[b] = np.full((len(qids), k), -np.inf, np.float64)
                q32 = q.astype("float32")
                found: list[tuple] = []
                for at in range(0, len(qids), SCAN_QUERIES):
                    cut = slice(at, at + SCAN_QUERIES)
                    hits = []
                    for low in range(0, len(ids), SCAN_VECTORS):
                        own = slice(low, low + SCAN_VECTORS)
                        asked, hit, near = _scan_top(q[cut], q32[cut], v[own], v32[own], order[own], k,
                                                     best[b][cut])
                        hits.append((asked, hit + low, near))
                    asked, hit, near = (np.concatenate(c) for c in zip(*hits))
                    last = near >= np.round(best[b][cut].min(axis=1), 3)[asked]
                    found.append((qids[cut][asked[last]], ids[hit[last]], near[last]))
                yield from _scan_table(found).to_batches()

    return run


# --- hybrid search -----------------------------------------------------------------------------

#: Rows of a block of the search. Every place goes to all query parts of its cell and every query to all
#: place parts, so blocks are as large as a task can hold.
SEARCH_PLACES, SEARCH_QUERIES = 65536, 32768
#: Pairs of a block that are scored at a time.
BLOCK_PAIRS = 1 << 18

PAIR_SCHEMA = ("query_id string, facility_id string, cell int, distance_km double, similarity double, "
               "score double, limit int")
PAIR_TYPES = {"query_id": pa.string(), "facility_id": pa.string(), "cell": pa.int32(),
              "distance_km": pa.float64(), "similarity": pa.float64(), "score": pa.float64(),
              "limit": pa.int32()}


def _codes(wanted, have) -> tuple[np.ndarray, np.ndarray]:
    """Optional equality as numbers: a wish of -1 accepts every place."""
    codes, _ = pd.factorize(np.concatenate([wanted.to_numpy(), have.to_numpy()]))
    return codes[:len(wanted)], codes[len(wanted):]


def _capacity(column, scale: float) -> np.ndarray:
    return np.minimum(1.0, np.nan_to_num(_floats(column)) / scale)


def _on_sphere(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack((np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)), axis=1)


def _search_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best ``limit`` places of one block for each of its queries.

    All pairs are scored in floats first, with the chord for the distance. An approximate score is at
    most ``over`` above the exact one and ``under`` below it, so what lies farther below the limit-th best
    can't be among the best; only the others are scored exactly, in doubles.
    """
    cols: dict[str, list] = {c: [] for c in PAIR_TYPES}
    if left.num_rows and right.num_rows:
        qids = np.array(left.column("query_id").to_pylist(), dtype=object)
        ids = np.array(right.column("facility_id").to_pylist(), dtype=object)
        q, v = _matrix(left.column("qv")), _matrix(right.column("embedding"))
        flat, flng = _floats(right.column("lat")), _floats(right.column("lng"))
        extra = (WEIGHT_BEDS * _capacity(right.column("beds"), BEDS_SCALE)
                 + WEIGHT_DOCTORS * _capacity(right.column("num_doctors"), DOCTORS_SCALE))
        box = {c: _floats(left.column(c)) for c in
               ("lat", "lng", "radius_km", "lat_lo", "lat_hi", "lng_lo", "lng_hi")}
        limits, cell = left.column("limit").to_numpy(), left.column("cell").to_numpy()
        radius = box["radius_km"]
        with np.errstate(invalid="ignore", divide="ignore"):
            arc = np.clip(radius / EARTH_KM, 0, np.pi)
            reach = 4 * np.sin(arc / 2) ** 2
            slope = WEIGHT_DISTANCE * EARTH_KM / radius
        over = WEIGHT_DISTANCE * arc ** 2 / 24 + 1e-5
        under = 2e-5 + 2e-7 * q.shape[1]
        q32, v32 = (WEIGHT_SIMILARITY * q).astype("float32"), np.nan_to_num(v).astype("float32").T
        extra32, usable = extra.astype("float32"), ~np.isnan(v).any(axis=1)
        qp, fp = _on_sphere(box["lat"], box["lng"]), _on_sphere(flat, flng).T
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(right.column("facility_id")).to_numpy()] = np.arange(len(ids))
        kinds = [_codes(left.column(w), right.column(h))
                 for w, h in (("type", "facility_type"), ("operator", "operator_type"))]
        rows = max(1, BLOCK_PAIRS // len(ids))
        for at in range(0, len(qids), rows):
            part = slice(at, at + rows)
            b = {c: x[part][:, None] for c, x in box.items()}
            chord = qp[part] @ fp
            chord *= -2
            chord += 2
            limit = reach[part][:, None]
            ok = chord <= limit * (1 + 1e-12) + 1e-14
            for test in (flat >= b["lat_lo"], flat <= b["lat_hi"], flng >= b["lng_lo"], flng <= b["lng_hi"],
                         usable):
                ok &= test
            for wish, have in kinds:
                for i in np.flatnonzero(wish[part] >= 0):
                    ok[i] &= have == wish[at + i]
            rim = chord >= limit * (1 - 1e-12) - 1e-14
            rim &= ok
            rim = rim if rim.any() else None
            rough = q32[part] @ v32
            rough += extra32
            with np.errstate(invalid="ignore"):
                rough -= slope[part][:, None].astype("float32") * np.sqrt(
                    np.maximum(chord, 0, out=chord).astype("float32"))
            low = np.full(len(rough), -np.inf)
            for i in np.flatnonzero(np.count_nonzero(ok, axis=1) > limits[part]):
                # the least of the best that are surely inside the circle bounds the others
                sure, k = rough[i][ok[i] if rim is None else ok[i] & ~rim[i]], int(limits[at + i])
                if len(sure) > k and not np.isnan(sure).any():
                    low[i] = np.partition(sure, len(sure) - k)[len(sure) - k] - over[at + i] - under - 2e-4
            ok &= ~(rough < low[:, None])
            n, hit = np.nonzero(ok)
            n += at
            sim = np.empty(len(n))
            for i in range(0, len(n), 1 << 14):
                cut = slice(i, i + (1 << 14))
                sim[cut] = (v[hit[cut]] * q[n[cut]]).sum(axis=1)
            qlat, lat = np.radians(box["lat"][n]), np.radians(flat[hit])
            cos = (np.sin(qlat) * np.sin(lat)
                   + np.cos(qlat) * np.cos(lat) * np.cos(np.radians(flng[hit] - box["lng"][n])))
            dist = EARTH_KM * np.arccos(np.clip(cos, -1, 1))
            inside = (dist <= radius[n]) & ~np.isnan(sim)
            n, hit, sim, dist = n[inside], hit[inside], sim[inside], dist[inside]
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.round(WEIGHT_SIMILARITY * sim + WEIGHT_DISTANCE * (1 - dist / radius[n])
                                 + extra[hit], 4)
            dist, sim = np.round(dist, 1), np.round(sim, 3)
            best = np.lexsort((by_id[hit], dist, -score, n))
            best = best[np.arange(len(best)) - np.searchsorted(n[best], n[best]) < limits[n[best]]]
            n, hit = n[best], hit[best]
            for c, x in (("query_id", qids[n]), ("facility_id", ids[hit]), ("cell", cell[n]),
                         ("distance_km", dist[best]), ("similarity", sim[best]), ("score", score[best]),
                         ("limit", limits[n])):
                cols[c].append(x)
    return pa.table({c: pa.array(np.concatenate(x) if x else [], PAIR_TYPES[c])
                     for c, x in cols.items()})


def type_operator_filter(pairs: DataFrame) -> DataFrame:
    """Optional equality on facility type and operator: a NULL wish accepts everything."""
    return pairs.filter(
        (F.col("type").isNull() | (F.col("type") == F.col("facility_type")))
        & (F.col("operator").isNull() | (F.col("operator") == F.col("operator_type"))))


def topk_by_score(hits: DataFrame) -> DataFrame:
    """Add ``rank`` and keep rank <= limit per query: rounded score descending, rounded distance
    ascending, id. Every query has its own ``limit``; a null one, or one below 1, keeps nothing."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc("distance_km"), F.asc("facility_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("limit"))


# --- the stored search table -------------------------------------------------------------------

#: Cells along a side of a tile, the unit of the table's folders.
TILE_CELLS = 2
SHOWN = ["name", "facility_type", "operator_type", "reason", "beds", "num_doctors", "official_phone",
         "official_website", "city", "state", "lat", "lng"]


def tile_of(cell) -> "F.Column":
    return (F.floor(cell / (10000 * TILE_CELLS)) * 10000
            + F.floor(F.pmod(cell, F.lit(10000)) / TILE_CELLS)).cast("int")


def search_table(fac: DataFrame, vec: DataFrame, geo: DataFrame, procedures: DataFrame,
                 cell_deg: float = CELL_DEG) -> DataFrame:
    """All that searching and showing a located facility takes, one row each.

    facility_id, point, capacity, type, ``geo_valid``, vector, the shown columns, the default
    ``reason``, its grid ``cell`` and the ``tile`` of cells. Facilities without a vector are left out,
    as they are never found. Store it with :func:`write_search_table`; search then reads only the
    cells that a batch touches and joins neither vectors nor checks.
    """
    places = fac.filter(in_india(F.col("lat"), F.col("lng")))
    valid = geo.groupBy("facility_id").agg(F.max(F.coalesce("geo_valid", F.lit(False))).alias("geo_valid"))
    cell = grid_cell(F.col("lat"), F.col("lng"), cell_deg)
    rows = (default_reason(places, procedures).withColumnRenamed("match_reason", "reason")
            .join(vec.select("facility_id", "embedding"), "facility_id")
            .join(valid, "facility_id", "left"))
    return rows.select("facility_id", *[c for c in SHOWN if c in rows.columns],
                       F.coalesce("geo_valid", F.lit(False)).alias("geo_valid"), "embedding",
                       cell.alias("cell"), tile_of(cell).alias("tile"))


def write_search_table(table: DataFrame, path: str) -> DataFrame:
    """Store the table, or an evidence index, in a folder per tile, sorted by cell, and read it back.

    A busy cell spans as many range partitions, and so files, as its rows need; files of one tile
    hold few cells each, which their statistics tell apart.
    """
    order = ["tile", "cell", F.xxhash64("facility_id")]
    (table.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("tile").parquet(path))
    return table.sparkSession.read.schema(table.schema).parquet(path)


def touched(table: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of a table with ``tile`` and ``cell`` in the cells of a batch, by its folders first.

    The list of cells is bounded by the India box (960 at one degree).
    """
    listed = cells.select("cell", tile_of(F.col("cell")).alias("tile")).distinct().collect()
    tiles, own = sorted({r["tile"] for r in listed}), sorted(r["cell"] for r in listed)
    if not own:
        return table.where("false")
    # one expression from text: a literal object for each cell takes seconds
    return table.where(f"tile IN ({', '.join(map(str, tiles))}) AND cell IN ({', '.join(map(str, own))})")


def search_pairs(queries: DataFrame, table: DataFrame, require_geo_valid: bool = True,
                 cell_deg: float = CELL_DEG, place_rows: int = SEARCH_PLACES,
                 query_rows: int = SEARCH_QUERIES) -> DataFrame:
    """Ranked (query_id, rank, facility_id, cell, distance_km, similarity, score, limit).

    ``table`` is a search table made with the same ``cell_deg``. Queries without a limit of 1 or more,
    or without a point in or near India, find nothing. One small job lists the cells of the batch.
    """
    asked = queries.select("query_id", "lat", "lng", "radius_km", "type", "operator",
                           F.col("limit").cast("int").alias("limit"), "qv").where("limit >= 1")
    asked = query_cells(asked, cell_deg)
    here = touched(table, asked)
    if require_geo_valid:
        here = here.where("geo_valid")
    here = here.select("facility_id", "lat", "lng", "beds", "num_doctors", "facility_type",
                       "operator_type", "embedding", "cell")
    asked, here = cut_blocks(asked, here, place_rows, query_rows)
    asked, here = spread(asked, *BLOCK), spread(here, *BLOCK)
    pairs = asked.groupBy(*BLOCK).cogroup(here.groupBy(*BLOCK)).applyInArrow(
        _search_block, PAIR_SCHEMA)
    return topk_by_score(pairs)


def default_reason(hits: DataFrame, procedures: DataFrame) -> DataFrame:
    """Add match_reason: the first three procedures by text, cut, else the name."""
    wanted = hits.select("facility_id").distinct()
    order = Window.partitionBy("facility_id").orderBy("txt")
    first = (procedures.join(wanted, "facility_id", "left_semi")
             .withColumn("n", F.row_number().over(order)).filter("n <= 3")
             .groupBy("facility_id").agg(F.array_join(
                 F.sort_array(F.collect_list("txt")), K.SEPARATOR).alias("_terms")))
    return hits.join(first, "facility_id", "left").withColumn(
        "match_reason", F.coalesce(F.left("_terms", F.lit(K.REASON_CHARS)), "name")).drop("_terms")


HIT_COLUMNS = ["query_id", "rank", "facility_id", "name", "facility_type", "operator_type",
               "distance_km", "similarity", "score", "match_reason", "beds", "num_doctors",
               "official_phone", "official_website", "city", "state", "lat", "lng"]


def search_facilities(queries: DataFrame, table: DataFrame, require_geo_valid: bool = True,
                      cell_deg: float = CELL_DEG, **blocks) -> DataFrame:
    """Hybrid search for a batch of queries over a stored search table.

    queries: query_id string, qv array<float>, lat, lng, radius_km, type, operator, limit.
    With ``require_geo_valid`` (the documented contract) only facilities whose coordinates passed
    validation take part; without it every located facility does.
    """
    hits = search_pairs(queries, table, require_geo_valid, cell_deg, **blocks)
    found = materialize(hits, "search-hits")
    shown = touched(table, found).select("facility_id", "cell", *SHOWN)
    return (found.join(shown, ["cell", "facility_id"])
            .withColumnRenamed("reason", "match_reason").select(*HIT_COLUMNS))


def overfetch_limit(limit) -> "F.Column":
    """How many hits to fetch so that the relevance floor can still fill ``limit``."""
    return F.least(F.lit(K.MAX_LIMIT), limit * K.OVERFETCH)


def overfetch_floor(hits: DataFrame, min_similarity: float = K.MIN_SIMILARITY,
                    floor_first: bool = False) -> DataFrame:
    """hits(query_id, rank, similarity, limit, ...) after the relevance floor, re-ranked.

    The floor applies to the rounded similarity of the first min(50, 3 * limit) hits, as served;
    ``floor_first`` drops irrelevant hits before that cut.
    """
    if not floor_first:
        hits = hits.filter(F.col("rank") <= overfetch_limit(F.col("limit")))
    kept = hits.filter(F.coalesce("similarity", F.lit(0.0)) >= min_similarity)
    order = Window.partitionBy("query_id").orderBy("rank")
    return (kept.withColumn("_r", F.row_number().over(order))
            .filter(F.col("_r") <= F.col("limit")).withColumn("rank", F.col("_r")).drop("_r"))
