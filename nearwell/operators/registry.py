"""Entity resolution of facilities against official registries, and registry text extraction."""

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.functions.cleaning import split_services, unescape_html
from nearwell.functions.similarity import gram_codes
from nearwell.operators.skew import first_row
from nearwell.session import materialize, spread

# ship the task functions of this module by value: executors need numpy and pyarrow only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A part of a block: about this many names of facilities meet about this many of the registry in one
# task, so that the pairs of a part fit in memory even if all of them match.
FACILITY_NAMES = 2048
REGISTRY_NAMES = 1024


def stage_registry(raw: DataFrame) -> DataFrame:
    """Registry rows as loaded: '' is missing, tabs and newlines are blanks, accredited boolean.

    ``row_id`` is a digest of the row, so that equal rows are one row to the matcher.
    """
    def text(c):
        return F.translate(F.nullif(F.col(c), F.lit("")), "\t\n", "  ")
    out = raw.select(*[text(c).alias(c) for c in K.REGISTRY_COLUMNS[:-1]],
                     F.nullif("accredited", F.lit("")).try_cast("boolean").alias("accredited"))
    return out.select(F.sha2(F.to_json(F.struct(*K.REGISTRY_COLUMNS)), 256).alias("row_id"), "*")


def _blocks(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """One row per (kind, block) a named row can match in: its PIN and its lower-cased city."""
    def key(kind, c):
        return F.struct(F.lit(kind).alias("kind"), c.alias("block"))
    return (df.select(F.explode(F.array(key("pin", F.col("pincode")),
                                        key("city", F.lower("city")))).alias("k"),
                      F.col(name).alias("name"), *keep)
            .select("k.kind", "k.block", "name", *keep)
            .filter(F.col("block").isNotNull() & F.col("name").isNotNull()))


KEY = ["kind", "block"]
PART = [*KEY, "fp", "rp"]
FOUND = "kind string, block string, fname string, rname string, score float"
FOUND_NAMES = "kind string, block string, side string, name string"


def _shared_grams(left: pa.Array, right: pa.Array, rows: int = 256):
    """(first row, shared): how many grams each list of ``left`` shares with each of ``right``, ``rows``
    lists of ``left`` at a time.

    Grams that many pairs share are columns of two 0/1 matrices that are multiplied; pairs that share
    a rarer one are counted one by one.
    """
    lrow, lgram = (f(left).to_numpy() for f in (pc.list_parent_indices, pc.list_flatten))
    rrow, rgram = (f(right).to_numpy() for f in (pc.list_parent_indices, pc.list_flatten))
    grams, rgram = np.unique(rgram, return_inverse=True)
    at = np.minimum(np.searchsorted(grams, lgram), max(len(grams) - 1, 0))
    known = grams[at] == lgram if len(grams) else np.zeros(len(lgram), bool)
    lrow, lgram = lrow[known], at[known]
    nl, nr = np.bincount(lgram, minlength=len(grams)), np.bincount(rgram, minlength=len(grams))
    common = nl * nr * 128 > len(left) * len(right)
    column = np.cumsum(common) - 1
    ours = np.zeros((len(left), int(common.sum())), np.float32)
    theirs = np.zeros((len(right), ours.shape[1]), np.float32)
    ours[lrow[common[lgram]], column[lgram[common[lgram]]]] = 1
    theirs[rrow[common[rgram]], column[rgram[common[rgram]]]] = 1
    lrow, lgram = lrow[~common[lgram]], lgram[~common[lgram]]
    order = np.argsort(rgram, kind="stable")
    rrow, ends = rrow[order], np.cumsum(nr)
    for lo in range(0, len(left), rows):
        hi = min(lo + rows, len(left))
        shared = ours[lo:hi] @ theirs.T
        own = slice(*np.searchsorted(lrow, (lo, hi)))
        size = nr[lgram[own]]
        place = np.arange(size.sum()) + np.repeat(
            ends[lgram[own]] - size - (np.cumsum(size) - size), size)
        pair = np.repeat(lrow[own] - lo, size) * len(right) + rrow[place]
        shared += np.bincount(pair, minlength=shared.size).reshape(shared.shape)
        yield lo, shared


def _match_part(mode: str, pin_thr: float, city_thr: float, fkeep: list[str], rkeep: list[str]):
    """The names of a part that are similar enough: their ``pairs`` with all columns of both sides, the ``best`` registry name of each
    facility's name (by score, then the least row_id, nulls first, and name), or only which ``names`` have
    a partner. Of ``rows``, several have one name, which is matched once; a pair of one city that is found
    for its PIN too is left out there.
    """
    def own_rows(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """A row of each name; and all rows in order of the names, with the size and begin of each name."""
        code = pc.dictionary_encode(table["name"].combine_chunks()).indices.to_numpy()
        order = np.argsort(code, kind="stable")
        size = np.bincount(code)
        begin = np.cumsum(size) - size
        return table.take(pa.array(order[begin])), order, size, begin

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols, scores = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float32))
        expand = mode == "rows" and left.num_rows and right.num_rows
        if expand:
            whole = left, right
            (left, lorder, lsize, lbegin), (right, rorder, rsize, rbegin) = own_rows(left), own_rows(right)
        if left.num_rows and right.num_rows:
            if mode == "best":
                right = right.take(pc.sort_indices(right, sort_keys=[
                    ("row_id", "ascending"), ("name", "ascending")], null_placement="at_start"))
            t = pin_thr if left["kind"][0].as_py() == "pin" else city_thr
            lg, rg = left["grams"].combine_chunks(), right["grams"].combine_chunks()
            nl, nr = (pc.list_value_length(g).to_numpy().astype(np.int64) for g in (lg, rg))
            # a little below the threshold, in single precision; the exact test is made of what passes
            low_l, low_r = ((t * n * (1 - 1e-5) - 0.01).astype(np.float32) for n in (nl, nr))
            for lo, shared in _shared_grams(lg, rg):
                near = shared * np.float32(1 + t) >= low_l[lo:lo + len(shared), None] + low_r
                r, c = np.nonzero(near & (shared > 0))
                both = shared[r, c].astype(np.float64)
                score = (both / (nl[lo + r] + nr[c] - both)).astype(np.float32)
                keep = score.astype(np.float64) >= t
                r, c, score = r[keep], c[keep], score[keep]
                if mode == "best":
                    grid = np.full(shared.shape, -1, np.float32)
                    grid[r, c] = score
                    c = grid.argmax(axis=1)
                    score = grid[np.arange(len(c)), c]
                    r = np.flatnonzero(score >= 0)
                    c, score = c[r], score[r]
                elif mode == "names":
                    r, c = np.unique(r), np.unique(c)
                rows.append(lo + r)
                cols.append(c)
                scores.append(score)
        row, col = np.concatenate(rows), np.concatenate(cols)
        if expand:
            score, (left, right) = np.concatenate(scores), whole
            pairs = lsize[row] * rsize[col]
            at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            width = np.repeat(rsize[col], pairs)
            row = lorder[np.repeat(lbegin[row], pairs) + at // width]
            col = rorder[np.repeat(rbegin[col], pairs) + at % width]
            score = np.repeat(score, pairs)
            if left["kind"][0].as_py() == "city":
                pins = pc.dictionary_encode(pa.concat_arrays([
                    *left["pin"].chunks, *right["pin"].chunks])).indices.fill_null(-1).to_numpy()
                mine, theirs = pins[:left.num_rows][row], pins[left.num_rows:][col]
                keep = (mine < 0) | (mine != theirs) | (score.astype(np.float64) < pin_thr)
                row, col, score = row[keep], col[keep], score[keep]
            scores = [score]

        def column(table: pa.Table, c: str, at: np.ndarray) -> pa.Array:
            values = table[c].combine_chunks()
            return values.take(pa.array(at)) if len(at) else values.slice(0, 0)

        if mode == "names":
            col = np.unique(col)
            out = {"side": pa.array(["fname"] * len(row) + ["rname"] * len(col), pa.string()),
                   "name": pa.concat_arrays([column(left, "name", row), column(right, "name", col)])}
        else:
            out = {"fname": column(left, "name", row), "rname": column(right, "name", col),
                   "score": pa.array(np.concatenate(scores))}
            out |= {c: column(table, c, at) for table, at, keep in (
                (left, row, fkeep), (right, col, rkeep)) for c in keep}
        n = len(out["score" if mode != "names" else "name"])
        key = {k: pa.repeat(pa.scalar(left[k][0].as_py() if n else None, pa.string()), n) for k in KEY}
        return pa.table(key | out)
    return run


def _matched(rnames: DataFrame, fnames: DataFrame, mode: str, pin_thr: float, city_thr: float,
             facility_names: int = FACILITY_NAMES, registry_names: int = REGISTRY_NAMES,
             ids: tuple[str, str] = ("name", "name")) -> DataFrame:
    """The similar names of each block; see :func:`_match_part` for ``mode``. ``ids`` are columns of the
    facilities and of the registry that tell rows of one name apart.

    Every distinct name of a block meets every other side's name there, in parts of bounded size that
    go to all tasks: a pair costs a few nanoseconds, however much the names look alike. The grams are
    made once per name and block.
    """
    counts = materialize(
        fnames.groupBy(*KEY).agg(F.count("*").alias("nf"))
        .join(rnames.groupBy(*KEY).agg(F.count("*").alias("nr")), KEY)
        .select(*KEY, F.ceil(F.col("nf") / facility_names).alias("fps"),
                F.ceil(F.col("nr") / registry_names).alias("rps")), "name-counts")

    def parts(df, own, other, row):
        df = spread(df.join(counts, KEY), *KEY, "name").withColumn("grams", gram_codes(F.col("name")))
        df = df.withColumns({
            f"{own}p": F.pmod(F.xxhash64(*dict.fromkeys(("name", row))), F.col(f"{own}ps")),
            f"{other}p": F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}ps") - 1))})
        return spread(df.drop("fps", "rps"), *PART).groupBy(*PART)

    keep = [[(c, t) for c, t in df.dtypes if mode in ("pairs", "rows") and c not in (*KEY, "name", "pin")]
            for df in (fnames, rnames)]
    schema = FOUND_NAMES if mode == "names" else ", ".join(
        [FOUND, *[f"{c} {t}" for side in keep for c, t in side]])
    return parts(fnames, "f", "r", ids[0]).cogroup(parts(rnames, "r", "f", ids[1])).applyInArrow(
        _match_part(mode, pin_thr, city_thr, *[[c for c, _ in side] for side in keep]), schema)


def _names(df: DataFrame, name: str) -> DataFrame:
    return _blocks(df, name).distinct()


def name_pairs(reg: DataFrame, fac: DataFrame, pin_thr: float = K.PIN_THRESHOLD,
               city_thr: float = K.CITY_THRESHOLD) -> DataFrame:
    """(kind, block, fname, rname, score): distinct names of one block that are similar enough, by the
    exact Jaccard similarity of their grams. Copies of a name are matched once."""
    return _matched(_names(reg, "registry_name"), _names(fac, "name"), "pairs", pin_thr, city_thr)


def match_classes(reg: DataFrame, fac: DataFrame, pin_thr: float = K.PIN_THRESHOLD,
                  city_thr: float = K.CITY_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, facilities, entries): every qualifying pair, by classes instead of rows.

    A class is all rows of one name within one PIN or city. pairs(kind, block, fname, rname, score) are
    the classes that match; facilities(kind, block, fname, facility_id) and entries(kind, block, rname,
    row_id) tell who is in those classes. Copies add members, never pairs, so a row is written at most
    twice (once for its PIN and once for its city) however many partners it has. The members come from
    the names that have a partner, without a row per pair.
    """
    rnames, fnames = _names(reg, "registry_name"), _names(fac, "name")
    matched = materialize(_matched(rnames, fnames, "names", pin_thr, city_thr), "matched-names")

    def members(df, name, side, key):
        own = _blocks(df, name, key).withColumnRenamed("name", side)
        return own.join(matched.where(F.col("side") == side).select(
            *KEY, F.col("name").alias(side)).distinct(), [*KEY, side], "left_semi")

    return (name_pairs(reg, fac, pin_thr, city_thr), members(fac, "name", "fname", "facility_id"),
            members(reg, "registry_name", "rname", "row_id"))


def class_pairs(reg: DataFrame, fac: DataFrame, pin_thr: float = K.PIN_THRESHOLD,
                city_thr: float = K.CITY_THRESHOLD) -> DataFrame:
    """The matching classes with their sizes and smallest members:
    (kind, block, fname, rname, score, facilities, facility_id, entries, row_id)."""
    f = _blocks(fac, "name", "facility_id").groupBy(*KEY, "name").agg(
        F.count("*").alias("facilities"), F.min("facility_id").alias("facility_id"))
    r = _blocks(reg, "registry_name", "row_id").groupBy(*KEY, "name").agg(
        F.count("*").alias("entries"), F.min("row_id").alias("row_id"))
    # sizes and members go with the names: no pair is shuffled
    return _matched(r, f, "pairs", pin_thr, city_thr)


def blocked_fuzzy_join(reg: DataFrame, fac: DataFrame, pin_thr: float = K.PIN_THRESHOLD,
                       city_thr: float = K.CITY_THRESHOLD) -> DataFrame:
    """(row_id, facility_id, score) of every qualifying registry row and facility.

    The expansion of :func:`match_classes`: it holds every matching pair, copies included. Use the
    classes, or :func:`best_match` for one row per facility, where there are many copies. The rows go with
    their names to the parts, so no pair is shuffled: a pair found for a PIN and for a city is told where it
    is made. Only ids of several rows that differ can bring one pair twice, and only theirs are made distinct.
    """
    def rows(df, name, key):
        own = df.select(key, F.col(name).alias("name"), "pincode", F.lower("city").alias("city")).distinct()
        own = materialize(own, "match-rows")
        several = materialize(own.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(
            F.col(key).alias("_key"), F.lit(True).alias("_several")), "match-ids")
        own = own.join(several, F.col(key).eqNullSafe(F.col("_key")), "left").withColumns(
            {"pin": F.col("pincode"), "_several": F.coalesce("_several", F.lit(False))})
        blocked = _blocks(own, "name", key, "pin", "_several")
        return (blocked.where("NOT _several").drop("_several"),
                None if several.isEmpty() else blocked.where("_several").drop("_several"))

    def pairs(r, f):
        return _matched(r, f, "rows", pin_thr, city_thr, ids=("facility_id", "row_id")).select(
            "row_id", "facility_id", "score")

    (f, f_several), (r, r_several) = rows(fac, "name", "facility_id"), rows(reg, "registry_name", "row_id")
    again = []
    if f_several is not None:
        again.append(pairs(r if r_several is None else r.union(r_several), f_several))
    if r_several is not None:
        again.append(pairs(r_several, f))
    return reduce(DataFrame.union, [pairs(r, f), *[df.distinct() for df in again]])


def best_match(reg: DataFrame, fac: DataFrame, pin_thr: float = K.PIN_THRESHOLD,
               city_thr: float = K.CITY_THRESHOLD) -> DataFrame:
    """The best registry row per facility (one registry row may verify many facilities).

    Registry copies are reduced to their lowest row_id per name and block, names to their best
    partner, and only then are facilities joined: one row each, however many copies there are.
    """
    fields = ["row_id", "source", "registry_name", "facility_type", "accredited", "services"]
    rows = _blocks(reg.withColumn("_name", F.col("registry_name")), "_name", *fields)
    reps = materialize(first_row(rows, [*KEY, "name"], [F.col("row_id")]), "registry-names")
    order = [-F.col("score"), F.col("row_id")]
    near = _matched(reps.select(*KEY, "name", "row_id"), _names(fac, "name"), "best", pin_thr, city_thr)
    best = first_row(near.join(reps.withColumnRenamed("name", "rname"), [*KEY, "rname"]),
                     [*KEY, "fname"], order)
    keyed = _blocks(fac, "name", "facility_id").withColumnRenamed("name", "fname")
    cand = keyed.join(best, [*KEY, "fname"]).select("facility_id", "score", *fields)
    return first_row(cand, ["facility_id"], order).select(
        "facility_id", "source", "registry_name", F.col("facility_type").alias("registry_type"),
        F.lit(True).alias("verified"), "accredited",
        split_services(F.col("services")).alias("verified_services"),
        F.round(F.col("score").cast("double"), 3).alias("match_score"))


def upsert_verification(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones by facility_id."""
    kept = old.join(new.select("facility_id"), "facility_id", "left_anti")
    return kept.unionByName(new)


def verification_summary(verification: DataFrame) -> DataFrame:
    return (verification.groupBy("source").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "source"))


def extract_listing_links(pages: DataFrame, prefix: str = K.LISTING_HREF_PREFIX) -> DataFrame:
    """(page_id, pos, district, url) of anchors labelled '<District> (PDF ...'.

    Tags are stripped, entities decoded, and blanks collapsed.
    """
    anchor = rf'(?is)<a[^>]+href="({prefix}[^"]+\.pdf)"[^>]*>(.*?)</a>'
    found = pages.select("page_id", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("url"),
        F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))).alias("pos", "a"))
    label = F.regexp_replace(F.col("a.label"), r"<[^>]+>", "")
    label = F.translate(unescape_html(label), "\u00a0", " ")
    label = F.trim(F.regexp_replace(label, r"\s+", " "))
    district = F.trim(F.regexp_extract(label, r"^([A-Za-z][A-Za-z .]+?)\s*\(PDF", 1))
    return found.select("page_id", "pos", district.alias("district"),
                        F.col("a.url").alias("url")).filter("district <> ''")


def parse_registry_text(texts: DataFrame, state: str) -> DataFrame:
    """(doc_id, district, pos, name, type) from the extracted text of district documents.

    A name stands between a hospital id and its type word and may wrap over lines.
    """
    entry = r"(?s)HOSP\w+\s+(.+?)\s+(Public|Private)\b"
    header = rf"(?U)District\s+([\w][\w ]*?)\s*\({state}\)"
    found = texts.select(
        "doc_id", F.trim(F.regexp_extract("text", header, 1)).alias("district"),
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("text", F.lit(entry), F.lit(1)).alias("name"),
            F.regexp_extract_all("text", F.lit(entry), F.lit(2)).alias("type"))).alias("pos", "e"))
    name = F.trim(F.regexp_replace("e.name", r"\s+", " "))
    return found.select("doc_id", "district", "pos", name.alias("name"),
                        F.col("e.type").alias("type")).filter("name <> ''")


def registry_rows(parsed: DataFrame, source: str, state: str) -> DataFrame:
    """Parsed rows (with the link label as fallback city) in the registry schema."""
    return parsed.select(
        "doc_id", "pos", F.lit(source).alias("source"), F.col("name").alias("registry_name"),
        F.coalesce(F.nullif("district", F.lit("")), "label").alias("city"),
        F.lit(state).alias("state"), F.lit("").alias("pincode"),
        F.col("type").alias("facility_type"), F.lit("").alias("services"),
        F.lit("false").alias("accredited"))
