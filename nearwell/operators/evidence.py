"""Why a hit matched: lexical evidence, grounding against listed services, registry badges."""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell import constants as K
from nearwell.functions.geo import in_india
from nearwell.functions.messages import json_object, suspect_evidence
from nearwell.functions.similarity import plain_words, shared_similarity
from nearwell.operators.geo import CELL_DEG, grid_cell
from nearwell.operators.search import tile_of, touched
from nearwell.operators.skew import split_groups
from nearwell.session import materialize

# ship the task functions of this module by value: executors need numpy and pyarrow only
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def union_terms(specialty: DataFrame, procedure: DataFrame, capability: DataFrame) -> DataFrame:
    """(facility_id, kind, txt) of the three child tables, duplicates kept."""
    out = None
    for kind, df in (("procedure", procedure), ("capability", capability),
                     ("specialty", specialty)):
        part = df.select("facility_id", F.lit(kind).alias("kind"), "txt")
        out = part if out is None else out.unionByName(part)
    return out


def suspect_evidence_filter(terms: DataFrame, fac: DataFrame) -> DataFrame:
    """Drop claims that the facility's kind makes implausible; an unknown verdict drops too."""
    names = fac.select("facility_id", F.col("name").alias("_name"))
    return (terms.join(names, "facility_id")
            .filter(~suspect_evidence(F.col("_name"), F.col("txt"))).drop("_name"))


def evidence_index(terms: DataFrame, fac: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """The plausible terms of located facilities with their words, one row per facility, kind and text.

    facility_id, kind, txt, ``words`` (lower-cased, parted by one blank), and the grid ``cell`` and
    ``tile``. Claims that the facility's kind makes implausible, or whose verdict is unknown, are left
    out. Store it with ``search.write_search_table``: evidence then reads the tiles of the hits only.
    """
    places = fac.filter(in_india(F.col("lat"), F.col("lng"))).select(
        "facility_id", F.col("name").alias("_name"), grid_cell(F.col("lat"), F.col("lng"), cell_deg).alias("cell"))
    return (terms.join(places, "facility_id").filter(~suspect_evidence(F.col("_name"), F.col("txt")))
            .select("facility_id", "kind", "txt", plain_words(F.col("txt")).alias("words"), "cell",
                    tile_of(F.col("cell")).alias("tile")))


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of all trigrams of each row's words, repeats kept; grams are three code points of 21
    bits, as each word is padded by two blanks before and one after."""
    padded = pc.binary_join_element_wise("  ", pc.replace_substring(words, " ", "   "), " ", "")
    sizes = pc.utf8_length(padded).to_numpy().astype(np.int64)
    text = "".join(padded.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if len(points) < 3:
        return row[:0], points[:0]
    # a gram begins no word where two blanks end it
    real = (row[:-2] == row[2:]) & ~((points[1:-1] == 32) & (points[2:] == 32))
    codes = (points[:-2] << 42) + (points[1:-1] << 21) + points[2:]
    return row[:-2][real], codes[real]


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a need and a text that share grams, with the shared ones and the sum of both numbers."""
    for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
        sides = [_grams(batch.column(c).cast(pa.string()).fill_null("")) for c in ("words", "_words")]
        codes, known = pd.factorize(np.concatenate([codes for _, codes in sides]))
        width, own = max(1, len(known)), []
        for (rows, _), ids in zip(sides, np.split(codes, [len(sides[0][0])])):
            keys = np.sort(rows * width + ids)
            own.append(keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys)
        keys = np.sort(np.concatenate(own))
        every = np.bincount(keys // width, minlength=batch.num_rows)
        both = np.bincount(keys[1:][keys[1:] == keys[:-1]] // width, minlength=batch.num_rows)
        out = pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("facility_id", "need", "kind", "txt")),
             pa.array(both, pa.int32()), pa.array(every, pa.int32())],
            ["facility_id", "need", "kind", "txt", "_both", "_all"])
        yield out.filter(pa.array(both > 0))


def lexical_evidence(hits: DataFrame, index: DataFrame,
                     min_sim: float = K.LEXICAL_MIN_SIMILARITY,
                     top: int = K.LEXICAL_TOP) -> DataFrame:
    """(query_id, facility_id, reason): the terms closest to the need, best first.

    hits: query_id, facility_id, need, cell; ``index`` is an evidence index. Evidence depends on the
    need and the facility only, so it is found once per distinct pair of the two, however often a
    need is asked. Texts meet the needs as words, which take a third of the bytes of their grams, and
    grams are made and counted for a batch of pairs at a time. Reasons are written before they meet the
    hits, so that Spark splits a pair that many queries ask for.
    """
    key = ["facility_id", "need"]
    asked = hits.select(*key).distinct().withColumn("_words", plain_words(F.col("need")))
    have = touched(index, hits).select("facility_id", "kind", "txt", "words")
    both = asked.join(have, "facility_id").mapInArrow(
        _shared_grams, "facility_id string, need string, kind string, txt string, _both int, _all int")
    scored = both.withColumn("s", shared_similarity(F.col("_both"), F.col("_all"))).filter(
        F.col("s").cast("double") > min_sim)
    order = Window.partitionBy(*key).orderBy(F.desc("s"), "txt", "kind")
    best = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)
    ordered = F.sort_array(F.collect_list(F.struct("rn", "txt")))
    reasons = materialize(best.groupBy(*key).agg(F.array_join(
        F.transform(ordered, lambda x: x["txt"]), K.SEPARATOR).alias("reason")), "reasons")
    return hits.select("query_id", *key).join(reasons, key).select(
        "query_id", "facility_id", "reason")


def weak_hits(hits: DataFrame, lexical: DataFrame) -> DataFrame:
    """Hits with no lexical evidence."""
    return hits.join(lexical.select("query_id", "facility_id"),
                     ["query_id", "facility_id"], "left_anti")


def grounding_candidates(weak: DataFrame, index: DataFrame, top: int = K.GROUNDING_TOP) -> DataFrame:
    """(facility_id, rn, txt): the shortest distinct plausible terms of each weak facility.

    weak: facility_id and cell; ``index`` is an evidence index.
    """
    have = touched(index, weak).select("facility_id", "txt").join(
        weak.select("facility_id").distinct(), "facility_id", "left_semi").distinct()
    order = Window.partitionBy("facility_id").orderBy(F.length("txt"), "txt")
    return (have.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)
            .select("facility_id", "rn", "txt"))


def grounding_requests(weak: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, system, prompt): one request per query with its facilities' listed services.

    A query has at most 50 hits of at most 12 terms, so its prompt is bounded.
    """
    lists = candidates.groupBy("facility_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", "txt"))).alias("t")).select(
        "facility_id", F.transform("t", lambda x: x["txt"]).alias("terms"))
    asked = weak.join(lists, "facility_id", "left")
    entry = F.when(F.col("terms").isNotNull(), F.struct("facility_id", "terms"))
    grouped = asked.groupBy("query_id", "need").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("listed"))
    return grouped.select(
        "query_id", F.lit(K.GROUND_PROMPT).alias("system"),
        F.concat(F.lit('need="'), "need", F.lit('"\n'), F.to_json("listed")).alias("prompt"))


def no_listing(need) -> "F.Column":
    return F.concat(F.lit("No specific “"), need, F.lit(
        "” service is listed — matched on the facility's overall profile"))


def merge_grounding(weak: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, facility_id, reason, weak) from replies(query_id, reply).

    A reply maps facility ids to supported services; a missing id, an empty list or an unusable
    reply becomes the honest disclaimer.
    """
    parsed = replies.select("query_id", F.from_json(
        json_object(F.col("reply")), "map<string,string>").alias("by_id"))
    joined = weak.join(parsed, "query_id", "left")
    raw = F.try_element_at("by_id", F.col("facility_id"))
    services = F.filter(F.from_json(raw, "array<string>"),
                        lambda x: x.isNotNull() & (x != ""))
    reason = F.nullif(F.array_join(F.slice(services, 1, 3), K.SEPARATOR), F.lit(""))
    return joined.select("query_id", "facility_id", "need", reason.alias("_r")).select(
        "query_id", "facility_id", F.coalesce("_r", no_listing(F.col("need"))).alias("reason"),
        F.col("_r").isNull().alias("weak"))


def evidence_confidence(hits: DataFrame, lexical: DataFrame, grounded: DataFrame) -> DataFrame:
    """Settle match_reason (lexical, else grounded, else default) and add evidence_confidence."""
    key = ["query_id", "facility_id"]
    lex = lexical.select(*key, F.col("reason").alias("_lex"))
    gr = grounded.select(*key, F.col("reason").alias("_gr"), F.col("weak").alias("_weak"))
    listed = F.col("_lex").isNotNull() | ~F.coalesce("_weak", F.lit(True))
    return hits.join(lex, key, "left").join(gr, key, "left").withColumns({
        "match_reason": F.coalesce("_lex", "_gr", "match_reason", F.lit("")),
        "evidence_confidence": F.when(listed, "listed").otherwise("weak"),
    }).drop("_lex", "_gr", "_weak")


def verification_badge(hits: DataFrame, verification: DataFrame) -> DataFrame:
    """Add verified and verified_source."""
    badge = verification.filter("verified").select(
        "facility_id", F.col("source").alias("verified_source"))
    return hits.join(badge, "facility_id", "left").withColumn(
        "verified", F.col("verified_source").isNotNull())


def facility_detail(fac: DataFrame, specialty: DataFrame, procedure: DataFrame,
                    capability: DataFrame, urls: DataFrame, phones: DataFrame,
                    max_items: int = 10000) -> DataFrame:
    """Every facility with arrays of its specialties, procedures, capabilities, URLs and phones.

    A facility with more than about ``max_items`` children, or 64 MB of them, is given on several rows
    (``part`` of ``parts``), each with a share of them. Its children are cut before any join, by counts
    of salted pieces, and its rows are written before they meet the facility, so no task, row or buffer
    holds all of them.
    """
    def child(df, kind, value):
        official = F.col("is_official") if kind == "phone" else F.lit(None).cast("boolean")
        return df.select("facility_id", F.lit(kind).alias("kind"), F.col(value).alias("txt"),
                         official.alias("is_official"))

    items = (child(specialty, "specialty", "txt").unionAll(child(procedure, "procedure", "txt"))
             .unionAll(child(capability, "capability", "txt"))
             .unionAll(child(urls, "url", "source_url")).unionAll(child(phones, "phone", "phone")))
    items = split_groups(items, "facility_id", F.concat("kind", "txt"), max_items, F.octet_length("txt"))

    def listed(kind):
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("txt"))))

    phone = F.when(F.col("kind") == "phone", F.struct(F.col("txt").alias("phone"), "is_official"))
    lists = items.groupBy("facility_id", "part", "parts").agg(
        listed("specialty").alias("specialties"), listed("procedure").alias("procedures"),
        listed("capability").alias("capabilities"), listed("url").alias("source_urls"),
        F.sort_array(F.collect_list(phone)).alias("phones"))
    lists = materialize(lists, "facility-children")
    # an inner join, as Spark splits a hot key of the right side only there
    bare = fac.join(lists.select("facility_id").distinct(), "facility_id", "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("part", "parts")
             else F.lit(0 if f.name == "part" else 1).alias(f.name)
             for f in lists.schema if f.name != "facility_id"]
    return fac.join(lists, "facility_id").unionByName(bare.select(*fac.columns, *empty))
