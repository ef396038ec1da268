"""The stored evidence index."""

from nearwell.functions import similarity as S
from nearwell.functions.similarity import trigram_similarity
from nearwell.operators import evidence as OE
from nearwell.operators import search as OS
from nearwell.session import scratch_path

from pyspark.sql import functions as F


def test_evidence_from_the_index(spark):
    fac = spark.createDataFrame(
        [("a", "Gaya Hospital", 20.0, 80.0), ("b", "Dental House", 20.0, 80.1), ("c", None, 20.0, 80.0),
         ("d", "Far", 30.0, 75.0), ("e", "Nowhere", None, None)],
        "facility_id string, name string, lat double, lng double")
    texts = ["heart bypass", "heart surgery", "hearts", "skin care", "", "heart bypass"]
    terms = spark.createDataFrame(
        [(f, k, t) for f in "abcde" for k, t in zip(("p", "p", "s", "s", "s", "c"), texts)],
        "facility_id string, kind string, txt string")
    index = OS.write_search_table(OE.evidence_index(terms, fac), scratch_path(spark, "evidence"))
    got = {(r["facility_id"], r["txt"]) for r in index.collect()}
    # without a name the verdict on a bypass is unknown
    assert got == {(f, t) for f in "ad" for t in texts} | {(f, t) for f in "bc" for t in texts if "bypass" not in t}

    hits = spark.createDataFrame(
        [(q, f, need) for q, need in (("1", "heart bypass"), ("2", "heart bypass"), ("3", "zzz"), ("4", None))
         for f in "ab"], "query_id string, facility_id string, need string").withColumn(
        "cell", F.lit(index.where("facility_id = 'a'").first()["cell"]))
    reasons = {(r["query_id"], r["facility_id"]): r["reason"] for r in OE.lexical_evidence(hits, index).collect()}
    sims = {t: spark.range(1).select(trigram_similarity(F.lit(t), F.lit("heart bypass"))).first()[0] for t in texts}
    order = sorted((t for t in texts if sims[t] > 0.12), key=lambda t: (-sims[t], t))
    assert reasons == {(q, f): " • ".join([t for t in order if f == "a" or "bypass" not in t][:3])
                       for q in "12" for f in "ab"}

    plan = OS.touched(index, hits)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tile" in plan.split("PartitionFilters: [")[1].split("]")[0]
    short = OE.grounding_candidates(hits.where("query_id = '3'"), index, 2).collect()
    assert {(r["facility_id"], r["rn"], r["txt"]) for r in short} == {
        ("a", 1, ""), ("a", 2, "hearts"), ("b", 1, ""), ("b", 2, "hearts")}


def test_shared_grams_are_those_of_the_trigrams(spark):
    texts = ["Heart  bypass, surgery", "heart care", "x", "", None, "Éclair-7 इलाज 𝒳y", "a a a", "ÅB ring ring"]
    pairs = spark.createDataFrame([(str(i), a, "k", b) for i, a in enumerate(texts) for b in texts],
                                  "facility_id string, need string, kind string, txt string")
    words = pairs.withColumns({"words": S.plain_words(F.col("txt")), "_words": S.plain_words(F.col("need"))})
    got = words.mapInArrow(OE._shared_grams, "facility_id string, need string, kind string, txt string, "
                                             "_both int, _all int")
    a, b = S.trigrams(F.col("need")), S.trigrams(F.col("txt"))
    want = pairs.withColumns({"_both": F.size(F.array_intersect(a, b)), "_all": F.size(a) + F.size(b)}).where("_both > 0")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 5


def test_the_index_holds_no_grams(spark):
    # a row of the index meets the hits in a shuffle: texts, not eight bytes a gram
    fac = spark.createDataFrame([("f", "Clinic", 20.0, 80.0)], "facility_id string, name string, lat double, lng double")
    terms = spark.createDataFrame([("f", "procedure", "Heart check")], "facility_id string, kind string, txt string")
    row = OE.evidence_index(terms, fac).first()
    assert row.words == "heart check" and not any(isinstance(x, list) for x in row)
