"""Geo validation, dialogue, session and shortlist rules on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from nearwell.operators import dialogue as OD
from nearwell.operators import evidence as OE
from nearwell.operators import geo as OG
from nearwell.operators import sessions as ON
from nearwell.operators import shortlists as OL
from nearwell.operators.cost import measured_cost, usage_rollup

FAC = "facility_id string, name string, city string, state string, lat double, lng double"


def test_small_cities_and_unknown_cities_pass(spark):
    four = [(f"a{i}", "n", "Four", "S", 20.0, 80.0) for i in range(3)] + [
        ("a3", "n", "four", "S", 25.0, 80.0)]
    five = [(f"b{i}", "n", "Five", None, 20.0, 80.0) for i in range(4)] + [
        ("b4", "n", "Five", "", 25.0, 80.0)]
    odd = [("c0", "n", "", "S", 20.0, 80.0), ("c1", "n", None, "S", 20.0, 80.0),
           ("c2", "n", "Four", "S", None, None), ("c3", "n", "Four", "S", 5.0, 80.0)]
    out = {r.facility_id: r for r in OG.validate_internal(
        spark.createDataFrame(four + five + odd, FAC)).collect()}
    # the outlier of a city of five is flagged; c3 makes Four a city of five as well
    assert not out["b4"].geo_valid_internal and out["b0"].geo_valid_internal
    assert not out["a3"].geo_valid_internal
    assert out["c0"].geo_valid_internal and out["c1"].geo_valid_internal
    assert not out["c2"].geo_valid_internal and not out["c3"].geo_valid_internal
    few = {r.facility_id: r for r in OG.validate_internal(
        spark.createDataFrame(four, FAC)).collect()}
    assert few["a3"].geo_valid_internal and few["a3"].dist_from_city_km > 80


def test_origin_precision(spark):
    fac = spark.createDataFrame(
        [("a", "n", "Gaya", "S", 20.0, 80.0, "800001"), ("b", "n", "Gaya", "S", 20.2, 80.0, "800002")],
        FAC + ", pincode string")
    geo = spark.createDataFrame([("a", True), ("b", True)], "facility_id string, geo_valid boolean")
    asked = spark.createDataFrame([
        ("pin", "x near 800001", "gaya", None, None), ("city", "x near gaya", "GAYA", None, None),
        ("gps", "x near gaya", "gaya", 20.1, 80.1), ("far", "x near gaya", "gaya", 28.0, 77.0),
        ("lone", "x", "", 28.0, 77.0), ("none", "x near 999999", "nowhere", None, None),
        ("abroad", "x", "", 51.0, 0.0)],
        "id string, message string, place string, device_lat double, device_lng double")
    out = {r.id: (r.precision, r.label, r.lat) for r in
           OG.resolve_origin(asked, fac, geo).collect()}
    assert out == {"pin": ("pin", "PIN 800001", 20.0), "city": ("city", "GAYA", 20.1),
                   "gps": ("gps", "your location", 20.1), "far": ("city", "gaya", 20.1),
                   "lone": ("gps", "your location", 28.0), "none": (None, None, None),
                   "abroad": (None, None, None)}


def test_intents_fall_back(spark):
    msgs = spark.createDataFrame([
        ("fast", "dialysis near Gaya", False, None, None),
        ("reply", "गया में डायलिसिस", False, None, None),
        ("broken", "eye test near Patna", True, "x", "Gaya"),
        ("context", "any cheaper?", True, "x", "Gaya"),
        ("pin", "any cheaper?", True, "x", " 800001 ")],
        "message_id string, text string, has_context boolean, prev_need string, prev_place string")
    replies = spark.createDataFrame([
        ("fast", '{"need":"no"}'), ("reply", 'ok {"need":"dialysis","place":"Gaya","lang":"HI"}'),
        ("broken", '{"need":')], "message_id string, reply string")
    parsed = OD.parse_need_place(msgs)
    assert {r.message_id for r in OD.intent_requests(parsed).collect()} == {
        "reply", "broken", "context", "pin"}
    out = {r.message_id: (r.need, r.place, r.lang) for r in
           OD.intent_merge(parsed, replies).collect()}
    assert out == {"fast": ("dialysis", "Gaya", "en"), "reply": ("dialysis", "Gaya", "hi"),
                   "broken": ("eye test", "Patna", "en"),
                   "context": ("any cheaper?", "Gaya", "en"), "pin": ("any cheaper?", "", "en")}


def test_grounding_replies(spark):
    weak = spark.createDataFrame([("q1", "1", "x"), ("q1", "2", "x"), ("q2", "1", "y")],
                                 "query_id string, facility_id string, need string")
    replies = spark.createDataFrame(
        [("q1", 'Sure {"1":["a","","b","c","d"],"2":[],"9":["z"]}')], "query_id string, reply string")
    out = {(r.query_id, r.facility_id): (r.reason, r.weak)
           for r in OE.merge_grounding(weak, replies).collect()}
    assert out["q1", "1"] == ("a • b • c", False)
    assert out["q1", "2"][1] and out["q2", "1"][0].startswith("No specific “y” service")


def test_facility_detail_splits_a_hot_facility(spark):
    fac = spark.createDataFrame([("a",), ("b",)], "facility_id string")
    terms = spark.range(3000).select(F.lit("a").alias("facility_id"),
                                     F.col("id").cast("string").alias("txt"))
    none = terms.limit(0)
    urls = none.withColumnRenamed("txt", "source_url")
    phones = none.select("facility_id", F.col("txt").alias("phone"),
                         F.lit(True).alias("is_official"))
    out = OE.facility_detail(fac, none, terms, none, urls, phones, max_items=500).collect()
    parts = [r for r in out if r.facility_id == "a"]
    assert len(parts) == 6 and sum(len(r.procedures) for r in parts) == 3000
    assert [r.part for r in out if r.facility_id == "b"] == [0]


def test_idle_edge_and_archive_parts(spark):
    at = datetime(2024, 1, 1, 12, 0)
    conv = spark.createDataFrame([
        ("edge", "u", at, datetime(2024, 1, 1, 11, 30), "active", "en"),
        ("idle", "u", at, datetime(2024, 1, 1, 11, 29, 59), "active", "en"),
        ("closing", "u", at, at, "closing", "hi"), ("closed", "u", at, at, "closed", "hi")],
        "conversation_id string, user_id string, started_at timestamp, last_activity_at timestamp, "
        "status string, lang string")
    assert [r.conversation_id for r in ON.idle_conversations(conv, "2024-01-01 12:00:00").collect()
            ] == ["idle"]
    done = ON.archivable(conv, "2024-01-01 12:00:00")
    turns = spark.range(1, 8).select(
        F.lit("idle").alias("conversation_id"), F.col("id").cast("int").alias("turn_no"),
        *[F.lit(None).cast("string").alias(c) for c in ON.TURN_FIELDS[1:-1]],
        F.lit(at).alias("created_at"))
    rows = ON.archive_rollup(done, turns, "2024-01-01 12:00:00", per_row=3).collect()
    idle = sorted((r.part, r.turn_count, r.turns.count("turn_no"))
                  for r in rows if r.conversation_id == "idle")
    assert idle == [(0, 7, 3), (1, 7, 3), (2, 7, 1)]
    assert [(r.turn_count, r.turns) for r in rows if r.conversation_id == "closing"] == [(0, "[]")]


def test_number_turns_continues(spark):
    rows = [("c", datetime(2024, 1, 1, h, 30), h) for h in (3, 1, 2)]
    new = spark.createDataFrame(rows, "conversation_id string, created_at timestamp, seq int")
    old = spark.createDataFrame([("c", 4)], "conversation_id string, turn_no int")
    out = {r.seq: r.turn_no for r in ON.number_turns(new, old).collect()}
    assert out == {1: 5, 2: 6, 3: 7}


ITEM = ("shortlist_id string, facility_id string, rank int, distance_km double, score double, "
        "match_reason string, note string, status string, added_at timestamp")


def test_upsert_keeps_all_but_rank(spark):
    t = datetime(2024, 1, 1)
    items = spark.createDataFrame([("s", "a", 1, 1.0, 0.5, "why", "n", "contacted", t)], ITEM)
    changes = spark.createDataFrame(
        [("s", "a", 1, 9, 2.0, 0.1, "new", t), ("s", "a", 2, None, 3.0, 0.2, "newer", t),
         ("s", "b", 1, 4, 2.0, 0.1, "first", t), ("s", "b", 2, 5, 3.0, 0.2, "second", t)],
        "shortlist_id string, facility_id string, seq long, rank int, distance_km double, "
        "score double, match_reason string, added_at timestamp")
    out = {r.facility_id: r for r in OL.upsert_items(items, changes).collect()}
    a, b = out["a"], out["b"]
    assert (a["rank"], a.distance_km, a.match_reason, a.status) == (None, 1.0, "why", "contacted")
    assert (b["rank"], b.distance_km, b.match_reason, b.status) == (5, 2.0, "first", "candidate")


def test_patch_reports_unknown_items(spark):
    t = datetime(2024, 1, 1)
    items = spark.createDataFrame([("s", "a", 1, 1.0, 0.5, "w", "old", "candidate", t)], ITEM)
    changes = spark.createDataFrame(
        [("s", "a", 1, "contacted", None), ("s", "a", 2, None, "new"), ("s", "a", 3, "bogus", "x"),
         ("s", "z", 1, "referred", None)],
        "shortlist_id string, facility_id string, seq long, status string, note string")
    updated, unmatched = OL.patch_items(items, changes)
    assert [(r.status, r.note) for r in updated.collect()] == [("contacted", "new")]
    assert sorted((r.facility_id, r.seq) for r in unmatched.collect()) == [("a", 3), ("z", 1)]


def test_no_embed_calls_cost_nothing_per_search(spark):
    events = spark.createDataFrame([("llm", 2_000_000, datetime(2024, 1, 2))],
                                   "kind string, tokens long, created_at timestamp")
    row = measured_cost(usage_rollup(events)).first()
    assert (row.llm_usd, row.total_usd, row.searches, row.per_search_usd) == (3.0, 3.0, 0, 0.0)
