"""End-to-end jobs and streams."""

from pyspark.sql import functions as F

from nearwell.operators import evidence as OE
from nearwell.operators import search as OS
from nearwell.plans import ask, build
from nearwell.plans.domain import Domain
from nearwell.session import scratch_path
from nearwell.streaming import streams as X

SF = "/root/testdata/sf0.001"


def test_refresh_then_ask(spark):
    d = Domain(spark, SF)
    out = scratch_path(spark, "directory")
    bronze = d.bronze_all.drop("c_custkey", "copy")
    tables = build.refresh_directory(spark, bronze, d.pin_directory, out)
    fac = tables["facility"]
    assert fac.count() == fac.select("facility_id").distinct().count() > 0
    assert tables["facility_vec"].count() == fac.count()
    again = OS.batch_embed(build.search_documents(bronze, fac), known=tables["facility_vec"])
    assert again.count() == 0

    messages = spark.createDataFrame(
        [("m1", "ECONOMY ward near NATION_2", None, None), ("m2", "stroke near Atlantis", None, None),
         ("m3", "दिल का दौरा", 20.0, 80.0), ("m4", "help", None, None)],
        "message_id string, text string, device_lat double, device_lng double")
    empty = spark.createDataFrame([], "message_id string, reply string")
    badges = spark.createDataFrame([], "facility_id string, source string, verified boolean")
    answers, hits = ask.answer_batch(
        messages, empty, empty.withColumnRenamed("message_id", "query_id"), fac,
        tables["facility_geo"], tables["search"], tables["evidence"], badges, radius_km=200.0)
    got = {r.message_id: r for r in answers.collect()}
    assert got["m1"].route in ("ok", "no_results") and got["m1"].label == "NATION_2"
    assert got["m2"].route == "place_not_found" and got["m2"].emergency
    assert got["m3"].precision == "gps" and got["m3"].emergency
    assert got["m4"].route == "need_more_info"
    for r in hits.collect():
        assert r.similarity >= 0.4 and r.evidence_confidence in ("listed", "weak")


def test_refreshes_into_one_folder_lose_no_vector(spark):
    d = Domain(spark, SF)
    out = scratch_path(spark, "versions")
    assert build.open_directory(spark, out) == {}
    bronze = d.bronze_all.drop("c_custkey", "copy")
    first = build.refresh_directory(spark, bronze, d.pin_directory, out, geocodes=d.geocode_result)
    assert first["facility_geo"].where("NOT geo_valid").count() > 0
    changed = bronze.withColumn("description", F.when(
        F.col("unique_id").endswith("3"), F.lit("changed")).otherwise(F.col("description")))
    for rows in (changed, changed.where("unique_id <> '14'"), bronze):
        tables = build.refresh_directory(spark, rows, d.pin_directory, out)
        fac, vec = tables["facility"], tables["facility_vec"]
        assert vec.count() == fac.count() > 0
        assert vec.join(fac, "facility_id", "left_anti").count() == 0
    again = build.open_directory(spark, out)
    a, b = ({(r.facility_id, r.doc_hash, tuple(r.embedding)) for r in t["facility_vec"].collect()}
            for t in (first, again))
    assert a == b


def test_requests_have_filters_of_their_own(spark):
    d = Domain(spark, SF)
    kinds = ["hospital", "clinic", "dentist", "doctor", "pharmacy", None]
    messages = spark.createDataFrame(
        [(str(k), "Eye checkup near NATION_2", None, None, k, 500.0, 2 if k else 40) for k in kinds],
        "message_id string, text string, device_lat double, device_lng double, type string, "
        "radius_km double, limit int")
    empty = spark.createDataFrame([], "message_id string, reply string")
    badges = spark.createDataFrame([], "facility_id string, source string, verified boolean")
    documents = d.facility.select("facility_id", F.lit("eye checkup").alias("doc"))
    terms = d.capability_term.withColumn("kind", F.lit("capability"))
    _, hits = ask.answer_batch(
        messages, empty, empty.withColumnRenamed("message_id", "query_id"), d.facility, d.facility_geo,
        OS.search_table(d.facility, OS.batch_embed(documents), d.facility_geo, d.procedure_term),
        OE.evidence_index(terms, d.facility), badges)
    found = {}
    for r in hits.join(d.facility.select("facility_id", F.col("facility_type").alias("k")),
                       "facility_id").collect():
        found.setdefault(r.query_id, []).append(r.k)
    every = found.pop("None")
    assert len(set(every)) > 1 and len(every) > 2 and found
    assert all(set(k) == {q} and len(k) <= 2 for q, k in found.items())


def test_bad_requests_are_refused_and_the_others_answered(spark):
    d = Domain(spark, SF)
    rows = [("ok", "Eye checkup near NATION_2", None, None, "500", "3", None, None),
            ("default", "Eye checkup near NATION_2", None, None, None, None, "public", None),
            ("limit", "Eye checkup near NATION_2", None, None, None, "0", None, None),
            ("many", "Eye checkup near NATION_2", "north", "80", "501", "x", "state", None),
            ("sos", "heart attack", "20", "181", None, None, None, None)]
    requests = spark.createDataFrame(rows, "message_id string, text string, lat string, lng string, "
                                           "radius string, limit string, operator string, type string")
    empty = spark.createDataFrame([], "message_id string, reply string")
    badges = spark.createDataFrame([], "facility_id string, source string, verified boolean")
    documents = d.facility.select("facility_id", F.lit("eye checkup").alias("doc"))
    answers, hits = ask.answer_requests(
        requests, empty, empty.withColumnRenamed("message_id", "query_id"), d.facility, d.facility_geo,
        OS.search_table(d.facility, OS.batch_embed(documents), d.facility_geo, d.procedure_term),
        d.evidence_index, badges)
    got = {r.message_id: r for r in answers.collect()}
    assert {m: r.reply for m, r in got.items() if r.route == "invalid"} == {
        "limit": "invalid: limit", "many": "invalid: lat, radius, limit, operator", "sos": "invalid: lng"}
    assert got["sos"].emergency and not got["limit"].emergency
    assert got["ok"].route == "ok" and got["ok"].n_results == 3
    found = {r.query_id for r in hits.select("query_id").distinct().collect()}
    assert "ok" in found and found <= {"ok", "default"}
    asked = {r.message_id for r in ask.model_requests(
        requests.select("message_id", "text").union(spark.createDataFrame([("x", "help me")], "a string, b string"))
    ).collect()}
    assert "x" in asked and "ok" not in asked


def test_stream_drops_rows_later_than_the_watermark(spark):
    path = scratch_path(spark, "late")
    schema = "kind string, tokens long, created_at timestamp"

    def add(*times):
        spark.createDataFrame([("embed", 1, t) for t in times], "kind string, tokens long, t string") \
            .select("kind", "tokens", F.col("t").cast("timestamp").alias("created_at")) \
            .coalesce(1).write.mode("append").parquet(path)

    def drain(out, state):
        stream = X.stream_usage_rollup(spark.readStream.schema(schema).parquet(path))
        (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", state).trigger(availableNow=True).start()
         .awaitTermination())

    out, state = scratch_path(spark, "late-out"), scratch_path(spark, "late-state")
    add("2024-01-01 00:10:00", "2024-01-01 02:30:00")
    drain(out, state)
    add("2024-01-01 00:20:00", "2024-01-01 05:00:00")  # the first is behind the watermark
    drain(out, state)
    rows = {str(r.window_start): r.calls for r in spark.read.parquet(out).collect()}
    assert rows == {"2024-01-01 00:00:00": 1, "2024-01-01 02:00:00": 1}
