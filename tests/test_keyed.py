"""Keyed tables merged by batches, and conversations archived from state."""

import json

import pytest
from pyspark.sql import functions as F

from nearwell.operators.registry import upsert_verification
from nearwell.operators.sessions import archive_rollup
from nearwell.operators.shortlists import upsert_items
from nearwell.plans.domain import Domain
from nearwell.session import scratch_path
from nearwell.sources.keyed import KeyedTable
from nearwell.streaming import archive
from nearwell.streaming import streams as X

SF = "/root/testdata/sf0.001"
KEYS = ("shortlist_id", "facility_id")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_batches_are_applied_once_and_in_order(spark):
    items, changes = Domain(spark, SF).shortlist_item, Domain(spark, SF).item_change
    table = KeyedTable(spark, scratch_path(spark, "items"), KEYS, items.schema)
    with pytest.raises(ValueError):
        table.merge(changes, upsert_items, "w", 0)
    table.replace(items, 4)
    assert same(table.read(), items)
    write = X.stream_upsert(table, "w")
    half = [changes.filter(F.col("seq") % 2 == i) for i in (1, 0)]
    for batch_id, batch in ((0, half[0]), (1, half[1]), (1, half[1]), (0, half[0])):  # two run again
        write(batch, batch_id)
    want = upsert_items(upsert_items(items, half[0]), half[1])
    assert same(table.read(), want)
    assert table.merge(half[0].limit(1), upsert_items, "another writer", 0)
    table.replace(table.read(), 7)
    assert same(table.read().select(*KEYS), want.select(*KEYS)) and table._commit()[1] == 7
    assert table.merge(half[0], upsert_items, "w", 1) == []


def test_a_batch_rewrites_only_its_buckets(spark):
    rows = spark.createDataFrame([(str(i), "old", i) for i in range(200)],
                                 "facility_id string, source string, n long")
    table = KeyedTable(spark, scratch_path(spark, "ver"), ("facility_id",), rows.schema)
    table.replace(rows, 8)
    before = table._commit()[2]
    new = spark.createDataFrame([("5", "new", -1), ("999", "new", -2), (None, "new", -3)], rows.schema)
    touched = table.merge(new, upsert_verification, "m", 0)
    after = table._commit()[2]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == set(touched)
    got = {r["facility_id"]: r["source"] for r in table.read().collect()}
    assert len(got) == 201 and got["5"] == got["999"] == "new" and got["6"] == "old"

    def broken(old, changes):
        return old.select("facility_id", "source", F.raise_error(F.lit("no")).cast("long").alias("n"))

    with pytest.raises(Exception, match="no"):
        table.merge(new, broken, "m", 1)
    assert {r["facility_id"]: r["source"] for r in table.read().collect()} == got
    assert table.merge(new.where("false"), upsert_verification, "m", 1) == []
    table.merge(new, upsert_verification, "m", 2)
    assert table.vacuum(keep=1) == 2 * len(touched) and table.read().count() == 201
    table.merge(spark.createDataFrame([(str(i), "x", 0) for i in range(200)], rows.schema),
                lambda old, ch: old.join(ch, "facility_id", "left_anti"), "m", 3)
    assert [r["facility_id"] for r in table.read().collect()] == ["999"]


TURN = ("conversation_id string, user_id string, conversation_lang string, started_at timestamp, turn_no int, "
        "role string, content string, parsed_need string, parsed_place string, lat double, lng double, "
        "result_count int, results_json string, created_at timestamp")


def run(spark, source, out, state, **kw):
    stream = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(source)
    (archive.stream_archive(stream, **kw).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())


def test_archive_from_state_equals_the_rollup(spark):
    d = Domain(spark, SF)
    source, out, state = (scratch_path(spark, n) for n in ("turns", "archive", "state"))
    facts = d.conversation.select("conversation_id", "user_id", F.col("lang").alias("conversation_lang"),
                                  "started_at")
    turns = d.turn.drop("conv_id", "lang").join(facts, "conversation_id")
    names = [f.split()[0] for f in TURN.split(", ")]
    turns = turns.select(*names)
    edge = turns.agg(F.max("created_at")).first()[0]
    half = turns.approxQuantile("turn_no", [0.5], 0.0)[0]
    for part in (turns.where(F.col("turn_no") <= half), turns.where(F.col("turn_no") > half)):
        part.orderBy("created_at").coalesce(1).write.mode("append").parquet(source)
    end = spark.createDataFrame([("end", "u", "en", None, 1, "user", "x") + (None,) * 7], TURN).withColumn(
        "created_at", F.lit(edge) + F.expr("INTERVAL 1 DAY"))
    end.coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, state, delay="1 day", per_row=3)
    early = spark.read.schema("part int").parquet(out).count()  # the watermark is at the last real turn
    late = end.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 3 DAYS"))
    late.withColumn("conversation_id", F.lit("late")).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, state, delay="1 day", per_row=3)
    cols = ["conversation_id", "user_id", "lang", "started_at", "turn_count", "part", "turns"]
    got = spark.read.parquet(out).where("conversation_id <> 'end'")
    want = archive_rollup(d.conversation, d.turn, edge, per_row=3)
    assert same(got.select(*cols), want.select(*cols)) and got.count() > max(early, d.conversation.count())


def test_archive_edges(spark):
    """Silence of exactly the gap closes; a conversation that goes on is archived again."""
    def turn(c, n, minute):
        return (c, "u", "en", None, n, "user", f"{c}{n}") + (None,) * 7, minute

    base = "TIMESTAMP '2024-01-01 00:00:00'"

    def frame(*rows):
        df = spark.createDataFrame([r[:-1] + (str(m),) for r, m in rows],
                                   TURN.replace("created_at timestamp", "created_at string"))
        return df.withColumn("created_at", F.expr(
            f"{base} + make_dt_interval(0, 0, cast(created_at AS int), 0)")).coalesce(1)

    source, out, state = (scratch_path(spark, n) for n in ("turns", "archive", "state"))
    frame(turn("a", 1, 0), turn("a", 2, 29), turn("a", 3, 59), turn("b", 1, 0), turn("c", 1, 5),
          turn(None, 1, 1)).write.mode("append").parquet(source)
    run(spark, source, out, state, delay="0 minutes")
    frame(turn("c", 2, 36), turn("z", 1, 60)).write.mode("append").parquet(source)
    frame(turn("z", 2, 200)).write.mode("append").parquet(source)
    frame(turn("z", 3, 210)).write.mode("append").parquet(source)
    run(spark, source, out, state, delay="0 minutes")
    got = {(r["conversation_id"], tuple(t["turn_no"] for t in json.loads(r["turns"])))
           for r in spark.read.parquet(out).collect()}
    assert got == {("a", (1, 2)), ("a", (3,)), ("b", (1,)), ("c", (1,)), ("z", (1,))}
