"""Jobs over stored tables, run again after failures."""

import pytest
from pyspark.sql import functions as F

from nearwell.operators import sessions as ON
from nearwell.plans import jobs
from nearwell.plans.domain import Domain
from nearwell.session import scratch_path
from nearwell.sources.keyed import KeyedTable
from nearwell.sources.readers import scan_registry_csv

SF = "/root/testdata/sf0.001"
AS_OF = "2024-01-01 12:00:00"


def stored(spark, name, key, rows):
    table = KeyedTable(spark, scratch_path(spark, name), (key,), rows.schema)
    table.replace(rows, 4)
    return table


def test_a_sweep_that_failed_is_run_again(spark, monkeypatch):
    d = Domain(spark, SF)
    log = d.usage_event.withColumn("created_date", F.to_date("created_at"))
    tables = [stored(spark, "conversations", "conversation_id", d.conversation),
              stored(spark, "turns", "conversation_id", d.turn),
              stored(spark, "searches", "created_date", log)]
    path = scratch_path(spark, "archive")
    want = ON.archive_rollup(ON.archivable(d.conversation, AS_OF), d.turn, AS_OF)
    merge = KeyedTable.merge

    def broken(self, changes, apply, writer, batch):
        if self is tables[0]:
            raise RuntimeError("lost")
        return merge(self, changes, apply, writer, batch)

    monkeypatch.setattr(KeyedTable, "merge", broken)
    with pytest.raises(RuntimeError):
        jobs.sweep_conversations(*tables, path, AS_OF, 3)
    monkeypatch.setattr(KeyedTable, "merge", merge)
    assert tables[0].read().count() == d.conversation.count()
    # the turns are gone by now, their archive is not
    for _ in range(2):
        archived = jobs.sweep_conversations(*tables, path, AS_OF, 3)
        rows = archived.select(want.columns)
        assert rows.exceptAll(want).count() == want.exceptAll(rows).count() == 0 < want.count()
    left = tables[0].read()
    assert left.join(want, "conversation_id", "left_semi").count() == 0
    assert left.count() + want.select("conversation_id").distinct().count() == d.conversation.count()
    assert tables[1].read().join(left, "conversation_id", "left_anti").count() == 0
    # a later sweep past the retention leaves nothing behind
    jobs.sweep_conversations(*tables, path, "2034-01-01 00:00:00", 4)
    assert [t.read().count() for t in tables] == [0, 0, log.where("created_at IS NULL").count()]


def test_searches_are_logged_once_and_expire(spark):
    table = stored(spark, "searches", "created_date", spark.createDataFrame([], jobs.SEARCHES))
    requests = spark.createDataFrame([("a", "u1", "eye near Pune", 50.0), ("b", None, "help", None),
                                      ("c", "u1", "x near y", 10.0), ("d", None, "bad", None)],
                                     "message_id string, user_id string, text string, radius_km double")
    answers = spark.createDataFrame([("a", "ok", "eye", "Pune", 18.5, 73.8, 2), ("b", "need_more_info", "", None, None, None, 0),
                                     ("c", "no_results", "x", "y", 20.0, 80.0, 0), ("d", "invalid", None, None, None, None, 0)],
                                    "message_id string, route string, need string, label string, lat double, "
                                    "lng double, n_results int")
    for batch, as_of in ((0, AS_OF), (0, AS_OF), (1, "2024-02-01 00:00:00")):
        jobs.log_searches(answers, requests, table, as_of, batch)
    rows = table.read().collect()
    assert sorted((r.raw_query, r.result_count, str(r.created_date)) for r in rows) == [
        ("eye near Pune", 2, "2024-01-01"), ("eye near Pune", 2, "2024-02-01"),
        ("x near y", 0, "2024-01-01"), ("x near y", 0, "2024-02-01")]
    assert len({r.session_id for r in rows}) == 4
    d = Domain(spark, SF)
    others = [stored(spark, name, "conversation_id", rows) for name, rows in (
        ("conversations", d.conversation), ("turns", d.turn))]
    jobs.sweep_conversations(*others, table, scratch_path(spark, "archive"), "2024-02-02 00:00:00", 0, days=30)
    assert {str(r.created_date) for r in table.read().collect()} == {"2024-02-01"}


def test_registry_files_are_ingested_and_verified(spark):
    pages = spark.createDataFrame([
        (2, '<a href="https://cdnbbsr/b.pdf">Hisar (PDF 2 KB)</a><a href="https://cdnbbsr/a.pdf">Karnal (PDF)</a>'),
        (1, '<a href="https://cdnbbsr/a.pdf">Ambala (PDF 1 KB)</a><a href="https://cdnbbsr/none.pdf">Rohtak (PDF)</a>'),
        (3, None)], "page_id long, html string")
    texts = spark.createDataFrame([
        ("https://cdnbbsr/a.pdf", "1 HOSP1 City\nCare Public x 2 HOSP2 Eye, \"Best\" Home Private y"),
        ("https://cdnbbsr/b.pdf", "District Ambala (Haryana) 1 HOSP3 CITY CARE Private z 2 HOSP4 New One Public"),
        ("https://cdnbbsr/unlinked.pdf", "1 HOSP5 Nobody Public"), ("https://cdnbbsr/none.pdf", None)],
        "url string, text string")
    out = scratch_path(spark, "registry")
    jobs.ingest_registry(pages, texts, out, "PMJAY", "Haryana")
    rows = {(r.registry_name, r.city, r.facility_type) for r in scan_registry_csv(spark, out).collect()}
    # the document linked twice belongs to page 1, and its City Care stands before that of page 2
    assert rows == {("City Care", "Ambala", "Public"), ('Eye, "Best" Home', "Ambala", "Private"),
                    ("New One", "Ambala", "Public")}

    facilities = spark.createDataFrame([("f1", "City Care", "Ambala", None), ("f2", "New One", "AMBALA", None),
                                        ("f3", "City Care", "Pune", None), ("f4", None, "Ambala", None)],
                                       "facility_id string, name string, city string, pincode string")
    old = spark.createDataFrame([("f3", "OLD", "kept", None, True, None, None, 1.0, None),
                                 ("f1", "OLD", "replaced", None, True, None, None, 1.0, None)], jobs.VERIFICATION)
    table = stored(spark, "verified", "facility_id", old)
    for _ in range(2):
        summary = jobs.verify_facilities(out, facilities, table, AS_OF, 0).collect()
        assert [(r.source, r.n) for r in summary] == [("PMJAY", 2), ("OLD", 1)]
    got = {r.facility_id: (r.registry_name, r.registry_type) for r in table.read().collect()}
    assert got == {"f1": ("City Care", "Public"), "f2": ("New One", "Public"), "f3": ("kept", None)}
