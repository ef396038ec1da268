"""Search against brute force, and the split paths against the plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.operators import geo as OG
from nearwell.operators import search as OS
from nearwell.session import scratch_path

FAC = ("facility_id string, name string, facility_type string, operator_type string, lat double, "
       "lng double, beds int, num_doctors int, official_phone string, official_website string, "
       "city string, state string")


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    n, nq, dim = 400, 9, 16
    vecs = rng.normal(size=(n, dim)).astype("float32")
    vecs[50:80] = vecs[0]  # copies at one spot: ties in every column but the id
    lat, lng = 20 + rng.normal(0, 0.4, n), 80 + rng.normal(0, 0.4, n)
    lat[50:80], lng[50:80] = 20.0, 80.0
    fac = [(f"f{i:03d}", f"Name {i}", ["hospital", "clinic", None][i % 3],
            ["public", "private"][i % 2], float(lat[i]), float(lng[i]),
            None if i % 5 == 0 or 50 <= i < 80 else int(i), None if 50 <= i < 80 else i % 40,
            None, None, "Gaya", "Bihar") for i in range(n)]
    q = [(f"q{i}", rng.normal(size=dim).astype("float32").tolist(), 20.0 + i / 50, 80.0,
          [10.0, 60.0, 500.0][i % 3], [None, "hospital"][i % 2], [None, None, "public"][i % 3],
          [50, 3, 20][i % 3]) for i in range(nq)]
    q[0] = (*q[0][:1], vecs[0].tolist(), *q[0][2:])
    return {
        "fac": spark.createDataFrame(fac, FAC), "rows": fac, "vecs": vecs, "q": q,
        "vec": spark.createDataFrame([(f[0], v.tolist()) for f, v in zip(fac, vecs)],
                                     "facility_id string, embedding array<float>"),
        "geo": spark.createDataFrame([(f[0], i % 11 != 0) for i, f in enumerate(fac)],
                                     "facility_id string, geo_valid boolean"),
        "queries": spark.createDataFrame(
            q, "query_id string, qv array<float>, lat double, lng double, radius_km double, "
               "type string, operator string, limit int")}


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b)
    return 6371 * math.acos(max(-1, min(1, x)))


def brute(world, valid=True):
    out = []
    for qid, qv, lat, lng, radius, kind, op, limit in world["q"]:
        qv, hits = np.array(qv, "float64"), []
        for i, f in enumerate(world["rows"]):
            d = km(lat, lng, f[4], f[5])
            if d > radius or (valid and i % 11 == 0) or (kind and f[2] != kind) or (
                    op and f[3] != op):
                continue
            v = world["vecs"][i].astype("float64")
            sim = float(qv @ v / np.linalg.norm(qv) / np.linalg.norm(v))
            score = (0.6 * sim + 0.25 * (1 - d / radius) + 0.1 * min(1, (f[6] or 0) / 200)
                     + 0.05 * min(1, (f[7] or 0) / 30))
            hits.append((-round(score, 4), round(d, 1), f[0], round(sim, 3)))
        out += [(qid, r + 1, h[2], h[1], h[3], -h[0])
                for r, h in enumerate(sorted(hits)[:limit])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.facility_id, r.distance_km, r.similarity, r.score)
                  for r in df.collect())


@pytest.mark.parametrize("grid", [{}, {"place_rows": 16, "query_rows": 2, "cell_deg": 0.5}])
@pytest.mark.parametrize("valid", [True, False])
def test_search_equals_brute_force(world, grid, valid):
    table = stored(world, grid.get("cell_deg", 1.0))
    assert rows(OS.search_pairs(world["queries"], table, valid, **grid)) == brute(world, valid)


def stored(world, cell_deg=1.0):
    procedures = world["fac"].selectExpr("facility_id", "'Check up' AS txt").where("facility_id < 'f2'")
    table = OS.search_table(world["fac"], world["vec"], world["geo"], procedures, cell_deg)
    return OS.write_search_table(table, scratch_path(table.sparkSession, "search-table"))


def test_search_reads_only_the_touched_cells(world):
    table, one = stored(world), world["queries"].where("query_id = 'q0'")
    hits = OS.search_facilities(one, table)
    want = [x for x in brute(world) if x[0] == "q0"]
    assert rows(hits) == want and len(want) > 1
    reasons = {r.facility_id: r.match_reason for r in hits.collect()}
    names = {f[0]: f[1] for f in world["rows"]}
    assert all(m == ("Check up" if f < "f2" else names[f]) for f, m in reasons.items())
    cells = OG.query_cells(one)
    plan = OS.touched(table, cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile" in plan or "PartitionFilters: [tile" in plan
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [IsNotNull(cell)" in plan
    assert OS.touched(table, cells).count() < table.count()


@pytest.mark.parametrize("limit", [None, 0, -1])
def test_a_bad_limit_finds_nothing_and_leaves_the_others(world, limit):
    table = stored(world)
    bad = world["queries"].where("query_id = 'q1'").withColumn("limit", F.lit(limit).cast("int"))
    got = OS.search_pairs(bad.union(world["queries"].where("query_id <> 'q1'")), table)
    assert rows(got) == [x for x in brute(world) if x[0] != "q1"]
    assert OS.search_pairs(bad, table).count() == 0


def test_radius_search_equals_brute_force_when_cells_are_cut(world):
    want = {(q[0], f[0]) for q in world["q"] for f in world["rows"]
            if km(q[2], q[3], f[4], f[5]) <= q[4]}
    got = OG.radius_search(world["queries"], world["fac"], place_rows=10, query_rows=2)
    assert {(r.query_id, r.facility_id) for r in got.collect()} == want


@pytest.mark.parametrize("levels", [0, 2, 4])
def test_cover_equals_brute_force_and_grows_with_cells(world, spark, levels):
    want = sorted((q[0], f[0]) for q in world["q"] for f in world["rows"]
                  if km(q[2], q[3], f[4], f[5]) <= q[4])
    whole, edge, members = OG.radius_cover(world["queries"], world["fac"], levels)
    got = whole.join(members, ["level", "cell"]).select("query_id", "facility_id").union(
        edge.select("query_id", "facility_id"))
    assert sorted((r.query_id, r.facility_id) for r in got.collect()) == want
    counts = {r.query_id: r.places for r in OG.radius_counts(
        world["queries"], world["fac"], levels).collect()}
    assert counts == {q: sum(x[0] == q for x in want) for q in {x[0] for x in want}}
    # ten times the facilities, the same rows for whole cells
    copies = world["fac"].withColumn("facility_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat("facility_id", F.lit("-"), i))))
    assert OG.radius_cover(world["queries"], copies, levels)[0].count() == whole.count()


def test_cover_of_odd_circles(spark):
    fac = spark.createDataFrame([("a", 20.0, 80.0), ("b", 37.6, 97.6), ("c", None, None),
                                 ("d", 51.0, 0.0)], "facility_id string, lat double, lng double")
    q = spark.createDataFrame(
        [("point", 20.0, 80.0, 0.001), ("all", 22.0, 82.0, 20000.0), ("null", None, 80.0, 5.0),
         ("away", 51.0, 0.0, 10.0), ("none", 20.0, 80.0, None)],
        "query_id string, lat double, lng double, radius_km double")
    got = {r.query_id: r.places for r in OG.radius_counts(q, fac).collect()}
    assert got == {"point": 1, "all": 2}
    assert OG.radius_counts(q.limit(0), fac).count() == OG.radius_counts(q, fac.limit(0)).count() == 0


def test_exact_radius_is_inside(spark):
    fac = spark.createDataFrame([("a", 20.0, 80.0)], "facility_id string, lat double, lng double")
    edge = km(20.3, 80.0, 20.0, 80.0)
    q = spark.createDataFrame([("in", 20.3, 80.0, edge), ("out", 20.3, 80.0, edge - 1e-3)],
                              "query_id string, lat double, lng double, radius_km double")
    assert [r.query_id for r in OG.radius_search(q, fac).collect()] in (["in"], [])
    assert OG.radius_search(q.filter("query_id='out'"), fac).count() == 0


def test_scan_equals_brute_force(world, monkeypatch):
    cols = ["query_id", "rank", "facility_id", "similarity"]
    vecs = world["vecs"].astype("float64")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = set()
    for qid, qv, *_ in world["q"]:
        sims = np.round(unit @ (np.array(qv, "float64") / np.linalg.norm(qv)), 3)
        order = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[:40]
        want |= {(qid, r + 1, f"f{i:03d}", float(sims[i])) for r, i in enumerate(order)}

    def scan(vec):
        return {tuple(r[c] for c in cols) for r in OS.semantic_scan(world["queries"], vec, 40).collect()}

    assert scan(world["vec"]) == want
    for rows in (50, 7):  # several blocks of vectors in a task, several files of queries
        monkeypatch.setattr(OS, "PLACE_ROWS", rows)
        monkeypatch.setattr(OS, "QUERY_ROWS", 2)
        assert scan(world["vec"].coalesce(1)) == want
    assert scan(world["vec"].where("false")) == set()
    zero = world["vec"].selectExpr("facility_id", "transform(embedding, x -> cast(0 AS float)) AS embedding")
    assert scan(zero) == set()
    assert OS.semantic_scan(world["queries"].where("false"), world["vec"], 3).count() == 0


def test_every_query_has_its_own_limit(world):
    wide = world["queries"].withColumn("limit", F.when(F.col("query_id") == "q1", 51).otherwise(1))
    rows = OS.search_pairs(wide, stored(world), False).collect()
    top = {}
    for r in rows:
        top[r.query_id] = max(top.get(r.query_id, 0), r["rank"])
    assert all(n == 1 for q, n in top.items() if q != "q1")


def test_overfetch_floor_order(spark):
    hits = spark.createDataFrame(
        [("q", i, f"f{i}", 0.39 if i <= 6 else 0.4, 2) for i in range(1, 10)],
        "query_id string, rank int, facility_id string, similarity double, limit int")
    assert OS.overfetch_floor(hits).count() == 0  # all of the first 6 are below the floor
    late = OS.overfetch_floor(hits, floor_first=True)
    assert [r.facility_id for r in late.orderBy("rank").collect()] == ["f7", "f8"]


def test_embedding_reuses_known_documents(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", "z Z")],
                                 "facility_id string, doc string")
    first = OS.batch_embed(docs)
    got = {r.facility_id: r.embedding for r in first.collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and set(got["b"]) == {0.0}
    changed = spark.createDataFrame([("a", "x y"), ("c", "other")],
                                    "facility_id string, doc string")
    again = OS.batch_embed(changed, known=first)
    assert [r.facility_id for r in again.collect()] == ["c"]


def joins(df):
    """The pair joins of a plan: those on block numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "pp#" in line]


def test_circles_never_go_to_the_driver(world, monkeypatch):
    # a few queries are hundreds of rows each, though Spark takes them for the small side
    kept = []
    monkeypatch.setattr(OG, "_pairs_within", lambda *a, f=OG._pairs_within: kept.append(f(*a)) or kept[-1])
    OG.radius_search(world["queries"], world["fac"])
    OG.radius_counts(world["queries"], world["fac"])
    assert len(kept) == 2
    for pairs in kept:
        assert joins(pairs) and all("SortMergeJoin" in line for line in joins(pairs))


def test_radius_search_carries_columns(world):
    asked = world["queries"].withColumn("wish", F.concat(F.lit("w-"), "query_id"))
    fac = world["fac"].withColumn("kind", F.concat(F.lit("k-"), "facility_id"))
    rows = OG.radius_search(asked, fac, ("wish",), ("kind",)).collect()
    plain = OG.radius_search(world["queries"], world["fac"]).collect()
    assert sorted(map(tuple, plain)) == sorted((r.query_id, r.facility_id, r.dist_km) for r in rows)
    assert rows and all(r.wish == "w-" + r.query_id and r.kind == "k-" + r.facility_id for r in rows)
