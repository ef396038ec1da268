"""Registry matching against brute force, with copies and threshold values."""

import random
import re

from nearwell.operators import registry as OR

FAC = "facility_id string, name string, city string, pincode string"
REG = ("row_id string, source string, registry_name string, city string, pincode string, "
       "facility_type string, services string, accredited boolean")


def grams(s):
    return {p[i:i + 3] for w in re.split(r"[\W_]+", s.lower()) if w
            for p in [f"  {w} "] for i in range(len(w) + 1)}


def sim(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def names(rng):
    words = ["city", "care", "hospital", "eye", "clinic", "medical", "college", "general", "st"]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))


def test_pairs_and_best_match_equal_brute_force(spark):
    rng = random.Random(5)
    fac = [(f"f{i}", rng.choice([names(rng), "city care hospital"]),
            rng.choice(["Patna", "patna", "Gaya", None, ""]),
            rng.choice(["800001", "800002", None])) for i in range(150)]
    reg = [(f"r{i:02d}", "NABH", rng.choice([names(rng), "City Care Hospital"]),
            rng.choice(["PATNA", "Gaya", None]), rng.choice(["800001", None]), "Public",
            "A;b" if i % 2 else None, i % 3 == 0) for i in range(60)]
    want, best = set(), {}
    for r in reg:
        for f in fac:
            s = sim(f[1], r[2])
            pin = f[3] is not None and f[3] == r[4] and s >= 0.40 - 1e-9
            city = f[2] and r[3] and f[2].lower() == r[3].lower() and s >= 0.62 - 1e-9
            if pin or city:
                want.add((r[0], f[0]))
                best[f[0]] = min(best.get(f[0], (9, "")), (-round(s, 6), r[0]))
    f, g = spark.createDataFrame(fac, FAC), spark.createDataFrame(reg, REG)
    got = {(r.row_id, r.facility_id) for r in OR.blocked_fuzzy_join(g, f).collect()}
    assert got == want and want
    rows = {r.facility_id: r for r in OR.best_match(g, f).collect()}
    by_id = {r[0]: r for r in reg}
    assert rows.keys() == best.keys()
    for k, (score, row_id) in best.items():
        assert rows[k].match_score == round(-score, 3)
        assert rows[k].registry_name == by_id[row_id][2]
        assert rows[k].verified_services == (["a", "b"] if by_id[row_id][6] else None)


def test_copies_add_members_not_pairs(spark):
    fac = [(f"f{i}", "City Care Hospital", "Gaya", "800001") for i in range(60)]
    fac += [("g1", "City Care Hospital", "Patna", None), ("g2", None, "Gaya", "800001"),
            ("g3", "Eye Clinic", "Gaya", None)]
    reg = [(f"r{i}", "NABH", "city care hospital", "gaya", "800001", "Public", None, True)
           for i in range(50)]
    reg.append(("s", "NABH", None, None, None, None, None, None))
    f, g = spark.createDataFrame(fac, FAC), spark.createDataFrame(reg, REG)
    pairs, facilities, entries = OR.match_classes(g, f)
    assert sorted((r.kind, r.block, r.fname, r.rname) for r in pairs.collect()) == [
        ("city", "gaya", "City Care Hospital", "city care hospital"),
        ("pin", "800001", "City Care Hospital", "city care hospital")]
    assert facilities.count() == 120 and entries.count() == 100
    assert OR.blocked_fuzzy_join(g, f).count() == 3000
    assert {(r.facilities, r.entries, r.facility_id, r.row_id)
            for r in OR.class_pairs(g, f).collect()} == {(60, 50, "f0", "r0")}
    assert OR.class_pairs(g.limit(0), f).count() == OR.class_pairs(g, f.limit(0)).count() == 0


def test_threshold_is_inclusive(spark):
    # "ab" and "ab cde": 3 of 7 grams; "abc" in "abc d": 4 of 6 shared
    assert abs(sim("abc", "abc d e") - 0.5) < 1e-9
    f = spark.createDataFrame([("f", "abc", "Gaya", "1")], FAC)
    r = spark.createDataFrame([("r", "S", "abc d e", "X", "1", "P", None, False)], REG)
    assert OR.blocked_fuzzy_join(r, f, pin_thr=0.5).count() == 1
    assert OR.blocked_fuzzy_join(r, f, pin_thr=0.51).count() == 0


def test_registry_text(spark):
    text = ("List of District  Nuh (Haryana)\n1 HOSP6G1 City\n Care Public x 2 HOSP6P2 Dr. A's "
            "Home Private\n3 HOSP6P3 Publicity House Private")
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id int, text string")
    got = [(r.district, r.pos, r.name, r.type) for r in OR.parse_registry_text(
        docs, "Haryana").orderBy("pos").collect()]
    assert got == [("Nuh", 0, "City Care", "Public"), ("Nuh", 1, "Dr. A's Home", "Private"),
                   ("Nuh", 2, "Publicity House", "Private")]


def test_stage_registry_blanks_and_newlines(spark):
    raw = spark.createDataFrame(
        [("NABH", "A\tB\nC", "", "Bihar", "", "Public", "", "true"),
         ("NABH", "D", "Gaya", "Bihar", None, "Public", "x", "")],
        "source string, registry_name string, city string, state string, pincode string, "
        "facility_type string, services string, accredited string")
    a, b = OR.stage_registry(raw).orderBy("registry_name").collect()
    assert (a.registry_name, a.city, a.pincode, a.services, a.accredited) == (
        "A B C", None, None, None, True)
    assert b.accredited is None and a.row_id != b.row_id


def test_look_alike_names_are_no_rows_before_they_match(spark):
    # every name shares most of its grams with every other: the join on shared grams met 20 times a pair
    fac = [(f"f{i}", f"Customer#{i:09d} Hospital", "Gaya", "800001") for i in range(120)]
    reg = [(f"r{i}", "NABH", f"Customer#{i:09d} Hospital", "Gaya", "800001", "Public", None, True)
           for i in range(0, 120, 2)]
    f, g = spark.createDataFrame(fac, FAC), spark.createDataFrame(reg, REG)
    pairs = OR.name_pairs(g, f)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "gram#" not in plan and "CoGroupsInArrow" in plan
    got = {(r.kind, r.fname, r.rname) for r in pairs.collect()}
    want = {(kind, a[1], b[2]) for a in fac for b in reg for kind, t in (("pin", 0.40), ("city", 0.62))
            if sim(a[1], b[2]) >= t - 1e-9}
    assert got == want and len(want) > 3000
    # small parts give the same, and the best of all parts
    for mode in ("pairs", "best", "names"):
        names = OR._blocks(g, "registry_name", "row_id"), OR._blocks(f, "name", "facility_id")
        whole, cut = (sorted(map(tuple, OR._matched(*names, mode, 0.40, 0.62, *size).distinct().collect()))
                      for size in ((), (7, 5)))
        assert whole
        if mode == "best":
            top = {}
            for kind, block, fname, rname, score in cut:
                top.setdefault((kind, block, fname), []).append(score)
            assert {k: max(v) for k, v in top.items()} == {(k, b, n): s for k, b, n, _, s in whole}
        else:
            assert whole == cut


def test_grams_counted_by_matrix_and_one_by_one(spark):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(4)
    for spread in (3, 60, 5000):
        lists = [[sorted(set(rng.integers(0, spread, rng.integers(0, 12)).tolist()))
                  for _ in range(n)] for n in (300, 170)]
        left, right = (pa.array(x, pa.list_(pa.int64())) for x in lists)
        got = np.concatenate([s for _, s in OR._shared_grams(left, right, 64)])
        assert got.tolist() == [[len(set(a) & set(b)) for b in lists[1]] for a in lists[0]]
    empty = pa.array([[], []], pa.list_(pa.int64()))
    assert [s.tolist() for _, s in OR._shared_grams(empty, empty)] == [[[0, 0], [0, 0]]]
