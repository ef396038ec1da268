"""Every matching pair once, without a shuffle of pairs."""

import random
from collections import Counter

from nearwell.operators import registry as OR

FAC = "facility_id string, name string, city string, pincode string"
REG = "row_id string, registry_name string, city string, pincode string"
NAMES = ["City Care Hospital", "City Care", "Care Hospital City", "Eye Clinic", "eye clinic", None]


def _rows(rng, ids, n):
    return [(rng.choice(ids), rng.choice(NAMES), rng.choice(["Gaya", "gaya", "Patna", None]),
             rng.choice(["800001", "800002", "", None])) for _ in range(n)]


def _by_classes(reg, fac):
    pairs, f, r = OR.match_classes(reg, fac)
    return pairs.join(f, ["kind", "block", "fname"]).join(r, ["kind", "block", "rname"]).select(
        "row_id", "facility_id", "score").distinct()


def test_pairs_equal_the_expanded_classes_whatever_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(OR._matched, "__defaults__", (7, 5, OR._matched.__defaults__[-1]))  # many parts
    rng = random.Random(3)
    ids = [f"i{i}" for i in range(60)] + [None]
    for some in (ids, [f"i{i}" for i in range(4000)]):
        fac = spark.createDataFrame(_rows(rng, some, 90), FAC)
        reg = spark.createDataFrame(_rows(rng, some, 70), REG)
        got = Counter(tuple(r) for r in OR.blocked_fuzzy_join(reg, fac).collect())
        assert got == Counter(tuple(r) for r in _by_classes(reg, fac).collect()) and len(got) > 500


def test_no_pair_is_shuffled(spark):
    rng = random.Random(4)
    fac = spark.createDataFrame([(f"f{i}", *r[1:]) for i, r in enumerate(_rows(rng, ["x"], 50))], FAC)
    reg = spark.createDataFrame([(f"r{i}", *r[1:]) for i, r in enumerate(_rows(rng, ["x"], 50))], REG)
    plan = OR.blocked_fuzzy_join(reg, fac)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("FlatMapCoGroupsInArrow")[0]
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in above and "Join" not in above
