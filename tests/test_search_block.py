"""A block of the search holds a bounded number of scored pairs at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from nearwell.operators import search as OS


def test_a_full_block_takes_bounded_memory_and_finds_the_best():
    rng = np.random.default_rng(4)
    n, m = 300, 16384
    lat, lng, radius = 20 + rng.random(n), 78 + rng.random(n), rng.choice([20.0, 60.0, 500.0], n)
    flat, flng = 20 + rng.random(m), 78 + rng.random(m)
    q, v = rng.normal(size=(n, 16)).astype("float32"), rng.normal(size=(m, 16)).astype("float32")
    v[:3000] = v[0]
    none, ids = pa.nulls(n, pa.string()), [f"f{i:05d}" for i in range(m)]
    side = radius / (111 * np.cos(np.radians(lat)))
    left = pa.table({"query_id": [str(i) for i in range(n)], "qv": pa.array(list(q)), "lat": lat, "lng": lng,
                     "radius_km": radius, "lat_lo": lat - radius / 111, "lat_hi": lat + radius / 111,
                     "lng_lo": lng - side, "lng_hi": lng + side, "type": none, "operator": none,
                     "limit": pa.array([7] * n, pa.int32()), "cell": pa.array([1] * n, pa.int32())})
    right = pa.table({"facility_id": ids, "embedding": pa.array(list(v)), "lat": flat, "lng": flng,
                      "beds": pa.array(np.arange(m) % 90), "num_doctors": pa.array(np.arange(m) % 7),
                      "facility_type": pa.nulls(m, pa.string()), "operator_type": pa.nulls(m, pa.string())})
    OS._search_block(left.slice(0, 5), right)
    tracemalloc.start()
    got = OS._search_block(left, right).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in range(0, n, 37):
        a, b, c = np.radians(lat[i]), np.radians(flat), np.radians(flng - lng[i])
        km = 6371 * np.arccos(np.clip(np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(c), -1, 1))
        sim = v.astype("float64") @ q[i].astype("float64") / np.linalg.norm(v.astype("float64"), axis=1) / np.linalg.norm(
            q[i].astype("float64"))
        score = np.round(0.6 * sim + 0.25 * (1 - km / radius[i]) + 0.1 * (np.arange(m) % 90) / 200
                         + 0.05 * (np.arange(m) % 7) / 30, 4)
        near = np.flatnonzero((km <= radius[i]) & (np.abs(flat - lat[i]) <= radius[i] / 111)
                              & (np.abs(flng - lng[i]) <= side[i]))
        near = near[np.lexsort((near, np.round(km[near], 1), -score[near]))[:7]]
        assert [r["facility_id"] for r in got if r["query_id"] == str(i)] == [ids[k] for k in near]
    assert peak < 80 << 20, peak >> 20
