"""Differencing against a plain restatement, and what every assignment must hold."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearwell.llm import shards
from nearwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_difference(sizes, start):
    """Partial partitions as lists of (sum, members), combined by hand."""
    k = len(start)
    parts = [(-1, sorted(((s, [], i) for i, s in enumerate(start)), key=lambda x: (-x[0], x[2])))]
    parts += [(i, [(s, [i], None)] + [(0, [], None)] * (k - 1)) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))
        (i, a), (j, b), *parts = parts
        both = [(s + t, x + y, m if m is not None else n)
                for (s, x, m), (t, y, n) in zip(a, reversed(b))]
        parts.append((min(i, j), sorted(both, key=lambda x: -x[0])))
    out = [None] * len(sizes)
    for _, members, shard in parts[0][1]:
        for m in members:
            out[m] = shard
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 8])
def test_difference(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, 2, 7, 60):
        for start in ([0] * k, rng.integers(0, 900, k).tolist()):
            sizes = np.sort(rng.integers(0, 200, n))[::-1]
            assert shards.difference(sizes, start).tolist() == plain_difference(sizes.tolist(), start)


def check(rows, k=shards.SHARDS):
    by_shard, homes = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    assert all(len(h) == 1 for h in homes.values()) and by_shard.keys() <= set(range(k))
    return [sum(r["size"] for r in by_shard.get(i, ())) for i in range(k)]


def test_query(spark, texts):
    rows = QUERIES["op11_sharding"](spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    sums = check(rows)
    assert max(sums) - min(sums) <= 16
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_bounded_pieces_and_a_hot_group(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 300, 4000).tolist()
    groups = spark.createDataFrame(
        [(i, s, 1) for i, s in enumerate(sizes)] + [(9999, 60_000, 300), (10_000, 7, 2000)],
        "key long, bytes long, n long")
    large, small = shards.balance(groups, heavy=16, bucket=256)
    heavy = {r["key"] for r in large.collect()}
    assert heavy == {9999, 10_000}
    rows = large.unionByName(small).collect()
    assert sorted(r["key"] for r in rows) == [*range(4000), 9999, 10_000]
    sums = np.bincount([r["shard"] for r in rows], [r["bytes"] for r in rows], shards.SHARDS)
    assert sums.max() - sums.min() <= 2
    again = shards.balance(groups.repartition(5), heavy=16, bucket=256)
    assert {tuple(r) for r in again[0].unionByName(again[1]).collect()} == {tuple(r) for r in rows}


def test_group_beyond_a_fair_share(spark):
    docs = spark.createDataFrame([(i, "x" * 900) for i in range(60)]
                                 + [(100 + i, f"{i}" * 10) for i in range(70)], "doc_id long, text string")
    rows = shards.assign(docs).collect()
    sums = sorted(check(rows))
    assert sums[-1] == 60 * 901 and sums[-2] - sums[0] <= 21


def test_odd_documents(spark, odd_documents, no_documents, tmp_path):
    rows = shards.assign(odd_documents).collect()
    check(rows)
    assert len(rows) == odd_documents.count()
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert shards.assign(no_documents).count() == 0
    folder = shards.write_shards(odd_documents, f"{tmp_path}/out")
    back = spark.read.parquet(folder)
    assert back.select("doc.*").columns == odd_documents.columns and back.count() == len(rows)
    assert {(r[0], r[1], r[2]) for r in back.select("shard", "slot", F.col("doc.doc_id")).collect()} == {
        (r["shard"], r["slot"], r["doc_id"]) for r in rows}
