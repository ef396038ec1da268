"""Ranked search against scores by plain integers."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from nearwell.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, items, k=50):
    """docs: [(doc_id, text)], items: [(item_id, text)]; sorted (item_id, rank, doc_id, score)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        own = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                    * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & c.keys())
            if s > 0:
                own.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(own, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    texts = ["", None, "Ab-c1É É\x7fß\n", "x", "--", "日本 ab"]
    got, bounds = lexical.terms_of(pa.array(texts))
    flat = [t.decode() for t in got.to_pylist()]
    assert [flat[x:y] for x, y in zip(bounds, bounds[1:])] == [terms(t) for t in texts]


def test_matches_plain_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(500)
    docs = docs.union(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 100000", "text"))  # ties
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    data, asked = [tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]
    want = plain_search(data, asked, 7)
    assert rows(lexical.search(docs.repartition(5), items, 7)) == want
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 15)
    assert rows(lexical.search(docs.repartition(3), items, 7)) == want


def test_tiles(monkeypatch):
    rng = np.random.default_rng(2)
    lists = [rng.choice(40, rng.integers(0, 20), replace=False).tolist() for _ in range(9)]
    block = pa.table({"item": np.arange(9), "terms": pa.array(
        [[str(t).encode() for t in x] for x in lists], pa.list_(pa.binary()))})
    own = lexical.Postings(block)
    names = [int(t) for t in own.vocabulary.to_pylist()]
    weights = rng.integers(0, 40_000, len(names)).astype(float)
    table = rng.integers(0, 10**6, (30, len(names))) * (rng.random((30, len(names))) < 0.3)
    row, ids = np.nonzero(table)
    want = [[sum(int(weights[names.index(t)]) * int(d[names.index(t)]) for t in x) for d in table] for x in lists]
    for size in (1, 7, 2048):
        monkeypatch.setattr(lexical, "TILE_TERMS", size)
        assert lexical.scores(row, ids, table[row, ids], 30, own, weights).tolist() == want
    found = np.array(want) // 10**9  # many ties
    best = lexical.Best(9, 4)
    docs = rng.permutation(30)
    for at in (slice(0, 11), slice(11, 12), slice(12, 30)):
        best.add(found[:, at], docs[at], np.zeros(len(docs[at]), bool))
    for i in range(9):
        mine = sorted((-s, d) for s, d in zip(found[i], docs) if s > 0)[:4]
        assert [(-s, d) for s, d in zip(best.score[best.item == i], best.id[best.item == i])] == mine


def test_odd_documents(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "p3 W1x1 two"), (1, "p3 W1x1 two"), (2, None), (3, "--"), (None, "日本"),
                                   (4, "nowhere")], "item_id long, text string")
    data = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = plain_search(data, [tuple(r) for r in items.collect()])
    assert rows(lexical.search(odd_documents, items)) == want and len(want) > 10
    assert rows(lexical.search(no_documents, items)) == []
    none = lexical.search(odd_documents, items.where("false").coalesce(1))
    assert rows(none) == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
