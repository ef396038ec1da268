"""Pairing of roots in other words by sketches first, and scratch files that go when they are used up."""

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearwell.llm import passages
from nearwell.session import discard, materialize

WIDE = 2 * passages.AROUND + 1


def _wordings(rng, groups: int, size: int):
    """Contexts of roots: in each group some share much with an earlier one, most share the root alone."""
    rows = []
    for g in range(groups):
        for i in range(size):
            near = rng.integers(0, 1 << 63, WIDE, dtype=np.uint64)
            if i and i % 5 == 0:
                keep = rng.permutation(WIDE)[:rng.integers(30, WIDE)]
                near[keep] = rows[-rng.integers(1, i + 1)][1][keep]
            near[passages.AROUND] = g
            rows.append((g, near, i, int(rng.integers(20, 60)), int(rng.integers(20, 60)), int(rng.integers(0, 12)) if i % 10 == 3 else 0))
    return rows


def test_sketches_leave_out_no_pair_that_shares_enough():
    rng = np.random.default_rng(5)
    rows = _wordings(rng, 40, 30)
    flat = np.concatenate([r[1] for r in rows])
    at = np.arange(len(rows)) * WIDE + passages.AROUND
    left, right = (np.array([r[c] for r in rows]) for c in (3, 4))
    lo, hi = at - np.minimum(left, passages.AROUND), at + np.minimum(right, passages.AROUND)
    sketch = passages._sketches(flat, lo, hi, np.ones(len(rows), bool))
    table = pa.table({
        "key": pa.array([r[0] for r in rows]), "p": pa.array([0] * len(rows)), "q": pa.array([0] * len(rows)),
        "wording": pa.array(range(len(rows))), "doc_id": pa.array([r[2] for r in rows]),
        "at": pa.array([9] * len(rows), pa.int32()), "left": pa.array(left, pa.int32()),
        "right": pa.array(right, pa.int32()), "sketch": sketch, "same": pa.array([0] * len(rows)),
        "done": pa.array([False] * len(rows)), "touched": pa.array([False] * len(rows)),
        "parts": pa.array([1] * len(rows)), "part": pa.array([0] * len(rows))})
    # what found passages cover, in a row of its own before the wording
    tell = table.set_column(9, "same", pa.array([r[5] for r in rows])).set_column(
        11, "touched", pa.array([True] * len(rows))).set_column(
        8, "sketch", pa.nulls(len(rows), pa.binary()))
    both = pa.concat_tables([tell, table]).take(pa.array(np.arange(2 * len(rows)).reshape(2, -1).T.ravel()))
    left_over = {w for b in passages._alike(37)(both.to_batches(max_chunksize=50))
                 for w in b.column("wording").to_pylist()}
    near = [flat[a:b + 1] >> np.uint64(32) for a, b in zip(lo, hi)]
    wanted = set()
    for x, r in enumerate(rows):
        for y in range(r[0] * 30, x):
            if np.isin(near[x], near[y]).sum() + r[5] >= 37:
                wanted |= {x, y}
    assert len(wanted) > 100 and wanted <= left_over
    assert len(left_over) < 0.8 * len(rows), len(left_over)


def _shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for d in dirs for _, _, names in os.walk(str(d)) for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_job_that_wrote_them(spark):
    before = _shuffle_files(spark)
    out = materialize(spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).count(), "kept")
    wait = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < wait:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert out.count() == 999
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_discarded_tables_are_gone(spark):
    out = materialize(spark.range(9), "gone")
    path = out.scratch.removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    discard(out)
    assert not os.path.exists(path)


def test_finding_passages_keeps_only_what_is_read_later(spark, monkeypatch):
    made = []

    def keep(df, name):
        made.append((name, materialize(df, name).scratch))
        return df.sparkSession.read.schema(df.schema).parquet(made[-1][1])

    def noted(df, name):
        out = keep(df, name)
        out.scratch = made[-1][1]
        return out

    monkeypatch.setattr(passages, "materialize", noted)
    words = [f"w{i}" for i in range(90)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x y " + " ".join(words[5:80]))], "doc_id long, text string")
    assert passages.find_passages(docs).count() == 1
    left = {name for name, path in made if os.path.exists(path.removeprefix("file:").replace("//", "/"))}
    assert "passages" in left and not left & {"keys", "windows", "first", "met", "wordings", "digests"}
