"""Shared tables are built in as many shuffle partitions as their base tables ask for."""

from types import SimpleNamespace

import pytest

from nearwell.plans import domain

PARTS, BYTES = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.mark.parametrize("broken", [False, True])
def test_partitions_of_a_build_grow_with_the_longest_base_table(spark, tmp_path, monkeypatch, broken):
    spark.range(5000).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("orders", "part"):
        spark.range(300).write.parquet(f"{tmp_path}/{name}.parquet")
    before, seen = {c: spark.conf.get(c, None) for c in (PARTS, BYTES)}, []

    def write(path):
        seen.append((spark.conf.get(PARTS), spark.conf.get(BYTES), path))
        if broken:
            raise RuntimeError

    df = SimpleNamespace(write=SimpleNamespace(parquet=write))
    for rows, parts in ((100, "50"), (1 << 40, before[PARTS])):
        monkeypatch.setattr(domain, "PART_ROWS", rows)
        try:
            domain.Domain(spark, str(tmp_path))._write("procedure_term", df, "here")
        except RuntimeError:
            assert broken
        assert seen.pop() == (parts, domain.PART_BYTES, "here")
        assert {c: spark.conf.get(c, None) for c in (PARTS, BYTES)} == before
