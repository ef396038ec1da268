"""A keyed table in hash buckets, each a folder of its own version; merged by batches."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` under ``path``, dealt by a hash of ``keys`` into buckets.

    A commit is one small file with a row per bucket that holds data: the folder of that bucket's
    rows, and the last batch of each writer. It appears whole, after the data it names. Readers take
    the newest commit and read its folders, so nothing is replayed and a half-written merge is never
    seen. One job writes a table at a time.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType

    COMMIT = "seq long, buckets int, bucket int, folder string, done map<string, bigint>"

    def _commit(self) -> tuple[int, int, dict[int, str], dict[str, int]]:
        """(seq, buckets, folder of each bucket, last batch of each writer) of the newest commit."""
        try:
            log = self.spark.read.schema(self.COMMIT).parquet(f"{self.path}/commits")
            last = log.agg(F.max("seq")).first()[0]
        except AnalysisException:  # no such folder yet
            last = None
        if last is None:
            return 0, 0, {}, {}
        rows = log.where(F.col("seq") == last).collect()  # a row per bucket
        return (last, rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["folder"]},
                rows[0]["done"])

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        """Write rows as a new version of their buckets; the folders of those that hold any."""
        top = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names, self._bucket(buckets).alias("bucket"))
        # a large bucket is several files, a small one is one
        dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{top}")
        found = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])) \
            .parquet(f"{self.path}/{top}").select("bucket").distinct().collect()
        return {r["bucket"]: f"{top}/bucket={r['bucket']}" for r in found}

    def _put(self, seq: int, buckets: int, folders: dict[int, str], done: dict[str, int]) -> None:
        rows = [(seq, buckets, b, f, done) for b, f in folders.items()] or [(seq, buckets, 0, None, done)]
        self.spark.createDataFrame(rows, self.COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits")

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in sorted(folders)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows of the newest commit."""
        return self._rows(self._commit()[2].values())

    def last_batch(self, writer: str) -> int:
        """The last batch that this writer has merged, -1 before any."""
        return self._commit()[3].get(writer, -1)

    def replace(self, rows: DataFrame, buckets: int = BUCKETS) -> None:
        """All rows anew, in ``buckets`` buckets (choose them so that a bucket is a few files).

        Writers' batches stay done. Also the way to more buckets: ``table.replace(table.read(), n)``.
        """
        seq, _, _, done = self._commit()
        self._put(seq + 1, buckets, self._write(rows, buckets), done)

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame],
              writer: str, batch: int) -> list[int]:
        """``apply(rows, changes)`` on the buckets that the changes touch; returns those.

        ``apply`` keeps every row's bucket: it may only add, change or drop rows of changed keys. A
        batch that this writer has done already changes nothing. Changes without a whole key are left
        out. A failed merge leaves files that no commit names.
        """
        seq, buckets, folders, done = self._commit()
        if not buckets:
            raise ValueError(f"no table at {self.path}: replace() makes one")
        if batch <= done.get(writer, -1):
            return []
        own = changes.dropna(subset=list(self.keys))
        touched = [r[0] for r in own.select(self._bucket(buckets)).distinct().collect()]
        before = self._rows(folders[b] for b in touched if b in folders)
        new = self._write(apply(before, own).select(*self.schema.names), buckets) if touched else {}
        kept = {b: f for b, f in folders.items() if b not in touched}
        self._put(seq + 1, buckets, kept | new, done | {writer: batch})
        return sorted(touched)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the bucket folders that none of the last ``keep`` commits name; how many went.

        Jobs that still read an older commit fail then, so keep as many as run at a time.
        """
        log = self.spark.read.schema(self.COMMIT).parquet(f"{self.path}/commits")
        last = self._commit()[0]
        named = log.where("folder IS NOT NULL").groupBy("folder").agg(F.max("seq").alias("seq"))
        old = [r["folder"] for r in named.where(F.col("seq") <= last - keep).collect()]
        jvm = self.spark._jvm
        for folder in old:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(old)
