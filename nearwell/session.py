"""Session settings and shared scratch space."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merge the sessions of a hot key map-side before they are shuffled
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # streaming state on the executors' disks, as timers and large state need it
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings that results (time zone) and hot keys (skew joins) rely on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of shuffle partitions.

    For stages whose work per byte is high: a plain shuffle of few bytes would be coalesced into a
    task or two.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir.

    Only a local session without that setting falls back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="nearwell-")
    return f"{base.rstrip('/')}/nearwell/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for what is run inside; the ones before come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


# shuffle files go with the job that wrote them, not when the driver happens to collect its garbage
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back (runs a job).

    Unlike a cache, the files survive the loss of executors, and later plans start from them. The shuffle
    files of the job are removed once it is done.
    """
    path = scratch_path(df.sparkSession, name)
    with settings(df.sparkSession, FREE_SHUFFLES):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame):
    """Delete the files of materialized tables that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
