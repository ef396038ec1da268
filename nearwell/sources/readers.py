"""Batch readers. All are plain scans with a declared schema, so filters and columns push down."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearwell.session import materialize
from nearwell.sources import schemas


def scan_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BRONZE_FACILITY).parquet(path)


def scan_pin_directory(spark: SparkSession, path: str) -> DataFrame:
    """PIN directory rows whose PIN is six digits."""
    rows = spark.read.schema(schemas.PIN_DIRECTORY).parquet(path)
    return rows.filter(F.col("pincode").rlike("^[0-9]{6}$"))


def csv_records(spark: SparkSession, glob: str) -> DataFrame:
    """(file, pos, text): the records of all CSV files matching ``glob``; quoted fields may span lines.

    Files are split like any text: each block's quotes are counted, and their sum over the blocks
    before tells whether a line begins inside a quoted field. ``pos`` is the record's first line, from
    1. Blank lines between records are left out; line ends inside a field become ``\n``. A quote that
    is never closed makes one record of the rest of its file.
    """
    at = ["file", "block"]
    lines = materialize(spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value"), "csv-lines")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*at).agg(F.sum(quotes).alias("q"), F.count("*").alias("n")).select(
        *at, F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("quotes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"))
    inside = Window.partitionBy(*at).orderBy("id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.join(blocks, at).select(
        *at, "value", (F.col("lines_before") + F.row_number().over(inside)).alias("line"),
        ((F.col("quotes_before") + F.coalesce(F.sum(quotes).over(before), F.lit(0))) % 2 == 0).alias("begins"))
    first = F.when(F.col("begins"), F.col("line"))
    upto = Window.partitionBy(*at).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = materialize(marked.withColumn("pos", F.max(first).over(upto)), "csv-records")
    # a block that begins inside a record goes on with the last one begun before
    carried = marked.groupBy(*at).agg(F.max(first).alias("last")).select(
        *at, F.max("last").over(earlier).alias("carried"))
    rows = marked.join(carried, at).select(
        "file", F.coalesce("pos", "carried").alias("pos"), F.struct("line", "value").alias("l"))
    texts = rows.groupBy("file", "pos").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return texts.select("file", "pos", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias(
        "text")).where("text <> ''")


def scan_registry_csv(spark: SparkSession, glob: str, positions: bool = False) -> DataFrame:
    """All registry CSVs matching ``glob``, columns by the names in each file's header.

    A column that a file or a record lacks is null, and one that the registry doesn't know is left
    out. A large file is many tasks, quoted line ends included. With ``positions`` the rows carry
    ``file`` and ``pos``, in whose order the files were written.
    """
    records = materialize(csv_records(spark, glob), "csv")
    head = records.groupBy("file").agg(F.min("pos").alias("pos")).join(records, ["file", "pos"])
    width = head.agg(F.max(F.size(F.split("text", ",")))).first()[0] or 1
    names = [f"c{i}" for i in range(width)]

    def fields(c: str):
        parsed = F.from_csv(F.col(c), ", ".join(f"{n} string" for n in names), {"escape": '"', "multiLine": "true"})
        return F.transform(F.array(parsed), lambda p: F.array(*(p[n] for n in names)))[0]

    head = head.select("file", F.col("pos").alias("_first"), F.reverse(fields("text")).alias("_names"))
    rows = records.join(head, "file").where("pos > _first").withColumn("_fields", fields("text"))

    def column(name: str):  # of columns named alike, the last
        place = F.array_position("_names", F.lit(name))
        return F.when(place > 0, F.try_element_at("_fields", (F.size("_names") - place + 1).cast("int"))).alias(name)

    columns = [f.split()[0] for f in schemas.REGISTRY.split(",")]
    return rows.select(*map(column, columns), *(["file", "pos"] if positions else []))
