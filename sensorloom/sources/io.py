"""Reading and writing sensor files, metrics and client updates."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import CHANNELS, SENSOR, base_name, parse_time

UPDATE = "round int, client_id string, layer int, weights array<double>"
READING = "time string, " + ", ".join(f"{c} double" for c in CHANNELS)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Jobs within remove their shuffle files when they end, as nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, leaves no shuffle files."""
    path = shared_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_readings(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """All sensor files of a folder; the sensor is the file's base name, or its folder's where ``write_readings`` made one.

    ``row_no`` grows with the place in the file.
    Spark cuts large files: a row's number joins the start of its cut and its place in it.
    """
    rows = spark.read.schema(READING).option("header", True).option("pathGlobFilter", glob).csv(path)
    rows = rows.select("*", "_metadata.file_name", "_metadata.file_block_start")
    numbered = rows.withColumn("row_no", F.col("file_block_start") * (1 << 20) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sensor = F.col(SENSOR).cast("string") if SENSOR in rows.columns else base_name(F.col("file_name"))
    return parse_time(numbered.withColumn(SENSOR, sensor)).drop("file_name", "file_block_start")


def read_picked(spark: SparkSession, path: str, suffix: str = "_CLEAN.csv") -> DataFrame:
    """Sensor files of a folder whose name ends with ``suffix``; the sensor is what stands before it.

    A file may be a folder of parts, as Spark writes it; only those that fit are listed. Folders of a table partitioned by ``file`` are read likewise.
    """
    rows = spark.read.schema(READING).option("header", True).csv(f"{path.rstrip('/')}/*{suffix}")
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), f"([^/=]+){re.escape(suffix)}(/[^/]*)?$", 1)
    return parse_time(rows.withColumn(SENSOR, name)).select(SENSOR, "time", *CHANNELS)


def union_readings(*tables: DataFrame) -> DataFrame:
    """All rows of several tables, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_readings(df: DataFrame, path: str, fmt: str = "csv", files_per_sensor: int = 1) -> None:
    """One folder per sensor. More than one file per sensor spreads a long series over tasks."""
    keys = [F.col(SENSOR)] if files_per_sensor == 1 else [F.col(SENSOR), F.pmod(F.xxhash64("row_no"), F.lit(files_per_sensor))]
    writer = df.repartition(*keys).sortWithinPartitions(SENSOR, "time").write.partitionBy(SENSOR)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Add training metrics to a table."""
    df.write.mode("append").parquet(path)


def parse_updates(df: DataFrame, col: str = "body") -> DataFrame:
    """Client updates ``{"weights": [...]}`` as arrays; what isn't such JSON becomes null."""
    return df.withColumn("weights", F.from_json(col, "struct<weights: array<double>>")["weights"])


def read_updates(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Client updates (round, client_id, layer, weights, body, is_malformed) from files of one JSON value per line.

    With ``files_per_trigger`` as a stream that takes so many files at once. A body that isn't such JSON, or that lacks a key or a number, is
    malformed: ``well_formed`` and ``malformed`` set both kinds apart.
    """
    lines = spark.read.text(path) if files_per_trigger is None else spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    rows = lines.withColumnRenamed("value", "body").withColumn("u", F.from_json("body", UPDATE)).select("u.*", "body")
    whole = F.forall("weights", lambda w: w.isNotNull() & ~F.isnan(w))
    known = F.col("round").isNotNull() & F.col("client_id").isNotNull() & F.col("layer").isNotNull() & F.col("weights").isNotNull()
    return rows.withColumn("is_malformed", ~F.coalesce(known & whole, F.lit(False)))


def well_formed(updates: DataFrame) -> DataFrame:
    return updates.filter(~F.col("is_malformed")).select("round", "client_id", "layer", "weights")


def malformed(updates: DataFrame) -> DataFrame:
    return updates.filter("is_malformed").select("body")


def format_updates(df: DataFrame) -> DataFrame:
    """The wire form of client updates."""
    return df.withColumn("body", F.to_json(F.struct("round", "client_id", "layer", "weights")))
