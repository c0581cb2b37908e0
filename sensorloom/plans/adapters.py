"""The given tables seen as sensor data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as readings: one sensor per user."""
    return as_readings(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_readings(events: DataFrame) -> DataFrame:
    """The same for a table or a stream of events."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("user_id").cast("string").alias("sensor_id"), F.col("event_id").alias("row_no"), F.col("ts").cast("timestamp").alias("time"),
        F.col("value").alias("value_temp"), k.alias("value_hum"), (k / 10.0).alias("value_acid"), (F.col("value") / 10.0).alias("value_PV"),
    )


#: The same in DuckDB, as the CTE r; i adds position and neighbours.
R = """r AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, event_id AS row_no, ts AS time, value AS value_temp,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value_hum, CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(10 AS DOUBLE) AS value_acid,
 value / CAST(10 AS DOUBLE) AS value_PV FROM events)"""
I = R + """, i AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY sensor_id) AS n, lag(time) OVER w AS prev, lead(time) OVER w AS next
 FROM r WINDOW w AS (PARTITION BY sensor_id ORDER BY time, row_no))"""
#: Segments at steps over a day.
S = I + """, b AS (SELECT *, coalesce((epoch_us(next) - epoch_us(time)) // 1000000 > 86400, false) AS brk FROM i),
 s AS (SELECT *, CAST(coalesce(sum(brk::INT) OVER (PARTITION BY sensor_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_id FROM b)"""


def readings_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with every third temperature and every fifth humidity of the file unknown."""
    return readings(spark, sf_dir).withColumns({
        "value_temp": F.when(F.col("row_no") % 3 != 0, F.col("value_temp")), "value_hum": F.when(F.col("row_no") % 5 != 0, F.col("value_hum")),
    })


def line_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as readings: one sensor per supplier; times aren't unique."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("sensor_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("row_no"), F.col("l_shipdate").cast("timestamp").alias("time"),
        F.col("l_quantity").cast("double").alias("value_temp"), (F.col("l_discount").cast("double") * 1000).alias("value_hum"),
        (F.col("l_tax").cast("double") * 100).alias("value_acid"), (F.col("l_extendedprice").cast("double") / 1000).alias("value_PV"),
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as client updates: one round per label."""
    return as_updates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def as_updates(embeddings: DataFrame) -> DataFrame:
    """The same for a table or a stream of embeddings."""
    return embeddings.select(
        F.col("label").alias("round"), F.col("vec_id").cast("string").alias("client_id"), F.lit(0).alias("layer"), (1 + F.col("vec_id") % 7).alias("n"),
        F.col("embedding").cast("array<double>").alias("weights"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as truth and prediction; the score mixes both marks with the id."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.lit("all").alias("sensor_id"), F.col("doc_id").alias("idx"), quality.alias("y_true"), toxic.alias("y_pred"),
        ((F.col("doc_id") % 10) / 20.0 + quality * 0.25 + toxic * 0.2 + 0.02).alias("score"),
    )


P = """p AS (SELECT doc_id AS idx, quality AS y_true, toxic AS y_pred,
 CAST(doc_id % 10 AS DOUBLE) / CAST(20 AS DOUBLE) + quality * CAST(0.25 AS DOUBLE) + toxic * CAST(0.2 AS DOUBLE) + CAST(0.02 AS DOUBLE) AS score FROM labels)"""
