"""Seasonal decomposition and synthetic series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import CHANNELS, ROW, SENSOR, TIME, by_time, uniform, whole, with_idx
from ..functions.scans import with_positions
from .segments import mean_step

#: Buckets that sensors are numbered in.
BUCKETS = 1024


def daily_period(df: DataFrame) -> DataFrame:
    """Points per day: whole part of 1440 over the mean step."""
    return mean_step(df).select(SENSOR, F.floor(F.lit(1440.0) / F.nullif("mean_step", F.lit(0.0))).alias("period"))


def decompose(df: DataFrame, col: str, period: int) -> DataFrame:
    """Additive trend, seasonal and resid; trend is null in the first and last period // 2 rows."""
    half = period // 2
    w = by_time()
    rows = with_idx(df).withColumn("__n", F.count(F.lit(1)).over(whole()))
    inner = F.sum(col).over(w.rowsBetween(-half, half))
    if period % 2 == 0:  # period + 1 points, the outer ones by half
        inner = inner - (F.lag(col, half).over(w) + F.lead(col, half).over(w)) / 2
    full = (F.col("idx") >= half) & (F.col("idx") < F.col("__n") - half)
    rows = rows.withColumn("trend", F.when(full, inner / period)).withColumn("phase", F.pmod("idx", F.lit(period)))
    by_phase = rows.groupBy(SENSOR, "phase").agg(F.avg(F.col(col) - F.col("trend")).alias("__mean"))
    by_phase = by_phase.withColumn("seasonal", F.col("__mean") - F.avg("__mean").over(whole())).drop("__mean")
    rows = rows.join(by_phase, [SENSOR, "phase"])
    return rows.withColumn("resid", F.col(col) - F.col("trend") - F.col("seasonal")).drop("__n")


def block_bootstrap(parts: DataFrame, copies: int = 5, block: int = 100, seed: int = 0) -> DataFrame:
    """Synthetic copies of decomposed series: trend, a rising line, and seasonal and residual blocks from any sensor.

    Source blocks are chosen by hash among all sensors' and fetched by an equi-join on their rows.
    """
    rows = parts.select(SENSOR, "idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trend", "seasonal", "resid")])
    sizes = rows.groupBy(SENSOR).agg(F.count(F.lit(1)).alias("n"))
    # sensors are numbered within hash buckets, of which there are few
    ranked = sizes.withColumn("bucket", F.pmod(F.xxhash64(SENSOR), F.lit(BUCKETS)))
    buckets = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("bucket", before.alias("before"), F.sum("held").over(Window.partitionBy()).alias("m"))
    ranked = ranked.join(F.broadcast(buckets), "bucket").withColumn("no", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy(SENSOR)) - 1)
    blocks = ranked.select(SENSOR, "n", "m", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("block"))
    pick = lambda s, m: F.pmod(F.xxhash64(SENSOR, "copy", "block", F.lit(seed + s)), m)
    blocks = blocks.withColumn("source_no", pick(0, F.col("m")))
    source = ranked.select(F.col("no").alias("source_no"), F.col(SENSOR).alias("source"), F.col("n").alias("source_n"))
    blocks = blocks.join(source, "source_no").withColumn("start", pick(1, F.greatest(F.col("source_n") - block, F.lit(1))))
    target = rows.select(SENSOR, "idx", "trend", F.expr(f"idx div {block}").alias("block")).join(blocks, [SENSOR, "block"])
    target = target.withColumn("from_idx", F.pmod(F.col("start") + F.pmod("idx", F.lit(block)), F.col("source_n")))
    given = rows.select(F.col(SENSOR).alias("source"), F.col("idx").alias("from_idx"), "seasonal", "resid")
    line = F.col("idx") / F.greatest(F.col("n") - 1, F.lit(1))
    return target.join(given, ["source", "from_idx"]).select(SENSOR, "copy", "idx", (F.col("trend") + line + F.col("seasonal") + F.col("resid") + F.col("copy")).alias("value"))


def shuffle_components(parts: DataFrame, parts_per_series: int = 20, seed: int = 0) -> DataFrame:
    """Trend, cubed seasonal values and rooted residuals; the latter two in random order within stretches of the series."""
    rows = parts.select(SENSOR, "idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trend", "seasonal", "resid")])
    rows = rows.withColumn("stretch", F.floor(F.col("idx") / F.greatest(F.floor(F.count(F.lit(1)).over(whole()) / parts_per_series), F.lit(1))))
    mixed = F.pow("seasonal", F.lit(3.0)) + F.signum("resid") * F.sqrt(F.abs("resid"))
    order = Window.partitionBy(SENSOR, "stretch")
    places = rows.select(SENSOR, "stretch", "idx", "trend", F.row_number().over(order.orderBy("idx")).alias("at"))
    values = rows.select(SENSOR, "stretch", F.row_number().over(order.orderBy(F.xxhash64(SENSOR, "idx", F.lit(seed)), "idx")).alias("at"), mixed.alias("mixed"))
    return places.join(values, [SENSOR, "stretch", "at"]).select(SENSOR, "idx", (F.col("trend") + F.col("mixed")).alias("value"))


def synthesize(df: DataFrame, n: int, seed: int = 0, noise: float = 0.05, start: str = "2024-01-01 00:00:00", minutes: int = 10, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """``n`` rows per sensor in the shape of its data: rows drawn by hash, with noise in the channel's range, on a clock."""
    rows = with_idx(df).select(SENSOR, "idx", *cols)
    limits = rows.groupBy(SENSOR).agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in cols])
    draws = limits.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("idx", F.pmod(F.xxhash64(SENSOR, "draw", F.lit(seed)), F.col("n")).cast("int"))
    shake = lambda c: noise * F.col(f"span_{c}") * (2 * uniform(seed + 1, SENSOR, "draw", F.lit(c)) - 1)
    clock = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("draw") * (60 * minutes))
    return draws.join(rows, [SENSOR, "idx"]).select(SENSOR, F.col("draw").cast("long").alias(ROW), clock.alias(TIME), *[(F.col(c) + shake(c)).alias(c) for c in cols])


def synthesize_sequences(df: DataFrame, n: int, size: int = 24, overlap: int = 6, seed: int = 0, start: str = "2024-01-01 00:00:00", minutes: int = 10, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """``n`` rows per sensor out of whole windows of its data, so that neighbouring rows go on as they do there; on a clock.

    Windows of ``size`` rows are drawn by hash; each fades in over the last ``overlap`` rows of the one before, all channels alike. Windows are fetched by an
    equi-join on sensor and position. A sensor with fewer rows is gone round; an unknown value within a window makes the row's channel unknown.
    """
    if not 0 <= overlap <= size // 2:
        raise ValueError("overlap must be at most half of a window")
    step = size - overlap
    rows = with_positions(df, "__n").select(SENSOR, "idx", *cols)
    sizes = rows.groupBy(SENSOR).agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // step))))
    blocks = blocks.withColumn("start", F.floor(uniform(seed, SENSOR, "block") * F.greatest(F.col("n") - size + 1, F.lit(1))))
    places = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("place", F.col("block") * step + F.col("at")).filter(F.col("place") < n)
    fade_in = F.when((F.col("at") < overlap) & (F.col("block") > 0), (F.col("at") + 1) / (overlap + 1)).otherwise(1.0)
    last = F.col("block") == (n - 1) // step
    weight = F.when((F.col("at") >= step) & ~last, 1 - (F.col("at") - step + 1) / (overlap + 1)).otherwise(fade_in)
    places = places.withColumn("weight", weight).withColumn("idx", F.pmod(F.col("start") + F.col("at"), F.col("n")))
    whole_value = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col("weight") * F.col(c))).alias(c)
    made = places.join(rows, [SENSOR, "idx"]).groupBy(SENSOR, "place").agg(*[whole_value(c) for c in cols])
    clock = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("place") * (60 * minutes))
    return made.select(SENSOR, F.col("place").cast("long").alias(ROW), clock.alias(TIME), *cols)
