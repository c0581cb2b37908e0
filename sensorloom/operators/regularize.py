"""Regular grids, filling and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import CHANNELS, ROW, SENSOR, TIME, by_time, uniform
from ..functions.scans import nearest_known, running_sum, with_positions


def dedupe_time(df: DataFrame) -> DataFrame:
    """Of rows with one time the first of the file."""
    w = Window.partitionBy(SENSOR, TIME).orderBy(ROW)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def fill_time_grid(df: DataFrame, minutes: int = 10, cols: tuple[str, ...] = CHANNELS, max_fill_minutes: int | None = None) -> DataFrame:
    """Add rows every ``minutes`` within longer steps, counted from the step's start; their values are null.

    A grid time that meets the next row adds none. ``max_fill_minutes`` leaves longer outages empty.
    """
    step = F.expr(f"interval {minutes} minutes")
    rows = df.withColumn("__next", F.lead(TIME).over(by_time()))
    span = (F.unix_micros("__next") - F.unix_micros(TIME)) / F.lit(6e7)
    wide = (span > minutes) if max_fill_minutes is None else (span > minutes) & (span <= max_fill_minutes)
    grid = F.filter(F.sequence(F.col(TIME) + step, F.col("__next"), step), lambda t: t < F.col("__next"))
    new = rows.filter(wide).select(SENSOR, F.explode(grid).alias(TIME), ROW)
    blank = new.select(SENSOR, ROW, TIME, *[F.lit(None).cast("double").alias(c) for c in cols], F.lit(True).alias("is_filled"))
    return df.select(SENSOR, ROW, TIME, *cols, F.lit(False).alias("is_filled")).unionByName(blank)


def _between(df: DataFrame, cols: tuple[str, ...], place: Column) -> DataFrame:
    """Linear interpolation over ``place``; leading nulls stay, trailing ones take the last value."""
    rows = nearest_known(df, {f"__known_{c}": F.when(F.col(c).isNotNull(), F.struct(place.alias("p"), F.col(c).alias("v"))) for c in cols}, ahead=True)
    out = {}
    for c in cols:
        a, b = F.col(f"__known_{c}"), F.col(f"__known_{c}_ahead")
        line = a["v"] + (b["v"] - a["v"]) * (place - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), None).when(b.isNull(), a["v"]).otherwise(F.coalesce(line, a["v"]))
    return rows.withColumns(out).select(*df.columns)


def interpolate_time(df: DataFrame, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Fill nulls on the line over time between known neighbours."""
    return _between(df, cols, F.unix_micros(TIME))


def interpolate_linear(df: DataFrame, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Fill nulls on the line over position between known neighbours."""
    return _between(with_positions(df), cols, F.col("idx")).drop("idx")


def as_freq(df: DataFrame, minutes: int = 1, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """A grid from first to last time; only readings exactly on it keep their values."""
    step = F.expr(f"interval {minutes} minutes")
    grid = df.groupBy(SENSOR).agg(F.min(TIME).alias("a"), F.max(TIME).alias("z")).select(SENSOR, F.explode(F.sequence("a", "z", step)).alias(TIME))
    return grid.join(dedupe_time(df).select(SENSOR, TIME, ROW, *cols), [SENSOR, TIME], "left")


def forward_fill(df: DataFrame, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The last known value of the same sensor."""
    rows = nearest_known(df, {f"__known_{c}": F.col(c) for c in cols})
    return rows.withColumns({c: F.col(f"__known_{c}") for c in cols}).select(*df.columns)


def regular_times(df: DataFrame, start: str, minutes: int = 10) -> DataFrame:
    """Times ``start``, ``start`` + minutes, ... by position."""
    rows = with_positions(df)
    return rows.withColumn(TIME, F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("idx") * (minutes * 60_000_000)))


def jittered_times(df: DataFrame, start: str, base: int = 600, seed: int = 0) -> DataFrame:
    """Times whose steps are ``base`` seconds and a whole number of them from -10 to 9; the first is ``start``."""
    jump = F.when(F.col("idx") == 0, 0).otherwise(base + F.floor(20 * uniform(seed, SENSOR, "idx")) - 10)
    rows = running_sum(with_positions(df).withColumn("__jump", jump), "__jump", "__at")
    return rows.withColumn(TIME, F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("__at"))).drop("__jump", "__at")
