"""Limits, scaling and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import CHANNELS, SENSOR, by_time, coerce_numeric
from ..functions.quantiles import exact_quantiles

# Target ranges of synthetic channels.
RANGES = {"value_temp": (0.0, 30.0), "value_hum": (0.0, 100.0), "value_acid": (2.5, 4.0)}


def min_max(df: DataFrame, cols: tuple[str, ...] = CHANNELS, rollup: bool = False) -> DataFrame:
    """Limits of each channel per sensor; with ``rollup`` also those of all (sensor null), in one pass."""
    grouped = df.rollup(SENSOR) if rollup else df.groupBy(SENSOR)
    return grouped.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def _with_limits(df: DataFrame, limits: DataFrame, scope: str) -> DataFrame:
    # one row in all, or one per sensor: Spark broadcasts the side if it is small enough
    return df.crossJoin(F.broadcast(limits)) if scope == "global" else df.join(limits, SENSOR)


def limits_of(df: DataFrame, cols: tuple[str, ...], scope: str = "sensor") -> DataFrame:
    if scope not in ("sensor", "global"):
        raise ValueError(f"unknown scope: {scope}")
    grouped = df.groupBy() if scope == "global" else df.groupBy(SENSOR)
    return grouped.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def minmax_scale(df: DataFrame, cols: tuple[str, ...] = CHANNELS, scope: str = "sensor", limits: DataFrame | None = None) -> DataFrame:
    """Channels to [0, 1] by the limits of their sensor or of all; a constant channel is 0."""
    limits = limits_of(df, cols, scope) if limits is None else limits
    rows = _with_limits(df, limits, scope)
    scaled = {c: (F.col(c) - F.col(f"min_{c}")) / F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0)) for c in cols}
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.coalesce(v, F.lit(0.0))) for c, v in scaled.items()}).select(*df.columns)


def minmax_inverse(df: DataFrame, limits: DataFrame, cols: tuple[str, ...] = CHANNELS, scope: str = "sensor") -> DataFrame:
    """Scaled channels back to their limits."""
    rows = _with_limits(df, limits, scope)
    return rows.withColumns({c: F.col(c) * (F.col(f"max_{c}") - F.col(f"min_{c}")) + F.col(f"min_{c}") for c in cols}).select(*df.columns)


def rescale_to_range(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Channels shifted to begin at 0 and stretched to their target range."""
    ranges = ranges or RANGES
    rows = df.join(limits_of(df, tuple(ranges)), SENSOR)
    out = {}
    for c, (low, high) in ranges.items():
        span = F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0.0))
        out[c] = F.coalesce(F.greatest(F.col(c) - F.col(f"min_{c}"), F.lit(0.0)) / span, F.lit(0.0)) * (high - low) + low
    return rows.withColumns(out).select(*df.columns)


def channel_stats(df: DataFrame, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Least, largest, mean and sample deviation of each channel per sensor; text is read as numbers."""
    return coerce_numeric(df, list(cols)).groupBy(SENSOR).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))])


def describe_channel(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Count, mean, deviation, limits and quartiles; exact ones by counting in finer and finer ranges, or approximate ones in one pass."""
    at = dict(zip(("q25", "q50", "q75"), (0.25, 0.5, 0.75)))
    known = dict(zip(at, exact_quantiles(df, col, tuple(at.values())))) if exact else {}
    quartiles = {n: F.lit(known[n]).cast("double") if exact else F.percentile_approx(col, F.lit(q)) for n, q in at.items()}
    rows = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("low"), *[v.alias(n) for n, v in quartiles.items() if not exact], F.max(col).alias("high"))
    rows = rows.withColumns(quartiles) if exact else rows
    return rows.select("n", "mean", "std", "low", *at, "high")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in bins of equal width between the limits; the last bin holds its upper limit."""
    limits = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    rows = df.filter(F.col(col).isNotNull()).select(col).crossJoin(F.broadcast(limits))
    at = F.floor((F.col(col) - F.col("__lo")) / F.nullif((F.col("__hi") - F.col("__lo")) / bins, F.lit(0.0)))
    return rows.select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def label_share(df: DataFrame, label: str = "good", col: str = "label") -> DataFrame:
    """Rows, rows with a label and their percentage, per sensor."""
    n, hits = F.count(F.lit(1)), F.count_if(F.col(col) == label)
    return df.groupBy(SENSOR).agg(n.alias("n"), hits.alias("n_target"), (F.lit(100.0) * hits / n).alias("percent"))


def jump_thresholds(df: DataFrame, cols: tuple[str, ...] = ("value_temp", "value_hum", "value_acid"), k: float = 3.0) -> DataFrame:
    """Mean and ``k`` deviations of the absolute difference to the previous row, per sensor and channel."""
    rows = df.withColumns({f"__{c}": F.abs(F.col(c) - F.lag(c).over(by_time())) for c in cols})
    return rows.groupBy(SENSOR).agg(*[(F.avg(f"__{c}") + k * F.stddev_samp(f"__{c}")).alias(f"thr_{c.removeprefix('value_')}") for c in cols])


def flag_above_quantile(df: DataFrame, col: str, q: float = 0.95, exact: bool = True) -> DataFrame:
    """Rows over a quantile of the whole column."""
    cut = exact_quantiles(df, col, (q,))[0] if exact else df.agg(F.percentile_approx(col, F.lit(q))).first()[0]
    return df.withColumn("is_above", F.col(col) > F.lit(cut).cast("double"))


def class_counts(df: DataFrame, col: str = "label") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
