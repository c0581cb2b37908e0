"""Error labels by range, jump and outage, and labels of windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ROW, SENSOR, TIME, by_time, minutes_between, uniform, with_idx

# A reading outside these limits is an error.
RANGE_RULES = {"value_temp": (-15.0, 50.0), "value_acid": (3.0, 9.5), "value_hum": (7.5, 90.0)}


def out_of_range(rules: dict[str, tuple[float, float]] | None = None) -> Column:
    """True if any channel lies outside its limits."""
    return reduce(lambda a, b: a | b, [(F.col(c) < low) | (F.col(c) > high) for c, (low, high) in (rules or RANGE_RULES).items()])


def label_by_range(df: DataFrame, rules: dict[str, tuple[float, float]] | None = None, skip_first: bool = True) -> DataFrame:
    """``error`` outside the limits, else ``good``; the first row of a series is ``good`` with ``skip_first``."""
    bad = F.coalesce(out_of_range(rules), F.lit(False))
    if skip_first:
        bad &= F.row_number().over(by_time()) > 1
    return df.withColumn("label", F.when(bad, "error").otherwise("good"))


def _jumps(thresholds: DataFrame) -> Column:
    w = by_time()
    names = [c.removeprefix("thr_") for c in thresholds.columns if c.startswith("thr_")]
    over = [F.abs(F.col(f"value_{n}") - F.lag(f"value_{n}").over(w)) > F.col(f"thr_{n}") for n in names]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in over]) | (F.col("value_hum") > 100), F.lit(False))


def label_by_jump(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``1`` where a channel jumps by more than its sensor's threshold or humidity is over 100, else ``0``.

    Sensors without thresholds are left out.
    """
    return df.join(thresholds, SENSOR).withColumn("label", F.when(_jumps(thresholds), "1").otherwise("0")).select(*df.columns, "label")


def label_by_gap(df: DataFrame, minutes: float = 15) -> DataFrame:
    """``error`` after an outage; other labels stay (``0`` where there is none)."""
    late = minutes_between(F.lag(TIME).over(by_time()), F.col(TIME)) > minutes
    other = F.col("label") if "label" in df.columns else F.lit("0")
    return df.withColumn("label", F.when(late, "error").otherwise(other))


def add_manual_labels(errors: DataFrame, windows: DataFrame, window: int = 20) -> DataFrame:
    """Errors (sensor_id, channel, idx) and those in the middle of marked windows (sensor_id, channel, start)."""
    new = windows.select(SENSOR, "channel", (F.col("start") + window // 2).cast("int").alias("idx"))
    return errors.select(SENSOR, "channel", "idx").unionByName(new).distinct()


def merge_errors(*tables: DataFrame) -> DataFrame:
    """(sensor_id, idx) that any table names."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(SENSOR, "idx") for t in tables]).distinct()


def label_reach(window: int = 20, bias: float = 2) -> tuple[int, int]:
    """How many positions before and after a window's own an error marks it.

    Window i is marked by errors e with i - h < e <= i + h; a half h starts and ends on whole positions.
    """
    half = window / 2 - bias
    return int(half // 1) - 1, int(-(-half // 1))


def label_windows(df: DataFrame, errors: DataFrame, window: int = 20, bias: float = 2, drop_last: bool = True) -> DataFrame:
    """1 for windows i with max(0, e - h) <= i < min(e + h, n - window) for an error e, where h = window / 2 - bias.

    The reach of an error is a frame over positions, so nothing is joined by range.
    """
    rows = with_idx(df).join(errors.select(SENSOR, "idx", F.lit(1).alias("__e")).distinct(), [SENSOR, "idx"], "left")
    before, after = label_reach(window, bias)
    frame = Window.partitionBy(SENSOR).orderBy("idx").rowsBetween(-before, after)
    rows = rows.withColumn("label", F.coalesce(F.max("__e").over(frame), F.lit(0)).cast("double")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(SENSOR)))
    return rows.filter(F.col("idx") < F.col("__n") - window + (0 if drop_last else 1)).select(SENSOR, "idx", "label")


def inject_errors(df: DataFrame, cols: tuple[str, ...], p: float = 0.05, low: float = 50, high: float = 200, seed: int = 0) -> DataFrame:
    """Each cell with probability ``p`` is multiplied by 1 + U(low, high) percent; ``is_error_*`` keeps the truth."""
    out: dict[str, Column] = {}
    for c in cols:
        hit = uniform(seed, SENSOR, ROW, F.lit(c)) < p
        grow = 1 + (F.lit(low) + (high - low) * uniform(seed + 1, SENSOR, ROW, F.lit(c))) / 100
        out[f"is_error_{c}"] = hit
        out[c] = F.when(hit, F.col(c) * grow).otherwise(F.col(c))
    return df.withColumns(out)
