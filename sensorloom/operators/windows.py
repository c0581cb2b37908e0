"""Sliding windows as samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import SENSOR
from ..functions.scans import CHUNK, OWN, in_frame, in_frames, with_positions

SAMPLE = ("value_temp", "value_hum", "value_acid")


def flat_features(size: int, cols: tuple[str, ...] = SAMPLE) -> Column:
    """The next ``size`` values of each channel, channel by channel, over rows of ``in_frames``."""
    frame = in_frame().rowsBetween(0, size - 1)
    return F.concat(*[F.collect_list(c).over(frame) for c in cols])


def sliding_windows(df: DataFrame, size: int = 30, cols: tuple[str, ...] = SAMPLE, layout: str = "flat", drop_last: bool = False, within: str | None = None, stride: int = 1) -> DataFrame:
    """Windows of ``size`` rows: ``features``, channel by channel (flat) or row by row (rows).

    within: a column that windows don't cross, such as seg_id. drop_last leaves out the last window.
    """
    if layout not in ("flat", "rows"):
        raise ValueError(f"unknown layout: {layout}")
    rows = in_frames(df, 0, size - 1)
    if layout == "flat":
        features = flat_features(size, cols)
    else:
        features = F.collect_list(F.array(*cols)).over(in_frame().rowsBetween(0, size - 1))
    rows = rows.withColumn("features", features).filter(OWN)
    if within:  # positions within the segment; segments are runs of rows
        ends = rows.groupBy(F.col(SENSOR).alias("__sensor"), F.col(within).alias("__seg")).agg(F.min("idx").alias("__start"), F.count(F.lit(1)).alias("__size"))
        rows = rows.join(ends, F.col(SENSOR).eqNullSafe(F.col("__sensor")) & F.col(within).eqNullSafe(F.col("__seg")))
        rows = rows.withColumns({"idx": F.col("idx") - F.col("__start"), "__n": F.col("__size")})
    last = F.col("__n") - size - (1 if drop_last else 0)
    keys = (SENSOR, within) if within else (SENSOR,)
    return rows.filter((F.col("idx") <= last) & (F.col("idx") % stride == 0)).select(*keys, F.col("idx").cast("int").alias("idx"), "features")


def with_target(windows: DataFrame) -> DataFrame:
    """The last row of a rows window as its target."""
    return windows.withColumn("target", F.element_at("features", -1))


def moving_average(df: DataFrame, col: str, size: int = 30, divide_by: str = "size") -> DataFrame:
    """Mean over [i - h + 1, i + h], h = size / 2; over [0, i + h - 1] in the first h rows.

    The sum is divided by ``size`` at the edges too, or by the rows present (``count``).
    """
    half = size // 2
    w = in_frame()
    inner, edge = w.rowsBetween(-(half - 1), half), w.rowsBetween(-(half - 1), half - 1)
    rows = in_frames(df, half - 1, half)
    total = F.when(F.col("idx") < half, F.sum(col).over(edge)).otherwise(F.sum(col).over(inner))
    n = F.lit(size) if divide_by == "size" else F.when(F.col("idx") < half, F.count(col).over(edge)).otherwise(F.count(col).over(inner))
    return rows.withColumn("moving_average", total / n).filter(OWN).drop("__n", CHUNK, OWN)


def take_first(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each series."""
    return with_positions(df).filter(F.col("idx") < n)


def take_last(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    return with_positions(df, "__n").filter(F.col("idx") >= F.col("__n") - n).drop("__n")


def temporal_split(df: DataFrame, n: int = 1500) -> DataFrame:
    """``split``: train for the first ``n`` rows of each series, else test."""
    return with_positions(df).withColumn("split", F.when(F.col("idx") < n, "train").otherwise("test"))


def flatten_window(windows: DataFrame) -> DataFrame:
    """A rows window as one flat array."""
    return windows.withColumn("features", F.flatten("features"))


def unflatten_window(windows: DataFrame, size: int, cols: tuple[str, ...] = SAMPLE) -> DataFrame:
    """A flat window as rows again: one column per channel, ``step`` counts within the window."""
    parts = F.arrays_zip(*[F.slice("features", i * size + 1, size).alias(c) for i, c in enumerate(cols)])
    rows = windows.select(SENSOR, "idx", F.posexplode(parts).alias("step", "row"))
    return rows.select(SENSOR, "idx", "step", *[F.col("row")[c].alias(c) for c in cols])


def chunked(df: DataFrame, bucket_seconds: int, halo: int) -> DataFrame:
    """Long series cut into time chunks that also hold the last ``halo`` rows before and first after them.

    ``chunk`` is the cut, ``is_own`` tells a chunk's own rows from copies. Frames of up to ``halo`` rows computed per
    (sensor_id, chunk) equal those of the whole series, and no task holds a whole sensor. Chunks must
    hold at least ``halo`` rows, or be next to one that does.
    """
    rows = df.withColumn("chunk", F.floor(F.unix_timestamp("time") / bucket_seconds))
    up, down = Window.partitionBy(SENSOR, "chunk").orderBy("time", "row_no"), Window.partitionBy(SENSOR, "chunk").orderBy(F.desc("time"), F.desc("row_no"))
    ranked = rows.withColumn("__up", F.row_number().over(up)).withColumn("__down", F.row_number().over(down))
    present = rows.select(SENSOR, "chunk").distinct()
    near = Window.partitionBy(SENSOR).orderBy("chunk")
    ends = present.select(SENSOR, "chunk", F.lag("chunk").over(near).alias("before"), F.lead("chunk").over(near).alias("after"))
    ranked = ranked.join(ends, [SENSOR, "chunk"])
    to = F.array_compact(F.array(
        F.struct(F.col("chunk").alias("chunk"), F.lit(True).alias("is_own")),
        F.when((F.col("__up") <= halo) & F.col("before").isNotNull(), F.struct(F.col("before").alias("chunk"), F.lit(False).alias("is_own"))),
        F.when((F.col("__down") <= halo) & F.col("after").isNotNull(), F.struct(F.col("after").alias("chunk"), F.lit(False).alias("is_own"))),
    ))
    return ranked.withColumn("__to", F.explode(to)).select(*df.columns, "__to.chunk", "__to.is_own")
