"""Gaps, segments and islands of sensor series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import CHANNELS, ROW, SENSOR, TIME, by_time, minutes_between, whole, whole_seconds, with_idx
from ..functions.scans import number_breaks, with_positions


def add_step(df: DataFrame) -> DataFrame:
    """Minutes to the previous and to the next row."""
    w = by_time()
    t = F.col(TIME)
    return df.withColumns({"step_prev": minutes_between(F.lag(TIME).over(w), t), "step_next": minutes_between(t, F.lead(TIME).over(w))})


def time_breaks(df: DataFrame, max_minutes: float = 30) -> DataFrame:
    """Rows after which more than ``max_minutes`` pass; seconds are cut before the comparison."""
    w = by_time()
    rows = with_idx(df).withColumn("next_time", F.lead(TIME).over(w))
    return rows.filter(whole_seconds(F.col(TIME), F.col("next_time")) > max_minutes * 60).select(SENSOR, "idx", TIME, "next_time")


def _numbered(df: DataFrame, is_break, cols: tuple[str, ...], drop_tail: bool) -> DataFrame:
    """``seg_id``: breaks before the row; the break row ends its segment. ``is_break`` stays as a column."""
    rows = number_breaks(df, is_break, cols, "__n" if drop_tail else None)
    return rows.filter("seg_id < __n").drop("__n") if drop_tail else rows


def split_segments(df: DataFrame, max_minutes: float = 30, drop_tail: bool = False) -> DataFrame:
    """Number the segments between outages."""
    return _numbered(df, lambda row, following: whole_seconds(row[TIME], following[TIME]) > max_minutes * 60, (TIME,), drop_tail).drop("is_break")


def split_by_jump(df: DataFrame, col: str = "value_PV", threshold: float = 3.0, drop_break_row: bool = True, drop_tail: bool = False) -> DataFrame:
    """Number the segments between jumps of a value; the row before a jump belongs to no segment."""
    rows = _numbered(df, lambda row, following: F.abs(row[col] - following[col]) > threshold, (col,), drop_tail)
    return (rows.filter(~F.col("is_break")) if drop_break_row else rows).drop("is_break")


def gap_report(df: DataFrame, threshold_minutes: float = 15) -> DataFrame:
    """Gaps longer than the threshold with the 1-based rows of the file on both sides."""
    rows = df.withColumn("file_row", F.row_number().over(Window.partitionBy(SENSOR).orderBy(ROW)).cast("long"))
    w = by_time()
    gaps = rows.select(
        SENSOR, F.lag("file_row").over(w).alias("start_row"), F.lag(TIME).over(w).alias("start_time"), F.col("file_row").alias("end_row"), F.col(TIME).alias("end_time"), ROW,
    ).filter(minutes_between(F.col("start_time"), F.col("end_time")) > threshold_minutes)
    number = F.row_number().over(Window.partitionBy(SENSOR).orderBy("end_time", ROW))
    return gaps.withColumn("gap_no", number).drop(ROW)


def check_max_step(df: DataFrame, max_minutes: float = 20) -> DataFrame:
    """Per segment: no step is longer than the limit (true for one row)."""
    step = minutes_between(F.col(TIME), F.lead(TIME).over(by_time(SENSOR, "seg_id")))
    return df.withColumn("__step", step).groupBy(SENSOR, "seg_id").agg(F.coalesce(F.bool_and(F.col("__step") <= max_minutes), F.lit(True)).alias("is_regular"))


def mean_step(df: DataFrame, *by: str, whole_secs: bool = False) -> DataFrame:
    """Mean minutes between rows, per sensor or segment; optionally of steps cut to whole seconds."""
    keys = by or (SENSOR,)
    following = F.lead(TIME).over(by_time(*keys))
    step = whole_seconds(F.col(TIME), following) / 60 if whole_secs else minutes_between(F.col(TIME), following)
    return df.withColumn("__step", step).groupBy(*keys).agg(F.avg("__step").alias("mean_step"))


def missing_between_segments(df: DataFrame) -> DataFrame:
    """Points missing between a segment and the next: whole minutes of the gap over the left mean step."""
    following = F.lead(TIME).over(by_time(SENSOR, "seg_id"))
    stepped = df.withColumn("__step", whole_seconds(F.col(TIME), following) / 60)
    per = stepped.groupBy(SENSOR, "seg_id").agg(F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"), F.avg("__step").alias("mean_step"))
    gap = F.floor(minutes_between(F.col("last_time"), F.lead("first_time").over(Window.partitionBy(SENSOR).orderBy("seg_id"))))
    return per.withColumn("gap_minutes", gap).filter(F.col("gap_minutes").isNotNull()).select(
        SENSOR, "seg_id", "mean_step", "gap_minutes", F.floor(F.col("gap_minutes") / F.nullif("mean_step", F.lit(0.0))).alias("n_missing"),
    )


def connect_segments(df: DataFrame, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Each pair of neighbouring segments, scaled together to [0, 1], with the missing points between.

    part 1: the left segment, 2: points put in on the line between the ends, 3: the right segment.
    """
    sides = F.explode(F.array(F.struct(F.col("seg_id").alias("pair"), F.lit(1).alias("part")), F.struct((F.col("seg_id") - 1).alias("pair"), F.lit(3).alias("part"))))
    last = df.withColumn("__last", F.max("seg_id").over(whole()))
    rows = last.withColumn("__side", sides).select(SENSOR, "__side.*", "__last", TIME, ROW, *cols).filter((F.col("pair") >= 0) & (F.col("pair") < F.col("__last")))
    rows = with_idx(rows, SENSOR, "pair", "part").withColumn("k", F.col("idx") + 1)
    ends = df.groupBy(SENSOR, "seg_id").agg(*[F.max_by(c, F.struct(TIME, ROW)).alias(f"end_{c}") for c in cols], *[F.min_by(c, F.struct(TIME, ROW)).alias(f"begin_{c}") for c in cols])
    w = Window.partitionBy(SENSOR).orderBy("seg_id")
    ends = ends.select(SENSOR, "seg_id", *[f"end_{c}" for c in cols], *[F.lead(f"begin_{c}").over(w).alias(f"next_{c}") for c in cols])
    holes = missing_between_segments(df).filter("n_missing > 0").join(ends, [SENSOR, "seg_id"])
    holes = holes.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_missing").cast("int"))))
    between = holes.select(
        SENSOR, F.col("seg_id").alias("pair"), F.lit(2).alias("part"), "k",
        *[(F.col(f"end_{c}") + F.col("k") * (F.col(f"next_{c}") - F.col(f"end_{c}")) / (F.col("n_missing") + 1)).alias(c) for c in cols],
    )
    limits = rows.groupBy(SENSOR, "pair").agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])
    every = rows.select(SENSOR, "pair", "part", "k", *cols).unionByName(between).join(limits, [SENSOR, "pair"])
    return every.select(SENSOR, "pair", "part", "k", *[F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols])


def next_diff(df: DataFrame, col: str) -> DataFrame:
    """Difference to the next row; 0 in the last."""
    return df.withColumn("next_diff", F.coalesce(F.col(col) - F.lead(col).over(by_time()), F.lit(0.0)))


def prediction_spans(preds: DataFrame, stretch: int = 30) -> DataFrame:
    """(start, stop, is_good) spans from rows (sensor_id, idx, pred): outliers (-1) at most ``stretch`` rows apart join.

    A bad span reaches ``stretch`` rows over its last outlier, up to the end of the series.
    """
    sizes = preds.groupBy(SENSOR).agg((F.max("idx") + 1).alias("n"))
    w = Window.partitionBy(SENSOR).orderBy("idx")
    bad = preds.filter("pred = -1").withColumn("new", F.coalesce((F.col("idx") - F.lag("idx").over(w) > stretch).cast("int"), F.lit(1)))
    bad = bad.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = bad.groupBy(SENSOR, "island").agg(F.min("idx").alias("start"), F.max("idx").alias("last")).join(sizes, SENSOR)
    bad = bad.select(SENSOR, "start", F.least(F.col("last") + stretch + 1, F.col("n")).alias("stop"), "n")
    # the good span before each bad one, and the one after the last
    before = bad.select(SENSOR, F.coalesce(F.lag("stop").over(Window.partitionBy(SENSOR).orderBy("start")), F.lit(0)).alias("start"), F.col("start").alias("stop"))
    after = sizes.join(bad.groupBy(SENSOR).agg(F.max("stop").alias("start")), SENSOR, "left").select(SENSOR, F.coalesce("start", F.lit(0)).alias("start"), F.col("n").alias("stop"))
    good = before.unionByName(after).filter("start < stop").withColumn("is_good", F.lit(True))
    return bad.select(SENSOR, "start", "stop", F.lit(False).alias("is_good")).unionByName(good)


def segment_bounds(df: DataFrame) -> DataFrame:
    """Where each segment starts in its series, and how many rows it has."""
    return with_positions(df).groupBy(SENSOR, "seg_id").agg(F.min("idx").alias("start_idx"), F.count(F.lit(1)).alias("n_rows"))


def segment_summary(df: DataFrame, max_minutes: float = 30, cols: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Per segment: rows, first and last time, limits of channels, and points missing up to the next segment."""
    rows = split_segments(df, max_minutes)
    per = rows.groupBy(SENSOR, "seg_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"),
        *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))],
    )
    return per.join(missing_between_segments(rows).select(SENSOR, "seg_id", "n_missing"), [SENSOR, "seg_id"], "left")
