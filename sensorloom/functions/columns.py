"""Column expressions and window specs shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

SENSOR, TIME, ROW = "sensor_id", "time", "row_no"
CHANNELS = ("value_temp", "value_hum", "value_acid", "value_PV")


def by_time(*keys: str) -> WindowSpec:
    """Rows of one sensor (or segment) in order of time; the row number of the file breaks ties."""
    return Window.partitionBy(*(keys or (SENSOR,))).orderBy(TIME, ROW)


def whole(*keys: str) -> WindowSpec:
    """All rows of one sensor (or segment)."""
    return Window.partitionBy(*(keys or (SENSOR,)))


def with_idx(df: DataFrame, *keys: str) -> DataFrame:
    """``idx``: position in the series, from 0."""
    return df.withColumn("idx", F.row_number().over(by_time(*keys)) - 1)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from ``start`` to ``end`` to the microsecond, as double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, cut to whole ones."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A repeatable number in [0, 1) from the MD5 of keys; the same however rows are partitioned, and in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def parse_time(df: DataFrame, col: str = TIME) -> DataFrame:
    """ISO-8601 text with ``Z`` to a timestamp (session time zone UTC); what can't be read becomes null."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def format_time(df: DataFrame, col: str = TIME) -> DataFrame:
    """A timestamp as ISO-8601 text with ``Z``."""
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` itself if it has all of ``cols``; else an error that names the missing ones."""
    if missing := sorted(set(cols) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what isn't a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def time_features(df: DataFrame) -> DataFrame:
    """Hour and day of the year."""
    return df.withColumns({"hour": F.hour(TIME), "day_of_year": F.dayofyear(TIME)})


def select_channels(df: DataFrame, names: dict[str, str], keys: tuple[str, ...] = (SENSOR, TIME)) -> DataFrame:
    """Keys and chosen channels under new names, in the given order."""
    return df.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])


def encode_label(df: DataFrame, mapping: dict[str, int] | None = None, col: str = "label") -> DataFrame:
    """Labels as numbers; labels without one become null."""
    code = F.lit(None).cast("int")
    for name, value in (mapping or {"error": 0, "good": 1}).items():
        code = F.when(F.col(col) == name, value).otherwise(code)
    return df.withColumn(f"{col}_code", code)


def trim_edges(df: DataFrame, k: int = 50) -> DataFrame:
    """Drop the first and last ``k`` rows of each series."""
    from .scans import with_positions

    return with_positions(df, "__n").filter((F.col("idx") >= k) & (F.col("idx") < F.col("__n") - k)).drop("__n")


def filter_long_segments(df: DataFrame, min_len: int = 1000) -> DataFrame:
    """Segments with more than ``min_len`` rows."""
    return df.withColumn("__n", F.count(F.lit(1)).over(whole(SENSOR, "seg_id"))).filter(F.col("__n") > min_len).drop("__n")


def drop_incomplete_series(df: DataFrame, cols: list[str]) -> DataFrame:
    """Series without any null in ``cols``."""
    holes = F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNull().cast("int")
    return df.withColumn("__holes", F.max(holes).over(whole())).filter("__holes = 0").drop("__holes")


def slice_range(df: DataFrame, start: int, end: int, inclusive_start: bool = False) -> DataFrame:
    """Rows with start < idx < end, or [start, end) with ``inclusive_start``."""
    low = F.col("idx") >= start if inclusive_start else F.col("idx") > start
    return df.filter(low & (F.col("idx") < end))


def clip(df: DataFrame, col: str, lower: float = 0.0) -> DataFrame:
    """No value under ``lower``; nulls stay."""
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.col(col), F.lit(lower))))


def to_long(df: DataFrame, cols: tuple[str, ...] = CHANNELS, keys: tuple[str, ...] = (SENSOR, ROW, TIME)) -> DataFrame:
    """One row per channel and time."""
    return df.unpivot(list(keys), list(cols), "channel", "value")


def to_wide(df: DataFrame, cols: tuple[str, ...] = CHANNELS, keys: tuple[str, ...] = (SENSOR, ROW, TIME)) -> DataFrame:
    """One column per channel."""
    return df.groupBy(*keys).pivot("channel", list(cols)).agg(F.first("value"))


def base_name(col: Column, suffixes: tuple[str, ...] = ("_CLEAN", "_GENERATED", "_TEMP_FORECAST")) -> Column:
    """A file's name without folder, known suffix and extension."""
    name = F.regexp_replace(F.regexp_extract(col, "([^/]+)$", 1), "\\.csv$", "")
    return F.regexp_replace(name, f"({'|'.join(suffixes)})$", "")
