"""Running results over series of any length, in two steps: no task holds a sensor.

A sensor's time is cut into chunks. Within a chunk a window function runs as usual; each chunk gives one summary (rows, breaks, first and last
known values), the summaries of a sensor are scanned in order of chunks, and what comes from the chunks before (or after) is added to the
rows. Rows are shuffled once, by sensor and chunk; summaries are a row per CHUNK_ROWS rows.

Chunks have equal widths in time and CHUNK_ROWS rows on average: a burst of readings makes a longer chunk, never a wrong result. Rows without a time are
a chunk of their own, before all others, as they come first in order of time. A sensor may be null: it is a series as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .columns import ROW, SENSOR, TIME

#: Rows of a chunk on average.
CHUNK_ROWS = 1 << 16
CHUNK, OWN = "__chunk", "__own"


def in_chunks(df: DataFrame, pieces: str | None = None) -> DataFrame:
    """``df`` with the number of each row's chunk; numbers rise with time. ``pieces``: a column for how many chunks the sensor may have."""
    at, n = F.unix_micros(TIME), F.greatest(F.ceil(F.count(TIME) / CHUNK_ROWS), F.lit(1))
    spans = df.groupBy(SENSOR).agg(F.min(at).alias("__low"), F.ceil((F.max(at) - F.min(at) + 1) / n).alias("__width"), (n + F.max(F.col(TIME).isNull().cast("int"))).alias("__pieces"))
    rows = df.join(spans.withColumnRenamed(SENSOR, "__sensor"), F.col(SENSOR).eqNullSafe(F.col("__sensor")))
    rows = rows.withColumn(CHUNK, F.floor((at - F.col("__low")) / F.col("__width"))).drop("__sensor", "__low", "__width")
    return rows.withColumnRenamed("__pieces", pieces) if pieces else rows.drop("__pieces")


def in_chunk() -> WindowSpec:
    """A chunk's rows in order of time."""
    return Window.partitionBy(SENSOR, CHUNK).orderBy(TIME, ROW)


def _over() -> WindowSpec:
    """A sensor's summaries in order."""
    return Window.partitionBy(SENSOR).orderBy(CHUNK)


def _earlier() -> WindowSpec:
    return _over().rowsBetween(Window.unboundedPreceding, -1)


def with_summary(rows: DataFrame, summaries: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their chunk's summary."""
    right = summaries.withColumnsRenamed({SENSOR: "__sensor", CHUNK: "__of"})
    return rows.join(right, F.col(SENSOR).eqNullSafe(F.col("__sensor")) & F.col(CHUNK).eqNullSafe(F.col("__of")), how).drop("__sensor", "__of")


def with_positions(df: DataFrame, total: str | None = None) -> DataFrame:
    """``idx``: position in the series, from 0; ``total``: a column for the series' length."""
    rows = in_chunks(df)
    sizes = rows.groupBy(SENSOR, CHUNK).agg(F.count(F.lit(1)).alias("__size"))
    sums = {"__before": F.coalesce(F.sum("__size").over(_earlier()), F.lit(0))}
    if total:
        sums[total] = F.sum("__size").over(Window.partitionBy(SENSOR))
    rows = with_summary(rows, sizes.withColumns(sums).drop("__size"))
    return rows.withColumn("idx", F.col("__before") + F.row_number().over(in_chunk()) - 1).drop("__before", CHUNK)


def in_frames(df: DataFrame, before: int, after: int) -> DataFrame:
    """Rows for frames of up to ``before`` rows back and ``after`` rows ahead: window functions over ``in_frame`` give OWN rows what they give over the whole series.

    Each row is in the chunk of its position, and as a copy in a neighbouring one that reaches it. Also has ``idx`` and the series' length ``__n``.
    """
    rows = with_positions(df, "__n")
    size = max(CHUNK_ROWS, before, after)
    own, at = F.floor(F.col("idx") / size), F.col("idx") % size
    part = lambda chunk, is_own: F.struct(chunk.alias("chunk"), F.lit(is_own).alias("own"))
    to = F.array(part(own, True), *([F.when((at < after) & (own > 0), part(own - 1, False))] if after else []), *([F.when((at >= size - before) & (F.col("idx") + 1 < F.col("__n")), part(own + 1, False))] if before else []))
    rows = rows.withColumn("__to", F.explode(F.array_compact(to)))
    return rows.withColumns({CHUNK: F.col("__to")["chunk"], OWN: F.col("__to")["own"]}).drop("__to")


def in_frame() -> WindowSpec:
    """A chunk's rows and the copies beside them, by position."""
    return Window.partitionBy(SENSOR, CHUNK).orderBy("idx")


def running_sum(df: DataFrame, col: str, name: str) -> DataFrame:
    """``name``: the sum of ``col`` up to and with each row."""
    rows = in_chunks(df)
    sums = rows.groupBy(SENSOR, CHUNK).agg(F.sum(col).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0))).drop("__sum")
    return with_summary(rows, sums).withColumn(name, F.col("__before") + F.sum(col).over(in_chunk().rowsBetween(Window.unboundedPreceding, 0))).drop("__before", CHUNK)


def number_breaks(df: DataFrame, is_break: Callable[[Column, Column], Column], cols: tuple[str, ...], total: str | None = None) -> DataFrame:
    """``seg_id``: breaks before each row; ``is_break``: there is one after the row.

    ``is_break`` is given a row and the next one as structs of ``cols``. ``total``: a column for the series' breaks.
    """
    known = lambda a, b: F.coalesce(is_break(a, b), F.lit(False))
    own, at = F.struct(*cols), F.struct(TIME, ROW)
    rows = in_chunks(df).withColumn("__next", F.lead(own).over(in_chunk())).withColumn("is_break", known(own, F.col("__next")))
    ends = rows.groupBy(SENSOR, CHUNK).agg(F.sum(F.col("is_break").cast("long")).alias("__breaks"), F.min_by(own, at).alias("__head"), F.max_by(own, at).alias("__tail"))
    ends = ends.withColumn("__following", F.lead("__head").over(_over())).withColumn("__edge", known(F.col("__tail"), F.col("__following")))
    ends = ends.withColumn("__all", F.col("__breaks") + F.col("__edge").cast("long"))
    sums = {"__before": F.coalesce(F.sum("__all").over(_earlier()), F.lit(0))}
    if total:
        sums[total] = F.sum("__all").over(Window.partitionBy(SENSOR))
    rows = with_summary(rows, ends.withColumns(sums).drop("__breaks", "__head", "__tail", "__following", "__all"))
    inner = F.coalesce(F.sum(F.col("is_break").cast("long")).over(in_chunk().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the chunk's last row has no next one in it; its break counts from the next chunk on
    rows = rows.withColumn("seg_id", (F.col("__before") + inner).cast("int")).withColumn("is_break", F.when(F.col("__next").isNull(), F.col("__edge")).otherwise(F.col("is_break")))
    return rows.drop("__next", "__before", "__edge", CHUNK)


def nearest_known(df: DataFrame, values: dict[str, Column], ahead: bool = False) -> DataFrame:
    """For each of ``values`` (name: expression) a column of its last known value at or before the row; with ``ahead``, also ``name_ahead``: the next one."""
    rows = in_chunks(df).withColumns({f"__{n}": v for n, v in values.items()})
    at = lambda n: F.when(F.col(f"__{n}").isNotNull(), F.struct(TIME, ROW))
    last = [F.max_by(f"__{n}", at(n)).alias(f"__last_{n}") for n in values]
    first = [F.min_by(f"__{n}", at(n)).alias(f"__first_{n}") for n in values] if ahead else []
    ends = rows.groupBy(SENSOR, CHUNK).agg(*last, *first)
    later = _over().rowsBetween(1, Window.unboundedFollowing)
    carried = [F.last(f"__last_{n}", ignorenulls=True).over(_earlier()).alias(f"__back_{n}") for n in values]
    carried += [F.first(f"__first_{n}", ignorenulls=True).over(later).alias(f"__on_{n}") for n in values] if ahead else []
    rows = with_summary(rows, ends.select(SENSOR, CHUNK, *carried))
    back, on = in_chunk().rowsBetween(Window.unboundedPreceding, 0), in_chunk().rowsBetween(0, Window.unboundedFollowing)
    out = {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(back), F.col(f"__back_{n}")) for n in values}
    if ahead:
        out |= {f"{n}_ahead": F.coalesce(F.first(f"__{n}", ignorenulls=True).over(on), F.col(f"__on_{n}")) for n in values}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])
