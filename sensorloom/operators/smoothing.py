"""Smoothing of channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.batches import matrix as _matrix, starts as _starts, whole_runs
from ..functions.columns import CHANNELS, ROW, SENSOR, TIME, to_long
from ..functions.kernels import HoltWinters, LevelSteps, kalman_runs, local_fits, lowess as _lowess, lowess_runs, savgol_weights
from ..functions import scans
from ..functions.quantiles import medians
from ..functions.scans import CHUNK, OWN, in_chunks, in_frame, in_frames, with_positions, with_summary
from ..sources.io import kept


def savgol(df: DataFrame, cols: tuple[str, ...] = ("value_temp", "value_hum", "value_acid"), window: int = 11, poly: int = 2, edge: str = "interp") -> DataFrame:
    """Savitzky-Golay: inside, a weighted sum of the window around a row; near the edges the fit of the first or last
    whole window is read at the row's place (``interp``), or the value is null (``null``). Series shorter than the window stay."""
    left = window // 2
    right = window - 1 - left
    rows = in_frames(df, window - 1, window - 1)
    w = in_frame()
    idx, n = F.col("idx"), F.col("__n")

    def fit(c: str, offset: int, at: float | None) -> Column:
        """The weighted sum over the window that starts ``offset`` rows from the row."""
        terms = [float(k) * (F.lead(c, offset + i).over(w) if offset + i >= 0 else F.lag(c, -(offset + i)).over(w)) for i, k in enumerate(savgol_weights(window, poly, at))]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    def smoothed(c: str) -> Column:
        value = F.when((idx >= left) & (idx < n - right), fit(c, -left, None))
        if edge == "interp":
            for p in range(left):
                value = value.when(idx == p, fit(c, -p, float(p)))
            for p in range(right):
                value = value.when(idx == n - 1 - p, fit(c, -(window - 1 - p), float(window - 1 - p)))
        return F.when(n < window, F.col(c)).otherwise(value)

    rows = rows.select(*[F.col(c) for c in df.columns if c not in cols], "idx", OWN, *[smoothed(c).alias(c) for c in cols])
    return rows.filter(OWN).drop(OWN)


def _per_series(df: DataFrame, cols: tuple[str, ...], smooth) -> DataFrame:
    """Apply a numpy function (rows x channels) to each series in order of time."""
    schema = f"{SENSOR} string, {TIME} timestamp, {ROW} long, " + ", ".join(f"{c} double" for c in cols)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([TIME, ROW])
        rows[list(cols)] = smooth(rows[list(cols)].to_numpy(float))
        return rows

    return df.select(SENSOR, TIME, ROW, *cols).groupBy(SENSOR).applyInPandas(run, schema)


def lowess(df: DataFrame, cols: tuple[str, ...] = CHANNELS, frac: float = 0.1, iters: int = 3, k: int | None = None) -> DataFrame:
    """Robust local linear smoothing over the row index, over the nearest ``frac`` of a series' known values or, for series of any length, ``k`` of them.

    A share of a series needs the whole of it in a task. With ``k``, series of up to a chunk of rows are smoothed many at a time, with all their iterations, where
    one shuffle brings them. Of longer ones, chunks of positions are fitted apart from each other.
    """
    if k is None:
        return _per_series(df, cols, lambda x: np.stack([_lowess(c, frac, iters) for c in x.T], axis=1))
    df = df.select(SENSOR, TIME, ROW, *[F.col(c).cast("double").alias(c) for c in cols])
    of = kept(df.groupBy(SENSOR).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > scans.CHUNK_ROWS).select(F.col(SENSOR).alias("__sensor")), "long")
    if of.isEmpty():
        return _lowess_of_short(df, cols, iters, k)
    same = F.col(SENSOR).eqNullSafe(F.col("__sensor"))
    return _lowess_of_short(df.join(of, same, "left_anti"), cols, iters, k).unionByName(_lowess_of_long(df.join(of, same, "left_semi"), cols, iters, k))


def _lowess_of_short(df: DataFrame, cols: tuple[str, ...], iters: int, k: int) -> DataFrame:
    """Whole series, as many as a batch of rows brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in whole_runs(batches, SENSOR):
            values = [lowess_runs(y, start, k, iters) for y in _matrix(rows, list(cols)).T]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (SENSOR, TIME, ROW)), *[pa.array(v, mask=np.isnan(v)) for v in values]], names=[SENSOR, TIME, ROW, *cols])

    return _in_order(df, SENSOR).mapInArrow(run, f"{SENSOR} string, {TIME} timestamp, {ROW} long, " + ", ".join(f"{c} double" for c in cols))


def _lowess_of_long(df: DataFrame, cols: tuple[str, ...], iters: int, k: int) -> DataFrame:
    """Chunks of positions, with copies of the ``k`` rows on both sides; the median residual of each series, which weighs the next fit, is counted in ranges."""
    own = F.struct(SENSOR, "channel")
    known = to_long(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = with_positions(known.select(own.alias(SENSOR), ROW, TIME, F.col("value").alias("y")), "n").select(F.col(SENSOR)[SENSOR].alias(SENSOR), F.col(SENSOR)["channel"].alias("channel"), ROW, TIME, "idx", "n", "y", F.lit(1.0).alias("robust"))
    rows, size = kept(rows, "lowess"), max(scans.CHUNK_ROWS, k)
    chunk, at = F.floor(F.col("idx") / size), F.col("idx") % size
    copies = F.array_compact(F.array(chunk, F.when(at < k, chunk - 1), F.when(at >= size - k, chunk + 1)))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", ignore_index=True)
        mine, n = part[part["idx"] // size == key[2]].copy(), int(part["n"].iloc[0])
        if n < 3:
            mine["fitted"] = mine["y"]
        elif len(mine):
            mine["fitted"] = local_fits(mine["idx"].to_numpy(), part["y"].to_numpy(), part["robust"].to_numpy(), int(part["idx"].iloc[0]), n, min(n, max(2, k)))
        else:
            mine["fitted"] = mine["y"]
        return mine.drop(columns=CHUNK)

    keys = (SENSOR, "channel")
    for i in range(iters + 1):
        parts = rows.withColumn(CHUNK, F.explode(copies)).groupBy(*keys, CHUNK)
        fitted = kept(parts.applyInPandas(fit, f"{SENSOR} string, channel string, {ROW} long, {TIME} timestamp, idx long, n long, y double, robust double, fitted double"), "lowess")
        if i == iters:
            break
        middle = medians(fitted.withColumn("off", F.abs(F.col("y") - F.col("fitted"))), keys, "off", kept).withColumnsRenamed({SENSOR: "__sensor", "channel": "__channel"})
        spread = 6 * F.col("median")
        weight = F.pow(F.greatest(1 - F.pow((F.col("y") - F.col("fitted")) / spread, F.lit(2.0)), F.lit(0.0)), F.lit(2.0))
        joined = fitted.join(middle, F.col(SENSOR).eqNullSafe(F.col("__sensor")) & (F.col("channel") == F.col("__channel")))
        # a series that is fitted exactly keeps its weights, and so its fit
        rows = kept(joined.withColumn("robust", F.when(spread > 1e-12, weight).otherwise(F.col("robust"))).select(*rows.columns), "lowess")
    wide = fitted.groupBy(SENSOR, ROW, TIME).pivot("channel", list(cols)).agg(F.first("fitted")).withColumnsRenamed({SENSOR: "__sensor", ROW: "__row", TIME: "__time"})
    same = F.col(SENSOR).eqNullSafe(F.col("__sensor")) & F.col(ROW).eqNullSafe(F.col("__row")) & F.col(TIME).eqNullSafe(F.col("__time"))
    return df.select(SENSOR, TIME, ROW).join(wide, same, "left").select(SENSOR, TIME, ROW, *cols)


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys``, those of a series in order of time."""
    return df.repartition(*keys).sortWithinPartitions(*keys, TIME, ROW)


def kalman_level(df: DataFrame, cols: tuple[str, ...] = CHANNELS, q: float = 0.01, r: float = 1.0, p0: float = 1.0) -> DataFrame:
    """Filtered level of each channel.

    Steps of the filter compose, so a chunk of a long series is summed up as one step (and, should nothing be known before it, as
    one state); the steps of a sensor's chunks in a row give the state before each chunk, and chunks are filtered apart from each other. Rows of
    many chunks are handled at once, a batch's last state is kept for the next batch.
    """
    mean, variance = [f"m_{c}" for c in cols], [f"p_{c}" for c in cols]
    rows = in_chunks(df.select(SENSOR, TIME, ROW, *[F.col(c).cast("double").alias(c) for c in cols]), "pieces")
    fields = [f"{f}_{c}" for f in "abcgj" for c in cols]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk, or part of it within a batch: all its steps as one, and the state it ends in if it is the first."""
        for batch in batches:
            if not batch.num_rows:
                continue
            start, y = _starts(batch, SENSOR, CHUNK), _matrix(batch, list(cols))
            last = np.flatnonzero(np.append(start[1:] != start[:-1], True))
            steps = LevelSteps.of(y, q, r).running(start)[last]
            none = np.full(y.shape, np.nan)
            ends = [x[last] for x in kalman_runs(y, start, q, r, p0, none, none)]
            at = pa.array(last)
            numbers = np.hstack([*steps.fields, *ends])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (SENSOR, CHUNK, TIME, ROW)), *[pa.array(x) for x in numbers.T]], names=[SENSOR, CHUNK, TIME, ROW, *fields, *mean, *variance])

    def states(parts: pd.DataFrame) -> pd.DataFrame:
        """The state before each chunk of a sensor."""
        parts = parts.sort_values([TIME, ROW], na_position="first")
        m, p, out = np.full(len(cols), np.nan), np.full(len(cols), np.nan), []
        steps = LevelSteps(*parts[fields].to_numpy().reshape(len(parts), 5, len(cols)).transpose(1, 0, 2))
        fresh = parts[mean].to_numpy(), parts[variance].to_numpy()
        for i in range(len(parts)):  # a row per chunk, or per batch of one
            out.append(np.append(m, p))
            _, m2, p2, *_ = LevelSteps.state(m, p).then(steps[i]).fields
            m, p = np.where(np.isnan(m), fresh[0][i], m2), np.where(np.isnan(p), fresh[1][i], p2)
        parts[mean + variance] = out
        return parts.drop_duplicates(CHUNK)[[SENSOR, CHUNK, *mean, *variance]]

    doubles = lambda names: ", ".join(f"{n} double" for n in names)
    long_ones = _in_order(rows.filter("pieces > 1").select(SENSOR, CHUNK, TIME, ROW, *cols), SENSOR, CHUNK)
    parts = long_ones.mapInArrow(sums, f"{SENSOR} string, {CHUNK} long, {TIME} timestamp, {ROW} long, {doubles(fields + mean + variance)}")
    before = parts.groupBy(SENSOR).applyInPandas(states, f"{SENSOR} string, {CHUNK} long, {doubles(mean + variance)}")
    held = with_summary(rows.drop("pieces"), before, "left")

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            start, y = _starts(batch, SENSOR, CHUNK), _matrix(batch, list(cols))
            m, p = _matrix(batch, mean), _matrix(batch, variance)
            first, last = (tuple(batch.column(c)[i].as_py() for c in (SENSOR, CHUNK)) for i in (0, batch.num_rows - 1))
            if first == key:  # the chunk goes on
                m[0], p[0] = state
            level, spread = kalman_runs(y, start, q, r, p0, m, p)
            key, state = last, (level[-1], spread[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (SENSOR, TIME, ROW)), *[pa.array(x, mask=np.isnan(x)) for x in level.T]], names=[SENSOR, TIME, ROW, *cols])

    return _in_order(held, SENSOR, CHUNK).mapInArrow(levels, f"{SENSOR} string, {TIME} timestamp, {ROW} long, {doubles(cols)}")


def holt_winters(df: DataFrame, cols: tuple[str, ...] = CHANNELS, season: int = 12, horizon: int = 12) -> DataFrame:
    """The next ``horizon`` steps of each channel by additive trend and season.

    A sensor's rows come sorted, a batch at a time, and only its smoothing state is kept: memory doesn't grow with its length. Its
    rows are smoothed one after the other, by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensor, smoothers = None, None

        def done() -> pa.RecordBatch:
            ahead = [s.ahead(horizon) for s in smoothers]
            return pa.RecordBatch.from_arrays([pa.array([sensor] * horizon, pa.string()), pa.array(np.arange(1, horizon + 1, dtype=np.int32)), *[pa.array(x, mask=np.isnan(x)) for x in ahead]], names=[SENSOR, "step", *cols])

        for batch in batches:
            start, y, names = _starts(batch, SENSOR), _matrix(batch, list(cols)), batch.column(SENSOR)
            heads = np.unique(start).tolist()
            for a, z in zip(heads, [*heads[1:], batch.num_rows]):
                name = names[a].as_py()
                if smoothers is None or name != sensor:
                    if smoothers is not None:
                        yield done()
                    sensor, smoothers = name, [HoltWinters(season) for _ in cols]
                for s, column in zip(smoothers, y[a:z].T):
                    s.add(column)
        if smoothers is not None:
            yield done()

    rows = df.select(SENSOR, TIME, ROW, *[F.col(c).cast("double").alias(c) for c in cols])
    return _in_order(rows, SENSOR).mapInArrow(run, f"{SENSOR} string, step int, " + ", ".join(f"{c} double" for c in cols))
