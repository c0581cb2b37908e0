"""Forecasts by trend and seasonal terms, fitted per series.

The sums that least squares needs (X'X and X'y) are added up over shards of a series, so no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.batches import matrix, whole_runs
from ..functions.columns import SENSOR, TIME, to_long
from ..functions.kernels import fourier_features, ridge_of_runs, ridge_of_sums
from ..sources.io import kept

DAY = 1440.0
#: Rows of a shard, and shards of a series at most (beyond them shards grow, their features are made in slices).
SHARD, SHARDS = 65_536, 1024
SLICE = 8192


def _sums(rows: DataFrame, keys: tuple[str, ...], periods: dict[float, int], extra: tuple[str, ...]) -> DataFrame:
    """(keys, shard, n, gram): sums of products of the features and the target of rows (keys, at, scale, y, extra, shards).

    ``gram`` is [X | y]' [X | y] row by row.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        scale, total = part["scale"].iloc[0], 0.0
        for low in range(0, len(part), SLICE):
            few = part.iloc[low : low + SLICE]
            x = np.hstack([fourier_features(few["at"].to_numpy(float), periods, scale), few[[*extra, "y"]].to_numpy(float)])
            total = total + x.T @ x
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "shard": [key[-1]], "n": [len(part)], "gram": [total.reshape(-1)]})

    shard = F.pmod(F.xxhash64(*keys, "at"), F.col("shards")).cast("int").alias("shard")
    schema = ", ".join(f"{k} string" for k in keys) + ", shard int, n long, gram array<double>"
    return rows.select(*keys, shard, "at", "scale", "y", *extra).groupBy(*keys, "shard").applyInPandas(run, schema)


def _spans(rows: DataFrame, keys: tuple[str, ...], last) -> DataFrame:
    """(keys, start, scale, shards, end): where a series' known rows start, their minutes, its shards and its last time."""
    minutes = (F.unix_micros(F.max("known")) - F.unix_micros(F.min("known"))) / 6e7
    shards = F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.ceil(F.count("known") / SHARD))).cast("int")
    return rows.groupBy(*keys).agg(F.min("known").alias("start"), F.greatest(minutes, F.lit(1.0)).alias("scale"), shards.alias("shards"), last.alias("end")).filter("start IS NOT NULL")


def _whole(sums: DataFrame, spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, gram, and what ``spans`` has): the sums of a series' shards."""
    # SHARDS rows of a series at most, added up by place in the order of shards
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("shard", "gram"))), lambda s: s["gram"])
    total = F.aggregate(F.slice(ordered, 2, SHARDS), F.element_at(ordered, 1), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), total.alias("gram")).join(spans, [*keys])


def _fitted(sums: DataFrame, spans: DataFrame, keys: tuple[str, ...], value: str, horizon: int, minutes: int, periods: dict[float, int], extra: tuple[str, ...]) -> DataFrame:
    """(keys, time, value) of the steps after each series' end; future ``extra`` features keep the value of ``spans``."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups:
            for r in rows.itertuples(index=False):
                width = int(round(len(r.gram) ** 0.5))
                fitted = ridge_of_sums(np.reshape(r.gram, (width, width)), r.n)
                ahead = pd.Series(r.end + pd.to_timedelta(minutes * np.arange(1, horizon + 1), unit="m"))
                x = fourier_features(((ahead - r.start) / pd.Timedelta(minutes=1)).to_numpy(float), periods, r.scale)
                held = np.tile(np.array([getattr(r, c) for c in extra], float), (horizon, 1))
                yield pd.DataFrame({**{k: getattr(r, k) for k in keys}, TIME: ahead, value: np.hstack([x, held]) @ fitted})

    schema = ", ".join(f"{k} string" for k in keys) + f", {TIME} timestamp, {value} double"
    return _whole(sums, spans, keys).select(*keys, "n", "gram", "start", "scale", "end", *extra).mapInPandas(run, schema)


def _model_schema(cols: tuple[str, ...]) -> str:
    return f"{SENSOR} string, " + ", ".join(f"start_{c} long, end_{c} long, fitted_{c} array<double>" for c in cols)


def _models(df: DataFrame, cols: tuple[str, ...], periods: dict[float, int]) -> DataFrame:
    """(sensor_id; start, end and fitted for each channel): the first and last known time, in microseconds, and coefficients; null where nothing is known.

    Sensors of up to SHARD rows are fitted many at a time, where one shuffle brings their rows. Of longer ones sums are added up over shards.
    """
    rows = df.filter(F.col(SENSOR).isNotNull() & F.col(TIME).isNotNull()).select(SENSOR, TIME, *[F.col(c).cast("double").alias(c) for c in cols])
    of = kept(rows.groupBy(SENSOR).count().filter(F.col("count") > SHARD).select(SENSOR), "long")
    if of.isEmpty():
        return _models_of_short(rows, cols, periods)
    return _models_of_short(rows.join(of, SENSOR, "left_anti"), cols, periods).unionByName(_models_of_long(rows.join(of, SENSOR, "left_semi"), cols, periods))


def _models_of_short(rows: DataFrame, cols: tuple[str, ...], periods: dict[float, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start in whole_runs(batches, SENSOR):
            at, values = batch.column("at").to_numpy(), matrix(batch, list(cols))
            heads, series = np.unique(start, return_inverse=True)
            known, found = ~np.isnan(values), {}
            while len(found) < len(cols):  # channels that are known at the same times have the same features
                first = next(j for j in range(len(cols)) if j not in found)
                alike = [j for j in range(first, len(cols)) if j not in found and (known[:, j] == known[:, first]).all()]
                here = known[:, first]
                t, of = at[here], series[here]
                sizes = np.bincount(of, minlength=len(heads))
                some = sizes > 0
                begins = (np.cumsum(sizes) - sizes)[some]
                low, high = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
                if len(begins):
                    low[some], high[some] = np.minimum.reduceat(t, begins), np.maximum.reduceat(t, begins)
                fitted = ridge_of_runs((t - low[of]) / 6e7, values[here][:, alike], begins, sizes[some], np.maximum((high - low)[some] / 6e7, 1.0), periods)
                for i, j in enumerate(alike):
                    coefficients = iter(fitted[:, :, i])
                    lists = [next(coefficients) if x else None for x in some]
                    found[j] = [pa.array(low, mask=~some), pa.array(high, mask=~some), pa.array(lists, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(SENSOR).take(pa.array(heads)), *[a for j in range(len(cols)) for a in found[j]]], names=[SENSOR, *[f"{f}_{c}" for c in cols for f in ("start", "end", "fitted")]])

    dealt = rows.select(SENSOR, F.unix_micros(TIME).alias("at"), *cols).repartition(SENSOR).sortWithinPartitions(SENSOR, "at", *cols)
    return dealt.mapInArrow(run, _model_schema(cols))


def _models_of_long(rows: DataFrame, cols: tuple[str, ...], periods: dict[float, int]) -> DataFrame:
    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups:
            for r in rows.itertuples(index=False):
                width = int(round(len(r.gram) ** 0.5))
                yield pd.DataFrame({SENSOR: [r.sensor_id], "channel": [r.channel], "start": [r.start], "end": [r.end], "fitted": [ridge_of_sums(np.reshape(r.gram, (width, width)), r.n)]})

    keys = (SENSOR, "channel")
    series = to_long(rows, cols, (SENSOR, TIME)).filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, F.col(TIME).alias("known"), F.col("value").alias("y"))
    spans = _spans(series, keys, F.max("known"))
    sums = _sums(series.join(spans, [*keys]).withColumn("at", (F.unix_micros("known") - F.unix_micros("start")) / 6e7), keys, periods, ())
    whole = _whole(sums, spans, keys).select(*keys, "n", "gram", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))
    found = whole.mapInPandas(run, f"{SENSOR} string, channel string, start long, end long, fitted array<double>")
    # a row for each channel of a long series
    return found.groupBy(SENSOR).agg(*[F.max(F.when(F.col("channel") == c, F.col(f))).alias(f"{f}_{c}") for c in cols for f in ("start", "end", "fitted")])


def _ahead(models: DataFrame, cols: tuple[str, ...], horizon: int, minutes: int, periods: dict[float, int], side_by_side: bool) -> DataFrame:
    """The next ``horizon`` steps of each channel: rows (sensor_id, channel, time, value), or the times that all channels have with a column for each."""
    step = minutes * 60_000_000
    names = [SENSOR, TIME, *cols] if side_by_side else [SENSOR, "channel", TIME, "value"]
    schema = ", ".join(f"{n} {'timestamp' if n == TIME else 'string' if n in (SENSOR, 'channel') else 'double'}" for n in names)

    def features(times: np.ndarray, start: int, end: int) -> np.ndarray:
        return fourier_features((times - start) / 6e7, periods, max((end - start) / 6e7, 1.0))

    def together(own: list) -> Iterator[tuple]:
        """(times, values)"""
        last, first = max(m[1] for m in own), min(m[1] for m in own)
        n = horizon - (last - first) // step
        if n <= 0 or any((last - m[1]) % step for m in own):
            return
        times, made = last + step * np.arange(1, n + 1), {}
        for m in own:
            if m[:2] not in made:
                made[m[:2]] = features(times, *m[:2])
        yield times, [made[m[:2]] @ m[2] for m in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []  # (row, channel, times, values)
            columns = [(batch.column(f"start_{c}").to_pylist(), batch.column(f"end_{c}").to_pylist(), batch.column(f"fitted_{c}")) for c in cols]
            for i in range(batch.num_rows):
                own = [(s[i], e[i], f[i].values.to_numpy()) if s[i] is not None else None for s, e, f in columns]
                if side_by_side:
                    held += [(i, None, t, v) for t, v in together(own)] if all(own) else []
                else:
                    made: dict[tuple, np.ndarray] = {}
                    for c, m in zip(cols, own):
                        if m is not None:
                            times = m[1] + step * np.arange(1, horizon + 1)
                            if m[:2] not in made:
                                made[m[:2]] = features(times, *m[:2])
                            held.append((i, c, times, [made[m[:2]] @ m[2]]))
                if sum(len(h[2]) for h in held) >= SLICE or i + 1 == batch.num_rows and held:
                    size = [len(h[2]) for h in held]
                    keys = [batch.column(SENSOR).take(pa.array(np.repeat([h[0] for h in held], size)))]
                    if not side_by_side:
                        keys.append(pa.array([h[1] for h in held]).take(pa.array(np.repeat(np.arange(len(held)), size))))
                    times = pa.array(np.concatenate([h[2] for h in held])).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([*keys, times, *[pa.array(np.concatenate(v)) for v in zip(*[h[3] for h in held])]], names=names)
                    held = []

    return models.mapInArrow(run, schema)


def fourier_forecast(df: DataFrame, cols: tuple[str, ...] = ("value_temp", "value_hum", "value_acid"), horizon: int = 1000, minutes: int = 10, daily: int = 15, weekly: int = 10) -> DataFrame:
    """(sensor_id, channel, time, value) for the next ``horizon`` steps of each channel; unknown values and times are left out."""
    periods = {DAY: daily, 7 * DAY: weekly}
    return _ahead(_models(df, cols, periods), cols, horizon, minutes, periods, False)


def fourier_forecasts(df: DataFrame, cols: tuple[str, ...] = ("value_temp", "value_hum", "value_acid"), horizon: int = 1000, minutes: int = 10, daily: int = 15, weekly: int = 10) -> DataFrame:
    """What ``combine_forecasts`` makes of a ``fourier_forecast`` for each channel, from models side by side: no forecast is shuffled."""
    periods = {DAY: daily, 7 * DAY: weekly}
    return _ahead(_models(df, cols, periods), cols, horizon, minutes, periods, True)


def regressor_forecast(df: DataFrame, target: str = "value_PV", regressors: tuple[str, ...] = ("value_temp", "value_hum", "value_acid"), horizon: int = 1460, minutes: int = 10) -> DataFrame:
    """The target's next steps from trend, seasons and regressors; unknown regressors keep their last value, future ones too.

    Trend and seasons count from the sensor's first time.
    """
    periods, keys = {DAY: 4, 7 * DAY: 3, 365.25 * DAY: 3}, (SENSOR,)
    held = Window.partitionBy(SENSOR).orderBy(TIME, *regressors).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.last(F.when(~F.isnan(c), F.col(c)), ignorenulls=True).over(held) for c in regressors}
    rows = df.filter(F.col(TIME).isNotNull()).select(SENSOR, F.col(TIME).alias("known"), F.col(TIME), F.col(target).alias("y"), *[c.alias(n) for n, c in known.items()])
    last = [F.max_by(c, TIME).alias(c) for c in regressors]
    ends = rows.groupBy(SENSOR).agg(*last)
    spans = _spans(rows, keys, F.max("known")).join(ends, SENSOR)
    use = F.col("y").isNotNull() & ~F.isnan("y")
    for c in regressors:
        use = use & F.col(c).isNotNull()
    fit = rows.filter(use).join(spans.select(SENSOR, "start", "scale", "shards"), SENSOR).withColumn("at", (F.unix_micros("known") - F.unix_micros("start")) / 6e7)
    return _fitted(_sums(fit, keys, periods, regressors), spans, keys, target, horizon, minutes, periods, regressors)


def combine_forecasts(temp: DataFrame, hum: DataFrame, acid: DataFrame) -> DataFrame:
    """Rows that all three forecasts have, side by side."""
    named = [d.select(SENSOR, TIME, F.col("value").alias(n)) for d, n in ((temp, "value_temp"), (hum, "value_hum"), (acid, "value_acid"))]
    return named[0].join(named[1], [SENSOR, TIME]).join(named[2], [SENSOR, TIME])


def combine_channels(forecast: DataFrame, channels: tuple[str, ...] = ("value_temp", "value_hum", "value_acid")) -> DataFrame:
    """The same from one long table: one shuffle in place of two joins."""
    wide = forecast.groupBy(SENSOR, TIME).pivot("channel", list(channels)).agg(F.first("value"))
    return wide.dropna(subset=list(channels))
