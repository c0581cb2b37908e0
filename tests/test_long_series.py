"""One sensor with a third of all rows or more, cut into chunks: the same as over whole series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from sensorloom.functions import columns as C, scans
from sensorloom.operators import decompose as D, regularize as G, segments as S, smoothing as SM, windows as W

START = dt.datetime(2024, 1, 1)
SCHEMA = "sensor_id string, row_no long, time timestamp, value_temp double, value_PV double"


@pytest.fixture(scope="module")
def long_series(spark):
    """A long sensor with bursts, outages, equal times and nulls, some short ones, a null sensor and rows without a time."""
    r, rows = random.Random(3), []
    for sensor, n in (("long", 600), ("a", 40), ("b", 1), (None, 60)):
        at = START
        for i in range(n):
            at += dt.timedelta(seconds=r.choice((0, 1, 5, 600, 600, 1800, 1801, 9000)))
            rows.append((sensor, len(rows) * 7 % 1009 + 1009 * len(rows), at if r.random() > 0.02 else None, r.choice((None, None, r.random() * 9)), r.choice((0.0, 1.0, 9.0, None))))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(params=[50, 7, 1 << 16])
def chunked(request, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK_ROWS", request.param)


def rows_of(df, *cols):
    return sorted(df.select("row_no", *cols).collect(), key=lambda r: r["row_no"])


def test_positions(long_series, chunked):
    whole = C.with_idx(long_series).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sensor_id")))
    assert rows_of(scans.with_positions(long_series, "n"), "idx", "n") == rows_of(whole, "idx", "n")
    assert rows_of(W.take_last(long_series, 5), "idx") == rows_of(whole.filter("idx >= n - 5"), "idx")


def test_segments(long_series, chunked):
    w = C.by_time()
    for cut, got in (
        (C.whole_seconds(F.col("time"), F.lead("time").over(w)) > 1800, S.split_segments(long_series)),
        (F.abs(F.col("value_PV") - F.lead("value_PV").over(w)) > 3, S.split_by_jump(long_series, drop_break_row=False)),
    ):
        want = long_series.withColumn("b", F.coalesce(cut, F.lit(False)).cast("int"))
        want = want.withColumn("seg_id", F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        assert rows_of(got, "seg_id") == rows_of(want, "seg_id")
    tail = S.split_segments(long_series, drop_tail=True)
    top = rows_of(want, "seg_id") and S.split_segments(long_series).groupBy("sensor_id").agg(F.max("seg_id").alias("top")).collect()
    assert {r["sensor_id"]: r["m"] for r in tail.groupBy("sensor_id").agg((F.max("seg_id") + 1).alias("m")).collect()} == {r["sensor_id"]: r["top"] for r in top if r["top"]}


def test_fills(long_series, chunked):
    w = C.by_time()
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = long_series.withColumn("value_temp", F.last("value_temp", ignorenulls=True).over(back))
    assert rows_of(G.forward_fill(long_series, ("value_temp",)), "value_temp") == rows_of(want, "value_temp")
    place = C.with_idx(long_series)
    known = F.when(F.col("value_temp").isNotNull(), F.struct(F.col("idx").alias("p"), F.col("value_temp").alias("v")))
    pairs = {r["row_no"]: r for r in place.select("row_no", "idx", "value_temp", F.last(known, ignorenulls=True).over(back).alias("a"), F.first(known, ignorenulls=True).over(ahead).alias("b")).collect()}
    for r in G.interpolate_linear(long_series, ("value_temp",)).collect():
        x = pairs[r["row_no"]]
        a, b = x["a"], x["b"]
        if x["value_temp"] is not None or a is None or b is None:
            assert r["value_temp"] == (x["value_temp"] if x["value_temp"] is not None else a and a["v"])
        else:
            assert np.isclose(r["value_temp"], a["v"] + (b["v"] - a["v"]) * (x["idx"] - a["p"]) / (b["p"] - a["p"]))


def test_jitter_adds_up(long_series, chunked):
    got = G.jittered_times(long_series.filter("sensor_id = 'long'"), "2024-01-01 00:00:00").orderBy("idx").collect()
    steps = [(b["time"] - a["time"]).total_seconds() for a, b in zip(got, got[1:])]
    assert [r["idx"] for r in got] == list(range(600)) and all(590 <= s <= 609 for s in steps)


def test_no_task_gets_the_long_sensor(spark, monkeypatch):
    """Rows of a sensor with most of a table are dealt over tasks."""
    monkeypatch.setattr(scans, "CHUNK_ROWS", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("sensor_id"), F.col("id").alias("row_no"), F.timestamp_seconds(F.col("id") * 60).alias("time"))
    rows = scans.in_chunks(df).repartition(8, "sensor_id", scans.CHUNK).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 20_000 / 3


def test_frames_across_chunks(long_series, chunked):
    """Windows, moving averages and smoothing near the borders of chunks are those of whole series."""
    d = long_series.fillna({"value_temp": 0.5, "value_PV": 2.0})
    whole = {}
    for r in C.with_idx(d).orderBy("sensor_id", "idx").collect():
        whole.setdefault(r["sensor_id"], []).append((r["value_temp"], r["value_PV"]))
    got = {(r["sensor_id"], r["idx"]): r["features"] for r in W.sliding_windows(d, 12, ("value_temp", "value_PV")).collect()}
    want = {(s, i): [x[c] for c in (0, 1) for x in rows[i : i + 12]] for s, rows in whole.items() for i in range(len(rows) - 11)}
    assert got == want
    for r in W.moving_average(d, "value_temp", 10).collect():
        rows, i = whole[r["sensor_id"]], r["idx"]
        part = rows[max(0, i - 4) : i + 6] if i >= 5 else rows[: i + 5]
        assert np.isclose(r["moving_average"], sum(x[0] for x in part) / 10)
    smooth = {(r["sensor_id"], r["idx"]): r["value_temp"] for r in SM.savgol(d, ("value_temp",), 7).collect()}
    for s, rows in whole.items():
        y = [x[0] for x in rows]
        for i in range(len(y)):
            a = min(max(i - 3, 0), max(len(y) - 7, 0))
            fit = np.polynomial.polynomial.polyfit(np.arange(7.0), y[a : a + 7], 2) if len(y) >= 7 else None
            assert np.isclose(smooth[s, i], y[i] if fit is None else np.polynomial.polynomial.polyval(i - a, fit))


def test_windows_within_segments(long_series, chunked):
    rows = S.split_segments(long_series.fillna({"value_PV": 2.0}))
    got = {(r["sensor_id"], r["seg_id"], r["idx"]): r["features"] for r in W.sliding_windows(rows, 3, ("value_PV",), within="seg_id").collect()}
    parts = {}
    for r in C.with_idx(rows).orderBy("sensor_id", "idx").collect():
        parts.setdefault((r["sensor_id"], r["seg_id"]), []).append(r["value_PV"])
    assert got == {(*k, i): v[i : i + 3] for k, v in parts.items() for i in range(len(v) - 2)}


def test_sequences_go_on_as_their_source(spark):
    """Rows drawn as windows keep the source's lag-1 autocorrelation; rows drawn one by one don't."""
    rng, y = np.random.default_rng(3), [0.0]
    for _ in range(2999):
        y.append(0.95 * y[-1] + rng.normal())
    df = spark.createDataFrame([("s", i, START + dt.timedelta(minutes=10 * i), float(v), float(v)) for i, v in enumerate(y)], SCHEMA)
    lag = lambda x: np.corrcoef(x[:-1], x[1:])[0, 1]
    series = lambda d: np.array([r["value_temp"] for r in d.orderBy("row_no").collect()])
    made = series(D.synthesize_sequences(df, 3000, 48, 12, cols=("value_temp",)))
    assert len(made) == 3000 and abs(lag(made) - lag(y)) < 0.03 and abs(made.std() - np.std(y)) < 0.3 * np.std(y)
    assert abs(lag(series(D.synthesize(df, 3000, cols=("value_temp",))))) < 0.2
    short = D.synthesize_sequences(df.filter("row_no < 5").withColumn("value_PV", F.when(F.col("row_no") != 2, F.col("value_PV"))), 30, 8, 2, cols=("value_temp", "value_PV")).collect()
    assert len(short) == 30 and all(r["value_temp"] is not None for r in short) and 0 < sum(r["value_PV"] is None for r in short) < 30
    assert D.synthesize_sequences(df.limit(0), 30, cols=("value_temp",)).count() == 0
