"""Filters whose steps compose, and smoothing with a carried state, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest

from sensorloom.functions import kernels as K, scans
from sensorloom.operators import smoothing as SM

SCHEMA = "sensor_id string, row_no long, time timestamp, value_temp double, value_hum double"


def loop_level(values, q=0.01, r=1.0, p0=1.0):
    level, p, out = None, p0, []
    for v in values:
        if level is not None:
            p += q
        if v is not None:
            gain = p / (p + r)
            level = v if level is None else level + gain * (v - level)
            p *= 1 - gain
        out.append(level)
    return out


def loop_winters(y, season, horizon, a, b, g):
    """(squared error, forecast) of one choice of weights."""
    y = list(y)
    while len(y) >= 2 * season and (all(v is None for v in y[:season]) or all(v is None for v in y[season : 2 * season])):
        y = y[1:]
    if len(y) < 2 * season:
        known = [v for v in y if v is not None]
        return 0.0, [known[-1] if known else None] * horizon
    mean = lambda part: np.mean([v for v in part if v is not None])
    first, second = mean(y[:season]), mean(y[season : 2 * season])
    level, trend, seasonal, error = first, (second - first) / season, [0.0 if v is None else v - first for v in y[:season]], 0.0
    for t, v in enumerate(y):
        if v is None:
            level += trend
            continue
        s = seasonal[t % season]
        error += (v - level - trend - s) ** 2
        new = a * (v - s) + (1 - a) * (level + trend)
        trend, seasonal[t % season], level = b * (new - level) + (1 - b) * trend, g * (v - new) + (1 - g) * s, new
    return error, [level + (h + 1) * trend + seasonal[(len(y) + h) % season] for h in range(horizon)]


@pytest.fixture(scope="module")
def series():
    r, rows = random.Random(5), {}
    for sensor, n in (("hot", 700), ("a", 30), ("b", 1), (None, 90), ("dark", 40)):
        at, out = dt.datetime(2024, 1, 1), []
        for i in range(n):
            at += dt.timedelta(seconds=r.choice((1, 60, 600, 90_000)))
            value = lambda p: None if sensor == "dark" or r.random() < p or i < 8 and sensor == "hot" else r.gauss(20, 5)
            out.append((sensor, i, at, value(0.3), value(0.05)))
        rows[sensor] = out
    return rows


@pytest.fixture(scope="module")
def readings(spark, series):
    rows = [x for own in series.values() for x in own]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("chunk, batch", [(1 << 16, 10_000), (60, 10_000), (60, 17), (5, 64)])
def test_kalman_in_chunks(spark, readings, series, monkeypatch, chunk, batch):
    monkeypatch.setattr(scans, "CHUNK_ROWS", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r["sensor_id"], r["row_no"]): r for r in SM.kalman_level(readings, ("value_temp", "value_hum")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, series.values()))
    for sensor, rows in series.items():
        for c, at in (("value_temp", 3), ("value_hum", 4)):
            for row, want in zip(rows, loop_level([x[at] for x in rows])):
                value = got[sensor, row[1]][c]
                assert value is None and want is None or np.isclose(value, want, rtol=1e-10), (sensor, row, want, value)


def test_steps_compose_in_any_grouping():
    y = np.random.default_rng(0).normal(size=(40, 2))
    y[3:9, 0] = np.nan
    steps = K.LevelSteps.of(y, 0.01, 1.0)
    whole = steps.running(np.zeros(40, np.int64))[[39]]
    halves = steps[:25].running(np.zeros(25, np.int64))[[24]].then(steps[25:].running(np.zeros(15, np.int64))[[14]])
    assert all(np.allclose(a, b) for a, b in zip(whole.fields, halves.fields))


@pytest.mark.parametrize("batch", [10_000, 7])
def test_holt_winters_carries_its_state(spark, readings, series, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r["sensor_id"], r["step"]): r for r in SM.holt_winters(readings, ("value_temp", "value_hum"), 12, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grid = (0.1, 0.3, 0.5, 0.8)
    for sensor, rows in series.items():
        for c, at in (("value_temp", 3), ("value_hum", 4)):
            ways = [loop_winters([x[at] for x in rows], 12, 5, a, b, g) for a in grid for b in grid for g in grid]
            want = min(ways, key=lambda w: w[0])[1]
            for step, value in enumerate(want, 1):
                own = got[sensor, step][c]
                assert own is None and value is None or np.isclose(own, value), (sensor, c, own, value)


def test_holt_winters_keeps_little():
    s = K.HoltWinters(12)
    s.add(np.sin(np.arange(3000) / 2) + np.arange(3000) / 100)
    held = sum(x.nbytes for x in vars(s).values() if isinstance(x, np.ndarray))
    assert not s.waiting and held < 20_000 and s.n == 3000
