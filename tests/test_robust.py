"""Exact quantiles by counting, and a covariance that planted clusters don't bend."""

import datetime as dt
import random

import numpy as np
import pytest

from sensorloom.functions import kernels as K, quantiles as Q, scans
from sensorloom.operators import outliers as O, scaling as A, smoothing as SM
from sensorloom.sources import io as IO

QS = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)


@pytest.mark.parametrize("few, bins", [(20_000, 4096), (3, 4), (1, 2)])
@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "one", "equal"])
def test_quantiles(spark, monkeypatch, kind, few, bins):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    rng = np.random.default_rng(2)
    x = {"normal": rng.normal(size=101), "ties": rng.integers(0, 4, 90).astype(float), "heavy": np.exp(rng.normal(size=64) * 5) * rng.choice([-1, 1], 64), "one": np.array([7.5]), "equal": np.full(40, -3.0)}[kind]
    rows = [(float(v),) for v in x] + [(None,), (float("nan"),)]
    random.Random(1).shuffle(rows)
    got = Q.exact_quantiles(spark.createDataFrame(rows, "v double").coalesce(2), "v", QS if bins > 4 else QS[1:4])
    assert np.allclose(got, np.quantile(x, QS if bins > 4 else QS[1:4]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert Q.exact_quantiles(empty, "v", (0.5,)) == [None]
    assert A.flag_above_quantile(empty, "v").first()["is_above"] is None
    assert A.describe_channel(empty, "v").first()["q50"] is None


def vectors(spark, x):
    return spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "sensor_id string, idx int, features array<double>").repartition(4)


def planted(share, n=600, d=5):
    """Correlated data, and a far cluster that holds ``share`` of the rows."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(d, d))
    x = rng.normal(size=(n, d)) @ base
    odd = rng.choice(n, int(share * n), replace=False)
    x[odd] = np.linalg.norm(base, 2) * 10 * np.ones(d) / np.sqrt(d) + rng.normal(size=(len(odd), d)) @ base / 2
    return x, set(odd.tolist()), base.T @ base


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_planted_clusters_don_t_bend_the_covariance(spark, share):
    x, odd, true = planted(share)
    mean, cov = O.robust_shape(vectors(spark, x))
    clean = x[[i for i in range(len(x)) if i not in odd]]
    # as far from the truth as a fit to the clean rows alone, or little more
    error = lambda c: np.linalg.norm(np.linalg.solve(true, c) - np.eye(len(true)))
    assert error(cov) < error(np.cov(clean.T)) + 0.6 and np.linalg.norm(mean - clean.mean(axis=0)) < 0.5


def test_the_cluster_is_what_is_flagged(spark):
    x, odd, _ = planted(0.2)
    got = O.detect_outliers(vectors(spark, x), "elliptic_envelope", contamination=0.2).collect()
    flagged = {r["idx"] for r in got if r["pred"] == -1}
    assert len(flagged & odd) == len(odd) and len(flagged) <= 121
    # one trimming pass from all rows fails here
    m, c = x.mean(axis=0), np.cov(x.T)
    first = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    core = x[first <= np.quantile(first, 0.75)]
    second = np.einsum("ij,jk,ik->i", x - core.mean(axis=0), np.linalg.inv(np.cov(core.T)), x - core.mean(axis=0))
    assert len(set(np.argsort(-second)[:120].tolist()) & odd) < len(odd)


def test_flat_directions_and_few_windows(spark):
    x = np.random.default_rng(0).normal(size=(80, 3))
    x = np.hstack([x, x[:, :1] * 2])
    x[5] += 30
    got = O.detect_outliers(vectors(spark, x), "elliptic_envelope", contamination=0.05).orderBy("score").collect()
    assert got[-1]["idx"] == 5 and sum(r["pred"] == -1 for r in got) == 4
    for n in (0, 1, 2):
        assert O.detect_outliers(vectors(spark, x[:n]) if n else spark.createDataFrame([], "sensor_id string, idx int, features array<double>"), "elliptic_envelope").count() == n
    assert O.detect_outliers(spark.createDataFrame([], "sensor_id string, idx int, features array<double>"), "autoencoder").count() == 0


def test_medians_of_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    monkeypatch.setattr(Q, "BINS", 4)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=41), "b": rng.integers(0, 3, 30) * 1.0, None: np.exp(rng.normal(size=24) * 3), "c": np.array([4.0]), "d": np.array([1.0] * 20 + [9.0] * 20)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    got = {r["g"]: r["median"] for r in Q.medians(spark.createDataFrame(rows, "g string, v double").repartition(2), ("g",), "v", IO.kept).collect()}
    assert set(got) == set(groups) and all(np.isclose(got[g], np.median(x)) for g, x in groups.items())


@pytest.mark.parametrize("chunk", [1 << 16, 25])
def test_lowess_of_near_values(spark, monkeypatch, chunk):
    """With k values in place of a share: the kernel's fit where both are the same."""
    monkeypatch.setattr(scans, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(Q, "FEW", 30)
    rng, rows, want = np.random.default_rng(6), [], {}
    for s, n in (("long", 200), ("short", 9), (None, 40), ("two", 2), ("dark", 3)):
        y = np.sin(np.arange(n) / 9) + rng.normal(size=n) / 9
        y[::13] += 3
        if s == "dark":
            y[:] = np.nan
        elif n > 20:
            y[[3, 17, 18]] = np.nan
        seen = int((~np.isnan(y)).sum())
        want |= {(s, i): v for i, v in enumerate(K.lowess(y, 20 / seen if seen > 20 else 1.0))}
        rows += [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if v != v else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "sensor_id string, row_no long, time timestamp, value_temp double").repartition(3)
    got = {(r["sensor_id"], r["row_no"]): r["value_temp"] for r in SM.lowess(df, ("value_temp",), k=20).collect()}
    assert set(got) == set(want) and all(g is None and np.isnan(w) or np.isclose(g, w, atol=1e-9) for g, w in ((got[x], want[x]) for x in want))


def test_lowess_of_many_short_series(spark, monkeypatch):
    """Each series in a batch of many is the kernel's; nothing but the rows themselves is shuffled or written."""
    monkeypatch.setattr(SM, "_lowess_of_long", None, raising=False)
    rng, rows, want = np.random.default_rng(4), [], {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for s in [None, *(f"s{i}" for i in range(300))]:
            y = np.round(rng.normal(size=rng.integers(1, 40)) * 9, 1) if s != "s7" else np.arange(30.0)
            y[rng.random(len(y)) < 0.1] = np.nan
            seen = int((~np.isnan(y)).sum())
            want |= {(s, i): v for i, v in enumerate(K.lowess(y, 12 / seen if seen > 12 else 1.0))}
            rows += [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if v != v else float(v)) for i, v in enumerate(y)]
        random.Random(2).shuffle(rows)
        df = spark.createDataFrame(rows, "sensor_id string, row_no long, time timestamp, value_temp double").repartition(3)
        store = spark.sparkContext._jsc.sc().statusStore()
        before = store.executorList(True).apply(0).totalShuffleWrite()
        got = {(r["sensor_id"], r["row_no"]): r["value_temp"] for r in SM.lowess(df, ("value_temp",), k=12).collect()}
        assert store.executorList(True).apply(0).totalShuffleWrite() - before < len(rows) * 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(g is None and np.isnan(w) or np.isclose(g, w, atol=1e-9) for g, w in ((got[x], want[x]) for x in want))
