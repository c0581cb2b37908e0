"""Hand-made cases for each rule that is off by one somewhere."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import columns as C, kernels as K
from sensorloom.operators import federated as FD, forecast as FC, labels as L, metrics as M, outliers as O, regularize as G, scaling as A, segments as S, smoothing as SM, windows as W
from sensorloom.sources import io as IO
from sensorloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def series(spark, seconds, temp=None, pv=None, sensor="s"):
    temp = temp or [float(i) for i in range(len(seconds))]
    pv = pv or temp
    rows = [(sensor, i, T0 + dt.timedelta(seconds=s), temp[i], 50.0, 5.0, pv[i]) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "sensor_id string, row_no long, time timestamp, value_temp double, value_hum double, value_acid double, value_PV double")


def column(df, name, order="row_no"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_breaks_cut_seconds_first(spark):
    d = series(spark, [0, 1800, 3600.9, 5401.9])  # steps 30:00, 30:00.9, 30:01
    assert [r["idx"] for r in S.time_breaks(d).collect()] == [2]
    assert column(S.split_segments(d), "seg_id") == [0, 0, 0, 1]
    assert column(S.split_segments(d, drop_tail=True), "seg_id") == [0, 0, 0]


def test_no_outage(spark):
    d = series(spark, [0, 600, 1200])
    assert column(S.split_segments(d), "seg_id") == [0, 0, 0]
    assert S.split_segments(d, drop_tail=True).count() == 0
    assert S.missing_between_segments(S.split_segments(d)).count() == 0


def test_one_row_segments(spark):
    d = S.split_segments(series(spark, [0, 7200, 14400]))
    assert all(r["is_regular"] for r in S.check_max_step(d).collect())
    assert [r["n_missing"] for r in S.missing_between_segments(d).collect()] == [None, None]


def test_jump_drops_break_rows(spark):
    d = series(spark, range(0, 3000, 600), pv=[10.0, 10.0, 14.0, 14.0, 10.0])
    assert [(r["row_no"], r["seg_id"]) for r in S.split_by_jump(d).orderBy("row_no").collect()] == [(0, 0), (2, 1), (4, 2)]


def test_gap_report_counts_file_rows(spark):
    rows = [("s", i, T0 + dt.timedelta(minutes=m), 0.0) for i, m in enumerate((40, 0, 10))]
    got = S.gap_report(spark.createDataFrame(rows, "sensor_id string, row_no long, time timestamp, value_temp double")).collect()
    assert [(g["start_row"], g["end_row"], g["gap_no"]) for g in got] == [(3, 1, 1)]


def test_grid_adds_inside_only(spark):
    d = series(spark, [0, 600, 2100, 2700])  # steps 10, 25, 10 minutes
    filled = G.fill_time_grid(d)
    assert filled.filter("is_filled").count() == 2
    assert G.fill_time_grid(series(spark, [0, 1200])).filter("is_filled").count() == 1
    assert G.fill_time_grid(d, max_fill_minutes=20).filter("is_filled").count() == 0


def test_interpolation_ends(spark):
    d = series(spark, range(0, 3000, 600), temp=[None, 1.0, None, 3.0, None])
    assert column(G.interpolate_time(d, ("value_temp",)), "value_temp") == [None, 1.0, 2.0, 3.0, 3.0]
    assert column(G.interpolate_linear(d, ("value_temp",)), "value_temp") == [None, 1.0, 2.0, 3.0, 3.0]


def test_duplicate_times_keep_first(spark):
    assert column(G.dedupe_time(series(spark, [0, 0, 600, 600])), "row_no") == [0, 2]


def test_frequency_drops_off_grid(spark):
    got = G.as_freq(series(spark, [0, 630, 1200]), 10, ("value_temp",)).orderBy("time").collect()
    assert [r["value_temp"] for r in got] == [0.0, None, 2.0]


def test_constant_channel_scales_to_zero(spark):
    d = series(spark, [0, 600], temp=[4.0, 4.0])
    assert column(A.minmax_scale(d), "value_temp") == [0.0, 0.0]


@pytest.mark.parametrize("n, full, less", [(29, 0, 0), (30, 1, 0), (31, 2, 1)])
def test_window_counts(spark, n, full, less):
    d = series(spark, range(0, 600 * n, 600))
    assert W.sliding_windows(d).count() == full
    assert W.sliding_windows(d, drop_last=True).count() == less


@pytest.mark.parametrize("window", [19, 20, 21])
def test_window_labels(spark, window):
    n = 60
    d = series(spark, range(0, 600 * n, 600))
    errors = spark.createDataFrame([("s", e) for e in (0, 7, 8, n - 1)], "sensor_id string, idx int")
    half, want = window / 2 - 2, [0] * (n - window)
    for e in (0, 7, 8, n - 1):
        for i in range(int(max(0, e - half) // 1), int(min(e + half, n - window) // 1)):
            want[i] = 1
    got = [int(r["label"]) for r in L.label_windows(d, errors, window).orderBy("idx").collect()]
    assert got == want


def test_range_rules_are_strict(spark):
    rows = [("s", i, T0 + dt.timedelta(seconds=i), t, h, a, 0.0) for i, (t, h, a) in enumerate([(99.0, 50.0, 5.0), (-15.0, 50.0, 5.0), (50.0, 90.0, 9.5), (0.0, 7.5, 3.0), (50.1, 50.0, 5.0), (0.0, 90.1, 5.0), (0.0, 50.0, 2.9)])]
    d = spark.createDataFrame(rows, "sensor_id string, row_no long, time timestamp, value_temp double, value_hum double, value_acid double, value_PV double")
    assert column(L.label_by_range(d), "label") == ["good"] * 4 + ["error"] * 3


def test_moving_average_edges(spark):
    d = series(spark, range(0, 600 * 60, 600))
    got = column(W.moving_average(d, "value_temp"), "moving_average")
    want = [sum(range(0, i + 15)) / 30 if i < 15 else sum(range(i - 14, min(i + 16, 60))) / 30 for i in range(60)]
    assert np.allclose(got, want)


def test_prediction_spans(spark):
    preds = [1] * 40 + [-1] + [1] * 29 + [-1] + [1] * 30 + [-1] + [1] * 40
    d = spark.createDataFrame([("s", i, p) for i, p in enumerate(preds)], "sensor_id string, idx int, pred int")
    got = [(r["start"], r["stop"], r["is_good"]) for r in S.prediction_spans(d).orderBy("start").collect()]
    assert got == [(0, 40, True), (40, 101, False), (101, 132, False), (132, 142, True)]


def test_int8_round_trip(spark):
    d = spark.createDataFrame([("a", 0, [1.0, 2.0, 4.0]), ("b", 0, [3.0, 3.0])], "client_id string, layer int, weights array<double>")
    q = FD.quantize_i8(d)
    back = {r["client_id"]: r["weights"] for r in FD.dequantize_i8(q).collect()}
    assert np.allclose(back["a"], [1, 2, 4], atol=3 / 254) and np.allclose(back["b"], [3, 3])


def test_weighted_average(spark):
    d = spark.createDataFrame([(0, 0, 1, [0.0, 1.0]), (0, 0, 3, [4.0, 5.0])], "round int, layer int, n int, weights array<double>")
    assert FD.fed_avg(d).first()["weights"] == [2.0, 3.0] and FD.fed_avg(d, "n").first()["weights"] == [3.0, 4.0]


def test_chunks_equal_whole_series(spark):
    d = series(spark, range(0, 600 * 100, 600))
    whole = column(W.moving_average(d, "value_temp", 10), "moving_average")
    cut = W.chunked(d, 20 * 600, 10)
    w = C.by_time("sensor_id", "chunk").rowsBetween(-4, 5)
    part = cut.withColumn("m", F.sum("value_temp").over(w) / 10).filter("is_own")
    assert np.allclose(column(part, "m")[5:], whole[5:])


def test_savgol_keeps_a_parabola(spark):
    temp = [float(i * i) for i in range(30)]
    assert np.allclose(column(SM.savgol(series(spark, range(0, 18000, 600), temp), ("value_temp",)), "value_temp"), temp)


def level_of(y):
    none = np.full((len(y), 1), np.nan)
    return K.kalman_runs(y[:, None].astype(float), np.zeros(len(y), np.int64), 0.01, 1.0, 1.0, none, none)[0][:, 0]


def winters(y, season, horizon):
    smoother = K.HoltWinters(season)
    smoother.add(y)
    return smoother.ahead(horizon)


def test_kernels_against_loops():
    y = np.sin(np.arange(50)) + np.arange(50) / 10
    level, p, want = y[0], 1.0, []
    for i, v in enumerate(y):
        p += 0.01 * (i > 0)
        g = p / (p + 1)
        level, p = level + g * (v - level), p * (1 - g)
        want.append(level)
    assert np.allclose(level_of(y), want)
    assert np.allclose(K.lowess(2.0 * np.arange(40) + 1), 2.0 * np.arange(40) + 1)
    season = np.tile([0.0, 1.0, 0.0, -1.0], 10) + np.arange(40)
    assert np.abs(winters(season, 4, 4) - (np.array([0, 1, 0, -1]) + np.arange(40, 44))).max() < 1.0


def test_detectors_find_the_odd_one(spark):
    rng = np.random.default_rng(0)
    rows = [("s", i, (rng.normal(size=4) + (60 if i == 17 else 0)).tolist()) for i in range(200)]
    d = spark.createDataFrame(rows, "sensor_id string, idx int, features array<double>")
    for name in ("isolation_forest", "local_outlier_factor", "elliptic_envelope"):
        assert O.detect_outliers(d, name).filter("idx = 17").first()["pred"] == -1, name
    with pytest.raises(ValueError):
        O.detect_outliers(d, "other")


def test_training_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i % 3}", i, x.tolist(), float(x[0] > 0)) for i, x in enumerate(rng.normal(size=(300, 4)))]
    d = spark.createDataFrame(rows, "client_id string, idx int, features array<double>, label double")
    _, metrics = FD.federated_train(d, [{"units": 1, "activation": "sigmoid"}], rounds=4, variant="weighted", rate=0.1)
    loss = [r["l"] for r in metrics.groupBy("round").agg(F.avg("loss").alias("l")).orderBy("round").collect()]
    assert loss[-1] < loss[0]


def test_csv_files(spark, tmp_path):
    (tmp_path / "df_A_CLEAN.csv").write_text("time,value_temp,value_hum,value_acid,value_PV\n2024-01-01T00:00:00Z,1,2,3,4\nbad,5,6,7,8\n")
    got = IO.read_readings(spark, str(tmp_path), "*_CLEAN.csv").orderBy("row_no").collect()
    assert [(r["sensor_id"], r["value_temp"], r["time"] is None) for r in got] == [("df_A", 1.0, False), ("df_A", 5.0, True)]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        C.require_columns(series(spark, [0]), ["value_other"])


def test_auc_by_pairs(spark):
    rows = [(i, i % 2, (i * 7 % 10) / 10) for i in range(40)]
    d = spark.createDataFrame(rows, "idx int, y_true int, score double")
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])
    assert abs(M.binary_metrics(d).first()["auc"] - want) < 1e-9


def test_streams_equal_batch(spark, tmp_path):
    live.with_rocksdb(spark)
    d = series(spark, [0, 600, 1200, 9000, 9600])
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert run(live.outage_sessions(stream), "sessions", "append").count() <= 2
    assert sorted(r["label"] for r in run(live.range_labels(stream), "ranges").collect()) == sorted(r["label"] for r in live.range_labels(d).collect())
    levels = sorted((r["time"], r["level"]) for r in run(live.live_kalman(stream), "levels").collect())
    assert np.allclose([x[1] for x in levels], column(SM.kalman_level(d, ("value_temp",)), "value_temp"))
    assert run(live.live_labels(stream, {"value_temp": 0.5}), "labels").filter("label = 'error'").count() == 1
    assert run(live.drop_resent(stream), "resent").count() == 5


def test_updates_are_averaged_once(spark, tmp_path):
    schema = "round int, client_id string, layer int, weights array<double>"
    first = [(0, "a", 0, [1.0]), (0, "b", 0, [3.0]), (1, "a", 0, [5.0])]
    second = [(0, "c", 0, [9.0]), (1, "a", 0, [5.0]), (1, "b", 0, [7.0]), (2, "a", 0, [1.0])]  # round 0 is closed, a is sent again
    seen = []
    for rows in (first, second, [(2, "b", 0, [2.0])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.collect_updates(stream, str(tmp_path / "kept"), 2, lambda m, number: seen.extend((number, *r) for r in m.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(number, r, w) for number, r, _, w in seen] == [(0, 0, [2.0]), (1, 1, [6.0]), (2, 2, [1.5])]


def test_live_labels_over_triggers(spark, tmp_path):
    live.with_rocksdb(spark)
    seconds = [0, 600, 1200, 9000, 9600, 10200, 600]
    values = [1.0, 1.1, 5.0, 5.0, 5.1, 9.0, 7.0]
    want = ["0", "0", "1", "error", "0", "1", "0"]  # the last row is late
    d = series(spark, seconds, values)
    for a, z in ((0, 2), (2, 3), (3, 6), (6, 7)):
        d.filter(f"row_no >= {a} AND row_no < {z}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        out = live.live_labels(stream, {"value_temp": 0.5}, late="1 day")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = [(r["time"], r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted((T0 + dt.timedelta(seconds=s), label) for s, label in zip(seconds, want))


@pytest.mark.parametrize("shard", [7, 1000])
def test_forecasts_against_one_fit(spark, monkeypatch, shard):
    monkeypatch.setattr(FC, "SHARD", shard)
    rng = np.random.default_rng(1)
    seconds = np.cumsum(rng.integers(300, 4000, 60)).tolist()
    temp = rng.normal(size=60).tolist()
    d = series(spark, seconds, temp, rng.normal(size=60).tolist()).withColumn("value_temp", F.when(F.col("row_no") % 9 != 4, F.col("value_temp")))

    def fit(x, y):
        return np.linalg.solve(x.T @ x + 1e-3 * len(x) * np.eye(x.shape[1]), x.T @ y)

    at = (np.array(seconds) - seconds[0]) / 60
    ahead = at[-1] + 10.0 * np.arange(1, 6)
    keep = np.arange(60) % 9 != 4
    features = lambda t, p: K.fourier_features(t, p, at[-1])
    p = {1440.0: 2, 10080.0: 1}
    want = features(ahead, p) @ fit(features(at[keep], p), np.array(temp)[keep])
    got = FC.fourier_forecast(d, ("value_temp",), horizon=5, daily=2, weekly=1).orderBy("time").collect()
    assert np.allclose([r["value"] for r in got], want)
    assert [r["time"] for r in got] == [T0 + dt.timedelta(seconds=seconds[-1] + 600 * k) for k in range(1, 6)]
    known = np.array([temp[i - (i % 9 == 4)] for i in range(60)])
    p = {1440.0: 4, 10080.0: 3, 365.25 * 1440: 3}
    y = np.array(column(d, "value_PV"))
    x = np.hstack([features(at, p), known[:, None]])
    want = np.hstack([features(ahead, p), np.full((5, 1), known[-1])]) @ fit(x, y)
    got = FC.regressor_forecast(d, regressors=("value_temp",), horizon=5).orderBy("time").collect()
    assert np.allclose([r["value_PV"] for r in got], want)


def test_forecasts_of_nothing(spark):
    d = series(spark, [0, 600]).withColumn("value_temp", F.lit(None).cast("double"))
    assert FC.fourier_forecast(d, ("value_temp",), horizon=5).count() == 0
    assert FC.regressor_forecast(d, horizon=5).count() == 0
    assert FC.fourier_forecast(d.limit(0), horizon=5).count() == 0


def test_unknown_values_don_t_spread():
    y = np.array([3.0, np.nan, 4.0, 5.0, np.nan, 6.0, 5.5, 7.0, 6.5, 8.0] * 4)
    level = level_of(y)
    assert not np.isnan(level).any() and level[1] == level[0] and np.isnan(level_of(np.array([np.nan, 2.0]))[0])
    smooth = K.lowess(y, 0.3)
    assert (np.isnan(smooth) == np.isnan(y)).all()
    assert np.isfinite(winters(y, 4, 5)).all()
    whole = np.sin(np.arange(300) / 9.0) + np.arange(300) % 7
    assert np.allclose(K.lowess(whole, 0.2), K.lowess(whole, 0.2, block=100))
    assert np.isfinite(K.lowess(np.arange(20_000) % 50 * 1.0, 0.1, 1)).all()
