"""Cases in which an operator once did less than the whole job."""

import datetime as dt

import numpy as np
import pytest

from sensorloom.functions import kernels as K
from sensorloom.operators import federated as FD, forecast as FC, outliers as O
from sensorloom.plans import catalog


def vectors(spark, x):
    return spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "sensor_id string, idx int, features array<double>")


def test_autoencoder_finds_the_odd_one(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 90)) + rng.normal(size=(200, 90)) / 100
    x[17] += rng.normal(size=90)
    got = O.detect_outliers(vectors(spark, x), "autoencoder", k=5).orderBy("score").collect()
    assert got[-1]["idx"] == 17 and got[-1]["pred"] == -1 and sum(r["pred"] == -1 for r in got) == 10


def test_autoencoder_wants_more_rank_than_components(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(100, 20))
    with pytest.raises(ValueError):
        O.detect_outliers(vectors(spark, np.hstack([a, a[:, :10] / 10])), "autoencoder")


def test_autoencoder_query_flags_planted_windows(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        odd = 700 <= i < 730
        pick = (lambda top: int(rng.integers(0, 2) * top)) if odd else (lambda top: int(rng.integers(0, top + 1)))
        rows.append((i, 1, 1, 1, dt.date(2020, 1, 1) + dt.timedelta(days=i), pick(50), pick(10) / 100, pick(8) / 100, 1000.0))
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity int, l_discount double, l_tax double, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["idx"]: r["pred"] for r in catalog.QUERIES["out4_autoencoder"](spark, str(tmp_path)).collect()}
    assert len(got) == 1471 and all(got[i] == -1 for i in range(697, 704))


def brute_factor(x, k=20):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    gap = np.take_along_axis(d, near, axis=1)
    density = 1 / np.maximum(np.maximum(gap, gap[near, -1]).mean(axis=1), 1e-12)
    return density[near].mean(axis=1) / density


@pytest.mark.parametrize("block", [8192, 500])
def test_outlier_factor_looks_at_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    x[:25] = 30 + rng.normal(size=(25, 6)) / 100  # a small dense group, and one beside it
    x[25] = 30.5
    got = O.detect_outliers(vectors(spark, x), "local_outlier_factor").orderBy("idx").collect()
    want = brute_factor(x)
    assert np.allclose([r["score"] for r in got], want, rtol=1e-9) and [r["pred"] == -1 for r in got] == (want > 1.5).tolist()
    assert got[25]["pred"] == -1


def test_outlier_factor_of_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 40)
    x = np.repeat(1000.1 + np.arange(4.0), 30)[:, None] * np.ones(5)
    assert all(r["pred"] == 1 for r in O.detect_outliers(vectors(spark, x), "local_outlier_factor").collect())


def drifting(n, seed=4):
    """Windows of a series whose level drifts."""
    rng = np.random.default_rng(seed)
    level = np.cumsum(rng.normal(size=n + 7)) * 2 + rng.normal(size=n + 7) / 10
    return np.lib.stride_tricks.sliding_window_view(level, 8).copy()


def test_blocks_of_near_windows(spark, monkeypatch):
    """More equal windows than a block holds; scores are those of brute force."""
    monkeypatch.setattr(O, "BLOCK", 100)
    x = drifting(2000)
    x[50:350] = x[50]
    df = vectors(spark, x)
    size = [len(r["idxs"]) for r in O._near_each_other(df, len(x)).collect()]
    assert sum(size) == len(x) and max(size) <= 250
    got = O.detect_outliers(df, "local_outlier_factor").orderBy("idx").collect()
    assert np.allclose([r["score"] for r in got[400:]], brute_factor(x)[400:], rtol=1e-6)


def test_far_blocks_don_t_meet(spark, monkeypatch):
    """Most blocks are too far apart to be compared: far fewer distances than the square of the windows."""
    monkeypatch.setattr(O, "BLOCK", 600)
    blocks = O._near_each_other(vectors(spark, drifting(30_000)), 30_000)
    size = {r["block"]: len(r["idxs"]) for r in blocks.select("block", "idxs").collect()}
    met = sum(r["windows"] * size[r["block"]] for r in O._meetings(blocks, 20).collect())
    assert met < 0.15 * 30_000**2


def shuffled(spark):
    """Bytes that tasks have shuffled so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_blocks_that_meet_aren_t_shuffled(spark, monkeypatch):
    """Windows without structure: each block meets nearly all, and is read for it, not copied."""
    monkeypatch.setattr(O, "BLOCK", 100)
    x = np.random.default_rng(8).normal(size=(3000, 12))
    before = shuffled(spark)
    got = O.detect_outliers(vectors(spark, x), "local_outlier_factor").orderBy("idx").collect()
    assert shuffled(spark) - before < 10 * x.nbytes + 3000 * 20 * 50
    assert np.allclose([r["score"] for r in got], brute_factor(x), rtol=1e-9)


def test_outlier_factor_with_copies(spark, monkeypatch):
    """Windows with one to 24 copies each."""
    monkeypatch.setattr(O, "BLOCK", 60)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(240, 5)), np.arange(240) % 24 + 1, axis=0)[rng.permutation(3000)]
    got = O.detect_outliers(vectors(spark, x), "local_outlier_factor").orderBy("idx").collect()
    want = brute_factor(x)
    # a window with 21 copies or more has a density of 1e12
    assert np.allclose([r["score"] for r in got], want, rtol=1e-6) and [r["pred"] == -1 for r in got] == (want > 1.5).tolist()


def test_windows_with_many_copies_need_no_search(spark, monkeypatch):
    monkeypatch.setattr(O, "_nearest", None)
    x = np.repeat(np.random.default_rng(1).normal(size=(50, 4)), 21, axis=0)
    got = O.detect_outliers(vectors(spark, x), "local_outlier_factor").collect()
    assert len(got) == len(x) and all(r["score"] == 1 and r["pred"] == 1 for r in got)


def test_large_clients_train_in_shards(spark, monkeypatch):
    monkeypatch.setattr(FD, "SHARD", 40, raising=False)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 4))
    d = spark.createDataFrame([("c", i, v.tolist(), float(v[0] > 0)) for i, v in enumerate(x)], "client_id string, idx int, features array<double>, label double")
    spec = [{"units": 3, "activation": "relu"}, {"units": 1, "activation": "sigmoid"}]
    start = K.initial_weights(4, spec)
    got = FD.local_train(d, start, spec).orderBy("layer").collect()
    parts = [K.train_epoch(x[i : i + 40], (x[i : i + 40, 0] > 0).astype(float), start, spec) for i in (0, 40, 80)]
    assert [r["n"] for r in got] == [100] * 4
    for r, want in zip(got, zip(*parts)):
        assert np.allclose(r["weights"], np.average([w.reshape(-1) for w in want], axis=0, weights=[40, 40, 20]))


def test_rounds_have_a_client_for_each_sensor(spark):
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["fed9_rounds"](spark, sf)
    sensors = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().filter("count > 20").count()
    assert got.select("client_id").distinct().count() == sensors and got.select("round").distinct().count() == 5


@pytest.mark.parametrize("variant", ["plain", "weighted", "float16", "int8"])
def test_rounds_of_many_clients(spark, monkeypatch, variant):
    """Clients of one shard, trained side by side, and one of three: weights and metrics of plain loops, and no shuffle of each weight of each client."""
    monkeypatch.setattr(FD, "SHARD", 40)
    monkeypatch.setattr(FD, "ABREAST", 32, raising=False)
    rng = np.random.default_rng(5)
    spec = [{"units": 8, "activation": "relu"}, {"units": 1, "activation": "sigmoid"}]
    clients = {f"c{i}": (rng.normal(size=(n, 20)), rng.integers(0, 2, n).astype(float)) for i, n in enumerate([100, 1, 2, *rng.integers(3, 9, 500)])}
    rows = [(c, i, v.tolist(), float(t)) for c, (x, y) in clients.items() for i, (v, t) in enumerate(zip(x, y))]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "client_id string, idx int, features array<double>, label double").repartition(3)
    before = shuffled(spark)
    got, table = FD.federated_train(d, spec, 2, variant)
    found = {(r["round"], r["client_id"]): r for r in table.collect()}
    assert shuffled(spark) - before < 6 * len(rows) * 20 * 8
    weights = K.initial_weights(20, spec)
    trip = {"float16": lambda v: v.astype(np.float16).astype(float), "int8": int8}.get(variant, lambda v: v)
    for r in range(2):
        own, losses = {}, {}
        for c, (x, y) in clients.items():
            parts = [(K.train_epoch(x[i : i + 40], y[i : i + 40], weights, spec), x[i : i + 40], y[i : i + 40]) for i in range(0, len(x), 40)]
            own[c] = [np.average([p[0][j] for p in parts], axis=0, weights=[len(p[1]) for p in parts]) for j in range(len(weights))]
            logs = [log_loss(b, K.dense_forward(a, w, spec)[-1].reshape(-1)) for w, a, b in parts]
            losses[c] = np.average(logs, weights=[len(p[1]) for p in parts])
        share = {c: len(x) if variant == "weighted" else 1 for c, (x, _) in clients.items()}
        weights = [sum(share[c] * trip(own[c][j]) for c in clients) / sum(share.values()) for j in range(len(weights))]
        for c, (x, y) in clients.items():
            p, f = K.dense_forward(x, weights, spec)[-1].reshape(-1), found[r, c]
            hit, pos, neg = p > 0.5, p[y == 1], p[y == 0]
            area = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) if len(pos) and len(neg) else None
            want = [len(x), len(x), losses[c], (hit == y).mean(), y[hit].mean() if hit.any() else None, hit[y == 1].mean() if y.any() else None, log_loss(y, p), area]
            for a, b in zip([f[k] for k in ("n", "work", "loss", "accuracy", "precision", "recall", "log_loss", "auc")], want):
                assert a is None and b is None or np.isclose(a, b, atol=1e-6)
    assert len(found) == 2 * len(clients) and all(np.allclose(a, b) for a, b in zip(got, weights))


def log_loss(y, p):
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()


def int8(v):
    cut = np.clip(v, v.mean() - 2 * v.std(), v.mean() + 2 * v.std())
    low, high = cut.min(), cut.max()
    return (np.rint(((cut - low) / (high - low) * 2 - 1) * 127) / 127 + 1) / 2 * (high - low) + low if high > low else cut


def test_weights_travel_as_in_tables(spark):
    """What a task does to the weights it sums is what the operators on tables do."""
    v = np.random.default_rng(2).normal(size=(6, 30))
    v[0] = 0.25
    rows = spark.createDataFrame([(str(i), 0, w.tolist()) for i, w in enumerate(v)], "client_id string, layer int, weights array<double>")
    back = {r["client_id"]: r["weights"] for r in FD.dequantize_i8(FD.quantize_i8(rows)).collect()}
    half = {r["client_id"]: r["weights"] for r in FD.quantize_f16(rows).collect()}
    assert all(np.allclose(a, back[str(i)]) for i, a in enumerate(K.int8_round_trip(v))) and all(np.allclose(a, half[str(i)]) for i, a in enumerate(K.float16_round_trip(v)))


def test_labelled_windows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(s, i, start + dt.timedelta(minutes=i), float(i), 1.0, 2.0) for s in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "sensor_id string, row_no long, time timestamp, value_temp double, value_hum double, value_acid double")
    errors = spark.createDataFrame([("a", 50), ("a", 299), ("b", 0), ("b", 7)], "sensor_id string, idx int")
    got = {(r["sensor_id"], r["idx"]): (r["features"][:20], r["label"]) for r in FD.training_table(df, errors).collect()}
    near = lambda s, i: any(i - 8 < e <= i + 8 for t, e in (("a", 50), ("a", 299), ("b", 0), ("b", 7)) if t == s)
    assert got == {(s, i): ([float(j) for j in range(i, i + 20)], float(near(s, i))) for s in ("a", "b") for i in range(280)}


@pytest.mark.parametrize("shard", [65_536, 60])
def test_forecasts_side_by_side(spark, monkeypatch, shard):
    """Models of short and of long series, channels with other known times or none, combined as their tables would be."""
    monkeypatch.setattr(FC, "SHARD", shard)
    rng, start, rows, want = np.random.default_rng(6), dt.datetime(2024, 1, 1), [], {}
    cols, periods = ("value_temp", "value_hum", "value_acid"), {1440.0: 2, 10080.0: 1}
    # how many of their last values channels don't know, in steps of a minute
    for s, n, lost in (("same", 50, (0, 0, 0)), ("ends", 90, (0, 20, 10)), ("other", 40, (0, 3, 0)), ("far", 130, (0, 90, 0)), ("dark", 30, (0, 30, 0)), ("one", 1, (0, 0, 0)), (None, 20, (0, 0, 0))):
        y = rng.normal(size=(n, 3))
        at = np.arange(n) * (1 if n != 40 else 7)
        y[rng.random(y.shape) < 0.1] = np.nan
        y[0], y[-1] = 1.0, 2.0
        for j, m in enumerate(lost):
            y[n - m :, j] = np.nan
            y[max(n - m - 1, 0), j] = 2.0 if m < n else np.nan
        rows += [(s, i, start + dt.timedelta(minutes=int(at[i])), *[None if v != v else float(v) for v in y[i]]) for i in range(n)]
        for j, c in enumerate(cols):
            known = ~np.isnan(y[:, j])
            if s is None or not known.any():
                continue
            t = at[known].astype(float)
            scale = max(t[-1] - t[0], 1.0)
            x = K.fourier_features(t - t[0], periods, scale)
            fitted = np.linalg.solve(x.T @ x + 1e-3 * len(t) * np.eye(x.shape[1]), x.T @ y[known, j])
            ahead = t[-1] + 10 * np.arange(1, 9)
            for u, v in zip(ahead, K.fourier_features(ahead - t[0], periods, scale) @ fitted):
                want[s, c, start + dt.timedelta(minutes=float(u))] = v
    rng.shuffle(rows)
    rows += [("same", 99, None, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame([(a, int(b), c, *map(lambda v: None if v is None else float(v), r)) for a, b, c, *r in rows], "sensor_id string, row_no long, time timestamp, value_temp double, value_hum double, value_acid double").repartition(3)
    got = {(r["sensor_id"], r["channel"], r["time"]): r["value"] for r in FC.fourier_forecast(df, cols, 8, 10, 2, 1).collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], atol=1e-8) for k in want)
    both = FC.fourier_forecasts(df, cols, 8, 10, 2, 1).collect()
    expected = {(s, t): [want[s, c, t] for c in cols] for s, _, t in want if all((s, c, t) in want for c in cols)}
    assert {s for s, _ in expected} >= {"same", "ends", "one"} and len(both) == len(expected)
    assert all(np.allclose([r[c] for c in cols], expected[r["sensor_id"], r["time"]], atol=1e-8) for r in both)


def test_forecasts_aren_t_shuffled(spark):
    """Neither forecasts nor sums of products: readings only."""
    before = shuffled(spark)
    assert catalog.QUERIES["for3_combine_forecasts"](spark, "/root/testdata/sf0.01").count() == 150_000
    assert shuffled(spark) - before < 10_000 * 100


def loop_partial(x, y, work, rows, start, spec):
    """Weights of a client after ``work - 1`` batches of ``rows`` rows, each a row further on."""
    weights = [w.copy() for w in start]
    return K.train_batches([(x[b : b + rows], y[b : b + rows]) for b in range(work - 1) if b < len(x)], weights, spec)


def test_partial_rounds(spark):
    """A round is the mean of what its clients' batches make of the model, by their work."""
    rng = np.random.default_rng(3)
    spec = [{"units": 3, "activation": "relu"}, {"units": 1, "activation": "sigmoid"}]
    clients = {c: (rng.normal(size=(n, 4)), rng.integers(0, 2, n).astype(float)) for c, n in (("a", 80), ("b", 30), ("c", 3))}
    d = spark.createDataFrame([(c, i, v.tolist(), float(t)) for c, (x, y) in clients.items() for i, (v, t) in enumerate(zip(x, y))], "client_id string, idx int, features array<double>, label double").repartition(3)
    got, table = FD.federated_train(d, spec, 2, "partial")
    work = {(r["round"], r["client_id"]): r["work"] for r in FD.work_of([0, 1], spark.createDataFrame([(c,) for c in clients], "client_id string")).collect()}
    assert set(work.values()) <= set(range(5, 11)) and len(work) == 6
    weights = K.initial_weights(4, spec)
    for r in range(2):
        own = {c: loop_partial(x, y, work[r, c], 50, weights, spec) for c, (x, y) in clients.items()}
        weights = [sum(work[r, c] * own[c][i] for c in clients) / sum(work[r, c] for c in clients) for i in range(len(weights))]
    assert all(np.allclose(a, b) for a, b in zip(got, weights))
    rows = {(r["round"], r["client_id"]): r for r in table.collect()}
    assert {k: r["work"] for k, r in rows.items()} == work
    for c, (x, y) in clients.items():
        p = K.dense_forward(x, weights, spec)[-1].reshape(-1)
        r = rows[1, c]
        pos, neg = p[y == 1], p[y == 0]
        area = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) if len(pos) and len(neg) else None
        assert np.isclose(r["accuracy"], ((p > 0.5) == y).mean()) and (r["auc"] is None if area is None else np.isclose(r["auc"], area))


def test_no_clients(spark):
    none = spark.createDataFrame([], "client_id string, idx int, features array<double>, label double")
    weights, table = FD.federated_train(none, [{"units": 1, "activation": "sigmoid"}])
    assert weights == [] and table.count() == 0
