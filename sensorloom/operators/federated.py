"""Federated averaging: client data, local training, quantisation, averages and rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import SENSOR, uniform
from ..functions.kernels import dense_forward, float16_round_trip, group_metrics, initial_weights, int8_round_trip, train_batches, train_clients
from ..functions.scans import OWN, in_frame, in_frames
from ..sources.io import append_metrics, kept, shared_path, swept
from .labels import label_reach
from .metrics import binary_metrics
from .windows import flat_features

#: Positions of a client that one task trains on.
SHARD = 1500
#: Packed shards that are trained side by side.
ABREAST = 512
UPDATES = "round int, client_id string, layer int, n long, work long, loss double, weights array<double>"
METRICS = ("accuracy", "precision", "recall", "log_loss", "auc")


def assign_clients(df: DataFrame, k: int = 10, group: str | None = None) -> DataFrame:
    """``client_id``: k contiguous runs of n // k rows of idx; the rest is dropped. Positions may count per ``group``."""
    w = Window.partitionBy(group) if group else None
    if w is None:
        n = df.agg(F.floor(F.count(F.lit(1)) / k).alias("__size"))
        rows = df.crossJoin(F.broadcast(n))
    else:
        rows = df.withColumn("__size", F.floor(F.count(F.lit(1)).over(w) / k))
    client = F.floor(F.col("idx") / F.nullif("__size", F.lit(0)))
    return rows.withColumn("client_id", client.cast("int")).filter(F.col("client_id") < k).drop("__size")


def client_samples(windows: DataFrame, n: int = 1500) -> DataFrame:
    """A sensor is a client; its first ``n`` windows."""
    return windows.filter(F.col("idx") < n).withColumn("client_id", F.col(SENSOR))


def training_table(df: DataFrame, errors: DataFrame, window: int = 20) -> DataFrame:
    """Windows and their labels (those of ``sliding_windows`` and ``label_windows``) side by side.

    Errors are joined to rows, and both are frames over the same rows, so no window is shuffled. Sensors without a name are left out.
    """
    before, after = label_reach(window)
    rows = in_frames(df.filter(F.col(SENSOR).isNotNull()), before, max(after, window - 1))
    rows = rows.join(errors.select(SENSOR, "idx", F.lit(1).alias("__e")).distinct(), [SENSOR, "idx"], "left")
    features = flat_features(window)
    label = F.coalesce(F.max("__e").over(in_frame().rowsBetween(-before, after)), F.lit(0)).cast("double")
    rows = rows.withColumns({"features": features, "label": label}).filter(F.col(OWN) & (F.col("idx") < F.col("__n") - window))
    return rows.select(SENSOR, F.col("idx").cast("int").alias("idx"), "features", "label")


def fed_avg(updates: DataFrame, weight: str | None = None, by: tuple[str, ...] = ("round", "layer")) -> DataFrame:
    """Mean weights of all clients, plain or weighted by a column, element by element."""
    rows = updates.select(*by, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), F.posexplode("weights").alias("pos", "v"))
    means = rows.groupBy(*by, "pos").agg((F.sum(F.col("__w") * F.col("v").cast("double")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias("v"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("weights"))


def partial_batches(df: DataFrame, batches: int = 9, rows: int = 50) -> DataFrame:
    """Batch b of a client holds rows [b, b + rows): each row with the batches it is in."""
    first, last = F.greatest(F.col("idx") - rows + 1, F.lit(0)), F.least(F.col("idx"), F.lit(batches - 1))
    return df.filter(first <= last).withColumn("batch", F.explode(F.sequence(first, last)))


def quantize_f16(df: DataFrame, col: str = "weights") -> DataFrame:
    """Weights after a round trip through half precision."""

    @F.pandas_udf("array<float>")
    def halved(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return df.withColumn(col, halved(F.col(col).cast("array<double>")))


def quantize_i8(df: DataFrame, by: tuple[str, ...] = ("client_id", "layer")) -> DataFrame:
    """Weights as bytes: cut to two deviations around the mean, scaled to [-1, 1] by their limits, times 127, half to even."""
    rows = df.select(*by, F.posexplode("weights").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"m": F.avg("v").over(w), "s": F.stddev_pop("v").over(w)})
    rows = rows.withColumn("v", F.greatest(F.least("v", F.col("m") + 2 * F.col("s")), F.col("m") - 2 * F.col("s")))
    rows = rows.withColumns({"low": F.min("v").over(w), "high": F.max("v").over(w)})
    scaled = F.coalesce((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5)) * 2 - 1
    rows = rows.withColumn("q", F.rint(scaled * 127).cast("tinyint"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"])
    return rows.groupBy(*by).agg(packed.alias("weights"), F.first("low").alias("min"), F.first("high").alias("max"))


def dequantize_i8(df: DataFrame) -> DataFrame:
    """Bytes back to weights within their limits."""
    value = F.transform("weights", lambda q: (q / F.lit(127.0) + 1) / 2 * (F.col("max") - F.col("min")) + F.col("min"))
    return df.withColumn("weights", value)


def balance_classes(df: DataFrame, seed: int | None = 0, label: str = "label", keys: tuple[str, ...] = (SENSOR, "idx")) -> DataFrame:
    """As many rows of each label as the rarest has; by hash order, or by key order without seed.

    Rows are ranked within pieces of their label, so no task ranks a whole class: in hash buckets, or in the ranges that
    Spark sorts a table into.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.min("n").alias("__least"))
    if seed is None:
        order = [F.col(k) for k in keys]
        rows = df.repartitionByRange(label, *order).withColumn("__b", F.spark_partition_id())
        # both readings below must see the same ranges, also after an executor is lost
        path = shared_path(df.sparkSession, "ranges")
        rows.write.parquet(path)
        rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    else:
        draw = uniform(seed, *keys)
        order = [draw, *[F.col(k) for k in keys]]
        rows = df.withColumn("__b", F.floor(draw * 256))
    sizes = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.join(before, [label, "__b"]).withColumn("__rn", F.row_number().over(Window.partitionBy(label, "__b").orderBy(*order)) + F.col("__before"))
    return ranked.crossJoin(F.broadcast(least)).filter("__rn <= __least").select(*df.columns)


def make_batches(df: DataFrame, epochs: int = 5, batch: int = 40, seed: int | None = 0, by: str = SENSOR) -> DataFrame:
    """Rows repeated for each epoch, shuffled, in batches; per sensor."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    order = [F.xxhash64(by, "idx", "epoch", F.lit(seed)), F.col("idx")] if seed is not None else [F.col("idx")]
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by, "epoch").orderBy(*order)) - 1) / batch))


def work_of(rounds: list[int] | range, clients: DataFrame, seed: int = 0, least: int = 5, most: int = 10) -> DataFrame:
    """(round, client_id, work): how much each client does in each round, ``least`` to ``most``, drawn by hash; it trains on ``work - 1`` batches."""
    each = clients.select(F.col("client_id").cast("string").alias("client_id")).withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))
    return each.select("round", "client_id", (least + F.floor((most - least + 1) * uniform(seed, "client_id", "round"))).cast("int").alias("work"))


def _packed(data: DataFrame) -> DataFrame:
    """(client_id, shard, n, x, y): the rows of SHARD positions of a client as one, in order of idx; x and y are their bytes, written once.

    Rows are packed as they come, so the shuffle moves a piece of a shard for each batch that has rows of it, not each row.
    """
    names = ["client_id", "shard", "n", "idx", "x", "y"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            idx, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("idx", np.int64), ("label", float)))
            codes = pc.fill_null(batch.column("client_id").dictionary_encode().indices, -1).to_numpy().astype(np.int64)
            shard = idx // SHARD
            order = np.lexsort((idx, shard, codes))
            new = np.append(True, (codes[order][1:] != codes[order][:-1]) | (shard[order][1:] != shard[order][:-1]))
            ends = np.append(np.flatnonzero(new), len(order)).tolist()
            parts = [order[i:j] for i, j in zip(ends, ends[1:])]
            heads = pa.array([p[0] for p in parts])
            yield pa.RecordBatch.from_arrays([batch.column("client_id").take(heads), pa.array(shard[heads.to_numpy()]), pa.array([len(p) for p in parts], pa.int64()), *[pa.array([v[p].tobytes() for p in parts], pa.binary()) for v in (idx, x, y)]], names=names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def whole() -> dict:
            """The pieces of a shard as one."""
            idx = np.concatenate([np.frombuffer(r["idx"], np.int64) for r in held])
            order = np.argsort(idx, kind="stable")
            x, y = (np.concatenate([np.frombuffer(r[c]) for r in held]) for c in ("x", "y"))
            return {"client_id": key[0], "shard": key[1], "n": len(idx), "idx": idx[order].tobytes(), "x": x.reshape(len(idx), -1)[order].tobytes(), "y": y[order].tobytes()}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if (r["client_id"], r["shard"]) != key:
                    if held:
                        done.append(held[0] if len(held) == 1 else whole())
                    key, held = (r["client_id"], r["shard"]), []
                held.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=batch.schema)
        if held:
            yield pa.RecordBatch.from_pylist([held[0] if len(held) == 1 else whole()], schema=batch.schema)

    schema = "client_id string, shard long, n long, idx binary, x binary, y binary"
    rows = data.select(F.col("client_id").cast("string").alias("client_id"), F.col("idx").cast("long").alias("idx"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))
    # Python gets shards by bytes, as a row holds up to SHARD windows
    data.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    spread = rows.mapInArrow(pieces, schema).repartition("client_id", "shard").sortWithinPartitions("client_id", "shard")
    return kept(spread.mapInArrow(merged, schema).drop("idx"), "clients")


def _clients(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(x, y, sizes, rows of the batch) of some packed shards at a time, the largest first."""
    if not batch.num_rows:
        return
    sizes = batch.column("n").to_numpy()
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), ABREAST):
        rows = order[i : i + ABREAST]
        x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist())) for c in ("x", "y"))
        yield x.reshape(len(y), -1), y, sizes[rows], pa.array(rows)


def _averaged(parts: DataFrame, partial: bool = False) -> DataFrame:
    """Weights and losses of a client's shards (round, client_id, layer, n, work, loss, weights) averaged by rows."""
    by = ("round", "client_id", "layer")
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    places = parts.select(*by, "n", "work", "loss", F.posexplode("weights").alias("pos", "v")).groupBy(*by, "pos").agg(mean("v"), mean("loss"), F.sum("n").alias("n"), (F.max("work") if partial else F.sum("work")).alias("work"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    return places.groupBy(*by).agg(F.first("n").alias("n"), F.first("work").alias("work"), F.first("loss").alias("loss"), packed.alias("weights"))


def _train_shards(packed: DataFrame, weights: list[np.ndarray], spec: list[dict], round_no: int, batch: int, rate: float) -> DataFrame:
    """One epoch on each shard: its weights by layer, rows and loss."""
    shared = packed.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for x, y, sizes, rows in _clients(got):
                new, loss = train_clients(x, y, sizes, shared.value, spec, batch, rate)
                names, m = got.column("client_id").take(rows), len(sizes)
                for layer, w in enumerate(new):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, round_no, np.int32)), names, pa.array(np.full(m, layer, np.int32)), pa.array(sizes), pa.array(sizes), pa.array(loss), pa.array(list(w.reshape(m, -1)), pa.list_(pa.float64()))], names=["round", "client_id", "layer", "n", "work", "loss", "weights"])

    return packed.mapInArrow(run, UPDATES)


def local_train(data: DataFrame, weights: list[np.ndarray], spec: list[dict], round_no: int = 0, batch: int = 32, rate: float = 1e-3, work: DataFrame | None = None, rows: int = 50) -> DataFrame:
    """One epoch on each client's (client_id, idx, features, label): its weights by layer, rows, loss and work.

    A client's rows are trained on in shards of SHARD positions, whose weights and losses are averaged by rows. With ``work`` (client_id, work) a
    client does ``work - 1`` batches only, batch b on its rows from position b to b + ``rows``; its work is then that number and a client without any isn't in the result.
    """
    if work is None:
        return _averaged(_train_shards(_packed(data), weights, spec, round_no, batch, rate))
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        x, y = np.stack(own["features"].to_list()).astype(float), own["label"].to_numpy(float)
        at, n = own["idx"].to_numpy(), int(own["work"].iloc[0])
        parts = [np.flatnonzero((at >= b) & (at < b + rows)) for b in range(n - 1)]
        parts = [p for p in parts if len(p)]
        new = train_batches([(x[p], y[p]) for p in parts], shared.value, spec, rate)
        p = np.clip(dense_forward(x, new, spec)[-1].reshape(-1), 1e-7, 1 - 1e-7)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        return pd.DataFrame({"round": round_no, "client_id": key[0], "layer": range(len(new)), "n": len(own), "work": n, "loss": loss, "weights": [w.reshape(-1).tolist() for w in new]})

    slim = data.select(F.col("client_id").cast("string").alias("client_id"), F.floor(F.col("idx") / SHARD).alias("shard"), "idx", "features", "label")
    slim = slim.join(work.select("client_id", "work"), "client_id").filter(F.col("idx") < F.col("work") - 2 + rows)
    return _averaged(slim.groupBy("client_id", "shard").applyInPandas(run, UPDATES), True)


ROUND_TRIPS = {"float16": float16_round_trip, "int8": int8_round_trip}


def _train_round(packed: DataFrame, weights: list[np.ndarray], spec: list[dict], variant: str, batch: int, rate: float) -> DataFrame:
    """(client_id, n, loss, total, sums): a row for each client, who has one shard, and one for each task with the sums of what its clients send, by which ``fed_avg`` means."""
    shared = packed.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, 0.0
        names = ["client_id", "n", "loss", "total", "sums"]
        row = lambda c, n, loss, t, s: pa.RecordBatch.from_arrays([c, pa.array(n, pa.int64()), pa.array(loss, pa.float64()), pa.array(t, pa.float64()), pa.array(s, pa.list_(pa.float64()))], names=names)
        for got in batches:
            for x, y, sizes, rows in _clients(got):
                new, loss = train_clients(x, y, sizes, shared.value, spec, batch, rate)
                sent = np.hstack([ROUND_TRIPS.get(variant, lambda v: v)(w.reshape(len(sizes), -1)) for w in new])
                counts = sizes.astype(float) if variant == "weighted" else np.ones(len(sizes))
                total, sums = total + counts.sum(), sums + counts @ sent
                none = [None] * len(sizes)
                yield row(got.column("client_id").take(rows), sizes, loss, none, none)
        if total:
            yield row(pa.array([None], pa.string()), [None], [None], [total], [sums])

    return packed.mapInArrow(run, "client_id string, n long, loss double, total double, sums array<double>")


def _scored(packed: DataFrame, weights: list[np.ndarray], spec: list[dict]) -> DataFrame:
    """What ``binary_metrics`` gives for a model on the rows of each client, who has one shard."""
    shared = packed.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for x, y, sizes, rows in _clients(got):
                found = group_metrics(y, dense_forward(x, shared.value, spec)[-1].reshape(-1), sizes)
                yield pa.RecordBatch.from_arrays([got.column("client_id").take(rows), *[pa.array(v, mask=np.isnan(v)) for v in found.T]], names=["client_id", *METRICS])

    return packed.mapInArrow(run, "client_id string, " + ", ".join(f"{c} double" for c in METRICS))


def _unpacked(packed: DataFrame) -> DataFrame:
    """(client_id, idx, features, label) of packed shards; idx counts within a shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for r in some.itertuples(index=False):
                x = np.frombuffer(r.x).reshape(r.n, -1)
                yield pd.DataFrame({"client_id": r.client_id, "idx": range(r.n), "features": list(x), "label": np.frombuffer(r.y)})

    return packed.select("client_id", "n", "x", "y").mapInPandas(run, "client_id string, idx long, features array<double>, label double")


def predicted(data: DataFrame, weights: list[np.ndarray], spec: list[dict]) -> DataFrame:
    """(client_id, idx, y_true, score) of a model on all clients' rows."""
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                score = dense_forward(np.stack(rows["features"].to_list()).astype(float), shared.value, spec)[-1].reshape(-1)
                yield pd.DataFrame({"client_id": rows["client_id"], "idx": rows["idx"], "y_true": rows["label"], "score": score})

    return data.select(F.col("client_id").cast("string").alias("client_id"), F.col("idx").cast("long").alias("idx"), "features", F.col("label").cast("double").alias("label")).mapInPandas(run, "client_id string, idx long, y_true double, score double")


VARIANTS = ("plain", "weighted", "partial", "float16", "int8")


def federated_train(data: DataFrame, spec: list[dict], rounds: int = 5, variant: str = "plain", seed: int = 0, rate: float = 1e-3) -> tuple[list[np.ndarray], DataFrame]:
    """Rounds of local training and averaging: the last weights, and a table of all rounds and clients.

    variant: plain, weighted (by rows), partial (clients do some batches, drawn for each round, and count by their work), float16 or int8 (weights travel
    quantised). The table has round, client_id, n, work, loss (after local training) and, of the round's averaged model on the client's rows,
    accuracy, precision, recall, log_loss and auc. Only averaged weights reach the driver; the table is written as it comes. Without rows there
    are no rounds, and the weights are empty.

    Clients of SHARD positions at most are packed once and train many at a time, where they are read; of what they send a task keeps the sum. The updates of
    larger ones, and of all in partial rounds, are written and averaged from there.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    spark, path = data.sparkSession, shared_path(data.sparkSession, "rounds")
    partial = variant == "partial"
    if partial:
        short, data = None, kept(data.select(F.col("client_id").cast("string").alias("client_id"), "idx", "features", "label"), "clients")
        first, large = data.select(F.size("features")).first(), True
    else:
        packed = _packed(data)
        first = packed.select((F.length("x") / F.length("y")).cast("int")).first()
        of = packed.groupBy("client_id").count().filter("count > 1").select(F.col("client_id").alias("__client"))
        large = first is not None and not of.isEmpty()
        same = F.col("client_id").eqNullSafe(F.col("__client"))
        short, data = (packed.join(of, same, "left_anti"), packed.join(of, same, "left_semi")) if large else (packed, None)
    weights = initial_weights(first[0], spec, seed) if first else []
    clients = data.select("client_id").distinct() if partial else None
    for r in range(rounds if first else 0):
        total, sums = 0.0, 0.0
        stats, scores = [], []
        if short is not None:
            done = kept(_train_round(short, weights, spec, variant, 32, rate), "round")
            stats.append(done.filter("n IS NOT NULL").select(F.lit(r).alias("round"), "client_id", "n", F.col("n").alias("work"), "loss"))
            # a row for each weight, added up over tasks
            added = done.filter("n IS NULL").select("total", F.posexplode("sums").alias("pos", "v")).groupBy("pos").agg(F.sum("total").alias("total"), F.sum("v").alias("v")).orderBy("pos").collect()
            total, sums = (added[0]["total"], np.array([a["v"] for a in added])) if added else (0.0, 0.0)
        if large:
            new = local_train(data, weights, spec, r, rate=rate, work=work_of([r], clients, seed)) if partial else _averaged(_train_shards(data, weights, spec, r, 32, rate))
            updates = kept(new, "updates")
            sent = quantize_f16(updates) if variant == "float16" else dequantize_i8(quantize_i8(updates, ("round", "client_id", "layer"))) if variant == "int8" else updates
            weight = {"weighted": "n", "partial": "work"}.get(variant)
            mean = fed_avg(sent, weight).orderBy("layer").collect()
            own = updates.filter("layer = 0")
            share = float(own.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0])
            total, sums = total + share, sums + share * np.concatenate([m["weights"] for m in mean])
            stats.append(own.select("round", "client_id", "n", "work", "loss"))
        flat = np.split(sums / total, np.cumsum([w.size for w in weights])[:-1])
        weights = [v.reshape(w.shape) for v, w in zip(flat, weights)]
        if short is not None:
            scores.append(_scored(short, weights, spec))
        if large:
            scores.append(binary_metrics(predicted(data if partial else _unpacked(data), weights, spec), by=("client_id",)))
        with swept(spark):
            for rows, scored in zip(stats, scores):
                append_metrics(rows.join(scored, "client_id"), f"{path}/metrics")
    columns = "client_id string, round int, n long, work long, loss double, " + ", ".join(f"{c} double" for c in METRICS)
    return weights, spark.read.schema(columns).parquet(f"{path}/metrics") if first else spark.createDataFrame([], columns)
