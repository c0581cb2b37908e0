"""Outliers among windows: pred is -1 for an outlier, else 1."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import SENSOR
from ..functions.kernels import block_ids, isolation_score, isolation_trees, merge_nearest
from ..functions.quantiles import exact_quantiles
from ..sources.io import kept, shared_path

#: Windows that isolation trees are grown on, or that robust fits start from, at most.
REFERENCE = 2048
#: Windows that are compared with others as one matrix.
BLOCK = 8192
#: Principal components in which blocks of windows are told apart.
COMPONENTS = 6


def _sample(df: DataFrame, n: int, seed: int) -> np.ndarray:
    """A repeatable sample of ``n`` feature vectors at most."""
    rows = df.select("features").orderBy(F.xxhash64(SENSOR, "idx", F.lit(seed)), SENSOR, "idx").limit(n).collect()
    return np.array([r[0] for r in rows], float)


def _scored(df: DataFrame, score) -> DataFrame:
    """Keys and the score of each window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({SENSOR: rows[SENSOR], "idx": rows["idx"], "score": score(np.stack(rows["features"].to_list()).astype(float))})

    return df.select(SENSOR, "idx", "features").mapInPandas(run, f"{SENSOR} string, idx int, score double")


def _flagged(scores: DataFrame, is_out) -> DataFrame:
    return scores.withColumn("pred", F.when(is_out, -1).otherwise(1))


def isolation_forest(df: DataFrame, trees: int = 10, sample: int = 256, seed: int = 0) -> DataFrame:
    """Short isolation paths: score over 0.5. Trees are grown on a bounded sample."""
    x = _sample(df, REFERENCE, seed)
    forest = isolation_trees(x, trees, sample, seed) if len(x) else [[(-1, 0.0, 0, 0)]]
    return _flagged(_scored(df, lambda v: isolation_score(v, forest, min(sample, max(len(x), 2)))), F.col("score") > 0.5)


def _near_each_other(df: DataFrame, n: int) -> DataFrame:
    """(block, low, high, sensors, idxs, copies, x, at): about BLOCK windows a row that lie near each other, written once; x is their packed matrix.

    Windows are cut at quantiles of their first principal component into slabs, each slab at quantiles of the second. A cell that holds more, as of
    equal windows, is dealt over several blocks by hash. at holds their first COMPONENTS components, low and high the limits of these. ``copies`` of
    ``df``, if there, tells how many windows a row stands for.
    """
    spark, cells = df.sparkSession, -(-n // BLOCK)
    df = df if "copies" in df.columns else df.withColumn("copies", F.lit(1).cast("long"))
    _, mean, cov = _moments(df)
    basis = np.linalg.eigh(cov)[1][:, ::-1][:, :COMPONENTS]
    slabs = max(1, math.isqrt(cells))
    shares = lambda m: [i / m for i in range(1, m)]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                at = (np.stack(rows["features"].to_list()).astype(float) - mean) @ basis
                yield rows[[SENSOR, "idx", "copies", "features"]].assign(a=at[:, 0], b=at[:, min(1, at.shape[1] - 1)])

    rows = kept(df.mapInPandas(placed, f"{SENSOR} string, idx int, copies long, features array<double>, a double, b double"), "components")
    first = np.array(rows.agg(F.percentile_approx("a", shares(slabs))).first()[0] if slabs > 1 else [])
    per = max(1, -(-cells // slabs))

    def slab(a: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first, a.to_numpy()), dtype="int64")

    rows = rows.withColumn("slab", F.pandas_udf(slab, "long")("a"))
    second = {r[0]: np.array(r[1]) for r in rows.groupBy("slab").agg(F.percentile_approx("b", shares(per))).collect()} if per > 1 else {}

    def cell(slab: pd.Series, b: pd.Series) -> pd.Series:
        out = slab.to_numpy() * per
        for s, cuts in second.items():
            own = slab.to_numpy() == s
            out[own] += np.searchsorted(cuts, b.to_numpy()[own])
        return pd.Series(out)

    rows = rows.withColumn("cell", F.pandas_udf(cell, "long")("slab", "b"))
    sizes = sorted((r[0], -(-r[1] // BLOCK)) for r in rows.groupBy("cell").count().collect())
    starts = np.cumsum([0, *(m for _, m in sizes)])
    table = spark.createDataFrame([(int(c), int(s), int(m)) for (c, m), s in zip(sizes, starts)], "cell long, start long, parts long")
    block = (F.col("start") + F.pmod(F.xxhash64(SENSOR, "idx"), F.col("parts"))).cast("int")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([SENSOR, "idx"])
        x = np.stack(rows["features"].to_list()).astype(float)
        at = (x - mean) @ basis
        return pd.DataFrame({"block": [key[0]], "low": [at.min(axis=0)], "high": [at.max(axis=0)], "sensors": [rows[SENSOR].to_list()], "idxs": [rows["idx"].to_list()], "copies": [rows["copies"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "at": [at.tobytes()]})

    dealt = rows.join(F.broadcast(table), "cell").select(SENSOR, "idx", "copies", "features", block.alias("block"))  # a row for each BLOCK windows
    schema = "block int, low array<double>, high array<double>, sensors array<string>, idxs array<int>, copies binary, x binary, at binary"
    # a file for each block, so that readers of some blocks pass the others over
    return kept(dealt.groupBy("block").applyInPandas(pack, schema), "blocks", maxRecordsPerFile=1)


def _gap(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each point is from a box, at least."""
    return np.sqrt((np.maximum(np.maximum(low - at, at - high), 0) ** 2).sum(axis=1))


class _Search:
    """The ``k`` nearest among other rows, so far, of the rows of a block that stand for ``k`` windows at most; those of more have all their neighbours at distance 0."""

    def __init__(self, r, k: int):
        x, copies = np.frombuffer(r.x).reshape(len(r.idxs), -1), np.frombuffer(r.copies, np.int64)
        self.of = np.flatnonzero(copies <= k)
        self.x, self.copies, self.ids = x[self.of], copies[self.of], block_ids(r.block, len(x))[self.of]
        self.at, self.block, self.met = np.frombuffer(r.at).reshape(len(x), -1)[self.of], r.block, 0
        self.best, self.near, self.held = (np.full((len(self.of), k), v, t) for v, t in ((np.inf, float), (-1, np.int64), (0, np.int64)))
        if len(self.of):
            merge_nearest(self.x, x, block_ids(r.block, len(x)), self.of, self.best, self.near, copies, self.held)

    @property
    def reach(self) -> np.ndarray:
        """How far a nearer row may be, with a margin for rounding."""
        return self.best[:, -1] * (1 + 1e-9)

    def meet(self, r) -> None:
        """Rows of another block; own ones whose k-th distance is less than that to its limits are passed over."""
        some = np.flatnonzero(_gap(self.at, np.asarray(r.low), np.asarray(r.high)) <= self.reach)
        if len(some):
            x, copies = np.frombuffer(r.x).reshape(-1, self.x.shape[1]), np.frombuffer(r.copies, np.int64)
            best, near, held = self.best[some], self.near[some], self.held[some]
            merge_nearest(self.x[some], x, block_ids(r.block, len(x)), None, best, near, copies, held)
            self.best[some], self.near[some], self.held[some] = best, near, held

    def found(self, k: int) -> pd.DataFrame:
        """(id, near, distance, times, reach): who is near and how often it counts, its own copies among them; reach is the k-th distance."""
        own = (self.copies - 1)[:, None]
        upto = np.minimum(np.cumsum(np.hstack([own, self.held]), axis=1), k)
        times = np.diff(upto, axis=1, prepend=0)
        near, distance = np.hstack([self.ids[:, None], self.near]), np.hstack([np.zeros(own.shape), self.best])
        some, last = times > 0, (upto < k).sum(axis=1)
        lists = lambda v: [v[i, some[i]] for i in range(len(v))]
        return pd.DataFrame({"id": self.ids, "near": lists(near), "distance": lists(distance), "times": lists(times), "reach": distance[np.arange(len(distance)), last]})


def _meetings(blocks: DataFrame, k: int) -> DataFrame:
    """(to, block, gap, windows): which blocks may hold one of the ``k`` nearest of windows of block ``to``, how far from these they are at least, and of how many windows.

    A window's k-th neighbour within its own block bounds its true one; a block further off, in a few components already, can't hold a nearer one.
    """
    # a box for each BLOCK windows
    known = blocks.select("block", "low", "high").toPandas().sort_values("block")
    numbers, low, high = known["block"].to_numpy(), np.stack(known["low"].to_list()), np.stack(known["high"].to_list())
    shared = blocks.sparkSession.sparkContext.broadcast((numbers, low, high))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, low, high = shared.value
        for rows in batches:
            for r in rows.itertuples(index=False):
                own, found = _Search(r, k), []
                apart = np.sqrt((np.maximum(np.maximum(low - np.asarray(r.high), np.asarray(r.low) - high), 0) ** 2).sum(axis=1))
                for i in np.flatnonzero(apart <= own.reach.max(initial=-1)).tolist():
                    gaps = _gap(own.at, low[i], high[i])
                    of = gaps <= own.reach
                    if of.any():
                        found.append((r.block, numbers[i], gaps[of].min(), int(of.sum())))
                yield pd.DataFrame(found, columns=["to", "block", "gap", "windows"])

    return blocks.mapInPandas(near, "to int, block int, gap double, windows long")


def _nearest(df: DataFrame, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest other windows of each row (features, copies) that stands for ``k`` windows at most, as ``_Search.found`` gives them; and the blocks.

    Blocks whose ids are near search in one job: each meets all blocks that any of them needs, as Spark reads them one after the other. Nothing is shuffled: a
    task holds a block, another one and its running top k, however many meet, and each other block only narrows the search.
    """
    spark = df.sparkSession
    # Python gets a few packed blocks at once
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    blocks = _near_each_other(df, n)
    meetings = kept(_meetings(blocks, k), "meetings")
    numbers = sorted(r[0] for r in meetings.select("to").distinct().collect())  # a number for each BLOCK windows
    path, at_once = shared_path(spark, "nearest"), max(64, 4 * spark.sparkContext.defaultParallelism)
    schema = "id long, near array<long>, distance array<double>, times array<long>, reach double"

    for i in range(0, len(numbers), at_once):
        low, high = numbers[i], numbers[min(i + at_once, len(numbers)) - 1]
        some = F.col("to").between(low, high)
        needed = sorted(r[0] for r in meetings.filter(some).select("block").distinct().collect())

        def run(pairs, needed=len(needed)) -> Iterator[tuple]:
            open_ones: dict[int, _Search] = {}
            for own, other in pairs:
                search = open_ones.get(own.block) or open_ones.setdefault(own.block, _Search(own, k))
                if other.block != own.block:
                    search.meet(other)
                search.met += 1
                if search.met == needed:
                    found = open_ones.pop(own.block).found(k)
                    for at in range(0, len(found), 1024):
                        yield (pickle.dumps(found.iloc[at : at + 1024]),)

        def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for r in rows["packed"]:
                    yield pickle.loads(r)

        own = blocks.filter(F.col("block").between(low, high)).select("block", "idxs", "copies", "x", "at")
        others = blocks.filter(F.col("block").isin(needed)).select("block", "low", "high", "copies", "x").coalesce(1)
        packed = spark.createDataFrame(own.rdd.cartesian(others.rdd).mapPartitions(run), "packed binary", verifySchema=False)
        packed.mapInPandas(unpacked, schema).write.mode("append").parquet(path)
    rows = spark.read.schema(schema).parquet(path) if numbers else spark.createDataFrame([], schema)
    return rows, blocks


def local_outlier_factor(df: DataFrame, k: int = 20, cut: float = 1.5) -> DataFrame:
    """Low local density: factor over ``cut``. Neighbours are the ``k`` nearest among all other windows, whatever their number.

    Equal windows have equal neighbours, so each distinct one searches once. One with more than ``k`` copies has its neighbours at distance 0, and a factor of 1.
    """
    df = _kept(df)
    n = df.count()
    if n <= k:
        return df.select(SENSOR, "idx", F.lit(1.0).alias("score"), F.lit(1).alias("pred"))
    alike = kept(df.groupBy("features").agg(F.count(F.lit(1)).alias("copies")), "alike")
    if alike.filter(F.col("copies") <= k).isEmpty():
        return _flagged(df.select(SENSOR, "idx", F.lit(1.0).alias("score")), F.lit(False))
    # no window in particular: numbers deal and order the distinct ones
    name = F.xxhash64("features")
    rows, blocks = _nearest(alike.select(name.cast("string").alias(SENSOR), F.lit(0).alias("idx"), "copies", "features"), alike.count(), k)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for r in some.itertuples(index=False):
                x = np.frombuffer(r.x).reshape(len(r.copies) // 8, -1)
                ids = block_ids(r.block, len(x))
                for i in range(0, len(x), 1024):
                    yield pd.DataFrame({"id": ids[i : i + 1024], "features": list(x[i : i + 1024])})

    edges = rows.select("id", F.explode(F.arrays_zip("near", "distance", "times")).alias("e")).select("id", "e.near", "e.distance", "e.times")
    many = 1 / F.lit(1e-12)  # the density of a window with more than k copies
    reach = rows.select(F.col("id").alias("near"), "reach")
    mean = F.sum(F.col("times") * F.greatest("distance", F.coalesce("reach", F.lit(0.0)))) / k
    density = kept(edges.join(reach, "near", "left").groupBy("id").agg((1 / F.greatest(mean, F.lit(1e-12))).alias("density")), "density")
    around = edges.join(density.withColumnRenamed("id", "near"), "near", "left").groupBy("id").agg((F.sum(F.col("times") * F.coalesce("density", many)) / k).alias("around"))
    scores = kept(density.join(around, "id").select("id", (F.col("around") / F.col("density")).alias("score")), "scores")
    vectors = blocks.select("block", "copies", "x").mapInPandas(named, "id long, features array<double>")
    scored = df.join(scores.join(vectors, "id").drop("id"), "features", "left")
    return _flagged(scored.select(SENSOR, "idx", F.coalesce("score", F.lit(1.0)).alias("score")), F.col("score") > cut)


def _kept(df: DataFrame) -> DataFrame:
    """Windows written once, as fits read them again and again."""
    return kept(df.select(SENSOR, "idx", "features"), "windows")


def _moments(rows: DataFrame, within=None) -> tuple[int, np.ndarray, np.ndarray]:
    """(windows, mean, covariance) of feature vectors, in one job; ``within``: which rows of a matrix count."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            if len(part):
                x = np.stack(part["features"].to_list()).astype(float)
                x = x if within is None else x[within(x)]
                sums = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
                total = sums if total is None else total + sums
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    # a task's sums, of the size of a covariance matrix, added up by place
    sums = np.array([r[1] for r in rows.select("features").mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v")).orderBy("i").collect()])
    if not len(sums) or not sums[0]:
        return 0, np.empty(0), np.empty((0, 0))
    d = int((math.isqrt(4 * len(sums) - 3) - 1) // 2)
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    return int(n), mean, sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


class _Shape:
    """Distances from a mean in the directions in which data with this covariance spread at all."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        size, vectors = np.linalg.eigh(cov)
        some = size > max(size[-1], 0) * 1e-10
        self.mean, self.rank = mean, int(some.sum())
        self.axes = vectors[:, some] / np.sqrt(size[some])
        self.volume = float(np.log(size[some]).sum())

    def distance(self, x: np.ndarray) -> np.ndarray:
        """Squared."""
        return (((x - self.mean) @ self.axes) ** 2).sum(axis=1)


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-squared distribution, by its cube root's normal approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def _starts(x: np.ndarray, share: float, seed: int, starts: int, best: int) -> list[_Shape]:
    """The tightest shapes that hold ``share`` of a sample, from many small random starts."""
    rng, h = np.random.default_rng(seed), max(int(np.ceil(share * len(x))), 2)

    def tighter(shape: _Shape, steps: int) -> _Shape:
        for _ in range(steps):
            near = x[np.argpartition(shape.distance(x), h - 1)[:h]]
            shape = _Shape(near.mean(axis=0), np.cov(near.T, bias=True).reshape(x.shape[1], -1))
        return shape

    rank = _Shape(x.mean(axis=0), np.cov(x.T, bias=True).reshape(x.shape[1], -1)).rank
    few = [x[rng.choice(len(x), min(rank + 1, len(x)), replace=False)] for _ in range(starts)]
    shapes = sorted((tighter(_Shape(f.mean(axis=0), np.cov(f.T, bias=True).reshape(x.shape[1], -1)), 2) for f in few), key=lambda s: (-s.rank, s.volume))[:best]
    return sorted((tighter(s, 20) for s in shapes), key=lambda s: (-s.rank, s.volume))


def robust_shape(df: DataFrame, share: float = 0.5, seed: int = 0, starts: int = 200, best: int = 10, finalists: int = 2, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) that up to ``1 - share`` of the windows can't bend: the least determinant of ``share`` of them.

    Starts of as many random windows as the rank needs concentrate on a bounded sample (REFERENCE): each step keeps
    the nearest and takes their mean and covariance. The ``finalists`` of least determinant then concentrate on all windows, whose
    distances are cut at their exact quantile, until the determinant falls no more. The best is scaled to the median distance of normal data, and once
    more fitted to all windows within its 97.5 % ellipsoid.
    """
    sample = _sample(df, REFERENCE, seed)
    if len(sample) < 2:
        raise ValueError("at least two windows are needed")
    results = []
    for shape in _starts(sample, share, seed, starts, best)[:finalists]:
        for _ in range(steps):
            cut = exact_quantiles(_scored(df, shape.distance), "score", (share,))[0]
            _, mean, cov = _moments(df, lambda x, s=shape, c=cut: s.distance(x) <= c)
            new = _Shape(mean, cov)
            done = new.rank < shape.rank or new.volume >= shape.volume - 1e-9
            shape, final = new, (mean, cov)
            if done:
                break
        results.append((-shape.rank, shape.volume, final))
    mean, cov = min(results, key=lambda r: r[:2])[2]
    shape = _Shape(mean, cov)
    cov = cov * exact_quantiles(_scored(df, shape.distance), "score", (0.5,))[0] / chi2_quantile(0.5, max(shape.rank, 1))
    shape, limit = _Shape(mean, cov), chi2_quantile(0.975, max(shape.rank, 1))
    n, again, spread = _moments(df, lambda x: shape.distance(x) <= limit)
    return (again, spread) if n > len(mean) else (mean, cov)


def mahalanobis_outliers(df: DataFrame, contamination: float = 0.1, share: float = 0.5, seed: int = 0) -> DataFrame:
    """The share ``contamination`` of windows with the largest squared distance from a robust mean and covariance."""
    df = _kept(df)
    if df.isEmpty():
        return _flagged(_scored(df, lambda x: np.zeros(len(x))), F.lit(False))
    mean, cov = robust_shape(df, share, seed) if df.limit(2).count() > 1 else (np.zeros(len(df.first()["features"])), np.zeros((1, 1)))
    scores = _scored(df, _Shape(mean, cov).distance if len(cov) == len(mean) else lambda x: np.zeros(len(x)))
    return _flagged(scores, F.col("score") > F.lit(exact_quantiles(scores, "score", (1 - contamination,))[0]))


def channel_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Squared Mahalanobis distance of two channels from their mean, in column functions only."""
    m = df.agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"), F.var_samp(a).alias("__va"), F.var_samp(b).alias("__vb"), F.covar_samp(a, b).alias("__c"))
    x, y = F.col(a) - F.col("__ma"), F.col(b) - F.col("__mb")
    det = F.col("__va") * F.col("__vb") - F.col("__c") * F.col("__c")
    value = (F.col("__vb") * x * x - 2 * F.col("__c") * x * y + F.col("__va") * y * y) / F.nullif(det, F.lit(0.0))
    return df.crossJoin(F.broadcast(m)).withColumn("distance", value).select(*df.columns, "distance")


def reconstruction_outliers(df: DataFrame, k: int = 32, q: float = 0.95) -> DataFrame:
    """Windows that ``k`` principal components rebuild worst: squared error over the quantile ``q``.

    As many components as the data's rank rebuild every window, so that errors are rounding only: more
    than half the rank is an error.
    """
    df = _kept(df)
    n, mean, cov = _moments(df)
    if not n:
        return _flagged(_scored(df, lambda x: np.zeros(len(x))), F.lit(False))
    size, vectors = np.linalg.eigh(cov)
    rank = int((size > max(size[-1], 0) * 1e-9).sum())
    if 2 * k > rank:
        raise ValueError(f"{k} components for windows of rank {rank}: at most half the rank")
    basis = vectors[:, -k:]
    scores = _scored(df, lambda x: ((x - mean - (x - mean) @ basis @ basis.T) ** 2).mean(axis=1))
    return _flagged(scores, F.col("score") > F.lit(exact_quantiles(scores, "score", (q,))[0]))


ALGORITHMS = {
    "isolation_forest": isolation_forest,
    "local_outlier_factor": local_outlier_factor,
    "elliptic_envelope": mahalanobis_outliers,
    "autoencoder": reconstruction_outliers,
}


def detect_outliers(df: DataFrame, algorithm: str, **options) -> DataFrame:
    """The detector of a name; an unknown name is an error."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {algorithm}; known: {sorted(ALGORITHMS)}")
    return ALGORITHMS[algorithm](df, **options)
