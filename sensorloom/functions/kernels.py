"""Small numpy helpers for recursions and model fits; Spark deals the series and clients out."""

from __future__ import annotations

import numpy as np


def savgol_weights(window: int, poly: int, at: float | None = None) -> np.ndarray:
    """Weights of the values of a window whose polynomial fit is read at position ``at`` (default: the middle)."""
    x = np.arange(window, dtype=float) - ((window - 1) / 2 if at is None else at)
    return np.linalg.pinv(np.vander(x, poly + 1, increasing=True))[0]


def local_fits(x: np.ndarray, y: np.ndarray, robust: np.ndarray, first: int | np.ndarray, n: int | np.ndarray, k: int, block: int = 1 << 20) -> np.ndarray:
    """Local lines at positions ``x`` of a series of ``n``, over the ``k`` nearest positions with tricube weights.

    ``y`` and ``robust`` (further weights) hold the series from position ``first`` on, as far as it is needed. Of rows of many series, ``first`` and ``n`` are
    arrays: where position 0 of a row's series is in ``y``, as a negative number, and how long it is. Memory is bounded by ``block``.
    """
    out, size = np.empty(len(x)), max(1, block // k)
    for low in range(0, len(x), size):  # some rows at a time: n * k numbers would not fit
        here = x[low : low + size].astype(float)
        start, end = (v if np.isscalar(v) else v[low : low + size] for v in (first, n))
        at = np.clip(here.astype(np.int64) - k // 2, 0, end - k)[:, None] + np.arange(k)
        place = at - (start if np.isscalar(start) else start[:, None])
        distance = np.abs(at - here[:, None])
        reach = np.maximum(distance.max(axis=1, keepdims=True), 1e-12)
        w = np.clip(1 - (distance / reach) ** 3, 0, None) ** 3 * robust[place]
        total = np.maximum(w.sum(axis=1), 1e-12)
        mx, my = (w * at).sum(axis=1) / total, (w * y[place]).sum(axis=1) / total
        dx = at - mx[:, None]
        var = (w * dx * dx).sum(axis=1)
        slope = np.divide((w * dx * (y[place] - my[:, None])).sum(axis=1), var, out=np.zeros(len(here)), where=var > 1e-12)
        out[low : low + len(here)] = my + slope * (here - mx)
    return out


def run_medians(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row the median of its run; ``start`` holds where each row's run begins."""
    ordered = v[np.lexsort((v, start))]
    size = np.bincount(start, minlength=len(v))[start]
    return (ordered[start + (size - 1) // 2] + ordered[start + size // 2]) / 2


def lowess_runs(y: np.ndarray, start: np.ndarray, k: int, iters: int = 3) -> np.ndarray:
    """``lowess`` over the ``k`` nearest known values of runs of rows, all at once; ``start`` holds where each row's run begins."""
    out, seen = np.full(len(y), np.nan), ~np.isnan(y)
    y, start = y[seen], run_starts(start[seen])
    n, at = np.bincount(start, minlength=len(y))[start], np.arange(len(y))
    near = np.minimum(n, max(2, k))
    fitted, robust, on = y.astype(float), np.ones(len(y)), n >= 3
    for i in range(iters + 1):
        for width in np.unique(near[on]).tolist():  # series shorter than k have widths of their own
            of = np.flatnonzero(on & (near == width))
            fitted[of] = local_fits(at[of] - start[of], y, robust, -start[of], n[of], width)
        if i < iters:
            spread = 6 * run_medians(np.abs(y - fitted), start)
            on = on & (spread > 1e-12)  # a series that is fitted exactly keeps its fit
            robust[on] = np.clip(1 - ((y[on] - fitted[on]) / spread[on]) ** 2, 0, None) ** 2
    out[seen] = fitted
    return out


def lowess(y: np.ndarray, frac: float = 0.1, iters: int = 3, block: int = 1 << 20) -> np.ndarray:
    """Robust local linear fit over the position, with tricube weights of the nearest frac * n points.

    Unknown values stay unknown; the fit is over the positions of the others.
    """
    seen = ~np.isnan(y)
    if not seen.all():
        out = np.full(len(y), np.nan)
        out[seen] = lowess(y[seen], frac, iters, block)
        return out
    n = len(y)
    k = min(n, max(2, int(np.ceil(frac * n))))
    if n < 3:
        return y.astype(float)
    robust, fitted = np.ones(n), y.astype(float)
    for _ in range(iters + 1):
        fitted = local_fits(np.arange(n), y, robust, 0, n, k, block)
        spread = 6 * np.median(np.abs(y - fitted))
        if spread <= 1e-12:
            break
        robust = np.clip(1 - ((y - fitted) / spread) ** 2, 0, None) ** 2
    return fitted


class LevelSteps:
    """Steps of the local-level filter as maps of (mean, variance) that compose in any grouping; each field has a value per step and channel.

    A step sends mean m and variance p to a (m + p g) / (1 + p j) + b and a p a / (1 + p j) + c. A step with a = 0 forgets what
    was before: it is a state.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, g: np.ndarray, j: np.ndarray):
        self.fields = a, b, c, g, j

    @classmethod
    def of(cls, values: np.ndarray, q: float, r: float) -> "LevelSteps":
        """A step for each row of values; an unknown value only adds variance."""
        known, gain = ~np.isnan(values), q / (q + r)
        return cls(np.where(known, 1 - gain, 1.0), np.where(known, gain * values, 0.0), np.where(known, (1 - gain) * q, q), np.where(known, values / (q + r), 0.0), np.where(known, 1 / (q + r), 0.0))

    @classmethod
    def state(cls, mean: np.ndarray, variance: np.ndarray) -> "LevelSteps":
        zero = np.zeros_like(mean)
        return cls(zero, mean, variance, zero, zero)

    def __getitem__(self, at) -> "LevelSteps":
        return LevelSteps(*[f[at] for f in self.fields])

    def put(self, at, other: "LevelSteps") -> None:
        for f, new in zip(self.fields, other.fields):
            f[at] = new

    def then(self, following: "LevelSteps") -> "LevelSteps":
        """Both, one after the other."""
        (a, b, c, g, j), (a2, b2, c2, g2, j2) = self.fields, following.fields
        d = 1 / (1 + c * j2)
        return LevelSteps(a2 * d * a, a2 * d * (b + c * g2) + b2, a2 * d * c * a2 + c2, a * d * (g2 - j2 * b) + g, a * d * j2 * a + j)

    def running(self, start: np.ndarray) -> "LevelSteps":
        """Each step with all before it in its run; ``start`` holds where each row's run begins."""
        out, at = LevelSteps(*[f.copy() for f in self.fields]), np.arange(len(start))
        step = 1
        while step < len(start):
            rows = np.flatnonzero(at - step >= start)
            if not len(rows):
                break
            out.put(rows, out[rows - step].then(out[rows]))
            step *= 2
        return out


def run_starts(key: np.ndarray) -> np.ndarray:
    """For each row, where its run of equal keys begins."""
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)


def kalman_runs(values: np.ndarray, start: np.ndarray, q: float, r: float, p0: float, mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels, variances) of runs of rows, all at once; ``mean`` and ``variance``, a row per row, are the states before a run (NaN: none yet).

    The first known value of a series is its prior mean and is updated as it is; before it there is no level.
    """
    known = ~np.isnan(values)
    steps = LevelSteps.of(values, q, r)
    has = ~np.isnan(mean)
    seen = np.cumsum(known, axis=0)
    before = np.where(start[:, None] > 0, seen[start - 1], 0)
    seen -= before
    first = known & (seen == 1) & ~has[start]
    heads = np.unique(start)
    entered = LevelSteps.state(mean[heads], variance[heads]).then(steps[heads])
    keep = has[heads]
    steps.put(heads, LevelSteps(*[np.where(keep, new, old) for new, old in zip(entered.fields, steps[heads].fields)]))
    steps.put(first, LevelSteps.state(values[first], np.full(int(first.sum()), p0 * r / (p0 + r))))
    _, level, spread, *_ = steps.running(start).fields
    none = ~has[start] & (seen == 0)
    return np.where(none, np.nan, level), np.where(none, np.nan, spread)


class HoltWinters:
    """Additive trend and season of one channel, a value at a time; smoothing weights of least squared error within a grid, all at once.

    An unknown value counts as the one that was expected. Two seasons are needed to start from, each with a known value; values before them are left out.
    """

    def __init__(self, season: int, grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.8)):
        self.season, self.waiting, self.n = season, [], 0
        self.weights = [x.reshape(-1) for x in np.meshgrid(grid, grid, grid, indexing="ij")]

    def add(self, values: np.ndarray) -> None:
        for value in values.tolist():
            if self.n:
                self._step(value)
                continue
            self.waiting.append(value)
            if len(self.waiting) == 2 * self.season:
                y = np.array(self.waiting)
                if np.isnan(y[: self.season]).all() or np.isnan(y[self.season :]).all():
                    del self.waiting[0]
                    continue
                self._start(y)
                self.waiting = []

    def _start(self, y: np.ndarray) -> None:
        first, second = np.nanmean(y[: self.season]), np.nanmean(y[self.season :])
        m = len(self.weights[0])
        self.level, self.trend, self.error = np.full(m, first), np.full(m, (second - first) / self.season), np.zeros(m)
        self.seasonal = np.tile(np.nan_to_num(y[: self.season] - first), (m, 1))
        for value in y.tolist():
            self._step(value)

    def _step(self, value: float) -> None:
        t, self.n = self.n % self.season, self.n + 1
        if value != value:
            self.level = self.level + self.trend
            return
        a, b, g = self.weights
        s, expected = self.seasonal[:, t], self.level + self.trend
        self.error += (value - expected - s) ** 2
        new = a * (value - s) + (1 - a) * expected
        self.trend = b * (new - self.level) + (1 - b) * self.trend
        self.seasonal[:, t] = g * (value - new) + (1 - g) * s
        self.level = new

    def ahead(self, horizon: int) -> np.ndarray:
        """The next values; without two seasons, the last known one."""
        if not self.n:
            known = [v for v in self.waiting if v == v]
            return np.full(horizon, known[-1] if known else np.nan)
        best, steps = int(np.argmin(self.error)), np.arange(1, horizon + 1)
        return self.level[best] + steps * self.trend[best] + self.seasonal[best, (self.n + steps - 1) % self.season]


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of ``n`` points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_trees(x: np.ndarray, trees: int, sample: int, seed: int) -> list[list[tuple]]:
    """Trees as node lists (feature, cut, left, right) or (-1, path beyond, 0, 0)."""
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(min(sample, len(x)), 2))))
    forest = []
    for _ in range(trees):
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append((-1, average_path(len(rows)), 0, 0))
            spread = np.flatnonzero(x[rows].max(axis=0) > x[rows].min(axis=0)) if len(rows) > 1 else ()
            if level < depth and len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(x[rows, f].min(), x[rows, f].max())
                under = x[rows, f] < cut
                left = grow(rows[under], level + 1)
                nodes[at] = (f, cut, left, grow(rows[~under], level + 1))
            return at

        grow(rng.choice(len(x), min(sample, len(x)), replace=False), 0)
        forest.append(nodes)
    return forest


def isolation_score(x: np.ndarray, forest: list[list[tuple]], sample: int) -> np.ndarray:
    """Anomaly scores, over 0.5 for outliers."""
    total = np.zeros(len(x))
    for nodes in forest:
        stack = [(0, np.arange(len(x)), 0)]
        while stack:
            at, rows, level = stack.pop()
            f, cut, left, right = nodes[at]
            if f < 0:
                total[rows] += level + cut
            elif len(rows):
                under = x[rows, f] < cut
                stack += [(left, rows[under], level + 1), (right, rows[~under], level + 1)]
    return 2.0 ** (-total / len(forest) / max(average_path(sample), 1e-12))


def block_ids(block: int, n: int) -> np.ndarray:
    """Ids of the rows of a block."""
    return (np.int64(block) << 32) + np.arange(n, dtype=np.int64)


def merge_nearest(x: np.ndarray, other: np.ndarray, ids: np.ndarray, itself: np.ndarray | None, best: np.ndarray, near: np.ndarray, copies: np.ndarray | None = None, held: np.ndarray | None = None) -> None:
    """Put rows of ``other`` into the running k nearest of ``x`` (distances ``best``, ids ``near``); itself: which of ``other`` each row is, where they are of one block.

    Products only narrow the choice, with a margin for their rounding; distances are exact, and equal ones go by id. ``held`` keeps the
    ``copies`` of those that are near.
    """
    k = best.shape[1]
    middle = x.mean(axis=0)
    right = other - middle
    squares = (right * right).sum(axis=1)
    for at in range(0, len(x), 512):
        left = x[at : at + 512] - middle
        own = (left * left).sum(axis=1)
        d = squares - 2 * left @ right.T
        if itself is not None:
            d[np.arange(len(left)), itself[at : at + 512]] = np.inf
        bound = best[at : at + 512, -1] ** 2 - own
        if len(other) > k:
            bound = np.where(np.isinf(bound), np.partition(d, k - 1, axis=1)[:, k - 1] if np.isinf(bound).any() else bound, bound)
        bound += 1e-12 * (own + squares.max())
        rows, cols = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        exact = np.sqrt(((x[at + rows] - other[cols]) ** 2).sum(axis=1))
        has = np.nonzero(near[at : at + 512] >= 0)
        rows = np.concatenate([has[0], rows])
        exact = np.concatenate([best[at : at + 512][has], exact])
        names = np.concatenate([near[at : at + 512][has], ids[cols]])
        order = np.lexsort((names, exact, rows))
        ordered = rows[order]
        place = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
        keep, order = place < k, order[place < k]
        to = at + rows[order], place[keep]
        if held is not None:
            held[to] = np.concatenate([held[at : at + 512][has], copies[cols]])[order]
        best[to], near[to] = exact[order], names[order]


def fourier_features(minutes: np.ndarray, periods: dict[float, int], scale: float | np.ndarray) -> np.ndarray:
    """Constant, line and sine pairs of each period (in minutes) up to its order."""
    columns = [np.ones_like(minutes), minutes / scale]
    for period, order in periods.items():
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * minutes / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.stack(columns, axis=1)


def ridge_of_sums(gram: np.ndarray, n: int, strength: float = 1e-3) -> np.ndarray:
    """Coefficients of least squares with a small penalty, from [X | y]' [X | y] of ``n`` rows."""
    return np.linalg.solve(gram[:-1, :-1] + strength * max(n, 1) * np.eye(len(gram) - 1), gram[:-1, -1])


def ridge_of_runs(minutes: np.ndarray, y: np.ndarray, start: np.ndarray, sizes: np.ndarray, scale: np.ndarray, periods: dict[float, int], block: int = 1 << 15) -> np.ndarray:
    """``ridge_of_sums`` of ``fourier_features`` for each column of ``y``, of many runs of rows at once: (runs, features, columns). Memory is bounded by ``block`` rows.

    ``start`` and ``sizes`` are where a run's rows are, ``scale`` its minutes.
    """
    width = 2 + 2 * sum(periods.values())
    gram, target = np.zeros((len(sizes), width, width)), np.zeros((len(sizes), width, y.shape[1]))
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + max(1, block // max(int(sizes[order[at]]), 1))]
        at += len(some)
        for low in range(0, int(sizes[some[0]]), block):
            place = low + np.arange(min(block, int(sizes[some[0]]) - low))
            there = place < sizes[some, None]
            rows = start[some, None] + np.where(there, place, 0)
            x = np.where(there[:, :, None], fourier_features(minutes[rows].reshape(-1), periods, np.repeat(scale[some], len(place))).reshape(*there.shape, width), 0.0)
            gram[some] += x.transpose(0, 2, 1) @ x
            target[some] += x.transpose(0, 2, 1) @ np.where(there[:, :, None], y[rows], 0.0)
    return np.linalg.solve(gram + 1e-3 * np.maximum(sizes, 1)[:, None, None] * np.eye(width), target)


def dense_shapes(inputs: int, spec: list[dict]) -> list[tuple[int, ...]]:
    """Shapes of weights and biases of a dense net, given [{units, activation}]."""
    shapes: list[tuple[int, ...]] = []
    for layer in spec:
        shapes += [(inputs, layer["units"]), (layer["units"],)]
        inputs = layer["units"]
    return shapes


def initial_weights(inputs: int, spec: list[dict], seed: int = 0) -> list[np.ndarray]:
    """Uniform weights by fan, zero biases."""
    rng = np.random.default_rng(seed)
    return [rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s)) if len(s) == 2 else np.zeros(s) for s in dense_shapes(inputs, spec)]


_ACTIVATIONS = {
    "linear": (lambda z: z, lambda a: np.ones_like(a)),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30))), lambda a: a * (1 - a)),
}


def dense_forward(x: np.ndarray, weights: list[np.ndarray], spec: list[dict]) -> list[np.ndarray]:
    """The outputs of all layers, the input first."""
    out = [x]
    for i, layer in enumerate(spec):
        out.append(_ACTIVATIONS[layer["activation"]][0](out[-1] @ weights[2 * i] + weights[2 * i + 1]))
    return out


def train_epoch(x: np.ndarray, y: np.ndarray, weights: list[np.ndarray], spec: list[dict], batch: int = 32, rate: float = 1e-3) -> list[np.ndarray]:
    """One epoch over rows in batches."""
    return train_batches([(x[at : at + batch], y[at : at + batch]) for at in range(0, len(x), batch)], weights, spec, rate)


def train_batches(batches: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], spec: list[dict], rate: float = 1e-3) -> list[np.ndarray]:
    """A step of Adam for each batch, on binary cross-entropy (sigmoid output) or squared error (other outputs)."""
    weights = [w.copy() for w in weights]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step, (xs, ys) in enumerate(batches, 1):
        ys = ys.reshape(-1, 1)
        out = dense_forward(xs, weights, spec)
        delta = (out[-1] - ys) / len(xs)
        grads: list[np.ndarray] = [np.empty(0)] * len(weights)
        for i in reversed(range(len(spec))):
            if i < len(spec) - 1:
                delta = delta * _ACTIVATIONS[spec[i]["activation"]][1](out[i + 1])
            grads[2 * i], grads[2 * i + 1] = out[i].T @ delta, delta.sum(axis=0)
            delta = delta @ weights[2 * i].T
        for j, g in enumerate(grads):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            weights[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-7)
    return weights


def _padded(sizes: np.ndarray, batch: int):
    """Batches of many clients' rows side by side: (clients with rows left, rows, which are there); clients are in order of falling size."""
    starts = np.cumsum(sizes) - sizes
    for at in range(0, int(sizes.max(initial=0)), batch):
        active = int((sizes > at).sum())
        place = at + np.arange(min(batch, int(sizes[0]) - at))
        there = place < sizes[:active, None]
        yield active, starts[:active, None] + np.where(there, place, 0), there


def train_clients(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weights: list[np.ndarray], spec: list[dict], batch: int = 32, rate: float = 1e-3) -> tuple[list[np.ndarray], np.ndarray]:
    """``train_epoch`` of many clients at once, whose rows follow each other, and their losses after it; ``sizes``, their numbers of rows, mustn't rise.

    Each array of weights has a client per row.
    """
    weights = [np.repeat(w[None], len(sizes), axis=0) for w in weights]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def forward(xs: np.ndarray, active: int) -> list[np.ndarray]:
        out = [xs]
        for i, layer in enumerate(spec):
            out.append(_ACTIVATIONS[layer["activation"]][0](out[-1] @ weights[2 * i][:active] + weights[2 * i + 1][:active, None]))
        return out

    for step, (active, rows, there) in enumerate(_padded(sizes, batch), 1):
        out = forward(x[rows], active)
        delta = np.where(there[:, :, None], out[-1] - y[rows][:, :, None], 0.0) / there.sum(axis=1)[:, None, None]
        grads: list[np.ndarray] = [np.empty(0)] * len(weights)
        for i in reversed(range(len(spec))):
            if i < len(spec) - 1:
                delta = delta * _ACTIVATIONS[spec[i]["activation"]][1](out[i + 1])
            grads[2 * i], grads[2 * i + 1] = out[i].transpose(0, 2, 1) @ delta, delta.sum(axis=1)
            delta = delta @ weights[2 * i][:active].transpose(0, 2, 1)
        for w, a, b, g in zip(weights, m, v, grads):
            a[:active], b[:active] = 0.9 * a[:active] + 0.1 * g, 0.999 * b[:active] + 0.001 * g * g
            w[:active] -= rate * (a[:active] / (1 - 0.9**step)) / (np.sqrt(b[:active] / (1 - 0.999**step)) + 1e-7)
    loss = np.zeros(len(sizes))
    for active, rows, there in _padded(sizes, batch):
        p = np.clip(forward(x[rows], active)[-1][:, :, 0], 1e-7, 1 - 1e-7)
        loss[:active] -= np.where(there, y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p), 0.0).sum(axis=1)
    return weights, loss / sizes


def float16_round_trip(v: np.ndarray) -> np.ndarray:
    return v.astype(np.float16).astype(float)


def int8_round_trip(v: np.ndarray) -> np.ndarray:
    """Each row as bytes within two deviations around its mean, and back."""
    mean, spread = v.mean(axis=1, keepdims=True), v.std(axis=1, keepdims=True)
    v = np.clip(v, mean - 2 * spread, mean + 2 * spread)
    low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    scaled = np.divide(v - low, high - low, out=np.full(v.shape, 0.5), where=high > low)
    return (np.rint((scaled * 2 - 1) * 127) / 127 + 1) / 2 * (high - low) + low


def group_metrics(y: np.ndarray, score: np.ndarray, sizes: np.ndarray, cut: float = 0.5) -> np.ndarray:
    """(accuracy, precision, recall, log loss, area under the curve) of runs of rows, NaN where there is none."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    total = lambda v: np.bincount(run, v, len(sizes))
    ratio = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
    hit, p = (score > cut).astype(float), np.clip(score, 1e-7, 1 - 1e-7)
    order = np.lexsort((score, run))
    r, s, neg = run[order], score[order], 1 - y[order]
    tie = run_starts(np.cumsum(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])))) if len(r) else np.empty(0, np.int64)
    before = np.cumsum(neg) - neg  # negatives of all rows before, also of other runs
    first = np.cumsum(sizes) - sizes
    ties = np.bincount(tie, neg, len(r))[tie] if len(r) else neg
    below = before[tie] - before[first[r]] + ties / 2
    area = np.bincount(r, (1 - neg) * below, len(sizes))
    loss = -total(y * np.log(p) + (1 - y) * np.log(1 - p))
    return np.stack([total(y == hit) / sizes, ratio(total(y * hit), total(hit)), ratio(total(y * hit), total(y)), loss / sizes, ratio(area, total(y) * total(1 - y))], axis=1)
