"""Exact quantiles of a whole column, without any task that holds it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Ranges that a pass counts, and values that are few enough to be looked at.
BINS, FEW = 4096, 20_000


def exact_quantiles(df: DataFrame, col: str, qs: tuple[float, ...]) -> list[float | None]:
    """Quantiles ``qs`` of a column of numbers, linear between neighbours; None where no value is known (null, NaN).

    Values are counted in ranges of equal width, the range that holds a rank is counted again in finer ones, until it has few values or
    a single one. A pass is one job over the column and brings at most BINS rows for each quantile to the driver; each makes the range
    BINS times narrower, so a few do.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(qs)
    # (rank from 0 of the lower neighbour, what of the way to the next)
    wanted = [((rank := min(math.floor((n - 1) * q), n - 1)), (n - 1) * q - rank) for q in qs]
    found: dict[int, tuple[float, float]] = {}
    ranges = {i: (low, high, 0, n) for i in range(len(qs))}  # values below and values within
    while ranges:
        few = {i: r for i, r in ranges.items() if r[0] == r[1] or r[3] <= FEW}
        for i, (a, z, below, size) in few.items():
            rank = wanted[i][0] - below
            if a == z:
                found[i] = a, a if rank + 1 < size or below + size == n else values.filter(F.col("v") > z).agg(F.min("v")).first()[0]
            else:
                here = sorted(r[0] for r in values.filter(F.col("v").between(a, z)).collect())
                found[i] = here[rank], here[rank + 1] if rank + 1 < size else here[rank] if below + size == n else values.filter(F.col("v") > z).agg(F.min("v")).first()[0]
            del ranges[i]
        if not ranges:
            break
        place = lambda a, z: F.least(F.floor((F.col("v") / 2 - a / 2) / (z / 2 - a / 2) * BINS), F.lit(BINS - 1)).cast("int")  # noqa: E731  halves, so that no width overflows
        at = F.array_compact(F.array(*[F.when(F.col("v").between(a, z), F.struct(F.lit(i).alias("range"), place(a, z).alias("bin"))) for i, (a, z, _, _) in ranges.items()]))
        counted = values.select("v", F.explode(at).alias("x")).groupBy("x.range", "x.bin").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins: dict[int, list] = {}
        for r in counted.collect():
            bins.setdefault(r["range"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        for i in list(ranges):
            below = ranges[i][2]
            for _, size, a, z in sorted(bins[i]):
                if wanted[i][0] < below + size:
                    ranges[i] = a, z, below, size
                    break
                below += size
    return [a + (b - a) * share if share else a for (a, b), (_, share) in ((found[i], wanted[i]) for i in range(len(qs)))]


def medians(rows: DataFrame, keys: tuple[str, ...], col: str, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(keys, median) of each group's known values, exactly, without a task that holds a long group; ``kept`` writes a table and reads it back.

    As above, but ranges are a table: each pass counts the values of open ranges in bins, and finds the bin that holds both middle ranks.
    """
    right = {k: f"__{k}" for k in keys}
    same = lambda: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in right.items()])
    values = rows.select(*keys, F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ranges = values.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("size"))
    ranges = kept(ranges.select(*keys, "low", "high", "size", F.expr("(size - 1) div 2").alias("one"), F.expr("size div 2").alias("two")), "ranges")
    done = []
    while not ranges.isEmpty():
        few = (F.col("size") <= FEW) | (F.col("low") == F.col("high"))
        inside = F.col("v").between(F.col("low"), F.col("high"))
        near = values.join(ranges.filter(few & (F.col("low") < F.col("high"))).withColumnsRenamed(right), same() & inside)
        near = near.groupBy(*keys, "one", "two").agg(F.array_sort(F.collect_list("v")).alias("x"))
        single = ranges.filter(F.col("low") == F.col("high")).select(*keys, F.col("low").alias("median"))
        middle = (F.element_at("x", (F.col("one") + 1).cast("int")) + F.element_at("x", (F.col("two") + 1).cast("int"))) / 2
        done += [single, near.select(*keys, middle.alias("median"))]
        wide = ranges.filter(~few)
        place = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        bins = values.join(wide.withColumnsRenamed(right), same() & inside).groupBy(*keys, "one", "two", place.alias("bin")).agg(F.count("v").alias("m"), F.min("v").alias("a"), F.max("v").alias("z"))
        upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("below", F.coalesce(upto, F.lit(0)))
        holds = lambda rank: (F.col(rank) >= F.col("below")) & (F.col(rank) < F.col("below") + F.col("m"))
        found = kept(bins.filter(holds("one") | holds("two")).withColumn("both", holds("one") & holds("two")), "bins")
        # the middle falls between two bins: the last value of one and the first of the next
        split = found.filter(~F.col("both")).groupBy(*keys).agg(((F.max(F.when(holds("one"), F.col("z"))) + F.max(F.when(holds("two"), F.col("a")))) / 2).alias("median"))
        done.append(split)
        ranges = kept(found.filter("both").select(*keys, F.col("a").alias("low"), F.col("z").alias("high"), F.col("m").alias("size"), (F.col("one") - F.col("below")).alias("one"), (F.col("two") - F.col("below")).alias("two")), "ranges")
    return kept(reduce(lambda a, b: a.unionByName(b), done), "medians") if done else rows.select(*keys, F.lit(None).cast("double").alias("median")).limit(0)
