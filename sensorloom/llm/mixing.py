"""Mixing sources to target weights by subset-sum budget fitting.

Sources in order of code points (null last) weigh 5, 2, 1, repeating, and share ``budget_share`` of all
sizes. A target stops at ``max_repeat`` times its source's size; the excess goes to the others by weight
until none is above. A target of r whole repeats and a rest gives every document r times,
and the rest is fitted: documents are counted by exact size, each size gives its even share,
the largest sizes that still fit are added until the open budget is small, and a bounded-knapsack
table over the open budget closes it (exactly, or as near from below as any subset comes). Which
documents of a size are taken goes by a seeded hash of the id.

Only (source, size) counts meet in one task per source; documents of one size are ranked in hash
buckets, so a size that a third of all rows share is spread over many tasks. Targets are found by
a few sums over the table of sources, which the driver never holds.

Edge cases: null or empty texts have size 0 and take 0 words; a null source is one of its own; repeated
rows are each a document; texts of any length count whole; columns of ``docs`` pass through whatever their
names; an empty table gives no rows; reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_SEPARATORS, boxed, materialize, quoted, small_side, unboxed

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_REPEAT = 2
SEED = 20
#: Hash buckets that the documents of one (source, size) are ranked in.
RANK_BUCKETS = 1024
#: Largest open budget that the knapsack table covers, in words.
TABLE_WORDS = 1 << 20


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, WORD_SEPARATORS), ""))).cast("long")


def source_targets(per_source: DataFrame, budget_share: float = BUDGET_SHARE, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, w): the driver sees a few sums a round, never the sources."""
    last = [F.col("source").isNull(), F.col("source")]
    sliced = per_source.repartitionByRange(*last).select("source", "w", F.spark_partition_id().alias("pid"))
    sliced = materialize(sliced.withColumn("at", F.row_number().over(Window.partitionBy("pid").orderBy(*last))), "sources")
    # one row per partition
    before = sliced.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("before") + F.col("at") - 1, F.lit(len(weights))).cast("int")
    rows = sliced.join(F.broadcast(before), "pid").select("source", "w", F.get(F.array(*map(F.lit, weights)), turn).alias("weight"))
    rows = materialize(rows, "weights")
    words = rows.agg(F.sum("w")).first()[0] or 0
    budget, open_words, open_weight = min(budget_share, float(max_repeat)) * words, 0.0, 1.0
    while True:  # words per weight grow until no share is above its cap; capped sources stay so
        share, cap = F.lit(open_words) * F.col("weight") / F.lit(open_weight), max_repeat * F.col("w")
        full, weight = rows.agg(F.sum(F.when(share >= cap, cap)).cast("double"), F.sum(F.when(share < cap, F.col("weight")))).first()
        left = budget - (full or 0.0)
        if not weight or left / weight <= open_words / open_weight:
            return rows.select("source", F.col("w").alias("source_size"), F.least(share, cap.cast("double")).alias("target"))
        open_words, open_weight = left, weight


def _close(size: np.ndarray, spare: np.ndarray, left: int, unit: int) -> np.ndarray:
    """Documents to add so that their words come as near to ``left`` from below as the table's unit tells apart."""
    weight, span = -(-size // unit), left // unit
    add = np.zeros(len(size), np.int64)
    reached = np.full(span + 1, -1, np.int64)  # the step that first reached a sum
    reached[0] = 0
    steps: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(size, kind="stable"):
        if reached[span] >= 0:
            break
        n, pack = int(min(spare[i], span // weight[i])), 1
        while n > 0 and reached[span] < 0:  # counts in packs of 1, 2, 4, ... and the rest
            k = min(pack, n)
            w = k * int(weight[i])
            steps.append((int(i), k))
            reached[np.flatnonzero((reached[:-w] >= 0) & (reached[w:] < 0)) + w] = len(steps) - 1
            n, pack = n - k, pack * 2
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        i, k = steps[reached[at]]
        add[i] += k
        at -= k * int(weight[i])
    return add


def fit_counts(size: np.ndarray, count: np.ndarray, budget: int, table_words: int = TABLE_WORDS) -> np.ndarray:
    """How many documents of each size to take so that their words come near ``budget`` from below.

    size: distinct sizes over 0; count: documents of each. A budget that the table holds is met as near as any
    subset comes. Of a larger one most is shared out evenly; the rest, several of the largest documents long,
    is fitted by the table over all documents left, exactly to the word where the rest has ``table_words`` words at
    most, else in units of the rest's ``table_words``-th part, and what that leaves once more.
    """
    total = int((size * count).sum())
    if budget >= total:
        return count.copy()
    room = min(table_words, max(4 * int(size.max()), 1 << 14))
    take = (count * max(0, budget - room) // total).astype(np.int64)
    left = budget - int((take * size).sum())
    for i in np.argsort(-size, kind="stable"):  # close what rounding down left open, largest sizes first
        if left <= room:
            break
        if 4 * size[i] > room:  # the table chooses among these
            continue
        n = int(min(count[i] - take[i], max(0, left - room // 2) // size[i]))
        take[i] += n
        left -= n * int(size[i])
    while left:
        unit = -(-left // table_words)
        add = _close(size, count - take, left, unit)
        take += add
        left -= int((add * size).sum())
        if unit == 1 or not add.any():
            break
    return take


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, budget_share: float = BUDGET_SHARE, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(k, rk, source, size, source_size, target, copies) per document; rk tells rows of one id apart."""
    text, key = F.col(quoted(text_col)).cast("string"), F.col(quoted(id_col)).cast("long")
    rk = F.xxhash64(text)
    slim = materialize(docs.select(key.alias("k"), rk.alias("rk"), F.col(quoted(source_col)).cast("string").alias("source"), n_words(text).alias("size")), "sizes")
    counts = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    per_source = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("w")), budget_share, weights, max_repeat)
    goal = per_source.select(F.col("source").alias("s"), "source_size", "target")
    placed_sizes = counts.join(small_side(materialize(goal, "targets")), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        words, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(target // words) if words else 0
        rows = rows.sort_values("size").reset_index(drop=True)
        real = (rows["size"] > 0).to_numpy()
        extra = np.zeros(len(rows), np.int64)
        if real.any() and whole < max_repeat:
            extra[real] = fit_counts(rows["size"].to_numpy()[real], rows["n"].to_numpy()[real], int(round(target)) - whole * words)
        return rows.assign(source=rows["source"].where(rows["source"].notna(), None), whole=whole, extra=extra)[[x.split()[0] for x in schema.split(", ")]]

    schema = "source string, size long, n long, whole long, extra long, source_size long, target double"
    plan = materialize(placed_sizes.groupBy("source").applyInPandas(fit, schema), "size-plan")
    plan = plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "whole", "extra", "source_size", "target")
    rank = F.xxhash64(F.lit(seed), "k")
    placed = slim.withColumn("rank", rank).withColumn("bucket", F.pmod(F.shiftright("rank", 20), F.lit(RANK_BUCKETS)))
    in_bucket = placed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_bucket.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # the plan comes to the rows with their bucket's start: a size may have most rows, but no bucket of it has
    starts = starts.join(small_side(plan), F.col("s").eqNullSafe(F.col("ps")) & (F.col("z") == F.col("pz"))).drop("ps", "pz")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b"))
    ranked = placed.join(starts, same, "left").drop("s", "z", "b")
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("rank", "k", "rk")) + F.col("before"))
    return ranked.select("k", "rk", "source", "size", "source_size", "target", (F.col("whole") + (F.col("at") <= F.col("extra")).cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and the same columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    plan = materialize(mixed(docs, **options).select("k", "rk", "copies"), "mix")
    # repeated rows share a key: a number within the key pairs each with one plan row
    plan = plan.select(F.col("k").alias("pk"), F.col("rk").alias("prk"), "copies").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pk", "prk")))
    once = plan.filter("n = 1 and copies > 0").drop("n")
    often = plan.filter("n > 1").groupBy("pk", "prk").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    keyed = boxed(docs, k=F.col(quoted(id_col)).cast("long"), rk=F.xxhash64(F.col(quoted(text_col)).cast("string")))
    match = F.col("k").eqNullSafe(F.col("pk")) & (F.col("rk") == F.col("prk"))
    every = keyed.join(small_side(materialize(once, "mix-once")), match).select("row", F.col("copies").cast("int").alias("copies"))
    if often.limit(1).count():
        number = F.row_number().over(Window.partitionBy("pk", "prk").orderBy(F.xxhash64("row")))
        share = F.floor(F.col("copies") / F.col("n")) + (number <= F.col("copies") % F.col("n")).cast("long")
        every = every.unionByName(keyed.join(often, match).select("row", share.cast("int").alias("copies")).filter("copies > 0"))
    return unboxed(every.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), docs.columns)
