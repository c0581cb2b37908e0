"""Live versions of the batch operators on Structured Streaming; each works on batch input too where noted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import SENSOR, TIME
from ..functions.kernels import kalman_runs
from ..operators.federated import fed_avg
from ..operators.labels import out_of_range

#: State of a sensor that is silent for so long expires.
KEEP_MS = 7 * 24 * 3600 * 1000
ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outage_sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end when a sensor is silent for ``gap`` (batch or stream)."""
    rows = df.withWatermark(TIME, late) if df.isStreaming else df
    return rows.groupBy(SENSOR, F.session_window(TIME, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time")).drop("w")


def range_labels(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Range rules row by row (batch or stream)."""
    return df.withColumn("label", F.when(F.coalesce(out_of_range(rules), F.lit(False)), "error").otherwise("good"))


def tumbling_stats(df: DataFrame, col: str = "value_temp", size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows, mean and limits of a channel per time window, tumbling or sliding (batch or stream)."""
    rows = df.withWatermark(TIME, late) if df.isStreaming else df
    window = F.window(TIME, size, slide) if slide else F.window(TIME, size)
    grouped = rows.groupBy(SENSOR, window.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(col).alias("mean"), F.min(col).alias("low"), F.max(col).alias("high"))
    return grouped.select(SENSOR, F.col("w.start").alias("window_start"), "n_rows", "mean", "low", "high")


def with_rocksdb(spark: SparkSession) -> dict[str, str | None]:
    """Let queries that start from now on keep state in RocksDB, which stateful processors need; gives what was set before."""
    before = {ROCKSDB[0]: spark.conf.get(ROCKSDB[0], None)}
    spark.conf.set(*ROCKSDB)
    return before


class PerSensor(StatefulProcessor):
    """One value of state per sensor, from its last reading on; it expires KEEP_MS after that reading, by event time.

    ``follow`` gets a sensor's timely readings of a trigger in order of time and the state before them, and gives a column and the state after
    them. A reading that is older than the last one of an earlier trigger is late: it has no known neighbour, gets ``late`` and leaves the state
    as it is, and so does one without a time or, of readings further back than the watermark, what Spark lets through.
    """

    def __init__(self, columns: tuple[str, ...], state: str, name: str, follow: Callable, late: Callable):
        self.columns, self.state, self.name, self.follow, self.late, self.keep = columns, state, name, follow, late, KEEP_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"at long, {self.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a trigger's readings of one sensor: the source's rate limits (maxFilesPerTrigger, maxBytesPerTrigger) bound them
        here = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable", ignore_index=True, na_position="last")
        last = tuple(self.kept.get()) if self.kept.exists() else None
        known = here["at"].notna().to_numpy()
        at = here["at"].fillna(0).to_numpy(np.int64)
        timely = known & (at >= last[0]) if last else known
        values = here[list(self.columns)].to_numpy(float)
        out = np.array(self.late(values), object)
        if timely.any():
            out[timely], after = self.follow(at[timely], values[timely], last)
            latest = int(at[timely][-1])
            if after is not None:
                self.kept.update((latest, *after))
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(max(latest // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep)
        yield pd.DataFrame({SENSOR: here[SENSOR], TIME: here[TIME], self.name: out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def _per_sensor(df: DataFrame, late: str, processor: PerSensor, kind: str) -> DataFrame:
    rows = df.withWatermark(TIME, late).select(SENSOR, TIME, F.unix_micros(TIME).alias("at"), *processor.columns)
    return rows.groupBy(SENSOR).transformWithStateInPandas(processor, f"{SENSOR} string, {TIME} timestamp, {processor.name} {kind}", "Append", "EventTime")


def live_labels(df: DataFrame, thresholds: dict[str, float], minutes: float = 15, late: str = "1 hour") -> DataFrame:
    """Outage and jump labels against the sensor's last reading, kept as state."""
    cols, limits = tuple(thresholds), np.array(list(thresholds.values()))

    def over(values: np.ndarray) -> np.ndarray:
        wet = values[:, cols.index("value_hum")] > 100 if "value_hum" in cols else np.zeros(len(values), bool)
        return np.where(wet, "1", "0").astype(object)

    def follow(at: np.ndarray, values: np.ndarray, last: tuple | None) -> tuple[np.ndarray, tuple]:
        label = over(values)
        # the reading before: of this trigger, or for the first one the kept one
        before = np.vstack([values[:1] if last is None else np.array([last[1:]], float), values[:-1]])
        before_at = np.append(at[0] if last is None else last[0], at[:-1])
        label[(np.abs(values - before) > limits).any(axis=1)] = "1"
        label[(at - before_at) / 6e7 > minutes] = "error"
        return label, tuple(None if v != v else float(v) for v in values[-1])

    return _per_sensor(df, late, PerSensor(cols, ", ".join(f"{c} double" for c in cols), "label", follow, over), "string")


def live_kalman(df: DataFrame, col: str = "value_temp", q: float = 0.01, r: float = 1.0, p0: float = 1.0, late: str = "1 hour") -> DataFrame:
    """Filtered level per sensor; the state is its mean and variance. A late reading isn't filtered, and has no level."""

    def follow(at: np.ndarray, values: np.ndarray, last: tuple | None) -> tuple[np.ndarray, tuple | None]:
        state = np.full((2, len(values), 1), np.nan)
        if last is not None:
            state[:, 0, 0] = last[1:]
        level, p = kalman_runs(values, np.zeros(len(values), np.int64), q, r, p0, *state)
        shown = np.where(np.isnan(level[:, 0]), None, level[:, 0].astype(object))
        return shown, None if np.isnan(level[-1, 0]) else (float(level[-1, 0]), float(p[-1, 0]))

    return _per_sensor(df, late, PerSensor((col,), "level double, p double", "level", follow, lambda values: [None] * len(values)), "double")


def collect_updates(stream: DataFrame, path: str, clients: int, done: Callable[[DataFrame, int], None], checkpoint: str):
    """Store client updates (round, client_id, layer, weights); once a round has ``clients`` of them, pass its mean on.

    A batch writes the updates of rounds still open, those before it included, to a folder of its number and reads the
    folder before; so closed rounds aren't read again. A resent update counts once; one for a closed round is
    left out. ``done`` gets the means and the batch's number: a batch that is repeated after a failure passes the same
    means with the same number, so a writer keyed by it stays right.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        keys = ["round", "client_id", "layer"]
        before = f"{path}/{number - 1}"
        if number:
            closed = spark.read.schema("round int").parquet(f"{before}/closed")
            rows = spark.read.schema(rows.schema).parquet(f"{before}/open").unionByName(rows.join(closed, "round", "left_anti"))
        rows.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/{number}/known")
        known = spark.read.schema(rows.schema).parquet(f"{path}/{number}/known")
        full = known.groupBy("round").agg(F.count_distinct("client_id").alias("n")).filter(F.col("n") >= clients).select(F.col("round").cast("int").alias("round"))
        full.write.mode("overwrite").parquet(f"{path}/{number}/full")
        full = spark.read.schema("round int").parquet(f"{path}/{number}/full")
        (closed.unionByName(full) if number else full).write.mode("overwrite").parquet(f"{path}/{number}/closed")
        known.join(full, "round", "left_anti").write.mode("overwrite").parquet(f"{path}/{number}/open")
        if not full.isEmpty():
            done(fed_avg(known.join(full, "round")), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def drop_resent(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Readings without those sent again within the watermark (stream), or at all (batch)."""
    if df.isStreaming:
        return df.withWatermark(TIME, late).dropDuplicatesWithinWatermark([SENSOR, TIME])
    return df.dropDuplicates([SENSOR, TIME])
