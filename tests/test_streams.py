"""Stateful streams over several triggers: late, repeated and timeless readings, silence, and state that goes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.sources import io as IO
from sensorloom.streaming import live

SCHEMA = "sensor_id string, row_no long, time timestamp, value_temp double, value_hum double"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


class Feed:
    """A stream whose every run reads what was added since."""

    def __init__(self, spark, path, form, mode="append"):
        self.spark, self.path, self.form, self.mode = spark, path, form, mode
        spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/in")

    def run(self, rows):
        """(what the run puts out, its last count of state rows)."""
        got = []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        out = self.form(self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in"))
        query = out.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.path}/state").foreachBatch(lambda batch, number: got.extend(batch.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        return got, states[-1] if states else 0


@pytest.fixture
def rocks(spark):
    before = live.with_rocksdb(spark)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_levels_over_triggers(rocks, tmp_path):
    feed = Feed(rocks, str(tmp_path), lambda d: live.live_kalman(d, late="1 day"))
    first, _ = feed.run([("a", 1, at(0), 10.0, 0.0), ("a", 3, at(20), 12.0, 0.0), ("a", 2, at(10), None, 0.0), ("b", 4, at(5), None, 0.0)])
    level, p = 10.0, 0.5
    p = p + 0.01 + 0.01
    gain = p / (p + 1)
    level, p = level + gain * (12.0 - level), p * (1 - gain)
    assert sorted((r["sensor_id"], r["level"]) for r in first if r["level"] is not None and r["sensor_id"] == "a") == sorted([("a", 10.0), ("a", 10.0), ("a", level)])
    assert [r["level"] for r in first if r["sensor_id"] == "b"] == [None]
    late, _ = feed.run([("a", 5, at(15), 99.0, 0.0), ("a", 6, None, 77.0, 0.0)])  # older than the last one; without a time
    assert {r["level"] for r in late} <= {None} and any(r["time"] == at(15) for r in late)
    after, _ = feed.run([("a", 7, at(30), 11.0, 0.0), ("b", 8, at(30), 4.0, 0.0)])
    p += 0.01
    gain = p / (p + 1)
    got = {r["sensor_id"]: r["level"] for r in after}
    assert np.isclose(got["a"], level + gain * (11.0 - level)) and got["b"] == 4.0


def test_labels_over_triggers(rocks, tmp_path):
    feed = Feed(rocks, str(tmp_path), lambda d: live.live_labels(d, {"value_temp": 5.0, "value_hum": 50.0}, 15, late="1 day"))
    labels = lambda rows: {r["time"]: r["label"] for r in rows}
    assert labels(feed.run([("a", 1, at(0), 1.0, 10.0), ("a", 2, at(10), 9.0, 10.0)])[0]) == {at(0): "0", at(10): "1"}
    assert labels(feed.run([("a", 3, at(20), 9.0, 70.0)])[0]) == {at(20): "1"}
    assert labels(feed.run([("a", 4, at(5), 99.0, 70.0), ("a", 5, at(40), None, 70.0)])[0]) == {at(5): "0", at(40): "error"}
    assert labels(feed.run([("a", 6, at(50), 1.0, 101.0)])[0]) == {at(50): "1"}  # no known temperature before, too wet


def test_silent_sensors_are_forgotten(rocks, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "KEEP_MS", 60 * 60_000)
    feed = Feed(rocks, str(tmp_path), lambda d: live.live_kalman(d, late="1 minute"))
    feed.run([("a", 1, at(0), 10.0, 0.0), ("b", 2, at(0), 10.0, 0.0)])
    feed.run([("b", 3, at(70), 12.0, 0.0)])
    feed.run([("b", 4, at(200), 12.0, 0.0)])
    again, _ = feed.run([("a", 5, at(210), 50.0, 0.0)])  # as if it had never been seen
    assert [r["level"] for r in again] == [50.0]


@pytest.mark.parametrize("zone", ["UTC", "America/Lima"])
def test_expiry_doesn_t_depend_on_the_zone(rocks, tmp_path, monkeypatch, zone):
    monkeypatch.setattr(live, "KEEP_MS", 60 * 60_000)
    before = rocks.conf.get("spark.sql.session.timeZone")
    rocks.conf.set("spark.sql.session.timeZone", zone)
    try:
        feed = Feed(rocks, str(tmp_path), lambda d: live.live_kalman(d, late="1 minute"))
        feed.run([("a", 1, at(0), 10.0, 0.0)])
        kept, _ = feed.run([("a", 2, at(50), 10.0, 0.0), ("b", 3, at(55), 1.0, 0.0)])
        assert [r["level"] for r in kept if r["sensor_id"] == "a"] == [10.0]
        assert [r["level"] for r in feed.run([("a", 4, at(60), 20.0, 0.0)])[0]] != [20.0]  # not silent for an hour yet
    finally:
        rocks.conf.set("spark.sql.session.timeZone", before)


def test_windows_are_put_out_once_and_dropped(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), lambda d: live.tumbling_stats(d, size="1 hour", late="10 minutes"))
    out, states = [], []
    for day in range(3):
        rows, state = feed.run([("a", day * 100 + i, at(day * 1440 + i * 30), float(i), 0.0) for i in range(10)])
        out += rows
        states.append(state)
    starts = [r["window_start"] for r in out]
    assert len(starts) == len(set(starts)) == 14 and max(states) <= 2  # of 15 hours the last is open
    assert {r["n_rows"] for r in out} == {2}
    late, _ = feed.run([("a", 999, at(30), 7.0, 0.0)])
    assert late == []


def test_sessions_are_put_out_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), lambda d: live.outage_sessions(d, "30 minutes", "10 minutes"))
    out = []
    for start in (0, 25, 200, 1000):
        rows, state = feed.run([("a", start, at(start), 1.0, 0.0), ("a", start + 1, at(start + 5), 1.0, 0.0)])
        out += rows
        assert state <= 2
    assert sorted((r["first_time"], r["last_time"], r["n_rows"]) for r in out) == [(at(0), at(30), 4), (at(200), at(205), 2)]


def test_updates_as_json_files(spark, tmp_path):
    """Files come a few at a time, one is sent twice; broken bodies are set apart, rounds pass their means on once."""
    rows = [(r, c, 0, [float(r), float(ord(c))]) for r in (0, 1, 2) for c in "abc"]
    bodies = [r["body"] for r in IO.format_updates(spark.createDataFrame(rows, IO.UPDATE)).orderBy("round", "client_id").collect()]
    broken = ["", "{", '{"weights": [1]}', '{"round": 0, "client_id": "z", "layer": 0, "weights": [1, null]}', '{"round": "x", "client_id": "z", "layer": 0, "weights": [1]}', "[1, 2]"]
    (tmp_path / "in").mkdir()
    seen = []
    for i, lines in enumerate((bodies[:4] + broken, bodies[2:7], bodies[:7], bodies[7:])):
        for half in (0, 1):
            (tmp_path / "in" / f"{i}{half}.json").write_text("\n".join(lines[half::2]))
        stream = IO.read_updates(spark, str(tmp_path / "in"), 1)
        query = live.collect_updates(IO.well_formed(stream), str(tmp_path / "kept"), 3, lambda m, number: seen.extend((r["round"], r["weights"]) for r in m.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert len(query.recentProgress) >= 2  # a file each
    assert sorted(seen) == [(r, [float(r), 98.0]) for r in (0, 1, 2)]
    files = IO.read_updates(spark, str(tmp_path / "in"))
    assert sorted(r["body"] for r in IO.malformed(files).collect()) == sorted(broken)
    assert {tuple(r["weights"]) for r in IO.well_formed(files).collect()} == {tuple(r[3]) for r in rows}


def test_picked_files(spark, tmp_path):
    head = "time,value_temp,value_hum,value_acid,value_PV\n2024-01-01T00:00:00Z,"
    for name in ("df A_CLEAN.csv", "df_B_GENERATED.csv", "_CLEANER.csv"):
        (tmp_path / name).write_text(head + f"{len(name)},2,3,4\n")
    (tmp_path / "file=df_C_CLEAN.csv").mkdir()
    (tmp_path / "file=df_C_CLEAN.csv" / "part-0.csv").write_text(head + "7,2,3,4\n")
    assert {(r["sensor_id"], r["value_temp"]) for r in IO.read_picked(spark, str(tmp_path)).collect()} == {("df A", 14.0), ("df_C", 7.0)}
