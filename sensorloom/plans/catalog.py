"""Registered queries of the time-series operators, and the same in DuckDB SQL.

Results carry longs, doubles of six places, strings and booleans; times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import columns as C
from ..operators import decompose as D, federated as FD, forecast as FC, labels as L, metrics as M, outliers as O, regularize as G, scaling as A, segments as S, smoothing as SM, windows as W
from ..sources import io as IO
from ..streaming import live
from . import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CH = C.CHANNELS
DAY = 1440


def plain(df: DataFrame) -> DataFrame:
    """Longs, rounded doubles, times as microseconds."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def num(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def us(x: str) -> str:
    return f"epoch_us({x})"


def add(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, source=ad.readings) -> None:
    query(name, sql)(lambda spark, sf_dir: f(source(spark, sf_dir)))


def seg(df: DataFrame) -> DataFrame:
    return S.split_segments(df, DAY)


FILL = f", {ad.R.replace('value AS value_temp', 'CASE WHEN event_id % 3 <> 0 THEN value END AS value_temp').replace('r AS', 'h AS', 1)}"

# sources
@query("src1_read_readings", f"WITH {ad.I} SELECT sensor_id, idx, {us("date_trunc('second', time)")} AS time, {', '.join(f'{num(c)} AS {c}' for c in CH)} FROM i")
def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = IO.shared_path(spark, "csv")
    IO.write_readings(C.format_time(ad.readings(spark, sf_dir)).select("sensor_id", "time", *CH), path)
    place = F.row_number().over(Window.partitionBy("sensor_id").orderBy("row_no")) - 1
    return IO.read_readings(spark, path).select("sensor_id", place.alias("idx"), "time", *CH)


add("src2_base_name", lambda d: d.select("row_no", C.base_name(F.concat(F.lit("/in/df_"), "sensor_id", F.lit("_CLEAN.csv"))).alias("base")), f"WITH {ad.R} SELECT row_no, 'df_' || sensor_id AS base FROM r")


@query("src2_pick_files", f"WITH {ad.R} SELECT sensor_id, {us("date_trunc('second', time)")} AS time, {', '.join(f'{num(c)} AS {c}' for c in CH)} FROM r WHERE CAST(sensor_id AS BIGINT) % 2 = 0")
def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two kinds are written, those of one are read."""
    path = IO.shared_path(spark, "files")
    kind = F.when(F.col("sensor_id").cast("long") % 2 == 0, "_CLEAN.csv").otherwise("_GENERATED.csv")
    rows = C.format_time(ad.readings(spark, sf_dir)).select("time", *CH, F.concat("sensor_id", kind).alias("file"))
    rows.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return IO.read_picked(spark, path)


add("src3_union_readings", lambda d: IO.union_readings(d.filter("row_no % 2 = 0"), d.filter("row_no % 2 = 1")).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value_temp").alias("total")), f"WITH {ad.R} SELECT sensor_id, count(*) AS n, {num('sum(value_temp)')} AS total FROM r GROUP BY 1")


@query("src4_csv_round_trip", f"WITH {ad.R} SELECT sensor_id, count(*) AS n, {num('sum(value_temp)')} AS total FROM r GROUP BY 1")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = IO.shared_path(spark, "csv")
    IO.write_readings(C.format_time(ad.readings(spark, sf_dir)), path)
    return spark.read.option("header", True).schema(f"row_no long, {IO.READING}, sensor_id string").csv(path).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value_temp").alias("total"))


@query("src5_append_metrics", f"SELECT CAST(label AS BIGINT) AS model, count(*) AS n, {num('sum(vec_id)')} AS loss FROM embeddings GROUP BY 1")
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = IO.shared_path(spark, "metrics")
    rows = ad.updates(spark, sf_dir).select(F.col("round").alias("model"), F.col("client_id").cast("double").alias("loss"))
    IO.append_metrics(rows.filter("model < 5"), path)
    IO.append_metrics(rows.filter("model >= 5"), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"))


@query("src6_parse_updates", f"SELECT event_id, {num(chr(34) + 'k' + chr(34))} AS k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)")
def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.concat(F.lit('{"weights": ['), F.get_json_object("props", "$.k"), F.lit("]}"))
    return IO.parse_updates(d.withColumn("body", body)).select("event_id", F.get("weights", 0).alias("k"))


# projections
add("prj1_times", lambda d: C.parse_time(C.format_time(d)).select("row_no", "time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text")), f"WITH {ad.R} SELECT row_no, {us("date_trunc('second', time)")} AS time, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS text FROM r")
add("prj3_coerce_numeric", lambda d: C.coerce_numeric(d.select("row_no", F.when(F.col("row_no") % 4 == 0, "n/a").otherwise(F.col("value_hum").cast("string")).alias("v")), ["v"]), f"WITH {ad.R} SELECT row_no, CASE WHEN row_no % 4 <> 0 THEN {num('value_hum')} END AS v FROM r")
add("prj4_time_features", lambda d: C.time_features(d).select("row_no", "hour", "day_of_year"), f"WITH {ad.R} SELECT row_no, CAST(hour(time) AS BIGINT) AS hour, CAST(dayofyear(time) AS BIGINT) AS day_of_year FROM r")
add("prj5_select_channels", lambda d: C.select_channels(d, {"value_acid": "acid", "value_temp": "temp"}, ("row_no",)), f"WITH {ad.R} SELECT row_no, {num('value_acid')} AS acid, {num('value_temp')} AS temp FROM r")
add("prj6_encode_label", lambda d: C.encode_label(L.label_by_range(d)).select("row_no", "label_code"), f"WITH {ad.I} SELECT row_no, CAST(CASE WHEN idx > 0 AND (value_temp < -15 OR value_temp > 50 OR value_acid < 3 OR value_acid > 9.5 OR value_hum < 7.5 OR value_hum > 90) THEN 0 ELSE 1 END AS BIGINT) AS label_code FROM i")
add("prj7_trim_edges", lambda d: C.trim_edges(d, 10).select("row_no", "idx"), f"WITH {ad.I} SELECT row_no, idx FROM i WHERE idx >= 10 AND idx < n - 10")
add("prj8_long_segments", lambda d: C.filter_long_segments(seg(d), 5).select("row_no", "seg_id"), f"WITH {ad.S} SELECT row_no, seg_id FROM s QUALIFY count(*) OVER (PARTITION BY sensor_id, seg_id) > 5")
add("prj9_drop_incomplete", lambda d: C.drop_incomplete_series(d.withColumn("value_temp", F.when(F.col("row_no") % 97 != 0, F.col("value_temp"))), ["value_temp", "value_hum"]).select("row_no"), f"WITH {ad.R} SELECT row_no FROM r WHERE sensor_id NOT IN (SELECT sensor_id FROM r WHERE row_no % 97 = 0)")
add("prj10_slice_range", lambda d: C.slice_range(C.with_idx(d), 3, 40).select("row_no", "idx"), f"WITH {ad.I} SELECT row_no, idx FROM i WHERE idx > 3 AND idx < 40")
add("prj11_clip", lambda d: C.clip(d.withColumn("value_hum", F.col("value_hum") - 50), "value_hum").select("row_no", "value_hum"), f"WITH {ad.R} SELECT row_no, {num('greatest(value_hum - 50, 0)')} AS value_hum FROM r")
add("prj12_long_and_wide", lambda d: C.to_wide(C.to_long(d).withColumn("value", F.when(F.col("channel") == "value_hum", F.col("value") * 2).when(F.col("channel") != "value_PV", F.col("value")))), f"WITH {ad.R} SELECT sensor_id, row_no, {us('time')} AS time, {num('value_temp')} AS value_temp, {num('value_hum * 2')} AS value_hum, {num('value_acid')} AS value_acid, CAST(NULL AS DOUBLE) AS value_PV FROM r")

# segments
MIN = "(epoch_us({b}) - epoch_us({a})) / CAST(60000000 AS DOUBLE)"
STEP = MIN.format(a="time", b="next")
LAST = MIN.format(a="prev", b="time")
add("seg1_steps", lambda d: S.add_step(d).select("row_no", *[F.coalesce(F.round(F.col(c) * 6e7), F.lit(-1)).cast("long").alias(f"{c}_us") for c in ("step_prev", "step_next")]), f"WITH {ad.I} SELECT row_no, coalesce(epoch_us(time) - epoch_us(prev), -1) AS step_prev_us, coalesce(epoch_us(next) - epoch_us(time), -1) AS step_next_us FROM i")
add("seg2_time_breaks", lambda d: S.time_breaks(d, DAY), f"WITH {ad.S} SELECT sensor_id, idx, {us('time')} AS time, {us('next')} AS next_time FROM s WHERE brk")
add("seg3_split_segments", lambda d: seg(d).select("row_no", "seg_id"), f"WITH {ad.S} SELECT row_no, seg_id FROM s")
JUMP = ad.I + """, j AS (SELECT *, coalesce(abs(value_PV - lead(value_PV) OVER (PARTITION BY sensor_id ORDER BY idx)) > 3.0, false) AS brk FROM i)"""
add("seg4_split_by_jump", lambda d: S.split_by_jump(d).select("row_no", "seg_id"), f"WITH {JUMP} SELECT row_no, seg_id FROM (SELECT *, CAST(coalesce(sum(brk::INT) OVER (PARTITION BY sensor_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_id FROM j) WHERE NOT brk")
add("seg5_gap_report", lambda d: S.gap_report(d, DAY), f"""WITH {ad.R}, f AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY row_no) AS fr FROM r),
 g AS (SELECT sensor_id, lag(fr) OVER w AS start_row, lag(time) OVER w AS start_time, fr AS end_row, time AS end_time, row_no FROM f WINDOW w AS (PARTITION BY sensor_id ORDER BY time, row_no))
 SELECT sensor_id, start_row, {us('start_time')} AS start_time, end_row, {us('end_time')} AS end_time, row_number() OVER (PARTITION BY sensor_id ORDER BY end_time, row_no) AS gap_no
 FROM g WHERE {MIN.format(a='start_time', b='end_time')} > 1440""")
SEGSTEP = ad.S + f", t AS (SELECT *, {MIN.format(a='time', b='lead(time) OVER (PARTITION BY sensor_id, seg_id ORDER BY idx)')} AS step FROM s)"
add("seg6_max_step", lambda d: S.check_max_step(seg(d), 720), f"WITH {SEGSTEP} SELECT sensor_id, seg_id, coalesce(bool_and(step <= 720), true) AS is_regular FROM t GROUP BY ALL")
add("seg7_mean_step", lambda d: S.mean_step(d), f"WITH {ad.I} SELECT sensor_id, {num(f'avg({STEP})')} AS mean_step FROM i GROUP BY 1")
MISSING = ad.S + """, t AS (SELECT *, ((epoch_us(lead(time) OVER (PARTITION BY sensor_id, seg_id ORDER BY idx)) - epoch_us(time)) // 1000000) / CAST(60 AS DOUBLE) AS step FROM s),
 p AS (SELECT sensor_id, seg_id, min(time) AS a, max(time) AS z, avg(step) AS mean_step FROM t GROUP BY ALL),
 q AS (SELECT *, CAST(floor((epoch_us(lead(a) OVER (PARTITION BY sensor_id ORDER BY seg_id)) - epoch_us(z)) / CAST(60000000 AS DOUBLE)) AS BIGINT) AS gap_minutes FROM p),
 m AS (SELECT *, CAST(floor(gap_minutes / nullif(mean_step, 0)) AS BIGINT) AS n_missing FROM q WHERE gap_minutes IS NOT NULL)"""
add("seg8_missing", lambda d: S.missing_between_segments(seg(d)).withColumn("n_missing", F.col("n_missing").cast("double")), f"WITH {MISSING} SELECT sensor_id, seg_id, {num('mean_step')} AS mean_step, gap_minutes, CAST(n_missing AS DOUBLE) AS n_missing FROM m")
add("seg9_connect", lambda d: S.connect_segments(seg(d), ("value_temp",)), f"""WITH {MISSING},
 e AS (SELECT sensor_id, seg_id, arg_max(value_temp, idx) AS z, arg_min(value_temp, idx) AS a FROM s GROUP BY ALL),
 e2 AS (SELECT *, lead(a) OVER (PARTITION BY sensor_id ORDER BY seg_id) AS nx FROM e),
 o AS (SELECT sensor_id, seg_id AS pair, 1 AS part, idx, value_temp AS v FROM s UNION ALL SELECT sensor_id, seg_id - 1, 3, idx, value_temp FROM s),
 o2 AS (SELECT o.sensor_id, pair, part, row_number() OVER (PARTITION BY o.sensor_id, pair, part ORDER BY idx) AS k, v FROM o JOIN (SELECT sensor_id, max(seg_id) AS top FROM s GROUP BY 1) x ON o.sensor_id = x.sensor_id WHERE pair >= 0 AND pair < top),
 f AS (SELECT m.sensor_id, m.seg_id AS pair, 2 AS part, k, e2.z + k * (e2.nx - e2.z) / (n_missing + 1) AS v FROM m JOIN e2 ON m.sensor_id = e2.sensor_id AND m.seg_id = e2.seg_id, unnest(range(1, n_missing + 1)) u(k) WHERE n_missing > 0),
 l AS (SELECT sensor_id, pair, min(v) AS lo, max(v) AS hi FROM o2 GROUP BY ALL), a AS (SELECT * FROM o2 UNION ALL SELECT * FROM f)
 SELECT a.sensor_id, a.pair, CAST(part AS BIGINT) AS part, k, {num('coalesce((v - lo) / nullif(hi - lo, 0), 0)')} AS value_temp FROM a JOIN l ON a.sensor_id = l.sensor_id AND a.pair = l.pair""")
add("seg10_next_diff", lambda d: S.next_diff(d, "value_temp").select("row_no", "next_diff"), f"WITH {ad.I} SELECT row_no, {num('coalesce(value_temp - lead(value_temp) OVER (PARTITION BY sensor_id ORDER BY idx), 0)')} AS next_diff FROM i")
add("seg11_prediction_spans", lambda d: S.prediction_spans(C.with_idx(d).select("sensor_id", "idx", F.when(F.col("value_temp") > 60, -1).otherwise(1).alias("pred")), 5), f"""WITH {ad.I}, k AS (SELECT sensor_id, idx, n, idx - lag(idx) OVER (PARTITION BY sensor_id ORDER BY idx) AS gap FROM i WHERE value_temp > 60),
 g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY idx) AS isl FROM k),
 z AS (SELECT sensor_id, min(idx) AS a, least(max(idx) + 6, max(n)) AS z, max(n) AS n FROM g GROUP BY sensor_id, isl),
 ok AS (SELECT sensor_id, coalesce(lag(z) OVER (PARTITION BY sensor_id ORDER BY a), 0) AS a, a AS z FROM z UNION ALL
  SELECT x.sensor_id, coalesce(y.z, 0), x.n FROM (SELECT sensor_id, max(n) AS n FROM i GROUP BY 1) x LEFT JOIN (SELECT sensor_id, max(z) AS z FROM z GROUP BY 1) y USING (sensor_id))
 SELECT sensor_id, a AS start, z AS stop, false AS is_good FROM z UNION ALL SELECT sensor_id, a, z, true FROM ok WHERE a < z""")
add("seg12_bounds", lambda d: S.segment_bounds(seg(d)), f"WITH {ad.S} SELECT sensor_id, seg_id, min(idx) AS start_idx, count(*) AS n_rows FROM s GROUP BY ALL")
SUMMARY = f"""WITH {MISSING}, y AS (SELECT sensor_id, seg_id, count(*) AS n_rows, {us('min(time)')} AS first_time, {us('max(time)')} AS last_time,
 {', '.join(f'{num(f"{g}({c})")} AS {g}_{c}' for c in CH for g in ('min', 'max'))} FROM s GROUP BY ALL)
 SELECT y.*, CAST(m.n_missing AS DOUBLE) AS n_missing FROM y LEFT JOIN m USING (sensor_id, seg_id)"""
add("segment_summary", lambda d: S.segment_summary(d, DAY).withColumn("n_missing", F.col("n_missing").cast("double")), SUMMARY)

# grids and filling
add("reg1_time_grid", lambda d: G.fill_time_grid(d, 360).select("sensor_id", "time", "is_filled"), f"""WITH {ad.I} SELECT sensor_id, {us('time')} AS time, false AS is_filled FROM i UNION ALL
 SELECT sensor_id, {us('time')} + k * 21600000000, true FROM i, unnest(range(1, greatest(1, CAST(ceil((epoch_us(next) - epoch_us(time)) / CAST(21600000000 AS DOUBLE)) AS BIGINT)))) u(k) WHERE next IS NOT NULL""")
INTER = """, a AS (SELECT *, {p} AS p, max(CASE WHEN v IS NOT NULL THEN {p} END) OVER (PARTITION BY sensor_id ORDER BY time, row_no) AS p0,
 min(CASE WHEN v IS NOT NULL THEN {p} END) OVER (PARTITION BY sensor_id ORDER BY time, row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
 last_value(v IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY time, row_no) AS v0,
 first_value(v IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY time, row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM x)
 SELECT row_no, round(CAST(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0) END AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS value_temp FROM a"""
HOLES = f"WITH {ad.I}, x AS (SELECT *, CASE WHEN row_no % 3 <> 0 THEN value_temp END AS v FROM i)"
add("reg2_interpolate_time", lambda d: G.interpolate_time(d, ("value_temp",)).select("row_no", "value_temp"), HOLES + INTER.format(p="epoch_us(time)"), ad.readings_with_holes)
add("reg3_interpolate_linear", lambda d: G.interpolate_linear(d, ("value_temp",)).select("row_no", "value_temp"), HOLES + INTER.format(p="idx"), ad.readings_with_holes)
add("reg4_dedupe_time", lambda d: G.dedupe_time(d.withColumn("time", F.date_trunc("day", "time"))).select("row_no"), f"WITH {ad.R} SELECT min(row_no) AS row_no FROM r GROUP BY sensor_id, date_trunc('day', time)")
add("reg5_as_freq", lambda d: G.as_freq(d.withColumn("time", F.date_trunc("hour", "time")), 120).select("sensor_id", "time", "value_temp"), f"""WITH {ad.R}, t AS (SELECT * REPLACE (date_trunc('hour', time) AS time) FROM r), d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY sensor_id, time ORDER BY row_no) = 1),
 g AS (SELECT sensor_id, unnest(generate_series(min(time), max(time), INTERVAL 2 HOUR)) AS time FROM t GROUP BY 1)
 SELECT g.sensor_id, {us('g.time')} AS time, {num('value_temp')} AS value_temp FROM g LEFT JOIN d ON g.sensor_id = d.sensor_id AND g.time = d.time""")
add("reg6_forward_fill", lambda d: G.forward_fill(d, ("value_temp", "value_hum")).select("row_no", "value_temp", "value_hum"), f"""WITH {ad.R} SELECT row_no, {num('last_value(CASE WHEN row_no % 3 <> 0 THEN value_temp END IGNORE NULLS) OVER w')} AS value_temp,
 {num('last_value(CASE WHEN row_no % 5 <> 0 THEN value_hum END IGNORE NULLS) OVER w')} AS value_hum FROM r WINDOW w AS (PARTITION BY sensor_id ORDER BY time, row_no)""", ad.readings_with_holes)
add("reg7_regular_times", lambda d: G.regular_times(d, "2024-01-01 00:00:00").select("row_no", "time"), f"WITH {ad.I} SELECT row_no, epoch_us(TIMESTAMP '2024-01-01') + idx * 600000000 AS time FROM i")
DRAW = lambda seed, *keys: f"(CAST('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(keys)})), 1, 13) AS BIGINT) * CAST({2.0**-52!r} AS DOUBLE))"
add("reg8_jittered_times", lambda d: G.jittered_times(d, "2024-01-01 00:00:00").select("row_no", "time"), f"""WITH {ad.I}, j AS (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE 590 + CAST(floor(20 * {DRAW(0, 'sensor_id', 'idx')}) AS BIGINT) END AS jump FROM i)
 SELECT row_no, CAST(epoch_us(TIMESTAMP '2024-01-01') + 1000000 * sum(jump) OVER (PARTITION BY sensor_id ORDER BY idx) AS BIGINT) AS time FROM j""")

# statistics
LIM = ", ".join(f"{num(f'{g}({c})')} AS {g}_{c}" for c in CH for g in ("min", "max"))
add("agg1_min_max", lambda d: A.min_max(d), f"WITH {ad.R} SELECT sensor_id, {LIM} FROM r GROUP BY 1")
add("agg2_rollup", lambda d: A.min_max(d, rollup=True), f"WITH {ad.R} SELECT sensor_id, {LIM} FROM r GROUP BY ROLLUP (sensor_id)")
OVER = "(PARTITION BY sensor_id)"
add("agg3_scale", lambda d: A.minmax_scale(d).select("row_no", *CH), f"WITH {ad.R} SELECT row_no, {', '.join(f'{num(f'coalesce(({c} - min({c}) OVER {OVER}) / nullif(max({c}) OVER {OVER} - min({c}) OVER {OVER}, 0), 0)')} AS {c}' for c in CH)} FROM r")
add("agg3_scale_global", lambda d: A.minmax_scale(d, scope="global").select("row_no", *CH), f"WITH {ad.R} SELECT row_no, {', '.join(f'{num(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} AS {c}' for c in CH)} FROM r")
# halfway between the scaled value and the lower limit
add("agg4_inverse", lambda d: A.minmax_inverse(A.minmax_scale(d).withColumns({c: F.col(c) / 2 for c in CH}), A.limits_of(d, CH)).select("row_no", *CH), f"WITH {ad.R} SELECT row_no, {', '.join(f'{num(f'({c} + min({c}) OVER {OVER}) / 2')} AS {c}' for c in CH)} FROM r")
add("agg5_rescale", lambda d: A.rescale_to_range(d).select("row_no", *A.RANGES), f"WITH {ad.R} SELECT row_no, {', '.join(f'{num(f'coalesce(({c} - min({c}) OVER {OVER}) / nullif(max({c}) OVER {OVER} - min({c}) OVER {OVER}, 0), 0) * {hi - lo} + {lo}')} AS {c}' for c, (lo, hi) in A.RANGES.items())} FROM r")
add("agg6_channel_stats", lambda d: A.channel_stats(d), f"WITH {ad.R} SELECT sensor_id, {', '.join(f'{num(f'{g}({c})')} AS {n}_{c}' for c in CH for n, g in (('min', 'min'), ('max', 'max'), ('mean', 'avg'), ('std', 'stddev_samp')))} FROM r GROUP BY 1")
add("agg7_describe", lambda d: A.describe_channel(d, "value_temp"), f"WITH {ad.R} SELECT count(*) AS n, {num('avg(value_temp)')} AS mean, {num('stddev_samp(value_temp)')} AS std, {num('min(value_temp)')} AS low, {', '.join(f'{num(f'quantile_cont(value_temp, {q / 100})')} AS q{q}' for q in (25, 50, 75))}, {num('max(value_temp)')} AS high FROM r")
add("agg8_histogram", lambda d: A.histogram(d, "value_temp"), f"WITH {ad.R}, l AS (SELECT min(value_temp) AS lo, max(value_temp) AS hi FROM r) SELECT CAST(least(floor((value_temp - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM r, l GROUP BY 1")
RANGE = "CASE WHEN idx > 0 AND (value_temp < -15 OR value_temp > 50 OR value_acid < 3 OR value_acid > 9.5 OR value_hum < 7.5 OR value_hum > 90) THEN 'error' ELSE 'good' END"
add("agg9_label_share", lambda d: A.label_share(L.label_by_range(d)), f"WITH {ad.I}, x AS (SELECT *, {RANGE} AS label FROM i) SELECT sensor_id, count(*) AS n, count(*) FILTER (label = 'good') AS n_target, {num("100.0 * count(*) FILTER (label = 'good') / count(*)")} AS percent FROM x GROUP BY 1")
THR = ad.I + ", d AS (SELECT *, " + ", ".join(f"abs(value_{c} - lag(value_{c}) OVER (PARTITION BY sensor_id ORDER BY idx)) AS d_{c}" for c in ("temp", "hum", "acid")) + " FROM i), th AS (SELECT sensor_id, " + ", ".join(f"avg(d_{c}) + 3 * stddev_samp(d_{c}) AS thr_{c}" for c in ("temp", "hum", "acid")) + " FROM d GROUP BY 1)"
add("agg10_jump_thresholds", lambda d: A.jump_thresholds(d), f"WITH {THR} SELECT sensor_id, {', '.join(f'{num(f'thr_{c}')} AS thr_{c}' for c in ('temp', 'hum', 'acid'))} FROM th")
add("agg11_above_quantile", lambda d: A.flag_above_quantile(d, "value_temp").select("row_no", "is_above"), f"WITH {ad.R} SELECT row_no, value_temp > (SELECT quantile_cont(value_temp, 0.95) FROM r) AS is_above FROM r")
add("agg12_class_counts", lambda d: A.class_counts(L.label_by_range(d)), f"WITH {ad.I} SELECT {RANGE} AS label, count(*) AS n FROM i GROUP BY 1")

# labels
add("lab1_range", lambda d: L.label_by_range(d).select("row_no", "label"), f"WITH {ad.I} SELECT row_no, {RANGE} AS label FROM i")
HIT = " OR ".join(f"coalesce(d_{c} > thr_{c}, false)" for c in ("temp", "hum", "acid"))


add("lab2_jump", lambda d: L.label_by_jump(d, A.jump_thresholds(d)).select("row_no", "label"), f"WITH {THR} SELECT row_no, CASE WHEN {HIT} OR value_hum > 100 THEN '1' ELSE '0' END AS label FROM d JOIN th USING (sensor_id)")
add("lab3_gap", lambda d: L.label_by_gap(L.label_by_jump(d, A.jump_thresholds(d)), DAY).select("row_no", "label"), f"WITH {THR} SELECT row_no, CASE WHEN {LAST} > 1440 THEN 'error' WHEN {HIT} OR value_hum > 100 THEN '1' ELSE '0' END AS label FROM d JOIN th USING (sensor_id)")


def _range_errors(d: DataFrame) -> DataFrame:
    return C.with_idx(L.label_by_range(d)).filter("label = 'error'").select("sensor_id", F.lit("value_temp").alias("channel"), "idx")


def _jumps(d: DataFrame) -> DataFrame:
    return C.with_idx(L.label_by_jump(d, A.jump_thresholds(d))).filter("label = '1'").select("sensor_id", F.lit("value_temp").alias("channel"), "idx")


BY_RANGE = f"SELECT sensor_id, idx FROM i WHERE {RANGE} = 'error'"
BY_JUMP = f"SELECT sensor_id, idx FROM d JOIN th USING (sensor_id) WHERE {HIT} OR value_hum > 100"
add("lab4_manual", lambda d: L.add_manual_labels(_range_errors(d), _jumps(d).withColumnRenamed("idx", "start")), f"WITH {THR} SELECT sensor_id, 'value_temp' AS channel, idx FROM ({BY_RANGE}) UNION SELECT sensor_id, 'value_temp', idx + 10 FROM ({BY_JUMP})")
add("lab5_merge_errors", lambda d: L.merge_errors(_range_errors(d), _jumps(d)), f"WITH {THR} {BY_RANGE} UNION {BY_JUMP}")
MARK = f"FROM i LEFT JOIN (SELECT sensor_id, idx AS e FROM ({BY_JUMP})) x ON i.sensor_id = x.sensor_id AND greatest(0, e - 8) <= i.idx AND i.idx < e + 8 WHERE i.idx < n - 20 GROUP BY i.sensor_id, i.idx"
add("lab6_windows", lambda d: L.label_windows(d, _jumps(d)), f"WITH {THR} SELECT i.sensor_id, i.idx, CAST(max(CASE WHEN e IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS label {MARK}")
INJECT = lambda c: (f"{DRAW(0, 'sensor_id', 'row_no', repr(c))} < CAST(0.05 AS DOUBLE)", f"{c} * (1 + (50 + 150 * {DRAW(1, 'sensor_id', 'row_no', repr(c))}) / CAST(100 AS DOUBLE))")
add("lab7_inject_errors", lambda d: L.inject_errors(d, ("value_temp", "value_hum")).select("row_no", *[f"{p}{c}" for c in ("value_temp", "value_hum") for p in ("", "is_error_")]),
    f"WITH {ad.R} SELECT row_no, " + ", ".join(f"{hit} AS is_error_{c}, {num(f'CASE WHEN {hit} THEN {grown} ELSE {c} END')} AS {c}" for c in ("value_temp", "value_hum") for hit, grown in [INJECT(c)]) + " FROM r")

# windows: some values as they are, all of them as a sum of millionths times their place
MILLION = "CAST(round(CAST({} AS DOUBLE) * 1000000) AS BIGINT)"


def _all_values(flat) -> F.Column:
    places = F.transform(flat, lambda x, i: (i + 1) * F.round(x * 1e6).cast("long"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, b: a + b).alias("total")


def _totals(place: str, width: int = 30) -> str:
    """The same in SQL: ``place`` is that of channel c and row k."""
    parts = " + ".join(f"({place.format(c=i, k='(y.idx - x.idx)')} + 1) * {MILLION.format(f'y.{c}')}" for i, c in enumerate(("value_temp", "value_hum", "value_acid")))
    return f"t AS (SELECT x.sensor_id, x.idx, CAST(sum({parts}) AS BIGINT) AS total FROM i x JOIN i y ON x.sensor_id = y.sensor_id AND y.idx >= x.idx AND y.idx < x.idx + {width} WHERE x.idx <= x.n - {width} GROUP BY ALL)"


def _digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.size("features").alias("n"), F.get("features", 0).alias("a"), F.element_at("features", -1).alias("z"), F.get("features", 30).alias("m"))


def _flat(size: int, drop: int, cols=("value_temp", "value_hum", "value_acid"), part="sensor_id") -> str:
    lead = lambda c, k: f"lead({c}, {k}) OVER (PARTITION BY {part} ORDER BY time, row_no)"
    m = lead(cols[30 // size], 30 % size)
    return f"{3 * size} AS n, {num(cols[0])} AS a, {num(lead(cols[2], size - 1))} AS z, {num(m)} AS m"


add("win1_flat", lambda d: W.sliding_windows(d).select("sensor_id", "idx", F.size("features").alias("n"), _all_values(F.col("features"))), f"WITH {ad.I}, {_totals('30 * {c} + {k}')} SELECT sensor_id, idx, CAST(90 AS BIGINT) AS n, total FROM t")
add("win2_rows", lambda d: W.sliding_windows(d, layout="rows").select("sensor_id", "idx", F.size("features").alias("n"), _all_values(F.flatten("features"))), f"WITH {ad.I}, {_totals('{c} + 3 * {k}')} SELECT sensor_id, idx, CAST(30 AS BIGINT) AS n, total FROM t")
add("win9_flatten_rows", lambda d: W.flatten_window(W.sliding_windows(d, layout="rows")).select("sensor_id", "idx", _all_values(F.col("features"))), f"WITH {ad.I}, {_totals('{c} + 3 * {k}')} SELECT sensor_id, idx, total FROM t")
add("win3_drop_last", lambda d: _digest(W.sliding_windows(A.minmax_scale(d, scope="global"), 20, drop_last=True), "sensor_id", "idx"), f"WITH {ad.I.replace('FROM r WINDOW', 'FROM g WINDOW').replace(', i AS', ', g AS (SELECT sensor_id, row_no, time, ' + ', '.join(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}' for c in CH) + ' FROM r), i AS', 1)}, x AS (SELECT sensor_id, idx, n AS total, {_flat(20, 1)} FROM i) SELECT sensor_id, idx, CAST(n AS BIGINT) AS n, a, z, m FROM x WHERE idx < total - 20")
add("win4_within_segments", lambda d: W.sliding_windows(seg(d), 5, within="seg_id").select("sensor_id", "seg_id", "idx", F.element_at("features", -1).alias("z")), f"WITH {ad.S}, x AS (SELECT sensor_id, seg_id, row_number() OVER w - 1 AS idx, lead(value_acid, 4) OVER w AS v, count(*) OVER (PARTITION BY sensor_id, seg_id) AS total FROM s WINDOW w AS (PARTITION BY sensor_id, seg_id ORDER BY time, row_no)) SELECT sensor_id, seg_id, idx, {num('v')} AS z FROM x WHERE idx <= total - 5")
add("win5_target", lambda d: W.with_target(W.sliding_windows(d, layout="rows")).select("sensor_id", "idx", F.get("target", 0).alias("temp"), F.get("target", 2).alias("acid")), f"WITH {ad.I}, x AS (SELECT sensor_id, idx, n AS total, lead(value_temp, 29) OVER w AS t, lead(value_acid, 29) OVER w AS c FROM i WINDOW w AS (PARTITION BY sensor_id ORDER BY idx)) SELECT sensor_id, idx, {num('t')} AS temp, {num('c')} AS acid FROM x WHERE idx <= total - 30")
MOVE = "CASE WHEN idx < 15 THEN sum(value_temp) OVER (PARTITION BY sensor_id ORDER BY idx ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING) ELSE sum(value_temp) OVER (PARTITION BY sensor_id ORDER BY idx ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING) END / 30"
add("win6_moving_average", lambda d: W.moving_average(d, "value_temp").select("row_no", "moving_average"), f"WITH {ad.I} SELECT row_no, {num(MOVE)} AS moving_average FROM i")
add("win7_first_and_last", lambda d: W.take_first(d, 7).unionByName(W.take_last(d, 7)).select("row_no", "idx"), f"WITH {ad.I} SELECT row_no, idx FROM i WHERE idx < 7 UNION ALL SELECT row_no, idx FROM i WHERE idx >= n - 7")
add("win8_temporal_split", lambda d: W.temporal_split(d, 40).select("row_no", "split"), f"WITH {ad.I} SELECT row_no, CASE WHEN idx < 40 THEN 'train' ELSE 'test' END AS split FROM i")
add("win9_flatten", lambda d: W.unflatten_window(W.sliding_windows(d, 20, stride=20), 20), f"WITH {ad.I}, x AS (SELECT sensor_id, idx AS i0, n FROM i WHERE idx <= n - 20 AND idx % 20 = 0) SELECT x.sensor_id, x.i0 AS idx, i.idx - x.i0 AS step, {', '.join(f'{num(c)} AS {c}' for c in W.SAMPLE)} FROM x JOIN i ON x.sensor_id = i.sensor_id AND i.idx >= x.i0 AND i.idx < x.i0 + 20")

# smoothing and decomposition
def _savgol_sql(window: int = 11) -> str:
    from ..functions.kernels import savgol_weights

    half = window // 2
    at = lambda k: f"(CASE WHEN idx + ({k}) >= 0 THEN " + (f"lead(value_temp, {k})" if k >= 0 else f"lag(value_temp, {-k})") + " OVER w END)"
    total = lambda first, p=None: " + ".join(f"CAST({float(c)!r} AS DOUBLE) * {at(first + j)}" for j, c in enumerate(savgol_weights(window, 2, p)))
    cases = [f"WHEN n < {window} THEN value_temp", f"WHEN idx >= {half} AND idx < n - {half} THEN {total(-half)}"]
    cases += [f"WHEN idx = {p} THEN {total(-p, float(p))}" for p in range(half)]
    cases += [f"WHEN idx = n - 1 - {p} THEN {total(-(window - 1 - p), float(window - 1 - p))}" for p in range(half)]
    return f"WITH {ad.I} SELECT row_no, {num('CASE ' + ' '.join(cases) + ' END')} AS value_temp FROM i WINDOW w AS (PARTITION BY sensor_id ORDER BY idx)"


add("smo1_savgol", lambda d: SM.savgol(d, ("value_temp",)).select("row_no", "value_temp"), _savgol_sql())
add("smo2_lowess", lambda d: SM.lowess(d, ("value_temp",)).select("row_no", "value_temp"))
add("smo2_lowess_near", lambda d: SM.lowess(d, ("value_temp",), k=12).select("row_no", "value_temp"))
add("smo3_kalman", lambda d: SM.kalman_level(d, ("value_temp",)).select("row_no", "value_temp"), f"""WITH RECURSIVE {ad.I}, k(sensor_id, idx, row_no, m, p) AS (
 SELECT sensor_id, idx, row_no, value_temp, CAST(0.5 AS DOUBLE) FROM i WHERE idx = 0 UNION ALL
 SELECT i.sensor_id, i.idx, i.row_no, k.m + (k.p + CAST(0.01 AS DOUBLE)) / (k.p + CAST(1.01 AS DOUBLE)) * (i.value_temp - k.m), (k.p + CAST(0.01 AS DOUBLE)) / (k.p + CAST(1.01 AS DOUBLE)) FROM k JOIN i ON i.sensor_id = k.sensor_id AND i.idx = k.idx + 1)
 SELECT row_no, {num('m')} AS value_temp FROM k""")
add("smo4_holt_winters", lambda d: SM.holt_winters(d, ("value_temp",)))
add("syn1_daily_period", lambda d: D.daily_period(d.withColumn("time", F.timestamp_seconds(F.unix_timestamp("time") / 60))), f"WITH {ad.R}, m AS (SELECT * REPLACE (make_timestamp(CAST(floor(epoch_us(time) / 1000000) * 1000000 / 60 AS BIGINT)) AS time) FROM r), x AS (SELECT *, lead(time) OVER (PARTITION BY sensor_id ORDER BY time, row_no) AS next FROM m) SELECT sensor_id, CAST(floor(1440 / nullif(avg({STEP}), 0)) AS BIGINT) AS period FROM x GROUP BY 1")
DEC = ad.I + """, t AS (SELECT *, idx % 12 AS phase, CASE WHEN idx >= 6 AND idx < n - 6 THEN (sum(value_temp) OVER (PARTITION BY sensor_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
 - (lag(value_temp, 6) OVER w + lead(value_temp, 6) OVER w) / 2) / 12 END AS trend FROM i WINDOW w AS (PARTITION BY sensor_id ORDER BY idx)),
 ph AS (SELECT sensor_id, phase, avg(value_temp - trend) AS m FROM t GROUP BY ALL), se AS (SELECT sensor_id, phase, m - avg(m) OVER (PARTITION BY sensor_id) AS seasonal FROM ph)"""
add("syn2_decompose", lambda d: D.decompose(d, "value_temp", 12).select("row_no", *[(F.col(c) * 8).alias(f"{c}_x8") for c in ("trend", "seasonal", "resid")]), f"WITH {DEC} SELECT row_no, {num('trend * 8')} AS trend_x8, {num('seasonal * 8')} AS seasonal_x8, {num('(value_temp - trend - seasonal) * 8')} AS resid_x8 FROM t JOIN se USING (sensor_id, phase)")
add("syn3_block_bootstrap", lambda d: D.block_bootstrap(D.decompose(d, "value_temp", 12), block=20))
add("syn4_shuffle_components", lambda d: D.shuffle_components(D.decompose(d, "value_temp", 12)))
add("syn5_synthesize", lambda d: D.synthesize(d, 50))
add("syn5_sequences", lambda d: D.synthesize_sequences(d, 50, 12, 4, cols=("value_temp", "value_hum")), f"""WITH {ad.I}, b AS (SELECT sensor_id, n, j, CAST(floor({DRAW(0, 'sensor_id', 'j')} * greatest(n - 11, 1)) AS BIGINT) AS a FROM (SELECT DISTINCT sensor_id, n FROM i), unnest(range(0, 7)) u(j)),
 o AS (SELECT *, j * 8 + k AS place, (a + k) % n AS idx, CASE WHEN k >= 8 AND j < 6 THEN 1 - (k - 7) / CAST(5 AS DOUBLE) WHEN k < 4 AND j > 0 THEN (k + 1) / CAST(5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w FROM b, unnest(range(0, 12)) v(k) WHERE j * 8 + k < 50)
 SELECT o.sensor_id, place AS row_no, epoch_us(TIMESTAMP '2024-01-01') + place * 600000000 AS time, {num('sum(w * value_temp)')} AS value_temp, {num('sum(w * value_hum)')} AS value_hum FROM o JOIN i ON o.sensor_id = i.sensor_id AND o.idx = i.idx GROUP BY o.sensor_id, place""")


# outliers and forecasts
def _windows(d: DataFrame) -> DataFrame:
    return W.sliding_windows(d, 10)


for _key, _name in (("out1", "isolation_forest"), ("out2", "local_outlier_factor"), ("out3", "elliptic_envelope")):
    add(f"{_key}_{_name}", lambda d, n=_name: O.detect_outliers(_windows(d), n).select("sensor_id", "idx", "pred"))
# channels that aren't multiples of each other, on one scale
add("out4_autoencoder", lambda d: O.detect_outliers(W.sliding_windows(A.minmax_scale(d, W.SAMPLE)), "autoencoder").select("sensor_id", "idx", "pred"), source=ad.line_readings)
add("out3_channel_distance", lambda d: O.channel_distance(d, "value_temp", "value_hum").select("row_no", "distance"), f"WITH {ad.R}, m AS (SELECT avg(value_temp) AS a, avg(value_hum) AS b, var_samp(value_temp) AS va, var_samp(value_hum) AS vb, covar_samp(value_temp, value_hum) AS c FROM r) SELECT row_no, {num('(vb * (value_temp - a) * (value_temp - a) - 2 * c * (value_temp - a) * (value_hum - b) + va * (value_hum - b) * (value_hum - b)) / (va * vb - c * c)')} AS distance FROM r, m")
add("for1_fourier", lambda d: FC.fourier_forecast(d))
add("for2_regressors", lambda d: FC.regressor_forecast(d))


def _daily(d: DataFrame, channel: str) -> DataFrame:
    return d.groupBy("sensor_id", F.date_trunc("day", "time").alias("time")).agg(F.max(channel).alias("value"))


add("for3_combine", lambda d: FC.combine_forecasts(*[_daily(d, c) for c in W.SAMPLE]), f"WITH {ad.R} SELECT sensor_id, {us("date_trunc('day', time)")} AS time, {', '.join(f'{num(f'max({c})')} AS {c}' for c in W.SAMPLE)} FROM r GROUP BY sensor_id, date_trunc('day', time)")
add("for3_combine_channels", lambda d: FC.combine_channels(C.to_long(d, W.SAMPLE).groupBy("sensor_id", F.date_trunc("day", "time").alias("time"), "channel").agg(F.max("value").alias("value"))), ORACLES["for3_combine"])
add("for3_combine_forecasts", lambda d: FC.fourier_forecasts(d, W.SAMPLE))

# federated averaging
add("fed1_clients", lambda d: FD.assign_clients(C.with_idx(d), 10, "sensor_id").select("row_no", "client_id"), f"WITH {ad.I} SELECT row_no, CAST(idx // (n // 10) AS BIGINT) AS client_id FROM i WHERE idx // (n // 10) < 10")
add("fed2_client_samples", lambda d: FD.client_samples(W.sliding_windows(d), 40).select("client_id", "idx", _all_values(F.col("features"))), f"WITH {ad.I}, {_totals('30 * {c} + {k}')} SELECT sensor_id AS client_id, idx, total FROM t WHERE idx < 40")
UP = "u AS (SELECT label AS round, vec_id, 1 + vec_id % 7 AS n, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings)"


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("round", F.posexplode("weights").alias("pos", "v"))


add("fed4_average", lambda d: _exploded(FD.fed_avg(d)), f"WITH {UP} SELECT CAST(round AS BIGINT) AS round, pos, {num('avg(CAST(v AS DOUBLE))')} AS v FROM u GROUP BY ALL", ad.updates)
add("fed5_weighted", lambda d: _exploded(FD.fed_avg(d, "n")), f"WITH {UP} SELECT CAST(round AS BIGINT) AS round, pos, {num('sum(n * CAST(v AS DOUBLE)) / sum(n)')} AS v FROM u GROUP BY ALL", ad.updates)
add("fed6_partial_batches", lambda d: FD.partial_batches(C.with_idx(d), 9, 20).select("sensor_id", "idx", "batch"), f"WITH {ad.I} SELECT sensor_id, idx, k AS batch FROM i, unnest(range(0, 9)) u(k) WHERE idx >= k AND idx < k + 20")
F16 = "pow(CAST(2 AS DOUBLE), greatest(floor(log2(abs(CAST(v AS DOUBLE)))), -14) - 10)"
add("fed7_float16", lambda d: _exploded(FD.fed_avg(FD.quantize_f16(d))), f"WITH {UP}, h AS (SELECT round, pos, CASE WHEN v = 0 THEN CAST(0 AS DOUBLE) ELSE round_even(CAST(v AS DOUBLE) / {F16}, 0) * {F16} END AS v FROM u) SELECT CAST(round AS BIGINT) AS round, pos, {num('avg(v)')} AS v FROM h GROUP BY ALL", ad.updates)
I8 = UP + """, s AS (SELECT *, avg(CAST(v AS DOUBLE)) OVER w AS m, stddev_pop(CAST(v AS DOUBLE)) OVER w AS s FROM u WINDOW w AS (PARTITION BY vec_id)),
 c AS (SELECT *, greatest(least(CAST(v AS DOUBLE), m + 2 * s), m - 2 * s) AS x FROM s), l AS (SELECT *, min(x) OVER (PARTITION BY vec_id) AS lo, max(x) OVER (PARTITION BY vec_id) AS hi FROM c)"""
add("fed8_int8", lambda d: FD.quantize_i8(d).select("client_id", F.posexplode("weights").alias("pos", "q"), "min", "max"), f"WITH {I8} SELECT CAST(vec_id AS VARCHAR) AS client_id, pos, CAST(round_even(((x - lo) / (hi - lo) * 2 - 1) * 127, 0) AS BIGINT) AS q, {num('lo')} AS min, {num('hi')} AS max FROM l", ad.updates)
SPEC = [{"units": 8, "activation": "relu"}, {"units": 1, "activation": "sigmoid"}]


def _train(d: DataFrame, variant: str, rounds: int = 5) -> DataFrame:
    data = FD.training_table(A.minmax_scale(d), _jumps(d)).withColumn("client_id", F.col("sensor_id"))
    return FD.federated_train(data, SPEC, rounds, variant)[1]


add("fed9_rounds", lambda d: _train(d, "int8"))
add("fed9_partial", lambda d: _train(d, "partial", 2))
add("fed6_weighted_by_work", lambda d: _exploded(FD.fed_avg(d.withColumn("client_id", F.col("client_id")).join(FD.work_of([0], d.select("client_id")).select("client_id", "work"), "client_id"), "work")), f"""WITH {UP.replace("1 + vec_id % 7 AS n", f"5 + CAST(floor(6 * {DRAW(0, 'CAST(vec_id AS VARCHAR)', "'0'")}) AS BIGINT) AS n")} SELECT CAST(round AS BIGINT) AS round, pos, {num('sum(n * CAST(v AS DOUBLE)) / sum(n)')} AS v FROM u GROUP BY ALL""", ad.updates)
add("fed10_training_table", lambda d: FD.training_table(d, _jumps(d)).select("sensor_id", "idx", "label", F.element_at("features", -1).alias("z")), f"WITH {THR}, y AS (SELECT i.sensor_id, i.idx, CAST(max(CASE WHEN e IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS label {MARK}), x AS (SELECT sensor_id, idx, lead(value_acid, 19) OVER (PARTITION BY sensor_id ORDER BY idx) AS v FROM i) SELECT y.sensor_id, y.idx, y.label, {num('v')} AS z FROM y JOIN x USING (sensor_id, idx)")
add("fed11_balance", lambda d: FD.balance_classes(L.label_by_range(C.with_idx(d)), None, keys=("row_no",)).select("row_no", "label"), f"WITH {ad.I}, x AS (SELECT row_no, {RANGE} AS label FROM i) SELECT row_no, label FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_no) <= (SELECT min(c) FROM (SELECT count(*) AS c FROM x GROUP BY label))")
add("fed11_balance_hashed", lambda d: FD.balance_classes(L.label_by_range(C.with_idx(d))).select("row_no", "label"), f"WITH {ad.I}, x AS (SELECT row_no, {RANGE} AS label, {DRAW(0, 'sensor_id', 'idx')} AS h FROM i) SELECT row_no, label FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY h) <= (SELECT min(c) FROM (SELECT count(*) AS c FROM x GROUP BY label))")
add("fed12_batches", lambda d: FD.make_batches(C.with_idx(d), 2, 40, None).select("row_no", "epoch", "batch"), f"WITH {ad.I} SELECT row_no, e AS epoch, idx // 40 AS batch FROM i, unnest([1::BIGINT, 2::BIGINT]) u(e)")

# metrics
add("met1_confusion", lambda d: M.confusion_matrix(d), f"WITH {ad.P} SELECT CAST(y_true AS BIGINT) AS y_true, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1 FROM p GROUP BY 1", ad.predictions)
add("met2_binary", lambda d: M.binary_metrics(d), f"""WITH {ad.P}, q AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS hit, greatest(least(score, 1 - CAST(1e-7 AS DOUBLE)), CAST(1e-7 AS DOUBLE)) AS g FROM p),
 c AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM p GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
 SELECT {num('avg(CASE WHEN y_true = hit THEN 1.0 ELSE 0.0 END)')} AS accuracy, {num('sum(y_true * hit) / CAST(sum(hit) AS DOUBLE)')} AS "precision", {num('sum(y_true * hit) / CAST(sum(y_true) AS DOUBLE)')} AS recall,
 {num('-avg(y_true * ln(g) + (1 - y_true) * ln(1 - g))')} AS log_loss, (SELECT {num('sum(pos * (below + neg / CAST(2 AS DOUBLE))) / CAST(sum(pos) * sum(neg) AS DOUBLE)')} FROM w) AS auc FROM q""", ad.predictions)
# per client and round, which come from the documents' ids
BY = ("client_id", "round")
add("met2_by_client_and_round", lambda d: M.binary_metrics(d.withColumns({"client_id": F.col("idx") % 10, "round": F.floor(F.col("idx") / 10) % 3}), BY), f"""WITH {ad.P}, e AS (SELECT *, idx % 10 AS client_id, (idx // 10) % 3 AS round FROM p), q AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS hit, greatest(least(score, 1 - CAST(1e-7 AS DOUBLE)), CAST(1e-7 AS DOUBLE)) AS g FROM e),
 c AS (SELECT client_id, round, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM e GROUP BY ALL), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY client_id, round ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
 a AS (SELECT client_id, round, sum(pos * (below + neg / CAST(2 AS DOUBLE))) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auc FROM w GROUP BY ALL)
 SELECT client_id, round, {num('avg(CASE WHEN y_true = hit THEN 1.0 ELSE 0.0 END)')} AS accuracy, {num('sum(y_true * hit) / nullif(CAST(sum(hit) AS DOUBLE), 0)')} AS "precision", {num('sum(y_true * hit) / nullif(CAST(sum(y_true) AS DOUBLE), 0)')} AS recall,
 {num('-avg(y_true * ln(g) + (1 - y_true) * ln(1 - g))')} AS log_loss, {num('any_value(auc)')} AS auc FROM q JOIN a USING (client_id, round) GROUP BY ALL""", ad.predictions)
add("met3_mse", lambda d: M.mse(d, pred="score"), f"WITH {ad.P} SELECT {num('avg((y_true - score) * (y_true - score))')} AS mse FROM p", ad.predictions)
add("met4_positives", lambda d: M.positives(d, d.select("sensor_id", "idx", F.col("score").alias("value"))).select("idx", "kind", "value"), f"WITH {ad.P} SELECT idx, 'true' AS kind, {num('score')} AS value FROM p WHERE y_true = 1 UNION ALL SELECT idx, 'predicted', {num('score')} FROM p WHERE score > 0.5", ad.predictions)

# the batch form of streams
add("str1_sessions", lambda d: live.outage_sessions(d, "1 day"), f"WITH {ad.I}, b AS (SELECT *, coalesce(epoch_us(time) - epoch_us(prev) > 86400000000, true) AS new FROM i), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY sensor_id ORDER BY idx) AS no FROM b) SELECT sensor_id, count(*) AS n_rows, {us('min(time)')} AS first_time, {us('max(time)')} AS last_time FROM s GROUP BY sensor_id, no")
add("str4_range_labels", lambda d: live.range_labels(d).select("row_no", "label"), f"WITH {ad.I} SELECT row_no, {RANGE.replace('idx > 0 AND ', '')} AS label FROM i")
add("str5_tumbling", lambda d: live.tumbling_stats(d, size="1 day"), f"WITH {ad.R} SELECT sensor_id, {us("date_trunc('day', time)")} AS window_start, count(*) AS n_rows, {num('avg(value_temp)')} AS mean, {num('min(value_temp)')} AS low, {num('max(value_temp)')} AS high FROM r GROUP BY sensor_id, date_trunc('day', time)")
add("str7_sliding", lambda d: live.tumbling_stats(d, size="2 days", slide="1 day"), f"WITH {ad.R}, x AS (SELECT *, date_trunc('day', time) - to_days(CAST(k AS INTEGER)) AS ws FROM r, unnest([0, 1]) u(k)) SELECT sensor_id, {us('ws')} AS window_start, count(*) AS n_rows, {num('avg(value_temp)')} AS mean, {num('min(value_temp)')} AS low, {num('max(value_temp)')} AS high FROM x GROUP BY sensor_id, ws")
add("str8_drop_resent", lambda d: live.drop_resent(d.withColumn("time", F.date_trunc("day", "time"))).select("sensor_id", "time"), f"WITH {ad.R} SELECT DISTINCT sensor_id, {us("date_trunc('day', time)")} AS time FROM r")


# the same as streams: readings come in slices of time, each read by a run of its own that goes on where the one before ended
SLICES = 3


def _streamed(spark: SparkSession, sf_dir: str, live_form: Callable[[DataFrame], DataFrame], closes: str | None = None) -> DataFrame:
    """All that a stream of the readings has put out, each row once.

    With ``closes`` (how long after a reading its windows end) a row without a sensor follows the last slice, a day after all windows of
    readings have ended: the watermark passes them, so they are put out too; that row's own windows never are.
    """
    path = IO.shared_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    low, high = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    place = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * SLICES / F.lit(high - low + 1))
    events.limit(0).write.parquet(f"{path}/in")
    out = live_form(ad.as_readings(spark.readStream.schema(events.schema).parquet(f"{path}/in")))

    def store(batch: DataFrame, number: int) -> None:  # a repeated batch overwrites itself
        batch.write.mode("overwrite").parquet(f"{path}/out/{number}")

    before = live.with_rocksdb(spark)
    try:
        for i in range(SLICES):
            events.filter(place == i).write.mode("append").parquet(f"{path}/in")
            writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").foreachBatch(store)
            writer.trigger(availableNow=True).start().awaitTermination()
        if closes:
            end = F.max("ts") + F.expr(f"INTERVAL {closes}") + F.expr("INTERVAL 1 day")
            beat = events.agg(end.alias("ts")).select(*[(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
            beat.write.mode("append").parquet(f"{path}/in")
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(out.schema).parquet(f"{path}/out/*")


def stream(name: str, sql: str, live_form: Callable[[DataFrame], DataFrame], closes: str | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: _streamed(spark, sf_dir, live_form, closes))


stream("str1_sessions_live", ORACLES["str1_sessions"], lambda d: live.outage_sessions(d, "1 day"), "1 day")
LIVE = f"CASE WHEN {LAST} > 1440 THEN 'error' WHEN coalesce(abs(value_temp - lag(value_temp) OVER w) > 60, false) OR coalesce(abs(value_hum - lag(value_hum) OVER w) > 60, false) OR value_hum > 100 THEN '1' ELSE '0' END"
stream("str2_labels_live", f"WITH {ad.I} SELECT sensor_id, {us('time')} AS time, {LIVE} AS label FROM i WINDOW w AS (PARTITION BY sensor_id ORDER BY idx)", lambda d: live.live_labels(d, {"value_temp": 60.0, "value_hum": 60.0}, DAY))
LEVELS = ORACLES["smo3_kalman"].replace("idx, row_no,", "idx, time,").replace("i.row_no,", "i.time,").replace("SELECT row_no, ", f"SELECT sensor_id, {us('time')} AS time, ").replace("AS value_temp FROM k", "AS level FROM k")
stream("str3_kalman_live", LEVELS, lambda d: live.live_kalman(d))
stream("str4_range_labels_live", ORACLES["str4_range_labels"], lambda d: live.range_labels(d).select("row_no", "label"))
stream("str5_tumbling_live", ORACLES["str5_tumbling"], lambda d: live.tumbling_stats(d, size="1 day"), "1 day")
stream("str7_sliding_live", ORACLES["str7_sliding"], lambda d: live.tumbling_stats(d, size="2 days", slide="1 day"), "2 days")
stream("str8_drop_resent_live", ORACLES["str8_drop_resent"], lambda d: live.drop_resent(d.withColumn("time", F.date_trunc("day", "time")), "1000 days").select("sensor_id", "time"))


@query("str6_collect_updates", f"WITH {UP} SELECT CAST(round AS BIGINT) AS round, pos, {num('avg(CAST(v AS DOUBLE))')} AS v FROM u GROUP BY ALL HAVING count(*) >= 48")
def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates as JSON files that come in two parts, the first sent again, some lines broken; rounds with 48 clients pass their means on."""
    path = IO.shared_path(spark, "updates")
    rows = ad.updates(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.col("client_id").cast("long")))
    bodies = IO.format_updates(rows.withColumn("late", place > 47)).select("late", F.explode(F.when(F.col("n") == 1, F.array("body", F.expr("left(body, 40)"))).otherwise(F.array("body"))).alias("body"))
    parts = bodies.filter("not late").select("body"), bodies.select("body")

    def done(means: DataFrame, number: int) -> None:
        means.write.mode("overwrite").parquet(f"{path}/means/{number}")

    spark.createDataFrame([], "body string").write.text(f"{path}/in")
    for part in parts:
        part.write.mode("append").text(f"{path}/in")
        stream = IO.well_formed(IO.read_updates(spark, f"{path}/in", 1000))
        live.collect_updates(stream, f"{path}/kept", 48, done, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return _exploded(spark.read.schema("round int, layer int, weights array<double>").parquet(f"{path}/means/*"))


@query("src6_malformed_updates", f"SELECT count(*) AS n, CAST(sum(CAST(vec_id % 7 = 0 AS INTEGER)) AS BIGINT) AS n_malformed FROM embeddings")
def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies written as they are sent, those of every seventh client cut short, and read again."""
    path = IO.shared_path(spark, "bodies")
    rows = IO.format_updates(ad.updates(spark, sf_dir))
    rows.select(F.when(F.col("n") == 1, F.expr("left(body, 40)")).otherwise(F.col("body"))).write.text(path)
    return IO.read_updates(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_malformed").alias("n_malformed"))
