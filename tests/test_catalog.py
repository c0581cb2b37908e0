"""Every registered time-series query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sensorloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(frame):
    cols = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted((tuple(clean(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, db, name):
    cols, got = _rows(catalog.QUERIES[name](spark, SF).toPandas())
    want_cols, want = _rows(db.sql(catalog.ORACLES[name]).df())
    assert cols == want_cols and len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_and_repeats(spark, name):
    first, second = (catalog.QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(first) and len(first) == len(second)
    if not name.startswith("fed9_"):  # sums of floats in any order
        assert _rows(first)[1] == _rows(second)[1]
    else:
        keys = ["client_id", "round", "n", "work"]
        assert _rows(first[keys]) == _rows(second[keys])
        order = ["round", "client_id"]
        for c in ("loss", "accuracy", "log_loss"):
            assert abs(first.sort_values(order)[c].to_numpy() - second.sort_values(order)[c].to_numpy()).max() < 1e-3


@pytest.mark.parametrize("name", ["str1_sessions", "str5_tumbling", "str7_sliding"])
def test_streams_put_out_their_last_windows(spark, name):
    batch, streamed = (_rows(catalog.QUERIES[n](spark, SF).toPandas()) for n in (name, f"{name}_live"))
    assert streamed == batch
