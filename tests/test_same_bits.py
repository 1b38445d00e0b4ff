"""Values where the last bit or the sign of a zero decides, against SQL as text."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.operators.series import direction, wrap_degrees
from pathloom.plans import registry


def texts(table):
    names = sorted(table.column_names)
    return sorted(zip(*[map(str, table.column(n).to_pylist()) for n in names], strict=True))


@pytest.fixture(scope="module")
def straight_back(tmp_path_factory):
    """Runs whose chords turn straight back every four rows, by steps of all directions."""
    rng, rows = np.random.default_rng(3), []
    for run in range(600):
        a, b = (np.round(rng.uniform(0, 150, 2), 2) for _ in "ab")
        rows += [(run * 100 + k, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k), run, "view", float((a if k % 8 < 4 else b)[0]), f'{{"k": {int((a if k % 8 < 4 else b)[1])}}}') for k in range(24)]
    out = tmp_path_factory.mktemp("back")
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(out / "events.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["traj_heading_unwrap", "traj_heading_rate_smooth", "traj_reported_turns", "traj_turn_events"])
def test_turns_straight_back_go_to_the_side_of_sql(spark, straight_back, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{straight_back}/events.parquet'")
    assert texts(registry.QUERIES[name](spark, straight_back).toArrow()) == texts(con.sql(registry.ORACLES[name]).to_arrow_table())


@pytest.fixture(scope="module")
def short_routes(tmp_path_factory):
    """Routes of five places on a small grid, many of whose turns are symmetric, and some rows twice."""
    rng, rows = np.random.default_rng(5), []
    for run in range(4000):
        places = [(run * 5 + k, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k), run, "view", float(x), f'{{"k": {y}}}') for k, (x, y) in enumerate(rng.integers(0, 4, (5, 2)))]
        rows += places + places[:1] * (run % 10 == 0)
    out = tmp_path_factory.mktemp("short")
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(out / "events.parquet")
    return str(out)


def test_symmetric_and_repeated_turns_have_the_centre_of_sql(spark, short_routes):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{short_routes}/events.parquet'")
    assert texts(registry.QUERIES["traj_turn_sessions"](spark, short_routes).toArrow()) == texts(con.sql(registry.ORACLES["traj_turn_sessions"]).to_arrow_table())


def test_direction_has_the_bits_of_the_c_library(spark):
    ends = [(-14.55, 50.0), (-0.6300000000000026, -34.0), (107.29, 21.0), (0.0, -0.0), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(ends, "x double, y double").select(direction("y", "x")).collect()]
    assert got == [None if x is None else math.atan2(y, x) * (180 / math.pi) for x, y in ends]


def test_wrapping_has_the_bits_of_sql(spark):
    angles = [float(np.nextafter(k, k + d)) for k in (-540, -360, -180, 0, 180, 360, 540) for d in (-1, 1)] + [180.0, -180.0, 540.0]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in angles], "a double").select(wrap_degrees(F.col("a"))).collect()]
    assert got == [180.0 - ((180.0 - a) - 360.0 * math.floor((180.0 - a) / 360.0)) for a in angles]


def test_positions_that_round_to_zero_keep_their_sign(spark, tmp_path):
    vectors = [[-1e-7, 1e-7, -2e-6, 0, 0, 0, 0], [-0.0, -0.000004, 0.5, 0, 0, 0, 0]]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([1, 2])::BIGINT AS vec_id, unnest({vectors}::FLOAT[][]) AS embedding, unnest([2, 4])::INT AS label) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert texts(registry.QUERIES["turn_positions"](spark, str(tmp_path)).toArrow()) == texts(con.sql(registry.ORACLES["turn_positions"]).to_arrow_table())
