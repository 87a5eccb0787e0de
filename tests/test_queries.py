"""Every query with SQL gives the rows of DuckDB on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

from voxelane.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert got == sorted(tables.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_others_run_over_whole_tables(spark, name):
    """Queries without SQL, whose kernels other tests hold against planted truth: rows, and no missing keys."""
    rows = QUERIES[name](spark, SF).collect()
    keys = [c for c in rows[0].asDict() if c in ("t", "x", "y", "pix", "cell")]
    assert rows and all(r[c] is not None for r in rows for c in keys)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_footprints_of_hals_stay_near_their_seeds(spark):
    """Blurred supports: cell k starts at pixel (0, k) of its block and reaches the pixels around it; the rest is background."""
    rows = QUERIES["hals"](spark, SF).collect()
    assert rows and all(r.w > 0 and r.x - r.bx <= 1 and abs(r.y - r.by - r.cell) <= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert registry.flagship(spark, SF).count() == 64


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_frame_is_registered(spark):
    from voxelane.plans.fixtures import Views

    want = {r.t for r in Views(spark, SF).movie.select("t").distinct().collect()}
    got = [r.t for r in QUERIES["register_rigid"](spark, SF).select("t").collect()]
    assert len(got) == len(want) and set(got) == want


def test_noise_reads_whole_and_short_traces(spark):
    import numpy as np

    from voxelane.functions.signal import noise_fft
    from voxelane.operators import traces as T

    rng = np.random.default_rng(0)
    ys = {n: np.r_[rng.normal(size=n // 2), rng.normal(size=n - n // 2) * 5] for n in (1, 2, 3, 20, 41, 100)}
    df = spark.createDataFrame([(n, t, float(x)) for n, y in ys.items() for t, x in enumerate(y)], "pix long, t long, v double")
    got = {r.pix: r.noise for r in T.noise_fft(df).collect()}
    assert got.pop(1) is None and set(got) == set(ys) - {1}
    assert all(np.isclose(got[n], noise_fft(ys[n], method="mean")[0]) for n in got)
    most = {r.pix: r.noise for r in T.noise_fft(df, most=30).collect()}
    assert all(np.isclose(most[n], noise_fft(ys[n], method="mean", most=30)[0]) for n in got)


def test_noise_of_odd_traces_goes_to_arrow(spark):
    """Null pixels are a trace of their own, null values leave no noise, null frames come last; rows don't pass through pandas."""
    import numpy as np

    from voxelane.functions.signal import noise_fft
    from voxelane.operators import traces as T

    rows = [(1, 3, 4.0), (1, 0, 1.0), (1, 2, -2.0), (1, 1, 3.0), (2, 0, 1.0), (2, 1, None), (2, 2, 5.0), (None, 1, 2.0), (None, 0, 7.0), (None, 2, 1.0), (3, None, 9.0), (3, 1, 2.0), (3, 0, 1.0), (4, 0, None)]
    df = spark.createDataFrame(rows, "pix long, t long, v double").repartition(3)
    found = T.noise_fft(df)
    got = {r.pix: r.noise for r in found.collect()}
    want = {1: [1.0, 3.0, -2.0, 4.0], None: [7.0, 2.0, 1.0], 3: [1.0, 2.0, 9.0]}
    assert set(got) == {1, 2, 3, 4, None} and got[2] is None and got[4] is None
    assert all(got[k] == noise_fft(np.array(y), method="mean")[0] for k, y in want.items())
    assert T.noise_fft(df.limit(0)).collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan
