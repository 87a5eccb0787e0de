"""Archives that grow by ranges of time, and recordings as a data source."""

import numpy as np
import pandas as pd
import pytest

from voxelane.sources import archive, ranged


def frame_of(spark, cube, times):
    x, y, t = (k.ravel() for k in np.indices(cube.shape))
    return spark.createDataFrame(pd.DataFrame({"t": np.asarray(times)[t], "x": x, "y": y, "v": cube.ravel()}))


def test_ranges_come_late_and_are_joined(spark, tmp_path):
    rng = np.random.default_rng(0)
    cube = rng.normal(size=(5, 7, 60))
    kept = archive.Archive(spark, f"file://{tmp_path}/a", size=4, frames=16)
    put = lambda a, b: kept.append(frame_of(spark, cube[..., a : b + 1], range(a, b + 1)), a, b)
    put(0, 19)
    put(40, 59)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    put(20, 39)  # late
    assert all(f.stat().st_mtime_ns == m for f, m in before.items())  # nothing that was there is written again
    with pytest.raises(archive.Conflict):
        put(10, 12)

    def whole(movie, a=0, b=59):
        out = np.full(cube.shape, np.nan)
        pdf = movie.toPandas()
        out[pdf["x"].astype(int), pdf["y"].astype(int), pdf["t"].astype(int)] = pdf["v"]
        assert len(pdf) == 35 * (b - a + 1)
        return out[..., a : b + 1]

    assert np.allclose(whole(kept.movie()), cube)
    assert np.allclose(whole(kept.movie(18, 41), 18, 41), cube[..., 18:42])
    assert kept.tiles(0, 15, bx=1, by=1).count() == 1
    number = kept._numbers()[-1]
    assert kept.compact() == 1 and len(kept.state(number)["segments"]) == 3
    again = archive.Archive(spark, f"file://{tmp_path}/a")
    assert (again.size, again.frames) == (4, 16) and np.allclose(whole(again.movie()), cube)
    one = again.tiles(16, 31, 0, 0).where("chunk = 1").collect()
    assert len(one) == 1 and list(one[0].t) == list(range(16, 32))
    again.vacuum()
    assert np.allclose(whole(again.movie()), cube) and len([d for d in (tmp_path / "a").iterdir() if d.is_dir()]) == 2


def test_a_broken_append_leaves_nothing(spark, tmp_path):
    kept = archive.Archive(spark, f"file://{tmp_path}/b", 4, 8)
    bad = spark.range(8).selectExpr("id AS t", "0L AS x", "0L AS y", "IF(id > 5, CAST(raise_error('broken') AS DOUBLE), 1.0D) AS v")
    with pytest.raises(Exception):  # noqa: B017
        kept.append(bad, 0, 7)
    assert kept.movie().count() == 0
    kept.append(bad.where("t < 4"), 0, 7)
    assert kept.movie().count() == 4


def test_two_writers(spark, tmp_path):
    one = archive.Archive(spark, f"file://{tmp_path}/c", 4, 8)
    two = archive.Archive(spark, f"file://{tmp_path}/c")
    row = lambda t: spark.createDataFrame([(t, 0, 0, float(t))], "t long, x long, y long, v double")
    one.append(row(1), 0, 3)
    two.append(row(5), 4, 7)
    assert sorted(r.t for r in one.movie().collect()) == [1, 5]
    with pytest.raises(archive.Conflict):
        one.append(row(6), 6, 6)


def test_recordings_are_read_by_ranges(spark, tmp_path):
    data = np.arange(3 * 1000, dtype="<f4").reshape(1000, 3)
    (tmp_path / "one.bin").write_bytes(data.tobytes() + b"xx")
    (tmp_path / "two.bin").write_bytes(data[:10].tobytes())
    ranged.register(spark)
    load = lambda: spark.read.format("recording").option("path", str(tmp_path)).option("channels", "a, b,c").option("records", 128).load()
    assert load().count() == 1010 and load().rdd.getNumPartitions() == 9
    rows = {(r.path.rsplit("/", 1)[1], r.i): (r.a, r.b, r.c) for r in load().collect()}
    assert all(rows["one.bin", i] == tuple(data[i]) for i in range(1000)) and rows["two.bin", 9] == tuple(data[9])
    some = load().where("i >= 300 AND i < 310 AND a > 903")
    assert some.count() == 8 and some.rdd.getNumPartitions() == 1  # one range of one file is read
    assert load().where("i = 5").count() == 2 and load().where("i > 5000").count() == 0
