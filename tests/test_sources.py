import bz2
import struct

import numpy as np
import pytest

from voxelane.sources import recordings as R


def stack_of(df):
    rows = df.collect()
    shape = [max(r[c] for r in rows) + 1 for c in ("t", "z", "y", "x")]
    out = np.zeros(shape)
    for r in rows:
        out[r.t, r.z, r.y, r.x] = r.v
    return out


def tiff(pages: np.ndarray, order: str = "<") -> bytes:
    """An uncompressed TIFF of (page, y, x) unsigned 16-bit values, one strip a page."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    ny, nx = pages.shape[1:]
    for k, page in enumerate(pages):
        data = page.astype(order + "u2").tobytes()
        tags = [(256, nx), (257, ny), (258, 16), (259, 1), (273, 0), (277, 1), (279, len(data))]
        start = len(out) + 2 + 12 * len(tags) + 4
        out += struct.pack(order + "H", len(tags))
        for tag, value in tags:
            out += struct.pack(order + "HHII", tag, 4, 1, start if tag == 273 else value)
        out += struct.pack(order + "I", 0 if k == len(pages) - 1 else start + len(data)) + data
    return bytes(out)


def test_raw_samples_are_read_in_ranges(spark, tmp_path):
    data = np.arange(70, dtype="<f4").reshape(-1, 7)
    (tmp_path / "a.10ch").write_bytes(data.tobytes() + b"\0\0")  # an incomplete record follows
    (tmp_path / "empty.10ch").write_bytes(b"")
    names = [f"c{k}" for k in range(7)]
    rows = R.raw_samples(spark, str(tmp_path), names, records=3).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(10))
    assert [[r[n] for n in names] for r in rows] == data.tolist()


def test_packed_stacks(spark, tmp_path):
    movie = np.random.default_rng(0).integers(-99, 99, (2, 3, 4, 5)).astype("<i2")
    for t, stack in enumerate(movie):
        (tmp_path / f"TM{t:05d}_CM0.stack.bz2").write_bytes(bz2.compress(stack.tobytes()))
    got = R.packed_stacks(spark, str(tmp_path), (5, 4, 3), time=r"TM(\d+)")  # the last number of these names is the camera's
    assert np.array_equal(stack_of(got), movie)
    for t in range(2):
        (tmp_path / f"TM{t:05d}_CM0.stack.bz2").rename(tmp_path / f"TM{t:05d}.bz2")
    assert np.array_equal(stack_of(R.packed_stacks(spark, str(tmp_path), (5, 4, 3))), movie)


def test_stacks_of_a_wrong_size_are_named(spark, tmp_path):
    (tmp_path / "7.bz2").write_bytes(bz2.compress(b"\0" * 10))
    with pytest.raises(Exception, match="7.bz2"):
        R.packed_stacks(spark, str(tmp_path), (5, 4, 3)).collect()


def test_array_and_tiff_stacks(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 999, (3, 4, 5))
    np.save(tmp_path / "0.npy", a)
    assert np.array_equal(stack_of(R.array_stacks(spark, str(tmp_path)))[0], a)
    for k, order in enumerate("<>"):
        folder = tmp_path / f"tiff-{'le' if k == 0 else 'be'}"
        folder.mkdir()
        (folder / "movie.tif").write_bytes(tiff(a, order))
        assert np.array_equal(stack_of(R.tiff_stacks(spark, str(folder)))[0], a)
    with pytest.raises(ValueError):
        R.tiff_pages(b"II\x2b\0abcdefgh")


def test_camera_description(spark, tmp_path):
    (tmp_path / "ch0.xml").write_text('<push><info camera_roi="0_100_20_80" dimensions="5x4x3"/><action dimensions="5x4x9"/></push>')
    (tmp_path / "ch1.xml").write_text("<push><info a='b'/></push>")
    info = R.camera_info(spark, str(tmp_path)).orderBy("path")
    assert [r.info for r in info.collect()] == [{"camera_roi": "0_100_20_80", "dimensions": "5x4x9"}, {"a": "b"}]
    assert [tuple(r)[1:] for r in R.camera_roi(info).orderBy("path").collect()] == [(0, 100, 20, 80), (None,) * 4]


def test_blocks(spark, tmp_path):
    df = spark.range(12).selectExpr("id", "id % 2 AS z", "id % 3 AS bx", "0 AS by")
    R.write_blocks(df, str(tmp_path / "blocks"))
    got = R.read_block(spark, str(tmp_path / "blocks"), z=1, bx=2, by=0)
    assert sorted(r.id for r in got.collect()) == [5, 11]
    assert "PartitionFilters: [isnotnull(z" in got._jdf.queryExecution().toString()
