"""Motion correction through Spark: planted shifts, rotations and shifts across planes come back."""

import numpy as np
import pandas as pd
import pytest

from voxelane.functions import register as R
from voxelane.operators import motion as M


def scene(shape, seed=0):
    rng = np.random.default_rng(seed)
    grid = np.indices(shape)
    out = np.zeros(shape)
    for _ in range(14):
        at = [rng.uniform(0.15, 0.85) * n for n in shape]
        out += rng.uniform(0.5, 1.5) * np.exp(-sum((g - a) ** 2 for g, a in zip(grid, at)) / rng.uniform(6, 16))
    return out


def frame_of(spark, vols):
    """(t, z, x, y, v) of {t: (z, x, y)}."""
    parts = []
    for t, v in vols.items():
        z, x, y = (k.ravel() for k in np.indices(v.shape))
        parts.append(pd.DataFrame({"t": t, "z": z, "x": x, "y": y, "v": v.ravel()}))
    return spark.createDataFrame(pd.concat(parts))


def about_middle(shape, turn=0.0, shift=(0, 0)):
    return R.matrix_of("rigid", np.r_[shift, turn], shape)


def test_volumes_and_reference(spark):
    rng = np.random.default_rng(1)
    vols = {t: rng.normal(size=(2, 3, 4)) for t in range(5, 25)}
    stored = M.volumes(frame_of(spark, vols))
    back = {(r.t, r.z, r.x, r.y): r.v for r in M.voxels(stored).collect()}
    assert all(back[t, z, x, y] == v for t, a in vols.items() for (z, x, y), v in np.ndenumerate(a))
    assert np.allclose(M.reference(stored, 7, 12), np.mean([vols[t] for t in range(7, 12)], 0))
    assert np.allclose(M.middle_reference(stored), np.mean([vols[t] for t in (13, 14, 15, 16)], 0))
    with pytest.raises(ValueError):
        M.reference(stored, 100, 120)
    assert M.volumes(frame_of(spark, vols).where("t < 0")).count() == 0


def test_rigid_motion_of_planes_is_undone(spark):
    still = scene((40, 36))
    planted = {0: (0.0, (0, 0)), 1: (0.05, (1.5, -2.0)), 2: (-0.04, (-2.0, 1.0)), 3: (0.0, (3.0, 0.5))}
    vols = {t: R.apply(still, np.linalg.inv(about_middle(still.shape, a, s)))[None] for t, (a, s) in planted.items()}
    stored = M.volumes(frame_of(spark, vols))
    out, found = M.corrected(stored, still[None])
    for r in M.offsets(found).collect():
        m = about_middle(still.shape, *planted[r.t])
        assert abs(r.turn - m[0, 1] / m[0, 0]) < 0.02 and abs(r.dx - m[0, 2]) < 0.6 and abs(r.dy - m[1, 2]) < 0.6
    inner = slice(8, -8)
    for r in out.collect():
        a = np.array(r.v).reshape(40, 36)[inner, inner]
        assert np.corrcoef(a.ravel(), still[inner, inner].ravel())[0, 1] > 0.98


def test_shifts_across_planes(spark):
    still = scene((12, 24, 22), 3)
    vols = {t: R.apply(still, np.linalg.inv(np.array([[1, 0, 0, z], [0, 1, 0, x], [0, 0, 1, y], [0, 0, 0, 1.0]]))) for t, (z, x, y) in enumerate([(0, 0, 0), (1.0, 1.5, -1.0), (-1.5, 0.5, 2.0)])}
    stored = M.volumes(frame_of(spark, vols))
    for kind in ("translation3d", "rigid_in_planes"):
        for r in M.transforms(stored, still, kind).collect():
            m = np.array(r.m).reshape(4, 4)
            want = [(0, 0, 0), (1.0, 1.5, -1.0), (-1.5, 0.5, 2.0)][r.t]
            assert np.abs(m[:3, 3] - want).max() < 0.7, (kind, r.t, m)
    with pytest.raises(ValueError):
        M.transforms(stored, still, "elastic")


def test_held_transforms(spark):
    found = spark.createDataFrame([(t, [float(t)] * 16) for t in (3, 4, 10, 33)], M.TRANSFORM)
    times = spark.createDataFrame([(t,) for t in (0, 3, 4, 5, 9, 10, 29, 32, 33, 40, 40)], "t long")
    for chunk in (1, 4, 100):
        got = sorted((r.t, r.m[0]) for r in M.held(found, times, chunk).collect())
        assert got == [(0, 3), (3, 3), (4, 4), (5, 4), (9, 4), (10, 10), (29, 10), (32, 10), (33, 33), (40, 33), (40, 33)]


@pytest.mark.parametrize("name", [*M.PLANAR, *M.SPATIAL])
def test_stacks_give_each_volume_what_it_has_alone(name):
    """Searched side by side, in stacks of any size, and yet each as if alone."""
    rng = np.random.default_rng(2)
    shape = (8, 8) if name in M.PLANAR else (4, 8, 8)
    fixed, moving = rng.normal(size=shape), rng.normal(size=(5, *shape))
    find = (M.PLANAR | M.SPATIAL)[name]
    alone = np.stack([find(fixed, v) for v in moving])
    assert np.array_equal(find(fixed, moving), alone)
    if name in ("rigid2d", "translation3d"):
        R.TOGETHER, kept = 2 * fixed.size, R.TOGETHER
        try:
            assert np.array_equal(find(fixed, moving), alone)
        finally:
            R.TOGETHER = kept


def test_volumes_are_spread_over_tasks(spark):
    """However few bytes frames have, their searches don't gather in one task; frames cut by batches stay whole."""
    rng = np.random.default_rng(3)
    vols = {t: rng.normal(size=(1, 5, 7)) for t in range(90)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        stored = M.volumes(frame_of(spark, vols).where("NOT (t = 4 AND x = 2)"))
        got = {r.t: np.array(r.v).reshape(1, 5, 7) for r in stored.collect()}
        vols[4][0, 2] = 0
        assert sorted(got) == sorted(vols) and all(np.array_equal(got[t], vols[t]) for t in vols)
        assert stored.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 8
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
