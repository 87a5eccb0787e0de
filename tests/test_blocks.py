"""Block stores, demixing and tile factors through Spark, against planted truth."""

import re

import numpy as np
import pandas as pd
import pytest

from voxelane.operators import blocks, cellblocks, demixing, tilefactors
from voxelane.operators.space import EIGHT, HALF4, local_correlation, pair_correlation


def frame_of(spark, cube):
    """(t, x, y, v) of a cube (x, y, t)."""
    x, y, t = (k.ravel() for k in np.indices(cube.shape))
    return spark.createDataFrame(pd.DataFrame({"t": t, "x": x, "y": y, "v": cube.ravel().astype(float)}))


def cube_of(frame):
    pdf = frame.toPandas()
    out = np.zeros([int(pdf[c].max()) + 1 for c in ("x", "y", "t")])
    out[pdf["x"].astype(int), pdf["y"].astype(int), pdf["t"].astype(int)] = pdf["v"]
    return out


def bursts(rng, n, count=9):
    c = np.zeros(n)
    for s in rng.choice(n - 20, count, replace=False):
        c[s : s + 20] += rng.uniform(2, 5) * np.exp(-np.arange(20) / 5)
    return c


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(5)
    xx, yy = np.indices((20, 20))
    a = np.stack([np.exp(-((xx - p) ** 2 + (yy - q) ** 2) / 4.5) for p, q in ((7.5, 7.5), (15, 4), (12, 15))], -1)
    a[a < 0.08] = 0
    c = np.stack([bursts(rng, 240) for _ in range(3)])
    return a, c, a.reshape(400, 3) @ c + 2 + rng.normal(0, 0.15, (400, 240))


def test_cells_across_borders_have_one_trace_each(spark, cells):
    a, c, m = cells
    s = demixing.Settings(size=8, frames=100, last_rounds=2, every=2, patch=12, most=120)
    w, t, b = demixing.demix(frame_of(spark, m.reshape(20, 20, 240)), (0.8,), (5,), (2,), (0.5,), s)
    w, t, b = w.toPandas(), t.toPandas(), b.toPandas()
    assert w["cell"].nunique() == t["cell"].nunique() == 3 and len(b) == 400
    assert (w.groupby("cell")["w"].apply(lambda x: (x**2).sum()) - 1).abs().max() < 1e-9 and (w["w"] > 0).all() and (t["c"] >= 0).all()
    for k in range(3):
        trace = {cell: np.corrcoef(g.sort_values("t")["c"], c[k])[0, 1] for cell, g in t.groupby("cell")}
        best = max(trace, key=trace.get)
        assert trace[best] > 0.98
        own = w[w["cell"] == best]
        image = np.zeros((20, 20))
        image[own["x"].astype(int), own["y"].astype(int)] = own["w"]
        assert (image * a[..., k]).sum() / np.linalg.norm(a[..., k]) > 0.98
    assert abs(b["b"].median() - 2) < 0.3


def test_descent_lowers_the_error_and_shares_traces(spark, cells):
    """Footprints and traces near their least squares: what is left is noise; two blocks of a cell hold one trace."""
    _, _, m = cells
    d = demixing.Demixer(frame_of(spark, m.reshape(20, 20, 240)), demixing.Settings(size=8, frames=100, every=0, patch=12))
    d.back = d.pixels.select(*demixing.BLOCK, "b")
    d.foot, d.trace = d.seeds(d.write(demixing._bright(d.movie, 2), "bright"), 0.8, 5, 0.5, 0)
    assert d.foot.groupBy("cell").count().where("count > 1").count() >= 1
    error = []
    for _ in range(3):
        d.refine(1)
        error.append(d.residual().selectExpr("sqrt(avg(v * v))").first()[0])
    assert error == sorted(error, reverse=True) and error[-1] < 0.25
    assert d.trace.groupBy("cell", "chunk").count().where("count > 1").count() == 0


def test_no_cells(spark):
    m = np.random.default_rng(0).normal(size=(6, 6, 40))
    w, t, b = demixing.demix(frame_of(spark, m), (0.9,), (3,), (1,), (0.5,), demixing.Settings(size=4, frames=20))
    assert w.count() == t.count() == 0 and b.count() == 36


def test_store_is_not_shuffled(spark, cells):
    store = blocks.Store(spark, blocks.tiles_of(frame_of(spark, cells[2].reshape(20, 20, 240)), 8, 100))
    out = store.with_rows(store.keys(), "bx long, n long", lambda tile, rows: pd.DataFrame({"bx": [tile.key[0]], "n": [tile.v.size]}))
    assert out.selectExpr("sum(n)").first()[0] == 400 * 240
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bx") == 1, plan  # that of the rows
    store.drop()


@pytest.mark.parametrize("keys", [("x", "y"), ("x", "y", "z")])
def test_neighbours_by_margins_equal_those_by_joins(spark, keys):
    rng = np.random.default_rng(3)
    shape = (7, 9, 4)[: len(keys)]
    cube = rng.normal(5, 1, (*shape, 25)).cumsum(-1)
    cube[(0,) * len(shape)] = 3  # a constant pixel
    index = np.indices(cube.shape)
    frame = spark.createDataFrame(pd.DataFrame({**{k: index[i].ravel() for i, k in enumerate(keys)}, "t": index[-1].ravel(), "v": cube.ravel()}))
    steps = HALF4 if len(keys) == 2 else tuple((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0))
    names = [*keys, *[f"{k}2" for k in keys], "r"]
    got, want = ({tuple(map(int, r[:-1])): r[-1] for r in f.select(*names).collect()} for f in (blocks.neighbour_correlation(frame, 3, 10, steps, keys), pair_correlation(frame, steps, keys)))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    if len(keys) == 2:
        mean = blocks.neighbour_correlation(frame, 4, 25, EIGHT).groupBy("x", "y").avg("r").collect()
        want = {(r.x, r.y): r.v for r in local_correlation(frame).collect()}
        assert max(abs(want[r.x, r.y] - r[2]) for r in mean) < 1e-9


@pytest.fixture(scope="module")
def smooth():
    rng = np.random.default_rng(1)
    xx, yy = np.indices((16, 12))
    u = np.stack([np.exp(-((xx - 5) ** 2 + (yy - 4) ** 2) / 12), np.exp(-((xx - 10) ** 2 + (yy - 8) ** 2) / 12)], -1).reshape(-1, 2)
    v = np.stack([np.sin(np.arange(300) / 9), np.cos(np.arange(300) / 14)]) * 2
    clean = u @ v + 4
    return clean, clean + rng.normal(0, 0.5, clean.shape)


def test_tile_factors_of_low_rank_and_noise(spark, smooth):
    clean, noisy = smooth
    movie = frame_of(spark, noisy.reshape(16, 12, 300))
    found = tilefactors.factor_tiles(movie, 16, 12, 2, frames=100)
    ranks = {(r.grid, r.tile): r["rank"] for r in found.ranks().collect()}
    assert len(ranks) == 4 + 2 + 2 + 1 and max(ranks.values()) <= 3
    out = cube_of(tilefactors.voxels(found, movie.select("t").distinct(), 100)).reshape(clean.shape)
    assert ((out - clean) ** 2).mean() < 0.15 * ((noisy - clean) ** 2).mean()
    # in numpy: each tile's kept components, blended
    grid, total = found.grid, np.repeat(noisy.mean(1, keepdims=True), 300, 1).reshape(16, 12, 300)
    for (g, tile), rank in ranks.items():
        x0, y0, w, h = grid.box(g, tile)
        m = noisy.reshape(16, 12, 300)[x0 : x0 + w, y0 : y0 + h].reshape(w * h, 300)
        u, s, vt = np.linalg.svd(m - m.mean(1, keepdims=True), full_matrices=False)
        acf = np.array([np.mean([(x[k:] * x[: 300 - k]).sum() for k in range(6)]) for x in vt[: min(w * h, 300) // 2]])
        keep = np.flatnonzero(acf >= 1.15 * tilefactors.threshold(300, 5, 3.09))
        keep = keep if len(keep) else np.array([0])
        assert len(keep) == rank
        total[x0 : x0 + w, y0 : y0 + h] += ((u[:, keep] * s[keep]) @ vt[keep]).reshape(w, h, 300) * grid.weight(g, tile)[..., None]
    assert np.abs(total.reshape(out.shape) - out).max() < 1e-6


def test_blending_weights_sum_to_one():
    for nx, ny, parts in ((8, 8, 2), (17, 12, 3), (9, 30, 2), (5, 5, 1)):
        grid, total = tilefactors.Grid(nx, ny, parts), np.zeros((nx, ny))
        for g in tilefactors.GRIDS if parts > 1 else ("base",):
            ex, ey = grid.edges(g)
            for tile in range((len(ex) - 1) * (len(ey) - 1)):
                x0, y0, w, h = grid.box(g, tile)
                total[x0 : x0 + w, y0 : y0 + h] += grid.weight(g, tile)
        assert np.allclose(total, 1) or parts == 1


def test_greedy_tiles(spark, smooth):
    clean, noisy = smooth
    movie = frame_of(spark, noisy.reshape(16, 12, 300)[:, :, :120])
    found = tilefactors.greedy_tiles(movie, 16, 12, 2, frames=50, factor=2.0, most=3)
    out = cube_of(tilefactors.voxels(found, movie.select("t").distinct(), 50)).reshape(192, 120)
    assert ((out - clean[:, :120]) ** 2).mean() < 0.25 * ((noisy - clean)[:, :120] ** 2).mean()


@pytest.fixture(scope="module")
def glowing():
    """Two planes of cells with bursts over a texture, every other frame moved by a pixel."""
    rng = np.random.default_rng(8)
    xx, yy = np.indices((24, 20))
    spots = {0: [(6, 6), (16, 12)], 1: [(12, 9)]}
    n, vols, truth = 120, {}, {}
    base = {z: 20 + 15 * np.cos(xx / 1.9 + z) * np.sin(yy / 2.3 + z) + 20 * sum(np.exp(-((xx - p) ** 2 + (yy - q) ** 2) / 10) for p, q in s) for z, s in spots.items()}
    for z, s in spots.items():
        for p, q in s:
            truth[z, p, q] = bursts(rng, n, 5)
    for t in range(n):
        planes = []
        for z, s in spots.items():
            v = base[z] + sum(6 * truth[z, p, q][t] * np.exp(-((xx - p) ** 2 + (yy - q) ** 2) / 5) for p, q in s)
            planes.append(np.roll(v, t % 2, 0) + rng.normal(0, 0.5, v.shape))
        vols[t] = np.stack(planes)
    parts = []
    for t, v in vols.items():
        z, x, y = (k.ravel() for k in np.indices(v.shape))
        parts.append(pd.DataFrame({"t": t, "z": z, "x": x, "y": y, "v": v.ravel()}))
    return pd.concat(parts), truth


def test_whole_brain_to_changes_of_cells(spark, glowing, tmp_path):
    from voxelane.pipelines import WholeBrain

    rows, truth = glowing
    camera = spark.createDataFrame([(x, y, 0.0, 1.0) for x in range(24) for y in range(20)], "x long, y long, off double, gain double")
    make = lambda: WholeBrain(spark.createDataFrame(rows), camera, f"file://{tmp_path}/brain", size=24, frames=50, kind="translation2d", window=80, segment=10, cell_window=80, downsample=4, top=50, low=0.2, scale=1.0, least_f=1.0)
    brain = make()
    change = brain.change().toPandas()
    light = cellblocks.trace_rows(brain.traces(), "masked").toPandas()
    place = {r.pix: (r.z, r.x0 + r.nx / 2, r.y0 + r.ny / 2) for r in brain.layout().collect()}
    assert len(place) >= 3
    for (z, p, q), c in truth.items():
        near = [k for k, (zz, x, y) in place.items() if zz == z and abs(x - p) < 5 and abs(y - q) < 5]
        like = lambda rows: max(np.corrcoef(rows[rows["pix"] == k].sort_values("t")["v"], c)[0, 1] for k in near)  # noqa: B023, E731
        assert like(light) > 0.9 and like(change) > 0.6, (z, p, q, like(light), like(change))  # a baseline follows long bursts
    shift = {r.t: r.m[7] for r in brain.stages.table("transforms", None).collect()}
    assert abs(np.mean([shift[t] for t in range(1, 120, 2)]) - np.mean([shift[t] for t in range(0, 120, 2)]) - 1) < 0.3
    again = make()  # stages of a former run are read
    again.stages.table("cells", lambda: 1 / 0)
    assert again.change().count() == len(change)
    pca = brain.local_pca().toPandas()
    outside = brain.mask().where("NOT keep").toPandas()
    assert len(pca) == 2 * 24 * 20 * 120 and (pca.merge(outside, on=["x", "y"])["v"] == 0).all()


def test_traces_of_stored_cells(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(3, 1, (12, 10, 70))
    store = blocks.Store.of(frame_of(spark, m), 6, 30)
    foot = [(x // 6, y // 6, k, x, y, float(rng.uniform(0.2, 1))) for x in range(12) for y in range(10) for k in range(2) if (x + y + k) % 3]
    frame = spark.createDataFrame(foot, cellblocks.FOOT)
    mask = spark.createDataFrame([(x, y, x > 2) for x in range(12) for y in range(10)], "x long, y long, keep boolean")
    traces = cellblocks.cell_traces(store, frame, mask, cut=0.5, least=4)
    plan = traces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bx") - plan.count("Exchange hashpartitioning(bx#", plan.rindex("FileScan")) <= 4 and "v#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    got = {}
    for r in traces.collect():
        got.setdefault((r.bx, r.by, r.cell, r.part), {}).update(zip(r.t, r.c))
    for bx in range(2):
        for by in range(2):
            y0, y1 = by * 6, min(10, by * 6 + 6)
            block = m[bx * 6 : bx * 6 + 6, y0:y1]
            a = np.zeros((*block.shape[:2], 2))
            for p, q, k, x, y, w in foot:
                if (p, q) == (bx, by):
                    a[x - bx * 6, y - y0, k] = w
            a = a.reshape(-1, 2)
            want = np.linalg.lstsq(a, block.reshape(len(a), -1), rcond=None)[0]
            for k in range(2):
                assert np.allclose([got[bx, by, k, "whole"][t] for t in range(70)], want[k])
            keep = np.repeat(np.arange(bx * 6, bx * 6 + 6) > 2, y1 - y0)
            high = np.where(a < 0.5 * a.max(0), 0, a) * keep[:, None]
            some = np.flatnonzero((high > 0).sum(0) > 4)
            assert {k for p, q, k, part in got if (p, q, part) == (bx, by, "masked")} == set(some)
            want = np.linalg.lstsq(high[:, some], block.reshape(len(a), -1) * keep[:, None], rcond=None)[0]
            for i, k in enumerate(some):
                assert np.allclose([got[bx, by, k, "masked"][t] for t in range(70)], want[i])


def test_single_plane_end_to_end(spark):
    from voxelane.pipelines import SinglePlane

    rng = np.random.default_rng(4)
    xx, yy = np.indices((16, 16))
    c = bursts(rng, 120, 4)
    still = 50 + 10 * np.cos(xx / 2.5) * np.sin(yy / 3.1) + 6 * np.sin(xx * yy / 40)
    m = still[..., None] + 2 * np.exp(-((xx - 7) ** 2 + (yy - 9) ** 2) / 6)[..., None] * c + rng.normal(0, 0.3, (16, 16, 120))
    camera = spark.createDataFrame([(x, y, 0.0, 1.0) for x in range(16) for y in range(16)], "x long, y long, off double, gain double")
    settings = demixing.Settings(size=16, frames=120, last_rounds=1, every=0, patch=16)
    plane = SinglePlane(frame_of(spark, m), camera, parts=2, frames=120, noise=0.2, knot=400, settings=settings)
    w, t, b = plane.demix((0.7,), (8,), (2,), (0.5,))
    best = max(np.corrcoef(g.sort_values("t")["c"], c)[0, 1] for _, g in t.toPandas().groupby("cell"))
    assert best > 0.9 and b.count() == 256 and plane.change().count() == 16 * 120


def test_pairs_of_odd_pixels_take_one_shuffle(spark):
    """Repeated pixels meet all repeats of their neighbours, null values count as their pixel's mean, null keys meet nothing; only the
    frames are dealt, once, and what is joined is the pixels' statistics."""
    rng = np.random.default_rng(3)
    rows = [(t, x, y, None if rng.random() < 0.1 else float(rng.normal() + x)) for t in range(12) for x in range(3) for y in range(3) if rng.random() < 0.9 for _ in range(rng.integers(1, 4))]
    rows = [(t, x, y, 2.5 if (x, y) == (2, 2) else v) for t, x, y, v in rows] + [(0, 5, 5, float("nan")), (0, 5, 6, 1.0), (1, 5, 6, 2.0)]
    odd = [(None, 0, 0, 1.0), (3, None, 1, 1.0), (3, 1, None, 1.0)]
    movie = spark.createDataFrame(rows + odd, "t long, x long, y long, v double").repartition(3)
    of = {}
    for _, x, y, v in rows + odd:
        of.setdefault((x, y), []).append(v)
    stats = {k: (np.mean(u), np.std(u)) for k, vs in of.items() if (u := [v for v in vs if v is not None])}
    z = lambda x, y, v: 0.0 if v is None or stats[x, y][1] < 1e-12 else (v - stats[x, y][0]) / stats[x, y][1]
    for steps in (HALF4, EIGHT):
        want = {}
        for t, x, y, v in rows:
            for s, a, b, w in rows:
                if s == t and (a - x, b - y) in steps:
                    want.setdefault((x, y, a, b), []).append(z(x, y, v) * z(a, b, w))
        found = pair_correlation(movie, steps)
        got = {(r.x, r.y, r.x2, r.y2): r.r for r in found.collect()}
        assert got.keys() == want.keys() and any(np.isnan(r) for r in got.values())
        assert all(np.isclose(got[k], np.mean(v), atol=1e-12, equal_nan=True) for k, v in want.items())
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert [len(by.split(", ")) for by in re.findall(r"Exchange hashpartitioning\((t#[^)]*)\)", plan)] == [2]  # t, and how many parts
    assert pair_correlation(movie.limit(0), HALF4).collect() == []
