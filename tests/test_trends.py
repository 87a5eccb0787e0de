"""Trends by regions and around stimuli, and camera noise in tiles, through Spark, against planted truth and whole-array kernels."""

import numpy as np
import pandas as pd

from voxelane.functions import optics
from voxelane.functions import signal as G
from voxelane.operators import noisecorrection, trends


def traces(spark, ys):
    return spark.createDataFrame([(int(k), t, float(v)) for k, y in ys.items() for t, v in enumerate(y)], "pix long, t long, v double")


def test_trends_by_regions(spark):
    rng = np.random.default_rng(0)
    n, ys, clean = 700, {}, {}
    for k in range(2):
        c = np.interp(np.arange(n), [0, 200, 400, n], [0, 3, 1, 2.0])
        for s in (220, 232, 241):
            c[s : s + 6] += 8
        clean[k], ys[k] = c, c + rng.normal(0, 0.3, n)
    ys[5] = np.zeros(60)
    frame = traces(spark, ys)
    where = dict(gap=60, buffer=15)
    found = trends.regions(frame, **where)
    cuts = sorted(map(tuple, found.select("pix", "region", "first", "last").collect()))
    for k in (0, 1):
        own = [c for c in cuts if c[0] == k]
        assert own[0][2] == 0 and own[-1][3] == n - 1 and all(a[3] + 1 == b[2] for a, b in zip(own, own[1:])) and len(own) >= 3
        assert any(a <= 220 and b >= 246 for _, _, a, b in own)
    out = trends.region_trends(frame, found, 12)
    got = {k: np.zeros(len(y)) for k, y in ys.items()}
    for r in out.collect():
        got[r.pix][r.t] = r.v
    for k in (0, 1):
        assert np.allclose(got[k], G.constrained_trend_in_regions(ys[k], rounds=12, **where))
        assert np.sqrt(((got[k] - clean[k]) ** 2).mean()) < 0.3
        sigma = G.noise_welch(ys[k])[0]
        for _, _, a, b in (c for c in cuts if c[0] == k):  # each region's residual stays within the noise
            assert np.sqrt(((ys[k][a : b + 1] - got[k][a : b + 1]) ** 2).mean()) <= sigma * (1 + 1e-9)
    assert not got[5].any()


def test_splines_around_stimuli_and_jumps(spark):
    rng = np.random.default_rng(1)
    n = 600
    stim = np.zeros(n)
    stim[200:300] = 1
    slow = 5 - 2 * np.linspace(0, 1, n) + np.r_[np.zeros(400), np.full(n - 400, 3.0)]
    signal = rng.normal(0, 0.1, (5, n))
    rows = [(r, p, t, float(slow[t] + 2 * stim[t] * (r == 1) + signal[p, t])) for r in (1, 2) for p in range(5) for t in range(n)]
    events = [(1, t, float(stim[t]), t == 400) for t in range(n) if stim[t] or t == 400] + [(2, 400, None, True)]
    frame = spark.createDataFrame(rows, "rec long, pix long, t long, v double")
    marks = spark.createDataFrame(events, "rec long, t long, stim double, jump boolean")
    out = trends.stimulus_detrended(frame, marks, together=2, spacing=200)
    pdf = out.toPandas()
    assert len(pdf) == 2 * 5 * (n - 3) and not pdf["t"].isin([399, 400, 401]).any()
    one = pdf[(pdf["rec"] == 1) & (pdf["pix"] == 3)].sort_values("i")
    assert one["i"].tolist() == list(range(n - 3)) and one["v"].abs().max() < 1.6 and one["v"].std() < 0.25  # a spline bends at once, but does not jump, where the stimulus does
    kept = one["t"].to_numpy()
    assert np.abs(one["trend"].to_numpy() - slow[kept] - 2 * stim[kept]).mean() < 0.1
    added = trends.stimulus_response(out, together=3).toPandas()
    own = added[(added["rec"] == 1) & (added["pix"] == 2)].sort_values("t")
    during = own["t"].between(215, 285)
    assert abs(own[during]["v"].mean() - 2) < 0.3 and own[own["t"] < 190]["v"].abs().mean() < 0.2
    assert added[added["rec"] == 2]["v"].abs().mean() < 0.2


def test_camera_noise_in_tiles_of_any_frame(spark):
    rng = np.random.default_rng(2)
    nx, ny, size = 13, 9, 5
    xx, yy = np.indices((nx, ny))
    clean = 20 + 15 * np.sin(xx / 3.0) * np.cos(yy / 2.5)
    var, gain = rng.uniform(2, 30, (nx, ny)), rng.uniform(1.5, 2.5, (nx, ny))
    frames = [np.maximum(rng.poisson(clean) + rng.normal(0, np.sqrt(var) / gain), -1) for _ in range(3)]
    movie = spark.createDataFrame(pd.DataFrame([(t, x, y, f[x, y]) for t, f in enumerate(frames) for x in range(nx) for y in range(ny)], columns=["t", "x", "y", "v"]))
    camera = spark.createDataFrame([(x, y, float(gain[x, y]), float(var[x, y])) for x in range(nx) for y in range(ny)], "x long, y long, gain double, var double")
    lens = dict(pixel=0.1, aperture=1.0, wavelength=0.6, alpha=0.5)
    out = noisecorrection.corrected(movie, camera, nx, ny, size, **lens).toPandas()
    got = np.zeros((3, nx, ny))
    got[out["t"], out["x"], out["y"]] = out["v"]
    assert len(out) == 3 * nx * ny
    for t, f in enumerate(frames):
        # the whole-image kernel squares its frame; ours ends at the tiles that the frame needs, so compare tiles inside both
        want = optics.reduce_noise(f, var, gain, size, lens["pixel"], lens["aperture"], lens["wavelength"], lens["alpha"])
        assert np.allclose(got[t][: nx - nx % size - 1, : ny - ny % size - 1], want[: nx - nx % size - 1, : ny - ny % size - 1], atol=1e-4)
        assert ((got[t] - clean) ** 2).mean() < 0.8 * ((np.maximum(f, 1e-6) - clean) ** 2).mean()
    still = noisecorrection.corrected(movie, camera.withColumn("var", camera["var"] * 0), nx, ny, size, **lens).toPandas()
    assert np.allclose(still.sort_values(["t", "x", "y"])["v"], np.maximum(np.stack(frames), 1e-6).ravel())


def test_trends_side_by_side(spark):
    """Traces of any lengths, cut by batches and worked on in stacks, get the trends that each has alone."""
    from voxelane.operators import grouped as D

    rng = np.random.default_rng(7)
    ys = {(p, r): rng.normal(size=int(n)).cumsum() for p in range(20) for r, n in enumerate(rng.integers(1, 60, 4))}
    rows = [(p, r, 5 + t, float(x), 0.2 + p % 3) for (p, r), y in ys.items() for t, x in enumerate(y)]
    frame = spark.createDataFrame(rows, "pix long, region long, t long, v double, sigma double").repartition(3)
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(name, 101)
        got: dict = {}
        for r in D.per_stack(frame, ("pix", "region"), lambda y, n, s: G.constrained_trends(y, n, s, 6), "sigma").collect():
            got.setdefault((r.pix, r.region), {})[r.t - 5] = r.v
    finally:
        spark.conf.set(name, before)
    assert sorted(got) == sorted(ys)
    for (p, r), y in ys.items():
        out = np.array([got[p, r][t] for t in range(len(y))])
        assert len(got[p, r]) == len(y) and np.abs(out - G.constrained_trend(y, 0.2 + p % 3, 6)).max() < 1e-6
    y, n = G.columns(list(ys.values()))
    many = G.trend_filters(y, n, np.full(len(n), 3.0))
    assert all(np.abs(many[: len(x), k] - G.trend_filter(x, 3.0)).max() < 1e-8 for k, x in enumerate(ys.values()))


def test_stimulus_splines_spread_over_tasks(spark):
    from voxelane.session import dealt

    rng = np.random.default_rng(3)
    rows = [(r, 0, t, float(rng.normal())) for r in [*range(20), None] for t in range(40)]
    marks = [(r, t, 1.0, False) for r in range(20) for t in range(10, 20)] + [(3, 30, 0.0, True)]
    frame = spark.createDataFrame(rows, "rec long, pix long, t long, v double")
    out = trends.stimulus_detrended(frame, spark.createDataFrame(marks, "rec long, t long, stim double, jump boolean"), spacing=20)
    added = trends.stimulus_response(out)
    assert out.rdd.getNumPartitions() >= dealt(spark) and added.rdd.getNumPartitions() >= dealt(spark)  # were joined by bytes before
    size = {r.rec: r["count"] for r in out.groupBy("rec").count().collect()}
    assert size == {r: 37 if r == 3 else 40 for r in [*range(20), None]}
    got = np.array([r.trend for r in out.where("rec = 7").orderBy("i").collect()])
    y, stim = np.array([r[3] for r in rows if r[0] == 7]), np.zeros(40)
    stim[10:20] = 1
    assert np.allclose(got, G.stimulus_trend(y, stim, np.zeros(0, int), 100, 20))


def test_camera_tiles_side_by_side(spark):
    from voxelane.functions import factor
    from voxelane.session import dealt

    rng = np.random.default_rng(4)
    u, var, gain = rng.poisson(5, (30, 7, 7)) + 0.5, rng.uniform(0.1, 1, (30, 7, 7)), rng.uniform(0.4, 2, (30, 7, 7))
    var[5], gain[7, 2, 2] = 0, 1e-6
    mask = optics.high_pass(7, 0.1, 1.0, 0.6)
    one = np.stack([factor.noise_corrected(*a, mask, 0.2, 60) for a in zip(u, var, gain)])
    assert np.allclose(factor.noise_corrected_many(u, var, gain, mask, 0.2, 60), one, rtol=0, atol=1e-9)
    movie = spark.createDataFrame([(t, x, y, float(u[t, x, y])) for t in range(30) for x in range(7) for y in range(7)], "t long, x long, y long, v double")
    camera = spark.createDataFrame([(x, y, float(gain[0, x, y]), float(var[0, x, y])) for x in range(7) for y in range(7)], "x long, y long, gain double, var double")
    out = noisecorrection.corrected(movie, camera, 7, 7, 5, 0.1, 1.0, 0.6, 0.2, 15)
    assert out.rdd.getNumPartitions() >= dealt(spark)  # was joined by bytes before
    assert out.count() == 30 * 49
