"""Queries over block tables and whole workflows. What SQL can state has its SQL; tests hold the rest against planted truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import cellblocks as C
from ..operators import demixing as D
from ..operators import motion as M
from ..operators import noisecorrection as N
from ..operators import spikenet as S
from ..operators import tilefactors as U
from ..operators import traces as T
from ..operators import trends as R
from ..pipelines import SinglePlane, WholeBrain
from ..sources.archive import Archive
from ..streaming import live as L
from ..workspace import Workspace
from .registry import query

#: 13 of the 26 directions to a voxel's neighbours; the others are their opposites.
HALF26 = tuple((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0))
_Z3 = "z AS (SELECT t, x, y, z, coalesce((v - avg(v) OVER q) / nullif(stddev_pop(v) OVER q, 0), 0) AS v FROM volume WINDOW q AS (PARTITION BY x, y, z)), st AS (SELECT * FROM (VALUES " + ", ".join(map(str, HALF26)) + ") s(dx, dy, dz))"


@query("volume", "SELECT a.x, a.y, a.z, b.x AS x2, b.y AS y2, b.z AS z2, avg(a.v * b.v) AS r FROM z a, st, z b WHERE b.t = a.t AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL", "r", "x y z x2 y2 z2", ctes=_Z3)
def neighbours26(v):
    """Correlations of a volume's voxels with all their neighbours, by tiles with margins."""
    return B.neighbour_correlation(v.volume, 4, 64, HALF26, ("x", "y", "z"))


@query("movie", "SELECT x // 3 AS block_x, y // 3 AS block_y, count(*) AS n, sum(v) AS v FROM movie GROUP BY ALL", "v", "block_x block_y n")
def stored_tiles(v):
    """Sums over blocks, by tiles in a bucketed store."""
    import pandas as pd

    store = B.Store.of(v.movie, 3, 128)
    each = store.with_rows(store.keys(), "bx long, by long, n long, v double", lambda tile, rows: pd.DataFrame({"bx": [tile.key[0]], "by": [tile.key[1]], "n": [tile.v.size], "v": [tile.v.sum()]}))
    return each.groupBy(F.col("bx").alias("block_x"), F.col("by").alias("block_y")).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


@query("movie", "SELECT t, x, y, v FROM movie", "v", "t x y")
def archived(v):
    """The movie after it came in three ranges, the middle one late, and was joined."""
    spark = v.movie.sparkSession
    low, high = v.movie.agg(F.min("t"), F.max("t")).first()
    a, b = low + (high - low) // 3, low + 2 * (high - low) // 3
    kept = Archive(spark, f"{Workspace(spark, 'archive').path}/movie", 4, 100)
    kept.append(v.movie, low, a)
    kept.append(v.movie, b + 1, high)
    kept.append(v.movie, a + 1, b)
    kept.compact()
    return kept.movie()


_LSQ = """g AS (SELECT block_x, block_y, sum(wa * wa) AS aa, sum(wa * wb) AS ab, sum(wb * wb) AS bb FROM w GROUP BY ALL),
    p AS (SELECT block_x, block_y, t, sum(wa * v) AS ya, sum(wb * v) AS yb FROM movie JOIN w USING (x, y) GROUP BY ALL),
    s AS (SELECT block_x, block_y, t, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS ca, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS cb FROM p JOIN g USING (block_x, block_y))"""


@query("movie", "SELECT block_x, block_y, 0 AS cell, t, ca AS c FROM s UNION ALL SELECT block_x, block_y, 1, t, cb FROM s", "c", "block_x block_y cell t", ctes="w AS (SELECT x, y, x // 4 AS block_x, y // 4 AS block_y, 1.0::DOUBLE + x % 4 AS wa, 1.0::DOUBLE + y % 4 AS wb FROM movie WHERE t = 0), " + _LSQ)
def block_traces(v):
    """Least-squares traces of two footprints of every block, ramps along x and y."""
    w = v.pixels.select(F.floor(F.col("x") / 4).alias("bx"), F.floor(F.col("y") / 4).alias("by"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("cell"), (1.0 + F.col("x") % 4).alias("w")), F.struct(F.lit(1).cast("long").alias("cell"), (1.0 + F.col("y") % 4).alias("w")))).alias("c"), "x", "y")
    traces = C.cell_traces(B.Store.of(v.movie, 4, 128), w.select("bx", "by", "c.*", "x", "y"), least=0)
    return traces.where("part = 'whole'").select("bx", "by", "cell", F.explode(F.arrays_zip("t", "c")).alias("z")).select(F.col("bx").alias("block_x"), F.col("by").alias("block_y"), "cell", F.col("z.t").alias("t"), F.col("z.c").alias("c"))


@query()
def block_cells(v):
    """Footprints of the cells of each block, seeded by the largest values inside the mask."""
    image = v.wide.groupBy("x", "y").agg(F.max("v").alias("v"))
    return C.demix_blocks(B.Store.of(v.wide, 16, 256), image, every=2, scale=0.5, segment=8, blob=3)


@query()
def masked_pca(v):
    """Low rank of the pixels that the mask keeps."""
    return C.pca_on_mask(B.Store.of(v.movie, 8, 256), v.mask)


@query()
def joint_demixing(v):
    """Weights of cells that blocks of a movie hold together, found in superpixels of correlated neighbours."""
    s = D.Settings(size=8, frames=256, last_rounds=2, every=2, cut=0.05, most=64, merge_cut=0.3, patch=8)
    return D.demix(v.wide, (0.08,), (2,), (1,), (0.5,), s)[0]


@query()
def tile_factors(v):
    """The movie from low-rank factors of overlapping tiles."""
    found = U.factor_tiles(v.movie, 8, 8, 2, 256)
    return U.voxels(found, v.movie.select("t").distinct(), 256)


@query()
def tile_ranks(v):
    return U.factor_tiles(v.wide, 16, 16, 2, 128).ranks()


@query()
def greedy_ranks(v):
    """Ranks of tiles whose components are smoothed one by one."""
    planes = v.volume.groupBy("t", "x", "y").agg(F.avg("v").alias("v"))
    return U.greedy_tiles(planes, 8, 8, 2, 256, factor=0.0).ranks()


@query("affine", "SELECT f.t, a.dy, a.dx FROM (SELECT DISTINCT t FROM movie) f JOIN affine a ON a.t = f.t - f.t % 4", "dy dx", "t")
def held_transforms(v):
    """The last transform at or before each frame."""
    rows = v.affine.select("t", F.array("dy", "dx").alias("m"))
    return M.held(rows, v.movie.select("t").distinct(), 64).select("t", F.col("m")[0].alias("dy"), F.col("m")[1].alias("dx"))


@query()
def region_trends(v):
    """Trends that follow each trace's spikes, region by region."""
    found = R.regions(v.trace, 0.1, 3, 1, 3.0, 10, 3)
    return R.region_trends(v.trace, found, 10)


def _stimulated(v):
    """Traces of every customer as recordings of one pixel, and their events: errors are a stimulus, the middle is a jump."""
    rows = v.trace.select(F.col("pix").alias("rec"), F.lit(0).cast("long").alias("pix"), "t", "v")
    half = F.floor(F.count("*").over(Window.partitionBy("pix")) / 2)
    events = v.prob.select(F.col("pix").alias("rec"), "t", F.col("truth").cast("double").alias("stim"), (F.col("t") == half).alias("jump"))
    return rows, events.where("stim > 0 OR jump")


@query()
def stimulus_splines(v):
    """Traces without splines that follow their stimuli and a jump."""
    return R.stimulus_detrended(*_stimulated(v), followup=5, spacing=40)


@query()
def stimulus_responses(v):
    return R.stimulus_response(R.stimulus_detrended(*_stimulated(v), followup=5, spacing=40))


@query()
def camera_noise(v):
    """Frames corrected for the noise of a camera whose maps differ by pixel, in tiles of five."""
    camera = v.camera.select("x", "y", "gain", (F.col("gain") * 0.5).alias("var"))
    movie = v.movie.select("t", "x", "y", (5 * (F.col("v") + 1)).alias("v"))
    return N.corrected(movie, camera, 8, 8, 5, 0.1, 1.0, 0.6, 0.2, 15)


def _counts(rows, *keys):
    """Vectors as counts of a camera."""
    return rows.select(*keys, (20 * (F.col("v") + 2)).alias("v"))


def _even(v):
    return v.pixels.select("x", "y", F.lit(0.0).alias("off"), F.lit(1.0).alias("gain"))


@query()
def whole_brain(v):
    """(pix, t, v): changes of the fluorescence of the cells of four planes, from raw counts on."""
    return WholeBrain(_counts(v.volume, "t", "z", "x", "y"), _even(v), size=8, frames=256, every=4, window=80, low=0.1, scale=0.5, segment=6, blob=3, least_f=1.0, cell_window=80, downsample=4, top=1000.0).change()


@query()
def single_plane(v):
    """Traces of the cells of one plane, from raw counts on."""
    s = D.Settings(size=8, frames=512, last_rounds=1, every=0, patch=8)
    return SinglePlane(_counts(v.movie, "t", "x", "y"), _even(v), parts=2, frames=512, noise=0.1, settings=s).demix((0.3,), (1,), (1,), (0.5,))[1]


@query("movie", "SELECT x // 4 AS block_x, y // 4 AS block_y, t // 100 AS chunk, count(*) AS voxels, 8 * count(*) AS bytes, 8 * count(*) > 12000 AS large FROM movie GROUP BY ALL", "", "block_x block_y chunk voxels bytes", "large")
def tile_sizes(v):
    """Bytes of each tile that a grid would have, and whether they exceed a bound."""
    return B.tile_sizes(v.movie, 4, 100, 12_000).withColumnsRenamed({"bx": "block_x", "by": "block_y"})


@query("components mask", "SELECT cell, count(*) AS pixels, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS inside, max(w) AS top, count(*) > 10 AS large FROM components JOIN mask USING (x, y) GROUP BY cell", "top", "cell pixels inside", "large")
def cell_report(v):
    """What a look at the cells tells: their pixels, those inside the mask, the largest weight."""
    return C.report(v.components, v.mask)


@query("", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL", "mean", "n", "event_type start")
def streamed_means(v):
    """Hourly means of each kind of event, from a stream over the table's files, after all of them."""
    table = v.read("events")
    work = Workspace(table.sparkSession, "stream")
    rows = L.watch(table.sparkSession, v.path("events*"), table.schema).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zone
    L.latest(L.window_means(rows, "1 hour", ("event_type",)), f"{work.path}/means", f"{work.path}/checkpoint")
    return table.sparkSession.read.parquet(f"{work.path}/means").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g", "total", "n user_id", "first last")
def event_bursts(v):
    """Runs of a customer's events without a pause of six hours."""
    return L.bursts(v.read("events"), "6 hours", ("user_id",))


@query()
def spike_network(v):
    """(pix, t, p) of every window, by a network that two workers trained on all of them."""
    windows = Workspace(v.prob.sparkSession, "windows").write(T.sliding_windows(v.prob, 9, 2), "windows")
    return S.score(windows, S.train(windows, 2, 4, 3, 8192, 0.03))


@query()
def relative_movie(v):
    """Detrended voxels over their baselines."""
    rows = v.movie.select((F.col("x") * 8 + F.col("y")).alias("pix"), "t", (F.col("v") + 2).alias("v"))
    out = T.detrend(rows, 80, 20)
    place = [F.floor(F.col("pix") / 8).alias("x"), (F.col("pix") % 8).alias("y")]
    return T.relative_change(out.select("t", *place, "v"), rows.select("t", *place, "v"))
