"""Correction of camera noise in images of any size: tiles with margins met by their camera's maps, each fitted under a penalty on
what the optics can't pass.

Square tiles of `size` pixels carry a margin of one pixel from their neighbours, repeated at the frame's edge; the parts beyond a
frame that isn't a whole number of tiles are dark and without variance. A tile's own pixels are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import optics
from ..functions.factor import noise_corrected_many
from ..session import dealt, ship
from ..workspace import small_enough
from .pixel import FLOOR


#: Tiles that are fitted side by side.
TOGETHER = 1024


def _tiles(rows: DataFrame, size: int, side_x: int, side_y: int) -> DataFrame:
    """Rows (.., x, y, ..) once for every tile (bx, by) that shows them, with the places (px, py) there; a margin beyond the frame shows
    the edge."""
    def places(c: Column, n: int) -> Column:
        b = F.floor(c / size)
        own = F.struct(b.alias("b"), (c - b * size + 1).alias("p"))
        before = F.when(c % size == 0, F.when(c == 0, F.struct(b.alias("b"), F.lit(0).cast("long").alias("p"))).otherwise(F.struct((b - 1).alias("b"), F.lit(size + 1).cast("long").alias("p"))))
        after = F.when(c % size == size - 1, F.when(c == n - 1, F.struct(b.alias("b"), F.lit(size + 1).cast("long").alias("p"))).otherwise(F.struct((b + 1).alias("b"), F.lit(0).cast("long").alias("p"))))
        return F.filter(F.array(own, before, after), lambda s: s.isNotNull())

    spread = rows.withColumn("_i", F.explode(places(F.col("x"), side_x))).withColumn("_j", F.explode(places(F.col("y"), side_y)))
    return spread.select(*[c for c in rows.columns if c not in ("x", "y")], F.col("_i.b").alias("bx"), F.col("_j.b").alias("by"), F.col("_i.p").alias("px"), F.col("_j.p").alias("py"))


def corrected(movie: DataFrame, camera: DataFrame, nx: int, ny: int, size: int, pixel: float, aperture: float, wavelength: float, alpha: float, rounds: int = 200, kind: str = "weighted", width: float = 1.0, height: float = 0.7) -> DataFrame:
    """Frames (t, x, y, v) in photons, given the camera's (x, y, gain, var): every tile's image of least Poisson-Gaussian cost plus alpha
    times its energy beyond the optics (pixel size, aperture and wavelength in one unit). Values that aren't positive count as FLOOR,
    as do results; tiles without variance stay. Tiles are dealt to tasks by count and fitted side by side; their maps meet them by the
    tile, not the frame."""
    ship(movie.sparkSession)
    high = optics.high_pass(size + 2, pixel, aperture, wavelength, kind, width, height)
    side_x, side_y = -(-nx // size) * size, -(-ny // size) * size
    images = _tiles(movie.select("t", "x", "y", "v"), size, side_x, side_y)
    maps = _tiles(camera.select("x", "y", "gain", "var"), size, side_x, side_y)
    block = ["bx", "by"]
    maps = maps.groupBy(*block).agg(F.collect_list(F.struct("px", "py", "gain", "var")).alias("maps"))
    tasks = dealt(movie.sparkSession)
    frames = images.repartition(tasks, "t", *block).groupBy("t", *block).agg(F.collect_list(F.struct("px", "py", "v")).alias("image"))

    def placed(lists: pa.Array, *fill: float) -> list[np.ndarray]:
        """(tiles, side, side) of each value of lists of (px, py, *values)."""
        row = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
        px, py, *values = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        out = [np.full((len(lists), size + 2, size + 2), f) for f in fill]
        for o, v in zip(out, values):
            o[row, px, py] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                (u,), (gain, var) = placed(some.column("image"), FLOOR), placed(some.column("maps"), 0.0, 0.0)
                u = np.where(u > 0, u, FLOOR)
                out = np.maximum(noise_corrected_many(u, var, gain, high, alpha, rounds), FLOOR)[:, 1:-1, 1:-1]
                t, bx, by = (some.column(c).to_numpy()[:, None, None] for c in ("t", "bx", "by"))
                i, j = np.indices(out.shape[1:])
                x, y = bx * size + i, by * size + j
                keep = (x < nx) & (y < ny)
                yield pa.RecordBatch.from_pydict({"t": np.broadcast_to(t, keep.shape)[keep], "x": x[keep], "y": y[keep], "v": out[keep]})

    if small_enough(maps):
        met = frames.join(F.broadcast(maps), block, "left")
    else:
        met = frames.join(maps, block, "left").repartition(tasks, "t", *block)
    return met.select("t", *block, "image", "maps").mapInArrow(run, "t long, x long, y long, v double")
