"""Recordings end to end: whole-brain volumes, and movies of one plane. Every stage is a Parquet table or a store that is made once.

A stage whose table a former run finished in the same folder is read, not made again, so a broken run goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cellblocks as C
from .operators import demixing as D
from .operators import motion as M
from .operators import pixel as P
from .operators import tilefactors as U
from .operators import traces as T
from .operators.blocks import Store
from .workspace import Workspace


class Stages:
    """Named tables of one folder; without one, of a workspace that goes when the driver ends."""

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None):
        self.spark, self.path = spark, folder.rstrip("/") if folder else Workspace(spark, label).path

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.done(name):
            make().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")


@dataclass
class WholeBrain:
    """Volumes (t, z, x, y, v) to changes of the cells' fluorescence. Planes lie side by side in x from their correction on, each from a
    whole block: x + z * lane.

    size, frames: of the tiles. kind, every: of the transforms, and between the time points that get one of their own. window,
    percentile: of the baseline. low: pixels whose mean lies under this quantile are outside the mask. thin: frames between those
    that cells are told from. segment, blob, weak: of the cells of a block. least_f, top: of cells that count.
    """

    movie: DataFrame
    camera: DataFrame
    folder: str | None = None
    size: int = 64
    frames: int = 512
    kind: str = "rigid2d"
    every: int = 1
    window: int = 100
    percentile: float = 20
    low: float = 0.4
    thin: int = 1
    scale: float = 10.0
    segment: int = 50
    blob: int = 10
    weak: float = 0.3
    least_f: float = 20.0
    cell_window: int = 400
    downsample: int = 10
    top: float = 5.0

    def __post_init__(self):
        self.spark = self.movie.sparkSession
        self.stages = Stages(self.spark, "whole-brain", self.folder)
        box = self.movie.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
        self.nx, self.ny = int(box.x or 0) + 1, int(box.y or 0) + 1
        self.lane = -(-self.nx // self.size) * self.size
        self._stores: dict[str, Store] = {}

    def preprocessed(self) -> DataFrame:
        """(t, x, y, v): calibrated, without dead pixels, moved onto the mean of the middle, planes side by side."""
        def denoised() -> DataFrame:
            # a plane of a time point is a frame of its own
            planes = self.movie.select((F.col("t") * (1 << 20) + F.col("z")).alias("t"), "x", "y", "v")
            clean = P.median3x3(P.calibrate(planes, self.camera), self.nx, self.ny)
            return M.volumes(clean.select(F.shiftright("t", 20).alias("t"), (F.col("t") % (1 << 20)).alias("z"), "x", "y", "v"))

        def moved() -> DataFrame:
            vols = self.stages.table("denoised", denoised)
            fixed = self._reference(vols)
            found = self.stages.table("transforms", lambda: M.transforms(vols, fixed, self.kind, self.every))
            every = found if self.every == 1 else self.stages.table("held", lambda: M.held(found, vols.select("t")))
            return M.voxels(M.moved(vols, every)).select("t", (F.col("x") + F.col("z") * self.lane).alias("x"), "y", "v")

        return self.stages.table("corrected", moved)

    def _reference(self, vols: DataFrame) -> np.ndarray:
        def image() -> DataFrame:
            fixed = M.middle_reference(vols, 50)
            return self.spark.createDataFrame([(0, *fixed.shape, fixed.ravel().tolist())], M.SCHEMA)

        row = self.stages.table("reference", image).first()
        return np.asarray(row.v).reshape(row.nz, row.nx, row.ny)

    def detrended(self) -> DataFrame:
        def trace() -> DataFrame:
            rows = self.preprocessed().select((F.col("x") * D.WIDE + F.col("y")).alias("pix"), "t", "v")
            out = T.detrend(rows, self.window, self.percentile)
            return out.select("t", F.floor(F.col("pix") / D.WIDE).alias("x"), (F.col("pix") % D.WIDE).alias("y"), "v")

        return self.stages.table("detrended", trace)

    def images(self) -> DataFrame:
        """(x, y, top, mean, change): the largest and mean value of each pixel, and the largest detrended one."""
        def make() -> DataFrame:
            a = self.preprocessed().groupBy("x", "y").agg(F.max("v").alias("top"), F.avg("v").alias("mean"))
            return a.join(self.detrended().groupBy("x", "y").agg(F.max("v").alias("change")), ["x", "y"])

        return self.stages.table("images", make)

    def mask(self) -> DataFrame:
        """(x, y, keep): pixels whose mean exceeds the quantile `low` of all means."""
        images = self.images()
        edge = images.agg(F.percentile("mean", self.low).alias("edge"))
        return images.crossJoin(F.broadcast(edge)).select("x", "y", (F.col("mean") > F.col("edge")).alias("keep"))  # one row

    def store(self, name: str) -> Store:
        if name not in self._stores:
            self._stores[name] = Store.of(getattr(self, name)(), self.size, self.frames)
        return self._stores[name]

    def local_pca(self, relative: bool = False) -> DataFrame:
        """Low rank of the detrended movie inside the mask, block by block; relative: of its change over the baseline."""
        store = self.store("detrended")
        if relative:
            change = T.relative_change(self.detrended(), self.preprocessed())
            store = Store.of(change.fillna(0.0, ["v"]), self.size, self.frames)
        return C.pca_on_mask(store, self.mask())

    def cells(self) -> DataFrame:
        """Footprints (bx, by, cell, x, y, w) from every thin-th frame, seeded by the largest change of the pixels inside the mask."""
        seen = self.images().join(self.mask(), ["x", "y"]).select("x", "y", F.when(F.col("keep"), F.col("change")).otherwise(0.0).alias("v"))
        return self.stages.table("cells", lambda: C.demix_blocks(self.store("detrended"), seen, self.thin, self.scale, self.segment, self.blob, self.weak, True))

    def traces(self) -> DataFrame:
        """Traces of the cells in the corrected movie, whole and inside the mask."""
        return self.stages.table("traces", lambda: C.cell_traces(self.store("preprocessed"), self.cells(), self.mask(), self.weak, self.blob))

    def change(self) -> DataFrame:
        """(pix, t, v): fluorescence over its baseline less 1 of the cells inside the mask that are bright and stay in bounds."""
        rows = C.trace_rows(self.traces(), "masked")
        return self.stages.table("change", lambda: T.cell_dff_qc(rows, self.least_f, self.cell_window, self.percentile, self.downsample, self.top))

    def layout(self) -> DataFrame:
        """(pix, z, x0, y0, nx, ny, pixels): where each cell with a result lies."""
        rows = self.cells().select(C.name_of(F.col("bx"), F.col("by"), F.col("cell")).alias("pix"), F.floor(F.col("x") / self.lane).alias("z"), (F.col("x") % self.lane).alias("x"), "y")
        box = rows.groupBy("pix", "z").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("nx"), (F.max("y") - F.min("y") + 1).alias("ny"), F.count("*").alias("pixels"))
        return box.join(self.change().select("pix").distinct(), "pix", "left_semi")


@dataclass
class SinglePlane:
    """A movie (t, x, y, v) of one plane to cells: calibration, dead pixels, motion, spline trends, low-rank tiles, joint demixing.

    sign: -1 where activity darkens. parts: tiles a side. noise: deviation of white noise that keeps neighbouring pixels of flat
    regions from correlating, from hashes of their places, so that a run can be repeated.
    """

    movie: DataFrame
    camera: DataFrame
    folder: str | None = None
    parts: int = 10
    frames: int = 512
    sign: int = 1
    noise: float = 0.0
    knot: int = 100
    settings: D.Settings | None = None

    def __post_init__(self):
        self.spark = self.movie.sparkSession
        self.stages = Stages(self.spark, "single-plane", self.folder)
        box = self.movie.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
        self.nx, self.ny = int(box.x or 0) + 1, int(box.y or 0) + 1

    def preprocess(self) -> DataFrame:
        def moved() -> DataFrame:
            clean = self.stages.table("denoised", lambda: M.volumes(P.median3x3(P.calibrate(self.movie, self.camera), self.nx, self.ny)))
            out, _ = M.corrected(clean, M.middle_reference(clean, 150))
            return M.voxels(out).drop("z")

        return self.stages.table("corrected", moved)

    def detrend(self) -> DataFrame:
        """The corrected movie without each pixel's spline trend."""
        from .functions import signal as G
        from .operators.grouped import per_trace

        def make() -> DataFrame:
            rows = self.preprocess().select((F.col("x") * D.WIDE + F.col("y")).alias("pix"), "t", "v")
            out = per_trace(rows, lambda y, k=self.knot: y - G.spline_trend(y, k))
            return out.select("t", F.floor(F.col("pix") / D.WIDE).alias("x"), (F.col("pix") % D.WIDE).alias("y"), "v")

        return self.stages.table("detrended", make)

    def denoise(self) -> DataFrame:
        def make() -> DataFrame:
            rows = self.detrend()
            return U.voxels(U.factor_tiles(rows, self.nx, self.ny, self.parts, self.frames), rows.select("t").distinct(), self.frames)

        return self.stages.table("low-rank", make)

    def demix(self, cuts: tuple[float, ...] = (0.6, 0.6, 0.5), lengths: tuple[int, ...] = (25, 25, 25), deviations: tuple[float, ...] = (2, 2, 1), residual: tuple[float, ...] = (0.6, 0.6, 0.6)) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(footprints, traces, background)."""
        # a sum of twelve uniform numbers, less 6, has deviation 1
        uniform = [F.pmod(F.xxhash64("t", "x", "y", F.lit(k)), F.lit(1 << 30)) / (1 << 30) for k in range(12)]
        v = F.col("v") + (sum(uniform[1:], uniform[0]) - 6) * self.noise if self.noise else F.col("v")
        rows = self.denoise().select("t", "x", "y", (v * self.sign).alias("v"))
        settings = self.settings or D.Settings(frames=self.frames, rounds=60, last_rounds=100, cut=0.3, merge_cut=0.5, overlap=0.8, patch=50)
        names = ("footprints", "traces", "background")
        if not all(self.stages.done(n) for n in names):
            for name, frame in zip(names, D.demix(rows, cuts, lengths, deviations, residual, settings)):
                self.stages.table(name, lambda frame=frame: frame)
        return tuple(self.stages.table(n, lambda: None) for n in names)

    def change(self) -> DataFrame:
        """(t, x, v): each frame's relative change, row by row of the corrected movie."""
        return T.frame_dff(self.preprocess())
