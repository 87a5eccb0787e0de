"""Linear kernels over blocks whose frames never meet in one task: sums over chunks of frames make one matrix a block, and the matrix
is applied chunk by chunk. A chunk takes 8 size^2 frames bytes, whatever the movie's length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal as G
from ..session import ship
from ..workspace import Workspace, sent

#: Frames of a chunk (a multiple of half a segment), samples of a segment of Welch's spectra, times that are numbered together.
FRAMES, SEGMENT, NUMBERED = 4096, 256, 1 << 16


def in_order(movie: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], int]:
    """The movie with its frames numbered from 0 without gaps, what gives rows (t, ...) their times back, and the number of frames."""
    times = movie.select("t").distinct()
    n, low, high = times.agg(F.count("t"), F.min("t"), F.max("t")).first()
    if not n or high - low + 1 == n:
        return movie.withColumn("t", F.col("t") - F.lit(low or 0)), lambda rows: rows.withColumn("t", F.col("t") + F.lit(low or 0)), n
    work = Workspace(movie.sparkSession, "frames")
    parts = work.write(times.withColumn("part", F.floor(F.col("t") / NUMBERED)), "times")
    before = parts.groupBy("part").count().select("part", F.expr("sum(count) OVER (ORDER BY part) - count").alias("before"))
    numbers = parts.join(before, "part").select("t", (F.expr("row_number() OVER (PARTITION BY part ORDER BY t)") - 1 + F.col("before")).alias("i"))
    numbers = work.write(numbers, "numbers")
    names = movie.columns
    renumbered = movie.join(sent(numbers), "t").drop("t").withColumnRenamed("i", "t").select(*names)
    return renumbered, lambda rows: rows.withColumnRenamed("t", "i").join(sent(numbers), "i").select(*rows.columns), n


def chunks(movie: DataFrame, size: int, frames: int = FRAMES, margin: int = 0) -> DataFrame:
    """(bx, by, chunk, x0, y0, nx, ny, own, t, v): blocks of size x size pixels by chunks of frames; v holds the voxels in the order x, y, t,
    missing ones 0, of the chunk's `own` frames and of `margin` frames after them; with a margin, frames are numbered without gaps."""
    ship(movie.sparkSession)
    at = movie.select("t", "x", "y", "v", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    box = at.groupBy("bx", "by").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("nx"), (F.max("y") - F.min("y") + 1).alias("ny"))
    own = F.floor(F.col("t") / frames)
    near = F.explode(F.array_distinct(F.array(own, F.floor((F.col("t") - margin) / frames)))) if margin else own
    keys = ["bx", "by", "chunk", "x0", "y0", "nx", "ny"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, chunk, x0, y0, nx, ny = key
        t, of = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        cube = np.zeros((nx, ny, len(t)))
        cube[pdf["x"].to_numpy() - x0, pdf["y"].to_numpy() - y0, of] = pdf["v"].to_numpy(float)
        return pd.DataFrame([(*key, int((t < (chunk + 1) * frames).sum()), t, cube.ravel())], columns=[*keys, "own", "t", "v"])

    rows = at.withColumn("chunk", near).where("chunk >= 0" if margin else "true").join(sent(box), ["bx", "by"])
    schema = ", ".join(f"{k} long" for k in [*keys, "own"]) + ", t array<long>, v array<double>"
    return rows.groupBy(*keys).applyInPandas(run, schema).where("own > 0")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(other columns, frames, pixels x frames) of each row of chunks()."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            t, v = (row.pop(c).values.to_numpy(zero_copy_only=False) for c in ("t", "v"))
            yield row, t, v.reshape(-1, len(t))


def by_moments(movie: DataFrame, size: int, kernel: Callable[[int, tuple[int, int], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], spectra: bool = False, frames: int = FRAMES) -> DataFrame:
    """(t, x, y, v): w @ pixels + b of every frame of each block. kernel(frames, (nx, ny), means, centred products, spectrum) gives w
    and b; the spectrum (pixels x frequencies) is Welch's mean if so asked,
    else empty; pixels of zeros have none (nan). Products are centred within a chunk, and
    chunks are joined by their means."""
    movie, back, total = in_order(movie)
    work, segment = Workspace(movie.sparkSession, "moments"), min(SEGMENT, total)
    tiles = work.write(chunks(movie, size, frames, SEGMENT // 2 if spectra else 0), "chunks")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, t, m in _tiles(batches):
            own = row["own"].as_py()
            a = m[:, :own]
            mean = a.mean(1)
            d = a - mean[:, None]
            count = len(range(0, min(own, len(t) - segment + 1), max(1, segment - segment // 2))) if spectra else 0
            p = G.welch(m[:, : (count - 1) * (segment - segment // 2) + segment], segment)[1] * count if count else np.zeros((len(m), segment // 2 + 1) if spectra else 0)
            any_ = np.abs(a).max(1) > 0
            values = [row["bx"].as_py(), row["by"].as_py(), row["nx"].as_py(), row["ny"].as_py(), own, count]
            lists = [mean, (d @ d.T).ravel(), p.ravel(), any_.astype(float)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in values), *(pa.array([x], pa.list_(pa.float64())) for x in lists)], names=["bx", "by", "nx", "ny", "n", "segments", "mean", "c", "p", "some"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        means = np.stack(pdf["mean"])
        mean = n @ means / n.sum()
        off = means - mean
        c = sum(np.asarray(x) for x in pdf["c"]).reshape(len(mean), len(mean)) + (off.T * n) @ off
        p = sum(np.asarray(x) for x in pdf["p"]).reshape(len(mean), -1) / max(1, pdf["segments"].sum()) if spectra else np.zeros((len(mean), 0))
        p[np.stack(pdf["some"]).max(0) == 0] = np.nan
        w, b = kernel(int(n.sum()), (int(pdf["nx"].iloc[0]), int(pdf["ny"].iloc[0])), mean, c, p)
        return pd.DataFrame([(pdf["bx"].iloc[0], pdf["by"].iloc[0], w.ravel(), b)], columns=["bx", "by", "w", "b"])

    schema = "bx long, by long, nx long, ny long, n long, segments long, mean array<double>, c array<double>, p array<double>, some array<double>"
    summed = tiles.mapInArrow(sums, schema)
    found = work.write(summed.groupBy("bx", "by").applyInPandas(solve, "bx long, by long, w array<double>, b array<double>"), "matrices")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, t, m in _tiles(batches):
            own, x0, y0, ny = (row[c].as_py() for c in ("own", "x0", "y0", "ny"))
            w, b = (row[c].values.to_numpy(zero_copy_only=False) for c in ("w", "b"))
            out, k = w.reshape(len(m), len(m)) @ m[:, :own] + b[:, None], np.arange(len(m))
            columns = [np.tile(t[:own], len(m)), np.repeat(k // ny + x0, own), np.repeat(k % ny + y0, own), out.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "x", "y", "v"])

    return back(tiles.join(sent(found), ["bx", "by"]).mapInArrow(apply, "t long, x long, y long, v double"))
