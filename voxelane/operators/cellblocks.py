"""Cells of blocks: seeded factorisation, traces of stored footprints, low rank inside a mask. Footprints of a block never leave it.

Cells are named by block and number within it; footprints are rows (bx, by, cell, x, y, w). Movies are stores of tiles, which what is
joined to them doesn't move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import demix as X
from ..functions import factor as K
from ..session import ship
from .blocks import Store, Tile

FOOT = "bx long, by long, cell long, x long, y long, w double"
TRACE = "bx long, by long, cell long, part string, chunk long, t array<long>, c array<double>"


def name_of(bx: Column, by: Column, k: Column) -> Column:
    """One number for the k-th cell of a block; 4096 cells a block, 2^24 columns and rows of blocks."""
    return F.shiftleft(bx.cast("long"), 36) + F.shiftleft(by.cast("long"), 12) + k


def _whole(tiles: pd.DataFrame, every: int = 1) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(voxels x, y, t; times; x0; y0) of a block's tiles, of every `every`-th time."""
    tiles = tiles.sort_values("chunk")
    parts, times = [], []
    for row in tiles.to_dict("records"):
        tile = Tile(row)
        keep = tile.t % every == 0
        parts.append(tile.v[:, keep])
        times.append(tile.t[keep])
    return np.concatenate(parts, 1).reshape(tile.nx, tile.ny, -1), np.concatenate(times), tile.x0, tile.y0


def demix_blocks(store: Store, image: DataFrame | None = None, every: int = 1, scale: float = 10.0, segment: int = 50, blob: int = 10, cut: float = 0.3, inside: bool = False) -> DataFrame:
    """Footprints of each block's cells, from every `every`-th frame: segments of the image (x, y, v), by default the largest value of
    each pixel, are grown and factored jointly, weak weights cut, footprints split into blobs and refined. Blocks where the image is
    nowhere positive, or of one row of pixels, have none. inside: pixels where the image isn't positive count as dark. A block with
    those frames is a task's."""
    ship(store.spark)
    block = ["bx", "by"]
    if image is not None:
        rows = _by_block(store, image).groupBy(*block).agg(F.collect_list(F.struct("x", "y", "v")).alias("image"))
    else:
        rows = store.keys().select(*block).distinct().withColumn("image", F.lit(None).cast("array<struct<x:bigint,y:bigint,v:double>>"))

    def run(key: tuple, tiles: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["bx", "by", "cell", "x", "y", "w"])
        if not len(tiles) or not len(right):
            return none
        m, _, x0, y0 = _whole(tiles, every)
        seen = right["image"].iloc[0]
        top = None if seen is None else np.zeros(m.shape[:2])
        if top is not None:
            for p in seen:
                top[p["x"] - x0, p["y"] - y0] = p["v"]
        if min(m.shape[:2]) == 1 or not m.size or (top is not None and top.max() <= 0):
            return none
        if inside and top is not None:
            m = m * (top > 0)[..., None]
        a, _ = K.demix_block(m, scale, segment, blob, cut, top)
        p, k = np.nonzero(a)
        return pd.DataFrame({"bx": key[0], "by": key[1], "cell": k, "x": p // m.shape[1] + x0, "y": p % m.shape[1] + y0, "w": a[p, k]})

    return store.tiles.select("bx", "by", "chunk", "x0", "y0", "nx", "ny", "t", "v").groupBy(*block).cogroup(rows.groupBy(*block)).applyInPandas(run, FOOT)


def _by_block(store: Store, image: DataFrame) -> DataFrame:
    """An image's pixels with their blocks; blocks are squares of the store's size."""
    return image.withColumn("bx", F.floor(F.col("x") / store.size)).withColumn("by", F.floor(F.col("y") / store.size))


def cell_traces(store: Store, footprints: DataFrame, mask: DataFrame | None = None, cut: float = 0.3, least: int = 10) -> DataFrame:
    """(bx, by, cell, part, chunk, t, c): least-squares traces of all footprints of a block (part whole), and (part masked) of those that
    keep more than least pixels inside the mask (x, y, keep) after weights under cut times their largest go, on the masked movie.
    Blocks without a footprint, or without a pixel of the mask, have none. Least squares go frame by frame, so chunks are apart, and
    the movie stays where it is stored."""
    block = ["bx", "by"]
    each = footprints.groupBy(*block).agg(F.collect_list(F.struct("cell", "x", "y", "w")).alias("cells"))
    if mask is not None:
        inside = _by_block(store, mask.where("keep")).groupBy(*block).agg(F.collect_list(F.struct("x", "y")).alias("inside"))
        each = each.join(inside, block)
    else:
        each = each.withColumn("inside", F.lit(None).cast("array<struct<x:bigint,y:bigint>>"))

    def run(tile: Tile, rows: pd.DataFrame) -> pd.DataFrame | None:
        row = rows.iloc[0]
        names = sorted({p["cell"] for p in row["cells"]})
        at = {c: k for k, c in enumerate(names)}
        a, keep = np.zeros((len(tile.v), len(names))), np.full(len(tile.v), row["inside"] is None)
        for p in row["cells"]:
            a[(p["x"] - tile.x0) * tile.ny + p["y"] - tile.y0, at[p["cell"]]] = p["w"]
        for p in row["inside"] if row["inside"] is not None else ():
            keep[(p["x"] - tile.x0) * tile.ny + p["y"] - tile.y0] = True
        whole, c, inner, d = X.cell_traces(tile.v.reshape(tile.nx, tile.ny, -1), a, keep.reshape(tile.nx, tile.ny), cut, least)
        some = np.array(names)[a.sum(0) > 0]
        high = np.where(a < cut * a.max(0), 0, a)[:, a.sum(0) > 0]
        kept = some[((high * keep[:, None]) > 0).sum(0) > least] if len(some) else some
        out = [(*tile.key[:2], n, "whole", tile.key[2], tile.t, x) for n, x in zip(some, c)] + [(*tile.key[:2], n, "masked", tile.key[2], tile.t, x) for n, x in zip(kept, d)]
        return pd.DataFrame(out, columns=["bx", "by", "cell", "part", "chunk", "t", "c"]) if out else None

    return store.with_rows(store.keys().join(each, block), TRACE, run)


def trace_rows(traces: DataFrame, part: str = "whole") -> DataFrame:
    """(pix, t, v) of a part's traces, pix naming the cell."""
    one = traces.where(F.col("part") == part).select(name_of(F.col("bx"), F.col("by"), F.col("cell")).alias("pix"), F.explode(F.arrays_zip("t", "c")).alias("z"))
    return one.select("pix", F.col("z.t").alias("t"), F.col("z.c").alias("v"))


def pca_on_mask(store: Store, mask: DataFrame, most: int = 300) -> DataFrame:
    """(t, x, y, v): each block's centred voxels inside the mask (x, y, keep) at a low rank, a quarter of the smaller side or `most`;
    0 outside the mask. A block is a task's."""
    block = ["bx", "by"]
    rows = _by_block(store, mask.where("keep")).groupBy(*block).agg(F.collect_list(F.struct("x", "y")).alias("inside"))

    def run(key: tuple, tiles: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(tiles):
            return pd.DataFrame(columns=["t", "x", "y", "v"])
        m, t, x0, y0 = _whole(tiles)
        keep = np.zeros(m.shape[:2], bool)
        for p in right["inside"].iloc[0] if len(right) else ():
            keep[p["x"] - x0, p["y"] - y0] = True
        flat = (m - m.mean(2, keepdims=True)).reshape(-1, len(t)) * keep.ravel()[:, None]
        out = K.low_rank(flat, max(1, min(min(flat.shape) // 4, most))) * keep.ravel()[:, None] if keep.any() else flat
        x, y = (k.ravel() for k in np.indices(keep.shape))
        return pd.DataFrame({"t": np.tile(t, len(x)), "x": np.repeat(x + x0, len(t)), "y": np.repeat(y + y0, len(t)), "v": out.ravel()})

    return store.tiles.groupBy(*block).cogroup(rows.groupBy(*block)).applyInPandas(run, "t long, x long, y long, v double")


def report(components: DataFrame, mask: DataFrame, least: int = 10) -> DataFrame:
    """(cell, pixels, inside, top, large): of each footprint (cell, x, y, w) its pixels, those inside the mask (x, y, keep), its largest
    weight, and whether it has more than least pixels."""
    rows = components.join(mask, ["x", "y"])
    return rows.groupBy("cell").agg(F.count("*").alias("pixels"), F.sum(F.col("keep").cast("long")).alias("inside"), F.max("w").alias("top"), (F.count("*") > least).alias("large"))
