"""Movies as tiles of pixels x frames, stored so that per-tile work joins them without moving them.

A tile is a row (bx, by, chunk, x0, y0, nx, ny, t, v): v holds the voxels in the order x, y, t of the frames in t. Stores are bucketed by
(bx, by, chunk); what is joined to them is shuffled, the movie is not. A tile takes 8 size^2 frames bytes, whatever the movie's size.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..workspace import shared_root

TILE = ("bx", "by", "chunk")
SCHEMA = "bx long, by long, chunk long, x0 long, y0 long, nx long, ny long, t array<long>, v array<double>"


def tiles_of(movie: DataFrame, size: int, frames: int) -> DataFrame:
    """Rows (t, x, y, v) as tiles of size x size pixels and `frames` frames; missing voxels are 0."""
    ship(movie.sparkSession)
    keys = [F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"), F.floor(F.col("t") / frames).alias("chunk")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, of = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        x0, y0 = int(x.min()), int(y.min())
        cube = np.zeros((int(x.max()) - x0 + 1, int(y.max()) - y0 + 1, len(t)))
        cube[x - x0, y - y0, of] = pdf["v"].to_numpy(float)
        return pd.DataFrame([(*key, x0, y0, *cube.shape[:2], t, cube.ravel())], columns=["bx", "by", "chunk", "x0", "y0", "nx", "ny", "t", "v"])

    return movie.select("t", "x", "y", "v").groupBy(*keys).applyInPandas(run, SCHEMA)


def tile_sizes(movie: DataFrame, size: int, frames: int, most: int = 1 << 30) -> DataFrame:
    """(bx, by, chunk, voxels, bytes, large): what each tile of such a grid would take, and whether that is over `most` bytes; counted
    before any tile is made."""
    keys = [F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"), F.floor(F.col("t") / frames).alias("chunk")]
    return movie.groupBy(*keys).agg(F.count("*").alias("voxels")).select("*", (8 * F.col("voxels")).alias("bytes"), (8 * F.col("voxels") > most).alias("large"))


class Store:
    """Tiles in a bucketed table, in the shared folder. It goes when the driver ends, or by drop(). size: the side of its blocks."""

    def __init__(self, spark: SparkSession, tiles: DataFrame, buckets: int | None = None, size: int = 0):
        self.spark, self.name, self.size = spark, f"tiles_{uuid.uuid4().hex}", size
        self.path = f"{shared_root(spark)}/{self.name}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        tiles.repartition(buckets, *TILE).write.option("path", self.path).option("compression", "zstd").bucketBy(buckets, *TILE).sortBy(*TILE).saveAsTable(self.name)
        self.tiles = spark.table(self.name)
        atexit.register(self.drop)

    @classmethod
    def of(cls, movie: DataFrame, size: int, frames: int) -> Store:
        """The store of a movie of rows (t, x, y, v)."""
        return cls(movie.sparkSession, tiles_of(movie, size, frames), size=size)

    def drop(self) -> None:
        with contextlib.suppress(Exception):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keys(self) -> DataFrame:
        """(bx, by, chunk) of all tiles, from the narrow columns alone."""
        return self.spark.read.schema(SCHEMA).parquet(self.path).select(*TILE)

    def with_rows(self, rows: DataFrame, schema: str, run: Callable[[Tile, pd.DataFrame], pd.DataFrame | None]) -> DataFrame:
        """What run makes of each tile and the rows of its (bx, by, chunk); tiles without rows give none. Only the rows are shuffled."""
        ship(self.spark)
        names = [part.split()[0] for part in schema.split(", ")]

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = run(Tile(left.iloc[0]), right) if len(left) and len(right) else None
            return pd.DataFrame(columns=names) if out is None else out

        return self.tiles.groupBy(*TILE).cogroup(rows.groupBy(*TILE)).applyInPandas(both, schema)


class Tile:
    """A tile's row with its voxels as pixels x frames."""

    def __init__(self, row: pd.Series):
        self.key = (int(row["bx"]), int(row["by"]), int(row["chunk"]))
        self.x0, self.y0, self.nx, self.ny = (int(row[c]) for c in ("x0", "y0", "nx", "ny"))
        self.t = np.asarray(row["t"])
        self.v = np.asarray(row["v"], float).reshape(self.nx * self.ny, len(self.t))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """x and y of each pixel."""
        p = np.arange(self.nx * self.ny)
        return p // self.ny + self.x0, p % self.ny + self.y0


def sum_arrays(column: str) -> F.Column:
    """The sum, place by place, of a group's arrays of one length."""
    lists = F.collect_list(column)
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), lists[0], lambda s, a: F.zip_with(s, a, lambda p, q: p + q))


def neighbour_correlation(movie: DataFrame, size: int, frames: int, steps: tuple[tuple[int, ...], ...], keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(keys, keys2, r): Pearson r of each pixel and those at the given steps, all in one shuffle of the movie.

    Tiles carry a margin of the farthest step, so neighbours across a border meet; each pair is counted in the tile that owns its
    first pixel, as sums over the tile's frames, which are added up. Constant pixels give 0, pairs outside the movie none. Sums are
    centred within a chunk, and chunks are joined by their means.
    """
    ship(movie.sparkSession)
    far = [max(abs(s[i]) for s in steps) for i in range(len(keys))]
    spread = movie.select("t", *keys, "v")
    for k, m in zip(keys, far):  # a voxel goes to its own tile and to those whose margin it lies in
        spread = spread.withColumn(f"b{k}", F.explode(F.sequence(F.floor((F.col(k) - m) / size), F.floor((F.col(k) + m) / size))))
    names = [*keys, *[f"{k}2" for k in keys]]
    sums = ["n", "mp", "mq", "pp", "qq", "pq"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        corner = np.array([int(b) * size for b in key[: len(keys)]])
        t, of = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        at = tuple(pdf[k].to_numpy() - c + m for k, c, m in zip(keys, corner, far))
        shape = [size + 2 * m for m in far]
        cube = np.full((*shape, len(t)), np.nan)
        cube[(*at, of)] = pdf["v"].to_numpy(float)
        own = tuple(slice(m, m + size) for m in far)
        p, out = cube[own], []
        for s in steps:
            q = cube[tuple(slice(m + d, m + d + size) for m, d in zip(far, s))]
            both = ~np.isnan(p) & ~np.isnan(q)
            n = both.sum(-1)
            a, b = np.where(both, p, 0), np.where(both, q, 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                ma, mb = a.sum(-1) / n, b.sum(-1) / n
            a, b = np.where(both, a - ma[..., None], 0), np.where(both, b - mb[..., None], 0)
            place = np.nonzero(n)
            first = [x + c for x, c in zip(place, corner)]
            values = [n[place], ma[place], mb[place], (a * a).sum(-1)[place], (b * b).sum(-1)[place], (a * b).sum(-1)[place]]
            out.append(pd.DataFrame(dict(zip([*names, *sums], [*first, *[x + d for x, d in zip(first, s)], *values]))))
        return pd.concat(out)

    schema = ", ".join([*[f"{c} long" for c in names], "n long", *[f"{c} double" for c in sums[1:]]])
    parts = spread.groupBy(*[f"b{k}" for k in keys], F.floor(F.col("t") / frames).alias("chunk")).applyInPandas(run, schema)
    n = F.sum("n")
    mp, mq = F.sum(F.col("n") * F.col("mp")) / n, F.sum(F.col("n") * F.col("mq")) / n
    joined = lambda within, x, y, mx, my: F.sum(F.col(within) + F.col("n") * F.col(x) * F.col(y)) - n * mx * my
    total = parts.groupBy(*names).agg(joined("pp", "mp", "mp", mp, mp).alias("pp"), joined("qq", "mq", "mq", mq, mq).alias("qq"), joined("pq", "mp", "mq", mp, mq).alias("pq"))
    flat = (F.col("pp") <= 1e-12) | (F.col("qq") <= 1e-12)
    return total.select(*names, F.when(flat, 0.0).otherwise(F.try_divide(F.col("pq"), F.sqrt("pp") * F.sqrt("qq"))).alias("r"))
