"""Motion correction of movies and volumes: a reference, a transform a time point, held transforms, resampling by splines.

A volume is a row (t, nz, nx, ny, v) with its voxels as one array in the order z, x, y; a movie of frames has nz = 1. Transforms are
rows (t, m), m a homogeneous 4 x 4 matrix by rows that takes a place of the reference to the place whose value belongs there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import register as R
from ..session import dealt, ship
from ..workspace import sent
from .grouped import runs

SCHEMA = "t long, nz long, nx long, ny long, v array<double>"
TRANSFORM = "t long, m array<double>"
#: Bytes of a reference that is sent to all workers, which is as much as one volume takes; volumes added up together.
LARGEST, FAN = 1 << 30, 32
#: Voxels of volumes that are gathered or registered together, one volume at least.
GATHERED = 1 << 16

#: Kinds of transforms and what finds them, given the reference and a stack of volumes (z, x, y). The first three look at the brightest of all
#: planes, the others at whole volumes.
PLANAR: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"translation2d": R.translation2d, "rigid2d": R.rigid2d, "affine2d": R.affine2d}
SPATIAL: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"translation3d": R.translation3d, "rigid3d": R.rigid3d, "affine3d": R.affine3d, "rigid_in_planes": R.rigid_in_planes, "rigid_projected": R.rigid_projected}


def volumes(movie: DataFrame) -> DataFrame:
    """Rows (t, [z,] x, y, v) as volumes; missing voxels are 0. A volume is gathered by one task, of which each takes many in order of time."""
    ship(movie.sparkSession)
    flat = movie if "z" in movie.columns else movie.withColumn("z", F.lit(0).cast("long"))
    box = flat.agg(*[f(c).alias(f"{n}{c}") for c in "zxy" for n, f in (("a", F.min), ("b", F.max))]).first()
    if box["az"] is None:
        return movie.sparkSession.createDataFrame([], SCHEMA)
    first, shape = [box[f"a{c}"] for c in "zxy"], [box[f"b{c}"] - box[f"a{c}"] + 1 for c in "zxy"]

    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at, v in runs(batches):  # voxels of whole volumes
            times, row = np.unique(t, return_inverse=True)
            most = max(1, GATHERED // size)
            for a in range(0, len(times), most):
                out = np.zeros((len(times[a : a + most]), size))
                own = slice(*np.searchsorted(row, (a, a + most)))
                out[row[own] - a, at[own]] = v[own]
                n = len(out)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * size) if n * size < 1 << 31 else pa.array([0, size], pa.int32())
                yield pa.RecordBatch.from_pydict({"t": pa.array(times[a : a + most], pa.int64()), **{f"n{c}": pa.array(np.full(n, k), pa.int64()) for c, k in zip("zxy", shape)}, "v": pa.ListArray.from_arrays(ends, pa.array(out.ravel()))})

    at = ((F.col("z") - first[0]) * shape[1] + F.col("x") - first[1]) * shape[2] + F.col("y") - first[2]
    rows = flat.select("t", at.cast("long").alias("at"), F.col("v").cast("double").alias("v")).repartition(dealt(movie.sparkSession), "t").sortWithinPartitions("t")
    return rows.mapInArrow(run, SCHEMA)


def voxels(vols: DataFrame) -> DataFrame:
    """Volumes as rows (t, z, x, y, v)."""
    at = vols.select("t", "nx", "ny", F.posexplode("v").alias("p", "v"))
    z, rest = F.floor(F.col("p") / (F.col("nx") * F.col("ny"))), F.col("p") % (F.col("nx") * F.col("ny"))
    return at.select("t", z.alias("z"), F.floor(rest / F.col("ny")).alias("x"), (rest % F.col("ny")).alias("y"), "v")


def _volume(row: pd.Series | dict) -> np.ndarray:
    return np.asarray(row["v"], float).reshape(int(row["nz"]), int(row["nx"]), int(row["ny"]))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield {c: one.column(k)[0].as_py() if c != "v" else one.column(k).flatten().to_numpy() for k, c in enumerate(batch.schema.names)}


def reference(vols: DataFrame, first: int, last: int) -> np.ndarray:
    """The mean of the volumes with first <= t < last. Tasks add up theirs, those sums meet in one; the driver gets one volume."""
    ship(vols.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, shape = None, 0, None
        for row in _each(batches):
            shape, n = (row["nz"], row["nx"], row["ny"]), n + 1
            total = row["v"].copy() if total is None else total + row["v"]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "nz": [shape[0]], "nx": [shape[1]], "ny": [shape[2]], "v": [total]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        return pd.DataFrame([(int(pdf["n"].sum()), row["nz"], row["nx"], row["ny"], sum(np.asarray(v, float) for v in pdf["v"]))], columns=["n", "nz", "nx", "ny", "v"])

    kind = "n long, nz long, nx long, ny long, v array<double>"
    sums = vols.where((F.col("t") >= first) & (F.col("t") < last)).select("nz", "nx", "ny", "v").mapInArrow(add, kind)
    some = sums.withColumn("part", F.spark_partition_id() % FAN)
    row = some.groupBy("part").applyInPandas(meet, kind).groupBy().applyInPandas(meet, kind).first()
    if row is None:
        raise ValueError(f"no volumes with {first} <= t < {last}")
    return _volume(row.asDict()) / row["n"]


def middle_reference(vols: DataFrame, most: int = 150) -> np.ndarray:
    """The mean over the time points around the middle one, `most` or an eighth of all on either side."""
    low, high = vols.agg(F.min("t"), F.max("t")).first()
    n = high - low + 1
    mid, reach = low + n // 2, max(1, min(most, n // 2 // 4))
    return reference(vols, mid - reach, mid + reach)


def transforms(vols: DataFrame, fixed: np.ndarray, kind: str = "rigid2d", every: int = 1) -> DataFrame:
    """(t, m): the transform of every `every`-th time point, found coarse to fine by mutual information with the reference; held for
    those between by held(). Planar kinds get a 4 x 4 matrix that leaves z."""
    if kind not in PLANAR | SPATIAL:
        raise ValueError(f"kind is one of {sorted(PLANAR | SPATIAL)}")
    known = fixed.max(0) if kind in PLANAR else fixed
    if known.nbytes > LARGEST:
        raise ValueError("the reference takes more than a worker is sent; register the planes' projection or thinned volumes")
    spark = vols.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, t, v = shared.value, [], []

        def found() -> pa.RecordBatch:
            stack = np.stack(v)
            m = R.lifted(PLANAR[kind](target, stack)) if kind in PLANAR else SPATIAL[kind](target, stack)
            return pa.RecordBatch.from_pydict({"t": pa.array(t, pa.int64()), "m": pa.array(list(m.reshape(len(t), 16)), pa.list_(pa.float64()))})

        for row in _each(batches):
            t.append(row["t"])
            v.append(_volume(row).max(0) if kind in PLANAR else _volume(row).copy())
            if len(v) * target.size >= GATHERED:
                yield found()
                t, v = [], []
        if t:
            yield found()

    some = vols if every == 1 else vols.where(F.col("t") % every == 0)
    return some.mapInArrow(run, TRANSFORM)


def held(found: DataFrame, times: DataFrame, chunk: int = 4096) -> DataFrame:
    """(t, m) for every time of times (t): the last transform at or before it, the first one for times before all. Within chunks of
    time by a window, across them by each chunk's last transform, so that no task sees all times."""
    c = F.floor(F.col("t") / chunk).alias("c")
    every = times.select("t", F.lit(None).cast("array<double>").alias("m"), F.lit(1).alias("asked")).union(found.select("t", "m", F.lit(0).alias("asked")))
    every = every.select("t", "m", "asked", c)
    ends = every.groupBy("c").agg(F.max_by("m", F.when(F.col("m").isNotNull(), F.col("t"))).alias("end"))
    carried = ends.select("c", F.last("end", True).over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))  # a row a chunk
    inside = F.last("m", True).over(Window.partitionBy("c").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0))
    earliest = found.agg(F.min_by("m", "t").alias("first"))
    rows = every.withColumn("m", inside).where("asked = 1").join(carried, "c").crossJoin(F.broadcast(earliest))  # one row
    return rows.select("t", F.coalesce("m", "carry", "first").alias("m"))


def moved(vols: DataFrame, found: DataFrame, order: int = 3) -> DataFrame:
    """Volumes resampled by their transforms (t, m), by cubic splines (order 3) or linearly (1); 0 where a place lies outside."""
    ship(vols.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            v, m = _volume(row), np.asarray(row["m"]).reshape(4, 4)
            if v.shape[0] == 1:
                out = R.apply(v[0], m[1:, 1:], order=order)[None]
            else:
                out = R.apply(v, m, order=order)
            yield pa.RecordBatch.from_pydict({"t": pa.array([row["t"]], pa.int64()), **{c: pa.array([row[c]], pa.int64()) for c in ("nz", "nx", "ny")}, "v": pa.array([out.ravel()], pa.list_(pa.float64()))})

    return vols.join(sent(found), "t").select("t", "nz", "nx", "ny", "v", "m").mapInArrow(run, SCHEMA)


def corrected(vols: DataFrame, fixed: np.ndarray | None = None, kind: str = "rigid2d", every: int = 1) -> tuple[DataFrame, DataFrame]:
    """(volumes, transforms): every time point moved onto the reference, by default the middle's mean. Transforms are written once."""
    from ..workspace import Workspace

    fixed = middle_reference(vols) if fixed is None else fixed
    found = Workspace(vols.sparkSession, "motion").write(transforms(vols, fixed, kind, every), "transforms")
    every_t = found if every == 1 else Workspace(vols.sparkSession, "motion").write(held(found, vols.select("t")), "held")
    return moved(vols, every_t), every_t


def offsets(found: DataFrame) -> DataFrame:
    """(t, turn, dx, dy): the tangent of the rotation within planes and the shifts of transforms."""
    at = lambda i: F.col("m")[i]
    return found.select("t", F.try_divide(at(6), at(5)).alias("turn"), at(7).alias("dx"), at(11).alias("dy"))
