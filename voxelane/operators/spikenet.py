"""The spike network trained by many tasks at once, which hold the same weights.

In every step each task adds up the gradient of its windows of the step's batch, and the driver takes a step of Adam with their sum,
which has the size of the weights. What a window does depends on its key alone, so the weights don't depend on how windows are dealt
but for rounding. A step reads its batch alone; a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lstm as L
from ..session import ship

#: Windows of a batch that are worth a task of their own.
LEAST = 1024
#: Salt by which a batch's windows fall to its tasks.
PART = 1 << 20


def _mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each key and a salt."""
    z = (key.astype(np.uint64) + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def kept_units(key: np.ndarray, turn: int, units: int, dropout: float) -> np.ndarray:
    """(windows, 1, units): 0 for the units that a pass leaves out of a window, else what makes up for them."""
    each = _mixed(np.repeat(key, units) + np.tile(np.arange(units, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019), len(key)), turn + 1)
    return ((each >> np.uint64(11)) * 2.0**-53 >= dropout).reshape(len(key), 1, units) / (1 - dropout)


def train(windows: DataFrame, workers: int = 4, hidden: int = 16, passes: int = 10, batch: int = 8192, rate: float = 1e-2, dropout: float = 0.2, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights fitted to windows (pix, t, w array<double>, y). Every pass deals the windows anew to batches of about `batch`, and each
    batch to as many tasks as the application has cores, `workers` at least, but no more than suit its size. A step is a job over its
    batch's tasks alone; what they send has the size of the weights."""
    spark = windows.sparkSession
    ship(spark)
    context = spark.sparkContext
    rows = windows.select(F.xxhash64("pix", "t").alias("k"), F.col("w").cast("array<double>").alias("w"), F.col("y").cast("double").alias("y"))
    batches = max(1, round(rows.count() / batch))
    parts = max(1, workers, min(context.defaultParallelism, batch // LEAST))
    p = L.create(hidden, 1, seed)
    names = sorted(p)
    first, second, step = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}, 0
    for turn in range(passes):
        salt = turn * 2 + 1000 + seed

        def deal(data: Iterator[pa.RecordBatch], salt: int = salt) -> Iterator[pa.RecordBatch]:
            for b in data:
                key = b.column(0).to_numpy().view(np.uint64)
                at = _mixed(key, salt) % np.uint64(batches) * np.uint64(parts) + _mixed(key, PART) % np.uint64(parts)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=["k", "w", "y", "at"])

        dealt = rows.mapInArrow(deal, "k long, w array<double>, y double, at int").repartitionById(batches * parts, "at")
        packed = dealt.select("k", "w", "y").mapInArrow(_packed, "key binary, x binary, y binary, width int").rdd  # shuffled once a pass
        for b in range(batches):

            def gradients(held: Iterator, p: dict = p, turn: int = turn) -> Iterator[tuple[int, bytes]]:
                for r in held:
                    key, y = np.frombuffer(r.key, np.uint64), np.frombuffer(r.y)
                    x = np.frombuffer(r.x).reshape(len(y), r.width)
                    drop = kept_units(key, turn, 2 * hidden, dropout) if dropout else None
                    _, g = L.gradient(x, y, p, drop)
                    yield len(y), (np.concatenate([g[k].ravel() for k in names]) * len(y)).tobytes()

            found = context.runJob(packed, gradients, range(b * parts, (b + 1) * parts))
            if not found:
                continue
            n, total = sum(f[0] for f in found), np.sum([np.frombuffer(f[1]) for f in found], 0)
            step, at, new = step + 1, 0, {}
            for k in names:
                g = total[at : at + p[k].size].reshape(p[k].shape) / n
                at += p[k].size
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                new[k] = p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            p = new
    return p


def _packed(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of bytes of a part's windows, in order of their keys; none for an empty part."""
    held = [b for b in data if b.num_rows]
    if not held:
        return
    key = np.concatenate([b.column(0).to_numpy() for b in held])
    x = np.concatenate([b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) for b in held])
    y = np.concatenate([b.column(2).to_numpy() for b in held])
    order = np.argsort(key, kind="stable")
    yield pa.RecordBatch.from_pydict({"key": [key[order].tobytes()], "x": [x[order].tobytes()], "y": [y[order].tobytes()], "width": pa.array([x.shape[1]], pa.int32())})


def score(windows: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(pix, t, p): the probability of a spike in each window."""
    ship(windows.sparkSession)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in data:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                x = some.column(2).flatten().to_numpy().reshape(some.num_rows, -1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(L.score(x, weights))], names=["pix", "t", "p"])

    return windows.select("pix", "t", F.col("w").cast("array<double>").alias("w")).mapInArrow(run, "pix long, t long, p double")
