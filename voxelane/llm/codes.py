"""Product codes of vectors, by Lloyd rounds whose assignments search outward from the entry held before.

Vectors become integers and are cut into equal parts, each position with a codebook. An entry that is as near to a part as the one it
held, at distance d, lies within 2 d of that one (triangle inequality); so only that entry's neighbours of such distances are looked
at, nearest first, in lists sorted once a round. All distances are exact integers, ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed
from .workspace import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows handled together; share of the rows from which on a label's sum is sent to all tasks (so to 1 / HOT labels at most).
TOGETHER, HOT = 8192, 1e-4
#: Halves in which sums travel: any sum of floats of 32 bits fits two decimals.
_LOW = 1 << 62
_DECIMAL = pa.decimal128(38, 0)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where squares of differences could leave 64 bits."""
    v = np.floor(vectors.astype(np.float64) * scale)
    if float(np.abs(v).max(initial=0)) < _narrow(v.shape[-1]):
        return v.astype(np.int64)
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


def _narrow(width: int) -> float:
    """Components below this leave four times a squared distance within 64 bits."""
    return (1 << 29) / max(1, width) ** 0.5


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the last axes."""
    d = a - b
    return (d * d).sum(-1)


class Codebook:
    """The entries (k, width) of one part position, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = _square(entries[:, None], entries[None])
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.away = np.take_along_axis(apart, self.near, 1)

    def nearest(self, points: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, searched from the entry that it held."""
        least, best = _square(points, self.entries[held]), held.astype(np.int64)
        reach = 4 * least
        to = np.empty(len(points), np.int64)
        for e in np.unique(held):
            mine = np.flatnonzero(held == e)
            to[mine] = np.searchsorted(self.away[e], reach[mine], side="right")
        order = np.argsort(-to, kind="stable")
        ends = np.searchsorted(-to[order], -np.arange(to.max(initial=0)), side="left")  # points that look at their k-th neighbour
        for k, n in enumerate(ends.tolist()):
            some = order[:n]
            entry = self.near[held[some], k]
            d = _square(points[some], self.entries[entry])
            better = (d < least[some]) | ((d == least[some]) & (entry < best[some]))
            some = some[better]
            least[some], best[some] = d[better], entry[better]
        return best, least


def assign(vectors: np.ndarray, books: list[Codebook], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, parts) of bytes, squared error of each vector), given the codes held before."""
    codes, error = np.empty(held.shape, np.uint8), np.zeros(len(vectors), vectors.dtype)
    if len(vectors):
        for p, (book, part) in enumerate(zip(books, np.split(vectors, len(books), axis=1))):
            codes[:, p], d = book.nearest(part, held[:, p])
            error = error + d
    return codes, error


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _kept(vectors: DataFrame, key: str, vector: str, label: str, parts: int) -> DataFrame:
    """(key, label, v): the rows with finite vectors that can be cut into equal parts."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<float>").alias("v"))
    return rows.where(fine & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code binary, error long) of every row with a finite vector, and the codebooks (parts, entries, width).

    Codebooks start as the vectors of the `entries` smallest keys (nulls last, equal keys by vector) and take `rounds` rounds; rows
    are assigned once more at the end. Components are taken as 32-bit floats. Left out are null vectors, those with null or
    non-finite components (as 32-bit floats), and those that are empty, cannot be cut into equal parts or have another length than
    most rows (of equally frequent lengths, the greatest counts). Repeated rows count each, null labels are labels, other columns are
    not read; with fewer rows than entries every row is an entry; empty tables give no rows and empty codebooks. An error above the
    greatest long is that.
    Every pass writes its codes for the next one to start from; the driver gets codebooks and sums only, of parts * entries rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have a byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    work = Workspace(spark, "codes")
    fine = _kept(vectors, key, vector, label, parts)
    usual = fine.groupBy(F.size("v").alias("wide")).count().orderBy(F.desc("count"), F.desc("wide")).first()
    wide = usual.wide if usual else 0
    fine = fine.where(F.size("v") == wide)
    rows = fine.select("key", "label", "v", F.lit(bytes(parts)).alias("code"))
    least = fine.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = integers(np.array([r.v for r in least], np.float32).reshape(len(least), wide), scale)
    books = np.stack(np.split(books, parts, axis=1)) if wide else np.zeros((parts, len(least), 0), np.int64)
    for k in range(rounds + 1):
        rows = work.write(_assigned(rows, books, scale), f"codes-{k}")
        if k:
            work.drop(f"codes-{k - 1}")
        if k < rounds:
            books = _moved(rows, books, scale)
            rows = rows.select("key", "label", "v", "code")
    return rows.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error"), books


def _assigned(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bool, list[Codebook]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                x = integers(_matrix(some.column(2)), scale)
                large = object in (x.dtype, books.dtype)
                if large not in known:
                    known[large] = [Codebook(b.astype(object) if large else b) for b in books]
                held = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(len(some), len(books))
                codes, error = assign(x.astype(object) if large else x, known[large], held)
                error = pa.array([min(int(e), (1 << 63) - 1) for e in error] if large else error, pa.int64())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), pa.array([c.tobytes() for c in codes], pa.binary()), error], names=["key", "label", "v", "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(trimmed(run), f"{kinds}, error long")


def _moved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks with every used entry at the floor of the mean of its parts. Tasks send a sum an entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), object)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                x = integers(_matrix(some.column(0)), scale).reshape(len(some), parts, width)
                codes = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(len(some), parts)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    one = np.zeros((entries, width), x.dtype)
                    np.add.at(one, codes[:, p], x[:, p])  # under 2**29 each, 8192 rows: far from 64 bits
                    total[p] += one
        p, e = np.nonzero(count)
        if len(p):
            sums = total[p, e]
            halves = [pa.array([[Decimal(int(f(s))) for s in row] for row in sums], pa.list_(_DECIMAL)) for f in (lambda s: s // _LOW, lambda s: s % _LOW)]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *halves], names=["p", "e", "n", "high", "low"])

    sums = rows.select("v", "code").mapInArrow(trimmed(run), "p long, e long, n long, high array<decimal(38,0)>, low array<decimal(38,0)>")
    each = lambda name: [F.sum(F.col(name)[j]).alias(f"{name}{j}") for j in range(width)]
    out = books.copy()
    for r in sums.groupBy("p", "e").agg(F.sum("n").alias("n"), *each("high"), *each("low")).collect():  # a row an entry
        mean = [(int(r[f"high{j}"]) * _LOW + int(r[f"low{j}"])) // r.n for j in range(width)]
        if out.dtype != object and max(map(abs, mean)) >= _narrow(parts * width):
            out = out.astype(object)
        out[r.p, r.e] = mean
    return out


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error: the error summed over the rows of an equal label, nulls together, whatever share a label holds.

    Sums of labels with a share of HOT of all rows, so of 1 / HOT labels at most, are sent to all tasks; others are joined by label.
    """
    sums = Workspace(codes.sparkSession, "labels").write(codes.groupBy(F.col(label).alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("_n")), "sums")
    least = (sums.agg(F.sum("_n")).first()[0] or 0) * HOT
    hot, rest = sums.where(F.col("_n") >= least).drop("_n"), sums.where(F.col("_n") < least).drop("_n")
    met = codes.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    often = met.where("_hot").drop("_hot")
    if rest.isEmpty():
        return often
    return often.unionByName(met.where("_hot IS NULL").drop("_hot", "label_error").join(rest, F.col(label).eqNullSafe(F.col("_label"))).drop("_label"))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
