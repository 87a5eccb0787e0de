"""Readers of recordings, stacks, arrays and camera descriptions, and block-partitioned tables.

Files are listed by Spark's binaryFile source. Recordings of any length are read in ranges of records, so that no task holds a
whole one; stacks and arrays are one time point or one frame set a file and are read a file at a time.
"""

from __future__ import annotations

import bz2
import io
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def raw_samples(spark: SparkSession, path: str, channels: list[str], dtype: str = "<f4", glob: str | None = None, records: int = 1 << 20) -> DataFrame:
    """(path, i, one double a channel): interleaved samples, i counting the records of a file; an incomplete last record is left out.

    Ranges of `records` records are read each for itself, so one long recording spreads over all tasks.
    """
    ship(spark)
    width = np.dtype(dtype).itemsize * len(channels)
    whole = _files(spark, path, glob).select("path", F.floor(F.col("length") / width).alias("n")).where("n > 0")
    ranges = whole.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(records).cast("long"))).alias("first"))
    spread = ranges.repartition("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count = min(records, row["n"] - row["first"])
                with _open(row["path"]) as f:
                    f.seek(row["first"] * width)
                    data = np.frombuffer(f.read(count * width), dtype).reshape(-1, len(channels)).astype(np.float64)
                for a in range(0, len(data), 65536):
                    part = data[a : a + 65536]
                    at = np.arange(len(part), dtype=np.int64) + row["first"] + a
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(part)), pa.array(at), *(pa.array(np.ascontiguousarray(c)) for c in part.T)], names=["path", "i", *channels])

    return spread.mapInArrow(run, "path string, i long, " + ", ".join(f"`{c}` double" for c in channels))


def _voxels(path: str, t: int, stack: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a (z, y, x) stack, a plane at a time."""
    ny, nx = stack.shape[1:]
    y, x = (pa.array(g.ravel().astype(np.int64)) for g in np.indices((ny, nx)))
    for z, plane in enumerate(stack):
        same = lambda v: pa.array(np.full(nx * ny, v, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([path] * (nx * ny)), same(t), same(z), y, x, pa.array(plane.ravel().astype(np.float64))], names=["path", "t", "z", "y", "x", "v"])


_VOXEL = "path string, t long, z long, y long, x long, v double"


#: The last number of a file's name up to its first dot.
LAST_NUMBER = r"(\d+)\D*$"


def _read_stacks(files: DataFrame, parse, time: str = LAST_NUMBER) -> DataFrame:
    """Voxels of files; t is what the pattern `time` finds in a file's name up to its first dot (0 if nothing)."""
    ship(files.sparkSession)
    name = F.split(F.element_at(F.split("path", "/"), -1), r"\.")[0]
    digits = F.nullif(F.regexp_extract(name, time, 1), F.lit(""))
    rows = files.select("path", F.coalesce(digits.cast("long"), F.lit(0).cast("long")).alias("t"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, t, content = (c[i].as_py() for c in batch.columns)
                try:
                    stack = parse(content)
                except (ValueError, OSError, EOFError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                yield from _voxels(path, t, stack)

    return rows.mapInArrow(run, _VOXEL)


def packed_stacks(spark: SparkSession, path: str, dims: tuple[int, int, int], glob: str = "*.bz2", dtype: str = "<i2", time: str = LAST_NUMBER) -> DataFrame:
    """(path, t, z, y, x, v): one bz2-compressed stack a time point. dims is (x, y, z) as the camera description states it, x
    running fastest. A file of another size is an error that names it."""
    return _read_stacks(_files(spark, path, glob), lambda content: np.frombuffer(bz2.decompress(content), dtype).reshape(dims[::-1]), time)


def array_stacks(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(path, t, z, y, x, v) of .npy arrays of one to three axes; missing leading axes have length one."""

    def parse(content: bytes) -> np.ndarray:
        a = np.load(io.BytesIO(content), allow_pickle=False)
        if a.ndim > 3:
            raise ValueError(f"{a.ndim} axes; at most three are read")
        return a.reshape((1,) * (3 - a.ndim) + a.shape)

    return _read_stacks(_files(spark, path, glob), parse)


def tiff_pages(data: bytes) -> np.ndarray:
    """(page, y, x) of an uncompressed single-channel TIFF, either byte order; pages of one size and type.

    Tags read (fixed values of the format): 256 width, 257 height, 258 bits, 259 compression, 273 strip offsets, 277
    samples a pixel, 279 strip lengths, 339 sample format (1 unsigned, 2 signed, 3 float).
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    kinds = {1: "B", 3: "H", 4: "I"}
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(count):
            entry = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            if kind in kinds:
                size = struct.calcsize(kinds[kind]) * n
                where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{kinds[kind]}", data, where)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        if one(259, 1) != 1 or one(277, 1) != 1:
            raise ValueError("only uncompressed pages of one sample a pixel are read")
        strips = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279]))
        dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{one(258, 8) // 8}")
        pages.append(np.frombuffer(strips, dtype).reshape(one(257, 0), one(256, 0)))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
    return np.stack(pages)


def tiff_stacks(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """(path, t, z, y, x, v) of TIFF files, z counting the pages; of a movie in one file, z is the time."""
    return _read_stacks(_files(spark, path, glob), tiff_pages)


def parse_camera(text: bytes | str) -> dict[str, str]:
    """The attributes of all <info>, then of all <action> elements; later ones win."""
    root = ElementTree.fromstring(text)
    found: dict[str, str] = {}
    for tag in ("info", "action"):
        for element in root.iter(tag):
            found.update(element.attrib)
    return found


def camera_info(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, info): one map of attributes a camera description."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [list(parse_camera(x.as_py()).items()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["path", "info"])

    return _files(spark, path, glob).select("path", "content").mapInArrow(run, "path string, info map<string,string>")


def camera_roi(info: DataFrame) -> DataFrame:
    """(path, x0, x1, y0, y1) from the attribute camera_roi, null where it isn't stated or not a number."""
    parts = F.split(F.try_element_at("info", F.lit("camera_roi")), "_")
    return info.select("path", *[F.get(parts, F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("x0", "x1", "y0", "y1"))])


def write_blocks(df: DataFrame, path: str, keys: tuple[str, ...] = ("z", "bx", "by"), mode: str = "error") -> None:
    """A Parquet table with one folder a block; a block's rows are gathered first, so that it is one file."""
    df.repartition(*keys).write.mode(mode).option("compression", "zstd").partitionBy(*keys).parquet(path)


def read_block(spark: SparkSession, path: str, **block: int) -> DataFrame:
    """The rows of one block; only its folder is read."""
    df = spark.read.parquet(path)
    for name, value in block.items():
        df = df.where(F.col(name) == value)
    return df
