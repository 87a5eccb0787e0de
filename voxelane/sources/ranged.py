"""Raw interleaved recordings as a data source of Spark: a partition a range of records, and conditions on the record's number
decide which ranges are read.

After register(spark): spark.read.format("recording").option("path", ...).option("channels", "ch1,ch2").load().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..session import ship
from .recordings import _open

#: Rows of one Arrow batch.
BATCH = 1 << 16


class Range(InputPartition):
    """Records first to last - 1 of a file."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict, channels: list[str]):
        self.path, self.channels = options["path"], channels
        self.dtype, self.records = np.dtype(options.get("dtype", "<f4")), int(options.get("records", 1 << 20))
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take conditions that compare the record's number i with a constant; give back the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("i",) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    most = f.value + (not isinstance(f, LessThan))
                    self.high = most if self.high is None else min(self.high, most)
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else self.path.split("://")[0] + "://"
        width = self.dtype.itemsize * len(self.channels)
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                n = f.size // width
                end = n if self.high is None else min(n, self.high)
                out += [Range(prefix + f.path, a, min(end, a + self.records)) for a in range(self.low, end, self.records)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        width = self.dtype.itemsize * len(self.channels)
        with _open(partition.path if "://" in partition.path else f"file://{partition.path}") as f:
            f.seek(partition.first * width)
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                data = np.frombuffer(f.read(n * width), self.dtype).reshape(-1, len(self.channels)).astype(np.float64)
                columns = [pa.array([partition.path] * len(data)), pa.array(np.arange(a, a + len(data), dtype=np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in data.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "i", *self.channels])


class RecordingSource(DataSource):
    """Options: path (a file or a folder, read by every worker), channels (names, by commas, as they alternate), dtype (of one number,
    <f4 by default), records (of a partition). Rows: path, i, a double a channel; an incomplete last record is left out."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def _channels(self) -> list[str]:
        return [c.strip() for c in self.options["channels"].split(",")]

    def schema(self) -> str:
        return "path string, i long, " + ", ".join(f"`{c}` double" for c in self._channels())

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options, self._channels())


def register(spark: SparkSession) -> None:
    """Make the source known, with conditions handed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
