"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local master without one gets a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="voxelane-")
    return _LOCAL


_LOCAL: str | None = None


class Workspace:
    """Parquet tables of one operator call.

    write() runs a plan once and returns a frame that reads the written files, so a lost executor costs only the reading tasks again. drop() removes a table that a later one replaces; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, frame: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        frame.write.options(**({"compression": "zstd"} | (options or {}))).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        for _ in range(2):  # the first finds the plans' proxies, the second what they held
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.4)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            self.drop()


#: Megabytes that a table may have to be broadcast.
BROADCAST_MB = 32


def _bytes(name: str, kind: DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        wide = 16 if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)) else 8
        text = F.octet_length(c.cast("string")) if wide == 16 else F.lit(0)
        return F.greatest(F.size(c), F.lit(0)) * wide + F.coalesce(text, F.lit(0)) + 16
    return F.lit(16)


def small_enough(frame: DataFrame, megabytes: float = BROADCAST_MB) -> bool:
    """Whether the rows of a frame, as Spark holds them, take at most so many megabytes."""
    wide = sum((_bytes(f.name, f.dataType) for f in frame.schema.fields), F.lit(8))
    return (frame.agg(F.sum(wide.cast("long"))).first()[0] or 0) <= megabytes * 1e6


def sent(frame: DataFrame, megabytes: float = BROADCAST_MB) -> DataFrame:
    """The frame, marked for broadcast if its rows take at most so many megabytes; else as it is, for Spark to shuffle. Counting
    runs the frame's plan once, which is cheap for what is small."""
    return F.broadcast(frame) if small_enough(frame, megabytes) else frame
