"""Session construction and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own.

    AQE stays on, and the time zone is pinned to UTC so that results compare with other engines.
    """
    options = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.config(map=options).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once per application.

    The zip travels by Spark's own file server, so executors need no shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(target)


def dealt(spark: SparkSession) -> int:
    """Parts for rows whose work is far larger than their bytes, by which Spark would join small parts into a few tasks."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trim() -> None:
    """Give memory that Python, Arrow and the C library hold for later use back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches after whose end the worker, which other tasks use again, holds no more than it needs."""

    @wraps(run)
    def and_trim(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return and_trim
