"""Movies kept by block, every block's voxels in order of time, to which ranges of time are added without rewriting what is there.

An archive is a folder of segments, each the tiles of one range of time in Parquet, and numbered lists of the segments that count. A
segment counts once a list names it; lists are written aside and renamed, and only to a number that is free, so readers see all of
a range or nothing of it, and of two writers the second tries again on what the first left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import SCHEMA, TILE, tiles_of
from ..session import ship


class Conflict(Exception):
    """Another writer's range lies in the same time."""


class Archive:
    """The movie of one folder, which driver and executors share. size, frames: of its tiles, as stated when it was begun."""

    def __init__(self, spark: SparkSession, path: str, size: int = 64, frames: int = 512):
        self.spark, self.path = spark, path.rstrip("/")
        ship(spark)
        if not self._numbers():
            self._commit(lambda state: state | {"size": size, "frames": frames, "segments": []})
        state = self.state()
        self.size, self.frames = state["size"], state["frames"]

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/_lists")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, number: int | None = None) -> dict:
        """The newest list, or that of a number: size, frames and segments [{folder, first, last}], last included."""
        numbers = self._numbers()
        if not numbers:
            return {}
        fs, path = self._fs(f"{self.path}/_lists/{numbers[-1] if number is None else number:08d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict], dict], tries: int = 20) -> dict:
        """Write the next list: change applied to the newest."""
        for _ in range(tries):
            numbers = self._numbers()
            state = change(self.state())
            mark = uuid.uuid4().hex
            fs, aside = self._fs(f"{self.path}/_lists/.{mark}")
            out = fs.create(aside, True)
            out.write(bytearray(json.dumps(state | {"mark": mark}).encode()))
            out.close()
            _, final = self._fs(f"{self.path}/_lists/{(numbers[-1] if numbers else 0) + 1:08d}.json")
            if not fs.exists(final) and fs.rename(aside, final) and self.state((numbers[-1] if numbers else 0) + 1)["mark"] == mark:
                return state
            fs.delete(aside, False)
        raise Conflict("other writers kept committing")

    def append(self, movie: DataFrame, first: int, last: int) -> None:
        """Add rows (t, x, y, v) with first <= t <= last. A range that touches one that is there is refused; others may come in any
        order. If the write breaks off, nothing counts."""
        self._free(self.state(), first, last)
        folder = f"{first}-{last}-{uuid.uuid4().hex}"
        rows = movie.where(F.col("t").between(first, last))
        tiles_of(rows, self.size, self.frames).repartition("bx", "by").sortWithinPartitions(*TILE).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")

        def change(state: dict) -> dict:
            self._free(state, first, last)
            return state | {"segments": sorted([*state["segments"], {"folder": folder, "first": first, "last": last}], key=lambda s: s["first"])}

        self._commit(change)

    @staticmethod
    def _free(state: dict, first: int, last: int) -> None:
        if first > last:
            raise ValueError("the range is empty")
        for s in state["segments"]:
            if first <= s["last"] and s["first"] <= last:
                raise Conflict(f"{s['first']} to {s['last']} is there already")

    def tiles(self, first: int | None = None, last: int | None = None, bx: int | None = None, by: int | None = None) -> DataFrame:
        """Tiles with frames in a range of time, of all blocks or of one. Only segments of that range are read."""
        segments = [s for s in self.state().get("segments", []) if (last is None or s["first"] <= last) and (first is None or s["last"] >= first)]
        if not segments:
            return self.spark.createDataFrame([], SCHEMA)
        out = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{s['folder']}" for s in segments])
        for name, value in (("bx", bx), ("by", by)):
            out = out if value is None else out.where(F.col(name) == value)
        out = out if first is None else out.where(F.col("chunk") >= first // self.frames)
        out = out if last is None else out.where(F.col("chunk") <= last // self.frames)
        return joined(out) if _shared(segments, self.frames) else out

    def movie(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Rows (t, x, y, v) of a range of time."""
        at = self.tiles(first, last).select("x0", "y0", "ny", "t", F.posexplode("v").alias("p", "v")).withColumn("n", F.size("t"))
        pixel = F.floor(F.col("p") / F.col("n"))
        rows = at.select(F.get("t", (F.col("p") % F.col("n")).cast("int")).alias("t"), (F.col("x0") + F.floor(pixel / F.col("ny"))).alias("x"), (F.col("y0") + pixel % F.col("ny")).alias("y"), "v")
        return rows.where(F.col("t") >= first if first is not None else F.lit(True)).where(F.col("t") <= last if last is not None else F.lit(True))

    def compact(self, most: int = 1 << 20) -> int:
        """Join runs of neighbouring segments to one of `most` time points at most each, so that a block's frames lie together; the
        number of segments then. Old folders stay for readers of older lists until vacuum()."""
        state = self.state()
        runs: list[list[dict]] = []
        for s in state["segments"]:
            if runs and s["last"] - runs[-1][0]["first"] < most:
                runs[-1].append(s)
            else:
                runs.append([s])
        new = []
        for run in runs:
            if len(run) == 1:
                new.append(run[0])
                continue
            folder = f"{run[0]['first']}-{run[-1]['last']}-{uuid.uuid4().hex}"
            old = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{s['folder']}" for s in run])
            joined(old).repartition("bx", "by").sortWithinPartitions(*TILE).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
            new.append({"folder": folder, "first": run[0]["first"], "last": run[-1]["last"]})

        def change(now: dict) -> dict:
            mine = {s["folder"] for s in state["segments"]}
            if not mine <= {s["folder"] for s in now["segments"]}:
                raise Conflict("another writer joined the same segments")
            later = [s for s in now["segments"] if s["folder"] not in mine]  # added meanwhile
            for s in later:
                self._free({"segments": new}, s["first"], s["last"])
            return now | {"segments": sorted([*new, *later], key=lambda s: s["first"])}

        return len(self._commit(change)["segments"])

    def vacuum(self) -> None:
        """Delete the folders that the newest list doesn't name, and older lists. For times without writers and readers."""
        kept = {s["folder"] for s in self.state()["segments"]}
        fs, root = self._fs(self.path)
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if f.isDirectory() and name != "_lists" and name not in kept:
                fs.delete(f.getPath(), True)
        for n in self._numbers()[:-1]:
            fs.delete(self._fs(f"{self.path}/_lists/{n:08d}.json")[1], False)


def _shared(segments: list[dict], frames: int) -> bool:
    """Whether two segments have frames of one chunk."""
    return any(a["last"] // frames >= b["first"] // frames for a, b in zip(segments, segments[1:]))


def joined(tiles: DataFrame) -> DataFrame:
    """Tiles of one (bx, by, chunk) put together in order of time; their pixels are the same."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf
        t = np.concatenate([np.asarray(x) for x in pdf["t"]])
        x0, y0 = int(pdf["x0"].min()), int(pdf["y0"].min())
        nx, ny = int((pdf["x0"] + pdf["nx"]).max()) - x0, int((pdf["y0"] + pdf["ny"]).max()) - y0
        v, at = np.zeros((nx, ny, len(t))), 0
        for r in pdf.itertuples():
            v[r.x0 - x0 : r.x0 - x0 + r.nx, r.y0 - y0 : r.y0 - y0 + r.ny, at : at + len(r.t)] = np.asarray(r.v).reshape(r.nx, r.ny, -1)
            at += len(r.t)
        order = np.argsort(t)
        return pd.DataFrame([(*pdf[["bx", "by", "chunk"]].iloc[0], x0, y0, nx, ny, t[order], v[..., order].ravel())], columns=pdf.columns)

    return tiles.groupBy(*TILE).applyInPandas(run, SCHEMA)
