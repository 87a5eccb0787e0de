"""Joint demixing of a whole movie into footprints and traces, by descent over tables of blocks.

Cells live in two tables: footprints (bx, by, cell, a, m), a row for every block that a cell reaches, with weights and support of the
block's pixels, and traces (cell, chunk, t, c). A round updates footprints block by block from sums over the frames, then traces chunk
by chunk from sums over the blocks, so that a cell across a border has one trace. Cells of one block descend one after another, those
of other blocks enter with their last traces and a step shortened by their overlap, under which the error cannot grow. No task sees
more than a tile and its cells, one cell's surroundings, or one chunk of a block's cells and their neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demix import supports
from ..session import ship
from ..workspace import Workspace
from .blocks import Store, Tile, neighbour_correlation, sum_arrays
from .space import HALF4, minimum_labels
from .traces import threshold_mad

BLOCK = ("bx", "by")
_FOOT = "bx long, by long, cell long, a array<double>, m array<boolean>"
_TRACE = "cell long, chunk long, t array<long>, c array<double>"
#: Pixel numbers are x * WIDE + y; later passes number their cells from pass * PASS on.
WIDE, PASS = 1 << 24, 1 << 52


@dataclass
class Settings:
    """size, frames: of a tile. rounds, last_rounds: of every pass but the last, and of that. every: rounds between merging and new
    supports, 0 for none. cut: correlation of a support. most: pixels that a support may have. merge_cut, overlap: cells merge that
    touch and whose pixels above merge_cut share more than `overlap` of both. patch: side of the squares in which pure cells are told."""

    size: int = 32
    frames: int = 512
    rounds: int = 35
    last_rounds: int = 50
    every: int = 4
    cut: float = 0.31
    most: int = 4000
    merge_cut: float = 0.6
    overlap: float = 0.6
    patch: int = 100


class _Rows:
    """The cells that a tile was joined with."""

    def __init__(self, pdf: pd.DataFrame, *columns: str):
        pdf = pdf.sort_values("cell")
        self.cells = pdf["cell"].to_numpy()
        for c in columns:
            setattr(self, c, np.stack([np.asarray(x) for x in pdf[c]]))


class Demixer:
    """The tables of one movie: tiles, per-pixel statistics and the cells found so far."""

    def __init__(self, movie: DataFrame, settings: Settings):
        self.spark, self.set = movie.sparkSession, settings
        ship(self.spark)
        self.work, self.count = Workspace(self.spark, "demix"), 0
        least = movie.groupBy("x", "y").agg(F.min("v").alias("low"))
        lifted = movie.join(least, ["x", "y"]).select("t", "x", "y", (F.col("v") - F.least("low", F.lit(0.0))).alias("v"))
        self.movie = self.work.write(lifted, "movie")
        self.store = Store.of(self.movie, settings.size, settings.frames)
        self.pixels = self._pixels()
        self.foot = self.trace = self.back = None

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return self.work.write(frame, f"{name}-{self.count}")

    def _pixels(self) -> DataFrame:
        """(bx, by, x0, y0, nx, ny, mean, sd, b): of each block's pixels; b, the first background, is the median."""
        s = self.set
        rows = self.movie.groupBy("x", "y").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.median("v").alias("b"))
        block = [F.floor(F.col("x") / s.size).alias("bx"), F.floor(F.col("y") / s.size).alias("by")]

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["x", "y"])
            x, y = pdf["x"], pdf["y"]
            return pd.DataFrame([(*key, x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, *(pdf[c].to_numpy() for c in ("mean", "sd", "b")))], columns=["bx", "by", "x0", "y0", "nx", "ny", "mean", "sd", "b"])

        kind = "bx long, by long, x0 long, y0 long, nx long, ny long, mean array<double>, sd array<double>, b array<double>"
        return self.write(rows.groupBy(*block).applyInPandas(run, kind), "pixels")

    def seeds(self, bright: DataFrame, correlation: float, least: int, residual: float, number: int) -> tuple[DataFrame, DataFrame] | None:
        """Footprints and traces of the pure superpixels of a thresholded movie; None without any."""
        s = self.set
        r = neighbour_correlation(bright, s.size, s.frames, HALF4).where(F.col("r") > correlation)
        pixel = lambda e="": (F.col(f"x{e}") * WIDE + F.col(f"y{e}")).alias("b" if e else "a")
        found = minimum_labels(r.select(pixel(), pixel("2")))
        size = found.groupBy("label").count().where(F.col("count") > max(1, least))
        found = self.write(found.join(size, "label").select(F.floor(F.col("node") / WIDE).alias("x"), (F.col("node") % WIDE).alias("y"), (F.col("label") + number * PASS).alias("cell")), "superpixels")
        if found.isEmpty():
            return None
        store = Store.of(bright, s.size, s.frames)
        foot = self._first_footprints(found, bright)
        trace = self._first_traces(store, foot)
        zero = self.pixels.select(*BLOCK, F.transform("b", lambda x: F.lit(0.0)).alias("b"))
        for _ in range(4):  # superpixels share no pixel, so this is each one's own rank-1 descent
            foot, _ = self._footprints(store, foot, trace, zero, keep=zero)
            trace = self._traces(store, foot, trace, zero)
        store.drop()
        pure = self._pure(found, trace, residual)
        return foot.join(pure, "cell", "left_semi"), trace.join(pure, "cell", "left_semi")

    def _first_footprints(self, found: DataFrame, bright: DataFrame) -> DataFrame:
        means = bright.groupBy("x", "y").agg(F.avg("v").alias("w")).join(found, ["x", "y"])
        block = means.select("cell", "x", "y", "w", F.floor(F.col("x") / self.set.size).alias("bx"), F.floor(F.col("y") / self.set.size).alias("by"))
        each = block.groupBy(*BLOCK, "cell").agg(F.collect_list(F.struct("x", "y", "w")).alias("p")).join(self.pixels.select(*BLOCK, "x0", "y0", "nx", "ny"), [*BLOCK])
        at = F.map_from_entries(F.transform("p", lambda p: F.struct((p["x"] - F.col("x0")) * F.col("ny") + p["y"] - F.col("y0"), F.greatest(p["w"], F.lit(0.0)))))
        each = each.select(*BLOCK, "cell", at.alias("at"), F.sequence(F.lit(0).cast("long"), F.col("nx") * F.col("ny") - 1).alias("all"))
        return self.write(each.select(*BLOCK, "cell", F.transform("all", lambda k: F.coalesce(F.try_element_at("at", k), F.lit(0.0))).alias("a"), F.transform("all", lambda k: F.map_contains_key("at", k)).alias("m")), "footprints")

    def _first_traces(self, store: Store, foot: DataFrame) -> DataFrame:
        """Weighted means of the movie over each footprint."""
        def run(tile: Tile, rows: pd.DataFrame) -> pd.DataFrame:
            r = _Rows(rows, "a")
            return pd.DataFrame({"cell": r.cells, "chunk": tile.key[2], "t": [tile.t] * len(r.cells), "c": list(r.a @ tile.v), "w": (r.a**2).sum(1)})

        parts = store.with_rows(store.keys().join(foot, [*BLOCK]), f"{_TRACE}, w double", run)
        total = parts.groupBy("cell", "chunk").agg(F.first("t").alias("t"), sum_arrays("c").alias("c"), F.sum("w").alias("w"))
        return self.write(total.select("cell", "chunk", "t", F.transform("c", lambda x: F.greatest(F.try_divide(x, F.col("w")), F.lit(0.0))).alias("c")).where("w > 0"), "traces")

    def _sums(self, store: Store, rows: DataFrame) -> DataFrame:
        """(bx, by, chunk, cells, yc, cc, c1, n): what a tile's voxels and its cells' traces give for the descent of footprints."""
        def run(tile: Tile, rows: pd.DataFrame) -> pd.DataFrame:
            r = _Rows(rows, "c")
            return pd.DataFrame([(*tile.key, r.cells, (r.c @ tile.v.T).ravel(), (r.c @ r.c.T).ravel(), r.c.sum(1), len(tile.t))], columns=["bx", "by", "chunk", "cells", "yc", "cc", "c1", "n"])

        kind = "bx long, by long, chunk long, cells array<long>, yc array<double>, cc array<double>, c1 array<double>, n long"
        parts = store.with_rows(rows, kind, run)
        return parts.groupBy(*BLOCK).agg(F.first("cells").alias("cells"), *[sum_arrays(c).alias(c) for c in ("yc", "cc", "c1")], F.sum("n").alias("n"))

    def _footprints(self, store: Store, foot: DataFrame, trace: DataFrame, back: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """One sweep of all pixels over their cells, within supports, and the background that the traces so far and the new footprints
        leave. keep: a background to hold on to."""
        sums = self._sums(store, foot.select(*BLOCK, "cell").join(trace, "cell"))
        with_back = sums.join(self.pixels.select(*BLOCK, "mean"), [*BLOCK])
        fixed = keep is not None
        with_back = with_back.join(back.select(*BLOCK, "b"), [*BLOCK])

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = ["bx", "by", "cell", "a", "m", "b"]
            if not len(left) or not len(right):
                return pd.DataFrame(columns=names)
            row, r = left.iloc[0], _Rows(right, "a", "m")
            cells, n = np.asarray(row["cells"]), int(row["n"])
            known = np.isin(r.cells, cells)  # those that still have a trace
            a, m = r.a[known], r.m[known].astype(bool)
            k = len(cells)
            yc, cc, c1 = np.asarray(row["yc"]).reshape(k, -1), np.asarray(row["cc"]).reshape(k, k), np.asarray(row["c1"])
            mean, b = np.asarray(row["mean"]), np.asarray(row["b"])
            if not fixed:
                b = np.maximum(0, mean - (c1 / n) @ a)
            p = yc - c1[:, None] * b
            for i in range(k):
                if cc[i, i] > 0:
                    at = m[i]
                    a[i, at] = np.maximum(0, a[i, at] + (p[i, at] - cc[i] @ a[:, at]) / cc[i, i])
            if not fixed:
                b = np.maximum(0, mean - (c1 / n) @ a)
            out = pd.DataFrame({"bx": key[0], "by": key[1], "cell": cells, "a": list(a), "m": list(m)})
            out["b"] = [b] + [None] * (k - 1)
            return out

        both = self.write(with_back.groupBy(*BLOCK).cogroup(foot.groupBy(*BLOCK)).applyInPandas(run, f"{_FOOT}, b array<double>"), "footprints")
        moved = both.where("b IS NOT NULL").select(*BLOCK, "b")
        rest = self.pixels.join(moved, [*BLOCK], "left_anti").select(*BLOCK, F.transform("mean", lambda x: F.greatest(x, F.lit(0.0))).alias("b"))
        return both.select(*BLOCK, "cell", "a", "m"), keep if fixed else moved.union(rest)

    def _pairs(self, foot: DataFrame) -> DataFrame:
        """(cell, other, g): inner products of footprints that share pixels, each cell with itself included."""
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            r = _Rows(pdf, "a")
            g = r.a @ r.a.T
            i, j = np.nonzero(g)
            return pd.DataFrame({"cell": r.cells[i], "other": r.cells[j], "g": g[i, j]})

        return foot.groupBy(*BLOCK).applyInPandas(run, "cell long, other long, g double").groupBy("cell", "other").agg(F.sum("g").alias("g"))

    def _traces(self, store: Store, foot: DataFrame, trace: DataFrame, back: DataFrame) -> DataFrame:
        """One sweep of all traces; cells without weight go."""
        def run(tile: Tile, rows: pd.DataFrame) -> pd.DataFrame:
            r = _Rows(rows, "a")
            b = np.asarray(rows["b"].iloc[0])
            return pd.DataFrame({"cell": r.cells, "chunk": tile.key[2], "r": list(r.a @ (tile.v - b[:, None]))})

        rows = store.keys().join(foot.select(*BLOCK, "cell", "a").join(back, [*BLOCK]), [*BLOCK])
        right = store.with_rows(rows, "cell long, chunk long, r array<double>", run).groupBy("cell", "chunk").agg(sum_arrays("r").alias("r"))
        pairs = self.write(self._pairs(foot), "pairs")
        home = foot.groupBy("cell").agg(F.max_by(F.struct(*BLOCK), F.struct(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x), -F.col("bx"), -F.col("by"))).alias("h")).select("cell", "h.*")
        near = pairs.groupBy("cell").agg(F.collect_list(F.struct("other", "g")).alias("near"))
        mine = right.join(trace, ["cell", "chunk"]).join(near, "cell").join(home, "cell").select(*BLOCK, "chunk", "cell", "t", "c", "r", "near")
        away = pairs.where("cell <> other").select("cell", "other").join(home, "cell").join(home.select(F.col("cell").alias("other"), F.col("bx").alias("ox"), F.col("by").alias("oy")), "other")
        away = away.where("bx <> ox OR by <> oy").select(*BLOCK, F.col("other").alias("cell")).distinct().join(trace, "cell")
        away = away.select(*BLOCK, "chunk", "cell", "t", "c", F.lit(None).cast("array<double>").alias("r"), F.lit(None).cast("array<struct<other:bigint,g:double>>").alias("near"))

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cell").reset_index(drop=True)
            own = np.flatnonzero(pdf["r"].notna().to_numpy())
            at = {int(c): k for k, c in enumerate(pdf["cell"])}
            c = np.stack([np.asarray(x, float) for x in pdf["c"]])
            g = np.zeros((len(own), len(c)))
            for i, k in enumerate(own):
                for pair in pdf["near"].iloc[k]:
                    if pair["other"] in at:
                        g[i, at[pair["other"]]] = pair["g"]
            inside = np.zeros(len(c), bool)
            inside[own] = True
            for i, k in enumerate(own):
                slope = np.asarray(pdf["r"].iloc[k]) - g[i] @ c
                weight = g[i, k] + g[i, ~inside].sum()  # overlap with cells that move at the same time elsewhere shortens the step
                if weight > 0:
                    c[k] = np.maximum(0, c[k] + slope / weight)
            out = pdf.loc[own, ["cell", "chunk", "t"]]
            return out.assign(c=[c[k] for k in own])

        moved = self.write(mine.unionByName(away).groupBy(*BLOCK, "chunk").applyInPandas(step, _TRACE), "traces")
        alive = moved.groupBy("cell").agg(F.max(F.array_max("c")).alias("top")).where("top > 0")
        return moved.join(alive, "cell", "left_semi")

    def _pure(self, found: DataFrame, trace: DataFrame, residual: float) -> DataFrame:
        """(cell): superpixels that the others of a patch they reach don't explain, by successive projection over the patch's Gram
        matrix of traces scaled to sum 1."""
        p = self.set.patch
        where = found.select(F.floor(F.col("x") / p).alias("px"), F.floor(F.col("y") / p).alias("py"), "cell").distinct()

        def gram(pdf: pd.DataFrame) -> pd.DataFrame:
            r = _Rows(pdf, "c")
            return pd.DataFrame([(pdf["px"].iloc[0], pdf["py"].iloc[0], r.cells, (r.c @ r.c.T).ravel(), r.c.sum(1))], columns=["px", "py", "cells", "g", "s"])

        parts = where.join(trace, "cell").groupBy("px", "py", "chunk").applyInPandas(gram, "px long, py long, cells array<long>, g array<double>, s array<double>")
        total = parts.groupBy("px", "py").agg(F.first("cells").alias("cells"), sum_arrays("g").alias("g"), sum_arrays("s").alias("s"))

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            row = pdf.iloc[0]
            cells, s = np.asarray(row["cells"]), np.asarray(row["s"])
            scale = np.divide(1, s, out=np.zeros(len(s)), where=s > 0)
            return pd.DataFrame({"cell": cells[pure_of_gram(np.asarray(row["g"]).reshape(len(cells), -1) * scale * scale[:, None], residual)]})

        return self.write(total.groupBy("px", "py").applyInPandas(choose, "cell long").distinct(), "pure")

    def _correlations(self, foot: DataFrame, trace: DataFrame) -> DataFrame:
        """(bx, by, cell, corr, a, m): Pearson r of every pixel with the cells of its block and of the blocks around, and the cell's
        footprint there, zeros where it has none."""
        step = F.explode(F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)]))
        ring = foot.select(*BLOCK, "cell").withColumn("i", step).withColumn("j", step).select((F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by"), "cell").distinct()
        ring = ring.join(self.pixels.select(*BLOCK), [*BLOCK])
        sums = self._sums(self.store, ring.join(trace, "cell")).join(self.pixels.select(*BLOCK, "mean", "sd"), [*BLOCK])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            row = pdf.iloc[0]
            cells, n = np.asarray(row["cells"]), int(row["n"])
            k = len(cells)
            yc, cc, c1 = np.asarray(row["yc"]).reshape(k, -1), np.asarray(row["cc"]).reshape(k, k), np.asarray(row["c1"]) / n
            mean, sd = np.asarray(row["mean"]), np.asarray(row["sd"])
            scale = np.sqrt(np.maximum(np.diag(cc) / n - c1**2, 0))[:, None] * sd
            r = np.divide(yc / n - c1[:, None] * mean, scale, out=np.zeros_like(yc), where=scale > 1e-12)
            return pd.DataFrame({"bx": row["bx"], "by": row["by"], "cell": cells, "corr": list(r)})

        r = sums.groupBy(*BLOCK).applyInPandas(run, "bx long, by long, cell long, corr array<double>")
        return self.write(r.join(foot, [*BLOCK, "cell"], "left"), "correlations")

    def _merged(self, foot: DataFrame, trace: DataFrame, corr: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Cells that touch and whose regions of high correlation are mostly the same, replaced by the rank-1 factorisation of their
        sum, from inner products alone; None without any. A merged cell has the least name of its group."""
        s = self.set

        def shared(pdf: pd.DataFrame) -> pd.DataFrame:
            r = _Rows(pdf, "corr")
            high = (r.corr > s.merge_cut).astype(float)
            both = high @ high.T
            i, j = np.nonzero(both)
            return pd.DataFrame({"cell": r.cells[i], "other": r.cells[j], "n": both[i, j]})

        n = corr.groupBy(*BLOCK).applyInPandas(shared, "cell long, other long, n double").groupBy("cell", "other").agg(F.sum("n").alias("n"))
        own = n.where("cell = other").select("cell", F.col("n").alias("own"))
        edges = n.where("cell < other").join(own, "cell").join(own.select(F.col("cell").alias("other"), F.col("own").alias("theirs")), "other")
        edges = edges.where((F.col("n") > s.overlap * F.col("own")) & (F.col("n") > s.overlap * F.col("theirs"))).join(self._pairs(foot), ["cell", "other"])
        edges = self.write(edges.select(F.col("cell").alias("a"), F.col("other").alias("b")), "merging")
        if edges.isEmpty():
            return None
        group = self.write(minimum_labels(edges).select(F.col("node").alias("cell"), "label"), "groups")
        one, two = group.join(trace, "cell"), group.join(trace, "cell").select(F.col("cell").alias("other"), "label", "chunk", F.col("c").alias("d"))
        dot = F.aggregate(F.zip_with("c", "d", lambda x, y: x * y), F.lit(0.0), lambda u, x: u + x)
        times = one.join(two, ["label", "chunk"]).groupBy("label", "cell", "other").agg(F.sum(dot).alias("h"))
        weights = self._pairs(foot.join(group, "cell", "left_semi"))
        rows = times.join(weights, ["cell", "other"], "left").fillna(0.0, ["g"])

        def factor(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = np.unique(pdf["cell"])
            g, h = (pdf.pivot_table(index="cell", columns="other", values=v, fill_value=0.0).reindex(index=cells, columns=cells, fill_value=0.0).to_numpy() for v in ("g", "h"))
            alpha = beta = np.full(len(cells), 1 / len(cells))
            for _ in range(100):  # turns of a = M c / |c|^2 and c = M' a / |a|^2 for M = sum of a_k c_k'
                alpha = h @ beta / max(beta @ h @ beta, 1e-300)
                beta = g @ alpha / max(alpha @ g @ alpha, 1e-300)
            return pd.DataFrame({"label": pdf["label"].iloc[0], "cell": cells, "alpha": alpha, "beta": beta})

        mix = self.write(rows.groupBy("label").applyInPandas(factor, "label long, cell long, alpha double, beta double"), "mix")
        scaled = lambda c, w: F.transform(c, lambda x: x * F.col(w)).alias(c)
        summed = foot.join(mix, "cell").select("label", *BLOCK, scaled("a", "alpha"), F.transform("m", lambda x: x.cast("int")).alias("m"))
        summed = summed.groupBy("label", *BLOCK).agg(sum_arrays("a").alias("a"), F.transform(sum_arrays("m"), lambda x: x > 0).alias("m"))
        foot = foot.join(mix, "cell", "left_anti").unionByName(summed.withColumnRenamed("label", "cell"))
        joined = trace.join(mix, "cell").select("label", "chunk", "t", scaled("c", "beta")).groupBy("label", "chunk").agg(F.first("t").alias("t"), sum_arrays("c").alias("c"))
        return self.write(foot, "footprints"), self.write(trace.join(mix, "cell", "left_anti").unionByName(joined.withColumnRenamed("label", "cell")), "traces")

    def _supported(self, corr: DataFrame) -> DataFrame:
        """Footprints cut to, and supports grown to, each cell's connected region of correlation that overlaps its footprint most; it may
        reach into the next blocks."""
        s = self.set

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x0, y0 = pdf["x0"].min(), pdf["y0"].min()
            shape = (int((pdf["x0"] + pdf["nx"]).max() - x0), int((pdf["y0"] + pdf["ny"]).max() - y0))
            image, own = np.full(shape, -1.0), np.zeros(shape, bool)
            at = [(slice(r.x0 - x0, r.x0 - x0 + r.nx), slice(r.y0 - y0, r.y0 - y0 + r.ny)) for r in pdf.itertuples()]
            for k, r in zip(at, pdf.itertuples()):
                image[k] = np.asarray(r.corr).reshape(r.nx, r.ny)
                if r.a is not None:
                    own[k] = np.asarray(r.a).reshape(r.nx, r.ny) > 0
            region = supports(image.reshape(-1, 1), own.reshape(-1, 1), shape, s.cut, s.most / image.size)[:, 0].reshape(shape)
            rows = []
            for k, r in zip(at, pdf.itertuples()):
                m = region[k].ravel() > 0
                if m.any():
                    rows.append((r.bx, r.by, r.cell, np.where(m, 0.0 if r.a is None else np.asarray(r.a), 0.0), m))
            return pd.DataFrame(rows, columns=["bx", "by", "cell", "a", "m"])

        rows = corr.join(self.pixels.select(*BLOCK, "x0", "y0", "nx", "ny"), [*BLOCK])
        return self.write(rows.groupBy("cell").applyInPandas(run, _FOOT), "footprints")

    def refine(self, rounds: int) -> None:
        """Rounds of footprints and traces by turns, with merging and new supports."""
        s = self.set
        for k in range(rounds):
            self.foot, self.back = self._footprints(self.store, self.foot, self.trace, self.back)
            self.trace = self._traces(self.store, self.foot, self.trace, self.back)
            self.foot = self.foot.join(self.trace.select("cell").distinct(), "cell", "left_semi")
            if s.every and (k + 1) % s.every == 0:
                corr = self._correlations(self.foot, self.trace)
                joined = self._merged(self.foot, self.trace, corr)
                if joined is not None:
                    self.foot, self.trace = joined
                    corr = self._correlations(self.foot, self.trace)
                self.foot = self._supported(corr)
                self.trace = self.trace.join(self.foot.select("cell").distinct(), "cell", "left_semi")

    def residual(self) -> DataFrame:
        """The movie (t, x, y, v) without cells and background."""
        def run(tile: Tile, rows: pd.DataFrame) -> pd.DataFrame:
            b = np.asarray(rows["b"].iloc[0])
            some = rows[rows["cell"].notna()]
            v = tile.v - b[:, None]
            if len(some):
                r = _Rows(some, "a", "c")
                v = v - r.a.T @ r.c
            x, y = tile.places()
            return pd.DataFrame({"t": np.tile(tile.t, len(x)), "x": np.repeat(x, len(tile.t)), "y": np.repeat(y, len(tile.t)), "v": v.ravel()})

        cells = self.foot.select(*BLOCK, "cell", "a").join(self.trace.select("cell", "chunk", "c"), "cell") if self.foot is not None else None
        rows = self.store.keys().join(self.back, [*BLOCK])
        rows = rows.join(cells, [*BLOCK, "chunk"], "left") if cells is not None else rows.withColumns({"cell": F.lit(None).cast("long")})
        return self.store.with_rows(rows, "t long, x long, y long, v double", run)

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(cell, x, y, w), (cell, t, c), (x, y, b): footprints of norm 1, their traces, background."""
        place = [(F.col("x0") + F.floor(F.col("p") / F.col("ny"))).alias("x"), (F.col("y0") + F.col("p") % F.col("ny")).alias("y")]
        at = self.pixels.select(*BLOCK, "x0", "y0", "ny")
        b = self.back.join(at, [*BLOCK]).select("x0", "y0", "ny", F.posexplode("b").alias("p", "b")).select(*place, "b")
        if self.foot is None:
            return self.spark.createDataFrame([], "cell long, x long, y long, w double"), self.spark.createDataFrame([], "cell long, t long, c double"), b
        norm = self.foot.groupBy("cell").agg(F.sqrt(F.sum(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).where("norm > 0")
        w = self.foot.join(at, [*BLOCK]).select("cell", "x0", "y0", "ny", F.posexplode("a").alias("p", "w")).where("w > 0").select("cell", *place, "w").join(norm, "cell")
        c = self.trace.join(norm, "cell").select("cell", "norm", F.explode(F.arrays_zip("t", "c")).alias("z"))
        return w.select("cell", "x", "y", (F.col("w") / F.col("norm")).alias("w")), c.select("cell", F.col("z.t").alias("t"), (F.col("z.c") * F.col("norm")).alias("c")), b


def pure_of_gram(g: np.ndarray, cut: float) -> list[int]:
    """Successive projection over a Gram matrix: the vector with the largest residual in proportion to its norm, near ties by norm,
    while that proportion's root exceeds the cut."""
    left, norm, out = g.copy(), np.diag(g).copy(), []
    while len(out) < len(g):
        share = np.divide(np.maximum(np.diag(left), 0), norm, out=np.zeros(len(g)), where=norm > 0)
        if np.sqrt(share.max()) <= cut:
            break
        near = np.flatnonzero(share >= share.max() * (1 - 1e-6))
        k = int(near[norm[near].argmax()])
        if left[k, k] < 1e-12 * norm[k]:
            break
        out.append(k)
        left = left - np.outer(left[:, k], left[k]) / left[k, k]
    return out


def _bright(movie: DataFrame, deviations: float) -> DataFrame:
    """What of each pixel exceeds its median by so many median absolute deviations."""
    rows = threshold_mad(movie.select((F.col("x") * WIDE + F.col("y")).alias("pix"), "t", "v"), deviations)
    return rows.select("t", F.floor(F.col("pix") / WIDE).alias("x"), (F.col("pix") % WIDE).alias("y"), "v")


def demix(movie: DataFrame, cuts: tuple[float, ...] = (0.95, 0.9), lengths: tuple[int, ...] = (15, 10), deviations: tuple[float, ...] = (2, 1), residual: tuple[float, ...] = (0.6, 0.6), settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(footprints (cell, x, y, w), traces (cell, t, c), background (x, y, b)) of a movie (t, x, y, v), in a pass for each of cuts.

    A pass takes what the cells so far leave, keeps what of each pixel exceeds its median by so many deviations, joins neighbours that
    correlate above the cut to superpixels of more than so many pixels, takes those that the others of their patch don't explain as
    new cells, and refines all cells on the whole movie. Footprints are nonnegative with norm 1, traces nonnegative; a movie with
    negative values is lifted by each pixel's least one. Without superpixels there are no cells.
    """
    s = settings or Settings()
    d = Demixer(movie, s)
    d.back = d.pixels.select(*BLOCK, "b")
    for k, cut in enumerate(cuts):
        now = d.write(d.residual(), "residual") if d.foot is not None else d.movie
        bright = d.write(_bright(now, deviations[k]), "bright") if k or deviations[k] >= 0 else now
        found = d.seeds(bright, cut, lengths[k], residual[k], k)
        if found is None:
            continue
        foot, trace = found
        d.foot = d.write(foot if d.foot is None else d.foot.unionByName(foot), "footprints")
        d.trace = d.write(trace if d.trace is None else d.trace.unionByName(trace), "traces")
        d.refine(s.last_rounds if k == len(cuts) - 1 else s.rounds)
    return d.tables()
