"""Spatial operators: correlations of neighbours, superpixels, components, tiles and their blend."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt, ship
from ..workspace import Workspace, sent
HALF4 = ((1, 0), (0, 1), (1, -1), (1, 1))
FOUR = ((1, 0), (0, 1), (-1, 0), (0, -1))
EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))


def zscore(movie: DataFrame, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    s = movie.groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return movie.join(sent(s), [*keys]).select("t", *keys, F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0)).alias("v"))


def pair_correlation(movie: DataFrame, steps: tuple[tuple[int, ...], ...], keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(keys, keys2, r): Pearson r of each pixel and its neighbours; constant pixels give 0. Frames are dealt to tasks once, whole; there
    each value is given to its own pixel and to those that look at it, and summed beside theirs, so that pixels which come repeatedly
    in a frame take a row each and not one for each pair of them."""
    names, places = ["t", *keys], [(0,) * len(keys), *steps]
    z = zscore(movie, keys).where(" AND ".join(f"{n} IS NOT NULL" for n in names)).repartition(dealt(movie.sparkSession), "t")
    place = lambda i, s: F.struct(F.lit(i).alias("i"), *[F.lit(d).alias(k) for k, d in zip(keys, s)])
    given = z.withColumn("d", F.explode(F.array(*[place(i, s) for i, s in enumerate(places)]))).select("t", "v", "d.i", *[(F.col(k) - F.col(f"d.{k}")).alias(k) for k in keys])
    at = lambda i, c: F.when(F.col("i") == i, F.col(c))
    seen = given.groupBy(*names).agg(*[f for i in range(len(places)) for f in (F.sum(at(i, "v")).alias(f"v{i}"), F.count(at(i, "i")).alias(f"n{i}"))])
    pairs = F.explode(F.array(*[F.struct(*[(F.col(k) + d).alias(f"{k}2") for k, d in zip(keys, s)], F.col(f"v{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, s in enumerate(steps, 1)])).alias("p")
    met = seen.where("n0 > 0").select(*keys, "v0", "n0", pairs).select(*keys, "v0", "n0", "p.*").where("n > 0")
    return met.groupBy(*keys, *[f"{k}2" for k in keys]).agg((F.sum(F.col("v0") * F.col("r")) / F.sum(F.col("n0") * F.col("n"))).alias("r"))


def local_correlation(movie: DataFrame, steps: tuple[tuple[int, ...], ...] = EIGHT) -> DataFrame:
    """Mean correlation of a pixel with its neighbours."""
    return pair_correlation(movie, steps).groupBy("x", "y").agg(F.avg("r").alias("v"))


def superpixel_edges(movie: DataFrame, cut: float, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    steps = HALF4 if len(keys) == 2 else tuple((*s, 0) for s in HALF4) + ((0, 0, 1),)
    return pair_correlation(movie, steps, keys).where(F.col("r") > cut)


def minimum_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the least node reachable, by alternating steps that hang neighbours on the least of them.

    edges: (a, b) of longs; loops and repeats do no harm. Each round's table is written to the shared folder, so a lost executor
    costs only reading it again, and the table before goes.
    """
    work = Workspace(edges.sparkSession, "labels")
    now, mark = work.write(edges.select("a", "b").where("a <> b"), "edges-0"), None
    for k in range(1, max_rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = up.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = work.write(hung.where("a <> b").distinct(), f"edges-{k}")
        work.drop(f"edges-{k - 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = seen
    raise RuntimeError("labels still change")


def superpixel_labels(movie: DataFrame, cut: float, nx: int, least: int = 1, keys: tuple[str, ...] = ("x", "y"), ny: int = 1) -> DataFrame:
    """(pix, label) of the superpixels with more than least pixels; label is the least pixel number."""
    number = lambda s="": F.col(f"x{s}") + nx * F.col(f"y{s}") + (nx * ny * F.col(f"z{s}") if len(keys) == 3 else 0)
    e = superpixel_edges(movie, cut, keys).select(number().cast("long").alias("a"), number("2").cast("long").alias("b"))
    found = minimum_labels(e)
    size = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return found.join(size, "label").select(F.col("node").alias("pix"), "label")


def component_correlation(movie: DataFrame, traces: DataFrame, block: int = 16, cells: int = 256, frames: int = 2048) -> DataFrame:
    """(x, y, cell, r): Pearson r of every pixel with every component's trace (cell, t, c), 0 without variation.

    Blocks of block x block pixels meet groups of about so many cells, a chunk of frames at a time, and are multiplied as matrices, so
    that what is shuffled is each block once a group of cells, not each sample once a pixel and cell. Sums are centred within a chunk,
    and chunks are joined by their means. Frames that either lacks count as missing.
    """
    ship(movie.sparkSession)
    groups = max(1, -(-traces.select("cell").distinct().count() // cells))
    chunk = F.floor(F.col("t") / frames).alias("chunk")
    blocks = movie.select(F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by")).distinct()
    left = movie.select("t", "x", "y", "v", chunk, F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = traces.select("t", "cell", "c", chunk, F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("int").alias("g")).crossJoin(sent(blocks))
    sums = ["n", "mp", "mq", "pp", "qq", "pq"]

    def run(m: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(c):
            return pd.DataFrame({n: [] for n in ["x", "y", "cell", *sums]})
        a = m.pivot_table(index=["x", "y"], columns="t", values="v", aggfunc="first")
        b = c.pivot_table(index="cell", columns="t", values="c", aggfunc="first")
        t = a.columns.intersection(b.columns)
        a, b = a[t], b[t]
        u, w = a.notna().to_numpy(float), b.notna().to_numpy(float)
        p, q = np.nan_to_num(a.to_numpy(float)), np.nan_to_num(b.to_numpy(float))
        low_p, low_q = p.sum(1, keepdims=True) / np.maximum(u.sum(1, keepdims=True), 1), q.sum(1, keepdims=True) / np.maximum(w.sum(1, keepdims=True), 1)
        p, q = (p - low_p) * u, (q - low_q) * w
        n = u @ w.T
        mp, mq = p @ w.T / np.maximum(n, 1), u @ q.T / np.maximum(n, 1)
        values = [n, mp + low_p, mq + low_q.T, (p * p) @ w.T - n * mp**2, u @ (q * q).T - n * mq**2, p @ q.T - n * mp * mq]
        i, k = (z.ravel() for z in np.indices(n.shape))
        xy = np.array(a.index.tolist())
        return pd.DataFrame({"x": xy[i, 0], "y": xy[i, 1], "cell": b.index.to_numpy()[k], **{s: z.ravel() for s, z in zip(sums, values)}})

    keys = ["bx", "by", "g", "chunk"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "x long, y long, cell long, " + ", ".join(f"{s} double" for s in sums))
    n = F.sum("n")
    mean = {c: F.try_divide(F.sum(F.col("n") * F.col(c)), n) for c in ("mp", "mq")}
    total = parts.groupBy("x", "y", "cell").agg(n.alias("n"), *[m.alias(c) for c, m in mean.items()], F.collect_list(F.struct(*sums)).alias("parts"))
    joined = lambda within, a, b: F.aggregate("parts", F.lit(0.0), lambda s, z: s + z[within] + z["n"] * (z[a] - F.col(a)) * (z[b] - F.col(b)))
    total = total.select("x", "y", "cell", "n", "mp", "mq", joined("pp", "mp", "mp").alias("pp"), joined("qq", "mq", "mq").alias("qq"), joined("pq", "mp", "mq").alias("pq"))
    flat = F.coalesce((F.col("pp") <= 1e-24 * F.col("n") * F.col("mp") ** 2) | (F.col("qq") <= 1e-24 * F.col("n") * F.col("mq") ** 2), F.lit(True))
    return total.select("x", "y", "cell", F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(F.col("pq"), F.sqrt("pp") * F.sqrt("qq")), F.lit(0.0))).alias("r"))


def brightness_rank(components: DataFrame, traces: DataFrame) -> DataFrame:
    """(cell, brightness, rank): max weight times max trace, the brightest 0."""
    a = components.groupBy("cell").agg(F.max("w").alias("u"), F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    c = traces.groupBy("cell").agg(F.max("c").alias("m"))
    b = a.join(c, "cell").withColumn("brightness", F.col("u") * F.col("m"))
    return b.select("cell", "norm", "brightness", (F.row_number().over(Window.orderBy(F.desc("brightness"), "cell")) - 1).alias("rank"))


def component_overlap(components: DataFrame) -> DataFrame:
    """(a, b, dot, shared) for components that share pixels: an equality join on the pixel."""
    right = components.select("x", "y", F.col("cell").alias("b"), F.col("w").alias("v"))
    return components.withColumnRenamed("cell", "a").join(right, ["x", "y"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.count("*").alias("shared"))


def merge_pairs(components: DataFrame, share: float) -> DataFrame:
    """Pairs whose shared pixels exceed the share of both."""
    n = components.groupBy("cell").agg(F.count("*").alias("n"))
    o = component_overlap(components).join(n.select(F.col("cell").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("cell").alias("b"), F.col("n").alias("nb")), "b")
    return o.where((F.col("shared") > share * F.col("na")) & (F.col("shared") > share * F.col("nb"))).select("a", "b", "shared", "na", "nb")


def residual(movie: DataFrame, components: DataFrame, traces: DataFrame) -> DataFrame:
    """v less the sum of w * c over the components of a pixel."""
    model = components.join(traces, "cell").groupBy("t", "x", "y").agg(F.sum(F.col("w") * F.col("c")).alias("m"))
    return movie.join(model, ["t", "x", "y"], "left").select("t", "x", "y", (F.col("v") - F.coalesce("m", F.lit(0.0))).alias("v"))


def ls_unmix_2(movie: DataFrame, components: DataFrame, a: int, b: int) -> DataFrame:
    """(t, ca, cb): least-squares traces of two components, by their normal equations."""
    w = components.groupBy("x", "y").agg(F.coalesce(F.sum(F.when(F.col("cell") == a, F.col("w"))), F.lit(0.0)).alias("wa"), F.coalesce(F.sum(F.when(F.col("cell") == b, F.col("w"))), F.lit(0.0)).alias("wb"))
    g = w.agg(F.sum(F.col("wa") ** 2).alias("aa"), F.sum(F.col("wa") * F.col("wb")).alias("ab"), F.sum(F.col("wb") ** 2).alias("bb"))
    y = movie.join(sent(w), ["x", "y"]).groupBy("t").agg(F.sum(F.col("wa") * F.col("v")).alias("ya"), F.sum(F.col("wb") * F.col("v")).alias("yb"))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    return y.join(F.broadcast(g)).select("t", F.try_divide(F.col("bb") * F.col("ya") - F.col("ab") * F.col("yb"), det).alias("ca"), F.try_divide(F.col("aa") * F.col("yb") - F.col("ab") * F.col("ya"), det).alias("cb"))


def combine_cells(components: DataFrame, traces: DataFrame) -> DataFrame:
    """(cell, x0, y0, nx, ny, activity) of cells with any activity."""
    box = components.groupBy("cell").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("nx"), (F.max("y") - F.min("y") + 1).alias("ny"))
    act = traces.groupBy("cell").agg(F.sum(F.abs("c")).alias("activity")).where("activity > 0")
    return box.join(act, "cell")


def layer_mosaic(components: DataFrame) -> DataFrame:
    """The component of largest weight of each pixel."""
    return components.groupBy("x", "y").agg(F.max_by("cell", F.struct("w", -F.col("cell"))).alias("cell"))


def tile_of(c: Column, n: int, parts: int) -> Column:
    """The section of n near-equal ones that a coordinate lies in; the first n % parts are one longer."""
    base, longer = n // parts, n % parts
    return F.when(c < longer * (base + 1), F.floor(c / (base + 1))).otherwise(longer + F.floor((c - longer * (base + 1)) / base))


def edges_of(n: int, parts: int) -> list[int]:
    base, longer = n // parts, n % parts
    out = [0]
    for k in range(parts):
        out.append(out[-1] + base + (k < longer))
    return out


def offset_edges(n: int, parts: int) -> list[int]:
    """Edges of the half-tile grid: from the middle of the first tile to the middle of the last, inner edges between."""
    e = edges_of(n, parts)
    first, last = e[1] - -(-(e[1] - e[0]) // 2), e[-1] - -(-(e[-1] - e[-2]) // 2)
    return [first, *[x for x in e[2:-2] if first < x < last], last] if parts > 1 else [0, n]


def tiles(movie: DataFrame, nx: int, ny: int, parts: int, grids: tuple[str, ...] = ("base", "r", "c", "rc")) -> DataFrame:
    """Each voxel once for every grid that covers it, with its tile and its place in the tile: (grid, tile, px, py, w, h, border)."""
    rows = []
    for g in grids:
        ex = offset_edges(nx, parts) if "r" in g and g != "base" else edges_of(nx, parts)
        ey = offset_edges(ny, parts) if "c" in g else edges_of(ny, parts)
        rows += [(g, i * (len(ey) - 1) + j, ex[i], ex[i + 1] - 1, ey[j], ey[j + 1] - 1) for i in range(len(ex) - 1) for j in range(len(ey) - 1)]
    spark = movie.sparkSession
    t = spark.createDataFrame(rows, "grid string, tile int, x0 int, x1 int, y0 int, y1 int")
    cells = t.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    border = (F.col("grid") == "base") & ((F.col("x") == 0) | (F.col("x") == nx - 1) | (F.col("y") == 0) | (F.col("y") == ny - 1))
    cells = cells.select("grid", "tile", "x", "y", (F.col("x") - F.col("x0")).alias("px"), (F.col("y") - F.col("y0")).alias("py"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"), border.alias("border"))
    return movie.join(sent(cells), ["x", "y"])


def pyramid(px: Column, py: Column, w: Column, h: Column) -> Column:
    """Weight 0 at a tile's border, 1 at its centre; 0 in tiles of up to two pixels."""
    top = F.least(F.floor((w - 1) / 2), F.floor((h - 1) / 2))
    return F.coalesce(F.try_divide(F.least(px, w - 1 - px, py, h - 1 - py).cast("double"), top.cast("double")), F.lit(0.0))


def tile_blend(tiled: DataFrame) -> DataFrame:
    """Weighted mean over grids, by pyramids; the outer border of the base grid has weight 1."""
    weight = F.when(F.col("border"), 1.0).otherwise(pyramid(F.col("px"), F.col("py"), F.col("w"), F.col("h")))
    return tiled.withColumn("p", weight).groupBy("t", "x", "y").agg(F.try_divide(F.sum(F.col("p") * F.col("v")), F.sum("p")).alias("v"))


def overlap_add(movie: DataFrame, nx: int, parts: int, overlap: int) -> DataFrame:
    """Blocks along x widened by overlap, added up: sum, cover count and mean of each voxel."""
    e = edges_of(nx, parts)
    blocks = movie.sparkSession.createDataFrame([(k, max(0, e[k] - overlap), min(nx, e[k + 1] + overlap) - 1) for k in range(parts)], "block int, a int, b int").withColumn("x", F.explode(F.sequence("a", "b")))
    return movie.join(sent(blocks.select("block", "x")), "x").groupBy("t", "x", "y").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.avg("v").alias("v"))


def tile_rank(pixels: DataFrame, ranks: DataFrame, nx: int, ny: int, parts: int) -> DataFrame:
    """Each pixel with the rank of its tile."""
    tile = tile_of(F.col("x"), nx, parts) * parts + tile_of(F.col("y"), ny, parts)
    return pixels.withColumn("tile", tile.cast("int")).join(sent(ranks), "tile").select("x", "y", "rank")


def halo_tiles(movie: DataFrame, size: int, margin: int, nx: int, ny: int) -> DataFrame:
    """Each voxel once for every tile of size x size pixels whose margin reaches it, with the tile (bx, by) and whether it is the
    tile's own: one shuffle on the tile serves any operator that looks at most `margin` pixels away."""
    tiles_at = lambda c, n: F.sequence(F.floor(F.greatest(c - margin, F.lit(0)) / size), F.floor(F.least(c + margin, F.lit(n - 1)) / size))
    spread = movie.withColumn("bx", F.explode(tiles_at(F.col("x"), nx))).withColumn("by", F.explode(tiles_at(F.col("y"), ny)))
    return spread.withColumn("own", (F.floor(F.col("x") / size) == F.col("bx")) & (F.floor(F.col("y") / size) == F.col("by")))


def stitched(tiles_: DataFrame) -> DataFrame:
    """The movie of tiles with margins: each tile's own voxels."""
    return tiles_.where("own").drop("own", "bx", "by")


def edge_padded(movie: DataFrame, margin: int, nx: int, ny: int) -> DataFrame:
    """Frames with a margin that repeats the edge, from place 0 on."""
    copies = lambda c, n: F.when((c == 0) & (c == n - 1), F.sequence(F.lit(0), F.lit(2 * margin + n - 1))).when(c == 0, F.sequence(F.lit(0), F.lit(margin))).when(c == n - 1, F.sequence(F.lit(margin + n - 1), F.lit(2 * margin + n - 1))).otherwise(F.array((c + margin).cast("int")))
    wide = movie.withColumn("x2", F.explode(copies(F.col("x"), nx))).withColumn("y2", F.explode(copies(F.col("y"), ny)))
    return wide.select("t", F.col("x2").cast("long").alias("x"), F.col("y2").cast("long").alias("y"), "v")


def bridged(movie: DataFrame, margin: int, nx: int) -> DataFrame:
    """Frames with margins along x between the values of their first and last rows, in steps of a (2 margin + 1)-th of the difference:
    1, margin, ... 2 steps before the frame, margin + 1, ... 2 margin after it."""
    first = movie.where("x = 0").select("t", "y", F.col("v").alias("a"))
    last = movie.where(F.col("x") == nx - 1).select("t", "y", F.col("v").alias("b"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2 * margin - 1))).alias("k")
    step = F.when(F.col("k") == 0, 1).when(F.col("k") < margin, margin + 1 - F.col("k")).otherwise(F.col("k") + 1)
    place = F.when(F.col("k") < margin, F.col("k")).otherwise(F.col("k") + nx)
    between = first.join(last, ["t", "y"]).select("*", k).select("t", place.cast("long").alias("x"), "y", (F.col("a") + step * (F.col("b") - F.col("a")) / (2 * margin + 1)).alias("v"))
    return movie.select("t", (F.col("x") + margin).alias("x"), "y", "v").union(between)


def merge_components(components: DataFrame, traces: DataFrame, share: float, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(components, traces) with those that share more than `share` of both their pixels, directly or through others, replaced by one
    nonnegative rank-1 factorisation of their sum, named by the least of them. A group of components is one task's."""
    from ..functions.factor import nmf

    ship(components.sparkSession)
    names = minimum_labels(merge_pairs(components, share).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    own = components.join(sent(names.withColumnRenamed("node", "cell")), "cell", "left").withColumn("label", F.coalesce("label", F.col("cell").cast("long")))
    seen = traces.join(sent(names.withColumnRenamed("node", "cell")), "cell", "left").withColumn("label", F.coalesce("label", F.col("cell").cast("long")))
    kind = "label long, part string, x long, y long, t long, v double"

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        left = a.pivot_table(index=["x", "y"], columns="cell", values="w", aggfunc="sum", fill_value=0.0)
        right = c.pivot_table(index="t", columns="cell", values="c", aggfunc="sum", fill_value=0.0).reindex(columns=left.columns, fill_value=0.0)
        u, v = left.to_numpy(float), right.to_numpy(float).T
        if u.shape[1] > 1:
            m = np.maximum(u @ v, 0)
            u, v = nmf(m, u.mean(1)[:, None], np.maximum(v, 0).mean(0)[None], rounds)
        label, xy = int(a["label"].iloc[0]), np.array(left.index.tolist())
        return pd.concat([pd.DataFrame({"label": label, "part": "w", "x": xy[:, 0], "y": xy[:, 1], "t": 0, "v": u[:, 0]}), pd.DataFrame({"label": label, "part": "c", "x": 0, "y": 0, "t": right.index.to_numpy(), "v": v[0]})])

    out = Workspace(components.sparkSession, "merged").write(own.groupBy("label").cogroup(seen.groupBy("label")).applyInPandas(run, kind), "cells")
    return out.where("part = 'w' AND v <> 0").select(F.col("label").alias("cell"), "x", "y", F.col("v").alias("w")), out.where("part = 'c'").select(F.col("label").alias("cell"), "t", F.col("v").alias("c"))


def delete_components(components: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, traces) without those whose weights or whose traces are all 0."""
    kept = components.groupBy("cell").agg(F.max(F.abs("w")).alias("m")).where("m > 0").select("cell").join(traces.groupBy("cell").agg(F.max(F.abs("c")).alias("m")).where("m > 0").select("cell"), "cell")
    return components.join(kept, "cell", "left_semi"), traces.join(kept, "cell", "left_semi")


def patch_labels(labels: DataFrame, nx: int, size: int) -> DataFrame:
    """(px, py, label): the superpixels that reach into each patch of size x size pixels; pix is x + nx y."""
    x, y = F.col("pix") % nx, F.floor(F.col("pix") / nx)
    return labels.select(F.floor(x / size).alias("px"), F.floor(y / size).alias("py"), "label").distinct()
