"""Per-pixel operators on movies: camera correction, small stencils, masks, rescaling. Rows are (t, x, y, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import sent

EPS, FLOOR = 1e-12, 1e-6


def calibrate(movie: DataFrame, camera: DataFrame) -> DataFrame:
    """(v - off) / (gain + EPS) by a join on the pixel, broadcast where the camera's bytes allow; FLOOR where the gain is
    below 0.5 or above 5 or the result isn't positive."""
    v = (F.col("v") - F.col("off")) / (F.col("gain") + EPS)
    bad = (F.col("gain") < 0.5) | (F.col("gain") > 5) | (v <= 0)
    return movie.join(sent(camera), ["x", "y"]).select("t", "x", "y", F.when(bad, FLOOR).otherwise(v).alias("v"))


def gain_fit(levels: DataFrame) -> DataFrame:
    """Through-origin regression of variance on mean over light levels, level 0 subtracted; 0 if any rise is negative."""
    dark = levels.where("lvl = 0").select("pix", F.col("mean").alias("m0"), F.col("var").alias("v0"))
    d = levels.where("lvl > 0").join(dark, "pix").select("pix", (F.col("mean") - F.col("m0")).alias("m"), (F.col("var") - F.col("v0")).alias("v"))
    gain = F.try_divide(F.sum(F.col("m") * F.col("v")), F.sum(F.col("m") * F.col("m")))
    return d.groupBy("pix").agg(F.when(F.min("v") < 0, 0.0).otherwise(gain).alias("gain"))


def _reflect(c: Column, n: int | Column) -> Column:
    """Edge cells repeat: -1 is 0, n is n - 1."""
    return F.when(c < 0, -c - 1).when(c >= n, 2 * n - 1 - c).otherwise(c)


def stencil(movie: DataFrame, nx: int, ny: int, use) -> DataFrame:
    """use of the 3 x 3 neighbourhood of every pixel with repeated edges: an array of nine values, row by row, the pixel's own in the
    middle. A frame's rows travel as arrays: one shuffle of values, one of each row to its neighbours. Whole frames are expected."""
    rows = movie.groupBy("t", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda s: s["v"]).alias("row"))
    steps = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    near = rows.withColumn("step", steps).select("t", "row", F.col("x").alias("of"), (F.col("x") - F.col("step")).cast("int").alias("x"), "step").where(F.col("x").between(0, nx - 1))
    # the first and the last row stand for the ones beyond the edge as well
    edge = rows.where((F.col("x") == 0) | (F.col("x") == nx - 1)).withColumn("step", F.explode(F.when((F.col("x") == 0) & (F.col("x") == nx - 1), F.array(F.lit(-1), F.lit(1))).when(F.col("x") == 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(1)))))
    edge = edge.select("t", "row", F.col("x").alias("of"), F.col("x").cast("int").alias("x"), "step")
    three = near.union(edge).groupBy("t", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "row"))), lambda s: s["row"]).alias("rows"))
    pick = lambda row, y: F.array(*[F.get(row, _reflect(y + k, F.lit(ny))) for k in (-1, 0, 1)])
    around = F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda y: F.struct(y.alias("y"), F.flatten(F.transform("rows", lambda row: pick(row, y))).alias("near")))
    return three.select("t", F.col("x").cast("long").alias("x"), F.explode(around).alias("p")).select("t", "x", F.col("p.y").cast("long").alias("y"), use(F.col("p.near")).alias("v"))


def median3x3(movie: DataFrame, nx: int, ny: int) -> DataFrame:
    return stencil(movie, nx, ny, lambda near: F.get(F.array_sort(near), F.lit(4)))


def dead_pixel_boxcar(movie: DataFrame, nx: int, ny: int, factor: float = 100.0) -> DataFrame:
    """Replace pixels below factor times the frame's least neighbour mean by their neighbour mean."""
    others = lambda near: sum((F.get(near, F.lit(k)) for k in (0, 1, 2, 3, 5, 6, 7, 8)), F.lit(0.0)) / 8
    mean = stencil(movie, nx, ny, others).withColumnRenamed("v", "m")
    low = F.min("m").over(Window.partitionBy("t"))
    both = movie.join(mean, ["t", "x", "y"]).withColumn("low", low)
    return both.select("t", "x", "y", F.when(F.col("v") < factor * F.col("low"), F.col("m")).otherwise(F.col("v")).alias("v"))


def rescale_uint16(movie: DataFrame, top: int = 65535) -> DataFrame:
    """Min-max scale to 0..top, cut to integers; one global aggregate of two numbers, joined by broadcast."""
    s = movie.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return movie.join(F.broadcast(s)).select("t", "x", "y", F.try_divide((F.col("v") - F.col("lo")) * top, F.col("hi") - F.col("lo")).cast("int").alias("v"))


def bin_sum(movie: DataFrame, b: int) -> DataFrame:
    """Sum pooling by b; the column band comes first."""
    return movie.groupBy("t", F.floor(F.col("y") / b).alias("x"), F.floor(F.col("x") / b).alias("y")).agg(F.sum("v").alias("v"))


def downscale_zscore(movie: DataFrame, f: int) -> DataFrame:
    """Block means, each frame standardised and put on [0, 1]."""
    m = movie.groupBy("t", F.floor(F.col("x") / f).alias("x"), F.floor(F.col("y") / f).alias("y")).agg(F.avg("v").alias("v"))
    w = Window.partitionBy("t")
    z = m.withColumn("z", F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)))
    return z.select("t", "x", "y", F.try_divide(F.col("z") - F.min("z").over(w), F.max("z").over(w) - F.min("z").over(w)).alias("v"))


def crop(movie: DataFrame, x0: int, y0: int, size: int) -> DataFrame:
    inside = F.col("x").between(x0, x0 + size - 1) & F.col("y").between(y0, y0 + size - 1)
    return movie.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def intensity_mask(movie: DataFrame, percent: float) -> DataFrame:
    """(t, x, y, keep): v above the frame's percentile."""
    p = movie.groupBy("t").agg(F.percentile("v", percent / 100).alias("p"))
    return movie.join(p, "t").select("t", "x", "y", (F.col("v") > F.col("p")).alias("keep"))


def masked(movie: DataFrame, mask: DataFrame) -> DataFrame:
    """v inside the mask, 0 elsewhere."""
    return movie.join(sent(mask), ["x", "y"], "left").select("t", "x", "y", F.when(F.col("keep"), F.col("v")).otherwise(0.0).alias("v"))


def reference_image(movie: DataFrame, first: int, last: int) -> DataFrame:
    """Mean over frames first to last - 1; the range of t is pushed to the scan."""
    return movie.where(F.col("t").between(first, last - 1)).groupBy("x", "y").agg(F.avg("v").alias("v"))


def summary_images(movie: DataFrame) -> DataFrame:
    return movie.groupBy("x", "y").agg(F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.min("v").alias("v_min"))


def pad(movie: DataFrame, nx: int, ny: int, dx: int, dy: int, fill: float) -> DataFrame:
    """The movie put at (dx, dy) of nx by ny frames of a constant."""
    grid = movie.select("t").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    moved = movie.select("t", (F.col("x") + dx).cast("int").alias("x"), (F.col("y") + dy).cast("int").alias("y"), "v")
    return grid.join(moved, ["t", "x", "y"], "left").select("t", "x", "y", F.coalesce("v", F.lit(fill)).alias("v"))


def unpad(movie: DataFrame) -> DataFrame:
    """Without columns, then rows, that hold NaN alone."""
    ok = ~F.isnan("v")
    kept = movie.withColumn("a", F.max(ok.cast("int")).over(Window.partitionBy("t", "y"))).where("a = 1")
    return kept.withColumn("b", F.max(ok.cast("int")).over(Window.partitionBy("t", "x"))).where("b = 1").drop("a", "b")


def localization_hist(points: DataFrame, chunk: int) -> DataFrame:
    """1 + hits of a cell in the last chunk of points (i, px, py) that touched it."""
    n = points.groupBy(F.floor("px").alias("x"), F.floor("py").alias("y"), F.floor(F.col("i") / chunk).alias("c")).agg(F.count("*").alias("n"))
    return n.groupBy("x", "y").agg((F.max_by("n", "c") + 1).alias("v"))


def polygon_roi(pixels: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Pixels inside a polygon, by the parity of edges crossed to the right."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:
            spans = (F.lit(float(ay)) > F.col("y")) != (F.lit(float(by)) > F.col("y"))
            crossings = crossings + (spans & (F.col("x") < (bx - ax) * (F.col("y") - ay) / (by - ay) + ax)).cast("int")
    return pixels.where(crossings % 2 == 1)
