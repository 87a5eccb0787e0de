"""Time-series operators on traces: rows (pix, t, v), one window or aggregate over a pixel's rows each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import sent


def by_t():
    return Window.partitionBy("pix").orderBy("t")


def with_stats(trace: DataFrame, **stats: Column) -> DataFrame:
    """Per-pixel aggregates beside every row: partial aggregation, then a join on the pixel."""
    return trace.join(trace.groupBy("pix").agg(*[c.alias(n) for n, c in stats.items()]), "pix")


def with_mad(trace: DataFrame) -> DataFrame:
    """Median and unscaled median absolute deviation beside every row."""
    m = with_stats(trace, med=F.percentile("v", 0.5))
    mad = m.groupBy("pix").agg(F.percentile(F.abs(F.col("v") - F.col("med")), 0.5).alias("mad"))
    return m.join(mad, "pix")


def threshold_mad(trace: DataFrame, th: float) -> DataFrame:
    return with_mad(trace).select("pix", "t", F.greatest(F.lit(0.0), F.col("v") - (F.col("med") + th * F.col("mad"))).alias("v"))


def thresh_mad_zero(trace: DataFrame, k: float) -> DataFrame:
    return with_mad(trace).select("pix", "t", F.when(F.col("v") < F.col("med") + k * F.col("mad"), 0.0).otherwise(F.col("v")).alias("v"))


def mad_scale(trace: DataFrame, c: float = 0.6745) -> DataFrame:
    return with_mad(trace).select("pix", "t", F.try_divide((F.col("v") - F.col("med")) * c, F.col("mad")).alias("v"))


def min_correct(trace: DataFrame, every: int = 1) -> DataFrame:
    """v less the least of every so many samples of its trace."""
    return with_stats(trace, m=F.min(F.when(F.col("t") % every == 0, F.col("v")))).select("pix", "t", (F.col("v") - F.col("m")).alias("v"))


def temporal_decimate(trace: DataFrame, n: int) -> DataFrame:
    return trace.groupBy("pix", F.floor(F.col("t") / n).alias("t")).agg(F.avg("v").alias("v"))


def rolling_baseline(trace: DataFrame, window: int, percentile: float, downsample: int) -> DataFrame:
    """(pix, t, v, base): a rank filter over every downsample-th sample with repeated edges, then linear between and beyond them.

    The filter's frame reaches window // downsample // 2 back; the rank is floor(width * percentile / 100). Short traces are
    reflected as often as the frame needs.
    """
    d, width = downsample, window // downsample
    if width < 1:
        raise ValueError("the window is shorter than the downsampling")
    before, rank = width // 2, min(int(width * percentile / 100), width - 1)
    knots = trace.where(F.col("t") % d == 0).select("pix", (F.col("t") / d).cast("long").alias("k"), "v")
    arrays = knots.groupBy("pix").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("a"))
    n = F.size("a")
    fold = lambda i: F.when(F.pmod(i, 2 * n) < n, F.pmod(i, 2 * n)).otherwise(2 * n - 1 - F.pmod(i, 2 * n))
    frame = lambda k: F.transform(F.sequence(k - before, k + (width - 1 - before)), lambda i: F.get("a", fold(i)))
    smooth = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(F.array_sort(frame(k)), F.lit(rank)))
    based = arrays.select("pix", smooth.alias("b"))
    last = F.greatest(F.size("b") - 2, F.lit(0))
    i = F.least(F.floor(F.col("t") / d).cast("int"), last)
    left, right = F.get("b", i), F.coalesce(F.get("b", i + 1), F.get("b", i))
    return trace.join(based, "pix").select("pix", "t", "v", (left + (right - left) * (F.col("t") - i * d) / d).alias("base"))


def detrend(trace: DataFrame, window: int = 100, percentile: float = 20) -> DataFrame:
    b = rolling_baseline(trace, window, percentile, window // 40)
    return b.select("pix", "t", (F.col("v") - F.col("base")).alias("v"))


def cell_dff_qc(trace: DataFrame, min_f: float, window: int, percentile: float, downsample: int, dff_max: float) -> DataFrame:
    """F / baseline - 1 of cells whose largest F exceeds min_f, whose baseline stays positive and whose result stays under dff_max."""
    bright = with_stats(trace, top=F.max("v")).where(F.col("top") > min_f).select("pix", "t", "v")
    dff = rolling_baseline(bright, window, percentile, downsample).withColumn("dff", F.try_divide("v", "base") - 1)
    ok = with_stats(dff.select("pix", "t", "dff", "base"), most=F.max("dff"), low=F.min("base")).where((F.col("most") <= dff_max) & (F.col("low") > 0))
    return ok.select("pix", "t", F.col("dff").alias("v"))


def baseline_shift(trace: DataFrame, detrended: DataFrame, q: float = 0.003) -> DataFrame:
    """raw - detrended - min(0, quantile of raw)."""
    both = with_stats(trace, q=F.percentile("v", q)).join(detrended.withColumnRenamed("v", "d"), ["pix", "t"])
    return both.select("pix", "t", (F.col("v") - F.col("d") - F.least(F.lit(0.0), F.col("q"))).alias("v"))


def baseline_positive(base: DataFrame, trace: DataFrame, q: float = 0.003, least: float = 0.01) -> DataFrame:
    """A baseline kept positive: less min(0, quantile of raw); if its least is still not positive, less (least - 0.01)."""
    low = trace.groupBy("pix").agg(F.least(F.lit(0.0), F.percentile("v", q)).alias("q"))
    moved = base.join(low, "pix").select("pix", "t", (F.col("v") - F.col("q")).alias("v"))
    return with_stats(moved, m=F.min("v")).select("pix", "t", F.when(F.col("m") <= 0, F.col("v") - (F.col("m") - least)).otherwise(F.col("v")).alias("v"))


def roll_scale(trace: DataFrame, window: int, factor: float = 1.0) -> DataFrame:
    """(v - rolling median) / rolling sample deviation / factor over full centred frames; ends take the nearest full frame's."""
    w = by_t().rowsBetween(-(window // 2), window - 1 - window // 2)
    full = F.count("v").over(w) == window
    s = trace.withColumns({"m": F.when(full, F.percentile("v", 0.5).over(w)), "s": F.when(full, F.stddev_samp("v").over(w))})
    back, ahead = by_t().rowsBetween(Window.unboundedPreceding, 0), by_t().rowsBetween(0, Window.unboundedFollowing)
    near = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in ("m", "s")}
    return s.withColumns(near).select("pix", "t", F.try_divide(F.col("v") - F.col("m"), F.col("s") * factor).alias("v"))


def frame_dff(movie: DataFrame) -> DataFrame:
    """Per frame and row x: mean-centred mean signal over (mean - 5th percentile)."""
    r = movie.groupBy("t", "x").agg(F.avg("v").alias("m"), F.percentile("v", 0.05).alias("p"))
    g = movie.groupBy("x").agg(F.avg("v").alias("g"))
    return r.join(F.broadcast(g), "x").select("t", "x", F.try_divide(F.col("m") - F.col("g"), F.col("m") - F.col("p")).alias("v"))


def linear_detrend(trace: DataFrame) -> DataFrame:
    """v less its regression on t, plus its mean."""
    s = with_stats(trace, slope=F.regr_slope("v", "t"), icept=F.regr_intercept("v", "t"), m=F.avg("v"))
    return s.select("pix", "t", (F.col("v") - F.col("icept") - F.col("slope") * F.col("t") + F.col("m")).alias("v"))


def poly_detrend(trace: DataFrame) -> DataFrame:
    """v less its projection on 1, t and t squared: a centred regression in closed form, from one pass of sums."""
    c = with_stats(trace, tm=F.avg("t"), vm=F.avg("v")).withColumns({"a": F.col("t") - F.col("tm"), "w": F.col("v") - F.col("vm")})
    q = with_stats(c.select("pix", "t", "a", "w"), m2=F.avg(F.col("a") ** 2), m3=F.avg(F.col("a") ** 3), m4=F.avg(F.col("a") ** 4), p1=F.avg(F.col("a") * F.col("w")), p2=F.avg(F.col("a") ** 2 * F.col("w")))
    det = F.col("m2") * (F.col("m4") - F.col("m2") ** 2) - F.col("m3") ** 2
    b1 = F.try_divide(F.col("p1") * (F.col("m4") - F.col("m2") ** 2) - F.col("m3") * F.col("p2"), det)
    b2 = F.try_divide(F.col("m2") * F.col("p2") - F.col("m3") * F.col("p1"), det)
    return q.select("pix", "t", (F.col("w") - b1 * F.col("a") - b2 * (F.col("a") ** 2 - F.col("m2"))).alias("v"))


def photobleach(trace: DataFrame, on: DataFrame, segment: int) -> DataFrame:
    """(pix, t, trend): per segment, a line fitted to the samples outside the stimulus (pix, t, on)."""
    s = trace.join(on, ["pix", "t"]).withColumn("seg", F.floor(F.col("t") / segment))
    off = F.when(~F.col("on"), F.col("v"))
    fit = s.groupBy("pix", "seg").agg(F.regr_slope(off, "t").alias("slope"), F.regr_intercept(off, "t").alias("icept"))
    return s.join(fit, ["pix", "seg"]).select("pix", "t", (F.col("icept") + F.col("slope") * F.col("t")).alias("trend"))


def autocov(trace: DataFrame, maxlag: int) -> DataFrame:
    """Biased autocovariance at lags 0..maxlag; negative lags mirror them."""
    c = with_stats(trace, m=F.avg("v")).select("pix", "t", (F.col("v") - F.col("m")).alias("v"))
    cols = [F.sum(F.col("v") * F.col(f"l{k}")) / F.count("*") for k in range(maxlag + 1)]
    led = c.withColumns({f"l{k}": F.lead("v", k).over(by_t()) if k else F.col("v") for k in range(maxlag + 1)})
    wide = led.groupBy("pix").agg(*[F.coalesce(x, F.lit(0.0)).alias(f"c{k}") for k, x in enumerate(cols)])
    return wide.select("pix", F.posexplode(F.array(*[f"c{k}" for k in range(maxlag + 1)])).alias("lag", "v"))


def second_diff(trace: DataFrame) -> DataFrame:
    d = 2 * F.col("v") - F.lag("v").over(by_t()) - F.lead("v").over(by_t())
    return trace.select("pix", "t", d.alias("v")).where("v IS NOT NULL")


def kurtosis_select(trace: DataFrame) -> DataFrame:
    """Traces whose excess kurtosis exceeds the mean plus the deviation of all."""
    k = trace.groupBy("pix").agg(F.kurtosis("v").alias("k"))
    s = k.agg((F.avg("k") + F.stddev_pop("k")).alias("th"))
    return k.join(F.broadcast(s)).where("k > th").select("pix", "k")


def outlier_flags(trace: DataFrame, k: float, buffer: int) -> DataFrame:
    """(pix, t, keep, jump): within k deviations of the median throughout +-buffer samples; jump marks the first kept after a gap."""
    s = with_stats(trace, med=F.percentile("v", 0.5), sd=F.stddev_pop("v"))
    ok = (F.abs(F.col("v") - F.col("med")) < k * F.col("sd")).cast("int")
    kept = s.withColumn("keep", F.min(ok).over(by_t().rowsBetween(-buffer, buffer)) == 1)
    return kept.select("pix", "t", "keep", (F.col("keep") & ~F.lag("keep", 1, True).over(by_t())).alias("jump"))


def islands(flags: DataFrame) -> DataFrame:
    """(pix, start, stop, n) of the runs of flag."""
    on = flags.where("flag").withColumn("g", F.col("t") - F.row_number().over(by_t()))
    return on.groupBy("pix", "g").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n")).drop("g")


def min_consec(flags: DataFrame, k: int) -> DataFrame:
    return islands(flags).where(F.col("n") >= k)


def connect_regions(flags: DataFrame, gap: int, buffer: int) -> DataFrame:
    """(pix, start, stop, n): breaches closer than gap joined into regions, widened by the buffer on both sides; a lone breach stays bare."""
    on = flags.where("flag")
    new = F.coalesce((F.col("t") - F.lag("t").over(by_t()) >= gap).cast("int"), F.lit(0))
    g = on.withColumn("new", new).withColumn("g", F.sum("new").over(by_t()))
    r = g.groupBy("pix", "g").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    wide = F.when(F.col("n") > 1, buffer).otherwise(0)
    return r.select("pix", F.greatest(F.col("a") - wide, F.lit(0)).alias("start"), (F.col("b") + wide).alias("stop"), "n")


def stim_mask(stim: DataFrame, delta: int, jump: float = 1.0) -> DataFrame:
    """(pix, t, on): within delta samples centred on a jump of the stimulus (pix, t, v)."""
    j = F.abs(F.lead("v").over(by_t()) - F.col("v")) > jump
    s = stim.withColumn("j", F.coalesce(j, F.lit(False)).cast("int"))
    # a jump after sample k covers k + 1 - delta // 2 to k + delta - delta // 2
    w = by_t().rowsBetween(-(delta - delta // 2), delta // 2 - 1)
    return s.select("pix", "t", (F.coalesce(F.max("j").over(w), F.lit(0)) == 1).alias("on"))


def transform_hold(frames: DataFrame, affine: DataFrame, every: int) -> DataFrame:
    """Each frame's transform is the one estimated at the start of its group of frames."""
    return frames.withColumn("k", F.floor(F.col("t") / every) * every).join(sent(affine.withColumnRenamed("t", "k")), "k").drop("k")


def sliding_windows(x: DataFrame, window: int, half: int) -> DataFrame:
    """(pix, t, w, y): every full window from t, and whether truth occurs within half of its centre."""
    w = by_t().rowsBetween(0, window - 1)
    mid = int(round(window / 2))  # half to even
    y = F.max(F.col("truth").cast("int")).over(by_t().rowsBetween(max(mid - half, 0), mid + half))
    return x.select("pix", "t", F.collect_list("prob").over(w).alias("w"), y.alias("y")).where(F.size("w") == window)


def spike_peaks(x: DataFrame, window: int, half: int, threshold: float) -> DataFrame:
    """(pix, t, prob): the voltage peak within +-half of each centre whose probability exceeds the threshold, adjacent ones once."""
    near = by_t().rowsBetween(-half, half)
    at = F.max_by("t", F.struct("v", -F.col("t"))).over(near)
    hits = x.withColumn("p", at).where((F.col("prob") > threshold) & (F.col("t") >= window // 2)).groupBy("pix", F.col("p").alias("t")).agg(F.max_by("prob", "t").alias("prob"))
    run = hits.withColumn("back", F.lag("t").over(by_t()))
    return run.where("back IS NULL OR t - back > 1").select("pix", "t", "prob")


def spike_report(truth: DataFrame, found: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """One row: true and found spikes, hits in [t - before, t + after), misses, extras."""
    t2 = found.select("pix", F.explode(F.sequence(F.col("t") - after + 1, F.col("t") + before)).alias("t"), F.col("t").alias("f"))
    pairs = truth.join(t2, ["pix", "t"])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(truth, "total").join(count(found, "found")).join(count(pairs.select("pix", "t").distinct(), "hits")).join(count(pairs.select("pix", "f").distinct(), "matched"))
    return out.select("total", "found", "hits", (F.col("total") - F.col("hits")).alias("misses"), (F.col("found") - F.col("matched")).alias("extras"))


def noise_fft(trace: DataFrame, lo: float = 0.25, hi: float = 0.5, most: int = 3072) -> DataFrame:
    """(pix, noise): root of half the mean power over frequencies in (lo, hi] of every whole trace, by its spectrum; traces above `most`
    give their first, middle and last thirds of it. A trace without such frequencies has no noise. A trace is a task's row."""
    from ..functions import signal
    from ..session import ship

    ship(trace.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        y = rows["v"].to_numpy().astype(float)[np.argsort(rows["t"].to_numpy())]
        noise = float(signal.noise_fft(y, lo, hi, "mean", most)[0]) if len(y) > 1 else None
        return pa.table([rows["pix"][:1].cast(pa.int64()), pa.array([noise], pa.float64())], names=["pix", "noise"])

    return trace.select("pix", "t", "v").groupBy("pix").applyInArrow(run, "pix long, noise double").withColumn("noise", F.nanvl("noise", F.lit(None)))


def next_power(value: Column) -> Column:
    """The least e from 0 on for which 2^e is |value| or more."""
    near = F.greatest(F.ceil(F.log2(F.greatest(F.abs(value), F.lit(1)))).cast("int"), F.lit(0))
    return F.when(F.pow(F.lit(2.0), near - 1) >= F.abs(value), F.greatest(near - 1, F.lit(0))).when(F.pow(F.lit(2.0), near) < F.abs(value), near + 1).otherwise(near)


def covariance(movie: DataFrame) -> DataFrame:
    """Sample covariance of neighbouring pixels' traces in x."""
    right = movie.select("t", (F.col("x") - 1).alias("x"), "y", F.col("v").alias("r"))
    return movie.join(right, ["t", "x", "y"]).groupBy("x", "y").agg(F.covar_samp("v", "r").alias("v"))


def covariance_matrix(rows: DataFrame) -> DataFrame:
    """(a, b, v): sample covariance of all pairs of traces (pix, t, v) of a neighbourhood, each pair once and each with itself. Traces
    that share no sample have no row. Meant for the pixels of a patch: the matrix has as many entries as pairs."""
    left, right = rows.select(F.col("pix").alias("a"), "t", F.col("v").alias("l")), rows.select(F.col("pix").alias("b"), "t", F.col("v").alias("r"))
    return left.join(right, "t").where("a <= b").groupBy("a", "b").agg(F.covar_samp("l", "r").alias("v"))


def relative_change(detrended: DataFrame, movie: DataFrame) -> DataFrame:
    """v / (movie - v) for each voxel of a detrended movie: its change over its baseline; null where that is 0."""
    keys = [c for c in movie.columns if c != "v"]
    both = detrended.join(movie.withColumnRenamed("v", "w"), keys)
    return both.select(*keys, F.try_divide("v", F.col("w") - F.col("v")).alias("v"))


def spatial_decimate(movie: DataFrame, n: int) -> DataFrame:
    """Means of n x n pixels of every frame."""
    return movie.groupBy("t", F.floor(F.col("x") / n).alias("x"), F.floor(F.col("y") / n).alias("y")).agg(F.avg("v").alias("v"))
