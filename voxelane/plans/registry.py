"""The registered queries over the fixture views, and their SQL.

Doubles are rounded to six digits and integers are longs on both sides, since engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ephys as E
from ..operators import pixel as P
from ..operators import space as S
from ..operators import traces as T
from .fixtures import NEEDS, SQL, Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def shaped(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, 6) + 0.0 if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(*out)


def oracle(views: str, body: str, doubles: str = "", longs: str = "", plain: str = "", ctes: str = "") -> str:
    names: list[str] = []

    def need(v: str) -> None:
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                need(n) if n != v else names.append(n)

    for v in views.split():
        need(v)
    cols = [f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + plain.split()
    withs = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in names] + ([ctes] if ctes else [])
    start = f"WITH RECURSIVE {', '.join(withs)} " if withs else ""
    return f"{start}SELECT {', '.join(cols)} FROM ({body})"


def query(views: str = "", body: str = "", doubles: str = "", longs: str = "", plain: str = "", ctes: str = ""):
    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = f
        if body:
            ORACLE[f.__name__] = oracle(views, body, doubles, longs, plain, ctes)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import kernels, workflows  # noqa: F401  their queries register themselves

    return {name: (lambda spark, sf_dir, f=f: shaped(f(Views(spark, sf_dir)))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera calibration, the mean reference image and each pixel's mean relative change from it."""
    v = Views(spark, sf_dir)
    movie = P.calibrate(v.movie, v.camera)
    ref = P.reference_image(movie, 0, 100).withColumnRenamed("v", "ref")
    return shaped(movie.join(F.broadcast(ref), ["x", "y"]).groupBy("x", "y").agg(F.avg(F.try_divide(F.col("v") - F.col("ref"), "ref")).alias("dff")))


CAL = "SELECT t, x, y, CASE WHEN gain < 0.5 OR gain > 5 OR (v - off) / (gain + 1e-12) <= 0 THEN 1e-6 ELSE (v - off) / (gain + 1e-12) END AS v FROM movie JOIN camera USING (x, y)"


@query("movie camera", CAL, "v", "t x y")
def calibrate_pixels(v):
    return P.calibrate(v.movie, v.camera)


@query("levels", "SELECT pix, CASE WHEN min(l.var - d.var) < 0 THEN 0 ELSE sum((l.mean - d.mean) * (l.var - d.var)) / nullif(sum((l.mean - d.mean) * (l.mean - d.mean)), 0) END AS gain FROM levels l JOIN (SELECT pix, mean, var FROM levels WHERE lvl = 0) d USING (pix) WHERE l.lvl > 0 GROUP BY pix", "gain", "pix")
def gain_fit(v):
    return P.gain_fit(v.levels)


OFFS = "o AS (SELECT a, b FROM (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b))"
REFL = "nb AS (SELECT m.t, m.x, m.y, a, b, n.v FROM (SELECT t, x, y, a, b, CASE WHEN x + a < 0 THEN 0 WHEN x + a > 7 THEN 7 ELSE x + a END AS p, CASE WHEN y + b < 0 THEN 0 WHEN y + b > 7 THEN 7 ELSE y + b END AS q FROM movie, o) m JOIN movie n ON n.t = m.t AND n.x = m.p AND n.y = m.q)"


@query("movie", "SELECT t, x, y, median(v) AS v FROM nb GROUP BY ALL", "v", "t x y", ctes=f"{OFFS}, {REFL}")
def median3x3(v):
    return P.median3x3(v.movie, 8, 8)


@query("movie", "SELECT t, x, y, CASE WHEN v < 100 * min(m) OVER (PARTITION BY t) THEN m ELSE v END AS v FROM movie JOIN (SELECT t, x, y, avg(v) AS m FROM nb WHERE a <> 0 OR b <> 0 GROUP BY ALL) USING (t, x, y)", "v", "t x y", ctes=f"{OFFS}, {REFL}")
def dead_pixel_boxcar(v):
    return P.dead_pixel_boxcar(v.movie, 8, 8)


@query("movie", "SELECT x, y, avg(v) AS v FROM movie WHERE t BETWEEN 200 AND 299 GROUP BY ALL", "v", "x y")
def reference_image(v):
    return P.reference_image(v.movie, 200, 300)


@query("movie", "SELECT x, y, max(v) AS v_max, avg(v) AS v_mean, min(v) AS v_min FROM movie GROUP BY ALL", "v_max v_mean v_min", "x y")
def summary_images(v):
    return P.summary_images(v.movie)


@query("movie", "SELECT t, x, y, CAST(trunc((v - lo) * 65535 / (hi - lo)) AS BIGINT) AS v FROM movie, (SELECT min(v) AS lo, max(v) AS hi FROM movie)", "", "t x y v")
def rescale_uint16(v):
    return P.rescale_uint16(v.movie)


@query("movie", "SELECT t, y // 2 AS x, x // 2 AS y, sum(v) AS v FROM movie GROUP BY ALL", "v", "t x y")
def bin_sum(v):
    return P.bin_sum(v.movie, 2)


@query("movie", "SELECT t, x, y, (z - min(z) OVER (PARTITION BY t)) / nullif(max(z) OVER (PARTITION BY t) - min(z) OVER (PARTITION BY t), 0) AS v FROM (SELECT t, x, y, (v - avg(v) OVER (PARTITION BY t)) / nullif(stddev_pop(v) OVER (PARTITION BY t), 0) AS z FROM (SELECT t, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM movie GROUP BY ALL))", "v", "t x y")
def downscale_zscore(v):
    return P.downscale_zscore(v.movie, 2)


@query("movie", "SELECT t, x - 2 AS x, y - 3 AS y, v FROM movie WHERE x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6", "v", "t x y")
def crop_image(v):
    return P.crop(v.movie, 2, 3, 4)


@query("movie", "SELECT t, x, y, v > quantile_cont(v, 0.4) OVER (PARTITION BY t) AS keep FROM movie", "", "t x y", "keep")
def intensity_mask(v):
    return P.intensity_mask(v.movie, 40)


@query("movie mask", "SELECT t, x, y, CASE WHEN keep THEN v ELSE 0 END AS v FROM movie LEFT JOIN mask USING (x, y)", "v", "t x y")
def masked_movie(v):
    return P.masked(v.movie, v.mask)


@query("movie", "SELECT g.t, g.x, g.y, coalesce(m.v, -1) AS v FROM (SELECT t, x, y FROM (SELECT DISTINCT t FROM movie), (SELECT unnest(range(0, 10)) AS x), (SELECT unnest(range(0, 11)) AS y)) g LEFT JOIN movie m ON m.t = g.t AND m.x + 1 = g.x AND m.y + 2 = g.y", "v", "t x y")
def pad_image(v):
    return P.pad(v.movie, 10, 11, 1, 2, -1.0)


@query("movie", "SELECT t, x, y, v FROM movie WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6", "v", "t x y")
def unpad_image(v):
    outside = ~(F.col("x").between(2, 5) & F.col("y").between(1, 6))
    return P.unpad(v.movie.withColumn("v", F.when(outside, float("nan")).otherwise(F.col("v"))))


@query("", "SELECT x, y, 1 + arg_max(n, c) AS v FROM (SELECT CAST(floor(l_quantity) AS BIGINT) AS x, CAST(floor(l_discount * 100) AS BIGINT) AS y, l_orderkey // 1000 AS c, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL", "", "x y v")
def localization_hist(v):
    p = v.read("lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_quantity").alias("px"), (F.col("l_discount") * 100).alias("py"))
    return P.localization_hist(p, 1000)


@query("movie", "SELECT x, y FROM movie WHERE t = 0 AND ((y < 7 AND y >= 1 AND x < (4 - 1) * (y - 1) / 6.0 + 1)::INT + (y < 7 AND y >= 1 AND x < (7 - 4) * (y - 7) / -6.0 + 4)::INT) % 2 = 1", "", "x y")
def polygon_roi(v):
    return P.polygon_roi(v.pixels, [(1.0, 1.0), (4.0, 7.0), (7.0, 1.0)])


MAD = "med AS (SELECT *, median(v) OVER (PARTITION BY pix) AS m FROM trace), md AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY pix) AS mad FROM med)"


@query("trace", "SELECT pix, t, greatest(0, v - (m + 2 * mad)) AS v FROM md", "v", "pix t", ctes=MAD)
def threshold_mad(v):
    return T.threshold_mad(v.trace, 2.0)


@query("trace", "SELECT pix, t, CASE WHEN v < m + 1 * mad THEN 0 ELSE v END AS v FROM md", "v", "pix t", ctes=MAD)
def thresh_mad_zero(v):
    return T.thresh_mad_zero(v.trace, 1.0)


@query("trace", "SELECT pix, t, (v - m) * 0.6745 / nullif(mad, 0) AS v FROM md", "v", "pix t", ctes=MAD)
def mad_scale(v):
    return T.mad_scale(v.trace)


@query("trace", "SELECT pix, t, v - min(CASE WHEN t % 2 = 0 THEN v END) OVER (PARTITION BY pix) AS v FROM trace", "v", "pix t")
def min_correct(v):
    return T.min_correct(v.trace, 2)


@query("trace", "SELECT pix, t // 4 AS t, avg(v) AS v FROM trace GROUP BY ALL", "v", "pix t")
def temporal_decimate(v):
    return T.temporal_decimate(v.trace, 4)


def _base(w: int, p: float, d: int) -> str:
    width = w // d
    b, r = width // 2, min(int(width * p / 100), width - 1)
    return f"""kn AS (SELECT pix, list(v ORDER BY t) AS a FROM trace WHERE t % {d} = 0 GROUP BY pix),
      sm AS (SELECT pix, list_transform(range(0, len(a)), lambda k: list_sort(list_transform(range(k - {b}, k + {width - b}), lambda i:
        a[1 + CASE WHEN ((i % (2 * len(a))) + 2 * len(a)) % (2 * len(a)) < len(a) THEN ((i % (2 * len(a))) + 2 * len(a)) % (2 * len(a)) ELSE 2 * len(a) - 1 - ((i % (2 * len(a))) + 2 * len(a)) % (2 * len(a)) END]))[{r + 1}]) AS b FROM kn),
      kx AS (SELECT pix, t, v, b, least(t // {d}, greatest(len(b) - 2, 0)) AS i FROM trace JOIN sm USING (pix)),
      bs AS (SELECT pix, t, v, b[i + 1] + (coalesce(b[i + 2], b[i + 1]) - b[i + 1]) * (t - i * {d}) / {float(d)}::DOUBLE AS base FROM kx)"""


@query("trace", "SELECT pix, t, v, base FROM bs", "v base", "pix t", ctes=_base(22, 20, 2))
def rolling_baseline(v):
    return T.rolling_baseline(v.trace, 22, 20, 2)


@query("trace", "SELECT pix, t, v - base AS v FROM bs", "v", "pix t", ctes=_base(80, 20, 2))
def detrend(v):
    return T.detrend(v.trace, 80, 20)


@query("trace", "SELECT pix, t, d AS v FROM (SELECT *, max(d) OVER (PARTITION BY pix) AS mx, min(base) OVER (PARTITION BY pix) AS lo FROM (SELECT pix, t, base, v / nullif(base, 0) - 1 AS d, max(v) OVER (PARTITION BY pix) AS top FROM bs) WHERE top > 200) WHERE mx <= 30 AND lo > 0", "v", "pix t", ctes=_base(40, 20, 2))
def cell_dff_qc(v):
    return T.cell_dff_qc(v.trace, 200, 40, 20, 2, 30)


@query("trace", "SELECT pix, t, base - least(0, quantile_cont(v, 0.003) OVER (PARTITION BY pix)) AS v FROM bs", "v", "pix t", ctes=_base(80, 20, 2))
def baseline_shift(v):
    return T.baseline_shift(v.trace, T.detrend(v.trace, 80, 20))


@query("trace", "SELECT pix, t, CASE WHEN min(s) OVER (PARTITION BY pix) <= 0 THEN s - (min(s) OVER (PARTITION BY pix) - 0.01::DOUBLE) ELSE s END AS v FROM (SELECT pix, t, w - least(0, quantile_cont(w, 0.003) OVER (PARTITION BY pix)) AS s FROM (SELECT pix, t, v - 60 AS w FROM trace))", "v", "pix t")
def baseline_positive(v):
    low = v.trace.withColumn("v", F.col("v") - 60)
    return T.baseline_positive(low, low)


@query("trace", "SELECT pix, t, (v - coalesce(last_value(m IGNORE NULLS) OVER b, first_value(m IGNORE NULLS) OVER a)) / nullif(coalesce(last_value(s IGNORE NULLS) OVER b, first_value(s IGNORE NULLS) OVER a), 0) AS v FROM (SELECT pix, t, v, CASE WHEN count(*) OVER w = 11 THEN quantile_cont(v, 0.5) OVER w END AS m, CASE WHEN count(*) OVER w = 11 THEN stddev_samp(v) OVER w END AS s FROM trace WINDOW w AS (PARTITION BY pix ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WINDOW b AS (PARTITION BY pix ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY pix ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "v", "pix t")
def roll_scale(v):
    return T.roll_scale(v.trace, 11)


@query("movie", "SELECT t, x, (m - g) / nullif(m - p, 0) AS v FROM (SELECT t, x, avg(v) AS m, quantile_cont(v, 0.05) AS p FROM movie GROUP BY ALL) JOIN (SELECT x, avg(v) AS g FROM movie GROUP BY ALL) USING (x)", "v", "t x")
def frame_dff(v):
    return T.frame_dff(v.movie)


@query("trace", "SELECT pix, t, v - regr_intercept(v, t) OVER w - regr_slope(v, t) OVER w * t + avg(v) OVER w AS v FROM trace WINDOW w AS (PARTITION BY pix)", "v", "pix t")
def linear_detrend(v):
    return T.linear_detrend(v.trace)


@query("trace", "SELECT pix, t, w - b1 * a - b2 * (a * a - m2) AS v FROM (SELECT *, (p1 * (m4 - m2 * m2) - m3 * p2) / nullif(m2 * (m4 - m2 * m2) - m3 * m3, 0) AS b1, (m2 * p2 - m3 * p1) / nullif(m2 * (m4 - m2 * m2) - m3 * m3, 0) AS b2 FROM (SELECT *, avg(a * a) OVER q AS m2, avg(a * a * a) OVER q AS m3, avg(a * a * a * a) OVER q AS m4, avg(a * w) OVER q AS p1, avg(a * a * w) OVER q AS p2 FROM (SELECT pix, t, t - avg(t) OVER q AS a, v - avg(v) OVER q AS w FROM trace WINDOW q AS (PARTITION BY pix)) WINDOW q AS (PARTITION BY pix)))", "v", "pix t")
def poly_detrend(v):
    return T.poly_detrend(v.trace)


STIM = "sj AS (SELECT pix, t, coalesce(abs(lead(v) OVER w - v) > 100, false) AS j FROM trace WINDOW w AS (PARTITION BY pix ORDER BY t)), st AS (SELECT pix, t, coalesce(bool_or(j) OVER (PARTITION BY pix ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), false) AS stim FROM sj)"


@query("trace", "SELECT pix, t, stim FROM st", "", "pix t", "stim", ctes=STIM)
def stim_mask(v):
    return T.stim_mask(v.trace, 4, 100.0).withColumnRenamed("on", "stim")


@query("trace", "SELECT pix, t, (regr_intercept(o, t) OVER w + regr_slope(o, t) OVER w * t) / sd AS trend FROM (SELECT pix, t, t // 25 AS seg, CASE WHEN NOT stim THEN v END AS o, stddev_pop(v) OVER (PARTITION BY pix) AS sd FROM trace JOIN st USING (pix, t)) WINDOW w AS (PARTITION BY pix, seg)", "trend", "pix t", ctes=STIM)
def photobleach(v):
    """The trend in deviations of its trace, which are not round numbers as the table's values are."""
    found = T.photobleach(v.trace, T.stim_mask(v.trace, 4, 100.0), 25)
    return T.with_stats(found.join(v.trace, ["pix", "t"]), sd=F.stddev_pop("v")).select("pix", "t", F.try_divide("trend", "sd").alias("trend"))


@query("trace", "SELECT a.pix, k AS lag, coalesce(sum(a.v * b.v), 0) / max(a.n) AS v FROM c a CROSS JOIN (SELECT unnest(range(0, 6)) AS k) LEFT JOIN c b ON b.pix = a.pix AND b.t = a.t + k GROUP BY ALL", "v", "pix lag", ctes="c AS (SELECT pix, t, v - avg(v) OVER (PARTITION BY pix) AS v, count(*) OVER (PARTITION BY pix) AS n FROM trace)")
def autocov(v):
    return T.autocov(v.trace, 5)


@query("trace", "SELECT * FROM (SELECT pix, t, 2 * v - lag(v) OVER w - lead(v) OVER w AS v FROM trace WINDOW w AS (PARTITION BY pix ORDER BY t)) WHERE v IS NOT NULL", "v", "pix t")
def second_diff(v):
    return T.second_diff(v.trace)


@query("trace", "SELECT pix, k FROM k, (SELECT avg(k) + stddev_pop(k) AS th FROM k) WHERE k > th", "k", "pix", ctes="k AS (SELECT pix, kurtosis_pop(v) AS k FROM trace GROUP BY pix)")
def kurtosis_select(v):
    return T.kurtosis_select(v.trace)


FLAG = "fl AS (SELECT pix, t, min((abs(v - m) < 2 * s)::INT) OVER (PARTITION BY pix ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS keep FROM (SELECT *, median(v) OVER q AS m, stddev_pop(v) OVER q AS s FROM trace WINDOW q AS (PARTITION BY pix)))"


@query("trace", "SELECT pix, t, keep, keep AND NOT lag(keep, 1, true) OVER (PARTITION BY pix ORDER BY t) AS jump FROM fl", "", "pix t", "keep jump", ctes=FLAG)
def outlier_flags(v):
    return T.outlier_flags(v.trace, 2.0, 2)


ISL = "isl AS (SELECT pix, min(t) AS start, max(t) AS stop, count(*) AS n FROM (SELECT pix, t, t - row_number() OVER (PARTITION BY pix ORDER BY t) AS g FROM trace WHERE v > 50) GROUP BY pix, g)"


@query("trace", "SELECT * FROM isl WHERE n >= 3", "", "pix start stop n", ctes=ISL)
def min_consec(v):
    return T.min_consec(v.trace.withColumn("flag", F.col("v") > 50), 3)


@query("trace", "SELECT pix, greatest(a - CASE WHEN n > 1 THEN 2 ELSE 0 END, 0) AS start, b + CASE WHEN n > 1 THEN 2 ELSE 0 END AS stop, n FROM (SELECT pix, g, min(t) AS a, max(t) AS b, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY pix ORDER BY t) AS g FROM (SELECT pix, t, coalesce((t - lag(t) OVER (PARTITION BY pix ORDER BY t) >= 5)::INT, 0) AS nw FROM trace WHERE v > 100)) GROUP BY ALL)", "", "pix start stop n")
def connect_regions(v):
    return T.connect_regions(v.trace.withColumn("flag", F.col("v") > 100), 5, 2)


@query("movie affine", "SELECT f.t, dy, dx FROM (SELECT DISTINCT t FROM movie) f JOIN affine a ON a.t = f.t // 4 * 4", "dy dx", "t")
def transform_hold(v):
    return T.transform_hold(v.movie.where("x = 0 AND y = 0").select("t"), v.affine, 4)


@query("prob", "SELECT pix, t, w1, w9, y FROM (SELECT pix, t, list(prob) OVER (PARTITION BY pix ORDER BY t ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS w, max(truth::INT) OVER (PARTITION BY pix ORDER BY t ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING) AS y FROM prob) s, LATERAL (SELECT w[1] AS w1, w[9] AS w9) WHERE len(w) = 9", "w1 w9", "pix t y")
def sliding_windows(v):
    w = T.sliding_windows(v.prob, 9, 1)
    return w.select("pix", "t", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(8)).alias("w9"), "y")


PEAK = "pk AS (SELECT pix, p AS t, arg_max(prob, t) AS prob FROM (SELECT pix, t, prob, arg_max(t, (v, -t)) OVER (PARTITION BY pix ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM prob) WHERE prob > 0.3 AND t >= 4 GROUP BY pix, p), sp AS (SELECT pix, t, prob FROM (SELECT *, lag(t) OVER (PARTITION BY pix ORDER BY t) AS b FROM pk) WHERE b IS NULL OR t - b > 1)"


@query("prob", "SELECT * FROM sp", "prob", "pix t", ctes=PEAK)
def spike_peaks(v):
    return T.spike_peaks(v.prob, 9, 2, 0.3)


@query("prob", "SELECT (SELECT count(*) FROM tr) AS total, (SELECT count(*) FROM sp) AS found, (SELECT count(*) FROM tr WHERE EXISTS (SELECT 1 FROM sp WHERE sp.pix = tr.pix AND sp.t >= tr.t - 3 AND sp.t < tr.t + 3)) AS hits, (SELECT count(*) FROM tr WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.pix = tr.pix AND sp.t >= tr.t - 3 AND sp.t < tr.t + 3)) AS misses, (SELECT count(*) FROM sp WHERE NOT EXISTS (SELECT 1 FROM tr WHERE sp.pix = tr.pix AND sp.t >= tr.t - 3 AND sp.t < tr.t + 3)) AS extras", "", "total found hits misses extras", ctes=PEAK + ", tr AS (SELECT pix, t FROM prob WHERE truth)")
def spike_report(v):
    return T.spike_report(v.prob.where("truth").select("pix", "t"), T.spike_peaks(v.prob, 9, 2, 0.3))


NOISE = f"SELECT pix, sqrt(avg(p / n)) AS noise FROM (SELECT pix, n, k, pow(sum(v * cos(2 * {math.pi!r}::DOUBLE * k * i / n)), 2) + pow(sum(v * sin(2 * {math.pi!r}::DOUBLE * k * i / n)), 2) AS p FROM (SELECT *, count(*) OVER (PARTITION BY pix) AS n, row_number() OVER (PARTITION BY pix ORDER BY t) - 1 AS i FROM trace) w, LATERAL (SELECT unnest(range(w.n // 4 + 1, w.n // 2 + 1)) AS k) b GROUP BY pix, n, k) GROUP BY pix"


@query("trace", NOISE, "noise", "pix")
def noise_fft(v):
    return T.noise_fft(v.trace)


@query("trace", NOISE, "noise", "pix")
def noise_fft_whole(v):
    """The former name of noise_fft."""
    return T.noise_fft(v.trace)


@query("movie", "SELECT a.x, a.y, covar_samp(a.v, b.v) AS v FROM movie a JOIN movie b ON a.t = b.t AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL", "v", "x y")
def covariance(v):
    return T.covariance(v.movie)


@query("trace", "SELECT pix, ceil(log2(count(*))) AS e FROM trace GROUP BY pix", "", "pix e")
def next_power(v):
    """The exponent of the least power of two that a trace fits."""
    return v.trace.groupBy("pix").agg(T.next_power(F.count("*")).alias("e"))


def _corr(steps) -> str:
    return "z AS (SELECT t, x, y, coalesce((v - avg(v) OVER q) / nullif(stddev_pop(v) OVER q, 0), 0) AS v FROM movie WINDOW q AS (PARTITION BY x, y)), st AS (SELECT * FROM (VALUES " + ", ".join(map(str, steps)) + ") s(dx, dy)), pr AS (SELECT a.x, a.y, b.x AS x2, b.y AS y2, avg(a.v * b.v) AS r FROM z a, st, z b WHERE b.t = a.t AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL)"


@query("movie", "SELECT x, y, avg(r) AS v FROM pr GROUP BY ALL", "v", "x y", ctes=_corr(S.FOUR))
def local_corr4(v):
    return S.local_correlation(v.movie, S.FOUR)


@query("movie", "SELECT x, y, avg(r) AS v FROM pr GROUP BY ALL", "v", "x y", ctes=_corr(S.EIGHT))
def local_corr8(v):
    return S.local_correlation(v.movie, S.EIGHT)


@query("movie", "SELECT x, y, x2, y2, r FROM pr WHERE r > 0.05", "r", "x y x2 y2", ctes=_corr(S.HALF4))
def superpixel_edges(v):
    return S.superpixel_edges(v.movie, 0.05)


LAB = "ed AS (SELECT x + 8 * y AS a, x2 + 8 * y2 AS b FROM pr WHERE r > 0.05), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re(a, b) AS (SELECT a, a FROM bo UNION SELECT re.a, bo.b FROM re JOIN bo ON bo.a = re.b)"


@query("movie", "SELECT a AS pix, min(b) AS label FROM re GROUP BY a", "", "pix label", ctes=_corr(S.HALF4) + ", " + LAB)
def superpixel_labels(v):
    return S.superpixel_labels(v.movie, 0.05, 8)


@query("movie", "SELECT x, y, z, x2, y2, z2, r FROM (SELECT a.x, a.y, a.z, b.x AS x2, b.y AS y2, b.z AS z2, avg(a.v * b.v) AS r FROM z3 a, (VALUES (1, 0, 0), (0, 1, 0), (1, -1, 0), (1, 1, 0), (0, 0, 1)) s(dx, dy, dz), z3 b WHERE b.t = a.t AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) WHERE r > 0.05", "r", "x y z x2 y2 z2", ctes="z3 AS (SELECT t, x, y, z, coalesce((v - avg(v) OVER q) / nullif(stddev_pop(v) OVER q, 0), 0) AS v FROM (SELECT t, x, y % 4 AS y, y // 4 AS z, v FROM movie) WINDOW q AS (PARTITION BY x, y, z))")
def superpixel_edges_3d(v):
    m = v.movie.withColumns({"z": F.floor(F.col("y") / 4), "y": F.col("y") % 4})
    return S.superpixel_edges(m, 0.05, ("x", "y", "z"))


@query("movie cells", "SELECT x, y, cell, coalesce(CASE WHEN isnan(corr(v, c)) THEN 0 ELSE corr(v, c) END, 0) AS r FROM movie JOIN cells USING (t) GROUP BY ALL", "r", "x y cell")
def component_corr(v):
    return S.component_correlation(v.movie, v.cell_traces)


@query("components cells", "SELECT cell, norm, u * m AS brightness, row_number() OVER (ORDER BY u * m DESC, cell) - 1 AS rank FROM (SELECT cell, max(w) AS u, sqrt(sum(w * w)) AS norm FROM components GROUP BY cell) JOIN (SELECT cell, max(c) AS m FROM cells GROUP BY cell) USING (cell)", "norm brightness", "cell rank")
def brightness_rank(v):
    return S.brightness_rank(v.components, v.cell_traces)


OV = "ov AS (SELECT p.cell AS a, q.cell AS b, sum(p.w * q.w) AS dot, count(*) AS shared FROM components p JOIN components q USING (x, y) WHERE p.cell < q.cell GROUP BY ALL), cn AS (SELECT cell, count(*) AS n FROM components GROUP BY cell)"


@query("components", "SELECT * FROM ov", "dot", "a b shared", ctes=OV)
def component_overlap(v):
    return S.component_overlap(v.components)


@query("components", "SELECT a, b, shared, p.n AS na, q.n AS nb FROM ov JOIN cn p ON p.cell = a JOIN cn q ON q.cell = b WHERE shared > 0.3 * p.n AND shared > 0.3 * q.n", "", "a b shared na nb", ctes=OV)
def merge_pairs(v):
    return S.merge_pairs(v.components, 0.3)


@query("components cells", "SELECT t, x, y, v - coalesce(m, 0) AS v FROM movie LEFT JOIN (SELECT t, x, y, sum(w * c) AS m FROM components JOIN cells USING (cell) GROUP BY ALL) USING (t, x, y)", "v", "t x y")
def residual(v):
    return S.residual(v.movie, v.components, v.cell_traces)


@query("components", "SELECT t, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS ca, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS cb FROM (SELECT t, sum(wa * v) AS ya, sum(wb * v) AS yb FROM movie JOIN w2 USING (x, y) GROUP BY t), (SELECT sum(wa * wa) AS aa, sum(wa * wb) AS ab, sum(wb * wb) AS bb FROM w2)", "ca cb", "t", ctes="w2 AS (SELECT x, y, coalesce(sum(CASE WHEN cell = 1 THEN w END), 0) AS wa, coalesce(sum(CASE WHEN cell = 2 THEN w END), 0) AS wb FROM components GROUP BY ALL)")
def ls_unmix_2(v):
    return S.ls_unmix_2(v.movie, v.components, 1, 2)


@query("components cells", "SELECT cell, x0, y0, nx, ny, activity FROM (SELECT cell, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS nx, max(y) - min(y) + 1 AS ny FROM components GROUP BY cell) JOIN (SELECT cell, sum(abs(c)) AS activity FROM cells GROUP BY cell HAVING sum(abs(c)) > 0) USING (cell)", "activity", "cell x0 y0 nx ny")
def combine_cells(v):
    return S.combine_cells(v.components, v.cell_traces)


@query("components", "SELECT x, y, arg_max(cell, (w, -cell)) AS cell FROM components GROUP BY ALL", "", "x y cell")
def layer_mosaic(v):
    return S.layer_mosaic(v.components)


@query("movie", "SELECT t, x, y, sum(v) AS total, count(*) AS n, avg(v) AS v FROM movie JOIN (VALUES (0, 3), (2, 6), (5, 7)) b(a, z) ON x BETWEEN a AND z GROUP BY ALL", "total v", "t x y n")
def overlap_add(v):
    return S.overlap_add(v.movie, 8, 3, 1)


@query("movie", "SELECT t, x, y, v FROM movie", "v", "t x y")
def tile_blend(v):
    """Identity tiles blend back to the movie."""
    return S.tile_blend(S.tiles(v.movie, 8, 8, 2)).where("v IS NOT NULL")


@query("movie", "SELECT x, y, (x // 4 * 2 + y // 4) * 10 AS rank FROM movie WHERE t = 0", "", "x y rank")
def tile_rank(v):
    ranks = v.movie.sparkSession.range(4).select(F.col("id").cast("int").alias("tile"), (F.col("id") * 10).alias("rank"))
    return S.tile_rank(v.pixels, ranks, 8, 8, 2)


def _fir(col: str, src: str, name: str, taps: int, sigma: float) -> str:
    k = E.gaussian(taps, sigma)
    h = taps // 2
    terms = " + ".join(f"coalesce({'lead' if j >= h else 'lag'}({col}, {abs(j - h)}) OVER o, 0) * {w!r}::DOUBLE" for j, w in enumerate(k))
    return f"(SELECT *, {terms} AS {name} FROM {src} WINDOW o AS (ORDER BY i))"


POW = f"s1 AS {_fir('ch1', 'ephys', 's', 11, 2.0)}, s2 AS (SELECT *, pow(ch1 - s, 2) AS d FROM s1), pw AS {_fir('d', 's2', 'power', 11, 2.0)}, pe AS (SELECT i, power FROM (SELECT *, lag(power) OVER (ORDER BY i) AS b, lead(power) OVER (ORDER BY i) AS a FROM pw) WHERE power > b AND power > a)"


@query("ephys", "SELECT i, power FROM pw", "power", "i", ctes=POW)
def swim_power(v):
    return E.swim_power(v.ephys, "ch1", 11, 2.0).select("i", "power")


@query("ephys", "SELECT * FROM pe", "power", "i", ctes=POW)
def swim_peaks(v):
    return E.swim_peaks(E.swim_power(v.ephys, "ch1", 11, 2.0)).select("i", "power")


TH = ", hb AS (SELECT i // 500 AS bin, CAST(floor(power / 1e-3::DOUBLE) AS BIGINT) AS level, count(*) AS n FROM pe GROUP BY ALL), up AS (SELECT e.bin, level, sum(n) AS n FROM hb JOIN (SELECT DISTINCT i // 500 AS bin FROM pw) e ON hb.bin <= e.bin GROUP BY ALL), th AS (SELECT bin, arg_max(level, (n, -level)) * 1e-3::DOUBLE AS mode, min(level) * 1e-3::DOUBLE AS low FROM up GROUP BY bin), bu AS (SELECT i, power FROM pe JOIN th ON th.bin = i // 500 WHERE power > mode + 2.5::DOUBLE * (mode - low)), sw AS (SELECT g, min(i) AS start, max(i) AS stop, count(*) AS n FROM (SELECT i, sum(nw) OVER (ORDER BY i) AS g FROM (SELECT i, coalesce((i - lag(i) OVER (ORDER BY i) > 12)::INT, 0) AS nw FROM bu)) GROUP BY g HAVING count(*) > 1)"


def _swims(v):
    return E.found_swims(v.ephys, "ch1", 11, 2.0, 500, 1e-3, 2.5, 12)


@query("ephys", "SELECT start, stop, n FROM sw", "", "start stop n", ctes=POW + TH)
def swims(v):
    return _swims(v)[1]


@query("ephys", "SELECT stim3 AS block, min(i) AS start, max(i) AS stop FROM ephys WHERE i >= 100 GROUP BY stim3", "", "block start stop")
def stim_blocks(v):
    return E.stim_blocks(v.ephys, "stim3")


@query("ephys", "SELECT stim3 AS block, count(*) AS swims, sum(p) AS power FROM (SELECT sw.start, greatest(0, sum(pw.power)) AS p FROM sw JOIN pw ON pw.i BETWEEN sw.start AND sw.stop GROUP BY sw.start) s JOIN ephys ON ephys.i = s.start GROUP BY stim3", "power", "block swims", ctes=POW + TH)
def block_powers(v):
    power, spans = _swims(v)
    return E.block_powers(spans, power, v.ephys, "stim3")


@query("ephys", "SELECT trial, stim4 AS state, min(i) AS i FROM (SELECT *, sum(nw) OVER (ORDER BY i) AS trial FROM (SELECT *, coalesce((stim4 < lag(stim4) OVER (ORDER BY i))::INT, 0) AS nw FROM ephys)) GROUP BY ALL", "", "trial state i")
def trials(v):
    return E.trials(v.ephys, "stim4")
