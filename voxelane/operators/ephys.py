"""Electrophysiology: swim power, peaks, bursts and swims, stimulus blocks and trials. Rows (i, ch1, ch2, ...), optionally keyed by
rec, i counting the samples of a recording without gaps.

A recording of any length is cut into chunks of samples, so that no task holds a whole one: what looks at neighbours gets a margin
of samples from the chunks beside its own, and running sums and counts carry each chunk's total over to the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Samples of a chunk.
CHUNK = 1 << 16


def keys_of(rows: DataFrame) -> list[str]:
    return ["rec"] if "rec" in rows.columns else []


def with_margin(rows: DataFrame, margin: int, chunk: int = CHUNK) -> DataFrame:
    """Each sample once for every chunk (column _c) within `margin` samples of it; _own marks its own chunk's."""
    first, last = F.floor((F.col("i") - margin) / chunk), F.floor((F.col("i") + margin) / chunk)
    return rows.withColumn("_c", F.explode(F.sequence(first, last))).withColumn("_own", F.floor(F.col("i") / chunk) == F.col("_c"))


def by_i(rows: DataFrame) -> Window:
    """Samples in order within a chunk."""
    return Window.partitionBy(*keys_of(rows), "_c").orderBy("i")


def gaussian(taps: int, sigma: float) -> list[float]:
    g = [math.exp(-((k - taps // 2) ** 2) / (2 * sigma**2)) for k in range(taps)]
    return [x / sum(g) for x in g]


def fir(column: str, kernel: list[float], order: Window) -> Column:
    """A centred weighted sum; samples beyond the ends count as 0."""
    half = len(kernel) // 2
    return sum((F.coalesce(F.lead(column, k - half).over(order) if k >= half else F.lag(column, half - k).over(order), F.lit(0.0)) * w for k, w in enumerate(kernel)), F.lit(0.0))


def swim_power(rows: DataFrame, channel: str, taps: int = 121, sigma: float = 20.0, chunk: int = CHUNK) -> DataFrame:
    """rows with power: the squared distance from the smoothed channel, smoothed again."""
    near = with_margin(rows, 2 * (taps // 2), chunk)
    w, k = by_i(near), gaussian(taps, sigma)
    s = near.withColumn("_s", fir(channel, k, w)).withColumn("_d", (F.col(channel) - F.col("_s")) ** 2)
    return s.withColumn("power", fir("_d", k, w)).where("_own").drop("_s", "_d", "_c", "_own")


def swim_peaks(power: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Samples above both neighbours."""
    near = with_margin(power, 1, chunk)
    w = by_i(near)
    return near.withColumns({"_b": F.lag("power").over(w), "_a": F.lead("power").over(w)}).where("_own AND power > _b AND power > _a").drop("_a", "_b", "_c", "_own")


def running(rows: DataFrame, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows with the sum of a value over all samples so far: within its chunk by a window, before it by the totals of the chunks."""
    keys = keys_of(rows)
    cut = rows.withColumn("_c", F.floor(F.col("i") / chunk)).withColumn("_v", value)
    totals = cut.groupBy(*keys, "_c").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_t")).drop("_t")  # a row a chunk
    inside = F.sum("_v").over(by_i(cut).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("_in", inside).join(before, [*keys, "_c"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_c", "_v", "_in", "_before")


def previous(rows: DataFrame, column: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows with a column's value at the row before, of rows that may leave samples out: the last of the chunks before where a row is
    the first of its chunk."""
    keys = keys_of(rows)
    cut = rows.withColumn("_c", F.floor(F.col("i") / chunk))
    ends = cut.groupBy(*keys, "_c").agg(F.max_by(column, "i").alias("_last"))
    ends = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_c"))).drop("_last")  # a row a chunk
    inside = cut.withColumn("_lag", F.lag(column).over(by_i(cut))).withColumn("_first", F.row_number().over(by_i(cut)) == 1)
    return inside.join(ends, [*keys, "_c"]).withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop("_c", "_lag", "_first", "_carry")


def burst_threshold(power: DataFrame, peaks: DataFrame, bin_samples: int, grain: float = 1e-5, factor: float = 2.5) -> DataFrame:
    """(rec, bin, th): mode + factor * (mode - floor) of the power of all peaks up to the end of each time bin.

    A level's count only changes in bins that hold it. So the mode up to a bin is the best of what each bin's own levels have
    reached by then: running counts by level, then a running best over the bins.
    """
    keys = keys_of(power)
    h = peaks.groupBy(*keys, F.floor(F.col("i") / bin_samples).alias("bin"), F.floor(F.col("power") / grain).alias("level")).agg(F.count("*").alias("n"))
    upto = h.withColumn("n", F.sum("n").over(Window.partitionBy(*keys, "level").orderBy("bin")))
    each = upto.groupBy(*keys, "bin").agg(F.max(F.struct("n", (-F.col("level")).alias("down"))).alias("best"), F.min("level").alias("low"))
    bins = power.select(*keys, F.floor(F.col("i") / bin_samples).alias("bin")).distinct()
    so_far = Window.partitionBy(*keys).orderBy("bin")  # a row a bin
    run = bins.join(each, [*keys, "bin"], "left").withColumn("best", F.max("best").over(so_far)).withColumn("low", F.min("low").over(so_far)).where("best IS NOT NULL")
    mode, low = -F.col("best.down") * grain, F.col("low") * grain
    return run.select(*keys, "bin", (mode + factor * (mode - low)).alias("th"))


def bursts(peaks: DataFrame, thresholds: DataFrame, bin_samples: int) -> DataFrame:
    return peaks.withColumn("bin", F.floor(F.col("i") / bin_samples)).join(thresholds, [*keys_of(peaks), "bin"]).where("power > th").drop("bin", "th")


def swims(found: DataFrame, gap: int = 600, chunk: int = CHUNK) -> DataFrame:
    """(rec, start, stop, n): bursts at most gap samples apart; swims of one burst are left out."""
    keys = keys_of(found)
    marked = previous(found.select(*keys, "i"), "i", "back", chunk)
    new = F.coalesce((F.col("i") - F.col("back") > gap).cast("int"), F.lit(0))
    g = running(marked, new, "g", chunk)
    return g.groupBy(*keys, "g").agg(F.min("i").alias("start"), F.max("i").alias("stop"), F.count("*").alias("n")).where("n > 1").drop("g")


def stim_blocks(rows: DataFrame, level: str, skip: int = 100) -> DataFrame:
    """(rec, block, start, stop): where each level of the stimulus lies; the first skip samples have none."""
    return rows.where(F.col("i") >= skip).groupBy(*keys_of(rows), F.col(level).cast("long").alias("block")).agg(F.min("i").alias("start"), F.max("i").alias("stop"))


def block_powers(spans: DataFrame, power: DataFrame, rows: DataFrame, level: str, chunk: int = CHUNK) -> DataFrame:
    """(rec, block, swims, power): per block, the power of the swims that start in it, each clipped at 0. The sum over a swim is a
    difference of running sums at its ends, so no range join is needed."""
    keys = keys_of(power)
    run = running(power.select(*keys, "i", "power"), F.col("power"), "c", chunk)
    start, stop = run.select(*keys, F.col("i").alias("start"), F.col("c").alias("c0"), F.col("power").alias("p0")), run.select(*keys, F.col("i").alias("stop"), F.col("c").alias("c1"))
    s = start.join(spans, [*keys, "start"]).join(stop.join(spans.select(*keys, "stop"), [*keys, "stop"]), [*keys, "stop"])
    lab = rows.select(*keys, F.col("i").alias("start"), F.col(level).cast("long").alias("block")).join(spans.select(*keys, "start"), [*keys, "start"])
    return s.join(lab, [*keys, "start"]).groupBy(*keys, "block").agg(F.count("*").alias("swims"), F.sum(F.greatest(F.lit(0.0), F.col("c1") - F.col("c0") + F.col("p0"))).alias("power"))


def trials(rows: DataFrame, state: str, chunk: int = CHUNK) -> DataFrame:
    """(rec, trial, state, i): a trial starts where the state falls back to its least; the first sample of every state of a trial."""
    marked = previous(rows.select(*keys_of(rows), "i", F.col(state).alias("state")), "state", "back", chunk)
    new = F.coalesce((F.col("state") < F.col("back")).cast("int"), F.lit(0))
    t = running(marked, new, "trial", chunk)
    return t.groupBy(*keys_of(rows), "trial", "state").agg(F.min("i").alias("i"))


def trials_of_blocks(rows: DataFrame, block: str, state: str, skip: int = 100) -> DataFrame:
    """(rec, trial, state, i): blocks of the stimulus but for the last as trials; the first sample of every state inside a block, whose
    last sample doesn't count. The first skip samples belong to no block."""
    keys = keys_of(rows)
    own = rows.select(*keys, "i", F.when(F.col("i") >= skip, F.col(block)).otherwise(0).cast("long").alias("trial"), F.col(state).alias("state")).where("trial > 0")
    ends = own.groupBy(*keys, "trial").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    last = ends.groupBy(*keys).agg(F.max("trial").alias("last")) if keys else ends.agg(F.max("trial").alias("last"))
    spans = (ends.join(last, keys) if keys else ends.crossJoin(last)).where("trial < last").drop("last")
    inside = own.select(*keys, "i", "state").join(spans, (F.col("i") >= F.col("a")) & (F.col("i") < F.col("b"))) if not keys else own.drop("trial").join(spans, keys).where("i >= a AND i < b")
    return inside.groupBy(*keys, "trial", "state").agg(F.min("i").alias("i"))


def swim_run(rows: DataFrame, channel: str, level: str, taps: int = 121, sigma: float = 20.0, bin_samples: int = 360_000, grain: float = 1e-5, factor: float = 2.5, gap: int = 600, skip: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(swims, stimulus blocks, power per block) of recordings end to end: power, peaks, thresholds, bursts, swims, blocks. Power, peaks
    and swims are written once each, since several steps read them."""
    power, spans = found_swims(rows, channel, taps, sigma, bin_samples, grain, factor, gap)
    return spans, stim_blocks(rows, level, skip), block_powers(spans, power, rows, level)


def found_swims(rows: DataFrame, channel: str, taps: int, sigma: float, bin_samples: int, grain: float, factor: float, gap: int) -> tuple[DataFrame, DataFrame]:
    """(power, swims), both written."""
    work = Workspace(rows.sparkSession, "swims")
    power = work.write(swim_power(rows, channel, taps, sigma).select(*keys_of(rows), "i", "power"), "power")
    peaks = work.write(swim_peaks(power), "peaks")
    return power, work.write(swims(bursts(peaks, burst_threshold(power, peaks, bin_samples, grain, factor), bin_samples), gap), "swims")
