"""Trends that follow what happens in a recording: regions around spikes, stimuli and jumps. Traces are rows (pix, t, v), t without gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal as G
from ..session import dealt, ship
from .grouped import per_stack, runs


def regions(trace: DataFrame, cut: float = 0.02, order: int = 6, consecutive: int = 2, least: float = 5.0, gap: int = 400, buffer: int = 50, discount: float = 0.0) -> DataFrame:
    """(pix, region, first, last, sigma): each trace cut into stretches around its spikes and between them, with the noise that a trend
    may leave in each. Finding them takes one pass over a trace, in one task."""
    ship(trace.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, t = pdf["v"].to_numpy(float), pdf["t"].to_numpy()
        sigma = float(G.noise_welch(y)[0])
        parts, factor = G.detect_regions(y, sigma, cut, order, consecutive, least, gap, buffer, discount)
        return pd.DataFrame([(pdf["pix"].iloc[0], k, t[p[0]], t[p[-1]], sigma * f) for k, (p, f) in enumerate(zip(parts, factor))], columns=["pix", "region", "first", "last", "sigma"])

    return trace.select("pix", "t", "v").repartition(dealt(trace.sparkSession), "pix").groupBy("pix").applyInPandas(run, "pix long, region long, first long, last long, sigma double")


def region_trends(trace: DataFrame, found: DataFrame, rounds: int = 20) -> DataFrame:
    """(pix, region, t, v): in each region (of regions()) the smoothest trend whose residual stays within its noise. Regions go to
    tasks by themselves, so one long trace spreads over many, and a task takes many side by side; a trace is their values side by side."""
    ship(trace.sparkSession)
    each = found.select("pix", "region", "sigma", F.explode(F.sequence("first", "last")).alias("t"))

    rows = trace.select("pix", "t", "v").join(each, ["pix", "t"])
    return per_stack(rows, ("pix", "region"), lambda y, n, sigma: G.constrained_trends(y, n, sigma, rounds), "sigma")


#: Stands for a recording that is null.
_NONE = -(1 << 63)
#: Rows of results that leave a task at once.
_POOL = 1 << 16
_SPLINE = "rec long, pix long, i long, t long, v double, trend double, stim double"


def _by_pixel(pix: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixels, places, pixels x places): a value of each, NaN without one; pixels and places without any value are left out."""
    some = ~np.isnan(value)
    pix, of = np.unique(pix[some], return_inverse=True)
    at, where = np.unique(at[some], return_inverse=True)
    out = np.full((len(pix), len(at)), np.nan)
    out[of, where] = value[some]
    return pix, at, out


def _per_part(rows: DataFrame, schema: str, run: Callable[..., tuple[np.ndarray, ...] | None]) -> DataFrame:
    """What run(*other columns) makes of the rows of each (rec, part), the first two columns; rec comes before run's columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*kept)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], mask=cols[0] == _NONE), *map(pa.array, cols[1:])], names=names)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for rec, part, *cols in runs(batches, 2):
            start = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (part[1:] != part[:-1])])
            for a, b in zip(start, [*start[1:], len(rec)]):
                out = run(*[c[a:b] for c in cols])
                if out is not None:
                    kept.append((np.full(len(out[0]), rec[a]), *out))
                    n += len(out[0])
                if n >= _POOL:
                    yield batch(kept)
                    kept, n = [], 0
        if kept:
            yield batch(kept)

    rows = rows.withColumn("rec", F.coalesce(F.col("rec").cast("long"), F.lit(_NONE))).where("part IS NOT NULL")
    return rows.repartition(dealt(rows.sparkSession), "rec", "part").sortWithinPartitions("rec", "part").mapInArrow(parts, schema)


def stimulus_detrended(traces: DataFrame, events: DataFrame, together: int = 256, followup: int = 100, spacing: int = 250, robust: bool = True) -> DataFrame:
    """(rec, pix, i, t, v, trend, stim): traces (rec, pix, t, v) without their spline trends, whose knots follow the recording's events
    (rec, t, stim, jump): three where the stimulus goes on or off and one `followup` samples later; at jumps the trend may jump, and
    their samples and neighbours are left out. i counts what is left. `together` pixels of a recording meet its events in a task;
    recordings without events have plain splines."""
    ship(traces.sparkSession)
    rows = traces.select("rec", "pix", "t", "v", F.pmod(F.floor(F.col("pix") / together), F.lit(1 << 40)).alias("part"))
    marks = rows.select("rec", "part").distinct().join(events, "rec")  # each part sees its recording's events
    rows = rows.select("rec", "part", "pix", "t", F.col("v").cast("double").alias("v"), F.lit(0.0).alias("stim"), F.lit(False).alias("jump"), F.lit(False).alias("event"))
    marks = marks.select("rec", "part", F.lit(0).cast("long").alias("pix"), "t", F.lit(None).cast("double").alias("v"), F.coalesce(F.col("stim").cast("double"), F.lit(0.0)).alias("stim"), F.coalesce("jump", F.lit(False)).alias("jump"), F.lit(True).alias("event"))

    def run(pix: np.ndarray, t: np.ndarray, v: np.ndarray, stims: np.ndarray, jumped: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, ...] | None:
        event = event.astype(bool)
        when, stims, jumped = t[event], stims[event], jumped[event].astype(bool)
        pix, t, y = _by_pixel(pix[~event], t[~event], np.asarray(v[~event], float))
        if not len(pix):
            return None
        stim, jump = np.zeros(len(t)), np.zeros(len(t), bool)
        at = np.searchsorted(t, when)
        hit = t[np.minimum(at, len(t) - 1)] == when
        stim[at[hit]], jump[at[hit]] = stims[hit], jumped[hit]
        jumps = np.flatnonzero(jump)
        trend = np.stack([G.stimulus_trend(x, stim, jumps, followup, spacing, robust) for x in y])
        left, kept_trend, kept_stim, _ = G.without_jumps(y, trend, stim, jumps)
        keep = np.setdiff1d(np.arange(len(t)), np.unique(np.clip(np.r_[jumps - 1, jumps, jumps + 1], 0, len(t) - 1))) if len(jumps) else np.arange(len(t))
        n = len(keep)
        return np.repeat(pix, n), np.tile(np.arange(n), len(y)), np.tile(t[keep], len(y)), left.ravel(), kept_trend.ravel(), np.tile(kept_stim, len(y))

    return _per_part(rows.where("t IS NOT NULL").unionByName(marks), _SPLINE, run)


def stimulus_response(detrended: DataFrame, together: int = 256, quadratic: bool = False) -> DataFrame:
    """(rec, pix, i, t, v): what a stimulus adds to the trends of stimulus_detrended(): the trend less its bleaching, a curve through the
    samples without stimulus of each stretch between jumps; samples within three of a jump are left out."""
    ship(detrended.sparkSession)
    part = F.pmod(F.floor(F.col("pix") / together), F.lit(1 << 40)).alias("part")

    def run(pix: np.ndarray, i: np.ndarray, t: np.ndarray, trend: np.ndarray, stim: np.ndarray) -> tuple[np.ndarray, ...]:
        _, first = np.unique(i, return_index=True)
        t, stim = t[first], stim[first]
        pix, _, m = _by_pixel(pix, i, trend)
        jumps = np.flatnonzero(np.diff(t) > 1) + 1  # where samples are missing
        added, keep = G.retrend(m, jumps, stim, quadratic)
        n = int(keep.sum())
        return np.repeat(pix, n), np.tile(np.flatnonzero(keep), len(m)), np.tile(t[keep], len(m)), added[:, keep].ravel()

    return _per_part(detrended.select("rec", part, "pix", "i", "t", "trend", "stim"), "rec long, pix long, i long, t long, v double", run)
