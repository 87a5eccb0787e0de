"""Periodic runs of words by the runs theorem, and texts with their repetitions collapsed.

Every run has, under one of the two orders of words, a Lyndon root that is the longest Lyndon word at its place. Longest Lyndon words
end at the next smaller suffix, so one suffix array gives those of both orders: next smaller and next greater values of its inverse.
Roots are extended to the right by common extensions, minima over ranges of the LCP array by a sparse table, and those that can
still make a run of the least length to the left by the same tables of the reversed text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed

#: Words of a run at least, and periods; words handled together (a longer text alone).
LENGTH, PERIODS, TOGETHER = 24, 3, 1 << 17
#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"


def _order(key: np.ndarray) -> np.ndarray:
    """A permutation that sorts non-negative keys; sorts keys and places in one word where both fit."""
    bits = max(1, len(key) - 1).bit_length()
    if int(key.max(initial=0)) < 1 << (63 - bits):
        return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


class Suffixes:
    """Suffix array, its inverse and common extensions of texts laid end to end.

    symbol: words as numbers from 1, with a 0 after each text; text: the number of the text at each place. Suffixes of different
    texts share nothing, those of earlier texts are smaller, and the end of a text is smaller than any word of it.
    """

    def __init__(self, symbol: np.ndarray, text: np.ndarray):
        n = len(symbol)
        key = text * (int(symbol.max(initial=0)) + 1) + symbol
        self.sa = _order(key)
        key = key[self.sa]
        at, first = np.arange(n), np.r_[True, key[1:] != key[:-1]]
        self.rank = np.empty(n, np.int64)
        self.rank[self.sa] = np.maximum.accumulate(np.where(first, at, 0))
        levels, width, live = [], 1, self._tied(at, first)
        while len(live):  # prefix doubling among suffixes that still share their first `width` symbols
            levels.append(self.rank.astype(np.int32) if n < 1 << 31 else self.rank.copy())
            own = self.sa[live]
            head, tail = self.rank[own], self.rank[own + width]
            order = _order(np.cumsum(np.r_[0, head[1:] != head[:-1]]) * n + tail)
            own, head, tail = own[order], head[order], tail[order]
            self.sa[live] = own
            first = np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]
            self.rank[own] = np.maximum.accumulate(np.where(first, live, 0))
            live, width = self._tied(live, first), 2 * width
        lcp = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
        if levels:
            some = np.flatnonzero(levels[0][self.sa[1:]] == levels[0][self.sa[:-1]])
            a, b, shared = self.sa[some], self.sa[some + 1], np.zeros(len(some), np.int64)
            for k in range(len(levels) - 1, -1, -1):
                shared += np.where(levels[k][a + shared] == levels[k][b + shared], 1 << k, 0)
            lcp[some + 1] = shared
        longest = int(np.bincount(text).max(initial=1))
        self.least = [lcp]
        for k in range(1, longest.bit_length()):  # minima of 2**k values of the LCP array
            below, half = self.least[-1], 1 << (k - 1)
            self.least.append(np.r_[np.minimum(below[:-half], below[half:]), below[len(below) - half :]])

    @staticmethod
    def _tied(at: np.ndarray, first: np.ndarray) -> np.ndarray:
        return at[~(first & np.r_[first[1:], True])]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b, different places of one text, share."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            use, table = np.flatnonzero(k == level), self.least[level]
            out[use] = np.minimum(table[lo[use]], table[hi[use] + 1 - (1 << int(level))])
        return out


def next_less(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value, or the length."""
    out, stack = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(texts: list[np.ndarray], length: int = LENGTH, periods: int = PERIODS) -> dict[int, list[tuple[int, int, int]]]:
    """Text number to its runs (start, length, period) by start, then period; texts without runs are left out. Words are numbers
    from 1."""
    size = np.array([len(t) for t in texts], np.int64)
    symbol = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int64))]) if texts else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), size + 1)
    if not size.sum():
        return {}
    s = Suffixes(symbol, text)
    found = []
    for rank in (s.rank, -s.rank):
        i = np.arange(len(symbol))
        period = next_less(rank.tolist()) - i
        i = i[i + period < len(symbol)]
        period = period[: len(symbol)][i]
        same = (symbol[i] > 0) & (symbol[i + period] == symbol[i]) & (text[i + period] == text[i])
        i, period = i[same], period[same]
        right = i + period + s.extension(i, i + period)
        far = right - i > np.maximum(length, periods * period) - period  # to the left, less than a period is missing at the first root
        found.append(np.stack([i[far], period[far], right[far]]))
    i, period, right = np.unique(np.concatenate(found, 1), axis=1)
    if not len(i):
        return {}
    some = np.unique(text[i])
    start = np.r_[0, np.cumsum(size + 1)][:-1]
    back = np.r_[0, np.cumsum(size[some] + 1)][:-1]
    r = Suffixes(np.concatenate([x for t in some for x in (texts[t][::-1], np.zeros(1, np.int64))]), np.repeat(np.arange(len(some)), size[some] + 1))
    of = np.searchsorted(some, text[i])
    mirror = back[of] + start[text[i]] + size[text[i]] - 1 - i  # of the root's first word
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > start[text[i]])
    left[inner] = r.extension(mirror[inner] + 1, mirror[inner] + 1 - period[inner])
    at = i - left
    keep = right - at >= np.maximum(length, periods * period)
    rows = np.unique(np.stack([text[i], at - start[text[i]], period, right - at])[:, keep], axis=1)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for t, a, p, n in rows.T.tolist():
        out.setdefault(t, []).append((a, n, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        gone[a + p] += 1
        gone[a + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, periods: int = PERIODS) -> DataFrame:
    """(key, runs, collapsed): each row's maximal runs of words with `length` words and `periods` periods at least, by start, then
    period, and its words without the repeated periods, joined by one space.

    Words are what SPACE separates, compared byte by byte and counted from 0. Null and empty texts have no runs and collapse to an
    empty string; null and repeated keys give a row each; other columns are not read; an empty table gives no rows. A text is
    handled whole, in memory of some 200 bytes a word and 4 bytes a word and level of the tables.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = batch.column(0), batch.column(1).cast(pa.binary())
            held, texts, at = [], [], 0
            number = defaultdict(count(1).__next__)

            def answer(at: int, held: list[list[bytes]], texts: list[np.ndarray]) -> pa.RecordBatch:
                found = runs_of(texts, length, periods)
                lines = [b" ".join(collapse(w, found[k]) if k in found else w) for k, w in enumerate(held)]
                runs = [[{"start": a, "length": n, "period": p} for a, n, p in found.get(k, [])] for k in range(len(held))]
                struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                return pa.RecordBatch.from_arrays([keys.slice(at, len(held)), pa.array(runs, pa.list_(struct)), pa.array(lines, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"])

            size = 0
            for i, x in enumerate(raw):
                words = (x.as_py() or b"").split()
                if held and size + len(words) > TOGETHER:
                    yield answer(at, held, texts)
                    held, texts, at, size = [], [], i, 0
                    number = defaultdict(count(1).__next__)
                held.append(words)
                texts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                size += len(words)
            if held:
                yield answer(at, held, texts)

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), f"key {kind}, runs {_RUN}, collapsed string").withColumnRenamed("key", key)


def longest(runs: Column) -> Column:
    """The run with the greatest length for its period, exactly; of equal ones that of smallest start, then period; null without runs."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, where one in ten texts repeats its words from some place on: with h the crc32 of the key as text and g = h div 10, texts
    with h mod 10 = 0 and n > 0 words continue from word a = g mod n with period 1 + (n - a) div (3 + g mod 8). Others, and those of
    null keys, stay."""
    names = [F.col(f"`{c}`") for c in docs.columns if c != text]
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.withColumns({"_h": h, "_w": F.when(h % 10 == 0, F.array_remove(F.split(F.col(text), SPACE), ""))})
    g, w, n = F.floor(F.col("_h") / 10), F.col("_w"), F.size("_w")
    rows = rows.withColumns({"_a": F.when(n > 0, (g % n).cast("int")), "_g": g})
    tail = n - F.col("_a")
    rows = rows.withColumn("_p", (1 + F.floor(tail / (3 + F.col("_g") % 8))).cast("int"))
    block = F.slice(w, F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil(tail / F.col("_p")).cast("int"))), F.lit(1), tail)
    joined = F.array_join(F.concat(F.slice(w, F.lit(1), F.col("_a")), again), " ")
    return rows.select(*names, F.when((F.col("_h") % 10 == 0) & (n > 0), joined).otherwise(F.col(text)).alias(text))
