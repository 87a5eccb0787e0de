"""A factorization machine over hashed terms that scores texts for toxicity."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed
from .workspace import Workspace

#: Hashed terms, factors of a term, labelled rows of each class at most, passes, words that a task remembers.
TERMS, FACTORS, MOST_TOXIC, MOST_CLEAN, PASSES, REMEMBERED = 1 << 18, 8, 4000, 12_000, 12, 200_000
#: Distinct terms of the labelled rows of each class at most (a row that alone has more counts as a whole).
MOST_TERMS = 12_000_000
#: Deviations from chance that keep a term, or both terms of a pair; the most frequent terms, whose pairs are looked at.
LEAST_Z, PAIR_Z, PAIRED = 4.0, 7.0, 3072
_WORD = re.compile(r"[^\W\d_]+").findall


class Terms:
    """Texts to sorted distinct term numbers: each word, and its first 4 and 5 letters, for stems with many endings."""

    def __init__(self, size: int = TERMS):
        self.size, self.known = size, {}

    def of_word(self, w: str) -> tuple[int, ...]:
        names = {f"w{w}"} | {f"{n}{w[:n]}" for n in (4, 5) if len(w) >= n}
        found = tuple(zlib.crc32(x.encode("utf-8", "replace")) % self.size for x in names)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[w] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        get, out = self.known.get, set()
        for w in set(_WORD((text or "").lower())):
            out.update(get(w) or self.of_word(w))
        return np.sort(np.fromiter(out, np.int32, len(out)))


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs of <v_i, v_j>) over the terms (sorted numbers) that it knows and a text has."""

    bias: float
    terms: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """The scores of texts, given their term numbers, all at once."""
        flat = np.concatenate([np.zeros(0, np.int32), *rows])
        text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(self.terms, flat), max(0, len(self.terms) - 1))
        use = np.flatnonzero(self.terms[at] == flat) if len(self.terms) else np.zeros(0, np.int64)
        at, text = at[use], text[use]
        z = self.bias + np.bincount(text, weights=self.weight[at], minlength=len(rows))
        for v in self.factor.T:
            one = v[at]
            total, square = (np.bincount(text, weights=x, minlength=len(rows)) for x in (one, one * one))
            z += 0.5 * (total * total - square)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chosen_terms(rows: list[np.ndarray], labels: np.ndarray, size: int, least_z: float = LEAST_Z, pair_z: float = PAIR_Z, paired: int = PAIRED) -> np.ndarray:
    """Sorted numbers of the terms worth weights: those whose frequency under label 1 differs from chance by least_z deviations,
    and both terms of every pair whose texts have label 1 pair_z deviations more or less often than both terms make expect.

    Pairs are those of the `paired` most frequent terms; what two terms make expect is the sum of their log odds. So a pair that
    matters only as a pair is found, and one beside a telling term adds nothing.
    """
    n, share = len(rows), float(labels.mean())
    seen, under = np.zeros(size, np.int64), np.zeros(size)
    for at in range(0, n, 1024):  # some texts at a time: the driver holds no second copy of all their terms
        some, own = rows[at : at + 1024], labels[at : at + 1024]
        flat = np.concatenate(some)
        seen += np.bincount(flat, minlength=size)
        under += np.bincount(flat, weights=np.repeat(own, [len(r) for r in some]), minlength=size)
    kept = np.abs(under - seen * share) > least_z * np.sqrt(seen * share * (1 - share))
    often = np.argsort(-seen, kind="stable")[:paired]
    often = np.sort(often[(seen[often] >= 16) & (seen[often] < n)])
    if len(often):
        odds = lambda p: np.log(p / (1 - p))
        own = odds((under[often] + share) / (seen[often] + 1)) - odds(share)
        has = np.zeros((n, len(often)), bool)
        of = np.full(size, -1, np.int32)
        of[often] = np.arange(len(often))
        for i, k in enumerate(np.argsort(-labels, kind="stable").tolist()):
            at = of[rows[k]]
            has[i, at[at >= 0]] = True
        toxic = int(labels.sum())
        for a in range(0, len(often), 256):
            both, bad = np.zeros((min(256, len(often) - a), len(often) - a), np.float32), None
            for lo, hi in ((0, toxic), (toxic, n)):  # those of label 1 first
                for b in range(lo, hi, 2048):
                    part = has[b : min(hi, b + 2048), a:].astype(np.float32)
                    both += part[:, :256].T @ part
                bad = both.copy() if bad is None else bad
            expect = 1 / (1 + np.exp(-(odds(share) + own[a : a + 256, None] + own[None, a:])))
            room = both * expect * (1 - expect)
            far = (np.abs(bad - both * expect) > pair_z * np.sqrt(room)) & (room >= 4)
            far[np.tril_indices(len(far), 0, len(often) - a)] = False
            i, j = np.nonzero(far)
            kept[often[a + i]] = kept[often[a + j]] = True
    return np.flatnonzero(kept).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = TERMS, factors: int = FACTORS, passes: int = PASSES, rate: float = 0.15, decay: float = 1e-4, seed: int = 1, **choice: float) -> Machine:
    """Adagrad on the logistic loss, one text at a time, over the terms that chosen_terms() picks. With one label alone, or
    without rows, every score is near 0 or 1 and no term counts."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Machine(30.0 if share else -30.0, np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    terms = chosen_terms(rows, labels, size, **choice)
    of = np.full(size, -1, np.int32)
    of[terms] = np.arange(len(terms))
    rows = [of[r][of[r] >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(len(terms)), rng.normal(0, 0.1, (len(terms), factors))
    bias, g_bias = float(np.log(share / (1 - share))), 1.0
    g_weight, g_factor = np.full(len(terms), 1.0), np.full((len(terms), factors), 0.1)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            t = rows[i]
            v = factor[t]
            total = v.sum(0)
            z = bias + float(weight[t].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())
            g = 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) - labels[i]
            if abs(g) < 1e-3:
                continue
            g_bias += g * g
            bias -= rate * g / np.sqrt(g_bias)
            step = g + decay * weight[t]
            g_weight[t] += step * step
            weight[t] -= rate * step / np.sqrt(g_weight[t])
            step = g * (total - v) + decay * v
            g_factor[t] += step * step
            factor[t] -= 0.3 * rate * step / np.sqrt(g_factor[t])
    return Machine(bias, terms, weight.astype(np.float32), factor.astype(np.float32))


def remainder(key: str, parts: int = 5) -> Column:
    """crc32 of the key as text, modulo parts; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", where: Column | None = None, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_terms: int = MOST_TERMS) -> Machine:
    """A machine fitted on a bounded sample: of the labelled keys that satisfy where, the most_toxic of label 1 and the
    most_clean of label 0 with the least hashes, as far as their texts have most_terms distinct terms a class in all.

    A key labelled more than once has its largest label; null keys, null labels and labels without a text are left out; a text
    that is null counts as empty, and rows that repeat a key count each. One task fits the sample's term numbers; the driver gets the weights.
    """
    ship(docs.sparkSession)
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = (known.where(where) if where is not None else known).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    least = lambda value, n: known.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(n)
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(least(1, most_toxic).union(least(0, most_clean))), "_key")  # at most 16,000 keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["k", "label", "n", "terms"])

    found = work.write(chosen.select("_key", "_label", "text").mapInArrow(trimmed(run), f"k {docs.schema[key].dataType.simpleString()}, label int, n long, terms binary"), "sample")
    # where a class has more terms than that, the hash beyond which its texts are left out; the driver gets three numbers a text
    order, room, last = F.xxhash64("k", F.xxhash64("terms")), {}, {}
    for r in sorted(found.select("label", order.alias("h"), "n").collect(), key=lambda r: (r.label, r.h)):
        if room.setdefault(r.label, 0) < most_terms:
            last[r.label] = r.h
        room[r.label] += r.n
    within = F.lit(False)
    for value, h in last.items():
        within = within | ((F.col("label") == value) & (order <= h))
    chosen = found.where(within).select("k", "label", "terms")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        rows.sort(key=lambda r: (str(r[0]), hashlib.sha256(r[2]).digest()))
        m = fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.float64))
        yield pa.RecordBatch.from_pydict({"bias": [m.bias], "terms": [m.terms.tobytes()], "weight": [m.weight.tobytes()], "factor": [m.factor.tobytes()]})

    # the sample's terms fit one task; the driver gets the weights
    r = chosen.coalesce(1).mapInArrow(trimmed(fitted), "bias double, terms binary, weight binary, factor binary").first()
    work.drop()
    if r is None:  # without rows there may be no task
        return fit([], np.zeros(0))
    return Machine(r.bias, *(np.frombuffer(x, kind) for x, kind in ((r.terms, np.int32), (r.weight, np.float32))), np.frombuffer(r.factor, np.float32).reshape(-1, FACTORS))


def _scored(machine: Machine, texts: pa.Array, terms: Terms) -> np.ndarray:
    """The scores of a column of texts, some at a time."""
    parts = [machine.scores([terms.of(x.as_py()) for x in texts[at : at + 256]]) for at in range(0, len(texts), 256)]
    return np.concatenate([np.zeros(0), *parts])


def score(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score): the score of every whole text; null and empty texts have that of no terms. Rows repeated, or without a key,
    give their row like any other."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(machine, batch.column(1), terms))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), f"key {kind}, score double").withColumnRenamed("key", key)


def reject(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score the threshold or more; columns as before, whole rows scored in place. A null text scores
    as an empty one and its row stays or goes by that; keys are not looked at."""
    ship(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            yield batch.filter(pa.array(_scored(machine, batch.column(at), terms) < threshold))

    return docs.mapInArrow(trimmed(run), schema)
