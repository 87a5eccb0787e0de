"""A hierarchical Pitman-Yor model of word pairs: seating by Gibbs sampling, scores from averaged predictive probabilities.

Each context word is a restaurant whose dishes are the next words. Context words fall into groups by hash, as many as the corpus
needs for groups of about GROUP_TOKENS tokens; the restaurants of a group share a parent restaurant, whose customers are their
tables, and all parents share one base, the smoothed word distribution of the corpus. So a group depends on nothing but its own
counts and that base, is sampled as a whole in one task, both levels by removing and seating all customers of a dish again, and gives
the same result wherever it runs. Context words with more than a share of a group's tokens are split over all groups by dish; each part
reads the parent of the group where it lies. Their customers are seated beforehand, with the base for a parent, and these tables are dealt
to the parents of all groups at random: so each parent has its share of them as guests among its customers, whatever the dish.

Texts become chunks of local word numbers. Each chunk learns the corpus counts of its words, asks the groups for the probabilities
of its distinct pairs, and gets them back in the order it asked. Words are known by 64-bit hashes throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed
from .toxicity import remainder
from .workspace import Workspace

#: Tokens of a chunk and of a group, the share of a group's tokens that splits a context.
CHUNK, GROUP_TOKENS, SPLIT = 800_000, 2_000_000, 0.125
#: Sweeps before the first sample, samples averaged, sweeps from one to the next.
BURN, SAMPLES, BETWEEN = 3, 3, 1
#: Discount and strength of contexts and of their parents, whose law is known in closed form for a half.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 1.0, 0.5, 10.0
#: Parts of the dishes that are seated after each other within a sweep; weights held together.
PARTS, CELLS = 4, 1 << 17
#: Terms of the series for many customers of a dish.
TERMS = 64
END = 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def make_chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(chunk, keys, train, n, vocab, ids, tokens): documents gathered to CHUNK tokens; ids, packed, number the vocab hashes by frequency, one
    END after each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, seq = xxhash.xxh3_64_intdigest, 0
        train, n, parts, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            vocab, ids, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            vocab, ids = vocab[order], rank[ids]
            chunk = TaskContext.get().partitionId() << 32 | seq
            arrays = [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(keys_arrays)), pa.array([train], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())), pa.array([vocab.tobytes()]), pa.array([pack(ids[None])]), pa.array([len(ids)])]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "keys", "train", "n", "vocab", "ids", "tokens"])

        keys_arrays = []
        for batch in batches:
            first = 0
            for i, (t, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                words = (x.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
                h[-1] = END
                parts.append(h)
                train.append(t)
                n.append(len(h))
                total += len(h)
                if total >= CHUNK:
                    keys_arrays.append(batch.column(0).slice(first, i + 1 - first))
                    yield row()
                    train, n, parts, total, keys_arrays, first, seq = [], [], [], 0, [], i + 1, seq + 1
            if first < batch.num_rows:
                keys_arrays.append(batch.column(0).slice(first))
        if parts:
            yield row()

    rows = docs.select(F.col(key).alias("key"), (remainder(key) != 1).alias("train"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), f"chunk long, keys array<{kind}>, train array<boolean>, n array<long>, vocab binary, ids binary, tokens long")


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def stretch(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack(x: np.ndarray) -> bytes:
    """Rows of int32 as planes of their bytes, compressed: most numbers are small."""
    x = np.ascontiguousarray(x, np.int32)
    return squeeze(x.view(np.uint8).reshape(*x.shape, 4).transpose(0, 2, 1).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(stretch(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, 4, n).transpose(0, 2, 1)).view(np.int32)[:, :, 0] if n else np.zeros((0, 0), np.int32)


def _wide(counts: np.ndarray) -> np.ndarray:
    """Counts of any size as two rows of int32."""
    return np.stack([counts & 0x7FFFFFFF, counts >> 31]).astype(np.int32)


def _narrow(rows: np.ndarray) -> np.ndarray:
    return rows[0].astype(np.int64) | rows[1].astype(np.int64) << 31


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary of a chunk's row in order of hash, and its token numbers."""
    vocab = np.frombuffer(row["vocab"], np.uint64)
    order = np.argsort(vocab)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return vocab[order], rank[unpack(row["ids"], sum(row["n"]))[0]]


class Chunk:
    """One chunk with its distinct pairs in the order in which groups are asked. count: the corpus counts of its vocabulary. split_only:
    with no pairs but those of split contexts in training texts."""

    def __init__(self, row: dict, count: np.ndarray, groups: int, split_only: bool = False):
        n = np.array(row["n"], np.int64)
        self.vocab, self.ids = opened(row)
        self.count = count
        self.doc = np.repeat(np.arange(len(n)), n)
        self.train = np.array(row["train"], bool)[self.doc]
        end = int(np.searchsorted(self.vocab, np.uint64(END)))
        before = np.r_[end, self.ids[:-1]] if len(self.ids) else self.ids  # every document follows an END
        some = np.flatnonzero(self.train & (count[before] > SPLIT * GROUP_TOKENS)) if split_only else slice(None)
        pair, of = np.unique((before * len(self.vocab) + self.ids)[some], return_inverse=True)
        u, w = pair // max(1, len(self.vocab)), pair % max(1, len(self.vocab))
        times = np.bincount(of[self.train[some]], minlength=len(pair))
        split = count[u] > SPLIT * GROUP_TOKENS
        h = self.vocab[u]
        group = (_mix(np.where(split, h ^ _mix(self.vocab[w]), h)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((w, u, group))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.u, self.w, self.group, self.times, self.split, self.of = u[order], w[order], group[order], times[order], split[order], place[of]

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """(group, request): the words and their corpus counts, then the contexts with their numbers of dishes, the dishes
        and their counts in the chunk's training texts, words as numbers among the request's own."""
        cut = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1], True]) if len(self.group) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            u, w = self.u[a:b], self.w[a:b]
            at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            words, of = np.unique(np.concatenate([u[at], w]), return_inverse=True)
            parts = [self.vocab[words].tobytes(), pack(_wide(self.count[words])), pack(np.stack([of[: len(at)], np.diff(np.r_[at, b - a])])), pack(np.stack([of[len(at) :], self.times[a:b]]))]
            head = np.array([b - a, len(at), len(words), *map(len, parts)], np.int64)
            yield int(self.group[a]), b"".join([head.tobytes(), *parts])


def _request(data: bytes) -> tuple[np.ndarray, ...]:
    """(contexts, their corpus counts, each pair's, dishes, their corpus counts, each pair's, times) of a request: hashes, and numbers of them."""
    n, k, m, *sizes = np.frombuffer(data, np.int64, 7).tolist()
    stops = np.cumsum([56, *sizes]).tolist()
    words, counts, rooms, pairs = (data[a:b] for a, b in zip(stops[:-1], stops[1:]))
    of, dishes = unpack(rooms, k)
    w, times = unpack(pairs, n)
    words, counts = np.frombuffer(words, np.uint64), _narrow(unpack(counts, m))
    return words[of], counts[of], np.repeat(np.arange(k), dishes), words, counts, w, times


def _guests(words: np.ndarray, counts: np.ndarray, times: np.ndarray) -> bytes:
    parts = [pack(_wide(counts)), pack(times[None])]
    return b"".join([np.array([len(words), len(parts[0])], np.int64).tobytes(), words.tobytes(), *parts])


def _guests_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dishes, their corpus counts, guests) as packed by _guests()."""
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    a, b = 16 + 8 * n, 16 + 8 * n + size
    return np.frombuffer(data, np.uint64, n, 16), _narrow(unpack(data[a:b], n)), unpack(data[b:], n)[0].astype(np.int64)


class Laws:
    """How many tables n customers of one dish take where new tables need no strength: log P(t) for t = 1, 2, ...

    The weight of t tables in any restaurant is that probability times a product over the tables. Where the discount is a half it
    has a closed form; else it follows from n - 1 customers, for the first `most` tables, all that a sampler needs if what lies
    beyond weighs nothing. So many customers that these are few tables among the n ** discount to be expected have a series, so
    that steps from one customer to the next depend on `most`, not on n. Laws end where floats do; widen() makes room for more
    tables, or for smaller numbers.
    """

    def __init__(self, n: np.ndarray, discount: float):
        self.n, self.discount, self.most, self.kind, self.rows = np.unique(n), discount, 256, np.float64, {}

    def __call__(self, n: int) -> np.ndarray:
        if not self.rows:
            self._make()
        return self.rows[n]

    def widen(self, n: int) -> None:
        if len(self.rows[n]) < min(n, self.most):
            self.kind = np.longdouble
        else:
            self.most *= 4
        self.rows = {}

    def _make(self) -> None:
        many = self.n[self.n**self.discount >= self.most / reach(self.discount)]
        self.rows = dict(zip(many.tolist(), many_law(many, self.most, self.discount)))
        self._step(self.n[: len(self.n) - len(many)])

    def _step(self, n: np.ndarray) -> None:
        last, d = int(n.max(initial=1)), self.discount
        width, wanted = min(self.most, last), set(n.tolist())
        t = np.arange(width + 1, dtype=self.kind)
        row = np.zeros_like(t[1:])
        row[0] = 1
        for n in range(1, last + 1):
            if n in wanted:
                held = row[: min(n, width)]
                whole = held > 1e8 * np.finfo(self.kind).tiny
                self.rows[n] = np.log(held[: len(held) if whole.all() else int(np.argmin(whole))]).astype(np.float64)
            k = min(n + 1, width)
            moved = row[: k - 1] * (d * t[1:k])
            row[:k] *= n - d * t[1 : k + 1]
            row[1:k] += moved
            row[:k] /= n


def reach(discount: float) -> float:
    """The most tables, as a share of n ** discount, for which the terms that many_law() leaves out weigh under 1e-18 and none loses digits."""
    return min(1.0, math.exp((math.log(1e-18) + math.lgamma(TERMS + 1) - math.lgamma(discount * TERMS + 1)) / TERMS))


def many_law(n: np.ndarray, most: int, discount: float) -> np.ndarray:
    """log P(t) of each of many customers n, for t = 1, ... most: P(t) = n / (t d) [z^n] (1 - (1 - z)^d)^t, by the binomial series.
    Its j-th term has C(t, j) = O(t^j) and, of (1 - z)^(d j), Gamma(n - d j) / Gamma(n) = O(n^(-d j)), here by Stirling's formula."""
    j, t = np.arange(1.0, TERMS + 1), np.arange(1.0, most + 1)
    choose = np.cumprod((t - j[:, None] + 1) / (most * j[:, None]), axis=0)  # C(t, j) / most^j
    a, m = discount * j, n[:, None].astype(np.float64)
    ratio = (m - a - 0.5) * np.log1p(-a / m) + a + (1 / (m - a) - 1 / m) / 12 - (1 / (m - a) ** 3 - 1 / m**3) / 360
    size = np.array([math.lgamma(x + 1) for x in a]) + ratio + j * math.log(most) - a * np.log(m)
    signs = -np.sin(np.pi * (a % 2)) * (-1.0) ** j
    return np.log((signs * np.exp(size)) @ choose / (np.pi * discount * t))


def half_law(n: np.ndarray, t: np.ndarray, factorials: np.ndarray) -> np.ndarray:
    """Laws of a discount of a half. factorials: the logarithms of 0!, 1!, ... (2 max(n))!."""
    m = 2 * n - t
    return np.log(2.0 * n / m) + factorials[m] - factorials[n] - factorials[n - t] - m * np.log(2)


class Group:
    """The restaurants of one group and their parent, sampled together. Pairs (u, w) are sorted and occur c > 0 times; total is the
    corpus count of each context; split contexts read the parent, whose customers are the tables of the others and, of each dish, its guests.

    What customers do beyond the number of tables of their dish has no bearing on any probability, so that it is summed out: the tables
    of all customers of a dish are drawn at once, by their law, whatever their number.
    """

    def __init__(self, room: np.ndarray, dish: np.ndarray, c: np.ndarray, total: np.ndarray, split: np.ndarray, base: np.ndarray, seed: int, guests: np.ndarray | None = None):
        self.rng = np.random.default_rng(seed)
        self.room, self.dish, self.c, self.base = room, dish, c, base
        self.rooms, self.dishes = len(total), len(base)
        own = np.bincount(room, weights=c, minlength=self.rooms)
        self.scale = np.where(split, total / np.maximum(own, 1), 1.0)  # of a split context's tables to those of all its parts
        self.cold = ~split[room]
        self.t = np.ones(len(c), np.int64)
        self.tables = np.bincount(room, minlength=self.rooms)  # of each room
        guests = np.zeros(self.dishes, np.int64) if guests is None else guests
        self.served = np.bincount(dish[self.cold], minlength=self.dishes) + guests  # tables of each dish in unsplit rooms and guests: the customers of the parent
        self.above = (self.served > 0).astype(np.int64)  # the parent's tables
        self.customers = int(self.served.sum())
        free = np.flatnonzero(c > 1)  # one customer alone has one table
        self.laws = Laws(c[free], DISCOUNT)
        self.parts = [self._batches(free[k::PARTS]) for k in range(PARTS)]
        self.factorials = np.r_[0.0, np.cumsum(np.log(np.arange(1.0, 2 * max(1, int((np.bincount(dish[self.cold], weights=c[self.cold], minlength=self.dishes) + guests).max(initial=1))) + 1)))]
        self.sweep()

    def _batches(self, p: np.ndarray) -> list[np.ndarray]:
        """Pairs with the same number of customers, some at a time."""
        p = p[np.argsort(self.c[p], kind="stable")]
        c = self.c[p]
        cut = np.r_[np.flatnonzero(np.r_[True, c[1:] != c[:-1]]), len(p)] if len(p) else [0]
        return [p[at : min(at + step, b)] for a, b in zip(cut[:-1], cut[1:]) for step in [max(1, CELLS // int(c[a]))] for at in range(a, b, step)]

    def _strength(self) -> float:
        return PARENT_STRENGTH + PARENT_DISCOUNT * self.above.sum()

    def prior(self) -> np.ndarray:
        """The parent's probability of each dish, given its tables and the customers it has just now."""
        left = np.maximum(self.served - PARENT_DISCOUNT * np.minimum(self.above, self.served), 0)
        return (left + self._strength() * self.base) / (PARENT_STRENGTH + self.customers)

    def _draw(self, weights: np.ndarray) -> np.ndarray:
        """A row of each column, by weights given as logarithms."""
        weights -= weights.max(0)
        np.exp(weights, out=weights)
        np.cumsum(weights, axis=0, out=weights)
        return (weights < self.rng.random(weights.shape[1]) * weights[-1]).sum(0)

    def _reseat(self, p: np.ndarray, strength: float) -> None:
        """All customers of the pairs p, equally many of each, leave and sit down again."""
        r, d, cold, n = self.room[p], self.dish[p], self.cold[p].astype(np.int64), int(self.c[p[0]])
        tables = STRENGTH + DISCOUNT * (self.tables[r] - self.t[p]) * self.scale[r]
        m = self.served[d] - cold * self.t[p]
        above, everyone = np.minimum(self.above[d], m + n), PARENT_STRENGTH + self.customers - cold * self.t[p]
        read = (np.maximum(m - PARENT_DISCOUNT * above, 0) + strength * self.base[d]) / (PARENT_STRENGTH + self.customers)
        while True:
            law = self.laws(n)
            j = np.arange(1.0, len(law))[:, None]  # tables there before the next
            k = m + j  # the parent's customers, at least as many as its tables: so many more arrangements has one more
            up = np.where(k >= above, (2 * k - above + 1) * (2 * k - above) / (4 * np.maximum(k + 1 - above, 1)), 1.0) / (everyone + j)
            weights = np.repeat(law[:, None], len(p), 1)
            weights[1:] += np.cumsum(np.log((tables + DISCOUNT * j) * np.where(cold, up, read) / (DISCOUNT * j)), axis=0)
            weights[np.arange(1, len(law) + 1)[:, None] < (above - m) * cold] = -np.inf
            if len(law) == n or (weights[-1] < weights.max(0) - 35).all():  # e ** -35 is beyond what a sum of floats tells
                break
            self.laws.widen(n)
        more = 1 + self._draw(weights) - self.t[p]
        self.t[p] += more
        np.add.at(self.tables, r, more)
        np.add.at(self.served, d, cold * more)
        self.customers += int((cold * more).sum())

    def _reseat_above(self) -> None:
        """The same for the parent, whose customers are the tables below."""
        self.above = np.minimum(self.above, self.served)
        self.above[self.served == 1] = 1
        live = np.flatnonzero(self.served > 1)
        live = live[np.argsort(self.served[live], kind="stable")]
        at = 0
        while at < len(live):
            p = live[at : at + max(1, CELLS // int(self.served[live[at]]))]
            p = p[: max(1, int(np.searchsorted(self.served[p] * np.arange(1, len(p) + 1), 2 * CELLS)))]
            n, tables = self.served[p], PARENT_STRENGTH + PARENT_DISCOUNT * (self.above.sum() - self.above[p])
            t = np.arange(1, int(n.max()) + 1)[:, None]
            weights = half_law(n, np.minimum(t, n), self.factorials)
            weights[1:] += np.cumsum(np.log((tables + PARENT_DISCOUNT * t[:-1]) * self.base[p] / (PARENT_DISCOUNT * t[:-1])), axis=0)
            weights[t > n] = -np.inf
            self.above[p] = 1 + self._draw(weights)
            at += len(p)

    def sweep(self) -> None:
        """Every customer leaves and sits down again: dish by dish below, many dishes at a time, then above."""
        strength = self._strength()
        for part in self.parts:
            for p in part:
                self._reseat(p, strength)
        self._reseat_above()

    def samples(self, burn: int = BURN, samples: int = SAMPLES, between: int = BETWEEN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of each pair, tables of each room, the parent's probability of each dish) of each sample."""
        for k in range(samples):
            for _ in range(between if k else burn):
                self.sweep()
            yield self.t, self.tables, self.prior()


def predictive(requests: list[tuple[np.ndarray, ...]], tokens: int, distinct: int, seed: int, **how: int) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """answered() for requests that are given as (u, w, times, corpus count of u, corpus count of w) of their pairs, without the parent's."""
    def numbered(u, w, n, cu, cw):
        (names, i, of), (words, j, dish) = (np.unique(x, return_index=True, return_inverse=True) for x in (u, w))
        return names, cu[i], of, words, cw[j], dish, n

    answers, _, split = answered((numbered(*r) for r in requests), tokens, distinct, seed, **how)
    return answers, split


def _joined(requests: Iterable[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray, list[int]]:
    """(contexts, their corpus counts, each pair's), the same of the dishes, times, and the numbers of pairs of the requests."""
    parts = [tuple(x.astype(np.int32) if i in (2, 5, 6) else x for i, x in enumerate(r)) for r in requests]

    def joined(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All names of the columns i, their counts and the number of each pair's."""
        names, of = np.unique(np.concatenate([r[i] for r in parts]), return_inverse=True)
        count = np.zeros(len(names), np.int64)
        count[of] = np.concatenate([r[i + 1] for r in parts])
        each = np.split(of, np.cumsum([len(r[i]) for r in parts])[:-1])
        return names, count, np.concatenate([g[r[i + 2]] for g, r in zip(each, parts)])

    return joined(0), joined(3), np.concatenate([r[6] for r in parts]), [len(r[6]) for r in parts]


def _base(count: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return (count + 0.5) / (tokens + 0.5 * (distinct + 1))


def dealt_tables(requests: Iterable[tuple[np.ndarray, ...]], tokens: int, distinct: int, seed: int, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, dishes, their corpus counts, guests): the tables of one group's parts of split contexts, seated with the base for a parent,
    each dealt to any group with the same chance."""
    (_, total, u), (words, count, w), n, _ = _joined(requests)
    pair, of = np.unique(u * len(words) + w, return_inverse=True)
    room, dish, c = pair // max(1, len(words)), pair % max(1, len(words)), np.bincount(of, weights=n).astype(np.int64)
    g = Group(room, dish, c, total, np.full(len(total), True), _base(count, tokens, distinct), seed)
    t, *_ = next(g.samples(samples=1))
    at, times = np.unique(g.rng.integers(0, groups, int(t.sum())) * len(words) + np.repeat(dish, t), return_counts=True)
    cut = np.searchsorted(at, np.arange(groups + 1) * len(words)).tolist()
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        if a < b:
            of = at[a:b] % len(words)
            yield k, words[of], count[of], times[a:b]


def answered(requests: Iterable[tuple[np.ndarray, ...]], tokens: int, distinct: int, seed: int, guests: Iterable[tuple[np.ndarray, ...]] = (), **how: int) -> tuple[list[np.ndarray], list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For each request of one group, a number a pair: its predictive probability averaged over samples, or, where the context is
    split, its count less the discounts of its tables; and for the latter the parent's probability of their dishes. Also the hashes of
    the split contexts and their tables in this group. guests: (dishes, their corpus counts, customers) beside the tables of this group."""
    (names, total, u), (words, count, w), n, sizes = _joined(requests)
    guests = [*guests]
    more, counts, times = (np.concatenate([np.zeros(0, t), *(x[i] for x in guests)]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    every = np.union1d(words, more)
    place, of = np.searchsorted(every, words), np.searchsorted(every, more)
    known_counts = np.zeros(len(every), np.int64)
    known_counts[of], known_counts[place] = counts, count
    words, count, w = every, known_counts, place[w]
    guest = np.bincount(of, weights=times, minlength=len(words)).astype(np.int64)
    base = _base(count, tokens, distinct)
    pair, of = np.unique(u * len(words) + w, return_inverse=True)
    del u, w
    of = of.astype(np.int32)
    room, dish, c = (pair // max(1, len(words))).astype(np.int32), (pair % max(1, len(words))).astype(np.int32), np.bincount(of, weights=n, minlength=len(pair)).astype(np.int64)
    del pair, n
    split = total > SPLIT * GROUP_TOKENS
    # what is only asked for takes no part: the sampled state depends on the training counts alone
    known = np.flatnonzero(c > 0)
    in_rooms, in_dishes = np.unique(room[known]), np.union1d(dish[known], np.flatnonzero(guest))
    g = Group(np.searchsorted(in_rooms, room[known]), np.searchsorted(in_dishes, dish[known]), c[known], total[in_rooms], split[in_rooms], base[in_dishes], seed, guest[in_dishes])
    hot = split[room]
    out, ups, tables, k = np.zeros(len(c)), np.zeros(int(hot.sum())), np.zeros(len(names)), 0
    for t, of_room, prior in g.samples(**how):
        left, t_room = c.astype(np.float64), np.zeros(len(names))
        left[known] -= DISCOUNT * t
        t_room[in_rooms] = of_room
        up = g._strength() / (PARENT_STRENGTH + g.customers) * base
        up[in_dishes] = prior
        cold = (left + (STRENGTH + DISCOUNT * t_room[room]) * up[dish]) / (STRENGTH + total[room])
        out += np.where(hot, left, cold)
        ups += up[dish[hot]]
        tables += t_room
        k += 1
    cuts = np.cumsum(sizes)[:-1]
    answers, place = np.split((out / k)[of], cuts), np.cumsum(hot) - 1
    above = [(ups / k)[place[x[hot[x]]]] for x in np.split(of, cuts)]
    return answers, above, (names[split], tables[split] / k)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each holds a chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_counts(chunks: DataFrame, buckets: int, work: Workspace) -> tuple[DataFrame, int, int, int]:
    """(chunk, bucket, size, counts): for each chunk the training counts of its words over all chunks, in order of hash within
    each bucket; tokens and distinct words of all training texts, and the count of the most frequent one."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vocab, ids = opened(row)
            n = np.bincount(ids[np.repeat(np.array(row["train"], bool), row["n"])], minlength=len(vocab))
            bucket = (_mix(vocab) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == b)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([row["chunk"]]), pa.array([vocab[at].tobytes()]), pa.array([pack(n[at][None])])], names=["bucket", "chunk", "words", "n"])

    def add(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(x, np.uint64) for x in pdf["words"]]
        names, of = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([unpack(x, len(w))[0] for x, w in zip(pdf["n"], words)]), minlength=len(names)).astype(np.int64)
        parts = np.split(n[of], np.cumsum([len(w) for w in words])[:-1])
        stats = [int((n > 0).sum()), int(n.sum()), int(n.max(initial=0))]
        out = [(int(k), int(key_[0]), len(x), pack(_wide(x)), *(stats if i == 0 else (0, 0, 0))) for i, (k, x) in enumerate(zip(pdf["chunk"], parts))]
        return pd.DataFrame(out, columns=["chunk", "bucket", "size", "counts", "distinct", "total", "most"])

    told = chunks.select("chunk", "n", "train", "vocab", "ids").mapInArrow(tell, "bucket long, chunk long, words binary, n binary")
    found = work.write(told.groupBy("bucket").applyInPandas(add, "chunk long, bucket long, size long, counts binary, distinct long, total long, most long"), "counts")
    distinct, total, most = (x or 0 for x in found.agg(F.sum("distinct"), F.sum("total"), F.max("most")).first())
    return found.select("chunk", "bucket", "size", "counts"), total, distinct, most


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Learned from the rows whose crc32(key as text) mod 5 is not 1 (null keys are learned from). Tokens are the words and one
    end; base_score is the log10 probability under the smoothed word distribution, score that under the model, the
    predictive probabilities of SAMPLES seatings averaged for each token. Scores depend on the rows alone, not on how they
    are dealt to tasks. Null and empty texts are one end; rows repeated count and answer each for itself. Without training
    rows the words are uniform; an empty table has no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "pitman-yor")
    kind = docs.schema[key].dataType.simpleString()
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # of words; results do not depend on it
    chunks = work.write(make_chunks(docs, text, key), "chunks")
    counts, tokens, distinct, most = _word_counts(chunks, buckets, work)
    groups = max(8, -(-tokens // GROUP_TOKENS))
    known = counts.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "size", "counts")).alias("known"))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vocab = np.sort(np.frombuffer(row["vocab"], np.uint64))
            n = np.empty(len(vocab), np.int64)
            order = np.argsort((_mix(vocab) % np.uint64(buckets)).astype(np.int64), kind="stable")
            n[order] = np.concatenate([_narrow(unpack(k["counts"], k["size"])) for k in sorted(row["known"], key=lambda k: k["bucket"])])
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([squeeze(n.tobytes())])], names=["chunk", "count"])

    own = work.write(chunks.select("chunk", "vocab").join(known, "chunk").mapInArrow(learned, "chunk long, count binary"), "known")
    work.drop("counts")
    ready = work.write(chunks.join(own, "chunk"), "ready")  # what follows reads whole chunks, without dealing them again but once
    for gone in ("chunks", "known"):
        work.drop(gone)
    work.release()

    def chunk_of(row: dict, split_only: bool = False) -> Chunk:
        return Chunk(row, np.frombuffer(stretch(row["count"]), np.int64), groups, split_only)

    def asking(split_only: bool) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                for group, data in chunk_of(row, split_only).requests():
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([row["chunk"]]), pa.array([data])], names=["group", "chunk", "data"])

        return ready.select("chunk", "n", "train", "vocab", "ids", "count").mapInArrow(trimmed(ask), "group int, chunk long, data binary")

    def host(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        dealt = dealt_tables(map(_request, pdf["data"]), tokens, distinct, -1 - int(key_[0]) & 0xFFFFFFFF, groups)
        return pd.DataFrame([(k, -1, _guests(*x)) for k, *x in dealt], columns=["group", "chunk", "data"])

    def restaurants(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        come = pdf["chunk"] == -1  # in an order that doesn't depend on how rows were dealt
        guests, pdf = map(_guests_of, sorted(pdf["data"][come])), pdf[~come]
        if not len(pdf):
            return pd.DataFrame(columns=["chunk", "group", "answer", "above", "split", "tables"])
        found, above, (u, t) = answered(map(_request, pdf["data"]), tokens, distinct, 1 + int(key_[0]), guests)
        none = [None] * len(found)
        packed = lambda arrays: [*(x.astype(np.float32).tobytes() for x in arrays), None]
        return pd.DataFrame({"chunk": [*pdf["chunk"], -1], "group": int(key_[0]), "answer": packed(found), "above": packed(above), "split": [*none, u.tobytes()], "tables": [*none, t.tobytes()]})

    # groups are numbered from 0 on, so each is a task of its own: by hash several would share one
    asked = asking(False)
    if most > SPLIT * GROUP_TOKENS:
        guests_ = work.write(asking(True).repartitionById(groups, "group").groupBy("group").applyInPandas(host, "group int, chunk long, data binary"), "guests")
        work.release()
        asked = asked.union(guests_)
    answers = work.write(asked.repartitionById(groups, "group").groupBy("group").applyInPandas(restaurants, "chunk long, group long, answer binary, above binary, split binary, tables binary"), "answers")
    work.release()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["split"], np.int64)), pa.array(np.frombuffer(row["tables"], np.float64))], names=["u", "t"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vocab, count = np.sort(np.frombuffer(row["vocab"], np.uint64)), np.frombuffer(stretch(row["count"]), np.int64)
            u = vocab[count > SPLIT * GROUP_TOKENS].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), row["chunk"])), pa.array(u)], names=["chunk", "u"])

    # the tables of split contexts over all groups: each chunk gets those of its own words
    tables = answers.where("chunk = -1").select("split", "tables").mapInArrow(spread, "u long, t double").groupBy("u").agg(F.sum("t").alias("t"))
    tables = ready.select("chunk", "vocab", "count").mapInArrow(wanted, "chunk long, u long").join(tables, "u").groupBy("chunk").agg(F.collect_list(F.struct("u", "t")).alias("tables"))
    pairs = answers.where("chunk <> -1").groupBy("chunk").agg(F.collect_list(F.struct("group", "answer", "above")).alias("pairs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = chunk_of(row)
                p, above = (np.concatenate([np.frombuffer(a[x], np.float32) for a in sorted(row["pairs"], key=lambda a: a["group"])]).astype(np.float64) for x in ("answer", "above"))
                base = (c.count + 0.5) / (tokens + 0.5 * (distinct + 1))
                s = np.flatnonzero(c.split)
                if len(s):
                    t = np.zeros(len(c.vocab))
                    for x in row["tables"]:
                        t[np.searchsorted(c.vocab, np.uint64(x["u"] % (1 << 64)))] = x["t"]
                    u = c.u[s]
                    p[s] = (p[s] + (STRENGTH + DISCOUNT * t[u]) * above) / (STRENGTH + c.count[u])
                k = len(row["n"])
                add = lambda x: np.bincount(c.doc, weights=x, minlength=k)
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(~np.array(row["train"], bool)), pa.array(np.array(row["n"], np.int64)), pa.array(add(c.count[c.ids] > 0).astype(np.int64)), pa.array(np.full(k, tokens, np.int64)), pa.array(add(np.log10(base)[c.ids])), pa.array(add(np.log10(p)[c.of]))], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    done = ready.select("chunk", "keys", "n", "train", "vocab", "ids", "count").join(pairs, "chunk").join(tables, "chunk", "left").mapInArrow(trimmed(finish), f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("key", key)
