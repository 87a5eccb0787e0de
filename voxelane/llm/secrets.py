"""Secrets in texts: known formats by patterns, and further spans by probabilistic automata inferred from the credentials found.

The credentials that patterns find are the labelled examples. Of each kind, and of other candidates, a bounded sample goes into a
prefix tree with counts, whose states are merged where their futures agree within Hoeffding's bound. The automata then score every
candidate of every text: a candidate more likely a credential of some kind than anything else by MARGIN is a span of its own.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed
from .workspace import Workspace

#: The kinds in their order, their patterns and least lengths (of group 2, where there is one).
KINDS = ("assign", "access", "hex")
PATTERNS = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]{32,}"),  # of a run of these characters, all belong to the match
)
LEAST = (8, 16, 32)
#: What a candidate beside them may consist of, and its least length.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Distinct examples of a kind (and of other candidates) that an automaton is inferred from at most, and characters of one.
EXAMPLES, LONGEST = 2000, 512
#: Chance of taking equal futures for different ones, uses below which a state's future is not judged, weight of what was never seen.
ALPHA, JUDGED, UNSEEN = 1e-3, 8, 0.1
#: Natural logarithm of the odds that a span needs: candidates are a few thousand times as often none.
MARGIN = 10.0


def matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of what the patterns find, by start, then kind; a value is group 2 or the match."""
    out = []
    for kind, (pattern, least) in enumerate(zip(PATTERNS, LEAST)):
        for m in pattern.finditer(text):
            value = m[2] if pattern.groups else m[0]
            if len(value) >= least:
                out.append((m.start(), kind, m.end(), value))
    return sorted(out)


def candidates(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, value) of the runs of SYMBOLS that no match touches."""
    out, k, end = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            end = max(end, found[k][2])
            k += 1
        if end <= m.start():
            out.append((m.start(), m[0]))
    return out


class _State:
    """A state with its uses, ends, successors and how often each symbol led there; number is that of a kept state."""

    __slots__ = ("uses", "ends", "next", "led", "number")

    def __init__(self):
        self.uses, self.ends, self.next, self.led, self.number = 0, 0, {}, {}, None


def _prefix_tree(examples: list[str]) -> _State:
    root = _State()
    for text in examples:
        at = root
        at.uses += 1
        for c in text:
            at.led[c] = at.led.get(c, 0) + 1
            at = at.next.setdefault(c, _State())
            at.uses += 1
        at.ends += 1
    return root


def _alike(a: _State, b: _State) -> bool:
    """Whether the futures of two states agree: the shares of ends and of each symbol, and the states that follow."""
    spread, todo = math.sqrt(0.5 * math.log(2 / ALPHA)), [(a, b)]
    while todo:
        a, b = todo.pop()
        if min(a.uses, b.uses) < JUDGED:
            continue
        bound = spread * (a.uses**-0.5 + b.uses**-0.5)
        if abs(a.ends / a.uses - b.ends / b.uses) > bound:
            return False
        for c in a.led.keys() | b.led.keys():
            if abs(a.led.get(c, 0) / a.uses - b.led.get(c, 0) / b.uses) > bound:
                return False
            if c in a.next and c in b.next:
                todo.append((a.next[c], b.next[c]))
    return True


def _fold(into: _State, tree: _State) -> list[_State]:
    """Add the counts of a tree to the states that its strings reach from another state; the kept states with new successors."""
    todo, grown = [(into, tree)], []
    while todo:
        a, b = todo.pop()
        a.uses += b.uses
        a.ends += b.ends
        for c, y in b.next.items():
            a.led[c] = a.led.get(c, 0) + b.led[c]
            if c in a.next:
                todo.append((a.next[c], y))
            else:
                a.next[c] = y
                if a.number is not None:
                    grown.append(a)
    return grown


@dataclass
class Automaton:
    """States by number, 0 the first; weight[state, symbol] is a logarithm, the last symbol the end. What a state never saw leads to 0."""

    to: np.ndarray
    weight: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods of texts of SYMBOLS."""
        if not texts:
            return np.zeros(0)
        size = np.array([len(t) for t in texts])
        flat = _NUMBER[np.frombuffer("".join(texts).encode("ascii"), np.uint8)]
        order = np.argsort(-size, kind="stable")
        base, ends = (np.cumsum(size) - size)[order], np.searchsorted(-size[order], -np.arange(size.max()), side="left")
        state, out = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for t, n in enumerate(ends.tolist()):  # the n texts with a symbol t
            if n < 4:  # a few long ones, each by itself
                for k in range(n):
                    s, total, to, weight = int(state[k]), 0.0, self.to, self.weight
                    for c in flat[base[k] + t : base[k] + size[order[k]]].tolist():
                        total += weight[s, c]
                        s = to[s, c]
                    state[k], out[k] = s, out[k] + total
                break
            c = flat[base[:n] + t]
            out[:n] += self.weight[state[:n], c]
            state[:n] = self.to[state[:n], c]
        out += self.weight[state, -1]
        back = np.empty(len(texts))
        back[order] = out
        return back


_NUMBER = np.zeros(256, np.int64)
_NUMBER[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))


def infer(examples: list[str], unseen: float = UNSEEN) -> Automaton:
    """The automaton of examples (texts of SYMBOLS): states of the prefix tree that follow kept states are merged with the first kept
    state whose future agrees, or kept. With unseen = 0, what it never saw is impossible."""
    root = _prefix_tree(sorted(examples))
    root.number, kept, open_ = 0, [root], deque([root])
    while open_:
        s = open_.popleft()
        for c in sorted(s.next):
            tree = s.next[c]
            if tree.number is not None:
                continue
            same = next((r for r in kept if _alike(r, tree)), None)
            if same is None:
                tree.number = len(kept)
                kept.append(tree)
                open_.append(tree)
            else:
                s.next[c] = same
                open_.extend(_fold(same, tree))
    n = len(SYMBOLS)
    to, seen = np.zeros((len(kept), n), np.int64), np.full((len(kept), n + 1), unseen)
    for s in kept:
        seen[s.number, n] += s.ends
        for c, y in s.next.items():
            to[s.number, SYMBOLS.index(c)] = y.number
            seen[s.number, SYMBOLS.index(c)] += s.led[c]
    with np.errstate(divide="ignore"):
        return Automaton(to, np.log(seen / seen.sum(1, keepdims=True)))


_FOUND = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"
_STRUCT = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def _rows(lists: list[list[tuple[int, int, int, str]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b, "value": v} for k, a, b, v in x] for x in lists], pa.list_(_STRUCT))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base, others): what the patterns find in each whole text, and the candidates that no match touches."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, base, others = batch.slice(at, 512), [], []
                for x in some.column(1):
                    text = x.as_py() or ""
                    found = matches(text)
                    base.append([(k, a, b, v) for a, k, b, v in found])
                    others.append([(-1, a, a + len(v), v) for a, v in candidates(text, found)])
                yield pa.RecordBatch.from_arrays([some.column(0), _rows(base), _rows(others)], names=["key", "base", "others"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), f"key {kind}, base {_FOUND}, others {_FOUND}")


def learn(scanned: DataFrame, examples: int = EXAMPLES, longest: int = LONGEST) -> dict[int, Automaton]:
    """Automata by kind, -1 for other candidates, each of at most so many distinct values of at most so many characters, those of
    least hash. Kinds without examples have none. Those of credentials accept only what their states saw, at whatever length."""
    spark = scanned.sparkSession
    each = scanned.select(F.explode(F.concat("base", "others")).alias("f")).where(F.length("f.value") <= longest)
    each = Workspace(spark, "examples").write(each.select("f.kind", "f.value").distinct(), "values")
    out = {}
    for kind in (-1, *range(len(KINDS))):
        some = each.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples).collect()
        if some:
            out[kind] = infer([r.value for r in some], UNSEEN if kind < 0 else 0)
    return out


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", margin: float = MARGIN, examples: int = EXAMPLES, longest: int = LONGEST) -> DataFrame:
    """(key, found): the spans of each text as (kind, start, end, value) in code points, by start, then kind.

    Kinds are those of KINDS and, for candidates that score as one of them, "like_" and its name. A span that patterns find stays,
    whatever its score. Null and empty texts have none, null and repeated keys give a row each, other columns are not read, texts are
    read whole, and empty tables give no rows. Without credentials to learn from nothing is added; scores of what was learnt depend
    on all texts, not on their order or partitions.
    """
    ship(docs.sparkSession)
    scanned = Workspace(docs.sparkSession, "secrets").write(scan(docs, text, key), "scanned")
    automata = learn(scanned, examples, longest)
    names = [*KINDS, *(f"like_{k}" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [k for k in sorted(automata) if k >= 0]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                base, others = some.column(1).to_pylist(), some.column(2).to_pylist()
                flat = [f["value"] for row in others for f in row]
                best, score = np.zeros(len(flat), np.int64), np.full(len(flat), -np.inf)
                if flat and known:
                    each = np.stack([automata[k].scores(flat) for k in known])
                    best, score = np.array(known)[each.argmax(0)], each.max(0) - automata[-1].scores(flat)
                out, k = [], 0
                for own, more in zip(base, others):
                    found = [(f["start"], f["kind"], f["end"], f["value"]) for f in own]
                    for f in more:
                        if score[k] >= margin:
                            found.append((f["start"], len(KINDS) + int(best[k]), f["end"], f["value"]))
                        k += 1
                    out.append([{"kind": names[q], "start": a, "end": b, "value": v} for a, q, b, v in sorted(found)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), *list(_STRUCT)[1:]])))], names=["key", "found"])

    kind = docs.schema[key].dataType.simpleString()
    return scanned.mapInArrow(trimmed(run), f"key {kind}, found {_FOUND.replace('kind:int', 'kind:string')}").withColumnRenamed("key", key)
