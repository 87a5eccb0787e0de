"""Removal of long repeated substrings, by suffixes sorted with hashed comparisons.

Windows of `length` bytes that are equal choose the same anchor: the place of least hash among their short grams. Runs of windows
with one anchor are contexts. Equal contexts are found by their digests and repeat as a whole; of those that share a gram but
differ, one of each is fetched, and groups of one gram are compared: their windows are sorted as suffixes by merging, each
comparison a binary search for the common extension over prefix hashes, and neighbours that agree on a whole window repeat.
A gram with very many different contexts would make one long task; those are dealt again, by what classes of their windows have
in common, in classes that get smaller, then by whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, trimmed
from .workspace import Workspace, small_enough

LENGTH, GRAM = 400, 64
#: Bytes handled together, windows sorted together, different contexts of a gram that are sorted in one task at most.
BUFFER, SORTED, HEAVY = 1 << 20, 1 << 19, 256
#: Windows of a class of a gram with more contexts, from level to level; each divides the one before, and the last is 1.
CLASSES = (48, 12, 3, 1)
#: Megabytes of a table that is sent to all tasks at most.
SENT_MB = 2
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    powers = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * BUFFER, b, np.uint64)])
    return values, powers(np.uint64(_BASE)), powers(np.uint64(_INVERSE))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = base**i times the polynomial hash of data[i:j], modulo 2**64."""
    values, powers, _ = _tables()
    if len(data) >= len(powers):
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), np.uint64(_BASE), np.uint64)])
    return np.r_[np.uint64(0), np.cumsum(values[data] * powers[: len(data)])]


def anchors(data: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor place, gram hash) for runs of windows with one anchor. doc: the document of each byte;
    windows never leave theirs. Buffers have 2 * BUFFER bytes at most."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h, inverse = prefix_hashes(data), _tables()[2]
    grams = (h[gram:] - h[:-gram]) * inverse[: len(data) - gram + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    n, w = len(grams), length - gram + 1
    key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(data) - length + 1
    place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = np.flatnonzero(doc[:windows] == doc[length - 1 : length - 1 + windows])
    if not len(whole):
        return none, none, none, none.astype(np.uint64)
    p = place[whole]
    cut = np.r_[0, np.flatnonzero((p[1:] != p[:-1]) | (whole[1:] != whole[:-1] + 1)) + 1]
    count = np.diff(np.r_[cut, len(whole)])
    return whole[cut], count, p[cut], grams[p[cut]]


class Suffixes:
    """Text with prefix hashes; common extensions by binary search."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.h = prefix_hashes(data)
        powers = _tables()[1]
        self.p = powers if len(powers) > len(data) else np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), np.uint64(_BASE), np.uint64)])

    def same(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        return (self.h[a + n] - self.h[a]) * self.p[b] == (self.h[b + n] - self.h[b]) * self.p[a]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, up to the window's length."""
        out = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            live = np.flatnonzero(out + step <= self.length)
            s = out[live]
            out[live] += step * self.same(a[live] + s, b[live] + s, step)
            step >>= 1
        return out

    def before(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at a is less than that at b, and whether they agree on a window."""
        e = self.extension(a, b)
        equal = e >= self.length
        e = np.where(equal, 0, e)
        return ~equal & (self.data[a + e] < self.data[b + e]), equal

    def sort(self, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A permutation that orders the windows at start by their text within runs [lo, hi): merges of growing width, every
        element finding its rank in the run beside its own by binary search."""
        order, at = np.arange(len(start)), np.arange(len(start))
        width, most = 1, int((hi - lo).max(initial=0))
        while width < most:
            inside = (at - lo) % (2 * width)
            first = at - inside
            left = inside < width
            middle = np.minimum(first + width, hi)
            a, b = np.where(left, middle, first), np.where(left, np.minimum(first + 2 * width, hi), middle)
            base = a.copy()
            live = np.flatnonzero(a < b)
            while len(live):
                mid = (a[live] + b[live]) // 2
                less, equal = self.before(start[order[mid]], start[order[live]])
                up = less | (equal & ~left[live])
                a[live] = np.where(up, mid + 1, a[live])
                b[live] = np.where(up, b[live], mid)
                live = live[a[live] < b[live]]
            moved = np.empty_like(order)
            moved[np.where(left, first + inside, first + inside - width) + a - base] = order
            order = moved
            width *= 2
        return order


def repeated(texts: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context (windows - 1 + length bytes, its anchor at offset) which of its windows repeat.

    group numbers the contexts' grams; count says how often a context occurs. Windows of one group can only be equal at
    equal distances from the anchor; they are sorted a slice of distances at a time. Should prefix hashes that agree turn out
    to stand for different bytes, the bytes themselves are looked up.
    """
    try:
        return _sorted(texts, group, offset, count, length)
    except Collision:
        return _looked_up(texts, group, offset, count, length)


class Collision(Exception):
    """Equal prefix hashes of different bytes."""


def _looked_up(texts: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray, length: int) -> list[np.ndarray]:
    """repeated() by a table of all windows' bytes."""
    flags, seen = [np.full(len(t) - length + 1, c > 1) for t, c in zip(texts, count)], {}
    for i, (text, g, off) in enumerate(zip(texts, group.tolist(), offset.tolist())):
        for t in range(len(flags[i])):
            other = seen.setdefault((g, off - t, text[t : t + length]), (i, t))
            if other != (i, t):
                flags[i][t] = flags[other[0]][other[1]] = True
    return flags


def _sorted(texts: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray, length: int) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    base, windows = np.r_[0, np.cumsum(size)[:-1]], size - length + 1
    flags = [np.full(n, c > 1) for n, c in zip(windows, count)]
    member = np.repeat(np.arange(len(texts)), windows)
    t = np.arange(len(member)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
    key = group[member] * (length + 1) + offset[member] - t
    order = np.argsort(key, kind="stable")
    member, t, key = member[order], t[order], key[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    run = np.repeat(np.diff(cut), np.diff(cut))
    keep = run > 1
    member, t, key = member[keep], t[keep], key[keep]
    if not len(member):
        return flags
    s = Suffixes(data, length)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    at = 0
    while at < len(cut) - 1:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + SORTED, "right")) - 1)
        a, b = cut[at], cut[to]
        n = np.diff(cut[at : to + 1])
        lo, hi = np.repeat(cut[at:to] - a, n), np.repeat(cut[at + 1 : to + 1] - a, n)
        start = base[member[a:b]] + t[a:b]
        p = s.sort(start, lo, hi)
        x, y = p[:-1], p[1:]
        beside = np.flatnonzero((lo[1:] == lo[:-1]))
        equal = beside[s.extension(start[x[beside]], start[y[beside]]) >= length]
        _mark(flags, texts, member[a:b], t[a:b], x[equal], y[equal], length)
        at = to
    return flags


def _mark(flags: list[np.ndarray], texts: list[bytes], member: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> None:
    """Flag windows of pairs whose hashes agree, after comparing their bytes, a run of windows of two contexts at a time."""
    if not len(x):
        return
    i, j, a, b = member[x], member[y], t[x], t[y]
    order = np.lexsort((a, b - a, j, i))
    i, j, a, b = i[order], j[order], a[order], b[order]
    new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)])
    for f, l in zip(new.tolist(), (np.r_[new[1:], len(i)] - 1).tolist()):
        p, q, af, al, bf = i[f], j[f], a[f], a[l], b[f]
        if texts[p][af : al + length] != texts[q][bf : bf + al - af + length]:
            raise Collision
        flags[p][af : al + 1] = True
        flags[q][bf : bf + al - af + 1] = True


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """Documents gathered to buffers: (key 1, key 2, place of the buffer's part in the document) per part, bytes, part of each
    byte. A long document comes in parts that overlap by a window less one byte."""
    parts, texts, size = [], [], 0

    def flush():
        data = np.frombuffer(b"".join(texts), np.uint8)
        return list(parts), data, np.repeat(np.arange(len(texts)), [len(x) for x in texts])

    for batch in batches:
        for k1, k2, text in zip(*(batch.column(i) for i in range(3))):
            raw, k1, k2 = (text.as_py() or "").encode("utf-8", "surrogatepass"), k1.as_py(), k2.as_py()
            for at in range(0, max(1, len(raw) - LENGTH + 1), BUFFER):
                piece = raw[at : at + BUFFER + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                if size + len(piece) > BUFFER and texts:
                    yield flush()
                    parts, texts, size = [], [], 0
                parts.append((k1, k2, at))
                texts.append(piece)
                size += len(piece)
    if texts:
        yield flush()


_HITS = "c1 long, c2 long, off long, f array<long>, t array<long>"


def _sent(frame: DataFrame) -> DataFrame:
    """A frame of the workspace, broadcast if it is small beside any input; joins of larger ones are shuffled at every size."""
    return F.broadcast(frame) if small_enough(frame, SENT_MB) else frame


def spans(docs: DataFrame, work: Workspace, text: str = "text") -> DataFrame:
    """(k1, k2, spans): for every distinct row key that has any, [from, to) bytes, unordered, that windows occurring twice
    cover. k1 and k2 are hashes of the row: xxhash64 of its text, without and with a prefix."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("k1", "k2", F.col(text).cast("string").alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for parts, data, doc in _buffers(batches):
            first, count, anchor, gram = anchors(data, doc)
            raw, start = data.tobytes(), np.searchsorted(doc, np.arange(len(parts)))
            digest = [xxhash.xxh3_128_digest(raw[f : f + n + LENGTH - 1]) for f, n in zip(first.tolist(), count.tolist())]
            c = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest else np.zeros((0, 2), np.int64)
            d = doc[first]
            k = np.array(parts, np.int64).reshape(-1, 3)
            columns = (k[d, 0], k[d, 1], k[d, 2] + first - start[d], count.astype(np.int32), (anchor - first).astype(np.int32), gram.view(np.int64), c[:, 0], c[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "start", "n", "off", "gram", "c1", "c2"])

    occurs = work.write(rows.mapInArrow(trimmed(place), "k1 long, k2 long, start long, n int, off int, gram long, c1 long, c2 long"), "occurs")
    twice = work.write(occurs.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    # in what follows only grams that occur twice; a third of all rows may be copies of one text, so contexts are counted first
    occurs = work.write(occurs.join(_sent(twice), "gram", "left_semi"), "occurs-twice")
    work.drop("occurs")
    context = ["gram", "c1", "c2", "off"]
    contexts = occurs.groupBy(*context).agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("k1", "k2", "start", "n")])
    contexts = work.write(contexts, "contexts")
    work.release()
    differ = work.write(contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "differ")
    wanted = contexts.join(_sent(differ), "gram").select("k1", "k2", F.struct("gram", "c1", "c2", "off", "start", "n", "times", (F.col("m") > HEAVY).alias("heavy")).alias("w"))
    wanted = work.write(wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")), "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows of equal text hold the same
        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if k in seen:
                    continue
                seen.add(k)
                raw, out = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass"), batch.column(3).slice(i, 1).flatten()
                start, n = (out.field(f).to_pylist() for f in ("start", "n"))
                pieces = pa.array([raw[a : a + b + LENGTH - 1] for a, b in zip(start, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(out.field(f) for f in (*context, "times", "heavy")), pieces], names=[*context, "times", "heavy", "piece"])

    some = rows.join(_sent(wanted), ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    pieces = work.write(some.mapInArrow(trimmed(fetch), "gram long, c1 long, c2 long, off int, times long, heavy boolean, piece binary"), "pieces")
    work.release()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, last = 0, None

        def answer() -> pa.RecordBatch:
            keys = list(held)
            names = {g: k for k, g in enumerate(dict.fromkeys(k[0] for k in keys))}
            found = repeated([held[k][0] for k in keys], np.array([names[k[0]] for k in keys]), np.array([k[3] for k in keys]), np.array([held[k][1] for k in keys]))
            c1, c2, off, f, t = [], [], [], [], []
            for k, flags in zip(keys, found):
                if flags.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, flags, 0]))
                    c1.append(k[1]), c2.append(k[2]), off.append(k[3])
                    f.append(edge[::2].tolist())
                    t.append((edge[1::2] - 1 + LENGTH).tolist())
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(off, pa.int64()), pa.array(f, longs), pa.array(t, longs)], names=["c1", "c2", "off", "f", "t"])

        for batch in batches:
            for g, c1, c2, off, n, piece in zip(*(x.to_pylist() for x in batch.columns)):
                if g != last and size > 2 << 20:
                    yield answer()
                    held, size = {}, 0
                last = g
                if (g, c1, c2, off) not in held:
                    held[g, c1, c2, off] = (piece, n)
                    size += len(piece)
        if held:
            yield answer()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("NOT heavy").select(*context, "times", "piece").repartition(parts, "gram").sortWithinPartitions("gram")
    hits = dealt.mapInArrow(trimmed(solve), _HITS)
    whole = contexts.where("times > 1").select("c1", "c2", F.col("off").cast("long").alias("off"), F.array(F.lit(0).cast("long")).alias("f"), F.array((F.col("n") - 1 + LENGTH).cast("long")).alias("t"))
    heavy = pieces.where("heavy")
    if heavy.limit(1).count():
        whole = whole.union(_crowded(heavy.dropDuplicates(context), work))
    hits = work.write(hits.union(whole), "hits")
    joined = occurs.join(_sent(hits), [occurs[c] == hits[c] for c in ("c1", "c2", "off")])
    cover = joined.select("k1", "k2", F.explode(F.arrays_zip("f", "t")).alias("s"), "start").select("k1", "k2", F.struct((F.col("start") + F.col("s.f")).alias("f"), (F.col("start") + F.col("s.t")).alias("t")).alias("s"))
    return cover.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))


def _crowded(pieces: DataFrame, work: Workspace) -> DataFrame:
    """The repeated windows (c1, c2, off, f, t) of grams with very many different contexts, without a task for any one of them.

    Windows at distances from their anchor fall into classes. Contexts whose whole class has equal bytes repeat there; where only
    what all windows of a class share is equal, the class is cut into smaller ones, down to single windows. So few rows are made of
    a class whose contexts differ in few places.
    """
    import xxhash

    pieces = work.write(pieces, "crowded")

    def classes(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for c1, c2, off, at, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    for r in at:
                        for q in range((off - r["b"]) // width, (off - r["a"]) // width + 1):  # windows at t have distance off - t
                            first, last = off - (q + 1) * width + 1, off - q * width
                            a, b = max(r["a"], first), min(r["b"], last)
                            union = np.frombuffer(xxhash.xxh3_128_digest(piece[a : b + LENGTH] + bytes([a - first, last - b])), np.int64)
                            core = np.frombuffer(xxhash.xxh3_128_digest(piece[last : first + LENGTH]), np.int64)
                            out.append((c1, c2, off, a, b, *union.tolist(), *core.tolist()))
                columns = list(zip(*out)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["c1", "c2", "off", "a", "b", "u1", "u2", "h1", "h2"])

        return run

    place, union, found = ["c1", "c2", "off"], ["u1", "u2", "h1", "h2"], None
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.length("piece") - LENGTH).cast("long").alias("b")))
    rows = pieces.select(*place, whole.alias("at"), "piece")
    for width in CLASSES:
        each = work.write(rows.mapInArrow(trimmed(classes(width)), "c1 long, c2 long, off long, a long, b long, u1 long, u2 long, h1 long, h2 long"), f"classes-{width}")
        unions = work.write(each.groupBy(*union).agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in (*place, "a", "b")]), f"unions-{width}")
        alike = each.join(_sent(unions.where("m > 1").select(*union)), union, "left_semi").select(*place, F.array("a").alias("f"), F.array(F.col("b") + LENGTH).alias("t"))
        found = alike if found is None else found.union(alike)
        shared = unions.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
        # one context of each different class; contexts with an equal class are done, but may be what others repeat
        open_ = work.write(unions.join(shared, ["h1", "h2"], "left_semi").groupBy(*place).agg(F.collect_list(F.struct("a", "b")).alias("at")), f"open-{width}")
        if width == 1 or not open_.limit(1).count():
            return found
        rows = pieces.join(_sent(open_), place).select(*place, "at", "piece")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, repeats[, kept, spans]): every document without the bytes that a repeated window covers.

    A window of LENGTH bytes repeats if it starts anywhere else too, in this or another row. Null and empty texts lose
    nothing; rows repeated lose all of a text of LENGTH bytes or more. Rows of equal text share one answer, whatever their keys;
    null and repeated keys keep their rows. repeats says whether anything was removed. Other columns are not read, texts of any
    length are read as a whole, and an empty table has no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "suffix")
    hashed = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})
    found = work.write(spans(hashed, work), "spans")
    joined = hashed.join(_sent(found), ["k1", "k2"], "left").select("key", "text", "spans")
    extra = ", kept string, spans array<struct<f:bigint,t:bigint>>" if keep_text else ""
    kind = docs.schema[key].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = []
                for x, s in zip(some.column(1), some.column(2)):
                    raw, kept, end, cut = x.as_py().encode("utf-8", "surrogatepass"), [], 0, []
                    for r in sorted((r["f"], r["t"]) for r in s.as_py() or []):
                        if cut and r[0] <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], r[1])
                        else:
                            cut.append([*r])
                    for f, t in cut:
                        kept.append(raw[end:f])
                        end = t
                    rest = b"".join([*kept, raw[end:]])
                    out.append((len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), bool(cut), rest.decode("utf-8", "replace"), [{"f": f, "t": t} for f, t in cut]))
                v = list(zip(*out)) or [[]] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + ([pa.string(), pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())]))] if keep_text else [])
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(a, k) for a, k in zip(v, types))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "kept", "spans"][: len(types) + 1])

    return joined.mapInArrow(trimmed(finish), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean{extra}").withColumnRenamed("key", key)
