"""SimHash near-duplicates: fingerprints, a grid over segment popcounts, exact links, components; near copies by shingle similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .components import connected_components
from .workspace import Workspace, small_enough

#: The 64 bits as 32 segments of 2, dealt to six blocks; 3 differing bits leave three blocks equal at least.
BLOCKS = ((0, 10), (10, 20), (20, 30), (30, 40), (40, 52), (52, 64))
LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shingles(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of so many words, in order, with repeats; of the whole text if it has fewer words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)] * n)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)


def _simhash(shingles: np.ndarray) -> int:
    n = len(shingles)
    hashes = shingles.view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles (the finalizer of SplitMix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of one text; 0 without words."""
    return _simhash(_shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): one row per document; fp is the SimHash as a signed long. Null and empty texts have 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _embedding(fp):
    """Per-segment bit counts, each in unary (0, 01, 11), so that Manhattan distance is a bit count."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(F.lit(LOW))
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def link_runs(cell: np.ndarray, fp: np.ndarray, emb: np.ndarray, side: np.ndarray, bits: int) -> np.ndarray:
    """Links inside runs of equal cells (sorted rows): pairs within the distance that join two trees.

    Pairs are compared at growing offsets within their run. Only a spanning forest of the links leaves, so
    a dense cell of m gives m - 1 rows at most. side: -1 everywhere, or which half of a block pair a row has.
    """
    n = len(cell)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    parent, out = np.arange(n), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    i, k = np.arange(n), 1
    while len(i := i[i + k < ends[i]]):
        j = i + k
        near = (np.bitwise_count(emb[i] ^ emb[j]) <= bits) & ((side[i] < 0) | (side[i] != side[j]))
        a, b = i[near], j[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        a, b = a[close], b[close]
        apart = parent[a] != parent[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
        if len(a):
            parent = parent[parent]
        k += 1
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return np.stack([fp[pairs[:, 0]], fp[pairs[:, 1]]], 1)


def links(fps: DataFrame, bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within Hamming distance, enough to connect what all links connect.

    Grid range join: the per-segment bit counts are the coordinates; their Manhattan distance never exceeds the Hamming
    distance. At most 3 of six blocks of coordinates can differ, so partners share a grid cell of three blocks. A cell of
    more than cell_rows is cut into parts, and every two parts meet in a task of their own; nothing is dropped.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the grid of three blocks of six serves distances of 0 to 3")
    ship(fps.sparkSession)
    masks = [_signed(sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen)) for chosen in combinations(BLOCKS, 3)]
    cells = fps.select("fp", _embedding(F.col("fp")).alias("emb")).select("fp", "emb", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("emb").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])).alias("cell"))
    heavy = cells.groupBy("cell").count().where(F.col("count") > cell_rows)
    if heavy.limit(1).count():
        parts = F.ceil(F.col("count") / cell_rows).cast("long")
        own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), parts)
        cut = cells.join(heavy, "cell").withColumn("n", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        cut = cut.select("fp", "emb", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
        cells = cells.join(heavy.select("cell"), "cell", "left_anti").select("fp", "emb", "cell", F.lit(-1).alias("side")).union(cut)
    else:
        cells = cells.select("fp", "emb", "cell", F.lit(-1).alias("side"))
    count = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(parts) -> pa.RecordBatch:
            cell, fp, emb, side = (np.concatenate(x) for x in zip(*parts))
            found = link_runs(cell, fp.view(np.uint64), emb.view(np.uint64), side, bits).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, fp, emb, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = int(np.searchsorted(cell, cell[-1]))  # the last run may go on in the next batch
            if cut:
                yield solve([*held, (cell[:cut], fp[:cut], emb[:cut], side[:cut])])
                held = []
            elif held and held[0][0][0] != cell[0]:
                yield solve(held)
                held = []
            held.append((cell[cut:], fp[cut:], emb[cut:], side[cut:]))
        if held:
            yield solve(held)

    return cells.select("cell", "fp", "emb", "side").repartition(count, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 3, shingle: int = 3) -> DataFrame:
    """(key, fp, component): one row per document; component is the smallest key reachable over links of at most bits.

    Documents without words have fingerprint 0 and link like any other. A null key keeps its row and joins its group, but
    names no component unless the whole group is null. Repeated rows give repeated rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "simhash")
    every = work.write(fingerprints(docs, text, key, shingle), "fingerprints")
    distinct = work.write(every.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    labels = connected_components(links(distinct.select("fp"), bits), work)
    placed = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    linked = placed.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("least").alias("component"))
    named = placed.join(linked, "group").select("fp", "component")
    return every.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(end of each row's run, columns): whole runs of equal first column of sorted batches; runs of one row are left out."""
    held: list[list[np.ndarray]] = []

    def solve(parts):
        cols = [np.concatenate(x) for x in zip(*parts)]
        new = np.r_[True, cols[0][1:] != cols[0][:-1], True]
        cols = [c[~(new[:-1] & new[1:])] for c in cols]
        n = len(cols[0])
        if n:
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            yield np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])), cols

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on in the next batch
        if cut:
            yield from solve([*held, [c[:cut] for c in cols]])
            held = []
        elif held and held[0][0][0] != cols[0][0]:
            yield from solve(held)
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield from solve(held)


def _sets(docs: DataFrame, shingle: int, percent: int, what: str, heavy: np.ndarray | None = None) -> DataFrame:
    """Per row of (key, text), by its set of shingles: what 'sketch' gives (key, sig, n, fps, prefix, wide), 'prefix' (sig, prefix) of rows
    whose prefix would hold a heavy shingle, 'set' (sig, shingles). sig is a hash of the set, n its size. Shingles are ordered by hash,
    heavy ones last; two sets at the similarity share one of the first n - ceil(percent n / 100) + 1. fps has the set's
    segment parities under COUNTED shingles and two SimHashes where it or a partner has that many; wide has parities of more segments."""
    ship(docs.sparkSession)
    kind = docs.schema["key"].dataType.simpleString()
    schema = {"sketch": f"key {kind}, sig long, n int, fps array<long>, prefix array<long>, wide binary", "prefix": "sig long, prefix array<long>", "set": "sig long, shingles array<long>"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sigs, sizes, fps, lists, wide = [], [], [], [], []
            for text in batch.column(1):
                every = _shingles(text.as_py(), shingle)
                own = np.unique(every)
                n = len(own)
                first = n - -(-percent * n // 100) + 1 if n else 0
                if what == "prefix":
                    late = np.isin(own & ~np.uint64(1), heavy)
                    if not late[:first].any():
                        continue
                sigs.append(_signed(xxhash.xxh3_64_intdigest(own.tobytes())))
                sizes.append(n)
                if what == "sketch":
                    small = [*_parities(own).tolist()] if n < COUNTED else [None, None]
                    large = [_simhash(every), _simhash(_mixed(every))] if 100 * n >= percent * COUNTED else [None, None]
                    fps.append([x if x is None else _signed(x) for x in small + large])
                    wide.append(_wide(own))
                lists.append((np.r_[own[~late], own[late]][:first] if what == "prefix" else own[:first] if what == "sketch" else own).view(np.int64))
            ends = np.cumsum([0, *map(len, lists)])
            nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            cols = {"sig": pa.array(sigs, pa.int64()), ("shingles" if what == "set" else "prefix"): nested}
            if what == "sketch":
                cols = {"key": batch.column(0), "sig": cols["sig"], "n": pa.array(sizes, pa.int32()), "fps": pa.array(fps, pa.list_(pa.int64())), "prefix": nested, "wide": pa.array(wide, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, schema)


#: The hash space in 128 segments; a set's embedding is how many of its shingles each holds. The Manhattan distance of two
#: embeddings never exceeds the number of shingles that only one set has, nor does the number of segments whose counts differ in
#: parity. So many bits are compared of two sets under COUNTED shingles. Larger sets fill all segments alike; they and sets that are
#: no smaller than partners of theirs can be have two SimHashes, which say which of two such sets to meet first, and rule none out.
COUNTED = 200

#: At similarity 0.8 a SimHash bit differs with probability arccos(0.8 * 2 / 1.8) / pi = 0.152, and more than 42 of 128 do with 2e-07
#: by the binomial estimate; of unrelated sets, 6e-05 come as near.
FAR = 42


#: Segments of the embedding by which the pairs that are left at last are compared: as many as a set has shingles, between these.
WIDE, WIDEST = 1024, 8192


def _wide(own: np.ndarray) -> bytes:
    """Parities in so many segments that the set doesn't fill them."""
    return _parities(own, min(WIDEST, max(WIDE, 1 << (len(own) - 1).bit_length() if len(own) else 0))).tobytes()


def _folded(wide: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """How many segments differ in parity between the sets i and j, in the segments of the one with fewer: halves laid on each other are
    the parities in half as many segments."""
    size, held = np.array([len(x) for x in wide]), {}
    for least in np.unique(size).tolist():
        place, rows = np.cumsum(size >= least) - 1, []
        for x in wide:
            if len(x) >= least:
                x = np.frombuffer(x, np.uint64)
                while len(x) * 8 > least:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                rows.append(x)
        held[least] = place, np.stack(rows)

    def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, least = np.zeros(len(i), np.int64), np.minimum(size[i], size[j])
        for k, (place, rows) in held.items():
            on = np.flatnonzero(least == k)
            if len(on):
                out[on] = np.bitwise_count(rows[place[i[on]]] ^ rows[place[j[on]]]).sum(1, dtype=np.int64)
        return out

    return differ


def _parities(own: np.ndarray, segments: int = 128) -> np.ndarray:
    """Parities of the counts in the segments of a set, as words."""
    odd = (np.bincount((own & np.uint64(segments - 1)).astype(np.int64), minlength=segments) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _distance(fps: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in fps)


def possible(h: np.ndarray, n: np.ndarray, fps: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int, far: int | None) -> np.ndarray:
    """Which pairs (i, j) of sets can have the similarity. By parities (h even) sets are left out whose embeddings lie farther apart
    than sets of their sizes can differ, which loses none; by SimHashes (h odd) those that differ in more than far of 128 bits (None: none)."""
    differ = _distance(fps, i, j)
    close = np.full(len(differ), True) if far is None else differ <= far
    return np.where(h[i] & 1 == 0, (100 + percent) * differ <= (100 - percent) * (n[i] + n[j]), close)


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80, heavy_rows: int = 1000, far: int | None = FAR, rounds: int = 1, window: int = 64) -> DataFrame:
    """(key, component): one row per document; component is the smallest key reachable over pairs whose sets of shingles have a
    Jaccard similarity of percent / 100 or more.

    Candidates share a shingle of their prefixes, which every such pair does; each is verified over the whole sets. A shingle in
    the prefixes of more than heavy_rows sets comes last in the order, so that common passages give no candidates. First the members
    of each run meet its smallest and their neighbour in size. Then, in rounds, every set meets the closest of another group among the
    next `window` of its runs, which joins families by one pair a set. At last all pairs that are still apart meet; runs of one group
    have none. Before a pair is emitted, possible() compares what is kept of both sets; far, a distance of SimHashes, only says which pairs
    the first rounds try. The last pairs are compared by parities alone, in as many segments as the sets have shingles at last: an exact
    bound near the true distance, which loses none and leaves few near misses.
    Documents without words are copies of each other. Null and repeated keys as in near_duplicates.
    """
    spark: SparkSession = docs.sparkSession
    work, count = Workspace(spark, "near-copies"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sketch = work.write(_sets(docs, shingle, percent, "sketch"), "sketch")
    distinct = work.write(sketch.groupBy("sig").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.first("prefix").alias("prefix"), F.first("wide").alias("wide")), "distinct")
    named = work.write(sketch.select("key", "sig"), "named")
    work.drop("sketch")
    work.release()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "n", "sig", "fp", "fp2"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (h, n, sig, *fps) in _runs(batches):
            here, n = np.arange(len(h)), n.astype(np.int64)
            first = np.searchsorted(h, h)
            for at in (first, np.maximum(here - 1, first)):
                ok = (at != here) & (100 * n[at] >= percent * n) & possible(h, n, fps, at, here, percent, far)
                yield pa.RecordBatch.from_arrays([pa.array(sig[at[ok]]), pa.array(sig[ok])], names=["a", "b"])

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ends, (h, n, sig, group, *fps) in _runs(batches):
            n, i, k = n.astype(np.int64), np.arange(len(h)), 1
            best, mate = np.full(len(h), 129), np.full(len(h), -1)
            while k <= window and len(i := i[i + k < ends[i]]) and len(i := i[100 * n[i] >= percent * n[i + k]]):
                ok = (group[i] != group[i + k]) & possible(h, n, fps, i, i + k, percent, far)
                a, b = i[ok], i[ok] + k
                d = _distance(fps, a, b)
                for x, y in ((a, b), (b, a)):
                    nearer = d < best[x]
                    best[x[nearer]], mate[x[nearer]] = d[nearer], y[nearer]
                k += 1
            ok = mate >= 0
            yield pa.RecordBatch.from_arrays([pa.array(sig[ok]), pa.array(sig[mate[ok]]), pa.array(best[ok])], names=["a", "b", "d"])

    def strangers(ends, h, n, sig, group, fps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different groups within the runs, that what is kept of them doesn't rule out."""
        several = np.maximum.reduceat(group, first := np.flatnonzero(np.r_[True, h[1:] != h[:-1]])) != np.minimum.reduceat(group, first)
        n, i, k = n.astype(np.int64), np.flatnonzero(np.repeat(several, np.diff(np.r_[first, len(h)]))), 1
        while len(i := i[i + k < ends[i]]) and len(i := i[100 * n[i] >= percent * n[i + k]]):
            j = i + k
            ok = (group[i] != group[j]) & possible(h, n, fps, i, j, percent, None)
            if ok.any():
                yield i[ok], j[ok]
            k += 1

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ends, (h, n, sig, group, *fps) in _runs(batches):
            some = np.full(len(h), False)
            for i, j in strangers(ends, h, n, sig, group, fps):
                some[i] = some[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (h, n, sig, group, *fps)], names=["h", "n", "sig", "group", "fp", "fp2"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ends, (h, n, sig, group, *fps, wide) in _runs(batches):
            differ, n = _folded(list(wide)), n.astype(np.int64)
            for i, j in strangers(ends, h, n, sig, group, fps):
                ok = (100 + percent) * differ(i, j) <= (100 - percent) * (n[i] + n[j])
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(sig[i[ok]]), pa.array(sig[j[ok]])], names=["a", "b"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(count, "h").sortWithinPartitions("h", "n", "sig")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
        ends = work.write(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), f"{name}-ends")
        own = distinct.join(ends, "sig", "left_semi").select(F.col("least").alias("key")).where("key IS NOT NULL")
        get = lambda rows: _sets(rows, shingle, percent, "set").join(ends, "sig", "left_semi")
        sets = work.write(get(docs.join(own, "key", "left_semi")).union(get(docs.where("key IS NULL")).dropDuplicates(["sig"])), f"{name}-sets")
        side = lambda end, to: sets.select(F.col("sig").alias(end), F.col("shingles").alias(to))
        both = F.size(F.array_intersect("s", "t"))
        links_ = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").select("a", "b", both.alias("both"), (F.size("s") + F.size("t")).alias("sum"))
        found = work.write(links_.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b"), f"{name}-links")
        for gone in ("pairs", "ends", "sets"):
            work.drop(f"{name}-{gone}")
        work.release()
        return found

    def meeting(prefixes: DataFrame, name: str) -> DataFrame:
        def postings(k: int) -> DataFrame:  # the lowest bit of a shingle says how its sets are compared
            rows = prefixes.where(F.get("fps", F.lit(2 * k)).isNotNull()).select(F.explode("prefix").alias("h"), "n", "sig", F.get("fps", F.lit(2 * k)).alias("fp"), F.get("fps", F.lit(2 * k + 1)).alias("fp2"))
            return rows.withColumn("h", F.col("h").bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(k)))

        out = work.write(dealt(postings(0).union(postings(1))).mapInArrow(shared, "h long, n int, sig long, fp long, fp2 long"), name)
        work.release()
        return out

    met = meeting(distinct, "met")
    heavy = [r.h for r in met.groupBy(F.col("h").bitwiseAND(F.lit(-2)).alias("h")).count().where(F.col("count") > heavy_rows).select("h").collect()]  # at most a heavy_rows-th of all
    if heavy:
        other = work.write(_sets(docs, shingle, percent, "prefix", np.array(heavy, np.int64).view(np.uint64)).dropDuplicates(["sig"]), "other")
        met = meeting(distinct.join(other.withColumnRenamed("prefix", "late"), "sig", "left").select("sig", "n", "fps", F.coalesce("late", "prefix").alias("prefix")), "met-late")
    found = verified(dealt(met).mapInArrow(star, "a long, b long"), "star")
    for k in range(rounds + 1):
        groups = connected_components(found, Workspace(spark, "near-copies-groups"))
        labelled = dealt(met.join(groups, met.sig == groups.node, "left").select("h", "n", "sig", F.coalesce("component", "sig").alias("group"), "fp", "fp2"))
        if k < rounds:
            pairs = labelled.mapInArrow(closest, "a long, b long, d long").groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
        else:
            rest = work.write(labelled.mapInArrow(open_, "h long, n int, sig long, group long, fp long, fp2 long"), "open")
            pairs = dealt(rest.join(distinct.select("sig", "wide"), "sig").select("h", "n", "sig", "group", "fp", "fp2", "wide")).mapInArrow(apart, "a long, b long")
        found = found.union(verified(pairs, f"round-{k}"))
    labels = connected_components(found, Workspace(spark, "near-copies-all"))
    placed = distinct.join(labels, distinct.sig == labels.node, "left").select("sig", "least", F.coalesce("component", "sig").alias("group"))
    linked = placed.groupBy("group").agg(F.min("least").alias("component"))
    return named.join(placed.join(linked, "group").select("sig", "component"), "sig").select(F.col("key").alias(key), "component")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 3, shingle: int = 3, percent: int | None = None) -> DataFrame:
    """docs without all but the smallest key of each near-duplicate group; columns as before. With percent, groups are those of
    near_copies, in place of fingerprints within bits.

    Of rows repeated under one key one stays. Rows with a null key can't be told apart and stay.
    """
    work = Workspace(docs.sparkSession, "simhash-keep")
    groups = near_duplicates(docs, text, key, bits, shingle) if percent is None else near_copies(docs, text, key, shingle, percent)
    found = work.write(groups, "found")
    gone = work.write(found.where(F.col(key) != F.col("component")).select(F.col(key).alias("_gone")).distinct(), "gone")
    side = F.broadcast(gone) if small_enough(gone) else gone
    kept = docs.join(side, docs[key] == side["_gone"], "left_anti")
    twice = work.write(found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_twice")).count().where("count > 1").select("_twice"), "twice")
    if not twice.limit(1).count():
        return kept
    single = kept.join(twice, kept[key] == twice["_twice"], "left_anti")
    return single.union(kept.join(twice, kept[key] == twice["_twice"], "left_semi").dropDuplicates([key]))
