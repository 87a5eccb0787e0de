"""Exact top-k inner products by an M-tree: recursively routed pages of metric nodes, searched best first.

Rows are dealt to routing objects, those of full nodes to further ones, until every node fits a page; nodes are rows of a table with
their routing object, covering radius, largest norm and distance to the parent's object, and so are pages, whose leaves have the
same. A query goes down the table level by level and keeps a queue of the pages that may still hold one of its best; rounds open
the first of each queue, then more, and drop what the scores found so far rule out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, trimmed
from .workspace import Workspace, small_enough

#: Rows of a page and of a leaf, queries searched together, routing objects of a node at most, rows that they are chosen from.
PAGE_ROWS, LEAF_ROWS, BLOCK, FAN, SAMPLE = 2048, 64, 512, 64, 512
#: Rows dealt to routing objects in one group, rows whose scores give a query its first floor, growth of the pages opened a round.
DEALT, FLOOR_ROWS, GROWTH = 32_768, 2048, 3
SLACK = 1e-6


def _pack(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: in doubles while every partial sum stays below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises where a score does not fit a long


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def spread(points: np.ndarray, k: int) -> np.ndarray:
    """Indexes of up to k routing objects, each farthest from those before it."""
    chosen, away = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < min(k, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def build_page(ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of one page: for each leaf a routing object, covering radius, largest norm and distance to the page's
    middle; for each entry the distance to its leaf's routing object."""
    route = np.rint(vectors.mean(0)).astype(np.int64)
    members: list[np.ndarray] = []
    todo = [np.arange(len(ids))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF_ROWS:
            members.append(own)
            continue
        roots = spread(vectors[own], 8)
        near = _distances(vectors[own], vectors[own][roots]).argmin(1)
        cut = [own[near == k] for k in range(len(roots))] if len(roots) > 1 else [own[i : i + LEAF_ROWS] for i in range(0, len(own), LEAF_ROWS)]
        todo += [c for c in cut if len(c)]
    order = np.concatenate(members)
    stops = np.cumsum([len(m) for m in members])
    centers = np.stack([np.rint(vectors[m].mean(0)) for m in members]).astype(np.int64)
    to_leaf = np.concatenate([_distances(vectors[m], centers[k : k + 1])[:, 0] for k, m in enumerate(members)])
    norm = np.sqrt((vectors[order].astype(np.float64) ** 2).sum(1))
    begins = np.r_[0, stops[:-1]]
    return {"ids": ids[order], "copies": copies[order], "vectors": vectors[order], "norm": norm, "to_leaf": to_leaf, "stops": stops, "centers": centers, "radius": np.maximum.reduceat(to_leaf, begins), "norm_max": np.maximum.reduceat(norm, begins), "to_page": _distances(centers, route[None])[:, 0], "route": route}


def search_page(page: dict[str, np.ndarray], queries: np.ndarray, own: np.ndarray, own_copy: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, copy, score) of up to k best entries for each query with scores of at least its floor.

    A score is (|q|^2 + |x|^2 - d(q, x)^2) / 2, so a lower bound on a distance gives an upper bound on a score. Leaves are
    opened in order of their best bound; the stored distances to parents give bounds without computing distances.
    """
    q = queries.astype(np.float64)
    q2 = (q * q).sum(1)
    none = np.iinfo(np.int64).max
    best, who, which = np.full((len(q), k), -none - 1), np.full((len(q), k), none), np.full((len(q), k), none)
    floor = floor.astype(np.float64).copy()
    slack = SLACK * (1 + q2 + float(page["norm"].max(initial=0)) ** 2)
    bound = lambda far, norm, rows: (q2[rows, None] + norm**2 - np.maximum(far, 0) ** 2) / 2 + slack[rows, None]
    every = np.arange(len(q))
    to_page = _distances(queries, page["route"][None])
    upper = bound(np.abs(to_page - page["to_page"]) - page["radius"], page["norm_max"], every)
    open_leaf = np.flatnonzero((upper >= floor[:, None]).any(0))
    to_center = _distances(queries, page["centers"][open_leaf])
    upper = np.minimum(upper[:, open_leaf], bound(to_center - page["radius"][open_leaf], page["norm_max"][open_leaf], every))
    begins = np.r_[0, page["stops"][:-1]]
    for n in np.argsort(-upper.max(0)) if len(open_leaf) else []:
        rows = np.flatnonzero(upper[:, n] >= floor)
        if not len(rows):
            continue
        a, b = begins[open_leaf[n]], page["stops"][open_leaf[n]]
        may = bound(np.abs(to_center[rows, n : n + 1] - page["to_leaf"][a:b]), page["norm"][a:b], rows) >= floor[rows, None]
        cols = np.flatnonzero(may.any(0))
        rows, may = rows[may.any(1)], None
        if not len(cols) or not len(rows):
            continue
        ids, copies = page["ids"][a:b][cols], page["copies"][a:b][cols]
        score = _dot(queries[rows], page["vectors"][a:b][cols])
        valid = ((ids[None] != own[rows, None]) | (copies[None] != own_copy[rows, None])) & (score >= floor[rows, None])
        hit = valid.any(1)
        rows, score, valid = rows[hit], score[hit], valid[hit]
        if not len(rows):
            continue
        s = np.concatenate([best[rows], np.where(valid, score, -none - 1)], 1)
        w, c = (np.concatenate([old[rows], np.where(valid, new[None], none)], 1) for old, new in ((who, ids), (which, copies)))
        top = np.lexsort((c, w, ~s), axis=1)[:, :k]
        best[rows], who[rows], which[rows] = (np.take_along_axis(x, top, 1) for x in (s, w, c))
        full = which[rows, -1] != none
        floor[rows] = np.where(full, np.maximum(floor[rows], best[rows, -1]), floor[rows])
    at, col = np.nonzero(which != none)
    return at, who[at, col], which[at, col], best[at, col]


def _matrix(packed) -> np.ndarray:
    """Vectors of packed longs, a row each."""
    packed = list(packed)
    return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), -1)


def quantised(frame: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(id, copy, v): floor(scale * x) as longs; rows with a null key, or null, empty or non-finite vectors, are left out. copy numbers
    the rows that repeat an id, in order of their vectors."""
    x = F.col(vector)
    finite = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = frame.where(finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        return rows.select("id", F.lit(0).cast("long").alias("copy"), "v")
    return rows.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("v")) - 1).cast("long").alias("copy"), "v")


def top_k(frame: DataFrame, is_query: str, k: int = 10, vector: str = "embedding", key: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that satisfies is_query (SQL over id), its k largest inner products
    with the vectors of all other rows, ties to the smaller id.

    Every row is indexed; only routing objects, and the scores that give a query its first floor, come from samples of least
    hash. Rows that repeat an id are queries and candidates each for themselves. Vectors of unequal length never meet. Longs
    must hold the scaled components and the scores. An empty table gives an empty result; other columns are not read.
    """
    spark = frame.sparkSession
    ship(spark)
    work = Workspace(spark, "mtree")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch.column(2).to_numpy())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["id", "copy", "dim", "v"])

    rows = quantised(frame, vector, key, scale).select("id", "copy", F.size("v").alias("dim"), "v")
    rows = work.write(rows.mapInArrow(pack, "id long, copy long, dim int, v binary"), "rows")
    found = None
    for dim in [r.dim for r in rows.select("dim").distinct().collect()]:  # a few lengths at most
        one = search(*build(rows.where(F.col("dim") == dim).select("id", "copy", "v"), Workspace(spark, f"mtree-{dim}")), is_query, k)[0]
        found = one if found is None else found.union(one)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


DEAL = "id long, copy long, v binary, node long, router binary, d double, norm double"


def _hash(a: np.ndarray, b: np.ndarray, c: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(c)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _distance_to(v: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _distances(v, one[None])[:, 0]


def routing(points: np.ndarray, k: int) -> np.ndarray:
    """Up to k routing objects: points, each farthest from those before it, or, where half of all points or more lie nearest to one of
    those, the middles of cells that are moved to where these deal more evenly."""
    far = points[spread(points, k)]
    deal = lambda r: _distances(points, r).argmin(1)
    most = lambda r: int(np.bincount(deal(r)).max())
    if len(far) == 1 or 2 * most(far) < len(points):
        return far
    best, middles = far, far
    for _ in range(8):
        at = deal(middles)
        middles = np.stack([np.rint(points[at == i].mean(0)) if (at == i).any() else points[i % len(points)] for i in range(len(far))]).astype(np.int64)
        best = middles if most(middles) < most(best) else best
    return best


def build(rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None, DataFrame, Workspace]:
    """(rows, nodes, pages): the tree over rows (id, copy, v), whose root is node 0. The nodes of a level follow those of the level
    above in number, FAN for each node that was dealt, so that numbers grow with the nodes and not with the depth.

    nodes: (node, parent, router, to_parent, radius, norm, leaf) below the root; None if the root is the one page. pages: (node, data).
    A round deals the rows of all nodes above PAGE_ROWS to routing objects, chosen from SAMPLE of the node's rows; where all of
    those are equal, by hash. Groups of DEALT rows and their node's objects meet in one task.
    """
    placed, nodes, level = rows.withColumns({"node": F.lit(0).cast("long"), "router": F.lit(None).cast("binary")}), None, 0
    done, fresh_at = None, 1
    while True:
        sizes = work.write(placed.groupBy("node").agg(F.count("*").alias("n"), F.first("router").alias("router")), f"sizes-{level}")
        full = sizes.where(F.col("n") > PAGE_ROWS).withColumn("place", F.row_number().over(Window.orderBy("node")) - 1)  # a row a node of many rows
        more = full.count()
        if nodes is not None:
            nodes = nodes.join(full.select("node", F.lit(False).alias("inner")), "node", "left").withColumn("leaf", F.col("leaf") & F.col("inner").isNull()).drop("inner")
        here = placed.join(full.select("node"), "node", "left_anti").select("id", "copy", "v", "node")
        done = here if done is None else done.union(here)
        if not more:
            break
        own = placed.drop("router").join(F.broadcast(full) if small_enough(full) else full, "node")
        least = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id", "copy"), "id", "copy"))
        sample = own.withColumn("r", least).where(F.col("r") <= SAMPLE)

        def choose(key, pdf: pd.DataFrame) -> pd.DataFrame:
            v, n = _matrix(pdf.sort_values("r")["v"]), int(pdf["n"].iloc[0])
            k = min(FAN, max(2, -(-2 * n // PAGE_ROWS)))
            found = routing(v, k)
            if len(found) == 1:
                found = np.repeat(found, k, 0)
            up = pdf["router"].iloc[0]
            to = _distance_to(found, np.frombuffer(up, np.int64)) if up is not None else np.zeros(len(found))
            return pd.DataFrame({"parent": int(key[0]), "node": fresh_at + int(pdf["place"].iloc[0]) * FAN + np.arange(len(found)), "router": [x.tobytes() for x in found], "to_parent": to, "parts": -(-n // DEALT)})

        routers = work.write(sample.groupBy("node").applyInPandas(choose, "parent long, node long, router binary, to_parent double, parts long"), f"routers-{level}")

        def deal(left: pd.DataFrame, right: pd.DataFrame, depth: int = level) -> pd.DataFrame:
            right = right.sort_values("node")
            v, r, child = _matrix(left["v"]), _matrix(right["router"]), right["node"].to_numpy(np.int64)
            d = _distances(v, r)
            at = d.argmin(1)
            if (r == r[0]).all():
                at = _hash(left["id"].to_numpy(np.int64), left["copy"].to_numpy(np.int64), depth) % len(r)
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            return pd.DataFrame({"id": left["id"], "copy": left["copy"], "v": left["v"], "node": child[at], "router": [right["router"].iloc[i] for i in at], "d": d[np.arange(len(v)), at], "norm": norm})

        parts = F.ceil(F.col("n") / DEALT).cast("long")
        mine = own.select("id", "copy", "v", "node", F.pmod(F.xxhash64("id", "copy", F.lit(level)), parts).alias("part"))
        theirs = routers.select(F.col("parent"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "node", "router")
        dealt = mine.groupBy("node", "part").cogroup(theirs.groupBy("parent", "part")).applyInPandas(_both(deal, DEAL), DEAL)
        dealt = work.write(dealt, f"dealt-{level}")
        stats = dealt.groupBy("node").agg(F.max("d").alias("radius"), F.max("norm").alias("norm"))
        fresh = routers.join(stats, "node").select("node", "parent", "router", "to_parent", "radius", "norm", F.lit(True).alias("leaf"))
        nodes = work.write(fresh if nodes is None else nodes.union(fresh), f"nodes-{level}")
        placed, level, fresh_at = dealt.drop("d", "norm"), level + 1, fresh_at + more * FAN

    def page(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "copy"])
        data = build_page(pdf["id"].to_numpy(np.int64), pdf["copy"].to_numpy(np.int64), _matrix(pdf["v"]))
        return pd.DataFrame({"node": [int(key[0])], "data": [_pack(**data)]})

    pages = work.write(done.groupBy("node").applyInPandas(page, "node long, data binary"), "pages")
    return rows, None if nodes is None else work.write(nodes, "nodes"), pages, work


def search(rows: DataFrame, nodes: DataFrame | None, pages: DataFrame, work: Workspace, is_query: str, k: int) -> tuple[DataFrame, int]:
    """((query_id, rank, vec_id, score), pages opened in all) of every row that satisfies is_query."""
    sample = rows.orderBy(F.xxhash64("id", "copy"), "id", "copy").limit(FLOOR_ROWS).toPandas()
    s_ids, s_copies, s_vec = sample["id"].to_numpy(np.int64), sample["copy"].to_numpy(np.int64), _matrix(sample["v"])
    asking = rows.where(is_query)
    slots = max(1, -(-asking.count() // BLOCK))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids, copies = (some.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                score = _dot(_matrix(some.column(2).to_pylist()), s_vec).astype(np.float64)
                score[(ids[:, None] == s_ids[None]) & (copies[:, None] == s_copies[None])] = -np.inf
                floor = -np.partition(-score, k - 1, 1)[:, k - 1] if score.shape[1] >= k else np.full(len(ids), -np.inf)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(floor)], names=["id", "copy", "v", "floor"])

    queries = work.write(asking.select("id", "copy", "v").mapInArrow(floors, "id long, copy long, v binary, floor double"), "queries")
    # a row a query and node: far is the distance to the node's routing object, upper bounds the scores below it
    at_root = queries.select(F.lit(0).cast("long").alias("node"), "id", "copy", "v", "floor", F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("far"))
    queue, step = at_root, 0
    if nodes is not None:
        slot = F.pmod(F.xxhash64("id", "copy"), F.lit(slots))
        children = nodes.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        inner, queue = at_root, None

        def descend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            q = _matrix(left["v"])
            q2, far, floor = (q.astype(np.float64) ** 2).sum(1), left["far"].to_numpy(), left["floor"].to_numpy()
            out = []
            for c in right.itertuples(index=False):
                slack = SLACK * (1 + q2 + c.norm**2)
                bound = lambda lower, rows_: (q2[rows_] + c.norm**2 - np.maximum(lower, 0) ** 2) / 2 + slack[rows_]  # noqa: B023, E731
                use = np.arange(len(q))
                if c.parent:  # the stored distance to the parent's object rules out without computing one
                    use = np.flatnonzero(bound(np.abs(far - c.to_parent) - c.radius, use) >= floor)
                d = _distance_to(q[use], np.frombuffer(c.router, np.int64))
                upper = bound(d - c.radius, use)
                keep = upper >= floor[use]
                one = left.iloc[use[keep]][["id", "copy", "v", "floor"]]
                out.append(one.assign(node=c.node, upper=upper[keep], far=d[keep], leaf=c.leaf))
            return pd.concat(out)[["node", "id", "copy", "v", "floor", "upper", "far", "leaf"]]

        while True:
            asked = inner.withColumn("slot", slot).groupBy("node", "slot")
            below = asked.cogroup(children.groupBy("parent", "slot")).applyInPandas(_both(descend, "node long, id long, copy long, v binary, floor double, upper double, far double, leaf boolean"), "node long, id long, copy long, v binary, floor double, upper double, far double, leaf boolean")
            below = work.write(below, f"below-{step}")
            leaves = below.where("leaf").drop("leaf")
            queue = leaves if queue is None else queue.union(leaves)
            inner, step = below.where("NOT leaf").drop("leaf"), step + 1
            if not inner.limit(1).count():
                break
    best, opened, most, turn = None, 0, 1, 0

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, asked in zip(batch.column(0), batch.column(1)):
                a = asked.as_py()
                ids, copies = (np.array([x[n] for x in a], np.int64) for n in ("id", "copy"))
                at, who, which, score = search_page(_unpack(data.as_py()), _matrix([x["v"] for x in a]), ids, copies, np.array([x["floor"] for x in a]), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], copies[at], who, which, score)], names=["id", "copy", "vec_id", "vec_copy", "score"])

    order = F.row_number().over(Window.partitionBy("id", "copy").orderBy(F.desc("upper"), "node"))
    while True:
        queue = work.write(queue.withColumn("turn", order).select("node", "id", "copy", "v", "floor", "upper", "turn"), f"queue-{turn}")
        first = queue.where(F.col("turn") <= most)
        here = first.count()
        if not here:
            break
        opened += here
        asked = first.groupBy("node", F.pmod(F.xxhash64("id", "copy"), F.lit(slots)).alias("slot")).agg(F.collect_list(F.struct("id", "copy", "v", "floor")).alias("asked"))
        hits = asked.join(pages, "node").select("data", "asked").mapInArrow(trimmed(look), "id long, copy long, vec_id long, vec_copy long, score long")
        ranked = (hits if best is None else hits.union(best.drop("rank"))).withColumn("rank", F.row_number().over(Window.partitionBy("id", "copy").orderBy(F.desc("score"), "vec_id", "vec_copy")))
        best = work.write(ranked.where(F.col("rank") <= k).select("id", "copy", "vec_id", "vec_copy", "score", "rank"), f"best-{turn}")
        reached = best.where(F.col("rank") == k).select("id", "copy", F.col("score").cast("double").alias("reached"))
        left = queue.where(F.col("turn") > most).join(reached, ["id", "copy"], "left").withColumn("floor", F.greatest("floor", F.coalesce("reached", F.lit(float("-inf")))))
        queue, turn, most = left.where("upper >= floor").drop("reached"), turn + 1, most * GROWTH
    if best is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long"), 0
    return best.select(F.col("id").alias("query_id"), "rank", "vec_id", "score"), opened


def _both(use, schema: str):
    """use of two groups where both have rows; else nothing."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return use(left, right) if len(left) and len(right) else pd.DataFrame({n: [] for n in names})

    return run
