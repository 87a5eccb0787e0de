"""The sampled and fitted models against plain versions of them."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelane.llm import mtree, pitman_yor, toxicity


class Plain:
    """The two levels seated customer by customer, one move at a time."""

    def __init__(self, counts, base, seed):
        self.rng, self.base = random.Random(seed), base
        self.child = {p: [] for p in counts}
        self.parent = {w: [] for w in base}
        for p, n in counts.items():
            for _ in range(n):
                self.sit(*p)

    def up(self, w):
        m, t = sum(sum(x) for x in self.parent.values()), sum(map(len, self.parent.values()))
        d, s = pitman_yor.PARENT_DISCOUNT, pitman_yor.PARENT_STRENGTH
        return (sum(self.parent[w]) - d * len(self.parent[w]) + (s + d * t) * self.base[w]) / (s + m)

    def fresh(self, u):
        return pitman_yor.STRENGTH + pitman_yor.DISCOUNT * sum(len(x) for (v, _), x in self.child.items() if v == u)

    def pick(self, weights):
        r = self.rng.random() * sum(weights)
        for i, x in enumerate(weights):
            r -= x
            if r < 0:
                return i
        return len(weights) - 1

    def sit(self, u, w):
        tables = self.child[u, w]
        k = self.pick([self.fresh(u) * self.up(w), *(x - pitman_yor.DISCOUNT for x in tables)])
        if k:
            tables[k - 1] += 1
        else:
            tables.append(1)
            above, t = self.parent[w], sum(map(len, self.parent.values()))
            j = self.pick([(pitman_yor.PARENT_STRENGTH + pitman_yor.PARENT_DISCOUNT * t) * self.base[w], *(x - pitman_yor.PARENT_DISCOUNT for x in above)])
            if j:
                above[j - 1] += 1
            else:
                above.append(1)

    def leave(self, u, w):
        tables = self.child[u, w]
        k = self.pick(tables)
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            above = self.parent[w]
            j = self.pick(above)
            above[j] -= 1
            if not above[j]:
                above.pop(j)

    def sweep(self):
        for p in self.child:
            for _ in range(sum(self.child[p])):
                self.leave(*p)
                self.sit(*p)

    def probability(self, u, w):
        tables, n = self.child.get((u, w), []), sum(sum(x) for (v, _), x in self.child.items() if v == u)
        return (sum(tables) - pitman_yor.DISCOUNT * len(tables) + self.fresh(u) * self.up(w)) / (pitman_yor.STRENGTH + n)


def test_predictive_probabilities_are_those_of_a_plain_sampler():
    counts = {(0, 0): 6, (0, 1): 1, (0, 2): 2, (1, 0): 3, (1, 3): 4, (2, 0): 5, (2, 1): 2, (2, 4): 1, (3, 2): 7}
    rooms, words = 4, 6
    asked = [(u, w) for u in range(rooms) for w in range(words)]
    total = [sum(n for (v, _), n in counts.items() if v == u) for u in range(rooms)]
    seen = [sum(n for (_, x), n in counts.items() if x == w) for w in range(words)]
    tokens, distinct = sum(seen), sum(x > 0 for x in seen)
    base = {w: (seen[w] + 0.5) / (tokens + 0.5 * (distinct + 1)) for w in range(words)}
    plain, want = Plain(counts, base, 3), np.zeros(len(asked))
    for k in range(1200):
        plain.sweep()
        if k >= 200:
            want += [plain.probability(*p) for p in asked]
    want /= 1000
    u, w = (np.array(x, np.uint64) + np.uint64(1) for x in zip(*asked))
    n, cu, cw = (np.array(x, np.int64) for x in ([counts.get(p, 0) for p in asked], [total[p[0]] for p in asked], [seen[p[1]] for p in asked]))
    (got,), _ = pitman_yor.predictive([(u, w, n, cu, cw)], tokens, distinct, 7, burn=50, samples=3000)
    assert np.allclose(got, want, rtol=0.06, atol=0.003)
    assert np.allclose([got[[p[0] == r for p in asked]].sum() for r in range(rooms)], 1 - 0.5 / (tokens + 0.5 * (distinct + 1)), atol=0.1)
    # in any order, cut into any requests, and beside pairs that are only asked for
    order = np.random.default_rng(0).permutation(len(u))
    parts = [tuple(x[order[i::2]] for x in (u, w, n, cu, cw)) for i in (0, 1)]
    again, _ = pitman_yor.predictive(parts, tokens, distinct, 7, burn=50, samples=3000)
    assert all(np.array_equal(a, got[order[i::2]]) for i, a in enumerate(again))


def test_split_contexts_and_crowds():
    rng = np.random.default_rng(0)
    u, w = np.repeat(np.arange(1, 4, dtype=np.uint64), 50), np.tile(np.arange(10, 60, dtype=np.uint64), 3)
    n = rng.integers(0, 9, 150)
    n[:50] *= 8000  # a context beyond its share of a group, with crowds at its dishes
    total = np.repeat(np.bincount(np.repeat(np.arange(3), 50), weights=n), 50).astype(np.int64)
    seen = np.tile(n.reshape(3, 50).sum(0), 3)
    (got,), (hot, tables) = pitman_yor.predictive([(u, w, n, total, seen)], int(n.sum()), int((seen[:50] > 0).sum()), 1)
    assert hot.tolist() == [1] and 0 < tables[0] < n[:50].sum()
    assert np.all(got[:50] >= 0) and np.all(got[:50] <= n[:50]) and np.allclose(got[:50].sum() + 0.75 * tables[0], n[:50].sum())
    assert np.all(got[50:] > 0) and np.all(got[50:] < 1)


def test_tables_of_crowds_follow_their_law():
    # one dish of 3,000 customers beside 40 of one: the law of its tables is known, whatever the seating started from
    c, base = np.r_[3000, np.ones(40, np.int64)], np.full(41, 1 / 41)
    g = pitman_yor.Group(np.zeros(41, np.int64), np.arange(41), c, np.array([3040]), np.array([True]), base, 5)
    got = np.array([t[0] for t, *_ in ((x.copy(), None) for x, *_ in g.samples(samples=400))])
    d, up = pitman_yor.DISCOUNT, (pitman_yor.PARENT_STRENGTH * base[0]) / pitman_yor.PARENT_STRENGTH
    p = np.zeros(3001)
    p[1] = 1
    for n in range(1, 3000):  # tables of n customers, a new one weighing d for each there is
        p[1:] = (p[1:] * (n - d * np.arange(1, 3001)) + p[:-1] * d * np.arange(3000)) / n
    j = np.arange(1, 3000)
    with np.errstate(divide="ignore"):
        weights = np.log(p[1:]) + np.r_[0, np.cumsum(np.log((pitman_yor.STRENGTH + d * (40 + j)) * up / (d * j)))]
    weights = np.exp(weights - weights.max())
    mean = (weights * np.arange(1, 3001)).sum() / weights.sum()
    spread = np.sqrt((weights * (np.arange(1, 3001) - mean) ** 2).sum() / weights.sum())
    assert abs(got.mean() - mean) < 5 * spread / 20 and 0.8 < got.std() / spread < 1.2
    for n in (1, 2, 7, 40):  # the closed form for a discount of a half
        t = np.arange(1, n + 1)
        assert np.allclose(pitman_yor.half_law(np.full(n, n), t, np.r_[0.0, np.cumsum(np.log(np.arange(1.0, 2 * n + 1)))]), pitman_yor.Laws(np.array([n]), 0.5)(n))
    # room for more tables is made where they weigh anything
    g = pitman_yor.Group(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([900]), np.array([900]), np.array([True]), np.array([40.0]), 5)
    assert g.laws.most > 256 and g.t[0] > 256


def test_laws_of_many_customers_need_no_step_for_each(monkeypatch):
    """Those that follow from n - 1 customers end at a number that `most` alone sets; the others are the same laws."""
    seen, step = [], pitman_yor.Laws._step
    monkeypatch.setattr(pitman_yor.Laws, "_step", lambda self, n: (seen.append(int(n.max(initial=1))), step(self, n)))
    n = np.array([1, 2, 300, 1700, 20_000, 10**7, 10**10])
    laws = pitman_yor.Laws(n, 0.75)
    assert [len(laws(k)) for k in n.tolist()] == [1, 2, 256, 256, 256, 256, 256] and seen == [300]
    laws.widen(20_000)
    assert len(laws(20_000)) == 1024 and seen == [300, 1700]
    for d in (0.3, 0.5, 0.75, 0.9):
        stepped = pitman_yor.Laws(np.array([4000, 20_000]), d)
        stepped.most = 16
        step(stepped, stepped.n)
        for k, row in zip((4000, 20_000), pitman_yor.many_law(stepped.n, 16, d)):
            if k**d * pitman_yor.reach(d) >= 16:
                assert np.allclose(row, stepped.rows[k], rtol=0, atol=1e-11)
    # towards infinity the tables over n^d have a law without n: P(1) n^d -> 1 / Gamma(1 - d)
    assert np.isclose(laws(10**10)[0] + 0.75 * np.log(1e10), -math.lgamma(0.25))


def test_split_contexts_hang_on_the_parent():
    # dish 2 fills many contexts beside a split one; dish 1 is as frequent in the corpus, but only in one
    u = np.r_[np.uint64(1), np.uint64(1), np.arange(10, 60, dtype=np.uint64), np.uint64(9)]
    w = np.r_[np.uint64(1), np.uint64(2), np.full(50, 2, np.uint64), np.uint64(1)]
    n = np.r_[1, 1, np.full(50, 2), 100]
    total = np.r_[300_000, 300_000, np.full(50, 2), 100]
    requests = [(np.array([1], np.uint64), total[:1], np.zeros(2, np.int64), np.array([1, 2], np.uint64), np.array([101, 101]), np.array([0, 1]), n[:2])]
    names, dishes = np.unique(u[2:]), np.array([1, 2], np.uint64)
    requests.append((names, np.array([2 if x > 9 else 100 for x in names]), np.searchsorted(names, u[2:]), dishes, np.array([101, 101]), (w[2:] - 1).astype(np.int64), n[2:]))
    _, above, (hot, _) = pitman_yor.answered(requests, 300_200, 2, 3)
    assert hot.tolist() == [1] and len(above[0]) == 2 and len(above[1]) == 0
    assert above[0][1] > 2 * above[0][0]


def test_tables_of_split_contexts_are_customers_of_parents():
    # a split context with dish 2 seldom and 300 others: each table goes to a group, as a guest of its parent
    w = np.arange(2, 303, dtype=np.uint64)
    n = np.r_[3, np.full(300, 1000)]
    request = (np.array([1], np.uint64), np.array([300_003]), np.zeros(301, np.int64), w, n.astype(np.int64), np.arange(301), n)
    dealt = list(pitman_yor.dealt_tables([request], 400_000, 400, 3, 8))
    guests = {}
    for k, words, counts, times in dealt:
        assert 0 <= k < 8 and np.array_equal(counts, n[words.astype(int) - 2])
        again = pitman_yor._guests_of(pitman_yor._guests(words, counts, times))
        assert all(np.array_equal(x, y) for x, y in zip(again, (words, counts, times)))
        for x, y in zip(words.tolist(), times.tolist()):
            guests[x] = guests.get(x, 0) + y
    assert set(guests) == set(w.tolist()) and {k for k, *_ in dealt} == set(range(8))
    assert all(g <= c for g, c in zip((guests[x] for x in w.tolist()), n))
    # a cold context: of two dishes it never had, of the same count, the one that guests eat is likelier; what it gives sums to one
    words = np.arange(2, 12, dtype=np.uint64)
    asked = (np.array([7], np.uint64), np.array([10]), np.zeros(10, np.int64), words, np.full(10, 40), np.arange(10), np.r_[10, np.zeros(9, np.int64)])
    (plain,), _, _ = pitman_yor.answered([asked], 400, 10, 5)
    (got,), _, _ = pitman_yor.answered([asked], 400, 10, 5, [(np.array([5, 99], np.uint64), np.array([40, 40]), np.array([12, 2]))])
    assert plain[3] == pytest.approx(plain[4]) and got[3] > 2 * got[4] and got.sum() < 1


def test_guests_come_from_split_contexts(spark, monkeypatch):
    rng, write, guests = np.random.default_rng(0), pitman_yor.Workspace.write, []

    def noted(self, frame, name, *options):
        out = write(self, frame, name, *options)
        if name == "guests":
            guests.extend(pitman_yor._guests_of(r.data) for r in out.collect())
        return out

    monkeypatch.setattr(pitman_yor.Workspace, "write", noted)
    texts = [" ".join(f"often w{k}" for k in rng.integers(0, 50, 3000)) for _ in range(120)]  # "often" is a context of some 288,000 tokens
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pitman_yor.scores(rows).collect()}
    assert len(got) == 120 and all(r.base_score < r.score < 0 for r in got.values())
    assert len(np.unique(np.concatenate([x for x, _, _ in guests]))) == 50
    again = {r.doc_id: r.score for r in pitman_yor.scores(rows.repartition(5)).collect()}
    assert all(abs(again[k] - r.score) < 0.01 * abs(r.score) for k, r in got.items())


def test_every_group_is_a_task(spark, monkeypatch):
    """Also where groups, 8 at least, outnumber the shuffle's partitions: each wrote a file of its own, and nothing is dealt once more."""
    write, files, plans = pitman_yor.Workspace.write, {}, {}

    def noted(self, frame, name, *options):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        out = write(self, frame, name, *options)
        if name == "answers":
            files.update({r.file: r.groups for r in out.groupBy(F.input_file_name().alias("file")).agg(F.collect_set("group").alias("groups")).collect()})
        return out

    monkeypatch.setattr(pitman_yor.Workspace, "write", noted)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"often w{k}" for k in rng.integers(0, 50, 3000)) for _ in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert pitman_yor.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 120
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(g for x in files.values() for g in x) == list(range(8)) and all(len(x) == 1 for x in files.values())
    assert all(plans[name].count("hashpartitioning(group") == 0 for name in ("guests", "answers"))


def test_pairs_alone_are_learned():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        has = rng.random(22) < 0.5
        rows.append(np.flatnonzero(has).astype(np.int32) * 7)
        labels.append(float(has[3] == has[11]))  # both or neither
    labels = np.array(labels)
    machine = toxicity.fit(rows[:2400], labels[:2400])
    assert set(machine.terms) >= {21, 77}
    assert ((machine.scores(rows[2400:]) >= 0.5) == labels[2400:]).mean() > 0.95


def test_scores_of_no_rows_and_of_one_class():
    for labels, want in ((np.zeros(3), 0.0), (np.ones(3), 1.0)):
        machine = toxicity.fit([np.array([1, 2], np.int32)] * 3, labels)
        assert np.allclose(machine.scores([np.array([1], np.int32), np.zeros(0, np.int32)]), want, atol=1e-9)
    machine = toxicity.fit([], np.zeros(0))
    assert machine.scores([]).shape == (0,) and machine.scores([np.array([5], np.int32)])[0] < 0.5


def brute(rows, k, asks=lambda i: i % 100 == 0):
    ok = [(i, [math.floor(float(np.float32(c)) * 1024) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if asks(q):
            s = sorted((-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(ok) if b != a and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -z) for n, (z, i) in enumerate(s)]
    return sorted(out)


def test_tree_of_many_levels(spark, monkeypatch):
    for name, value in (("PAGE_ROWS", 32), ("FAN", 4), ("DEALT", 64), ("FLOOR_ROWS", 40), ("SAMPLE", 30)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (20, 6))
    rows = [(i, (middles[i % 20] + rng.normal(0, 0.05, 6)).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] * 6) for i in range(150)]  # more equal vectors than a page holds
    rows += [(1, [2.0] * 6), (1, [2.0] * 6), (100, [0.5] * 6), (7, None), (8, []), (9, [float("nan")] * 6), (None, [1.0] * 6), (2000, [1.0, 2.0]), (2001, [0.5, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    got = sorted(tuple(r) for r in mtree.top_k(frame, "id % 100 = 0", 5).collect())
    assert got == brute(rows, 5)
    assert mtree.top_k(frame.where("false"), "id % 100 = 0", 5).count() == 0


def test_pages_opened_do_not_grow_with_the_rows(spark, monkeypatch):
    from voxelane.llm.workspace import Workspace

    monkeypatch.setattr(mtree, "PAGE_ROWS", 100)
    opened = {}
    for n in (1500, 15_000):
        rng = np.random.default_rng(2)
        middles = rng.normal(0, 1, (n // 50, 8))
        v = (np.repeat(middles, 50, 0) + rng.normal(0, 0.02, (n, 8))) / 4
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows = spark.createDataFrame([(i, 0, np.floor(x * 1024).astype(np.int64).tobytes()) for i, x in enumerate(v)], "id long, copy long, v binary")
        found, pages = mtree.search(*mtree.build(rows, Workspace(spark, "test")), f"id % {n // 30} = 0", 10)
        assert found.count() == 300
        opened[n] = pages / 30
    assert opened[15_000] < 3 * max(2, opened[1500])


def test_held_out_rows_take_no_part():
    assert {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}  # the folds of the contracts are not empty


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    import os

    from voxelane.llm import toxicity

    docs = spark.createDataFrame([(k, f"plain words {k}" + " vile" * (k % 3 == 0)) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels.limit(0)).terms) == 0
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(*rows):
        assert os.getpid() != driver
        return fit(*rows)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    machine = toxicity.train(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert min(found[k] for k in range(0, 120, 3)) > 0.5 > max(found[k] for k in range(1, 120, 3))


def test_nodes_of_deep_trees_have_numbers(spark, monkeypatch):
    """Four routing objects a node at most make some levels: their nodes' numbers must not grow as a power of the depth."""
    for name, value in (("PAGE_ROWS", 8), ("FAN", 1 << 28), ("FLOOR_ROWS", 40), ("SAMPLE", 4)):
        monkeypatch.setattr(mtree, name, value)
    rows = [(i, [float(2 ** (i % 14)) / 64, float(i % 3)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in mtree.top_k(frame, "id % 100 = 0", 5).collect()) == brute(rows, 5)


def test_routing_objects_deal_evenly():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-30, 30, (500, 8)), np.eye(8, dtype=np.int64)[:3] * 10_000])  # a crowd and three far from it
    share = lambda r: np.bincount(mtree._distances(points, r).argmin(1)).max() / len(points)
    assert share(points[mtree.spread(points, 4)]) > 0.9 and share(mtree.routing(points, 8)) < 0.5
    assert mtree.routing(np.zeros((3, 2), np.int64), 2).tolist() == [[0, 0]]
