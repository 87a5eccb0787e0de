"""Runs, product codes and secrets against brute force; hard rows, ties, empty tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from voxelane.llm import codes, queries, runs, secrets


def brute_runs(words, length, periods):
    found = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(length, periods * p) and not any(words[i + q : i + n] == words[i : i + n - q] for q in range(1, p)):
                found.append((i, n, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_document(key, text):
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words, 24, 3)
    gone = {k for a, m, p in found for k in range(a + p, a + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{a},{m},{p}\n" for a, m, p in found)
    return (key, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest(lines.encode()), digest(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def repetitive(rng):
    n, of = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 40])
    words = [f"w{rng.randrange(of)}" for _ in range(n)]
    if n and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randrange(1, 12)
        words = [w if i < a else words[a + (i - a) % min(p, n - a)] for i, w in enumerate(words)]
    return rng.choice([" ", "\n", " \t "]).join(words)


def test_runs_of_against_brute_force():
    rng = random.Random(1)
    for length, periods in ((24, 3), (4, 2), (6, 3)):
        for _ in range(60):
            texts = [repetitive(rng).split() for _ in range(rng.randrange(4))]
            names = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
            got = runs.runs_of([np.array([names[w] for w in t], np.int64) for t in texts], length, periods)
            for k, t in enumerate(texts):
                assert got.get(k, []) == brute_runs(t, length, periods)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("more")), random.Random(9)
    texts = [(k, repetitive(rng)) for k in range(300)]
    texts += [(300, None), (301, ""), (302, " \n\t"), (305, "a b " * 20_000), (304, "x\x1cy\x85z é ☃ " * 30), (None, "q " * 30), (None, "q " * 30), (5, texts[6][1]), (310, "no")]
    for k in range(400, 500):
        number = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        texts.append((k, f"ſecret: not this one, API_Key='{number(20)}' ☃ AKIA{number(16).upper()} sum {number(rng.choice([31, 40]))} " + " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 16))) for _ in range(60))))
    texts += [(500, f"bare {'0f9a3b7c' * 3} and token=short passwd: hunter2hunter2 token=passwd: hunter2hunter2 AKIAAB"), (501, "k" * 3_000_000)]
    # columns of names that operators use themselves
    rows = [(k, t, "en", "s", 1, "x", 7) for k, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, found long").repartition(3).write.parquet(f"{path}/documents.parquet")
    vec = lambda: [round(rng.gauss(0, 0.1), 3) for _ in range(32)]
    vectors = [(k, vec(), k % 3 if k % 5 else None) for k in range(400)]
    vectors += [(400 + k, vectors[0][1], None) for k in range(50)] + [(450, None, 1), (451, [0.1] * 31 + [None], 1), (452, [0.1] * 31 + [float("nan")], 1), (453, [float("-inf")] * 32, 1), (454, [], 2), (-1, [0.5] * 16, 1), (3, vec(), 2), (3, vectors[3][1], 2), (None, vec(), 2), (455, [-0.0] * 32, None)]
    spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, embedding array<float>, label int, code string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path, texts, vectors


def test_runs_of_documents(spark, folder):
    path, texts, _ = folder
    short = [(k, t) for k, t in texts if len(t or "") < 50_000]
    got = queries.op13_runs(spark, path).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert len(got) == len(texts)
    long = {305, 501}
    assert sorted((tuple(r) for r in got if r.doc_id not in long), key=str) == sorted((brute_document(*x) for x in short), key=str)
    one = next(r for r in got if r.doc_id == 305)
    assert (one.n_runs, one.start, one.length, one.period) == (1, 0, 40_000, 2) and one.collapsed_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    kept = [(k, v, lab) for k, v, lab in vectors if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.float32).tolist()))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        away = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        code, error = away.argmin(2), away.min(2).sum(1)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (code[:, p] == e).any():
                        s, n = x[code[:, p] == e, p].sum(0), int((code[:, p] == e).sum())
                        books[p, e] = [int(v) // n for v in s]
    total = {}
    for (_, _, lab), e in zip(kept, error):
        total[lab] = total.get(lab, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(k, "".join(f"{c:02x}" for c in row), int(e), total[lab], digest) for (k, _, lab), row, e in zip(kept, code, error)]


def test_codes_against_brute_force(spark, folder, monkeypatch):
    path, _, vectors = folder
    want = sorted(brute_codes(vectors), key=str)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, queries.op12_codes(spark, path).select(*columns).collect()), key=str) == want
    monkeypatch.setattr(codes, "HOT", 0.4)  # sums of most labels by a join
    assert sorted(map(tuple, queries.op12_codes(spark, path).select(*columns).collect()), key=str) == want


def test_codes_of_few_large_and_no_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, books = codes.encode(frame([]))
    assert found.count() == 0 and books.shape == (16, 0, 0) and codes.label_errors(found).count() == 0
    found, books = codes.encode(frame([(1, [1e38] * 16, 1), (2, [-1e38] * 16, 1), (3, [3.0] * 16, None)]))
    assert sorted((r.vec_id, bytes(r.code)[0], r.error) for r in found.collect()) == [(1, 0, 0), (2, 1, 0), (3, 2, 0)]
    assert int(books[0, 0, 0]) == int(float(np.float32(1e38))) * 256
    found, books = codes.encode(frame([(1, [0.0] * 16, 1), (2, [1e38] * 16, 1), (3, [-1e38] * 16, 1)]), entries=1)
    assert {r.error for r in codes.label_errors(found).select(codes.F.col("label_error").alias("error")).collect()} == {2**63 - 1}


def test_search_outward_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(40):
        k, hi = int(rng.integers(1, 65)), int(rng.choice([2, 50]))
        e, x = rng.integers(-hi, hi, (k, 3)), rng.integers(-hi, hi, (100, 3))
        away = ((x[:, None] - e[None]) ** 2).sum(-1)
        best, least = codes.Codebook(e).nearest(x, rng.integers(0, k, 100).astype(np.uint8))
        assert best.tolist() == away.argmin(1).tolist() and least.tolist() == away.min(1).tolist()


def brute_secrets(text):
    out = []
    patterns = [r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    for k, (pattern, least) in enumerate(zip(patterns, (8, 16, 32))):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets_of_documents(spark, folder):
    path, texts, _ = folder
    got = queries.op11_secrets(spark, path).collect()
    want = sorted(((k, *(sum(s.startswith(f"{n}:") for s in b) for n in ("assign", "access", "hex")), hashlib.sha256(",".join(b).encode()).hexdigest()) for k, t in texts for b in [brute_secrets(t)]), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    rows = {r.doc_id: r.spans.split(",") if r.spans else [] for r in got}
    for k, t in texts:
        if k is not None and k != 5:
            assert [s for s in rows[k] if not s.startswith("like_")] == brute_secrets(t)
    assert "like_hex:5:29" in rows[500] or "like_assign:5:29" in rows[500]  # of a form learnt, though too short for the pattern
    added = [s for k, spans in rows.items() if k is not None and k < 400 for s in spans]
    assert added == [] and rows[501] == []  # ordinary words are none
    assert secrets.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert secrets.find(spark.createDataFrame([(1, "ordinary words withoutanysecrets")], "doc_id long, text string")).first().found == []


def test_inferred_automata():
    rng = random.Random(2)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(800)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(12, 20))) for _ in range(800)]
    a, b = secrets.infer(keys[:600]), secrets.infer(words[:600])
    assert len(a.to) >= 4  # the prefix stays a chain of states
    assert (a.scores(keys[600:]) - b.scores(keys[600:]) > 10).all() and (b.scores(words[600:]) - a.scores(words[600:]) > 10).all()
    other = ["Z" + k[1:] for k in keys[600:]]
    assert (a.scores(keys[600:]) > a.scores(other) + 5).all()
    some = [*keys[:50], "A" * 700, "AKIA", "b" * 300]
    one = np.concatenate([a.scores([t]) for t in some])
    assert np.allclose(a.scores(some), one) and len(a.scores([])) == 0
    for t, s in zip(some, one):  # symbol by symbol
        state, total = 0, 0.0
        for c in t:
            total, state = total + a.weight[state, secrets.SYMBOLS.index(c)], a.to[state, secrets.SYMBOLS.index(c)]
        assert abs(total + a.weight[state, -1] - s) < 1e-6
