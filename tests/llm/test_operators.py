import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from voxelane.llm import bpe, decontaminate, line_dedup, mtree, pitman_yor, simhash, suffix_dedup, token_files, toxicity, warc

SCHEMA = "doc_id long, text string, component string, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)


LONG = " ".join(f"word{i}" for i in range(120))
ROWS = [(1, LONG), (2, LONG), (3, LONG.replace("word50", "other")), (4, None), (5, ""), (6, "a b"), (6, "a b"), (None, "one two three four")]


def test_simhash(spark):
    got = {(r.doc_id, r.fp): r.component for r in simhash.near_duplicates(docs(spark, ROWS)).collect()}
    fp = {t: np.uint64(simhash.fingerprint(t)).view(np.int64) for _, t in ROWS}
    assert got[1, fp[LONG]] == got[2, fp[LONG]] == 1 and got[4, 0] == got[5, 0] == 4
    kept = sorted(r.doc_id or 0 for r in simhash.keep_one(docs(spark, ROWS)).collect())
    assert kept.count(6) == 1 and 2 not in kept and 5 not in kept and 0 in kept
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_a_cut_cell(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {frozenset(r) for r in simhash.links(frame, cell_rows=8).collect()}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for pair in found:
        a, b = pair
        assert (a ^ b).bit_count() <= 3
        parent[root(a)] = root(b)
    assert len({root(f) for f in fps}) == 1


def test_bpe_is_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, mine = Tokenizer.from_file(path), bpe.Codec(path)
    for text in ("", "Hello  world's\n\n12é<|endoftext|> x", "́\x1c 　ab", LONG, "a" * 3000):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids and mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    encoded = bpe.encode(docs(spark, ROWS), path)
    assert sorted(r.text for r in bpe.decode(encoded, path).collect()) == sorted(t or "" for _, t in ROWS)


def test_token_files(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for encoding in ("dictionary", "delta"):
        path = f"file://{tmp_path}/{encoding}"
        token_files.write_tokens(docs(spark, ROWS), path, P.path("word_bpe_49k.json"), encoding=encoding)
        rows = sorted(token_files.digests(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6]
        at = 0
        for r, t in zip(rows, ["one two three four", LONG, ROWS[2][1], "", "", "a b", "a b"]):
            n = len(lib.encode(t if r.doc_id else "one two three four", add_special_tokens=False).ids) + 1
            if r.doc_id in (None, 1):
                assert (r.start, r.n_tokens) == (at, n)
            at += r.n_tokens


def test_mtree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 4)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 4), (302, [0.1, None, 0.2, 0.3]), (5, [9.0, 9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(frame, "id % 100 = 0", 3).collect()}
    v = [(i, [math.floor(float(np.float32(c)) * 1024) for c in x]) for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    for q in (0, 100, 200):
        own = v[q][1]
        s = sorted((-sum(a * b for a, b in zip(own, x)), i) for i, x in v if i != q)[:3]  # rows that repeat an id are candidates too
        assert [got[q, k + 1] for k in range(3)] == [(i, -x) for x, i in s]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ b", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, "WARC/1.1\r\n\r\nx"), (4, "u", None), (5, "u", "")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_captures(pages, path)
    rows = warc.transactions(warc.read_records(spark, path)).collect()
    kinds = sorted((r.capture.split(":")[2], r.main.record_type, r.main.payload_bytes) for r in rows)
    assert kinds == [("1", "revisit", 4), ("2", "response", 4), ("2", "revisit", 4), ("3", "response", 13), ("4", "revisit", 0), ("5", "response", 0)]
    assert all(r.request is not None and len(r.metadata) == 1 for r in rows)


def test_edit_distance(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(0)
    pairs = []
    for _ in range(300):
        a = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = [rng.choice("ab")] * rng.randrange(0, 2)
        pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("want"), line_dedup._distance_of(F.col("a"), F.col("b"), 2).alias("got"))
    for r in frame.collect():
        assert r.got == (r.want if r.want <= 2 else None)


def test_line_dedup(spark):
    line = "this is a line of more than twenty-four characters"
    rows = [(1, line + "\nshort\n\n"), (2, line.replace("more", "mare") + "\nshort\nown"), (3, None), (4, "")]
    found = {(r.doc_id, r.line_no): (r.kind, r.first_doc, r.edits) for r in line_dedup.repeats(docs(spark, rows)).collect()}
    assert found == {(2, 0): ("near", 1, 1), (2, 1): ("exact", 1, 0)}
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeats(docs(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "own", 3: None, 4: ""}
    assert line_dedup.repeats(docs(spark, [])).count() == 0


def test_decontamination(spark):
    item = "then Bob paid 10 km of rope to Anna and she sold 10 km of rope to Carl for 5 eur"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    rows = [(1, "aa then Joe paid 77 km of rope to Lisa and she sold 77 km of rope to Mike for 9 eur bb"), (2, item.replace("10", "77", 1)), (3, "x " + item), (4, None), (5, "")]
    assert {r.doc_id: r.same_slots for r in decontaminate.leaks(docs(spark, rows), items).collect()} == {1: False, 3: True}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs(spark, rows), items).collect()) == [2, 4, 5]


def test_suffix_dedup(spark):
    rng = np.random.default_rng(0)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = text(450)
    rows = [(1, text(500) + shared + text(300)), (2, shared), (3, text(700)), (4, None), (5, text(399)), (6, "é" * 1500)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[5].n_removed) == (450, 450, 0, 0)
    assert got[6].n_removed == 3000 and got[4].n_bytes == 0
    assert got[1].kept_sha256 == hashlib.sha256((rows[0][1][:500] + rows[0][1][950:]).encode()).hexdigest()


def test_pitman_yor(spark):
    import zlib

    rows = [(i, "the cat sat on the mat " * (1 + i % 3) + f"w{i}") for i in range(60)] + [(60, None), (61, "")]
    got = {r.doc_id: r for r in pitman_yor.scores(docs(spark, rows)).collect()}
    tok = {i: (t or "").split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tok}
    c = Counter(w for i in tok if not held[i] for w in tok[i])
    n, v = sum(c.values()), len(c)
    for i in tok:
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(tok[i]), sum(c[w] > 0 for w in tok[i]), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok[i]))
    assert sum(got[i].score for i in tok if held[i]) > sum(got[i].base_score for i in tok if held[i])


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = [f"plain{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" awful" if i % 4 == 0 else "")) for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs(spark, rows), labels, where=toxicity.remainder("doc_id") != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), machine).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in range(400)) > 390 and got[401] < 0.5
    assert toxicity.reject(docs(spark, rows), machine).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_near_copies_of_the_pipeline_stage(spark):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    texts = []
    for family in range(12):
        base = [word() for _ in range(int(rng.integers(30, 300)))]
        for changes in range(6):  # each change of one word costs five shingles
            own = list(base)
            for at in rng.choice(len(own), min(changes * len(own) // 90, len(own)), replace=False):
                own[at] = word()
            texts.append(" ".join(own))
    texts += ["same few", "same few", "", None, "Same FEW"]
    common = " ".join(word() for _ in range(30))
    texts += [common + " " + " ".join(word() for _ in range(10)) for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(texts)
    rows = list(enumerate(texts))

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    label, shares = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if not u or 5 * len(sets[i] & sets[j]) >= 4 * u:
                shares.append(len(sets[i] & sets[j]) / max(u, 1))
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert any(0.8 <= s < 0.85 for s in shares) and any(0.85 <= s < 0.97 for s in shares)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(spark, rows), "").collect()}
    assert kept == set(label)
    for how in ({"heavy_rows": 5}, {"far": None, "rounds": 0}):
        got = {r.doc_id: r.component for r in simhash.near_copies(docs(spark, rows), **how).collect()}
        assert got == dict(enumerate(label))
    for a in range(0, len(sets), 7):  # the embedding's distance is a lower bound
        one, other = (np.unique(simhash._shingles(texts[k], 5)) for k in (a, a - 1))
        bits = sum((x ^ y).bit_count() for x, y in zip(simhash._parities(one), simhash._parities(other)))
        assert bits <= len(np.setxor1d(one, other))


def test_near_copies_whose_repeats_differ(spark):
    """Sets of shingles can be alike where SimHashes, which count repeats, are far apart; and sets of any two sizes are compared."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    rows = [(1, " ".join(base)), (2, " ".join(base + base[:10] * 200)), (3, " ".join(f"v{k}" for k in rng.integers(0, 10**6, 400)))]
    one, other = ([simhash._simhash(f(simhash._shingles(t, 5))) for f in (lambda x: x, simhash._mixed)] for _, t in rows[:2])
    assert sum((a ^ b).bit_count() for a, b in zip(one, other)) > simhash.FAR
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(spark, rows), "").collect()} == {1, 3}
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 1100, 2000, 2100, 9000, 20_000)]
    sets.append(np.unique(np.r_[sets[4][:8500], sets[3]]))
    differ = simhash._folded([simhash._wide(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    got = differ(i, j)
    assert np.all(got <= true) and np.all(got > 100) and not differ(i, i).any()


def test_decontamination_of_repeating_templates(spark):
    items = {
        1: "2, 4, 6, 8, 10, 12, 14, 16",
        2: "5 km 6 km 7 km 8 km 9 km",
        3: "seen by Ada Bob Cleo Dan Eve Finn Gus",
        4: "give 3 kg 4 kg 3 kg 4 kg 3 kg 5 kg 3 kg",
    }
    texts = {
        11: "aa " + items[1] + " bb",
        12: "they ran " + items[2] + " in all",
        13: "they were " + items[3] + " at noon",
        14: "then " + items[4] + " away",
        21: "aa 3, 5, 7, 9, 11, 13, 15, 17 bb",
        24: "then give 8 kg 9 kg 8 kg 9 kg 8 kg 7 kg 8 kg away",
        31: "then " + items[4].replace("4 kg 3 kg 5", "4 kg or 3 kg 5") + " away",
        41: "then give 8 kg 9 kg 7 kg 6 kg 5 kg 4 kg 1 kg away",
    }
    frame = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered == r.item_tokens, r.same_slots) for r in decontaminate.leaks(docs(spark, list(texts.items())), frame).collect()}
    for doc, item, same in ((11, 1, True), (12, 2, True), (13, 3, True), (14, 4, True), (21, 1, False), (24, 4, False)):
        assert got[doc, item] == (True, same)
    assert got[31, 4][1] and (41, 4) not in got
    assert not {d for d, _ in got} - set(texts) and 41 in {r.doc_id for r in decontaminate.drop_leaks(docs(spark, list(texts.items())), frame.where("item_id = 4")).collect()}


def test_alignment_is_monotone(spark):
    from pyspark.sql import functions as F

    def grid(*hits):
        return [(i, [1001 if (i, s) in hits else 0 for s in range(8)]) for i in range(6)]

    cases = [grid((0, 0), (1, 0), (2, 3), (3, 3), (4, 1), (5, 1)), grid((0, 3), (1, 3), (3, 2), (4, 2)), grid((0, 3), (1, 2), (2, 1), (5, 0)), grid((0, 7), (1, 7), (2, 7)), grid()]
    frame = spark.createDataFrame([(k, g) for k, g in enumerate(cases)], "k int, g array<struct<spot:int,weights:array<int>>>")
    got = {r.k: [(c // 8, c % 8) for c in r.p] for r in frame.select("k", decontaminate._path(F.col("g")).alias("p")).collect()}
    assert len(got[0]) == 4 and got[1] == [(0, 3), (1, 3), (3, 2), (4, 2)] and len(got[2]) == 2 and got[3] == [(0, 7), (1, 7), (2, 7)] and got[4] == []
    for path in got.values():
        assert all(a[0] < b[0] and sum(a) < sum(b) for a, b in zip(path, path[1:]))


def test_warc_of_repeated_keys(spark, tmp_path):
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "v", "two"), (None, "u", "one"), (None, "u", "three"), (None, "w", "three"), (2, "u", "a"), (2, "u", "a"), (3, "u", "four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 4):
        path = f"file://{tmp_path}/{least}"
        warc.write_captures(pages, path, min_revisit_bytes=least)
        got = warc.transactions(warc.read_records(spark, path)).collect()
        assert all(r.main is not None and r.request is not None and len(r.metadata) == 1 for r in got)
        assert sorted((r.capture.split(":")[2], r.main.payload_bytes) for r in got) == sorted((str(i or "null"), len(h)) for i, _, h in rows)
        responses = {r.capture: r.main.payload_digest for r in got if r.main.record_type == "response"}
        revisits = [r.main for r in got if r.main.record_type == "revisit"]
        assert all(responses[m.refers_to] == m.payload_digest for m in revisits) and len(revisits) == (1 if least else 4)


def test_bpe_keeps_what_is_asked_for_again(monkeypatch):
    """A full memory loses what is rare, not the words that come again and again."""
    import public_tokenizers

    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    codec, seen = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json")), []
    encode = codec.encode_piece
    monkeypatch.setattr(codec, "encode_piece", lambda p: seen.append(p) or encode(p))
    texts = [f" again rare{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    got = [codec.encode(t) for t in texts]
    assert seen.count(" again") == 1 and len(seen) == 41 and len(codec.known) + len(codec.older) <= 8
    assert [codec.decode(x) for x in got] == texts
