"""The registered queries and the pipeline on small tables, against brute force; hard rows for every operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from voxelane.llm import decontaminate, line_dedup, mtree, pitman_yor, queries, simhash, suffix_dedup, token_files, toxicity, warc
from voxelane.llm.workspace import shared_root, small_enough

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sentences(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}{rng.choice(['', 'é', 'X'])}" for _ in range(n))


def documents():
    rng = random.Random(4)
    texts = [sentences(rng, rng.randrange(3, 150)) + "\n" + sentences(rng, rng.randrange(0, 60)) for _ in range(50)]
    shared = sentences(rng, 120, 10**6)
    texts += [texts[3], texts[3], texts[5].replace("w1", "w2", 1), "x " + shared + " " + texts[7], texts[8] + shared, None, "", "", " \n\t ", "ab" * 700, "<|endoftext|> done  ", "naïve ﬁ ☃ \U0001f600 \x1c \x85 end"]
    texts += [f"{t} awful slur" for t in texts[20:40]]
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2], (None, "no key at all", "en", "s", 13)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, int("awful" in (t or ""))) for d, t, *_ in rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "pay Bob 10 km of rope and sell 10 km of rope to Carl now"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_fingerprints_and_components(spark, folder):
    import xxhash

    fps = []
    for d, t, *_ in documents():
        words = [w.decode("utf-8") for w in WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    least = list(range(len(fps)))
    for i, (_, a) in enumerate(fps):
        for j, (_, b) in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 3:
                x, y = least[i], least[j]
                least = [min(x, y) if k in (x, y) else k for k in least]
    names = {g: min((fps[k][0] for k, h in enumerate(least) if h == g and fps[k][0] is not None), default=None) for g in least}
    want = sorted(((d, f"{f:016x}", names[g]) for (d, f), g in zip(fps, least)), key=str)
    assert rows_of(queries.op4_simhash(spark, folder).select("doc_id", "fingerprint", "component_id")) == want


def test_bpe_digests(spark, folder):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for d, t, *_ in documents():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(queries.op8_bpe(spark, folder)) == sorted(want, key=str)


def test_token_file_digests(spark, folder, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for d, t, *_ in documents():
        own.setdefault(d, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    want, at = [], 0
    for d in sorted(own, key=lambda d: (d is not None, d)):
        for ids in own[d]:  # rows that repeat a key are equal here
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert rows_of(queries.op6_token_files(spark, folder)) == sorted(want, key=str)
    path = f"file://{tmp_path}/delta"
    token_files.write_tokens(queries.table(spark, folder, "documents").withColumnRenamed("lang", "key"), path, P.path("word_bpe_49k.json"), encoding="delta")
    assert rows_of(token_files.digests(token_files.read_tokens(spark, path))) == sorted(want, key=str)


def removed(texts, length=400):
    """(bytes, removed, spans, digest of the rest) of texts by a table of all their windows."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def hard_texts():
    rng = random.Random(6)
    letters = lambda n, of="abcdefgh": "".join(rng.choice(of) for _ in range(n))
    base, passage = letters(900), letters(460)
    texts = [letters(500) + passage + letters(rng.randrange(0, 300)) for _ in range(12)]
    texts += [passage[:399], passage[:400], passage[20:], letters(700) + base[:450], base, base[100:700] + "z" + base[701:], "ab" * 500, "aba" * 300 + "x", "é" * 450, "q" * 1200]
    texts += [letters(300) + passage[30:420] + letters(300) for _ in range(6)]  # a common gram, no common window
    return texts + [texts[3], None, "", letters(399)]


@pytest.mark.parametrize("heavy", [256, 2])
def test_repeated_windows(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    texts = hard_texts()
    want = sorted((i, *r) for i, r in enumerate(removed(texts)))
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k1 long")
    assert rows_of(suffix_dedup.remove_repeats(frame).drop("repeats")) == sorted(want, key=str)


def test_near_misses_are_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base, texts, rows, write = [f"w{i}" for i in range(500)], [], {}, simhash.Workspace.write
    for i in range(30):  # similarities of about 0.7 within the family
        own = list(base)
        for k in range(17):
            own[29 * k + rng.randrange(4, 25)] = f"x{i}-{k}"
        texts.append(" ".join(own))

    def counted(self, frame, name, *options):
        out = write(self, frame, name, *options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(simhash.Workspace, "write", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(496)} for t in texts]
    near = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    got = {r.doc_id: r.component for r in simhash.near_copies(frame, rounds=0).collect()}
    assert near == 0 and got == {i: i for i in range(30)}
    assert rows["round-0-pairs"] <= 5


def test_near_copies_make_few_rows(spark, monkeypatch):
    """Many copies of a passage that differ in a letter each: classes are refined where they differ, not taken apart everywhere."""
    rng = random.Random(9)
    passage, texts, rows, write = "".join(rng.choice("abcdefgh") for _ in range(700)), [], [], suffix_dedup.Workspace.write
    for k in range(40):
        i = rng.randrange(700)
        texts.append(f"{k:03d}" + passage[:i] + "z" + passage[i + 1 :])

    def counted(self, frame, name, options=None):
        out = write(self, frame, name, options)
        rows.append(out.count() if name.startswith(("classes", "crowd-windows")) else 0)
        return out

    monkeypatch.setattr(suffix_dedup, "HEAVY", 2)
    monkeypatch.setattr(suffix_dedup.Workspace, "write", counted)
    want = sorted((i, *r) for i, r in enumerate(removed(texts)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(frame).drop("repeats")) == sorted(want, key=str)
    print(rows)
    assert 0 < max(rows) < 1500


def test_colliding_hashes_are_looked_up():
    texts = [b"x" * 500 + b"y" * 20, b"x" * 450, b"z" * 400]
    args = texts, np.zeros(3, int), np.array([50, 50, 50]), np.ones(3, int)
    assert [f.tolist() for f in suffix_dedup._looked_up(*args, 400)] == [f.tolist() for f in suffix_dedup.repeated(*args)]


def test_repeats_of_the_documents(spark, folder):
    want = [(d, *r) for (d, *_), r in zip(documents(), removed([t for _, t, *_ in documents()]))]
    assert rows_of(queries.op7_suffix_dedup(spark, folder).drop("repeats")) == sorted(want, key=str)


def test_model_scores_do_not_depend_on_partitions(spark, folder):
    def scores():
        return {(r.doc_id, r.n_tokens): r for r in queries.op2_pitman_yor(spark, folder).collect()}

    one = scores()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = scores()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: r.score for k, r in one.items()} == {k: r.score for k, r in again.items()}
    assert len(one) > 60 and all(r.score < 0 for r in one.values())


def test_toxicity_of_held_out_documents(spark, folder):
    got = queries.op5_toxicity(spark, folder).collect()
    texts = {(d, t) for d, t, *_ in documents()}
    assert len(got) == len(documents()) and {r.doc_id for r in got} == {d for d, _ in texts}
    bad = {d for d, t in texts if "awful" in (t or "")}
    assert sum(r.predicted == (r.doc_id in bad) for r in got) >= len(got) - 2
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def jaccard(a, b):
    def of(t):
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = of(a), of(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_pipeline(spark, folder):
    import corpus_pipeline

    from tests.llm.test_lines import plain

    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    machine = queries.toxicity_machine(spark, folder)
    terms = toxicity.Terms()
    docs = [(d, t) for d, t, *_ in documents() if machine.scores([terms.of(t)])[0] < 0.5]
    copies, seen = [], {}
    for d, t in sorted(docs, key=lambda r: str(r[1])):
        copies.append((d, seen.setdefault(d, 0), t))
        seen[d] += 1
    repeats = {}
    for d, c, t in copies:  # plain() names lines by key and number; the one key that repeats here holds one text twice
        repeats.setdefault((d, c), set())
    for d, n, kind, fd, fn, _ in plain(copies):
        own = [c for (k, c) in repeats if k == d]
        for c in own if (d, n) != (fd, fn) else own[1:]:
            repeats[d, c].add(n)
    docs = [(d, t if t is None or d is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in repeats[d, c])) for d, c, t in copies]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if jaccard(docs[i][1], docs[j][1]) >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if x in (a, b) else x for x in group]
    least = {g: min((docs[k][0] for k, h in enumerate(group) if h == g and docs[k][0] is not None), default=None) for g in group}
    kept, done = [], set()
    for (d, t), g in zip(docs, group):
        if d is None or (d == least[g] and d not in done):
            kept.append((d, t))
            done.add(d)
    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = sorted(((d, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in kept), key=str)
    got = sorted(((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert got == want
    leak = (900, "then pay Joe 77 km of rope and sell 77 km of rope to Mike now " + sentences(random.Random(1), 30), "en", "s", 9)
    more = queries.table(spark, folder, "documents").union(spark.createDataFrame([leak], "doc_id long, text string, lang string, source string, n_chars long"))
    stayed = corpus_pipeline.drop_benchmark_leaks(spark, more, folder)
    assert stayed.columns == more.columns and stayed.count() == more.count() - 1 and not stayed.where("doc_id = 900").count()


HARD = "doc_id long, text string, key string, line string, fp long, n long, h long, row string, copy long, _gone long, _twice long, _key long, cut string, k1 long, vec_id string"


def hard_rows():
    long = " ".join(f"long{i % 5000}" for i in range(700_000))  # 6 MB
    rows = [(1, long), (2, long), (2, long), (3, None), (None, "text without a key"), (None, None), (4, ""), (5, "a"), (5, "other text of a repeated key"), (6, "a")]
    return [(*r, None, "x", None, 1, None, "r", 0, 1, 2, 3, None, 5, "v") for r in rows]


def test_hard_rows_and_empty_tables(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    frame = spark.createDataFrame(hard_rows(), HARD).repartition(2)
    items = spark.createDataFrame([(1, "other text of a repeated key", "z"), (1, "a text of the same item here", "y"), (None, "x", None), (2, None, "n")], "item_id long, text string, doc_id string")
    labels = spark.createDataFrame([(5, 1), (6, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.train(frame, labels)
    for docs, n in ((frame, 10), (frame.where("false"), 0)):
        assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == ({5} if n else set())
        assert decontaminate.leaks(docs, items.where("false")).count() == 0
        assert decontaminate.drop_leaks(docs, items).count() == (8 if n else 0)
        assert len(pitman_yor.scores(docs).collect()) == n
        assert len(simhash.near_duplicates(docs).collect()) == n
        assert simhash.keep_one(docs, shingle=5, percent=80).columns == frame.columns
        assert simhash.keep_one(docs, shingle=5, percent=80).count() == (5 if n else 0)
        assert toxicity.score(docs, machine).count() == n and toxicity.reject(docs, machine).columns == frame.columns
        path = f"file://{tmp_path}/tokens-{n}"
        token_files.write_tokens(docs, path, P.path("word_bpe_49k.json"))
        assert token_files.digests(token_files.read_tokens(spark, path)).count() == n
        found = suffix_dedup.remove_repeats(docs).collect()
        assert len(found) == n and all((r.n_removed > 0) == (r.n_bytes > 400) for r in found)
        assert line_dedup.drop_repeats(docs).count() == n
        pages = docs.selectExpr("doc_id AS page_id", "key AS url", "text AS html", "*")
        path = f"file://{tmp_path}/warc-{n}"
        warc.write_captures(pages, path)
        assert warc.transactions(warc.read_records(spark, path, payloads=False)).where("main IS NOT NULL AND size(metadata) = 1").count() == n


def test_small_enough_goes_by_bytes(spark):
    frame = spark.createDataFrame([("x" * 1_200_000, [1, 2])], "a string, b array<int>")
    assert small_enough(frame, 2) and not small_enough(frame, 1)
    assert small_enough(frame.where("false"), 0.001)
    assert shared_root(spark).startswith(("file:", "/", "hdfs"))
    assert mtree.spread(np.zeros((3, 2)), 2).tolist() == [0]
