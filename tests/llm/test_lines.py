"""Line deduplication against a plain comparison of all lines."""

import random

import pytest

from voxelane.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(rows, edits=2, least=24):
    """Sorted (doc, line_no, kind, first_doc, first_line, edits); rows of one key in order of what the operator calls their copy."""
    every = [(d, n, c, line) for d, c, t in rows if d is not None and t is not None for n, line in enumerate(t.split("\n")) if line.strip(" ")]
    every.sort(key=lambda r: r[:3])
    first, near, out = {}, {}, []
    for d, n, _, line in every:
        if line in first:
            out.append((d, n, "exact", *first[line][:2], 0))
            if line in near:
                pass
        else:
            if len(line) >= least:
                for other, (fd, fn) in first.items():
                    if len(other) >= least and abs(len(other) - len(line)) <= edits and (k := distance(other, line)) <= edits:
                        near[line] = (fd, fn, k)
                        break
            first[line] = (d, n)
            if line in near:
                out.append((d, n, "near", *near[line]))
    return sorted(out)


def found(spark, rows, **how):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, line_dedup.repeats(frame, **how).select("doc_id", "line_no", "kind", "first_doc", "first_line", "edits").collect()))


def families(seed):
    rng, rows = random.Random(seed), []
    for k in range(6):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randrange(22, 60))).strip() + "x"
        for i in range(25):
            line = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(0, len(line) + 1)
                line[at : at + rng.randrange(0, 2)] = rng.choice(["", "é", "z", "qq"])
            rows.append("".join(line))
    rng.shuffle(rows)
    return [(i // 3, "\n".join(rows[i : i + 3] + [""])) for i in range(0, len(rows), 3)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_families_of_close_lines(spark, edits):
    rows = families(edits)
    assert found(spark, rows, edits=edits) == plain([(d, 0, t) for d, t in rows], edits)


def test_hot_keys_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROWTH", 2)
    # lines that share their first third, most of them far apart
    rng = random.Random(5)
    rows = [(i, "the same beginning of many" + "".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(60)]
    rows += [(100 + i, rows[i][1][:-1] + "Z") for i in range(0, 60, 5)]
    want = plain([(d, 0, t) for d, t in rows])
    assert len(want) == 12
    assert found(spark, rows) == want
    monkeypatch.setattr(line_dedup, "HOT", 5)
    assert found(spark, rows) == want
    assert found(spark, families(9)) == plain([(d, 0, t) for d, t in families(9)])


def test_repeated_rows_nulls_and_long_lines(spark):
    long = "a long line of many characters " * 3000
    rows = [(1, "hello"), (1, "hello"), (None, "hello"), (2, None), (3, ""), (4, long), (5, long[:-1] + "!"), (6, "ab " * 20), (6, "ab " * 20 + "c")]
    got = found(spark, rows)
    assert got == [(1, 0, "exact", 1, 0, 0), (5, 0, "near", 4, 0, 1), (6, 0, "near", 6, 0, 1)]
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, _cut int, lines string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in line_dedup.drop_repeats(frame).collect())
    assert [x for x in kept if x[0] == 1] == [(1, ""), (1, "hello")] and (5, "") in kept and (0, "hello") in kept and len(kept) == len(rows)
    assert line_dedup.drop_repeats(frame).columns == frame.columns
    assert [x for x in kept if x[0] == 6 and not x[1]] == [(6, "")]
    empty = frame.where("false")
    assert line_dedup.drop_repeats(empty).count() == 0 and line_dedup.repeats(empty).count() == 0


def test_keys_that_are_text(spark):
    frame = spark.createDataFrame([("b", "one line"), ("a", "one line"), ("c", "other")], "id string, body string")
    assert [tuple(r) for r in line_dedup.repeats(frame, "body", "id").collect()] == [("b", 0, "exact", "a", 0, 0)]
