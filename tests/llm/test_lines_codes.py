"""Line removal and vector codes against plain loops."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from postmill.llm import line_dedup, vector_codes

SPACE = " \t\n\v\f\r"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, chars, docs):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(low(line.strip(SPACE))) >= chars:
                held[low(line.strip(SPACE))].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            of = held.get(low(line.strip(SPACE)), ())
            holder = max(of, key=lambda d: (d is not None, d or 0)) if of else None
            if not (len(of) >= docs and holder != doc):
                keep.append(line)
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def cut(df, **options):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.remove(df, **options).collect()], key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (6, 3)])
def test_lines_equal_a_plain_loop(spark, batches, fanout):
    pick = random.Random(batches)
    lines = ["Footer", "  FOOTER ", "ünïcödé lines", "ÜNÏCÖDÉ LINES", "abcde", "abcd\x00", "", " ", "shared by all \r", "a b c d"]
    rows = [(pick.choice([None, *range(-3, 30)]), None if i == 7 else "\n".join(pick.choices(lines, k=pick.randrange(6)) + [f"own {i}"] * (i % 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut(df, least_chars=5, least_docs=4, batches=batches, fanout=fanout) == plain_lines(rows, 5, 4)


def test_lines_of_odd_tables(spark):
    line = "x" * 40
    rows = [(i, line + "\n" + "tail" * 500_000 if i == 3 else line, "e", i) for i in range(6)] + [(5, line, "f", 9), (9, "", "g", 1), (None, None, "h", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_LINES string, other int")
    got = cut(df)
    assert got == plain_lines([r[:2] for r in rows], 40, 5)
    assert [r[2] for r in got if r[0] == 5] == [0, 0]  # the largest id keeps its lines, in all its rows
    out = line_dedup.remove(df)
    assert out.columns == ["doc_id", "text", "other", "n_lines", "n_dropped"]
    assert cut(df.limit(0)) == []
    # One document less: nothing is shared by enough.
    assert all(r[2] == 0 for r in cut(df.filter("doc_id > 1")))


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(order[0][2])
    kept = [r for r in kept if len(r[2]) == length]
    width = -(-length // parts)
    cut_up = lambda v: [(v + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut_up(r[2])[p] for r in [o for o in order if len(o[2]) == length][:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            sums = defaultdict(list)
            for _, _, v in kept:
                sums[near(cut_up(v)[p], books[p])[1]].append(cut_up(v)[p])
            for e, xs in sums.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, totals = [], defaultdict(int)
    for i, label, v in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut_up(v))]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        totals[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted([(i, code, error, totals[label], digest) for i, label, code, error in out], key=repr)


@pytest.mark.parametrize("size, parts, entries", [(8, 4, 7), (6, 4, 64), (5, 2, 3)])
def test_codes_equal_a_plain_loop(spark, size, parts, entries):
    rng = np.random.default_rng(size)
    rows = [(int(i), [None, 1, 2][i % 3], [float(x) for x in rng.normal(0, 0.03, size)]) for i in rng.permutation(150)]
    rows += [(500, 1, None), (501, 1, [None] * size), (502, 1, [float("nan")] * size), (503, 2, [float("inf")] * size), (504, 2, [0.5]), (505, 1, []), (None, None, [0.1] * size)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, CODE string").repartition(4)
    got = vector_codes.compress(df, parts=parts, entries=entries)
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_codes(rows, parts, entries, 2)
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_masks_find_the_nearest_entry():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-9, 9, (64, 3)), rng.integers(-12, 12, (4000, 3))
    index, error = vector_codes.Slices.of(book).nearest(x)
    all_pairs = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == all_pairs.argmin(axis=1)).all() and (error == all_pairs.min(axis=1)).all()
    with pytest.raises(ValueError):
        vector_codes.start(None, entries=65)
