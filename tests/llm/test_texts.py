"""Operators over texts against brute force on small fixtures."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from postmill.llm import decontaminate, near_dedup, suffix_dedup
from postmill.llm import bytewords as bw


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def some_words(rng, n, size=40):
    return [f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"W{rng.randrange(size)}" for _ in range(n)]


# -- words -------------------------------------------------------------------

def test_words_of_bytes_are_words_of_characters():
    import pyarrow as pa

    texts = ["", None, "Ab  cd\tÉf", "x", " \n ", "日本 語", "a" * 3000, "end."]
    got = []
    for lo, hi, w in bw.words(pa.array(texts), bw.NOT_SPACE):
        for t in range(hi - lo):
            got.append([w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.first[t] : w.first[t + 1]], w.end[w.first[t] : w.first[t + 1]])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]


# -- decontamination ---------------------------------------------------------

def words7(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_hits(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = words7(t), set(), set()
        for k, x in items:
            v = words7(x)
            n = min(window, len(v))
            grams = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    found.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(k, " ".join(some_words(rng, rng.randrange(9, 40)))) for k in range(30)] + [(100, "Only three words"), (101, "one"), (102, ""), (103, None), (None, "null, id: item-text"), (3, "twice the id 3"), (110, "x y z " * 9)]
    docs = []
    for i in range(200):
        w = some_words(rng, rng.randrange(0, 80))
        if rng.random() < 0.5:
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(src)))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(5, 30)]
        docs.append((i, ",\n".join(w) if i % 2 else " ".join(w)))
    docs += [(7, "only THREE words here"), (7, "only THREE words here"), (None, items[0][1]), (900, None), (901, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(d, b, keep=["doc_id"])
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items)
    assert not decontaminate.judge(d, b.limit(0)).filter("contaminated").count()
    assert decontaminate.judge(d.limit(0), b).count() == 0
    from pyspark.sql import functions as F

    clash = decontaminate.judge(d.withColumn("N_HIT", F.lit("x")), b)
    assert [c for c in clash.columns if c.lower() == "n_hit"] == ["n_hit"]


# -- near duplicates ---------------------------------------------------------

def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(docs, k, percent):
    """Rows are nodes; a group's id is the least of its rows' ids."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(sets)), 2):
        (i, a), (j, b) = sets[x], sets[y]
        if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
            root[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), None if i is None else least[find(x)], i is None or least[find(x)] == i) for x, (i, s) in enumerate(sets)), key=repr)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 384), (5, 80, 8)])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(k)
    docs = [(i, " ".join(some_words(rng, rng.randrange(1, 120), 5000))) for i in range(60)]
    base = some_words(rng, 150, 5000)
    docs += [(100 + i, edited(rng, base, rng.randrange(0, 9))) for i in range(80)]
    other = some_words(rng, 200, 5000)
    docs += [(300 + i, edited(rng, other, i % 4)) for i in range(20)] + [(400 + i, " ".join(other)) for i in range(15)]
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "two words"), (504, "TWO\twords"), (None, " ".join(other)), (400, " ".join(other)), (600, "long " * 5000)]
    rng.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_dedup.group(d, shingle=k, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(docs, k, percent)
    assert near_dedup.group(d.limit(0)).count() == 0


def test_keeping_one_of_each_group(spark):
    docs = [(i, "same words in this text all the time") for i in range(5)] + [(9, "another text that stands for itself alone"), (10, None), (11, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = near_dedup.keep_one(d)
    assert sorted(r.doc_id for r in out.collect()) == [0, 9, 10, 11] and out.columns == d.columns


def test_rows_that_share_an_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "sun moon star sky cloud rain")
    rows = [(1, a, 1), (5, b, 2), (5, a, 3), (9, b, 4), (7, c, 5), (7, c, 6), (8, None, 7), (8, "", 8), (None, a, 9), (None, a, 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, KEPT int")
    got = near_dedup.group(d)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups([r[:2] for r in rows], 5, 80)
    left = near_dedup.keep_one(d)
    assert left.columns == d.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (7, c), (8, None), (8, ""), (None, a), (None, a)], key=repr)


# -- repeated strings --------------------------------------------------------

def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        t = [rng.randrange(rng.choice([1, 2, 3, 7])) for _ in range(rng.randrange(40))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute_removed(docs, length):
    first, out = {}, []
    for i, b in sorted((i, (t or "").encode()) for i, t in docs if i is not None):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (i, p))
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < (i, p):
                gone[p : p + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "share"), [(1024, 1024), (1, 4), (1, 1024)])
def test_repeated_strings(spark, monkeypatch, most, share):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    rng = random.Random(2)
    words = [f"wörd{j}" if j % 9 == 0 else f"word{j}" for j in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(12, 40))) for _ in range(8)]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 30)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a : len(p) - rng.randrange(len(p) // 3)], " ".join(rng.choices(words, k=rng.randrange(0, 12)))]
        docs.append((i, "".join(parts)))
    docs += [(200, "a" * 1000), (201, "ab" * 400), (202, docs[3][1]), (203, docs[3][1]), (204, None), (205, ""), (206, "short"), (207, passages[0] * 30), (-5, passages[1])]
    docs += [(300, docs[5][1]), (300, docs[5][1]), (None, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove(d)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removed(docs, 100)
    assert suffix_dedup.remove(d.limit(0)).count() == 0
