"""Search, URL rules, token counts and the two trained models."""

import random
import math
from collections import Counter

import numpy as np
import pytest

from postmill.llm import language, token_counts, topk_search, toxicity, url_filter

SMALL = "/root/testdata/sf0.01"


# -- top-k -------------------------------------------------------------------

def brute_top(rows, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, queries = [], {}
    for i, v in usable:
        if i % 100 == 0:
            queries[i] = min(v, queries.get(i, v))
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in usable if i != q and len(v) == len(x))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, query_bytes", [(0.2, 1 << 20), (40.0, 200)])
def test_search(spark, scale, query_bytes, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 128)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", query_bytes)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, scale) for _ in range(9)]) for i in range(700)]
    same = [0.5] * 9
    rows += [(1000 + i, same) for i in range(150)] + [(2000, [0.0] * 9), (2100, [1.0, 2.0]), (2101, [1.0, 3.0]), (2102, []), (2200, [])]
    rows += [(3000, None), (3001, [None] * 9), (3002, [float("nan")] * 9), (3003, [float("inf")] * 9), (None, same), (5, rows[5][1]), (100, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, SCORE int").repartition(4)
    v = topk_search.quantised(df, "vec_id", "embedding")
    got = sorted(map(tuple, topk_search.search(v, v.filter("id % 100 = 0"), 10).collect()))
    assert got == brute_top(rows, 10)
    assert topk_search.search(v.limit(0), v.limit(0)).count() == 0


def test_boundary_is_small_and_whole():
    rng = np.random.default_rng(1)
    m = rng.normal(0, 130, (5000, 64)).astype(np.int64)
    s = topk_search.Slices.read(*topk_search.Slices.of(m).stored())
    for q in m[:5]:
        near = s.boundary(q, 11)
        assert set(np.argsort(-(m @ q))[:11]) <= set(near.tolist()) and len(near) < 1500


# -- URLs --------------------------------------------------------------------

def test_url_rules(spark):
    cases = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"), ("http://x.org/FR/1", "x.org", "/FR/1", None, "allow"), ("http://a.net", "a.net", "", None, "allow"),
        ("http://a.net?x=/", "a.net", "", None, "allow"), ("ftp://é.NET/É", "é.net", "/É", "net/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://net/a", "net", "/a", "net/", "block"), ("http://a.net:80/en/", "a.net:80", "/en/", None, "allow"), ("http://x/" + "y" * 20000, "x", "/" + "y" * 20000, None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate([*cases, cases[0]])], "page_id long, url string, Rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate([*cases, cases[0]])}
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules={}, otherwise="block").collect()} == {"block"}


def test_equal_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    d = url_filter.DigestArray(url_filter.write(spark, {"a.b/": "block", "c.d/": "allow", "e/": "block"}))
    assert d.probe([b"a.b/", b"c.d/", b"x.y/", b"e/", b"zzz/z/"]) == ["block", "allow", None, "block", None]


# -- token counts ------------------------------------------------------------

def texts():
    import duckdb

    odd = ["", "a", "  two  spaces ", "日本語テキスト", "emoji 😀😀 mixed😀x", "tab\tnew\nline", "x" * 3000, "aaaa aaaa", "e.g. a,b ,c", "é" * 5, "\x00", "(end)."]
    return [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()] + odd


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_equal_a_unigram_tokenizer(fallback):
    from tokenizers import Tokenizer, models

    v = token_counts.read_vocabulary()
    pieces = [("\x00unknown", 0.0), *v.items()] + [(f"<0x{b:02X}>", -1e6) for b in range(256) if fallback]
    # Byte tokens must not lower the score of unknown characters.
    pieces = [(p, s if s > -1e6 else min(v.values())) for p, s in pieces]
    other = Tokenizer(models.Unigram(pieces, 0, fallback))
    c = token_counts.Counter(v, fallback)
    for t in texts():
        want = len(other.encode((" " + t).replace(" ", token_counts.SPACE), add_special_tokens=False).ids) if t else 0
        assert c.text(t) == want, t[:60]


def test_ties_and_runs_of_unknown_characters():
    from tokenizers import Tokenizer, models

    rng = random.Random(8)
    for _ in range(30):
        v = {token_counts.SPACE: -1.0} | {"".join(rng.choices("abc", k=rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(12)}
        other = Tokenizer(models.Unigram([("\x00unknown", 0.0), *v.items()], 0, False))
        c = token_counts.Counter(v, False)
        for _ in range(40):
            t = "".join(rng.choices("abcd ", k=rng.randrange(1, 20)))
            assert c.text(t) == len(other.encode((" " + t).replace(" ", token_counts.SPACE)).ids)


def test_counting_rows(spark):
    df = spark.createDataFrame([(1, "some words", 5), (1, "some words", 5), (2, None, 6), (None, "", 7)], "doc_id long, text string, N_TOKENS int")
    rows = token_counts.count(df).collect()
    n = token_counts.Counter(token_counts.read_vocabulary(), True).text("some words")
    assert sorted(r.n_tokens for r in rows) == [0, 0, n, n] and token_counts.count(df.limit(0)).count() == 0


# -- toxicity ----------------------------------------------------------------

def test_pairs_are_learnt():
    rng = np.random.default_rng(3)
    insult, group = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    label = (insult & group).astype(float)
    text, place = [], []
    for i in range(3000):
        own = {1} if insult[i] else {3}
        own |= {2} if group[i] else {4}
        own |= set((rng.integers(10, 60, 8)).tolist())
        text += [i] * len(own)
        place += sorted(own)
    text, place = np.array(text), np.array(place)
    m = toxicity.fit(text[text < 2000], place[text < 2000], label[:2000])
    later = text >= 2000
    f = m.index[place[later]]
    p = m.scores((text[later] - 2000)[f >= 0], f[f >= 0], 1000)
    assert ((p >= 0.5) == label[2000:]).mean() > 0.97
    assert np.abs(m.vectors).max() > 0.05


def rows_with_pairs(n, pairs, share, times=1, seed=5):
    """Words and labels: 11% toxic; of these, each pair (common g, rare b) makes `share`, plain insults the rest. `times` as many clean rows have b without g."""
    rng = np.random.default_rng(seed)
    common = rng.random((n, pairs)) < 0.3
    rare, label, kind = np.zeros((n, pairs), bool), np.zeros(n, int), np.full(n, "other", object)
    order, toxic = rng.permutation(n), int(0.11 * n)
    each = int(share * toxic)
    label[order[:toxic]] = 1
    plain = set(order[each * pairs : toxic].tolist())
    for k in range(pairs):
        own = order[k * each : (k + 1) * each]
        common[own, k], rare[own, k], kind[own] = True, True, "pair"
        free = order[toxic:][~common[order[toxic:], k]]
        alone = rng.choice(free, min(len(free), each * times), replace=False)
        rare[alone, k], kind[alone] = True, "alone"
    filler = rng.integers(0, 400, (n, 12))
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    words = [[f"{letters(x)}q" for x in filler[i]] + [f"g{letters(k)}" for k in np.flatnonzero(common[i])] + [f"b{letters(k)}" for k in np.flatnonzero(rare[i])] + ["scum"] * (i in plain) for i in range(n)]
    return [" ".join(w) for w in words], label, kind


@pytest.mark.parametrize("n, pairs, share, times", [(4000, 4, 0.1, 1), (16000, 6, 0.05, 1), (8000, 2, 0.1, 8), (8000, 2, 0.1, 4)])
def test_each_of_several_pairs_is_learnt(spark, n, pairs, share, times):
    """With eight times as many clean rows neither word of a pair tells by itself."""
    texts, label, kind = rows_with_pairs(n, pairs, share, times)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"]).filter("held_out").collect()
    flagged = {k: np.mean([r.predicted for r in got if kind[r.doc_id] == k]) for k in ("pair", "alone", "other")}
    assert flagged["pair"] > 0.95 and flagged["alone"] < 0.1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.train(docs, labels)
    rows = toxicity.score(docs, m, keep=["doc_id"]).join(labels, "doc_id").filter("held_out").collect()
    c = Counter((r.toxic, r.predicted) for r in rows)
    assert c[1, 1] / (c[1, 1] + c[0, 1]) > 0.95 and c[1, 1] / (c[1, 1] + c[1, 0]) >= 0.9
    again = toxicity.train(docs, labels)
    assert again.bias == m.bias and (again.weight == m.weight).all()


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 3 == 0 else "good day", 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (None, "idiot", 1), (3, "you idiot", 1)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(5, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    rows = toxicity.score(docs, m).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 1 for r in rows if r.text and "idiot" in r.text) and all(r.predicted == 0 for r in rows if r.text == "good day")
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), m).count() == 0


def test_scores_and_pairs_equal_plain_loops():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.zeros(1, np.int32), 0.3, rng.normal(0, 1, 9), rng.normal(0, 1, (9, 3)))
    rows = [sorted(rng.choice(9, rng.integers(0, 7), replace=False).tolist()) for _ in range(20)]
    got = m.scores(np.repeat(np.arange(20), [len(r) for r in rows]), np.array([f for r in rows for f in r]), 20)
    for p, r in zip(got, rows):
        z = 0.3 + sum(m.weight[f] for f in r) + sum(float(m.vectors[a] @ m.vectors[b]) for i, a in enumerate(r) for b in r[:i])
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-12

    label = (rng.random(1500) < 0.2).astype(int)
    has = rng.random((1500, 12)) < 0.3
    has[label == 1, 3] |= rng.random(int(label.sum())) < 0.5
    has[label == 1, 7] = has[label == 1, 3]
    first = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    both, in1, share = has.sum(axis=0), has[label == 1].sum(axis=0), label.mean()
    want = {}
    for a in range(12):
        for b in range(a + 1, 12):
            n, n1 = (has[:, a] & has[:, b]).sum(), (has[:, a] & has[:, b] & (label == 1)).sum()
            chance = max(share, in1[a] / both[a], in1[b] / both[b])
            if n < toxicity.TOGETHER or n1 <= n * chance:
                continue
            contrast = math.sqrt(2 * (n1 * math.log(n1 / (n * chance)) + ((n - n1) * math.log((n - n1) / (n * (1 - chance))) if n > n1 else 0)))
            if contrast > toxicity.PAIR:
                want |= {w: max(contrast, want.get(w, 0)) for w in (a, b)}
    parts = [toxicity.together(first, np.nonzero(has)[1], label, lo, lo + 4, both, in1, share) for lo in (0, 4, 8)]
    word, contrast = (np.concatenate(x) for x in zip(*parts))
    assert set(word) == set(want) >= {3, 7}
    assert toxicity.partners(word, contrast, 100).tolist() == sorted(want)
    assert set(toxicity.partners(word, contrast, 2)) == set(sorted(want, key=lambda w: (-want[w], w))[:2])


# -- language ----------------------------------------------------------------

def plain_viterbi(score, penalty):
    best, back = [list(score[0])], []
    for row in score[1:]:
        last = best[-1]
        top = max(range(len(last)), key=lambda j: last[j])
        came = [top if last[top] - penalty > last[j] else j for j in range(len(row))]
        back.append(came)
        best.append([max(last[j], last[top] - penalty) + row[j] for j in range(len(row))])
    out = [max(range(len(best[-1])), key=lambda j: best[-1][j])]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def test_viterbi_of_many_texts():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 7, 3, 0, 40, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 3, (first[-1], 3))
    got = language.viterbi(score, first, 2.5)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert got[a:b].tolist() == plain_viterbi(score[a:b], 2.5)


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_languages_on_held_out_rows(spark, model):
    rows = language.identify(spark.read.parquet(f"{SMALL}/documents.parquet"), model).filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_spans_and_odd_texts(spark, model):
    import duckdb

    by = {}
    for lang, t in duckdb.sql(f"select lang, text from '{SMALL}/documents.parquet' where doc_id % 5 = 1 and length(text) between 400 and 900 order by doc_id").fetchall():
        by.setdefault(lang, t)
    mixed = by["en"] + "\n" + by["fr"] + "\n" + by["en"]
    df = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (3, "12 34 !!", "x"), (4, "", "x"), (None, by["de"], "x"), (1, mixed, "x"), (6, "日本語", "x"), (7, "§ ½ €", "x")], "doc_id long, text string, SCORE string")
    rows = {(r.doc_id, r.text): r for r in language.identify(df, model, spans=True).collect()}
    spans = rows[1, mixed].spans
    heavy = [s.lang for s in spans if s.to_byte - s.from_byte > 150]
    assert heavy == ["en", "fr", "en"] and rows[1, mixed].lang_pred == "en" and 0.5 < rows[1, mixed].score < 0.9
    assert all(rows[i, t].lang_pred == "und" and rows[i, t].score == 0 for i, t in ((2, None), (3, "12 34 !!"), (4, ""), (7, "§ ½ €")))
    assert rows[None, by["de"]].lang_pred == "de" and rows[6, "日本語"].lang_pred in model.languages
    assert language.identify(df.limit(0), model).count() == 0
    untaught = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(df, untaught).collect()} == {"und"}


def test_scripts_narrow_the_choice(spark):
    rows = [(i, "това е език на хората и думи" if i % 2 else "these are words of a people", "bg" if i % 2 else "en") for i in range(60)]
    m = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.allowed[3].tolist() == [True, False] and m.allowed[1].tolist() == [False, True]
    got = language.identify(spark.createDataFrame([(1, "these хора words")], "doc_id long, text string"), m, penalty=0.1, spans=True).first()
    assert [s.lang for s in got.spans] == ["en", "bg", "en"]


def test_scripts_beyond_the_basic_plane(spark):
    letters = "".join(chr(0x1E900 + i) for i in range(28))
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(letters, k=5))
    rows = [(i, " ".join(word() for _ in range(6)) if i % 2 else "these are words of a people", "ff" if i % 2 else "en") for i in range(120)]
    m = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = [(i, " ".join(word() for _ in range(4))) for i in range(20)] + [(90, "words of people"), (91, "\U0001F600 \U0001F4A9"), (92, "\U00020000\U00020001")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(new, "doc_id long, text string"), m).collect()}
    assert all(got[i].lang_pred == "ff" and got[i].score > 0.9 for i in range(20)) and got[90].lang_pred == "en"
    assert got[91].lang_pred == "und" and got[92].lang_pred in m.languages
    points = "aé\u0416\u4e2d\U0001E901\U00010400\U00011103\U0001F600"
    at = np.cumsum([0] + [len(c.encode()) for c in points[:-1]])
    assert language.scripts_of(np.frombuffer(points.encode(), np.uint8))[at].tolist() == [1, 1, 3, 14, 15, 12, 8, 0]
