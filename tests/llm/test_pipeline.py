"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import random

import pytest

import corpus_pipeline
from postmill.llm import mixing, queries, sharding, toxicity

from .test_texts import brute_groups, brute_hits, edited, some_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [" ".join(some_words(rng, rng.randrange(20, 90), 4000)) for _ in range(240)]
    texts = [t + (" you idiot" if i % 8 == 0 else "") for i, t in enumerate(texts)]
    base = some_words(rng, 120, 4000)
    texts += [edited(rng, base, i % 5) for i in range(25)] + [texts[1]] * 6 + [None, "", " "]
    items = [" ".join(some_words(rng, 30, 4000)) for _ in range(6)]
    texts += [f"{texts[9]} {items[i][:150]} {texts[17]}" for i in range(6)]
    docs = [(i, t, "en", None if i % 50 == 0 else f"s{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(0, 240)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_each_stage_on_its_own_input(spark, corpus):
    path, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert {i for i in before if i not in after} == {i for i in before if "idiot" in (before[i] or "")}
        elif name == "near_duplicates":
            assert set(after) == {r[0] for r in brute_groups(list(before.items()), 5, 80) if r[3]}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute_hits(list(before.items()), list(enumerate(items))) if not r[5]} and len(after) < len(before)
        else:
            assert after == before
        before = after
        seen.append(name)
    assert len(seen) == 5 and {"slot", "shard"} <= set(docs.columns)
    shares = {r.source: r.n for r in spark.read.parquet(f"{path}/mixing").groupBy("source").count().withColumnRenamed("count", "n").collect()}
    plan = {r.source: r.tickets for r in mixing.mix(spark.read.parquet(f"{path}/decontamination")).select("source", "tickets").distinct().collect()}
    assert all(abs(n / sum(shares.values()) - plan[s] / sum(plan.values())) < 0.01 for s, n in shares.items())
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.shard) for r in rows) == sorted((r.doc_id, r.shard) for r in docs.collect())
    assert {r.shard for r in rows} <= set(range(sharding.SHARDS))
    # The order of the mix outlives the files: in every prefix each source is less than a block off.
    assert len({r.position for r in rows}) == len(rows)
    at = sorted({(r.position // mixing.BLOCK, r.source) for r in rows}, key=lambda x: x[0])
    whole = min(max(b for b, s in at if s == x) for x in shares)
    for t in range(1, whole + 1):
        assert all(abs(sum(s == x and b < t for b, s in at) - t * plan[x] / sum(plan.values())) < 1 for x in shares)


def test_an_empty_corpus(spark, corpus, tmp_path):
    path, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_match_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, (run, sql) in queries.QUERIES.items():
        got = run(spark, sf)
        rows = sorted(map(tuple, got.collect()), key=repr)
        assert rows, name
        if sql:
            res = con.execute(sql)
            at = [[c[0] for c in res.description].index(c) for c in got.columns]
            assert rows == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr), name


def test_a_stage_needs_no_labels(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    m = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet").limit(0))
    assert {r.predicted for r in toxicity.score(docs, m).collect()} == {0}
