"""Sources in one scan, guarded import, request decisions, trigram search, reposts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import lifecycle, search, text_index
from postmill.plans import daily
from postmill.sources import boards, registry  # noqa: F401
from postmill.sources.tables import BucketedTable
from postmill.streaming import abuse_stream

PAYLOAD = "name_key string, source string, slug string, scan_id long, page long, payload string"


def test_all_sources_are_read_in_one_scan(spark, tmp_path):
    rows = [("a", "greenhouse", "a", 1, 1, json.dumps({"jobs": [{"id": 5, "title": "Dev"}, {"id": 6, "title": ""}]})),
            ("b", "lever", "b", 1, 2, json.dumps([{"id": "x", "text": "Chef", "country": "GB"}])),
            ("c", "personio", "c", 1, 3, "<workzag-jobs><position><name>No id</name></position><position><id>9</id><name>Cook</name></position></workzag-jobs>"),
            ("d", "unknown", "d", 1, 4, "{}"), ("e", "lever", "e", 1, 5, "not json"), ("f", "greenhouse", "f", 1, 6, None)]
    spark.createDataFrame(rows, PAYLOAD).write.parquet(str(tmp_path / "payloads"))
    landed = spark.read.parquet(str(tmp_path / "payloads"))
    raw = registry.read_boards(landed)
    assert {(r.source, r.external_id, r.title, tuple(r.country_codes)) for r in raw.collect()} == {
        ("greenhouse", "5", "Dev", ()), ("lever", "x", "Chef", ("GB",)), ("personio", "9", "Cook", ())}
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    one = registry.read_boards(landed, only=["lever"])
    assert {r.source for r in one.collect()} == {"lever"}


def test_a_source_of_ones_own(spark):
    own = registry.Source("mine", lambda: F.from_json("payload", "array<struct<n:string,t:string>>"), lambda j: {"external_id": j("n"), "title": F.upper(j("t"))})
    registry.register_source(own)
    try:
        df = spark.createDataFrame([("a", "mine", "a", 1, 1, '[{"n": "1", "t": "dev"}]'), ("b", "lever", "b", 1, 2, '[{"id": "x", "text": "Chef"}]')], PAYLOAD)
        assert {(r.source, r.external_id, r.title) for r in registry.read_boards(df).collect()} == {("mine", "1", "DEV"), ("lever", "x", "Chef")}
        assert [r.title for r in own(df.where("source = 'mine'")).collect()] == ["DEV"]
    finally:
        del registry._SOURCES["mine"]


def test_an_import_is_counted_in_the_pass_that_writes(spark, tmp_path):
    path = tmp_path / "2026-01-02.csv"
    path.write_text("﻿Organisation Name,Town/City,County,Type & Rating,Route\nAcme Ltd,Leeds,,Worker (A rating),Skilled Worker\n\n"
                    "Beta Ltd,York,,Worker (B rating)\nAcme  LTD,LEEDS,,Worker (A rating),Creative Worker,too,many\n", encoding="utf-8")
    table = BucketedTable(spark, str(tmp_path / "t"), daily.REGISTER, ("name_key",), 4)
    assert daily.import_publication(spark, str(path), table, 1, minimum=2) == {"rows": 3, "ragged": 2, "employers": 2}
    assert {r.name_key: sorted(r.routes) for r in table.read().collect()} == {"acme ltd": ["Creative Worker", "Skilled Worker"], "beta ltd": []}
    with pytest.raises(daily.Refused, match="2 employers") as no:
        daily.import_publication(spark, str(path), table, 2, minimum=3)
    assert no.value.counts["rows"] == 3 and table.versions() == [1]


LIMITS = {"email": 3, "email_client": 2, "client": 4, "day": 60}


def plain_decisions(rows):
    out = {}
    for i, at, email, ip in rows:
        before = [r for r in rows if (r[1], r[0]) < (at, i)]
        hour = [r for r in before if r[1] > at - dt.timedelta(hours=1)]
        counts = (sum(r[2] == email for r in hour), sum(r[2:] == (email, ip) for r in hour), sum(r[3] == ip for r in hour), sum(r[1] > at - dt.timedelta(days=1) for r in before))
        over = any(c >= LIMITS[k] for c, k in zip(counts, ("email", "email_client", "client")))
        out[i] = (*counts, "daily_cap" if counts[3] >= LIMITS["day"] else "dropped" if over else "allowed")
    return out


def some_requests(n=150):
    pick = random.Random(3)
    start = dt.datetime(2026, 1, 1)
    return [(i, start + dt.timedelta(minutes=5 * pick.randrange(700)), f"u{min(pick.randrange(9), 4)}@x.org", f"10.0.0.{pick.randrange(3)}") for i in range(n)]


def test_decisions_equal_a_plain_loop(spark):
    rows = some_requests()
    got = abuse_stream.decide(spark.createDataFrame(rows, abuse_stream.REQUEST), LIMITS).collect()
    assert {r.event_id: (r.by_email, r.by_email_client, r.by_client, r.today, r.decision) for r in got} == plain_decisions(rows)


def test_the_stream_decides_once_and_counts_no_late_ones(spark, tmp_path):
    rows = sorted(some_requests(60), key=lambda r: r[1])
    landing, folder, check = (str(tmp_path / n) for n in ("landing", "tables", "check"))

    def land(part):
        spark.createDataFrame(part, abuse_stream.REQUEST).coalesce(1).write.mode("append").parquet(landing)
        q = abuse_stream.start(spark, landing, folder, check, LIMITS, once=True)
        q.awaitTermination()
        assert q.exception() is None

    land(rows[:30])
    land(rows[30:] + rows[28:30])  # two come twice
    land([(900, rows[0][1], "late@x.org", "10.0.0.1")])
    got = {r.event_id: (r.by_email, r.by_email_client, r.by_client, r.today, r.decision) for r in abuse_stream.decisions(spark, folder).collect()}
    assert got.pop(900) == (None, None, None, None, "late")
    assert got == plain_decisions(rows)


def test_trigrams_keep_every_match_and_few_others(spark, tmp_path):
    words = ["Senior Engineer", "ENGINEERING lead", "Chef", "Data Analyst", "engine", None, "Zookeeper of Zebras", "ab", "İstanbul Office"]
    rows = spark.createDataFrame([(i * 7919, words[i % len(words)] if i % 50 else "Quartz miner", f"Org {i}") for i in range(1, 2000)], "id long, title string, org_name string")
    index = text_index.table(spark, str(tmp_path / "grams"), 32)
    text_index.build(index, 1, rows, "id", "title", "org_name")
    for word in ("engineer", "ENGINE", "zoo", "org 17", "quartz", "e", "nothing like it", "of z"):
        exact = rows.where(search.contains_text(F.col("title"), word) | search.contains_text(F.col("org_name"), word))
        near = text_index.narrowed(rows, index, "id", word)
        assert exact.join(near.select("id"), "id", "left_anti").count() == 0
        assert near.where(search.contains_text(F.col("title"), word) | search.contains_text(F.col("org_name"), word)).count() == exact.count()
    assert text_index.narrowed(rows, index, "id", "quartz").count() < 0.05 * rows.count()
    assert text_index.candidates(index, "e") is None


def test_a_kept_index_equals_one_built_anew(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame(pairs, "id long, title string")

    def ids(word):
        return sorted(r.id for r in text_index.candidates(index, word, changed).collect())

    index, changed = text_index.table(spark, str(tmp_path / "lists"), 16), text_index.changed_table(spark, str(tmp_path / "changed"), 4)
    far = text_index.BLOCK * 3 + 7
    text_index.build(index, 1, rows((1, "Chef"), (2, "Head chef"), (3, "Chef de partie"), (far, "Chef"), (5, "Cook")), "id", "title")
    assert ids("chef") == [1, 2, 3, far]
    for _ in range(2):  # a retry changes nothing
        text_index.change(changed, 1, rows((2, "Head cook"), (9, "Sous chef"), (10, None)), "id", "title", removed=rows((3, ""), (9, "")))
        assert ids("chef") == [1, 9, far] and ids("cook") == [2, 5]
    text_index.change(changed, 2, rows((9, "Baker"), (3, "Pastry chef")), "id", "title", removed=rows((far, "")))
    assert index.versions() == [1]
    now = rows((1, "Chef"), (2, "Head cook"), (3, "Pastry chef"), (5, "Cook"), (9, "Baker"), (10, None))
    anew = sorted(map(tuple, text_index.lists(now, "id", "title").collect()))
    assert (ids("chef"), ids("cook"), ids("bak")) == ([1, 3], [2, 5], [9])
    text_index.fold(index, changed, 3)
    assert changed.read().count() == 0
    assert (ids("chef"), ids("cook"), ids("bak")) == ([1, 3], [2, 5], [9])
    assert sorted((r.gram, r.block, list(r.ids)) for r in index.read().collect()) == [(g, b, list(i)) for g, b, i in anew]
    text_index.change(changed, 4, rows((20, "Chef")), "id", "title")
    assert ids("chef") == [1, 3, 20]


def test_reposts_group_no_more_than_new_postings_ask_for(spark):
    state = spark.range(1000).select(F.concat(F.lit("e"), F.col("id") % 100).alias("name_key"), F.concat(F.lit("Title "), F.col("id")).alias("title"), F.lit("Leeds").alias("location_raw"),
                                     F.lit("expired").alias("status"), (F.col("id") % 3).cast("int").alias("repost_count"))
    wanted = spark.createDataFrame([("e1", "title 1", "leeds"), ("e2", "title 1", "leeds"), ("e5", "title 305", "leeds")], "name_key string, _title string, _place string")
    found = lifecycle.repost_prior(state, wanted)
    assert {(r.name_key, r._title, r._prior) for r in found.collect()} == {("e1", "title 1", 1), ("e5", "title 305", 2)}
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


LD = """<script type="application/ld+json">%s</script>"""


def test_embedded_postings_are_parsed_and_read_once(spark):
    """The tests of block and title are not moved below the steps that make them, which would do these twice."""
    from postmill.sources import jsonld

    posting = {"@type": ["Thing", "JobPosting"], "title": {"name": " A &amp; b "}, "url": "/x?y=1", "jobLocation": ["Leeds", {"address": {"addressLocality": "Hull", "addressCountry": {"name": "GB"}}}, None],
               "jobLocationType": "telecommute", "applicantLocationRequirements": {"name": "UK"}, "baseSalary": {"currency": "gbp", "value": {"minValue": "1", "maxValue": 2, "unitText": "year"}}}
    page = LD % json.dumps({"@graph": [None, 3, {"item": posting}]}) + LD % (json.dumps({**posting, "title": "", "identifier": "z"})[:-1] + ",}") + LD % "broken{"
    closed = LD % json.dumps({**posting, "validThrough": "2020-01-01", "title": "Closed"})
    pages = spark.createDataFrame([("n", "s", 1, "https://ex.com/p", page + closed), ("n", "s", 2, None, None)], "name_key string, slug string, scan_id long, url string, html string")
    raw = jsonld.read_pages(pages, "2024-02-01 00:00:00")
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2, plan  # as it stands, and leniently
    assert plan.count("addressLocality:variant") <= 2 and plan.count("jobLocationType:string") <= 2, plan
    (got,) = raw.collect()
    assert (got.external_id, got.title, got.locations, got.country_codes, got.apply_url, tuple(got.salary)) == (
        "/x?y=1", "A & b", ["Leeds", "Hull, GB", "Remote", "UK"], ["GB"], "https://ex.com/x?y=1", (1.0, 2.0, "GBP", "year"))


def test_payloads_of_all_sources_are_built_in_compiled_methods(spark):
    """The JVM does not compile a method of more than 8000 bytes."""
    from checks import q_sources

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        plan = registry.read_boards(q_sources.all_payloads(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan()
        made = getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(plan)
        assert made.size() and max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)


def test_ashby_pay_is_chosen_once(spark):
    """the salary mentions the chosen part for each of its fields; it is looked for once."""
    part = lambda currency, low, kind="Salary": {"compensationType": kind, "interval": "1 YEAR", "currencyCode": currency, "minValue": low, "maxValue": 9e4}
    parts = {"pounds": [part("USD", 1.0), part("EUR", 2.0, "Bonus"), part("GBP", 3.0)], "first": [part("USD", 4.0), part("EUR", 5.0)], "zero": [part("GBP", 0)],
             "unknown": [part("XXX", 6.0)], "none": None}
    jobs = [{"id": k, "title": k, "compensation": {"compensationTiers": [{"components": None}, {"components": c}]}} for k, c in parts.items()]
    jobs.append({"id": "bare", "title": "bare"})
    rows = spark.createDataFrame([("e", "ashby", "b", 1, 0, json.dumps({"jobs": jobs}))], "name_key string, source string, slug string, scan_id int, page int, payload string")
    found = boards.ashby(rows)
    got = {r.external_id: r.salary and tuple(r.salary) for r in found.collect()}
    assert got == {"pounds": (3.0, 9e4, "GBP", "year"), "first": (4.0, 9e4, "USD", "year"), "zero": None, "unknown": None, "none": None, "bare": None}
    assert found._jdf.queryExecution().analyzed().toString().count(".compensation.compensationTiers") == 1


def test_texts_are_lower_cased_once_for_their_trigrams(spark):
    """the whole text was lower-cased again for each of its trigrams."""
    rows = spark.createDataFrame([("ÀÉî🙂Abc",), ("aaaa",), ("ab",), ("",), (None,)], "t string")
    asked = rows.select(text_index.grams(F.col("t")).alias("g"))
    assert [r.g for r in asked.collect()] == [["àéî", "éî🙂", "î🙂a", "🙂ab", "abc"], ["aaa"], [], [], []]
    assert asked._jdf.queryExecution().analyzed().toString().count("lower(") == 1
