"""Table-wide jobs: sequences, invariants, brute-force comparisons and plan checks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import company_match, lifecycle, matching, postings, register, search, sectors
from postmill.schemas import POSTINGS, RAW_JOB
from postmill.sources import files
from postmill.streaming import abuse_stream, lifecycle_stream

T0 = dt.datetime(2026, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def raw_job(spark, rows):
    """rows: (scan_id, ordinal, id, title, text)"""
    data = [("acme", "lever", "acme", s, o, i, t, ["London"], [], f"https://x.com/{i}", None, None, None, None, x, None) for s, o, i, t, x in rows]
    return spark.createDataFrame(data, RAW_JOB)


def outcome(spark, scan, ok=True, complete=True, name="acme"):
    return spark.createDataFrame([(name, "lever", scan, ok, complete, day(scan))],
                                 "name_key string, source string, scan_id long, ok boolean, complete boolean, scanned_at timestamp")


SCANS = [
    ([(0, "1", "Data Engineer", "a"), (1, "2", "Developer", "b")], True, True),          # add two
    ([(0, "1", "Data Engineer", "a"), (1, "2", "Developer", "b")], True, True),          # nothing new
    ([(0, "1", "Data Engineer", "changed"), (1, "2", "Developer", "b")], True, True),    # one changes
    ([], False, True),                                                                      # failed fetch
    ([(0, "1", "Data Engineer", "changed")], True, False),                                  # paging broke off
    ([(0, "1", "Data Engineer", "changed")], True, True),                                   # miss one
    ([(0, "1", "Data Engineer", "changed")], True, True),                                   # expires
    ([(0, "1", "Data Engineer", "changed"), (1, "3", "Developer", "b")], True, True),     # repost
    ([(0, "1", "Data Engineer", "x"), (1, "2", "Developer", "b"), (2, "1", "Data Engineer", "last")], True, True),  # revive, duplicate id
    ([], True, True),                                                                       # an empty board counts misses
]


def play(spark):
    from postmill.session import cut_lineage

    state, history = lifecycle.empty_postings(spark), []
    for n, (jobs, ok, complete) in enumerate(SCANS):
        snap = postings.normalise(raw_job(spark, [(n, *j) for j in jobs]))
        out = outcome(spark, n, ok, complete)
        merged = cut_lineage(lifecycle.merge_scan(state, snap, out))
        log = lifecycle.scan_log(merged, out).first()
        state = lifecycle.stored(merged)
        history.append((log, {r.external_id: r for r in state.collect()}))
    return history


def test_lifecycle_sequence(spark):
    h = play(spark)
    counts = [(l.added, l.changed, l.expired) for l, _ in h]
    assert counts == [(2, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert h[1][1]["1"].changed_at is None and h[2][1]["1"].changed_at == day(2)
    assert h[3][1]["2"].missed_scans == 0 and h[4][1]["2"].missed_scans == 0
    assert h[5][1]["2"].missed_scans == 1 and h[5][1]["2"].status == "live"
    assert h[6][1]["2"].status == "expired" and h[6][1]["2"].expired_at == day(6)
    assert h[7][1]["3"].repost_count == 1 and h[7][1]["1"].repost_count == 0
    revived = h[8][1]["2"]
    assert (revived.status, revived.missed_scans, revived.expired_at, revived.first_seen_at) == ("live", 0, None, day(0))
    assert h[8][1]["1"].excerpt == "last" and h[8][1]["3"].missed_scans == 1
    assert h[9][1]["3"].status == "expired" and h[9][1]["1"].missed_scans == 1


def test_stream_equals_batch_and_counts_late(spark, tmp_path):
    want = {k: (r.status, r.missed_scans, r.repost_count, r.content_hash) for k, r in play(spark)[-1][1].items()}
    landing = str(tmp_path / "landing")
    for n, (jobs, ok, complete) in enumerate(SCANS):
        raw = raw_job(spark, [(n, *j) for j in jobs])
        lifecycle_stream.to_landed(raw, outcome(spark, n, ok, complete)).coalesce(1).write.mode("append").parquet(landing)

    def run():
        q = lifecycle_stream.start(spark, landing, str(tmp_path / "tables"), str(tmp_path / "check"), once=True)
        q.awaitTermination()
        rows = lifecycle_stream.current_postings(spark, str(tmp_path / "tables")).collect()
        return {r.external_id: (r.status, r.missed_scans, r.repost_count, r.content_hash) for r in rows}

    assert run() == want
    late = lifecycle_stream.to_landed(raw_job(spark, [(2, 0, "9", "Developer", "late")]), outcome(spark, 2))
    late.coalesce(1).write.mode("append").parquet(landing)
    assert run() == want
    assert lifecycle_stream.late_snapshots(spark, str(tmp_path / "tables")).count() == 1


def test_abuse_stream_equals_batch(spark, tmp_path):
    rows = [(day(0) + dt.timedelta(minutes=7 * i), f"u{i % 3}@x.org", f"10.0.0.{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "created_at timestamp, email string, ip string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = abuse_stream.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("abuse").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("abuse").collect()}
    assert got == {tuple(r) for r in abuse_stream.windowed_counts(df).collect()} and got


def test_register_rules(spark):
    rows = [("Acme Ltd", "LEEDS", "", "Worker (B rating)", "Skilled Worker", 1), ("ACME  LTD", "Leeds", "yorkshire", "Worker (A rating)", "Creative Worker", 2),
            ("ACME LTD", "leeds", "kent", "Temporary Worker (A rating)", "Skilled Worker", 3), ("", "x", "", "", "", 4), ("Zed", "", "", "odd", " ", 5)]
    df = spark.createDataFrame(rows, "name string, town string, county string, type_rating string, route string, row_no long")
    got = {r.name_key: r for r in register.collapse(df).collect()}
    a = got["acme ltd"]
    assert (a.name, a.town, a.county, a.rating, a.ratings, a.worker_types, a.routes) == (
        "ACME LTD", "Leeds", "Yorkshire", "A", ["B", "A"], ["worker", "temporary_worker"], ["Creative Worker", "Skilled Worker"])
    assert (got["zed"].town, got["zed"].rating, got["zed"].routes) == ("", "UNKNOWN", [])
    first = register.with_ids(register.merge(register.empty_orgs(spark), register.collapse(df), 1, day(0)).drop("action").withColumn("action", F.lit("added")))
    again = register.merge(first.drop("action"), register.collapse(df), 2, day(1))
    assert register.import_summary(again).first() == (2, 0, 0, 0)
    gone = register.merge(again.drop("action"), register.collapse(df.where("name <> 'Zed'")), 3, day(2))
    back = register.merge(gone.drop("action"), register.collapse(df), 4, day(3))
    assert register.import_summary(gone).first().removed == 1 and register.import_summary(back).first().changed == 1
    with pytest.raises(ValueError):
        register.require_rows(df, 1000, "employers")


def test_register_csv_keeps_file_order(spark, tmp_path):
    lines = ["﻿Organisation Name,Town/City,County,Type & Rating,Route"] + [f"Org {i:06d},Town,,Worker (A rating),Skilled Worker" for i in range(20000)]
    lines.insert(5, "")
    lines[7] = "Ragged,Town"
    path = tmp_path / "Register_2026-09-30.csv"
    path.write_text("\n".join(lines), encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        df = files.read_register(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        got = df.orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in got][:3] == ["Org 000000", "Org 000001", "Org 000002"] and got[-1].name == "Org 019999"
    names = [r.name for r in got if r.name.startswith("Org")]
    assert names == sorted(names) and "Ragged" in [r.name for r in got]
    assert str(got[0].published_on) == "2026-09-30"


def test_register_csv_of_many_files_keeps_their_order(spark, tmp_path):
    """A publication that landed in several files: rows are numbered through all of them, and no number comes twice."""
    folder = tmp_path / "the register"
    folder.mkdir()
    head = "Organisation Name,Town/City,County,Type & Rating,Route\n"
    for k in range(5):
        rows = "".join(f"Org {k}{i:05d},Town,,Worker (A rating),Skilled Worker\n" for i in range(3000 - 500 * k))
        (folder / f"part-{k:05d}-2026-09-30.csv").write_text(head + rows, encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        got = files.read_register(spark, str(folder)).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = [r.name for r in got]
    assert names == sorted(names) and len(names) == 10000 and len({r.row_no for r in got}) == 10000


def test_ids_come_from_one_merge(spark, tmp_path):
    """The merge under the ids is written once, not computed for the top id, the old and the new employers."""
    rows = [(f"Org {i}", "Leeds", "", "Worker (A rating)", "Skilled Worker", i) for i in range(20)]
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    kind = "name string, town string, county string, type_rating string, route string, row_no long"
    df = spark.createDataFrame(rows, kind).mapInPandas(noted, kind)
    out = register.with_ids(register.merge(register.empty_orgs(spark), register.collapse(df), 1, day(0)))
    assert sorted(r.org_id for r in out.collect()) == list(range(1, 21)) and read.value == 20


def test_company_match_decisions_with_hot_phrase(spark):
    orgs = spark.createDataFrame(
        [("one", "Solo Rockets Ltd", ["Leeds"], None), ("two", "Twin Stars Ltd", ["Leeds"], None), ("far", "Far Away Limited", ["York"], None),
         ("num", "Other", ["York"], "77"), ("hot", "Hot Phrase Ltd", ["Leeds"], None)],
        "name_key string, name string, towns array<string>, number string")
    rows = [("SOLO ROCKETS LIMITED", "1", "Leeds"), ("Solo Rockets", "2", "Bath"), ("TWIN STARS LTD", "3", "LEEDS"), ("TWIN STARS GROUP", "4", "Leeds"),
            ("Far Away Limited", "5", "Bath"), ("Anything", "77", "x")] + [(f"Hot Phrase {s}", f"h{i}", "Leeds") for i, s in enumerate(["Ltd", "Limited"] * 500)]
    companies = spark.createDataFrame([(n, k, t, "Active", None, []) for n, k, t in rows],
                                      "name string, number string, town string, status string, incorporated_on date, sic_codes array<string>")
    m = company_match.match(orgs.drop("towns"), orgs.select("name_key", F.explode("towns").alias("town")), companies)
    got = {r.name_key: (r.matched_by, r.number) for r in m.collect()}
    assert got == {"one": ("name_and_town", "1"), "two": ("name_and_town", "3"), "far": ("exact_name", "5"), "num": ("number", "77")}
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def people_and_postings(spark, n_people=12, n_jobs=1500, seed=3):
    rnd = random.Random(seed)
    fam = ["software", "data", "design"]
    jobs = [(i, rnd.choice(fam), rnd.choice(["senior", "entry", None]), rnd.choice(["London", None]), "London", rnd.choice(["remote", "hybrid", None]), None,
             None, None, None, None, rnd.sample(["Python", "SQL", "Go"], 2), None, rnd.choice(["offered", "not_offered", None]),
             None, day(0) - dt.timedelta(minutes=rnd.randrange(300000)), None, "live") for i in range(n_jobs)]
    view = spark.createDataFrame(jobs, "posting_id long, role_family string, seniority string, city string, location_raw string, work_mode string, employment_type string, "
                                 "salary_min int, salary_max int, salary_currency string, salary_period string, skills array<string>, years_experience int, sponsorship_signal string, "
                                 "posted_at timestamp, first_seen_at timestamp, stale_reason string, status string")
    ppl = [(u, [[], ["data"], ["software", "data"]][u % 3], ["london"] if u % 2 else [], ["remote"] if u % 4 == 0 else [], [], ["senior", None][u % 2], ["python"], None,
            ["yes", "no"][u % 2], None, True) for u in range(n_people)]
    people = spark.createDataFrame(ppl, "user_id long, roles array<string>, locations array<string>, work_modes array<string>, employment_types array<string>, level string, "
                                   "skills array<string>, years_experience int, needs_sponsorship string, min_salary int, hide_refusals boolean")
    # One person dismissed most of the newest postings, far more than fit beside the 400.
    newest = sorted(jobs, key=lambda j: (j[15], j[0]), reverse=True)
    marks = [(0, j[0], "dismissed") for j in newest[:900]] + [(1, newest[0][0], "dismissed"), (2, newest[1][0], "saved")]
    return people, view, spark.createDataFrame(marks, "user_id long, posting_id long, mark string"), ppl, newest, marks


def test_ranking_candidates_match_brute_force(spark):
    people, view, marks, ppl, newest, mk = people_and_postings(spark)
    out = matching.rank_for_people(people, view, marks, day(1)).collect()
    got = {}
    for r in out:
        got.setdefault(r.user_id, set()).add(r.posting_id)
        assert 0 <= r.score <= 100
    gone = {(u, p) for u, p, m in mk if m == "dismissed"}
    for p in ppl:
        want = [j[0] for j in newest if (not p[1] or j[1] in p[1]) and (p[0], j[0]) not in gone][:400]
        assert got[p[0]] == set(want), p[0]
    # Reasons add up to the score.
    most = {r.user_id: r.most for r in people.select("user_id", matching.max_points({c: F.col(c) for c in people.columns}).alias("most")).collect()}
    for r in out[:500]:
        raw = sum(x.points for x in r.reasons)
        assert r.score == max(0, min(100, int((50 + 50 * raw / most[r.user_id] + 0.5) // 1)))
    best = matching.rank_for_people(people, view, marks, day(1), top=5).collect()
    full = {(r.user_id, r.posting_id, r.rank) for r in out if r.rank and r.rank <= 5}
    assert {(r.user_id, r.posting_id, r.rank) for r in best} == full


def test_sector_refresh_is_idempotent(spark):
    from checks.catalog import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    once = sectors.refresh(i.profiles(), i.orgs(), i.postings(), day(0))
    twice = sectors.refresh(once.drop("sectors_changed", "computed_basis"), i.orgs(), i.postings(), day(1))
    assert once.where("sectors_changed").count() > 0 and twice.where("sectors_changed").count() == 0


def test_versions_replace_and_survive_half_writes(spark, tmp_path):
    t = str(tmp_path / "table")
    df = spark.range(3)
    files.write_version(df, t, 1)
    files.write_version(spark.range(5), t, 1)
    (tmp_path / "table" / "v=000000000002").mkdir()
    assert files.versions(spark, t) == [1] and files.read_version(spark, t, "id long").count() == 5
    assert files.read_version(spark, str(tmp_path / "none"), POSTINGS).count() == 0


def test_plans(spark):
    from checks.catalog import AS_OF, Inputs
    from checks.q_search import F2

    i = Inputs(spark, "/root/testdata/sf0.001")
    facets = search.posting_facets(i.posting_view(), F2, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert facets.count("lineitem.parquet") == 1, "all facets come from one scan of the postings"
    normal = postings.normalise(raw_job(spark, [(0, 0, "1", "Developer", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in normal and "EvalPython" not in normal


def test_daily_plans_end_to_end(spark):
    import json

    from postmill.plans import daily

    rows = spark.createDataFrame([("Acme Ltd", "Leeds", "", "Worker (A rating)", "Skilled Worker", 1)],
                                 "name string, town string, county string, type_rating string, route string, row_no long")
    orgs = daily.import_register(rows, register.empty_orgs(spark), 1, day(0), minimum=1).drop("action")
    lever = [{"id": "a1", "text": "Data Engineer", "hostedUrl": "https://x.com/1", "categories": {"location": "London"}, "descriptionPlain": "Python and SQL. Visa sponsorship is available."}]
    listing = {"content": [{"id": "s1", "name": "Developer", "location": {"city": "Leeds", "country": "gb"}}, {"id": "s2", "name": "Chef", "location": {"city": "Leeds", "country": "gb"}}]}
    detail = {"postingUrl": "https://x.com/s1", "jobAd": {"sections": {"a": {"text": "<p>No sponsorship.</p>"}}}}
    payloads = spark.createDataFrame([("acme ltd", "lever", "acme", 1, 0, json.dumps(lever), day(1)), ("acme ltd", "smartrecruiters", "acme", 1, 0, json.dumps(listing), day(1))],
                                     "name_key string, source string, slug string, scan_id long, page long, payload string, fetched_at timestamp")
    details = spark.createDataFrame([("acme ltd", "smartrecruiters", "s1", json.dumps(detail))], "name_key string, source string, external_id string, payload string")
    outs = spark.createDataFrame([("acme ltd", s, 1, True, True, day(1)) for s in ("lever", "smartrecruiters")],
                                 "name_key string, source string, scan_id long, ok boolean, complete boolean, scanned_at timestamp")
    merged, log = daily.scan(payloads, outs, lifecycle.empty_postings(spark), {"smartrecruiters": details})
    got = {r.external_id: r for r in merged.collect()}
    assert set(got) == {"a1", "s1"} and sorted(r.posting_id for r in got.values()) == [1, 2]
    assert got["a1"].sponsorship_signal == "offered" and got["a1"].skills == ["Python", "SQL"] and got["s1"].sponsorship_signal == "not_offered"
    assert {(r.source, r.added) for r in log.collect()} == {("lever", 1), ("smartrecruiters", 1)}
    profiles = orgs.select("name_key", F.lit("https://acme.com").alias("website"), F.lit(None).cast("string").alias("careers_url"), F.lit("lever").alias("ats_type"))
    raw = spark.createDataFrame([(7, ["data"], ["London"], [], [], "boss", ["python"], "5", "yes", "", True)],
                                "user_id long, roles array<string>, locations array<string>, work_modes array<string>, employment_types array<string>, level string, "
                                "skills array<string>, years_experience string, needs_sponsorship string, min_salary string, hide_refusals boolean")
    marks = spark.createDataFrame([], "user_id long, posting_id long, mark string")
    best = daily.rank_everyone(raw, lifecycle.stored(merged), orgs, profiles, marks, day(2)).collect()
    assert [(r.user_id, r.posting_id, r.rank) for r in best] == [(7, got["a1"].posting_id, 1)] and best[0].score > 90


def test_a_hot_board_and_a_hot_employer_are_split(spark):
    """No window runs on the board's layout, and employers are joined to postings once."""
    snap = postings.normalise(raw_job(spark, [(1, 0, "1", "Data Engineer", "a")]))
    merged = lifecycle.merge_scan(lifecycle.empty_postings(spark), snap, outcome(spark, 1))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("external_id" in line.split("windowspecdefinition")[1] for line in windows)


def test_a_board_that_asks_to_wait_is_not_logged(spark):
    from postmill.operators import reports

    rows = [("a", "lever", 1, False, True, day(1), 429), ("b", "lever", 1, False, True, day(1), 503), ("c", "lever", 1, True, True, day(1), 200)]
    out = spark.createDataFrame(rows, "name_key string, source string, scan_id long, ok boolean, complete boolean, scanned_at timestamp, http_status int")
    snap = postings.normalise(raw_job(spark, []))
    log = lifecycle.scan_log(lifecycle.merge_scan(lifecycle.empty_postings(spark), snap, out), out)
    assert {r.name_key for r in log.collect()} == {"b", "c"}
    last = reports.latest_scan_per_employer(out.withColumnRenamed("scanned_at", "started_at"))
    assert {r.name_key: r.ok for r in last.collect()} == {"b": False, "c": True}


def test_details_do_not_change_what_the_listing_decided(spark):
    """Screen, enrich, normalise: a detail that moves a posting abroad neither drops it nor renames its family."""
    raw = raw_job(spark, [(1, 0, "1", "Data Engineer", None), (1, 1, "2", "Head Chef", None), (1, 2, "3", "Developer", "own text")])
    kept = postings.screen(raw).where("skip is null or skip = 'no_apply_url'")
    details = spark.createDataFrame(
        [("acme", "lever", "1", ["Berlin, Germany"], "uses python"), ("acme", "lever", "2", ["London"], "x"), ("acme", "lever", "3", ["Paris"], "y")],
        "name_key string, source string, external_id string, locations array<string>, description_text string")
    out = {r.external_id: r for r in postings.normalise(postings.enrich(kept, details)).collect()}
    assert set(out) == {"1", "3"}
    assert out["1"].location_raw == "Berlin, Germany" and out["1"].role_family == "data" and out["1"].skills == ["Python"]
    assert out["3"].location_raw == "London" and out["3"].excerpt == "own text"


def test_later_parts_of_long_texts_count(spark):
    filler = "word " * 8000
    a, b = (postings.normalise(raw_job(spark, [(1, 0, "1", "Developer", filler + end)])).first() for end in ("This is a hybrid role.", "This is a remote role."))
    assert a.work_mode == "hybrid" and a.content_hash != b.content_hash


def test_notes_on_websites(spark):
    from postmill.functions import rules
    from postmill.operators import resolve

    wall = "<title>Just a moment...</title> checking your browser cf-chl captcha Attention Required Access denied"
    rows = [
        ("good", "Brightwater Foods Ltd", 0, "https://brightwaterfoods.com/", 200, "", 0.9, ["name in the title"], "t" * 300, "d" * 500, False),
        ("weak", "Brightwater Foods Ltd", 0, "https://other.com/", 200, "", 0.45, ["a word"], "t", "d", False),
        ("shut", "Brightwater Foods Ltd", 0, "https://brightwaterfoods.com/", 403, wall, 0.0, [], "", "", False),
        ("none", "Brightwater Foods Ltd", 0, "https://other.com/", 200, "", 0.1, [], "", "", False),
        ("said", "Brightwater Foods Ltd", 0, "https://bwf.org/", 200, "", 0.2, ["a word"], "t", "d", True),
    ]
    c = spark.createDataFrame(rows, "name_key string, org_name string, position int, url string, status int, html string, confidence double, reasons array<string>, title string, description string, claimed boolean")
    sites = resolve.choose_website(c)
    empty = sites.limit(0)
    careers = empty.select("name_key", *[F.lit(None).cast("string").alias(x) for x in ("careers_url", "ats_type", "ats_slug")])
    entities = empty.select("name_key", *[F.lit(None).cast("string").alias(x) for x in ("entity_id", "size_band", "industry")])
    companies = empty.select("name_key", F.lit("").alias("number"), F.lit("").alias("status"), F.lit(None).cast("date").alias("incorporated_on"), F.array(F.lit("")).alias("sic_codes"))
    got = {r.name_key: r for r in resolve.assemble_profiles(sites, careers, entities, companies, day(0)).collect()}
    note = {k: (r.provenance["website"].status, r.provenance["website"].source, r.provenance["website"].confidence, r.provenance["website"].detail) for k, r in got.items()}
    assert note["good"] == ("inferred", "domain_guess", 0.9, "name in the title") and len(got["good"].site_title) == 300
    assert note["weak"] == ("unconfirmed", "domain_guess", 0.45, rules.CANDIDATE_NOTE + "a word")
    assert note["shut"] == ("unconfirmed", "domain_guess", None, rules.BLOCKED_NOTE)
    assert note["none"] == ("unconfirmed", "domain_guess", None, rules.NO_WEBSITE_NOTE)
    assert note["said"] == ("inferred", "wikidata", 0.85, rules.CLAIM_REASON + "; a word")


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    from postmill.session import checkpoint_folder, scratch

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark) as keep:
        assert keep(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_profiles_score_landed_pages_once(spark, tmp_path):
    """links and profiles both start from the chosen websites; all pages were scored for each of them."""
    from checks import registered

    html = "<html><head><title>Brightwater Foods</title></head><body><h1>Brightwater Foods</h1><p>" + "Registered in England. " * 9 + "</p></body></html>"
    pages = [(i, f"https://brightwater{i}.co.uk/", html) for i in range(1, 11)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    parts = [(i, 7, "SMALL TIN", "Brand#1") for i in range(4)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    out = registered.QUERIES["profiles_assembled"].run(spark, str(tmp_path))
    assert "hugedomains" not in out._jdf.queryExecution().optimizedPlan().toString()  # the scored pages are read back, not scored again
    assert sorted(r.name_key for r in out.collect()) == ["e0", "e10", "e5"]


def test_outcomes_are_counted_once_for_all_scans(spark, monkeypatch):
    """F1 F2 F3 F4: the board outcomes were counted from all rows again in every merge, and every merge read all scans' postings."""
    from checks import q_postings
    from postmill.operators import lifecycle

    seen = []
    merge = lifecycle.merge_scan
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()

    def watched(state, snapshot, outcomes):
        seen.append((plan(outcomes), snapshot._jdf.queryExecution().executedPlan().toString()))
        return merge(state, snapshot, outcomes)

    monkeypatch.setattr(lifecycle, "merge_scan", watched)
    scans = [year for year, _, _ in q_postings.replayed(spark, "/root/testdata/sf0.001")]
    assert len(seen) == len(scans) > 1
    assert all("l_suppkey" not in outcomes and "Aggregate" not in outcomes for outcomes, _ in seen)
    assert all("PartitionFilters: [isnotnull(scan_id" in snapshot for _, snapshot in seen)
