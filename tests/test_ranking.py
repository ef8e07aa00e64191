"""Candidate lists against a plain loop: look-backs merged, depth per list, no limit."""

import datetime as dt
import random

from pyspark.sql import functions as F

from postmill.operators import matching

NOW = dt.datetime(2026, 3, 1)
VIEW = ("posting_id long, role_family string, seniority string, city string, location_raw string, work_mode string, employment_type string, salary_min int, "
        "salary_max int, salary_currency string, salary_period string, skills array<string>, years_experience int, sponsorship_signal string, posted_at timestamp, "
        "first_seen_at timestamp, stale_reason string, status string")
PEOPLE = ("user_id long, roles array<string>, locations array<string>, work_modes array<string>, employment_types array<string>, level string, skills array<string>, "
          "years_experience int, needs_sponsorship string, min_salary int, hide_refusals boolean, since_hours int")


def data(spark, n=400):
    pick = random.Random(5)
    posts = [(i, pick.choice(["software", "data", "design"]), NOW - dt.timedelta(minutes=pick.randrange(9000))) for i in range(n)]
    view = spark.createDataFrame([(i, r, None, None, "x", None, None, None, None, None, None, [], None, None, None, t, None, "live") for i, r, t in posts], VIEW)
    folk = [(u, pick.choice([[], ["software"], ["data", "design"]]), pick.choice([24, 40, 100, 192])) for u in range(25)]
    people = spark.createDataFrame([(u, r, [], [], [], None, [], None, None, None, False, h) for u, r, h in folk], PEOPLE)
    return posts, view, folk, people


def plain(posts, folk, gone, limit, look_back=True):
    out = {}
    for user, roles, hours in folk:
        fits = [(t, i) for i, r, t in posts if (not roles or r in roles) and (not look_back or t > NOW - dt.timedelta(hours=hours)) and (user, i) not in gone]
        out[user] = {i for _, i in sorted(fits, reverse=True)[:limit]}
    return {u: ids for u, ids in out.items() if ids}


def listed(df):
    out = {}
    for r in df.select("user_id", "posting_id").collect():
        out.setdefault(r.user_id, set()).add(r.posting_id)
    return out


def test_lists_equal_a_plain_loop(spark):
    posts, view, folk, people = data(spark)
    pick = random.Random(6)
    gone = {(u, i) for u, _, _ in folk[:9] for i in pick.sample(range(400), 30)}
    marks = spark.createDataFrame([(u, i, "dismissed") for u, i in gone], "user_id long, posting_id long, mark string")
    for look_back in (True, False):
        for limit in (1, 17, None):
            got = matching.rank_for_people(people if look_back else people.drop("since_hours"), view, marks, NOW, look_back=look_back, candidates=limit)
            assert listed(got) == plain(posts, folk, gone, limit, look_back)


def test_a_dismissal_deepens_one_list_only(spark):
    posts, view, folk, people = data(spark)
    roles = {u: r for u, r, _ in folk}
    one = next(u for u, r in roles.items() if r == ["software"])
    marks = spark.createDataFrame([(one, i, "dismissed") for i in range(300)], "user_id long, posting_id long, mark string")
    who = people.select("user_id", "since_hours", F.array_join("roles", ",").alias("shelf")).join(marks.groupBy("user_id").agg(F.count("*").alias("dismissals")), "user_id", "left").fillna(0)
    depth = {(r.since_hours, r.shelf): r.depth for r in matching._lists(who, 10).collect()}
    deep = next((h, "software") for u, _, h in folk if u == one)
    assert depth[deep] == 310 and all(d == 10 for k, d in depth.items() if k != deep)


def test_rows_are_cut_before_they_are_exchanged(spark):
    posts, view, _, _ = data(spark)
    narrow = view.select("posting_id", F.col("first_seen_at").alias("newest"), F.lit(0).alias("hours"), F.explode(F.array("role_family", F.lit("*"))).alias("role"))
    asked = [{"role": "*", "depth": 5, "hours": [0]}, {"role": "data", "depth": 5, "hours": [0]}]
    found = matching._role_newest(narrow, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and narrow.count() <= 2 * len(posts) and found.count() == 10


def test_readers_of_one_list_are_dealt_out(spark, monkeypatch):
    """All people on one list: their pairs are made by as many tasks as the readers ask for, not by one."""
    monkeypatch.setattr(matching, "_READERS", 5)
    who = spark.range(200).select(F.col("id").alias("user_id"), F.lit(192).alias("since_hours"), F.lit("software").alias("shelf"))
    shelves = spark.range(30).select(F.lit(192).alias("since_hours"), F.lit("software").alias("shelf"), F.col("id").alias("posting_id"), (F.col("id") + 1).cast("int").alias("place"))
    met = matching._met(who, shelves)
    rows = met.select(F.spark_partition_id().alias("task"), "user_id", "posting_id").collect()
    tasks = [len({r.user_id for r in rows if r.task == t}) for t in {r.task for r in rows}]
    assert len(tasks) > 15 and max(tasks) < 60 and sum(tasks) == 200
    assert len({(r.user_id, r.posting_id) for r in rows}) == len(rows) == 6000


def test_dismissed_places_need_no_pairs(spark):
    pick = random.Random(8)
    marked = {u: set(pick.sample(range(1, 301), pick.randrange(1, 200))) for u in range(12)}
    who = spark.createDataFrame([(u, 0, "*", len(d)) for u, d in marked.items()], "user_id long, since_hours int, shelf string, dismissals long")
    shelves = spark.range(1, 301).select(F.lit(0).alias("since_hours"), F.lit("*").alias("shelf"), F.col("id").alias("posting_id"), F.col("id").cast("int").alias("place"))
    dismissed = spark.createDataFrame([(u, p) for u, d in marked.items() for p in [*d, 999]], "user_id long, posting_id long")
    got = {r.user_id: r for r in matching._gone(who, shelves, dismissed, 100).collect()}
    for u, d in marked.items():
        left = [p for p in range(1, 301) if p not in d][:100]
        reached = 100 + (got[u].extra if u in got else 0)
        held = {64 * w + b for w, bits in enumerate(got[u].gone if u in got else []) for b in range(64) if bits >> b & 1}
        assert [p for p in range(1, min(reached, 300) + 1) if p not in held] == left
