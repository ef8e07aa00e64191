"""Scoring people against postings, and ranking every person's postings in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, extract, labels, rules
from ..functions.text import lookup
from ..session import cut_lineage

CANDIDATES = 400
PAGE = 20
#: Streams a role's postings are cut to their newest in, before the streams are merged.
_SALTS = 32
#: People of one list whose pairs one task scores.
_READERS = 1024
_ANY_ROLE = "*"


# ---------------------------------------------------------------- score
def max_points(p) -> Column:
    """Most points a posting could earn for this person; only answered questions count."""
    asked = [
        (F.size(p["roles"]) > 0, 35),
        (F.size(p["skills"]) > 0, 25),
        (p["level"].isNotNull(), 15),
        (p["years_experience"].isNotNull(), 5),
        (F.size(p["locations"]) > 0, 15),
        (F.size(p["work_modes"]) > 0, 5),
        (F.size(p["employment_types"]) > 0, 5),
        (F.coalesce(p["needs_sponsorship"].isin("yes", "unsure"), F.lit(False)), 20),
        (p["min_salary"].isNotNull(), 5),
    ]
    total = reduce(lambda acc, a: acc + F.when(a[0], a[1]).otherwise(0), asked, F.lit(3))
    return F.greatest(F.lit(40), total)


def _say(key: str, *values) -> Column:
    """One of the fixed wordings with its values filled in."""
    parts = rules.MATCH_WORDING[key].split("{}")
    filled = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        filled += [value, F.lit(after)]
    return F.concat(*filled)


def prepare_people(people: DataFrame) -> DataFrame:
    """What scoring needs of a person alone, computed once per person.

    Their own skills and years get names no posting column has.
    """
    return (
        people.withColumn("my_skills", F.col("skills"))
        .withColumn("my_years", F.col("years_experience"))
        .withColumn("my_level", lookup(rules.LEVEL_RANK, F.col("level")))
        .withColumn("needs", F.coalesce(F.col("needs_sponsorship").isin("yes", "unsure"), F.lit(False)))
        .withColumn("skills_lower", F.transform("skills", lambda s: F.lower(F.trim(s))))
        .withColumn("locations_lower", F.transform("locations", lambda s: F.lower(F.trim(s))))
        .withColumn("most", max_points(_named(people)))
        .drop("skills", "years_experience")
    )


def prepare_jobs(view: DataFrame, as_of) -> DataFrame:
    """What scoring needs of a posting alone, computed once per posting, not once per pair."""
    age = dates.elapsed_seconds(as_of, F.coalesce("posted_at", "first_seen_at")) / 86400
    top = extract.annual_gbp(F.coalesce("salary_max", "salary_min"), F.col("salary_currency"), F.col("salary_period"))
    return (
        view.withColumn("job_skills_lower", F.transform("skills", lambda s: F.lower(F.trim(s))))
        .withColumn("counted_skills", F.least(F.size("skills"), F.lit(6)))
        .withColumn("job_level", lookup(rules.LEVEL_RANK, F.col("seniority")))
        .withColumn("here", F.lower(F.trim(F.coalesce("city", F.lit("")))))
        .withColumn("raw_place", F.lower(F.trim("location_raw")))
        .withColumn("signal", F.coalesce("sponsorship_signal", F.lit("unmentioned")))
        .withColumn("top_pay", F.when(F.col("salary_min").isNotNull(), top))
        .withColumn("is_fresh", age <= 7)
    )


def topics(p, j) -> list[list[tuple]]:
    """The scoring rules. Each topic is a list of (condition, kind, text, points).

    Within a topic the first condition that holds speaks; if none does, the topic
    adds nothing, so silence on either side never counts. '+' helped, '-' counted
    against, '=' is a neutral note.
    """
    asked = lambda c: F.size(p[c]) > 0

    role = lookup(rules.ROLE_LABELS, j["role_family"])
    role_topic = [
        (asked("roles") & F.array_contains(p["roles"], j["role_family"]),
         "+", _say("role_chosen", role), 35),
        (asked("roles"), "-", _say("role_other", role), -15),
    ]

    hits = F.size(F.array_intersect(j["job_skills_lower"], p["skills_lower"]))
    hit = F.filter(j["skills"], lambda s: F.array_contains(p["skills_lower"], F.lower(F.trim(s))))
    most = j["counted_skills"]
    skill_points = F.least(F.lit(25), dates.round_half_up(hits / most * 25).cast("int"))
    both = asked("skills") & (F.size(j["skills"]) > 0)
    skill_topic = [
        (both & (hits > 0), "+",
         _say("skills_shared", hits.cast("string"), F.array_join(F.slice(hit, 1, 4), ", ")),
         skill_points),
        (both, "=", _say("skills_none"), 0),
    ]

    step = j["job_level"] - p["my_level"]
    level = lookup(rules.LEVEL_NAME, j["seniority"])
    level_topic = [
        (p["level"].isNotNull() & j["seniority"].isNull(), "=", _say("level_silent"), 3),
        (step == 0, "+", _say("level_same", level), 15),
        (F.abs(step) == 1, "=", _say("level_near", level), 5),
        (step > 1, "-", _say("level_above", level), -15),
        (step < -1, "-", _say("level_below", level), -8),
    ]

    asks, has = j["years_experience"], p["years_experience"]
    years_topic = [
        (asks > has + 2, "-", _say("years_short", asks.cast("string"), has.cast("string")), -8),
        (asks <= has, "+", _say("years_met", asks.cast("string"), has.cast("string")), 5),
    ]

    here, raw = j["here"], j["raw_place"]
    shown = F.coalesce(j["city"], F.split_part(j["location_raw"], F.lit(" | "), F.lit(1)))
    placed = F.exists(
        p["locations_lower"], lambda w: ((here != "") & F.startswith(here, w)) | F.contains(raw, w)
    )
    remote = j["work_mode"].isin("remote", "flexible") & F.array_contains(p["work_modes"], "remote")
    place_topic = [
        (asked("locations") & placed, "+", _say("place_yours", shown), 15),
        (asked("locations") & remote, "+", _say("place_remote"), 10),
        (asked("locations"), "-", _say("place_other", shown), -20),
    ]

    mode = lookup(rules.MODE_NAME, j["work_mode"])
    mode_stated = asked("work_modes") & j["work_mode"].isNotNull()
    suits = F.array_contains(p["work_modes"], j["work_mode"]) | (j["work_mode"] == "flexible")
    mode_topic = [
        (mode_stated & suits, "+", _say("mode_suits", mode), 5),
        (mode_stated, "-", _say("mode_other", mode), -10),
    ]

    type_stated = asked("employment_types") & j["employment_type"].isNotNull()
    type_topic = [
        (type_stated & F.array_contains(p["employment_types"], j["employment_type"]),
         "+", _say("type_chosen"), 5),
        (type_stated, "-", _say("type_other"), -12),
    ]

    needs, signal = p["needs"], j["signal"]
    sponsorship_topic = [
        (needs & (signal == "offered"), "+", _say("sponsor_offered"), 20),
        (needs & (signal == "not_offered"), "-", _say("sponsor_refused"), -40),
        (needs & (signal == "unclear"), "=", _say("sponsor_unclear"), 0),
        (needs & (signal == "right_to_work"), "-",
         _say("sponsor_right"), -10),
        (needs, "=", _say("sponsor_silent"), 0),
    ]

    top = j["top_pay"]
    figure = F.concat(F.lit("£"), labels.thousands(top))
    pay_topic = [
        (top < p["min_salary"], "-", _say("pay_below", figure), -15),
        (top >= p["min_salary"], "+", _say("pay_within", figure), 5),
    ]

    fresh_text = F.when(j["posted_at"].isNotNull(), _say("fresh_posted")).otherwise(_say("fresh_found"))
    fresh_topic = [(j["is_fresh"], "+", fresh_text, 3)]
    stale_topic = [
        (j["stale_reason"].isNotNull(), "-", _say("stale", F.lower(j["stale_reason"])), -5)
    ]
    return [role_topic, skill_topic, level_topic, years_topic, place_topic, mode_topic, type_topic,
            sponsorship_topic, pay_topic, fresh_topic, stale_topic]


def _case(topic, value) -> Column:
    chain = F.when(topic[0][0], value(topic[0]))
    for entry in topic[1:]:
        chain = chain.when(entry[0], value(entry))
    return chain


def _literal(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def points(rule_topics) -> Column:
    """Sum of points, without building any text."""
    each = [F.coalesce(_case(t, lambda e: _literal(e[3])), F.lit(0)) for t in rule_topics]
    return reduce(lambda a, b: a + b, each)


def reasons(rule_topics) -> Column:
    """The reasons behind the points, in topic order."""

    def reason(e) -> Column:
        return F.struct(
            F.lit(e[1]).alias("kind"), _literal(e[2]).alias("text"), _literal(e[3]).cast("int").alias("points")
        )

    return F.array_compact(F.array(*[_case(t, reason) for t in rule_topics]))


def is_hidden(p, j) -> Column:
    """The posting refuses, the person needs sponsorship and asked not to see refusals."""
    return F.coalesce(p["needs"] & (j["signal"] == "not_offered") & p["hide_refusals"], F.lit(False))


def score_of(total: Column, most: Column) -> Column:
    return dates.clamp(dates.round_half_up(F.lit(50) + F.lit(50) * total / most), 0, 100).cast("int")


# ---------------------------------------------------------------- ranking
_JOB = [
    "posting_id", "role_family", "seniority", "city", "location_raw", "work_mode", "employment_type", "salary_min",
    "salary_max", "salary_currency", "salary_period", "skills", "years_experience", "sponsorship_signal",
    "posted_at", "first_seen_at", "stale_reason",
]


def _newest_first():
    return [F.col("newest").desc(), F.col("posting_id").desc()]


def _lists(who: DataFrame, candidates: int | None) -> DataFrame:
    """(since_hours, shelf, role, depth): the roles of every list somebody asked for, and how much of it is needed.

    Someone who dismissed d postings needs d more, on their own list alone.
    """
    depth = F.lit(None).cast("long") if candidates is None else F.lit(candidates) + F.max("dismissals")
    lists = who.groupBy("since_hours", "shelf").agg(depth.alias("depth"))
    return lists.withColumn("role", F.explode(F.split("shelf", ",")))


def _role_newest(roles: DataFrame, asked: list) -> DataFrame:
    """(role, since_hours, place, newest, posting_id): the newest postings of each role within each asked look-back.

    A posting counts once, in the shortest look-back that reaches it. There the newest
    are found (in salted streams first, so no role is one task); then the look-backs of
    a role are merged from the shortest to the longest, each time keeping as many as
    the role's deepest list needs.
    """
    depths = {r["role"]: r["depth"] for r in asked}
    hours = {r["role"]: sorted(r["hours"]) for r in asked}
    by_role = F.create_map(*[x for role, h in hours.items() for x in (F.lit(role), F.array(*map(F.lit, h)))])
    fits = F.array_min(F.filter(by_role[F.col("role")], lambda s: s >= F.col("hours")))
    cut = roles.withColumn("since", fits).where("since is not null").withColumn("depth", lookup(depths, F.col("role")))
    most = max(depths.values())
    for by in (["role", "since", F.pmod(F.xxhash64("posting_id"), F.lit(_SALTS))], ["role", "since"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*_newest_first()))
        # The plain number lets Spark cut each task's rows before they are exchanged.
        cut = cut.withColumn("_n", place).where((F.col("_n") <= most) & (F.col("_n") <= F.col("depth"))).drop("_n")
    entry = F.struct("newest", "posting_id")
    steps = cut.groupBy("role", "since", "depth").agg(F.collect_list(entry).alias("new"))
    # At most `depth` entries for each asked hour.
    each = steps.groupBy("role", "depth").agg(F.map_from_entries(F.collect_list(F.struct("since", "new"))).alias("by_hour"))
    none = F.array().cast("array<struct<newest:timestamp,posting_id:bigint>>")

    def longer(state: Column, since: Column) -> Column:
        met = F.concat(state["now"], F.coalesce(F.try_element_at("by_hour", since), none))
        now = F.slice(F.sort_array(met, asc=False), F.lit(1), F.col("depth").cast("int"))
        return F.transform(F.array(now), lambda n: F.struct(n.alias("now"), F.concat(state["all"], F.array(F.struct(since.alias("since_hours"), n.alias("found")))).alias("all")))[0]

    start = F.struct(none.alias("now"), F.array().cast("array<struct<since_hours:int,found:array<struct<newest:timestamp,posting_id:bigint>>>>").alias("all"))
    merged = each.select("role", F.explode(F.aggregate(by_role[F.col("role")], start, longer)["all"]).alias("m"))
    return merged.select("role", "m.since_hours", F.posexplode("m.found").alias("place", "f")).select("role", "since_hours", "f.*")


def _shelves(view: DataFrame, lists: DataFrame, as_of, look_back: bool, candidates: int | None) -> DataFrame:
    """The live postings on every list, with their `place` (newest first; null without a limit)."""
    live = view.where("status = 'live'")
    # Whole hours of look-back that reach this posting.
    hours = F.floor(dates.elapsed_seconds(as_of, F.col("first_seen_at")) / 3600).cast("int") + 1 if look_back else F.lit(0)
    narrow = live.select("posting_id", F.coalesce("posted_at", "first_seen_at").alias("newest"), hours.alias("hours"), F.explode(F.array("role_family", F.lit(_ANY_ROLE))).alias("role"))
    if candidates is None:
        found = lists.join(narrow, "role").where(F.col("hours") <= F.col("since_hours")).select("since_hours", "shelf", "posting_id", F.lit(None).cast("int").alias("place"))
    else:
        # A row for each role.
        asked = lists.groupBy("role").agg(F.max("depth").alias("depth"), F.collect_set("since_hours").alias("hours")).collect()
        if not asked:
            return view.sparkSession.createDataFrame([], "since_hours int, shelf string, place int").join(prepare_jobs(live.select(*_JOB), as_of), F.lit(False))
        per_role = _role_newest(narrow, asked)
        order = Window.partitionBy("since_hours", "shelf").orderBy(*_newest_first())
        found = lists.join(per_role, ["since_hours", "role"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("depth"))
        found = found.select("since_hours", "shelf", "posting_id", "place")
    return found.join(prepare_jobs(live.select(*_JOB), as_of), "posting_id")


def _gone(who: DataFrame, shelves: DataFrame, dismissed: DataFrame, candidates: int) -> DataFrame:
    """(user_id, extra, gone): how many of a person's newest postings they dismissed, and at which places.

    The i-th dismissed place p is reached if p - i < candidates, and then one more
    posting takes its turn. ``gone`` holds a bit for each place, 64 to a word, so a
    pair is tested in one step however much somebody dismissed. Only dismissals are
    moved, never the pairs.
    """
    key = ["since_hours", "shelf"]
    mine = who.where("dismissals > 0").select("user_id", *key).join(dismissed.distinct(), "user_id")
    places = mine.join(shelves.select(*key, "posting_id", "place"), [*key, "posting_id"]).select("user_id", "place").distinct()
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    reached = places.withColumn("_n", nth).where(F.col("place") - F.col("_n") < candidates)
    words = reached.groupBy("user_id", (F.col("place") / 64).cast("int").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits"))
    by_word = words.groupBy("user_id").agg(
        F.sum("n").alias("extra"), F.max("word").alias("last"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    bits = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long")))
    return by_word.select("user_id", "extra", bits.alias("gone"))


def _met(who: DataFrame, shelves: DataFrame) -> DataFrame:
    """Every person with the postings of their list, at most about ``_READERS`` people of a list to a task.

    A list that many share is dealt out with its readers. The number of partitions is
    fixed, as pairs are hundreds of times the rows that are exchanged: tasks made up by
    bytes would sort many times the memory they have.
    """
    key = ["since_hours", "shelf"]
    shares = who.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / _READERS).cast("int").alias("shares"))
    tasks = shares.agg(F.coalesce(F.sum("shares"), F.lit(1))).first()[0]
    readers = who.join(F.broadcast(shares), key).withColumn("share", F.pmod(F.xxhash64("user_id"), F.col("shares")).cast("int")).drop("shares")
    dealt = shelves.join(F.broadcast(shares), key).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    by = [*key, "share"]
    return readers.repartition(tasks, *by).join(dealt.repartition(tasks, *by), by).drop("share")


def rank_for_people(
    people: DataFrame,
    view: DataFrame,
    marks: DataFrame,
    as_of,
    look_back: bool = False,
    min_score: int | None = None,
    top: int | None = None,
    candidates: int | None = CANDIDATES,
) -> DataFrame:
    """Scored candidates of every person: user_id, posting_id, score, reasons, hidden, rank.

    A person's candidates are the newest ``candidates`` (400) live postings in their
    roles that they have not dismissed; that number is part of what a ranking means,
    and None ranks all of them. People with the same roles (and look-back) share one
    list, of which there are at most 512 for each look-back, so candidates are computed per list and
    handed out; work per person does not depend on the number of postings.
    Someone who dismissed d postings gets the newest 400 + d of their list before
    the dismissed ones are taken out, which is exact whatever d is; nobody else's
    list grows by that.

    With ``look_back`` people carry since_hours. ``top`` keeps only
    each person's best; reasons are written for the rows that remain.
    """
    dismissed = cut_lineage(marks.where("mark = 'dismissed'").select("user_id", "posting_id"))
    counts = dismissed.groupBy("user_id").agg(F.count(F.lit(1)).alias("dismissals"))
    # Written once; lists, pairs and reasons are read from there.
    who = cut_lineage(
        prepare_people(people)
        .join(counts, "user_id", "left")
        .withColumn("dismissals", F.coalesce("dismissals", F.lit(0)))
        .withColumn("since_hours", F.col("since_hours").cast("int") if look_back else F.lit(0))
        .withColumn("shelf", F.when(F.size("roles") > 0, F.array_join(F.array_sort(F.array_distinct("roles")), ","))
                    .otherwise(_ANY_ROLE))
        .withColumn("namesakes", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    )
    # Computed and written once; pairs, dismissed places and reasons are read from there.
    shelves = cut_lineage(_shelves(view, _lists(who, candidates), as_of, look_back, candidates))
    key = ["since_hours", "shelf"]
    if candidates is None:
        found = who.join(shelves, key).join(dismissed, ["user_id", "posting_id"], "left_anti")
    else:
        # Rows that share an id share one deeper slice; everybody else has a list of their own.
        shared = (F.col("dismissals") > 0) & (F.col("namesakes") > 1)
        own = who.where(~shared).join(_gone(who.where(~shared), shelves, dismissed, candidates), "user_id", "left")
        last = F.lit(candidates) + F.coalesce("extra", F.lit(0))
        word, bit = (F.col("place") / 64).cast("int"), F.col("place") % 64
        taken = F.coalesce(F.getbit(F.get("gone", word), bit) == 1, F.lit(False))
        found = _met(own, shelves).where((F.col("place") <= last) & ~taken).drop("extra", "gone")
        deeper = who.where(shared).join(shelves, key).where(F.col("place") <= candidates + F.col("dismissals"))
        left = deeper.join(dismissed, ["user_id", "posting_id"], "left_anti")
        order = Window.partitionBy("user_id").orderBy("place")
        left = left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= candidates).drop("_n")
        found = found.unionByName(left)

    # Score first, then carry only ids and the score through the sort; the
    # reasons are written afterwards, for the rows that are left.
    narrow = found.select(
        "user_id", "posting_id", "first_seen_at", is_hidden(_named(found), _named(found)).alias("hidden"),
        score_of(points(_topics_over(found)), F.col("most")).alias("score"),
    )
    if min_score is not None:
        narrow = narrow.where(F.col("hidden") | (F.col("score") >= min_score))
    best = Window.partitionBy("user_id").orderBy(
        F.col("hidden"), F.col("score").desc(), F.col("first_seen_at").desc(), F.col("posting_id").desc()
    )
    ranked = narrow.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.where((F.col("rank") <= top) & ~F.col("hidden"))
    ranked = ranked.drop("first_seen_at")
    jobs = shelves.drop("since_hours", "shelf", "place").dropDuplicates(["posting_id"])
    explained = ranked.join(who, "user_id").join(jobs, "posting_id")
    return explained.select(
        "user_id", "posting_id", "score", "hidden", reasons(_topics_over(explained)).alias("reasons"),
        F.when(~F.col("hidden"), F.col("rank")).alias("rank"),
    )


def _named(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def _topics_over(df: DataFrame):
    """The rules over joined rows, where a person's own skills and years go by other names."""
    cols = _named(df)
    return topics({**cols, "skills": F.col("my_skills"), "years_experience": F.col("my_years")}, cols)


def page(ranked: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    return ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))


def person_summary(ranked: DataFrame, candidates: int | None = CANDIDATES) -> DataFrame:
    """Per person: listed, hidden, and whether the candidate limit was reached."""
    return ranked.groupBy("user_id").agg(
        F.count_if(~F.col("hidden")).alias("total"),
        F.count_if("hidden").alias("hidden_count"),
        (F.lit(False) if candidates is None else F.count(F.lit(1)) >= candidates).alias("capped"),
    )
