"""Matching: profiles in, scored and ranked postings out, for everybody."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates, rules
from postmill.operators import matching, people, reports

from . import duck as d
from .bindings import NOW, q
from .catalog import AS_OF, Inputs, joined, query
from .q_search import VIEW, VIEW_FRAMES

MARKED = """
  marked AS (SELECT user_id, posting_id, arg_max(mark, CAST(epoch_us(logged_at) AS HUGEINT) * 1000000 + event_id) AS mark, max(logged_at) AS created_at
    FROM (SELECT event_id, user_id, posting_id, logged_at, coalesce(mark, 'cleared') AS mark FROM mark_log) m GROUP BY 1, 2),
  marks AS (SELECT * FROM marked WHERE mark <> 'cleared' AND posting_id IN (SELECT posting_id FROM postings))"""


def _has(lst: str, x: str) -> str:
    return f"list_contains({lst}, {x})"


def _say(key: str, *values: str) -> str:
    """One of the fixed wordings as SQL."""
    parts = rules.MATCH_WORDING[key].split("{}")
    texts = [q(parts[0])]
    for value, after in zip(values, parts[1:]):
        texts += [value, q(after)]
    return f"concat({', '.join(texts)})"


def _topics() -> list:
    """(condition, text, points) per topic, over a row with person p_* and posting columns."""
    role = d.lookup(rules.ROLE_LABELS, "role_family")
    hit = "list_filter(j_skills, lambda s: list_contains(list_transform(p_skills, lambda m: lower(m)), lower(s)))"
    step = f"({d.lookup(rules.LEVEL_RANK, 'seniority')} - {d.lookup(rules.LEVEL_RANK, 'level')})"
    lvl = d.lookup(rules.LEVEL_NAME, "seniority")
    here = "lower(coalesce(city, ''))"
    placed = f"len(list_filter(p_places, lambda w: ({here} <> '' AND starts_with({here}, lower(w))) OR contains(lower(location_raw), lower(w)))) > 0"
    shown = "coalesce(city, string_split(location_raw, ' | ')[1])"
    mode = d.lookup(rules.MODE_NAME, "work_mode")
    needs = "coalesce(needs_sponsorship IN ('yes', 'unsure'), false)"
    top = "(CASE WHEN salary_min IS NOT NULL AND salary_currency = 'GBP' THEN salary_max END)"
    fig = f"format('£{{:,}}', CAST({top} AS BIGINT))"
    return [
        [("len(p_roles) > 0 AND list_contains(p_roles, role_family)", _say("role_chosen", role), "35"),
         ("len(p_roles) > 0", _say("role_other", role), "-15")],
        [(f"len(p_skills) > 0 AND len(j_skills) > 0 AND len({hit}) > 0", _say("skills_shared", f"len({hit})", f"array_to_string(list_slice({hit}, 1, 4), ', ')"),
          f"least(25, CAST(floor(len({hit}) / least(len(j_skills), 6) * 25 + 0.5) AS INTEGER))"),
         ("len(p_skills) > 0 AND len(j_skills) > 0", _say("skills_none"), "0")],
        [("level IS NOT NULL AND seniority IS NULL", _say("level_silent"), "3"), (f"{step} = 0", _say("level_same", lvl), "15"),
         (f"abs({step}) = 1", _say("level_near", lvl), "5"), (f"{step} > 1", _say("level_above", lvl), "-15"),
         (f"{step} < -1", _say("level_below", lvl), "-8")],
        [("j_years > p_years + 2", _say("years_short", "j_years", "p_years"), "-8"),
         ("j_years <= p_years", _say("years_met", "j_years", "p_years"), "5")],
        [(f"len(p_places) > 0 AND {placed}", _say("place_yours", shown), "15"),
         ("len(p_places) > 0 AND work_mode IN ('remote', 'flexible') AND list_contains(p_modes, 'remote')", _say("place_remote"), "10"),
         ("len(p_places) > 0", _say("place_other", shown), "-20")],
        [("len(p_modes) > 0 AND work_mode IS NOT NULL AND (list_contains(p_modes, work_mode) OR work_mode = 'flexible')", _say("mode_suits", mode), "5"),
         ("len(p_modes) > 0 AND work_mode IS NOT NULL", _say("mode_other", mode), "-10")],
        [("len(p_types) > 0 AND employment_type IS NOT NULL AND list_contains(p_types, employment_type)", _say("type_chosen"), "5"),
         ("len(p_types) > 0 AND employment_type IS NOT NULL", _say("type_other"), "-12")],
        [(f"{needs} AND sponsorship_signal = 'offered'", _say("sponsor_offered"), "20"),
         (f"{needs} AND sponsorship_signal = 'not_offered'", _say("sponsor_refused"), "-40"),
         (f"{needs} AND sponsorship_signal = 'unclear'", _say("sponsor_unclear"), "0"),
         (f"{needs} AND sponsorship_signal = 'right_to_work'", _say("sponsor_right"), "-10"),
         (needs, _say("sponsor_silent"), "0")],
        [(f"{top} < min_salary", _say("pay_below", fig), "-15"), (f"{top} >= min_salary", _say("pay_within", fig), "5")],
        [(f"epoch_us({NOW}) - epoch_us(coalesce(posted_at, first_seen_at)) <= 7 * 86400000000", f"CASE WHEN posted_at IS NOT NULL THEN {_say('fresh_posted')} ELSE {_say('fresh_found')} END", "3")],
        [("stale_reason IS NOT NULL", _say("stale", "lower(stale_reason)"), "-5")],
    ]


def _score() -> tuple[str, str]:
    topics = _topics()
    pts = " + ".join(d.case([(c, p) for c, _, p in t], "0") for t in topics)
    txt = "concat_ws('; ', " + ", ".join(d.case([(c, x) for c, x, _ in t]) for t in topics) + ")"
    return pts, txt


def _helped() -> str:
    """Texts of the reasons that helped, in topic order; the others say nothing here."""
    neutral = ("one step from", "does not state a level")

    def said(text: str, points: str) -> str:
        quiet = points.startswith("-") or points == "0" or any(n in text for n in neutral)
        return "NULL" if quiet else text

    parts = [d.case([(c, said(x, p)) for c, x, p in t]) for t in _topics()]
    return "concat_ws('; ', " + ", ".join(parts) + ")"


def ranked(since: str = "", look_back: str = "TRUE") -> str:
    pts, txt = _score()
    return f"""{VIEW}, {MARKED},
      who AS (SELECT user_id, {d.list_of('roles')} AS p_roles, {d.list_of('locations')} AS p_places, {d.list_of('work_modes')} AS p_modes,
          {d.list_of('employment_types')} AS p_types, {d.list_of('skills')} AS p_skills, level, years_experience AS p_years, needs_sponsorship,
          min_salary, hide_refusals{since} FROM people),
      cand AS (SELECT w.*, j.* EXCLUDE (skills, years_experience), {d.list_of('j.skills')} AS j_skills, j.years_experience AS j_years,
          row_number() OVER (PARTITION BY w.user_id ORDER BY coalesce(j.posted_at, j.first_seen_at) DESC, j.posting_id DESC) AS n
        FROM who w JOIN opp j ON (len(w.p_roles) = 0 OR list_contains(w.p_roles, j.role_family))
        WHERE j.status = 'live' AND {look_back} AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.user_id = w.user_id AND m.posting_id = j.posting_id AND m.mark = 'dismissed')),
      pts AS (SELECT *, {pts} AS points, {txt} AS reasons,
          greatest(40, 3 + CASE WHEN len(p_roles) > 0 THEN 35 ELSE 0 END + CASE WHEN len(p_skills) > 0 THEN 25 ELSE 0 END + CASE WHEN level IS NOT NULL THEN 15 ELSE 0 END
            + CASE WHEN p_years IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN len(p_places) > 0 THEN 15 ELSE 0 END + CASE WHEN len(p_modes) > 0 THEN 5 ELSE 0 END
            + CASE WHEN len(p_types) > 0 THEN 5 ELSE 0 END + CASE WHEN needs_sponsorship IN ('yes', 'unsure') THEN 20 ELSE 0 END
            + CASE WHEN min_salary IS NOT NULL THEN 5 ELSE 0 END) AS most,
          coalesce(needs_sponsorship IN ('yes', 'unsure') AND sponsorship_signal = 'not_offered' AND hide_refusals, false) AS hidden
        FROM cand WHERE n <= 400),
      scored AS (SELECT *, CAST(greatest(0, least(100, floor(50 + 50 * points / most + 0.5))) AS INTEGER) AS score FROM pts),
      ranks AS (SELECT *, CASE WHEN NOT hidden THEN row_number() OVER (PARTITION BY user_id ORDER BY hidden, score DESC, first_seen_at DESC, posting_id DESC) END AS rank FROM scored)"""


FRAMES = (*VIEW_FRAMES, "people", "mark_log")


def _people(i):
    return i.people().select("user_id", "roles", "locations", "work_modes", "employment_types", "level", "skills",
                             "years_experience", "needs_sponsorship", "min_salary", "hide_refusals")


def reason_text(ranked_rows):
    return ranked_rows.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: r["text"]), "; "))


@query("M1 M2 M3 M4 C6 C15 E3 E4 I5 I6 I7", lambda: f"""WITH {ranked()} SELECT user_id, posting_id, score, reasons, rank FROM ranks WHERE rank <= 20""", FRAMES)
def match_all(spark, sf):
    i = Inputs(spark, sf)
    out = matching.rank_for_people(_people(i), i.posting_view(), i.marks(), AS_OF, top=20)
    return reason_text(out).select("user_id", "posting_id", "score", "reasons", F.col("rank").cast("long").alias("rank"))


@query("M3 M4", lambda: f"""WITH {ranked()} SELECT user_id, count(*) FILTER (NOT hidden) AS total, count(*) FILTER (hidden) AS hidden_count,
    count(*) >= 400 AS capped FROM ranks GROUP BY 1""", FRAMES)
def match_person_summary(spark, sf):
    i = Inputs(spark, sf)
    return matching.person_summary(matching.rank_for_people(_people(i), i.posting_view(), i.marks(), AS_OF))


@query("M4", lambda: f"""WITH {ranked(look_back=f"j.first_seen_at > {NOW} - INTERVAL 72 HOUR")}
    SELECT user_id, posting_id, score, rank FROM (SELECT user_id, posting_id, score, hidden, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, first_seen_at DESC, posting_id DESC) AS rank
      FROM scored WHERE NOT hidden AND score >= 60) x WHERE rank <= 5""", FRAMES)
def match_today(spark, sf):
    i = Inputs(spark, sf)
    who = _people(i).withColumn("since_hours", F.lit(72))
    out = matching.rank_for_people(who, i.posting_view(), i.marks(), AS_OF, look_back=True, min_score=60, top=5)
    return out.select("user_id", "posting_id", "score", F.col("rank").cast("long").alias("rank"))


_LOOK = f"CAST(CASE WHEN last_digest_at IS NULL THEN 192 ELSE least(192, greatest(24, ceil((epoch_us({NOW}) - epoch_us(last_digest_at)) / 3600000000.0))) END AS INTEGER)"
_PREFS = "(roles <> '' OR locations <> '' OR skills <> '' OR work_modes <> '' OR level IS NOT NULL)"
_DUE = f"digest_opt_in AND (last_digest_at IS NULL OR last_digest_at < {NOW} - INTERVAL 6 DAY)"


def sql_digest(select: str) -> str:
    base = ranked(since=", since_hours", look_back=f"j.first_seen_at > {NOW} - w.since_hours * INTERVAL 1 HOUR")
    base = base.replace("FROM people)", f"FROM (SELECT *, {_LOOK} AS since_hours FROM people WHERE {_DUE} AND {_PREFS}) due)")
    role = d.lookup(rules.ROLE_LABELS, "role_family")
    return f"""WITH {base},
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, first_seen_at DESC, posting_id DESC) AS r
               FROM scored WHERE NOT hidden AND score >= 65) x WHERE r <= 5),
      lines AS (SELECT user_id, r, concat_ws(chr(10), concat(r, '. ', title, ' at ', trim(org_name), ' (', score, '% match)'),
          concat('   ', coalesce(city, string_split(location_raw, ' | ')[1]), ' · ', {role}),
          CASE WHEN plus <> '' THEN concat('   Why: ', array_to_string(list_slice(string_split(plus, '; '), 1, 3), '; ')) END,
          concat('   Apply: ', apply_url)) AS line FROM (SELECT *, {_helped()} AS plus FROM best) y),
      digests AS (SELECT user_id, count(*) AS postings, string_agg(line, concat(chr(10), chr(10)) ORDER BY r) AS body FROM lines GROUP BY 1) {select}"""


def _digests(spark, sf):
    i = Inputs(spark, sf)
    users = i.people()
    due = reports.due_digests(users, AS_OF, limit=None)
    who = reports.with_look_back(due, AS_OF).where(people.has_preferences())
    who = who.select("user_id", "roles", "locations", "work_modes", "employment_types", "level", "skills",
                     "years_experience", "needs_sponsorship", "min_salary", "hide_refusals", "since_hours")
    view = i.posting_view()
    best = matching.rank_for_people(who, view, i.marks(), AS_OF, look_back=True, min_score=65, top=5)
    return due, reports.digest_lines(best, view)


@query("N13 I9 M5", lambda: sql_digest("""SELECT user_id, postings, body, concat(postings, ' new role', CASE WHEN postings = 1 THEN '' ELSE 's' END,
    ' that fit you') AS subject FROM digests"""), FRAMES)
def digest_content(spark, sf):
    return _digests(spark, sf)[1].select("user_id", "postings", "body", "subject")


@query("N14 D3", lambda: sql_digest(f"""SELECT count(*) AS due, count(g.user_id) AS sent, count(*) - count(g.user_id) AS nothing_to_send
    FROM (SELECT user_id FROM people WHERE {_DUE}) u LEFT JOIN digests g ON g.user_id = u.user_id"""), FRAMES)
def digest_outcomes(spark, sf):
    due, digests = _digests(spark, sf)
    return reports.digest_outcomes(due, digests)


@query("I9", f"""SELECT user_id, {_LOOK} AS since_hours FROM people""", ("people",))
def digest_look_back(spark, sf):
    return reports.with_look_back(Inputs(spark, sf).raw("people"), AS_OF).select("user_id", "since_hours")


@query("M5", f"SELECT user_id, {_PREFS} AS for_digest, {_PREFS} OR needs_sponsorship IS NOT NULL AS for_page FROM people", ("people",))
def preference_tests(spark, sf):
    return Inputs(spark, sf).people().select("user_id", people.has_preferences().alias("for_digest"), people.has_preferences(True).alias("for_page"))


# ---------------------------------------------------------------- profiles
@query("B14 B15", r"""
    WITH listed AS (SELECT c_custkey AS user_id, [c_mktsegment, lower(c_mktsegment), concat(' ', c_name, '  x '), 'software', 'SOFTWARE', ''] AS raw,
        c_acctbal FROM customer),
      tidy AS (SELECT *, list_filter(list_transform(raw, lambda v: substring(trim(regexp_replace(v, '\s+', ' ', 'g')), 1, 30)), lambda v: v <> '') AS vs FROM listed),
      firsts AS (SELECT *, list_filter(vs, lambda v, i: list_position(list_transform(vs, lambda x: lower(x)), lower(v)) = i) AS skills FROM tidy)
    SELECT user_id, array_to_string(skills, ',') AS skills, 'software' AS roles,
           CAST(CASE WHEN floor(c_acctbal + 0.5) BETWEEN 0 AND 1000000 THEN floor(c_acctbal + 0.5) END AS INTEGER) AS min_salary,
           CAST(CASE WHEN floor(c_acctbal / 100 + 0.5) BETWEEN 0 AND 50 THEN floor(c_acctbal / 100 + 0.5) END AS INTEGER) AS years_experience FROM firsts""")
def profile_sanitise(spark, sf):
    c = Inputs(spark, sf).base("customer")
    text = F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.concat(F.lit(" "), "c_name", F.lit("  x ")), F.lit("software"), F.lit("SOFTWARE"), F.lit(""))
    raw = c.select(F.col("c_custkey").alias("user_id"), text.alias("roles"), text.alias("skills"), text.alias("locations"), text.alias("work_modes"),
                   text.alias("employment_types"), F.lit("boss").alias("level"), F.lit("yes").alias("needs_sponsorship"),
                   (F.col("c_acctbal") / 100).cast("string").alias("years_experience"), F.col("c_acctbal").cast("string").alias("min_salary"), F.lit(True).alias("hide_refusals"))
    return people.sanitise_profiles(raw).select("user_id", joined("skills"), joined("roles"), "min_salary", "years_experience")


@query("B16 H22", r"""SELECT user_id, lower(trim(email)) AS email, concat(lower(trim(email))[1:1], '***@e***.org') AS masked FROM people""", ("people",))
def email_masks(spark, sf):
    from postmill.functions.labels import mask_email

    u = people.valid_emails(Inputs(spark, sf).raw("people").select("user_id", "email"))
    return u.select("user_id", "email", mask_email(F.col("email")).alias("masked"))


@query("L8 E2", f"WITH {MARKED} SELECT user_id, posting_id, mark, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM marks", ("mark_log", "postings"))
def marks_current(spark, sf):
    m = Inputs(spark, sf).marks()
    return m.select("user_id", "posting_id", "mark", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


FOLLOWED = """
  followed AS (SELECT user_id, org_id, arg_max(following, CAST(epoch_us(logged_at) AS HUGEINT) * 1000000 + event_id) AS following, max(logged_at) AS created_at FROM follow_log GROUP BY 1, 2),
  follows AS (SELECT user_id, org_id, created_at FROM followed WHERE following AND org_id IN (SELECT org_id FROM orgs))"""


@query("L9", f"WITH {FOLLOWED} SELECT user_id, org_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM follows", ("follow_log", "orgs"))
def follows_current(spark, sf):
    f = Inputs(spark, sf).follows()
    return f.select("user_id", "org_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("L14", """SELECT user_id, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS level, CAST(floor(arg_max(value, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id)) AS BIGINT) AS min_salary,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS saves FROM events GROUP BY 1""")
def profiles_latest(spark, sf):
    e = Inputs(spark, sf).base("events")
    log = e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("logged_at"), F.col("event_type").alias("level"), F.floor("value").cast("long").alias("min_salary"))
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("saves"))
    return people.latest_profiles(log).join(n, "user_id").select(
        "user_id", "level", "min_salary", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "saves")


@query("L14", """WITH last AS (SELECT user_id, arg_max(following, CAST(epoch_us(logged_at) AS HUGEINT) * 1000000 + event_id) AS choice FROM follow_log GROUP BY 1)
    SELECT p.user_id, coalesce(l.choice, p.digest_opt_in) AS digest_opt_in FROM people p LEFT JOIN last l ON l.user_id = p.user_id""", ("people", "follow_log"))
def digest_choices(spark, sf):
    i = Inputs(spark, sf)
    log = i.raw("follow_log").withColumnRenamed("following", "opt_in")
    return people.digest_choices(i.raw("people").select("user_id", "digest_opt_in"), log).select("user_id", "digest_opt_in")
