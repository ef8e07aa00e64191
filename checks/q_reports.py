"""Reports, queues, runs, retention, export and abuse counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates, labels
from postmill.operators import reports, retention

from . import duck as d
from .bindings import NOW
from .catalog import AS_OF, Inputs, joined, query, stamp
from .q_matching import FOLLOWED, MARKED
from .q_search import VIEW, VIEW_FRAMES


@query("N8 D3 D4", f"""SELECT count(*) FILTER (status = 'live' AND first_seen_at > {NOW} - INTERVAL 36 HOUR) AS fresh,
    count(*) FILTER (status = 'live' AND changed_at > {NOW} - INTERVAL 36 HOUR AND first_seen_at <= {NOW} - INTERVAL 36 HOUR) AS updated,
    count(*) FILTER (status = 'expired' AND expired_at > {NOW} - INTERVAL 72 HOUR) AS closed, count(*) FILTER (status = 'live') AS live,
    count(DISTINCT name_key) FILTER (status = 'live') AS employers FROM postings""", ("postings",))
def today_summary(spark, sf):
    return reports.today_summary(Inputs(spark, sf).raw("postings"), AS_OF)


@query("N8 F1", f"""WITH {VIEW} SELECT posting_id, org_name, title FROM opp WHERE status = 'live' AND first_seen_at > {NOW} - INTERVAL 36 HOUR
    ORDER BY first_seen_at DESC, posting_id DESC LIMIT 30""", VIEW_FRAMES)
def today_new_roles(spark, sf):
    return reports.new_roles(Inputs(spark, sf).posting_view(), AS_OF).select("posting_id", "org_name", "title")


@query("N8 F1", f"""WITH {VIEW} SELECT posting_id, org_name, title FROM opp WHERE status = 'live' AND changed_at > {NOW} - INTERVAL 36 HOUR
    AND first_seen_at <= {NOW} - INTERVAL 36 HOUR ORDER BY changed_at DESC, posting_id DESC LIMIT 15""", VIEW_FRAMES)
def today_updated_roles(spark, sf):
    return reports.updated_roles(Inputs(spark, sf).posting_view(), AS_OF).select("posting_id", "org_name", "title")


@query("N9 C10", f"""WITH {VIEW}, {MARKED} SELECT user_id, posting_id, mark, status, n FROM (
    SELECT m.user_id, m.posting_id, m.mark, v.status, row_number() OVER (PARTITION BY m.user_id ORDER BY coalesce(v.expired_at, v.changed_at) DESC, m.posting_id DESC) AS n
    FROM marks m JOIN opp v ON v.posting_id = m.posting_id WHERE m.mark IN ('saved', 'applied')
      AND ((v.status = 'expired' AND v.expired_at > {NOW} - INTERVAL 14 DAY) OR v.changed_at > {NOW} - INTERVAL 3 DAY)) x WHERE n <= 20""", (*VIEW_FRAMES, "mark_log"))
def watch_list_changes(spark, sf):
    i = Inputs(spark, sf)
    out = reports.watch_list_changes(i.marks(), i.posting_view(), AS_OF)
    return out.select("user_id", "posting_id", "mark", "status", F.col("n").cast("long").alias("n"))


@query("N9 C7", f"""WITH {VIEW}, {FOLLOWED} SELECT user_id, posting_id, n FROM (
    SELECT f.user_id, v.posting_id, row_number() OVER (PARTITION BY f.user_id ORDER BY v.first_seen_at DESC, v.posting_id DESC) AS n
    FROM (SELECT DISTINCT f.user_id, o.name_key FROM follows f JOIN orgs o ON o.org_id = f.org_id) f JOIN opp v ON v.name_key = f.name_key
    WHERE v.status = 'live' AND v.first_seen_at > {NOW} - INTERVAL 7 DAY) x WHERE n <= 20""", (*VIEW_FRAMES, "follow_log"))
def followed_new_roles(spark, sf):
    i = Inputs(spark, sf)
    out = reports.followed_new_roles(i.follows(), i.orgs(), i.posting_view(), AS_OF)
    return out.select("user_id", "posting_id", F.col("n").cast("long").alias("n"))


@query("N10 D13 E1", """SELECT (SELECT count(*) FROM profiles WHERE resolve_status <> 'pending') AS researched,
    (SELECT count(*) FROM profiles WHERE resolve_status = 'resolved') AS websites, (SELECT count(*) FROM profiles WHERE ats_type IS NOT NULL) AS boards,
    (SELECT count(DISTINCT name_key) FROM postings WHERE status = 'live') AS employers_with_roles, (SELECT count(*) FROM postings WHERE status = 'live') AS live,
    (SELECT count(*) FROM (SELECT arg_max(ok, scan_id) AS ok FROM board_scans WHERE ok OR coalesce(http_status, 0) <> 429 GROUP BY name_key) x WHERE NOT ok) AS failing""", ("profiles", "postings", "board_scans"))
def coverage(spark, sf):
    i = Inputs(spark, sf)
    return reports.coverage(i.raw("profiles"), i.raw("postings"), i.raw("board_scans"))


@query("N10 D5", "SELECT ats_type, count(*) AS boards FROM profiles WHERE ats_type IS NOT NULL GROUP BY 1", ("profiles",))
def boards_by_platform(spark, sf):
    return reports.boards_by_platform(Inputs(spark, sf).raw("profiles"))


@query("C4 E1 N10", "SELECT name_key, arg_max(ok, scan_id) AS ok, arg_max(source, scan_id) AS source, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS started_at FROM board_scans WHERE ok OR coalesce(http_status, 0) <> 429 GROUP BY 1", ("board_scans",))
def latest_scans(spark, sf):
    return reports.latest_scan_per_employer(Inputs(spark, sf).raw("board_scans")).select("name_key", "ok", "source", stamp("started_at"))


RUNS = """
  folded AS (SELECT run_id, max(trigger_kind) AS trigger_kind, bool_and(all_steps) AS all_steps, bool_or(unfinished) AS unfinished, min(finished_at) AS started_at,
      max(finished_at) AS ended, count(*) AS steps, count(*) FILTER (status = 'failed') AS failed_steps, bool_or(status = 'failed' AND step = 'scan') AS scan_failed,
      CAST(sum(seconds) AS BIGINT) AS step_seconds, coalesce(max(boards) FILTER (step = 'scan'), 0) AS boards_scanned, coalesce(max(added) FILTER (step = 'scan'), 0) AS roles_added
    FROM run_steps GROUP BY run_id),
  runs AS (SELECT *, CASE WHEN unfinished THEN 'running' WHEN failed_steps = 0 THEN 'ok' WHEN scan_failed THEN 'failed' ELSE 'partial' END AS status,
      CAST(started_at AS DATE) AS run_date FROM folded)"""


def _runs(spark, sf):
    return reports.fold_runs(Inputs(spark, sf).raw("run_steps"))


@query("D16 I4", f"""WITH {RUNS} SELECT run_id, status, strftime(run_date, '%Y-%m-%d') AS run_date, steps, failed_steps, step_seconds, boards_scanned, roles_added FROM runs""", ("run_steps",))
def runs_folded(spark, sf):
    return _runs(spark, sf).select("run_id", "status", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "steps", "failed_steps",
                                   F.col("step_seconds").cast("long").alias("step_seconds"), "boards_scanned", "roles_added")


@query("L13", f"""WITH {RUNS} SELECT run_id, CASE WHEN status = 'running' AND started_at <= {NOW} - INTERVAL 8 HOUR THEN 'failed' ELSE status END AS status,
    CASE WHEN status = 'running' AND started_at <= {NOW} - INTERVAL 8 HOUR THEN 'abandoned: no result recorded' END AS error FROM runs""", ("run_steps",))
def runs_abandoned(spark, sf):
    return reports.abandon_stale(_runs(spark, sf), AS_OF).select("run_id", "status", "error")


@query("L13", f"""WITH {RUNS} SELECT strftime(run_date, '%Y-%m-%d') AS run_date, arg_min(run_id, (CAST(epoch_us(started_at) AS HUGEINT) * 1000000 + run_id)) AS run_id,
    arg_min(status, (CAST(epoch_us(started_at) AS HUGEINT) * 1000000 + run_id)) AS status FROM runs
    WHERE status IN ('ok', 'partial') AND trigger_kind = 'schedule' AND all_steps GROUP BY 1""", ("run_steps",))
def runs_completed_per_day(spark, sf):
    return reports.completed_run_per_day(_runs(spark, sf)).select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "run_id", "status")


@query("N11 F5 I10", f"""WITH {RUNS} SELECT run_id, status, CAST(round((epoch_us(ended) - epoch_us(started_at)) / 1000000.0) AS BIGINT) AS seconds FROM runs
    ORDER BY started_at DESC, run_id DESC LIMIT 14""", ("run_steps",))
def runs_recent(spark, sf):
    return reports.recent_runs(_runs(spark, sf)).select("run_id", "status", "seconds")


@query("N11 I10", f"""WITH {RUNS} SELECT CAST(round((epoch_us({NOW}) - epoch_us(max(ended))) / 3600000000.0) AS INTEGER) AS hours,
    round((epoch_us({NOW}) - epoch_us(max(ended))) / 3600000000.0) > 30 AS stale FROM runs WHERE status IN ('ok', 'partial')""", ("run_steps",))
def runs_stale_hours(spark, sf):
    return reports.hours_since_good_run(_runs(spark, sf), AS_OF)


@query("I4", """SELECT CAST(hour(finished_at) AS INTEGER) AS uk_hour, hour(finished_at) BETWEEN 8 AND 13 AS in_window, status, count(*) AS steps,
    CAST(sum(seconds) AS BIGINT) AS seconds FROM run_steps GROUP BY 1, 2, 3""", ("run_steps",))
def run_window(spark, sf):
    return reports.run_window_report(Inputs(spark, sf).raw("run_steps"))


@query("N15 D5", f"""WITH {MARKED} SELECT user_id, count(*) FILTER (mark = 'saved') AS saved, count(*) FILTER (mark = 'applied') AS applied,
    count(*) FILTER (mark = 'dismissed') AS dismissed FROM marks GROUP BY 1""", ("mark_log", "postings"))
def saved_counts(spark, sf):
    return reports.saved_counts(Inputs(spark, sf).marks())


@query("N15 C10", f"""WITH {VIEW}, {MARKED} SELECT user_id, posting_id, mark, title, org_name, v.status FROM marks m JOIN opp v USING (posting_id)""", (*VIEW_FRAMES, "mark_log"))
def saved_postings(spark, sf):
    i = Inputs(spark, sf)
    return reports.saved_postings(i.marks(), i.posting_view()).select("user_id", "posting_id", "mark", "title", "org_name", "status")


@query("N15 C11", f"""WITH {FOLLOWED} SELECT f.user_id, f.org_id, o.name, o.town, p.website, p.careers_url,
    (SELECT count(*) FROM postings x WHERE x.name_key = o.name_key AND x.status = 'live') AS live
    FROM follows f JOIN orgs o ON o.org_id = f.org_id LEFT JOIN profiles p ON p.name_key = o.name_key""", ("follow_log", "orgs", "profiles", "postings"))
def followed_orgs(spark, sf):
    i = Inputs(spark, sf)
    out = reports.followed_orgs(i.follows(), i.raw("orgs"), i.raw("profiles"), i.raw("postings"))
    return out.select("user_id", "org_id", "name", "town", "website", "careers_url", "live")


_LATEST = """latest AS (SELECT posting_id, org_id FROM opp WHERE status = 'live' ORDER BY coalesce(posted_at, first_seen_at) DESC, posting_id DESC LIMIT 20)"""


def _latest_page(i):
    from postmill.operators.search import PostingFilters, posting_page

    return posting_page(i.posting_view(), PostingFilters(), AS_OF)


@query("C16", f"""WITH {VIEW}, {MARKED}, {_LATEST} SELECT user_id, posting_id, mark FROM marks WHERE posting_id IN (SELECT posting_id FROM latest)""",
       (*VIEW_FRAMES, "mark_log"))
def page_marks(spark, sf):
    i = Inputs(spark, sf)
    return reports.marks_on_page(i.marks(), _latest_page(i)).select("user_id", "posting_id", "mark")


@query("C16", f"""WITH {VIEW}, {FOLLOWED}, {_LATEST} SELECT user_id, org_id FROM follows WHERE org_id IN (SELECT org_id FROM latest)""", (*VIEW_FRAMES, "follow_log"))
def page_follows(spark, sf):
    i = Inputs(spark, sf)
    return reports.follows_on_page(i.follows(), _latest_page(i)).select("user_id", "org_id")


# ---------------------------------------------------------------- queues
@query("N12 F2", f"""SELECT user_id FROM people WHERE digest_opt_in AND (last_digest_at IS NULL OR last_digest_at < {NOW} - INTERVAL 6 DAY)
    ORDER BY last_digest_at NULLS FIRST, user_id""", ("people",))
def queue_digests(spark, sf):
    return reports.due_digests(Inputs(spark, sf).raw("people"), AS_OF).select("user_id")


@query("N12 C4 F2", f"""WITH l AS (SELECT name_key, arg_max(ok, scan_id) AS ok, max(started_at) AS at_ FROM board_scans WHERE ok OR coalesce(http_status, 0) <> 429 GROUP BY 1)
    SELECT p.name_key, p.ats_slug, l.ok FROM profiles p LEFT JOIN l ON l.name_key = p.name_key WHERE ats_type IS NOT NULL AND ats_slug IS NOT NULL
      AND (at_ IS NULL OR (ok AND at_ < {NOW} - INTERVAL 20 HOUR) OR (NOT ok AND at_ < {NOW} - INTERVAL 3 DAY)) ORDER BY at_ NULLS FIRST, p.name_key""", ("profiles", "board_scans"))
def queue_scans(spark, sf):
    i = Inputs(spark, sf)
    return reports.due_scans(i.raw("profiles"), i.raw("board_scans"), AS_OF).select("name_key", "ats_slug", "ok")


@query("N12 F3", f"""SELECT name_key, resolve_status FROM profiles WHERE ats_type IS NULL AND (ats_probed_at IS NULL OR ats_probed_at < {NOW} - INTERVAL 30 DAY)
    ORDER BY (resolve_status = 'resolved') DESC, ats_probed_at NULLS FIRST, name_key""", ("profiles",))
def queue_probes(spark, sf):
    return reports.due_probes(Inputs(spark, sf).raw("profiles"), AS_OF).select("name_key", "resolve_status")


@query("N12 F2", f"""SELECT name_key, careers_url FROM profiles WHERE careers_url IS NOT NULL AND ats_type IS NULL
    AND (jsonld_checked_at IS NULL OR jsonld_checked_at < {NOW} - INTERVAL 30 DAY) ORDER BY jsonld_checked_at NULLS FIRST, name_key""", ("profiles",))
def queue_discovery(spark, sf):
    return reports.due_discovery(Inputs(spark, sf).raw("profiles"), AS_OF).select("name_key", "careers_url")


@query("N12 D8", f"""SELECT o.name_key, arg_min(o.name, o.org_id) AS name, arg_min(o.town, o.org_id) AS town, count(*) AS branches
    FROM orgs o LEFT JOIN profiles p ON p.name_key = o.name_key
    WHERE o.status = 'active' AND list_contains(CASE WHEN p.sectors_computed_at IS NOT NULL THEN {d.list_of('p.profile_tags')} ELSE {d.list_of('o.sector_tags')} END, 'tech')
      AND (p.name_key IS NULL OR p.resolve_status = 'pending' OR (p.resolve_status IN ('not_found', 'error') AND p.updated_at < {NOW} - INTERVAL 30 DAY))
    GROUP BY 1 ORDER BY branches DESC, 1""", ("orgs", "profiles"))
def queue_research(spark, sf):
    return reports.due_research(Inputs(spark, sf).org_view(), AS_OF, retry=True).select("name_key", "name", "town", "branches")


@query("N12 N7", f"""SELECT CAST((epoch_us({NOW}) - epoch_us(max(finished_at))) // 86400000000 AS INTEGER) AS days,
    (epoch_us({NOW}) - epoch_us(max(finished_at))) // 86400000000 >= 6 AS due FROM run_steps WHERE step = 'register' AND status = 'ok'""", ("run_steps",))
def queue_register(spark, sf):
    return reports.register_due(Inputs(spark, sf).raw("run_steps").where("step = 'register' and status = 'ok'"), AS_OF)


@query("N7 F5", """SELECT strftime(max(finished_at), '%Y-%m-%d') AS published_on FROM run_steps WHERE step = 'register' AND status = 'ok'""", ("run_steps",))
def latest_register(spark, sf):
    from postmill.operators.search import latest_register as latest

    log = Inputs(spark, sf).raw("run_steps").where("step = 'register' and status = 'ok'").withColumn("published_on", F.to_date("finished_at"))
    return latest(log.select("published_on", "finished_at").distinct()).select(F.date_format("published_on", "yyyy-MM-dd").alias("published_on"))


# ---------------------------------------------------------------- abuse counters
_BUCKET = "CASE WHEN contains(ip, ':') THEN concat('2001:db8:', string_split(ip, ':')[3], ':0') ELSE ip END"
_REQ_NOW = "(SELECT max(created_at) FROM requests)"


@query("D15 H22", f"""WITH r AS (SELECT *, {_BUCKET} AS client, created_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR AS recent FROM requests),
    k AS (SELECT 'email' AS kind, email AS key, recent FROM r UNION ALL SELECT 'email_client', concat(email, ' ', client), recent FROM r UNION ALL SELECT 'client', client, recent FROM r)
    SELECT kind, key, count(*) FILTER (recent) AS recent, count(*) AS total FROM k GROUP BY 1, 2""", ("requests",))
def abuse_counts(spark, sf):
    return reports.request_counts(Inputs(spark, sf).raw("requests"), "2024-01-30 12:00:00")


_LIMITS = {"email": 2, "email_client": 2, "client": 4, "day": 10_000}


@query("D15 N3", f"""WITH r AS (SELECT email, {_BUCKET} AS client, created_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR AS recent,
      created_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY AS late FROM requests),
    p AS (SELECT DISTINCT email, client FROM r)
    SELECT *, CASE WHEN today >= {_LIMITS['day']} THEN 'daily_cap' WHEN by_email >= {_LIMITS['email']} OR by_email_client >= {_LIMITS['email_client']} OR by_client >= {_LIMITS['client']}
      THEN 'dropped' ELSE 'allowed' END AS decision FROM (
    SELECT p.email, p.client, (SELECT count(*) FILTER (recent) FROM r WHERE r.email = p.email) AS by_email,
      (SELECT count(*) FILTER (recent) FROM r WHERE r.email = p.email AND r.client = p.client) AS by_email_client,
      (SELECT count(*) FILTER (recent) FROM r WHERE r.client = p.client) AS by_client, (SELECT count(*) FILTER (late) FROM r) AS today FROM p) x""", ("requests",))
def abuse_decisions(spark, sf):
    return reports.request_decisions(Inputs(spark, sf).raw("requests"), "2024-01-30 12:00:00", _LIMITS)


# ---------------------------------------------------------------- retention
@query("L10 C6", f"""WITH {MARKED} SELECT posting_id, status = 'expired' AND expired_at < {NOW} - INTERVAL 60 DAY
    AND posting_id NOT IN (SELECT posting_id FROM marks WHERE mark IN ('saved', 'applied')) AS removed FROM postings""", ("postings", "mark_log"))
def retention_postings(spark, sf):
    i = Inputs(spark, sf)
    return retention.mark_postings(i.raw("postings"), i.marks(), AS_OF).select("posting_id", "removed")


def _counts(name: str, table: str, old: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) FILTER ({old}) AS removed, count(*) FILTER (NOT ({old})) AS kept FROM {table}"


@query("L10", " UNION ALL ".join([
    _counts("scan_log", "board_scans", f"started_at < {NOW} - INTERVAL 3 DAY"), _counts("run_log", "run_steps", f"finished_at < {NOW} - INTERVAL 20 DAY"),
    _counts("sign_in_requests", "requests", f"created_at < {NOW} - INTERVAL 2 DAY"), _counts("sessions", "requests", f"expires_at < {NOW}")]), ("board_scans", "run_steps", "requests"))
def retention_counts(spark, sf):
    i = Inputs(spark, sf)
    return retention.removed_counts({
        "scan_log": retention.mark_older(i.raw("board_scans"), "started_at", AS_OF, 3),
        "run_log": retention.mark_older(i.raw("run_steps"), "finished_at", AS_OF, 20),
        "sign_in_requests": retention.mark_older(i.raw("requests"), "created_at", AS_OF, retention.TOKEN_DAYS),
        "sessions": retention.mark_expired_sessions(i.raw("requests"), AS_OF),
    })


@query("L11", f"""WITH {MARKED}, {FOLLOWED}, gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0)
    SELECT 'profiles' AS table_name, count(*) AS kept FROM people WHERE user_id NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'marks', count(*) FROM marks WHERE user_id NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'follows', count(*) FROM follows WHERE user_id NOT IN (SELECT user_id FROM gone)
    UNION ALL SELECT 'requests', count(*) FROM requests WHERE user_id NOT IN (SELECT user_id FROM gone)""", ("people", "mark_log", "follow_log", "postings", "orgs", "requests"))
def account_erasure(spark, sf):
    i = Inputs(spark, sf)
    gone = i.base("customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("user_id"), F.concat(F.lit("user"), "c_custkey", F.lit("@example.org")).alias("email"))
    left = retention.erase({"profiles": i.raw("people").drop("email"), "marks": i.marks(), "follows": i.follows(),
                            "requests": i.raw("requests").drop("user_id")}, gone)
    parts = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("table_name"), "kept") for n, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A23", f"""WITH {MARKED}, {FOLLOWED}, n AS (SELECT name_key, arg_min(name, org_id) AS employer FROM orgs GROUP BY 1)
    SELECT user_id, 'account' AS section, CAST(NULL AS VARCHAR) AS item_at, lower(trim(email)) AS shown FROM people
    UNION ALL SELECT user_id, 'profile', NULL, roles FROM people
    UNION ALL SELECT m.user_id, 'saved_opportunities', strftime(m.created_at, '%Y-%m-%d %H:%M:%S'), concat(m.mark, ' ', p.title, ' ', n.employer) FROM marks m JOIN postings p USING (posting_id) JOIN n ON n.name_key = p.name_key
    UNION ALL SELECT f.user_id, 'saved_organisations', strftime(f.created_at, '%Y-%m-%d %H:%M:%S'), concat(o.name, ' ', o.town) FROM follows f JOIN orgs o USING (org_id)
    UNION ALL SELECT user_id, 'signed_in_devices', strftime(created_at, '%Y-%m-%d %H:%M:%S'), strftime(expires_at, '%Y-%m-%d %H:%M') FROM requests""",
       ("people", "mark_log", "follow_log", "orgs", "postings", "requests"))
def export_people(spark, sf):
    i = Inputs(spark, sf)
    users = i.raw("people").select("user_id", labels.normalise_email(F.col("email")).alias("email"), "last_digest_at")
    out = retention.export_people(users, i.raw("people").select("user_id", "roles", "level"), i.marks(), i.raw("postings"), i.raw("orgs"), i.follows(),
                                  i.raw("requests").select("user_id", "created_at", "expires_at"))
    g = lambda k: F.get_json_object("item", f"$.{k}")
    shown = (F.when(F.col("section") == "account", g("email")).when(F.col("section") == "profile", g("roles"))
             .when(F.col("section") == "saved_opportunities", F.concat_ws(" ", g("mark"), g("title"), g("employer")))
             .when(F.col("section") == "saved_organisations", F.concat_ws(" ", g("name"), g("town")))
             .otherwise(F.date_format(g("expires_at").cast("timestamp"), "yyyy-MM-dd HH:mm")))
    return out.select("user_id", "section", stamp("at", "item_at"), shown.alias("shown"))
