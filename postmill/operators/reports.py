"""Reports: today, watch lists, coverage, runs, digests, due queues, abuse counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, labels, rules
from ..functions.text import lookup, trim
from .search import org_counts

NEW_HOURS = 36


# ---------------------------------------------------------------- today
def today_summary(postings: DataFrame, as_of) -> DataFrame:
    recent = dates.hours_before(as_of, NEW_HOURS)
    live = F.col("status") == "live"
    return postings.agg(
        F.count_if(live & (F.col("first_seen_at") > recent)).alias("fresh"),
        F.count_if(live & (F.col("changed_at") > recent) & (F.col("first_seen_at") <= recent)).alias("updated"),
        F.count_if((F.col("status") == "expired") & (F.col("expired_at") > dates.hours_before(as_of, 72))).alias("closed"),
        F.count_if(live).alias("live"),
        F.countDistinct(F.when(live, F.col("name_key"))).alias("employers"),
    )


def new_roles(view: DataFrame, as_of, limit: int = 30) -> DataFrame:
    recent = dates.hours_before(as_of, NEW_HOURS)
    hits = view.where((F.col("status") == "live") & (F.col("first_seen_at") > recent))
    return hits.orderBy(F.col("first_seen_at").desc(), F.col("posting_id").desc()).limit(limit)


def updated_roles(view: DataFrame, as_of, limit: int = 15) -> DataFrame:
    recent = dates.hours_before(as_of, NEW_HOURS)
    hits = view.where(
        (F.col("status") == "live") & (F.col("changed_at") > recent) & (F.col("first_seen_at") <= recent)
    )
    return hits.orderBy(F.col("changed_at").desc(), F.col("posting_id").desc()).limit(limit)


def _newest_per_person(df: DataFrame, when: Column, limit: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(when.desc(), F.col("posting_id").desc())
    return df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def watch_list_changes(marks: DataFrame, view: DataFrame, as_of, limit: int = 20) -> DataFrame:
    """For everyone: postings they saved or applied to that closed or changed lately."""
    closed = (F.col("status") == "expired") & (F.col("expired_at") > dates.days_before(as_of, 14))
    changed = F.col("changed_at") > dates.days_before(as_of, 3)
    moved = view.where(F.coalesce(closed, F.lit(False)) | F.coalesce(changed, F.lit(False)))
    mine = marks.where(F.col("mark").isin("saved", "applied")).select("user_id", "posting_id", "mark")
    return _newest_per_person(mine.join(moved, "posting_id"), F.coalesce("expired_at", "changed_at"), limit)


def followed_new_roles(follows: DataFrame, orgs: DataFrame, view: DataFrame, as_of, limit: int = 20) -> DataFrame:
    """For everyone: live postings of the last week at employers they follow.

    Only the newest ``limit`` per employer can be among anyone's newest ``limit``,
    so an employer with very many postings is cut down before it meets its followers.
    """
    recent = view.where((F.col("status") == "live") & (F.col("first_seen_at") > dates.days_before(as_of, 7)))
    order = Window.partitionBy("name_key").orderBy(F.col("first_seen_at").desc(), F.col("posting_id").desc())
    newest = recent.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    employers = follows.join(orgs.select("org_id", "name_key"), "org_id").select("user_id", "name_key").distinct()
    return _newest_per_person(employers.join(newest.drop("org_id"), "name_key"), F.col("first_seen_at"), limit)


# ---------------------------------------------------------------- coverage
def without_deferred(scans: DataFrame) -> DataFrame:
    """Scans without those that a board put off (HTTP 429): being told to wait is no failure and is not logged."""
    return scans.where("ok or coalesce(http_status, 0) <> 429") if "http_status" in scans.columns else scans


def latest_scan_per_employer(scans: DataFrame) -> DataFrame:
    return without_deferred(scans).groupBy("name_key").agg(
        F.max_by(F.struct("ok", "started_at", "source"), F.struct("started_at", "source")).alias("s")
    ).select("name_key", "s.*")


def coverage(profiles: DataFrame, postings: DataFrame, scans: DataFrame) -> DataFrame:
    """How much of the market is visible, in one row of three aggregates."""
    live = postings.where("status = 'live'")
    p = profiles.agg(
        F.count_if(F.col("resolve_status") != "pending").alias("researched"),
        F.count_if(F.col("resolve_status") == "resolved").alias("websites"),
        F.count_if(F.col("ats_type").isNotNull()).alias("boards"),
    )
    employers = live.agg(F.countDistinct("name_key")).scalar()
    postings_live = live.agg(F.count(F.lit(1))).scalar()
    failing = latest_scan_per_employer(scans).agg(F.count_if(~F.col("ok"))).scalar()
    return p.select(
        "*", employers.alias("employers_with_roles"), postings_live.alias("live"), failing.alias("failing")
    )


def boards_by_platform(profiles: DataFrame) -> DataFrame:
    known = profiles.where("ats_type is not null")
    return known.groupBy("ats_type").agg(F.count(F.lit(1)).alias("boards"))


# ---------------------------------------------------------------- runs
def fold_runs(steps: DataFrame) -> DataFrame:
    """One row per run from its step rows: status, duration, scan numbers.

    A run fails when its scan failed, is partial when anything else did.
    """
    failed = F.col("status") == "failed"
    scan = F.col("step") == "scan"
    number = lambda c: F.coalesce(F.max(F.when(scan, F.col(c))), F.lit(0))
    folded = steps.groupBy("run_id").agg(
        F.max("trigger_kind").alias("trigger_kind"),
        F.bool_and("all_steps").alias("all_steps"),
        F.bool_or("unfinished").alias("unfinished"),
        F.min("finished_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(failed).alias("failed_steps"),
        F.bool_or(failed & scan).alias("scan_failed"),
        F.sum("seconds").alias("step_seconds"),
        number("boards").alias("boards_scanned"),
        number("added").alias("roles_added"),
    )
    return folded.withColumn(
        "status",
        F.when(F.col("unfinished"), "running")
        .when(F.col("failed_steps") == 0, "ok")
        .when(F.col("scan_failed"), "failed")
        .otherwise("partial"),
    ).withColumn("run_date", dates.london_date(F.col("started_at")))


def abandon_stale(runs: DataFrame, as_of, hours: int = 8) -> DataFrame:
    """A run still 'running' after ``hours`` gave no result: relabel it failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") <= dates.hours_before(as_of, hours))
    return runs.withColumn("error", F.when(stale, "abandoned: no result recorded")).withColumn(
        "status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
    )


def completed_run_per_day(runs: DataFrame) -> DataFrame:
    """The first completed scheduled full run of each UK day."""
    done = runs.where(F.col("status").isin("ok", "partial") & (F.col("trigger_kind") == "schedule") & F.col("all_steps"))
    return done.groupBy("run_date").agg(
        F.min_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("r")
    ).select("run_date", "r.*")


def recent_runs(runs: DataFrame, limit: int = 14) -> DataFrame:
    seconds = F.round(dates.elapsed_seconds(F.col("finished_at"), F.col("started_at"))).cast("long")
    return runs.withColumn("seconds", seconds).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def hours_since_good_run(runs: DataFrame, as_of) -> DataFrame:
    """Hours since the last completed run; stale beyond thirty."""
    hours = dates.elapsed_seconds(as_of, F.max("finished_at")) / 3600
    return runs.where(F.col("status").isin("ok", "partial")).agg(F.round(hours).cast("int").alias("hours")).withColumn(
        "stale", F.col("hours") > 30
    )


def run_window_report(steps: DataFrame) -> DataFrame:
    """Step outcomes by UK hour, and whether that hour is inside the morning window."""
    ts = F.col("finished_at")
    return steps.groupBy(
        dates.london_hour(ts).alias("uk_hour"), dates.in_run_window(ts).alias("in_window"), "status"
    ).agg(F.count(F.lit(1)).alias("steps"), F.sum("seconds").cast("long").alias("seconds"))


# ---------------------------------------------------------------- saved page
def saved_counts(marks: DataFrame) -> DataFrame:
    """Marks of each person by kind, one row per person."""
    return marks.groupBy("user_id").pivot("mark", ["saved", "applied", "dismissed"]).count().na.fill(0)


def saved_postings(marks: DataFrame, view: DataFrame) -> DataFrame:
    return marks.join(view, "posting_id")


def followed_orgs(follows: DataFrame, orgs: DataFrame, profiles: DataFrame, postings: DataFrame) -> DataFrame:
    """Employers each person follows, with links and live postings."""
    live = org_counts(postings).select("name_key", "live")
    links = profiles.select("name_key", "website", "careers_url")
    return (
        follows.join(orgs.select("org_id", "name_key", "name", "town"), "org_id")
        .join(links, "name_key", "left")
        .join(live, "name_key", "left")
        .withColumn("live", F.coalesce("live", F.lit(0)).cast("long"))
    )


def marks_on_page(marks: DataFrame, page: DataFrame) -> DataFrame:
    """Everyone's marks on the postings of one page."""
    return marks.join(page.select("posting_id"), "posting_id", "left_semi")


def follows_on_page(follows: DataFrame, page: DataFrame) -> DataFrame:
    """Who follows an employer shown on one page."""
    return follows.join(page.select("org_id"), "org_id", "left_semi")


# ---------------------------------------------------------------- queues
def due_digests(users: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    due = users.where("digest_opt_in").where(
        F.col("last_digest_at").isNull() | (F.col("last_digest_at") < dates.days_before(as_of, 6))
    )
    ordered = due.orderBy(F.col("last_digest_at").asc_nulls_first(), "user_id")
    return ordered.limit(limit) if limit else due


def due_scans(profiles: DataFrame, scans: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Boards to fetch next: never fetched first; a failed one rests for three days."""
    last = latest_scan_per_employer(scans).select("name_key", "ok", "started_at")
    q = profiles.where("ats_type is not null and ats_slug is not null").join(last, "name_key", "left")
    due = q.where(
        F.col("started_at").isNull()
        | (F.col("ok") & (F.col("started_at") < dates.hours_before(as_of, 20)))
        | (~F.col("ok") & (F.col("started_at") < dates.days_before(as_of, 3)))
    )
    ordered = due.orderBy(F.col("started_at").asc_nulls_first(), "name_key")
    return ordered.limit(limit) if limit else due


def due_probes(profiles: DataFrame, as_of, limit: int | None = None, retry_days: int = 30) -> DataFrame:
    """Employers whose likely board addresses should be tried; resolved ones first."""
    due = profiles.where("ats_type is null").where(
        F.col("ats_probed_at").isNull() | (F.col("ats_probed_at") < dates.days_before(as_of, retry_days))
    )
    ordered = due.orderBy(
        (F.col("resolve_status") == "resolved").desc(), F.col("ats_probed_at").asc_nulls_first(), "name_key"
    )
    return ordered.limit(limit) if limit else due


def due_discovery(profiles: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Careers pages to look through for structured postings."""
    due = profiles.where("careers_url is not null and ats_type is null").where(
        F.col("jsonld_checked_at").isNull() | (F.col("jsonld_checked_at") < dates.days_before(as_of, 30))
    )
    ordered = due.orderBy(F.col("jsonld_checked_at").asc_nulls_first(), "name_key")
    return ordered.limit(limit) if limit else due


def due_research(view: DataFrame, as_of, tag: str = "tech", retry: bool = False, limit: int | None = None) -> DataFrame:
    """Employers with a tag that nobody has researched, those with most branches first."""
    open_ = F.col("resolve_status").isNull() | (F.col("resolve_status") == "pending")
    if retry:
        old = F.col("profile_updated_at") < dates.days_before(as_of, 30)
        open_ = open_ | (F.col("resolve_status").isin("not_found", "error") & old)
    rows = view.where("status = 'active'").where(F.array_contains("all_sector_tags", tag)).where(open_)
    grouped = rows.groupBy("name_key").agg(
        F.min_by(F.struct("name", "town", "county"), "org_id").alias("o"), F.count(F.lit(1)).alias("branches")
    ).select("name_key", "o.*", "branches")
    ordered = grouped.orderBy(F.col("branches").desc(), "name_key")
    return ordered.limit(limit) if limit else ordered


def register_due(log: DataFrame, as_of, days: int = 6) -> DataFrame:
    """Days since the last finished import and whether another is due."""
    age = dates.elapsed_days(as_of, F.max("finished_at"))
    return log.agg(age.alias("days")).withColumn("due", F.col("days").isNull() | (F.col("days") >= days))


# ---------------------------------------------------------------- digests
def with_look_back(users: DataFrame, as_of) -> DataFrame:
    return users.withColumn("since_hours", dates.digest_lookback_hours(F.col("last_digest_at"), as_of))


def digest_lines(best: DataFrame, view: DataFrame) -> DataFrame:
    """One digest per person from their best postings (user_id, posting_id, score, rank, reasons)."""
    show = view.select("posting_id", "title", "org_name", "city", "location_raw", "role_family", "apply_url")
    rows = best.join(show, "posting_id")
    place = F.coalesce("city", F.split_part(F.col("location_raw"), F.lit(" | "), F.lit(1)))
    helped = F.transform(F.slice(F.filter("reasons", lambda r: r["kind"] == "+"), 1, 3), lambda r: r["text"])
    why = F.when(F.size(helped) > 0, F.concat(F.lit("   Why: "), F.array_join(helped, "; ")))
    line = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". "), "title", F.lit(" at "), trim(F.col("org_name")),
                 F.lit(" ("), F.col("score").cast("string"), F.lit("% match)")),
        F.concat(F.lit("   "), place, F.lit(" · "), lookup(rules.ROLE_LABELS, F.col("role_family"))),
        why,
        F.concat(F.lit("   Apply: "), "apply_url"),
    )
    # At most five lines a person, so the list is bounded.
    return rows.withColumn("line", line).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("postings"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n")
        .alias("body"),
    ).withColumn(
        "subject",
        F.concat(F.col("postings").cast("string"), F.lit(" new role"), F.when(F.col("postings") == 1, "").otherwise("s"),
                 F.lit(" that fit you")),
    )


def digest_outcomes(due: DataFrame, digests: DataFrame) -> DataFrame:
    sent = digests.select("user_id").withColumn("_sent", F.lit(True))
    has = F.col("_sent").isNotNull()
    return due.join(sent, "user_id", "left").agg(
        F.count(F.lit(1)).alias("due"), F.count_if(has).alias("sent"), F.count_if(~has).alias("nothing_to_send")
    )


# ---------------------------------------------------------------- abuse counters
def request_counts(requests: DataFrame, as_of) -> DataFrame:
    """Requests in the last hour by address, by address and client, and by client."""
    hour = F.col("created_at") > dates.hours_before(as_of, 1)
    return _request_counts(requests.withColumn("client", labels.address_bucket(F.col("ip"))), hour)


def _request_counts(requests: DataFrame, recent: Column) -> DataFrame:
    # One pass: each request counts once under each of the three keys.
    keyed = requests.withColumn("_recent", recent).select(
        "_recent",
        F.inline(F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), key.alias("key"))
                for kind, key in (
                    ("email", F.col("email")),
                    ("email_client", F.concat_ws(" ", "email", "client")),
                    ("client", F.col("client")),
                )
            ]
        )),
    )
    return keyed.groupBy("kind", "key").agg(
        F.count_if("_recent").alias("recent"), F.count(F.lit(1)).alias("total")
    )


def request_decisions(requests: DataFrame, as_of, limits: dict[str, int]) -> DataFrame:
    """For every (email, client) that ever asked: the four counters and what they decide about one more request.

    limits: ``email``, ``email_client`` and ``client`` per hour, ``day`` for all requests
    of one day together. A reached day limit decides first (``daily_cap``), then any
    of the hourly ones (``dropped``); else the request is ``allowed``.
    """
    asked = requests.withColumn("client", labels.address_bucket(F.col("ip")))
    recent = F.count_if(F.col("created_at") > dates.hours_before(as_of, 1))
    pairs = asked.groupBy("email", "client").agg(recent.alias("by_email_client"))
    emails = pairs.groupBy("email").agg(F.sum("by_email_client").alias("by_email"))
    clients = pairs.groupBy("client").agg(F.sum("by_email_client").alias("by_client"))
    today = asked.where(F.col("created_at") > dates.days_before(as_of, 1)).agg(F.count(F.lit(1))).scalar()
    counted = pairs.join(emails, "email").join(clients, "client").select("email", "client", "by_email", "by_email_client", "by_client", today.alias("today"))
    over = (F.col("by_email") >= limits["email"]) | (F.col("by_email_client") >= limits["email_client"]) | (F.col("by_client") >= limits["client"])
    return counted.withColumn("decision", F.when(F.col("today") >= limits["day"], "daily_cap").when(over, "dropped").otherwise("allowed"))


def requests_over_limit(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Keys at or above the limit of their kind."""
    return counts.where(F.col("recent") >= lookup(limits, F.col("kind")))
