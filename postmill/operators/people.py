"""People: cleaning what they tell us, and folding their click logs into current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.labels import normalise_email
from ..functions.patterns import java
from ..functions.text import trim


def split_list(col: Column) -> Column:
    """'python, sql ; react' to a list."""
    return F.filter(
        F.transform(F.split(F.coalesce(col, F.lit("")), r"[,;\n]"), trim), lambda x: x != ""
    )


def tidy_strings(values: Column, limit: int | None = None, chars: int | None = None) -> Column:
    """Control characters out, whitespace squeezed, first of each spelling kept.

    ``chars`` cuts each entry and ``limit`` the list; by default nothing is cut.
    """

    def tidy(v: Column) -> Column:
        bare = F.regexp_replace(v, r"[\x00-\x1f]", "")
        tight = trim(F.regexp_replace(bare, java(r"\s+", False), " "))
        return tight if chars is None else F.substring(tight, 1, chars)

    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), tidy), lambda v: v != "")
    lower = F.transform(clean, lambda v: F.lower(v))
    first = F.filter(
        F.transform(clean, lambda v, i: F.when(F.array_position(lower, F.lower(v)) == i + 1, v)),
        lambda v: v.isNotNull(),
    )
    return first if limit is None else F.slice(first, 1, limit)


def choose(values: Column, allowed) -> Column:
    return F.filter(tidy_strings(values), lambda v: v.isin(*allowed))


def whole_number(col: Column, low: int, high: int) -> Column:
    n = F.floor(col.try_cast("double") + 0.5)
    return F.when(n.between(low, high), n.cast("int"))


def sanitise_profiles(raw: DataFrame) -> DataFrame:
    """Profile rows with anything unrecognised dropped, never guessed at."""
    one_of = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c)).alias(c)
    return raw.select(
        "user_id",
        choose(F.col("roles"), list(rules.ROLE_LABELS)).alias("roles"),
        tidy_strings(F.col("locations")).alias("locations"),
        choose(F.col("work_modes"), rules.WORK_MODES).alias("work_modes"),
        choose(F.col("employment_types"), rules.EMPLOYMENT_TYPES).alias("employment_types"),
        one_of("level", rules.LEVELS),
        tidy_strings(F.col("skills")).alias("skills"),
        whole_number(F.col("years_experience"), 0, 50).alias("years_experience"),
        one_of("needs_sponsorship", rules.SPONSORSHIP_NEEDS),
        whole_number(F.col("min_salary"), 0, 1_000_000).alias("min_salary"),
        F.coalesce(F.col("hide_refusals"), F.lit(False)).alias("hide_refusals"),
    )


def valid_emails(users: DataFrame) -> DataFrame:
    return users.withColumn("email", normalise_email(F.col("email"))).where("email is not null")


def _stamp() -> Column:
    return F.struct("logged_at", "event_id")


def current_marks(log: DataFrame, postings: DataFrame) -> DataFrame:
    """Last mark per (person, posting); a null mark clears; marks on unknown postings are ignored."""
    last = log.groupBy("user_id", "posting_id").agg(F.max(F.struct("logged_at", "event_id", "mark")).alias("m"))
    kept = last.select("user_id", "posting_id", "m.mark", F.col("m.logged_at").alias("created_at"))
    kept = kept.where(F.col("mark").isin("saved", "applied", "dismissed"))
    return kept.join(postings.select("posting_id"), "posting_id", "left_semi")


def current_follows(log: DataFrame, orgs: DataFrame) -> DataFrame:
    """Employers each person follows now, since when."""
    last = log.groupBy("user_id", "org_id").agg(F.max(F.struct("logged_at", "event_id", "following")).alias("m"))
    kept = last.where("m.following").select("user_id", "org_id", F.col("m.logged_at").alias("created_at"))
    return kept.join(orgs.select("org_id"), "org_id", "left_semi")


def latest_profiles(log: DataFrame) -> DataFrame:
    """Last profile saved by each person, from a log with (user_id, logged_at, event_id, profile columns)."""
    body = [c for c in log.columns if c not in ("user_id", "logged_at", "event_id")]
    last = log.groupBy("user_id").agg(F.max_by(F.struct("logged_at", *body), _stamp()).alias("p"))
    return last.select("user_id", F.col("p.logged_at").alias("updated_at"), *[F.col(f"p.{c}").alias(c) for c in body])


def digest_choices(users: DataFrame, log: DataFrame) -> DataFrame:
    """Users with digest_opt_in set to their last choice, where they made one."""
    last = log.groupBy("user_id").agg(F.max_by("opt_in", _stamp()).alias("_choice"))
    return users.join(last, "user_id", "left").withColumn(
        "digest_opt_in", F.coalesce("_choice", "digest_opt_in")
    ).drop("_choice")


def has_preferences(for_page: bool = False) -> Column:
    """Whether there is anything to rank by. The ranked page also counts a sponsorship answer."""
    lists = F.size("roles") + F.size("locations") + F.size("skills") + F.size("work_modes")
    any_ = (lists > 0) | F.col("level").isNotNull()
    return any_ | F.col("needs_sponsorship").isNotNull() if for_page else any_
