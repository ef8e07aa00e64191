"""What is kept for how long, what goes when a person leaves, and what they may take along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates

CLOSED_DAYS, SCAN_DAYS, RUN_DAYS, TOKEN_DAYS = 60, 30, 180, 2


def _split(df: DataFrame, old) -> DataFrame:
    return df.withColumn("removed", F.coalesce(old, F.lit(False)))


def mark_postings(postings: DataFrame, marks: DataFrame, as_of) -> DataFrame:
    """Flag closed postings past their time, unless somebody saved or applied to them."""
    wanted = marks.where(F.col("mark").isin("saved", "applied")).select("posting_id").distinct()
    old = (F.col("status") == "expired") & (F.col("expired_at") < dates.days_before(as_of, CLOSED_DAYS))
    kept = wanted.withColumn("_wanted", F.lit(True))
    return _split(postings.join(kept, "posting_id", "left"), old & F.col("_wanted").isNull()).drop("_wanted")


def trim_postings(postings: DataFrame, marks: DataFrame, as_of) -> DataFrame:
    return mark_postings(postings, marks, as_of).where(~F.col("removed")).drop("removed")


def mark_older(log: DataFrame, column: str, as_of, days: int) -> DataFrame:
    return _split(log, F.col(column) < dates.days_before(as_of, days))


def mark_expired_sessions(sessions: DataFrame, as_of) -> DataFrame:
    return _split(sessions, F.col("expires_at") < dates.instant(as_of))


def removed_counts(flagged: dict[str, DataFrame]) -> DataFrame:
    """Removed and kept rows per table."""
    parts = [
        df.agg(F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"))
        .select(F.lit(name).alias("table_name"), "removed", "kept")
        for name, df in flagged.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erase(tables: dict[str, DataFrame], erased: DataFrame) -> dict[str, DataFrame]:
    """Every user table without the erased people; sign-in requests go by address."""
    ids = erased.select("user_id")
    out = {}
    for name, df in tables.items():
        if "user_id" in df.columns:
            out[name] = df.join(ids, "user_id", "left_anti")
        else:
            out[name] = df.join(erased.select("email"), "email", "left_anti")
    return out


def export_people(users: DataFrame, profiles: DataFrame, marks: DataFrame, postings: DataFrame, orgs: DataFrame,
                  follows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Everything held on each person, as JSON items: (user_id, section, at, item).

    One job for all people. Items stay separate rows, so nobody's history, however
    long, has to fit in one task; sorted by (user_id, section, at descending) they
    are the person's document.
    """
    first_name = orgs.groupBy("name_key").agg(F.min_by("name", "org_id").alias("employer"))
    titles = postings.select("posting_id", "name_key", "title", "apply_url").join(first_name, "name_key")
    none = F.lit(None).cast("timestamp")

    def items(df: DataFrame, section: str, at, *columns: str) -> DataFrame:
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return df.select("user_id", F.lit(section).alias("section"), at.alias("at"), body.alias("item"))

    preferences = [c for c in profiles.columns if c not in ("user_id", "email")]
    at = F.col("created_at")
    return (
        items(users, "account", none, "email", "last_digest_at")
        .unionByName(items(profiles, "profile", none, *preferences))
        .unionByName(items(marks.join(titles, "posting_id"), "saved_opportunities", at, "mark", "title", "apply_url", "employer"))
        .unionByName(items(follows.join(orgs.select("org_id", "name", "town"), "org_id"), "saved_organisations", at, "name", "town"))
        .unionByName(items(sessions, "signed_in_devices", at, "expires_at"))
    )
