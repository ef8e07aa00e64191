"""Dates and ages. Nothing reads the clock: 'now' is always the ``as_of`` argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

# Month abbreviations used in register file names.
MONTHS = {m: i + 1 for i, m in enumerate(
    ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}
LONDON = "Europe/London"


def instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def hours_before(as_of, hours) -> Column:
    n = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_seconds(F.unix_seconds(instant(as_of)) - n.cast("bigint") * 3600)


def days_before(as_of, days) -> Column:
    n = days if isinstance(days, Column) else F.lit(days)
    return hours_before(as_of, n * 24)


def elapsed_seconds(later, earlier: Column) -> Column:
    return (F.unix_micros(instant(later)) - F.unix_micros(earlier)) / F.lit(1e6)


def elapsed_days(later, earlier: Column) -> Column:
    """Whole elapsed days, as opposed to calendar days; truncates toward zero."""
    days = elapsed_seconds(later, earlier) / F.lit(86400.0)
    return F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days)).cast("int")


def published_on(file_name: Column) -> Column:
    """Publication date in a register file name: '2026-09-30' or 'Sept 30 2026'."""
    iso = F.regexp_extract(file_name, r"(\d{4}-\d{2}-\d{2})", 1)
    worded = r"([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})"
    month = lookup(MONTHS, F.lower(F.regexp_extract(file_name, worded, 1)))
    day = F.regexp_extract(file_name, worded, 2).try_cast("int")
    year = F.regexp_extract(file_name, worded, 3).try_cast("int")
    spelled = F.format_string("%04d-%02d-%02d", year, month, day)
    spelled = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), spelled)
    return F.coalesce(F.when(iso != "", iso).try_cast("date"), spelled.try_cast("date"))


def uk_date(text: Column) -> Column:
    """dd/mm/yyyy to a date; anything else is null."""
    shape = r"^(\d{2})/(\d{2})/(\d{4})$"
    part = lambda i: F.regexp_extract(F.trim(text), shape, i)
    return F.when(F.trim(text).rlike(shape), F.concat_ws("-", part(3), part(2), part(1)).try_cast("date"))


def relative_posting_date(text: Column, as_of) -> Column:
    """'Posted 3 Days Ago', 'today', 'yesterday', '30+ days' to an instant."""
    t = F.lower(text)
    counted = F.regexp_extract(t, r"(\d+)\+?\s*days?", 1).try_cast("int")
    days = F.when(F.contains(t, F.lit("today")), 0).when(F.contains(t, F.lit("yesterday")), 1).otherwise(counted)
    return F.when(days.isNotNull(), days_before(as_of, days))


def loose_timestamp(text: Column) -> Column:
    """ISO 8601 text to an instant, or null."""
    t = F.regexp_replace(F.trim(text), " UTC$", "Z")
    return t.try_cast("timestamp")


def rss_timestamp(text: Column) -> Column:
    """RFC 822 date ('Tue, 01 Sep 2026 10:00:00 +0000') to an instant, or null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|Z)$", " +0000")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def london_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), LONDON))


def london_hour(ts: Column) -> Column:
    return F.hour(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), LONDON))


def in_run_window(ts: Column, from_hour: int = 8, to_hour: int = 14) -> Column:
    h = london_hour(ts)
    return (h >= from_hour) & (h < to_hour)


def round_half_up(x: Column) -> Column:
    """Rounding with halves toward positive infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def digest_lookback_hours(last_sent: Column, as_of) -> Column:
    """Hours since the last digest, between one day and eight."""
    hours = F.ceil(elapsed_seconds(as_of, last_sent) / F.lit(3600.0)).cast("int")
    return F.when(last_sent.isNull(), 192).otherwise(clamp(hours, 24, 192)).cast("int")


def age_label(ts: Column, as_of) -> Column:
    d = F.floor(elapsed_seconds(as_of, ts) / F.lit(86400.0)).cast("bigint")
    return (
        F.when(ts.isNull(), "")
        .when(d <= 0, "today")
        .when(d == 1, "yesterday")
        .when(d < 60, F.concat(d.cast("string"), F.lit(" days ago")))
        .otherwise(F.concat(F.floor(d / 30).cast("bigint").cast("string"), F.lit(" months ago")))
    )


def stale_reason(posted_at: Column, first_seen_at: Column, repost_count: Column, as_of) -> Column:
    """Why a live posting may be a ghost: reposted often, or open for over ninety days."""
    since = F.coalesce(posted_at, first_seen_at)
    return F.when(
        repost_count >= 2, F.concat(F.lit("Reposted "), repost_count.cast("string"), F.lit(" times"))
    ).when(
        elapsed_seconds(as_of, since) > 90 * 86400,
        F.concat(F.lit("Live for over "), elapsed_days(as_of, since).cast("string"), F.lit(" days")),
    )
