"""Display labels and privacy-preserving projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .dates import round_half_up
from .text import lookup, trim


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def money(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """'£60,000 – £75,000 a year', or null when no pay is known."""
    sign = lookup(rules.SIGN, F.coalesce(currency, F.lit("")), F.lit(""))
    per = lookup(rules.PERIOD_LABEL, F.coalesce(period, F.lit("year")))
    top = F.coalesce(high, low)
    return F.when(
        low.isNotNull(),
        F.concat(sign, thousands(low), F.lit(" – "), sign, thousands(top), F.lit(" "), per),
    )


def money_short(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """'£70k–£85k' for yearly pay, '£450 a day' otherwise."""
    sign = lookup(rules.SIGN, F.coalesce(currency, F.lit("")), F.lit(""))
    yearly = F.coalesce(period, F.lit("year")) == "year"

    def figure(n: Column) -> Column:
        short = F.concat(sign, round_half_up(n / 1000).cast("bigint").cast("string"), F.lit("k"))
        return F.when(yearly & (n >= 1000), short).otherwise(F.concat(sign, thousands(n)))

    top = F.coalesce(high, low)
    both = F.when(top != low, F.concat(figure(low), F.lit("–"), figure(top))).otherwise(figure(low))
    per = lookup(rules.PERIOD_LABEL, F.coalesce(period, F.lit("year")))
    return F.when(low.isNotNull(), F.when(yearly, both).otherwise(F.concat(both, F.lit(" "), per)))


def places(location: Column) -> Column:
    """Distinct place names of a '|' or ';' separated list, each cut at its first comma."""
    parts = F.transform(F.split(location, "[|;]"), lambda p: trim(F.split_part(p, F.lit(","), F.lit(1))))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def first_place(location: Column) -> Column:
    return F.coalesce(F.get(places(location), 0), F.lit("Location not stated"))


def more_places(location: Column) -> Column:
    return F.greatest(F.size(places(location)) - 1, F.lit(0))


def route_short(route: Column) -> Column:
    name = F.when(
        F.startswith(route, F.lit(rules.MOBILITY_PREFIX)),
        F.substr(route, F.lit(len(rules.MOBILITY_PREFIX) + 1)),
    ).otherwise(route)
    return lookup(rules.ROUTE_SHORT, name, name)


def route_group(route: Column) -> Column:
    return F.when(F.startswith(route, F.lit(rules.MOBILITY_PREFIX)), "mobility").otherwise("other")


def mask_email(email: Column) -> Column:
    """Enough for its owner to recognise, too little to harvest."""
    local = F.split_part(email, F.lit("@"), F.lit(1))
    domain = F.split_part(email, F.lit("@"), F.lit(2))
    rest = F.regexp_extract(domain, r"^[^.]*(\..*)$", 1)
    return F.concat(F.substring(local, 1, 1), F.lit("***@"), F.substring(domain, 1, 1), F.lit("***"), rest)


def normalise_email(raw: Column) -> Column:
    e = F.lower(trim(raw))
    part = r'[^\s@<>()\[\]\\,;:"]'
    shape = rf"^{part}+@{part}+\.{part}{{2,}}$"
    return F.when((F.length(e) <= 254) & e.rlike(shape), e)


def address_bucket(ip: Column) -> Column:
    """The unit requests are counted by: an IPv4 address, or the /64 of an IPv6 one."""
    mapped = F.regexp_extract(ip, r"^(?i)::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    low = F.lower(ip)
    head = F.filter(F.split(F.split_part(low, F.lit("::"), F.lit(1)), ":"), lambda g: g != "")
    tail = F.filter(F.split(F.split_part(low, F.lit("::"), F.lit(2)), ":"), lambda g: g != "")
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    full = F.when(F.contains(low, F.lit("::")), F.concat(head, gap, tail)).otherwise(head)
    first4 = F.transform(F.slice(full, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return F.when(mapped != "", mapped).when(~F.contains(ip, F.lit(":")), ip).otherwise(F.array_join(first4, ":"))
