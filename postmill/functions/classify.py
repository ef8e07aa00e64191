"""Classifiers: sector tags, role family, level, place, working pattern, contract type."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .patterns import java, words
from .text import clean, first_rule, lookup, matches, matches_in


# ---------------------------------------------------------------- register fields
def worker_type(col: Column) -> Column:
    temporary = F.startswith(F.lower(clean(col)), F.lit("temporary worker"))
    return F.when(temporary, "temporary_worker").otherwise("worker")


def rating(col: Column) -> Column:
    text = F.lower(clean(col))
    chain = reduce(
        lambda acc, m: acc.when(F.contains(text, F.lit(m[1])), m[0]),
        rules.RATING_MARKERS[1:],
        F.when(F.contains(text, F.lit(rules.RATING_MARKERS[0][1])), rules.RATING_MARKERS[0][0]),
    )
    return chain.otherwise("UNKNOWN")


def rating_rank(col: Column) -> Column:
    return lookup(rules.RATING_RANK, col)


def rating_of_rank(rank: Column) -> Column:
    return lookup({v: k for k, v in rules.RATING_RANK.items()}, rank)


# ---------------------------------------------------------------- sectors
def _sector_flags(text: Column) -> dict[str, Column]:
    flags = {tag: matches(text, p) for tag, p in rules.SECTOR_WORDS.items()}
    # A "network" of clinics or TV channels is not a telecoms business.
    other_network = matches(text, rules.NETWORK_OTHER) & ~matches(text, rules.TELECOM_CERTAIN)
    flags["telecoms"] = flags["telecoms"] & ~other_network
    techy = reduce(or_, [flags[t] for t in rules.TECH_SECTORS])
    flags["tech"] = matches(text, rules.TECH_WORDS) | techy
    return flags


def _tags(flags: dict[str, Column], order) -> Column:
    return F.array_compact(F.array(*[F.when(flags[t], F.lit(t)) for t in order]))


def sector_tags(name: Column) -> Column:
    return _tags(_sector_flags(name), rules.SECTOR_TAGS)


def site_sector_tags(text: Column) -> Column:
    """Tags a page's own wording supports, the umbrella tag last."""
    found = _tags(_sector_flags(text), rules.SITE_TEXT_TAGS)
    return F.when(F.size(found) > 0, F.array_append(found, F.lit("tech"))).otherwise(found)


# ---------------------------------------------------------------- roles
def role_family(title: Column, department: Column, table=rules.ROLE_RULES) -> Column:
    t = clean(title)
    chain = None
    for family, pattern in table:
        test = matches(t, pattern)
        chain = F.when(test, family) if chain is None else chain.when(test, family)
    technical = F.coalesce(matches(department, rules.TECH_DEPARTMENT), F.lit(False))
    bare = matches(t, rules.ENGINEER_WORD) & ~matches(t, rules.PHYSICAL_ENGINEER) & technical
    return chain.when(matches(t, rules.SOFTWARE_WORDS) | bare, "software")


def seniority(title: Column, table=rules.SENIORITY_RULES) -> Column:
    return first_rule(title, table)


# ---------------------------------------------------------------- places
_CITY = words(*[c for c in rules.UK_CITIES if c != "york"], "york")


def _city_text(loc: Column) -> Column:
    # "New York" names another city; blank it before looking for York.
    return F.regexp_replace(F.lower(loc), "new york(?![a-z0-9_])", "new ____")


def is_uk_location(locations: Column, codes: Column) -> Column:
    """UK by country code, by country word, or by city when nothing places it abroad."""

    def place(loc: Column) -> Column:
        abroad = matches(loc, rules.NORTH_AMERICA_CODE, False) | matches(loc, rules.OTHER_COUNTRY)
        return matches(loc, rules.UK_COUNTRY) | (~abroad & matches(_city_text(loc), _CITY, False))

    coded = F.exists(codes, lambda c: F.lower(c).isin(*rules.UK_COUNTRY_CODES))
    return F.coalesce(coded, F.lit(False)) | F.coalesce(F.exists(locations, place), F.lit(False))


def uk_city(locations: Column) -> Column:
    """The UK city named first, in the first location that names one."""
    found = F.transform(locations, lambda l: F.regexp_extract(_city_text(l), java(_CITY, False), 0))
    return F.initcap(F.get(F.filter(found, lambda c: c != ""), 0))


# ---------------------------------------------------------------- working pattern
def work_mode(location: Column, text: Column, lower: Column | None = None) -> Column:
    """struct(mode, origin) inferred from the place, else from the description."""
    loc = F.lower(location)
    body = F.coalesce(F.lower(text) if lower is None else lower, F.lit(""))
    left_over = F.regexp_replace(loc, java(rules.REMOTE_FILLER, False), "")
    hybrid = words("hybrid")

    def found(mode: Column | str, origin: str) -> Column:
        mode = F.lit(mode) if isinstance(mode, str) else mode
        return F.struct(mode.alias("mode"), F.lit(origin).alias("origin"))

    return (
        F.when(matches(loc, hybrid, False), found("hybrid", "location"))
        .when(
            matches(loc, words("remote"), False),
            found(F.when(left_over == "", "remote").otherwise("flexible"), "location"),
        )
        .when(matches_in(body, hybrid), found("hybrid", "text"))
        .when(matches_in(body, rules.REMOTE_TEXT), found("remote", "text"))
        .when(matches_in(body, rules.ONSITE_TEXT), found("onsite", "text"))
    )


def employment_type(raw: Column, table=rules.EMPLOYMENT_PREFIXES) -> Column:
    """Contract type from a board's own field."""
    squashed = F.regexp_replace(F.lower(raw), java(r"\s|_|-", False), "")
    return first_rule(squashed, [(t, "^" + p) for t, p in table])


def employment_type_from_title(title: Column, table=rules.EMPLOYMENT_TITLE) -> Column:
    return first_rule(title, table)


def size_band(headcount: Column) -> Column:
    chain = F.when(headcount.isNull() | (headcount <= 0), F.lit(None).cast("string"))
    for limit, label in rules.SIZE_BANDS:
        chain = chain.when(headcount < limit, label)
    return chain.otherwise("5000+")


# ---------------------------------------------------------------- company codes
def sic_code(text: Column) -> Column:
    """Leading code of '62012 - description'; '' when there is none."""
    return F.regexp_extract(F.trim(text), r"^(\d{4,5})(?![A-Za-z0-9_])", 1)


def sic_codes(texts: Column) -> Column:
    return F.array_distinct(
        F.filter(F.transform(texts, lambda t: sic_code(F.coalesce(t, F.lit("")))), lambda c: c != "")
    )


def _padded(code: Column) -> Column:
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.substring(F.rpad(digits, 5, "0"), 1, 5)


def has_specific_sic(codes: Column) -> Column:
    """At least one code that names an industry rather than paperwork."""

    def specific(code: Column) -> Column:
        digits = F.regexp_replace(code, "[^0-9]", "")
        c = _padded(code)
        return (F.length(digits) >= 4) & ~c.isin(*rules.GENERIC_SIC) & ~F.startswith(c, F.lit("68"))

    return F.coalesce(F.exists(codes, specific), F.lit(False))


def sic_evidence(codes: Column, table=rules.SIC_PREFIX_TAGS) -> Column:
    """Ordered evidence structs for a company's codes; the longest prefix rule decides each."""
    longest_first = sorted(table, key=lambda r: -len(r[0]))

    def tags(code: Column) -> Column:
        c = _padded(code)
        chain = F.when(c.isin(*rules.GENERIC_SIC), F.array().cast("array<string>"))
        for prefix, names in longest_first:
            chain = chain.when(F.startswith(c, F.lit(prefix)), F.array(*map(F.lit, names)))
        return chain.otherwise(F.array().cast("array<string>"))

    def rows(code: Column) -> Column:
        detail = F.concat(F.lit("SIC "), F.regexp_replace(code, "[^0-9]", ""))
        return F.transform(tags(code), lambda t: evidence(t, F.lit("sic"), detail))

    return F.flatten(F.transform(codes, rows))


def evidence(tag: Column, source: Column, detail: Column) -> Column:
    return F.struct(tag.alias("tag"), source.alias("source"), detail.cast("string").alias("detail"))


def all_of(conditions) -> Column:
    return reduce(and_, conditions, F.lit(True))
