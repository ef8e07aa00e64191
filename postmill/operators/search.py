"""Views, search predicates, pages and facets over postings and employers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.classify import all_of

POSTING_PAGE = 20
ORG_PAGE = 25


# ---------------------------------------------------------------- views
def posting_view(postings: DataFrame, orgs: DataFrame, profiles: DataFrame, as_of) -> DataFrame:
    """Postings with the employer's display name and careers link, age and stale reason.

    One display row per employer is picked by aggregation before the join, so no
    employer's branches multiply its postings.
    """
    names = orgs.groupBy("name_key").agg(
        F.min("org_id").alias("org_id"), F.min_by("name", "org_id").alias("org_name")
    )
    links = profiles.select("name_key", "website", "careers_url", "ats_type")
    since = F.coalesce("posted_at", "first_seen_at")
    # One row per employer, joined once, so that a hot employer's postings are split over tasks.
    employers = links.join(names, "name_key")
    return (
        postings.join(employers, "name_key")
        .withColumn("age_days", dates.elapsed_days(as_of, since))
        .withColumn(
            "stale_reason",
            dates.stale_reason(F.col("posted_at"), F.col("first_seen_at"), F.col("repost_count"), as_of),
        )
    )


def org_view(orgs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Employers with profile columns; computed sectors where there are any, else name-based ones."""
    extra = [c for c in profiles.columns if c not in orgs.columns]
    p = profiles.select("name_key", *extra, F.col("sector_tags").alias("_tags"))
    done = F.col("sectors_computed_at").isNotNull()
    by_name = F.array_sort(F.array_distinct("sector_tags"))
    none = F.array().cast("array<string>")
    return (
        orgs.join(p, "name_key", "left")
        .withColumn("all_sector_tags", F.when(done, F.coalesce("_tags", none)).otherwise(by_name))
        .withColumn(
            "sector_basis",
            F.when(done, F.col("sector_basis")).when(F.size("sector_tags") > 0, "name"),
        )
        .drop("_tags")
    )


# ---------------------------------------------------------------- predicates
def contains_text(col: Column, wanted: str) -> Column:
    """Case-insensitive substring; no character is special."""
    return F.contains(F.lower(col), F.lit(wanted.lower()))


def starts_with_text(col: Column, wanted: str) -> Column:
    return F.startswith(F.lower(col), F.lit(wanted.lower()))


def widen_modes(modes) -> list[str]:
    """Someone who would take remote, hybrid or on-site work also takes 'remote or office'."""
    return list(dict.fromkeys([*modes, *(["flexible"] if {"remote", "hybrid", "onsite"} & set(modes) else [])]))


@dataclass(frozen=True)
class PostingFilters:
    q: str = ""
    city: str = ""
    families: tuple = ()
    modes: tuple = ()
    employment: tuple = ()
    sponsorship: tuple = ()
    seniority: tuple = ()
    since_days: int = 0
    has_salary: bool = False
    hide_stale: bool = False
    page: int = 1


@dataclass(frozen=True)
class OrgFilters:
    q: str = ""
    town: str = ""
    sectors: tuple = ()
    routes: tuple = ()
    ratings: tuple = ()
    has_careers: bool = False
    page: int = 1


@dataclass
class Predicates:
    """Conjuncts every result must pass, and one optional conjunct per facet."""

    always: list = field(default_factory=list)
    by_facet: dict = field(default_factory=dict)

    def all(self) -> Column:
        return all_of([*self.always, *self.by_facet.values()])


def posting_predicates(f: PostingFilters, as_of) -> Predicates:
    p = Predicates([F.col("status") == "live"])
    if f.q:
        p.always.append(contains_text(F.col("title"), f.q) | contains_text(F.col("org_name"), f.q))
    if f.city:
        p.always.append(
            F.coalesce(starts_with_text(F.col("city"), f.city), F.lit(False))
            | contains_text(F.col("location_raw"), f.city)
        )
    if f.since_days:
        floor = dates.days_before(as_of, f.since_days)
        p.always.append((F.col("first_seen_at") > floor) | F.coalesce(F.col("changed_at") > floor, F.lit(False)))
    if f.has_salary:
        p.always.append(F.col("salary_min").isNotNull())
    if f.hide_stale:
        p.always.append(F.col("stale_reason").isNull())
    chosen = {
        "role_family": f.families,
        "work_mode": widen_modes(f.modes),
        "employment_type": f.employment,
        "sponsorship_signal": f.sponsorship,
        "seniority": f.seniority,
    }
    p.by_facet = {c: F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in chosen.items() if v}
    return p


def org_predicates(f: OrgFilters) -> Predicates:
    p = Predicates([F.col("status") == "active"])
    if f.q:
        p.always.append(contains_text(F.col("name_key"), f.q))
    if f.town:
        p.always.append(F.startswith(F.col("town_key"), F.lit(f.town.lower())))
    if f.has_careers:
        p.always.append(F.col("careers_url").isNotNull())
    overlap = lambda c, v: F.arrays_overlap(F.col(c), F.array(*map(F.lit, v)))
    if f.sectors:
        p.by_facet["sector"] = overlap("all_sector_tags", f.sectors)
    if f.routes:
        p.by_facet["route"] = overlap("routes", f.routes)
    if f.ratings:
        p.by_facet["rating"] = F.col("rating").isin(*f.ratings)
    return p


# ---------------------------------------------------------------- facets
def facet_counts(df: DataFrame, preds: Predicates, facets: dict[str, Column]) -> DataFrame:
    """Counts per facet value, each facet ignoring its own filter, plus the total.

    One scan for all facets: every row is tested once, and contributes to a facet
    when all conjuncts but that facet's own hold.
    """
    flags = {name: F.col(f"_ok_{name}") for name in preds.by_facet}
    flagged = df.where(all_of(preds.always))
    for name, cond in preds.by_facet.items():
        flagged = flagged.withColumn(f"_ok_{name}", cond)

    def others(facet: str) -> Column:
        return all_of([ok for name, ok in flags.items() if name != facet])

    none = F.array().cast("array<struct<facet:string,value:string>>")
    parts = []
    for name, values in facets.items():
        parts.append(F.when(others(name), F.coalesce(_labelled(name, values), none)).otherwise(none))
    total = F.array(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")))
    parts.append(F.when(others(""), total).otherwise(none))
    return (
        flagged.select(F.inline_outer(F.concat(*parts)))
        .where("facet is not null")
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _labelled(facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


def _single(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.array(F.col(name)))


def posting_facets(view: DataFrame, f: PostingFilters, as_of) -> DataFrame:
    names = ("role_family", "work_mode", "employment_type", "sponsorship_signal", "seniority")
    return facet_counts(view, posting_predicates(f, as_of), {n: _single(n) for n in names})


def org_facets(view: DataFrame, f: OrgFilters) -> DataFrame:
    facets = {"sector": F.col("all_sector_tags"), "route": F.col("routes"), "rating": _single("rating")}
    return facet_counts(view, org_predicates(f), facets)


# ---------------------------------------------------------------- pages
def newest_first():
    return [F.coalesce("posted_at", "first_seen_at").desc(), F.col("posting_id").desc()]


def posting_page(view: DataFrame, f: PostingFilters, as_of, size: int = POSTING_PAGE) -> DataFrame:
    hits = view.where(posting_predicates(f, as_of).all())
    return hits.orderBy(*newest_first()).offset((f.page - 1) * size).limit(size)


def org_counts(postings: DataFrame) -> DataFrame:
    """Live postings per employer, and how many of them offer sponsorship."""
    return postings.where("status = 'live'").groupBy("name_key").agg(
        F.count(F.lit(1)).alias("live"), F.count_if(F.col("sponsorship_signal") == "offered").alias("offered")
    )


def branch_counts(orgs: DataFrame) -> DataFrame:
    return orgs.where("status = 'active'").groupBy("name_key").agg(F.count(F.lit(1)).alias("branches"))


def last_good_scans(scans: DataFrame) -> DataFrame:
    return scans.where("ok").groupBy("name_key").agg(F.max("finished_at").alias("last_scan"))


def org_page(view: DataFrame, f: OrgFilters, postings: DataFrame, orgs: DataFrame, scans: DataFrame,
             size: int = ORG_PAGE) -> DataFrame:
    """A page of employers with live, offered, branch counts and last good scan.

    The page is cut first; the counts are then joined to its few rows.
    """
    rows = view.where(org_predicates(f).all()).orderBy("name_key", "org_id").offset((f.page - 1) * size).limit(size)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # At most ``size`` names; counts are taken for these alone.
    keys = F.broadcast(rows.select("name_key").distinct())
    own = lambda df: df.join(keys, "name_key", "left_semi")
    return (
        rows.join(org_counts(own(postings)), "name_key", "left")
        .join(branch_counts(own(orgs)), "name_key", "left")
        .join(last_good_scans(own(scans)), "name_key", "left")
        .withColumn("live", zero("live"))
        .withColumn("offered", zero("offered"))
        .withColumn("branches", zero("branches"))
    )


def top_towns(orgs: DataFrame, minimum: int = 40) -> DataFrame:
    """Towns with enough active employers, leaving out names that end in punctuation."""
    ok = (F.col("status") == "active") & (F.col("town") != "") & ~F.col("town").rlike(r"\p{Punct}$")
    return (
        orgs.where(ok).groupBy("town_key")
        .agg(F.min("town").alias("value"), F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= minimum).select("value", "count").orderBy("value")
    )


def top_cities(postings: DataFrame, k: int = 40) -> DataFrame:
    live = postings.where("status = 'live' and city is not null")
    counts = live.groupBy(F.col("city").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "value").limit(k)


def org_detail(view: DataFrame, profiles: DataFrame, asked: DataFrame) -> DataFrame:
    """Employers of the asked ids (org_id) with everything known of them."""
    more = [c for c in ("site_title", "website_candidate", "companies_house_no", "sic_codes") if c not in view.columns]
    one = view.join(asked.select("org_id").distinct(), "org_id", "left_semi")
    return one.join(profiles.select("name_key", *more), "name_key", "left") if more else one


def branches(orgs: DataFrame) -> DataFrame:
    """Every active branch once, with the number of active branches under its name."""
    b = orgs.where("status = 'active'").select(
        "name_key", F.col("org_id").alias("branch_id"), F.col("town").alias("branch_town"),
        F.col("rating").alias("branch_rating"),
    )
    return b.join(branch_counts(orgs), "name_key")


def branches_of(orgs: DataFrame, asked: DataFrame) -> DataFrame:
    """(org_id, branch columns) of the asked employers (org_id): all active branches under each one's name."""
    names = orgs.join(asked.select("org_id").distinct(), "org_id", "left_semi").select("org_id", "name_key")
    return names.join(branches(orgs), "name_key")


def org_roles(view: DataFrame, name_key: str, limit: int = 50) -> DataFrame:
    return view.where((F.col("name_key") == name_key) & (F.col("status") == "live")).orderBy(*newest_first()).limit(limit)


def live_summary(postings: DataFrame) -> DataFrame:
    live = F.col("status") == "live"
    return postings.where(live).agg(
        F.count(F.lit(1)).alias("live"),
        F.countDistinct("name_key").alias("orgs"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def latest_register(log: DataFrame) -> DataFrame:
    return log.where("finished_at is not null").orderBy(F.col("published_on").desc()).limit(1)
