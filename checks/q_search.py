"""Search: posting and employer pages, facets, top lists, summaries, labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postmill.functions import dates, labels, rules
from postmill.operators import search, text_index
from postmill.session import checkpoint_folder, cut_lineage

from . import duck as d
from .bindings import NOW, q
from .catalog import AS_OF, Inputs, joined, query, stamp

# The posting view, in DuckDB's words.
AGE = f"(epoch_us({NOW}) - epoch_us(coalesce(posted_at, first_seen_at)))"
VIEW = f"""
  names AS (SELECT name_key, min(org_id) AS org_id, arg_min(name, org_id) AS org_name FROM orgs GROUP BY 1),
  opp AS (SELECT v.*, n.org_id, n.org_name, p.website, p.careers_url, p.ats_type, CAST({AGE} // 86400000000 AS INTEGER) AS age_days,
      CASE WHEN repost_count >= 2 THEN concat('Reposted ', repost_count, ' times')
           WHEN {AGE} > 90 * 86400000000 THEN concat('Live for over ', CAST({AGE} // 86400000000 AS INTEGER), ' days') END AS stale_reason
    FROM postings v JOIN profiles p ON p.name_key = v.name_key JOIN names n ON n.name_key = v.name_key)"""
VIEW_FRAMES = ("postings", "orgs", "profiles")
ORG_VIEW = f"""
  ov AS (SELECT o.*, p.careers_url, p.ats_type, p.resolve_status, p.website,
      CASE WHEN p.sectors_computed_at IS NOT NULL THEN {d.list_of('p.profile_tags')} ELSE {d.list_of('o.sector_tags')} END AS tags,
      {d.list_of('o.routes', '|')} AS route_list
    FROM orgs o LEFT JOIN profiles p ON p.name_key = o.name_key)"""
SHOWN = "posting_id, org_id, org_name, title, role_family, work_mode, salary_min, stale_reason, ats_type"


@query("N1 C2 I1 I2 E2", f"WITH {VIEW} SELECT posting_id, org_id, org_name, careers_url, ats_type, age_days, stale_reason FROM opp", VIEW_FRAMES)
def posting_view(spark, sf):
    return Inputs(spark, sf).posting_view().select(
        "posting_id", "org_id", "org_name", "careers_url", "ats_type", "age_days", "stale_reason")


F1 = search.PostingFilters(q="Engineer", city="lon", modes=("remote",), has_salary=True)
F2 = search.PostingFilters(families=("software", "data"), employment=("full_time",), sponsorship=("offered", "unmentioned"),
                           seniority=("senior", "lead", "entry"), since_days=30, hide_stale=True, page=2)
_SINCE = f"(first_seen_at > {NOW} - INTERVAL 30 DAY OR coalesce(changed_at > {NOW} - INTERVAL 30 DAY, false))"
W1 = {"always": "status = 'live' AND (contains(lower(title), 'engineer') OR contains(lower(org_name), 'engineer')) AND "
                "(coalesce(starts_with(lower(city), 'lon'), false) OR contains(lower(location_raw), 'lon')) AND salary_min IS NOT NULL",
      "work_mode": "coalesce(work_mode IN ('remote', 'flexible'), false)"}
W2 = {"always": f"status = 'live' AND {_SINCE} AND stale_reason IS NULL",
      "role_family": "role_family IN ('software', 'data')", "employment_type": "coalesce(employment_type = 'full_time', false)",
      "sponsorship_signal": "sponsorship_signal IN ('offered', 'unmentioned')", "seniority": "coalesce(seniority IN ('senior', 'lead', 'entry'), false)"}


def where(w: dict, skip: str = "") -> str:
    return " AND ".join(v for k, v in w.items() if k != skip)


def sql_page(w: dict, offset: int) -> str:
    return f"""WITH {VIEW} SELECT {SHOWN} FROM opp WHERE {where(w)}
               ORDER BY coalesce(posted_at, first_seen_at) DESC, posting_id DESC LIMIT 20 OFFSET {offset}"""


@query("B1 B3 B4 B7 N2 F1", sql_page(W1, 0), VIEW_FRAMES)
def search_page_text(spark, sf):
    return search.posting_page(Inputs(spark, sf).posting_view(), F1, AS_OF).select(*SHOWN.split(", "))


@query("B3 N2 F1", sql_page(W1, 0), VIEW_FRAMES)
def search_page_indexed(spark, sf):
    """The same page through the trigram index of titles and employers' names."""
    view = Inputs(spark, sf).posting_view()
    index = text_index.table(spark, f"{checkpoint_folder(spark).rstrip('/')}/grams-{uuid.uuid4().hex}")
    text_index.build(index, 1, view, "posting_id", "title", "org_name")
    return search.posting_page(text_index.narrowed(view, index, "posting_id", F1.q), F1, AS_OF).select(*SHOWN.split(", "))


@query("B3 N2 F1", sql_page(W1, 0), VIEW_FRAMES)
def search_page_index_kept(spark, sf):
    """The same page through an index of older titles that is kept up: changes, folded into the lists, and more changes."""
    # What the page tests, sorts by and shows; the view's other columns are neither derived nor written.
    view = cut_lineage(Inputs(spark, sf).posting_view().select(*SHOWN.split(", "), "status", "city", "location_raw", "posted_at", "first_seen_at"))
    last = F.col("posting_id") % 10
    older = view.where(last != 1).withColumn("title", F.when(last < 4, "Engineer of old").otherwise(F.col("title")))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/grams-{uuid.uuid4().hex}"
    index, changed = text_index.table(spark, f"{folder}/lists"), text_index.changed_table(spark, f"{folder}/changed")
    said = ("posting_id", "title", "org_name")
    text_index.build(index, 1, older, *said)
    text_index.change(changed, 1, view.where(last < 2), *said)
    text_index.fold(index, changed, 2)
    text_index.change(changed, 3, view.where(last.isin(2, 3)), *said)
    return search.posting_page(text_index.narrowed(view, index, "posting_id", F1.q, changed), F1, AS_OF).select(*SHOWN.split(", "))


@query("B1 B5 B8 N2 F1", sql_page(W2, 20), VIEW_FRAMES)
def search_page_filters(spark, sf):
    return search.posting_page(Inputs(spark, sf).posting_view(), F2, AS_OF).select(*SHOWN.split(", "))


def sql_facets(w: dict) -> str:
    names = ("role_family", "work_mode", "employment_type", "sponsorship_signal", "seniority")
    parts = [f"SELECT {q(n)} AS facet, {n} AS value, count(*) AS count FROM opp WHERE {where(w, n)} AND {n} IS NOT NULL GROUP BY {n}" for n in names]
    parts.append(f"SELECT * FROM (SELECT 'total' AS facet, NULL AS value, count(*) AS count FROM opp WHERE {where(w)}) t WHERE count > 0")
    return f"WITH {VIEW} " + " UNION ALL ".join(parts)


@query("N2 D5", sql_facets(W1), VIEW_FRAMES)
def search_facets_text(spark, sf):
    return search.posting_facets(Inputs(spark, sf).posting_view(), F1, AS_OF)


@query("N2 D5", sql_facets(W2), VIEW_FRAMES)
def search_facets_filters(spark, sf):
    return search.posting_facets(Inputs(spark, sf).posting_view(), F2, AS_OF)


O1 = search.OrgFilters(q="o", sectors=("tech", "finance"), routes=("Skilled Worker",), ratings=("A", "A_PREMIUM", "B"))
O2 = search.OrgFilters(town="st n", has_careers=True)
OW1 = {"always": "status = 'active' AND contains(name_key, 'o')", "sector": "list_has_any(tags, ['tech', 'finance'])",
       "route": "list_has_any(route_list, ['Skilled Worker'])", "rating": "rating IN ('A', 'A_PREMIUM', 'B')"}
OW2 = {"always": "status = 'active' AND starts_with(town_key, 'st n') AND careers_url IS NOT NULL"}
ORG_FRAMES = ("orgs", "profiles", "postings", "board_scans")


def sql_org_page(w: dict) -> str:
    return f"""WITH {ORG_VIEW},
      j AS (SELECT name_key, count(*) AS live, count(*) FILTER (sponsorship_signal = 'offered') AS offered FROM postings WHERE status = 'live' GROUP BY 1),
      br AS (SELECT name_key, count(*) AS branches FROM orgs WHERE status = 'active' GROUP BY 1),
      ls AS (SELECT name_key, max(started_at) AS last_scan FROM board_scans WHERE ok GROUP BY 1)
      SELECT org_id, name, town, rating, routes, array_to_string(list_sort(tags), ',') AS all_sector_tags, ats_type, coalesce(live, 0) AS live,
             coalesce(offered, 0) AS offered, coalesce(branches, 0) AS branches, strftime(last_scan, '%Y-%m-%d %H:%M:%S') AS last_scan
      FROM (SELECT * FROM ov WHERE {where(w)} ORDER BY name_key, org_id LIMIT 25) o LEFT JOIN j USING (name_key) LEFT JOIN br USING (name_key) LEFT JOIN ls USING (name_key)"""


def _org_page(spark, sf, f):
    i = Inputs(spark, sf)
    out = search.org_page(i.org_view(), f, i.postings(), i.orgs(), i.scans())
    return out.select("org_id", "name", "town", "rating", joined("routes", "|"), F.array_join(F.array_sort("all_sector_tags"), ",").alias("all_sector_tags"),
                      "ats_type", "live", "offered", "branches", stamp("last_scan"))


@query("N4 B2 B6 C3 C5 F1", sql_org_page(OW1), ORG_FRAMES)
def org_search_page(spark, sf):
    return _org_page(spark, sf, O1)


@query("N4 B2 B4 C3 C5 F1", sql_org_page(OW2), ORG_FRAMES)
def org_search_town_page(spark, sf):
    return _org_page(spark, sf, O2)


def sql_org_facets(w: dict) -> str:
    parts = [f"SELECT {q(n)} AS facet, value, count(*) AS count FROM (SELECT unnest({lst}) AS value FROM ov WHERE {where(w, n)}) x GROUP BY value"
             for n, lst in (("sector", "tags"), ("route", "route_list"), ("rating", "[rating]"))]
    parts.append(f"SELECT * FROM (SELECT 'total' AS facet, NULL AS value, count(*) AS count FROM ov WHERE {where(w)}) t WHERE count > 0")
    return f"WITH {ORG_VIEW} " + " UNION ALL ".join(parts)


@query("N4 D6", sql_org_facets(OW1), ("orgs", "profiles"))
def org_search_facets(spark, sf):
    return search.org_facets(Inputs(spark, sf).org_view(), O1)


@query("N5 D7 B10", """SELECT min(town) AS value, count(*) AS count FROM orgs
    WHERE status = 'active' AND town <> '' AND NOT regexp_matches(town, '[[:punct:]]$') GROUP BY town_key HAVING count(*) >= 3""", ("orgs",))
def top_towns(spark, sf):
    return search.top_towns(Inputs(spark, sf).orgs(), 3)


@query("N5 F4", """SELECT city AS value, count(*) AS count FROM postings WHERE status = 'live' AND city IS NOT NULL
    GROUP BY city ORDER BY count DESC, value LIMIT 40""", ("postings",))
def top_cities(spark, sf):
    return search.top_cities(Inputs(spark, sf).raw("postings"))


@query("N6 C12", """SELECT org_id AS branch_id, town AS branch_town, rating AS branch_rating, count(*) OVER (PARTITION BY name_key) AS branches
    FROM orgs WHERE status = 'active'""", ("orgs",))
def org_branches(spark, sf):
    return search.branches(Inputs(spark, sf).raw("orgs")).select("branch_id", "branch_town", "branch_rating", "branches")


@query("N6", f"""WITH {VIEW} SELECT posting_id, org_name, title, city FROM opp
    WHERE name_key = (SELECT min(name_key) FROM opp WHERE status = 'live') AND status = 'live'
    ORDER BY coalesce(posted_at, first_seen_at) DESC, posting_id DESC LIMIT 50""", VIEW_FRAMES)
def org_roles(spark, sf):
    view = Inputs(spark, sf).posting_view()
    first = view.where("status = 'live'").agg(F.min("name_key")).first()[0]
    return search.org_roles(view, first).select("posting_id", "org_name", "title", "city")


@query("N6 C1", f"""WITH {ORG_VIEW} SELECT o.org_id AS org_id, o.name AS name, o.town AS town, p.website AS website, p.site_title AS site_title,
       p.companies_house_no AS companies_house_no,
       CASE WHEN p.sectors_computed_at IS NOT NULL THEN p.sector_basis WHEN o.sector_tags <> '' THEN 'name' END AS basis
    FROM ov o LEFT JOIN profiles p ON p.name_key = o.name_key WHERE o.org_id IN (SELECT o_custkey + 1 FROM orders WHERE o_orderstatus = 'F')""", ("orgs", "profiles"))
def org_detail(spark, sf):
    """Everything known of the employers of many ids at once."""
    i = Inputs(spark, sf)
    asked = i.base("orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") + 1).alias("org_id"))
    found = search.org_detail(i.org_view(), i.profiles(), asked)
    return found.select("org_id", "name", "town", "website", "site_title", "companies_house_no", F.col("sector_basis").alias("basis"))


@query("N6 E1", """SELECT name_key, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_scan FROM board_scans WHERE ok GROUP BY 1""", ("board_scans",))
def org_last_good_scan(spark, sf):
    return search.last_good_scans(Inputs(spark, sf).scans()).select("name_key", stamp("last_scan"))


@query("N7 D10", """SELECT count(*) AS live, count(DISTINCT name_key) AS orgs, strftime(max(last_seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at
    FROM postings WHERE status = 'live'""", ("postings",))
def live_summary(spark, sf):
    return search.live_summary(Inputs(spark, sf).raw("postings")).select("live", "orgs", stamp("last_seen_at"))


# ---------------------------------------------------------------- labels
def _thousands(e: str) -> str:
    return f"format('{{:,}}', CAST({e} AS BIGINT))"


_SIGN = d.lookup(rules.SIGN, "coalesce(salary_currency, '')", "''")
_PER = d.lookup(rules.PERIOD_LABEL, "coalesce(salary_period, 'year')")
_SHORT = lambda n: f"CASE WHEN {n} >= 1000 THEN concat({_SIGN}, CAST(floor({n} / 1000 + 0.5) AS BIGINT), 'k') ELSE concat({_SIGN}, {_thousands(n)}) END"
_PARTS = "list_filter(list_transform(regexp_split_to_array(location_raw, '[|;]'), lambda p: trim(string_split(p, ',')[1])), lambda p: p <> '')"
_DAYS = f"((epoch_us({NOW}) - epoch_us(first_seen_at)) // 86400000000)"


@query("H18 H19 H20", f"""SELECT posting_id,
    CASE WHEN salary_min IS NOT NULL THEN concat({_SIGN}, {_thousands('salary_min')}, ' – ', {_SIGN}, {_thousands('salary_max')}, ' ', {_PER}) END AS pay,
    CASE WHEN salary_min IS NOT NULL THEN CASE WHEN salary_max <> salary_min THEN concat({_SHORT('salary_min')}, '–', {_SHORT('salary_max')}) ELSE {_SHORT('salary_min')} END END AS pay_short,
    coalesce({_PARTS}[1], 'Location not stated') AS place, CAST(greatest(len({_PARTS}) - 1, 0) AS INTEGER) AS more,
    CASE WHEN {_DAYS} <= 0 THEN 'today' WHEN {_DAYS} = 1 THEN 'yesterday' WHEN {_DAYS} < 60 THEN concat({_DAYS}, ' days ago')
         ELSE concat({_DAYS} // 30, ' months ago') END AS seen FROM postings""", ("postings",))
def posting_labels(spark, sf):
    p = Inputs(spark, sf).raw("postings")
    pay = [F.col(c) for c in ("salary_min", "salary_max", "salary_currency", "salary_period")]
    return p.select("posting_id", labels.money(*pay).alias("pay"), labels.money_short(*pay).alias("pay_short"),
                    labels.first_place(F.col("location_raw")).alias("place"), labels.more_places(F.col("location_raw")).cast("int").alias("more"),
                    dates.age_label(F.col("first_seen_at"), AS_OF).alias("seen"))


_BARE = f"CASE WHEN starts_with(route, {q(rules.MOBILITY_PREFIX)}) THEN substring(route, {len(rules.MOBILITY_PREFIX) + 1}) ELSE route END"


@query("H21 D6", f"""SELECT {d.lookup(rules.ROUTE_SHORT, f'({_BARE})', f'({_BARE})')} AS short_name,
    CASE WHEN starts_with(route, {q(rules.MOBILITY_PREFIX)}) THEN 'mobility' ELSE 'other' END AS route_group, count(*) AS employers
    FROM (SELECT unnest(string_split(routes, '|')) AS route FROM orgs) x GROUP BY 1, 2""", ("orgs",))
def route_groups(spark, sf):
    r = Inputs(spark, sf).orgs().select(F.explode("routes").alias("route"))
    return r.groupBy(labels.route_short(F.col("route")).alias("short_name"), labels.route_group(F.col("route")).alias("route_group")).agg(
        F.count(F.lit(1)).alias("employers"))
