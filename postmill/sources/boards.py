"""Mappers for the job-board vendors' public payloads (JSON and XML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.text import blank_to_null, html_to_text, join_present, let, lookup, matches, trim
from ..functions.urls import quote
from .registry import Job, board_source, no_text, pay, present

# How boards spell working patterns and pay periods.
WORKPLACE = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite"}
BAMBOO_MODE = {"0": "onsite", "1": "remote", "2": "hybrid"}
PAY_PERIOD_WORD = {
    "year": "year", "yearly": "year", "annual": "year", "month": "month", "monthly": "month",
    "day": "day", "daily": "day", "hour": "hour", "hourly": "hour",
}
WORKDAY_REMOTE = (("remote", "^remote"), ("hybrid", "hybrid"), ("onsite", "on[- ]?site|office"))




def _interval_period(interval: Column) -> Column:
    iv = F.lower(F.coalesce(interval, F.lit("")))
    has = lambda w: F.contains(iv, F.lit(w))
    return F.when(has("hour"), "hour").when(has("month"), "month").when(has("day"), "day").otherwise("year")


def _workplace(col: Column) -> Column:
    return lookup(WORKPLACE, F.lower(col))


def country_code(name: Column) -> Column:
    """Two-letter code from a country name or code; null when it is neither."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.coalesce(lookup(rules.COUNTRY_NAME_CODE, n), F.when(n.rlike("^[a-z]{2}$"), F.upper(n)))


def _known_currency(col: Column) -> Column:
    return F.coalesce(col.isin(*rules.CURRENCIES), F.lit(False))


# ---------------------------------------------------------------- Greenhouse
GREENHOUSE = """struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,
  offices:array<struct<name:string>>,departments:array<struct<name:string>>,first_published:string,
  updated_at:string,content:string>>>"""


@board_source("greenhouse", lambda: F.from_json("payload", GREENHOUSE)["jobs"])
def greenhouse(j: Job) -> dict[str, Column]:
    offices = F.coalesce(F.transform(j("offices"), lambda o: o["name"]), no_text())
    return dict(
        external_id=j("id").cast("string"),
        title=trim(j("title")),
        locations=F.array_distinct(present(F.concat(F.array(j("location.name")), offices))),
        apply_url=j("absolute_url"),
        posted_at=dates.loose_timestamp(F.coalesce(j("first_published"), j("updated_at"))),
        department=F.get(j("departments"), 0)["name"],
        description_text=html_to_text(blank_to_null(j("content"))),
    )


# ---------------------------------------------------------------- Lever
LEVER = """array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,country:string,
  workplaceType:string,categories:struct<commitment:string,location:string,team:string,department:string,
  allLocations:array<string>>,descriptionPlain:string,additionalPlain:string,
  lists:array<struct<text:string,content:string>>,
  salaryRange:struct<min:double,max:double,currency:string,`interval`:string>>>"""


@board_source("lever", lambda: F.from_json("payload", LEVER))
def lever(j: Job) -> dict[str, Column]:
    every = j("categories.allLocations")
    places = F.when(F.size(F.coalesce(every, no_text())) > 0, every).otherwise(present(F.array(j("categories.location"))))
    sections = F.transform(
        j("lists"),
        lambda s: F.concat(F.coalesce(s["text"], F.lit("")), F.lit("\n"), html_to_text(F.coalesce(s["content"], F.lit("")))),
    )
    text = F.concat_ws("\n", blank_to_null(j("descriptionPlain")), sections, blank_to_null(j("additionalPlain")))
    s = j("salaryRange")
    currency = F.upper(s["currency"])
    return dict(
        external_id=j("id"),
        title=trim(j("text")),
        locations=places,
        country_codes=present(F.array(j("country"))),
        apply_url=F.coalesce(j("applyUrl"), j("hostedUrl")),
        posted_at=F.timestamp_millis(j("createdAt")),
        department=F.coalesce(j("categories.department"), j("categories.team")),
        employment_type_raw=j("categories.commitment"),
        work_mode=_workplace(j("workplaceType")),
        description_text=let(text, blank_to_null),
        salary=pay(s["min"], s["max"], currency, _interval_period(s["interval"]),
                   (s["min"] != 0) & (s["max"] != 0) & _known_currency(currency)),
    )


# ---------------------------------------------------------------- Ashby
ASHBY = """struct<jobs:array<struct<id:string,title:string,department:string,team:string,employmentType:string,
  location:string,secondaryLocations:array<struct<location:string,
  address:struct<postalAddress:struct<addressCountry:string>>>>,
  address:struct<postalAddress:struct<addressCountry:string>>,publishedAt:string,isListed:boolean,
  workplaceType:string,jobUrl:string,applyUrl:string,descriptionPlain:string,
  compensation:struct<compensationTiers:array<struct<components:array<struct<compensationType:string,
  `interval`:string,currencyCode:string,minValue:double,maxValue:double>>>>>>>>"""


@board_source("ashby", lambda: F.filter(F.from_json("payload", ASHBY)["jobs"], lambda j: ~j["isListed"].eqNullSafe(F.lit(False))))
def ashby(j: Job) -> dict[str, Column]:
    other = F.flatten(F.transform(
        F.coalesce(j("secondaryLocations"), F.array()),
        lambda s: F.array(s["location"], s["address"]["postalAddress"]["addressCountry"]),
    ))
    places = F.concat(F.array(j("location"), j("address.postalAddress.addressCountry")), F.coalesce(other, no_text()))
    parts = F.flatten(F.transform(j("compensation.compensationTiers"), lambda t: F.coalesce(t["components"], F.array())))
    stated = F.filter(
        parts,
        lambda c: (c["compensationType"] == "Salary") & (c["minValue"] != 0) & (c["maxValue"] != 0) & (c["currencyCode"] != ""),
    )
    # Bound, as the salary mentions the chosen part once for each of its fields.
    chosen = let(stated, lambda all_: F.coalesce(F.get(F.filter(all_, lambda c: c["currencyCode"] == "GBP"), 0), F.get(all_, 0)))
    salary = let(chosen, lambda s: pay(s["minValue"], s["maxValue"], s["currencyCode"], _interval_period(s["interval"]),
                                       _known_currency(s["currencyCode"])))
    return dict(
        external_id=j("id"),
        title=trim(j("title")),
        locations=F.array_distinct(present(places)),
        apply_url=F.coalesce(j("applyUrl"), j("jobUrl")),
        posted_at=dates.loose_timestamp(j("publishedAt")),
        department=F.coalesce(j("department"), j("team")),
        employment_type_raw=j("employmentType"),
        work_mode=F.when(F.lower(j("workplaceType")) != "on-site", _workplace(j("workplaceType"))),
        description_text=j("descriptionPlain"),
        salary=salary,
    )


# ---------------------------------------------------------------- Workable
WORKABLE = """struct<name:string,jobs:array<struct<title:string,shortcode:string,employment_type:string,
  telecommuting:boolean,department:string,url:string,application_url:string,published_on:string,
  created_at:string,country:string,city:string,
  locations:array<struct<country:string,countryCode:string,city:string,region:string,hidden:boolean>>,
  description:string>>>"""


@board_source("workable", lambda: F.from_json("payload", WORKABLE)["jobs"])
def workable(j: Job) -> dict[str, Column]:
    shown = F.filter(j("locations"), lambda l: ~F.coalesce(l["hidden"], F.lit(False)))
    listed = F.transform(shown, lambda l: join_present(", ", l["city"], l["region"], l["country"]))
    own = F.array(join_present(", ", j("city"), j("country")))
    places = F.when(F.coalesce(F.size(j("locations")), F.lit(0)) > 0, listed).otherwise(own)
    return dict(
        external_id=j("shortcode"),
        title=trim(j("title")),
        locations=present(places),
        country_codes=present(F.coalesce(F.transform(j("locations"), lambda l: l["countryCode"]), no_text())),
        apply_url=F.coalesce(j("application_url"), j("url")),
        posted_at=dates.loose_timestamp(F.coalesce(j("published_on"), j("created_at"))),
        department=j("department"),
        employment_type_raw=j("employment_type"),
        # Only a positive flag says something; false does not mean on-site.
        work_mode=F.when(j("telecommuting"), "remote"),
        description_text=html_to_text(blank_to_null(j("description"))),
    )


# ---------------------------------------------------------------- SmartRecruiters
SMARTRECRUITERS = """struct<content:array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,
  region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,department:struct<label:string>,
  `function`:struct<label:string>,typeOfEmployment:struct<label:string>>>>"""
SMARTRECRUITERS_DETAIL = """struct<applyUrl:string,postingUrl:string,
  jobAd:struct<sections:map<string,struct<text:string>>>>"""


@board_source("smartrecruiters", lambda: F.from_json("payload", SMARTRECRUITERS)["content"])
def smartrecruiters(j: Job) -> dict[str, Column]:
    place = F.coalesce(j("location.fullLocation"), join_present(", ", j("location.city"), j("location.region"), j("location.country")))
    return dict(
        external_id=j("id"),
        title=trim(j("name")),
        locations=present(F.array(place)),
        country_codes=present(F.array(j("location.country"))),
        posted_at=dates.loose_timestamp(j("releasedDate")),
        department=F.coalesce(j("department.label"), j("function.label")),
        employment_type_raw=j("typeOfEmployment.label"),
        work_mode=F.when(j("location.remote"), "remote").when(j("location.hybrid"), "hybrid"),
    )


def smartrecruiters_details(payloads: DataFrame) -> DataFrame:
    """Detail records (one per external_id): text and link."""
    d = payloads.withColumn("d", F.from_json("payload", SMARTRECRUITERS_DETAIL))
    sections = F.transform(F.map_values(F.col("d.jobAd.sections")), lambda s: html_to_text(F.coalesce(s["text"], F.lit(""))))
    return d.select(
        "name_key", "source", "external_id",
        F.array_join(sections, "\n").alias("description_text"),
        F.coalesce("d.postingUrl", "d.applyUrl").alias("apply_url"),
    )


# ---------------------------------------------------------------- Workday
WORKDAY = """struct<total:bigint,jobPostings:array<struct<title:string,externalPath:string,locationsText:string,
  timeType:string,postedOn:string,bulletFields:array<string>>>>"""
WORKDAY_DETAIL = """struct<jobPostingInfo:struct<jobDescription:string,location:string,additionalLocations:array<string>,
  startDate:string,timeType:string,remoteType:string,externalUrl:string>>"""


def workday_site(slug: Column) -> Column:
    """Public address of a board from its slug, 'tenant.wdN/site'."""
    parts = r"^([^/]+)\.(wd\d+)/(.+)$"
    tenant, number, site = (F.regexp_extract(slug, parts, i) for i in (1, 2, 3))
    return F.concat(F.lit("https://"), tenant, F.lit("."), F.lower(number), F.lit(".myworkdayjobs.com/"), site)


@board_source("workday", lambda: F.from_json("payload", WORKDAY)["jobPostings"])
def workday(j: Job) -> dict[str, Column]:
    """Lists; a board listed with its UK filter on has at least one UK site per posting."""
    from_path = blank_to_null(F.regexp_extract(j("externalPath"), "_([A-Za-z0-9-]+)$", 1))
    filtered = F.coalesce("uk_filtered", F.lit(False))
    return dict(
        external_id=F.coalesce(F.get(j("bulletFields"), 0), from_path, j("externalPath")),
        title=trim(j("title")),
        locations=present(F.array(j("locationsText"))),
        country_codes=F.when(filtered, F.array(F.lit("GB"))).otherwise(no_text()),
        apply_url=F.concat(workday_site(F.col("slug")), j("externalPath")),
        posted_at=dates.relative_posting_date(j("postedOn"), F.col("fetched_at")),
        employment_type_raw=j("timeType"),
    )


def workday_details(payloads: DataFrame) -> DataFrame:
    d = payloads.withColumn("d", F.from_json("payload", WORKDAY_DETAIL)["jobPostingInfo"]).where("d is not null")
    remote = F.col("d.remoteType")
    mode = F.when(matches(remote, WORKDAY_REMOTE[0][1]), "remote")
    for name, pattern in WORKDAY_REMOTE[1:]:
        mode = mode.when(matches(remote, pattern), name)
    places = F.concat(F.array("d.location"), F.coalesce("d.additionalLocations", no_text()))
    return d.select(
        "name_key", "source", "external_id",
        html_to_text(F.coalesce("d.jobDescription", F.lit(""))).alias("description_text"),
        F.col("d.externalUrl").alias("apply_url"),
        present(places).alias("locations"),
        mode.alias("work_mode"),
        dates.loose_timestamp(F.col("d.startDate")).alias("posted_at"),
        F.col("d.timeType").alias("employment_type_raw"),
    )


# ---------------------------------------------------------------- Teamtailor
TEAMTAILOR = """struct<channel:struct<item:array<struct<title:string,description:string,pubDate:string,link:string,
  guid:string,remoteStatus:string,`tt:locations`:struct<`tt:location`:array<struct<`tt:name`:string,`tt:city`:string,
  `tt:country`:string>>>,`tt:department`:string>>>>"""


@board_source("teamtailor", lambda: F.from_xml(F.col("payload"), TEAMTAILOR)["channel"]["item"], needs_id=True)
def teamtailor(j: Job) -> dict[str, Column]:
    places = F.transform(
        F.coalesce(j("tt:locations.tt:location"), F.array()),
        lambda l: F.struct(
            F.coalesce(blank_to_null(trim(l["tt:city"])), trim(l["tt:name"])).alias("city"),
            trim(l["tt:country"]).alias("country"),
        ),
    )
    return dict(
        external_id=F.coalesce(blank_to_null(trim(j("guid"))), blank_to_null(trim(j("link")))),
        title=trim(j("title")),
        locations=present(F.transform(places, lambda p: join_present(", ", p["city"], p["country"]))),
        country_codes=F.array_compact(F.transform(places, lambda p: country_code(p["country"]))),
        apply_url=blank_to_null(trim(j("link"))),
        posted_at=dates.rss_timestamp(j("pubDate")),
        department=blank_to_null(trim(j("tt:department"))),
        work_mode=_workplace(trim(j("remoteStatus"))),
        description_text=html_to_text(blank_to_null(j("description"))),
    )


# ---------------------------------------------------------------- BambooHR
BAMBOOHR = """struct<result:array<struct<id:string,jobOpeningName:string,departmentLabel:string,
  employmentStatusLabel:string,location:struct<city:string,state:string>,
  atsLocation:struct<country:string,state:string,province:string,city:string>,isRemote:boolean,locationType:string>>>"""
BAMBOOHR_DETAIL = "struct<result:struct<jobOpening:struct<description:string,datePosted:string>>>"


@board_source("bamboohr", lambda: F.from_json("payload", BAMBOOHR)["result"])
def bamboohr(j: Job) -> dict[str, Column]:
    place = join_present(
        ", ",
        F.coalesce(j("atsLocation.city"), j("location.city")),
        F.coalesce(j("atsLocation.state"), j("atsLocation.province"), j("location.state")),
        j("atsLocation.country"),
    )
    return dict(
        external_id=j("id"),
        title=trim(j("jobOpeningName")),
        locations=present(F.array(place)),
        country_codes=F.array_compact(F.array(country_code(j("atsLocation.country")))),
        apply_url=F.concat(F.lit("https://"), "slug", F.lit(".bamboohr.com/careers/"), quote(j("id"))),
        department=j("departmentLabel"),
        employment_type_raw=j("employmentStatusLabel"),
        work_mode=F.when(j("isRemote"), "remote").otherwise(lookup(BAMBOO_MODE, j("locationType"))),
    )


def bamboohr_details(payloads: DataFrame) -> DataFrame:
    d = payloads.withColumn("d", F.from_json("payload", BAMBOOHR_DETAIL)["result"]["jobOpening"])
    return d.where("d.description <> ''").select(
        "name_key", "source", "external_id",
        html_to_text(F.col("d.description")).alias("description_text"),
        dates.loose_timestamp(F.col("d.datePosted")).alias("posted_at"),
    )


# ---------------------------------------------------------------- Recruitee
RECRUITEE = """struct<offers:array<struct<id:string,guid:string,title:string,status:string,department:string,
  employment_type_code:string,country_code:string,location:string,
  locations:array<struct<city:string,country:string,country_code:string>>,remote:boolean,hybrid:boolean,
  on_site:boolean,careers_url:string,published_at:string,created_at:string,description:string,requirements:string,
  salary:struct<min:string,max:string,currency:string,period:string>>>>"""


@board_source("recruitee", lambda: F.filter(F.from_json("payload", RECRUITEE)["offers"], lambda o: (F.coalesce(o["title"], F.lit("")) != "") & (F.coalesce(o["status"], F.lit("")).isin("", "published"))))
def recruitee(j: Job) -> dict[str, Column]:
    listed = F.transform(j("locations"), lambda l: join_present(", ", l["city"], l["country"]))
    places = F.when(F.coalesce(F.size(j("locations")), F.lit(0)) > 0, listed).otherwise(F.array(j("location")))
    codes = F.concat(F.coalesce(F.transform(j("locations"), lambda l: l["country_code"]), no_text()), F.array(j("country_code")))
    codes = F.transform(F.filter(codes, lambda c: c.rlike("^[A-Za-z]{2}$")), F.upper)
    html = lambda c: html_to_text(blank_to_null(j(c)))
    s = j("salary")
    low, high, currency = s["min"].try_cast("double"), s["max"].try_cast("double"), F.upper(s["currency"])
    period = lookup(PAY_PERIOD_WORD, F.lower(s["period"]))
    return dict(
        external_id=F.coalesce(j("guid"), j("id")),
        title=trim(j("title")),
        locations=present(places),
        country_codes=F.array_distinct(codes),
        apply_url=j("careers_url"),
        posted_at=dates.loose_timestamp(F.coalesce(j("published_at"), j("created_at"))),
        department=j("department"),
        employment_type_raw=j("employment_type_code"),
        work_mode=F.when(j("remote"), "remote").when(j("hybrid"), "hybrid").when(j("on_site"), "onsite"),
        description_text=let(F.concat_ws("\n", html("description"), html("requirements")), blank_to_null),
        salary=pay(low, high, currency, period, (low > 0) & (high >= low) & period.isNotNull() & _known_currency(currency)),
    )


# ---------------------------------------------------------------- Personio
PERSONIO = """struct<position:array<struct<id:string,name:string,office:string,department:string,schedule:string,
  employmentType:string,createdAt:string,
  jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>>"""


@board_source("personio", lambda: F.from_xml(F.col("payload"), PERSONIO)["position"], needs_id=True)
def personio(j: Job) -> dict[str, Column]:
    office = trim(F.coalesce(j("office"), F.lit("")))
    code = F.upper(F.regexp_extract(office, r"\(([A-Za-z]{2})\)\s*$", 1))
    code = F.when(code == "UK", "GB").otherwise(code)
    sections = F.transform(
        j("jobDescriptions.jobDescription"),
        lambda s: F.concat(trim(F.coalesce(s["name"], F.lit(""))), F.lit("\n"), html_to_text(F.coalesce(s["value"], F.lit("")))),
    )
    return dict(
        external_id=blank_to_null(trim(j("id"))),
        title=trim(j("name")),
        locations=present(F.array(F.regexp_replace(office, r"\s*\([A-Za-z]{2}\)\s*$", ""))),
        country_codes=present(F.array(code)),
        apply_url=F.concat(F.lit("https://"), "slug", F.lit(".jobs.personio.com/job/"), quote(trim(j("id")))),
        posted_at=dates.loose_timestamp(j("createdAt")),
        department=blank_to_null(trim(j("department"))),
        employment_type_raw=blank_to_null(join_present(" ", trim(j("schedule")), trim(j("employmentType")))),
        description_text=let(F.array_join(sections, "\n"), blank_to_null),
    )


DETAILS = {
    "smartrecruiters": smartrecruiters_details,
    "workday": workday_details,
    "bamboohr": bamboohr_details,
}
