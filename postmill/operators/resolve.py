"""From evidence to profiles: websites, careers pages, boards, entities, and re-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, names, rules, urls
from ..functions.dates import instant
from ..functions.text import blank_to_null, core_phrase, matches, normalise_text
from .company_match import merge_maps
from .pages import blocks_robots, board_link

_PROV = "struct<status:string,source:string,confidence:double,detail:string,checked_at:timestamp>"


def note(status, source, as_of, confidence=None, detail=None) -> Column:
    """One provenance entry."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        col(status).alias("status"), col(source).alias("source"), col(confidence).alias("confidence"),
        col(detail).alias("detail"), instant(as_of).alias("checked_at"),
    ).cast(_PROV)


def domain_guesses(employers: DataFrame) -> DataFrame:
    """(name_key, position, domain) for every employer with a usable name."""
    guesses = names.domain_candidates(core_phrase(F.col("name")))
    return employers.select("name_key", F.posexplode(guesses).alias("position", "domain"))


# ---------------------------------------------------------------- websites
def choose_website(candidates: DataFrame) -> DataFrame:
    """One website decision per employer.

    ``candidates``: name_key, org_name, position, url, status, html, confidence,
    reasons, title, description, claimed (an official claim rather than a guess).
    A claim that could be read wins; else the first guess of at least 0.8 in
    guess order, else the best. A site that shuts robots out is remembered only
    when its domain is the employer's own name, and stays a candidate.
    """
    phrase = core_phrase(F.col("org_name"))
    label = urls.host_label(F.col("url"))
    first = F.split_part(phrase, F.lit(" "), F.lit(1))
    own_name = (label == names.joined_words(phrase)) | ((label == first) & (F.length(first) >= 7))
    c = candidates.withColumn("blocked", blocks_robots(F.col("status"), F.col("html")))
    c = c.withColumn("readable", ~F.col("blocked") & (F.col("status") < 400)).withColumn("own_name", own_name)
    confidence = F.when(F.col("claimed"), F.greatest("confidence", F.lit(rules.CLAIMED_WEBSITE))).otherwise(F.col("confidence"))
    why = F.when(F.col("claimed"), F.concat(F.array(F.lit(rules.CLAIM_REASON)), F.col("reasons"))).otherwise(F.col("reasons"))
    c = c.withColumn("confidence", confidence).withColumn("reasons", why)
    strong = F.col("confidence") >= rules.STRONG_WEBSITE
    order = F.struct(
        ~F.col("claimed"), ~strong, F.when(strong, 0.0).otherwise(-F.col("confidence")), F.col("position")
    )
    site = F.struct("url", "confidence", "reasons", "title", "description", "claimed")
    picked = c.groupBy("name_key").agg(
        F.min_by(F.when(F.col("readable"), site), F.when(F.col("readable"), order)).alias("best"),
        F.min_by(F.when(F.col("blocked") & F.col("own_name"), F.col("url")),
                 F.when(F.col("blocked") & F.col("own_name"), F.col("position"))).alias("blocked_url"),
    )
    conf = F.coalesce("best.confidence", F.lit(0.0))
    status = (
        F.when(conf >= rules.ACCEPT_WEBSITE, "resolved")
        .when(conf >= rules.CANDIDATE_WEBSITE, "candidate")
        .when(F.col("blocked_url").isNotNull(), "candidate")
        .otherwise("not_found")
    )
    ok = F.col("resolve_status") == "resolved"
    return picked.withColumn("resolve_status", status).select(
        "name_key",
        "resolve_status",
        F.when(ok, urls.origin(F.col("best.url"))).alias("website"),
        F.when(ok, conf).alias("website_confidence"),
        F.when(ok, F.when(F.col("best.claimed"), "wikidata").otherwise("domain_guess")).alias("website_source"),
        F.when(F.col("resolve_status") == "candidate", F.when(conf >= rules.CANDIDATE_WEBSITE, conf)).alias("candidate_confidence"),
        F.when(F.col("resolve_status") == "candidate", F.when(conf >= rules.CANDIDATE_WEBSITE, F.when(F.col("best.claimed"), "wikidata").otherwise("domain_guess")))
        .alias("candidate_source"),
        F.when((F.col("resolve_status") == "candidate"),
               F.when(conf >= rules.CANDIDATE_WEBSITE, F.col("best.url")).otherwise(urls.origin(F.col("blocked_url"))))
        .alias("website_candidate"),
        F.when(ok, blank_to_null(F.col("best.title"))).alias("site_title"),
        F.when(ok, blank_to_null(F.col("best.description"))).alias("site_description"),
        F.array_join("best.reasons", "; ").alias("website_reasons"),
        F.when(ok, F.col("best.url")).alias("home_url"),
    )


def pick_claim(claims: DataFrame) -> DataFrame:
    """Official website per entity: preferred rank first, then a UK domain, then order.

    ``claims``: entity_id, position, url, rank. A UK domain only wins inside the
    best rank present, as the others are then out of the running.
    """
    live = claims.where((F.col("rank") != "deprecated") & F.col("url").isNotNull())
    uk = matches(F.col("url"), rules.UK_WEBSITE)
    order = F.struct(F.col("rank") != "preferred", ~uk, F.col("position"))
    return live.groupBy("entity_id").agg(F.min_by("url", order).alias("website"))


def pick_entity(entities: DataFrame) -> DataFrame:
    """First entity per employer with UK evidence and a label that is, or begins with, its phrase.

    ``entities``: name_key, org_name, position, entity_id, label, description,
    website, countries, employees, industry.
    """
    wanted = core_phrase(F.col("org_name"))
    label = normalise_text(F.coalesce("label", F.lit("")))
    uk = (
        F.coalesce(F.array_contains("countries", "Q145"), F.lit(False))
        | F.coalesce(matches(F.col("description"), rules.UK_DESCRIPTION), F.lit(False))
        | F.coalesce(matches(F.col("website"), rules.UK_WEBSITE), F.lit(False))
    )
    named = (label == wanted) | F.startswith(label, F.concat(wanted, F.lit(" ")))
    row = F.struct("entity_id", "website", "employees", "industry")
    return entities.where(uk & named).groupBy("name_key").agg(F.min_by(row, F.col("position")).alias("e")).select(
        "name_key", "e.*", classify.size_band(F.abs("e.employees")).alias("size_band")
    )


# ---------------------------------------------------------------- careers pages and boards
def choose_careers(homes: DataFrame, links: DataFrame, landed: DataFrame) -> DataFrame:
    """Careers page and board per employer.

    ``homes``: name_key, home_url, html. ``links``: name_key, rank, link.
    ``landed``: url, status, html of fetched pages. A board found on the home page
    stands; else the first link that is, or leads to, a board. With no usable link
    the common addresses count if their heading speaks of careers.
    """
    home = homes.select("name_key", "home_url", board_link(F.col("html")).alias("home_board"))
    page = landed.where("status < 400").select(
        F.col("url").alias("link"), "url",
        F.coalesce(board_link(F.col("url")), board_link(F.col("html"))).alias("page_board"),
        matches(F.concat_ws(" ", F.regexp_extract("html", r"(?i)<title\b[^>]*>([\s\S]*?)</title>", 1),
                            F.regexp_extract("html", r"(?i)<h1\b[^>]*>([\s\S]*?)</h1>", 1)),
                rules.CAREER_HEADING).alias("speaks"),
    )
    followed = links.join(page, "link", "left").withColumn("direct", board_link(F.col("link")))
    usable = F.col("direct").isNotNull() | F.col("url").isNotNull()
    board = F.coalesce("direct", "page_board")
    by_link = followed.groupBy("name_key").agg(
        F.min_by(F.when(usable, F.col("link")), F.when(usable, F.col("rank"))).alias("careers_url"),
        F.min_by(board, F.when(board.isNotNull(), F.col("rank"))).alias("link_board"),
    )
    paths = F.array(*map(F.lit, rules.CAREER_PATHS))
    common = home.select("name_key", "home_url", F.posexplode(paths).alias("n", "path"))
    common = common.withColumn("link", F.concat(urls.origin(F.col("home_url")), "path"))
    common = common.join(page.where("speaks"), "link").groupBy("name_key").agg(
        F.min_by(F.struct("link", "page_board"), F.col("n")).alias("common")
    )
    out = home.join(by_link, "name_key", "left").join(common, "name_key", "left")
    no_link = F.col("careers_url").isNull()
    chosen = F.coalesce("home_board", "link_board", F.when(no_link, F.col("common.page_board")))
    return out.select(
        "name_key",
        F.coalesce("careers_url", "common.link").alias("careers_url"),
        chosen["ats"].alias("ats_type"),
        chosen["slug"].alias("ats_slug"),
    )


def slug_guesses(employers: DataFrame) -> DataFrame:
    """(name_key, slug_pos, slug) of likely board addresses."""
    slugs = names.slug_candidates(core_phrase(F.col("name")), F.col("website"))
    return employers.select("name_key", F.posexplode(slugs).alias("slug_pos", "slug"))


def choose_board(probes: DataFrame, employers: DataFrame) -> DataFrame:
    """Verified board per employer from landed probe answers.

    ``probes``: name_key, slug_pos, slug, ats, ok, board_name, job_text. Boards with
    a company name must name the employer; the others' posting text must.
    Slugs are tried in order, and for each slug the vendors in order.
    """
    e = employers.select("name_key", core_phrase(F.col("name")).alias("phrase"), "website", "website_confidence")
    j = probes.where("ok").join(e, "name_key")
    args = (F.col("phrase"), F.col("website"), F.col("website_confidence"))
    by_name = F.col("ats").isin("greenhouse", "workable", "smartrecruiters")
    good = F.when(by_name, names.board_name_matches(F.col("board_name"), *args)).otherwise(
        names.text_names_employer(F.coalesce("job_text", F.lit("")), *args)
    )
    vendor = F.array_position(F.array(*map(F.lit, rules.PROBE_BOARDS)), F.col("ats"))
    named = F.concat(F.initcap("ats"), F.lit(' board named "'), "board_name", F.lit('"'))
    said = F.concat(F.initcap("ats"), F.lit(" job text names the organisation"))
    hit = F.struct("ats", "slug", F.when(by_name, named).otherwise(said).alias("evidence"))
    return j.where(good).groupBy("name_key").agg(
        F.min_by(hit, F.struct(F.col("slug_pos"), vendor)).alias("h")
    ).select("name_key", "h.*")


def apply_outcomes(profiles: DataFrame, outcomes: DataFrame, checked_column: str, status: str, source: str, as_of) -> DataFrame:
    """Profiles after a probe or discovery run.

    ``outcomes``: name_key, ats, slug, evidence (ats null when nothing was found).
    A find sets the board and its provenance; either way the check is stamped.
    """
    o = outcomes.select("name_key", F.col("ats").alias("_ats"), F.col("slug").alias("_slug"),
                        F.col("evidence").alias("_evidence"), F.lit(True).alias("_checked"))
    j = profiles.join(o, "name_key", "left")
    hit = F.col("_ats").isNotNull()
    entry = F.when(hit, F.create_map(F.lit("ats"), note(status, source, as_of, detail=F.col("_evidence"))))
    new = {
        "ats_type": F.coalesce("_ats", "ats_type"),
        "ats_slug": F.coalesce("_slug", "ats_slug"),
        checked_column: F.when(F.col("_checked"), instant(as_of)).otherwise(F.col(checked_column)),
        "provenance": merge_maps(F.col("provenance"), entry),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in profiles.columns])


# ---------------------------------------------------------------- profiles
def assemble_profiles(websites: DataFrame, careers: DataFrame, entities: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """Profile rows with provenance, from the outputs of the choosers above."""
    j = (
        websites.join(careers, "name_key", "left")
        .join(entities.select("name_key", F.col("entity_id").alias("wikidata_id"), "size_band", "industry"), "name_key", "left")
        .join(companies.select("name_key", F.col("number").alias("companies_house_no"), F.col("status").alias("ch_status"),
                               "incorporated_on", "sic_codes"), "name_key", "left")
    )
    site_text = F.concat_ws(" ", "site_title", "site_description")
    ok = F.col("resolve_status") == "resolved"
    company = F.col("companies_house_no").isNotNull()
    codes = F.coalesce("sic_codes", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(
        F.transform(classify.sic_evidence(codes), lambda e: e["tag"]),
        F.when(ok, classify.site_sector_tags(site_text)).otherwise(none),
    ))
    trusted = F.col("website_confidence") >= rules.CLAIMED_WEBSITE
    entry = lambda key, cond, value: F.when(cond, F.struct(F.lit(key).alias("key"), value.alias("value")))
    website_note = (
        F.when(ok, note("inferred", F.col("website_source"), as_of, F.col("website_confidence"), F.col("website_reasons")))
        .when(F.col("resolve_status") == "candidate",
              F.when(F.col("candidate_source").isNull(), note("unconfirmed", "domain_guess", as_of, None, rules.BLOCKED_NOTE)).otherwise(
                  note("unconfirmed", F.col("candidate_source"), as_of, F.col("candidate_confidence"),
                       F.concat(F.lit(rules.CANDIDATE_NOTE), F.coalesce("website_reasons", F.lit(""))))))
        .otherwise(note("unconfirmed", "domain_guess", as_of, None, rules.NO_WEBSITE_NOTE))
    )
    careers_note = F.when(
        F.col("careers_url").isNotNull(),
        note(F.when(trusted, "verified").otherwise("inferred"), "link on organisation website", as_of, None,
             F.when(~trusted, rules.UNSURE_CAREERS_NOTE)),
    ).otherwise(note("unconfirmed", "link on organisation website", as_of, None, rules.NO_CAREERS_NOTE))
    provenance = F.map_from_entries(F.array_compact(F.array(
        entry("wikidata", F.col("wikidata_id").isNotNull(), note("inferred", "wikidata", as_of, None, F.col("wikidata_id"))),
        entry("size_band", F.col("size_band").isNotNull(), note("inferred", "wikidata", as_of)),
        entry("companies_house", company, note("verified", "companies_house", as_of, None, F.col("companies_house_no"))),
        entry("website", F.lit(True), website_note),
        entry("sector_tags", ok & (F.size("sector_tags") > 0),
              note("inferred", F.when(company, "companies_house+website_text").otherwise("website_text"), as_of)),
        entry("careers_url", ok, careers_note),
        entry("ats", ok & F.col("ats_type").isNotNull(),
              note("verified", "link or embed on careers page", as_of, None, F.concat("ats_type", F.lit(":"), "ats_slug"))),
    )))
    j = j.withColumn("sector_tags", tags)
    for c in ("careers_url", "ats_type", "ats_slug"):
        j = j.withColumn(c, F.when(ok, F.col(c)))
    return j.withColumn("provenance", provenance).withColumn("resolved_at", F.when(ok, instant(as_of)))


def upsert_profiles(stored: DataFrame, fresh: DataFrame, as_of) -> DataFrame:
    """Stored profiles with researched ones replaced and their attempts counted up."""
    shared = [c for c in fresh.columns if c in stored.columns and c not in ("name_key", "attempts")]
    s, f = stored.alias("s"), fresh.select("name_key", *shared).withColumn("_new", F.lit(True)).alias("f")
    j = s.join(f, "name_key", "full_outer")
    new = F.coalesce(F.col("f._new"), F.lit(False))
    out = []
    for c in stored.columns:
        if c == "name_key":
            out.append(F.col("name_key"))
        elif c == "attempts":
            out.append((F.coalesce("s.attempts", F.lit(0)) + F.when(new, 1).otherwise(0)).cast("int").alias(c))
        elif c == "updated_at":
            out.append(F.when(new, instant(as_of)).otherwise(F.col("s.updated_at")).alias(c))
        elif c in shared:
            out.append(F.when(new, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        else:
            out.append(F.col(f"s.{c}"))
    return j.select(*out)


# ---------------------------------------------------------------- re-checks
def weak_websites(profiles: DataFrame) -> DataFrame:
    return profiles.where(
        "resolve_status = 'resolved' and website is not null and website_confidence < 0.8 and website_source = 'domain_guess'"
    )


def reverify(profiles: DataFrame, rechecked: DataFrame, boards_ok: DataFrame, as_of) -> DataFrame:
    """Profiles after the weak ones were scored again, with ``verdict`` per row.

    ``rechecked``: name_key, confidence, reasons of pages that could be fetched.
    A website below 0.6 is demoted to candidate and takes the board with it; a
    guessed board that no longer verifies (absent from ``boards_ok``) is dropped.
    Unreachable sites are left alone.
    """
    weak = weak_websites(profiles).select("name_key").withColumn("_weak", F.lit(True))
    r = rechecked.select("name_key", F.col("confidence").alias("_conf"), F.array_join("reasons", "; ").alias("_why"))
    b = boards_ok.select("name_key").distinct().withColumn("_board_ok", F.lit(True))
    j = profiles.join(weak, "name_key", "left").join(r, "name_key", "left").join(b, "name_key", "left")
    guessed = F.startswith(F.col("provenance")["ats"]["source"], F.lit("job-board address guessed"))
    verdict = (
        F.when(F.col("_weak").isNull(), "unchecked")
        .when(F.col("_conf").isNull(), "unreachable")
        .when(F.col("_conf") < rules.ACCEPT_WEBSITE, "website_dropped")
        .when(F.coalesce(guessed, F.lit(False)) & F.col("_board_ok").isNull(), "board_dropped")
        .otherwise("kept")
    )
    j = j.withColumn("verdict", verdict)
    site_gone = F.col("verdict") == "website_dropped"
    board_gone = F.col("verdict").isin("website_dropped", "board_dropped")
    why = F.concat(F.lit("failed re-verification: "), F.when(F.coalesce("_why", F.lit("")) != "", F.col("_why")).otherwise("no longer matches"))
    own = lambda c: F.col(c)
    codes = F.coalesce("sic_codes", F.array().cast("array<string>"))
    notes = (
        F.when(site_gone, F.create_map(
            F.lit("website"), note("unconfirmed", "domain_guess", as_of, None, why),
            F.lit("careers_url"), note("unconfirmed", "website", as_of, None, "website no longer trusted")))
        .when(board_gone, F.create_map(F.lit("ats"), note(
            "unconfirmed", "board probe", as_of, None,
            "failed re-verification: the job board no longer passes the stricter ownership checks")))
    )
    gone_columns = ("website", "website_confidence", "careers_url", "site_title", "site_description")
    new = {
        "resolve_status": F.when(site_gone, "candidate").otherwise(own("resolve_status")),
        "website_candidate": F.when(site_gone, own("website")).otherwise(own("website_candidate")),
        "sector_tags": F.when(site_gone, F.array_distinct(F.transform(classify.sic_evidence(codes), lambda e: e["tag"])))
        .otherwise(own("sector_tags")),
        "ats_type": F.when(~board_gone, own("ats_type")),
        "ats_slug": F.when(~board_gone, own("ats_slug")),
        "provenance": merge_maps(own("provenance"), notes),
        "updated_at": F.when(board_gone, instant(as_of)).otherwise(own("updated_at")),
        **{c: F.when(~site_gone, own(c)) for c in gone_columns},
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in profiles.columns], "verdict")


def without_dropped(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Postings or scans of employers that kept their board."""
    gone = verdicts.where(F.col("verdict").isin("website_dropped", "board_dropped")).select("name_key")
    return rows.join(gone, "name_key", "left_anti")
