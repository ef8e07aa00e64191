"""Choices made from evidence: websites, entities, boards, profile updates and re-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import names, rules, text
from postmill.operators import register, resolve
from postmill.session import cut_lineage

from . import duck as d
from .bindings import NOW, pick, q
from .catalog import AS_OF, Inputs, joined, query
from .q_company import PARSED, _sic_tags
from .q_pages import CAREERS, board_sql, scored_pages, sql_evidence

_GROUP = "concat('e', CAST(page_id - page_id % 5 AS VARCHAR))"


@query("K8", lambda: f"""WITH ev AS ({sql_evidence()}),
    c AS (SELECT {_GROUP} AS name_key, page_id % 5 AS position, e.*, s.url, page_id % 7 = 3 AS blocked, page_id % 35 = 4 AS claimed,
          CASE WHEN page_id % 35 = 4 THEN greatest(confidence, 0.85) ELSE confidence END AS conf FROM ev e JOIN site_pages s USING (page_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY NOT claimed, NOT (conf >= 0.8), CASE WHEN conf >= 0.8 THEN 0.0 ELSE -conf END, position) AS n FROM c WHERE NOT blocked)
    SELECT name_key, CASE WHEN conf >= 0.6 THEN 'resolved' WHEN conf >= 0.4 THEN 'candidate' ELSE 'not_found' END AS resolve_status,
           CASE WHEN conf >= 0.6 THEN lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) END AS website, CASE WHEN conf >= 0.6 THEN conf END AS website_confidence,
           CASE WHEN conf >= 0.6 THEN CASE WHEN claimed THEN 'wikidata' ELSE 'domain_guess' END END AS website_source FROM r WHERE n = 1""", ("site_pages",))
def choose_websites(spark, sf):
    p = scored_pages(spark, sf)
    blocked = F.col("page_id") % 7 == 3
    c = p.withColumn("name_key", F.concat(F.lit("e"), (F.col("page_id") - F.col("page_id") % 5).cast("string"))).withColumn(
        "position", F.col("page_id") % 5).withColumn("status", F.when(blocked, 403).otherwise(200)).withColumn(
        "html", F.when(blocked, F.concat(F.lit("captcha "), "html")).otherwise(F.col("html"))).withColumn("claimed", F.col("page_id") % 35 == 4)
    return resolve.choose_website(c).select("name_key", "resolve_status", "website", "website_confidence", "website_source")


_URL = pick("p_partkey", ("https://a.com/", "https://b.co.uk/x", "https://c.uk", "https://d.io/"))
_RANK = pick("p_size", ("normal", "preferred", "deprecated"))


@query("K5", f"""WITH c AS (SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS entity_id, p_partkey AS position, {_URL} AS url, {_RANK} AS rank FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rank <> 'preferred', NOT regexp_matches(url, '\\.(co\\.uk|uk)(/|$)'), position) AS n FROM c WHERE rank <> 'deprecated')
    SELECT entity_id, url AS website FROM r WHERE n = 1""")
def pick_website_claims(spark, sf):
    c = Inputs(spark, sf).base("part").select(F.expr("CAST(floor(p_partkey / 4) AS BIGINT)").alias("entity_id"), F.col("p_partkey").alias("position"),
                                              F.expr(_URL).alias("url"), F.expr(_RANK).alias("rank"))
    return resolve.pick_claim(c)


_LABEL = "CASE n % 3 WHEN 0 THEN name WHEN 1 THEN concat({phrase}, ' research centre') ELSE 'something else' END"


@query("K4 I8", f"""WITH b AS (SELECT name_key, name, org_id AS n, {d.core_phrase('name')} AS phrase FROM orgs),
    e AS (SELECT *, {d.normalise_text(_LABEL.format(phrase='phrase'))} AS label, n % 4 = 0 OR n % 5 = 0 AS uk FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY n) AS pos FROM e WHERE uk AND (label = phrase OR starts_with(label, concat(phrase, ' '))))
    SELECT name_key, n AS entity_id, CASE WHEN n * 3 <= 0 THEN NULL WHEN n * 3 < 10 THEN '1-9' WHEN n * 3 < 50 THEN '10-49' WHEN n * 3 < 250 THEN '50-249'
       WHEN n * 3 < 1000 THEN '250-999' WHEN n * 3 < 5000 THEN '1000-4999' ELSE '5000+' END AS size_band FROM r WHERE pos = 1""", ("orgs",))
def pick_entities(spark, sf):
    o = Inputs(spark, sf).raw("orgs").withColumn("n", F.col("org_id")).withColumn("phrase", text.core_phrase(F.col("name")))
    e = o.select("name_key", F.col("name").alias("org_name"), F.col("n").alias("position"), F.col("n").alias("entity_id"),
                 F.expr(_LABEL.format(phrase="phrase")).alias("label"), F.when(F.col("n") % 5 == 0, "A British company").otherwise("A company").alias("description"),
                 F.lit(None).cast("string").alias("website"), F.when(F.col("n") % 4 == 0, F.array(F.lit("Q145"))).otherwise(F.array(F.lit("Q30"))).alias("countries"),
                 (F.col("n") * 3).alias("employees"), F.array().cast("array<string>").alias("industry"))
    return resolve.pick_entity(e).select("name_key", "entity_id", "size_band")


@query("K15", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' Join Harbour Software today') ELSE text END AS body FROM documents)
    SELECT doc_id, contains(concat(' ', {d.normalise_text('body')}, ' '), ' harbour software ') AS named FROM t""")
def text_names_employer(spark, sf):
    t = Inputs(spark, sf).base("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Join Harbour Software today"))).otherwise(F.col("text")).alias("body"))
    return t.select("doc_id", names.text_names_employer(F.col("body"), F.lit("harbour software"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("named"))


_VENDORS = ", ".join(f"({i}, {q(v)})" for i, v in enumerate(rules.PROBE_BOARDS))


@query("K16", f"""WITH o AS (SELECT name_key, arg_min(name, org_id) AS name, min(org_id) AS k, {d.core_phrase('arg_min(name, org_id)')} AS phrase FROM orgs GROUP BY 1),
    s AS (SELECT *, slug_pos FROM o, (VALUES (0), (1), (2)) p(slug_pos)),
    p AS (SELECT s.*, v.i, v.ats FROM s, (VALUES {_VENDORS}) v(i, ats) WHERE (k + slug_pos * 3 + v.i) % 4 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY slug_pos, i) AS n FROM p)
    SELECT name_key, ats, concat('s', CAST(slug_pos AS VARCHAR)) AS slug FROM r WHERE n = 1""", ("orgs",))
def choose_boards(spark, sf):
    o = Inputs(spark, sf).raw("orgs").groupBy("name_key").agg(F.min_by("name", "org_id").alias("name"), F.min("org_id").alias("k"))
    pos = F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("slug_pos")
    vendors = F.posexplode(F.array(*map(F.lit, rules.PROBE_BOARDS))).alias("i", "ats")
    p = o.select("name_key", "name", "k", pos).select("*", vendors).select(
        "name_key", "slug_pos", F.concat(F.lit("s"), "slug_pos").alias("slug"), "ats",
        ((F.col("k") + F.col("slug_pos") * 3 + F.col("i")) % 4 == 0).alias("ok"), F.col("name").alias("board_name"),
        F.concat(F.lit("work at "), text.core_phrase(F.col("name")), F.lit(" now")).alias("job_text"))
    employers = o.select("name_key", "name", F.lit(None).cast("string").alias("website"), F.lit(None).cast("double").alias("website_confidence"))
    return resolve.choose_board(p, employers).select("name_key", "ats", "slug")


# ---------------------------------------------------------------- profile updates
def _with_provenance(profiles):
    guessed = F.create_map(F.lit("ats"), resolve.note("inferred", "job-board address guessed from the name, then checked", AS_OF))
    return profiles.withColumn("provenance", F.when(F.col("customers") % 2 == 1, guessed)).drop("customers")


_H = "(length(name_key) * 7 + length(coalesce(site_title, '')))"


@query("K18 H10 H11", f"""WITH w AS (SELECT *, resolve_status = 'resolved' AND website IS NOT NULL AND website_confidence < 0.8 AND website_source = 'domain_guess' AS weak,
      {_H} % 5 AS h, customers % 2 = 1 AS guessed FROM profiles),
    v AS (SELECT *, CASE WHEN NOT weak THEN 'unchecked' WHEN h = 0 THEN 'unreachable' WHEN h IN (1, 2) THEN 'website_dropped'
      WHEN guessed AND length(name_key) % 2 = 0 THEN 'board_dropped' ELSE 'kept' END AS verdict FROM w)
    SELECT name_key, verdict, CASE WHEN verdict = 'website_dropped' THEN 'candidate' ELSE resolve_status END AS resolve_status,
      CASE WHEN verdict <> 'website_dropped' THEN website END AS website, CASE WHEN verdict NOT IN ('website_dropped', 'board_dropped') THEN ats_type END AS ats_type,
      CASE WHEN verdict = 'website_dropped' THEN website END AS website_candidate,
      CASE WHEN verdict = 'board_dropped' THEN 'board probe' WHEN guessed THEN 'job-board address guessed from the name, then checked' END AS ats_source FROM v""", ("profiles",))
def profiles_reverified(spark, sf):
    p = _with_provenance(Inputs(spark, sf).profiles())
    h = F.expr(_H) % 5
    again = p.withColumn("h", h).where("h <> 0").select("name_key", F.when(F.col("h").isin(1, 2), 0.5).otherwise(0.75).alias("confidence"), F.array(F.lit("no UK signal")).alias("reasons"))
    ok = p.where(F.length("name_key") % 2 == 1).select("name_key")
    out = resolve.reverify(p, again, ok, AS_OF)
    return out.select("name_key", "verdict", "resolve_status", "website", "ats_type", "website_candidate", F.col("provenance")["ats"]["source"].alias("ats_source"))


@query("L15", f"""SELECT name_key, CASE WHEN length(name_key) % 3 = 0 THEN 'ashby' ELSE ats_type END AS ats_type,
    CASE WHEN length(name_key) % 3 = 0 THEN 'found' ELSE ats_slug END AS ats_slug,
    CASE WHEN length(name_key) % 3 < 2 THEN '2024-02-01 00:00:00' ELSE strftime(ats_probed_at, '%Y-%m-%d %H:%M:%S') END AS ats_probed_at,
    CASE WHEN length(name_key) % 3 = 0 THEN 'job-board address guessed' END AS ats_source FROM profiles""", ("profiles",))
def profiles_probe_outcomes(spark, sf):
    p = Inputs(spark, sf).profiles()
    n = F.length("name_key") % 3
    outcomes = p.where(n < 2).select("name_key", F.when(n == 0, "ashby").alias("ats"), F.when(n == 0, "found").alias("slug"), F.when(n == 0, "named").alias("evidence"))
    out = resolve.apply_outcomes(p, outcomes, "ats_probed_at", "inferred", "job-board address guessed", AS_OF)
    return out.select("name_key", "ats_type", "ats_slug", F.date_format("ats_probed_at", "yyyy-MM-dd HH:mm:ss").alias("ats_probed_at"),
                      F.col("provenance")["ats"]["source"].alias("ats_source"))


@query("L7", """WITH names AS (SELECT DISTINCT name_key FROM orgs)
    SELECT n.name_key, CASE WHEN length(n.name_key) % 2 = 0 THEN 'resolved' ELSE p.resolve_status END AS resolve_status,
      CASE WHEN length(n.name_key) % 2 = 0 THEN 'https://new.example.com' ELSE p.website END AS website,
      CAST(CASE WHEN p.name_key IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN length(n.name_key) % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts
    FROM names n LEFT JOIN profiles p ON p.name_key = n.name_key WHERE p.name_key IS NOT NULL OR length(n.name_key) % 2 = 0""", ("orgs", "profiles"))
def profiles_upserted(spark, sf):
    i = Inputs(spark, sf)
    stored = i.profiles().withColumn("attempts", F.lit(3))
    fresh = i.raw("orgs").select("name_key").distinct().where(F.length("name_key") % 2 == 0).select(
        "name_key", F.lit("resolved").alias("resolve_status"), F.lit("https://new.example.com").alias("website"))
    return resolve.upsert_profiles(stored, fresh, AS_OF).select("name_key", "resolve_status", "website", "attempts")


@query("L2", """WITH f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT strftime(day, '%Y-%m-%d') AS published_on FROM f WHERE dayofmonth(day) % 3 <> 0""")
def register_new_publications(spark, sf):
    files = Inputs(spark, sf).base("orders").select(F.to_date("o_orderdate").alias("published_on")).distinct()
    log = files.where(F.dayofmonth("published_on") % 3 == 0)
    return register.new_publications(files, log).select(F.date_format("published_on", "yyyy-MM-dd").alias("published_on"))


@query("L2", """WITH f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT strftime(day, '%Y-%m-%d') AS published_on FROM f WHERE dayofmonth(day) % 3 <> 0 OR day = (SELECT max(day) FROM f)""")
def register_forced_publication(spark, sf):
    files = Inputs(spark, sf).base("orders").select(F.to_date("o_orderdate").alias("published_on")).distinct()
    log = files.where(F.dayofmonth("published_on") % 3 == 0)
    again = [files.agg(F.max("published_on")).first()[0]]
    return register.new_publications(files, log, force=again).select(F.date_format("published_on", "yyyy-MM-dd").alias("published_on"))


def _landed(p):
    """The pages themselves, and careers pages on some of their hosts."""
    origin = F.lower(F.regexp_extract("url", "^(https?://[^/?#]+)", 1))
    body = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<title>Careers</title><a href="https://jobs.lever.co/team'), "page_id", F.lit('">x</a>')))
            .when(F.col("page_id") % 4 == 1, "<h1>Join us</h1>").otherwise("<title>Nothing here</title>"))
    more = p.where("page_id % 3 <> 1").select(
        F.concat(origin, F.when(F.col("page_id") % 2 == 0, "/careers").otherwise("/careers/open")).alias("url"), "page_id", body.alias("html"))
    one = more.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    return p.select("url", "html").unionByName(one).withColumn("status", F.lit(200))


_TAGS_OF = f"flatten(list_transform(list_filter(sic, lambda c: {_sic_tags('c')} <> ''), lambda c: string_split({_sic_tags('c')}, ',')))"


def sql_assembled() -> str:
    origin = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"
    tag = lambda t: f"regexp_extract(html, '(?i)<{t}\\b[^>]*>([\\s\\S]*?)</{t}>', 1)"
    paths = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(rules.CAREER_PATHS))
    site = d.sector_tags("title", rules.SITE_TEXT_TAGS)
    return f"""WITH {PARSED}, {CAREERS}, ev AS ({sql_evidence()}),
    c AS (SELECT concat('e', CAST(page_id - page_id % 5 AS VARCHAR)) AS name_key, page_id % 5 AS position, e.*, s.url, s.html, page_id % 5 = 4 AS claimed,
          CASE WHEN page_id % 5 = 4 THEN greatest(confidence, 0.85) ELSE confidence END AS conf FROM ev e JOIN site_pages s USING (page_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY NOT claimed, NOT (conf >= 0.8), CASE WHEN conf >= 0.8 THEN 0.0 ELSE -conf END, position) AS n FROM c),
    w AS (SELECT *, {origin} AS home, CASE WHEN conf >= 0.6 THEN 'resolved' WHEN conf >= 0.4 THEN 'candidate' ELSE 'not_found' END AS status FROM r WHERE n = 1),
    ok AS (SELECT * FROM w WHERE status = 'resolved'),
    more AS (SELECT concat({origin}, CASE WHEN page_id % 2 = 0 THEN '/careers' ELSE '/careers/open' END) AS url, page_id,
          CASE page_id % 4 WHEN 0 THEN concat('<title>Careers</title><a href="https://jobs.lever.co/team', CAST(page_id AS VARCHAR), '">x</a>') WHEN 1 THEN '<h1>Join us</h1>'
               ELSE '<title>Nothing here</title>' END AS html FROM site_pages WHERE page_id % 3 <> 1),
    landed AS (SELECT url, html FROM site_pages UNION ALL SELECT url, arg_min(html, page_id) FROM more GROUP BY url),
    page AS (SELECT url, coalesce({board_sql('url')}, {board_sql('html')}) AS board, {d.rx(f"concat_ws(' ', {tag('title')}, {tag('h1')})", rules.CAREER_HEADING)} AS speaks FROM landed),
    followed AS (SELECT o.name_key, t.link, t.rank, {board_sql('t.link')} AS direct, page.board AS page_board, page.url IS NOT NULL AS seen
          FROM ok o JOIN top t ON t.page_id = o.page_id LEFT JOIN page ON page.url = t.link),
    by_link AS (SELECT name_key, arg_min(link, rank) FILTER (direct IS NOT NULL OR seen) AS careers_url,
          arg_min(coalesce(direct, page_board), rank) FILTER (coalesce(direct, page_board) IS NOT NULL) AS link_board FROM followed GROUP BY 1),
    tried AS (SELECT o.name_key, p.n AS n, page.url AS link, page.board AS board FROM ok o, (VALUES {paths}) p(n, path) JOIN page ON page.url = concat(o.home, p.path) WHERE page.speaks),
    common AS (SELECT name_key, arg_min(struct_pack(link := link, board := board), n) AS m FROM tried GROUP BY 1),
    careers AS (SELECT o.name_key, coalesce(l.careers_url, x.m.link) AS careers_url,
          coalesce({board_sql('o.html')}, l.link_board, CASE WHEN l.careers_url IS NULL THEN x.m.board END) AS board
        FROM ok o LEFT JOIN by_link l ON l.name_key = o.name_key LEFT JOIN common x ON x.name_key = o.name_key),
    labels AS (SELECT *, {d.normalise_text("CASE page_id % 3 WHEN 0 THEN phrase WHEN 1 THEN concat(phrase, ' research centre') ELSE 'something else' END")} AS label FROM c),
    found AS (SELECT name_key, min(page_id) AS k FROM labels WHERE page_id % 4 = 0 AND (label = phrase OR starts_with(label, concat(phrase, ' '))) GROUP BY 1),
    firms AS (SELECT concat('e', CAST(CAST(number AS BIGINT) * 5 AS VARCHAR)) AS name_key, number, status, born, sic FROM companies),
    j AS (SELECT w.*, k.careers_url, k.board, f.k, b.number, b.born, coalesce(b.sic, []) AS sic, CASE WHEN w.status = 'resolved' THEN {site} ELSE '' END AS site
        FROM w LEFT JOIN careers k ON k.name_key = w.name_key LEFT JOIN found f ON f.name_key = w.name_key LEFT JOIN firms b ON b.name_key = w.name_key),
    t AS (SELECT *, list_concat({_TAGS_OF}, CASE WHEN site = '' THEN [] ELSE string_split(concat(site, ',tech'), ',') END) AS tags FROM j)
    SELECT name_key, status AS resolve_status, CASE WHEN status = 'resolved' THEN home END AS website, careers_url,
      CASE WHEN board IS NOT NULL THEN string_split(board, ':')[1] END AS ats_type, CASE WHEN board IS NOT NULL THEN substr(board, strpos(board, ':') + 1) END AS ats_slug,
      array_to_string(list_filter(tags, lambda e, i: list_position(tags, e) = i), ',') AS sector_tags,
      'Q' || CAST(k AS VARCHAR) AS wikidata_id, CASE WHEN k * 3 <= 0 THEN NULL WHEN k * 3 < 10 THEN '1-9' WHEN k * 3 < 50 THEN '10-49' WHEN k * 3 < 250 THEN '50-249'
        WHEN k * 3 < 1000 THEN '250-999' WHEN k * 3 < 5000 THEN '1000-4999' WHEN k IS NOT NULL THEN '5000+' END AS size_band,
      number AS companies_house_no, strftime(born, '%Y-%m-%d') AS incorporated_on,
      CASE WHEN status = 'resolved' THEN 'inferred' ELSE 'unconfirmed' END AS website_status,
      CASE WHEN status <> 'not_found' AND claimed THEN 'wikidata' ELSE 'domain_guess' END AS website_source,
      CASE WHEN status = 'resolved' THEN CASE WHEN careers_url IS NULL THEN 'unconfirmed' WHEN conf >= 0.85 THEN 'verified' ELSE 'inferred' END END AS careers_status,
      board AS ats_note FROM t"""


@query("K12 K17", sql_assembled, ("site_pages", "company_rows"))
def profiles_assembled(spark, sf):
    """The whole research job over landed pages: evidence, website, careers, board, entity, company, profile."""
    from postmill.operators import pages

    p = scored_pages(spark, sf).withColumn("name_key", F.concat(F.lit("e"), (F.col("page_id") - F.col("page_id") % 5).cast("string")))
    c = p.withColumn("position", F.col("page_id") % 5).withColumn("status", F.lit(200)).withColumn("claimed", F.col("page_id") % 5 == 4)
    # Written once: both the homes' links and the profiles are read from it, and each would score all pages anew.
    sites = cut_lineage(resolve.choose_website(c))
    homes = sites.where("home_url is not null").join(p.select("name_key", F.col("url").alias("home_url"), "html"), ["name_key", "home_url"])
    links = pages.careers_links(homes.withColumnRenamed("home_url", "url"), ["name_key"])
    careers = resolve.choose_careers(homes, links, _landed(p.select("page_id", "url", "html")))
    n = F.col("page_id")
    phrase = text.core_phrase(F.col("org_name"))
    label = F.when(n % 3 == 0, phrase).when(n % 3 == 1, F.concat(phrase, F.lit(" research centre"))).otherwise("something else")
    none = F.lit(None).cast("string")
    entities = resolve.pick_entity(p.select(
        "name_key", "org_name", n.alias("position"), F.concat(F.lit("Q"), n).alias("entity_id"), label.alias("label"), F.lit("A company").alias("description"), none.alias("website"),
        F.when(n % 4 == 0, F.array(F.lit("Q145"))).otherwise(F.array(F.lit("Q30"))).alias("countries"), (n * 3).alias("employees"), F.array(F.lit("software")).alias("industry")))
    firms = Inputs(spark, sf).company_rows()
    companies = firms.select(F.concat(F.lit("e"), F.col("number").cast("long") * 5).alias("name_key"), "number", "status", "incorporated_on", "sic_codes")
    out = resolve.assemble_profiles(sites, careers, entities, companies, AS_OF)
    said = lambda key, what: F.col("provenance")[key][what]
    return out.select("name_key", "resolve_status", "website", "careers_url", "ats_type", "ats_slug", joined("sector_tags"), "wikidata_id", "size_band", "companies_house_no",
                      F.date_format("incorporated_on", "yyyy-MM-dd").alias("incorporated_on"), said("website", "status").alias("website_status"),
                      said("website", "source").alias("website_source"), said("careers_url", "status").alias("careers_status"), said("ats", "detail").alias("ats_note"))
