"""Pages and entity resolution: name guesses, link detection, evidence, choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import names, rules, text
from postmill.functions.patterns import re2
from postmill.operators import pages, resolve

from . import duck as d
from .bindings import NOW, q
from .catalog import AS_OF, Inputs, joined, query

# ---------------------------------------------------------------- names
_W = "string_split(phrase, ' ')"
_TLDS = ", ".join(q(t) for t in rules.DOMAIN_ENDINGS)


@query("K6", f"""
    WITH n AS (SELECT name_key, {d.core_phrase('name')} AS phrase FROM (SELECT name_key, arg_min(name, org_id) AS name FROM orgs GROUP BY 1) o),
      v AS (SELECT name_key, list_filter([CASE WHEN len({_W}) <= 3 THEN array_to_string({_W}, '') END, CASE WHEN len({_W}) >= 2 THEN concat({_W}[1], {_W}[2]) END,
          CASE WHEN length({_W}[1]) >= 4 OR len({_W}) = 1 THEN {_W}[1] END, CASE WHEN len({_W}) BETWEEN 2 AND 3 THEN array_to_string({_W}, '-') END],
          lambda x: x IS NOT NULL AND length(x) BETWEEN 3 AND 40) AS vs FROM n),
      u AS (SELECT name_key, list_filter(vs, lambda x, i: list_position(vs, x) = i) AS vs FROM v)
    SELECT name_key, array_to_string(flatten(list_transform([{_TLDS}], lambda t: list_transform(vs, lambda x: concat(x, '.', t)))), ',') AS domains FROM u""", ("orgs",))
def name_domains(spark, sf):
    orgs = Inputs(spark, sf).raw("orgs").groupBy("name_key").agg(F.min_by("name", "org_id").alias("name"))
    return orgs.select("name_key", F.array_join(names.domain_candidates(text.core_phrase(F.col("name"))), ",").alias("domains"))


@query("K13", f"""
    WITH n AS (SELECT o.name_key, {d.core_phrase('name')} AS phrase, p.website FROM (SELECT name_key, arg_min(name, org_id) AS name FROM orgs GROUP BY 1) o JOIN profiles p ON p.name_key = o.name_key),
      v AS (SELECT name_key, list_filter([CASE WHEN website IS NOT NULL THEN regexp_extract(website, '^https?://(?:www\\.)?([^./]+)', 1) END, array_to_string({_W}, ''),
          array_to_string({_W}, '-'), CASE WHEN length({_W}[1]) >= 4 THEN {_W}[1] END, CASE WHEN len({_W}) >= 2 THEN concat({_W}[1], {_W}[2]) END],
          lambda x: x IS NOT NULL AND regexp_matches(x, '^[a-z0-9][a-z0-9-]{{2,40}}$')) AS vs FROM n)
    SELECT name_key, array_to_string(list_filter(vs, lambda x, i: list_position(vs, x) = i), ',') AS slugs FROM v""", ("orgs", "profiles"))
def name_slugs(spark, sf):
    i = Inputs(spark, sf)
    orgs = i.raw("orgs").groupBy("name_key").agg(F.min_by("name", "org_id").alias("name")).join(i.raw("profiles").select("name_key", "website"), "name_key")
    return orgs.select("name_key", F.array_join(names.slug_candidates(text.core_phrase(F.col("name")), F.col("website")), ",").alias("slugs"))


_COMMON = ", ".join(q(w) for w in rules.COMMON_WORDS)
_BOARD = "concat(n.w1, CASE n.k % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', n.w2) ELSE concat(' ', n.w2, ' ', n.w3) END, ' Group Ltd')"


@query("K14", f"""
    WITH n AS (SELECT o.name_key, org_id AS k, {d.core_phrase('name')} AS phrase, p.website, p.website_confidence AS conf,
          string_split({d.core_phrase('name')}, ' ')[1] AS w1, coalesce(string_split({d.core_phrase('name')}, ' ')[2], '') AS w2, coalesce(string_split({d.core_phrase('name')}, ' ')[3], '') AS w3
        FROM orgs o JOIN profiles p ON p.name_key = o.name_key),
      b AS (SELECT n.*, {d.core_phrase(_BOARD)} AS theirs, CASE WHEN conf >= 0.8 THEN regexp_extract(website, '^https?://(?:www\\.)?([^./]+)', 1) END AS label FROM n),
      s AS (SELECT *, CASE WHEN len(string_split(theirs, ' ')) <= len(string_split(phrase, ' ')) THEN theirs ELSE phrase END AS shared FROM b),
      t AS (SELECT *, theirs = phrase AS same, starts_with(phrase, concat(theirs, ' ')) OR starts_with(theirs, concat(phrase, ' ')) AS begins,
          coalesce(label = replace(shared, ' ', '') OR label = replace(shared, ' ', '-'), false) AS agrees,
          len(list_filter(string_split(shared, ' '), lambda w: NOT (w IN ({_COMMON}) OR length(w) < 4))) = 0 AS common FROM s)
    SELECT k AS org_id, theirs, theirs <> '' AND phrase <> '' AND ((same AND NOT common) OR ((same OR begins) AND agrees)) AS matches FROM t""", ("orgs", "profiles"))
def board_name_agreement(spark, sf):
    i = Inputs(spark, sf)
    n = i.raw("orgs").select("name_key", "org_id", text.core_phrase(F.col("name")).alias("phrase")).join(
        i.raw("profiles").select("name_key", "website", "website_confidence"), "name_key")
    w = lambda k: F.coalesce(F.try_element_at(F.split("phrase", " "), F.lit(k)), F.lit(""))
    k = F.col("org_id") % 4
    board = F.concat(w(1), F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), w(2))).otherwise(F.concat(F.lit(" "), w(2), F.lit(" "), w(3))), F.lit(" Group Ltd"))
    return n.withColumn("board", board).select("org_id", text.core_phrase(F.col("board")).alias("theirs"),
        names.board_name_matches(F.col("board"), F.col("phrase"), F.col("website"), F.col("website_confidence")).alias("matches"))


# ---------------------------------------------------------------- links
def board_sql(expr: str) -> str:
    reserved = ", ".join(q(s) for s in rules.RESERVED_SLUGS)
    arms = []
    for vendor, pattern in rules.BOARD_LINKS:
        g = lambda n: f"regexp_extract_all({expr}, {q(re2(pattern))}, {n})"  # noqa: E731, B023
        if vendor == "greenhouse":
            slugs = f"list_transform(list_zip({g(1)}, {g(2)}), lambda z: CASE WHEN coalesce(z[1], '') <> '' THEN z[1] ELSE z[2] END)"
        elif vendor == "workday":
            slugs = f"list_transform(list_zip({g(1)}, {g(2)}, {g(3)}), lambda z: concat(z[1], '.', lower(z[2]), '/', z[3]))"
        else:
            slugs = g(1)
        first = f"list_filter({slugs}, lambda s: s <> '' AND lower(s) NOT IN ({reserved}))[1]"
        arms.append(f"CASE WHEN {first} IS NOT NULL THEN concat('{vendor}', ':', {first}) END")
    return f"coalesce({', '.join(arms)})"


@query("K9", f"""SELECT page_id, {board_sql('html')} AS board FROM site_pages""", ("site_pages",))
def page_board_links(spark, sf):
    p = Inputs(spark, sf).raw("site_pages")
    return p.withColumn("b", pages.board_link(F.col("html"))).select("page_id", F.when(F.col("b").isNotNull(), F.concat("b.ats", F.lit(":"), "b.slug")).alias("board"))


_A = r"<a\b([^>]*)>([\s\S]*?)</a>"
_TXT = "trim(regexp_replace(regexp_replace(inner_html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
# Every link in these pages is absolute or starts with '/'.
LINKS = f"""
  a0 AS (SELECT page_id, url, unnest(list_zip(regexp_extract_all(html, {q('(?i)' + _A)}, 1), regexp_extract_all(html, {q('(?i)' + _A)}, 2),
         generate_series(1, len(regexp_extract_all(html, {q('(?i)' + _A)}, 1))))) AS z FROM site_pages),
  a1 AS (SELECT page_id, url, z[3] AS pos, replace(trim(regexp_extract(z[1], '(?i)href="([^"]*)"', 1)), '&amp;', '&') AS href, z[2] AS inner_html FROM a0),
  a2 AS (SELECT *, {_TXT} AS txt, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin,
         regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM a1 WHERE href <> '' AND NOT starts_with(href, '#')),
  a3 AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(href, '^https?:') THEN href ELSE concat(origin, replace(href, ' ', '%20')) END, '#.*$', '') AS link FROM a2
         WHERE regexp_matches(href, '^(https?:|/)')),
  a4 AS (SELECT *, regexp_replace(lower(regexp_extract(link, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS lhost,
         CASE WHEN regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1) END AS path,
         CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS upath FROM a3)"""


def _top(inner: str) -> str:
    return f"""SELECT page_id, link, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM (
        SELECT page_id, link, max(score) AS score, min(pos) AS pos FROM ({inner}) s GROUP BY 1, 2) b) r"""


_ROOT = "array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.')"


CAREERS = f"""{LINKS}, scored AS (SELECT *, {board_sql('link')} IS NOT NULL AS board FROM a4 WHERE NOT {d.rx('href', rules.CAREER_NOISE)}), """ + _top(
    f"""SELECT * FROM (SELECT *, CAST(CASE WHEN board THEN 6 ELSE 0 END + CASE WHEN {d.rx("concat(path, regexp_extract(link, '^https?://([^/?#:]+)', 1))", rules.CAREER_HREF)} THEN 3 ELSE 0 END
        + CASE WHEN {d.rx('txt', rules.CAREER_TEXT)} AND length(txt) < 60 THEN 2 ELSE 0 END AS INTEGER) AS score FROM scored
      WHERE board OR ends_with(lhost, {_ROOT}) OR ends_with({_ROOT}, lhost)) x WHERE score >= 2 AND (board OR score >= 3 OR {d.rx('path', rules.CAREER_HREF)})""").replace("SELECT page_id, link, score, rank", "top AS (SELECT page_id, link, score, rank", 1) + ")"


@query("K10 E6", f"WITH {CAREERS} SELECT * FROM top", ("site_pages",))
def page_careers_links(spark, sf):
    p = Inputs(spark, sf).raw("site_pages")
    return pages.careers_links(p, ["page_id"]).select("page_id", "link", "score", F.col("rank").cast("long").alias("rank"))


_HERE, _THERE = "regexp_replace(upath, '/$', '')", "regexp_replace(path, '/$', '')"


@query("K11 E6", f"""WITH {LINKS}, top AS (""" + _top(
    f"""SELECT * FROM (SELECT *, CAST(CASE WHEN {d.rx('path', rules.JOB_PATH)} THEN 3 ELSE 0 END + CASE WHEN starts_with(path, concat({_HERE}, '/')) AND length(path) > length({_HERE}) + 3 THEN 2 ELSE 0 END
        + CASE WHEN length(txt) BETWEEN 5 AND 120 THEN 1 ELSE 0 END AS INTEGER) AS score FROM a4 WHERE NOT {d.rx('href', rules.NOT_JOB)} AND lhost = host AND {_THERE} <> {_HERE}) x
      WHERE score >= 3""") + ") SELECT * FROM top", ("site_pages",))
def page_job_links(spark, sf):
    p = Inputs(spark, sf).raw("site_pages")
    return pages.job_links(p, ["page_id"]).select("page_id", "link", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- evidence
def scored_pages(spark, sf):
    """Pages paired with an employer: half carry their own heading as the name, half a stranger's."""
    p = pages.features(Inputs(spark, sf).raw("site_pages"))
    own = F.array_join(F.slice(F.split("title", " "), 1, 3), " ")
    named = p.withColumn("org_name", F.when(F.col("page_id") % 2 == 0, F.concat(own, F.lit(" Ltd"))).otherwise("Harbour Software Ltd"))
    return pages.homepage_evidence(named.withColumn("town", F.lit("London")).withColumn("county", F.lit("")))


def sql_evidence() -> str:
    has = lambda hay, x: f"contains(concat(' ', {hay}, ' '), concat(' ', {x}, ' '))"
    inner = lambda e: f"regexp_replace({e}, '<!--[\\s\\S]*?-->|<[^>]*>', '', 'g')"
    dec = lambda e: "replace(" * 2 + f"replace({e}, '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
    silent = f"regexp_replace(regexp_replace(regexp_replace(html, '(?i)^[\\s\\S]*?<body\\b[^>]*>', ''), '(?i)<script\\b[^>]*>[\\s\\S]*?</script\\s*>', '', 'g'), '(?i)<style\\b[^>]*>[\\s\\S]*?</style\\s*>', '', 'g')"
    idle = ", ".join(q(w) for w in (*rules.FILLER_WORDS, *rules.EVERYDAY_WORDS))
    common = f"(t IN ({_COMMON}) OR length(t) < 4)"
    pool_others = f"list_filter(list_slice(ws, 2, len(ws)), lambda t: length(t) >= 2 AND t NOT IN ({idle}))"
    return f"""WITH f AS (SELECT page_id, url, html, {d.clean(dec(inner("regexp_extract(html, '(?i)<title\\b[^>]*>([\\s\\S]*?)</title>', 1)")))} AS title_,
        trim({dec(inner("regexp_extract(html, '(?i)<title\\b[^>]*>([\\s\\S]*?)</title>', 1)"))}) AS title,
        array_to_string(list_transform(regexp_extract_all(html, '(?i)<h1\\b[^>]*>([\\s\\S]*?)</h1>', 1), lambda h: {dec(inner('h'))}), ' ') AS h1,
        regexp_replace({dec(inner(silent))}, {q(re2(chr(92) + 's+', False))}, ' ', 'g') AS body FROM site_pages),
      g AS (SELECT *, {d.normalise_text("concat(title, ' ', h1)")} AS head, {d.normalise_text('body[greatest(length(body) - 1499, 1):]')} AS foot,
        {d.normalise_text('body')} AS words_, {d.rx('html', rules.PARKED_PAGE)} OR length(body) < 80 AS parked,
        CASE WHEN page_id % 2 = 0 THEN concat(array_to_string(list_slice(string_split(title, ' '), 1, 3), ' '), ' Ltd') ELSE 'Harbour Software Ltd' END AS org_name,
        regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM f),
      h AS (SELECT *, {d.core_phrase('org_name')} AS phrase, replace(string_split(host, '.')[1], '-', '') AS label FROM g),
      i AS (SELECT *, list_filter(string_split(phrase, ' '), lambda w: w <> '') AS ws, string_split(phrase, ' ')[1] AS brand FROM h),
      j AS (SELECT *, length(phrase) >= 3 AND {has('head', 'phrase')} AS in_head, length(phrase) >= 3 AND {has('foot', 'phrase')} AS in_foot,
        length(brand) >= 3 AND ({has('head', 'brand')} OR {has('foot', 'brand')}) AS shown, label = array_to_string(ws, '') OR label = brand OR label = array_to_string(list_slice(ws, 1, 2), '') AS fits,
        label = array_to_string(ws, '') AS whole, len(ws) > 1 AND len(list_filter(ws, lambda t: NOT {has('head', 't')})) = 0 AS all_in,
        length(brand) >= 7 AND brand NOT IN ({_COMMON}) AS rare, {has('words_', 'brand')} AS in_body,
        {pool_others} AS others, {d.rx('host', rules.UK_HOST)} OR {d.rx('body', rules.UK_PAGE_SIGNAL)} OR {has('words_', "'london'")} AS uk FROM i),
      k AS (SELECT *, CASE WHEN in_head THEN 0.85 WHEN in_foot THEN 0.8 WHEN fits AND all_in THEN 0.75 WHEN fits AND whole AND shown THEN 0.7 WHEN fits AND rare AND shown THEN 0.65
        WHEN fits AND shown THEN 0.5 WHEN fits AND in_body THEN 0.45 ELSE 0.0 END::DOUBLE AS c0,
        CASE WHEN len(list_filter(others, lambda t: NOT {common})) > 0 THEN list_filter(others, lambda t: NOT {common}) ELSE others END AS pool FROM j),
      l AS (SELECT *, CASE WHEN c0 > 0 AND c0 < 0.75 AND NOT all_in AND NOT whole AND len(pool) > 0 AND len(list_filter(pool, lambda t: {has('words_', 't')})) = 0 THEN least(c0, 0.5) ELSE c0 END AS c1 FROM k),
      m AS (SELECT *, CASE WHEN c0 > 0 AND len(ws) = 1 AND (brand IN ({_COMMON}) OR length(brand) < 4) THEN least(c1, 0.55) ELSE c1 END AS c2 FROM l)
    SELECT page_id, title, phrase, CAST(CASE WHEN parked THEN 0.0 WHEN c0 > 0 AND uk THEN round(least(1.0, c2 + 0.05), 2)
        WHEN c0 > 0 THEN round(least(c2, CASE WHEN len(ws) > 1 THEN 0.7 ELSE 0.5 END), 2) ELSE 0.0 END AS DOUBLE) AS confidence, uk AND NOT parked AS has_uk_signal FROM m"""


@query("K7 H23", sql_evidence, ("site_pages",))
def page_evidence(spark, sf):
    return scored_pages(spark, sf).select("page_id", "title", "phrase", "confidence", "has_uk_signal")
