"""Evidence in landed web pages: whose site it is, its careers pages, its job boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions.patterns import java
from ..functions.text import (
    brand, core_phrase, decode_entities, has_phrase, is_common_word, matches, normalise_text, squeeze, tokens, trim,
)

_TAG = r"<!--[\s\S]*?-->|<[^>]*>"
_SILENT = r"(?i)<(script|style|noscript)\b[^>]*>[\s\S]*?</\1\s*>"
_ANCHOR = r"(?i)<a\b([^>]*)>([\s\S]*?)</a>"
_HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_LD = r"""(?i)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>([\s\S]*?)</script>"""


def inner_text(html: Column) -> Column:
    """Text of an element: tags vanish, nothing is put in their place."""
    return decode_entities(F.regexp_replace(html, _TAG, ""))


def _meta(html: Column, attribute: str, name: str) -> Column:
    """content of <meta attribute="name">, whichever attribute comes first."""
    value = F.regexp_extract(_meta_tag(html, attribute, name), r"""(?i)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    return decode_entities(value)


def _meta_tag(html: Column, attribute: str, name: str) -> Column:
    return F.regexp_extract(html, rf"""(?i)<meta\b[^>]*\b{attribute}\s*=\s*["']{name}["'][^>]*>""", 0)


# ---------------------------------------------------------------- page features
def features(pages: DataFrame, footer_chars: int | None = rules.FOOTER_CHARS) -> DataFrame:
    """Add title, description, head, foot, body text and parked flag to (.., url, html).

    ``footer_chars``: how much of the end of the text counts as the page's foot; None: all of it.
    """
    foot = F.col("body_text")
    if footer_chars is not None:
        foot = F.substr(foot, F.greatest(F.length(foot) - footer_chars + 1, F.lit(1)))
    html = F.col("html")
    h1 = F.regexp_extract_all(html, F.lit(r"(?i)<h1\b[^>]*>([\s\S]*?)</h1>"), 1)
    ld = F.array_join(F.regexp_extract_all(html, F.lit(_LD), 1), "\n")
    ld_names = F.regexp_extract_all(ld, F.lit(r'"(?:legalName|name)"\s*:\s*"([^"]{2,120})"'), 1)
    body = F.regexp_replace(html, r"(?i)^[\s\S]*?<body\b[^>]*>", "")
    meta_description = _meta(html, "name", "description")
    out = pages.select(
        *pages.columns,
        trim(inner_text(F.regexp_extract(html, r"(?i)<title\b[^>]*>([\s\S]*?)</title>", 1))).alias("title"),
        trim(F.when(_meta_tag(html, "name", "description") != "", meta_description).otherwise(_meta(html, "property", "og:description"))).alias("description"),
        _meta(html, "property", "og:site_name").alias("site_name"),
        F.array_join(F.transform(h1, inner_text), " ").alias("h1"),
        F.array_join(ld_names, " ").alias("ld_names"),
        squeeze(inner_text(F.regexp_replace(body, _SILENT, ""))).alias("body_text"),
        matches(html, rules.PARKED_PAGE).alias("parked"),
    )
    return out.select(
        "*",
        normalise_text(F.concat_ws(" ", "title", "site_name", "h1", "ld_names")).alias("head"),
        normalise_text(foot).alias("foot"),
        normalise_text(F.col("body_text")).alias("page_words"),
    ).withColumn("parked", F.col("parked") | (F.length("body_text") < rules.EMPTY_PAGE_CHARS))


def homepage_evidence(pages: DataFrame) -> DataFrame:
    """Add confidence (0..1), reasons and has_uk_signal: does the page belong to the employer?

    Needs the columns of ``features`` plus org_name, town and county. Works in
    stages, each a projection over named columns, so nothing is computed twice.
    """
    p = pages.withColumn("phrase", core_phrase(F.col("org_name"))).withColumn("host", urls.bare_host(F.col("url")))
    p = p.select(
        "*",
        tokens(F.col("phrase")).alias("words"),
        brand(F.col("phrase")).alias("brand"),
        urls.host_label(F.col("url")).alias("label"),
        normalise_text(F.coalesce("town", F.lit(""))).alias("town_words"),
        normalise_text(F.coalesce("county", F.lit(""))).alias("county_words"),
    )
    head, foot, words_ = F.col("head"), F.col("foot"), F.col("page_words")
    phrase, first, label, ws = F.col("phrase"), F.col("brand"), F.col("label"), F.col("words")
    whole = F.array_join(ws, "")
    p = p.select(
        "*",
        ((F.length(phrase) >= 3) & has_phrase(head, phrase)).alias("in_head"),
        ((F.length(phrase) >= 3) & has_phrase(foot, phrase)).alias("in_foot"),
        ((F.length(first) >= 3) & (has_phrase(head, first) | has_phrase(foot, first))).alias("brand_shown"),
        ((label == whole) | (label == first) | (label == F.array_join(F.slice(ws, 1, 2), ""))).alias("label_fits"),
        (label == whole).alias("label_whole"),
        ((F.size(ws) > 1) & F.forall(ws, lambda t: has_phrase(head, t))).alias("all_in_head"),
        ((F.length(first) >= 7) & ~first.isin(*rules.COMMON_WORDS)).alias("distinctive"),
        has_phrase(words_, first).alias("brand_in_body"),
        _other_word_shown(ws, words_).alias("others_shown"),
        _uk_signal().alias("has_uk_signal"),
    )
    fits, shown = F.col("label_fits"), F.col("brand_shown")
    tiers = (
        (F.col("in_head"), 0.85, "full name in title/heading"),
        (F.col("in_foot"), 0.8, "full name in footer"),
        (fits & F.col("all_in_head"), 0.75, "all name words in title/heading"),
        (fits & F.col("label_whole") & shown, 0.7, "domain is the full name; brand on page"),
        (fits & F.col("distinctive") & shown, 0.65, "distinctive brand matches domain and page"),
        (fits & shown, 0.5, "brand matches domain but is a common word"),
        (fits & F.col("brand_in_body"), 0.45, "domain matches brand; brand in body only"),
    )
    first_tier = F.when(tiers[0][0], F.struct(F.lit(tiers[0][1]).alias("c"), F.lit(tiers[0][2]).alias("why")))
    for test, c, why in tiers[1:]:
        first_tier = first_tier.when(test, F.struct(F.lit(c).alias("c"), F.lit(why).alias("why")))
    p = p.withColumn("tier", first_tier).withColumn("c0", F.coalesce("tier.c", F.lit(0.0)))

    found = F.col("c0") > 0
    brand_only = found & (F.col("c0") < 0.75) & ~F.col("all_in_head") & ~F.col("label_whole")
    unsupported = brand_only & ~F.col("others_shown")
    lone = found & (F.size("words") == 1) & is_common_word(F.col("brand"))
    c1 = F.when(unsupported, F.least(F.col("c0"), F.lit(0.5))).otherwise(F.col("c0"))
    c2 = F.when(lone, F.least(c1, F.lit(0.55))).otherwise(c1)
    uk = F.col("has_uk_signal")
    ceiling = F.when(F.size("words") > 1, 0.7).otherwise(0.5)
    c3 = F.when(found & uk, F.least(F.lit(1.0), c2 + 0.05)).when(found, F.least(c2, ceiling)).otherwise(c2)
    notes = F.array_compact(F.array(
        F.col("tier.why"),
        F.when(unsupported, "no distinctive word from the name appears on the page"),
        F.when(lone, "generic single-word name"),
        F.when(found & uk, "UK signal").when(found, "no UK signal"),
    ))
    out = p.withColumn("confidence", F.when(F.col("parked"), 0.0).otherwise(F.round(c3, 2))).withColumn(
        "reasons", F.when(F.col("parked"), F.array(F.lit("parked or empty page"))).otherwise(notes)
    ).withColumn("has_uk_signal", uk & ~F.col("parked"))
    return out.drop("tier", "c0", "in_head", "in_foot", "brand_shown", "label_fits", "label_whole", "all_in_head",
                    "distinctive", "brand_in_body", "others_shown", "town_words", "county_words", "words", "brand")


def _other_word_shown(words: Column, page: Column) -> Column:
    """Another word of the name is on the page (true when the name has no other word).

    Common words only count when the name has no distinctive one.
    """
    idle = (*rules.FILLER_WORDS, *rules.EVERYDAY_WORDS)
    others = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0))), lambda t: (F.length(t) >= 2) & ~t.isin(*idle))
    rare = F.filter(others, lambda t: ~is_common_word(t))
    pool = F.when(F.size(rare) > 0, rare).otherwise(others)
    return (F.size(pool) == 0) | F.exists(pool, lambda t: has_phrase(page, t))


def _uk_signal() -> Column:
    page = F.col("page_words")
    return (
        matches(F.col("host"), rules.UK_HOST)
        | matches(F.col("body_text"), rules.UK_PAGE_SIGNAL)
        | ((F.length("town_words") >= 4) & has_phrase(page, F.col("town_words")))
        | ((F.length("county_words") >= 4) & has_phrase(page, F.col("county_words")))
    )


def blocks_robots(status: Column, html: Column) -> Column:
    return status.isin(403, 429, 503) & matches(html, rules.BOT_CHALLENGE)


# ---------------------------------------------------------------- job boards
def board_link(text: Column) -> Column:
    """struct(ats, slug) of the first credible job-board address, vendors in order; null if none."""
    hits = []
    for vendor, pattern in rules.BOARD_LINKS:
        regex = F.lit(java(pattern))
        group = lambda i: F.regexp_extract_all(text, regex, i)  # noqa: E731, B023
        if vendor == "greenhouse":
            slugs = F.zip_with(group(1), group(2), lambda a, b: F.when(a != "", a).otherwise(b))
        elif vendor == "workday":
            zipped = F.arrays_zip(group(1).alias("t"), group(2).alias("n"), group(3).alias("s"))
            slugs = F.transform(zipped, lambda z: F.concat(z["t"], F.lit("."), F.lower(z["n"]), F.lit("/"), z["s"]))
        else:
            slugs = group(1)
        good = F.filter(slugs, lambda s: (s != "") & ~F.lower(s).isin(*rules.RESERVED_SLUGS))
        slug = F.get(good, 0)
        hits.append(F.when(slug.isNotNull(), F.struct(F.lit(vendor).alias("ats"), slug.alias("slug"))))
    hinted = text.rlike(
        r"(?i)greenhouse\.io|lever\.co|ashbyhq|workable\.com|smartrecruiters|teamtailor|recruitee|personio|bamboohr|myworkdayjobs"
    )
    return F.when(hinted, F.coalesce(*hits))


# ---------------------------------------------------------------- links
def _anchors() -> Column:
    """Links of a page as structs (pos, href, text)."""
    attrs = F.regexp_extract_all("html", F.lit(_ANCHOR), 1)
    inner = F.regexp_extract_all("html", F.lit(_ANCHOR), 2)
    href = lambda a: F.concat(*[F.regexp_extract(a, _HREF, i) for i in (1, 2, 3)])
    rows = F.transform(
        F.arrays_zip(attrs.alias("attrs"), inner.alias("inner")),
        lambda z, i: F.struct(
            i.alias("pos"),
            decode_entities(trim(href(z["attrs"]))).alias("href"),
            trim(squeeze(inner_text(z["inner"]))).alias("text"),
        ),
    )
    return F.filter(rows, lambda a: (a["href"] != "") & ~F.startswith(a["href"], F.lit("#")))


def _resolved(anchors: Column) -> Column:
    """The links that lead to an http(s) page: (pos, text, link, host, path)."""
    absolute = F.transform(
        anchors,
        lambda a: F.struct(a["pos"].alias("pos"), a["text"].alias("text"),
                           urls.without_fragment(urls.resolve(a["href"], F.col("url"))).alias("link")),
    )
    return F.transform(
        F.filter(absolute, lambda a: a["link"].isNotNull()),
        lambda a: F.struct(a["pos"].alias("pos"), a["text"].alias("text"), a["link"].alias("link"),
                           urls.bare_host(a["link"]).alias("host"), urls.path(a["link"]).alias("path")),
    )


def _best_links(pages: DataFrame, key: list[str], scored: Column, limit: int | None) -> DataFrame:
    """Highest score per link, then the best ``limit`` per page (or all); earlier links win ties.

    Links are scored inside the page's row and only the good ones leave it.
    """
    rows = pages.select(*key, F.inline_outer(scored)).where("link is not null")
    best = rows.groupBy(*key, "link").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "pos")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def _scored(links: Column, score, ok) -> Column:
    marked = F.transform(
        links, lambda a: F.struct(a["pos"].alias("pos"), a["link"].alias("link"), score(a).alias("score"), ok(a).alias("ok"))
    )
    return F.transform(
        F.filter(marked, lambda a: a["ok"]),
        lambda a: F.struct(a["pos"].alias("pos"), a["link"].alias("link"), a["score"].alias("score")),
    )


def careers_links(pages: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """Links that look like careers pages or job boards, same site only, best first."""
    parts = F.split(urls.bare_host(F.col("url")), r"\.")
    p = pages.select(*key, "url", "html").withColumn("parts", parts)
    p = p.withColumn("root", F.array_join(F.slice("parts", F.greatest(F.size("parts") - 2, F.lit(1)), 3), "."))
    quiet = F.filter(_anchors(), lambda a: ~matches(a["href"], rules.CAREER_NOISE))
    known = F.transform(
        _resolved(quiet),
        lambda a: F.struct(
            *[a[c].alias(c) for c in ("pos", "link", "host", "path", "text")],
            board_link(a["link"]).isNotNull().alias("board"),
            matches(a["path"], rules.CAREER_HREF).alias("path_hit"),
        ),
    )
    root = F.col("root")
    near = F.filter(known, lambda a: a["board"] | F.endswith(a["host"], root) | F.endswith(root, a["host"]))

    def score(a: Column) -> Column:
        address = F.concat(a["path"], urls.host(a["link"]))
        said = matches(a["text"], rules.CAREER_TEXT) & (F.length(a["text"]) < 60)
        return (
            F.when(a["board"], 6).otherwise(0)
            + F.when(matches(address, rules.CAREER_HREF), 3).otherwise(0)
            + F.when(said, 2).otherwise(0)
        )

    with_score = F.transform(near, lambda a: F.struct(*[a[c].alias(c) for c in ("pos", "link", "board", "path_hit")], score(a).alias("score")))
    ok = lambda a: (a["score"] >= 2) & (a["board"] | (a["score"] >= 3) | a["path_hit"])
    return _best_links(p, key, _scored(with_score, lambda a: a["score"], ok), limit)


def job_links(pages: DataFrame, key: list[str], limit: int | None = None) -> DataFrame:
    """Links on the same host that look like single postings, best first."""
    p = pages.select(*key, "url", "html").withColumn("own_host", urls.bare_host(F.col("url"))).withColumn(
        "here", F.regexp_replace(urls.path(F.col("url")), "/$", "")
    )
    here = F.col("here")
    fitting = F.filter(
        _resolved(F.filter(_anchors(), lambda a: ~matches(a["href"], rules.NOT_JOB))),
        lambda a: (a["host"] == F.col("own_host")) & (F.regexp_replace(a["path"], "/$", "") != here),
    )

    def score(a: Column) -> Column:
        child = F.startswith(a["path"], F.concat(here, F.lit("/"))) & (F.length(a["path"]) > F.length(here) + 3)
        return (
            F.when(matches(a["path"], rules.JOB_PATH), 3).otherwise(0)
            + F.when(child, 2).otherwise(0)
            + F.when(F.length(a["text"]).between(5, 120), 1).otherwise(0)
        )

    with_score = F.transform(fitting, lambda a: F.struct(a["pos"].alias("pos"), a["link"].alias("link"), score(a).alias("score")))
    return _best_links(p, key, _scored(with_score, lambda a: a["score"], lambda a: a["score"] >= 3), limit)
