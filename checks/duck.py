"""SQL fragments for the checks: the rule tables said in DuckDB's words."""

from __future__ import annotations

from postmill.functions import rules
from postmill.functions.patterns import re2, words

from .bindings import q


def rx(expr: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({expr}, {q(re2(pattern, ignore_case))})"


def case(pairs, otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"(CASE {arms}{' ELSE ' + otherwise if otherwise else ''} END)"


def lookup(mapping: dict, expr: str, otherwise: str | None = None) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return case([(f"{expr} = {lit(k)}", lit(v)) for k, v in mapping.items()], otherwise)


def clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), {q(re2(chr(92) + 's+', False))}, ' ', 'g'))"


def key(expr: str) -> str:
    return f"""translate(lower({clean(expr)}), '‘’“”"', '''''')"""


def title_case(expr: str) -> str:
    """Word by word: split at spaces, capitalise after each delimiter."""
    small = ", ".join(q(w) for w in rules.SMALL_WORDS)

    def cap(w: str, delim: str) -> str:
        d = q(delim)
        return (f"array_to_string(list_transform(string_split({w}, {d}), "
                f"lambda p: concat(upper(p[1:1]), p[2:])), {d})")

    whole = cap(cap(cap("w", "-"), "''" if False else "'"), "(")
    return (f"array_to_string(list_transform(string_split(lower({clean(expr)}), ' '), "
            f"lambda w, i: CASE WHEN i > 1 AND w IN ({small}) THEN w ELSE {whole} END), ' ')")


def normalise_text(expr: str) -> str:
    x = f"replace(lower({expr}), '&', ' and ')"
    x = f"regexp_replace({x}, '[''’`]', '', 'g')"
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"


def core_phrase(expr: str) -> str:
    """Token lists instead of the engine's patterns."""
    legal = ", ".join(q(w) for w in rules.LEGAL_WORDS)
    trail = ", ".join(q(w) for w in rules.TRAILING_WORDS)
    traded = f"regexp_extract({expr}, {q(re2(words('t/a', 'trading as') + chr(92) + 's*(.+)$'))}, 1)"
    named = f"CASE WHEN {traded} <> '' THEN {traded} ELSE {expr} END"
    plain = normalise_text(f"regexp_replace({named}, '\\(.*?\\)', ' ', 'g')")
    all_words = f"string_split({plain}, ' ')"
    kept = f"list_filter({all_words}, lambda w: w NOT IN ({legal}))"
    kept = f"CASE WHEN len({kept}) = 0 THEN {all_words} ELSE {kept} END"
    # Last position that is not a trailing word; at least two words stay.
    last = f"coalesce(list_max(list_transform({kept}, lambda w, i: CASE WHEN w NOT IN ({trail}) THEN i END)), 0)"
    return (f"array_to_string(list_slice({kept}, 1, greatest({last}, least(2, len({kept})))), ' ')")


def sector_tags(expr: str, order=rules.SECTOR_TAGS) -> str:
    flag = {t: rx(expr, p) for t, p in rules.SECTOR_WORDS.items()}
    flag["telecoms"] = (f"({rx(expr, rules.SECTOR_WORDS['telecoms'])} AND NOT ({rx(expr, rules.NETWORK_OTHER)} "
                        f"AND NOT {rx(expr, rules.TELECOM_CERTAIN)}))")
    flag["tech"] = "(" + " OR ".join([rx(expr, rules.TECH_WORDS), *[flag[t] for t in rules.TECH_SECTORS]]) + ")"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {flag[t]} THEN {q(t)} END" for t in order) + ")"


def rating(expr: str) -> str:
    text = f"lower({clean(expr)})"
    return case([(f"contains({text}, {q(m)})", q(r)) for r, m in rules.RATING_MARKERS], "'UNKNOWN'")


def worker_type(expr: str) -> str:
    return f"CASE WHEN starts_with(lower({clean(expr)}), 'temporary worker') THEN 'temporary_worker' ELSE 'worker' END"


def list_of(text: str, sep: str = ",") -> str:
    """A delimited text as a list; empty text is an empty list."""
    return f"CASE WHEN coalesce({text}, '') = '' THEN [] ELSE string_split({text}, {q(sep)}) END"


# ---------------------------------------------------------------- postings
def spans(text: str, pattern: str, rank: int = 0) -> str:
    """Positions of all matches, from the lengths of what lies between them."""
    p = q(re2(pattern))
    gaps, hits = f"string_split_regex({text}, {p})", f"regexp_extract_all({text}, {p})"
    before = f"list_sum(list_transform(list_slice({gaps}, 1, i), lambda g: len(g)))"
    taken = f"coalesce(list_sum(list_transform(list_slice({hits}, 1, i - 1), lambda t: len(t))), 0)"
    start = f"CAST({before} + {taken} AS BIGINT)"
    return (f"list_transform({hits}, lambda h, i: "
            f"{{'start': {start}, 'rank': {rank}, 'stop': CAST({start} + len(h) AS BIGINT)}})")


def all_spans(text: str, patterns) -> str:
    out = spans(text, patterns[0], 0)
    for i, p in enumerate(patterns[1:], 1):
        out = f"list_concat({out}, {spans(text, p, i)})"
    return f"list_sort({out})"


def first_rule(expr: str, table) -> str:
    return case([(rx(expr, p), q(label)) for label, p in table])


def role_family(title: str, department: str) -> str:
    t = clean(title)
    arms = []
    for family, pattern in rules.ROLE_RULES:
        # This engine has no lookahead: what must not follow is blanked out for that alternative.
        head, tail = "(?:head|director|vp|chief)(?: of)? product", r"(?!\s+(?:marketing|sales))"
        test = rx(t, pattern.replace(head + tail + "|", ""))
        if head + tail in pattern:
            blanked = f"regexp_replace({t}, {q(re2(head + chr(92) + 's+(?:marketing|sales)'))}, '#', 'g')"
            test = f"({test} OR {rx(blanked, words(head))})"
        arms.append((test, q(family)))
    bare = (f"({rx(t, rules.ENGINEER_WORD)} AND NOT {rx(t, rules.PHYSICAL_ENGINEER)} "
            f"AND coalesce({rx(department, rules.TECH_DEPARTMENT)}, false))")
    arms.append((f"{rx(t, rules.SOFTWARE_WORDS)} OR {bare}", "'software'"))
    return case(arms)


_CITY = words(*rules.UK_CITIES)


def city_text(expr: str) -> str:
    return f"regexp_replace(lower({expr}), 'new york\\b', 'new ____', 'g')"


def is_uk(locations: str, code: str) -> str:
    abroad = f"({rx('l', rules.NORTH_AMERICA_CODE, False)} OR {rx('l', rules.OTHER_COUNTRY)})"
    place = f"{rx('l', rules.UK_COUNTRY)} OR (NOT {abroad} AND {rx(city_text('l'), _CITY, False)})"
    codes = ", ".join(q(c) for c in rules.UK_COUNTRY_CODES)
    return (f"(coalesce(lower({code}) IN ({codes}), false) OR "
            f"len(list_filter({locations}, lambda l: {place})) > 0)")


def uk_city(locations: str) -> str:
    found = f"list_transform({locations}, lambda l: regexp_extract({city_text('l')}, {q(re2(_CITY, False))}))"
    first = f"list_filter({found}, lambda c: c <> '')[1]"
    return (f"array_to_string(list_transform(string_split({first}, ' '), "
            f"lambda w: concat(upper(w[1:1]), w[2:])), ' ')")


def work_mode(location: str, text: str, part: str) -> str:
    loc, body = f"lower({location})", f"lower({text})"
    left = f"regexp_replace({loc}, {q(re2(rules.REMOTE_FILLER, False))}, '', 'g')"
    hybrid, remote = words("hybrid"), words("remote")
    arms = [
        (rx(loc, hybrid, False), ("'hybrid'", "'location'")),
        (rx(loc, remote, False), (f"(CASE WHEN {left} = '' THEN 'remote' ELSE 'flexible' END)", "'location'")),
        (rx(body, hybrid, False), ("'hybrid'", "'text'")),
        (rx(body, rules.REMOTE_TEXT, False), ("'remote'", "'text'")),
        (rx(body, rules.ONSITE_TEXT, False), ("'onsite'", "'text'")),
    ]
    return case([(c, v[0 if part == "mode" else 1]) for c, v in arms])


def employment_type(expr: str) -> str:
    squashed = f"regexp_replace(lower({expr}), {q(re2(chr(92) + 's|_|-', False))}, '', 'g')"
    return case([(rx(squashed, "^" + p), q(t)) for t, p in rules.EMPLOYMENT_PREFIXES])


def skills(expr: str) -> str:
    """Every pattern against the whole text, instead of one pass."""
    named = "concat_ws(',', " + ", ".join(f"CASE WHEN {rx(expr, p)} THEN {q(n)} END" for n, p in rules.SKILLS) + ")"
    return named


def pay_found(text: str) -> str:
    """First plausible pay range as a struct, pounds preferred."""
    p = q(re2(rules.PAY_RANGE))
    g = lambda i: f"coalesce(regexp_extract_all({text}, {p}, {i})[i], '')"
    sp = spans(text, rules.PAY_RANGE).replace("lambda h, i", "lambda h, j").replace("1, i)", "1, j)").replace("i - 1", "j - 1")
    num = lambda a, k: f"(CAST(replace({g(a)}, ',', '') AS DOUBLE) * CASE WHEN {g(k)} <> '' THEN 1000 ELSE 1 END)"
    after = f"lower(substring({text}, ({sp})[i].stop + 1, {rules.PAY_CONTEXT_CHARS}))"
    period = case([(rx(after, pat, False), q(n)) for n, pat in rules.PAY_PERIOD_TEXT], "'year'")
    low = (f"CASE WHEN {g(3)} = '' AND {g(5)} <> '' AND {num(2, 3)} < 1000 AND {num(4, 5)} >= 1000 "
           f"THEN {num(2, 3)} * 1000 ELSE {num(2, 3)} END")
    cur = lookup(rules.CURRENCY_SIGN, g(1))
    rows = (f"list_transform(generate_series(1, len(regexp_extract_all({text}, {p}))), lambda i: "
            f"{{'min': {low}, 'max': {num(4, 5)}, 'currency': {cur}, 'period': {period}}})")
    bands = " OR ".join(f"(s.period = {q(n)} AND s.min >= {lo} AND s.max <= {hi})" for n, (lo, hi) in rules.PAY_BOUNDS.items())
    return f"list_filter({rows}, lambda s: s.min <= s.max AND ({bands}))"


def number_text(expr: str) -> str:
    return f"CASE WHEN {expr} = floor({expr}) THEN CAST(CAST({expr} AS BIGINT) AS VARCHAR) ELSE CAST({expr} AS VARCHAR) END"


def normalise_ctes(source: str, identity: str, employment: str, mode: str, code: str, link: str) -> str:
    """Posting normalisation step by step; ends in ``normalised``."""
    text = "description"
    return f"""
    placed AS (SELECT *, string_split(location, ' | ') AS locs, {role_family('title', 'department')} AS role_family,
        {link} AS safe_url, {code} AS code, {employment} AS employment_raw, {mode} AS mode_given FROM {source}),
    screened AS (SELECT *, CASE WHEN NOT {is_uk('locs', 'code')} THEN 'not_uk' WHEN role_family IS NULL THEN 'not_tech'
        WHEN safe_url IS NULL THEN 'no_apply_url' END AS skip FROM placed),
    kept AS (SELECT * FROM screened WHERE skip IS NULL),
    found AS (SELECT *, {all_spans(text, rules.REFUSAL)} AS no_, {all_spans(text, rules.OFFER)} AS yes_,
        {spans(text, rules.RIGHT_TO_WORK)} AS rtw, {pay_found(text)} AS pays FROM kept),
    judged AS (SELECT *, list_filter(yes_, lambda p: len(list_filter(no_, lambda n: p.start < n.stop AND n.start < p.stop)) = 0) AS ok_,
        coalesce(list_filter(pays, lambda s: s.currency = 'GBP')[1], pays[1]) AS pay FROM found),
    decided AS (SELECT *, CASE WHEN len(no_) > 0 AND len(ok_) > 0 THEN 'unclear' WHEN len(no_) > 0 THEN 'not_offered'
        WHEN len(ok_) > 0 THEN 'offered' WHEN len(rtw) > 0 THEN 'right_to_work' ELSE 'unmentioned' END AS signal,
        coalesce(no_[1], ok_[1], rtw[1]) AS span, {work_mode('location', text, 'mode')} AS mode_read,
        {work_mode('location', text, 'origin')} AS mode_from, {employment_type('employment_raw')} AS type_given,
        {first_rule('title', rules.EMPLOYMENT_TITLE)} AS type_read,
        try_cast(nullif(regexp_extract({text}, {q(re2(rules.YEARS))}, 1), '') AS INTEGER) AS yrs FROM judged),
    normalised AS (SELECT {identity}, title, role_family, {first_rule('title', rules.SENIORITY_RULES)} AS seniority,
        location AS location_raw, {uk_city('locs')} AS city, coalesce(mode_given, mode_read) AS work_mode,
        coalesce(type_given, type_read) AS employment_type, CAST(floor(pay.min + 0.5) AS INTEGER) AS salary_min,
        CAST(floor(pay.max + 0.5) AS INTEGER) AS salary_max, pay.currency AS salary_currency, pay.period AS salary_period,
        department, {skills(f"concat(title, chr(10), {text})")} AS skills,
        CASE WHEN yrs <= {rules.MAX_YEARS} THEN yrs END AS years_experience, {rx(text, rules.DEGREE)} AS degree_mentioned,
        safe_url AS apply_url,
        substring(regexp_replace({text}, {q(re2(chr(92) + 's+', False))}, ' ', 'g'), 1, {rules.EXCERPT_CHARS}) AS excerpt,
        signal AS sponsorship_signal,
        CASE WHEN span IS NOT NULL THEN {clean(f"substring({text}, greatest(span.start - 90, 0) + 1, span.stop + 90 - greatest(span.start - 90, 0))")} END AS sponsorship_snippet,
        sha1(concat_ws(chr(1), title, location, {text},
             CASE WHEN pay IS NULL THEN '' ELSE concat({number_text('pay.min')}, '-', {number_text('pay.max')}) END)) AS content_hash,
        CASE WHEN pay IS NULL THEN 'unconfirmed' ELSE 'inferred' END AS pay_status,
        CASE WHEN mode_given IS NOT NULL THEN 'job board field' WHEN mode_from = 'location' THEN 'location text'
             WHEN mode_from = 'text' THEN 'job description' ELSE 'job text' END AS mode_source,
        CASE WHEN type_given IS NOT NULL THEN 'verified' WHEN type_read IS NOT NULL THEN 'inferred' ELSE 'unconfirmed' END AS type_status
      FROM decided)"""
