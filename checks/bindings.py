"""Domain inputs derived from the given tables.

Each frame is one SQL text that means the same in Spark and in DuckDB (integer
arithmetic, CASE, concat), so a query and its check start from equal rows.
Every frame reads its whole base tables; nothing is sampled or cut.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
AS_OF = "2024-02-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(expr: str, values) -> str:
    """CASE over ``expr % len(values)``; None stands for NULL."""
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else q(v) if isinstance(v, str) else v}" for i, v in enumerate(values)
    )
    text = f"(CASE CAST(({expr}) % {len(values)} AS INT) {arms} END)"
    listed = ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else str(v) for v in values)
    _LOOKED_UP[text] = f"get(array({listed}), CAST(({expr}) % {len(values)} AS INT))"
    return text


#: By the text of a ``pick``: the same for Spark, as one look-up in a constant list; an arm by arm CASE
#: makes a generated method too large for the JVM to compile.
_LOOKED_UP: dict[str, str] = {}


def div(expr: str, n: int) -> str:
    return f"CAST(floor(({expr}) / {n}) AS BIGINT)"


def ago(hours: str) -> str:
    return f"({NOW} - CAST({hours} AS INT) * INTERVAL '1' HOUR)"


STEMS = (
    "Harbour Software", "Beacon Data", "Cloudline Hosting", "Care Network", "Orchard Foods", "Shield Cyber",
    "Nova Digital", "Union Bank", "Riverside University", "Pixel Games", "Quantum Sensors", "Northgate Payments",
    "Metro Telecom", "Lifeline Hospital", "Insight Consulting", "Forge Engineering", "Bright AI",
    "Maple Restaurant", "Studio Design Agency", "Kestrel IT Services", "Primary Care Network", "Wave Broadband",
    "Atlas Technologies", "Green Builders",
)
STEM_TAGS = (
    "tech,software", "tech,data", "tech,cloud", "", "", "tech,cybersecurity", "tech,digital", "finance",
    "education", "tech,games", "tech,electronics", "tech,fintech", "tech,telecoms", "healthcare",
    "tech,data,consulting", "engineering", "tech,ai", "", "tech,design", "tech,it_services", "",
    "tech,telecoms", "tech", "",
)


def employer_name(e: str) -> str:
    return f"concat({pick(e, STEMS)}, ' ', CAST({e} AS VARCHAR(20)), {pick(e, (' Ltd', ' Limited', ' (UK) PLC'))})"


def town_name(n: str) -> str:
    return f"concat({pick(n, ('Stoke-On-', 'Kings ', 'St ', 'Isle of ', 'Upper '))}, 'Nation ', CAST({n} AS VARCHAR(20)))"


TITLES = (
    "Senior Software Engineer", "Data Engineer", "Product Manager", "UX Designer", "Machine Learning Engineer",
    "DevOps Engineer", "Security Analyst", "IT Support Technician", "Business Analyst", "Head of Engineering",
    "Graduate Developer", "Chef de Partie", "Lead Engineer", "Principal Data Scientist", "Warehouse Operative",
    "Electrical Maintenance Engineer", "Contract Python Developer", "Director of Product Marketing",
    "Frontend Developer Internship", "Solutions Architect",
)
FAMILIES = (
    "software", "data", "product", "design", "ai_ml", "cloud_devops", "cybersecurity", "it_support", "adjacent",
    "software", "software", "software", "software", "data", "data", "adjacent", "software", "product", "software",
    "adjacent",
)
LEVELS = (
    "senior", None, None, None, None, None, None, None, None, "lead", "entry", None, "lead", "principal", None,
    None, None, "lead", "entry", None,
)
LOCATIONS = (
    "London, England", "Manchester", "Remote - UK", "New York, NY", "Leeds | Paris", "Hybrid - Bristol",
    "Cambridge, MA", "Berlin, Germany", "Glasgow, Scotland", "Remote or London", "York", "Dublin, Ireland",
)
CITIES = ("London", "Manchester", None, None, "Leeds", "Bristol", None, None, "Glasgow", "London", "York", None)
DEPARTMENTS = ("Software", "Engineering", "Data Platform", "Finance", None)
PAY = (
    "Salary £60,000 - £75,000 per annum.", "Pay is £60-80k plus bonus.", "Day rate £450 - £500 per day.",
    "We pay $90,000 to $120,000 a year.", "Competitive salary.", "Hourly pay £15.50 - £20 per hour.",
    "Package €50k to €65k or £48k to £52k.",
)
WORDING = (
    "We are unable to offer visa sponsorship for this role.", "Visa sponsorship is available for this position.",
    "You must have the right to work in the UK.", "No sponsorship.", "We love cheese and long walks.",
    "We can offer sponsorship to strong candidates. Sponsorship is not available for contractors.",
    "Skilled worker visa sponsorship considered.", "You will work without requiring visa sponsorship.",
)
SKILL_TEXT = (
    "You know Python, SQL and Apache Spark on AWS.", "We use TypeScript, React.js and Node.js with GraphQL.",
    "C++ and C# with .NET; Docker, Kubernetes and Terraform.", "Experience of Power BI, Tableau and Excel.",
    "Penetration testing, SIEM and ISO 27001.", "Figma, prototyping and user research in an agile team.",
)
YEARS_TEXT = ("5+ years of commercial experience required.", "You bring 2-3 years experience.", "", "30 years of experience.")
MODE_TEXT = ("This role is hybrid.", "Fully remote team.", "This position is office-based.", "", "Free on-site parking.")
DEGREE_TEXT = ("A degree in a related field helps.", "", "BSc or MSc preferred.")
SOURCES = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "workday", "teamtailor", "bamboohr",
           "recruitee", "personio", "jsonld")
SIC = ("62012", "62020", "63110", "61900", "26110", "72190", "86101", "85421", "64999", "70229", "56101", "74100",
       "58290", "71122", "82990", "99999", "6201", "65110")
ROLE_SETS = ("", "software", "software,data", "product,design", "ai_ml,data", "cybersecurity,it_support,adjacent",
             "cloud_devops", "software,product,adjacent")
PLACE_SETS = ("", "London", "Manchester,Leeds", "Bristol", "York,Glasgow")
SKILL_SETS = ("", "python,sql", "React,TypeScript,Node.js", "Excel,Tableau", "Docker,Kubernetes,Terraform,AWS")
POSTING_SKILLS = ("", "Python,SQL,Spark", "TypeScript,React,Node.js,GraphQL", "C++,C#,Docker,Kubernetes,Terraform",
                  "Tableau,Power BI,Excel", "Python,Java,Go,AWS,Docker,SQL,Kafka")
STEPS = ("register", "companieshouse", "research", "probe", "discover", "scan", "maintenance", "digest")

_DESCRIPTION = """concat({skills}, ' ', {pay}, ' ', {wording}, ' ', {years}, ' ', {mode}, ' ', {degree})"""


def description(n: str) -> str:
    return _DESCRIPTION.format(
        skills=pick(n, SKILL_TEXT), pay=pick(n, PAY), wording=pick(n, WORDING), years=pick(n, YEARS_TEXT),
        mode=pick(f"({n}) + 2", MODE_TEXT), degree=pick(n, DEGREE_TEXT),
    )


_E = div("c_custkey", 5)
_EXT = "(l_partkey % 100)"
_YR = "CAST(year(l_shipdate) AS BIGINT)"
_K = "CAST(replace(substr(props, 7), '}', '') AS BIGINT)"
_PID = "(l_suppkey * 100 + l_partkey % 100 + 1)"

FRAMES: dict[str, str] = {
    # Rows of the public register: one per employer, town and route, with spelling noise.
    "register_rows": f"""
      SELECT CASE o_orderkey % 4 WHEN 1 THEN upper(nm) WHEN 2 THEN replace(nm, ' ', '  ')
                  WHEN 3 THEN concat('“', nm, '”') ELSE nm END AS name,
             CASE o_orderkey % 3 WHEN 1 THEN upper(tn) ELSE tn END AS town,
             CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lower(r_name) END AS county,
             {pick('o_orderkey + e', ('Worker (A rating)', 'Temporary Worker (A rating)', 'Worker (B rating)',
                                      'Worker (A (Premium))', 'Temporary Worker (A (SME+))',
                                      'Worker (UK Expansion Worker: Provisional )'))} AS type_rating,
             {pick('o_orderkey', ('Skilled Worker', 'Creative Worker', 'Charity Worker',
                                  'Global Business Mobility: Senior or Specialist Worker', ' Skilled  Worker ',
                                  'Tier 2 Ministers of Religion', ''))} AS route,
             o_orderkey AS row_no, o_orderdate AS listed
      FROM (SELECT o_orderkey, o_orderdate, {_E} AS e, {employer_name(_E)} AS nm,
                   {town_name('CAST(n_nationkey AS BIGINT)')} AS tn, r_name
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                 JOIN region ON n_regionkey = r_regionkey) x""",
    # Employers as stored, one per (employer, town).
    "orgs": f"""
      SELECT org_id, lower(nm) AS name_key, lower(tn) AS town_key, nm AS name, tn AS town, county,
             {pick('e', ('A', 'B', 'A_PREMIUM', 'A', 'A_SME_PLUS', 'PROVISIONAL'))} AS rating,
             {pick('e + n', ('Skilled Worker', 'Skilled Worker|Creative Worker',
                             'Global Business Mobility: Senior or Specialist Worker|Skilled Worker',
                             'Government Authorised Exchange'))} AS routes,
             {pick('e', ('worker', 'worker,temporary_worker'))} AS worker_types,
             {pick('e', STEM_TAGS)} AS sector_tags,
             CASE WHEN e % 11 = 3 THEN 'removed' ELSE 'active' END AS status,
             customers, balance
      FROM (SELECT {_E} AS e, CAST(c_nationkey AS BIGINT) AS n, {employer_name(_E)} AS nm,
                   {town_name('CAST(c_nationkey AS BIGINT)')} AS tn, min(r_name) AS county,
                   CAST(min(c_custkey) + 1 AS BIGINT) AS org_id, count(*) AS customers, sum(c_acctbal) AS balance
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            GROUP BY {_E}, c_nationkey) x""",
    # What research has found about each employer.
    "profiles": f"""
      SELECT lower({employer_name('e')}) AS name_key,
             {pick('e', ('resolved', 'candidate', 'resolved', 'not_found', 'pending', 'error'))} AS resolve_status,
             CASE WHEN e % 6 IN (0, 2) THEN concat('https://www.', lower(replace({pick('e', STEMS)}, ' ', '')),
                  CAST(e AS VARCHAR(20)), '.co.uk') END AS website,
             CAST(CASE WHEN e % 6 = 0 THEN 0.9 WHEN e % 6 = 2 THEN 0.7 END AS DOUBLE) AS website_confidence,
             CASE WHEN e % 6 IN (0, 2) THEN 'domain_guess' END AS website_source,
             CASE WHEN e % 4 < 3 AND e % 6 = 0 THEN concat('https://example.org/careers/', CAST(e AS VARCHAR(20))) END AS careers_url,
             {pick('e', (*SOURCES[:9], None, None, None, None))} AS ats_type,
             CASE WHEN e % 13 < 9 THEN concat('slug', CAST(e AS VARCHAR(20))) END AS ats_slug,
             CASE WHEN e % 7 = 0 THEN lpad(CAST(e * 3 + 1 AS VARCHAR(20)), 8, '0') END AS companies_house_no,
             {pick('e', ('', *SIC, '62012,70229', '82990,63110', '56101,99999'))} AS sic_codes,
             CASE WHEN e % 6 IN (0, 2) THEN {pick('e', STEMS)} END AS site_title,
             CASE WHEN e % 6 = 0 THEN {pick('e', ('We build software and analytics', 'A family restaurant',
                  'Online bank for people', 'Cloud hosting and cyber defence'))} END AS site_description,
             CASE WHEN e % 5 = 0 THEN {ago('e * 31 % 1500')} END AS ats_probed_at,
             CASE WHEN e % 5 = 1 THEN {ago('e * 29 % 1500')} END AS jsonld_checked_at,
             {ago('e * 17 % 2000')} AS updated_at,
             CASE WHEN e % 3 = 0 THEN {ago('e * 5 % 400')} END AS sectors_computed_at,
             {pick('e', ('name', 'sic', None))} AS sector_basis,
             {pick('e', ('tech,software', 'tech', ''))} AS profile_tags, customers
      FROM (SELECT {_E} AS e, count(*) AS customers FROM customer GROUP BY {_E}) x
      WHERE e % 17 <> 5""",
    # Company bulk file rows.
    "company_rows": f"""
      SELECT concat({pick('e', STEMS)}, ' ', CAST(e AS VARCHAR(20)),
                    {pick('k', (' LIMITED', ' Ltd', ' (UK) PLC', '', ' Group Limited'))}) AS name,
             lpad(CAST(k AS VARCHAR(20)), 8, '0') AS number,
             upper({town_name('k * 7 % 25')}) AS town,
             CASE WHEN p_size % 5 = 0 THEN 'Liquidation' ELSE 'Active' END AS status,
             CASE WHEN k % 4 = 0 THEN '' ELSE concat(lpad(CAST(k % 28 + 1 AS VARCHAR(20)), 2, '0'), '/',
                  lpad(CAST(k % 12 + 1 AS VARCHAR(20)), 2, '0'), '/', CAST(1980 + k % 40 AS VARCHAR(20))) END AS incorporated,
             concat({pick('k', SIC)}, ' - ', p_type) AS sic_1,
             CASE WHEN k % 3 = 0 THEN 'None Supplied' ELSE concat({pick('k + 5', SIC)}, ' - ', p_brand) END AS sic_2
      FROM (SELECT p_partkey AS k, {div('p_partkey', 3)} AS e, p_size, p_type, p_brand FROM part) x""",
    # Postings as boards reported them, one snapshot per ship year.
    "board_rows": f"""
      SELECT lower({employer_name('l_suppkey')}) AS name_key, {pick('l_suppkey', SOURCES)} AS source,
             {_YR} AS scan_id, l_orderkey * 10 + l_linenumber AS ordinal,
             CAST({_EXT} AS VARCHAR(20)) AS external_id, {pick(_EXT, TITLES)} AS title,
             {pick(f'{_EXT} % 20', LOCATIONS)} AS location, {pick(_EXT, DEPARTMENTS)} AS department,
             concat('HTTPS://Jobs.Example.com/', CAST({_PID} AS VARCHAR(20))) AS apply_url,
             {description(f'l_partkey % 100 + l_suppkey + {div(_YR, 2)}')} AS description, l_suppkey AS board
      FROM lineitem""",
    # Outcome of every board fetch.
    "board_scans": f"""
      SELECT lower({employer_name('l_suppkey')}) AS name_key, {pick('l_suppkey', SOURCES)} AS source,
             {_YR} AS scan_id, l_suppkey AS board, count(*) AS found,
             (l_suppkey + {_YR}) % 9 <> 0 AS ok, (l_suppkey + {_YR}) % 13 <> 0 AS complete,
             CASE WHEN (l_suppkey + {_YR}) % 18 = 0 THEN 429 WHEN (l_suppkey + {_YR}) % 9 = 0 THEN 503 ELSE 200 END AS http_status,
             {ago(f'(2001 - {_YR}) * 24 + l_suppkey % 20')} AS started_at
      FROM lineitem GROUP BY l_suppkey, {_YR}""",
    # Postings whose description is a whole document.
    "doc_jobs": f"""
      SELECT doc_id, {pick('doc_id', TITLES)} AS title, {pick('doc_id', LOCATIONS)} AS location,
             {pick('doc_id', DEPARTMENTS)} AS department,
             {pick('doc_id', ('gb', None, None, 'us'))} AS country,
             {pick('doc_id', (None, 'Full-time', 'Permanent', 'Fixed Term', None))} AS employment_type_raw,
             {pick('doc_id', (None, None, 'remote'))} AS work_mode_raw,
             {pick('doc_id', ('https://jobs.example.com/', 'HTTP://Example.org', 'javascript:alert', None))} AS link,
             concat(text, ' ', {description('doc_id')}) AS description
      FROM documents""",
    # Stored postings, in closed form.
    "postings": f"""
      SELECT id AS posting_id, lower({employer_name('board')}) AS name_key, {pick('board', SOURCES)} AS source,
             CAST(ext AS VARCHAR(20)) AS external_id, {pick('ext', TITLES)} AS title, {pick('ext', FAMILIES)} AS role_family,
             {pick('ext', LEVELS)} AS seniority, {pick('ext % 20', LOCATIONS)} AS location_raw,
             {pick('ext % 20', CITIES)} AS city, {pick('id', ('remote', 'hybrid', 'onsite', 'flexible', None))} AS work_mode,
             {pick('id', ('full_time', None, 'contract', 'part_time', 'full_time', 'internship'))} AS employment_type,
             CASE WHEN id % 4 <> 0 THEN CAST(20000 + qty * 1000 AS INT) END AS salary_min,
             CASE WHEN id % 4 <> 0 THEN CAST(25000 + qty * 1200 AS INT) END AS salary_max,
             CASE WHEN id % 4 <> 0 THEN {pick('id', ('GBP', 'GBP', 'USD', 'GBP', 'EUR'))} END AS salary_currency,
             CASE WHEN id % 4 <> 0 THEN 'year' END AS salary_period,
             {pick('id', POSTING_SKILLS)} AS skills, CAST(CASE WHEN id % 3 = 0 THEN id % 12 END AS INT) AS years_experience,
             concat('https://jobs.example.com/', CAST(id AS VARCHAR(20))) AS apply_url,
             {pick('id', ('offered', 'not_offered', 'unmentioned', 'unclear', 'right_to_work', 'unmentioned', 'unmentioned'))} AS sponsorship_signal,
             CASE WHEN id % 5 < 2 THEN {ago('id * 53 % 3600')} END AS posted_at,
             {ago('id * 37 % 2400')} AS first_seen_at, {ago('id % 48')} AS last_seen_at,
             CASE WHEN id % 6 = 1 THEN {ago('id * 11 % 200')} END AS changed_at,
             CASE WHEN id % 9 = 4 THEN {ago('id * 13 % 2400')} END AS expired_at,
             CASE WHEN id % 9 = 4 THEN 'expired' ELSE 'live' END AS status,
             CAST(id % 4 AS INT) AS repost_count, sightings
      FROM (SELECT {_PID} AS id, l_suppkey AS board, {_EXT} AS ext, CAST(max(l_quantity) AS BIGINT) AS qty,
                   count(*) AS sightings
            FROM lineitem GROUP BY {_PID}, l_suppkey, {_EXT}) x""",
    # People and what they look for.
    "people": f"""
      SELECT c_custkey AS user_id, {pick('c_custkey', ROLE_SETS)} AS roles,
             {pick('c_custkey + c_nationkey', PLACE_SETS)} AS locations,
             {pick('c_custkey', ('', 'remote', 'hybrid,onsite'))} AS work_modes,
             {pick('c_custkey', ('', 'full_time', 'contract,part_time', ''))} AS employment_types,
             {pick('c_custkey + 3', (None, 'senior', 'entry', 'lead', None, 'mid'))} AS level,
             {pick('c_custkey + 1', SKILL_SETS)} AS skills,
             CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 15 END AS INT) AS years_experience,
             {pick('c_custkey', (None, 'yes', 'no', 'unsure', 'yes'))} AS needs_sponsorship,
             CASE WHEN c_custkey % 4 = 1 THEN CAST(30000 + CAST(floor(abs(c_acctbal)) AS BIGINT) * 3 AS INT) END AS min_salary,
             c_custkey % 5 <> 0 AS hide_refusals,
             concat(' User', CAST(c_custkey AS VARCHAR(20)), '@Example.org ') AS email,
             c_custkey % 3 <> 0 AS digest_opt_in,
             CASE WHEN c_custkey % 4 <> 0 THEN {ago('c_custkey * 7 % 400')} END AS last_digest_at
      FROM customer""",
    # Clicks that set and clear marks; a null mark clears.
    "mark_log": f"""
      SELECT event_id, user_id, {_K} * 10 + user_id % 10 + 1 AS posting_id, ts AS logged_at,
             CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'click' THEN 'saved' WHEN 'error' THEN 'dismissed'
                  WHEN 'signup' THEN 'saved' END AS mark
      FROM events""",
    # Follow and unfollow clicks.
    "follow_log": f"""
      SELECT event_id, user_id, {_K} + 1 AS org_id, ts AS logged_at, event_type <> 'error' AS following FROM events""",
    # Sign-in requests.
    "requests": f"""
      SELECT event_id, ts AS created_at, concat('user', CAST(user_id AS VARCHAR(20)), '@example.org') AS email, user_id,
             CASE WHEN {_K} % 3 = 0 THEN concat('2001:db8:', CAST({_K} AS VARCHAR(20)), '::', CAST(user_id AS VARCHAR(20)))
                  ELSE concat('10.0.0.', CAST({_K} AS VARCHAR(20))) END AS ip,
             ts + CAST(user_id * 10 AS INT) * INTERVAL '1' HOUR AS expires_at
      FROM events""",
    # Steps of pipeline runs, eight to a run.
    "run_steps": f"""
      SELECT {div('event_id', 8)} AS run_id, event_id % 8 AS step_no, {pick('event_id', STEPS)} AS step, ts AS finished_at,
             CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'failed' WHEN event_type = 'signup' THEN 'skipped' ELSE 'ok' END AS status,
             CAST(floor(value) AS BIGINT) AS seconds, {_K} AS boards, user_id AS added,
             CASE WHEN {div('event_id', 8)} % 6 = 0 THEN 'manual' ELSE 'schedule' END AS trigger_kind,
             {div('event_id', 8)} % 10 <> 3 AS all_steps, {div('event_id', 8)} % 25 = 7 AS unfinished
      FROM events""",
    # Landed pages, with board and careers links on some.
    "site_pages": f"""
      SELECT page_id, url, concat(html,
             {pick('page_id', ('<a href="https://boards.greenhouse.io/acme_one">Careers</a>',
                               '<a href="/careers/open">We are hiring</a>', '',
                               '<a href="https://jobs.lever.co/jobs">x</a> <iframe src="https://apply.workable.com/widgetco/">',
                               '<a href="https://acme.wd5.myworkdayjobs.com/en-GB/External">Join the team</a>',
                               '<a href="/jobs/senior-engineer-12">Senior engineer</a>'))}) AS html
      FROM pages""",
}

_NAME = re.compile(r"\b(" + "|".join([*FRAMES, *BASE]) + r")\b")


def _uses(sql: str) -> set[str]:
    """Frames and tables a text reads: names that follow FROM or JOIN."""
    return set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) & (set(FRAMES) | set(BASE))


#: Tables whose rows are worked on one by one; the others are small dimensions.
LARGE = ("customer", "part", "orders", "lineitem", "events", "documents", "pages")


#: File bytes of a base table that one task takes.
_TASK_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where there are fewer files than cores.

    A given table is one file of one row group here, which is one task however the
    file is split. It is dealt out before anything is derived, so only base columns
    move; a table of many files is read as it is. The larger the table, the more
    tasks share it, so a task's rows do not grow with the table.

    Tests on derived columns would be moved below the exchange, into the few tasks
    that read the file; nothing is moved past a test that is not deterministic.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // _TASK_BYTES))).where(F.monotonically_increasing_id() >= 0)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LARGE else df


def _looked_up(sql: str) -> str:
    for case in sorted(_LOOKED_UP, key=len, reverse=True):
        sql = sql.replace(case, _LOOKED_UP[case])
    return sql


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived frame as a DataFrame; timestamps come out as instants."""
    sql = _looked_up(FRAMES[name])
    needs = {t: base(spark, sf_dir, t) if t in BASE else frame(spark, sf_dir, t) for t in _uses(sql)}
    text = re.sub(r"((?:FROM|JOIN)\s+)(\w+)", lambda m: m[1] + (f"{{{m[2]}}}" if m[2] in needs else m[2]),
                  sql.replace("{", "{{").replace("}", "}}"))
    text = text.replace("VARCHAR(20)", "STRING")
    df = spark.sql(text, **needs)
    for f in df.schema:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, df[f.name].cast("timestamp"))
    return df


def with_frames(body: str, *names: str) -> str:
    """DuckDB text: ``body`` preceded by the frames it needs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in sorted(_uses(FRAMES[n]) & set(FRAMES)):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FRAMES[n]})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
