"""Declared schemas of the persistent tables. Nothing is inferred from data."""

from __future__ import annotations

PROVENANCE = "map<string,struct<status:string,source:string,confidence:double,detail:string,checked_at:timestamp>>"
EVIDENCE = "array<struct<tag:string,source:string,detail:string>>"
PAY = "struct<min:double,max:double,currency:string,period:string>"



def columns(ddl: str) -> dict[str, str]:
    """Column names and types of a schema text, in order; commas inside <> do not split."""
    out, depth, start = {}, 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().rsplit(" ", 1)
            out[name.strip("`")] = kind
            start = i + 1
    return out


REGISTER_ROW = (
    "`Organisation Name` string, `Town/City` string, County string, `Type & Rating` string, Route string"
)

REGISTER_IMPORTS = (
    "import_id long, source string, published_on date, row_count long, org_count long, "
    "added long, removed long, changed long, started_at timestamp, finished_at timestamp"
)

ORGS = (
    "org_id long, name_key string, town_key string, name string, town string, county string, rating string, "
    "ratings array<string>, worker_types array<string>, routes array<string>, sector_tags array<string>, "
    "status string, first_import_id long, last_import_id long, removed_at timestamp, created_at timestamp, "
    "updated_at timestamp"
)

PROFILES = (
    "name_key string, resolve_status string, website string, website_confidence double, website_source string, "
    "website_candidate string, careers_url string, ats_type string, ats_slug string, wikidata_id string, "
    "companies_house_no string, ch_status string, incorporated_on date, sic_codes array<string>, "
    "size_band string, industry array<string>, sector_tags array<string>, site_title string, "
    f"site_description string, provenance {PROVENANCE}, attempts int, last_error string, resolved_at timestamp, "
    "updated_at timestamp, ats_probed_at timestamp, jsonld_checked_at timestamp, "
    f"sector_evidence {EVIDENCE}, sector_basis string, sectors_computed_at timestamp"
)

# What a board reports about one posting, before normalisation. description_text null means "not fetched".
RAW_JOB = (
    "name_key string, source string, slug string, scan_id long, ordinal long, external_id string, title string, "
    "locations array<string>, country_codes array<string>, apply_url string, posted_at timestamp, "
    "department string, employment_type_raw string, work_mode string, description_text string, "
    f"salary {PAY}"
)

POSTING_FIELDS = (
    "title string, role_family string, seniority string, location_raw string, city string, work_mode string, "
    "employment_type string, salary_min int, salary_max int, salary_currency string, salary_period string, "
    "department string, skills array<string>, years_experience int, degree_mentioned boolean, apply_url string, "
    "excerpt string, sponsorship_signal string, sponsorship_snippet string, posted_at timestamp, "
    "content_hash string, provenance map<string,struct<status:string,source:string,detail:string>>"
)

POSTINGS = (
    "posting_id long, name_key string, source string, external_id string, "
    + POSTING_FIELDS
    + ", first_seen_at timestamp, last_seen_at timestamp, changed_at timestamp, expired_at timestamp, "
    "status string, missed_scans int, repost_count int"
)

SCANS = (
    "scan_id long, name_key string, source string, slug string, started_at timestamp, finished_at timestamp, "
    "ok boolean, complete boolean, http_status int, jobs_found long, jobs_kept long, added long, changed long, "
    "expired long, error string"
)

USERS = (
    "user_id long, email string, created_at timestamp, last_login_at timestamp, digest_opt_in boolean, "
    "last_digest_at timestamp"
)

USER_PROFILES = (
    "user_id long, roles array<string>, locations array<string>, work_modes array<string>, "
    "employment_types array<string>, level string, skills array<string>, years_experience int, "
    "needs_sponsorship string, min_salary int, hide_refusals boolean, updated_at timestamp"
)

MARKS = ("user_id long, posting_id long, mark string, created_at timestamp")
SAVED_ORGS = ("user_id long, org_id long, created_at timestamp")
RUN_STEPS = (
    "run_id long, run_date date, trigger string, all_steps boolean, started_at timestamp, finished_at timestamp, "
    "step string, status string, seconds long, error string, "
    "summary struct<boards:long,failed:long,queued:long,added:long,changed:long,expired:long,stopped_early:boolean>"
)
COMPANY_IMPORTS = ("snapshot_date date, rows_read long, matched long, created long, updated long")
