"""The daily jobs, in the order their data depends on each other.

register -> company match -> (research over landed pages) -> scan -> sectors -> ranking.
Each function takes and returns DataFrames; writing versions is the caller's last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import company_match, lifecycle, matching, people, postings, register, reports, search, sectors
from ..operators.ids import assign_ids
from ..session import cut_lineage
from ..sources import boards, jsonld  # noqa: F401  (register their sources)
from ..sources.files import read_register
from ..sources.registry import read_boards
from ..sources.tables import BucketedTable


REGISTER = ("name_key string, town_key string, name string, town string, county string, rating string, ratings array<string>, "
            "worker_types array<string>, routes array<string>, sector_tags array<string>")


class Refused(ValueError):
    """An import that was not published; ``counts`` says what was read."""

    def __init__(self, message: str, counts: dict[str, int]):
        super().__init__(message)
        self.counts = counts


def import_publication(spark, path: str, table: BucketedTable, version: int, minimum: int) -> dict[str, int]:
    """Read a register CSV and publish its employers as a version of ``table`` (schema REGISTER).

    Rows, ragged rows and employers are counted by the very pass that writes them. With
    fewer than ``minimum`` employers the version is never published and ``Refused`` is
    raised. Returns the counts.
    """
    read, built = Observation(), Observation()
    rows = read_register(spark, path).observe(read, F.count(F.lit(1)).alias("rows"), F.count_if("ragged").alias("ragged"))
    employers = register.collapse(rows).observe(built, F.count(F.lit(1)).alias("employers"))
    counts: dict[str, int] = {}

    def accept() -> None:
        counts.update({**read.get, **built.get})
        if counts["employers"] < minimum:
            raise Refused(f"refusing to import: {counts['employers']} employers, fewer than {minimum}", counts)

    table.write(employers, version, accept=accept)
    return counts


def import_register(rows: DataFrame, stored: DataFrame, import_id: int, as_of, minimum: int | None = None) -> DataFrame:
    """Register rows and stored employers to merged, numbered employers with their action."""
    publication = register.collapse(rows)
    if minimum is not None:
        publication = register.require_rows(publication, minimum, "employers")
    return register.with_ids(register.merge(stored, publication, import_id, as_of))


def match_companies(records: DataFrame, orgs: DataFrame, profiles: DataFrame, as_of, minimum: int | None = None) -> DataFrame:
    """Parsed bulk records to profiles with company columns."""
    rows = records if minimum is None else register.require_rows(records, minimum, "company rows")
    return company_match.apply_matches(profiles, company_match.match(company_match.employer_refs(orgs, profiles), company_match.employer_towns(orgs), rows), as_of)


def scan(payloads: DataFrame, outcomes: DataFrame, stored: DataFrame, details: dict[str, DataFrame] | None = None):
    """Landed payloads of one scan to (postings with action, scan log)."""
    # Listings are screened before their details are read, so a detail record neither drops nor keeps a posting.
    kept = postings.screen(read_boards(payloads)).where("skip is null or skip = 'no_apply_url'")
    if details:
        landed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [boards.DETAILS[name](d) for name, d in details.items()])
        kept = postings.enrich(kept, landed)
    merged = cut_lineage(lifecycle.merge_scan(stored, postings.normalise(kept), outcomes))
    return assign_ids(merged, "posting_id", lifecycle.KEY), lifecycle.scan_log(merged, outcomes)


def refresh_sectors(profiles: DataFrame, orgs: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    return sectors.refresh(profiles, orgs, stored, as_of)


def rank_everyone(profiles_raw: DataFrame, stored: DataFrame, orgs: DataFrame, profiles: DataFrame, marks: DataFrame, as_of,
                  top: int = matching.PAGE) -> DataFrame:
    """Everybody's page of matches."""
    view = search.posting_view(stored, orgs, profiles, as_of)
    return matching.rank_for_people(people.sanitise_profiles(profiles_raw), view, marks, as_of, top=top)


def digests(users: DataFrame, view: DataFrame, marks: DataFrame, as_of) -> DataFrame:
    """Digest text for everybody who is due one. ``users`` carry their profile columns."""
    due = reports.with_look_back(reports.due_digests(users, as_of, limit=None), as_of).where(people.has_preferences())
    best = matching.rank_for_people(due, view, marks, as_of, look_back=True, min_score=65, top=5)
    return reports.digest_lines(best, view)
