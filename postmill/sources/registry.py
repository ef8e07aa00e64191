"""Board sources: each turns landed payloads into raw postings.

A payload row has name_key, source, slug, scan_id, page, payload (text) and may
carry fetched_at, uk_filtered and url. A source is a name, a Column that lists the jobs of
a payload, and a function from one job to raw-posting columns; ``register_source``
adds one. ``read_boards`` reads all sources in one pass over the payloads: every
payload is parsed once, by its own source, and all jobs are laid out by one explode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PAY, RAW_JOB, columns as schema_columns

#: From a path inside a job ("location.name") to its Column.
Job = Callable[[str], Column]
_SOURCES: dict[str, "Source"] = {}
# Positions are 32-bit numbers, so no two rows of a board share an ordinal.
_ROWS_PER_PAGE = 1 << 32
_OPTIONAL = {"fetched_at": "timestamp", "uk_filtered": "boolean", "url": "string"}


@dataclass(frozen=True)
class Source:
    """``jobs`` lists the jobs of column `payload`; ``fields`` maps one of them; a source may need an id of its own."""

    name: str
    jobs: Callable[[], Column]
    fields: Callable[[Job], dict[str, Column]]
    needs_id: bool = False

    def __call__(self, payloads: DataFrame) -> DataFrame:
        """Raw postings of payloads that are all of this source."""
        rows = explode_jobs(_complete(payloads), self.jobs())
        found = raw_jobs(rows, **self.fields(job(F.col("j"))))
        return found.where("external_id is not null") if self.needs_id else found


def job(of: Column) -> Job:
    return lambda path: reduce(lambda c, name: c[name], path.split("."), of)


def _complete(payloads: DataFrame) -> DataFrame:
    return payloads.withColumns({c: F.lit(None).cast(kind) for c, kind in _OPTIONAL.items() if c not in payloads.columns})


def register_source(source: Source) -> Source:
    _SOURCES[source.name] = source
    return source


def board_source(name: str, jobs: Callable[[], Column], needs_id: bool = False) -> Callable[[Callable[[Job], dict[str, Column]]], Source]:
    """Register the decorated function as the fields of a source."""
    return lambda fields: register_source(Source(name, jobs, fields, needs_id))


def sources() -> dict[str, Source]:
    return dict(_SOURCES)


def read_boards(payloads: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Raw postings of every registered source found in the payloads, in one scan of them."""
    chosen = [s for s in _SOURCES.values() if only is None or s.name in only]
    mine = _complete(payloads).where(F.col("source").isin(*[s.name for s in chosen]))
    # A list per source, of which all but one are empty; zipped, a job is null but for its own source's entry.
    lists = {f"_{s.name}": F.coalesce(F.when(F.col("source") == s.name, s.jobs()), F.array()) for s in chosen}
    rows = explode_jobs(mine.withColumns(lists), F.arrays_zip(*lists), drop=list(lists))
    mapped = {s.name: s.fields(job(F.col("j")[f"_{s.name}"])) for s in chosen}
    kinds = schema_columns(RAW_JOB)

    def own(column: str) -> Column:
        """A column by its row's source; nothing where the source does not state it."""
        arms = F.when(F.lit(False), F.lit(None).cast(kinds[column]))
        for name, fields in mapped.items():
            if column in fields:
                arms = arms.when(F.col("source") == name, fields[column].cast(kinds[column]))
        return F.coalesce(arms, no_text()) if column in ("locations", "country_codes") else arms

    stated = {c for fields in mapped.values() for c in fields}
    found = raw_jobs(rows, **{c: own(c) for c in kinds if c in stated})
    strict = [s.name for s in chosen if s.needs_id]
    return found.where(F.col("external_id").isNotNull() | ~F.col("source").isin(*strict)) if strict else found


def no_text() -> Column:
    return F.array().cast("array<string>")


def present(values: Column) -> Column:
    """List without nulls and empty strings."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def explode_jobs(payloads: DataFrame, jobs: Column, drop: list[str] | None = None) -> DataFrame:
    """One row per job, as column ``j``, keeping the payload columns and the position.

    The outer form is used because for the plain one the optimizer adds a test
    that the list is not empty, and that test would parse every payload a second time.
    """
    keep = [c for c in payloads.columns if c != "payload" and c not in (drop or ())]
    rows = payloads.withColumn("_jobs", jobs).select(*keep, F.posexplode_outer("_jobs").alias("pos", "j"))
    return rows.where("j is not null").withColumn("ordinal", F.col("page") * _ROWS_PER_PAGE + F.col("pos"))


def raw_jobs(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the raw-job schema; what a source does not state is null or empty."""
    out = []
    for name, kind in schema_columns(RAW_JOB).items():
        if name in columns:
            value = columns[name]
        elif name in ("name_key", "source", "slug", "scan_id", "ordinal"):
            value = F.col(name)
        elif name in ("locations", "country_codes"):
            value = no_text()
        else:
            value = F.lit(None)
        out.append(value.cast(kind).alias(name))
    return rows.select(*out).where("title <> ''")


def pay(low: Column, high: Column, currency: Column, period: Column, valid: Column) -> Column:
    fields = F.struct(
        low.cast("double").alias("min"), high.cast("double").alias("max"),
        currency.alias("currency"), period.alias("period"),
    )
    return F.when(valid, fields.cast(PAY))
