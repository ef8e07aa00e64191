"""The registered queries and, where SQL can say the same, the text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as b

AS_OF = b.AS_OF


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | Callable[[], str] | None = None, frames: tuple[str, ...] = ()):
    """Register a query under its function's name."""

    def wrap(fn):
        text = sql() if callable(sql) else sql
        if text is not None and frames:
            text = b.with_frames(text, *frames)
        QUERIES[fn.__name__] = Query(fn.__name__, covers, fn, text)
        return fn

    return wrap


class Inputs:
    """Derived frames for one data folder, with lists split out of their text form."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return b.frame(self.spark, self.sf_dir, name)

    def base(self, name: str) -> DataFrame:
        return b.base(self.spark, self.sf_dir, name)

    def orgs(self) -> DataFrame:
        return split(self.raw("orgs"), "|", "routes").transform(lambda d: split(d, ",", "worker_types", "sector_tags"))

    def profiles(self) -> DataFrame:
        d = split(self.raw("profiles"), ",", "sic_codes", "profile_tags").withColumnRenamed("profile_tags", "sector_tags")
        blank = {
            "ch_status": "string", "incorporated_on": "date", "website_candidate": "string",
            "provenance": "map<string,struct<status:string,source:string,confidence:double,detail:string,checked_at:timestamp>>",
            "sector_evidence": "array<struct<tag:string,source:string,detail:string>>",
        }
        return d.select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])

    def postings(self) -> DataFrame:
        return split(self.raw("postings"), ",", "skills")

    def people(self) -> DataFrame:
        return split(self.raw("people"), ",", "roles", "locations", "work_modes", "employment_types", "skills")

    def company_rows(self) -> DataFrame:
        from postmill.operators.company_match import read_records

        return read_records(self.raw("company_rows"), ["sic_1", "sic_2"])

    def scans(self) -> DataFrame:
        return self.raw("board_scans").withColumn("finished_at", F.col("started_at"))

    def posting_view(self) -> DataFrame:
        from postmill.operators.search import posting_view

        return posting_view(self.postings(), self.orgs(), self.profiles(), AS_OF)

    def org_view(self) -> DataFrame:
        from postmill.operators.search import org_view

        p = self.profiles().drop("customers").withColumnRenamed("updated_at", "profile_updated_at")
        return org_view(self.orgs(), p)

    def marks(self) -> DataFrame:
        from postmill.operators.people import current_marks

        return current_marks(self.raw("mark_log"), self.raw("postings").select("posting_id"))

    def follows(self) -> DataFrame:
        from postmill.operators.people import current_follows

        return current_follows(self.raw("follow_log"), self.raw("orgs").select("org_id"))


def split(df: DataFrame, sep: str, *columns: str) -> DataFrame:
    for c in columns:
        parts = F.split(F.col(c), f"[{sep}]")
        df = df.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts))
    return df


def joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


def stamp(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def duck_stamp(expr: str, alias: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {alias}"
