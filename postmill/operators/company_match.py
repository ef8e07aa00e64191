"""Employers to companies of the national bulk file.

A name is matched only when it is safe: by number when one is held; else by the
single active company with the same distinctive words in one of the employer's
towns; else, elsewhere, by a sole candidate whose full name is identical.

The decision needs counts of candidates, not the candidates. So companies are
aggregated per phrase, per (phrase, town), per (phrase, full name) and per
(phrase, town, full name), and employers look those up. A phrase shared by a third of all
companies is one row by the time it meets the employers: no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions.dates import instant, uk_date
from ..session import cut_lineage

ROW = ["name", "number", "town", "status", "incorporated_on", "sic_codes"]


def read_records(raw: DataFrame, sic_columns: list[str]) -> DataFrame:
    """Bulk records to typed rows; those without a name or number are dropped."""
    return raw.select(
        F.trim("name").alias("name"),
        F.trim("number").alias("number"),
        F.trim("town").alias("town"),
        F.trim("status").alias("status"),
        uk_date(F.col("incorporated")).alias("incorporated_on"),
        classify.sic_codes(F.array(*sic_columns)).alias("sic_codes"),
    ).where("name <> '' and number <> ''")


def employer_refs(orgs: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per active employer name: first name, company number if held."""
    grouped = orgs.where("status = 'active'").groupBy("name_key").agg(F.min_by("name", "org_id").alias("name"))
    held = profiles.select("name_key", F.col("companies_house_no").alias("number"))
    return grouped.join(held, "name_key", "left")


def employer_towns(orgs: DataFrame) -> DataFrame:
    """Distinct (name_key, town) of active employers."""
    return orgs.where("status = 'active'").select("name_key", "town").distinct()


def match(refs: DataFrame, towns: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows (name_key, matched_by, company columns) for every safe match.

    Companies are cleaned once, cut down to phrases that an employer has, reduced to
    one row per (phrase, town, full name), and written; all counts come from that table.
    """
    company = F.struct(*ROW)
    held = refs.where("number is not null").select("name_key", "number")
    numbers = held.select("number").distinct()
    by_number = held.join(
        companies.groupBy("number").agg(F.max(company).alias("c")), "number"
    ).select("name_key", F.lit("number").alias("matched_by"), "c")

    wanted = refs.where("number is null").select(
        "name_key",
        text.core_phrase(F.col("name")).alias("phrase"),
        text.normalise_text(F.col("name")).alias("full_name"),
    ).where("phrase <> ''")
    active = companies.where("status = 'Active'").join(numbers, "number", "left_anti").select(
        text.core_phrase(F.col("name")).alias("phrase"),
        text.normalise_text(F.col("town")).alias("town_norm"),
        text.normalise_text(F.col("name")).alias("full_name"),
        company.alias("c"),
    ).join(wanted.select("phrase").distinct(), "phrase", "left_semi")

    n = F.count(F.lit(1)).alias("n")
    one = F.min("c").alias("c")
    named = cut_lineage(active.groupBy("phrase", "town_norm", "full_name").agg(n, one))
    in_town = named.groupBy("phrase", "town_norm").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    in_name = named.groupBy("phrase", "full_name").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    anywhere = in_town.groupBy("phrase").agg(F.sum("n").alias("n_all"))

    own_towns = towns.select("name_key", text.normalise_text(F.col("town")).alias("town_norm")).where("town_norm <> ''").distinct()
    by_town = wanted.join(own_towns, "name_key")

    local = by_town.join(in_town, ["phrase", "town_norm"]).groupBy("name_key").agg(
        F.sum("n").alias("n_local"), F.min("c").alias("local")
    )
    local_exact = by_town.join(named, ["phrase", "town_norm", "full_name"]).groupBy("name_key").agg(
        F.sum("n").alias("n_local_exact"), F.min("c").alias("local_exact")
    )
    decided = (
        wanted.join(anywhere, "phrase")
        .join(in_name.select("phrase", "full_name", F.col("n").alias("n_exact"), F.col("c").alias("exact")),
              ["phrase", "full_name"], "left")
        .join(local, "name_key", "left")
        .join(local_exact, "name_key", "left")
    )
    n_local = F.coalesce("n_local", F.lit(0))
    chosen = (
        F.when(n_local == 1, F.col("local"))
        .when((n_local > 1) & (F.col("n_local_exact") == 1), F.col("local_exact"))
        .when((n_local == 0) & (F.col("n_all") == 1) & (F.col("n_exact") == 1), F.col("exact"))
    )
    how = F.when(n_local > 0, "name_and_town").otherwise("exact_name")
    by_name = decided.select("name_key", how.alias("matched_by"), chosen.alias("c")).where("c is not null")
    return by_number.unionByName(by_name).select("name_key", "matched_by", "c.*")


def match_histogram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("matched_by").agg(F.count(F.lit(1)).alias("employers"))


def apply_matches(profiles: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    """Profiles with company columns filled in, and ``action`` created / updated / kept.

    A profile that already holds another number is left alone.
    """
    now = instant(as_of)
    p, m = profiles.alias("p"), matches.alias("m")
    j = p.join(m, "name_key", "full_outer")
    hit = F.col("m.number").isNotNull()
    known = F.col("p.resolve_status").isNotNull()
    free = F.col("p.companies_house_no").isNull() | (F.col("p.companies_house_no") == F.col("m.number"))
    write = hit & (~known | free)
    note = F.struct(
        F.lit("inferred").alias("status"), F.lit("companies_house_bulk").alias("source"),
        F.lit(None).cast("double").alias("confidence"), F.col("m.number").alias("detail"), now.alias("checked_at"),
    )
    new_prov = F.when(write & (F.col("m.matched_by") != "number"), F.create_map(F.lit("companies_house"), note))
    set_to = {
        "resolve_status": F.coalesce("p.resolve_status", F.lit("pending")),
        "companies_house_no": F.when(write, F.col("m.number")).otherwise(F.col("p.companies_house_no")),
        "ch_status": F.when(write, F.col("m.status")).otherwise(F.col("p.ch_status")),
        "incorporated_on": F.when(write, F.col("m.incorporated_on")).otherwise(F.col("p.incorporated_on")),
        "sic_codes": F.when(write, F.col("m.sic_codes")).otherwise(F.col("p.sic_codes")),
        "provenance": merge_maps(F.col("p.provenance"), new_prov),
        "updated_at": F.when(write, now).otherwise(F.col("p.updated_at")),
    }
    keep = [c for c in profiles.columns if c != "name_key"]
    return j.select(
        "name_key",
        *[set_to.get(c, F.col(f"p.{c}")).alias(c) for c in keep],
        F.when(write & known, "updated").when(write, "created").otherwise("kept").alias("action"),
    )


def merge_maps(left: Column, right: Column) -> Column:
    """Shallow merge of two maps; the right one wins."""
    return (
        F.when(right.isNull(), left)
        .when(left.isNull(), right)
        .otherwise(F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right))
    )


def pick_company(hits: DataFrame, orgs: DataFrame) -> DataFrame:
    """Best search hit per employer: active, same distinctive words, own town first, then hit order.

    ``hits``: name_key, position, title, company_status, company_number, locality.
    """
    j = hits.join(orgs.select("name_key", "name", "town"), "name_key")
    same = (F.col("company_status") == "active") & (
        text.core_phrase(F.coalesce("title", F.lit(""))) == text.core_phrase(F.col("name"))
    )
    town = text.normalise_text(F.coalesce("town", F.lit("")))
    local = (town != "") & (text.normalise_text(F.coalesce("locality", F.lit(""))) == town)
    return j.where(same).groupBy("name_key").agg(
        F.min_by(F.struct("company_number", "title"), F.struct((~local).alias("far"), F.col("position"))).alias("hit")
    ).select("name_key", "hit.*")
