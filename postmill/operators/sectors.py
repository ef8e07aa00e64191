"""Which sector an employer is in, with the evidence for every tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, rules, text
from ..functions.dates import instant


def family_counts(postings: DataFrame) -> DataFrame:
    """Live postings per employer and role family, as one map per employer."""
    live = postings.where("status = 'live' and role_family is not null")
    counted = live.groupBy("name_key", "role_family").agg(F.count(F.lit(1)).alias("n"))
    # At most one entry per role family, so the list is bounded.
    return counted.groupBy("name_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("role_family", "n")))).alias("families")
    )


def hiring_evidence(families: Column) -> Column:
    """Tags an employer's own hiring supports: three live roles of one kind."""
    parts = []
    for family, tag in rules.FAMILY_SECTOR:
        n = F.coalesce(F.try_element_at(families, F.lit(family)), F.lit(0))
        label = family.replace("_", "/", 1)
        detail = F.concat(n.cast("string"), F.lit(f" live {label} roles"))
        parts.append(
            F.when(n >= rules.MIN_ROLES_FOR_SECTOR, classify.evidence(F.lit(tag), F.lit("jobs"), detail))
        )
    found = F.array_compact(F.array(*parts))
    umbrella = classify.evidence(F.lit("tech"), F.lit("jobs"), F.lit(None))
    return F.when(F.size(found) > 0, F.array_append(found, umbrella)).otherwise(found)


def _tagged(tags: Column, source: str) -> Column:
    return F.transform(tags, lambda t: classify.evidence(t, F.lit(source), F.lit(None)))


def derive(employers: DataFrame) -> DataFrame:
    """Add evidence, tags and basis to rows of (name, sic_codes, website_text, families).

    Registered codes and the website speak first. Hiring counts only when both
    are silent; the name only when nothing else, not even a specific code, spoke.
    The first evidence for a tag is the strongest, as sources come in rank order.
    """
    none = F.array().cast("array<struct<tag:string,source:string,detail:string>>")
    codes = F.coalesce("sic_codes", F.array().cast("array<string>"))
    site = F.when(F.coalesce("website_text", F.lit("")) != "", _tagged(classify.site_sector_tags(F.col("website_text")), "website"))
    strong = employers.withColumn("_strong", F.concat(classify.sic_evidence(codes), F.coalesce(site, none)))
    hiring = F.coalesce(hiring_evidence(F.col("families")), none)
    weak = strong.withColumn("_weak", F.when(F.size("_strong") > 0, F.col("_strong")).otherwise(hiring))
    by_name = _tagged(classify.sector_tags(F.col("name")), "name")
    final = F.when(
        (F.size("_weak") > 0) | classify.has_specific_sic(codes), F.col("_weak")
    ).otherwise(by_name)
    out = weak.withColumn("_all", final)
    all_ = F.col("_all")
    # Keep the first mention of each tag.
    firsts = F.filter(
        all_, lambda e, i: F.array_position(F.transform(all_, lambda x: x["tag"]), e["tag"]) == i + 1
    )
    out = out.withColumn("evidence", firsts)
    return out.withColumn("tags", F.transform("evidence", lambda e: e["tag"])).withColumn(
        "basis", F.get(F.transform("evidence", lambda e: e["source"]), 0)
    ).drop("_strong", "_weak", "_all")


def refresh(profiles: DataFrame, orgs: DataFrame, postings: DataFrame, as_of) -> DataFrame:
    """Profiles with recomputed sectors; ``sectors_changed`` marks rows that differ.

    One display name per employer (lowest id), so branches cannot disagree.
    """
    names = orgs.groupBy("name_key").agg(F.min_by("name", "org_id").alias("name"))
    site = F.concat_ws(" ", text.blank_to_null(F.col("site_title")), text.blank_to_null(F.col("site_description")))
    inputs = (
        profiles.join(names, "name_key")
        .join(family_counts(postings), "name_key", "left")
        .withColumn("website_text", text.blank_to_null(site))
    )
    d = derive(inputs)
    changed = ~(
        F.col("sectors_computed_at").isNotNull()
        & F.col("sector_basis").eqNullSafe(F.col("basis"))
        & F.col("sector_evidence").eqNullSafe(F.col("evidence"))
    )
    d = d.withColumn("sectors_changed", changed)
    new = {
        "sector_evidence": F.col("evidence"),
        "sector_tags": F.array_sort(F.array_distinct("tags")),
        "sector_basis": F.col("basis"),
        "sectors_computed_at": instant(as_of),
    }
    return d.select(
        *[
            F.when(F.col("sectors_changed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in profiles.columns
        ],
        "sectors_changed",
        F.col("basis").alias("computed_basis"),
    )


def basis_counts(refreshed: DataFrame) -> DataFrame:
    return refreshed.groupBy(F.coalesce("computed_basis", F.lit("none")).alias("basis")).agg(
        F.count(F.lit(1)).alias("employers"), F.count_if("sectors_changed").alias("changed")
    )
