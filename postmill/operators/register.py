"""Register publications: collapse rows to employers, then merge with the previous state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, rules, text
from ..functions.dates import instant
from ..session import cut_lineage
from .ids import assign_ids

_KEY = ["name_key", "town_key"]


def collapse(rows: DataFrame) -> DataFrame:
    """One record per (employer, town) from rows of (name, town, county, type_rating, route, row_no).

    Two shuffles. The first aggregation has only fixed-width buffers and runs
    map-side, so an employer holding a third of the register has shrunk to its few
    distinct rows before anything is exchanged. The data is then laid out by
    employer once, which serves both the spelling counts and the last aggregation.
    """
    shaped = rows.select(
        text.key(F.col("name")).alias("name_key"),
        text.key(F.col("town")).alias("town_key"),
        text.clean(F.col("name")).alias("name"),
        text.clean(F.col("town")).alias("town"),
        text.clean(F.col("county")).alias("county"),
        classify.rating_rank(classify.rating(F.col("type_rating"))).alias("rank"),
        classify.worker_type(F.col("type_rating")).alias("worker_type"),
        text.clean(F.col("route")).alias("route"),
        "row_no",
    ).where("name <> ''")
    distinct = shaped.groupBy(*_KEY, "name", "town", "county", "rank", "worker_type", "route").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("row")
    )
    laid_out = distinct.repartition(*_KEY)

    ranks = sorted(rules.RATING_RANK.values())
    kinds = ("worker", "temporary_worker")
    # How often each spelling occurs; the layout already keeps its rows together.
    spelling = Window.partitionBy(*_KEY, "name")
    counted = laid_out.withColumn("times", F.sum("n").over(spelling)).withColumn("since", F.min("row").over(spelling))
    merged = counted.groupBy(*_KEY).agg(
        F.max_by("name", F.struct(F.col("times"), -F.col("since"))).alias("name"),
        F.min_by("town", "row").alias("town"),
        F.coalesce(F.min_by("county", F.when(F.col("county") != "", F.col("row"))), F.lit("")).alias("county"),
        *[F.min(F.when(F.col("rank") == r, F.col("row"))).alias(f"r{r}") for r in ranks],
        *[F.min(F.when(F.col("worker_type") == k, F.col("row"))).alias(k) for k in kinds],
        # At most one entry per route of the register's vocabulary, whatever the number of rows.
        F.array_sort(F.collect_set(text.blank_to_null(F.col("route")))).alias("routes"),
    )
    best = F.greatest(*[F.when(F.col(f"r{r}").isNotNull(), r) for r in ranks])
    return merged.select(
        *_KEY,
        "name",
        text.title_case(F.col("town")).alias("town"),
        text.title_case(F.col("county")).alias("county"),
        classify.rating_of_rank(best).alias("rating"),
        _first_seen({n: F.col(f"r{r}") for n, r in rules.RATING_RANK.items()}).alias("ratings"),
        _first_seen({k: F.col(k) for k in kinds}).alias("worker_types"),
        "routes",
        classify.sector_tags(F.col("name")).alias("sector_tags"),
    )


def _first_seen(first_rows: dict[str, Column]) -> Column:
    """Labels that occur, in order of the row they first occurred on."""
    pairs = [
        F.when(row.isNotNull(), F.struct(row.alias("row"), F.lit(label).alias("label")))
        for label, row in first_rows.items()
    ]
    return F.transform(F.array_sort(F.array_compact(F.array(*pairs))), lambda p: p["label"])


def require_rows(df: DataFrame, minimum: int, what: str) -> DataFrame:
    """Refuse a suspiciously small input; the caller names the number."""
    if df.count() < minimum:
        raise ValueError(f"refusing to import: fewer than {minimum} {what}")
    return df


def already_imported(log: DataFrame, published_on) -> bool:
    """A publication date is imported once; ask again only to force it."""
    return not log.where(F.col("published_on") == F.lit(published_on)).limit(1).isEmpty()


def new_publications(files: DataFrame, log: DataFrame, force=()) -> DataFrame:
    """Register files whose publication date is not in the import log yet, and those of the forced dates."""
    if force:
        log = log.where(~F.col("published_on").isin(*force))
    return files.join(log.select("published_on"), "published_on", "left_anti")


_CONTENT = ["name", "town", "county", "rating", "ratings", "worker_types", "routes", "sector_tags"]


def merge(stored: DataFrame, publication: DataFrame, import_id: int, as_of) -> DataFrame:
    """Stored employers after one publication, with an ``action`` column.

    One full outer join. ``action`` is added, changed (rating or routes differ, or
    the employer is back), removed, or same; a new spelling alone is no change.
    """
    now = instant(as_of)
    old, new = stored.alias("o"), publication.alias("n")
    j = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in _KEY], "full_outer")
    here, known = F.col("n.name_key").isNotNull(), F.col("o.name_key").isNotNull()
    differs = (
        ~F.col("o.rating").eqNullSafe(F.col("n.rating"))
        | ~F.col("o.routes").eqNullSafe(F.col("n.routes"))
        | (F.col("o.status") != "active")
    )
    action = (
        F.when(here & ~known, "added")
        .when(here & known & differs, "changed")
        .when(~here & (F.col("o.status") == "active"), "removed")
        .otherwise("same")
    )
    pick = lambda c: F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    a = F.col("action")
    return (
        j.withColumn("action", action)
        .select(
            F.col("o.org_id").alias("org_id"),
            *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in _KEY],
            *[pick(c) for c in _CONTENT],
            F.when(here, "active").when(a == "removed", "removed").otherwise(F.col("o.status")).alias("status"),
            F.coalesce("o.first_import_id", F.lit(import_id).cast("long")).alias("first_import_id"),
            F.when(here, F.lit(import_id).cast("long")).otherwise(F.col("o.last_import_id")).alias("last_import_id"),
            F.when(here, F.lit(None)).when(a == "removed", now).otherwise(F.col("o.removed_at")).alias("removed_at"),
            F.coalesce("o.created_at", now).alias("created_at"),
            F.when(a == "same", F.col("o.updated_at")).otherwise(now).alias("updated_at"),
            "action",
        )
    )


def with_ids(merged: DataFrame) -> DataFrame:
    """Number new employers after the existing ones, in key order.

    The merge is written once; the highest id, old and new employers are read from there.
    """
    return assign_ids(cut_lineage(merged), "org_id", _KEY)


def import_summary(merged: DataFrame) -> DataFrame:
    """The counts an import records about itself."""
    a = F.col("action")
    return merged.agg(
        F.count_if(F.col("status") == "active").alias("org_count"),
        F.count_if(a == "added").alias("added"),
        F.count_if(a == "changed").alias("changed"),
        F.count_if(a == "removed").alias("removed"),
    )


def empty_orgs(spark) -> DataFrame:
    from ..schemas import ORGS

    return spark.createDataFrame([], ORGS)
