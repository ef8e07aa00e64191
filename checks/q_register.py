"""Register: build, merge, facets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postmill.functions import dates
from postmill.operators import register
from postmill.plans import daily
from postmill.session import checkpoint_folder
from postmill.sources.tables import BucketedTable

from . import duck as d
from .bindings import with_frames
from .catalog import AS_OF, Inputs, joined, query

FIRST = "listed < TIMESTAMP '2000-01-01 00:00:00'"
SECOND = "listed >= TIMESTAMP '1996-01-01 00:00:00'"


def collapse_ctes(where: str = "TRUE", tag: str = "") -> str:
    return f"""
    shaped{tag} AS (
      SELECT {d.key('name')} AS name_key, {d.key('town')} AS town_key, {d.clean('name')} AS name,
             {d.title_case('town')} AS town, {d.title_case('county')} AS county, {d.rating('type_rating')} AS rating,
             {d.worker_type('type_rating')} AS worker_type, {d.clean('route')} AS route, row_no
      FROM register_rows WHERE {where}),
    spelling{tag} AS (
      SELECT name_key, town_key, name,
             row_number() OVER (PARTITION BY name_key, town_key ORDER BY count(*) DESC, min(row_no)) AS n
      FROM shaped{tag} WHERE name <> '' GROUP BY name_key, town_key, name),
    rated{tag} AS (SELECT name_key, town_key, rating, min(row_no) AS first_at,
             {d.lookup({'A_PREMIUM': 5, 'A_SME_PLUS': 4, 'A': 3, 'B': 2, 'PROVISIONAL': 1, 'UNKNOWN': 0}, 'rating')} AS rank
      FROM shaped{tag} GROUP BY ALL),
    kinds{tag} AS (SELECT name_key, town_key, worker_type, min(row_no) AS first_at FROM shaped{tag} GROUP BY ALL),
    built{tag} AS (
      SELECT s.name_key, s.town_key, s.name,
        (SELECT arg_min(town, row_no) FROM shaped{tag} x WHERE x.name_key = s.name_key AND x.town_key = s.town_key) AS town,
        coalesce((SELECT arg_min(county, row_no) FROM shaped{tag} x WHERE x.name_key = s.name_key AND x.town_key = s.town_key AND county <> ''), '') AS county,
        (SELECT arg_max(rating, rank) FROM rated{tag} r WHERE r.name_key = s.name_key AND r.town_key = s.town_key) AS rating,
        (SELECT string_agg(rating, ',' ORDER BY first_at) FROM rated{tag} r WHERE r.name_key = s.name_key AND r.town_key = s.town_key) AS ratings,
        (SELECT string_agg(worker_type, ',' ORDER BY first_at) FROM kinds{tag} k WHERE k.name_key = s.name_key AND k.town_key = s.town_key) AS worker_types,
        coalesce((SELECT string_agg(DISTINCT route, '|' ORDER BY route) FROM shaped{tag} x WHERE x.name_key = s.name_key AND x.town_key = s.town_key AND route <> ''), '') AS routes
      FROM spelling{tag} s WHERE n = 1)"""


def sql_build() -> str:
    return f"WITH {collapse_ctes()} SELECT *, {d.sector_tags('name')} AS sector_tags FROM built"


@query("D1 D2 D12 H1 H2 H3 H9 J1", sql_build, ("register_rows",))
def register_build(spark, sf):
    out = register.collapse(Inputs(spark, sf).raw("register_rows"))
    return out.select(
        "name_key", "town_key", "name", "town", "county", "rating", joined("ratings"), joined("worker_types"),
        joined("routes", "|"), joined("sector_tags"),
    )


def sql_facets() -> str:
    return f"""WITH {collapse_ctes()}
      SELECT tag AS value, count(*) AS employers FROM
        (SELECT unnest(string_split({d.sector_tags('name')}, ',')) AS tag FROM built) x
      WHERE tag <> '' GROUP BY tag"""


@query("A1 D1 D6 J1", sql_facets, ("register_rows",))
def register_sector_facets(spark, sf):
    orgs = register.collapse(Inputs(spark, sf).raw("register_rows"))
    return orgs.select(F.explode("sector_tags").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("employers"))


def _two_publications(spark, sf):
    rows = Inputs(spark, sf).raw("register_rows")
    first = register.merge(register.empty_orgs(spark), register.collapse(rows.where(FIRST)), 1, "2024-01-01 00:00:00")
    return register.merge(first.drop("action"), register.collapse(rows.where(SECOND)), 2, AS_OF)


def sql_merge(select: str) -> str:
    return f"""WITH {collapse_ctes(FIRST, '1')}, {collapse_ctes(SECOND, '2')}, merged AS (
      SELECT coalesce(n.name_key, o.name_key) AS name_key, coalesce(n.town_key, o.town_key) AS town_key,
             coalesce(n.name, o.name) AS name, coalesce(n.rating, o.rating) AS rating,
             coalesce(n.routes, o.routes) AS routes,
             CASE WHEN n.name_key IS NULL THEN 'removed' ELSE 'active' END AS status,
             CAST(CASE WHEN o.name_key IS NULL THEN 2 ELSE 1 END AS BIGINT) AS first_import_id,
             CAST(CASE WHEN n.name_key IS NULL THEN 1 ELSE 2 END AS BIGINT) AS last_import_id,
             CASE WHEN o.name_key IS NULL THEN 'added' WHEN n.name_key IS NULL THEN 'removed'
                  WHEN o.rating IS DISTINCT FROM n.rating OR o.routes IS DISTINCT FROM n.routes THEN 'changed'
                  ELSE 'same' END AS action
      FROM built1 o FULL OUTER JOIN built2 n ON o.name_key = n.name_key AND o.town_key = n.town_key) {select}"""


@query("L1 B9 C13 G3", lambda: sql_merge("SELECT * FROM merged"), ("register_rows",))
def register_merge(spark, sf):
    return _two_publications(spark, sf).select(
        "name_key", "town_key", "name", "rating", joined("routes", "|"), "status", "first_import_id",
        "last_import_id", "action",
    )


@query("L1 D3", lambda: sql_merge("""
    SELECT count(*) FILTER (status = 'active') AS org_count, count(*) FILTER (action = 'added') AS added,
           count(*) FILTER (action = 'changed') AS changed, count(*) FILTER (action = 'removed') AS removed
    FROM merged"""), ("register_rows",))
def register_import_summary(spark, sf):
    return register.import_summary(_two_publications(spark, sf))


@query("L1 §7.4 ids", lambda: sql_merge("""
    SELECT name_key, town_key, first_import_id,
           row_number() OVER (ORDER BY first_import_id, name_key, town_key) AS org_id FROM merged"""), ("register_rows",))
def register_ids(spark, sf):
    rows = Inputs(spark, sf).raw("register_rows")
    first = register.with_ids(register.merge(
        register.empty_orgs(spark), register.collapse(rows.where(FIRST)), 1, "2024-01-01 00:00:00"))
    second = register.merge(first.drop("action"), register.collapse(rows.where(SECOND)), 2, AS_OF)
    return register.with_ids(second).select("name_key", "town_key", "first_import_id", "org_id")


_NAMES = "concat(CASE o_orderkey % 3 WHEN 0 THEN 'Register_' WHEN 1 THEN 'Workers ' ELSE 'undated ' END, {iso}, '.csv')"


@query("A2 L2", """
    WITH files AS (
      SELECT o_orderdate AS day, CASE o_orderkey % 3
               WHEN 0 THEN concat('Register_', strftime(o_orderdate, '%Y-%m-%d'), '.csv')
               WHEN 1 THEN concat('Workers ', strftime(o_orderdate, '%b %-d, %Y'), '.csv') ELSE 'undated.csv' END AS file_name
      FROM orders)
    SELECT file_name, CASE WHEN file_name = 'undated.csv' THEN NULL ELSE strftime(min(day), '%Y-%m-%d') END AS published_on,
           count(*) AS files FROM files GROUP BY file_name""")
def register_publication_dates(spark, sf):
    o = Inputs(spark, sf).base("orders")
    day = F.col("o_orderdate").cast("timestamp")
    name = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Register_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Workers "), F.date_format(day, "MMM d, yyyy"), F.lit(".csv")))
        .otherwise("undated.csv")
    )
    files = o.select(name.alias("file_name")).groupBy("file_name").agg(F.count(F.lit(1)).alias("files"))
    return files.withColumn("published_on", F.date_format(dates.published_on(F.col("file_name")), "yyyy-MM-dd"))


# ---------------------------------------------------------------- from a CSV file
def _landed_csv(spark, sf) -> str:
    """The register rows as one publication, in their order: CSV files that follow one another by name, a range of rows each."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/register-{uuid.uuid4().hex}"
    rows = Inputs(spark, sf).raw("register_rows").select(
        F.col("name").alias("Organisation Name"), F.col("town").alias("Town/City"), F.col("county").alias("County"), F.col("type_rating").alias("Type & Rating"),
        F.col("route").alias("Route"), "row_no")
    rows.repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no").write.option("header", True).csv(f"{folder}/landed")
    return folder


def _table(spark, folder: str) -> BucketedTable:
    return BucketedTable(spark, f"{folder}/table", daily.REGISTER, ("name_key",), 32)


@query("A1 B13 A22 D1", sql_build, ("register_rows",))
def register_build_from_csv(spark, sf):
    """Read the CSV, count and build in the pass that writes, publish, and read what was published."""
    folder = _landed_csv(spark, sf)
    table = _table(spark, folder)
    daily.import_publication(spark, f"{folder}/landed", table, 1, minimum=100)
    return table.read().select("name_key", "town_key", "name", "town", "county", "rating", joined("ratings"), joined("worker_types"), joined("routes", "|"), joined("sector_tags"))


@query("B13 A1", lambda: f"""WITH {collapse_ctes()} SELECT (SELECT count(*) FROM register_rows) AS rows_read, CAST(0 AS BIGINT) AS ragged, count(*) AS employers,
       true AS refused, CAST(0 AS BIGINT) AS versions FROM built""", ("register_rows",))
def register_import_refused(spark, sf):
    """An import with too few employers is counted and refused; no version of it can be read."""
    folder = _landed_csv(spark, sf)
    table = _table(spark, folder)
    refused, counts = False, {}
    try:
        daily.import_publication(spark, f"{folder}/landed", table, 1, minimum=10**9)
    except daily.Refused as no:
        refused, counts = True, no.counts
    return spark.createDataFrame([(counts["rows"], counts["ragged"], counts["employers"], refused, len(table.versions()))],
                                 "rows_read long, ragged long, employers long, refused boolean, versions long")
