"""Company bulk file: parsing, matching, applying; names and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import classify, dates, text
from postmill.operators import company_match, sectors

from . import duck as d
from .bindings import NOW, q
from .catalog import AS_OF, Inputs, joined, query

# Parsed bulk rows, in DuckDB's words.
PARSED = r"""
  companies AS (SELECT name, number, town, status,
      CASE WHEN regexp_matches(incorporated, '^\d{2}/\d{2}/\d{4}$') THEN try_strptime(incorporated, '%d/%m/%Y') END AS born,
      list_distinct_kept AS sic
    FROM (SELECT trim(name) AS name, trim(number) AS number, trim(town) AS town, trim(status) AS status, incorporated,
            CASE WHEN a = b THEN list_filter([a], lambda c: c <> '') ELSE list_filter([a, b], lambda c: c <> '') END AS list_distinct_kept
          FROM (SELECT *, regexp_extract(trim(sic_1), '^(\d{4,5})\b', 1) AS a, regexp_extract(trim(sic_2), '^(\d{4,5})\b', 1) AS b
                FROM company_rows) x) y
    WHERE name <> '' AND number <> '')"""


@query("A3 A4 A5 A6", f"""WITH {PARSED} SELECT name, number, town, status, strftime(born, '%Y-%m-%d') AS incorporated_on,
       array_to_string(sic, ',') AS sic_codes FROM companies""", ("company_rows",))
def company_records(spark, sf):
    c = Inputs(spark, sf).company_rows()
    return c.select("name", "number", "town", "status", F.date_format("incorporated_on", "yyyy-MM-dd").alias("incorporated_on"), joined("sic_codes"))


@query("A3 A4", f"""WITH {PARSED} SELECT name, number, town, status, strftime(born, '%Y-%m-%d') AS incorporated_on,
       array_to_string(sic, ',') AS sic_codes FROM companies""", ("company_rows",))
def company_records_from_csv(spark, sf):
    """The bulk rows written as the published file is laid out, and read back."""
    import uuid

    from postmill.session import checkpoint_folder
    from postmill.sources import files

    path = f"{checkpoint_folder(spark).rstrip('/')}/companies-{uuid.uuid4().hex}"
    heads = {"CompanyName": "name", " CompanyNumber": "number", "RegAddress.PostTown": "town", "CompanyStatus": "status",
             "IncorporationDate": "incorporated", "SICCode.SicText_1": "sic_1", " SICCode.SicText_2": "sic_2"}
    rows = Inputs(spark, sf).raw("company_rows").select(*[F.col(c).alias(h) for h, c in heads.items()])
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    c = company_match.read_records(files.read_companies(spark, path), ["sic_1", "sic_2", "sic_3", "sic_4"])
    return c.select("name", "number", "town", "status", F.date_format("incorporated_on", "yyyy-MM-dd").alias("incorporated_on"), joined("sic_codes"))


# The decision table over candidate pairs; the engine never forms them.
MATCHED = f"""{PARSED},
  refs AS (SELECT o.name_key, arg_min(o.name, o.org_id) AS name, list(DISTINCT o.town) AS towns, max(p.companies_house_no) AS held
           FROM orgs o LEFT JOIN profiles p ON p.name_key = o.name_key WHERE o.status = 'active' GROUP BY o.name_key),
  direct AS (SELECT r.name_key, 'number' AS matched_by, c.* FROM refs r JOIN companies c ON c.number = r.held),
  phrased AS (SELECT *, {d.core_phrase('name')} AS phrase, {d.normalise_text('name')} AS full_name, {d.normalise_text('town')} AS tn
              FROM companies WHERE status = 'Active' AND number NOT IN (SELECT held FROM refs WHERE held IS NOT NULL)),
  wanted AS (SELECT name_key, {d.core_phrase('name')} AS phrase, {d.normalise_text('name')} AS full_name,
             list_transform(towns, lambda t: {d.normalise_text('t')}) AS tns FROM refs WHERE held IS NULL),
  pairs AS (SELECT w.name_key, c.name, c.number, c.town, c.status, c.born, c.sic, list_contains(w.tns, c.tn) AND c.tn <> '' AS local,
            c.full_name = w.full_name AS exact FROM wanted w JOIN phrased c ON c.phrase = w.phrase AND w.phrase <> ''),
  counted AS (SELECT *, count(*) OVER (PARTITION BY name_key) AS n, count(*) FILTER (local) OVER (PARTITION BY name_key) AS nl,
              count(*) FILTER (local AND exact) OVER (PARTITION BY name_key) AS nle FROM pairs),
  named AS (SELECT name_key, CASE WHEN nl > 0 THEN 'name_and_town' ELSE 'exact_name' END AS matched_by, name, number, town, status, born, sic
            FROM counted WHERE (nl = 1 AND local) OR (nl > 1 AND nle = 1 AND local AND exact) OR (nl = 0 AND n = 1 AND exact)),
  matches AS (SELECT * FROM direct UNION ALL SELECT * FROM named)"""
_FRAMES = ("company_rows", "orgs", "profiles")


def _matches(spark, sf):
    i = Inputs(spark, sf)
    profiles = i.profiles()
    return profiles, company_match.match(company_match.employer_refs(i.orgs(), profiles), company_match.employer_towns(i.orgs()), i.company_rows())


@query("K1 C8 C9 D8 D9 H4 H5 H6", f"""WITH {MATCHED} SELECT name_key, matched_by, name, number, town, status,
       strftime(born, '%Y-%m-%d') AS incorporated_on, array_to_string(sic, ',') AS sic_codes FROM matches""", _FRAMES)
def company_match_all(spark, sf):
    m = _matches(spark, sf)[1]
    return m.select("name_key", "matched_by", "name", "number", "town", "status",
                    F.date_format("incorporated_on", "yyyy-MM-dd").alias("incorporated_on"), joined("sic_codes"))


@query("D18", f"WITH {MATCHED} SELECT matched_by, count(*) AS employers FROM matches GROUP BY 1", _FRAMES)
def company_match_histogram(spark, sf):
    return company_match.match_histogram(_matches(spark, sf)[1])


@query("K2 H11 H13", f"""WITH {MATCHED}
    SELECT coalesce(p.name_key, m.name_key) AS name_key, coalesce(p.resolve_status, 'pending') AS resolve_status,
           CASE WHEN w THEN m.number ELSE p.companies_house_no END AS companies_house_no,
           CASE WHEN w THEN array_to_string(m.sic, ',') ELSE p.sic_codes END AS sic_codes,
           CASE WHEN w AND m.matched_by <> 'number' THEN 'companies_house_bulk' END AS company_source,
           CASE WHEN w AND p.name_key IS NOT NULL THEN 'updated' WHEN w THEN 'created' ELSE 'kept' END AS action
    FROM profiles p FULL OUTER JOIN matches m ON p.name_key = m.name_key,
         LATERAL (SELECT m.name_key IS NOT NULL AND (p.name_key IS NULL OR p.companies_house_no IS NULL OR p.companies_house_no = m.number) AS w) x""",
       _FRAMES)
def company_match_apply(spark, sf):
    profiles, m = _matches(spark, sf)
    out = company_match.apply_matches(profiles, m, AS_OF)
    return out.select("name_key", "resolve_status", "companies_house_no", joined("sic_codes"),
                      F.col("provenance")["companies_house"]["source"].alias("company_source"), "action")


@query("H4 H5 H6", f"""SELECT name, {d.normalise_text('name')} AS normal, {d.core_phrase('name')} AS phrase FROM (
       SELECT DISTINCT CASE k % 4 WHEN 0 THEN concat(name, ' t/a ', town, ' & Sons GmbH Ireland') WHEN 1 THEN concat('The ', name)
              WHEN 2 THEN 'The Company Limited' ELSE concat(name, ' Europe AG Pty') END AS name
       FROM (SELECT name, town, CAST(number AS BIGINT) AS k FROM company_rows) x) y""", ("company_rows",))
def company_core_names(spark, sf):
    r = Inputs(spark, sf).raw("company_rows")
    k = r["number"].cast("bigint") % 4
    name = (F.when(k == 0, F.concat("name", F.lit(" t/a "), "town", F.lit(" & Sons GmbH Ireland")))
            .when(k == 1, F.concat(F.lit("The "), "name")).when(k == 2, "The Company Limited")
            .otherwise(F.concat("name", F.lit(" Europe AG Pty"))))
    n = r.select(name.alias("name")).distinct()
    return n.select("name", text.normalise_text(F.col("name")).alias("normal"), text.core_phrase(F.col("name")).alias("phrase"))


@query("K3", f"""WITH orgs1 AS (SELECT name_key, arg_min(name, org_id) AS name, arg_min(town, org_id) AS town FROM orgs GROUP BY 1),
    hits AS (SELECT o.name_key, o.name AS org_name, o.town AS org_town, c.*, row_number() OVER (PARTITION BY o.name_key ORDER BY number) AS pos,
             CASE WHEN c.status = 'Active' THEN 'active' ELSE 'dissolved' END AS st
             FROM orgs1 o JOIN company_rows c ON {d.core_phrase('c.name')} = {d.core_phrase('o.name')})
    SELECT name_key, arg_min(number, (CASE WHEN {d.normalise_text('town')} = {d.normalise_text('org_town')} THEN 0 ELSE 1000000 END) + pos) AS company_number
    FROM hits WHERE st = 'active' GROUP BY name_key""", ("orgs", "company_rows"))
def company_pick_search_hit(spark, sf):
    i = Inputs(spark, sf)
    from pyspark.sql import Window

    orgs = i.raw("orgs").groupBy("name_key").agg(F.min_by("name", "org_id").alias("name"), F.min_by("town", "org_id").alias("town"))
    c = i.raw("company_rows").select(text.core_phrase(F.col("name")).alias("phrase"), F.col("name").alias("title"),
        F.when(F.col("status") == "Active", "active").otherwise("dissolved").alias("company_status"),
        F.col("number").alias("company_number"), F.col("town").alias("locality"))
    hits = orgs.select("name_key", text.core_phrase(F.col("name")).alias("phrase")).join(c, "phrase").withColumn(
        "position", F.row_number().over(Window.partitionBy("name_key").orderBy("company_number")))
    return company_match.pick_company(hits, orgs).select("name_key", "company_number")


# ---------------------------------------------------------------- sectors
def _sic_tags(code: str) -> str:
    from postmill.functions import rules

    generic = ", ".join(q(c) for c in rules.GENERIC_SIC)
    pad = f"rpad({code}, 5, '0')[1:5]"
    best = sorted(rules.SIC_PREFIX_TAGS, key=lambda r: -len(r[0]))
    arms = [(f"{pad} IN ({generic})", "''")] + [(f"starts_with({pad}, {q(p)})", q(",".join(t))) for p, t in best]
    return d.case(arms, "''")


def _specific(code: str) -> str:
    from postmill.functions import rules

    generic = ", ".join(q(c) for c in rules.GENERIC_SIC)
    pad = f"rpad({code}, 5, '0')[1:5]"
    return f"(length({code}) >= 4 AND {pad} NOT IN ({generic}) AND NOT starts_with({pad}, '68'))"


@query("J16 J17 E8", f"""
    WITH coded AS (SELECT sic_codes, count(*) AS employers, {d.list_of('sic_codes')} AS codes FROM profiles GROUP BY sic_codes)
    SELECT sic_codes, employers,
           array_to_string(list_transform(list_filter(codes, lambda c: {_sic_tags('c')} <> ''),
             lambda c: array_to_string(list_transform(string_split({_sic_tags('c')}, ','), lambda t: concat(t, '=', 'SIC ', c)), ';')), ';') AS evidence,
           len(list_filter(codes, lambda c: {_specific('c')})) > 0 AS specific
    FROM coded""", ("profiles",))
def sector_sic_evidence(spark, sf):
    p = Inputs(spark, sf).raw("profiles").groupBy("sic_codes").agg(F.count(F.lit(1)).alias("employers"))
    codes = F.when(F.col("sic_codes") == "", F.array().cast("array<string>")).otherwise(F.split("sic_codes", ","))
    ev = F.transform(classify.sic_evidence(codes), lambda e: F.concat(e["tag"], F.lit("="), e["detail"]))
    return p.select("sic_codes", "employers", F.array_join(ev, ";").alias("evidence"), classify.has_specific_sic(codes).alias("specific"))


def sql_sectors(select: str) -> str:
    from postmill.functions import rules

    fam = [(f, t, f.replace("_", "/", 1)) for f, t in rules.FAMILY_SECTOR]
    fam_sql = ", ".join(
        f"CASE WHEN coalesce(max(n) FILTER (role_family = {q(f)}), 0) >= 3 THEN concat({q(t)}, '|jobs|', max(n) FILTER (role_family = {q(f)}), ' live {l} roles') END"
        for f, t, l in fam)
    site_text = "concat_ws(' ', nullif(site_title, ''), nullif(site_description, ''))"
    return f"""WITH names AS (SELECT name_key, arg_min(name, org_id) AS name FROM orgs GROUP BY 1),
      counts AS (SELECT name_key, role_family, count(*) AS n FROM postings WHERE status = 'live' GROUP BY 1, 2),
      hiring AS (SELECT name_key, concat_ws(';', {fam_sql}) AS ev FROM counts GROUP BY 1),
      tagged AS (SELECT p.name_key, p.sectors_computed_at, n.name, {d.list_of('p.sic_codes')} AS codes,
          {d.sector_tags(site_text, rules.SITE_TEXT_TAGS)} AS site, {d.sector_tags('n.name')} AS named,
          coalesce(h.ev, '') AS hire
        FROM profiles p JOIN names n ON n.name_key = p.name_key LEFT JOIN hiring h ON h.name_key = p.name_key),
      listed AS (SELECT *, array_to_string(list_concat(
            list_transform(list_filter(codes, lambda c: {_sic_tags('c')} <> ''), lambda c: array_to_string(list_transform(
               string_split({_sic_tags('c')}, ','), lambda t: concat(t, '|sic|SIC ', c)), ';')),
            CASE WHEN site = '' THEN [] ELSE list_transform(string_split(concat(site, ',tech'), ','), lambda t: concat(t, '|website|')) END), ';') AS strong,
          CASE WHEN hire = '' THEN '' ELSE concat(hire, ';tech|jobs|') END AS weak,
          len(list_filter(codes, lambda c: {_specific('c')})) > 0 AS specific,
          array_to_string(list_transform({d.list_of('named')}, lambda t: concat(t, '|name|')), ';') AS by_name FROM tagged),
      chosen AS (SELECT *, CASE WHEN strong <> '' THEN strong WHEN weak <> '' THEN weak WHEN specific THEN '' ELSE by_name END AS ev FROM listed),
      firsts AS (SELECT *, {d.list_of('ev', ';')} AS items FROM chosen),
      final AS (SELECT name_key, sectors_computed_at, list_filter(items, lambda e, i: list_position(list_transform(items,
          lambda x: string_split(x, '|')[1]), string_split(e, '|')[1]) = i) AS items FROM firsts) {select}"""


_SECTOR_FRAMES = ("profiles", "orgs", "postings")


def _refreshed(spark, sf):
    i = Inputs(spark, sf)
    return sectors.refresh(i.profiles(), i.orgs(), i.postings(), AS_OF)


@query("J2 J18 J19 J20 D11 D12 E7 G1 G2 H12 C14", lambda: sql_sectors("""
    SELECT name_key, array_to_string(items, ';') AS evidence,
           array_to_string(list_sort(list_transform(items, lambda x: string_split(x, '|')[1])), ',') AS sector_tags,
           string_split(items[1], '|')[2] AS sector_basis FROM final"""), _SECTOR_FRAMES)
def sector_refresh(spark, sf):
    r = _refreshed(spark, sf)
    ev = F.transform("sector_evidence", lambda e: F.concat_ws("|", e["tag"], e["source"], F.coalesce(e["detail"], F.lit(""))))
    return r.select("name_key", F.array_join(ev, ";").alias("evidence"), joined("sector_tags"), "sector_basis")


@query("J20 D18 H14", lambda: sql_sectors("""
    SELECT coalesce(string_split(items[1], '|')[2], 'none') AS basis, count(*) AS employers, count(*) AS changed FROM final GROUP BY 1"""),
       _SECTOR_FRAMES)
def sector_basis_counts(spark, sf):
    return sectors.basis_counts(_refreshed(spark, sf))


@query("C1 D12 N4", f"""SELECT o.org_id, CASE WHEN p.sectors_computed_at IS NOT NULL THEN coalesce(p.profile_tags, '') ELSE
      array_to_string(list_sort(list_distinct({d.list_of('o.sector_tags')})), ',') END AS all_sector_tags,
      CASE WHEN p.sectors_computed_at IS NOT NULL THEN p.sector_basis WHEN o.sector_tags <> '' THEN 'name' END AS sector_basis
      FROM orgs o LEFT JOIN profiles p ON p.name_key = o.name_key""", ("orgs", "profiles"))
def org_view(spark, sf):
    return Inputs(spark, sf).org_view().select("org_id", joined("all_sector_tags"), "sector_basis")
