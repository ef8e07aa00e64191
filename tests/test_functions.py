"""Column builders against worked examples."""

from pyspark.sql import functions as F

from postmill.functions import classify, dates, extract, labels, names, text, urls


def test_register_fields(evaluate):
    raw = [("Worker (A rating)",), ("Temporary Worker (A rating)",), ("Worker (A (Premium))",), ("Temporary Worker (A (SME+))",),
           ("Worker (B rating)",), ("Worker (UK Expansion Worker: Provisional )",), ("odd",)]
    assert evaluate(classify.rating, raw, "t string") == ["A", "A", "A_PREMIUM", "A_SME_PLUS", "B", "PROVISIONAL", "UNKNOWN"]
    assert evaluate(classify.worker_type, raw, "t string")[:2] == ["worker", "temporary_worker"]


def test_keys_and_names(evaluate):
    assert evaluate(text.key, [("  ACME “Widgets”  Ltd ",), ("O’Neil",), (None,)], "t string") == ["acme widgets ltd", "o'neil", ""]
    assert evaluate(text.title_case, [("STOKE-ON-TRENT",), ("isle OF wight",), ("king's lynn",), ("(north) end and by",)], "t string") == [
        "Stoke-On-Trent", "Isle of Wight", "King'S Lynn", "(North) End and by"]
    phrases = [("The Acme Widgets (UK) Limited",), ("Foo Ltd t/a Bright Ideas GmbH Ireland",), ("Software AG",), ("The Company Ltd",),
               ("Pacific Green Technologies",), ("Kingdom & Sons Co",)]
    assert evaluate(text.core_phrase, phrases, "t string") == [
        "acme widgets", "bright ideas", "software ag", "the company ltd", "pacific green technologies", "kingdom sons"]


def test_html(evaluate):
    cases = [("<p>One</p><ul><li>Two</li></ul>",), ("&lt;p&gt;Tea &amp;amp; cake&lt;/p&gt;",), ("<style>x</style>A &pound;5 &#8211; &#x41; &nope; &#0;",), (None,)]
    assert evaluate(text.html_to_text, cases, "t string") == ["One\nTwo", "Tea & cake", "A £5 – A &nope; &#0;", None]


def test_sectors(evaluate):
    cases = [("Bright Software Ltd",), ("Primary Care Network",), ("Metro Networks",), ("Union Bank",), ("Maple Restaurant",), ("Acme Technologies",)]
    assert evaluate(classify.sector_tags, cases, "t string") == [["tech", "software"], [], ["tech", "telecoms"], ["finance"], [], ["tech"]]
    ev = evaluate(classify.sic_evidence, [(["62012", "70229", "72190", "8610"],)], "c array<string>")[0]
    assert [(e.tag, e.detail) for e in ev] == [("software", "SIC 62012"), ("tech", "SIC 62012"), ("engineering", "SIC 72190"), ("healthcare", "SIC 8610")]


def test_roles(evaluate):
    cases = {
        ("Senior Software Engineer", None): "software", ("Machine Learning Engineer", None): "ai_ml", ("Lead Engineer", "Platform"): "software",
        ("Lead Engineer", "Engineering"): None, ("Electrical Engineer", "Software"): None, ("Head of Product", None): "product",
        ("Director of Product Marketing", None): None, ("Director of Product", None): "product", ("Security Analyst", None): "cybersecurity",
        ("Solutions Architect", None): "adjacent", ("Service Desk Analyst", None): "it_support", ("UX Researcher", None): "design",
        ("Data Engineer", None): "data", ("Site Reliability Engineer", None): "cloud_devops", ("Chef", None): None, ("Développeur café", None): None,
    }
    assert evaluate(classify.role_family, list(cases), "t string, d string") == list(cases.values())
    levels = [("Graduate Developer",), ("CTO",), ("Staff Engineer",), ("Lead QA",), ("Sr. Engineer",), ("Associate PM",), ("Engineer",)]
    assert evaluate(classify.seniority, levels, "t string") == ["entry", "executive", "principal", "lead", "senior", "mid", None]


def test_places(evaluate):
    cases = [(["London"], []), (["New York"], []), (["Cambridge, MA"], []), (["York"], []), (["Paris"], ["gb"]), (["Reading, United Kingdom"], []),
             (["London, Ontario, Canada"], []), (["Birmingham, AL"], []), ([], [])]
    assert evaluate(classify.is_uk_location, cases, "l array<string>, c array<string>") == [True, False, False, True, True, True, False, False, False]
    assert evaluate(classify.uk_city, [(["Remote", "Leeds or London"],), (["New York"],), (["milton keynes"],)], "l array<string>") == ["Leeds", None, "Milton Keynes"]


def test_working_pattern(evaluate):
    cases = [("Remote - UK", ""), ("Remote or London", ""), ("Hybrid, Leeds", ""), ("Leeds", "Fully remote team"), ("Leeds", "free on-site parking"), ("Leeds", "This role is office-based.")]
    got = evaluate(classify.work_mode, cases, "l string, t string")
    assert [g and (g.mode, g.origin) for g in got] == [
        ("remote", "location"), ("flexible", "location"), ("hybrid", "location"), ("remote", "text"), None, ("onsite", "text")]
    assert evaluate(classify.employment_type, [("Full-time",), ("fixed_term",), ("Intern",), ("odd",), (None,)], "t string") == ["full_time", "contract", "internship", None, None]


def test_pay(evaluate):
    cases = [("£60,000 - £75,000 per annum",), ("£60-80k",), ("£450 to £500 per day",), ("$90,000 - $120,000; UK £50k – £60k",), ("£15.50 - £20 an hour",),
             ("from £60,000",), ("£2 - £3 coffee",), ("£90k - £60k",)]
    got = evaluate(extract.pay_range, cases, "t string")
    assert [g and (g.min, g.max, g.currency, g.period) for g in got] == [
        (60000, 75000, "GBP", "year"), (60000, 80000, "GBP", "year"), (450, 500, "GBP", "day"), (50000, 60000, "GBP", "year"), (15.5, 20, "GBP", "hour"), None, None, None]


def test_sponsorship(evaluate):
    cases = ["We are unable to offer visa sponsorship.", "Visa sponsorship is available.", "No sponsorship. But we can offer sponsorship to some.",
             "You need the right to work in the UK", "We sponsor events", "Nothing here", "x. Sponsor. We will not sponsor a visa"]
    got = evaluate(extract.sponsorship, [(c,) for c in cases], "t string")
    assert [g.signal for g in got] == ["not_offered", "offered", "unclear", "right_to_work", "unmentioned", "unmentioned", "not_offered"]
    assert cases[6][got[6].start:got[6].stop] == "will not sponsor a visa"
    shown = evaluate(lambda t: extract.snippet(t, extract.sponsorship(t)["start"], extract.sponsorship(t)["stop"]), [("a " * 100 + "no sponsorship" + " b" * 100,)], "t string")[0]
    assert shown.startswith("a a") and "no sponsorship" in shown and len(shown) <= 90 + 14 + 90


def test_skills_years_degree(evaluate):
    t = "Python, C++, node.js, ASP.NET, ci/cd, Apache Spark and JavaScript (not java-free) 5+ years of commercial experience, a degree"
    assert evaluate(lambda c: extract.skills(extract.skill_hits(c)), [(t,)], "t string")[0] == ["Python", "JavaScript", "Java", "C++", "C#", "Node.js", "CI/CD", "Spark"]
    assert evaluate(extract.years_of_experience, [(t,), ("40 years of experience",), ("years",)], "t string") == [5, None, None]
    assert evaluate(extract.mentions_degree, [(t,), ("none",)], "t string") == [True, False]


def test_dates(evaluate, spark):
    assert [str(x) for x in evaluate(dates.published_on, [("r_2026-09-30.csv",), ("Sept 3, 2026.csv",), ("x.csv",)], "t string")] == ["2026-09-30", "2026-09-03", "None"]
    assert [str(x) for x in evaluate(dates.uk_date, [("11/09/2012",), ("2012-09-11",), ("99/99/2012",)], "t string")] == ["2012-09-11", "None", "None"]
    # Every day of two years: the scheduler's 07:00 and 08:00 UTC never both or neither fall on eight o'clock in the UK.
    days = spark.sql("select explode(sequence(timestamp '2026-01-01 00:00:00', timestamp '2027-12-31 00:00:00', interval 1 day)) d")
    hit = lambda h: (dates.london_hour(F.col("d") + F.expr(f"interval {h} hour")) == 8).cast("int")
    assert days.where(hit(7) + hit(8) != 1).count() == 0


def test_labels(evaluate):
    assert evaluate(labels.money_short, [(70000, 85000, "GBP", "year"), (450, 450, "GBP", "day"), (None, None, None, None)],
                    "a int, b int, c string, p string") == ["£70k–£85k", "£450 a day", None]
    assert evaluate(labels.first_place, [("London, England | Leeds",), ("",)], "t string") == ["London", "Location not stated"]
    assert evaluate(labels.mask_email, [("tester@example.test",)], "t string") == ["t***@e***.test"]
    assert evaluate(labels.address_bucket, [("2001:0db8::1",), ("::ffff:1.2.3.4",), ("10.0.0.1",)], "t string") == ["2001:db8:0:0", "1.2.3.4", "10.0.0.1"]
    assert evaluate(labels.normalise_email, [(" A@B.co ",), ("a@b",), ("a b@c.de",)], "t string") == ["a@b.co", None, None]


def test_urls(evaluate):
    assert evaluate(urls.safe_http_url, [("HTTPS://A.com",), ("javascript:alert(1)",), ("data:x",), (" http://b.org:80/x?y ",), (None,)], "t string") == [
        "https://a.com/", None, None, "http://b.org/x?y", None]
    cases = [("../a/./b?x=1#f", "https://ex.com/p/q/r"), ("//c.io/z", "https://ex.com/"), ("?p=2", "https://ex.com/l"), ("mailto:a@b.c", "https://ex.com/"), ("k", "https://ex.com/a/b")]
    assert evaluate(urls.resolve, cases, "h string, p string") == ["https://ex.com/p/a/b?x=1#f", "https://c.io/z", "https://ex.com/l?p=2", None, "https://ex.com/a/k"]


def test_name_guesses(evaluate):
    got = evaluate(names.domain_candidates, [("bright ideas",), ("ab",)], "p string")
    assert got[0][:4] == ["brightideas.co.uk", "bright.co.uk", "bright-ideas.co.uk", "brightideas.com"] and got[1] == []
    cases = [("Acme Rockets Ltd", "acme rockets", None, None), ("Smart", "smart", None, None), ("Atlantis", "atlantis technology", "https://www.atlantis.com", 0.9),
             ("Atlantis", "atlantis technology", "https://www.atlantis.com", 0.7)]
    assert evaluate(names.board_name_matches, cases, "b string, p string, w string, c double") == [True, False, True, False]


def test_product_titles_look_ahead(evaluate):
    from postmill.functions import classify

    rows = [("Director of Product and Director of Product Marketing", None), ("Director of Product Marketing", None), ("Director of Product", None), ("Solution Architect", None), ("End-user computing lead", None)]
    assert evaluate(classify.role_family, rows, "t string, d string") == ["product", None, "product", "adjacent", "it_support"]


def test_deeply_nested_postings_fail_loudly(spark):
    import pytest

    from postmill.sources import jsonld

    def page(levels):
        body = '{"@type":"JobPosting","title":"x"}'
        for _ in range(levels):
            body = '{"@graph":[' + body + "]}"
        return f'<script type="application/ld+json">{body}</script>'

    deep = lambda n: spark.createDataFrame([("a", page(n))], "name_key string, html string")
    assert jsonld.job_postings(deep(5)).count() == 1
    with pytest.raises(Exception, match="nested deeper"):
        jsonld.job_postings(deep(40)).collect()


def test_rule_tables_are_arguments(spark):
    from postmill.functions import classify, extract
    from postmill.functions.patterns import words

    df = spark.createDataFrame([("Head Gardener", "we grow roses and ferns")], "t string, body string")
    from pyspark.sql import functions as F

    table = (("Roses", words("roses")), ("Ferns", words("ferns")), ("Moss", words("moss")))
    got = df.select(
        classify.role_family(F.col("t"), F.lit(None).cast("string"), (("garden", words("gardener")),)).alias("family"),
        classify.seniority(F.col("t"), (("top", words("head")),)).alias("level"),
        extract.skills(extract.skill_hits(F.col("body"), table), table=table).alias("skills"),
        extract.skills(extract.skill_hits(F.col("body"), table), 1, table).alias("one"),
    ).first()
    assert (got.family, got.level, got.skills, got.one) == ("garden", "top", ["Roses", "Ferns"], ["Roses"])


def test_text_is_read_once(spark):
    """Each step of the markup reader stands once in the plan, also where its result is named more than once."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("&lt;p&gt;a &AMP;amp; b&lt;/p&gt; &#99;",)], "t string")
    out = df.select(text.html_to_text(F.col("t")).alias("out"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("</\\1>") == 1, plan
    assert out.first().out == "a & b\nc"


def test_entities_in_any_case_and_order(evaluate):
    cases = {"&AMP;lt;": "&lt;", "&amp;lt;": "&lt;", "&#38;lt;": "&lt;", "&#65\n;": "&#65\n;", "&&lt;;": "&<;", "&zzz;&copy;": "&zzz;©", "&#x41;&#0;": "A&#0;"}
    assert evaluate(text.decode_entities, [(c,) for c in cases], "t string") == [*cases.values()]


def test_input_lookups_are_not_arm_by_arm(spark):
    from checks import bindings as b

    assert not any("CASE CAST((" in b._looked_up(sql) for sql in b.FRAMES.values())
    expr = b.pick("x", ("a", None, "it''s"[:2]))
    df = spark.sql("SELECT x FROM VALUES (0L), (1L), (2L), (3L), (-1L), (NULL) t(x)")
    assert all(r[0] == r[1] for r in df.selectExpr(expr, b._looked_up(expr)).collect())


def test_screen_runs_after_rows_are_dealt_out(spark):
    """The tests of the screen are not moved below the exchange, into the tasks that read the file."""
    from checks import q_postings
    from postmill.operators import postings

    plan = postings.screen(q_postings.raw_boards(spark, "/root/testdata/sf0.001")).where("skip is null")._jdf.queryExecution().executedPlan().toString()
    head, below = plan.split("RoundRobinPartitioning", 1)
    assert "RLIKE(" in head and "RLIKE(" not in below


def test_sponsorship_text_is_joined_once(spark):
    df = spark.createDataFrame([("We cheer. No sponsorship. Visa support!",), ("cheese",), (None,)], "t string")
    out = df.select(extract.sponsorship(F.col("t")).alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().count("array_join(") == 1
    assert [r.s.signal for r in out.collect()] == ["unclear", "unmentioned", "unmentioned"]


def test_variant_list_is_read_once(spark):
    from postmill.sources import jsonld

    df = spark.sql("SELECT parse_json(j) AS v FROM VALUES ('{\"a\":[1,2]}'), ('{\"a\":3}'), ('{\"a\":null}'), ('{}'), ('{\"a\":[]}') t(j)")
    out = df.select(jsonld._list(F.col("v"), "$.a").alias("l"))
    assert out._jdf.queryExecution().analyzed().toString().count("$.a") == 1
    assert [r[0] for r in out.select(F.size("l")).collect()] == [2, 1, 0, 0, 0]


def test_a_match_holds_what_its_pattern_needs(evaluate):
    """texts are searched for the words a pattern cannot do without before the pattern is run."""
    import random
    import re

    from postmill.functions import patterns, rules

    assert patterns.needed(rules.OFFER[0]) == (("visa sponsorship",), ("available", "offered", "possible", "provided", "supported"))
    assert patterns.needed(r"\<(?:ab)?c+\>|x") == () and patterns.begins_with(r"\<(?:ab)?c") == "ac" and patterns.begins_with(r"a?") == ""
    mixed = (*rules.REFUSAL, *rules.OFFER, rules.RIGHT_TO_WORK, rules.YEARS, rules.DEGREE, rules.REMOTE_TEXT, rules.ONSITE_TEXT, *[p for _, p in rules.SKILLS])
    pick = random.Random(5)
    parts = sorted({w for p in mixed for w in re.findall(r"[a-z0-9+#./]+", p)}) + [" ", " ", " ", "\n", ".", "3", "'", "-", "İ", "K"]
    texts = ["".join(pick.choice(parts) + pick.choice(["", " "]) for _ in range(12)).title() for _ in range(400)] + ["We Are Unable To Offer Visa Sponsorship", "ISO27001 pentest A/B Testing"]
    for p in mixed[::7] + (rules.DEGREE, rules.SKILLS[18][1]):
        got = evaluate(lambda c, p=p: text.matches(c, p) & ~text.may_match(F_lower(c), p), [(t,) for t in texts], "t string")
        assert not any(got), p


def F_lower(c):
    from pyspark.sql import functions as F

    return F.lower(c)


def test_spans_in_a_text_that_holds_the_marks(evaluate):
    """matches are cut out at marks; a text that holds a mark already gives the same places."""
    from pyspark.sql import functions as F

    cases = ["no sponsorship, NO visa sponsorship 🙂 no sponsorship", "no sponsorship 🙂 no sponsorship", "no sponsorship", "no sponsor", ""]
    got = evaluate(lambda c: F.transform(extract.spans(c, r"\<no (?:visa )?sponsorship\>", 4), lambda s: F.substr(c, s["start"] + 1, s["stop"] - s["start"])), [(c,) for c in cases], "t string")
    assert got == [["no sponsorship", "NO visa sponsorship", "no sponsorship"], ["no sponsorship"] * 2, ["no sponsorship"], [], []]


def test_only_runs_that_are_not_one_space_are_squeezed(evaluate, spark):
    from pyspark.sql import functions as F

    cases = [" a  b\tc   d e\n\n f g ", "a b", "", "é 　"]
    assert evaluate(text.squeeze, [(c,) for c in cases], "t string") == [" a b c d e f g ", "a b", "", "é "]
    # A single space matches nothing, so most texts are only scanned.
    assert spark.range(1).select(F.lit("a b c").rlike(text._RUN_OF_SPACES)).first()[0] is False


def test_pay_is_read_from_one_scan(evaluate, spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("£60-80k\u0001per day £450 - £500 a day",), ("€1,000 to 2,000 per month",), ("60-80k",), (None,)], "t string")
    out = df.select(extract.pay_range(F.col("t")).alias("p"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    assert [r.p and tuple(r.p) for r in out.collect()] == [(60000, 80000, "GBP", "year"), (1000, 2000, "EUR", "month"), None, None]


def test_skill_words_are_tried_by_first_letter():
    from postmill.functions import rules

    assert extract._one_scan([p for _, p in rules.SKILLS]).count("python") == 1
    assert "(?=p)(?:(?:python)" in extract._one_scan([p for _, p in rules.SKILLS])
    assert extract._one_scan([r"\<(?:\w+x)\>", r"\<(?:y)\>"]) == r"\<(?:(?:\w+x)\>|(?:y)\>)"
