"""Rule tables: the vocabularies the classifiers and extractors look for.

Everything here is data. The values are fixed, because a different word list
gives different results; the code that applies them lives in ``classify``,
``extract`` and ``names``. Patterns use the notation of ``patterns``.
"""

from __future__ import annotations

from .patterns import any_of, words

# --------------------------------------------------------------------------
# Register vocabulary
# --------------------------------------------------------------------------
RATING_RANK = {"A_PREMIUM": 5, "A_SME_PLUS": 4, "A": 3, "B": 2, "PROVISIONAL": 1, "UNKNOWN": 0}
RATING_MARKERS = (
    ("PROVISIONAL", "provisional"),
    ("A_PREMIUM", "premium"),
    ("A_SME_PLUS", "sme+"),
    ("A", "(a rating)"),
    ("B", "(b rating)"),
)
SMALL_WORDS = ("upon", "on", "in", "under", "the", "of", "le", "de", "cum", "with", "by", "and")

# --------------------------------------------------------------------------
# Sector vocabulary
# --------------------------------------------------------------------------
SECTOR_TAGS = (
    "tech", "software", "ai", "data", "cloud", "cybersecurity", "it_services", "digital", "design",
    "fintech", "telecoms", "electronics", "games", "finance", "healthcare", "education",
    "consulting", "engineering",
)
SECTOR_WORDS = {
    "software": words("software", "saas", "apps?", "devops", "developers?"),
    "ai": words("ai", "artificial intelligence", "machine learning", "deep ?learning", "robotics?",
                "automation", "llm"),
    "data": words("data", "analytics", "databases?", "insights?"),
    "cloud": words("cloud", "hosting", "datacent(?:re|er)s?"),
    "cybersecurity": words(r"cyber\w*", "infosec", "penetration", "soc", "encryption"),
    "it_services": words(
        "it (?:services|solutions|consulting|consultancy|support|systems|recruitment)",
        "computing", "computers?", "informatics", "technology (?:services|solutions|consulting)"),
    "digital": words("digital", "online", "web", "mobile", "internet", "virtual"),
    "design": words("ux", "ui", "user experience", "product design", "digital design",
                    "design (?:studio|agency|consultancy)"),
    "fintech": words("fintech", "payments?", "blockchain", r"crypto\w*", "neobank"),
    "telecoms": words(r"telecom\w*", "networks?", "broadband", "wireless", "satellite"),
    "electronics": words("electronics?", "semiconductors?", "photonics?",
                         "micro(?:chip|electronics)", "sensors?", "quantum"),
    "games": words("games?", "gaming", "esports?"),
    "finance": words("bank", "banking", "capital", "asset management", "insurance", "investment",
                     "financial"),
    "healthcare": words("nhs", "hospital", "health(?:care)?", r"pharma\w*", r"biotech\w*", "medical",
                        "therapeutics", "genomics?"),
    "education": words("university", "college", "school", "academy", "institute", "research",
                       "sciences?"),
    "consulting": words("consult(?:ing|ancy|ants)", "advisory", "partners"),
    "engineering": words("engineering", "engineers", "aerospace", "automotive", "energy",
                         "renewables?"),
}
TECH_SECTORS = ("software", "ai", "data", "cloud", "cybersecurity", "it_services", "digital",
                "design", "fintech", "telecoms", "electronics", "games")
TECH_WORDS = words("tech", "technolog(?:y|ies)")
TELECOM_CERTAIN = words(r"telecom\w*", "broadband", "wireless", "satellite")
NETWORK_OTHER = words("care", "health", "nhs", "tv", "television", "radio", r"broadcast\w*", "media",
                      "primary", "social", "support", "community", "business", "charity", "family",
                      "church")
# Tags a web page's own wording may support, in output order.
SITE_TEXT_TAGS = ("software", "ai", "data", "cloud", "cybersecurity", "it_services", "design",
                  "fintech", "telecoms", "electronics", "games")

# SIC 2007 prefixes and what they say about a company.
SIC_PREFIX_TAGS = (
    ("58210", ("games", "tech")),
    ("58290", ("software", "tech")),
    ("6201", ("software", "tech")),
    ("6202", ("it_services", "tech")),
    ("6203", ("it_services", "tech")),
    ("6209", ("it_services", "tech")),
    ("6311", ("data", "cloud", "tech")),
    ("6312", ("digital", "tech")),
    ("61", ("telecoms", "tech")),
    ("261", ("electronics", "tech")),
    ("262", ("electronics", "tech")),
    ("263", ("electronics", "telecoms", "tech")),
    ("264", ("electronics", "tech")),
    ("265", ("electronics", "tech")),
    ("268", ("electronics", "tech")),
    ("72190", ("engineering",)),
    ("72110", ("healthcare",)),
    ("71", ("engineering",)),
    ("74100", ("design",)),
    ("64110", ("finance",)),
    ("6419", ("finance",)),
    ("6491", ("finance",)),
    ("6492", ("finance",)),
    ("6499", ("finance",)),
    ("65", ("finance",)),
    ("66", ("finance",)),
    ("6430", ("finance",)),
    ("6630", ("finance",)),
    ("86", ("healthcare",)),
    ("21", ("healthcare",)),
    ("85", ("education",)),
)
GENERIC_SIC = (
    "64201", "64202", "64203", "64204", "64205", "64209", "64301", "64302", "64303", "64304", "64305",
    "64306", "70100", "70210", "70221", "70229", "74901", "74902", "74909", "74990", "78101", "78109",
    "78200", "78300", "82110", "82190", "82990", "68100", "68209", "68310", "68320", "96090", "98000",
    "98100", "99999", "99000",
)
FAMILY_SECTOR = (
    ("software", "software"), ("ai_ml", "ai"), ("data", "data"), ("cloud_devops", "cloud"),
    ("cybersecurity", "cybersecurity"), ("design", "design"),
)
MIN_ROLES_FOR_SECTOR = 3
EVIDENCE_RANK = {"sic": 0, "website": 1, "jobs": 2, "name": 3}

# --------------------------------------------------------------------------
# Role families, in rule order (first match wins)
# --------------------------------------------------------------------------
ROLE_LABELS = {
    "software": "Software engineering",
    "product": "Product",
    "design": "UX / UI / product design",
    "ai_ml": "AI / machine learning",
    "data": "Data",
    "cloud_devops": "Cloud / DevOps",
    "cybersecurity": "Cybersecurity",
    "it_support": "IT / support",
    "adjacent": "Adjacent tech roles",
}
ROLE_RULES = (
    ("ai_ml", any_of(
        words("machine learning", "ml", "mlops", "ai", "artificial intelligence", "deep learning", "nlp",
              "computer vision", "llms?", "generative", "applied scientist",
              "research (?:scientist|engineer)"),
        r"\<a\.i\.\b")),
    ("software", words(
        "software (?:engineer|developer|architect)", "engineering (?:manager|director|lead|head)",
        "(?:head|director|vp)(?: of)? engineering", "swe", "(?:front|back)[- ]?end", "full[- ]?stack",
        "ios (?:engineer|developer)", "android (?:engineer|developer)", "mobile (?:engineer|developer)",
        "web (?:engineer|developer)", "sdet", "qa engineer", "test automation", "automation tester",
        "software tester", "qa (?:analyst|tester|lead)", "test (?:analyst|lead)", "firmware",
        "embedded (?:software|engineer)", "programmer")),
    ("cybersecurity", any_of(
        words(r"cyber\w*", "infosec", "appsec", r"pentest\w*", r"penetration test\w*", "devsecops", "ciso",
              "soc analyst", "threat (?:intelligence|hunter|analyst)", "vulnerability",
              "incident response", "(?:blue|red|purple) team"),
        words("security (?:engineer|analyst|architect|researcher|specialist|consultant|manager|lead|head|"
              "officer|director|developer|tester|operations)"),
        words("(?:head|director) of security"),
        words("(?:information|application|cloud|product) security"))),
    ("cloud_devops", words(
        "devops", "sre", "site reliability", "platform engineer", "infrastructure engineer",
        "cloud (?:engineer|architect|ops|platform)", "kubernetes", "release engineer", "build engineer",
        "observability", "reliability engineer")),
    ("data", words(
        "data (?:engineer|scientist|science|analyst|architect|analytics|platform|product|governance|"
        "quality|steward)",
        "(?:head|director|vp|chief)(?: of)? data", "analytics engineer", "business intelligence",
        "bi (?:developer|analyst|engineer)", "database", "dba", "etl", "statistician",
        "quantitative (?:analyst|researcher|developer)")),
    ("design", words(
        "designer", "ux", "ui", "user (?:experience|interface|research)", "product design",
        "interaction design", "visual design", "content design",
        "design (?:lead|manager|system|ops|technologist)")),
    ("product", words(
        "product (?:manager|owner|lead|director|operations|ops|analyst)",
        r"(?:head|director|vp|chief)(?: of)? product(?!\s+(?:marketing|sales))", "head of product", "chief product",
        "vp(?: of)? product", "group product", "product management", "apm")),
    ("adjacent", words(
        "forward[- ]deployed", "solutions? (?:engineer|architect|consultant)", "sales engineer",
        "customer (?:engineer|success engineer)",
        "technical (?:account manager|writer|support|program(?:me)?|project|recruiter|consultant|"
        "specialist|architect)",
        "support engineer", "implementation (?:engineer|consultant|specialist)", "business analyst",
        "(?:project|programme|delivery) manager", "scrum master", "agile coach", "enterprise architect",
        "developer (?:advocate|relations)", "solution architect")),
    ("it_support", words(
        "it (?:support|analyst|technician|manager|engineer|operations|helpdesk)",
        "end[- ]user (?:services|computing|support)", "service desk", "help ?desk", "desktop support",
        "systems? administrator", "sysadmin", "network engineer", "infrastructure analyst",
        "end[- ]user computing")),
)
SOFTWARE_WORDS = words("developer", "software")
ENGINEER_WORD = words("engineer")
PHYSICAL_ENGINEER = any_of(
    words("sales", "solutions?", "customer", "support", "mechanical", "civil", "electrical",
          "electronics?", "structural", "field", "process", "manufacturing", "production", "maintenance",
          "controls?", "chemical", "building", "plant", "hardware", "network", "systems?",
          "applications?", "service", "commissioning", "installation", "thermal", "hvac", "automotive",
          "materials", "safety", "quality", "project", "design", "test", "reliability", "technical")
    + r".*\<engineer\>",
    r"\<engineer\>.*" + words("mechanical", "electrical", "civil", "maintenance"))
TECH_DEPARTMENT = words("software", "digital", "technology", "tech", "platform", "data",
                        "infrastructure", "product", "r&d", "it", "ai", "ml", "cloud", "security",
                        "backend", "frontend", "mobile", "web")

SENIORITY_RULES = (
    ("entry", words("intern", "internship", "placement", r"apprentice\w*", "graduate", "grad", "junior",
                    "jr", "entry[- ]level", "trainee")),
    ("executive", words("chief", "cto", "cio", "ciso", "cpo", "vp", "vice president", "svp", "evp")),
    ("principal", words("principal", "staff", "distinguished", "fellow")),
    ("lead", words("lead", "head of", "director", "manager of", "engineering manager")),
    ("senior", words("senior", "sr")),
    ("mid", words("mid[- ]level", "intermediate", "associate")),
)

# --------------------------------------------------------------------------
# places
# --------------------------------------------------------------------------
UK_CITIES = (
    "london", "manchester", "birmingham", "edinburgh", "glasgow", "bristol", "leeds", "cambridge",
    "oxford", "cardiff", "belfast", "liverpool", "newcastle", "sheffield", "nottingham", "southampton",
    "reading", "brighton", "leicester", "aberdeen", "dundee", "exeter", "bath", "york", "milton keynes",
    "coventry", "swansea", "bournemouth", "portsmouth", "norwich", "derby", "plymouth", "stirling",
    "inverness", "durham", "guildford", "slough", "luton", "watford", "swindon", "cheltenham",
    "gloucester", "canterbury", "warwick", "lancaster", "salford", "sunderland", "wolverhampton",
    "ipswich", "peterborough", "northampton", "basingstoke", "crawley", "maidenhead", "harlow",
    "bracknell", "woking", "hemel hempstead", "st albans", "chelmsford", "colchester",
)
UK_COUNTRY = any_of(
    words("united kingdom", "uk", "gb", "gbr", "great britain", "britain", "england", "scotland", "wales",
          "northern ireland"),
    r"\<u\.k\.\b")
OTHER_COUNTRY = any_of(
    words("canada", "ontario", "usa", "united states", "mexico", "australia", "india", "singapore",
          "germany", "france", "ireland", "netherlands"),
    r"\<u\.s\.a?\.?\b")
# US state and Canadian province codes after a comma, upper case only.
NORTH_AMERICA_CODE = (
    r",\s*(?:A[LKZR]|C[AOT]|D[EC]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|"
    r"T[NX]|UT|V[AT]|W[AIVY]|ON|QC|BC|AB|MB|NS|NB|SK)\>"
)
UK_COUNTRY_CODES = ("gb", "uk", "gbr")
COUNTRY_NAME_CODE = {
    "united kingdom": "GB", "uk": "GB", "great britain": "GB", "england": "GB", "scotland": "GB",
    "wales": "GB", "northern ireland": "GB",
}

# --------------------------------------------------------------------------
# Working pattern, contract, level
# --------------------------------------------------------------------------
REMOTE_TEXT = words("fully remote", "100% remote", "remote[- ]first", "work from anywhere",
                    "remote[- ]only")
ONSITE_TEXT = words(
    "on[- ]?site (?:role|position|basis|working|presence|only)",
    "(?:this|the) (?:role|position) is (?:fully )?(?:on[- ]?site|office[- ]based)", "office[- ]based",
    "based (?:on[- ]?site|in (?:our|the) office)", "fully on[- ]?site", "100% on[- ]?site",
    "(?:5|five) days (?:a week )?(?:in|at) the office")
REMOTE_FILLER = r"\<remote\>|\(|\)|,|\<uk\>|united kingdom|\<or\>|-|–|\s"
EMPLOYMENT_PREFIXES = (
    ("full_time", "(?:fulltime|permanent|regular)"),
    ("part_time", "parttime"),
    ("contract", "(?:contract|contractor|fixedterm|freelance)"),
    ("internship", "(?:intern|internship|placement|apprentice)"),
    ("temporary", "(?:temp|temporary|seasonal)"),
)
EMPLOYMENT_TITLE = (
    ("internship", words("intern", "internship", "placement", r"apprentice\w*")),
    ("contract", words("contract", "contractor", "fixed[- ]term", "ftc", "freelance")),
    ("part_time", words("part[- ]time")),
    ("temporary", words("temporary")),
)
EXCERPT_CHARS = 500
SNIPPET_MARGIN = 90

# --------------------------------------------------------------------------
# pay
# --------------------------------------------------------------------------
CURRENCY_SIGN = {"£": "GBP", "$": "USD", "€": "EUR"}
CURRENCIES = ("GBP", "USD", "EUR")
PAY_AMOUNT = r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s?(k)?"
PAY_RANGE = r"([£$€])\s?" + PAY_AMOUNT + r"\s*(?:-|–|—|to|and)\s*(?:[£$€]\s?)?" + PAY_AMOUNT
PAY_CONTEXT_CHARS = 40
PAY_PERIOD_TEXT = (
    ("day", r"^\s*(?:per|a|/)\s*(?:day|diem)|day rate"),
    ("hour", r"^\s*(?:per|an|/)\s*(?:hour|hr)|hourly"),
    ("month", r"^\s*(?:per|a|/)\s*month"),
)
PAY_BOUNDS = {"year": (10000, 1000000), "day": (80, 3000), "hour": (5, 500), "month": (800, 80000)}
PERIODS_PER_YEAR = {"year": 1, "month": 12, "day": 220, "hour": 1650}

# --------------------------------------------------------------------------
# Sponsorship wording
# --------------------------------------------------------------------------
REFUSAL = (
    words("unable", "not able", "cannot", "can ?not", "can[’']?t", "won[’']?t", "will not", "do not",
          "don[’']?t", "does not", "doesn[’']?t", "are not", "aren[’']?t", "is not", "isn[’']?t",
          "not currently", "no longer")
    + r"[^.\n]{0,40}\<(?:offer|provide|support|sponsor|consider|accept)\w*[^.\n]{0,30}"
    + words("visas?", "sponsorship", "sponsor", "applicants? requiring"),
    words("no (?:visa )?sponsorship"),
    words("sponsorship (?:is )?(?:not|unavailable)"),
    words("without", "not requiring", "not require", "no need for")
    + r"[^.\n]{0,25}\<(?:visa )?sponsorship\>",
    words("not (?:eligible|available) for (?:visa )?sponsorship"),
    words("(?:we|company) (?:do|does) not sponsor"),
    words("cannot sponsor"),
)
OFFER = (
    words("visa sponsorship")
    + r"[^.\n]{0,40}\b(?:is |are )?(?:available|provided|offered|supported|possible)\>",
    words("we", "company", "employer") + r"[^.\n]{0,30}"
    + words("can", "will", "do", "are able to", "are happy to", "may", "are willing to", "offer", "provide")
    + r"[^.\n]{0,30}" + words("sponsor", "sponsorship"),
    words("(?:offer|provide|support)s? (?:visa )?sponsorship"),
    words("sponsor(?:ing)? (?:your|a|the) (?:skilled worker )?visa"),
    words("skilled worker (?:visa )?sponsorship"),
    words("visa support"),
    words("licensed (?:visa )?sponsor"),
)
RIGHT_TO_WORK = any_of(
    words("right to work (?:in|within) the (?:uk|united kingdom)"),
    words("(?:uk|united kingdom) right to work"),
    words("eligible to work in the (?:uk|united kingdom)"))
# Every wording above contains at least one of these.
SPONSORSHIP_HINTS = ("sponsor", "visa", "applicant", "to work")

# --------------------------------------------------------------------------
# Skills, in output order
# --------------------------------------------------------------------------
SKILLS = (
    ("Python", words("python")), ("JavaScript", words("javascript")), ("TypeScript", words("typescript")),
    ("Java", words("java")), ("Kotlin", words("kotlin")), ("Swift", words("swift")),
    ("Go", words("golang", "go (?:language|developer|engineer)")), ("Rust", words("rust")),
    ("C++", r"\<c\+\+"), ("C#", r"\<c#|\.net\>"), ("Ruby", words("ruby")), ("PHP", words("php")),
    ("Scala", words("scala")), ("React", words(r"react(?:\.js|js)?")), ("Vue", words(r"vue(?:\.js)?")),
    ("Angular", words("angular")), ("Node.js", words(r"node\.?js")), ("Django", words("django")),
    ("AWS", words("aws", "amazon web services")), ("Azure", words("azure")),
    ("GCP", words("gcp", "google cloud")), ("Kubernetes", words("kubernetes", "k8s")),
    ("Docker", words("docker")), ("Terraform", words("terraform")),
    ("CI/CD", words("ci/cd", "continuous (?:integration|delivery)")), ("SQL", words("sql")),
    ("PostgreSQL", words("postgres(?:ql)?")), ("MongoDB", words("mongo(?:db)?")),
    ("Kafka", words("kafka")), ("Spark", words("(?:apache )?spark")), ("Airflow", words("airflow")),
    ("dbt", words("dbt")), ("Snowflake", words("snowflake")), ("BigQuery", words("bigquery")),
    ("Tableau", words("tableau")), ("Power BI", words("power ?bi")), ("Looker", words("looker")),
    ("PyTorch", words("pytorch")), ("TensorFlow", words("tensorflow")),
    ("Machine learning", words("machine learning")),
    ("NLP", words("nlp", "natural language processing")),
    ("LLMs", words("llms?", "large language models?")), ("Figma", words("figma")),
    ("User research", words("user research")), ("Prototyping", words(r"prototyp\w+")),
    ("Design systems", words("design systems?")), ("Agile", words("agile")), ("Scrum", words("scrum")),
    ("Jira", words("jira")), ("A/B testing", words(r"a/b test\w*", "experimentation")),
    ("GraphQL", words("graphql")), ("Microservices", words("microservices?")), ("Linux", words("linux")),
    ("Penetration testing", words(r"pen(?:etration)?[- ]?test\w*")), ("SIEM", words("siem")),
    ("ISO 27001", words("iso ?27001")), ("OWASP", words("owasp")), ("Splunk", words("splunk")),
    ("Salesforce", words("salesforce")), ("Excel", words("excel")),
)
YEARS = (r"\<(\d{1,2})\s*\+?\s*(?:(?:-|–|to)\s*\d{1,2}\s*)?years?[’']?\s*(?:of\s+)?"
         r"(?:[\w/-]+\s+){0,4}?experience")
MAX_YEARS = 25
DEGREE = words("bachelor", r"b\.?sc", r"m\.?sc", "master[’']?s", "degree", "phd", "doctorate")

# --------------------------------------------------------------------------
# Company names
# --------------------------------------------------------------------------
LEGAL_WORDS = (
    "limited", "ltd", "plc", "llp", "llc", "lp", "inc", "incorporated", "corp", "corporation", "co",
    "company", "cic", "cio", "uk", "gb", "europe", "emea", "holdings", "group", "international", "intl",
    "the", "and",
)
TRAILING_WORDS = (
    "gmbh", "ag", "bv", "nv", "sa", "sas", "sarl", "srl", "spa", "pty", "pvt", "private", "oy", "ab", "kk",
    "ltda", "kg", "ug", "sl", "sro", "united", "kingdom", "britain", "canada", "usa", "america",
    "americas", "ireland", "scotland", "wales", "england", "apac", "asia", "pacific",
)
COMMON_WORDS = (
    "global", "digital", "smart", "first", "alpha", "delta", "prime", "apex", "blue", "green", "red",
    "london", "british", "national", "united", "premier", "advanced", "applied", "general", "direct",
    "express", "future", "modern", "new", "north", "south", "east", "west", "central", "royal", "star",
    "sun", "pro", "one", "net", "web", "tech", "data", "systems", "solutions", "services", "consulting",
    "software", "cyber", "cloud", "ai", "labs", "studio", "media", "technology", "technologies", "expert",
    "experts", "innovation", "innovations", "enterprise", "enterprises", "network", "networks",
    "computing", "computers", "information", "business", "communications", "engineering", "management",
    "research", "security", "secure", "online", "mobile", "internet", "creative", "industrial",
    "electronics", "electronic", "automation", "robotics", "analytics", "insights", "insight", "partners",
    "resources", "logic", "dynamics", "concepts",
)
EVERYDAY_WORDS = (
    "it", "of", "at", "in", "on", "by", "to", "as", "be", "is", "or", "an", "if", "my", "we", "us", "no",
    "so", "do", "go", "up", "me", "he", "am", "the", "and", "for",
)
FILLER_WORDS = (
    "solutions", "services", "systems", "consulting", "consultancy", "consultants", "limited", "company",
    "trading", "enterprises", "associates", "partners",
)
DOMAIN_ENDINGS = ("co.uk", "com", "uk", "io", "ai", "tech", "net", "org", "org.uk")

# --------------------------------------------------------------------------
# Web pages and job boards
# --------------------------------------------------------------------------
PARKED_PAGE = (
    r"domain (?:is )?for sale|buy this domain|this domain (?:may be|is) for sale|parked (?:free|domain)|"
    r"sedo\.com|hugedomains|godaddy\.com/forsale|domain has expired|account suspended"
)
BOT_CHALLENGE = (
    r"just a moment|attention required|checking your browser|cf-chl|captcha|access denied|"
    r"enable javascript and cookies"
)
UK_PAGE_SIGNAL = any_of(
    "united kingdom", words("england", "scotland", "wales"),
    "registered in (?:england|scotland|wales)", words("company (?:number|no)"),
    r"\<[a-z]{1,2}\d[a-z\d]? ?\d[a-z]{2}\>", r"\+44", r"\<0[12378]\d{2,3} ?\d{3} ?\d{3,4}\>", "£")
UK_HOST = r"\.(?:uk|co\.uk|org\.uk|scot|wales|london)\z"
BOARD_LINKS = (
    ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"
                   r"|boards-api\.greenhouse\.io/v1/boards/([a-z0-9_-]+)"),
    ("lever", r"jobs(?:\.eu)?\.lever\.co/([a-z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9._%-]+)"),
    ("workable", r"apply\.workable\.com/([a-z0-9_-]+)"),
    ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9_-]+)"),
    ("teamtailor", r"([a-z0-9-]+)\.teamtailor\.com"),
    ("recruitee", r"([a-z0-9-]+)\.recruitee\.com"),
    ("personio", r"([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"),
    ("bamboohr", r"([a-z0-9-]+)\.bamboohr\.com/(?:careers|jobs)"),
    ("workday", r"([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[a-z]{2}/)?([a-z0-9_-]+)"),
)
RESERVED_SLUGS = (
    "embed", "jobs", "careers", "api", "v1", "j", "widget", "www", "static", "assets", "job", "apply",
    "en", "en-us", "app", "career", "support", "help", "company", "cdn", "login",
)
CAREER_TEXT = (r"career|\<jobs?\>|vacanc|join (?:us|the team|our team)|work (?:with|for) us|opportunit|"
               r"we.?re hiring|recruit")
CAREER_HREF = r"career|/jobs?\b|vacanc|join-us|work-(?:with|for)-us|recruit|opportunit"
CAREER_NOISE = r"blog|news|press|investor|privacy|terms|cookie|login|signin|\.pdf\z|mailto:|tel:"
CAREER_HEADING = "career|jobs|vacanc|join"
CAREER_PATHS = ("/careers", "/jobs", "/careers/", "/join-us", "/about/careers", "/company/careers")
JOB_PATH = r"/(?:jobs?|vacanc(?:y|ies)|positions?|openings?|roles?|careers?)/[^/?#]+"
NOT_JOB = (r"/(?:category|categories|tag|page|location|locations|team|teams|department|departments|"
           r"search|apply|login|blog|news)\b|\.(?:pdf|jpg|png|zip)\z|^mailto:|^tel:")
UK_DESCRIPTION = any_of("british", words("uk"), "united kingdom", "english", "scottish", "welsh", "england")
UK_WEBSITE = r"\.(?:co\.uk|uk)(?:/|\z)"
SIZE_BANDS = ((10, "1-9"), (50, "10-49"), (250, "50-249"), (1000, "250-999"), (5000, "1000-4999"))
PROBE_BOARDS = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters")

# HTML named entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "pound": "£", "euro": "€",
    "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "hellip": "…",
    "bull": "•", "middot": "·", "copy": "©",
}

# --------------------------------------------------------------------------
# Display labels
# --------------------------------------------------------------------------
PERIOD_LABEL = {"year": "a year", "month": "a month", "day": "a day", "hour": "an hour"}
SIGN = {"GBP": "£", "USD": "$", "EUR": "€"}
MOBILITY_PREFIX = "Global Business Mobility: "
ROUTE_SHORT = {
    "Ministers of Religion": "Minister of Religion",
    "Tier 2 Ministers of Religion": "Minister of Religion",
    "Tier 2 General": "Tier 2 General (old name)",
    "Government Authorised Exchange": "Government Exchange",
    "Senior or Specialist Worker": "Senior or Specialist",
    "UK Expansion Worker": "UK Expansion",
    "Secondment Worker": "Secondment",
    "Intra Company Transfers (ICT)": "Intra-company Transfer",
    "Intra-company Routes": "Intra-company",
}
LEVEL_RANK = {"entry": 0, "mid": 1, "senior": 2, "lead": 3, "principal": 3, "executive": 4}
LEVEL_NAME = {"entry": "entry level", "mid": "mid level", "senior": "senior", "lead": "lead",
              "principal": "staff / principal", "executive": "executive"}
MODE_NAME = {"remote": "remote", "hybrid": "hybrid", "onsite": "on-site", "flexible": "remote or office"}
WORK_MODES = ("remote", "hybrid", "onsite")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "internship", "temporary")
LEVELS = ("entry", "mid", "senior", "lead", "principal", "executive")
SPONSORSHIP_NEEDS = ("yes", "no", "unsure")

# --------------------------------------------------------------------------
# Limits of the page evidence rules
# --------------------------------------------------------------------------
FOOTER_CHARS = 1500
EMPTY_PAGE_CHARS = 80

# --------------------------------------------------------------------------
# Wording of notes on a profile
# --------------------------------------------------------------------------
CLAIM_REASON = "official website claim on Wikidata"
BLOCKED_NOTE = "domain matches the name but the site blocks automated access, so it could not be verified"
CANDIDATE_NOTE = "low-confidence candidate: "
NO_WEBSITE_NOTE = "no verified website found"
NO_CAREERS_NOTE = "no careers page found"
UNSURE_CAREERS_NOTE = "website match is not high-confidence"
ACCEPT_WEBSITE, CANDIDATE_WEBSITE, STRONG_WEBSITE, CLAIMED_WEBSITE = 0.6, 0.4, 0.8, 0.85

# --------------------------------------------------------------------------
# Wording of a match's reasons; {} stands for a value
# --------------------------------------------------------------------------
MATCH_WORDING = {
    "role_chosen": "Role type: {}, one of the types you chose",
    "role_other": "Role type is {}, which is not one you chose",
    "skills_shared": "Mentions {} of your skills: {}",
    "skills_none": "None of your listed skills appear in the posting",
    "level_silent": "The posting does not state a level",
    "level_same": "Level: {}, matching yours",
    "level_near": "Level: {}, one step from yours",
    "level_above": "Level: {}, well above yours",
    "level_below": "Level: {}, well below yours",
    "years_short": "Asks for {}+ years of experience; you listed {}",
    "years_met": "Asks for {}+ years of experience, within your {}",
    "place_yours": "Location: {}, one of your places",
    "place_remote": "Can be done remotely, and you are open to remote work",
    "place_other": "Location ({}) is not one of your places",
    "mode_suits": "Working pattern: {}, which suits you",
    "mode_other": "Working pattern is {}, not one you chose",
    "type_chosen": "Employment type is one you chose",
    "type_other": "Employment type is not one you chose",
    "sponsor_offered": "The posting says it offers visa sponsorship",
    "sponsor_refused": "The posting says it does not offer visa sponsorship",
    "sponsor_unclear": "The posting has conflicting wording about sponsorship",
    "sponsor_right": "The posting asks for UK right to work, which can rule out sponsored applicants",
    "sponsor_silent": "The posting does not mention sponsorship (the employer is a licensed sponsor)",
    "pay_below": "Pay tops out below your minimum ({} a year)",
    "pay_within": "Pay is within your minimum (up to {} a year)",
    "fresh_posted": "Posted in the last 7 days",
    "fresh_found": "Found in the last 7 days",
    "stale": "Possibly stale: {}",
}
