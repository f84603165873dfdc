"""Word lists and tables whose values are fixed by the results they must give."""

# Fixed values.

POSITIVE_KEYWORDS = (
    "admission",
    "admissions",
    "apply",
    "application",
    "application period",
    "deadline",
    "closing date",
    "undergraduate",
    "international",
    "international applicant",
    "requirement",
    "requirements",
    "english",
    "ielts",
    "toefl",
    "pte",
    "qualification",
    "qualifications",
    "programme",
    "programmes",
    "program",
    "programs",
    "degree",
    "prerequisite",
    "tuition",
    "fees",
    "financial",
    "scholarship",
    "scholarships",
    "visa",
    "student pass",
    "housing",
    "accommodation",
    "contact",
    "office",
    "prospectus",
    "pdf",
    "api",
)

NEGATIVE_KEYWORDS = (
    "alumni",
    "news",
    "event",
    "events",
    "donate",
    "giving",
    "media",
    "staff",
    "jobs",
    "careers",
    "blog",
    "press",
    "privacy",
    "terms",
    "cookie",
    "cookies",
    "sitemap",
)

TRACKING_QUERY_PREFIXES = (
    "utm_",
)

TRACKING_QUERY_NAMES = (
    "fbclid",
    "gclid",
    "mc_cid",
    "mc_eid",
    "igshid",
)

STATIC_RESOURCE_SUFFIXES = (
    ".css",
    ".js",
    ".mjs",
    ".ico",
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".svg",
    ".webp",
    ".avif",
    ".woff",
    ".woff2",
    ".ttf",
    ".eot",
    ".map",
)

LOW_VALUE_DOCUMENT_TERMS = (
    "privacy",
    "gdpr",
    "cookie",
    "cookies",
    "terms",
    "data protection",
    "personal information collection",
)

DISALLOWED_SOURCE_PLAN_HOST_TERMS = (
    "facebook.",
    "instagram.",
    "linkedin.",
    "twitter.",
    "x.com",
    "youtube.",
    "youtu.be",
    "tiktok.",
    "reddit.",
    "quora.",
    "medium.",
)

DISALLOWED_SOURCE_PLAN_PATH_TERMS = (
    "/redirect",
    "/redir",
    "/outbound",
    "/external",
    "/tracking",
    "/track",
)

DISALLOWED_SOURCE_PLAN_PORTAL_TERMS = (
    "/login",
    "/signin",
    "/sign-in",
    "/sso",
    "/portal",
    "/applynow",
    "/apply-now",
    "/application-system",
)

CHALLENGE_URL_TERMS = (
    "_incapsula_resource",
    "captcha",
    "access-denied",
    "access_denied",
)

CHALLENGE_TEXT_TERMS = (
    "captcha",
    "cloudflare",
    "access denied",
    "verify you are human",
    "enable javascript",
    "bot detection",
    "incapsula incident id",
)

PROGRAMME_SOURCE_PATH_HINTS = (
    "/programmes",
    "/programs",
    "/undergraduate-programmes",
    "/undergraduate-programs",
    "/undergraduate-education",
    "/degree-programmes",
    "/degree-programs",
    "/majors",
    "/minors",
    "/bulletin",
    "/catalogue",
    "/catalog",
    "/study/undergraduate",
)

UNDERGRAD_ADMISSIONS_PATH_HINTS = (
    "/admission",
    "/admissions",
    "/study/ug",
    "/undergraduate",
    "/ug/",
    "/apply",
    "/jupas",
    "/non-jupas",
    "/requirements",
    "/qualifications",
    "/fees-and-scholarships",
)

EXPLICIT_UNDERGRAD_PATH_HINTS = (
    "/study/ug",
    "/undergraduate",
    "/undergraduate-education",
    "/ug/",
    "/jupas",
    "/non-jupas",
)

NON_ADMISSIONS_PATH_HINTS = (
    "/current-students",
    "/education",
    "/research",
    "/gs/",
    "/graduate",
    "/graduates",
    "/postgraduate",
    "/postgraduates",
    "/sao/",
    "/student-affairs",
    "/hall-admission",
    "/accommodation",
    "/residential-life",
    "/life-at-ntu/accommodation",
    "/search-results",
    "/privacy",
    "/human-resources",
    "/finance-office",
    "/contact-us/form",
    "/alumni",
    "/news",
    "/giving",
    "/jobs",
    "/careers",
)

ENGLISH_REQUIREMENT_TEXT_HINTS = (
    "english language requirement",
    "english language requirements",
    "english proficiency",
    "english language proficiency",
    "minimum english",
    "ielts",
    "toefl",
    "pte academic",
    "hk dse english",
    "hkdse english",
    "cambridge c1",
    "cambridge c2",
    "c1 advanced",
    "c2 proficiency",
)

ENGLISH_FALSE_POSITIVE_HINTS = (
    "english language centre",
    "english and applied linguistics",
    "quick links",
    "current students",
    "summer programme website",
    "institute for higher education research",
)

RELEVANCE_STRATEGY_ALIASES = {
    "admissions-programme": "admissions-programme",
    "admissions_programme": "admissions-programme",
    "admissions-programme-profile": "admissions-programme",
    "admissions_programme_profile": "admissions-programme",
    "default": "admissions-programme",
    "rule-based": "rule-based",
    "rule_based": "rule-based",
    "bm25-like": "bm25-like",
    "bm25_like": "bm25-like",
}

ADMISSIONS_PROGRAMME_PATH_HINTS = (
    "/admission",
    "/admissions",
    "/apply",
    "/application",
    "/deadline",
    "/dates",
    "/requirements",
    "/requirement",
    "/qualifications",
    "/qualification",
    "/english",
    "/international",
    "/documents",
    "/fees",
    "/fee",
    "/tuition",
    "/scholarship",
    "/scholarships",
    "/financial-aid",
    "/contact",
    "/enquiry",
    "/undergraduate",
    "/study/ug",
    "/ug/",
    "/programme",
    "/program",
    "/degree",
    "/major",
    "/minor",
    "/bulletin",
    "/catalogue",
    "/catalog",
)

ADMISSIONS_PROGRAMME_TEXT_HINTS = (
    "undergraduate admissions",
    "undergraduate admission",
    "undergraduate programmes",
    "undergraduate programs",
    "degree programmes",
    "degree programs",
    "bachelor",
    "major",
    "minor",
    "application requirements",
    "entry requirements",
    "admission requirements",
    "application period",
    "application deadline",
    "closing date",
    "required documents",
    "supporting documents",
    "english language requirements",
    "english proficiency",
    "international qualifications",
    "tuition fees",
    "admissions office",
)

ADMISSIONS_PROGRAMME_NOISE_HINTS = (
    "/news",
    "/alumni",
    "/giving",
    "/donate",
    "/staff",
    "/jobs",
    "/career",
    "/careers",
    "/privacy",
    "/cookie",
    "/cookies",
    "/marketing",
    "/press",
    "/media",
    "/summer",
    "/pre-university",
    "/preuniversity",
    "/continuing-education",
    "/executive-education",
    "/professional-education",
    "/postgraduate",
    "/graduate",
)

ADMISSIONS_PROGRAMME_TEXT_NOISE_HINTS = (
    "alumni",
    "giving",
    "donate",
    "staff",
    "job vacancy",
    "career opportunities",
    "privacy notice",
    "cookie policy",
    "marketing",
    "news article",
    "press release",
    "summer school",
    "pre-university",
    "executive education",
    "continuing education",
    "postgraduate admissions",
    "graduate admissions",
)

PATH_RELEVANCE_HINTS = (
    "/admission",
    "/undergraduate",
    "/apply",
    "/programme",
    "/program",
    "/degree-program",
    "/major",
    "/minor",
    "/bulletin",
    "/catalogue",
    "/catalog",
    "/study/undergraduate",
    "/fee",
    "/scholarship",
    "/international",
    "/requirement",
    "/contact",
)

PATH_NOISE_HINTS = (
    "/news",
    "/alumni",
    "/giving",
    "/donate",
    "/staff",
    "/jobs",
    "/career",
    "/privacy",
    "/cookie",
)

KEYWORD_URL_HINTS = (
    ("admission", ("/admissions",)),
    ("admissions", ("/admissions",)),
    ("apply", ("/apply", "/admissions")),
    ("application", ("/apply", "/admissions")),
    ("undergraduate", ("/undergraduate", "/ug")),
    ("ug", ("/undergraduate", "/ug")),
    ("bachelor", ("/undergraduate", "/programmes", "/undergraduate-education", "/degree-programmes")),
    ("degree", ("/degree-programmes", "/programmes", "/undergraduate-education")),
    ("major", ("/majors", "/programmes", "/catalogue")),
    ("majors", ("/majors", "/programmes", "/catalogue")),
    ("minor", ("/minors", "/programmes", "/catalogue")),
    ("minors", ("/minors", "/programmes", "/catalogue")),
    ("bulletin", ("/bulletin",)),
    ("catalogue", ("/catalogue", "/catalog")),
    ("catalog", ("/catalog", "/catalogue")),
    ("programme", ("/programme", "/programmes", "/undergraduate-programmes", "/undergraduate-education")),
    ("program", ("/program", "/programs", "/undergraduate-programs", "/undergraduate-education")),
    ("requirement", ("/requirements",)),
    ("requirements", ("/requirements",)),
    ("international", ("/international",)),
    ("english", ("/english", "/requirements")),
    ("ielts", ("/english", "/requirements")),
    ("toefl", ("/english", "/requirements")),
    ("fee", ("/fees",)),
    ("fees", ("/fees",)),
    ("tuition", ("/fees", "/tuition")),
    ("scholarship", ("/scholarships",)),
    ("scholarships", ("/scholarships",)),
    ("contact", ("/contact",)),
)

CLASSIFIER_NEGATIVE = (
    "alumni",
    "news",
    "donate",
    "giving",
    "staff",
    "jobs",
    "blog",
)

STRONG_ADMISSIONS_SIGNALS = (
    "/admissions/",
    "/admission/",
    "undergraduate admissions",
    "admissions office",
    "admission guide",
    "international qualifications",
    "international requirements",
    "tuition fees",
    "scholarships",
    "student pass",
    "undergraduate housing",
    "undergraduate programmes",
    "undergraduate education",
)

STRONG_IRRELEVANT_PATHS = (
    "/news/",
    "/alumni/",
    "/giving/",
    "/donate",
    "/jobs",
    "/careers",
    "/staff/",
    "/blog/",
)

SITEMAP_PROBE_PATHS = (
    "/sitemap.xml",
    "/sitemap_index.xml",
)

COMMON_OFFICIAL_PATH_PROBES = (
    "/admissions",
    "/undergraduate",
    "/undergraduate-admissions",
    "/undergraduate-programmes",
    "/programmes",
    "/degree-programmes",
    "/study/undergraduate",
    "/catalogue",
    "/catalog",
    "/bulletin",
)

PORTAL_TERMS = (
    "applyto",
    "application portal",
    "applicant portal",
    "login",
    "sign in",
    "signin",
    "sso",
)

SENSITIVE_QUERY_KEYS = (
    "accesskey",
    "accesstoken",
    "apikey",
    "auth",
    "authorization",
    "csrf",
    "csrftoken",
    "jwt",
    "key",
    "nonce",
    "password",
    "secret",
    "session",
    "sig",
    "signature",
    "token",
)

CATEGORY_KEYWORDS = {
    "undergraduate_admissions": ("undergraduate admissions", "admissions", "apply", "how to apply"),
    "international_requirements": ("international requirements", "international applicants", "international", "requirements"),
    "application_deadlines": ("deadline", "deadlines", "apply by", "application period", "closing date"),
    "accepted_qualifications": ("accepted qualification", "accepted qualifications", "qualification", "a-level", "ib diploma"),
    "programme_list": ("programmes", "programs", "degrees", "degree", "undergraduate programmes", "undergraduate education", "degree programmes", "degree programs", "majors", "minors", "bulletin", "catalogue", "catalog"),
    "programme_prerequisites": ("prerequisite", "prerequisites", "required for", "requires mathematics", "mathematics required"),
    "fees": ("tuition", "fees", "fee"),
    "scholarships": ("scholarship", "scholarships", "financial aid"),
    "visa": ("visa", "student pass", "immigration"),
    "housing": ("housing", "accommodation", "residence"),
    "contact": ("contact", "email", "phone", "admissions office"),
}

CORE_FIELDS = (
    "undergraduate_application_entry",
    "application_periods",
    "english_requirements",
    "accepted_qualifications",
    "required_documents",
    "programmes",
    "fees",
    "scholarships",
    "contacts",
)

DATE_PATTERN = r"[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}(?:,\s*[0-9]{1,2}(?::[0-9]{2})?\s*(?:am|pm)?)?"

# Patterns of extractors.

FEE_PATTERN = r"(?i)((?:(?:Tuition|Fees?|International undergraduate|Domestic undergraduate|Singapore citizen|Permanent resident)[^.\n|]*?(?:USD|SGD|S\$|\$|per year|per annum|annual|semester)[^.\n]*\.?)|(?:(?:USD|SGD|S\$|\$)\s?[0-9][0-9,]*(?:\s*(?:per year|per annum|annual|semester))?))"

MONEY_PATTERN = r"(?i)(HKD|HK\$|S\$|SGD|USD|US\$|\$)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"

PROGRAMME_PATTERN = r"(?i)\b((?:Bachelor|BSc|BA|BEng|LLB|MBBS|BBA|BAcc)\s+(?:of|in)?\s*[A-Z][A-Za-z&/(),\- ]{2,90}?)(?=\s+(?:requires?|needs?|must)\b|[.;\n]|$)"

#: Response headers that may be kept.
SAFE_RESPONSE_HEADERS = (
    "cache-control",
    "content-length",
    "content-type",
    "etag",
    "last-modified",
    "link",
    "x-total-count",
)

#: Content types whose bodies may be kept.
JSON_CONTENT_TYPES = ("application/json", "application/ld+json")

#: Ids of an application's root element.
APP_ROOT_PATTERN = r"id=[\"'](?:__next|root|app|nuxt|gatsby-focus-wrapper)[\"']"

FRAMEWORK_STATE_TERMS = (
    "__next_data__",
    "window.__nuxt__",
    "ng-version",
    "data-reactroot",
    "webpackjsonp",
    "vite/client",
)

SCRIPT_PLEA_TERMS = (
    "enable javascript",
    "javascript is required",
    "you need javascript",
)

HARD_BLOCK_TERMS = (
    "_incapsula_resource",
    "incapsula incident id",
    "captcha",
    "cloudflare",
    "access denied",
    "verify you are human",
    "bot detection",
)

#: Programme catalogues: sources, candidate lines and row patterns.
CATALOG_URL_TERMS = ("programme", "program", "course", "catalog", "jupas", "study/ug")
ADMISSIONS_LONGFORM_TERMS = ("admission-guide", "international qualifications", "tuition", "fees", "scholarship", "financial", "contact-us")
CATALOG_LEVEL_TERMS = ("undergraduate", "bachelor", "bsc", "bba", "beng", "programme", "program", "degree", "major")
CATALOG_GRADUATE_TERMS = ("graduate programmes", "postgraduate", "master of", "phd", "executive education")
CATALOG_TOPIC_TERMS = ("programme", "program", "degree", "major", "undergraduate education", "undergraduate programmes")
COURSE_TABLE_HEADERS = ("course code", "course title", "major pe courses", "pre-req", "pre req", "pre-requisite", "prerequisite", "open to")
COURSE_CODE_PATTERN = r"\b[A-Z]{2,4}[0-9]{4}[A-Z]?\b"
PROSE_PATTERN = r"\b(?:applicants?|curriculum|students?|graduates?|courses?|requirements?|admissions?|designed|provides?|offers?|learn|career)\b"
LABELLED_ROW_PATTERN = r"(?i)\b(Bachelor\s+(?:of|in)\s+[A-Z][A-Za-z&/(),'+\- ]{2,120})\s+CODE\s+([A-Z0-9-]+)\s+FACULTY\s+(.+?)\s+STUDY\s+PERIOD\s+(.+?)\s+TYPE\s+(.+)$"
AWARD_LISTING_PATTERN = r"(?i)^(.+?)\s+-\s+(B(?:A|Sc|Eng|BA|BAA|BAF|BAI|FA|SW|Des|Ed)[A-Za-z() ]*(?:\s+Scheme)?)\s+-\s+(Bachelor(?:'s)?\s+(?:of\s+)?[A-Za-z() ]+(?:\s+Scheme)?)\s+([A-Z]{2}[0-9]{4}|[0-9]{5}(?:-[A-Z]+)?)?$"
FREE_NAME_PATTERNS = (
    r"\b(Bachelor\s+of\s+[A-Z][A-Za-z&/(),'\- ]{2,100})",
    r"\b(Bachelor\s+in\s+[A-Z][A-Za-z&/(),'\- ]{2,100})",
    r"\b(BSc\s*\(Hons\)\s+Major:\s*[A-Z][A-Za-z&/(),'\- ]{2,100})",
    r"\b(BBA\s+Major:\s*[A-Z][A-Za-z&/(),'\- ]{2,100})",
    r"\b((?:CHS|FASS)\s+(?:Primary\s+)?Major:\s*[A-Z][A-Za-z&/(),'\- ]{2,100})",
    r"\b(Scholars Programme)(?=\s|$|[.;,])",
    r"\b((?:NUS\s+College|Special Programme in Science(?:\s+\(SPS\))?|Engineering Scholars Programme(?:\s+\(E-Scholars\))?))(?=\s|$|[.;,])",
)
NAME_TAIL_PATTERNS = (
    r"(?i)\s+(?:CODE|FACULTY|STUDY\s+PERIOD|TYPE)\b.*$",
    r"(?i)\s+(?:Specialisations?|Majors)\b.*$",
    r"(?i)\s+(?:requires?|needs?|must|is offered|are offered|leads to|programmes are)\b.*$",
    r"(?i)\s+(?:full-time|part-time|four-year|three-year|160 units?|at least).*$",
    r"(?i)\s+within\b.*$",
)
DEGREE_WORDS_PATTERN = r"\b(?:bsc|ba|beng|bba|llb|mbbs)\b"
CONTEXT_AWARD_PATTERN = r"\b(Bachelor\s+of\s+[A-Z][A-Za-z&/(),'\- ]{2,100})"
AWARD_PATTERN = r"(?i)\b(?:Bachelor|BSc|BA|BEng|BBA|LLB|MBBS|Honours|Hons)\b"
FACULTY_PATTERN = r"(?i)\b(?:faculty|school|college|academy|institute|department|centre|center)\b"
SUBJECT_PATTERN = r"\b(?:accountancy|architecture|arts?|business|computing|communication|design|economics|education|engineering|humanities|law|medicine|psychology|science|sociology)\b"
NAME_CELL_NOT = ("programme", "program", "degree", "degree title", "award", "all", "filter")
NAME_CELL_NOT_TERMS = ("programme level", "programme type", "select a", "view all", "read more")
CHOICE_TERMS = ("engineering", "business administration", "humanities", "common computer", "nus college")
CHOICE_PATTERN = r"(?i)(?:admissions? choice|choice|pathway)[:\s]+([A-Z][A-Za-z&/(),'\- ]{2,80})"
DURATION_PATTERN = r"(?i)((?:three|four|five|six|[0-9]+)[- ]year[^.;|]*|(?:at least\s+)?[0-9]{2,3}\s+units?[^.;|]*)"
DURATION_CUT_PATTERN = r"(?i)(?:,\s*(?:full-time|part-time)|\s+(?:full-time|part-time)\b).*$"
SPECIALISATION_PATTERN = r"(?i)(?:including|majors? including|majors?[:\s]+|specialisations?[:\s]+)([A-Z][^.]+)"
FACULTY_HINTS = (
    ("NUS Business School", ("business school", "school-of-business")),
    ("School of Computing", ("school of computing", "school-of-computing")),
    ("College of Design and Engineering", ("college of design and engineering", "design and engineering", "college-of-design-and-engineering")),
    ("College of Humanities and Sciences", ("college of humanities and sciences", "chs.nus.edu.sg")),
    ("Faculty of Science", ("faculty of science", "faculty-of-science")),
)
CATALOG_CSV_FIELDS = (
    "university_id",
    "university_name",
    "programme_id",
    "name",
    "faculty_or_school",
    "degree_or_award",
    "category",
    "mode",
    "duration_or_units",
    "admissions_choice_name",
    "specialisations_or_majors",
    "source_url",
    "source_title",
    "evidence_snippet",
    "evidence_confidence",
    "parse_status",
    "warnings",
    "retrieved_at",
)
ROW_WARNINGS = {
    "duplicate_name": "Duplicate programme normalized key retained for manual review.",
    "ambiguous_degree": "Programme row does not expose a stable degree or award.",
    "missing_faculty": "Programme row does not expose a faculty or school.",
    "category_inferred": "Programme category was inferred from row text rather than an explicit catalogue type.",
    "raw_needs_manual_review": "Programme catalog row could not be fully normalised; review category/award context.",
}
API_ROW_WARNINGS = {
    "ambiguous_degree": "API programme row does not expose a stable degree or award.",
    "missing_faculty": "API programme row does not expose a faculty or school.",
    "raw_needs_manual_review": "API programme row could not be fully normalised.",
}

#: JSON catalogues: key aliases and terms.
API_NAME_KEYS = ("name", "title", "programme", "program", "programmeName", "programName", "courseTitle", "degreeTitle")
API_DEGREE_KEYS = ("degree", "award", "qualification", "degreeTitle", "awardName", "degree_or_award")
API_FACULTY_KEYS = ("faculty", "school", "college", "department", "schoolName", "facultyOrSchool", "faculty_or_school")
API_MODE_KEYS = ("mode", "studyMode", "attendance", "fullTimePartTime")
API_DURATION_KEYS = ("duration", "studyPeriod", "durationOrUnits", "units", "credits")
API_CHOICE_KEYS = ("choice", "admissionChoice", "admissionsChoice", "jupasCode", "applicationCode", "code")
API_SPECIALISATION_KEYS = ("specialisations", "specializations", "majors", "specialisationsOrMajors", "specializationsOrMajors")
API_FILTER_METADATA_KEYS = ("level", "programmetype", "studytype", "studymode", "mode", "faculty", "school", "college", "department", "degree", "award", "category")
API_FILTER_CONTAINERS = ("filters", "facets", "filteroptions", "filtermetadata", "searchfilters")
API_TOTAL_KEYS = ("total", "count", "totalcount", "recordstotal")
API_NOT_NAMES = ("all", "any", "undergraduate", "programme", "program", "degree", "filter", "search")
API_NOT_NAME_TERMS = ("select ", "view all", "read more", "find out", "apply now")
API_NAVIGATION_NAMES = ("full-time", "part-time", "undergraduate", "postgraduate", "degree programme")
API_NAVIGATION_TERMS = ("filteroption", "filter option", "navigation", "breadcrumb", "facet")
API_SIGNAL_PATTERN = r"\b(?:undergraduate|bachelor|bsc|ba|beng|bba|llb|mbbs|degree|major|minor|programme|program|course)\b"
API_VOCABULARY_PATTERN = r"\b(?:undergraduate|bachelor|bsc|ba|beng|bba|llb|mbbs|degree|programme|program|major|minor|faculty|school)\b"
API_NAME_TAIL_PATTERN = r"(?i)\s+(?:requires?|needs?|must|is offered|are offered|leads to)\b.*$"
API_AWARD_PATTERN = r"(?i)\b(?:Bachelor|BSc|BA|BEng|BBA|LLB|MBBS)\b"
API_DEGREE_PATTERN = r"\b(?:bachelor|bsc|ba|beng|bba|llb|mbbs|degree)\b"

#: Claims in JSON answers: fields with their key aliases.
API_CLAIM_KEYS = {
    "programmes": ("programme", "program", "programName", "programmeName", "title", "name"),
    "application_periods": ("deadline", "applicationDeadline", "closingDate", "closing_date", "applyBy", "apply_by"),
    "fees": ("fee", "fees", "tuition", "tuitionFee", "tuition_fee"),
    "required_documents": ("requiredDocuments", "required_documents", "documents", "document"),
}
API_PROGRAMME_PATTERN = r"(?i)\b(?:Bachelor|BSc|BA|BEng|LLB|MBBS|Programme|Program|Major)\b"

#: Filters of catalogue endpoints.
FILTER_DIMENSIONS = {
    "level": ("level", "studylevel", "programmelevel", "programlevel"),
    "programme_type": ("programmetype", "programtype", "programmetypes", "programtypes", "type", "awardtype"),
    "study_mode": ("studymode", "mode", "attendance", "attendancepattern"),
    "faculty_or_school": ("faculty", "facultyid", "facultycode", "school", "schoolid", "schoolcode", "college", "department"),
}
FILTER_QUERY_KEYS = {"level": "level", "programme_type": "programmeType", "study_mode": "studyMode", "faculty_or_school": "faculty"}
FILTER_CONTAINERS = ("facet", "facets", "filter", "filters", "filteroption", "filteroptions", "searchfacet", "searchfacets", "searchfilter", "searchfilters")
FILTER_TARGETS = {
    "level": ("undergraduate", "undergrad", "ug"),
    "programme_type": ("degree", "degreeprogramme", "degreeprogram", "bachelor", "undergraduatedegree"),
    "study_mode": ("fulltime", "full-time", "full time"),
}

#: Catalogue pages whose rows a script would load.
DYNAMIC_FILTER_TERMS = ("programme level", "programme type", "study mode", "full-time", "part-time", "filter", "all")
DYNAMIC_LEVEL_TERMS = ("undergraduate", "programme", "program", "degree")
DYNAMIC_ROW_PATTERNS = (
    r"(?i)\bprogramme\s*\|\s*(?:degree|award|title)\b",
    r"(?i)\b(?:Bachelor\s+of|Bachelor\s+in|BSc|BA|BEng|BBA|LLB|MBBS)\b.{0,80}\b(?:degree|honours|hons|faculty|school)\b",
)

#: English requirements: triggers, tests, and how scores are phrased ({t} is a test's first word, {q} a qualifier and {n}
#: a number).
ENGLISH_TRIGGER_PATTERN = r"\b(?:english language requirements?|english proficiency|english language proficiency|ielts|toefl|pte academic|hkdse english|hk dse english|cambridge c1|cambridge c2|c1 advanced|c2 proficiency)\b"
ENGLISH_TESTS = (
    ("IELTS", r"\bIELTS\b"),
    ("TOEFL iBT", r"\bTOEFL(?:\s+iBT)?\b"),
    ("PTE Academic", r"\bPTE\s+Academic\b|\bPTE\b"),
    ("HKDSE English", r"\bHKDSE\s+English\b|\bHK\s*DSE\s+English\b"),
    ("Cambridge English", r"\bCambridge\b|\bC1\s+Advanced\b|\bC2\s+Proficiency\b|\bCAE\b"),
    ("SAT", r"\bSAT\b"),
    ("ACT", r"\bACT\b"),
    ("MUET", r"\bMUET\b"),
)
ENGLISH_MENTION_PATTERN = r"\b(?:IELTS|TOEFL(?:\s+iBT)?|PTE\s+Academic|SAT|ACT|MUET|C1\s+Advanced|C2\s+Proficiency|Cambridge English Advanced|CAE)\b"
ENGLISH_NUMBER = r"([0-9]{1,4}(?:\.[0-9])?)"
ENGLISH_QUALIFIER = r"(?:overall\s+band\s+of|overall\s+score\s+of|overall\s+of|overall|minimum\s+of\s+overall|minimum\s+overall\s+score\s+of|minimum\s+overall\s+of|minimum\s+overall|minimum\s+of\s+composite\s+score\s+of|minimum\s+composite\s+score\s+of|composite\s+score\s+of|minimum\s+of|at\s+least|minimum)"
ENGLISH_SCORE_PATTERNS = (
    r"{q}\s+{n}\s*(?:in|for)?\s*(?:the\s+)?{t}\b",
    r"{q}\s+{n}\b[^;|]{0,100}?{t}\b",
    r"(?:at\s+least|minimum(?:\s+of)?)\s+{n}\s+(?:overall|score)",
    r"{t}\b[^.;|]{0,120}?{q}\s*{n}",
    r"{t}\b\s*{n}\s*(?:overall|minimum|score|band)?",
    r"{t}\b\s*\([^)]*?(?:overall|minimum(?:\s+of)?|at\s+least|composite\s+score\s+of)\s*{n}",
)
ENGLISH_COMPONENTS = ("writing", "speaking", "reading", "listening", "verbal")
ENGLISH_COMPONENT_PATTERN = r"\b{c}\s*(?:score\s*)?(?:of\s*)?([0-9]{1,4}(?:\.[0-9])?|[A-E][0-9]?)\b"
ENGLISH_SUBTEST_PATTERN = r"\b(?:no\s+)?(?:subtest|component)\s+(?:below|less\s+than|under|at\s+least)\s*([0-9]{1,4}(?:\.[0-9])?)"
ENGLISH_SCORE_TERMS = ("at least", "minimum", "overall", "score", "band", "writing", "speaking", "reading", "listening", "verbal")
ENGLISH_EXEMPTION_TERMS = ("exempt", "exemption", "waiver", "waived")
ENGLISH_EXEMPTION_SUBJECTS = ("english", "ielts", "toefl", "pte", "medium of instruction")
ENGLISH_HARD_FALSE_TERMS = ("english language centre", "english and applied linguistics", "quick links", "current students", "summer programme website")
ENGLISH_SAFE_TEXT = r"(?:[0-9]\.[0-9]|[^.\n])"
ENGLISH_SNIPPET_PATTERNS = (
    r"(?:English language requirements?|English proficiency|English language proficiency){s}{0,260}(?:IELTS|TOEFL|PTE|HKDSE|HK DSE|Cambridge|minimum|required|requirement|qualification|exempt|waiver){s}{0,260}\.?",
    r"(?:IELTS|TOEFL|PTE Academic|HKDSE English|HK DSE English|C1 Advanced|C2 Proficiency|Cambridge C1|Cambridge C2){s}{0,220}(?:[0-9]{1,3}(?:\.[0-9])?|minimum|required|requirement|qualification|exempt|waiver){s}{0,220}\.?",
)
QUALIFICATION_PATTERNS = (
    r"(?i)((?:Accepted qualifications?|Qualifications? accepted)[^.]*\.)",
    r"(?i)((?:A-level|IB Diploma|International Baccalaureate)[^.]*accepted[^.]*\.)",
)

#: Paths that a suggested fact may fill, and the terms of programme catalogues around them.
SUGGESTED_CLAIM_PATHS = (
    "admissions.application_period",
    "admissions.application_deadline",
    "admissions.application_entry",
    "admissions.requirements.academic",
    "admissions.requirements.english",
    "admissions.required_documents",
    "admissions.fees",
    "admissions.scholarships",
    "admissions.contact",
    "programme_catalog[].name",
    "programme_catalog[].degree",
    "programme_catalog[].faculty_or_school",
    "programme_catalog[].duration",
    "programme_catalog[].entry_requirements",
    "programme_catalog[].source_url",
)
SUGGESTED_CONFIDENCE = 0.2
CATALOG_CONTEXT_NOT = ("postgraduate", "graduate research", "phd", "master of")
CATALOG_CONTEXT = ("undergraduate programme", "undergraduate program", "bachelor", "degree programme", "degree program", "major", "minor", "catalogue", "catalog")

#: Fees in tables: where to look for them, and headings that stand for them.
FEE_TABLE_NOT = ("/graduate", "/postgraduate", "postgraduate", "graduate tuition", "/hall-admission", "/sao/", "residential life")
FEE_TABLE_PATTERNS = (
    r"(?i)Tuition Fees For Semester 1 and 2(?:\s+Accepted programme offer in [0-9]{4})?",
    r"(?i)Tuition fees payable for AY[0-9]{4}\s*[-–]\s*[0-9]{2,4}",
    r"(?i)Tuition Fees payable per academic unit[^.]{0,180}",
)
FEE_NUMBER_PATTERN = r"(?i)(?:HKD|HK\$|S\$|SGD|USD|US\$|\$)\s*[0-9]"
PREREQUISITE_PATTERNS = (r"(?i)(Mathematics required[^.]*\.)", r"(?i)(requires Mathematics[^.]*\.)")

#: What a fee's table cell or sentence says of it, and where cells and sentences end.
FEE_YEAR_PATTERN = r"(?i)\b(?:AY|academic year)\s*([0-9]{4}\s*[/\\-]\s*[0-9]{2,4})\b"
COHORT_PATTERN = r"(?i)\(([0-9]{4}\s*-\s*[0-9]{2,4}\s+cohort)\)"
FEE_ROW_MARKS = r"\.|\|| Left Column | Middle Column | Right Column "

#: What each core field comes from: categories, gates, extractors and suggested paths; lists with commas between.
FIELD_CAPABILITIES = (
    ("undergraduate_application_entry", "/admissions/undergraduate_application_entry", "undergraduate_admissions", "requires_application_period", "source_url_from_application_period", "admissions.application_entry"),
    ("application_periods", "/admissions/application_periods", "undergraduate_admissions,application_deadlines", "", "extract_deadline", "admissions.application_period,admissions.application_deadline"),
    ("english_requirements", "/admissions/english_requirements", "international_requirements", "has_english_requirement_context,has_undergraduate_admissions_context", "extract_english_requirement", "admissions.requirements.english"),
    ("accepted_qualifications", "/admissions/accepted_qualifications", "accepted_qualifications,international_requirements,programme_prerequisites", "", "extract_accepted_qualification,extract_prerequisite", "admissions.requirements.academic"),
    ("required_documents", "/admissions/required_documents", "undergraduate_admissions", "", "extract_required_document", "admissions.required_documents"),
    ("programmes", "/programmes", "programme_list,programme_prerequisites", "has_undergraduate_admissions_context", "extract_programmes,extract_programme", ""),
    ("fees", "/fees", "fees", "has_undergraduate_fee_context,has_undergraduate_admissions_context", "extract_fee", "admissions.fees"),
    ("scholarships", "/scholarships", "scholarships", "has_undergraduate_scholarship_context,has_undergraduate_admissions_context", "extract_scholarship", "admissions.scholarships"),
    ("contacts", "/contacts", "contact", "has_admissions_contact_context,has_undergraduate_admissions_context", "extract_contact", "admissions.contact"),
)

#: Context gates, portals and page categories: the terms of each test.
ADMISSIONS_TOPIC_PATHS = ("/admission", "/admissions", "/apply", "/requirements", "/qualifications", "/fees-and-scholarships")
UNDERGRADUATE_LEVEL_TERMS = ("undergraduate", "jupas", "non-jupas", "bachelor", "freshmen", "freshman")
FEE_CONTEXT_NOT = ("hall fee", "hall fees", "phd fellowship", "graduate tuition", "postgraduate", "residential life", "/graduate", "/postgraduate", "/current-students", "/sao/", "/hall-admission")
FEE_CONTEXT_TERMS = ("tuition", "application fee", "fees", "fee")
SCHOLARSHIP_CONTEXT_NOT = ("phd fellowship", "graduate school", "postgraduate", "research postgraduate")
SCHOLARSHIP_CONTEXT_TERMS = ("scholarship", "financial aid")
CONTACT_CONTEXT_NOT = ("privacy", "personal information collection statement", "data access and correction", "/contact-us/form")
CONTACT_CONTEXT_TERMS = ("admissions office", "admission matters", "admissions matters", "contact us", "enquiry", "enquiries")
PORTAL_TEXT_TERMS = ("please log in", "sign in to")
NEWS_EXCEPTION_TERMS = ("admission", "undergraduate", "scholarship")
ADMISSIONS_PAGE_TERMS = ("undergraduate admissions", "admissions office")
CONTEXTUAL_IRRELEVANT_TERMS = ("/current-students", "/education", "/research", "/gs/", "/graduate", "/postgraduate", "/sao/", "/student-affairs", "/hall-admission", "/accommodation", "/search-results", "/contact-us/form")
ADMISSIONS_SCORE_PATHS = ("/admission", "/undergraduate", "/apply", "/programme", "/program", "/fee", "/scholarship", "/international", "/requirement", "/contact")
PDF_SCORE_TERMS = ("admission", "programme", "requirement", "prospectus")

#: HTML that isn't content: tags, and what names furniture in attributes.
DROPPED_TAGS = ("script", "style", "noscript", "svg", "canvas", "iframe", "nav", "header", "footer", "aside")
NOISE_ATTRIBUTE_PATTERN = "breadcrumb|cookie|consent|banner|global|nav|menu|mega|header|footer|sidebar|social|share|skip|search|modal|popup|toolbar|utility"
