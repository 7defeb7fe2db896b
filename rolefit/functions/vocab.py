"""Word lists, rank tables, weights and sentence texts.

Everything in this file is a fixed value: results depend on these exact
words, orders and numbers. The order inside each list matters.
"""

from __future__ import annotations

from html.entities import html5

# --- fixed values: ordinal ranks -------------------------------------------

EDUCATION_RANK = {
    "high_school": 1,
    "associate": 2,
    "bachelor": 3,
    "master": 4,
    "phd": 5,
}

# Job seniority may be "junior"; a parsed candidate's never is.
SENIORITY_RANK = {
    "intern": 1,
    "entry": 2,
    "junior": 2,
    "mid": 3,
    "senior": 4,
    "manager": 5,
}

CANDIDATE_SENIORITY_RANK = {
    "intern": 1,
    "entry": 2,
    "mid": 3,
    "senior": 4,
    "manager": 5,
}

# --- fixed values: score weights, caps, labels ------------------------------

WEIGHTS = {
    "required_skill_score": 0.38,
    "preferred_skill_score": 0.12,
    "experience_score": 0.20,
    "education_score": 0.08,
    "seniority_score": 0.12,
    "domain_score": 0.10,
}
CAP_NO_REQUIRED = 45.0
CAP_FEW_REQUIRED = 60.0
FIT_LABELS = [(85, "Strong Fit"), (70, "Good Fit"), (50, "Partial Fit")]
LOWEST_FIT_LABEL = "Weak Fit"

# --- fixed values: skill taxonomy -------------------------------------------

SKILL_ALIASES = {
    "python": ["python"],
    "sql": ["sql", "mysql", "postgresql", "postgres", "tsql"],
    "machine_learning": ["machine learning", "ml"],
    "deep_learning": ["deep learning", "neural networks", "pytorch", "tensorflow", "keras"],
    "data_analysis": ["data analysis", "data analytics", "analytics"],
    "pandas": ["pandas"],
    "numpy": ["numpy"],
    "scikit_learn": ["scikit-learn", "sklearn"],
    "spark": ["spark", "pyspark"],
    "aws": ["aws", "amazon web services"],
    "azure": ["azure"],
    "gcp": ["gcp", "google cloud"],
    "docker": ["docker"],
    "kubernetes": ["kubernetes", "k8s"],
    "fastapi": ["fastapi"],
    "flask": ["flask"],
    "streamlit": ["streamlit"],
    "tableau": ["tableau"],
    "power_bi": ["power bi", "powerbi"],
    "excel": ["excel"],
    "git": ["git"],
    "linux": ["linux"],
    "airflow": ["airflow"],
    "dbt": ["dbt"],
    "hadoop": ["hadoop"],
    "communication": ["communication", "verbal communication", "written communication"],
    "leadership": ["leadership"],
    "statistics": ["statistics", "statistical analysis"],
    "nlp": ["nlp", "natural language processing"],
    "llm": ["llm", "large language model", "large language models", "gpt", "llama"],
    "data_engineering": ["data engineering", "data pipeline", "etl", "elt"],
    "mlops": ["mlops", "model deployment", "model serving"],
    "api": ["api", "rest api"],
    "sales": ["sales", "selling", "sales cycle"],
    "negotiation": ["negotiation", "negotiating", "negotiations"],
    "crm": ["crm", "salesforce"],
    "strategy": ["strategy", "strategic"],
    "ai": ["ai", "artificial intelligence"],
    "enterprise": ["enterprise"],
    "presentation": ["presentation", "presentation skills"],
}

# --- fixed values: hints around a skill, section headings -------------------

REQUIRED_HINTS = [
    "required", "must have", "must-have", "need to have", "needs to have",
    "minimum qualifications", "basic qualifications", "you have",
    "qualification", "qualifications", "requirements", "minimum requirements",
]
PREFERRED_HINTS = [
    "preferred", "nice to have", "nice-to-have", "bonus", "plus",
    "preferred qualifications", "desired", "good to have",
]
NEGATION_HINTS = ["not required", "no experience required", "optional"]
CONTEXT_CHARS = 120

REQUIREMENT_HEADINGS = [
    "minimum requirements", "requirements", "minimum qualifications", "qualifications",
]
PREFERRED_HEADINGS = ["preferred qualifications", "preferred", "nice to have", "nice-to-have"]

# --- fixed values: titles ----------------------------------------------------

TITLE_SENIORITY = {
    "intern": ["intern", "internship"],
    "junior": ["junior", "entry level", "jr"],
    "mid": ["mid", "mid level"],
    "senior": ["senior", "sr", "staff", "lead", "principal"],
    "manager": ["manager", "director", "head of", "vp", "vice president"],
}

# (canonical title, job family, phrases)
TITLE_RULES = [
    ("data_scientist", "data_science", ["data scientist"]),
    ("machine_learning_engineer", "machine_learning",
     ["machine learning engineer", "ml engineer", "ai engineer"]),
    ("data_analyst", "analytics",
     ["data analyst", "business analyst", "bi analyst", "business intelligence analyst"]),
    ("data_engineer", "data_engineering", ["data engineer", "analytics engineer"]),
    ("software_engineer", "software_engineering",
     ["software engineer", "backend engineer", "frontend engineer",
      "full stack engineer", "fullstack engineer"]),
    ("account_executive", "sales", ["account executive"]),
    ("product_manager", "product", ["product manager"]),
]

JOB_FUNCTION_BY_FAMILY = {
    "data_science": "data",
    "machine_learning": "data",
    "analytics": "data",
    "data_engineering": "data",
    "software_engineering": "engineering",
    "sales": "go_to_market",
    "product": "product",
}

# --- fixed values: locations -------------------------------------------------

COUNTRY_KEYWORDS = [
    ("united states", "united states"),
    ("usa", "united states"),
    ("u.s.", "united states"),
    ("canada", "canada"),
    ("france", "france"),
    ("japan", "japan"),
    ("brazil", "brazil"),
    ("ireland", "ireland"),
    ("united kingdom", "united kingdom"),
    ("uk", "united kingdom"),
    ("england", "united kingdom"),
    ("india", "india"),
    ("singapore", "singapore"),
    ("germany", "germany"),
]

REGION_BY_COUNTRY = {
    "united states": "north_america",
    "canada": "north_america",
    "france": "europe",
    "japan": "asia",
    "brazil": "south_america",
    "ireland": "europe",
    "united kingdom": "europe",
    "india": "asia",
    "singapore": "asia",
    "germany": "europe",
}

LOCATION_REPLACEMENTS = {
    "remote - united states": "remote, united states",
    "remote - canada": "remote, canada",
    "new york ny": "new york, ny",
    "san francisco ca": "san francisco, ca",
}

# --- fixed values: education phrases in job text -----------------------------

EDUCATION_PHRASES = {
    "high_school": ["high school diploma", "secondary school"],
    "associate": ["associate degree", "associate's degree"],
    "bachelor": ["bachelor degree", "bachelor's degree", "bs degree", "ba degree", "b.sc", "bsc"],
    "master": ["master degree", "master's degree", "ms degree", "m.sc", "msc", "mba"],
    "phd": ["phd", "ph.d", "doctorate", "doctoral degree"],
}
# Those that only count as whole words.
EDUCATION_WORDS = ["bsc", "msc", "mba", "phd"]

# --- fixed values: candidate wording -----------------------------------------

CANDIDATE_EDUCATION = {
    "high school": "high_school",
    "high_school": "high_school",
    "secondary": "high_school",
    "associate": "associate",
    "associate degree": "associate",
    "bachelor": "bachelor",
    "bachelors": "bachelor",
    "bachelor's": "bachelor",
    "bs": "bachelor",
    "ba": "bachelor",
    "bsc": "bachelor",
    "master": "master",
    "masters": "master",
    "master's": "master",
    "ms": "master",
    "msc": "master",
    "mba": "master",
    "phd": "phd",
    "ph.d": "phd",
    "doctorate": "phd",
}

CANDIDATE_SENIORITY = {
    "intern": "intern",
    "junior": "entry",
    "entry": "entry",
    "entry-level": "entry",
    "entry level": "entry",
    "mid": "mid",
    "mid-level": "mid",
    "mid level": "mid",
    "senior": "senior",
    "lead": "senior",
    "staff": "senior",
    "manager": "manager",
    "director": "manager",
    "principal": "manager",
    "head": "manager",
    "vp": "manager",
}
DEFAULT_CANDIDATE_ID = "candidate_001"
DEFAULT_MIN_SCORE = 50

# --- fixed values: HTML entities ---------------------------------------------

# The names that are common in postings; all others come from the standard library's table.
_COMMON_ENTITIES = ["amp", "lt", "gt", "quot", "apos", "nbsp", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo",
                    "bull", "middot", "hellip", "euro", "copy", "reg", "trade"]
HTML_ENTITIES = {name: html5[name + ";"] for name in _COMMON_ENTITIES}
RARE_HTML_ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and name[:-1] not in HTML_ENTITIES}
OPEN_HTML_ENTITIES = {name: text for name, text in html5.items() if not name.endswith(";")}
# Numbers 128 to 159 mean the characters of Windows-1252 at those places.
C1_CHARACTERS = {n: ord(text) for n in range(0x80, 0xA0) if (text := bytes([n]).decode("cp1252", "ignore"))}

# --- fixed values: explanation sentences --------------------------------------

SENTENCES = {
    "req_all": "Candidate matches all required skills.",
    "req_all_point": "Strong required-skill alignment.",
    "req_some": "Candidate matches {matched} out of {total} required skills.",
    "req_gap": "Missing required skills: {missing}",
    "req_some_advice": "Highlight or develop missing required skills: {missing}.",
    "req_some_point": "Partial required-skill alignment.",
    "req_few_advice": "Prioritize these required skills before applying: {missing}.",
    "req_few_point": "Weak required-skill alignment.",
    "req_none": "No explicit required skills were listed for this job.",
    "req_none_point": "No required-skill blocker detected.",
    "pref_all": "Candidate matches all preferred skills.",
    "pref_all_point": "Strong preferred-skill alignment.",
    "pref_some": "Candidate matches preferred skills: {matched}.",
    "pref_some_advice": "Strengthen preferred skills: {missing}.",
    "pref_few_advice": "Consider building preferred skills: {missing}.",
    "pref_none": "No preferred skills were listed for this job.",
    "dom_match": "Candidate domain background matches job domain(s): {matched}.",
    "dom_match_point": "Relevant domain alignment.",
    "dom_gap": "Candidate does not show direct domain alignment with: {missing}.",
    "dom_advice": "Add projects or experience related to: {missing}.",
    "dom_none": "No specific job domain was listed.",
    "exp_unknown_gap": "Candidate experience is not specified.",
    "exp_unknown_advice": "Add clear years of experience to the candidate profile.",
    "exp_met": "Candidate meets the experience requirement ({have} years vs required {need}).",
    "exp_met_point": "Experience requirement met.",
    "exp_gap": "Experience gap: candidate has {have} years vs required {need}.",
    "exp_small": "Experience gap is small; strengthen the application with strong project evidence.",
    "exp_medium": "Target similar roles with slightly lower experience requirements "
                  "or emphasize advanced project work.",
    "exp_large": "Consider roles with lower experience requirements before applying to this role.",
    "exp_none": "No explicit experience requirement was found.",
    "edu_given": "Candidate education is provided ({have}).",
    "edu_gap": "Education requirement exists but candidate education is missing.",
    "edu_advice": "Add education details to the candidate profile.",
    "edu_none": "No explicit education requirement was found.",
    "sen_match": "Candidate seniority aligns with the role ({need}).",
    "sen_match_point": "Seniority alignment.",
    "sen_differs": "Review seniority fit: job expects {need}, candidate profile shows {have}.",
    "sen_unknown": "Add candidate seniority level for better matching.",
    "sen_none": "No explicit seniority requirement was found.",
    "summary_strong": "Candidate is a strong match for the main job requirements.",
    "summary_required": "Candidate has important required-skill gaps for this role.",
    "summary_partial": "Candidate is a partial match with some improvement areas.",
    "advice_default": "Candidate profile aligns well with the main job requirements.",
}
