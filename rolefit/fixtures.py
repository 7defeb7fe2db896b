"""Postings, candidates and preferences derived from the given tables.

Every row of a given table becomes a row here, computed from its own columns:
``part`` gives match-ready jobs, ``customer`` gives candidate payloads, ``pages``
the rows of feed A and ``documents`` those of feed B, whole texts included.
``orders`` with ``lineitem`` say which customer asks about which part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolefit.functions import text as X
from rolefit.functions import vocab
from rolefit.session import spread

SKILLS = [
    "python", "sql", "machine_learning", "deep_learning", "data_analysis", "pandas", "numpy", "spark", "aws", "azure",
    "docker", "kubernetes", "fastapi", "tableau", "power_bi", "excel", "git", "linux", "airflow", "statistics", "nlp",
    "communication", "leadership", "sales",
]
ALIASES = [alias for aliases in vocab.SKILL_ALIASES.values() for alias in aliases]
JOB_EDUCATION = [None, "high_school", "associate", "bachelor", "master", "phd", "master in cs"]
JOB_SENIORITY = [None, "intern", "entry", "junior", "mid", "senior", "manager", "principal"]
DOMAINS = ["ai", "analytics", "finance", "retail", "health"]
TITLES = [
    "Senior Data Scientist", "ML Engineer", "Machine Learning Engineer II", "AI Engineer (m/f/d)",
    "Junior Data Analyst", "Business  Analyst", "BI Analyst", "Business Intelligence Analyst, Lead",
    "Data Engineer", "Analytics Engineer - Mid Level", "Staff Software Engineer", "Backend Engineer",
    "Frontend Engineer", "Full Stack Engineer", "Fullstack Engineer", "Account Executive, Sr.",
    "Product Manager", "Chef de Partie!", "Internal Auditor", "Engineering Intern",
    "Principal Engineer", "Jr. Developer", "Entry Level Clerk", "Director of Sales", "Head of People",
    "Vice President, Growth", "VP Finance", "Café & Bar Lead", "Data\tScientist", "Internship Program",
    "Midwife",
]
LOCATIONS = [
    "Remote - United States", "Remote - Canada", "New York N.Y.", "San Francisco CA", "Paris, France",
    "Tokyo,  Japan", "Sao Paulo, Brazil", "Dublin, Ireland", "London, United Kingdom", "Leeds, UK",
    "York, England", "Pune, India", "Singapore", "Berlin, Germany", "Austin, USA", "Boston, U.S.",
    "Toronto, Canada", "Milwaukee, WI", "", "Remote",
]
WORKPLACES = ["remote", "hybrid", "onsite", ""]
EDUCATION_PHRASES = [
    "Bachelor's degree", "Master's degree or PhD", "High school diploma", "Associate degree",
    "Bachelor's or Master's degree", "MBA preferred", "Doctorate", "B.Sc in any field", "",
]
YEARS_PHRASES = [" years of experience", "+ years in sales", " yrs", "-9 years", " to 12 years", " projects",
                 " or ١٢ years of experience", "99999999999999999999 years of experience"]
CANDIDATE_EDUCATION = ["Bachelor's", "Master in CS", "phd", "  MBA ", "high school", "associate degree",
                       None, "BSc"]
CANDIDATE_SENIORITY = [None, "Junior", "mid-level", "Lead", "director", "", "wizard"]
PROJECTS = ["Churn Model", "ETL  rebuild", "dashboard"]
# fixed values: character references and their text
REFERENCES = {
    "&rarr;": "→", "&Omega;": "Ω", "a&ensp;b": "a b", "&#00000065;": "A", "&#x0000041;": "A", "&copy 2020": "© 2020",
    "R&ampD": "R&D", "&nosuch;": "&nosuch;", "&#150;": "–", "<i title='a>b'>x</i>": "x", "&NotEqualTilde;": "≂̸",
}
SKILL_STEPS = [(7, 0), (11, 5), (13, 10), (5, 15)]
TOOL_STEPS = [(19, 20), (23, 7)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, e: Column) -> Column:
    """Element ``e mod n`` of a literal list."""
    return F.element_at(X.literal_array(values), (e % len(values) + 1).cast("int"))


def first(items: list[Column], n: Column) -> Column:
    return F.slice(F.array(*items), 1, n.cast("int"))


def sorted_distinct(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


# --- match-ready jobs and candidate payloads -------------------------------------------

def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.concat(F.lit("fx::"), k % 5, F.lit("::"), k).alias("job_id"),
        k.alias("ord"),
        pick(TITLES, k).alias("title"),
        F.lower("p_brand").alias("company"),
        pick(LOCATIONS, 7 * k + 3).alias("location"),
        pick(WORKPLACES, k).alias("workplace_type"),
        sorted_distinct(first([pick(DOMAINS, k), pick(DOMAINS, k + 2)], k % 3)).alias("domains"),
        sorted_distinct(first([pick(SKILLS, 31 * k + i) for i in (1, 12, 18, 23)], k % 5))
        .alias("required_skills"),
        sorted_distinct(first([pick(SKILLS, 17 * k + i) for i in (3, 9)], k % 3))
        .alias("preferred_skills"),
        F.when(k % 97 == 0, 1234567).when(F.col("p_size") % 7 != 0, F.col("p_size") % 13).cast("bigint")
        .alias("years_experience_required"),
        pick(JOB_EDUCATION, k).alias("education_required"),
        pick(JOB_SENIORITY, 3 * k + 1).alias("seniority"),
    )


def candidate_id(key: Column) -> Column:
    return F.concat(F.lit("cand_"), key)


def job_id(key: Column) -> Column:
    return F.concat(F.lit("fx::"), key % 5, F.lit("::"), key)


def candidate_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    skills = [pick(SKILLS, m * c + i) for m, i in SKILL_STEPS]
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        candidate_id(c).alias("candidate_id"),
        F.col("c_name").alias("full_name"),
        pick(TITLES, 5 * c + 2).alias("current_title"),
        pick(LOCATIONS, c).alias("location"),
        pick(CANDIDATE_EDUCATION, c).alias("education"),
        F.when(c % 89 == 0, 2345678).otherwise(c % 16).cast("int").alias("years_experience"),
        F.array(F.concat(F.lit("  "), F.upper(skills[0])), *skills[1:], F.lit(" ")).alias("skills"),
        F.array(*[pick(SKILLS, m * c + i) for m, i in TOOL_STEPS]).alias("tools"),
        first([pick(DOMAINS, c), pick(DOMAINS, c + 1)], c % 3).alias("domains"),
        first([F.lit("Scrum  Master")], c % 2).alias("certifications"),
        first([pick(PROJECTS, c), pick(PROJECTS, c + 1)], c % 3).alias("projects"),
        pick(CANDIDATE_SENIORITY, c).alias("seniority"),
        F.concat(F.lower("c_mktsegment"), F.lit("\n specialist")).alias("summary"),
    )


def match_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate is to be matched with which job: who ordered which part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (
        lines.join(orders.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select("o_custkey", "l_partkey").distinct()
        .select(candidate_id(F.col("o_custkey")).alias("candidate_id"), job_id(F.col("l_partkey")).alias("job_id"))
    )


# --- preferences -----------------------------------------------------------------------

def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of two customers in three; the others have none."""
    c = F.col("c_custkey")
    none = X.empty_strings()

    def only(kind: int, value: Column) -> Column:
        return F.when(c % 6 == kind, value).otherwise(none)

    return table(spark, sf_dir, "customer").filter(c % 3 != 0).select(
        candidate_id(c).alias("candidate_id"),
        F.struct(
            only(1, F.array(pick(["Engineer", " data ", "analyst", "manager"], c), F.lit("zzz")))
            .alias("preferred_titles"),
            only(2, F.array(pick(LOCATIONS, c), F.upper(pick(LOCATIONS, c + 5))))
            .alias("preferred_locations"),
            only(4, F.array(pick(["Remote", "hybrid"], F.floor(c / 6)))).alias("preferred_workplace_types"),
            only(5, F.array(pick(DOMAINS, c))).alias("preferred_domains"),
            F.when(c % 4 == 1, pick(["senior", " Mid ", "entry"], c)).alias("preferred_seniority"),
            ((c % 8) * 10).cast("int").alias("min_score"),
        ).alias("preferences"),
    )


# --- feeds ----------------------------------------------------------------------------

def posting_sentences(k: Column) -> dict[str, Column]:
    """Requirement text of a posting; every sixth has no headings."""
    alias = [pick(ALIASES, m * k + i) for m, i in [(1, 0), (5, 7), (11, 3), (13, 29)]]
    filler = F.repeat(F.lit("lorem "), ((k % 3) * 10).cast("int"))
    required = F.concat(
        F.lit("About us. Requirements: "), alias[0], F.lit(", "), alias[1], F.lit(" required. "),
        k % 17, pick(YEARS_PHRASES, k), F.lit(". "), pick(EDUCATION_PHRASES, k), F.lit(". "), filler)
    preferred = F.concat(
        F.lit("Preferred qualifications: "), alias[2], F.lit(" nice to have. "), filler,
        alias[3], F.lit(" is optional."))
    plain = F.concat(F.lit("We use "), alias[0], F.lit(" and "), alias[1], F.lit("; at least "),
                     k % 11, F.lit(" tools. "))
    headed = k % 6 != 0
    return {
        "required": F.when(headed, required).otherwise(plain),
        "preferred": F.when(headed, preferred).otherwise(F.concat(F.lit("A plus: "), alias[2], F.lit("."))),
    }


def feed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed A rows from the web pages: the page itself with the requirement text."""
    k = F.col("page_id")
    say = posting_sentences(k)

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), value.cast("variant").alias("value"))

    html = F.concat(F.col("html"), F.lit("<div><p>"), say["required"], F.lit("&nbsp;</p><p>R&amp;D "),
                    say["preferred"], F.lit("</p></div>"))
    return spread(table(spark, sf_dir, "pages"), "page_id").select(
        F.concat(F.lit("board_"), k % 4).alias("board"),
        F.floor(k / 4).alias("pos"),
        k.alias("id"),
        F.col("url").alias("absolute_url"),
        F.lit("2026-04-06T00:00:00Z").alias("updated_at"),
        pick(TITLES, k).alias("title"),
        html.alias("content"),
        F.struct(pick(LOCATIONS, 7 * k + 3).alias("name")).alias("location"),
        F.array(
            entry(F.lit("team"), F.lit("x")), entry(F.lit(""), F.lit("lost")),
            entry(F.lit("grade"), k % 5), entry(F.lit("team"), pick(["core", "é"], k)),
        ).alias("metadata"),
        first([F.struct(pick(["Sales", "Data"], k).alias("name"))], k % 2).alias("departments"),
        F.array(F.struct(F.lit("HQ").alias("name"))).alias("offices"),
    )


def feed_a_on_two_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed A with each seventh page again on the next board."""
    rows = feed_a(spark, sf_dir)
    copies = rows.filter(F.col("id") % 7 == 0).withColumns({
        "board": F.concat(F.lit("board_"), (F.col("id") + 1) % 4), "pos": F.col("pos") + 1_000_000})
    return rows.unionByName(copies)


def feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed B rows from the documents: the whole text between the requirement texts."""
    k = F.col("doc_id")
    say = posting_sentences(k)
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("board"),
        k.alias("pos"),
        k.cast("string").alias("id"),
        pick(TITLES, k).alias("text"),
        F.concat(F.lit("https://jobs.example.com/"), k).alias("hostedUrl"),
        (F.lit(1700000000000) + k).alias("createdAt"),
        F.concat(F.lit("<p>"), pick(TITLES, k), F.lit("</p>")).alias("description"),
        F.concat(say["required"], F.lit("\n")).alias("descriptionPlain"),
        F.col("text").alias("additionalPlain"),
        F.concat(F.lit(" "), say["preferred"]).alias("listsPlain"),
        F.struct(
            pick(["Full-time", "Contract", None], k).alias("commitment"),
            pick(WORKPLACES, k).alias("workplaceType"),
            pick(LOCATIONS, 7 * k + 3).alias("location"),
            F.lit("Ops").alias("department"),
            F.lit(None).cast("string").alias("team"),
        ).alias("categories"),
    )


def with_copies(staging: DataFrame) -> DataFrame:
    """Each tenth posting again with the same ids, each twentieth also with another id
    but the same title and address."""
    shift = F.lit(1 << 50).cast("bigint")
    again = staging.filter(F.col("ord") % 10 == 0).withColumn("ord", F.col("ord") + shift)
    renamed = staging.filter(F.col("ord") % 20 == 0).withColumns({
        "ord": F.col("ord") + 2 * shift,
        "job_uid": F.concat("job_uid", F.lit("-b")),
        "source_job_id": F.concat("source_job_id", F.lit("-b")),
    })
    return staging.unionByName(again).unionByName(renamed)


# --- payloads as lines ------------------------------------------------------------------

def payload_lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """JSON lines of every kind of payload, some outside their limits and some cut off."""
    c, k, o = F.col("c"), F.col("ord"), F.col("o_orderkey")

    def lines(rows: DataFrame, key: Column) -> DataFrame:
        line = F.to_json(F.struct(*[name for name in rows.columns if name not in ("c", "ord", "o_orderkey")]))
        return rows.select(F.when(key % 10 == 3, F.left(line, F.lit(5))).otherwise(line).alias("value"))

    number = F.regexp_extract("candidate_id", "[0-9]+", 0).cast("bigint")
    people = candidate_payloads(spark, sf_dir).withColumn("c", number).withColumns({
        "years_experience": F.when(c % 10 == 1, -1).otherwise(F.col("years_experience")),
        "full_name": F.when(c % 10 != 2, F.col("full_name"))})
    offers = jobs(spark, sf_dir).withColumn("title", F.when(k % 10 != 5, F.col("title")))
    wishes = preferences(spark, sf_dir).select(number.alias("c"), "preferences.*").withColumn(
        "min_score", F.when(c % 10 == 1, 101).when(c % 10 == 2, -1).otherwise(F.col("min_score")))
    orders = table(spark, sf_dir, "orders")
    requests = orders.select("o_orderkey", candidate_id(F.col("o_custkey")).alias("candidate_id"),
                             (o % 104).alias("top_k"), (o % 7).alias("limit_jobs"))
    previews = orders.select("o_orderkey", (o % 505).alias("limit"))
    return {"candidate": lines(people, c), "job": lines(offers, k), "preference": lines(wishes, c),
            "request": lines(requests, o), "preview": lines(previews, o)}
