"""Candidate parsing and the match-ready features of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rolefit.functions import text as X
from rolefit.functions import vocab

LIST_FIELDS = ["skills", "tools", "domains", "certifications", "projects"]

CANDIDATE_INPUT = T.StructType([
    T.StructField("candidate_id", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("current_title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("education", T.StringType()),
    T.StructField("years_experience", T.IntegerType()),
    *[T.StructField(name, T.ArrayType(T.StringType())) for name in LIST_FIELDS],
    T.StructField("seniority", T.StringType()),
    T.StructField("summary", T.StringType()),
])

JOB_INPUT = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("workplace_type", T.StringType()),
    T.StructField("domains", T.ArrayType(T.StringType())),
    T.StructField("required_skills", T.ArrayType(T.StringType())),
    T.StructField("preferred_skills", T.ArrayType(T.StringType())),
    T.StructField("other_skills", T.ArrayType(T.StringType())),
    T.StructField("years_experience_required", T.LongType()),
    T.StructField("education_required", T.StringType()),
    T.StructField("seniority", T.StringType()),
])


def column_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# --- candidates --------------------------------------------------------------------

def education_level(c: Column) -> Column:
    value = F.lower(X.clean_text(c))
    known = F.when(value.isin(*vocab.EDUCATION_RANK), value)
    return F.coalesce(X.lookup(vocab.CANDIDATE_EDUCATION, value), known)


def seniority_level(c: Column) -> Column:
    value = F.lower(X.clean_text(c))
    return X.lookup(vocab.CANDIDATE_SENIORITY, value)


def years_level(c: Column, is_integer: bool) -> Column:
    """Whole years: an integer is floored at 0, anything else gives its first digits."""
    if is_integer:
        return F.when(c < 0, 0).otherwise(c.cast("int"))
    found = X.whole_number(F.regexp_extract(c.cast("string"), f"{X.DIGIT}+", 0))
    return F.when(found.isNotNull(), F.least(found, F.lit((1 << 31) - 1))).cast("int")


def parse_candidates(df: DataFrame) -> DataFrame:
    """Candidate payloads to typed profiles; list fields may be arrays or delimited text."""
    types = dict(df.dtypes)

    def listed(name):
        if name not in types:
            return X.empty_strings().alias(name)
        return X.candidate_list(F.col(name), types[name].startswith("array")).alias(name)

    def cleaned(name):
        return X.clean_text(column_or_null(df, name))

    years = column_or_null(df, "years_experience", "int")
    is_integer = types.get("years_experience", "int") in ("tinyint", "smallint", "int", "bigint")
    fixed = {"candidate_id", "full_name", "current_title", "location", "education",
             "years_experience", "seniority", "summary", *LIST_FIELDS}
    return df.select(
        *[c for c in df.columns if c not in fixed],
        F.coalesce(X.nullif_blank(cleaned("candidate_id")),
                   F.lit(vocab.DEFAULT_CANDIDATE_ID)).alias("candidate_id"),
        cleaned("full_name").alias("full_name"),
        cleaned("current_title").alias("current_title"),
        cleaned("location").alias("location"),
        education_level(column_or_null(df, "education")).alias("education"),
        years_level(years, is_integer).alias("years_experience"),
        *[listed(name) for name in LIST_FIELDS],
        seniority_level(column_or_null(df, "seniority")).alias("seniority"),
        cleaned("summary").alias("summary"),
    )


def seniority_from_title(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    # fixed values: words, in order
    return (
        F.when(F.contains(t, F.lit("intern")), "intern")
        .when(X.any_contains(t, ["junior", "entry"]), "entry")
        .when(X.any_contains(t, ["manager", "director", "head", "principal", "vp"]), "manager")
        .when(X.any_contains(t, ["senior", "sr", "lead", "staff"]), "senior")
    )


def seniority_from_years(years: Column) -> Column:
    # fixed values: year limits
    return (
        F.when(years >= 10, "manager").when(years >= 8, "senior")
        .when(years >= 4, "mid").when(years >= 0, "entry")
    )


def candidate_features(profiles: DataFrame) -> DataFrame:
    """Typed profiles to matching features (seniority settled, skills with tools, ranks)."""
    seniority = F.coalesce(
        "seniority", seniority_from_title(F.col("current_title")),
        seniority_from_years(F.col("years_experience")))
    df = profiles.withColumns({
        "seniority": seniority,
        "skills": X.merge_unique(F.col("skills"), F.col("tools")),
        "domains": X.merge_unique(F.col("domains")),
        "projects": X.merge_unique(F.col("projects")),
        "certifications": X.merge_unique(F.col("certifications")),
    })
    blob = F.concat_ws(
        " ", "current_title", "summary",
        *[F.array_join(name, " ") for name in ["skills", "domains", "projects", "certifications"]])
    return df.withColumns({
        "education_rank": X.lookup(vocab.EDUCATION_RANK, F.col("education")),
        "seniority_rank": X.lookup(vocab.CANDIDATE_SENIORITY_RANK, F.col("seniority")),
        "keyword_blob": X.clean_text(F.lower(blob)),
    })


# --- the two sides of a match --------------------------------------------------------

JOB_SIGNATURE = ["j_req", "j_pref", "j_dom", "j_need_given", "j_years",
                 "j_edu", "j_edu_rank", "j_sen", "j_sen_rank"]
CANDIDATE_SIGNATURE = ["c_skills", "c_dom", "c_years", "c_edu", "c_edu_rank", "c_sen", "c_sen_rank"]


def match_jobs(jobs: DataFrame) -> DataFrame:
    """Job columns as scoring wants them. A listed requirement wins over an extracted one.

    Display columns stay; everything that depends on the job alone is computed
    here, once per job.
    """
    def given(*names):
        return F.coalesce(*[X.nullif_blank(F.col(n).cast("string"))
                            for n in names if n in jobs.columns], F.lit(None).cast("string"))

    def items(name):
        return X.item_set(column_or_null(jobs, name, "array<string>"))

    years = given("years_experience_required", "years_experience_extracted")
    edu = given("education_required", "education_extracted")
    sen = given("seniority", "seniority_inferred")
    shown = ["title", "company", "location", "workplace_type"]
    job_id = F.coalesce(*[X.nullif_blank(F.col(c)) for c in ["job_uid", "job_id"] if c in jobs.columns])
    return jobs.select(
        *[c for c in ["ord"] if c in jobs.columns],
        *[column_or_null(jobs, c).alias(c) for c in shown],
        job_id.alias("job_id"),
        items("required_skills").alias("j_req"),
        items("preferred_skills").alias("j_pref"),
        items("domains").alias("j_dom"),
        years.isNotNull().alias("j_need_given"),
        years.try_cast("double").alias("j_years"),
        edu.alias("j_edu"),
        X.lookup(vocab.EDUCATION_RANK, X.norm_key(edu)).alias("j_edu_rank"),
        sen.alias("j_sen"),
        X.lookup(vocab.SENIORITY_RANK, X.norm_key(sen)).alias("j_sen_rank"),
        # Preferences look at the stated level only, never at an inferred one.
        column_or_null(jobs, "seniority").cast("string").alias("stated_seniority"),
    )


def match_candidates(features: DataFrame) -> DataFrame:
    extra = [c for c in ["preferences"] if c in features.columns]
    return features.select(
        "candidate_id", *extra,
        F.sort_array(F.array_distinct("skills")).alias("c_skills"),
        F.sort_array(F.array_distinct("domains")).alias("c_dom"),
        F.col("years_experience").cast("double").alias("c_years"),
        F.col("education").alias("c_edu"),
        X.lookup(vocab.EDUCATION_RANK, X.norm_key(F.col("education"))).alias("c_edu_rank"),
        F.col("seniority").alias("c_sen"),
        X.lookup(vocab.SENIORITY_RANK, X.norm_key(F.col("seniority"))).alias("c_sen_rank"),
    )
