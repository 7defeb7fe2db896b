"""Curated postings to enriched ones: extracted skills, years, education, seniority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolefit.functions import extraction as E
from rolefit.functions import text as X

# fixed values: text fields in the order they are joined
TEXT_FIELDS = ["title", "title_raw", "description", "description_raw", "description_clean",
               "description_normalized", "job_description", "requirements"]


def posting_text(df: DataFrame) -> Column:
    """All text fields the table has, missing values skipped, markup removed."""
    return X.clean_html(F.concat_ws(" ", *[F.col(c) for c in TEXT_FIELDS if c in df.columns]))


def posting_title(df: DataFrame) -> Column:
    present = [X.nullif_blank(F.col(c)) for c in ["title", "title_raw"] if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def enrich(df: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """Append the six extracted columns. Row-wise: one pass, no shuffle."""
    columns = df.columns
    texts = df.withColumn("__text", E.lowered(posting_text(df)))
    skills = E.with_skills(texts, "__text", taxonomy, collapsed=True)
    facts = skills.withColumns({
        "years_experience_extracted": E.years_of_experience(F.col("__text")),
        "education_extracted": E.education_required(F.col("__text")),
    })
    inferred = facts.withColumn("seniority_inferred", E.posting_seniority(
        posting_title(df), F.col("__text"), F.col("years_experience_extracted")))
    return inferred.select(
        *columns, "required_skills", "preferred_skills", "other_skills_found",
        "years_experience_extracted", "education_extracted", "seniority_inferred")


def lists_as_json(df: DataFrame) -> DataFrame:
    """List columns as JSON text, for text sinks."""
    lists = [name for name, kind in df.dtypes if kind == "array<string>"]
    return df.withColumns({name: X.list_to_json(F.col(name)) for name in lists})
