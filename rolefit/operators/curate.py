"""Staging to curated postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolefit.functions import normalise as N
from rolefit.functions import text as X
from rolefit.operators.dedup import keep_first

# fixed values: curated columns in order
CURATED_COLUMNS = [
    "job_uid", "source", "source_company", "source_job_id", "source_url", "ingested_at",
    "source_updated_at", "pipeline_version", "title_raw", "title_normalized", "job_family",
    "job_function", "seniority_level", "employment_type", "workplace_type", "location_raw",
    "location_normalized", "country", "region", "description_raw", "description_clean",
    "description_normalized", "language", "description_hash", "dedupe_key", "department",
    "team", "years_experience_min", "years_experience_preferred", "education_min",
    "is_remote", "is_hybrid", "is_onsite", "metadata_raw", "curated_record_hash",
]


def normalize_texts(df: DataFrame) -> DataFrame:
    cleaned = df.withColumns({
        "description_clean": X.clean_text(F.col("description_clean")),
        "language": F.coalesce("language", F.lit("")),
    })
    # Clean text is collapsed and stripped already.
    return cleaned.withColumn("description_normalized", F.lower("description_clean"))


def normalize_titles(df: DataFrame) -> DataFrame:
    """Replace the title columns by those of the normalised title."""
    record = df.withColumn("__title", N.title_record(F.col("title_raw")))
    names = ["title_normalized", "job_family", "job_function", "seniority_level"]
    return record.withColumns({n: F.col(f"__title.{n}") for n in names}).drop("__title")


def normalize_locations(df: DataFrame) -> DataFrame:
    """Replace the location columns; the feed's own workplace type is overwritten."""
    placed = df.withColumn("location_normalized", X.normalize_location_text(F.col("location_raw")))
    placed = placed.withColumn("country", N.country(F.col("location_normalized")))
    placed = placed.withColumns({
        "region": N.region(F.col("country")),
        "__work": N.workplace(F.col("location_raw"), F.col("description_clean")),
    })
    names = ["is_remote", "is_hybrid", "is_onsite", "workplace_type"]
    return placed.withColumns({n: F.col(f"__work.{n}") for n in names}).drop("__work")


def add_record_hash(df: DataFrame) -> DataFrame:
    """Hash of the identifying fields; ``description_clean`` has to be clean.

    Joining clean parts by '::' gives clean text, so it is hashed as it is.
    """
    parts = [X.clean_text(F.col(c)) for c in ["job_uid", "title_normalized", "location_normalized"]]
    joined = F.concat_ws("::", *parts, F.coalesce("description_clean", F.lit("")))
    return df.withColumn("curated_record_hash", F.sha2(joined, 256))


def select_curated(df: DataFrame) -> DataFrame:
    keep = [c for c in CURATED_COLUMNS if c in df.columns]
    return df.select(*keep, *[c for c in ["ord"] if c in df.columns])


def normalize_postings(staging: DataFrame) -> DataFrame:
    """All row-wise steps of curation."""
    return add_record_hash(normalize_locations(normalize_titles(normalize_texts(staging))))


def curate(staging: DataFrame, order: str = "ord") -> DataFrame:
    """Normalise, drop later copies of the same record, select the curated columns."""
    return select_curated(keep_first(normalize_postings(staging), ["curated_record_hash"], order))
