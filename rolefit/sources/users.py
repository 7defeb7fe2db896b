"""Saved profiles and preferences: one row per user, last write wins."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rolefit.functions import text as X
from rolefit.functions import vocab
from rolefit.operators.features import LIST_FIELDS
from rolefit.session import fresh_path, written

_PROFILE_TEXTS = ["candidate_id", "full_name", "current_title", "location"]
_PROFILE_NULLABLE = ["education", "seniority", "summary"]
_PREFERENCE_LISTS = ["preferred_titles", "preferred_locations", "preferred_workplace_types",
                     "preferred_domains"]


BUCKETS = 64


def last_write(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """One row per key: the newest by (updated_at, ord); a missing time or number is the oldest.

    Saves that agree in both are told apart by a hash of the row, so the result does not depend on their order. Every
    task keeps one version per key before the shuffle, so a much-written user costs one row per task.
    """
    rest = [c for c in rows.columns if c != key]
    least = F.lit(-(1 << 63))
    order = F.struct(
        F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), least).alias("at"),
        F.coalesce(F.col("ord").cast("bigint"), least).alias("ord"), F.xxhash64(*rest).alias("hash"))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return newest.select(key, "__row.*").select(*rows.columns)


def upsert(existing: DataFrame | None, changes: DataFrame) -> DataFrame:
    rows = changes if existing is None else existing.unionByName(changes)
    return last_write(rows)


def save(path: str, changes: DataFrame, key: str = "user_id", buckets: int = BUCKETS) -> None:
    """Apply changes to the store at ``path``; only the buckets they touch are read and written.

    A bucket is a folder of the keys with one hash. The new buckets are written aside first, since a folder cannot be
    read and replaced in one step; a save that is repeated after a failure gives the same store.
    """
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    changed = written(last_write(changes).withColumn("bucket", bucket), "changes")
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # at most `buckets` numbers
    store = read_store(spark, path)
    if store is not None:
        changed = store.filter(F.col("bucket").isin(touched)).unionByName(changed)
    merged = written(last_write(changed, key), "buckets").repartition(max(len(touched), 1), "bucket")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The store's rows with their ``bucket``; None before the first save."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def bucketed(df: DataFrame, key: str = "user_id", buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``: joins of two such tables move no row."""
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", fresh_path(df.sparkSession, name)).saveAsTable(name))
    return df.sparkSession.table(name)


def asked_rows(stored: DataFrame, users: DataFrame | None, key: str = "user_id") -> DataFrame:
    """Rows of the asked users, all without. Both are joined where they are if they are bucketed alike."""
    return stored if users is None else users.hint("merge").join(stored, key)


def profile_rows(changes: DataFrame) -> DataFrame:
    """Profile payloads as stored: texts stripped, blanks NULL, lists as JSON text."""
    stored = changes.withColumns({
        **{c: X.strip(F.coalesce(F.col(c), F.lit(""))) for c in _PROFILE_TEXTS},
        **{c: X.nullif_blank(X.strip(F.col(c))) for c in _PROFILE_NULLABLE},
        "years_experience": F.coalesce("years_experience", F.lit(0)),
        **{f"{c}_json": X.list_to_json(F.col(c)) for c in LIST_FIELDS},
    })
    return stored.drop(*LIST_FIELDS)


def preference_rows(changes: DataFrame) -> DataFrame:
    stored = changes.withColumns({
        "preferred_seniority": X.nullif_blank(X.strip(F.col("preferred_seniority"))),
        "min_score": F.coalesce("min_score", F.lit(vocab.DEFAULT_MIN_SCORE)),
        **{f"{c}_json": X.list_to_json(F.col(c)) for c in _PREFERENCE_LISTS},
    })
    return stored.drop(*_PREFERENCE_LISTS)


def load_profiles(stored: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Profiles of the asked users (all without), lists back as arrays."""
    rows = asked_rows(stored, users)
    texts = {c: F.coalesce(F.col(c), F.lit(""))
             for c in ["full_name", "current_title", "location", "summary"]}
    lists = {c: X.json_to_list(F.col(f"{c}_json")) for c in LIST_FIELDS}
    return rows.withColumns({**texts, **lists}).drop(*[f"{c}_json" for c in LIST_FIELDS])


def load_preferences(stored: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Preferences of the asked users; a stored threshold of 0 reads as the default."""
    rows = asked_rows(stored, users)
    lists = {c: X.json_to_list(F.col(f"{c}_json")) for c in _PREFERENCE_LISTS}
    threshold = F.when((F.col("min_score").isNull()) | (F.col("min_score") == 0),
                       vocab.DEFAULT_MIN_SCORE).otherwise(F.col("min_score"))
    return (rows.withColumns({**lists, "min_score": threshold})
            .drop(*[f"{c}_json" for c in _PREFERENCE_LISTS]))
