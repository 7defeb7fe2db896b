"""Preference filter over scored pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rolefit.functions import text as X
from rolefit.operators.pairs import settled
from rolefit.session import merge_join

GRAM = 3


def with_facets(jobs: DataFrame) -> DataFrame:
    """The job columns preferences look at, normalised once per job."""
    return jobs.withColumns({
        "f_title": X.norm_key(F.col("title")),
        "f_location": X.norm_key(F.col("location")),
        "f_workplace": X.norm_key(F.col("workplace_type")),
        "f_seniority": X.norm_key(F.col("stated_seniority")),
    })


FACETS = ["f_title", "f_location", "f_workplace", "f_seniority"]


def prepared(preferences: Column) -> Column:
    """Preferences as compared: lists stripped and lowered, blanks out."""
    return F.when(preferences.isNotNull(), F.struct(
        X.clean_items(preferences["preferred_titles"]).alias("titles"),
        X.clean_items(preferences["preferred_locations"]).alias("locations"),
        X.clean_items(preferences["preferred_workplace_types"]).alias("workplaces"),
        X.clean_items(preferences["preferred_domains"]).alias("domains"),
        X.norm_key(preferences["preferred_seniority"]).alias("seniority"),
        F.coalesce(preferences["min_score"], F.lit(0)).cast("double").alias("min_score"),
    ))


def _any_or_empty(items: Column, test: Column) -> Column:
    return (F.size(items) == 0) | test


def job_passes(p: Column) -> Column:
    """The tests that depend on the job alone; ``p`` is a prepared preference."""
    tests = [
        _any_or_empty(p["titles"], F.exists(
            p["titles"], lambda t: F.contains(F.col("f_title"), t))),
        _any_or_empty(p["locations"], F.array_contains(p["locations"], F.col("f_location"))),
        _any_or_empty(p["workplaces"], F.array_contains(p["workplaces"], F.col("f_workplace"))),
        (p["seniority"] == "") | (p["seniority"] == F.col("f_seniority")),
        _any_or_empty(p["domains"], F.arrays_overlap(p["domains"], F.col("j_dom"))),
    ]
    return p.isNull() | reduce(lambda a, b: a & b, tests)


def score_passes(p: Column) -> Column:
    return p.isNull() | (F.col("score") >= p["min_score"])


def preference_filter(pairs: DataFrame, p: Column) -> DataFrame:
    """Scored pairs that pass; no preferences keep every pair.

    The tests on the job alone move below the scoring, so that only the pairs
    that pass them are scored.
    """
    return settled(pairs.filter(job_passes(p)), "score").filter(score_passes(p))


# --- join keys ---------------------------------------------------------------------

def restricts_jobs(p: Column) -> Column:
    """Whether any job-only test is set (a score threshold alone is none)."""
    return F.coalesce(
        (F.size(p["titles"]) > 0) | (F.size(p["locations"]) > 0) | (F.size(p["domains"]) > 0)
        | (F.size(p["workplaces"]) > 0) | (p["seniority"] != ""), F.lit(False))


def _keys(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.concat(F.lit(kind + ":"), v))


def preference_keys(p: Column) -> Column:
    """Keys of the one test a preference is looked up by, the usually narrowest first.

    Any job that passes has one of these keys (``with_job_keys``): a title that
    contains a wanted phrase contains its first characters.
    """
    return (
        F.when(F.size(p["titles"]) > 0,
               _keys("t", F.transform(p["titles"], lambda t: F.left(t, F.lit(GRAM)))))
        .when(F.size(p["locations"]) > 0, _keys("l", p["locations"]))
        .when(F.size(p["domains"]) > 0, _keys("d", p["domains"]))
        .when(p["seniority"] != "", _keys("s", F.array(p["seniority"])))
        .otherwise(_keys("w", p["workplaces"]))
    )


def title_keys(titles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys of each title: its parts of one to GRAM characters, if anyone asks for them."""
    title = F.col("f_title")
    parts = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(title)),
        lambda i: F.array(*[F.substr(title, i, F.lit(n)) for n in range(1, GRAM + 1)])))
    keys = titles.filter(title != "").select(
        "f_title", F.explode_outer(_keys("t", parts)).alias("key"))
    return keys.join(wanted, "key", "left_semi").groupBy("f_title").agg(
        F.collect_set("key").alias("title_keys"))


def with_job_keys(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per job and key; title parts are worked out once per distinct title."""
    titles = title_keys(jobs.select("f_title").distinct(), wanted)
    keys = F.concat(
        F.coalesce("title_keys", X.empty_strings()),
        _keys("l", F.array("f_location")), _keys("d", F.col("j_dom")),
        _keys("s", F.array("f_seniority")), _keys("w", F.array("f_workplace")))
    return (merge_join(jobs, titles, "f_title", "left")
            .select(*jobs.columns, F.explode_outer(keys).alias("key")))


def key_fits_job(key: Column) -> Column:
    """Whether a preference key is one of a job's keys, without listing those."""
    kind, value = F.left(key, F.lit(1)), key.substr(F.lit(3), F.length(key))
    return (
        F.when(kind == "t", F.contains(F.col("f_title"), value))
        .when(kind == "l", F.col("f_location") == value)
        .when(kind == "d", F.array_contains("j_dom", value))
        .when(kind == "s", F.col("f_seniority") == value)
        .otherwise(F.col("f_workplace") == value)
    )
