"""Scoring, hard filters and explanations over candidate-job pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolefit.functions import scoring as R
from rolefit.functions import text as X
from rolefit.functions import vocab

COMPONENTS = list(vocab.WEIGHTS)


def settled(df: DataFrame, *names: str) -> DataFrame:
    """Fix columns that filters use next.

    The one-row generator keeps the optimizer from copying their expressions
    into the filters, where they would be evaluated again and again.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def requested_pairs(requests: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Join a (candidate_id, job_id) request table with both prepared sides.

    The prepared sides grow with the input too and are never broadcast. Each task holds its part of them in a hash table
    and lets the requests, which are many more, pass unsorted; AQE splits a hot job or candidate. The candidate's columns
    travel with every request to the jobs, so they are packed into as few bytes as they take.
    """
    packed = [c for c in candidates.columns if c != "candidate_id"]
    narrow = candidates.select("candidate_id", *[_packed(candidates, c).alias(c) for c in packed])
    met = requests.join(narrow.hint("shuffle_hash"), "candidate_id").join(jobs.hint("shuffle_hash"), "job_id")
    return met.withColumns({c: _unpacked(candidates, c) for c in packed})


#: Between the items of a packed list; a list with an item that holds it is not packed.
BETWEEN = "\x1f"


def _packed(df: DataFrame, name: str) -> Column:
    """A list of texts as one text and a list, one of which is NULL. The text has ``BETWEEN`` before every item."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "array<string>":
        return c
    plain = ~F.exists(c, lambda item: item.isNull() | F.contains(item, F.lit(BETWEEN)))
    text = F.array_join(F.transform(c, lambda item: F.concat(F.lit(BETWEEN), item)), "")
    return F.struct(F.when(plain, text).alias("text"), F.when(~plain, c).alias("items"))


def _unpacked(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if dict(df.dtypes)[name] != "array<string>":
        return c
    text = c["text"]
    items = F.split(text.substr(F.lit(2), F.length(text)), BETWEEN)
    return F.when(text == "", X.empty_strings()).when(text.isNotNull(), items).otherwise(c["items"])


def set_counts() -> dict[str, Column]:
    """Sizes of the item sets of both sides and of what they share."""
    return {
        "n_req": F.size("j_req"), "req_hits": F.size(F.array_intersect("j_req", "c_skills")),
        "n_pref": F.size("j_pref"), "pref_hits": F.size(F.array_intersect("j_pref", "c_skills")),
        "n_dom": F.size("j_dom"), "dom_hits": F.size(F.array_intersect("j_dom", "c_dom")),
        "n_cand_dom": F.size("c_dom"),
    }


def component_columns() -> dict[str, Column]:
    """The six components from set counts, years and ranks."""
    c = F.col
    return {
        "required_skill_score": R.required_score(c("req_hits"), c("n_req")),
        "preferred_skill_score": R.share_score(c("pref_hits"), c("n_pref")),
        "experience_score": R.experience_score(c("j_need_given"), c("j_years"), c("c_years")),
        "education_score": R.education_score(
            c("j_edu"), c("j_edu_rank"), c("c_edu"), c("c_edu_rank")),
        "seniority_score": R.seniority_score(
            c("j_sen"), c("j_sen_rank"), c("c_sen"), c("c_sen_rank")),
        "domain_score": R.domain_score(c("dom_hits"), c("n_dom"), c("n_cand_dom")),
    }


def score_from_counts(pairs: DataFrame) -> DataFrame:
    """Add the components and the score, one step per projection so that no
    intermediate value is computed twice."""
    return (
        pairs.withColumns(component_columns())
        .withColumn("__weighted", R.weighted_sum(*[F.col(c) for c in COMPONENTS]) * 100)
        .withColumn("__rounded", X.round_binary(F.col("__weighted"), 2))
        .withColumn("score", R.capped(F.col("__rounded"), F.col("required_skill_score")))
        .drop("__weighted", "__rounded")
    )


def with_score(pairs: DataFrame) -> DataFrame:
    """Add the six components (unrounded), score and fit_label."""
    counts = set_counts()
    scored = score_from_counts(pairs.withColumns(counts)).drop(*counts)
    return scored.withColumn("fit_label", R.fit_label(F.col("score")))


def rounded_components() -> list[Column]:
    return [X.round_binary(F.col(c), 4).alias(c) for c in COMPONENTS]


def with_hard_filters(pairs: DataFrame) -> DataFrame:
    """Add the skill, experience and education checks and their conjunction."""
    exp = R.experience_check(F.col("j_need_given"), F.col("j_years"), F.col("c_years"))
    checked = pairs.withColumns({
        "required_skills_total": F.size("j_req"),
        "required_skills_matched": F.array_intersect("j_req", "c_skills"),
        "required_skills_missing": F.array_except("j_req", "c_skills"),
        "experience_passed": exp["passed"],
        "experience_gap": exp["gap"],
        "education_passed": R.education_check(
            *[F.col(c) for c in ["j_edu", "j_edu_rank", "c_edu", "c_edu_rank"]]),
    })
    checked = checked.withColumn("skills_passed", F.size("required_skills_missing") == 0)
    return checked.withColumn(
        "hard_filters_passed",
        F.col("skills_passed") & F.col("experience_passed") & F.col("education_passed"))


def with_explanation(pairs: DataFrame) -> DataFrame:
    """Add the explanation struct."""
    sets = pairs.withColumns({
        "__mr": F.array_intersect("j_req", "c_skills"), "__xr": F.array_except("j_req", "c_skills"),
        "__mp": F.array_intersect("j_pref", "c_skills"), "__xp": F.array_except("j_pref", "c_skills"),
        "__md": F.array_intersect("j_dom", "c_dom"), "__xd": F.array_except("j_dom", "c_dom"),
    })
    told = sets.withColumn("explanation", R.explanation({
        "matched_required": F.col("__mr"), "missing_required": F.col("__xr"),
        "matched_preferred": F.col("__mp"), "missing_preferred": F.col("__xp"),
        "matched_domains": F.col("__md"), "missing_domains": F.col("__xd"),
        "need_years": F.col("j_years"), "have_years": F.col("c_years"),
        "need_education": F.col("j_edu"), "have_education": F.col("c_edu"),
        "need_seniority": F.col("j_sen"), "have_seniority": F.col("c_sen"),
    }))
    return told.withColumn("explanation", F.col("explanation").withField(
        "recommendations", R.with_default_advice(F.col("explanation.recommendations"))
    )).drop("__mr", "__xr", "__mp", "__xp", "__md", "__xd")


def result_columns() -> list[Column]:
    """The nested parts of a result, from the columns of the filters, the score and the explanation."""
    return [
        F.struct(
            F.col("hard_filters_passed").alias("passed"),
            F.struct("required_skills_total", "required_skills_matched", "required_skills_missing",
                     F.col("skills_passed").alias("passed")).alias("skill_check"),
            F.struct(F.col("j_years").alias("job_years_required"),
                     F.col("c_years").alias("candidate_years"),
                     F.col("experience_passed").alias("passed"),
                     F.col("experience_gap").alias("gap")).alias("experience_check"),
            F.struct(F.col("j_edu").alias("job_education"),
                     F.col("c_edu").alias("candidate_education"),
                     F.col("education_passed").alias("passed")).alias("education_check"),
        ).alias("hard_filters"),
        F.struct(
            "score", "fit_label",
            F.struct(*rounded_components()).alias("component_scores"),
            F.struct(*[F.lit(w).alias(n) for n, w in vocab.WEIGHTS.items()]).alias("weights"),
        ).alias("match_score"),
        F.col("explanation"),
    ]


def match_result(pairs: DataFrame) -> DataFrame:
    """Full nested result of each pair: filters, score with components, explanation."""
    df = with_explanation(with_hard_filters(with_score(pairs)))
    return df.select("job_id", "candidate_id", *result_columns())
