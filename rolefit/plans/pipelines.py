"""The end-to-end jobs: ingestion, curation, extraction and the recommendation requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolefit.operators import curate as C
from rolefit.operators import dedup as D
from rolefit.operators import enrich as En
from rolefit.operators import features as Fe
from rolefit.operators import pairs as P
from rolefit.operators import recommend as Rec
from rolefit.operators import staging as St
from rolefit.session import prepare
from rolefit.sources import datasets as Ds
from rolefit.sources import feeds


def run_ingestion(feed_a: DataFrame | None, feed_b: DataFrame | None, base: str, run_ts: str,
                  ingested_at: str, pipeline_version: str, boards: DataFrame | None = None) -> dict[str, str]:
    """Raw snapshot, deduplicated staging table and run summary of one run.

    ``feed_a`` and ``feed_b`` hold landed feed rows with ``board`` and ``pos``.
    Every later step reads the stored snapshot, so a lost executor never
    leads back to the feeds. ``boards`` (source_type, source_name) is the list of
    boards in the order in which they are taken (board_rank, else by name).
    """
    given = {feeds.FEED_A: feed_a, feeds.FEED_B: feed_b}
    stage = {feeds.FEED_A: St.stage_feed_a, feeds.FEED_B: St.stage_feed_b}
    paths = {n: f"{base}/{n}" for n in ["raw", "staging", "run_summary"]}
    staged, raw = [], []
    spark = next(df for df in given.values() if df is not None).sparkSession
    for feed, rows in given.items():
        if rows is None:
            continue
        feeds.write_raw_snapshot(rows, paths["raw"], feed, run_ts)
        stored = feeds.read_raw_snapshot(spark, paths["raw"], feed, run_ts)
        listed = None if boards is None else boards.where(F.col("source_type") == feed)
        ranked = St.with_board_rank(stored, listed)
        staged.append(stage[feed](ranked, ingested_at, pipeline_version))
        raw.append(stored.select(F.lit(feed).alias("source_type"), F.col("board").alias("source_name")))
    all_staged, all_raw = St.unify(*staged), St.unify(*raw)
    Ds.write_version(D.dedup_staging(St.postprocess(all_staged)), paths["staging"], run_ts)
    if boards is None:
        boards = all_raw.distinct()
    boards = boards.select("source_type", "source_name").withColumn("raw_snapshot_path", F.concat(
        F.lit(f"{paths['raw']}/run_ts={run_ts}/source="), "source_type",
        F.lit("/source_company="), "source_name"))
    Ds.write_version(St.run_summary(boards, all_raw, all_staged), paths["run_summary"], run_ts)
    return paths


def run_curation(spark: SparkSession, staging: str, curated: str, run_ts: str) -> None:
    Ds.write_version(C.curate(Ds.read_latest(spark, staging)), curated, run_ts)


def run_extraction(spark: SparkSession, curated: str, enriched: str, run_ts: str,
                   taxonomy: dict[str, list[str]] | None = None) -> None:
    Ds.write_version(En.enrich(Ds.read_latest(spark, curated), taxonomy), enriched, run_ts)


def prepared_candidates(payloads: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    candidates = Fe.match_candidates(Fe.candidate_features(Fe.parse_candidates(payloads)))
    if preferences is not None:
        candidates = candidates.join(preferences, "candidate_id", "left")
    return candidates


def match(requests: DataFrame, jobs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Full result of each requested (candidate_id, job_id) pair."""
    prepare(requests.sparkSession)
    return P.match_result(P.requested_pairs(
        requests, Fe.match_jobs(jobs), prepared_candidates(payloads)))


def recommend(jobs: DataFrame, payloads: DataFrame, preferences: DataFrame | None = None,
              top_k: int = Rec.DEFAULT_TOP_K) -> DataFrame:
    """Best jobs per candidate from given match-ready jobs (with a unique ``ord``)."""
    return Rec.recommend(Fe.match_jobs(jobs), prepared_candidates(payloads, preferences), top_k)


def recommend_from_dataset(dataset: DataFrame, payloads: DataFrame, preferences: DataFrame | None = None,
                           top_k: int = Rec.DEFAULT_TOP_K, limit_jobs: int | None = None) -> DataFrame:
    """Best jobs per candidate from a stored jobs table; ``limit_jobs`` takes its first jobs.

    The limit is found on the order numbers alone, so the jobs stay where they are.
    """
    jobs = Ds.match_ready(dataset)
    if "ord" not in dataset.columns:
        jobs = Rec.written(jobs, "jobs")
    if limit_jobs:
        last = jobs.select("ord").orderBy("ord").limit(limit_jobs).agg(F.max("ord")).scalar()
        jobs = jobs.where(F.col("ord") <= last)
    return recommend(jobs, payloads, preferences, top_k)
