"""Headline queries, timed in one warm session; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from rolefit.queries import QUERIES
from rolefit.session import local_session

HEADLINE = [
    "recommend_topk", "recommend_preferences", "match_scores", "match_explanations",
    "preference_filter", "staging_dedup", "curated_jobs", "enriched_jobs", "skill_hits",
    "candidate_features", "profile_upsert", "extraction_macro",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The given tables in several files each, as a large table is: one row group can only be read by one task."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in ("documents", "pages", "part", "customer", "orders", "lineitem", "labels", "benchmark"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(files, table.columns[0]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    tables = laid_out(spark, sf_dir, 2 * (int(cores) if cores.isdigit() else 8))
    run(spark, "stable_hash_docs", tables)
    seconds = {}
    for name in HEADLINE:
        run(spark, name, tables)  # warm-up
        seconds[name] = round(statistics.median(run(spark, name, tables) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
