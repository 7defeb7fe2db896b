"""Corpus clean-up in five stages; each stage's rows are written and reread before the next one starts.

All stages: an empty table gives an empty one with the same columns; rows that agree in all columns are judged alike, each
by itself but for the two stages that remove repeats; columns besides doc_id and text pass through, whatever they are
called; very long texts are taken whole, in slices where the operator works by words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm import bpe, decontaminate, langid, lines, simhash
from rolefit.llm.common import BATCH_BYTES, cut, prepare, with_new
from rolefit.llm.queries import VOCABULARY, language_tables

#: A document goes if no language is at least this likely.
LEAST_SCORE = 0.5

#: The stages learn, sketch and merge, which SQL cannot express; the tests compare them with brute force.
ORACLE_SQL = None


#: For Python workers: arrays are mapped, and so given back when they are freed. Workers of one stage live on beside those of
#: the next, and what they hold counts.
WORKER_MEMORY = {
    "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def ready(spark: SparkSession) -> None:
    """The session's settings for the operators and their workers."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES // 2))  # a stage runs several workers a task
    spark.sparkContext.environment.update(WORKER_MEMORY)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns renamed, so that none clashes with an operator's, and their new names."""
    ready(docs.sparkSession)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(found: DataFrame, names: dict[str, str], new: dict[str, Column] | None = None) -> DataFrame:
    return found.select(*[(new or {}).get(c, F.col(k)).alias(c) for c, k in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found. Null and empty texts, texts without a letter and undecided ones go.

    The language column is only learned from; a null there is not. Without any language to learn, every document goes.
    """
    named, names = aside(docs)
    found = langid.detect(named, language_tables(docs), text=names["text"], lang="found", score="sure")
    return restored(found.where((F.col("found") != langid.UNKNOWN) & (F.col("sure") >= LEAST_SCORE)), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier already, by doc_id and place; one that loses every word goes.

    Null and empty texts have no line to lose and stay as they are. Of repeated rows one keeps its lines. A null doc_id is
    the last one.
    """
    named, names = aside(docs)
    found = lines.remove_lines(named, names["doc_id"], names["text"], share=0.8)
    left = found.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return restored(left, names, {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")})


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, and one of equal rows.

    Null and empty texts, and those without a word, share one fingerprint and so are one group with all near it.
    """
    named, names = aside(docs)
    return restored(simhash.keep_one(named, names["doc_id"], names["text"], size=4, radius=4), names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none and stay; empty items are in no text."""
    named, names = aside(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("item_text"))
    return restored(decontaminate.clean(named, items, names["text"], item_text="item_text", size=5, share=0.8), names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, the number of these, and whether the ids decode to the text.

    Null and empty texts have no tokens. Columns called ids, n_tokens or round_trip are replaced.
    """
    ready(spark)
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = bpe.round_trip(docs, path, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return with_new(both, {"n_tokens": (F.octet_length("ids") / 4).cast("bigint"), "round_trip": same}).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
