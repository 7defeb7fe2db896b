"""The operators' queries over the given tables, and the SQL equivalents where there are any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, langid, lines, merkle, neighbours, packing, repeats, secret_scan, simhash, toxicity, urls
from .common import fit_sample, fold, prepare
from .oracles import ORACLES as ORACLES

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four folds of five."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull())
    sample = fit_sample(labels, "doc_id", 8000, "toxic")
    model = toxicity.fit(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "text", "toxic")
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, share=0.8)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), share=0.8)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def list_history(pages: DataFrame) -> DataFrame:
    """Dated list entries taken from the pages: of half of the hosts and host sections, each with up to three changes."""
    def day(n):
        return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))

    host, section = urls.host(F.col("url")), F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([a-z]+)", 1)
    named = pages.select("page_id", host.alias("host"), section.alias("section")).where("host <> ''")
    patterns = named.select("page_id", F.col("host").alias("pattern")).union(named.where("section <> ''").select("page_id", F.concat_ws("/", "host", "section").alias("pattern")))
    seen = patterns.groupBy("pattern").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.substring(F.md5("pattern"), 1, 1) < "8")
    changes = F.array(
        F.struct(day(F.col("first") % 150).alias("changed_at"), F.lit(True).alias("listed")),
        F.struct(day(150 + F.col("n") % 100).alias("changed_at"), F.lit(False).alias("listed")),
        F.struct(day(250 + F.col("first") % 100).alias("changed_at"), (F.col("n") % 2 == 0).alias("listed")),
    )
    return seen.select("pattern", F.explode(changes).alias("e")).select("pattern", "e.changed_at", "e.listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list of its fetch day, which follows from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    judged = urls.judge(fetched, list_history(pages))
    return judged.select("page_id", F.col("fetched_at").cast("string").alias("fetched_at"), F.col("n_matches").cast("bigint").alias("n_matches"), "matched", "blocked")


def language_tables(documents: DataFrame) -> langid.Tables:
    return langid.fit(documents.where(fold(F.col("doc_id"), 4) != 2), "text", "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.detect(documents, language_tables(documents))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048)
    summed = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(summed, size=2048)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents by source; half of the ids are verified with their line breaks taken out."""
    documents = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in fields]
    replaced = F.when(fold(F.col("doc_id"), 2) == 0, merkle.leaf(tampered))
    found = merkle.manifest(documents, fields, group="source", order="doc_id", replaced=replaced)
    proof = F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), path_a, path_b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", digest)
    return alignment.scored(rows, alignment.vocabulary_size(path_b))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_embedding_near_dedup, op3_substring_dedup, op4_byte_bpe, op5_simhash, op6_secrets, op7_decontamination,
        op8_line_dedup, op9_url_filter, op10_language_id, op11_pattern_packing, op12_merkle_manifest,
        op13_token_alignment,
    )
}
