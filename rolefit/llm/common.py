"""Shared folder, written intermediate tables and row keys of the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Two settings of the session that the operators need.

    Arrow batches are bounded by bytes, since whole texts differ much in length; and Python workers may import this
    package from where the driver has it, if it is neither installed nor shipped.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        env["PYTHONPATH"] = ":".join([*paths, here])


def release() -> None:
    """Hands the memory of a finished task back to the machine, since idle Python workers live on beside the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written to the shared folder, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_new(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with `columns` added; columns of the same name, in any case, are replaced."""
    names = {c.lower() for c in columns}
    return df.select(*[df[c] for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in columns.items()])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit_sample(df: DataFrame, key: str, at_most: int, by: str, labels: int = 10_000) -> DataFrame:
    """About `at_most` rows for each value of `by`, chosen by a hash of `key`.

    The expected number is at most `at_most`; equal keys are in or out together. `by` may have at most `labels` values.
    """
    part, total = free_name(df, "part"), free_name(df, "total")
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(total)).limit(labels + 1).toArrow()
    if len(sizes) > labels:
        raise ValueError(f"{by} has more than {labels} values")
    known = df.sparkSession.createDataFrame(sizes, df.select(by, F.lit(0).cast("bigint").alias(total)).schema)
    share = (F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias(part)
    return (
        df.select("*", share).join(F.broadcast(known), by)
        .where(F.col(part) * F.col(total) < F.lit(float(at_most))).drop(part, total)
    )


def numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """`df` with `out`: the row's number, from 0, in the order of `keys` (nulls first).

    Range partitions by all `keys` are sorted and written; only their sizes, a number for each partition, meet the driver.
    `keys` should tell rows apart, as rows that are equal in all of them share a partition.
    """
    spark, at, part, before = df.sparkSession, free_name(df, "row_at"), free_name(df, "row_part"), free_name(df, "row_before")
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn(part, F.shiftright(at, 33))
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(part).agg(F.count(F.lit(1))).collect())
    total, starts = 0, []
    for number, rows in sizes:
        starts.append((number, total))
        total += rows
    known = spark.createDataFrame(starts, f"{part} bigint, {before} bigint")
    place = F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)
    return ordered.join(F.broadcast(known), part).select(*df.columns, place.alias(out))
