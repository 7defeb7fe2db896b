"""Keep-first deduplication over narrow keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolefit.session import written


def _narrow(df: DataFrame, keys: list[str], order: str, *carry: str) -> DataFrame:
    """Order number and one text of fixed width for all keys; NULL keys are equal to each other.

    Written, since several steps read it: the texts behind the keys are read once.
    """
    key = F.sha2(F.to_json(F.struct(*keys)), 256).alias("__key")
    return written(df.select(key, F.col(order), *carry), "keys")


def _first(rows: DataFrame, order: str, key: str = "__key") -> DataFrame:
    """Order number of the first row of each key.

    A plain aggregate of numbers: every task reduces its copies before the
    shuffle, so a key holding a third of all rows sends one row per task.
    """
    return rows.groupBy(key).agg(F.min(order).alias("__first"))


def drop_rows(df: DataFrame, copies: DataFrame, order: str) -> DataFrame:
    """Rows whose unique order number is not among the copies.

    Only the copies' numbers meet the wide rows: with few of them, the planner
    sends them to the rows, which then stay where they are.
    """
    return df.join(written(copies.select(order), "copies"), order, "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """First row per key in order; a missing order number is the last.

    Rows that share a key and the first number are copies too: of these, the one with the least hash stays (the first of
    them if all their columns agree). Only their keys, which are few, make a second pass necessary.
    """
    if {"__key", "__at"} & set(df.columns):
        raise ValueError("columns __key and __at are taken")
    key = F.sha2(F.to_json(F.struct(*keys)), 256)
    keyed = df.withColumns({"__key": key, "__at": F.coalesce(F.col(order).cast("bigint"), F.lit((1 << 63) - 1))})
    rows = written(keyed.select("__key", "__at"), "keys")
    firsts = rows.groupBy("__key").agg(F.min("__at").alias("__first"))
    counts = rows.groupBy("__key", "__at").agg(F.count("*").alias("__n"))
    judged = written(counts.join(firsts, "__key"), "judged")
    copies = written(judged.where(F.col("__at") > F.col("__first")).select("__key", "__at"), "copies")
    left = keyed.join(copies, ["__key", "__at"], "left_anti")
    tied = judged.where((F.col("__at") == F.col("__first")) & (F.col("__n") > 1)).select("__key")
    if tied.isEmpty():
        return left.drop("__key", "__at")
    tied = written(tied, "tied")
    whole = F.struct(*df.columns)
    alike = left.join(tied, "__key", "left_semi").groupBy("__key").agg(F.min_by(whole, F.xxhash64(*df.columns)).alias("__row"))
    return left.join(tied, "__key", "left_anti").select(*df.columns).unionByName(alike.select("__row.*"))


PRIMARY_KEYS = ["job_uid", "source", "source_company", "source_job_id"]


def dedup_staging(df: DataFrame, order: str = "ord") -> DataFrame:
    """First per primary key (if all its columns exist), then, among those, first
    per dedupe_key. The order of the two steps matters for the result.

    Both steps run on keys and numbers only; the postings are joined once.
    """
    has_primary = all(k in df.columns for k in PRIMARY_KEYS)
    has_key = "dedupe_key" in df.columns
    if not has_key:
        return keep_first(df, PRIMARY_KEYS, order) if has_primary else df
    if not has_primary:
        return keep_first(df, ["dedupe_key"], order)
    rows = _narrow(df, PRIMARY_KEYS, order, "dedupe_key")
    firsts = rows.join(_first(rows, order), "__key").where(F.col(order) == F.col("__first")).drop("__first")
    kept = _first(firsts, order, "dedupe_key").select(F.col("__first").alias(order))
    return drop_rows(df, rows.select(order).join(kept, order, "left_anti"), order)
