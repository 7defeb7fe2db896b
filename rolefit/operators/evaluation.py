"""Extraction and label quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolefit.functions import text as X


def zip_by_id(predictions: DataFrame, truths: DataFrame, on: str = "id") -> DataFrame:
    """Pair predictions with ground truth; ids missing on one side drop out."""
    return predictions.join(truths, on)


def with_prf(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Add precision, recall and f1 of two skill lists, rounded to 4 digits."""
    sets = df.withColumns({"__p": X.item_set(F.col(predicted)), "__t": X.item_set(F.col(truth))})
    counts = sets.withColumns({
        "__np": F.size("__p"), "__nt": F.size("__t"), "__hit": F.size(F.array_intersect("__p", "__t")),
    })

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    both_empty = (F.col("__np") == 0) & (F.col("__nt") == 0)
    raw = counts.withColumns({
        "__pr": F.when(both_empty, 1.0).otherwise(ratio(F.col("__hit"), F.col("__np"))),
        "__rc": F.when(both_empty, 1.0).otherwise(ratio(F.col("__hit"), F.col("__nt"))),
    })
    total = F.col("__pr") + F.col("__rc")
    f1 = F.when(total == 0, 0.0).otherwise(
        F.lit(2) * F.col("__pr") * F.col("__rc") / F.when(total != 0, total))
    return raw.withColumns({
        "precision": X.round_binary(F.col("__pr"), 4),
        "recall": X.round_binary(F.col("__rc"), 4),
        "f1": X.round_binary(f1, 4),
    }).drop("__p", "__t", "__np", "__nt", "__hit", "__pr", "__rc")


def macro_average(rows: DataFrame) -> DataFrame:
    """Averages of the rounded row values, rounded; NULL for no rows.

    The row values are whole ten-thousandths, so they are summed as integers:
    the result does not depend on the order in which tasks finish.
    """
    def mean(name: str) -> Column:
        units = F.sum(F.round(F.col(name) * 10000).cast("bigint"))
        return X.round_binary(F.try_divide(units / F.lit(10000.0), F.count("*")), 4)

    return rows.agg(*[mean(n).alias(f"avg_{n}") for n in ["precision", "recall", "f1"]])


def label_accuracy(df: DataFrame, predicted: str = "predicted_label",
                   true: str = "true_label") -> DataFrame:
    same = F.sum(F.when(F.col(predicted).eqNullSafe(F.col(true)), 1).otherwise(0))
    correct = F.coalesce(same, F.lit(0))
    return df.agg(
        X.round_binary(F.try_divide(correct.cast("double"), F.count("*")), 4).alias("accuracy"),
        F.count("*").alias("total_samples"),
        correct.alias("correct"),
    )
