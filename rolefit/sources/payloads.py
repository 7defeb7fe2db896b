"""Payload scans with their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from rolefit.functions import text as X
from rolefit.operators.features import CANDIDATE_INPUT, JOB_INPUT

PREFERENCES = T.StructType([
    T.StructField("preferred_titles", T.ArrayType(T.StringType())),
    T.StructField("preferred_locations", T.ArrayType(T.StringType())),
    T.StructField("preferred_workplace_types", T.ArrayType(T.StringType())),
    T.StructField("preferred_domains", T.ArrayType(T.StringType())),
    T.StructField("preferred_seniority", T.StringType()),
    T.StructField("min_score", T.IntegerType()),
])

REQUEST = T.StructType([
    T.StructField("candidate_id", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("limit_jobs", T.IntegerType()),
])
PREVIEW = T.StructType([T.StructField("limit", T.IntegerType())])

CORRUPT = "_corrupt_record"

# --- fixed values: constraints as (column, name of the violation, least, most) -----
CANDIDATE_REQUIRED = ["candidate_id", "full_name", "current_title", "location", "years_experience"]
CANDIDATE_RANGES = [("years_experience", 0, None)]
PROFILE_RANGES = [("years_experience", 0, 60)]
PROFILE_LENGTHS = [("candidate_id", 100), ("full_name", 100), ("current_title", 100), ("location", 100)]
JOB_REQUIRED = ["job_id", "title"]
PREFERENCE_RANGES = [("min_score", 0, 100)]
REQUEST_RANGES = [("top_k", 1, 100), ("limit_jobs", 1, None)]
PREVIEW_RANGES = [("limit", 1, 500)]


def read_payloads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines are kept in a column."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(with_corrupt).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _range_tests(ranges) -> list[Column]:
    tests = []
    for name, least, most in ranges:
        if least is not None:
            tests.append(F.when(F.col(name) < least, f"{name} below {least}"))
        if most is not None:
            tests.append(F.when(F.col(name) > most, f"{name} above {most}"))
    return tests


def with_violations(df: DataFrame, required=(), ranges=(), lengths=()) -> DataFrame:
    """Add ``violations``, the list of broken constraints in a fixed order."""
    tests = [F.when(F.col(n).isNull(), f"{n} missing") for n in required]
    tests += _range_tests([r for r in ranges if r[0] in df.columns])
    tests += [F.when(F.length(X.strip(F.col(n))) > most, f"{n} longer than {most}")
              for n, most in lengths]
    if CORRUPT in df.columns:
        tests.append(F.when(F.col(CORRUPT).isNotNull(), "not readable"))
    found = F.array(*tests) if tests else X.empty_strings()
    return df.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") == 0).drop("violations")


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") > 0)


def candidate_payloads(spark: SparkSession, path: str) -> DataFrame:
    return with_violations(read_payloads(spark, path, CANDIDATE_INPUT),
                           CANDIDATE_REQUIRED, CANDIDATE_RANGES)


def job_payloads(spark: SparkSession, path: str) -> DataFrame:
    return with_violations(read_payloads(spark, path, JOB_INPUT), JOB_REQUIRED)


def preference_payloads(spark: SparkSession, path: str) -> DataFrame:
    return with_violations(read_payloads(spark, path, PREFERENCES), ranges=PREFERENCE_RANGES)


#: Schema and constraints of each kind of payload.
KINDS = {
    "candidate": (CANDIDATE_INPUT, {"required": CANDIDATE_REQUIRED, "ranges": CANDIDATE_RANGES}),
    "job": (JOB_INPUT, {"required": JOB_REQUIRED}),
    "preference": (PREFERENCES, {"ranges": PREFERENCE_RANGES}),
    "request": (REQUEST, {"required": ["candidate_id"], "ranges": REQUEST_RANGES}),
    "preview": (PREVIEW, {"ranges": PREVIEW_RANGES}),
}


def settle(spark: SparkSession, path: str, kind: str, base: str) -> tuple[int, int]:
    """Scan payloads of one kind once: rows that keep all constraints go to the accepted table, the others to quarantine.

    Both are folders of one write. A quarantined row keeps its violations and its text (as read, or the line itself where
    it is not readable). Returns the numbers of accepted and rejected rows, observed while they are written. Settling a
    kind again replaces both of its tables.
    """
    schema, constraints = KINDS[kind]
    checked = with_violations(read_payloads(spark, path, schema), **constraints)
    rejected, seen = F.size("violations") > 0, Observation()
    text = F.coalesce(CORRUPT, F.to_json(F.struct(*schema.names)))
    (checked.select(*schema.names, "violations", F.when(rejected, text).alias("payload"), (~rejected).alias("accepted"))
     .observe(seen, F.count_if("accepted").alias("kept"), F.count_if(~F.col("accepted")).alias("lost"))
     .write.mode("overwrite").partitionBy("accepted").parquet(f"{base}/{kind}"))
    return seen.get["kept"], seen.get["lost"]


def _settled(spark: SparkSession, base: str, kind: str) -> DataFrame:
    schema = T.StructType([*KINDS[kind][0].fields, T.StructField("violations", T.ArrayType(T.StringType())),
                           T.StructField("payload", T.StringType()), T.StructField("accepted", T.BooleanType())])
    return spark.read.schema(schema).parquet(f"{base}/{kind}")


def accepted(spark: SparkSession, base: str, kind: str) -> DataFrame:
    return _settled(spark, base, kind).filter("accepted").drop("violations", "payload", "accepted")


def quarantined(spark: SparkSession, base: str, kind: str) -> DataFrame:
    return _settled(spark, base, kind).filter("NOT accepted").select("violations", "payload")
