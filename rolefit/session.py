"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's settings hold."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("rolefit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# fixed values: Spark's setting, and the size in bytes from which the JVM only interprets a method
METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def prepare(spark: SparkSession, explained: bool = True) -> None:
    """Setting for explanations, taken back for other work.

    All steps of a stage are generated as one method. The rules of an explanation make it longer than what the JVM
    compiles, so that it is interpreted for each row; above this limit Spark generates each projection in short methods.
    Spark reads the setting when the table is computed.
    """
    if explained and int(spark.conf.get(METHOD_LIMIT)) > COMPILED_BYTES:
        spark.conf.set(METHOD_LIMIT, str(COMPILED_BYTES))
    elif not explained and spark.conf.get(METHOD_LIMIT) == str(COMPILED_BYTES):
        spark.conf.unset(METHOD_LIMIT)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, from spark.checkpoint.dir.

    Only a local master, where driver and executors are one process, gets a
    temporary folder when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="rolefit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table that several steps read to the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over all tasks, by keys that differ from row to row, before work that is heavy for each row.

    A file is read by one task for each of its row groups, which may be one or two for all its texts. The number of
    tasks is given, since by size AQE would join them into few again.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input.

    The planner goes by the size of files, in which repeated texts take next to no room, and so would collect a whole
    table in the driver to broadcast it.
    """
    return left.hint("merge").join(right, on, how)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, with the number of rows as observed while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return table, seen.get["rows"]
