"""Versioned datasets: one folder (partition) per run, latest-version scans."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolefit.functions import text as X
from rolefit.operators.features import JOB_INPUT, column_or_null

RUN_TS_FORMAT = "%Y-%m-%dT%H-%M-%S"
TEXT_FORMATS = ("csv", "json")


def run_timestamps(now: datetime | None = None) -> tuple[str, str]:
    """ISO text for the rows and the sortable name of the run."""
    now = now or datetime.now(timezone.utc)
    return now.isoformat(), now.strftime(RUN_TS_FORMAT)


def _csv_options(writer_or_reader):
    return (writer_or_reader.option("header", True).option("multiLine", True)
            .option("escape", '"').option("encoding", "UTF-8"))


def run_folder(base: str, run_ts: str) -> str:
    return f"{base.rstrip('/')}/run_ts={run_ts}"


def write_version(df: DataFrame, base: str, run_ts: str, fmt: str = "parquet") -> None:
    """Write one run of a dataset; a run of the same name is replaced. CSV cannot
    hold lists, so they become JSON text."""
    out = df
    if fmt == "csv":
        lists = [n for n, kind in df.dtypes if kind.startswith("array")]
        out = out.withColumns({n: X.list_to_json(F.col(n)) for n in lists})
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.format(fmt).save(run_folder(base, run_ts))


def read_run(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Rows below one folder. Text formats need a schema; nothing is inferred from the data."""
    reader = spark.read
    if fmt in TEXT_FORMATS:
        if schema is None:
            raise ValueError("a text dataset needs a schema")
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = _csv_options(reader)
    return reader.format(fmt).load(path)


def finished_runs(spark: SparkSession, base: str) -> list[str]:
    """Names of the runs whose writing has ended, oldest first; only listings are read."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath().getName() for f in store.listStatus(jvm_path) if f.isDirectory()]
    names = [n.removeprefix("run_ts=") for n in folders if n.startswith("run_ts=")]
    return sorted(n for n in names if _exists(spark, f"{run_folder(base, n)}/_SUCCESS"))


def read_latest(spark: SparkSession, base: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Rows of the last finished run by name; no other folder is opened."""
    runs = finished_runs(spark, base)
    if not runs:
        raise FileNotFoundError(f"no finished run under {base}")
    return read_run(spark, run_folder(base, runs[-1]), fmt, schema)


def newest_dataset(spark: SparkSession, folders: list[str], custom_path: str | None = None,
                   pattern: str = "*.parquet") -> str:
    """Folder holding the most recently modified data file, or the explicit path.

    Only file listings are read, never contents; one row reaches the driver.
    """
    if custom_path is not None:
        folders = [custom_path]
    present = [f for f in folders if _exists(spark, f)]
    if not present:
        raise FileNotFoundError(f"no jobs dataset under {', '.join(folders)}")
    if custom_path is not None:
        return custom_path
    listings = [
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
        for folder in present
    ]
    files = listings[0]
    for other in listings[1:]:
        files = files.unionByName(other)
    newest = files.select(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no jobs dataset under {', '.join(folders)}")
    return newest.rsplit("/", 1)[0]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


# --- match-ready jobs ----------------------------------------------------------------

def _first_given(df: DataFrame, *names: str) -> Column:
    found = [X.nullif_blank(X.strip(F.col(n).cast("string"))) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def _cell_items(df: DataFrame, *names: str) -> Column:
    types = dict(df.dtypes)

    def items(name):
        if types[name].startswith("array"):
            stripped = F.transform(F.col(name), X.strip)
            return F.filter(stripped, lambda v: v != "")
        return F.when(F.col(name).isNotNull(), X.cell_list(F.col(name)))

    found = [items(n) for n in names if n in types]
    return F.coalesce(*found, X.empty_strings())


def match_ready(df: DataFrame) -> DataFrame:
    """Any jobs table to the columns matching needs; rows without id or title go.

    Alternative column names are tried in order. For years, education and
    seniority the first column that exists decides, even where it is empty.
    Files have no row order: a table without ``ord`` is numbered as it is read
    (unique, though not dense), so it has to be written before it is read twice.
    """
    def column_that_exists(*names):
        return column_or_null(df, next((n for n in names if n in df.columns), names[0]))

    job_id = _first_given(df, "job_id", "job_uid")
    order = F.col("ord") if "ord" in df.columns else F.monotonically_increasing_id()
    years = column_that_exists("years_experience_required", "years_experience_extracted")
    edu = column_that_exists("education_required", "education_extracted").cast("string")
    sen = column_that_exists("seniority", "seniority_inferred").cast("string")
    out = df.select(
        order.alias("ord"),
        job_id.alias("job_id"),
        _first_given(df, "title", "title_raw", "title_normalized").alias("title"),
        _first_given(df, "company", "source_company").alias("company"),
        _first_given(df, "location", "location_normalized", "location_raw").alias("location"),
        _first_given(df, "workplace_type").alias("workplace_type"),
        _cell_items(df, "domains").alias("domains"),
        _cell_items(df, "required_skills").alias("required_skills"),
        _cell_items(df, "preferred_skills").alias("preferred_skills"),
        _cell_items(df, "other_skills", "other_skills_found").alias("other_skills"),
        years.try_cast("double").try_cast("bigint").alias("years_experience_required"),
        X.nullif_blank(X.strip(edu)).alias("education_required"),
        X.nullif_blank(X.strip(sen)).alias("seniority"),
    )
    assert set(JOB_INPUT.names) <= set(out.columns)
    return out.filter((F.col("job_id") != "") & (F.col("title") != ""))


def preview(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """First jobs in input order (1 to 500), bad rows already dropped."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    return jobs.orderBy("ord").limit(limit)
