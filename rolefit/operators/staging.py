"""Feed rows to one unified staging table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolefit.functions import text as X
from rolefit.operators.features import column_or_null
from rolefit.sources.feeds import FEED_A, FEED_B, MAX_BOARDS, ingestion_order

_LISTS = ["skills_required", "skills_preferred", "tools_required", "tools_preferred",
          "domains", "responsibilities"]

# fixed values: staging columns in order
STAGING_COLUMNS = [
    "job_uid", "source", "source_company", "source_job_id", "source_url", "ingested_at",
    "source_updated_at", "pipeline_version", "title_raw", "title_normalized", "job_family",
    "job_function", "seniority_level", "employment_type", "workplace_type", "location_raw",
    "location_normalized", "country", "region", "description_raw", "description_clean",
    "language", "description_hash", "dedupe_key", "department", "team", "skills_required",
    "skills_preferred", "tools_required", "tools_preferred", "domains", "responsibilities",
    "years_experience_min", "years_experience_preferred", "education_min", "certifications",
    "is_remote", "is_hybrid", "is_onsite", "metadata_raw",
]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def flatten_metadata(metadata: Column) -> Column:
    """Name/value entries to a JSON object: unnamed entries dropped, the last value
    of a repeated name kept, keys sorted."""
    named = F.filter(metadata, lambda m: m["name"] != "")
    # One posting's entries only; a later entry with the same name hides this one.
    last = F.filter(named, lambda m, i: ~F.exists(
        F.slice(named, i + 2, F.size(named)), lambda later: later["name"] == m["name"]))
    in_order = F.array_sort(last, lambda a, b: F.when(a["name"] < b["name"], -1)
                            .when(a["name"] > b["name"], 1).otherwise(0))
    return F.coalesce(F.to_json(F.map_from_entries(in_order), {"ignoreNullFields": "false"}),
                      F.lit("{}"))


def _staging(df: DataFrame, feed: str, given: dict[str, Column], ingested_at: str,
             pipeline_version: str, board_rank: Column | None) -> DataFrame:
    defaults: dict[str, Column] = {name: F.lit("") for name in STAGING_COLUMNS}
    defaults |= {name: X.empty_strings() for name in [*_LISTS, "certifications"]}
    defaults |= {name: F.lit(None).cast("int")
                 for name in ["years_experience_min", "years_experience_preferred"]}
    defaults |= {name: F.lit(False) for name in ["is_remote", "is_hybrid", "is_onsite"]}
    row_id = F.col("id").cast("string")
    common = {
        "job_uid": F.concat(F.lit(feed + "::"), F.col("board"), F.lit("::"),
                            F.coalesce(row_id, F.lit("None"))),
        "source": F.lit(feed),
        "source_company": F.col("board"),
        "source_job_id": _text(row_id),
        "ingested_at": F.lit(ingested_at),
        "pipeline_version": F.lit(pipeline_version),
    }
    columns = defaults | common | given
    if board_rank is None:
        if "board_rank" not in df.columns:
            df = with_board_rank(df)
        board_rank = F.col("board_rank")
    order = ingestion_order(feed, board_rank, F.col("pos"))
    return df.select(*[columns[n].alias(n) for n in STAGING_COLUMNS], order.alias("ord"))


def with_board_rank(rows: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Add ``board_rank``: the place of the board in the list of boards, else by name.

    The list is broadcast, since more than MAX_BOARDS boards are refused.

    ``boards`` has source_name and board_rank; boards it does not name follow by
    name. Only the distinct boards are numbered in one place, and these have to
    fit into the board part of ``ord``.
    """
    names = rows.select("board").distinct()
    listed = F.lit(None).cast("bigint")
    if boards is not None and "board_rank" in boards.columns:
        given = boards.groupBy(F.col("source_name").alias("board")).agg(F.min("board_rank").alias("listed"))
        names, listed = names.join(given, "board", "left"), F.col("listed")
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last(listed), "board")) - 1
    checked = F.when(rank < MAX_BOARDS, rank).otherwise(F.raise_error("too many boards"))
    return rows.join(F.broadcast(names.select("board", checked.alias("board_rank"))), "board", "left")


def stage_feed_a(df: DataFrame, ingested_at: str, pipeline_version: str,
                 board_rank: Column | None = None) -> DataFrame:
    """Feed A rows (with ``board`` and ``pos``) to staging columns."""
    return _staging(df, FEED_A, {
        "source_url": _text(F.col("absolute_url")),
        "source_updated_at": _text(F.col("updated_at")),
        "title_raw": _text(F.col("title")),
        "location_raw": _text(F.col("location.name")),
        "description_raw": _text(F.col("content")),
        "description_clean": X.html_to_text(_text(F.col("content"))),
        "department": _text(F.try_element_at("departments", F.lit(1))["name"]),
        "metadata_raw": flatten_metadata(F.col("metadata")),
    }, ingested_at, pipeline_version, board_rank)


def stage_feed_b(df: DataFrame, ingested_at: str, pipeline_version: str,
                 board_rank: Column | None = None) -> DataFrame:
    """Feed B rows (with ``board`` and ``pos``) to staging columns."""
    def category(name):
        return _text(F.col(f"categories.{name}"))

    parts = [X.nullif_blank(X.strip(F.col(c)))
             for c in ["descriptionPlain", "additionalPlain", "listsPlain"]]
    sorted_categories = F.struct(*[F.col(f"categories.{n}") for n in
                                   ["commitment", "department", "location", "team", "workplaceType"]])
    return _staging(df, FEED_B, {
        "source_url": _text(F.col("hostedUrl")),
        "source_updated_at": _text(F.col("createdAt")),
        "title_raw": _text(F.col("text")),
        "employment_type": category("commitment"),
        "workplace_type": category("workplaceType"),
        "location_raw": category("location"),
        "description_raw": _text(F.col("description")),
        "description_clean": F.concat_ws(" ", *parts),
        "department": category("department"),
        "team": category("team"),
        "metadata_raw": F.coalesce(F.to_json(sorted_categories), F.lit("{}")),
    }, ingested_at, pipeline_version, board_rank)


def postprocess(df: DataFrame) -> DataFrame:
    """Clean the staging texts and add normalised location, hashes and dedupe key."""
    cleaned = df.withColumns({
        "description_clean": X.clean_text(F.col("description_clean")),
        "source_url_key": X.clean_text(F.col("source_url")),
        "title_raw": X.clean_text(F.col("title_raw")),
        "location_normalized": X.normalize_location_text(F.col("location_raw")),
        "location_raw": X.clean_text(F.col("location_raw")),
    })
    return cleaned.withColumns({
        "description_hash": F.sha2("description_clean", 256),
        "dedupe_key": X.stable_hash(F.concat_ws("::", "title_raw", "source_url_key")),
    }).drop("source_url_key")


def unify(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed)
    return out


def run_summary(boards: DataFrame, raw: DataFrame, staged: DataFrame) -> DataFrame:
    """Fetched and normalised rows per feed and board; boards without rows stay.

    ``boards`` has source_type, source_name, raw_snapshot_path; ``raw`` has
    source_type, source_name; ``staged`` is the table before deduplication.
    """
    fetched = raw.groupBy("source_type", "source_name").agg(F.count("*").alias("records_fetched"))
    normalized = (
        staged.groupBy(F.col("source").alias("source_type"),
                       F.col("source_company").alias("source_name"))
        .agg(F.count("*").alias("records_normalized"))
    )
    on = ["source_type", "source_name"]
    return (
        boards.join(fetched, on, "left").join(normalized, on, "left")
        .select(*on,
                F.coalesce("records_fetched", F.lit(0)).alias("records_fetched"),
                F.coalesce("records_normalized", F.lit(0)).alias("records_normalized"),
                column_or_null(boards, "raw_snapshot_path").alias("raw_snapshot_path"))
    )
