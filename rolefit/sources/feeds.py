"""Snapshots of the two posting feeds: schemas, readers and the raw sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rolefit.functions import text as X

# --- fixed values: feed names as they appear in ids ------------------------------
FEED_A = "greenhouse"
FEED_B = "lever"
FEED_RANK = {FEED_A: 0, FEED_B: 1}

FEED_A_ROW = (
    "id BIGINT, absolute_url STRING, updated_at STRING, title STRING, content STRING, "
    "location STRUCT<name: STRING>, metadata ARRAY<STRUCT<name: STRING, value: VARIANT>>, "
    "departments ARRAY<STRUCT<name: STRING>>, offices ARRAY<STRUCT<name: STRING>>"
)
FEED_B_ROW = (
    "id STRING, text STRING, hostedUrl STRING, createdAt BIGINT, description STRING, "
    "descriptionPlain STRING, additionalPlain STRING, listsPlain STRING, "
    "categories STRUCT<commitment: STRING, workplaceType: STRING, location: STRING, "
    "department: STRING, team: STRING>"
)
FEED_ROW = {FEED_A: FEED_A_ROW, FEED_B: FEED_B_ROW}
_TOP_LEVEL_KEY = {FEED_A: "jobs"}

# A payload position takes 40 bits, the upper 16 of them for the place of its file
# among those of the board; feed and board order stand above it.
_POS_BITS = 40
_ROW_BITS = 24
_BOARD_BITS = 20
MAX_BOARDS = 1 << _BOARD_BITS


def ingestion_order(feed: str, board_rank: Column, pos: Column) -> Column:
    """Feed, then board, then position in the payload, as one number."""
    board = board_rank.cast("bigint") + F.lit(FEED_RANK[feed] << _BOARD_BITS).cast("bigint")
    return F.shiftleft(board, _POS_BITS) + pos.cast("bigint")


def read_payloads(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Feed responses landed as files, named ``<feed>_<board>_jobs_raw_<run>.json`` or
    below a folder ``source_company=<board>``.

    Takes the response object (rows under a key, feed A only) as well as the
    bare list. One file is one response of one board, so the unit read by a
    task is what the feed itself delivers at once. Rows keep their position,
    and files of one board follow each other by path. That order comes from a
    join with the listing, whose files are not opened; no name meets the driver.
    A file that is no JSON has no rows.
    """
    row = FEED_ROW[feed]
    found = F.col("_metadata.file_path").alias("path")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", found)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(found)
    board = F.coalesce(X.nullif_blank(F.regexp_extract("path", "/source_company=([^/]+)/[^/]+", 1)),
                       F.regexp_extract("path", rf"/{feed}_([^/]+)_jobs_raw_[^/]*$", 1))
    order = Window.partitionBy("board").orderBy("path")
    placed = listing.withColumn("board", board).withColumn("place", F.row_number().over(order).cast("bigint") - 1)
    rows = F.from_json("value", f"ARRAY<STRUCT<{row}>>")
    if feed in _TOP_LEVEL_KEY:
        key = _TOP_LEVEL_KEY[feed]
        wrapped = F.from_json("value", f"STRUCT<{key}: ARRAY<STRUCT<{row}>>>")[key]
        rows = F.when(F.ltrim("value").startswith("{"), wrapped).otherwise(rows)
    # Outer, so that the planner does not parse every file twice to test for rows.
    read = (files.join(placed, "path").select("board", "place", F.posexplode_outer(rows).alias("pos", "row"))
            .filter(F.col("pos").isNotNull()))
    return read.select("board", (F.shiftleft("place", _ROW_BITS) + F.col("pos")).alias("pos"), "row.*")


def land_payloads(rows: DataFrame, path: str, feed: str, page_rows: int, wrapped: Column) -> None:
    """Rows as responses of at most ``page_rows`` rows of one board, a file each.

    ``wrapped`` says of a page whether it is a response object or a bare list
    (feed B knows only lists).
    """
    page = F.lpad(F.floor(F.col("pos") / page_rows).cast("string"), 12, "0")
    line = F.to_json(F.struct(*[c for c in rows.columns if c not in ("board", "pos")]))
    pages = (rows.select(F.col("board").alias("source_company"), page.alias("page"), F.struct("pos", line.alias("row")).alias("row"))
             .groupBy("source_company", "page").agg(F.sort_array(F.collect_list("row"))["row"].alias("rows")))
    body = F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))
    if feed in _TOP_LEVEL_KEY:
        body = F.when(wrapped, F.concat(F.lit(f'{{"{_TOP_LEVEL_KEY[feed]}":'), body, F.lit("}"))).otherwise(body)
    pages.select("source_company", "page", body.alias("value")).write.partitionBy("source_company", "page").text(path)


def raw_folder(base: str, feed: str, run_ts: str) -> str:
    return f"{base}/run_ts={run_ts}/source={feed}"


def write_raw_snapshot(rows: DataFrame, base: str, feed: str, run_ts: str) -> None:
    """Raw rows of one run as JSON lines, one folder per run, feed and board; a
    snapshot of the same run and feed is replaced.

    Lines split across readers. Rows are rebalanced by board, so that a run does
    not leave a file per board and task; a board with very many rows is still
    spread over several files. The position column keeps the payload order.
    """
    (rows.hint("rebalance", "board").withColumnRenamed("board", "source_company").write.mode("overwrite")
     .partitionBy("source_company").json(raw_folder(base, feed, run_ts)))


def read_raw_snapshot(spark: SparkSession, base: str, feed: str, run_ts: str) -> DataFrame:
    schema = f"pos BIGINT, {FEED_ROW[feed]}, source_company STRING"
    stored = spark.read.schema(schema).json(raw_folder(base, feed, run_ts))
    return stored.withColumnRenamed("source_company", "board")
