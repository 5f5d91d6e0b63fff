"""ST3: append-only activity logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescope.functions.windows import page, running

LOG_LIMIT = 10 * 1024 * 1024
LOG_CAP = LOG_LIMIT - 4096
PAGE_ROWS, PAGE_BYTES = 100, 128 * 1024


def checked_log(log: DataFrame, cap: int = LOG_CAP) -> DataFrame:
    """Verdict on every row of each log: kept, out_of_order or beyond_cap.

    ``log``: log_id, line_no, sequence, row_bytes (with the line end).  Each
    row's ``sequence`` must be the byte offset where it starts; rows that would
    pass the cap are not kept.
    """
    placed = running(log, ["log_id"], ["line_no"], {"start": ("sum", F.col("row_bytes"))})
    verdict = (
        F.when(F.col("start") + F.col("row_bytes") >= cap, F.lit("beyond_cap"))
        .when(F.col("sequence") != F.col("start"), F.lit("out_of_order"))
        .otherwise(F.lit("kept"))
    )
    return placed.withColumns({"verdict": verdict, "next_cursor": F.col("start") + F.col("row_bytes")})


def _page_rows(checked: DataFrame, cursors: DataFrame, rows: int, size: int) -> DataFrame:
    """The stored rows each log's page reads, with whether the cursor fits and the order holds."""
    wanted = checked.filter("verdict <> 'beyond_cap'").join(cursors, "log_id").filter(F.col("start") >= F.col("cursor"))
    first = page(wanted, ["log_id"], ["start"], 0, rows)
    window = Window.partitionBy("log_id").orderBy("row_pos").rowsBetween(Window.unboundedPreceding, -1)
    read = first.withColumn("read_before", F.coalesce(F.sum("row_bytes").over(window), F.lit(0))).filter(F.col("read_before") < size)
    whole = Window.partitionBy("log_id")  # a page's rows
    boundary = F.min("start").over(whole) == F.col("cursor")
    broken = F.max((F.col("verdict") == "out_of_order").cast("int")).over(whole) == 1
    return read.withColumns({"boundary": boundary, "broken": broken}).drop("read_before")


def log_page(checked: DataFrame, cursors: DataFrame, rows: int = PAGE_ROWS, size: int = PAGE_BYTES) -> DataFrame:
    """One page per log from its cursor: at most 100 rows, and no further row once 128 KiB are read.

    ``cursors``: log_id, cursor.  A cursor that is not a row boundary, or a row of
    wrong sequence in the page, is an error: no rows (see ``page_states``).
    """
    found = _page_rows(checked, cursors, rows, size)
    return found.filter(F.col("boundary") & ~F.col("broken")).drop("boundary", "broken")


def page_states(checked: DataFrame, cursors: DataFrame, rows: int = PAGE_ROWS, size: int = PAGE_BYTES) -> DataFrame:
    """What each log's page ends with: ``status`` (ok, not_on_boundary, order_broken), ``next_cursor``, ``has_more``, ``limited``.

    ``limited``: rows beyond the cap were not kept.  A cursor at the log's end gives an empty, good page.
    """
    stored = F.col("verdict") != "beyond_cap"
    logs = checked.groupBy("log_id").agg(
        F.coalesce(F.max(F.when(stored, F.col("next_cursor"))), F.lit(0)).alias("stored_bytes"), F.bool_or(~stored).alias("limited")
    )
    pages = _page_rows(checked, cursors, rows, size).groupBy("log_id").agg(
        F.max("next_cursor").alias("read_to"), F.bool_and("boundary").alias("boundary"), F.bool_or("broken").alias("broken")
    )
    joined = cursors.join(logs, "log_id").join(pages, "log_id", "left")
    at_end = F.col("cursor").isin(0) | (F.col("cursor") == F.col("stored_bytes"))
    status = (
        F.when(~F.coalesce("boundary", at_end), F.lit("not_on_boundary"))
        .when(F.coalesce("broken", F.lit(False)), F.lit("order_broken"))
        .otherwise(F.lit("ok"))
    )
    good = F.col("status") == "ok"
    following = F.when(good, F.coalesce("read_to", "cursor"))
    return joined.withColumn("status", status).select(
        "log_id", "status", following.alias("next_cursor"), (good & F.col("read_to").isNotNull() & (following < F.col("stored_bytes"))).alias("has_more"), "limited",
    )


def stream_log(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """New lines of log files as rows; the checkpoint is the cursor."""
    lines = spark.readStream.text(folder)
    rows = lines.select(
        F.get_json_object("value", "$.runId").alias("log_id"),
        F.get_json_object("value", "$.sequence").cast("bigint").alias("sequence"),
        (F.octet_length("value") + 1).cast("bigint").alias("row_bytes"),
        F.get_json_object("value", "$.event").alias("event"),
    )
    return (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
