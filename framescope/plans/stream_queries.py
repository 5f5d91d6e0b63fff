"""Registered queries: streaming (ST). Each stream runs once over all available data."""

import uuid

from pyspark.sql import functions as F

from framescope.plans import adapters
from framescope.plans.frame_queries import HEADERS, event_headers
from framescope.plans.registry import check
from framescope.plans.source_queries import DUMPED, dump_texts
from framescope.sources import tables
from framescope.streaming import activity, frames


#: Dumps of one file that arrives; a packed file is read by one task.
FILE_DUMPS = 10_000


def _folder(spark):
    return f"{tables.shared_folder(spark)}/framescope-{uuid.uuid4().hex}"


@check(
    "st1_stream_frames",
    f"WITH {DUMPED} SELECT 'order' || k AS capture_id, CAST(n AS BIGINT) AS position, CAST(10 + 3 * n AS BIGINT) AS frame_index, CASE WHEN k % 5 <> 0 THEN c / 8 END AS frame_time_ms, (k + n) * 2 AS bytes FROM fd",
)
def stream_frames(spark, sf):
    base = _folder(spark)
    dump_texts(spark, sf).select("json").write.options(**tables.PACKED_TEXT, maxRecordsPerFile=FILE_DUMPS).text(f"{base}/in")
    query = frames.stream_frames(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", multi_line=False)
    query.awaitTermination()
    rows = spark.read.schema("capture_id STRING, position BIGINT, frame_index BIGINT, frame_time_ms DOUBLE, gc_alloc_bytes_total DECIMAL(20,0)").parquet(f"{base}/out")
    return rows.select("capture_id", "position", "frame_index", "frame_time_ms", F.col("gc_alloc_bytes_total").cast("bigint").alias("bytes"))


@check(
    "st2_stream_intervals",
    f"""WITH {HEADERS}, nx AS (SELECT *, lead(raw_frame_id) OVER w AS nid, lead(start_ns) OVER w AS ns, lead(skipped) OVER w AS nsk FROM hd WINDOW w AS (PARTITION BY capture_id ORDER BY frame_index))
    SELECT capture_id, frame_index,
      CASE WHEN NOT skipped AND NOT nsk AND nid = raw_frame_id + 1 AND ns >= start_ns THEN CAST(CAST(ns - start_ns AS FLOAT) * CAST(1e-6 AS FLOAT) AS DOUBLE) END AS frame_ms,
      CASE WHEN skipped THEN 'frame not recorded' WHEN nsk THEN 'no next frame start' WHEN nid <> raw_frame_id + 1 THEN 'raw frame ids not consecutive' WHEN ns < start_ns THEN 'frame start goes back' END AS reason
    FROM nx WHERE nid IS NOT NULL""",
)
def stream_intervals(spark, sf):
    """The interval of each recording's last frame stays open in a stream."""
    base = _folder(spark)
    headers = event_headers(spark, sf)
    headers.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(headers.schema).parquet(f"{base}/in")
    query = (
        frames.stream_intervals(stream).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(frames.INTERVALS).parquet(f"{base}/out")


LOG_SQL = """l AS (SELECT conv_id, turn, strlen(text) + 1 AS row_bytes FROM conversations),
  st AS (SELECT *, coalesce(sum(row_bytes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
  vd AS (SELECT *, CASE WHEN s + row_bytes >= 3000 THEN 'beyond_cap' WHEN conv_id % 13 = 0 AND turn = 2 THEN 'out_of_order' ELSE 'kept' END AS verdict FROM st)"""


def conversation_log(spark, sf):
    """Turns as log rows of known length; one row of some logs claims a wrong offset."""
    turns = adapters.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("log_id"), F.col("turn").alias("line_no"), (F.octet_length("text") + 1).cast("bigint").alias("row_bytes")
    )
    from framescope.functions.windows import running

    placed = running(turns, ["log_id"], ["line_no"], {"at": ("sum", F.col("row_bytes"))})
    wrong = F.when((F.col("log_id") % 13 == 0) & (F.col("line_no") == 2), 1).otherwise(0)
    return placed.withColumn("sequence", F.col("at") + wrong).drop("at")


@check("st3_activity_log", f"WITH {LOG_SQL} SELECT conv_id AS log_id, turn AS line_no, CAST(s AS BIGINT) AS start, CAST(s + row_bytes AS BIGINT) AS next_cursor, verdict FROM vd")
def activity_log(spark, sf):
    return activity.checked_log(conversation_log(spark, sf), cap=3000).select("log_id", "line_no", "start", "next_cursor", "verdict")


PAGE_SQL = f"""{LOG_SQL}, cu AS (SELECT conv_id, max(CASE WHEN turn = 1 THEN s END) AS cursor FROM vd WHERE verdict <> 'beyond_cap' GROUP BY 1),
    w AS (SELECT vd.*, cursor, row_number() OVER (PARTITION BY conv_id ORDER BY s) - 1 AS row_pos FROM vd JOIN cu USING (conv_id) WHERE verdict <> 'beyond_cap' AND s >= cursor),
    r AS (SELECT *, coalesce(sum(row_bytes) OVER (PARTITION BY conv_id ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w WHERE row_pos < 4),
    g AS (SELECT *, bool_or(verdict = 'out_of_order') OVER (PARTITION BY conv_id) AS broken FROM r WHERE before < 700)"""


def _cursors(checked):
    return checked.filter("line_no = 1 AND verdict <> 'beyond_cap'").select("log_id", F.col("start").alias("cursor"))


@check("st3_activity_page", f"WITH {PAGE_SQL} SELECT conv_id AS log_id, turn AS line_no, row_pos, CAST(s + row_bytes AS BIGINT) AS next_cursor FROM g WHERE NOT broken")
def activity_page(spark, sf):
    checked = activity.checked_log(conversation_log(spark, sf), cap=3000)
    return activity.log_page(checked, _cursors(checked), rows=4, size=700).select("log_id", "line_no", "row_pos", "next_cursor")


@check(
    "st3_page_states",
    f"""WITH {PAGE_SQL}, e AS (SELECT conv_id, coalesce(max(s + row_bytes) FILTER (verdict <> 'beyond_cap'), 0) AS stored, bool_or(verdict = 'beyond_cap') AS limited FROM vd GROUP BY 1),
    p AS (SELECT conv_id, max(s + row_bytes) AS read_to, bool_or(broken) AS broken FROM g GROUP BY 1)
    SELECT conv_id AS log_id, CASE WHEN broken THEN 'order_broken' ELSE 'ok' END AS status, CAST(CASE WHEN NOT broken THEN read_to END AS BIGINT) AS next_cursor,
      NOT broken AND read_to < stored AS has_more, limited FROM cu JOIN e USING (conv_id) JOIN p USING (conv_id) WHERE cursor IS NOT NULL""",
)
def page_states(spark, sf):
    checked = activity.checked_log(conversation_log(spark, sf), cap=3000)
    return activity.page_states(checked, _cursors(checked), rows=4, size=700)
