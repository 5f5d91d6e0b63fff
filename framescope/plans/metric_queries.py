"""Registered queries: per-recording metrics (M)."""

from pyspark.sql import functions as F

from framescope.functions.scalars import choose
from framescope.operators import metrics as ops
from framescope.plans import inputs
from framescope.plans.frame_queries import EVENTS, RENDER, SITES
from framescope.plans.oracle import FRAMES, SAMPLES, ranks
from framescope.plans.registry import check
from framescope.schemas import COMPARED_METRICS, FRAME, MEMORY_COUNTERS, RENDER_COUNTERS

RENDER_COLUMNS = dict(zip(RENDER_COUNTERS, ["draw_calls", "set_pass_calls", "batches", "triangles", "vertices"]))


def text(column: str):
    return F.concat_ws("; ", column).alias(column)


@check("m1_rank_stats", f"WITH {FRAMES}, vals AS (SELECT capture_id, cpu_ms AS v FROM fr) {ranks('vals', 'capture_id')}")
def rank_stats(spark, sf):
    return ops.metric_rank_stats(inputs.frames(spark, sf), "cpu_ms")


def quality_sql(valid: str, reasons: str, notes: str) -> str:
    """Quality per recording and shard (frame number modulo 30)."""
    return f"""WITH {FRAMES}, q AS (SELECT *, frame_index % 30 AS shard, {valid} AS ok FROM fr),
    s AS (SELECT capture_id, shard, count(*) FILTER (ok) AS valid_frames, count(*) AS total_frames,
      bool_or(version_verified IS NOT DISTINCT FROM false) AS unv, bool_or(ok AND estimated) AS est, arg_min(source, position) AS source FROM q GROUP BY 1, 2),
    r AS (SELECT DISTINCT capture_id, shard, unnest(list_filter([{reasons}], lambda x: x IS NOT NULL)) AS reason FROM q WHERE NOT ok),
    n AS (SELECT *, EXISTS (SELECT 1 FROM r WHERE r.capture_id = s.capture_id AND r.shard = s.shard) AS has FROM s),
    a AS (SELECT capture_id, shard, reason FROM r UNION SELECT capture_id, shard, unnest(list_filter([{notes}], lambda x: x IS NOT NULL)) FROM n)
    SELECT capture_id, shard, CASE WHEN valid_frames = 0 THEN 'unavailable' WHEN valid_frames < total_frames THEN 'partial'
      WHEN unv THEN 'unverified' WHEN est THEN 'estimated' ELSE 'available' END AS status, source, valid_frames, total_frames,
      coalesce((SELECT string_agg(reason, '; ' ORDER BY reason) FROM a WHERE a.capture_id = n.capture_id AND a.shard = n.shard AND reason_filter), '') AS reasons FROM n"""


REASONS = (
    "CASE WHEN frame_index % 6 = 0 THEN 'main thread missing, duplicated or root not unique' END, "
    "CASE WHEN frame_index % 7 = 0 THEN 'allocation total missing or inconsistent' END, "
    "CASE WHEN frame_index % 8 = 0 THEN 'Draw Calls Count: not recorded' END"
)
NOTES = (
    f"CASE WHEN valid_frames < total_frames AND NOT has THEN '{ops.DEFAULT_REASON}' END, "
    f"CASE WHEN unv THEN '{ops.UNVERIFIED_REASON}' END, CASE WHEN est THEN '{ops.ESTIMATED_REASON}' END"
)


@check("m2_quality", quality_sql("frame_ms IS NOT NULL", REASONS, NOTES).replace("AND reason_filter", ""))
def quality(spark, sf):
    frames = inputs.frames(spark, sf).withColumn("shard", F.col("frame_index") % 30)
    found = ops.quality(frames, F.col("frame_ms").isNotNull(), ["capture_id", "shard"])
    return found.withColumn("reasons", F.concat_ws("; ", "reasons"))


M3_NOTE = f"CASE WHEN valid_frames < total_frames AND NOT has THEN 'Draw Calls Count: no valid count in the input' END, CASE WHEN est THEN '{ops.ESTIMATED_REASON}' END"
M3_REASONS = "CASE WHEN frame_index % 8 = 0 AND frame_index % 16 <> 0 THEN 'Draw Calls Count: not recorded' END"


@check(
    "m3_counter_quality",
    quality_sql("draw_calls IS NOT NULL", M3_REASONS, M3_NOTE)
    .replace("AND NOT has THEN", "AND NOT has AND NOT est THEN")
    .replace("AND reason_filter", ""),
)
def counter_quality(spark, sf):
    frames = inputs.frames(spark, sf).withColumn("shard", F.col("frame_index") % 30)
    other = F.when(F.col("frame_index") % 16 == 0, F.filter("reasons", lambda r: ~r.startswith("Draw"))).otherwise(F.col("reasons"))
    found = ops.counter_quality(frames.withColumn("reasons", other), "Draw Calls Count", ["capture_id", "shard"])
    return found.withColumn("reasons", F.concat_ws("; ", "reasons"))


HOT = """SELECT capture_id, name, sum(total_ms) AS total_ms, CAST(sum(call_count) AS BIGINT) AS call_count, max(max_ms) AS max_ms,
  CASE WHEN sum(call_count) = 0 THEN 0 ELSE sum(total_ms) / sum(call_count) END AS avg_ms"""
CPU_MARKERS = f"""{SAMPLES}, mk AS (SELECT capture_id, frame_index, marker_name AS name, sum(time_ms) AS total_ms, count(*) AS call_count, max(time_ms) AS max_ms
  FROM smp WHERE thread_index = 0 AND frame_index % 6 <> 0 GROUP BY 1, 2, 3), cpu_hot AS ({HOT} FROM mk GROUP BY 1, 2)"""


@check("m4_cpu_hotspots", f"WITH {CPU_MARKERS} SELECT * FROM cpu_hot")
def cpu_hotspots(spark, sf):
    return ops.cpu_hotspots(inputs.markers(spark, sf), inputs.frames(spark, sf))


GC_HOT = f"""{SITES}, gc_hot AS (SELECT capture_id, thread, name, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(call_count) AS BIGINT) AS call_count,
  max(max_bytes) AS max_bytes, CAST(sum(total_bytes) AS DOUBLE) / sum(call_count) AS avg_bytes FROM fsite WHERE frame_index % 7 <> 0 GROUP BY 1, 2, 3)"""


def gc_hotspot_rows(spark, sf):
    hot = ops.gc_hotspots(inputs.sites(spark, sf), inputs.frames(spark, sf))
    return hot.withColumns({c: F.col(c).cast("bigint") for c in ("total_bytes", "max_bytes")})


@check("m5_gc_hotspots", f"WITH {GC_HOT} SELECT * FROM gc_hot")
def gc_hotspots(spark, sf):
    return gc_hotspot_rows(spark, sf)


@check("m6_render_hotspots", f"WITH {RENDER} {HOT} FROM rend GROUP BY 1, 2")
def render_hotspots(spark, sf):
    return ops.render_hotspots(inputs.render_markers(spark, sf), inputs.frames(spark, sf))


@check(
    "m7_gc_totals",
    f"""WITH {FRAMES}, vals AS (SELECT capture_id, CAST(gc_bytes AS DOUBLE) AS v FROM fr), rk AS ({ranks('vals', 'capture_id')}),
    t AS (SELECT capture_id, CAST(sum(gc_bytes) AS BIGINT) AS total_alloc_bytes FROM fr GROUP BY 1)
    SELECT t.*, CAST(NULL AS BIGINT) AS gen0, CAST(NULL AS BIGINT) AS gen1, CAST(NULL AS BIGINT) AS gen2, p50, p95, p99, "max" FROM t LEFT JOIN rk USING (capture_id)""",
)
def gc_totals(spark, sf):
    found = ops.gc_totals(inputs.frames(spark, sf))
    return found.withColumn("total_alloc_bytes", F.col("total_alloc_bytes").cast("bigint"))


def unpivot(columns: dict[str, str], frames: str = "fr") -> str:
    return " UNION ALL ".join(
        f"SELECT capture_id, frame_index, estimated, version_verified, '{m}' AS metric, CAST({c} AS DOUBLE) AS v FROM {frames}" for m, c in columns.items()
    )


@check(
    "m8_render_stats",
    f"""WITH {FRAMES}, lg AS ({unpivot(RENDER_COLUMNS)}), rk AS ({ranks('lg', 'capture_id, metric')}),
    t AS (SELECT capture_id, metric, count(v) AS valid_frames, count(*) AS total_frames FROM lg GROUP BY 1, 2)
    SELECT t.*, p50, p95, p99, "max" FROM t LEFT JOIN rk USING (capture_id, metric)""",
)
def render_stats(spark, sf):
    return ops.render_stats(inputs.frames(spark, sf))


MEMORY_UNIT = 180_000_000_000_000_000
KIND_SQL = " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in zip(inputs.EVENT_KINDS, MEMORY_COUNTERS))
MEMORY = f"""{EVENTS}, ob AS (SELECT capture_id, frame_index, CASE event_type {KIND_SQL} END AS name,
    CASE WHEN k % 7 <> 0 THEN CAST(k AS HUGEINT) * {MEMORY_UNIT} END AS v FROM ev),
  msum AS (SELECT c.capture_id, c.name, total_frames, CAST(max(v) AS VARCHAR) AS peak,
    arg_max(frame_index, CAST(v AS HUGEINT) * 100000 + frame_index) FILTER (v IS NOT NULL) AS peak_frame,
    CAST(arg_min(v, frame_index) FILTER (v IS NOT NULL) AS VARCHAR) AS "first", CAST(arg_max(v, frame_index) FILTER (v IS NOT NULL) AS VARCHAR) AS "last",
    CAST(arg_max(v, frame_index) FILTER (v IS NOT NULL) - arg_min(v, frame_index) FILTER (v IS NOT NULL) AS VARCHAR) AS delta, count(v) AS valid_frames
  FROM (SELECT t.capture_id, total_frames, nm.name FROM (SELECT capture_id, count(*) AS total_frames FROM ev GROUP BY 1) t CROSS JOIN (SELECT unnest({MEMORY_COUNTERS}) AS name) nm) c
  LEFT JOIN ob ON ob.capture_id = c.capture_id AND ob.name = c.name GROUP BY 1, 2, 3)"""


def memory_rows(spark, sf):
    name = choose(F.col("event_type"), dict(zip(inputs.EVENT_KINDS, MEMORY_COUNTERS)))
    value = F.when(F.col("k") % 7 != 0, (F.col("k").cast("decimal(20,0)") * F.lit(MEMORY_UNIT)).cast("decimal(20,0)"))
    return inputs.event_frames(spark, sf).select(*FRAME, "position", name.alias("name"), value.alias("value"))


@check(
    "m9_memory_summary",
    f"""WITH {MEMORY} SELECT capture_id, name, peak, peak_frame, "first", "last", delta, valid_frames, total_frames,
    CASE WHEN valid_frames = 0 THEN 'unavailable' WHEN valid_frames < total_frames THEN 'partial' ELSE 'unverified' END AS status,
    'pending-editor-comparison' AS validation FROM msum""",
)
def memory_summary(spark, sf):
    rows = memory_rows(spark, sf)
    found = ops.memory_summary(inputs.event_frames(spark, sf), rows.select(*FRAME, "name", "value"))
    return found.withColumns({c: F.col(c).cast("string") for c in ("peak", "first", "last", "delta")})


@check(
    "m10_timeline",
    f"WITH {FRAMES} SELECT capture_id, position, frame_index, cpu_ms AS ms, frame_ms AS frame_time_ms, gc_bytes AS gc_alloc_bytes, draw_calls, set_pass_calls FROM fr",
)
def timeline(spark, sf):
    return ops.timeline(inputs.frames(spark, sf)).withColumn("gc_alloc_bytes", F.col("gc_alloc_bytes").cast("bigint"))


META = """meta AS (SELECT capture_id, sum(frame_ms) AS duration_ms, count(*) + CASE WHEN capture_id = 'O' THEN 3 ELSE 0 END AS declared_frame_count,
  count(*) AS frame_count, 'desktop' AS platform, CASE WHEN capture_id = 'O' THEN '6000.3.23f1' ELSE '6000.3.9f1' END AS version,
  arg_min(source, position) AS source FROM fr GROUP BY capture_id)"""


@check("m11_session_meta", f"WITH {FRAMES}, {META} SELECT * FROM meta")
def session_meta(spark, sf):
    return ops.session_meta(inputs.frames(spark, sf), inputs.captures(spark, sf))


def _summary_area(name: str, column: str) -> str:
    return f"""v_{name} AS (SELECT capture_id, CAST({column} AS DOUBLE) AS v FROM fr), rk_{name} AS ({ranks('v_' + name, 'capture_id')}),
    {name} AS (SELECT capture_id, count(v) AS valid_frames FROM v_{name} GROUP BY 1)"""


@check(
    "m12_session_summary",
    f"""WITH {CPU_MARKERS}, {GC_HOT.replace(SAMPLES + ',', '')}, {FRAMES}, {META}, {_summary_area('cpu', 'cpu_ms')}, {_summary_area('gc', 'gc_bytes')}, {_summary_area('rendering', 'draw_calls')},
    hc AS (SELECT capture_id, count(*) AS cpu_hotspots FROM cpu_hot GROUP BY 1), gh AS (SELECT capture_id, count(*) AS gc_hotspots FROM gc_hot GROUP BY 1)
    SELECT meta.*, rk_cpu.p95 AS cpu_p95, rk_gc.p95 AS gc_p95, rk_rendering.p95 AS rendering_p95, cpu.valid_frames AS cpu_valid, gc.valid_frames AS gc_valid,
      rendering.valid_frames AS rendering_valid, 'partial' AS cpu_status, cpu_hotspots, gc_hotspots
    FROM meta JOIN rk_cpu USING (capture_id) JOIN rk_gc USING (capture_id) JOIN rk_rendering USING (capture_id) JOIN cpu USING (capture_id)
    JOIN gc USING (capture_id) JOIN rendering USING (capture_id) JOIN hc USING (capture_id) JOIN gh USING (capture_id)""",
)
def session_summary(spark, sf):
    frames = inputs.frames(spark, sf)
    cpu = ops.cpu_hotspots(inputs.markers(spark, sf), frames).groupBy("capture_id").agg(F.count(F.lit(1)).alias("cpu_hotspots"))
    gc = ops.gc_hotspots(inputs.sites(spark, sf), frames).groupBy("capture_id").agg(F.count(F.lit(1)).alias("gc_hotspots"))
    full = ops.session_summary(frames, inputs.captures(spark, sf), cpu.join(gc, "capture_id", "full_outer"))
    areas = ("cpu", "gc", "rendering")
    return full.select(
        *ops.session_meta(frames, inputs.captures(spark, sf)).columns,
        *[F.col(f"{a}.p95").alias(f"{a}_p95") for a in areas],
        *[F.col(f"{a}.valid_frames").alias(f"{a}_valid") for a in areas],
        F.col("cpu.status").alias("cpu_status"),
        "cpu_hotspots",
        "gc_hotspots",
    )


@check(
    "m13_compact_descriptions",
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents)
    SELECT doc_id, CASE WHEN length(text) > 256 THEN left(text, 256) || '{ops.CUT_MARK}' ELSE text END AS text,
      array_to_string(list_transform(lines[1:5], lambda x: CASE WHEN length(x) > 256 THEN left(x, 256) || '{ops.CUT_MARK}' ELSE x END), chr(10)) AS reasons,
      CAST(len(lines) AS INTEGER) AS reasons_total, len(lines) > 5 AS reasons_truncated FROM d""",
)
def compact_descriptions(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.split("text", "\n").alias("reasons"))
    return ops.compact_descriptions(documents, ["reasons"], ["text"]).withColumn("reasons", F.array_join("reasons", "\n"))


STATS_SQL = f"""lg AS ({unpivot(COMPARED_METRICS)}), lv AS (SELECT *, CASE WHEN NOT estimated AND version_verified IS DISTINCT FROM false AND v >= 0 THEN v END AS w FROM lg),
  rk AS ({ranks('lv', 'capture_id, metric', 'w', ', avg(w) AS mean')}),
  tt AS (SELECT capture_id, metric, count(w) AS valid_frames, count(*) AS total_frames,
    count(*) FILTER (version_verified IS NOT DISTINCT FROM false) AS unverified_excluded, count(*) FILTER (estimated) AS estimated_excluded FROM lv GROUP BY 1, 2),
  mstat AS (SELECT tt.*, p50, p95, p99, "max", mean FROM tt LEFT JOIN rk USING (capture_id, metric))"""


@check("m14_metric_stats", f'WITH {FRAMES}, {STATS_SQL} SELECT * EXCLUDE (mean), round(mean, 6) AS mean FROM mstat')
def metric_stats(spark, sf):
    found = ops.metric_stats(inputs.frames(spark, sf))
    return found.withColumn("mean", F.round("mean", 6))
