"""Registered queries: ranking and paging (Q)."""

from pyspark.sql import functions as F

from framescope.operators import metrics, ranking
from framescope.plans import adapters, inputs

from framescope.plans.metric_queries import CPU_MARKERS, MEMORY, STATS_SQL, memory_rows
from framescope.plans.oracle import FRAMES, SAMPLES, frames_without_flaws, ranks
from framescope.plans.registry import check
from framescope.schemas import FRAME, SAMPLE, THREAD


def cpu_quality(spark, sf):
    return metrics.quality(inputs.frames(spark, sf), F.col("samples_valid"))


def cpu_hot(spark, sf):
    return metrics.cpu_hotspots(inputs.markers(spark, sf), inputs.frames(spark, sf))


@check(
    "q1_hotspots_page",
    f"""WITH {CPU_MARKERS}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY total_ms DESC, name) - 1 AS rank, count(*) OVER (PARTITION BY capture_id) AS total FROM cpu_hot)
    SELECT *, CASE WHEN total > 15 THEN CAST(15 AS BIGINT) END AS next_start, 'partial' AS status FROM r WHERE rank BETWEEN 5 AND 14""",
)
def hotspots_page(spark, sf):
    return ranking.hotspots_page(cpu_hot(spark, sf), cpu_quality(spark, sf), "cpu", start=5, limit=10)


NAMES = ["GC.Alloc", "Update.Brand#13", "ECONOMY", "No Such Marker"]


@check(
    "q2_target_hotspots",
    f"""WITH {CPU_MARKERS}, s AS (SELECT capture_id, count(*) AS scanned FROM cpu_hot GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY total_ms DESC, name) - 1 AS rank, count(*) OVER (PARTITION BY capture_id) AS total
          FROM cpu_hot WHERE name IN {tuple(NAMES)}), n AS (SELECT unnest({NAMES}) AS name)
    SELECT capture_id, n.name, rank, total_ms, total, scanned, rank IS NOT NULL AS observed FROM s CROSS JOIN n LEFT JOIN r USING (capture_id, name)""",
)
def target_hotspots(spark, sf):
    found = ranking.target_hotspots(cpu_hot(spark, sf), cpu_quality(spark, sf), "cpu", NAMES)
    return found.select("capture_id", "name", "rank", "total_ms", "total", "scanned", "observed")


@check(
    "q3_frames_page",
    f"""WITH {FRAMES}, t AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS total FROM fr)
    SELECT capture_id, position, frame_index, cpu_ms AS ms, gc_bytes AS gc_alloc_bytes, total, CASE WHEN total > 600 THEN CAST(600 AS BIGINT) END AS next_start FROM t WHERE position BETWEEN 100 AND 599""",
)
def frames_page(spark, sf):
    rows = ranking.frames_page(metrics.timeline(inputs.frames(spark, sf)), start=100, limit=500)
    return rows.select("capture_id", "position", "frame_index", "ms", F.col("gc_alloc_bytes").cast("bigint").alias("gc_alloc_bytes"), "total", "next_start")


@check(
    "q4_frame_threads",
    f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame_index ORDER BY thread_index) - 1 AS row_pos, count(*) OVER (PARTITION BY capture_id, frame_index) AS total FROM thr)
    SELECT capture_id, frame_index, thread_index, CAST(thread_id AS VARCHAR) AS thread_id, thread_name, sample_count, row_pos, total, CASE WHEN total > 1 THEN CAST(1 AS BIGINT) END AS next_start FROM r WHERE row_pos < 1""",
)
def frame_threads(spark, sf):
    rows = ranking.frame_threads(inputs.threads(spark, sf), 0, 1)
    return rows.select(*THREAD, F.col("thread_id").cast("string").alias("thread_id"), "thread_name", "sample_count", "row_pos", "total", "next_start")


@check(
    "q5_hierarchy",
    f"""WITH {SAMPLES}, cut AS (SELECT capture_id, frame_index, thread_index, bool_or(depth >= 2) AS depth_truncated FROM smp GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame_index, thread_index ORDER BY sample_index) - 1 AS row_pos FROM smp WHERE sample_index >= 1 AND depth < 2),
    x AS (SELECT *, max(CASE WHEN row_pos = 3 THEN sample_index END) OVER (PARTITION BY capture_id, frame_index, thread_index) AS next_start FROM s)
    SELECT x.capture_id, x.frame_index, x.thread_index, x.sample_index, x.row_pos, x.marker_name, CAST(x.depth AS INTEGER) AS depth, x.self_ms, x.next_start, cut.depth_truncated,
      concat_ws('; ', CASE WHEN depth_truncated THEN '{ranking.DEPTH_WARNING}' END, CASE WHEN next_start IS NOT NULL THEN '{ranking.PAGE_WARNING}' END) AS warnings
    FROM x JOIN cut USING (capture_id, frame_index, thread_index) WHERE row_pos < 3""",
)
def hierarchy(spark, sf):
    rows = ranking.hierarchy(inputs.timed_tree(spark, sf), start=1, limit=3, max_depth=2)
    return rows.select(*SAMPLE, "row_pos", "marker_name", "depth", "self_ms", "next_start", "depth_truncated", F.concat_ws("; ", "warnings").alias("warnings"))


@check(
    "q6_evidence",
    f"""WITH {SAMPLES}, e AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame_index ORDER BY thread_index, sample_index) - 1 AS row_pos, count(*) OVER (PARTITION BY capture_id, frame_index) AS total
      FROM smp WHERE metadata_count > 0)
    SELECT capture_id, frame_index, thread_index, sample_index, row_pos, total, CASE WHEN total > 3 THEN CAST(3 AS BIGINT) END AS next_start, thread_name AS thread, marker_name AS marker,
      CAST(metadata_count AS BIGINT) AS metadata_count, CASE WHEN supp % 4 = 0 THEN '' ELSE 'size=' || bytes || ' bytes' END AS metadata, supp % 4 = 0 AS metadata_truncated,
      CASE WHEN supp % 4 = 0 THEN 'no general metadata payload in the input' END AS metadata_reason
    FROM e WHERE row_pos < 3""",
)
def evidence(spark, sf):
    """One field per sample; the fields of every fourth supplier have lost their sample."""
    samples = inputs.samples(spark, sf)
    owner = F.when(F.col("marker_id") % 4 != 0, F.col("sample_index")).alias("sample_index")
    fields = samples.filter(F.col("metadata_count") > 0).select(
        *THREAD, owner, F.lit(0).alias("field_index"), F.lit("size").alias("field_name"), F.lit(4).alias("payload_type"),
        F.col("gc_alloc_bytes").cast("string").alias("value"), F.lit("bytes").alias("unit"), F.lit("typed").alias("status"),
    )
    rows = ranking.evidence(samples, inputs.threads(spark, sf), fields, limit=3)
    shown = F.transform(F.coalesce("metadata", F.array()), lambda m: F.concat(m["field_name"], F.lit("="), m["value"], F.lit(" "), m["unit"]))
    return rows.select(
        *SAMPLE, "row_pos", "total", "next_start", "thread", "marker", "metadata_count", F.array_join(shown, ",").alias("metadata"),
        "metadata_truncated", "metadata_reason",
    )


@check(
    "q7_flows",
    f"""WITH {SAMPLES}, w AS (SELECT DISTINCT capture_id, frame_index - frame_index % 8 AS win, frame_index, thread_index FROM smp),
    av AS (SELECT capture_id, win, bool_and(frame_index % 47 <> 0) AS available FROM w GROUP BY 1, 2),
    e AS (SELECT capture_id, frame_index - frame_index % 8 AS win, frame_index, thread_index, sample_index AS event_index, CASE WHEN supp % 9 = 0 THEN -1 ELSE sample_index END AS sid,
      supp AS flow_id, supp % 5 AS event_type, marker_name, time_ms FROM smp),
    r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, win ORDER BY frame_index, thread_index, event_index) - 1 AS row_pos FROM e),
    c AS (SELECT capture_id, win, count(*) AS total, count(*) FILTER (event_type = 0) AS begin_count, count(*) FILTER (event_type = 2) AS end_count, count(*) FILTER (event_type > 3) AS unknown_types FROM e GROUP BY 1, 2)
    SELECT av.capture_id, av.win AS "window", available, coalesce(total, 0) AS total, coalesce(begin_count, 0) AS begin_count, coalesce(end_count, 0) AS end_count, coalesce(unknown_types, 0) AS unknown_types,
      row_pos, frame_index, thread_index, event_index, flow_id, CASE event_type WHEN 0 THEN 'Begin' WHEN 1 THEN 'ParallelNext' WHEN 2 THEN 'End' WHEN 3 THEN 'Next' WHEN 4 THEN 'Unknown' END AS kind,
      CASE WHEN sid >= 0 THEN marker_name END AS marker, CASE WHEN sid >= 0 THEN time_ms END AS sample_ms
    FROM av LEFT JOIN c USING (capture_id, win) LEFT JOIN (SELECT * FROM r WHERE row_pos < 5) r USING (capture_id, win)""",
)
def flows(spark, sf):
    """All frames in windows of eight; threads of frames divisible by 47 do not vouch for their flow data."""
    window = F.col("frame_index") - F.col("frame_index") % 8
    samples = inputs.samples(spark, sf)
    supp = F.col("marker_id").cast("bigint")
    events = samples.select(
        *THREAD, window.alias("window"), F.col("sample_index").alias("event_index"),
        F.when(supp % 9 == 0, -1).otherwise(F.col("sample_index")).alias("sample_index"),
        supp.alias("flow_id"), (supp % 5).alias("event_type"),
    )
    threads = inputs.threads(spark, sf).withColumns({"window": window, "has_flow": F.col("frame_index") % 47 != 0})
    rows = ranking.flows(events, threads, samples, limit=5)
    return rows.select(
        "capture_id", "window", "available", "total", "begin_count", "end_count", "unknown_types", "row_pos", "frame_index",
        "thread_index", "event_index", "flow_id", "kind", "marker", "sample_ms",
    )


PATH_SQL = "CASE depth WHEN 0 THEN thread_name WHEN 1 THEN thread_name || ' > ' || head_name ELSE thread_name || ' > ' || head_name || ' > ' || marker_name END"


@check(
    "q8_compare_frames",
    f"""WITH {SAMPLES}, pt AS (SELECT capture_id, frame_index, {PATH_SQL} AS path, count(*) AS calls, sum(time_ms) AS ms, coalesce(sum(self_ms), 0) AS self_ms, count(self_ms) AS sv, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS gc
      FROM smp WHERE thread_index = 0 GROUP BY 1, 2, 3),
    mt AS (SELECT DISTINCT capture_id, frame_index FROM pt),
    pr AS (SELECT a.capture_id, a.frame_index, b.frame_index AS baseline_index FROM mt a JOIN mt b ON a.capture_id = b.capture_id AND b.frame_index = a.frame_index - 1),
    al AS (SELECT pr.*, pt.path, true AS now, calls, ms, self_ms, sv, gc FROM pr JOIN pt USING (capture_id, frame_index)
           UNION ALL SELECT pr.*, pt.path, false, calls, ms, self_ms, sv, gc FROM pr JOIN pt ON pt.capture_id = pr.capture_id AND pt.frame_index = pr.baseline_index),
    mg AS (SELECT capture_id, frame_index, baseline_index, path,
      coalesce(sum(calls) FILTER (now), 0) AS cc, coalesce(sum(calls) FILTER (NOT now), 0) AS bc, coalesce(sum(ms) FILTER (now), 0) AS cm, coalesce(sum(ms) FILTER (NOT now), 0) AS bm,
      coalesce(sum(self_ms) FILTER (now), 0) AS cs, coalesce(sum(self_ms) FILTER (NOT now), 0) AS bs, coalesce(sum(sv) FILTER (now), 0) AS cv, coalesce(sum(sv) FILTER (NOT now), 0) AS bv,
      coalesce(sum(gc) FILTER (now), 0) AS cg, coalesce(sum(gc) FILTER (NOT now), 0) AS bg FROM al GROUP BY 1, 2, 3, 4),
    rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame_index ORDER BY cm - bm DESC, path) - 1 AS row_pos, count(*) OVER (PARTITION BY capture_id, frame_index) AS total FROM mg)
    SELECT rk.capture_id, rk.frame_index, rk.baseline_index, path, row_pos, total, CASE WHEN total > 8 THEN CAST(8 AS BIGINT) END AS next_start, CAST(bc AS BIGINT) AS baseline_calls, CAST(cc AS BIGINT) AS current_calls,
      bm AS baseline_inclusive_ms, cm AS current_inclusive_ms, CASE WHEN bc > 0 THEN bm / bc END AS baseline_mean_ms, CASE WHEN cc > 0 THEN cm / cc END AS current_mean_ms,
      CASE WHEN bc = bv THEN bs END AS baseline_self_ms, CASE WHEN cc = cv THEN cs END AS current_self_ms, cm - bm AS inclusive_delta_ms, CAST(cc - bc AS BIGINT) AS calls_delta,
      CASE WHEN bc = bv AND cc = cv THEN cs - bs END AS self_delta_ms, CASE WHEN g.gc_valid AND h.gc_valid THEN CAST(cg - bg AS BIGINT) END AS gc_delta_bytes
    FROM rk JOIN gcv g USING (capture_id, frame_index) JOIN gcv h ON h.capture_id = rk.capture_id AND h.frame_index = rk.baseline_index WHERE row_pos < 8""",
)
def compare_frames(spark, sf):
    """Every frame against the one before it."""
    pairs = inputs.dump_frames(spark, sf).select(*FRAME, (F.col("frame_index") - 1).alias("baseline_index"))
    rows = ranking.compare_frames(
        inputs.timed_tree(spark, sf), inputs.threads(spark, sf), inputs.gc_flags(spark, sf), pairs, limit=8
    )
    return rows.drop("baseline_gc_bytes", "current_gc_bytes").withColumns(
        {"path": F.concat_ws(" > ", "path"), "gc_delta_bytes": F.col("gc_delta_bytes").cast("bigint")}
    )


@check(
    "q9_memory_page",
    f"""WITH {MEMORY}, p AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS total FROM ev)
    SELECT p.capture_id, p.frame_index, p.frame_index AS position, p.total, CASE WHEN p.total > 12 THEN CAST(12 AS BIGINT) END AS next_start,
      CAST(ob.v AS VARCHAR) AS value, CASE WHEN ob.frame_index IS NOT NULL AND ob.v IS NULL THEN 'invalid' END AS reason, m.peak, m.delta, m.valid_frames
    FROM p LEFT JOIN ob ON ob.capture_id = p.capture_id AND ob.frame_index = p.frame_index AND ob.name = 'GC Used Memory'
    JOIN msum m ON m.capture_id = p.capture_id AND m.name = 'GC Used Memory' WHERE p.frame_index BETWEEN 2 AND 11""",
)
def memory_page(spark, sf):
    observed = memory_rows(spark, sf).withColumn("reason", F.when(F.col("value").isNull(), F.lit("invalid")))
    frames = inputs.event_frames(spark, sf).withColumn("version_verified", F.lit(None).cast("boolean"))
    summary = metrics.memory_summary(frames, observed.select(*FRAME, "name", "value"))
    rows = ranking.memory_page(frames, observed, summary, "GC Used Memory", start=2, limit=10)
    return rows.select(
        *FRAME, "position", "total", "next_start", F.col("value").cast("string").alias("value"), "reason",
        F.col("peak").cast("string").alias("peak"), F.col("delta").cast("string").alias("delta"), "valid_frames",
    )


AREAS = "SELECT capture_id, frame_index, 'cpu' AS area, cpu_ms AS v FROM fr UNION ALL SELECT capture_id, frame_index, 'gc', CAST(gc_bytes AS DOUBLE) FROM fr UNION ALL SELECT capture_id, frame_index, 'rendering', CAST(draw_calls AS DOUBLE) FROM fr"


@check(
    "q10_analysis",
    f"""WITH {frames_without_flaws()}, ar AS ({AREAS}), st AS ({ranks('ar', 'capture_id, area')}),
    bd AS (SELECT * FROM (VALUES ('cpu', 16.67::DOUBLE, 'ms'), ('gc', 4194304::DOUBLE, 'bytes'), ('rendering', 1500::DOUBLE, 'count')) t(area, budget, unit)),
    ov AS (SELECT ar.*, row_number() OVER (PARTITION BY capture_id, area ORDER BY v DESC, frame_index) AS n FROM ar JOIN bd USING (area) WHERE v > budget),
    oc AS (SELECT capture_id, area, count(*) AS affected_frames, string_agg(frame_index || ':' || CAST(v AS BIGINT), ',' ORDER BY n) FILTER (n <= 5) AS evidence FROM ov GROUP BY 1, 2),
    vf AS (SELECT capture_id, count(*) AS valid_frames FROM fr GROUP BY 1)
    SELECT capture_id, area, 'medium' AS severity, 'threshold-exceeded' AS kind, p95, "max", budget, unit, 'dump-' || lower(capture_id) AS source,
      CASE WHEN p95 > budget THEN 'p95' ELSE 'isolated-peak' END AS trigger, affected_frames, valid_frames, evidence
    FROM st JOIN bd USING (area) LEFT JOIN oc USING (capture_id, area) JOIN vf USING (capture_id) WHERE CASE WHEN area = 'rendering' THEN p95 ELSE "max" END > budget""",
)
def analysis(spark, sf):
    issues = ranking.analysis(inputs.full_frames(spark, sf))
    shown = F.transform("evidence_frames", lambda e: F.concat_ws(":", e["frame_index"], e["value"].cast("bigint")))
    return issues.withColumn("evidence", F.array_join(shown, ",")).drop("evidence_frames")


@check(
    "q11_investigation_frames",
    f"""WITH {FRAMES}, ar AS ({AREAS}), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, area ORDER BY v DESC, frame_index) - 1 AS rank FROM ar WHERE v IS NOT NULL)
    SELECT capture_id, area, rank, frame_index, v AS value FROM r WHERE rank < 3""",
)
def investigation_frames(spark, sf):
    return ranking.investigation_frames(inputs.frames(spark, sf))


@check(
    "q12_slow_frames",
    f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY cpu_ms DESC, frame_index) - 1 AS rank FROM fr WHERE cpu_ms IS NOT NULL)
    SELECT capture_id, rank, frame_index, cpu_ms AS value FROM r WHERE rank < 20""",
)
def slow_frames(spark, sf):
    return ranking.slow_frames(inputs.frames(spark, sf))


@check(
    "q13_bounded_page",
    """WITH j AS (SELECT conv_id, turn, strlen(CAST(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}) AS VARCHAR)) AS row_bytes,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_pos, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
    p AS (SELECT *, CAST(sum(row_bytes) OVER (PARTITION BY conv_id ORDER BY row_pos) AS BIGINT) AS page_bytes FROM j WHERE row_pos < 50),
    k AS (SELECT *, max(row_pos) OVER (PARTITION BY conv_id) + 1 AS stop FROM p WHERE page_bytes <= 900 OR row_pos = 0)
    SELECT conv_id, turn, row_pos, row_bytes, page_bytes, total, row_bytes > 900 AS page_error, CASE WHEN stop < total THEN stop END AS next_start FROM k""",
)
def bounded_page(spark, sf):
    turns = adapters.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return ranking.bounded_page(turns, ["conv_id"], ["turn"], budget=900).drop("role", "text")


SEMANTICS_SQL = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{t}' AS meaning" for m, t in ranking.METRIC_SEMANTICS.items())


@check(
    "q14_metric_semantics",
    f"WITH {FRAMES}, {STATS_SQL}, sem AS ({SEMANTICS_SQL}) SELECT capture_id, metric, valid_frames, p95, meaning, '{ranking.PERCENTILE_METHOD}' AS percentile_method FROM mstat JOIN sem USING (metric)",
)
def metric_semantics(spark, sf):
    rows = ranking.with_metric_semantics(metrics.metric_stats(inputs.frames(spark, sf)))
    return rows.select("capture_id", "metric", "valid_frames", "p95", "meaning", "percentile_method")


