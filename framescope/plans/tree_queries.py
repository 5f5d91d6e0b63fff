"""Registered queries: call trees (T) and validation (V)."""

from pyspark.sql import functions as F

from framescope.operators import tree, validate
from framescope.plans import adapters, inputs
from framescope.plans.oracle import SAMPLES
from framescope.plans.registry import check
from framescope.schemas import FRAME, SAMPLE, THREAD
from framescope.sources.tables import materialize

KEY = "capture_id, frame_index, thread_index, sample_index"


@check("t1_parent_depth", f"WITH {SAMPLES} SELECT {KEY}, parent_index, CAST(depth AS INTEGER) AS depth FROM smp")
def parent_depth(spark, sf):
    rows = inputs.samples(spark, sf).select(*SAMPLE, "marker_name", "children_count")
    return tree.with_tree(rows, ("parent_index", "depth"), adapters.long_threads(spark, sf)).select(
        *SAMPLE, "parent_index", "depth"
    )


@check(
    "t2_attribute_alloc",
    f"""WITH {SAMPLES} SELECT {KEY},
    CASE WHEN depth = 2 AND p_size % 5 <> 0 THEN head_name ELSE thread_name END AS site_name, bytes
    FROM smp WHERE is_alloc""",
)
def attribute_alloc(spark, sf):
    found = tree.attribute_alloc(inputs.samples(spark, sf), long_threads=adapters.long_threads(spark, sf))
    return found.select(*SAMPLE, "site_name", F.col("gc_alloc_bytes").cast("bigint").alias("bytes"))


@check("t3_self_time", f"WITH {SAMPLES} SELECT {KEY}, self_ms, self_ms IS NULL AS has_reason FROM smp")
def self_time(spark, sf):
    timed = tree.self_time(inputs.tree(spark, sf))
    return timed.select(*SAMPLE, "self_ms", F.col("self_reason").isNotNull().alias("has_reason"))


@check(
    "t4_call_paths",
    f"""WITH {SAMPLES} SELECT {KEY}, CASE depth WHEN 0 THEN thread_name WHEN 1 THEN thread_name || ' > ' || head_name
    ELSE thread_name || ' > ' || head_name || ' > ' || marker_name END AS path, CAST(NULL AS VARCHAR) AS path_rule FROM smp""",
)
def call_paths(spark, sf):
    samples = inputs.samples(spark, sf).select(*SAMPLE, "marker_name", "children_count")
    rows = tree.call_paths(samples, long_threads=adapters.long_threads(spark, sf))
    return rows.select(*SAMPLE, F.concat_ws(" > ", "path").alias("path"), "path_rule")


@check(
    "t5_rollup_bytes",
    f"""WITH {SAMPLES}, headed AS (SELECT *, CASE WHEN depth = 2 THEN parent_index WHEN depth = 1 THEN sample_index END AS head FROM smp),
    heads AS (SELECT capture_id, frame_index, thread_index, head, sum(bytes) AS b FROM headed WHERE head IS NOT NULL GROUP BY ALL),
    whole AS (SELECT capture_id, frame_index, thread_index, sum(bytes) AS b FROM smp GROUP BY ALL)
    SELECT h.capture_id, h.frame_index, h.thread_index, h.sample_index,
      CAST(coalesce(CASE h.depth WHEN 0 THEN w.b WHEN 1 THEN g.b ELSE h.bytes END, 0) AS BIGINT) AS inclusive_bytes
    FROM headed h JOIN whole w USING (capture_id, frame_index, thread_index)
    LEFT JOIN heads g ON g.capture_id = h.capture_id AND g.frame_index = h.frame_index AND g.thread_index = h.thread_index AND g.head = h.head""",
)
def rollup_bytes(spark, sf):
    rows = tree.rollup_bytes(inputs.samples(spark, sf), long_threads=adapters.long_threads(spark, sf))
    return rows.select(*SAMPLE, F.col("inclusive_bytes").cast("bigint").alias("inclusive_bytes"))


BUCKET_SQL = {
    "rendering": "0", "scripts": "1", "physics": "5, 33", "animation": "6", "gc": "17", "vsync": "18", "ui": "4, 26, 27, 35",
}


@check(
    "t6_cpu_by_category",
    f"WITH {SAMPLES} SELECT capture_id, frame_index, "
    + ", ".join(f"coalesce(sum(CASE WHEN category_index IN ({ids}) THEN q END), 0) AS {b}_ms" for b, ids in BUCKET_SQL.items())
    + ", 0.0::DOUBLE AS others_ms FROM smp WHERE thread_index = 0 GROUP BY 1, 2",
)
def cpu_by_category(spark, sf):
    return tree.cpu_by_category(inputs.tree(spark, sf).filter("thread_index = 0"))


@check(
    "t7_select_thread",
    f"""WITH {SAMPLES}, m AS (SELECT capture_id, frame_index, count(*) FILTER (thread_name = 'Main Thread' OR frame_index % 19 = 0) AS k,
      min(thread_index) FILTER (thread_name = 'Main Thread' OR frame_index % 19 = 0) AS t FROM thr GROUP BY 1, 2)
    SELECT capture_id, frame_index, CASE WHEN k = 1 THEN t END AS thread_index,
      CASE WHEN k = 1 THEN 'ok' WHEN k = 0 THEN 'not_found' ELSE 'ambiguous' END AS status FROM m""",
)
def select_thread(spark, sf):
    renamed = F.when(F.col("frame_index") % 19 == 0, F.lit("Main Thread")).otherwise(F.col("thread_name"))
    threads = inputs.threads(spark, sf).withColumn("thread_name", renamed)
    return tree.select_thread(threads, inputs.dump_frames(spark, sf))


NO_PLACE = "CAST(NULL AS BIGINT)"


@check(
    "v1_duplicate_ids",
    f"""WITH {SAMPLES}
    SELECT capture_id, frame_index, {NO_PLACE} AS thread_index, {NO_PLACE} AS sample_index, 'duplicate_frame_index' AS rule FROM dfr WHERE frame_index % 50 = 0
    UNION ALL SELECT capture_id, frame_index, thread_index, {NO_PLACE}, 'duplicate_thread_index' FROM thr WHERE frame_index % 43 = 0
    UNION ALL SELECT capture_id, frame_index, {NO_PLACE}, {NO_PLACE}, 'duplicate_thread_id' FROM (
      SELECT capture_id, frame_index, CASE WHEN frame_index % 41 = 0 THEN 1000 ELSE thread_id END AS id, count(*) * (CASE WHEN frame_index % 43 = 0 THEN 2 ELSE 1 END) AS k
      FROM thr GROUP BY 1, 2, 3) WHERE k > 1""",
)
def duplicate_ids(spark, sf):
    frames = inputs.dump_frames(spark, sf).select(*FRAME)
    frames = frames.unionByName(frames.filter("frame_index % 50 = 0"))
    one_id = F.when(F.col("frame_index") % 41 == 0, F.lit(1000).cast("decimal(20,0)")).otherwise(F.col("thread_id"))
    threads = inputs.threads(spark, sf).select(*THREAD, one_id.alias("thread_id"))
    threads = threads.unionByName(threads.filter("frame_index % 43 = 0"))
    return validate.duplicate_ids(frames, threads)


@check(
    "v2_sample_positions",
    f"WITH {SAMPLES} SELECT capture_id, frame_index, thread_index, sample_index + 1 AS sample_index, 'sample_index' AS rule FROM smp WHERE supp % 53 = 0",
)
def sample_positions(spark, sf):
    supp = F.col("marker_id")
    rows = inputs.samples(spark, sf).withColumn("pos", F.col("sample_index"))
    shifted = F.col("sample_index") + F.when(supp % 53 == 0, 1).otherwise(0)
    return validate.sample_positions(rows.withColumn("sample_index", shifted))


@check(
    "v3_times",
    f"""WITH {SAMPLES} SELECT capture_id, frame_index, {NO_PLACE} AS thread_index, {NO_PLACE} AS sample_index, 'frame_time' AS rule FROM dfr WHERE frame_index % 37 = 0 AND frame_time_ms IS NOT NULL
    UNION ALL SELECT {KEY}, 'sample_time' FROM smp WHERE supp % 61 = 0 OR supp % 67 = 0 OR start_time_ms - CASE WHEN supp % 71 = 0 THEN 40 ELSE 0 END < 0""",
)
def times(spark, sf):
    frame_time = F.when(F.col("frame_index") % 37 == 0, -F.col("frame_time_ms")).otherwise(F.col("frame_time_ms"))
    supp = F.col("marker_id")
    time = F.when(supp % 61 == 0, F.lit(float("nan"))).when(supp % 67 == 0, F.lit(float("inf"))).otherwise(F.col("time_ms"))
    start = F.col("start_time_ms") - F.when(supp % 71 == 0, 40).otherwise(0)
    return validate.times(
        inputs.dump_frames(spark, sf).withColumn("frame_time_ms", frame_time),
        inputs.samples(spark, sf).withColumns({"time_ms": time, "start_time_ms": start}),
    )


@check(
    "v4_tree_closed",
    f"""WITH {SAMPLES}
    SELECT {KEY}, 'children_out_of_range' AS rule FROM smp WHERE frame_index % 29 = 0 AND sample_index = n - 1
    UNION ALL SELECT DISTINCT capture_id, frame_index, thread_index, {NO_PLACE}, 'tree_not_closed' FROM smp WHERE frame_index % 29 = 0""",
)
def tree_closed(spark, sf):
    """Frames divisible by 29 declare one child too many on the last sample of each thread."""
    rows = inputs.samples(spark, sf).select(*SAMPLE, "marker_name", "children_count")
    last = rows.groupBy(*THREAD).agg(F.max("sample_index").alias("last"))
    extra = F.when((F.col("frame_index") % 29 == 0) & (F.col("sample_index") == F.col("last")), 1).otherwise(0)
    broken = rows.join(last, THREAD).withColumn("children_count", F.col("children_count") + extra).drop("last")
    # both rules read the tree; it is rebuilt once
    found = materialize(tree.with_tree(broken, ("parent_index",), adapters.long_threads(spark, sf)).drop("marker_name"))
    return validate.tree_closed(found)


@check(
    "v5_sample_totals",
    f"WITH {SAMPLES} SELECT capture_id, frame_index, {NO_PLACE} AS thread_index, {NO_PLACE} AS sample_index, 'sample_count_total' AS rule FROM dfr WHERE n <> sample_count_total",
)
def sample_totals(spark, sf):
    return validate.sample_totals(inputs.dump_frames(spark, sf), inputs.threads(spark, sf))


@check(
    "v6_reconcile_gc",
    f"""WITH {SAMPLES} SELECT capture_id, frame_index, gc_valid, CASE WHEN gc_valid THEN bytes END AS gc_bytes,
    concat_ws('; ', CASE WHEN incomplete THEN 'allocation metadata missing' END,
      CASE WHEN thread_off OR incomplete_off THEN 'thread allocation total missing or inconsistent' END,
      CASE WHEN frame_off OR (incomplete AND bytes_recorded <> bytes) OR incomplete_frame_off THEN 'frame allocation total missing or inconsistent' END) AS reasons
    FROM (SELECT g.capture_id, g.frame_index, gc_valid, bytes, incomplete, thread_off, frame_off, t.off AS incomplete_off, t.recorded AS bytes_recorded,
            (bytes + CASE WHEN frame_off THEN 1 ELSE 0 END) <> t.recorded AS incomplete_frame_off
          FROM gcv g JOIN (SELECT capture_id, frame_index, bool_or(declared_bytes <> r) AS off, sum(r) AS recorded FROM (
            SELECT capture_id, frame_index, declared_bytes, CASE WHEN frame_index % 7 = 0 THEN 0 ELSE bytes END AS r FROM thr) GROUP BY 1, 2) t
          USING (capture_id, frame_index))""",
)
def reconcile_gc(spark, sf):
    flags = validate.reconcile_gc(inputs.dump_frames(spark, sf), inputs.threads(spark, sf), inputs.samples(spark, sf))
    return flags.select(
        *FRAME, "gc_valid", F.col("gc_bytes").cast("bigint").alias("gc_bytes"), F.concat_ws("; ", "gc_reasons").alias("reasons")
    )


@check(
    "v7_main_root",
    f"""WITH {SAMPLES}, f AS (SELECT DISTINCT capture_id, frame_index FROM thr),
    m AS (SELECT * FROM smp WHERE thread_index = 0 AND sample_index = 0 AND frame_index % 17 <> 0)
    SELECT f.capture_id, f.frame_index, m.time_ms IS NOT NULL AS cpu_valid, m.time_ms AS cpu_ms, m.time_ms IS NULL AS has_reason
    FROM f LEFT JOIN m USING (capture_id, frame_index)""",
)
def main_root(spark, sf):
    """Frames divisible by 17 rename their main thread."""
    name = F.when(F.col("frame_index") % 17 == 0, F.lit("Renamed")).otherwise(F.col("thread_name"))
    threads = inputs.threads(spark, sf).withColumn("thread_name", name)
    flags = validate.main_root(inputs.dump_frames(spark, sf), threads, inputs.tree(spark, sf))
    return flags.select(*FRAME, "cpu_valid", "cpu_ms", F.col("cpu_reason").isNotNull().alias("has_reason"))


@check(
    "v8_partial_export",
    f"""WITH {SAMPLES}, c AS (SELECT capture_id, count(*) AS exported, count(*) + CASE WHEN capture_id = 'O' THEN 3 ELSE 0 END AS declared_frame_count FROM dfr GROUP BY 1)
    SELECT *, 'partial export: ' || exported || ' of ' || declared_frame_count || ' frames' AS warning FROM c WHERE exported <> declared_frame_count""",
)
def partial_export(spark, sf):
    return validate.partial_export(inputs.captures(spark, sf), inputs.dump_frames(spark, sf))


@check(
    "v9_version_rules",
    """WITH b AS (SELECT o_custkey AS capture_id, CASE WHEN o_custkey % 3 = 0 THEN '6000.3.9f1' WHEN o_custkey % 3 = 1 THEN '6000.3.23f1'
      WHEN o_orderstatus = 'F' THEN '2022.3.1f1' ELSE '6000.3.9f1' END AS v FROM orders)
    SELECT capture_id, min(v) AS version, min(v) = max(v) AS single_version,
      min(v) = max(v) AND min(v) IN ('6000.3.9f1', '6000.3.23f1') AS version_verified FROM b GROUP BY 1""",
)
def version_rules(spark, sf):
    orders = adapters.table(spark, sf, "orders")
    cust = F.col("o_custkey")
    version = (
        F.when(cust % 3 == 0, F.lit("6000.3.9f1"))
        .when(cust % 3 == 1, F.lit("6000.3.23f1"))
        .when(F.col("o_orderstatus") == "F", F.lit("2022.3.1f1"))
        .otherwise(F.lit("6000.3.9f1"))
    )
    return validate.version_rules(orders.select(cust.alias("capture_id"), version.alias("version")))
