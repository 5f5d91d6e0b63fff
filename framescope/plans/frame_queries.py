"""Registered queries: per-frame derivations (F)."""

from pyspark.sql import functions as F

from framescope.functions.scalars import choose
from framescope.operators import frames as ops
from framescope.plans import adapters, inputs
from framescope.plans.oracle import SAMPLES
from framescope.plans.registry import check
from framescope.schemas import FRAME, MEMORY_COUNTERS, RENDER_COUNTERS, SAMPLE, THREAD

EVENTS = """
ev AS (SELECT CAST(user_id AS VARCHAR) AS capture_id, event_id, ts, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)
"""


@check("f1_frame_cpu", f"WITH {SAMPLES}, m AS (SELECT capture_id, frame_index, time_ms AS cpu_ms FROM smp WHERE thread_index = 0 AND sample_index = 0) SELECT capture_id, frame_index, cpu_ms FROM dfr LEFT JOIN m USING (capture_id, frame_index)")
def frame_cpu(spark, sf):
    return ops.frame_cpu(inputs.dump_frames(spark, sf), inputs.threads(spark, sf), inputs.tree(spark, sf))


@check("f2_frame_gc", f"WITH {SAMPLES} SELECT capture_id, frame_index, CASE WHEN gc_valid THEN bytes END AS gc_bytes FROM gcv")
def frame_gc(spark, sf):
    found = ops.frame_gc(inputs.dump_frames(spark, sf), inputs.threads(spark, sf), inputs.samples(spark, sf))
    return found.withColumn("gc_bytes", F.col("gc_bytes").cast("bigint"))


def event_headers(spark, sf):
    """Frame headers with id gaps every seven frames, skipped frames and some starts that go back."""
    back = F.when(F.col("value") < 5, 10**13).otherwise(0)
    return inputs.event_frames(spark, sf).select(
        *FRAME,
        (F.col("frame_index") + F.floor(F.col("frame_index") / 7)).alias("raw_frame_id"),
        (F.col("epoch_us") * 1000 - back).cast("decimal(20,0)").alias("start_ns"),
        (F.col("event_type") == "error").alias("skipped"),
    )


HEADERS = f"""{EVENTS}, hd AS (SELECT capture_id, frame_index, frame_index + frame_index // 7 AS raw_frame_id,
    epoch_us(ts) * 1000 - CASE WHEN value < 5 THEN 10000000000000 ELSE 0 END AS start_ns, event_type = 'error' AS skipped FROM ev)
"""


@check(
    "f3_frame_interval",
    f"""WITH {HEADERS}, nx AS (SELECT *, lead(raw_frame_id) OVER w AS nid, lead(start_ns) OVER w AS ns, lead(skipped) OVER w AS nsk
      FROM hd WINDOW w AS (PARTITION BY capture_id ORDER BY frame_index))
    SELECT capture_id, frame_index, raw_frame_id,
      CASE WHEN NOT skipped AND nid IS NOT NULL AND NOT nsk AND nid = raw_frame_id + 1 AND ns >= start_ns
           THEN CAST(CAST(ns - start_ns AS FLOAT) * CAST(1e-6 AS FLOAT) AS DOUBLE) END AS frame_ms,
      CASE WHEN skipped THEN 'frame not recorded' WHEN nid IS NULL OR nsk THEN 'no next frame start'
           WHEN nid <> raw_frame_id + 1 THEN 'raw frame ids not consecutive' WHEN ns < start_ns THEN 'frame start goes back' END AS reason
    FROM nx""",
)
def frame_interval(spark, sf):
    return ops.frame_intervals(event_headers(spark, sf))


EVENT_DAY = "CAST(epoch_us(ts) // 86400000000 AS BIGINT)"


def _sql_names(names):
    return " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in zip(inputs.EVENT_KINDS, names))


def _daily(spark, sf, names):
    day = F.floor(F.col("epoch_us") / F.lit(86400000000)).cast("bigint")
    named = choose(F.col("event_type"), dict(zip(inputs.EVENT_KINDS, names)))
    return inputs.event_frames(spark, sf).withColumns({"frame_index": day, "name": named})


@check(
    "f4_render_counters",
    f"""WITH {EVENTS}, ob AS (SELECT capture_id, {EVENT_DAY} AS frame_index, CASE event_type {_sql_names(RENDER_COUNTERS)} END AS name,
      CASE WHEN k >= 5 THEN k % 3 END AS v FROM ev),
    f AS (SELECT DISTINCT capture_id, frame_index FROM ob), nm AS (SELECT unnest({RENDER_COUNTERS}) AS name),
    ag AS (SELECT capture_id, frame_index, name, count(*) AS seen, count(v) AS ok, min(v) AS lo, max(v) AS hi FROM ob GROUP BY 1, 2, 3)
    SELECT f.capture_id, f.frame_index, nm.name, CASE WHEN ok = seen AND lo = hi THEN lo END AS value,
      CASE WHEN seen IS NULL THEN 'not recorded' WHEN ok < seen THEN 'metadata missing, unknown or negative'
           WHEN lo <> hi THEN 'observations of one frame conflict' END AS reason
    FROM f CROSS JOIN nm LEFT JOIN ag ON ag.capture_id = f.capture_id AND ag.frame_index = f.frame_index AND ag.name = nm.name""",
)
def render_counters(spark, sf):
    daily = _daily(spark, sf, RENDER_COUNTERS)
    observed = daily.select(*FRAME, "name", F.when(F.col("k") >= 5, F.col("k") % 3).alias("value"))
    return ops.render_counters(daily.select(*FRAME).distinct(), observed)


@check(
    "f5_memory_counters",
    f"""WITH {EVENTS}, ob AS (SELECT capture_id, {EVENT_DAY} AS frame_index, CASE event_type {_sql_names(MEMORY_COUNTERS)} END AS name,
      event_id % 2 AS th, event_id AS sid,
      CASE WHEN k % 10 = 0 THEN 'counter flag missing' WHEN k % 13 = 0 THEN 'metadata missing or field count differs'
           WHEN k % 17 = 0 THEN 'unit is not bytes' WHEN k % 6 > 3 THEN 'payload is not an integer'
           WHEN k % 19 = 0 THEN 'negative or invalid integer' END AS why, k % 3 AS raw FROM ev),
    vo AS (SELECT *, CASE WHEN why IS NULL THEN raw END AS v, row_number() OVER (PARTITION BY capture_id, frame_index, name ORDER BY th, sid) AS n FROM ob),
    f AS (SELECT DISTINCT capture_id, frame_index FROM ob), nm AS (SELECT unnest({MEMORY_COUNTERS}) AS name),
    ag AS (SELECT capture_id, frame_index, name, count(*) AS seen, count(v) AS ok, min(v) AS lo, max(v) AS hi,
      max(why ORDER BY n) FILTER (why IS NOT NULL) AS unused, arg_max(why, n) FILTER (why IS NOT NULL) AS why,
      string_agg(CAST(sid AS VARCHAR), ',' ORDER BY n) FILTER (n <= 16) AS sources FROM vo GROUP BY 1, 2, 3)
    SELECT f.capture_id, f.frame_index, nm.name, CASE WHEN ok = seen AND lo = hi THEN lo END AS value,
      CASE WHEN seen IS NULL THEN 'counter not recorded' WHEN why IS NOT NULL THEN why WHEN lo <> hi THEN 'observations of one frame conflict' END AS reason,
      coalesce(sources, '') AS sources, coalesce(seen, 0) AS source_count
    FROM f CROSS JOIN nm LEFT JOIN ag ON ag.capture_id = f.capture_id AND ag.frame_index = f.frame_index AND ag.name = nm.name""",
)
def memory_counters(spark, sf):
    k = F.col("k")
    observed = _daily(spark, sf, MEMORY_COUNTERS).select(
        *FRAME,
        "name",
        (F.col("event_id") % 2).alias("thread_index"),
        (F.col("event_id") % 2 + 1000).cast("decimal(20,0)").alias("thread_id"),
        F.col("event_id").alias("sample_index"),
        k.cast("int").alias("marker_id"),
        (k % 10 != 0).alias("is_counter"),
        F.when(k % 13 == 0, 2).otherwise(1).alias("metadata_count"),
        F.lit(1).alias("fields"),
        F.when(k % 17 == 0, F.lit("count")).otherwise(F.lit("bytes")).alias("unit"),
        (k % 6 + 2).alias("payload_type"),
        F.when(k % 19 == 0, F.lit("-5")).otherwise((k % 3).cast("string")).alias("value"),
    )
    found = ops.memory_counters(observed.select(*FRAME).distinct(), observed)
    ids = F.transform("sources", lambda s: s["sample_index"].cast("string"))
    return found.select(
        *FRAME, "name", F.col("value").cast("bigint").alias("value"), "reason",
        F.coalesce(F.array_join(ids, ","), F.lit("")).alias("sources"), "source_count",
    )


@check("f6_compact_markers", f"WITH {SAMPLES} SELECT capture_id, frame_index, marker_name AS name, sum(time_ms) AS total_ms, count(*) AS call_count, max(time_ms) AS max_ms FROM smp WHERE thread_index = 0 GROUP BY 1, 2, 3")
def compact_markers(spark, sf):
    return ops.compact_markers(ops.main_markers(inputs.tree(spark, sf), inputs.main_cpu(spark, sf)))


SITES = f"""{SAMPLES}, site AS (SELECT s.capture_id, s.frame_index, thread_name || ' #' || thread_index AS thread,
    CASE WHEN depth = 2 AND p_size % 5 <> 0 THEN head_name ELSE thread_name END AS name, s.bytes
    FROM smp s JOIN gcv g ON g.capture_id = s.capture_id AND g.frame_index = s.frame_index AND gc_valid WHERE is_alloc),
  fsite AS (SELECT capture_id, frame_index, thread, name, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS call_count, max(bytes) AS max_bytes
    FROM site GROUP BY 1, 2, 3, 4)"""


@check("f7_compact_sites", f"WITH {SITES} SELECT * FROM fsite")
def compact_sites(spark, sf):
    rows = ops.alloc_sites(inputs.attributed(spark, sf), inputs.threads(spark, sf), inputs.gc_flags(spark, sf))
    out = ops.compact_sites(rows)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("total_bytes", "max_bytes")})


RENDER = f"""{SAMPLES}, rend AS (SELECT capture_id, frame_index, thread_name || ' #' || thread_index || ' / ' || marker_name AS name,
    sum(time_ms) AS total_ms, count(*) AS call_count, max(time_ms) AS max_ms FROM smp WHERE category_index = 0 AND time_ms > 0 GROUP BY 1, 2, 3)"""


@check("f8_render_events", f"WITH {RENDER} SELECT * FROM rend")
def render_events(spark, sf):
    return ops.compact_markers(ops.render_events(inputs.samples(spark, sf), inputs.threads(spark, sf)))


@check(
    "f9_alloc_continuation",
    f"""WITH {EVENTS}, fr AS (SELECT *, frame_index + frame_index // 7 AS id, event_type <> 'error' AS live,
      event_type IN ('view', 'click') AS has_repeat, event_type <> 'error' AND k % 4 <> 0 AS whole_end, CASE WHEN k % 5 = 0 THEN 8 ELSE 7 END AS mark FROM ev),
    pv AS (SELECT *, lag(id) OVER w AS pid, lag(live AND whole_end AND mark = 7) OVER w AS pok FROM fr WINDOW w AS (PARTITION BY capture_id ORDER BY frame_index)),
    rep AS (SELECT capture_id, frame_index, CAST(1 AS BIGINT) AS sample_index, coalesce(pok AND pid + 1 = id, false) AS c FROM pv WHERE has_repeat)
    SELECT capture_id, frame_index, sample_index, c AS gc_continuation, NOT c AS gc_missing FROM rep
    UNION ALL SELECT capture_id, frame_index, CASE WHEN has_repeat THEN 2 ELSE 1 END, false, false FROM fr WHERE live""",
)
def alloc_continuation(spark, sf):
    """Each event is a frame on a regular time grid; some end in an allocation that the next repeats."""
    k, start = F.col("k"), (F.col("frame_index") * 1000).cast("decimal(20,0)")
    events = inputs.event_frames(spark, sf)
    headers = events.select(
        *FRAME,
        (F.col("frame_index") + F.floor(F.col("frame_index") / 7)).alias("raw_frame_id"),
        start.alias("start_ns"),
        (F.col("event_type") == "error").alias("skipped"),
    )
    live = events.filter("event_type <> 'error'").withColumn("thread_index", F.lit(0).cast("bigint"))
    repeat = F.col("event_type").isin("view", "click")

    def sample(index, marker, name, begin, length, children, bytes_):
        return F.struct(
            F.lit(index).cast("bigint").alias("sample_index") if isinstance(index, int) else index.cast("bigint").alias("sample_index"),
            marker.cast("bigint").alias("marker_id"), F.lit(name).alias("marker_name"),
            begin.cast("decimal(20,0)").alias("start_ns"), length.cast("float").alias("duration_ns"),
            children.cast("bigint").alias("children_count"), bytes_.cast("decimal(20,0)").alias("gc_bytes"),
            F.lit(None if isinstance(index, int) and index == 0 else 0).cast("bigint").alias("parent_index"),
        )

    none = F.lit(None)
    kids = F.when(repeat, 2).otherwise(1)
    root = sample(0, F.lit(ops.SENTINEL_MARKER), "", start, F.lit(1000), kids, none)
    again = F.when(repeat, sample(1, F.lit(7), "GC.Alloc", start, F.lit(0), F.lit(0), none))
    length = F.when(k % 4 == 0, 99).otherwise(100)
    last = sample(kids, F.when(k % 5 == 0, 8).otherwise(7), "GC.Alloc", start + 900, length, F.lit(0), k)
    raw = live.select(*THREAD, F.inline(F.array_compact(F.array(root, again, last))))
    threads = live.select(
        *THREAD, F.lit(1).cast("decimal(20,0)").alias("thread_id"), F.lit("Main Thread").alias("thread_name"),
        F.lit(None).cast("string").alias("thread_group_name"),
    )
    marked = ops.alloc_continuation(headers, threads, raw).filter("marker_name = 'GC.Alloc'")
    return marked.select(*FRAME, "sample_index", "gc_continuation", "gc_missing")


@check(
    "f10_coverage",
    """WITH f AS (SELECT DISTINCT l_linestatus AS capture_id, l_partkey AS p FROM lineitem)
    SELECT capture_id, count(*) AS raw_blocks, count(*) FILTER (p % 21 <> 0) AS decoded_frames, count(*) FILTER (p % 21 = 0) AS skipped_frames,
      CAST(0 AS BIGINT) AS failed_frames, CASE WHEN bool_or(p % 13 = 0) THEN 'pending-editor-comparison' ELSE 'limited-capture-comparison' END AS validation
    FROM f GROUP BY 1""",
)
def coverage(spark, sf):
    source = F.when(F.col("frame_index") % 21 == 0, F.lit("data-structured-skipped")).otherwise(F.lit("data-structured"))
    return ops.coverage(inputs.frames(spark, sf).withColumn("source", source))


@check(
    "f11_match_all_or_nothing",
    f"""WITH {SAMPLES}, a AS (SELECT *, CASE WHEN supp % 31 = 0 THEN 0 WHEN supp % 37 = 0 THEN 2 ELSE 1 END AS recs FROM smp WHERE is_alloc),
    g AS (SELECT *, bool_and(recs = 1) OVER (PARTITION BY capture_id, frame_index, thread_index) AS matched FROM a)
    SELECT capture_id, frame_index, thread_index, sample_index, CASE WHEN matched THEN bytes END AS size, matched FROM g""",
)
def match_all_or_nothing(spark, sf):
    allocs = inputs.samples(spark, sf).filter("marker_name = 'GC.Alloc'")
    supp = F.col("marker_id")
    records = F.when(supp % 31 == 0, 0).when(supp % 37 == 0, 2).otherwise(1)
    sizes = allocs.select(*SAMPLE, F.col("gc_alloc_bytes").cast("bigint").alias("size"), F.explode(F.array_repeat(F.lit(1), records)).alias("r"))
    return ops.match_all_or_nothing(allocs.select(*SAMPLE), sizes.drop("r"), THREAD)


@check(
    "f12_longest_run",
    f"""WITH {EVENTS}, pr AS (SELECT capture_id, 8 * (frame_index + frame_index // 5) AS body_offset, frame_index + CASE WHEN k < 30 THEN -1 ELSE 0 END AS si FROM ev),
    fl AS (SELECT *, coalesce(body_offset = lag(body_offset) OVER w + 8 AND si > lag(si) OVER w, false) AS ext,
      coalesce(body_offset = lag(body_offset) OVER w + 8 AND si = lag(si) OVER w + 1, false) AS stp FROM pr WINDOW w AS (PARTITION BY capture_id ORDER BY body_offset)),
    isl AS (SELECT *, sum(CASE WHEN ext THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN stp THEN 0 ELSE 1 END) OVER w AS chain FROM fl WINDOW w AS (PARTITION BY capture_id ORDER BY body_offset)),
    ch AS (SELECT capture_id, run, chain, count(*) AS c, min(body_offset) AS o FROM isl GROUP BY 1, 2, 3),
    rn AS (SELECT capture_id, run, min(o) AS start_offset, CAST(sum(c) AS BIGINT) AS run_length, max(c) AS longest_step_chain FROM ch GROUP BY 1, 2)
    SELECT capture_id, start_offset, run_length, longest_step_chain FROM rn
    QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY run_length DESC, start_offset) = 1""",
)
def longest_run(spark, sf):
    index = F.col("frame_index")
    pairs = inputs.event_frames(spark, sf).select(
        "capture_id",
        ((index + F.floor(index / 5)) * 8).alias("body_offset"),
        (index + F.when(F.col("k") < 30, -1).otherwise(0)).alias("sample_index"),
    )
    return ops.longest_run(pairs, ["capture_id"])


def _vector_item(i):
    return f"((o_orderkey * {i + 3}) % 50 + {i})"


def _vector_rule():
    order = [f"{_vector_item(a)} <= {_vector_item(b)}" for a, _, b in ops.MEMORY_VECTOR_ORDER]
    return " AND ".join(order + [f"{_vector_item(i)} > 0" for i in ops.MEMORY_VECTOR_POSITIVE])


@check(
    "f13_counter_invariants",
    f"SELECT o_orderkey, {_vector_rule()} AS valid, "
    + ", ".join(f"{_vector_item(i)} AS {n}" for n, i in ops.MEMORY_VECTOR_COLUMNS.items())
    + " FROM orders",
)
def counter_invariants(spark, sf):
    orders = adapters.table(spark, sf, "orders")
    vector = F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: (F.col("o_orderkey") * (i + 3)) % 50 + i)
    return ops.counter_invariants(orders.select("o_orderkey", vector.alias("values")))
