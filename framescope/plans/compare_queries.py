"""Registered queries: cross-recording comparison (C)."""

from pyspark.sql import functions as F

from framescope.functions.windows import running
from framescope.operators import compare, metrics
from framescope.plans import adapters, inputs
from framescope.plans.frame_queries import EVENTS
from framescope.plans.metric_queries import STATS_SQL
from framescope.plans.oracle import FRAMES, SAMPLES, frames_without_flaws
from framescope.plans.registry import check
from framescope.schemas import CONDITION_FIELDS


@check(
    "c1_select_range",
    f"""WITH {EVENTS}, r AS (SELECT DISTINCT capture_id, CASE WHEN CAST(capture_id AS BIGINT) % 11 = 0 THEN 30 WHEN CAST(capture_id AS BIGINT) % 5 <> 0 THEN CAST(capture_id AS BIGINT) % 7 END AS lo,
      CASE WHEN CAST(capture_id AS BIGINT) % 11 = 0 THEN 10 WHEN CAST(capture_id AS BIGINT) % 5 <> 0 THEN CAST(capture_id AS BIGINT) % 7 + 55 END AS hi FROM ev),
    s AS (SELECT r.capture_id, lo, hi, count(ev.frame_index) AS selected FROM r LEFT JOIN ev ON ev.capture_id = r.capture_id AND (lo IS NULL OR frame_index BETWEEN lo AND hi) GROUP BY 1, 2, 3)
    SELECT capture_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, selected, CASE WHEN lo > hi THEN 'reversed' WHEN selected = 0 THEN 'empty' ELSE 'ok' END AS status,
      coalesce(hi - lo + 1 <> selected, false) AS missing_frames FROM s""",
)
def select_range(spark, sf):
    frames = inputs.event_frames(spark, sf)
    user = F.col("capture_id").cast("bigint")
    lo = F.when(user % 11 == 0, 30).when(user % 5 != 0, user % 7)
    hi = F.when(user % 11 == 0, 10).when(user % 5 != 0, user % 7 + 55)
    ranges = frames.select("capture_id").distinct().select("capture_id", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    return compare.range_report(frames.select("capture_id", "frame_index"), ranges)


CONDITIONS_SQL = {
    "device": "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END",
    "platform": "CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'desktop' END",
    "scenario": "'n' || c_nationkey % 2", "operation": "'walk'", "build": "CASE WHEN c_custkey % 9 = 0 THEN 'debug' ELSE 'release' END",
    "quality": "'high'", "resolution": "CASE WHEN c_acctbal < 0 THEN '720p' ELSE '1080p' END", "profiling": "'deep'",
}


def _unknown_sql(f):
    return f"CASE WHEN a.{f} = '' OR b.{f} = '' THEN '{f}' END"


def _mismatch_sql(f):
    return f"CASE WHEN a.{f} <> '' AND b.{f} <> '' AND a.{f} <> b.{f} THEN '{f}' END"


@check(
    "c2_conditions_match",
    f"""WITH cap AS (SELECT c_custkey, {', '.join(f'{sql} AS {f}' for f, sql in CONDITIONS_SQL.items())},
      CASE WHEN c_custkey % 40 <> 0 THEN '6000.3.' || c_custkey % 2 END AS version, 'dump' AS source, 10 + CASE WHEN c_custkey % 25 = 0 THEN 1 ELSE 0 END AS declared, 10 AS actual FROM customer),
    p AS (SELECT CAST(a.c_custkey AS VARCHAR) AS a_id, CAST(b.c_custkey AS VARCHAR) AS b_id,
      concat_ws(',', {', '.join(_unknown_sql(f) for f in CONDITION_FIELDS)}, CASE WHEN a.version IS NULL OR b.version IS NULL THEN 'version' END,
        CASE WHEN a.declared > a.actual THEN 'A partial export without range' END, CASE WHEN b.declared > b.actual THEN 'B partial export without range' END) AS unknown,
      concat_ws(',', {', '.join(_mismatch_sql(f) for f in CONDITION_FIELDS)}, CASE WHEN a.version IS DISTINCT FROM b.version THEN 'version' END) AS mismatch
      FROM cap a JOIN cap b ON b.c_custkey = a.c_custkey + 2)
    SELECT *, unknown = '' AND mismatch = '' AS comparable, CASE WHEN mismatch <> '' THEN 'not_comparable' WHEN unknown = '' THEN 'confirmed' ELSE 'limited' END AS comparability FROM p""",
)
def conditions_match(spark, sf):
    """Every customer as a recording, paired with the one two further on."""
    key = F.col("c_custkey")
    customers = adapters.table(spark, sf, "customer")
    captures = customers.select(
        key.cast("string").alias("capture_id"),
        F.when(key % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("device"),
        F.when(key % 50 == 0, F.lit("")).otherwise(F.lit("desktop")).alias("platform"),
        F.concat(F.lit("n"), F.col("c_nationkey") % 2).alias("scenario"),
        F.lit("walk").alias("operation"),
        F.when(key % 9 == 0, F.lit("debug")).otherwise(F.lit("release")).alias("build"),
        F.lit("high").alias("quality"),
        F.when(F.col("c_acctbal") < 0, F.lit("720p")).otherwise(F.lit("1080p")).alias("resolution"),
        F.lit("deep").alias("profiling"),
        F.when(key % 40 != 0, F.concat(F.lit("6000.3."), key % 2)).alias("version"),
        F.lit("dump").alias("source"),
        (F.lit(10) + F.when(key % 25 == 0, 1).otherwise(0)).alias("declared_frame_count"),
        F.lit(10).alias("frame_count"),
    )
    pairs = customers.select(key.cast("string").alias("a_id"), (key + 2).cast("string").alias("b_id"))
    found = compare.conditions_match(pairs, captures, confirmed=F.lit(True))
    return found.withColumns({"unknown": F.array_join("unknown", ","), "mismatch": F.array_join("mismatch", ",")})


def recording_pairs(spark, sf):
    """Each recording with the one before it in name order."""
    ids = inputs.captures(spark, sf).select(F.col("capture_id").alias("b_id"))
    return running(ids, [], ["b_id"], {"a_id": ("last", F.col("b_id"))}).filter("a_id IS NOT NULL").select("a_id", "b_id")


def _delta_sql():
    return ", ".join(
        f'b."{s}" - a."{s}" AS {s}_delta, CASE WHEN a."{s}" <> 0 THEN 100.0::DOUBLE * (b."{s}" - a."{s}") / a."{s}" END AS {s}_percent'
        for s in compare.DELTA_STATS
    )


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


DELTA_COLUMNS = [f"{s}_{k}" for s in compare.DELTA_STATS for k in ("delta", "percent")]
ROUND_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in DELTA_COLUMNS)


@check(
    "c3_metric_deltas",
    f"""WITH {FRAMES}, {STATS_SQL}, d AS (SELECT a.capture_id AS a_id, b.capture_id AS b_id, metric, {_delta_sql()} FROM mstat a JOIN mstat b USING (metric) WHERE a.capture_id < b.capture_id)
    SELECT a_id, b_id, metric, {ROUND_SQL} FROM d""",
)
def metric_deltas(spark, sf):
    deltas = compare.metric_deltas(recording_pairs(spark, sf), metrics.metric_stats(inputs.frames(spark, sf)))
    return _rounded(deltas.select("a_id", "b_id", "metric", *DELTA_COLUMNS), DELTA_COLUMNS)


@check(
    "c4_budget_verdict",
    f"""WITH {frames_without_flaws()}, {STATS_SQL}, j AS (SELECT a.capture_id AS a_id, b.capture_id AS b_id, metric, b.p95 AS b_p95,
      CASE metric WHEN 'cpuMs' THEN 1000.0::DOUBLE WHEN 'gcBytes' THEN 1.0::DOUBLE END AS budget_p95 FROM mstat a JOIN mstat b USING (metric) WHERE a.capture_id < b.capture_id)
    SELECT *, CASE WHEN budget_p95 IS NULL THEN 'no_target' WHEN b_p95 <= budget_p95 THEN 'reached' ELSE 'not_reached' END AS verdict FROM j""",
)
def budget_verdict(spark, sf):
    """Both recordings under the same conditions, fully covered."""
    frames = inputs.full_frames(spark, sf)
    same = [F.lit("same").alias(f) for f in CONDITION_FIELDS]
    captures = frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("frame_count")).select(
        "capture_id", *same, F.lit("6000.3.9f1").alias("version"), F.lit("dump").alias("source"),
        F.col("frame_count").alias("declared_frame_count"), "frame_count",
    )
    pairs = recording_pairs(spark, sf)
    conditions = compare.conditions_match(pairs, captures, confirmed=F.lit(True))
    budgets = spark.createDataFrame([("cpuMs", 1000.0), ("gcBytes", 1.0)], "metric STRING, budget_p95 DOUBLE")
    deltas = compare.metric_deltas(pairs, metrics.metric_stats(frames))
    return compare.budget_verdict(deltas, conditions, budgets).select("a_id", "b_id", "metric", "b_p95", "budget_p95", "verdict")


PROFILE = f"""{SAMPLES}, nf AS (SELECT capture_id, count(DISTINCT frame_index) AS total_frames FROM smp GROUP BY 1),
  pp AS (SELECT capture_id, CASE WHEN thread_index = 1 THEN 'Jobs' END AS thread_group_name, CASE WHEN thread_index = 1 THEN 'Job.Worker' ELSE thread_name END AS role,
    CASE depth WHEN 0 THEN '["' || thread_name || '"]' WHEN 1 THEN '["' || thread_name || '","' || head_name || '"]' ELSE '["' || thread_name || '","' || head_name || '","' || marker_name || '"]' END AS pj,
    any_value(marker_name) AS leaf, sum(time_ms) AS ms, count(*) AS calls, sum(bytes) AS b, count(bytes) AS sized, count(DISTINCT frame_index) AS observed_frames FROM smp GROUP BY 1, 2, 3, 4),
  prof AS (SELECT capture_id, '[' || CASE WHEN thread_group_name IS NULL THEN 'null' ELSE '"' || thread_group_name || '"' END || ',"' || role || '",' || pj || ']' AS path_id, leaf,
    ms / total_frames AS inclusive_ms_per_frame, CAST(calls AS DOUBLE) / total_frames AS calls_per_frame, CASE WHEN sized = calls THEN CAST(b AS DOUBLE) / total_frames END AS gc_bytes_per_frame,
    observed_frames, total_frames FROM pp JOIN nf USING (capture_id))"""


def profile(spark, sf):
    frames = inputs.dump_frames(spark, sf)
    return compare.path_profile(inputs.tree(spark, sf), inputs.threads(spark, sf), frames)


@check(
    "c5_path_profile",
    f"""WITH {PROFILE} SELECT capture_id, path_id, round(inclusive_ms_per_frame, 6) AS inclusive_ms_per_frame, round(calls_per_frame, 6) AS calls_per_frame,
    round(gc_bytes_per_frame, 6) AS gc_bytes_per_frame, observed_frames, total_frames FROM prof""",
)
def path_profile(spark, sf):
    rows = profile(spark, sf).drop("thread_group_name", "role", "path")
    return _rounded(rows, ["inclusive_ms_per_frame", "calls_per_frame", "gc_bytes_per_frame"])


ASSOCIATED = f"""{PROFILE}, asc_rows AS (SELECT coalesce(a.path_id, b.path_id) AS path_id, a.inclusive_ms_per_frame AS a_ms, b.inclusive_ms_per_frame AS b_ms,
    b.inclusive_ms_per_frame - a.inclusive_ms_per_frame AS delta_inclusive_ms, CASE WHEN a.path_id IS NULL THEN 'only_b' WHEN b.path_id IS NULL THEN 'only_a' ELSE 'both' END AS association
  FROM (SELECT * FROM prof WHERE capture_id = 'F') a FULL OUTER JOIN (SELECT * FROM prof WHERE capture_id = 'O') b ON a.path_id = b.path_id),
  asc_rank AS (SELECT *, row_number() OVER (ORDER BY abs(coalesce(delta_inclusive_ms, 0)) DESC, path_id) - 1 AS rank, count(*) OVER () AS total FROM asc_rows)"""


def associated(spark, sf):
    return compare.associate(recording_pairs(spark, sf), profile(spark, sf))


@check(
    "c6_associate",
    f"WITH {ASSOCIATED} SELECT 'F' AS a_id, 'O' AS b_id, path_id, round(a_ms, 6) AS a_ms, round(b_ms, 6) AS b_ms, round(delta_inclusive_ms, 6) AS delta_inclusive_ms, association, rank FROM asc_rank",
)
def associate(spark, sf):
    rows = compare.ranked_associations(associated(spark, sf)).select(
        "a_id", "b_id", "path_id", F.col("a_inclusive_ms_per_frame").alias("a_ms"), F.col("b_inclusive_ms_per_frame").alias("b_ms"),
        "delta_inclusive_ms", "association", "rank",
    )
    return _rounded(rows, ["a_ms", "b_ms", "delta_inclusive_ms"])


@check(
    "c7_association_top",
    f"WITH {ASSOCIATED} SELECT 'F' AS a_id, 'O' AS b_id, path_id, round(delta_inclusive_ms, 6) AS delta_inclusive_ms, association, rank, total, CASE WHEN total > 20 THEN CAST(20 AS BIGINT) END AS next_start FROM asc_rank WHERE rank < 20",
)
def association_top(spark, sf):
    rows = compare.association_top(associated(spark, sf))
    return _rounded(rows.select("a_id", "b_id", "path_id", "delta_inclusive_ms", "association", "rank", "total", "next_start"), ["delta_inclusive_ms"])


@check(
    "c8_observe_markers",
    f"""WITH {PROFILE}, t AS (SELECT p_partkey AS task_id, unnest(CASE WHEN p_partkey % 12 = 0 THEN [NULL] ELSE ['Update.' || p_brand, p_type, 'Unseen'] END) AS name FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0),
    m AS (SELECT leaf AS name, path_id, inclusive_ms_per_frame AS ms, row_number() OVER (PARTITION BY leaf ORDER BY path_id) AS n, count(*) OVER (PARTITION BY leaf) AS k FROM prof WHERE capture_id = 'O'),
    g AS (SELECT name, max(k) AS total_paths, string_agg(path_id, ';' ORDER BY path_id) FILTER (n <= 5) AS matches, max(ms) FILTER (n = 1) AS first_ms FROM m GROUP BY 1)
    SELECT CAST(task_id AS VARCHAR) AS task_id, t.name, CASE WHEN t.name IS NULL THEN 'manual' WHEN total_paths > 0 THEN 'observed' ELSE 'not_observed' END AS status,
      coalesce(total_paths, 0) AS total_paths, coalesce(matches, '') AS matches, coalesce(total_paths > 5, false) AS truncated, first_ms FROM t LEFT JOIN g ON g.name = t.name""",
)
def observe_markers(spark, sf):
    key = F.col("p_partkey")
    tasks = adapters.table(spark, sf, "part").select(
        key.cast("string").alias("task_id"),
        F.when(key % 3 == 0, F.lit("marker")).otherwise(F.lit("optimize")).alias("kind"),
        (key % 2 == 0).alias("selected"),
        F.when(key % 12 != 0, F.array(F.concat(F.lit("Update."), F.col("p_brand")), F.col("p_type"), F.lit("Unseen"))).otherwise(F.array().cast("array<string>")).alias("marker_names"),
    )
    found = compare.observe_markers(tasks, profile(spark, sf).filter("capture_id = 'O'"))
    ids = F.array_join(F.transform("matches", lambda m: m["path_id"]), ";")
    return found.withColumn("first_ms", F.get("matches", F.lit(0))["inclusive_ms_per_frame"]).withColumn("matches", ids)
