"""Registered queries: optimisation history (W) and its validation rules.

scene = nation, round = customer, run = order, change = line item; each run has
two tasks.  States and kinds come from the keys.
"""

from pyspark.sql import functions as F

from framescope.functions.windows import running
from framescope.operators import history, validate
from framescope.plans import adapters
from framescope.plans.registry import check


def scenes(spark, sf):
    key = F.col("n_nationkey").cast("bigint")
    return adapters.table(spark, sf, "nation").select(key.alias("scene_id"), (key * 7 % 25).alias("last_code_revision"))


def rounds(spark, sf):
    key = F.col("c_custkey")
    return adapters.table(spark, sf, "customer").select(
        key.alias("round_id"), F.col("c_nationkey").cast("bigint").alias("scene_id"), key.alias("seq"),
        F.when(key % 5 != 0, key).alias("candidate"),
        F.when(key % 11 == 0, F.lit("deferred")).when(key % 2 == 0, F.lit("accepted")).otherwise(F.lit("pending")).alias("decision"),
        (key % 4 == 1).alias("has_comparison"),
    )


def runs(spark, sf):
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(owner % 13 == 0, F.lit("rolled_back")).when(owner % 7 == 0, F.lit("investigated"))
        .when(key % 101 == 0, F.lit("running")).otherwise(F.lit("done"))
    )
    return adapters.table(spark, sf, "orders").select(
        key.alias("run_id"), owner.alias("round_id"), key.alias("seq"), status.alias("status"), (key % 6 != 0).alias("has_text")
    )


def tasks(spark, sf):
    run, owner = F.col("run_id"), F.col("round_id")

    def one(n):
        kind = F.when((owner % 3 == 0) | ((run + n) % 4 == 0), F.lit("marker")).otherwise(F.lit("optimize"))
        return F.struct(F.lit(f"t{n}").alias("task_id"), kind.alias("kind"), ((run + n) % 5 != 0).alias("selected"))

    rows = runs(spark, sf).select("run_id", "round_id", F.inline(F.array(one(1), one(2))))
    names = F.when(F.col("kind") == "marker", F.array(F.concat(F.lit("Mark."), F.col("run_id") % 9))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("marker_names", names).drop("round_id")


def changes(spark, sf):
    run = F.col("l_orderkey")
    state = (
        F.when(F.col("l_suppkey") % 90 == 0, F.lit("conflict")).when(F.col("l_suppkey") % 90 == 1, F.lit("prepared"))
        .when((F.col("l_returnflag") == "A") & (run % 7 == 3), F.lit("applied")).otherwise(F.lit("rolled_back"))
    )
    task = F.when(F.col("l_suppkey") % 10 != 5, F.concat(F.lit("t"), F.col("l_linenumber") % 2 + 1))
    # the changes of one order in seven belong to no run
    lines = adapters.table(spark, sf, "lineitem")
    return lines.select(F.when(run % 7 != 0, run).alias("run_id"), task.alias("task_id"), state.alias("state"))


HISTORY = """
rounds AS (SELECT c_custkey AS round_id, CAST(c_nationkey AS BIGINT) AS scene_id, c_custkey AS seq, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS candidate,
  CASE WHEN c_custkey % 11 = 0 THEN 'deferred' WHEN c_custkey % 2 = 0 THEN 'accepted' ELSE 'pending' END AS decision, c_custkey % 4 = 1 AS has_comparison FROM customer),
scenes AS (SELECT CAST(n_nationkey AS BIGINT) AS scene_id, CAST(n_nationkey * 7 % 25 AS BIGINT) AS last_code_revision FROM nation),
runs AS (SELECT o_orderkey AS run_id, o_custkey AS round_id, o_orderkey AS seq, CASE WHEN o_custkey % 13 = 0 THEN 'rolled_back' WHEN o_custkey % 7 = 0 THEN 'investigated'
  WHEN o_orderkey % 101 = 0 THEN 'running' ELSE 'done' END AS status, o_orderkey % 6 <> 0 AS has_text FROM orders),
tasks AS (SELECT run_id, round_id, 't' || n AS task_id, CASE WHEN round_id % 3 = 0 OR (run_id + n) % 4 = 0 THEN 'marker' ELSE 'optimize' END AS kind, (run_id + n) % 5 <> 0 AS selected
  FROM runs, (VALUES (1), (2)) t(n)),
changes AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS run_id, CASE WHEN l_suppkey % 10 <> 5 THEN 't' || (l_linenumber % 2 + 1) END AS task_id,
  CASE WHEN l_suppkey % 90 = 0 THEN 'conflict' WHEN l_suppkey % 90 = 1 THEN 'prepared' WHEN l_returnflag = 'A' AND l_orderkey % 7 = 3 THEN 'applied' ELSE 'rolled_back' END AS state
  FROM lineitem),
applied AS (SELECT round_id, task_id, arg_max(run_id, run_id) AS run_id, arg_max(kind, run_id) AS kind FROM tasks t
  WHERE EXISTS (SELECT 1 FROM changes c WHERE c.run_id = t.run_id AND c.state = 'applied' AND (c.task_id = t.task_id OR (c.task_id IS NULL AND t.selected))) GROUP BY 1, 2),
rchange AS (SELECT c.*, r.round_id, EXISTS (SELECT 1 FROM tasks t WHERE t.run_id = c.run_id AND t.task_id = c.task_id AND t.kind = 'marker') AS is_marker FROM changes c JOIN runs r USING (run_id)),
monly AS (SELECT round_id, coalesce(bool_or(state = 'applied') AND NOT bool_or(state = 'applied' AND NOT is_marker) AND NOT bool_or(state IN ('prepared', 'conflict')), false) AS marker_only
  FROM rounds LEFT JOIN rchange USING (round_id) GROUP BY 1),
unres AS (SELECT round_id, scene_id, seq FROM rounds JOIN (SELECT round_id, bool_or(state IN ('prepared', 'conflict')) AS op, bool_or(state = 'applied') AS ap FROM rchange GROUP BY 1) USING (round_id)
  WHERE op OR (ap AND decision <> 'accepted')),
cur AS (SELECT scene_id, max(seq) AS seq, arg_max(round_id, seq) AS round_id, count(*) AS round_count FROM rounds GROUP BY 1)
"""


def applied(spark, sf):
    return history.applied_tasks(tasks(spark, sf), changes(spark, sf), runs(spark, sf))


@check("w1_applied_tasks", f"WITH {HISTORY} SELECT round_id, task_id, run_id, kind FROM applied")
def applied_tasks(spark, sf):
    return applied(spark, sf).select("round_id", "task_id", "run_id", "kind")


@check("w2_marker_only", f"WITH {HISTORY} SELECT * FROM monly")
def marker_only(spark, sf):
    return history.marker_only(rounds(spark, sf), runs(spark, sf), tasks(spark, sf), changes(spark, sf))


@check(
    "w3_round_status",
    f"""WITH {HISTORY}, pr AS (SELECT round_id, bool_and(NOT EXISTS (SELECT 1 FROM changes c WHERE c.run_id = runs.run_id) AND status <> 'running') AS untouched,
      bool_and(status = 'rolled_back') AS all_back, arg_max(status, seq) AS last_status, arg_max(has_text, seq) AS last_text FROM runs GROUP BY 1),
    ch AS (SELECT c_custkey AS round_id, c_custkey % 9 = 0 AS marker_tasks FROM customer WHERE c_custkey % 10 <> 9),
    tg AS (SELECT c_custkey AS round_id, CASE WHEN c_custkey % 12 <> 5 THEN c_custkey % 8 = 1 END AS op, CASE WHEN c_custkey % 12 <> 5 THEN c_custkey % 3 = 2 END AS missed FROM customer)
    SELECT round_id, CASE WHEN decision = 'deferred' THEN 'deferred' WHEN untouched AND last_status = 'investigated' AND last_text THEN 'investigated'
      WHEN decision = 'accepted' AND NOT has_comparison AND marker_only AND candidate IS NOT NULL THEN 'sampling_accepted'
      WHEN decision = 'accepted' AND NOT has_comparison AND marker_only THEN 'sampling_without_candidate' WHEN all_back THEN 'undecidable_rolled_back'
      WHEN NOT has_comparison THEN 'awaiting_recording' WHEN marker_tasks THEN 'undecidable_markers_only' WHEN op IS NULL OR op THEN 'undecidable'
      WHEN missed THEN 'not_reached' ELSE 'reached' END AS status
    FROM rounds LEFT JOIN pr USING (round_id) LEFT JOIN monly USING (round_id) LEFT JOIN ch USING (round_id) LEFT JOIN tg USING (round_id)""",
)
def round_status(spark, sf):
    key = F.col("round_id")
    base = rounds(spark, sf)
    round_tasks = base.select(
        key, F.when(key % 9 == 0, F.lit("marker")).otherwise(F.lit("optimize")).alias("kind"), (key % 10 != 9).alias("selected")
    )
    verdict = F.when(key % 8 == 1, F.lit("undecidable")).when(key % 3 == 2, F.lit("not_reached")).otherwise(F.lit("reached"))
    missed = F.when(key % 3 == 2, F.lit("not_reached")).otherwise(F.lit("no_target"))
    # one round in twelve was compared without a budget
    budget = lambda value: F.when(key % 12 != 5, F.lit(value)).alias("budget_p95")
    verdicts = base.select(key, F.inline(F.array(F.struct(budget(5.0), verdict.alias("verdict")), F.struct(budget(7.0), missed.alias("verdict")))))
    return history.round_status(base, runs(spark, sf), tasks(spark, sf), changes(spark, sf), round_tasks, verdicts)


@check("w4_current_round", f"WITH {HISTORY} SELECT scene_id, round_id, round_count, coalesce(p, 0) AS prior_count, s AS prior_seq_sum FROM cur LEFT JOIN (SELECT r.scene_id, count(*) AS p, CAST(sum(r.seq) AS BIGINT) AS s FROM rounds r JOIN cur c ON c.scene_id = r.scene_id AND r.seq < c.seq GROUP BY 1) USING (scene_id)")
def current_round(spark, sf):
    current = history.current_rounds(rounds(spark, sf))
    prior = history.prior_rounds(current, rounds(spark, sf)).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("p"), F.sum("seq").alias("prior_seq_sum")
    )
    return current.join(prior, "scene_id", "left").select("scene_id", "round_id", "round_count", F.coalesce("p", F.lit(0)).alias("prior_count"), "prior_seq_sum")


@check(
    "w5_unresolved_blocker",
    f"""WITH {HISTORY} SELECT s.scene_id, (SELECT arg_min(u.scene_id, u.seq) FROM unres u WHERE u.scene_id <> s.scene_id) AS blocked_by,
    (SELECT count(*) FROM unres u WHERE u.scene_id = s.scene_id) AS unresolved_rounds FROM scenes s""",
)
def unresolved_blocker(spark, sf):
    open_rounds = history.unresolved(rounds(spark, sf), runs(spark, sf), changes(spark, sf))
    counts = open_rounds.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    found = history.blockers(scenes(spark, sf), open_rounds).join(counts, "scene_id", "left")
    return found.select("scene_id", "blocked_by", F.coalesce("n", F.lit(0)).alias("unresolved_rounds"))


@check(
    "w6_stale_captures",
    f"""WITH {HISTORY}, c AS (SELECT c_custkey AS capture_id, CAST(c_nationkey AS BIGINT) AS scene_id, CASE WHEN c_custkey % 13 <> 0 THEN 15 + c_custkey % 12 END AS code_revision FROM customer)
    SELECT capture_id, code_revision IS NULL OR EXISTS (SELECT 1 FROM scenes s WHERE s.scene_id <> c.scene_id AND s.last_code_revision > c.code_revision) AS stale FROM c""",
)
def stale_captures(spark, sf):
    key = F.col("c_custkey")
    captures = adapters.table(spark, sf, "customer").select(
        key.alias("capture_id"), F.col("c_nationkey").cast("bigint").alias("scene_id"), F.when(key % 13 != 0, 15 + key % 12).alias("code_revision")
    )
    return history.stale_captures(captures, scenes(spark, sf)).select("capture_id", "stale")


@check(
    "w7_marker_streak",
    f"""WITH {HISTORY}, k AS (SELECT r.*, coalesce((SELECT bool_and(a.kind = 'marker') FROM applied a WHERE a.round_id = r.round_id), false) AS m, row_number() OVER (PARTITION BY scene_id ORDER BY seq) AS n FROM rounds r),
    b AS (SELECT *, max(CASE WHEN NOT m THEN n END) OVER (PARTITION BY scene_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM k)
    SELECT scene_id, round_id, seq, n - 1 - coalesce(lb, 0) AS marker_streak FROM b""",
)
def marker_streak(spark, sf):
    return history.marker_streaks(rounds(spark, sf), applied(spark, sf))


@check(
    "w8_open_focus",
    f"""WITH {HISTORY}, rq AS (SELECT c.round_id AS target_round, a.round_id AS focus_round, a.task_id AS focus_task, r.seq AS round_seq FROM applied a JOIN rounds r USING (round_id)
      JOIN cur c ON c.scene_id = r.scene_id AND r.seq < c.seq WHERE a.kind = 'marker'),
    rv AS (SELECT c.round_id AS target_round, run.seq AS run_seq, r.seq AS round_seq, run.round_id - 25 AS focus_round, 't1' AS focus_task, CASE WHEN run.run_id % 3 = 0 THEN 'resolved' ELSE 'continue' END AS disposition
      FROM runs run JOIN rounds r USING (round_id) JOIN cur c ON c.scene_id = r.scene_id AND r.seq < c.seq),
    lt AS (SELECT * FROM rv QUALIFY row_number() OVER (PARTITION BY target_round ORDER BY round_seq DESC, run_seq DESC) = 1),
    f1 AS (SELECT lt.target_round, lt.focus_round, lt.focus_task FROM lt JOIN rq USING (target_round, focus_round, focus_task) WHERE disposition <> 'resolved'),
    f2 AS (SELECT rq.* FROM rq WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.target_round = rq.target_round AND rv.focus_round = rq.focus_round AND rv.focus_task = rq.focus_task AND disposition = 'resolved')
      QUALIFY row_number() OVER (PARTITION BY target_round ORDER BY round_seq DESC, focus_task DESC) = 1)
    SELECT cur.round_id AS target_round, CASE WHEN f1.target_round IS NOT NULL THEN f1.focus_round ELSE f2.focus_round END AS focus_round,
      CASE WHEN f1.target_round IS NOT NULL THEN f1.focus_task ELSE f2.focus_task END AS focus_task
    FROM cur LEFT JOIN f1 ON f1.target_round = cur.round_id LEFT JOIN f2 ON f2.target_round = cur.round_id""",
)
def open_focus(spark, sf):
    reviews = runs(spark, sf).select(
        "round_id", F.col("seq").alias("run_seq"), (F.col("round_id") - 25).alias("focus_round"), F.lit("t1").alias("focus_task"),
        F.when(F.col("run_id") % 3 == 0, F.lit("resolved")).otherwise(F.lit("continue")).alias("disposition"),
    )
    base = rounds(spark, sf)
    return history.open_focus(history.current_rounds(base), base, applied(spark, sf), reviews)


REPORTS = """reports AS (SELECT o_orderkey AS report_id, o_custkey AS round_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'project' ELSE 'performance' END AS stage,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_report_id,
  o_custkey % 50 AS capture_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END AS text FROM orders)"""


def reports(spark, sf):
    orders = adapters.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    linked = running(orders, ["o_custkey"], ["o_orderkey"], {"parent_report_id": ("last", F.col("o_orderkey"))})
    key = F.col("o_orderkey")
    return linked.select(
        key.alias("report_id"), F.col("o_custkey").alias("round_id"), key.alias("seq"), key.alias("created_at"),
        F.when(key % 3 == 0, F.lit("project")).otherwise(F.lit("performance")).alias("stage"),
        F.when(F.col("o_orderstatus") == "P", F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        "parent_report_id", (F.col("o_custkey") % 50).alias("capture_id"),
        F.when(key % 17 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("text"),
    )


@check(
    "w9_report_attempt",
    f"""WITH {REPORTS}, lp AS (SELECT round_id, arg_max(report_id, seq) AS id, arg_max(status, seq) AS st FROM reports WHERE stage = 'performance' GROUP BY 1),
    rd AS (SELECT DISTINCT r.round_id FROM reports r LEFT JOIN lp USING (round_id) WHERE stage = 'project' AND status = 'completed' AND (lp.id IS NULL OR (st = 'completed' AND parent_report_id = lp.id)))
    SELECT report_id, row_number() OVER (PARTITION BY round_id, stage ORDER BY seq) AS attempt, rd.round_id IS NOT NULL AS round_ready FROM reports LEFT JOIN rd USING (round_id)""",
)
def report_attempt(spark, sf):
    rows = reports(spark, sf)
    ready = history.ready_reports(rounds(spark, sf), rows)
    return history.report_attempts(rows).join(ready, "round_id", "left").select("report_id", "attempt", F.col("ready").alias("round_ready"))


@check(
    "w10_select_reports",
    f"""WITH {REPORTS}, s AS (SELECT r.report_id AS selection_id, r.capture_id, CASE r.report_id % 4 WHEN 0 THEN [r.report_id] WHEN 1 THEN [r.report_id, coalesce(r.parent_report_id, r.report_id)]
      WHEN 2 THEN [r.report_id, r.report_id + 1] ELSE [r.report_id, r.report_id + 1, r.report_id + 2] END AS ids FROM reports r),
    e AS (SELECT selection_id, len(ids) AS n, ids, a.report_id AS a_id, a.parent_report_id AS ap, b.report_id AS b_id, b.parent_report_id AS bp FROM s
      LEFT JOIN reports a ON a.report_id = ids[1] AND a.text <> '' AND a.capture_id = s.capture_id LEFT JOIN reports b ON b.report_id = ids[2] AND b.text <> '' AND b.capture_id = s.capture_id),
    st AS (SELECT *, CASE WHEN n > 2 THEN 'choose_one_or_two' WHEN a_id IS NULL OR (n = 2 AND b_id IS NULL) THEN 'missing_empty_or_foreign'
      WHEN n = 2 AND (a_id = b_id OR NOT coalesce(ap = b_id OR bp = a_id, ap = b_id, bp = a_id, false)) THEN 'not_parent_and_child' ELSE 'ok' END AS status FROM e)
    SELECT selection_id, status, CASE WHEN status = 'ok' THEN array_to_string(list_sort(ids), ',') END AS ordered_ids FROM st""",
)
def select_reports(spark, sf):
    rows = reports(spark, sf)
    key = F.col("report_id")
    ids = (
        F.when(key % 4 == 0, F.array(key)).when(key % 4 == 1, F.array(key, F.coalesce("parent_report_id", key)))
        .when(key % 4 == 2, F.array(key, key + 1)).otherwise(F.array(key, key + 1, key + 2))
    )
    selections = rows.select(key.alias("selection_id"), "capture_id", ids.alias("report_ids"))
    found = history.select_reports(selections, rows)
    return found.withColumn("ordered_ids", F.array_join("ordered_ids", ","))


def journal(spark, sf):
    """Turns of each conversation as journal rows; some repeated, alone or with more text, some with a hole before them."""
    turns = adapters.table(spark, sf, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("n"), F.col("text").alias("chunk"))
    placed = running(turns, ["item_id"], ["n"], {"offset": ("sum", F.octet_length("chunk").cast("bigint"))}, {"count": ("count", None)})
    hole = F.when((F.col("item_id") % 9 == 0) & (F.col("n") > 0), 3).otherwise(0)
    repeats = F.when(F.col("item_id") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cut = (F.col("item_id") % 5 == 2) & (F.col("n") == F.col("count") - 1)
    rows = placed.select("item_id", "n", F.explode(repeats).alias("again"), (F.col("offset") + hole).alias("offset"), "chunk", (~cut).alias("terminated"))
    longer = (F.col("again") == 1) & (F.col("item_id") % 4 == 3)
    rows = rows.withColumn("chunk", F.when(longer, F.concat("chunk", F.lit(" and more"))).otherwise(F.col("chunk")))
    return rows.withColumn("line_no", F.col("n") * 2 + F.col("again")).drop("n", "again")


@check(
    "w11_replay_chunks",
    """WITH t AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
    ok AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (NOT (conv_id % 5 = 2 AND turn = k - 1)) AS body, count(*) FILTER (NOT (conv_id % 5 = 2 AND turn = k - 1)) AS committed FROM t GROUP BY 1)
    SELECT conv_id AS item_id, CASE WHEN conv_id % 9 = 0 AND committed > 1 THEN '' ELSE coalesce(body, '') END AS text,
      CASE WHEN conv_id % 2 = 0 THEN 'interrupted' ELSE 'completed' END AS status, CASE WHEN conv_id % 9 = 0 AND committed > 1 THEN 'gap' END AS problem FROM ok""",
)
def replay_chunks(spark, sf):
    log = journal(spark, sf)
    items = adapters.table(spark, sf, "conversations").select(F.col("conv_id").alias("item_id")).distinct().select(
        "item_id", F.lit("").alias("text"), F.when(F.col("item_id") % 2 == 0, F.lit("running")).otherwise(F.lit("completed")).alias("status")
    )
    return history.replay_chunks(items, log)


@check(
    "v10_history_integrity",
    """WITH sc AS (SELECT n_nationkey AS scene_id FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey % 10 = 4),
    ids AS (SELECT DISTINCT scene_id FROM sc), cap AS (SELECT c_custkey AS capture_id, c_nationkey AS scene_id FROM customer),
    rd AS (SELECT o_orderkey AS round_id, c_nationkey AS scene_id, o_custkey AS baseline, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 END AS candidate FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT CAST(scene_id AS VARCHAR) AS id, 'duplicate_scene' AS rule FROM sc GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT CAST(capture_id AS VARCHAR), 'capture_scene_missing' FROM cap WHERE scene_id NOT IN (SELECT scene_id FROM ids)
    UNION ALL SELECT CAST(round_id AS VARCHAR), 'round_scene_missing' FROM rd WHERE scene_id NOT IN (SELECT scene_id FROM ids)
    UNION ALL SELECT CAST(round_id AS VARCHAR), 'round_uses_foreign_capture' FROM rd JOIN cap ON cap.capture_id = rd.candidate WHERE cap.scene_id <> rd.scene_id""",
)
def history_integrity(spark, sf):
    """Scene 3 is missing and three scenes appear twice; some rounds use the next customer's recording."""
    base = scenes(spark, sf).select("scene_id")
    scene_rows = base.filter("scene_id <> 3").unionByName(base.filter("scene_id % 10 = 4"))
    customers = adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("capture_id"), F.col("c_nationkey").cast("bigint").alias("scene_id"))
    orders = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("round_id"), F.col("o_custkey").alias("baseline"))
    owned = orders.join(customers, F.col("baseline") == F.col("capture_id")).select("round_id", "scene_id", "baseline")
    used = owned.withColumn("candidate", F.when(F.col("round_id") % 3 == 0, F.col("baseline") + 1))
    return validate.history_integrity(scene_rows, customers, used)


@check(
    "v11_task_rules",
    r"""WITH t AS (SELECT l_orderkey AS run, l_partkey % 6 AS task, l_suppkey AS s, l_linenumber AS ln FROM lineitem),
    r AS (SELECT DISTINCT run, task, unnest(list_filter([CASE WHEN s % 10 = 0 THEN 'kind' END, CASE WHEN s % 11 = 0 OR s % 5 = 3 THEN 'empty_field' END, CASE WHEN s % 40 + 1 > 20 AND s % 5 <> 3 THEN 'too_many_files' END,
        CASE WHEN s % 7 IN (1, 3, 4) OR (s % 7 IN (2, 5) AND (s % 3 <> 0 OR s % 10 = 0)) THEN 'marker_names' END], lambda x: x IS NOT NULL)) AS rule FROM t)
    SELECT CAST(run AS VARCHAR) AS run_id, CAST(task AS VARCHAR) AS task_id, rule FROM r
    UNION ALL SELECT CAST(run AS VARCHAR), CAST(task AS VARCHAR), 'duplicate_task' FROM t GROUP BY run, task HAVING count(*) > 1
    UNION ALL SELECT CAST(run AS VARCHAR), NULL, 'too_many_tasks' FROM t GROUP BY run HAVING count(*) > 20""",
)
def task_rules(spark, sf):
    """Each line item proposes a task; several texts, kinds and name lists break a rule."""
    s = F.col("l_suppkey")
    kind = F.when(s % 10 == 0, F.lit("investigate")).when(s % 3 == 0, F.lit("marker")).otherwise(F.lit("optimize"))
    none = F.array().cast("array<string>")
    names = (
        F.when(s % 7 == 1, F.array(F.lit("A"), F.lit("A"))).when(s % 7 == 2, F.array(F.lit("A"), F.lit("B")))
        .when(s % 7 == 3, F.array(F.repeat(F.lit("x"), 201))).when(s % 7 == 4, F.array(F.lit("tab\there")))
        .when(s % 7 == 5, F.array(F.repeat(F.lit("é"), 100))).otherwise(none)
    )
    tasks_ = adapters.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), (F.col("l_partkey") % 6).cast("string").alias("task_id"), kind.alias("kind"),
        F.when(s % 11 == 0, F.lit("")).otherwise(F.lit("title")).alias("title"), F.lit("e").alias("evidence"), F.lit("i").alias("instructions"),
        F.lit("a").alias("acceptance"), F.when(s % 5 == 3, 0).otherwise(s % 40 + 1).alias("file_count"), names.alias("marker_names"),
    )
    return validate.task_rules(tasks_)
