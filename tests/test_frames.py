from decimal import Decimal

from pyspark.sql import functions as F

from framescope.operators import compare, frames, history, metrics, project
from framescope.schemas import CONDITION_FIELDS, U64_MAX

RAW = (
    "capture_id STRING, frame_index BIGINT, thread_index BIGINT, sample_index BIGINT, marker_id BIGINT, marker_name STRING, start_ns DECIMAL(20,0), "
    "duration_ns FLOAT, children_count BIGINT, gc_bytes DECIMAL(20,0), parent_index BIGINT"
)
SENTINEL = frames.SENTINEL_MARKER


def continuation(spark, **change):
    v = dict(id2=6, start2=1000, marker=7, duration=0.0, group2="g", length=100.0)
    v.update(change)
    headers = spark.createDataFrame(
        [("c", 0, 5, Decimal(0), False), ("c", 1, v["id2"], Decimal(v["start2"]), False)], "capture_id STRING, frame_index BIGINT, raw_frame_id BIGINT, start_ns DECIMAL(20,0), skipped BOOLEAN"
    )
    threads = spark.createDataFrame(
        [("c", f, 0, Decimal(1), "Main Thread", g) for f, g in ((0, "g"), (1, v["group2"]))], "capture_id STRING, frame_index BIGINT, thread_index BIGINT, thread_id DECIMAL(20,0), thread_name STRING, thread_group_name STRING"
    )
    start2 = Decimal(v["start2"])
    raw = spark.createDataFrame(
        [
            ("c", 0, 0, 0, SENTINEL, "", Decimal(0), 1000.0, 1, None, None),
            ("c", 0, 0, 1, 7, "GC.Alloc", Decimal(900), v["length"], 0, Decimal(104), 0),
            ("c", 1, 0, 0, SENTINEL, "", start2, 1000.0, 2, None, None),
            ("c", 1, 0, 1, v["marker"], "GC.Alloc", start2, v["duration"], 0, None, 0),
            ("c", 1, 0, 2, 7, "GC.Alloc", start2 + 5, 1.0, 0, Decimal(17), 0),
        ],
        RAW,
    )
    marked = frames.alloc_continuation(headers, threads, raw).filter("frame_index = 1 AND sample_index = 1").first()
    return marked.gc_continuation, marked.gc_missing


def test_allocation_continuation_and_each_condition(spark):
    assert continuation(spark) == (True, False)
    for change in ({"id2": 7}, {"start2": 1001}, {"marker": 8}, {"duration": 1.0}, {"group2": "h"}, {"length": 100.5}):
        assert continuation(spark, **change) == (False, True), change


def test_memory_counters_and_summary(spark):
    shape = (
        "capture_id STRING, frame_index BIGINT, thread_index BIGINT, thread_id DECIMAL(20,0), sample_index BIGINT, marker_id INT, name STRING, is_counter BOOLEAN, "
        "metadata_count INT, fields INT, unit STRING, payload_type INT, value STRING"
    )
    name = "System Used Memory"
    row = lambda f, s, v, counter=True: ("c", f, 0, Decimal(1), s, 1, name, counter, 1, 1, "bytes", 5, v)
    observed = spark.createDataFrame([row(0, 0, str(2**64 - 1)), row(1, 0, "1"), row(1, 1, "2"), row(2, 0, "0"), row(3, 0, "3", False), row(4, 0, str(2**64))], shape)
    base = spark.createDataFrame([("c", f, f) for f in range(5)], "capture_id STRING, frame_index BIGINT, position BIGINT")
    found = frames.memory_counters(base, observed)
    mine = {r.frame_index: (None if r.value is None else int(r.value), r.reason) for r in found.filter(F.col("name") == name).collect()}
    assert mine == {
        0: (2**64 - 1, None), 1: (None, "observations of one frame conflict"), 2: (0, None), 3: (None, "counter flag missing"), 4: (None, "negative or invalid integer"),
    }
    summary = metrics.memory_summary(base, found).filter(F.col("name") == name).first()
    assert (summary.valid_frames, summary.peak_frame, int(summary.delta), summary.status) == (2, 0, -int(U64_MAX), "partial")
    # Equal peaks: the last frame counts.
    level = spark.createDataFrame([("c", f, name, Decimal(9)) for f in range(3)], "capture_id STRING, frame_index BIGINT, name STRING, value DECIMAL(20,0)")
    assert metrics.memory_summary(base, level).filter(F.col("name") == name).first().peak_frame == 2


def test_gc_total_overflow_is_null(spark):
    df = spark.createDataFrame([("c", 0, U64_MAX), ("c", 1, Decimal(1))], "capture_id STRING, frame_index BIGINT, gc_bytes DECIMAL(20,0)")
    assert metrics.gc_totals(df).first().total_alloc_bytes is None


def captures(spark, **second):
    base = {f: "x" for f in CONDITION_FIELDS} | {"version": "1", "source": "s", "declared_frame_count": 2, "frame_count": 2}
    rows = [{"capture_id": "A", **base}, {"capture_id": "B", **base, **second}]
    return spark.createDataFrame(rows, ", ".join(["capture_id STRING", *[f"{f} STRING" for f in CONDITION_FIELDS], "version STRING, source STRING, declared_frame_count BIGINT, frame_count BIGINT"]))


def test_conditions_and_verdicts(spark):
    pairs = spark.createDataFrame([("A", "B")], "a_id STRING, b_id STRING")
    label = lambda confirmed=True, **b: compare.conditions_match(pairs, captures(spark, **b), confirmed=F.lit(confirmed)).first()
    assert label().comparability == "confirmed"
    assert label(False).comparability == "limited"
    assert (label(device="").comparability, label(device="").unknown) == ("limited", ["device"])
    assert label(build="y").mismatch == ["build"] and label(version="2").comparability == "not_comparable"
    assert label(declared_frame_count=3).unknown == ["B partial export without range"]
    stats = spark.createDataFrame(
        [(c, "cpuMs", v, v, v, v, v, 2, 2) for c, v in (("A", 4.0), ("B", 5.0))],
        "capture_id STRING, metric STRING, mean DOUBLE, p50 DOUBLE, p95 DOUBLE, p99 DOUBLE, max DOUBLE, valid_frames BIGINT, total_frames BIGINT",
    )
    deltas = compare.metric_deltas(pairs, stats)
    assert (deltas.first().p95_delta, deltas.first().p95_percent) == (1.0, 25.0)
    conditions = compare.conditions_match(pairs, captures(spark), confirmed=F.lit(True))
    for budget, verdict in ((5.0, "reached"), (4.9, "not_reached"), (None, "no_target")):
        budgets = spark.createDataFrame([("cpuMs" if budget else "other", budget or 1.0)], "metric STRING, budget_p95 DOUBLE")
        assert compare.budget_verdict(deltas, conditions, budgets).first().verdict == verdict
    partial = deltas.withColumn("b_valid_frames", F.lit(1))
    assert compare.budget_verdict(partial, conditions, budgets).first().verdict == "undecidable"


def test_association_by_role_and_path(spark):
    shape = "capture_id STRING, frame_index BIGINT, thread_index BIGINT, path ARRAY<STRING>, time_ms DOUBLE, gc_alloc_bytes DECIMAL(20,0)"
    rows = [
        ("A", 1, 0, ["R"], 10.0, None), ("A", 1, 0, ["R", "Work"], 4.0, None), ("A", 2, 0, ["R"], 10.0, None), ("A", 1, 1, ["J"], 1.0, Decimal(6)),
        ("B", 7, 5, ["R"], 10.0, None), ("B", 7, 5, ["R", "Renamed"], 4.0, None), ("B", 7, 6, ["J"], 3.0, None),
    ]
    tree = spark.createDataFrame(rows, shape)
    names = [("A", 1, 0, "Main Thread", None), ("A", 2, 0, "Main Thread", None), ("A", 1, 1, "Job.Worker 3", "Jobs"), ("B", 7, 5, "Main Thread", None), ("B", 7, 6, "Job.Worker 9", "Jobs")]
    threads = spark.createDataFrame(names, "capture_id STRING, frame_index BIGINT, thread_index BIGINT, thread_name STRING, thread_group_name STRING")
    profile = compare.path_profile(tree, threads, tree.select("capture_id", "frame_index").distinct())
    pairs = spark.createDataFrame([("A", "B")], "a_id STRING, b_id STRING")
    found = {tuple(r.path): r for r in compare.ranked_associations(compare.associate(pairs, profile)).collect()}
    assert found[("R",)].delta_inclusive_ms == 0.0 and found[("R", "Work")].association == "only_a" and found[("R", "Renamed")].association == "only_b"
    assert (found[("J",)].delta_inclusive_ms, found[("J",)].rank, found[("J",)].a_gc_bytes_per_frame) == (2.5, 0, 3.0)
    tasks = spark.createDataFrame([("t", "marker", True, ["R", "Work", "Wor"]), ("m", "marker", True, [])], "task_id STRING, kind STRING, selected BOOLEAN, marker_names ARRAY<STRING>")
    seen = {(r.task_id, r.name): r.status for r in compare.observe_markers(tasks, profile.filter("capture_id = 'A'")).collect()}
    assert seen == {("t", "R"): "observed", ("t", "Work"): "observed", ("t", "Wor"): "not_observed", ("m", None): "manual"}


def test_a_recording_in_several_pairs(spark):
    shape = "capture_id STRING, frame_index BIGINT, thread_index BIGINT, path ARRAY<STRING>, time_ms DOUBLE, gc_alloc_bytes DECIMAL(20,0)"
    rows = [("A", 1, 0, ["R"], 2.0, None), ("B", 1, 0, ["R"], 5.0, None), ("C", 1, 0, ["R"], 9.0, None), ("C", 1, 0, ["R", None], 1.0, None), ("C", 1, 0, [None, "R"], 3.0, None)]
    threads = spark.createDataFrame([(c, 1, 0, "Main Thread", None) for c in "ABC"], "capture_id STRING, frame_index BIGINT, thread_index BIGINT, thread_name STRING, thread_group_name STRING")
    tree = spark.createDataFrame(rows, shape)
    profile = compare.path_profile(tree, threads, tree.select("capture_id", "frame_index").distinct())
    assert sorted((r.capture_id, tuple(x or "" for x in r.path), r.inclusive_ms_per_frame) for r in profile.collect()) == [
        ("A", ("R",), 2.0), ("B", ("R",), 5.0), ("C", ("", "R"), 3.0), ("C", ("R",), 9.0), ("C", ("R", ""), 1.0)
    ]
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("B", "B")], "a_id STRING, b_id STRING")
    found = compare.associate(pairs, profile).collect()
    both = {(r.a_id, r.b_id): r.delta_inclusive_ms for r in found if r.association == "both"}
    assert both == {("A", "B"): 3.0, ("B", "A"): -3.0, ("A", "C"): 7.0, ("B", "B"): 0.0}
    rest = [(r.a_id, r.b_id, r.association, r.a_inclusive_ms_per_frame, r.b_inclusive_ms_per_frame) for r in found if r.association != "both"]
    assert sorted(rest, key=repr) == [("A", "C", "only_b", None, 1.0), ("A", "C", "only_b", None, 3.0)]


def test_replay_gap_and_saved_text(spark):
    items = spark.createDataFrame([("a", "he", "running"), ("b", "", "done")], "item_id STRING, text STRING, status STRING")
    log = spark.createDataFrame(
        [("a", 0, 0, "he", True), ("a", 1, 2, "llo", True), ("a", 2, 5, "!", False), ("b", 0, 3, "x", True)], "item_id STRING, line_no INT, offset BIGINT, chunk STRING, terminated BOOLEAN"
    )
    found = {r.item_id: (r.text, r.status, r.problem) for r in history.replay_chunks(items, log).collect()}
    assert found == {"a": ("hello", "interrupted", None), "b": ("", "done", "gap")}


def test_duplicate_owner_leaves_object_unresolved(spark):
    g = "0123456789abcdef0123456789abcdef"
    lines = [("A.mat.meta", 1, f"guid: {g.upper()}"), ("B.mat.meta", 1, f"guid: {g}"), ("A.mat", 1, "--- !u!21 &5"), ("S.unity", 1, "--- !u!1 &9"), ("S.unity", 2, f"- m_Mat: {{fileID: 5, guid: {g}, type: 2}}"),
             ("D.unity", 1, "--- !u!1 &9"), ("D.unity", 2, "--- !u!1 &9"), ("D.unity", 3, "m_X: {fileID: 9}")]
    df = spark.createDataFrame(lines, "path STRING, line INT, text STRING")
    resolved = project.resolved_references(project.refs(df), project.guids(df), project.objects(df)).collect()
    assert {(r.source, r.property, r.target, r.object_resolved, r.object_id) for r in resolved} == {("S.unity", "m_Mat", "A.mat", False, "9"), ("S.unity", "m_Mat", "B.mat", False, "9")}
    assert {r.path for r in project.objects(df).collect()} == {"A.mat", "S.unity"}
