"""What is joined or moved: samples meet as few joins as the result asks for."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framescope.functions.windows import BUCKET_ROWS_CONF, running
from framescope.operators import compare, frames, ranking, tree

THREADS = "capture_id STRING, frame_index BIGINT, thread_index BIGINT, thread_id BIGINT, thread_name STRING, thread_group_name STRING"


def joins_over(df, column):
    """How many joins lie over each table with ``column``."""

    def walk(node, joins):
        children = node.children()
        if children.isEmpty():
            return [joins] if f"{column}#" in node.output().toString() else []
        joins += node.nodeName() == "Join"
        return [n for k in range(children.size()) for n in walk(children.apply(k), joins)]

    return walk(df._jdf.queryExecution().optimizedPlan(), 0)


def threads(spark, many):
    rows = [("A", f, t, t, "Main Thread" if t == 0 else "Job.Worker 1", None if t == 0 else "Jobs") for f in range(many) for t in (0, 1)]
    return spark.createDataFrame(rows, THREADS)


@pytest.mark.parametrize("size", [3, 40, 250_000])
def test_sums_ahead_match_brute_force(spark, size):
    rng = random.Random(5)
    data = [("hot" if n % 3 == 0 else f"k{n % 50}" if n % 7 else None, n, None if n % 11 == 0 else float(rng.randrange(9))) for n in range(700)]
    df = spark.createDataFrame(data, "k STRING, a INT, v DOUBLE")
    spark.conf.set(BUCKET_ROWS_CONF, str(size))
    try:
        wide = running(df, ["k"], ["a"], {"i": ("count", None)}, ahead={"two": (2, F.col("v")), "five": (5, F.col("v"))}).collect()
        alone = running(df, ["k"], ["a"], ahead={"two": (2, F.col("v"))}, bounded=True).collect()
    finally:
        spark.conf.unset(BUCKET_ROWS_CONF)
    expected = {}
    for k in {d[0] for d in data}:
        values = [(d[1], d[2]) for d in data if d[0] == k]
        for i, (a, _) in enumerate(values):
            near = [[v for _, v in values[i : i + 1 + many] if v is not None] for many in (2, 5)]
            expected[a] = (i, *(sum(n) if n else None for n in near))
    assert {r.a: (r.i, r.two, r.five) for r in wide} == expected
    assert {r.a: r.two for r in alone} == {a: two for a, (_, two, _) in expected.items()}


def timed(spark, many):
    shape = "capture_id STRING, frame_index BIGINT, thread_index BIGINT, path ARRAY<STRING>, time_ms DOUBLE, self_ms DOUBLE, gc_alloc_bytes DECIMAL(20,0)"
    rows = [("A", f, t, p, float(f + 1), 0.5, Decimal(f)) for f in range(many) for t in (0, 1) for p in (["R"], ["R", f"p{f}"])]
    return spark.createDataFrame(rows, shape)


def test_flags_join_pairs_and_not_their_paths(spark):
    pairs = spark.createDataFrame([("A", 1, 0), ("A", 2, 1), ("A", 3, 2)], "capture_id STRING, frame_index BIGINT, baseline_index BIGINT")
    flags = spark.createDataFrame([("A", 0, True), ("A", 1, True), ("A", 2, None), ("A", 2, True), ("A", 2, True)], "capture_id STRING, frame_index BIGINT, gc_valid BOOLEAN")
    found = ranking.compare_frames(timed(spark, 4), threads(spark, 4), flags, pairs)
    assert max(joins_over(found, "self_ms")) <= 4
    rows = sorted((r.frame_index, "/".join(r.path), r.inclusive_delta_ms, r.baseline_calls, r.current_calls, r.gc_delta_bytes is not None) for r in found.collect())
    # one row for each flag of a frame, as in a join with the flags
    assert rows == sorted(
        (f, *path, ok)
        for f, oks in ((1, [True]), (2, [False, True, True]), (3, [False, False, False]))
        for path in (("R", 1.0, 1, 1), (f"R/p{f}", f + 1.0, 0, 1), (f"R/p{f - 1}", -float(f), 1, 0))
        for ok in oks
    )


def test_samples_join_once_for_call_paths_and_sites(spark):
    rows, names = timed(spark, 3), threads(spark, 3)
    profile = compare.path_profile(rows, names, spark.createDataFrame([("A", 1), ("A", 2)], "capture_id STRING, frame_index BIGINT"))
    assert max(joins_over(profile, "self_ms")) <= 3
    assert {r.total_frames for r in profile.collect()} == {2} and profile.count() == 6
    valid = spark.createDataFrame([("A", 0, True), ("A", 1, False), ("A", 2, None)], "capture_id STRING, frame_index BIGINT, gc_valid BOOLEAN")
    sites = frames.alloc_sites(rows.withColumn("site_name", F.element_at("path", 1)), names, valid)
    assert max(joins_over(sites, "self_ms")) == 1
    assert sorted((r.frame_index, r.thread, r.name) for r in sites.collect()) == [(0, "Job.Worker 1 #1", "R")] * 2 + [(0, "Main Thread #0", "R")] * 2


def test_calls_without_children_meet_no_join_for_self_time(spark):
    shape = """capture_id STRING, frame_index BIGINT, thread_index BIGINT, sample_index BIGINT, parent_index BIGINT, children_count BIGINT, time_ms DOUBLE,
      start_time_ms DOUBLE, raw_start_ns DECIMAL(20,0), raw_duration_ns FLOAT, is_counter BOOLEAN"""
    rows = [("A", 0, 0, n, p, c, t, s, None, None, False) for n, p, c, t, s in [(0, None, 2, 9.0, 0.0), (1, 0, 0, 4.0, 0.0), (2, 0, None, 3.0, 4.0), (3, None, 1, 2.0, 9.0)]]
    found = tree.self_time(spark.createDataFrame(rows, shape))
    assert min(joins_over(found, "is_counter")) == 0
    assert {r.sample_index: (r.self_ms, r.self_reason is None) for r in found.collect()} == {0: (2.0, True), 1: (4.0, True), 2: (None, False), 3: (None, False)}
