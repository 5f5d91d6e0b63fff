import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framescope.operators import tree, validate
from framescope.schemas import SAMPLE, THREAD

COLUMNS = (
    "capture_id STRING, frame_index BIGINT, thread_index BIGINT, sample_index BIGINT, marker_name STRING, children_count BIGINT, "
    "time_ms DOUBLE, start_time_ms DOUBLE, gc_alloc_bytes DECIMAL(20,0), is_counter BOOLEAN, raw_start_ns DECIMAL(20,0), raw_duration_ns FLOAT"
)


def sample(thread, index, name, kids, time=1.0, start=0.0, size=None, counter=False):
    return ("c", 0, thread, index, name, kids, time, start, None if size is None else Decimal(size), counter, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def random_thread(rng, thread, size, stringy):
    """Pre-order child counts of a random forest, with parents and depths from a plain stack."""
    rows, stack, left = [], [], size
    for i in range(size):
        while stack and stack[-1][1] == 0:
            stack.pop()
        parent, depth = (stack[-1][0], len(stack)) if stack else (None, 0)
        owner = next((s[2] for s in reversed(stack) if s[2] != "GC.Alloc"), None)
        path = [s[2] for s in stack] + [name] if (name := rng.choice(["A", "B", "GC.Alloc"])) else []
        if stack:
            stack[-1][1] -= 1
        promised = sum(s[1] for s in stack)
        kids = rng.randint(0, min(1 if stringy else 3, size - i - 1 - promised)) if size - i - 1 > promised else 0
        rows.append((sample(thread, i, name, kids), parent, depth, owner, path))
        stack.append([i, kids, name])
    return rows


@pytest.mark.parametrize("block_rows", [3, 7, 1000])
def test_tree_matches_stack_on_random_forests(spark, block_rows):
    rng = random.Random(block_rows)
    threads = [random_thread(rng, t, rng.randint(1, 60), t % 3 == 0) for t in range(60)]
    rows = [r for t in threads for r in t]
    out = tree.with_tree(frame(spark, [r[0] for r in rows]), ("parent_index", "depth", "owner_name", "path", "ancestors"), block_rows=block_rows)
    got = {(r.thread_index, r.sample_index): (r.parent_index, r.depth, r.owner_name, r.path) for r in out.collect()}
    assert got == {(r[0][2], r[0][3]): r[1:] for r in rows}
    assert all(r.ancestors[-1] == r.sample_index and len(r.ancestors) == r.depth + 1 for r in out.collect())
    open_rows = validate.tree_closed(out).collect()
    assert [r for r in open_rows if r.rule == "children_out_of_range"] == []


def self_of(spark, kids, declared=None):
    rows = [sample(0, 0, "P", len(kids) if declared is None else declared, 10.0)]
    rows += [sample(0, i + 1, "C", 0, end - start, start) for i, (start, end) in enumerate(kids)]
    timed = tree.self_time(tree.with_tree(frame(spark, rows)))
    return timed.filter("sample_index = 0").first()


def test_self_time_rules(spark):
    assert self_of(spark, [(0.0, 4.0), (4.0, 10.0)]).self_ms == 0
    assert self_of(spark, [(4.0, 10.0), (0.0, 4.0)]).self_ms == 0  # order of start counts
    for kids, declared in [([(0.0, 4.0), (3.0, 9.0)], None), ([(0.0, 4.0), (9.0, 15.0)], None), ([(0.0, 4.0), (4.0, 10.0)], 3)]:
        found = self_of(spark, kids, declared)
        assert found.self_ms is None and found.self_reason
    assert self_of(spark, []).self_ms == 10


def test_self_time_with_many_children_in_buckets(spark):
    kids = [(i * 0.05, i * 0.05 + 0.05) for i in range(150)]
    spark.conf.set("spark.framescope.bucketRows", "20")
    try:
        assert abs(self_of(spark, kids).self_ms - 2.5) < 1e-9
        kids[100] = (kids[100][0] - 0.01, kids[100][1])
        assert self_of(spark, kids).self_ms is None
    finally:
        spark.conf.unset("spark.framescope.bucketRows")


def test_counter_has_no_self_time(spark):
    timed = tree.self_time(tree.with_tree(frame(spark, [sample(0, 0, "K", 0, counter=True)])))
    assert timed.first().self_ms is None


def test_nested_allocations_and_rollup(spark):
    rows = [
        sample(0, 0, "Main Thread", 1), sample(0, 1, "Update", 1), sample(0, 2, "GC.Alloc", 1, size=20), sample(0, 3, "GC.Alloc", 0, size=4),
        sample(1, 0, "GC.Alloc", 0, size=8),
    ]
    sites = {(r.thread_index, r.sample_index): r.site_name for r in tree.attribute_alloc(frame(spark, rows)).collect()}
    assert sites == {(0, 2): "Update", (0, 3): "Update", (1, 0): "unattributed"}
    total = {(r.thread_index, r.sample_index): int(r.inclusive_bytes) for r in tree.rollup_bytes(frame(spark, rows)).collect()}
    assert total == {(0, 0): 24, (0, 1): 24, (0, 2): 24, (0, 3): 4, (1, 0): 8}


def test_path_rules(spark):
    deep = [sample(0, i, "N", 1 if i < 69 else 0) for i in range(70)] + [sample(1, 0, "x" * 5000, 0)]
    rules = tree.call_paths(frame(spark, deep), block_rows=16).filter("path_rule IS NOT NULL").select(*SAMPLE, "path_rule").collect()
    assert {(r.thread_index, r.sample_index, r.path_rule) for r in rules} == {(0, i, "depth") for i in range(65, 70)} | {(1, 0, "path_bytes")}


def test_unclosed_tree(spark):
    rows = [sample(0, 0, "A", 2), sample(0, 1, "B", 0)]
    rules = {r.rule for r in validate.tree_closed(tree.with_tree(frame(spark, rows))).collect()}
    assert rules == {"children_out_of_range", "tree_not_closed"}


def test_category_sums_drop_unknown(spark):
    rows = [sample(0, 0, "R", 1, 10.0), sample(0, 1, "S", 0, 4.0)]
    df = frame(spark, rows).withColumn("category_index", F.when(F.col("sample_index") == 0, 33).otherwise(999))
    found = tree.cpu_by_category(tree.with_tree(df)).first()
    assert (found.physics_ms, found.scripts_ms, found.others_ms) == (6.0, 0.0, 0.0)


@pytest.mark.parametrize("block_rows", [2, 5, 1000])
def test_rollup_over_blocks_is_the_sum_over_ancestors(spark, block_rows):
    rng = random.Random(block_rows)
    threads = [random_thread(rng, t, rng.randint(1, 70), t % 4 == 0) for t in range(30)]
    sizes = {(r[0][2], r[0][3]): rng.choice([None, 0, 7, 2**64 - 1, 2**63, 2**32]) for t in threads for r in t}
    rows = [(*r[0][:8], None if (v := sizes[r[0][2], r[0][3]]) is None else Decimal(v), *r[0][9:]) for t in threads for r in t]
    got = {(r.thread_index, r.sample_index): int(r.inclusive_bytes) for r in tree.rollup_bytes(frame(spark, rows), block_rows=block_rows).collect()}
    want = dict.fromkeys(sizes, 0)
    for t in threads:
        parents = {r[0][3]: r[1] for r in t}
        for r in t:
            at = r[0][3]
            while at is not None:
                want[r[0][2], at] += sizes[r[0][2], r[0][3]] or 0
                at = parents[at]
    assert got == want


def test_long_chains_and_flat_threads_in_arrays():
    import time

    import numpy as np

    from framescope.operators.brackets import Blocks, depths, ends

    begun = time.perf_counter()
    for children in (np.r_[10**7 - 1, np.zeros(10**7 - 1, int)], np.r_[np.ones(10**6 - 1, int), 0]):
        starts = np.arange(len(children)) == 0
        blocks = Blocks.of(starts, children, np.zeros(len(children), bool))
        parents, flat = blocks.parents(), children[0] > 1
        assert (parents[1:] == (0 if flat else np.arange(len(children) - 1))).all() and (ends(parents)[0], parents[0]) == (len(children), -1)
        assert (depths(parents) == (np.minimum(np.arange(len(children)), 1) if flat else np.arange(len(children)))).all()
    assert time.perf_counter() - begun < 60


def test_finding_long_threads_moves_no_samples(spark):
    """All samples were shuffled to be matched with the threads of more than one block, of which there are few."""
    rows = spark.range(100).selectExpr("'a' AS capture_id", "id % 5 AS frame_index", "0L AS thread_index", "id DIV 5 AS sample_index", "'m' AS marker_name", "0L AS children_count")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (tree.with_tree(rows, block_rows=4), tree.with_tree(rows, long_threads=rows.filter("sample_index >= 4").select(*THREAD).distinct(), block_rows=4)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_closed_trees_are_checked_on_one_rebuilt_tree(spark):
    from framescope.plans.catalog import QUERIES

    plan = QUERIES["v4_tree_closed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapGroups" not in plan
