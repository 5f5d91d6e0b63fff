import random

import pytest
from pyspark.sql import functions as F

from framescope.functions.windows import BUCKET_ROWS_CONF, numbered, page, rank_stats, running


def skewed(spark, rows=600):
    rng = random.Random(3)
    data = [("hot" if n % 3 == 0 else f"k{n % 7}", rng.randrange(40), n, float(rng.randrange(9))) for n in range(rows)]
    return data, spark.createDataFrame(data, "k STRING, a INT, b INT, v DOUBLE")


@pytest.fixture(params=[3, 40, 250_000])
def buckets(spark, request):
    spark.conf.set(BUCKET_ROWS_CONF, str(request.param))
    yield
    spark.conf.unset(BUCKET_ROWS_CONF)


def test_running_matches_brute_force(spark, buckets):
    data, df = skewed(spark)
    out = running(
        df, ["k"], ["a", "b"],
        {"n": ("count", None), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("b"))},
        {"size": ("count", None), "total": ("sum", F.col("v"))},
    )
    expected = []
    for k in {d[0] for d in data}:
        group = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
        for i, d in enumerate(group):
            before = [g[3] for g in group[:i]]
            expected.append((k, d[2], i, sum(before), max(before, default=None), group[i - 1][2] if i else None, len(group), sum(g[3] for g in group)))
    got = [(r.k, r.b, r.n, r.s, r.m, r.l, r.size, r.total) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_numbered_without_keys_and_deep_page(spark):
    _, df = skewed(spark)
    assert sorted(r.row_pos for r in numbered(df, [], ["a", "b"]).collect()) == list(range(600))
    deep = page(df.withColumn("k", F.lit("x")), ["k"], ["a", "b"], 550, 600)
    assert [r.row_pos for r in deep.orderBy("row_pos").collect()] == list(range(550, 600))


def test_rank_stats_nearest_rank(spark):
    def brute(values, q):
        values = sorted(values)
        return values[int((len(values) - 1) * q + 0.5)]

    groups = {"a": list(range(11)), "b": [0, 32], "c": [5] * 40 + [1], "d": [random.Random(1).randrange(500) for _ in range(700)]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    out = {r.k: r for r in rank_stats(spark.createDataFrame(rows, "k STRING, v DOUBLE"), "v", ["k"]).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        assert (out[k].p50, out[k].p95, out[k].p99, out[k].max, out[k].valid) == (brute(vs, 0.5), brute(vs, 0.95), brute(vs, 0.99), max(vs), len(vs))
    assert (out["b"].p50, out["a"].p50, out["a"].p95) == (32, 5, 10)


def test_null_keys_and_no_job_while_building(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 1)], "k STRING, n INT")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = running(df, ["k"], ["n"], {"before": ("sum", F.col("n"))})
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert {(r.k, r.n, r.before) for r in out.collect()} == {(None, 1, 0), (None, 2, 1), ("x", 1, 0)}


def test_bounded_groups_give_what_buckets_give(spark):
    rows = [(None if k % 5 == 0 else k % 3, k, None if k % 4 == 0 else k * 7 % 11) for k in range(60)]
    table = spark.createDataFrame(rows, "key int, n int, v int")
    prefix = {"rows": ("count", None), "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "before": ("last", F.col("v"))}
    totals = {"many": ("count", None), "whole": ("sum", F.col("v"))}
    one, other = (running(table, ["key"], ["n"], prefix, totals, bounded=b).collect() for b in (False, True))
    assert sorted(map(repr, one)) == sorted(map(repr, other)) and len(one) == 60


def test_rows_of_uncut_keys_are_shuffled_once_and_no_row_carries_all_splitters(spark, buckets):
    rows = [("hot" if n % 2 else f"k{n % 50}", n * 7 % 1009, float(n % 5)) for n in range(1000)]
    df = spark.createDataFrame(rows, "k STRING, a INT, v DOUBLE")
    out = running(df, ["k"], ["a"], {"n": ("count", None)}, {"size": ("count", None)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and plan.count("LeftOuter") >= 3 and "Inner" not in plan
    groups = {k: sorted(a for key, a, _ in rows if key == k) for k, _, _ in rows}
    assert {(r.k, r.a): (r.n, r.size) for r in out.collect()} == {(k, a): (i, len(g)) for k, g in groups.items() for i, a in enumerate(g)}
