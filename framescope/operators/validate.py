"""Structural rules (rows to reject) and reconciliation flags (values to distrust).

A violation row is ``capture_id, frame_index, thread_index, sample_index, rule``;
``reject`` drops the offending recordings.  Flags never reject: they turn a
metric into NULL and keep the reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.schemas import ALLOC_MARKER, FRAME, MAIN_THREAD, THREAD, VERIFIED_VERSIONS

LOCATION = {"capture_id": "string", "frame_index": "bigint", "thread_index": "bigint", "sample_index": "bigint"}


def violation(rows: DataFrame, rule: str | Column) -> DataFrame:
    located = [
        (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in LOCATION.items()
    ]
    return rows.select(*located, (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_ids(frames: DataFrame, threads: DataFrame) -> DataFrame:
    """V1: a frame number twice in a recording, a thread index or id twice in a frame."""

    def repeated(df, keys):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    return union_all(
        [
            violation(repeated(frames, FRAME), "duplicate_frame_index"),
            violation(repeated(threads, THREAD), "duplicate_thread_index"),
            violation(repeated(threads, [*FRAME, "thread_id"]), "duplicate_thread_id"),
        ]
    )


def sample_positions(samples: DataFrame, position: str = "pos") -> DataFrame:
    """V2: ``sample_index`` must be the position in the exported list."""
    return violation(samples.filter(~F.col("sample_index").eqNullSafe(F.col(position))), "sample_index")


def _bad_time(column: str) -> Column:
    c = F.col(column)
    return F.coalesce(F.isnan(c) | (c < 0) | (c == float("inf")), F.lit(False))


def times(frames: DataFrame, samples: DataFrame) -> DataFrame:
    """V3: times are finite and not negative; a missing frame time is allowed."""
    bad_sample = _bad_time("time_ms") | _bad_time("start_time_ms") | F.col("time_ms").isNull() | F.col("start_time_ms").isNull()
    return union_all(
        [
            violation(frames.filter(_bad_time("frame_time_ms")), "frame_time"),
            violation(samples.filter(bad_sample), "sample_time"),
        ]
    )


def negative_times(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """V3 for the convention format: frame and marker times must not be negative."""
    return union_all(
        [
            violation(frames.filter((F.col("cpu_ms") < 0) | (F.col("frame_ms") < 0)), "frame_time"),
            violation(markers.filter((F.col("total_ms") < 0) | (F.col("max_ms") < 0)), "marker_time"),
        ]
    )


def tree_closed(tree: DataFrame) -> DataFrame:
    """V4: declared children fit in the rest of the thread, and none is left open.

    The tree is closed exactly when the declared child slots of a thread are as
    many as its samples that have a parent.
    """
    per_thread = tree.groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("children_count").alias("slots"),
        F.count("parent_index").alias("used"),
    )
    too_many = tree.join(per_thread.select(*THREAD, "n"), THREAD).filter(
        F.col("children_count") > F.col("n") - F.col("sample_index") - 1
    )
    return union_all(
        [
            violation(too_many, "children_out_of_range"),
            violation(per_thread.filter(F.col("slots") != F.col("used")), "tree_not_closed"),
        ]
    )


def sample_totals(frames: DataFrame, threads: DataFrame) -> DataFrame:
    """V5: samples over all threads add up to the frame's declared total."""
    actual = threads.groupBy(*FRAME).agg(F.sum("sample_count").alias("actual"))
    joined = frames.join(actual, FRAME, "left")
    return violation(
        joined.filter(F.coalesce("actual", F.lit(0)) != F.col("sample_count_total")), "sample_count_total"
    )


def reject(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Drop every recording that breaks a structural rule."""
    return df.join(violations.select("capture_id").distinct(), "capture_id", "left_anti")


def reconcile_gc(frames: DataFrame, threads: DataFrame, samples: DataFrame) -> DataFrame:
    """V6: allocation bytes agree between samples, threads and frame, or all are distrusted.

    One row per frame: ``gc_valid``, ``gc_bytes`` (NULL unless valid) and reasons.
    """
    complete = (F.col("metadata_count") > 0) & F.col("gc_alloc_bytes").isNotNull()
    per_thread = (
        samples.filter(F.col("marker_name") == ALLOC_MARKER)
        .groupBy(*THREAD)
        .agg(
            F.bool_and(complete).alias("complete"),
            F.sum(F.when(complete, F.col("gc_alloc_bytes"))).alias("bytes"),
        )
    )
    zero = F.lit(0).cast("decimal(30,0)")
    checked = threads.join(per_thread, THREAD, "left").select(
        *FRAME,
        F.coalesce("complete", F.lit(True)).alias("complete"),
        F.coalesce("bytes", zero).alias("bytes"),
        F.col("gc_alloc_total_bytes").eqNullSafe(F.coalesce("bytes", zero)).alias("total_ok"),
    )
    per_frame = checked.groupBy(*FRAME).agg(
        F.bool_and("complete").alias("complete"),
        F.bool_and("total_ok").alias("total_ok"),
        F.try_sum("bytes").alias("bytes"),
    )
    joined = frames.join(per_frame, FRAME, "left")
    frame_ok = F.col("bytes").isNotNull() & F.col("gc_alloc_bytes_total").eqNullSafe(F.col("bytes"))
    complete_ok = F.coalesce("complete", F.lit(True))
    thread_ok = F.coalesce("total_ok", F.lit(True))
    valid = frame_ok & complete_ok & thread_ok
    reasons = F.array_compact(
        F.array(
            F.when(~complete_ok, F.lit("allocation metadata missing")),
            F.when(~thread_ok, F.lit("thread allocation total missing or inconsistent")),
            F.when(~frame_ok, F.lit("frame allocation total missing or inconsistent")),
        )
    )
    return joined.select(
        *FRAME,
        valid.alias("gc_valid"),
        F.when(valid, F.col("bytes")).cast("decimal(20,0)").alias("gc_bytes"),
        reasons.alias("gc_reasons"),
    )


def main_root(frames: DataFrame, threads: DataFrame, tree: DataFrame) -> DataFrame:
    """V7/F1: CPU time of a frame is its main thread's root, if thread and root are unique."""
    main = threads.filter(F.col("thread_name") == MAIN_THREAD).groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("mains"), F.min("thread_index").alias("thread_index")
    )
    roots = (
        tree.filter(F.col("parent_index").isNull())
        .groupBy(*THREAD)
        .agg(F.count(F.lit(1)).alias("roots"), F.max(F.when(F.col("sample_index") == 0, F.col("time_ms"))).alias("root_ms"))
    )
    joined = frames.select(*FRAME).join(main, FRAME, "left").join(roots, THREAD, "left")
    valid = F.coalesce((F.col("mains") == 1) & (F.col("roots") == 1), F.lit(False))
    return joined.select(
        *FRAME,
        valid.alias("cpu_valid"),
        F.when(valid, F.col("root_ms")).alias("cpu_ms"),
        F.when(valid, F.col("thread_index")).alias("main_thread_index"),
        F.when(~valid, F.lit("main thread missing, duplicated or root not unique")).alias("cpu_reason"),
    )


def partial_export(captures: DataFrame, frames: DataFrame) -> DataFrame:
    """V8: one warning row per recording that exported another number of frames than declared."""
    actual = frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("exported"))
    exported = F.coalesce("exported", F.lit(0)).cast("bigint")
    return (
        captures.join(actual, "capture_id", "left")
        .filter(exported != F.col("declared_frame_count"))
        .select(
            "capture_id",
            exported.alias("exported"),
            "declared_frame_count",
            F.format_string("partial export: %d of %d frames", exported, "declared_frame_count").alias("warning"),
        )
    )


def version_rules(blocks: DataFrame) -> DataFrame:
    """V9: a recording has one version; only listed versions count as verified."""
    return blocks.groupBy("capture_id").agg(
        F.min("version").alias("version"), (F.min("version") == F.max("version")).alias("single_version")
    ).withColumn("version_verified", F.col("single_version") & F.col("version").isin(VERIFIED_VERSIONS))


def history_integrity(scenes: DataFrame, captures: DataFrame, rounds: DataFrame) -> DataFrame:
    """Repeated scenes, dangling scene ids, and rounds that use another scene's recording."""

    def rule(df, key, name):
        return df.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("rule"))

    ids = scenes.select("scene_id").distinct()
    repeated = scenes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    owners = captures.select("capture_id", F.col("scene_id").alias("capture_scene"))
    used = rounds.select("round_id", "scene_id", F.explode(F.array_compact(F.array("baseline", "candidate"))).alias("capture_id"))
    foreign = used.join(owners, "capture_id").filter(F.col("capture_scene") != F.col("scene_id"))
    return union_all(
        [
            rule(repeated, "scene_id", "duplicate_scene"),
            rule(captures.join(ids, "scene_id", "left_anti"), "capture_id", "capture_scene_missing"),
            rule(rounds.join(ids, "scene_id", "left_anti"), "round_id", "round_scene_missing"),
            rule(foreign.select("round_id").distinct(), "round_id", "round_uses_foreign_capture"),
        ]
    )


TASK_TEXTS = ["title", "evidence", "instructions", "acceptance"]
MAX_TASKS, MAX_MARKER_NAMES, MAX_NAME_BYTES = 20, 16, 200


def valid_marker_names(kind: Column, names: Column) -> Column:
    bad_name = F.exists(
        names,
        lambda n: (F.trim(n) == "") | (F.octet_length(n) > MAX_NAME_BYTES) | n.rlike(r"\p{Cc}"),
    )
    return (
        (F.size(names) <= MAX_MARKER_NAMES)
        & ((F.size(names) == 0) | (kind == "marker"))
        & ~bad_name
        & (F.size(F.array_distinct(names)) == F.size(names))
    )


def task_rules(tasks: DataFrame) -> DataFrame:
    """Problems of proposed tasks, one row per ``run_id, task_id, rule``."""
    names = F.coalesce("marker_names", F.array().cast("array<string>"))
    empty = F.lit(False)
    for column in TASK_TEXTS:
        empty = empty | (F.coalesce(F.col(column), F.lit("")) == "")
    rules = F.array_compact(
        F.array(
            F.when(~F.col("kind").isin("optimize", "marker"), F.lit("kind")),
            F.when(empty | (F.coalesce("file_count", F.lit(0)) == 0), F.lit("empty_field")),
            F.when(F.coalesce("file_count", F.lit(0)) > MAX_TASKS, F.lit("too_many_files")),
            F.when(~valid_marker_names(F.col("kind"), names), F.lit("marker_names")),
        )
    )
    per_task = tasks.select("run_id", "task_id", F.explode(rules).alias("rule"))
    repeated = tasks.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    count = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_TASKS)
    return union_all(
        [
            per_task.distinct(),
            repeated.select("run_id", "task_id", F.lit("duplicate_task").alias("rule")),
            count.select("run_id", F.lit(None).cast("string").alias("task_id"), F.lit("too_many_tasks").alias("rule")),
        ]
    )


def visible_bytes(samples: DataFrame, gc_flags: DataFrame) -> DataFrame:
    """Detail rows show allocation bytes only on allocations of frames that reconcile."""
    joined = samples.join(gc_flags.select(*FRAME, "gc_valid"), FRAME, "left")
    shown = F.coalesce("gc_valid", F.lit(False)) & (F.col("marker_name") == ALLOC_MARKER)
    return joined.withColumn("gc_alloc_bytes", F.when(shown, F.col("gc_alloc_bytes"))).drop("gc_valid")


