"""Per-frame derivations: intervals, counters, compacted markers, allocation continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.scalars import editor_ms
from framescope.functions.windows import running
from framescope.operators.validate import main_root, reconcile_gc
from framescope.schemas import (
    ALLOC_MARKER, FRAME, MEMORY_COUNTERS, RENDER_COUNTERS, THREAD, U64_MAX,
)




def frame_cpu(frames: DataFrame, threads: DataFrame, tree: DataFrame) -> DataFrame:
    """milliseconds of the single root of the single main thread, else NULL."""
    return main_root(frames, threads, tree).select(*FRAME, "cpu_ms")


def frame_gc(frames: DataFrame, threads: DataFrame, samples: DataFrame) -> DataFrame:
    """allocated bytes over all threads, NULL when they do not reconcile."""
    return reconcile_gc(frames, threads, samples).select(*FRAME, "gc_bytes")


def interval_ms(start_ns: Column, next_ns: Column) -> Column:
    """Nanosecond difference to milliseconds in single precision, as recorded."""
    return editor_ms((next_ns - start_ns).cast("float"))


def frame_intervals(headers: DataFrame) -> DataFrame:
    """duration of a frame = start of the next frame minus its own start.

    Only if the next recorded frame follows at once (raw ids consecutive, not
    skipped) and time does not go back.  Frames are numbered without gaps, so
    the next frame is found by joining on ``frame_index + 1``.
    """
    following = headers.select(
        "capture_id",
        (F.col("frame_index") - 1).alias("frame_index"),
        F.col("raw_frame_id").alias("next_id"),
        F.col("start_ns").alias("next_start"),
        F.col("skipped").alias("next_skipped"),
    )
    joined = headers.join(following, FRAME, "left")
    chained = ~F.col("skipped") & F.col("next_id").isNotNull() & ~F.col("next_skipped")
    consecutive = F.col("next_id") == F.col("raw_frame_id") + 1
    forward = F.col("next_start") >= F.col("start_ns")
    valid = chained & consecutive & forward
    reason = (
        F.when(F.col("skipped"), F.lit("frame not recorded"))
        .when(~chained, F.lit("no next frame start"))
        .when(~consecutive, F.lit("raw frame ids not consecutive"))
        .when(~forward, F.lit("frame start goes back"))
    )
    return joined.select(
        *FRAME,
        "raw_frame_id",
        F.when(valid, interval_ms(F.col("start_ns"), F.col("next_start"))).alias("frame_ms"),
        reason.alias("reason"),
    )


def _agreed(value: str) -> list[Column]:
    """Counts and the common value of several observations of one counter in one frame."""
    return [
        F.count(F.lit(1)).alias("seen"), F.count(value).alias("usable"), F.min(value).alias("low"), F.max(value).alias("high"),
    ]


def render_counters(frames: DataFrame, observations: DataFrame) -> DataFrame:
    """one row per frame and rendering counter: the agreed value or the reason.

    ``observations``: capture_id, frame_index, name, value (NULL = unusable).
    """
    spark = frames.sparkSession
    names = spark.createDataFrame([(n,) for n in RENDER_COUNTERS], "name STRING")
    wanted = frames.select(*FRAME, F.explode(F.lit(RENDER_COUNTERS)).alias("name"))
    found = observations.join(F.broadcast(names), "name", "left_semi").groupBy(*FRAME, "name").agg(*_agreed("value"))
    joined = wanted.join(found, [*FRAME, "name"], "left")
    agreed = (F.col("usable") == F.col("seen")) & (F.col("low") == F.col("high"))
    reason = (
        F.when(F.col("seen").isNull(), F.lit("not recorded"))
        .when(F.col("usable") < F.col("seen"), F.lit("metadata missing, unknown or negative"))
        .when(F.col("low") != F.col("high"), F.lit("observations of one frame conflict"))
    )
    return joined.select(*FRAME, "name", F.when(agreed, F.col("low")).alias("value"), reason.alias("reason"))


def memory_observation_value(observed: DataFrame) -> DataFrame:
    """Value or reason of each memory counter sample (``fields``, ``unit``, ``payload_type``, ``value``)."""
    number = F.when(F.col("value").rlike(r"^\+?[0-9]+$"), F.col("value").try_cast("decimal(38,0)"))
    in_range = F.when(number <= F.lit(U64_MAX), number.cast("decimal(20,0)"))
    reason = (
        F.when(~F.col("is_counter"), F.lit("counter flag missing"))
        .when((F.col("metadata_count") != 1) | (F.col("fields") != 1), F.lit("metadata missing or field count differs"))
        .when(~F.col("unit").eqNullSafe("bytes"), F.lit("unit is not bytes"))
        .when(~F.coalesce(F.col("payload_type").isin(2, 3, 4, 5), F.lit(False)), F.lit("payload is not an integer"))
        .when(in_range.isNull(), F.lit("negative or invalid integer"))
    )
    return observed.withColumn("sample_reason", reason).withColumn(
        "bytes", F.when(F.col("sample_reason").isNull(), in_range)
    )


MAX_SOURCES = 16


def memory_counters(frames: DataFrame, observed: DataFrame) -> DataFrame:
    """one row per frame and memory counter: agreed bytes, reason, first sources.

    ``observed``: capture_id, frame_index, thread_index, thread_id, sample_index,
    marker_id, name, is_counter, metadata_count, fields, unit, payload_type, value.
    """
    names = frames.sparkSession.createDataFrame([(n,) for n in MEMORY_COUNTERS], "name STRING")
    valued = memory_observation_value(observed.join(F.broadcast(names), "name", "left_semi"))
    place = F.struct("thread_index", "sample_index")
    keys = [*FRAME, "name"]
    found = valued.groupBy(*keys).agg(
        *_agreed("bytes"), F.max_by("sample_reason", F.when(F.col("sample_reason").isNotNull(), place)).alias("why")
    )
    ranked = valued.withColumn(
        "n", F.row_number().over(Window.partitionBy(*keys).orderBy("thread_index", "sample_index"))
    ).filter(F.col("n") <= MAX_SOURCES)
    sources = ranked.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("n", "thread_id", "sample_index", "marker_id"))),
            lambda s: F.struct(s["thread_id"].alias("thread_id"), s["sample_index"].alias("sample_index"), s["marker_id"].alias("marker_id")),
        ).alias("sources")
    )
    wanted = frames.select(*FRAME, F.explode(F.lit(MEMORY_COUNTERS)).alias("name"))
    joined = wanted.join(found, keys, "left").join(sources, keys, "left")
    agreed = (F.col("usable") == F.col("seen")) & (F.col("low") == F.col("high"))
    reason = (
        F.when(F.col("seen").isNull(), F.lit("counter not recorded"))
        .when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("low") != F.col("high"), F.lit("observations of one frame conflict"))
    )
    return joined.select(
        *keys,
        F.when(agreed, F.col("low")).alias("value"),
        reason.alias("reason"),
        "sources",
        F.coalesce("seen", F.lit(0)).alias("source_count"),
    )


def compact_markers(markers: DataFrame) -> DataFrame:
    """per frame and marker: total ms, calls and longest call."""
    return markers.groupBy(*FRAME, "name").agg(
        F.sum("total_ms").alias("total_ms"),
        F.try_sum("call_count").alias("call_count"),
        F.max("max_ms").alias("max_ms"),
    )


def compact_overflow(compacted: DataFrame) -> DataFrame:
    """Frames whose compacted totals are not finite or do not fit."""
    bad = F.isnan("total_ms") | (F.abs("total_ms") == float("inf")) | F.col("call_count").isNull()
    return compacted.filter(F.coalesce(bad, F.lit(True)))


def main_markers(tree: DataFrame, cpu: DataFrame) -> DataFrame:
    """Samples of the valid main thread as markers of one call each."""
    main = cpu.filter("cpu_valid").select(*FRAME, F.col("main_thread_index").alias("thread_index"))
    return tree.join(main, THREAD).select(
        *FRAME,
        F.col("marker_name").alias("name"),
        F.col("time_ms").alias("total_ms"),
        F.lit(1).cast("bigint").alias("call_count"),
        F.col("time_ms").alias("max_ms"),
    )


def compact_sites(sites: DataFrame) -> DataFrame:
    """per frame, thread label and site: bytes, allocations, largest; NULL on overflow."""
    limit = F.lit(U64_MAX)
    total = F.try_sum("total_bytes")
    return sites.groupBy(*FRAME, "thread", "name").agg(
        F.when(total <= limit, total).cast("decimal(20,0)").alias("total_bytes"),
        F.try_sum("call_count").alias("call_count"),
        F.max("max_bytes").alias("max_bytes"),
    )


def alloc_sites(attributed: DataFrame, threads: DataFrame, gc_flags: DataFrame) -> DataFrame:
    """Allocation sites of the frames that reconcile, one row per allocation."""
    label = F.concat_ws(" #", "thread_name", "thread_index")
    # Threads are held against the frames, not their allocations: those are joined once.
    kept = threads.select(*THREAD, "thread_name").join(gc_flags.filter("gc_valid").select(*FRAME), FRAME, "left_semi")
    return attributed.filter(F.col("gc_alloc_bytes").isNotNull()).join(kept, THREAD).select(
        *FRAME,
        label.alias("thread"),
        F.col("site_name").alias("name"),
        F.col("gc_alloc_bytes").alias("total_bytes"),
        F.lit(1).cast("bigint").alias("call_count"),
        F.col("gc_alloc_bytes").alias("max_bytes"),
    )


def render_events(samples: DataFrame, threads: DataFrame) -> DataFrame:
    """F8: rendering samples that took time, named ``thread #position / marker``."""
    kept = samples.filter((F.col("category_index") == 0) & ~F.col("is_counter") & (F.col("time_ms") > 0))
    named = kept.join(threads.select(*THREAD, "thread_name"), THREAD)
    return named.select(
        *FRAME,
        F.format_string("%s #%d / %s", "thread_name", "thread_index", "marker_name").alias("name"),
        F.col("time_ms").alias("total_ms"),
        F.lit(1).cast("bigint").alias("call_count"),
        F.col("time_ms").alias("max_ms"),
    )


SENTINEL_MARKER = 2**32 - 1


def alloc_continuation(headers: DataFrame, threads: DataFrame, raw: DataFrame) -> DataFrame:
    """mark the zero-length repeat of an allocation that ended the previous frame.

    ``raw``: samples with parent_index, marker_id, duration_ns, start_ns,
    children_count, gc_bytes.  Adds ``gc_continuation``; such a sample carries
    no bytes and no call.  An allocation with neither record nor continuation
    gets ``gc_missing``.
    """
    last = raw.groupBy(*THREAD).agg(
        F.max_by(F.struct("marker_id", "marker_name", "duration_ns", "start_ns", "children_count", "gc_bytes"), "sample_index").alias("t")
    )
    whole = F.col("t.duration_ns").cast("decimal(20,0)")
    ended = last.filter(
        F.col("t.gc_bytes").isNotNull()
        & (F.col("t.duration_ns") > 0)
        & (F.col("t.duration_ns").cast("double") == whole.cast("double"))
        & (F.col("t.children_count") == 0)
    ).select(*THREAD, F.col("t.marker_id").alias("marker_id"), (F.col("t.start_ns") + whole).alias("end_ns"))
    identity = threads.select(*THREAD, "thread_id", F.coalesce("thread_group_name", F.lit("")).alias("g"), "thread_name")
    frame_of = headers.filter(~F.col("skipped")).select(*FRAME, "raw_frame_id", F.col("start_ns").alias("frame_start"))
    before = (
        ended.join(identity, THREAD)
        .join(frame_of, FRAME)
        .select("capture_id", (F.col("raw_frame_id") + 1).alias("raw_frame_id"), (F.col("frame_index") + 1).alias("frame_index"),
                "thread_id", "g", "thread_name", "marker_id", F.col("end_ns").alias("frame_start"))
        .withColumn("continues", F.lit(True))
    )
    roots = (
        raw.filter(
            (F.col("sample_index") == 0) & (F.col("marker_id") == SENTINEL_MARKER) & F.col("parent_index").isNull()
        )
        .select(*THREAD, F.col("start_ns").alias("root_start"))
    )
    candidates = (
        raw.filter(
            (F.col("marker_name") == ALLOC_MARKER)
            & F.col("gc_bytes").isNull()
            & (F.col("sample_index") == 1)
            & (F.col("parent_index") == 0)
            & (F.col("duration_ns") == 0)
            & (F.col("children_count") == 0)
        )
        .join(roots, THREAD)
        .join(frame_of, FRAME)
        .filter((F.col("root_start") == F.col("frame_start")) & (F.col("start_ns") == F.col("frame_start")))
        .join(identity, THREAD)
    )
    match = ["capture_id", "frame_index", "raw_frame_id", "thread_id", "g", "thread_name", "marker_id", "frame_start"]
    proven = candidates.join(before, match, "left_semi").select(*THREAD, "sample_index", F.lit(True).alias("gc_continuation"))
    joined = raw.join(proven, [*THREAD, "sample_index"], "left")
    continuation = F.coalesce("gc_continuation", F.lit(False))
    missing = (F.col("marker_name") == ALLOC_MARKER) & F.col("gc_bytes").isNull() & ~continuation
    return joined.withColumns({"gc_continuation": continuation, "gc_missing": missing})


def coverage(frames: DataFrame) -> DataFrame:
    """raw, decoded and skipped frames per recording, and the validation label."""
    skipped = F.col("source").endswith("-skipped")
    unverified = F.bool_or(F.col("version_verified").eqNullSafe(False))
    return frames.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("raw_blocks"),
        F.count_if(~skipped).alias("decoded_frames"),
        F.count_if(skipped).alias("skipped_frames"),
        F.lit(0).cast("bigint").alias("failed_frames"),
        F.when(unverified, F.lit("pending-editor-comparison")).otherwise(F.lit("limited-capture-comparison")).alias("validation"),
    )


def match_all_or_nothing(allocs: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """attach sizes to a group's allocations only if every one has exactly one."""
    keys = [*group, "sample_index"]
    single = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.max("size").alias("size"))
    joined = allocs.join(single, keys, "left")
    complete = joined.groupBy(*group).agg(F.bool_and(F.coalesce(F.col("records") == 1, F.lit(False))).alias("complete"))
    return joined.join(complete, group).select(
        *allocs.columns, F.when(F.col("complete"), F.col("size")).alias("size"), F.col("complete").alias("matched")
    )


RECORD_BYTES = 8


def longest_run(pairs: DataFrame, group: list[str]) -> DataFrame:
    """the longest run of adjacent records with rising sample index, the first on ties.

    ``pairs``: group columns, body_offset, sample_index.  One row per group:
    start offset, length, and the longest stretch inside it rising by one.
    """
    order = ["body_offset"]
    previous = running(
        pairs, group, order,
        {"before": ("last", F.struct("body_offset", "sample_index"))},
    )
    adjacent = F.coalesce(F.col("body_offset") == F.col("before.body_offset") + RECORD_BYTES, F.lit(False))
    extends = adjacent & (F.col("sample_index") > F.col("before.sample_index"))
    steps = adjacent & (F.col("sample_index") == F.col("before.sample_index") + 1)
    flagged = previous.withColumns(
        {"run_break": F.when(extends, 0).otherwise(1), "step_break": F.when(steps, 0).otherwise(1)}
    )
    islands = running(
        flagged, group, order, {"runs_before": ("sum", F.col("run_break")), "steps_before": ("sum", F.col("step_break"))}
    ).withColumns({"run": F.col("runs_before") + F.col("run_break"), "chain": F.col("steps_before") + F.col("step_break")})
    chains = islands.groupBy(*group, "run", "chain").agg(
        F.count(F.lit(1)).alias("chain_rows"), F.min("body_offset").alias("chain_start")
    )
    runs = chains.groupBy(*group, "run").agg(
        F.min("chain_start").alias("start_offset"),
        F.sum("chain_rows").alias("run_length"),
        F.max("chain_rows").alias("longest_step_chain"),
    )
    best = F.max_by(
        F.struct("start_offset", "run_length", "longest_step_chain"), F.struct("run_length", -F.col("start_offset"))
    )
    return runs.groupBy(*group).agg(best.alias("best")).select(*group, "best.*")


# Position of each named column in the 34-value memory vector (fixed values).
MEMORY_VECTOR_COLUMNS = {
    "system_used_bytes": 0, "committed_bytes": 2, "used_bytes": 4, "reserved_bytes": 5, "gc_used_bytes": 6,
    "gc_reserved_bytes": 7, "profiler_used_bytes": 8, "profiler_reserved_bytes": 9, "audio_used_bytes": 10,
    "video_used_bytes": 12, "gfx_used_bytes": 21, "gfx_reserved_bytes": 22, "texture_mem_bytes": 23,
    "texture_count": 24, "mesh_mem_bytes": 25, "mesh_count": 26, "material_count": 28, "material_mem_bytes": 27,
    "animation_clip_mem_bytes": 29, "animation_clip_count": 30, "asset_count": 16, "gc_alloc_frame_bytes": 20,
    "gc_alloc_frame_count": 19, "object_count": 33, "game_object_count": 18, "scene_object_count": 17,
}
# Invariants between vector positions (fixed values): (left, comparison, right).
MEMORY_VECTOR_ORDER = [(4, "<=", 5), (6, "<=", 7), (18, "<=", 16), (18, "<=", 17), (25, "<=", 23)]
MEMORY_VECTOR_POSITIVE = [4, 24, 26, 28, 30, 33]


def counter_invariants(vectors: DataFrame, values: str = "values") -> DataFrame:
    """check a 34-value memory vector and name its columns."""
    item = lambda n: F.get(F.col(values), F.lit(n))
    valid = F.size(values) == 34
    for left, _, right in MEMORY_VECTOR_ORDER:
        valid = valid & (item(left) <= item(right))
    for n in MEMORY_VECTOR_POSITIVE:
        valid = valid & (item(n) > 0)
    kept = [c for c in vectors.columns if c != values]
    return vectors.select(
        *kept,
        F.coalesce(valid, F.lit(False)).alias("valid"),
        *[item(n).alias(name) for name, n in MEMORY_VECTOR_COLUMNS.items()],
    )

