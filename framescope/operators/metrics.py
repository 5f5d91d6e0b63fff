"""Per-recording metrics: order statistics, quality roll-ups, hotspots, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.windows import RANKS, rank_stats
from framescope.schemas import COMPARED_METRICS, MEMORY_COUNTERS, RENDER_COUNTERS, U64_MAX

DEFAULT_REASON = "not provided by the input or not yet verified"
UNVERIFIED_REASON = "version not verified; no firm verdict on targets"
ESTIMATED_REASON = "contains estimates, not observations"
STATS = [*RANKS, "max"]

# Frames column of each rendering counter.
RENDER_COLUMNS = dict(zip(RENDER_COUNTERS, ["draw_calls", "set_pass_calls", "batches", "triangles", "vertices"]))


def quality(frames: DataFrame, valid: Column, keys: list[str] | None = None) -> DataFrame:
    """M2: status, valid and total frames, source of the first frame, sorted reasons."""
    keys = keys or ["capture_id"]
    flag = F.coalesce(valid, F.lit(False))
    marked = frames.withColumn("__valid", flag)
    summary = marked.groupBy(*keys).agg(
        F.count_if("__valid").alias("valid_frames"),
        F.count(F.lit(1)).alias("total_frames"),
        F.bool_or(F.col("version_verified").eqNullSafe(False)).alias("unverified"),
        F.bool_or(F.col("__valid") & F.col("estimated")).alias("any_estimated"),
        F.min_by("source", "position").alias("source"),
    )
    # Reasons are made distinct before they are gathered, so the list is short.
    reasons = (
        marked.filter(~F.col("__valid"))
        .select(*keys, F.explode("reasons").alias("reason"))
        .distinct()
        .groupBy(*keys)
        .agg(F.collect_set("reason").alias("found"))
    )
    none = F.array().cast("array<string>")
    joined = summary.join(reasons, keys, "left")
    found = F.coalesce("found", none)
    partial = F.col("valid_frames") < F.col("total_frames")
    notes = F.array_compact(
        F.array(
            F.when(partial & (F.size(found) == 0), F.lit(DEFAULT_REASON)),
            F.when(F.col("unverified"), F.lit(UNVERIFIED_REASON)),
            F.when(F.col("any_estimated"), F.lit(ESTIMATED_REASON)),
        )
    )
    status = (
        F.when(F.col("valid_frames") == 0, F.lit("unavailable"))
        .when(partial, F.lit("partial"))
        .when(F.col("unverified"), F.lit("unverified"))
        .when(F.col("any_estimated"), F.lit("estimated"))
        .otherwise(F.lit("available"))
    )
    return joined.select(
        *keys,
        status.alias("status"),
        "source",
        "valid_frames",
        "total_frames",
        F.array_sort(F.array_distinct(F.concat(found, notes))).alias("reasons"),
    )


def counter_quality(frames: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """M3: quality of one rendering counter; other metrics' reasons are left out."""
    base = quality(frames, F.col(RENDER_COLUMNS[name]).isNotNull(), keys)
    own = F.filter("reasons", lambda r: r.startswith(f"{name}:") | (r == ESTIMATED_REASON))
    missing = (F.col("valid_frames") < F.col("total_frames")) & (F.size("reasons") == 0)
    default = F.array(F.lit(f"{name}: no valid count in the input"))
    return base.withColumn("reasons", own).withColumn(
        "reasons", F.when(missing, default).otherwise(F.col("reasons"))
    )


def metric_rank_stats(frames: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """M1: p50, p95, p99 and max of one frames column per recording."""
    keys = keys or ["capture_id"]
    return rank_stats(frames, value, keys).select(*keys, *STATS)


def _hotspots(markers: DataFrame) -> DataFrame:
    totals = markers.groupBy("capture_id", "name").agg(
        F.sum("total_ms").alias("total_ms"), F.sum("call_count").alias("call_count"), F.max("max_ms").alias("max_ms")
    )
    mean = F.when(F.col("call_count") == 0, F.lit(0.0)).otherwise(F.col("total_ms") / F.col("call_count"))
    return totals.withColumn("avg_ms", mean)


def cpu_hotspots(markers: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """M4: per marker total, calls, longest and mean milliseconds over frames with valid samples."""
    if frames is not None:
        valid = frames.filter("samples_valid").select("capture_id", "frame_index")
        markers = markers.join(valid, ["capture_id", "frame_index"], "left_semi")
    return _hotspots(markers)


def render_hotspots(events: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """M6: the same over rendering events."""
    if frames is not None:
        valid = frames.filter("render_valid").select("capture_id", "frame_index")
        events = events.join(valid, ["capture_id", "frame_index"], "left_semi")
    return _hotspots(events)


def gc_hotspots(sites: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """M5: per thread and site bytes, allocations, mean and largest allocation (saturating)."""
    if frames is not None:
        valid = frames.filter("sites_valid").select("capture_id", "frame_index")
        sites = sites.join(valid, ["capture_id", "frame_index"], "left_semi")
    cap = F.lit(U64_MAX)
    totals = sites.groupBy("capture_id", "thread", "name").agg(
        F.least(F.coalesce(F.try_sum("total_bytes"), cap), cap).cast("decimal(20,0)").alias("total_bytes"),
        F.sum("call_count").alias("call_count"),
        F.max("max_bytes").alias("max_bytes"),
    )
    mean = F.when(F.col("call_count") == 0, F.lit(0.0)).otherwise(F.col("total_bytes").cast("double") / F.col("call_count"))
    return totals.withColumn("avg_bytes", mean)


def gc_totals(frames: DataFrame) -> DataFrame:
    """M7: allocated bytes over valid frames (NULL if none or beyond 64 bits) and their ranks."""
    total = F.try_sum("gc_bytes")
    limit = F.lit(U64_MAX)
    none = F.lit(None).cast("bigint")
    sums = frames.groupBy("capture_id").agg(
        F.when(total <= limit, total).cast("decimal(20,0)").alias("total_alloc_bytes"),
        none.alias("gen0"), none.alias("gen1"), none.alias("gen2"),
    )
    bytes_as_number = frames.withColumn("gc_bytes", F.col("gc_bytes").cast("double"))
    return sums.join(metric_rank_stats(bytes_as_number, "gc_bytes"), "capture_id", "left")


def long_metrics(frames: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Unpivot metric columns to rows ``metric, value`` (value NULL where invalid)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in columns.items()])
    return frames.select("capture_id", "frame_index", "position", "estimated", "version_verified", F.inline(pairs))


def render_stats(frames: DataFrame) -> DataFrame:
    """M8: ranks and validity of the five rendering counters."""
    rows = long_metrics(frames, RENDER_COLUMNS)
    totals = rows.groupBy("capture_id", "metric").agg(
        F.count("value").alias("valid_frames"), F.count(F.lit(1)).alias("total_frames")
    )
    return totals.join(rank_stats(rows, "value", ["capture_id", "metric"]).select("capture_id", "metric", *STATS), ["capture_id", "metric"], "left")


def memory_summary(frames: DataFrame, observations: DataFrame, names: list[str] | None = None) -> DataFrame:
    """M9: peak, its last frame, first, last and exact change of every memory counter.

    ``observations``: capture_id, frame_index, name, value (unsigned 64 bit, NULL if invalid).
    """
    names = names or MEMORY_COUNTERS
    per_capture = frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_frames"))
    wanted = per_capture.select("*", F.explode(F.lit(names)).alias("name"))
    placed = observations.filter(F.col("value").isNotNull()).join(
        frames.select("capture_id", "frame_index", "position"), ["capture_id", "frame_index"]
    )
    found = placed.groupBy("capture_id", "name").agg(
        F.max("value").alias("peak"),
        F.max_by("frame_index", F.struct("value", "position")).alias("peak_frame"),
        F.min_by("value", "position").alias("first"),
        F.max_by("value", "position").alias("last"),
        F.count(F.lit(1)).alias("valid"),
    )
    valid = F.coalesce("valid", F.lit(0))
    status = (
        F.when(valid == 0, F.lit("unavailable"))
        .when(valid < F.col("total_frames"), F.lit("partial"))
        .otherwise(F.lit("unverified"))
    )
    return wanted.join(found, ["capture_id", "name"], "left").select(
        "capture_id", "name", "peak", "peak_frame", "first", "last",
        (F.col("last") - F.col("first")).cast("decimal(21,0)").alias("delta"),
        valid.alias("valid_frames"), "total_frames", status.alias("status"),
        F.lit("pending-editor-comparison").alias("validation"),
    )


def timeline(frames: DataFrame) -> DataFrame:
    """One row per frame; invalid metrics are NULL."""
    return frames.select(
        "capture_id", "position", "frame_index", F.col("cpu_ms").alias("ms"), F.col("frame_ms").alias("frame_time_ms"),
        F.col("gc_bytes").alias("gc_alloc_bytes"), "draw_calls", "set_pass_calls",
    )


def session_meta(frames: DataFrame, captures: DataFrame) -> DataFrame:
    """Total valid duration (NULL if none), declared and actual frames, platform, version, source."""
    per_capture = frames.groupBy("capture_id").agg(
        F.sum("frame_ms").alias("duration_ms"),
        F.count(F.lit(1)).alias("frame_count"),
        F.min_by("source", "position").alias("source"),
    )
    return captures.join(per_capture, "capture_id", "left").select(
        "capture_id", "duration_ms", "declared_frame_count",
        F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
        "platform", "version", F.coalesce("source", F.lit("unknown")).alias("source"),
    )


def session_summary(frames: DataFrame, captures: DataFrame, hotspot_counts: DataFrame) -> DataFrame:
    """One row per recording with structs for cpu, gc and rendering, and hotspot counts."""

    def part(name: str, column: str) -> DataFrame:
        as_number = frames.withColumn(column, F.col(column).cast("double"))
        stats = metric_rank_stats(as_number, column)
        rated = quality(frames, F.col(column).isNotNull()).join(stats, "capture_id", "left")
        return rated.select("capture_id", F.struct(*STATS, "status", "valid_frames", "total_frames", "reasons").alias(name))

    summary = session_meta(frames, captures)
    for name, column in (("cpu", "cpu_ms"), ("gc", "gc_bytes"), ("rendering", "draw_calls")):
        summary = summary.join(part(name, column), "capture_id", "left")
    return summary.join(hotspot_counts, "capture_id", "left")


MAX_LISTED, MAX_TEXT = 5, 256
CUT_MARK = "…[cut; see the original frame]"


def compact_descriptions(df: DataFrame, lists: list[str] = ("reasons",), texts: list[str] = ()) -> DataFrame:
    """Cut reason lists to five with total and flag, and long texts to 256 characters."""

    def cut(text: Column) -> Column:
        return F.when(F.char_length(text) > MAX_TEXT, F.concat(F.left(text, F.lit(MAX_TEXT)), F.lit(CUT_MARK))).otherwise(text)

    columns: dict[str, Column] = {}
    for name in lists:
        columns[name] = F.transform(F.slice(name, 1, MAX_LISTED), cut)
        columns[f"{name}_total"] = F.size(name)
        columns[f"{name}_truncated"] = F.size(name) > MAX_LISTED
    for name in texts:
        columns[name] = cut(F.col(name))
    return df.withColumns(columns)


def metric_stats(frames: DataFrame) -> DataFrame:
    """Ranks, mean and counts of the eight compared metrics.

    Estimated and unverified frames do not take part, nor do negative or
    non-finite values; how many were left out is reported.
    """
    usable = ~F.coalesce("estimated", F.lit(False)) & ~F.col("version_verified").eqNullSafe(False)
    rows = long_metrics(frames, COMPARED_METRICS)
    v = F.col("value")
    fit = usable & (v >= 0) & (v < float("inf"))
    valued = rows.withColumn("value", F.when(fit, v))
    keys = ["capture_id", "metric"]
    totals = valued.groupBy(*keys).agg(
        F.count("value").alias("valid_frames"),
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if(F.col("version_verified").eqNullSafe(False)).alias("unverified_excluded"),
        F.count_if(F.coalesce("estimated", F.lit(False))).alias("estimated_excluded"),
    )
    return totals.join(rank_stats(valued, "value", keys).select(*keys, *STATS, "mean"), keys, "left")

