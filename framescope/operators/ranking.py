"""Bounded questions: pages, top-k lists, screening and frame comparison.

Every operator answers for all recordings (or frames) in its input at once;
restrict the input first to ask about one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.scalars import flow_kind
from framescope.functions.windows import page
from framescope.operators.metrics import STATS, long_metrics, quality
from framescope.operators.validate import union_all
from framescope.functions.windows import rank_stats
from framescope.schemas import FRAME, MAIN_THREAD, SAMPLE, THREAD

PAGE_BYTES = 20 * 1024
HOTSPOT_ORDERS = {
    "cpu": lambda: [-F.col("total_ms"), F.col("name")],
    "rendering": lambda: [-F.col("total_ms"), F.col("name")],
    "gc": lambda: [-F.col("total_bytes"), F.col("thread"), F.col("name")],
}


def check_page(start: int, limit: int, largest: int) -> None:
    if start < 0 or not 1 <= limit <= largest:
        raise ValueError(f"start must be >= 0 and limit in 1..{largest}")


def paged(df: DataFrame, keys: list[str], order: list[Column | str], start: int, limit: int) -> DataFrame:
    """A page per group with ``row_pos``, group ``total`` and ``next_start`` (NULL on the last page)."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rows = page(df, keys, order, start, limit)
    stop = start + limit
    return rows.join(totals, keys).withColumn("next_start", F.when(F.col("total") > stop, F.lit(stop).cast("bigint")))


def hotspots_page(hotspots: DataFrame, rated: DataFrame, area: str, start: int = 0, limit: int = 50) -> DataFrame:
    """Q1: ranked hotspots of one area, with total, next page and the quality of the aggregate."""
    if area not in HOTSPOT_ORDERS:
        raise ValueError("area must be cpu, gc or rendering")
    check_page(start, limit, 50)
    rows = paged(hotspots, ["capture_id"], HOTSPOT_ORDERS[area](), start, limit).withColumnRenamed("row_pos", "rank")
    if area == "gc":
        rows = rows.withColumnRenamed("call_count", "allocation_count")
    return rows.join(rated.select("capture_id", "status"), "capture_id", "left")


def target_hotspots(hotspots: DataFrame, rated: DataFrame, area: str, names: list[str], start: int = 0, limit: int = 50) -> DataFrame:
    """Q2: hotspots with one of the exact names, ranked among themselves, and the names never seen.

    Unseen names come as rows with ``observed`` false and no rank.
    """
    if area not in ("cpu", "gc"):
        raise ValueError("exact names work for cpu and gc")
    if not 1 <= len(names) <= 20 or len(set(names)) != len(names) or any(not n.strip() or len(n) > 200 for n in names):
        raise ValueError("1..20 different names of at most 200 characters")
    scanned = hotspots.groupBy("capture_id").agg(F.count(F.lit(1)).alias("scanned"))
    hits = hotspots.filter(F.col("name").isin(names))
    rows = hotspots_page(hits, rated, area, start, limit).withColumn("observed", F.lit(True))
    wanted = scanned.select("capture_id", F.explode(F.lit(names)).alias("name"))
    unseen = wanted.join(hits.select("capture_id", "name").distinct(), ["capture_id", "name"], "left_anti")
    both = rows.unionByName(unseen.withColumn("observed", F.lit(False)), allowMissingColumns=True)
    return both.join(scanned, "capture_id")


def frames_page(timeline: DataFrame, start: int = 0, limit: int = 500) -> DataFrame:
    """Q3: timeline rows by position in the recording, not by frame number."""
    check_page(start, limit, 500)
    totals = timeline.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total"))
    stop = start + limit
    rows = timeline.filter((F.col("position") >= start) & (F.col("position") < stop))
    return rows.join(totals, "capture_id").withColumn("next_start", F.when(F.col("total") > stop, F.lit(stop).cast("bigint")))


def frame_threads(threads: DataFrame, start: int = 0, limit: int = 128) -> DataFrame:
    """Q4: threads of each frame, paged."""
    check_page(start, limit, 128)
    return paged(threads, FRAME, ["thread_index"], start, limit)


DEPTH_WARNING = "depth truncated: hidden samples may include nested allocations"
PAGE_WARNING = "more samples follow: continue at next_start"


def hierarchy(timed_tree: DataFrame, start: int = 0, limit: int = 200, max_depth: int = 64) -> DataFrame:
    """Q5: call tree of each thread from ``start`` down to ``max_depth``, one page.

    Self time comes with the input, so the depth filter cannot change it.
    """
    check_page(start, limit, 500)
    if not 1 <= max_depth <= 64:
        raise ValueError("max_depth must be in 1..64")
    cut = timed_tree.groupBy(*THREAD).agg(F.bool_or(F.col("depth") >= max_depth).alias("depth_truncated"))
    shown = timed_tree.filter((F.col("sample_index") >= start) & (F.col("depth") < max_depth))
    rows = page(shown, THREAD, ["sample_index"], 0, limit + 1)
    following = F.max(F.when(F.col("row_pos") == limit, F.col("sample_index"))).over(Window.partitionBy(*THREAD))
    kept = rows.withColumn("next_start", following).filter(F.col("row_pos") < limit).join(cut, THREAD)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("depth_truncated"), F.lit(DEPTH_WARNING)),
            F.when(F.col("next_start").isNotNull(), F.lit(PAGE_WARNING)),
        )
    )
    return kept.withColumn("warnings", warnings)


def evidence(samples: DataFrame, threads: DataFrame, metadata: DataFrame, counters_only: bool = False, start: int = 0, limit: int = 50) -> DataFrame:
    """Q6: samples with metadata (or counters) of each frame with their typed fields.

    ``metadata``: sample keys, field_index, field_name, payload_type, value, unit, status.
    """
    check_page(start, limit, 50)
    wanted = samples.filter(F.col("is_counter") if counters_only else F.col("metadata_count") > 0)
    rows = paged(wanted, FRAME, ["thread_index", "sample_index"], start, limit)
    field = F.struct(
        "field_index",
        F.when(F.char_length("field_name") > 128, F.concat(F.left("field_name", F.lit(128)), F.lit("…[truncated]")))
        .otherwise(F.col("field_name")).alias("field_name"),
        "payload_type", "value", "unit", "status",
    )
    # Only the fields of the samples on the page are gathered.
    on_page = metadata.join(rows.select(*SAMPLE), SAMPLE, "left_semi")
    fields = on_page.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(field)).alias("metadata"))
    named = rows.join(fields, SAMPLE, "left").join(threads.select(*THREAD, "thread_id", "thread_name"), THREAD)
    present = F.coalesce(F.size("metadata"), F.lit(0))
    present = F.when(F.col("metadata").isNull(), F.lit(0)).otherwise(present)
    reason = F.when((F.col("metadata_count") > 0) & (present == 0), F.lit("no general metadata payload in the input")).when(
        F.col("metadata_count") > present, F.lit("field limit exceeded; not read completely")
    )
    return named.select(
        *SAMPLE, "row_pos", "total", "next_start", "thread_id", F.left("thread_name", F.lit(128)).alias("thread"),
        "marker_id", F.left("marker_name", F.lit(256)).alias("marker"), "is_counter", "metadata_count", "metadata",
        (F.col("metadata_count") > present).alias("metadata_truncated"), reason.alias("metadata_reason"),
    )


def flow_window(df: DataFrame, capture_id: str, frame: int, end_frame: int) -> DataFrame:
    """Rows of up to eight frames, marked as one window."""
    if end_frame < frame or end_frame - frame > 7:
        raise ValueError("a flow query covers at most 8 frames")
    kept = df.filter((F.col("capture_id") == capture_id) & F.col("frame_index").between(frame, end_frame))
    return kept.withColumn("window", F.lit(frame).cast("bigint"))


def flows(events: DataFrame, threads: DataFrame, samples: DataFrame, flow_id: int | None = None, start: int = 0, limit: int = 50) -> DataFrame:
    """Q7: flow events of each window in frame, thread and event order with their sample.

    ``events`` and ``threads`` carry a ``window`` column; ``threads.has_flow``
    tells whether flow data was recorded.  Totals cover the whole window; no
    edges are inferred.  A window without events gives one row without event.
    """
    check_page(start, limit, 50)
    keys = ["capture_id", "window"]
    chosen = events if flow_id is None else events.filter(F.col("flow_id") == flow_id)
    rows = page(chosen, keys, ["frame_index", "thread_index", "event_index"], start, limit)
    counts = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == 0).alias("begin_count"),
        F.count_if(F.col("event_type") == 2).alias("end_count"),
        F.count_if(F.col("event_type") > 3).alias("unknown_types"),
    )
    available = threads.groupBy(*keys).agg(F.bool_and("has_flow").alias("available"))
    owners = samples.select(
        *SAMPLE, F.left("marker_name", F.lit(240)).alias("marker"), "raw_start_ns", F.col("time_ms").alias("sample_ms")
    )
    placed = rows.join(owners, SAMPLE, "left").join(
        threads.select(*THREAD, "thread_id", F.left("thread_name", F.lit(160)).alias("thread")), THREAD, "left"
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "begin_count", "end_count", "unknown_types")}
    windows = available.join(counts, keys, "left").withColumns(zero)
    return windows.join(placed, keys, "left").withColumn("kind", F.when(F.col("event_type").isNotNull(), flow_kind(F.col("event_type"))))


def _side(name: str, on: Column) -> list[Column]:
    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(on, F.col(column))), F.lit(0))

    return [total(c).alias(f"{name}_{c}") for c in ("calls", "inclusive_ms", "self_ms", "self_valid", "gc_bytes")]


def path_totals(timed_tree: DataFrame) -> DataFrame:
    """Calls, inclusive, self and allocation totals per thread and call path."""
    return timed_tree.groupBy(*THREAD, "path").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("time_ms").alias("inclusive_ms"),
        F.coalesce(F.sum("self_ms"), F.lit(0.0)).alias("self_ms"),
        F.count("self_ms").alias("self_valid"),
        F.coalesce(F.sum("gc_alloc_bytes"), F.lit(0)).alias("gc_bytes"),
    )


def _compared_threads(threads: DataFrame, pairs: DataFrame, thread_index: int | None) -> DataFrame:
    """Pairs with the one thread to compare in each frame; ambiguous ones drop out."""
    pair = ["capture_id", "frame_index", "baseline_index"]

    def unique(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("thread_index").alias(name), F.min("thread_id").alias("id"))
        return found.filter("n = 1").drop("n")

    if thread_index is None:
        main = unique(threads.filter(F.col("thread_name") == MAIN_THREAD), FRAME, "thread_now").drop("id")
        before = main.select("capture_id", F.col("frame_index").alias("baseline_index"), F.col("thread_now").alias("thread_before"))
        return pairs.select(*pair).join(main, FRAME).join(before, ["capture_id", "baseline_index"])
    now = unique(threads.filter(F.col("thread_index") == thread_index), FRAME, "thread_now").withColumnRenamed("id", "thread_id")
    before = unique(threads, [*FRAME, "thread_id"], "thread_before").drop("id").withColumnRenamed("frame_index", "baseline_index")
    return pairs.select(*pair).join(now, FRAME).join(before, ["capture_id", "baseline_index", "thread_id"]).drop("thread_id")


def compare_frames(
    timed_tree: DataFrame, threads: DataFrame, gc_flags: DataFrame, pairs: DataFrame, thread_index: int | None = None,
    start: int = 0, limit: int = 50,
) -> DataFrame:
    """Q8: two frames of one recording matched by full call path.

    ``timed_tree`` has path and self time; ``pairs``: capture_id, frame_index,
    baseline_index.  The main thread is compared unless ``thread_index`` names
    another, which is matched by thread id.  Rows by inclusive change, largest
    first, then by path.
    """
    check_page(start, limit, 50)
    pair = ["capture_id", "frame_index", "baseline_index"]
    chosen = _compared_threads(threads, pairs, thread_index)
    now_threads = chosen.select("capture_id", "frame_index", F.col("thread_now").alias("thread_index"))
    then_threads = chosen.select("capture_id", F.col("baseline_index").alias("frame_index"), F.col("thread_before").alias("thread_index"))
    # Only the compared threads are summed, and each once however many pairs use it.
    compared = now_threads.unionByName(then_threads).distinct()
    # Samples of thread numbers that no pair compares are left out before the others are moved; numbers are as few as a frame has threads.
    numbers = F.broadcast(compared.select("thread_index").distinct())
    totals = path_totals(timed_tree.join(numbers, "thread_index", "left_semi").join(compared, THREAD, "left_semi"))
    # Flags join the pairs, one row each, and not their paths; as many rows come out as a frame has flags.
    valid = gc_flags.select(*FRAME, "gc_valid")
    base_valid = valid.select("capture_id", F.col("frame_index").alias("baseline_index"), F.col("gc_valid").alias("base_gc_valid"))
    both_valid = F.coalesce(F.col("gc_valid") & F.col("base_gc_valid"), F.lit(False))
    flags = (
        chosen.select(*pair).distinct().join(valid, FRAME, "left").join(base_valid, ["capture_id", "baseline_index"], "left")
        .groupBy(*pair).agg(F.collect_list(both_valid).alias("gc_flags"))
    )
    # Both sides of a pair in one table of places, so the totals are joined once.
    places = F.array(
        *(F.struct(F.col(at).alias("frame_index"), F.col(thread).alias("thread_index"), F.lit(now).alias("now"))
          for at, thread, now in (("frame_index", "thread_now", True), ("baseline_index", "thread_before", False)))
    )
    of_pair = F.struct(F.col("frame_index").alias("of_frame"), F.col("baseline_index").alias("of_baseline"), "gc_flags")
    sides = chosen.join(flags, pair).select("capture_id", of_pair.alias("of"), F.explode(places).alias("at")).select("capture_id", "at.*", "of.*")
    both = totals.join(sides, THREAD).drop("frame_index").withColumnsRenamed({"of_frame": "frame_index", "of_baseline": "baseline_index"})
    # a pair has one list of flags, so they part no group
    merged = both.groupBy(*pair, "path", "gc_flags").agg(*_side("baseline", ~F.col("now")), *_side("current", F.col("now")))
    flagged = merged.withColumn("gc_ok", F.explode("gc_flags"))
    gc_ok = F.col("gc_ok")
    self_ok = {s: F.col(f"{s}_calls") == F.col(f"{s}_self_valid") for s in ("baseline", "current")}
    rows = flagged.select(
        *pair, "path",
        *[F.col(f"{s}_{c}") for s in ("baseline", "current") for c in ("calls", "inclusive_ms")],
        *[F.when(F.col(f"{s}_calls") > 0, F.col(f"{s}_inclusive_ms") / F.col(f"{s}_calls")).alias(f"{s}_mean_ms") for s in ("baseline", "current")],
        *[F.when(self_ok[s], F.col(f"{s}_self_ms")).alias(f"{s}_self_ms") for s in ("baseline", "current")],
        *[F.when(gc_ok, F.col(f"{s}_gc_bytes")).alias(f"{s}_gc_bytes") for s in ("baseline", "current")],
        (F.col("current_inclusive_ms") - F.col("baseline_inclusive_ms")).alias("inclusive_delta_ms"),
        (F.col("current_calls") - F.col("baseline_calls")).alias("calls_delta"),
        F.when(self_ok["baseline"] & self_ok["current"], F.col("current_self_ms") - F.col("baseline_self_ms")).alias("self_delta_ms"),
        F.when(gc_ok, F.col("current_gc_bytes") - F.col("baseline_gc_bytes")).alias("gc_delta_bytes"),
    )
    return paged(rows, pair, [-F.col("inclusive_delta_ms"), F.col("path")], start, limit)


def memory_page(frames: DataFrame, observations: DataFrame, summary: DataFrame, name: str, start: int = 0, limit: int = 50) -> DataFrame:
    """Q9: observations of one memory counter by frame position, with its summary."""
    check_page(start, limit, 50)
    rows = frames_page(frames.select("capture_id", "position", "frame_index", "version_verified"), start, limit)
    seen = observations.filter(F.col("name") == name).select(*FRAME, "value", "reason")
    return rows.join(seen, FRAME, "left").join(summary.filter(F.col("name") == name), "capture_id", "left")


# Screening budgets (fixed values): area -> frames column, budget, unit, statistic that triggers.
BUDGETS = {
    "cpu": ("cpu_ms", 16.67, "ms", "max"),
    "gc": ("gc_bytes", 4.0 * 1024 * 1024, "bytes", "max"),
    "rendering": ("draw_calls", 1500.0, "count", "p95"),
}


def _areas(focus: str) -> dict[str, tuple]:
    if focus != "all" and focus not in BUDGETS:
        raise ValueError("focus must be all, cpu, gc or rendering")
    return {a: b for a, b in BUDGETS.items() if focus in ("all", a)}


def _area_values(frames: DataFrame, focus: str) -> DataFrame:
    return long_metrics(frames, {a: b[0] for a, b in _areas(focus).items()}).withColumnRenamed("metric", "area")


EVIDENCE_FRAMES, INVESTIGATION_FRAMES, SLOW_FRAMES = 5, 3, 20


def analysis(frames: DataFrame, focus: str = "all") -> DataFrame:
    """Q10: areas over the default budget, one issue row each with its five worst frames.

    Only areas whose quality is ``available`` are judged.
    """
    areas = _areas(focus)
    spark = frames.sparkSession
    budgets = F.broadcast(
        spark.createDataFrame(
            [(a, limit, unit, stat) for a, (_, limit, unit, stat) in areas.items()], "area STRING, budget DOUBLE, unit STRING, stat STRING"
        )
    )
    values = _area_values(frames, focus)
    keys = ["capture_id", "area"]
    stats = rank_stats(values, "value", keys).select(*keys, *STATS)
    rated = union_all(
        [quality(frames, F.col(c).isNotNull()).withColumn("area", F.lit(a)) for a, (c, *_) in areas.items()]
    ).select(*keys, "status", "source", "valid_frames")
    over = values.join(budgets.select("area", "budget"), "area").filter(F.col("value") > F.col("budget"))
    affected = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_frames"))
    worst = page(over, keys, [-F.col("value"), F.col("frame_index")], 0, EVIDENCE_FRAMES)
    shown = worst.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("row_pos", "frame_index", "value"))),
            lambda e: F.struct(e["frame_index"].alias("frame_index"), e["value"].alias("value")),
        ).alias("evidence_frames")
    )
    judged = stats.join(budgets, "area").join(rated.filter("status = 'available'"), keys)
    trigger = F.when(F.col("stat") == "p95", F.col("p95")).otherwise(F.col("max"))
    return (
        judged.filter(trigger > F.col("budget"))
        .join(affected, keys, "left")
        .join(shown, keys, "left")
        .select(
            *keys, F.lit("medium").alias("severity"), F.lit("threshold-exceeded").alias("kind"), "p95", "max", "budget", "unit", "source",
            F.when(F.col("p95") > F.col("budget"), F.lit("p95")).otherwise(F.lit("isolated-peak")).alias("trigger"),
            "affected_frames", "valid_frames", "evidence_frames",
        )
    )


def investigation_frames(frames: DataFrame, focus: str = "all") -> DataFrame:
    """Q11: the three highest frames of each area, over budget or not."""
    values = _area_values(frames, focus).filter(F.col("value").isNotNull())
    return page(values, ["capture_id", "area"], [-F.col("value"), F.col("frame_index")], 0, INVESTIGATION_FRAMES).select(
        "capture_id", "area", F.col("row_pos").alias("rank"), "frame_index", "value"
    )


def slow_frames(frames: DataFrame, mode: str = "cpu") -> DataFrame:
    """Q12: the twenty slowest (or most allocating) frames of each recording."""
    value = F.col({"cpu": "cpu_ms", "gc": "gc_bytes"}[mode]).cast("double")
    rows = frames.select(*FRAME, value.alias("value")).filter(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    return page(rows, ["capture_id"], [-F.col("value"), F.col("frame_index")], 0, SLOW_FRAMES).withColumnRenamed("row_pos", "rank")


def bounded_page(
    df: DataFrame, keys: list[str], order: list[Column | str], start: int = 0, limit: int = 50, budget: int = PAGE_BYTES
) -> DataFrame:
    """Q13: a page cut where its rows, as JSON, pass ``budget`` bytes.

    ``page_error`` marks a page whose first row alone is too large; its rows
    are then withheld except that one.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows = paged(df.withColumn("row_bytes", size.cast("bigint")), keys, order, start, limit).drop("next_start")
    within = Window.partitionBy(*keys).orderBy("row_pos")
    sized = rows.withColumn("page_bytes", F.sum("row_bytes").over(within))
    kept = sized.filter((F.col("page_bytes") <= budget) | (F.col("row_pos") == start))
    end = F.max("row_pos").over(Window.partitionBy(*keys)) + 1
    return kept.withColumn("page_error", F.col("row_bytes") > budget).withColumn(
        "next_start", F.when(end < F.col("total"), end)
    )


# How to read each metric (fixed texts).
METRIC_SEMANTICS = {
    "cpuMs": "inclusive milliseconds of the only main-thread root; waiting is included",
    "frameMs": "time from one frame start to the next; its difference to cpuMs proves nothing by itself",
    "gcBytes": "bytes allocated in the frame; allocation is not collection pause",
    "Draw Calls Count": "observed count per frame; missing is not zero",
    "SetPass Calls Count": "observed count per frame; missing is not zero",
    "Batches Count": "observed count per frame; missing is not zero",
    "Triangles Count": "observed count per frame; missing is not zero",
    "Vertices Count": "observed count per frame; missing is not zero",
}
PERCENTILE_METHOD = "ascending, zero-based index round((n-1)*q), halves up, no interpolation; valid frames only"


def with_metric_semantics(stats: DataFrame) -> DataFrame:
    """Q14: attach to each metric row how it is to be read."""
    rows = [(m, text, PERCENTILE_METHOD) for m, text in METRIC_SEMANTICS.items()]
    table = stats.sparkSession.createDataFrame(rows, "metric STRING, meaning STRING, percentile_method STRING")
    return stats.join(F.broadcast(table), "metric", "left")
