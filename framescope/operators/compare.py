"""Comparison of recordings A and B: ranges, conditions, metrics, call paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.scalars import path_key, thread_role
from framescope.functions.windows import numbered, page
from framescope.schemas import CONDITION_FIELDS, FRAME, THREAD

DELTA_STATS = ["mean", "p50", "p95", "p99", "max"]
PAIR = ["a_id", "b_id"]


def select_range(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames inside the inclusive range of their recording.

    ``ranges``: capture_id, lo, hi; NULL bounds take the whole recording.
    """
    inside = F.col("lo").isNull() | F.col("frame_index").between(F.col("lo"), F.col("hi"))
    return frames.join(ranges, "capture_id").filter(inside).drop("lo", "hi")


def range_report(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """How many frames each range selects, ``status`` and whether frames are missing inside."""
    counted = select_range(frames, ranges).groupBy("capture_id").agg(F.count(F.lit(1)).alias("selected"))
    joined = ranges.join(counted, "capture_id", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    status = (
        F.when(F.col("lo") > F.col("hi"), F.lit("reversed"))
        .when(F.col("selected") == 0, F.lit("empty"))
        .otherwise(F.lit("ok"))
    )
    missing = F.coalesce(F.col("hi") - F.col("lo") + 1 != F.col("selected"), F.lit(False))
    return joined.withColumns({"status": status, "missing_frames": missing})


def conditions_match(pairs: DataFrame, captures: DataFrame, reports: DataFrame | None = None, confirmed: Column | None = None) -> DataFrame:
    """Unknown and differing conditions of every pair, and how comparable it is.

    ``captures``: capture_id, the eight condition fields, version, source,
    declared_frame_count, frame_count.  ``reports`` from ``range_report`` tells
    which sides use a range; a partial recording without range is unknown.
    """
    fields = [*CONDITION_FIELDS, "version", "source", "declared_frame_count", "frame_count"]
    if reports is None:
        sided = captures.select("capture_id", *fields, F.lit(False).alias("ranged"), F.lit(False).alias("missing_frames"))
    else:
        ranged = reports.select("capture_id", F.col("lo").isNotNull().alias("ranged"), "missing_frames")
        sided = captures.select("capture_id", *fields).join(ranged, "capture_id", "left").fillna(False, ["ranged", "missing_frames"])

    def side(name: str) -> DataFrame:
        return sided.select(F.col("capture_id").alias(f"{name}_id"), F.struct(*[c for c in sided.columns if c != "capture_id"]).alias(name))

    joined = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    empty = lambda f: (F.coalesce(a(f), F.lit("")) == "") | (F.coalesce(b(f), F.lit("")) == "")
    unknown = [F.when(empty(f), F.lit(f)) for f in CONDITION_FIELDS]
    mismatch = [F.when(~empty(f) & (a(f) != b(f)), F.lit(f)) for f in CONDITION_FIELDS]
    mismatch += [F.when(~a(f).eqNullSafe(b(f)), F.lit(f)) for f in ("version", "source")]
    unknown.append(F.when(a("version").isNull() | b("version").isNull(), F.lit("version")))
    for name, s in (("A", a), ("B", b)):
        partial = ~s("ranged") & (s("declared_frame_count") > s("frame_count"))
        unknown.append(F.when(partial, F.lit(f"{name} partial export without range")))
    for name, s in (("A", a), ("B", b)):
        unknown.append(F.when(s("missing_frames"), F.lit(f"{name} range has missing frames")))
    agreed = F.col("confirmed") if confirmed is None and "confirmed" in pairs.columns else (F.lit(False) if confirmed is None else confirmed)
    out = joined.select(
        *pairs.columns,
        F.array_compact(F.array(*unknown)).alias("unknown"),
        F.array_compact(F.array(*mismatch)).alias("mismatch"),
        agreed.alias("__confirmed"),
    )
    comparable = (F.size("mismatch") == 0) & (F.size("unknown") == 0) & F.col("__confirmed")
    label = (
        F.when(F.size("mismatch") > 0, F.lit("not_comparable")).when(comparable, F.lit("confirmed")).otherwise(F.lit("limited"))
    )
    return out.withColumns({"comparable": comparable, "comparability": label}).drop("__confirmed")


def metric_deltas(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """B minus A and percent of A per metric and statistic (percent NULL when A is zero)."""
    counts = ["valid_frames", "total_frames"]

    def side(name: str) -> DataFrame:
        return stats.select(
            F.col("capture_id").alias(f"{name}_id"), "metric", *[F.col(c).alias(f"{name}_{c}") for c in [*DELTA_STATS, *counts]]
        )

    joined = pairs.join(side("a"), "a_id").join(side("b"), ["b_id", "metric"])
    columns: dict[str, Column] = {}
    for s in DELTA_STATS:
        delta = F.col(f"b_{s}") - F.col(f"a_{s}")
        columns[f"{s}_delta"] = delta
        columns[f"{s}_percent"] = F.when(F.col(f"a_{s}") != 0, 100.0 * delta / F.col(f"a_{s}"))
    return joined.withColumns(columns)


def budget_verdict(deltas: DataFrame, conditions: DataFrame, budgets: DataFrame) -> DataFrame:
    """C4: reached / not_reached on B's p95, undecidable without full, comparable coverage."""
    full = (F.col("a_valid_frames") == F.col("a_total_frames")) & (F.col("b_valid_frames") == F.col("b_total_frames"))
    joined = deltas.join(conditions.select(*PAIR, "comparable"), PAIR).join(budgets, "metric", "left")
    reached = F.coalesce(F.col("b_p95") <= F.col("budget_p95"), F.lit(False))
    verdict = (
        F.when(~F.col("comparable") | ~full, F.lit("undecidable"))
        .when(F.col("budget_p95").isNull(), F.lit("no_target"))
        .when(reached, F.lit("reached"))
        .otherwise(F.lit("not_reached"))
    )
    return joined.withColumn("verdict", verdict)


def path_name(path: Column) -> Column:
    """128 bits that stand for a call path where rows are counted or moved."""
    return F.unhex(F.md5(F.coalesce(F.to_json(path), F.lit("")).cast("binary")))


def path_table(tree: DataFrame) -> DataFrame:
    """The distinct call paths of each recording: ``path_name``, ``path``.

    Every task combines its own samples first, so what is moved follows the number of paths.
    """
    return tree.select("capture_id", path_name(F.col("path")).alias("path_name"), "path").distinct()


def path_profile(tree: DataFrame, threads: DataFrame, frames: DataFrame) -> DataFrame:
    """Per-frame cost of every call path over the selected frames of each recording.

    The path is keyed by thread group, role (workers of one pool together) and
    full marker path.  Sums are divided by all selected frames, also those
    without the path; bytes only when every call has them.  Samples carry the name
    of their path; the path itself comes back from the table of paths.
    """
    totals = frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_frames"))
    # Threads are held against the selected frames, not their samples: those are joined once.
    roles = threads.select(*THREAD, "thread_group_name", thread_role(F.col("thread_name")).alias("role")).join(
        frames.select(*FRAME), FRAME, "left_semi"
    )
    keys = ["capture_id", "thread_group_name", "role", "path_name"]
    samples = tree.select(*THREAD, path_name(F.col("path")).alias("path_name"), "time_ms", "gc_alloc_bytes")
    # Per frame first: the frame count then needs no distinct over all samples.
    per_frame = (
        samples.join(roles, THREAD)
        .groupBy(*keys, "frame_index")
        .agg(
            F.sum("time_ms").alias("ms"), F.count(F.lit(1)).alias("calls"),
            F.sum("gc_alloc_bytes").alias("bytes"), F.count("gc_alloc_bytes").alias("sized"),
        )
    )
    summed = per_frame.groupBy(*keys).agg(
        F.sum("ms").alias("ms"), F.sum("calls").alias("calls"), F.sum("bytes").alias("bytes"),
        F.sum("sized").alias("sized"), F.count(F.lit(1)).alias("observed_frames"),
    )
    n = F.col("total_frames")
    named = summed.join(path_table(tree), ["capture_id", "path_name"])
    return named.join(totals, "capture_id").select(
        "capture_id", "thread_group_name", "role", "path",
        path_key(F.col("thread_group_name"), F.col("role"), F.col("path")).alias("path_id"),
        (F.col("ms") / n).alias("inclusive_ms_per_frame"),
        (F.col("calls") / n).alias("calls_per_frame"),
        F.when(F.col("sized") == F.col("calls"), F.col("bytes").cast("double") / n).alias("gc_bytes_per_frame"),
        "observed_frames",
        "total_frames",
    )


def associate(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Full outer match of two recordings' paths, largest change first.

    A path missing on one side has no change and ranks with the unchanged ones.
    The profile is read once: its rows go to the pairs they belong to, as side a or
    b, and both sides of a path meet in one grouping.
    """
    measures = ["inclusive_ms_per_frame", "calls_per_frame", "gc_bytes_per_frame", "observed_frames", "total_frames"]
    ends = F.array(*(F.struct(F.col(f"{s}_id").alias("capture_id"), F.lit(s).alias("side")) for s in ("a", "b")))
    sides = pairs.select(*PAIR, F.explode(ends).alias("end")).select(*PAIR, "end.*")
    rows = sides.join(profile, "capture_id").groupBy(*PAIR, "path_id").agg(
        *(F.any_value(c).alias(c) for c in ("thread_group_name", "role", "path")),
        *(F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{s}_{m}") for s in ("a", "b") for m in measures),
        *(F.bool_or(F.col("side") == s).alias(f"in_{s}") for s in ("a", "b")),
    )
    delta = F.col("b_inclusive_ms_per_frame") - F.col("a_inclusive_ms_per_frame")
    label = F.when(~F.col("in_a"), F.lit("only_b")).when(~F.col("in_b"), F.lit("only_a")).otherwise(F.lit("both"))
    rows = rows.withColumns({"delta_inclusive_ms": delta, "association": label}).drop("in_a", "in_b")
    return rows.withColumn("__size", -F.abs(F.coalesce("delta_inclusive_ms", F.lit(0.0))))


def ranked_associations(rows: DataFrame) -> DataFrame:
    """All matched paths with their rank in the pair."""
    return numbered(rows, PAIR, ["__size", "path_id"], "rank").drop("__size")


TOP_ASSOCIATIONS = 20


def association_top(rows: DataFrame) -> DataFrame:
    """The first twenty matched paths of each pair, with the total."""
    totals = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("total"))
    top = page(rows, PAIR, ["__size", "path_id"], 0, TOP_ASSOCIATIONS, "rank").drop("__size")
    next_start = F.when(F.col("total") > TOP_ASSOCIATIONS, F.lit(TOP_ASSOCIATIONS).cast("bigint"))
    return top.join(totals, PAIR).withColumn("next_start", next_start)


MAX_MATCHES = 5
MATCH_BYTES = 8 * 1024
OBSERVED = ["thread_group_name", "role", "path", "inclusive_ms_per_frame", "calls_per_frame", "gc_bytes_per_frame", "observed_frames", "total_frames"]


def observe_markers(tasks: DataFrame, profile: DataFrame, available: bool = True) -> DataFrame:
    """Whether the names of selected marker tasks occur as the last marker of a path.

    ``tasks``: task_id, kind, selected, marker_names; ``profile`` of recording B.
    One row per task and name with up to five matching paths and what was observed
    on them, fewer if their JSON is over 8 KiB.
    """
    chosen = tasks.filter(F.col("selected") & (F.col("kind") == "marker"))
    names = chosen.select("task_id", F.explode_outer("marker_names").alias("name"))
    leaves = profile.select(F.element_at("path", -1).alias("name"), F.struct("path_id", *OBSERVED).alias("match"))
    none = F.array().cast(f"array<{leaves.schema['match'].dataType.simpleString()}>")
    if not available:
        status = F.when(F.col("name").isNull(), F.lit("manual")).otherwise(F.lit("unavailable"))
        return names.select("task_id", "name", status.alias("status"), F.lit(0).cast("bigint").alias("total_paths"), none.alias("matches"), F.lit(False).alias("truncated"))
    wanted = names.select("name").distinct()
    leaves = leaves.join(wanted, "name", "left_semi")
    totals = leaves.groupBy("name").agg(F.count(F.lit(1)).alias("total_paths"))
    first = page(leaves.withColumn("path_id", F.col("match.path_id")), ["name"], ["path_id"], 0, MAX_MATCHES)
    found = F.array_sort(F.collect_list("match"))  # at most MAX_MATCHES, the path id comes first
    shown = first.groupBy("name").agg(found.alias("found"))
    cut = none
    for many in range(1, MAX_MATCHES + 1):
        part = F.slice("found", 1, many)
        cut = F.when((F.size("found") >= many) & (F.octet_length(F.to_json(part)) <= MATCH_BYTES), part).otherwise(cut)
    joined = names.join(totals, "name", "left").join(shown.select("name", cut.alias("matches")), "name", "left")
    total, matches = F.coalesce("total_paths", F.lit(0)), F.coalesce("matches", none)
    status = F.when(F.col("name").isNull(), F.lit("manual")).when(total > 0, F.lit("observed")).otherwise(F.lit("not_observed"))
    return joined.select("task_id", "name", status.alias("status"), total.alias("total_paths"), matches.alias("matches"), (total > F.size(matches)).alias("truncated"))
