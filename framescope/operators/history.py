"""Optimisation history: rounds, applied changes, verdicts, reports and journals.

Tables: scenes(scene_id, last_code_revision), rounds(round_id, scene_id, seq,
candidate, decision, has_comparison), runs(run_id, round_id, seq, status,
has_text), tasks(run_id, task_id, kind, selected, marker_names), changes(run_id,
task_id, state), reports(report_id, parent_report_id, round_id, seq, stage,
status, capture_id, created_at, text).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.scalars import preview_bytes
from framescope.functions.windows import numbered, running

MAX_TEXT_BYTES = 2 * 1024 * 1024
OPEN_STATES = ["prepared", "conflict"]


def applied_tasks(tasks: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks with an applied change of their own, or selected in a run with an unassigned one.

    One row per round and task; the latest run wins.
    """
    applied = changes.filter("state = 'applied'")
    own = tasks.join(applied.select("run_id", "task_id").distinct(), ["run_id", "task_id"], "left_semi")
    unassigned = applied.filter("task_id IS NULL").select("run_id").distinct()
    selected = tasks.filter("selected").join(unassigned, "run_id", "left_semi")
    found = own.unionByName(selected).join(runs.select("run_id", "round_id", F.col("seq").alias("run_seq")), "run_id")
    latest = F.max_by(F.struct("run_id", "kind", "marker_names", "run_seq"), "run_seq")
    return found.groupBy("round_id", "task_id").agg(latest.alias("t")).select("round_id", "task_id", "t.*")


def _round_changes(changes: DataFrame, runs: DataFrame) -> DataFrame:
    return changes.join(runs.select("run_id", "round_id"), "run_id")


def marker_only(rounds: DataFrame, runs: DataFrame, tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Rounds whose applied changes all belong to marker tasks, with nothing left open."""
    markers = tasks.filter("kind = 'marker'").select("run_id", "task_id", F.lit(True).alias("is_marker")).distinct()
    marked = _round_changes(changes, runs).join(markers, ["run_id", "task_id"], "left")
    applied = F.col("state") == "applied"
    summary = marked.groupBy("round_id").agg(
        F.count_if(applied).alias("applied"),
        F.count_if(applied & F.col("is_marker").isNull()).alias("other"),
        F.count_if(F.col("state").isin(OPEN_STATES)).alias("open"),
    )
    only = (F.col("applied") > 0) & (F.col("other") == 0) & (F.col("open") == 0)
    return rounds.select("round_id").join(summary, "round_id", "left").select(
        "round_id", F.coalesce(only, F.lit(False)).alias("marker_only")
    )


def round_status(
    rounds: DataFrame, runs: DataFrame, tasks: DataFrame, changes: DataFrame, round_tasks: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """One status code per round; the first rule that holds decides.

    ``round_tasks``: round_id, kind, selected.  ``verdicts``: round_id,
    budget_p95, verdict of the round's comparison.
    """
    changed = changes.select("run_id").distinct().withColumn("changed", F.lit(True))
    per_round = (
        runs.join(changed, "run_id", "left")
        .groupBy("round_id")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            F.bool_and(F.col("changed").isNull() & (F.col("status") != "running")).alias("untouched"),
            F.bool_and(F.col("status") == "rolled_back").alias("all_back"),
            F.max_by(F.struct("status", "has_text"), "seq").alias("last_run"),
        )
    )
    chosen = round_tasks.filter("selected").groupBy("round_id").agg(F.bool_and(F.col("kind") == "marker").alias("marker_tasks"))
    targets = verdicts.filter(F.col("budget_p95").isNotNull()).groupBy("round_id").agg(
        F.bool_or(F.col("verdict") == "undecidable").alias("open_target"),
        F.bool_or(F.col("verdict") == "not_reached").alias("missed"),
    )
    joined = (
        rounds.join(per_round, "round_id", "left")
        .join(marker_only(rounds, runs, tasks, changes), "round_id", "left")
        .join(chosen, "round_id", "left")
        .join(targets, "round_id", "left")
    )
    investigated = F.col("untouched") & (F.col("last_run.status") == "investigated") & F.col("last_run.has_text")
    sampled = (F.col("decision") == "accepted") & ~F.col("has_comparison") & F.col("marker_only")
    status = (
        F.when(F.col("decision") == "deferred", F.lit("deferred"))
        .when(investigated, F.lit("investigated"))
        .when(sampled & F.col("candidate").isNotNull(), F.lit("sampling_accepted"))
        .when(sampled, F.lit("sampling_without_candidate"))
        .when(F.col("all_back"), F.lit("undecidable_rolled_back"))
        .when(~F.col("has_comparison"), F.lit("awaiting_recording"))
        .when(F.col("marker_tasks"), F.lit("undecidable_markers_only"))
        .when(F.col("open_target").isNull() | F.col("open_target"), F.lit("undecidable"))
        .when(F.col("missed"), F.lit("not_reached"))
        .otherwise(F.lit("reached"))
    )
    return joined.select("round_id", status.alias("status"))


def current_rounds(rounds: DataFrame) -> DataFrame:
    """The last round of every scene."""
    return rounds.groupBy("scene_id").agg(
        F.max_by("round_id", "seq").alias("round_id"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("round_count")
    )


def prior_rounds(targets: DataFrame, rounds: DataFrame) -> DataFrame:
    """Earlier rounds of the same scene for each target (round_id, scene_id, seq)."""
    wanted = targets.select("scene_id", F.col("round_id").alias("target_round"), F.col("seq").alias("target_seq"))
    return rounds.join(wanted, "scene_id").filter(F.col("seq") < F.col("target_seq")).drop("target_seq")


def unresolved(rounds: DataFrame, runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Rounds with open changes, or applied ones that were not accepted."""
    states = _round_changes(changes, runs).groupBy("round_id").agg(
        F.bool_or(F.col("state").isin(OPEN_STATES)).alias("open"), F.bool_or(F.col("state") == "applied").alias("applied")
    )
    left = F.col("open") | (F.col("applied") & (F.col("decision") != "accepted"))
    return rounds.join(states, "round_id").filter(left).select("round_id", "scene_id", "seq")


def _two_best(df: DataFrame, value: Column, owner: str) -> Column:
    """The two smallest ``value`` rows with their owner, as one scalar array."""
    best = df.select(value.alias("v"), F.col(owner).alias("o")).orderBy("v", "o").limit(2)
    return best.agg(F.array_sort(F.collect_list(F.struct("v", "o")))).scalar()


def blockers(scenes: DataFrame, open_rounds: DataFrame) -> DataFrame:
    """For every scene the scene of the first unresolved round elsewhere, or NULL.

    The first unresolved round of each scene is enough, and of those only the
    two earliest matter: a scene is blocked by the earliest that is not its own.
    """
    firsts = open_rounds.groupBy("scene_id").agg(F.min("seq").alias("seq"))
    two = F.col("two")
    first, second = F.get(two, F.lit(0))["o"], F.get(two, F.lit(1))["o"]
    marked = scenes.select("scene_id", _two_best(firsts, F.col("seq"), "scene_id").alias("two"))
    return marked.select("scene_id", F.when(first != F.col("scene_id"), first).otherwise(second).alias("blocked_by"))


def stale_captures(captures: DataFrame, scenes: DataFrame) -> DataFrame:
    """Recordings of unknown code revision, or older than another scene's last change."""
    marked = captures.withColumn("two", _two_best(scenes, -F.col("last_code_revision"), "scene_id"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    newest_elsewhere = -F.when(first["o"] != F.col("scene_id"), first["v"]).otherwise(second["v"])
    stale = F.col("code_revision").isNull() | F.coalesce(newest_elsewhere > F.col("code_revision"), F.lit(False))
    return marked.withColumn("stale", stale).drop("two")


def marker_streaks(rounds: DataFrame, applied: DataFrame) -> DataFrame:
    """Before each round, how many rounds of its scene in a row applied marker tasks only."""
    kinds = applied.groupBy("round_id").agg(F.bool_and(F.col("kind") == "marker").alias("all_marker"))
    placed = numbered(rounds.select("round_id", "scene_id", "seq"), ["scene_id"], ["seq"], "pos").join(kinds, "round_id", "left")
    breaks = F.when(~F.coalesce("all_marker", F.lit(False)), F.col("pos"))
    marked = running(placed, ["scene_id"], ["seq"], {"last_break": ("max", breaks)})
    streak = F.col("pos") - 1 - F.coalesce("last_break", F.lit(-1))
    return marked.select("scene_id", "round_id", "seq", streak.alias("marker_streak"))


def open_focus(targets: DataFrame, rounds: DataFrame, applied: DataFrame, reviews: DataFrame) -> DataFrame:
    """The marker question each target round should go on with.

    ``reviews``: round_id, run_seq, focus_round, focus_task, disposition.  The
    latest review's question counts unless it was resolved; otherwise the last
    required marker task that no review resolved.
    """
    prior = prior_rounds(targets, rounds).select("target_round", "round_id", F.col("seq").alias("round_seq"))
    required = applied.filter("kind = 'marker'").join(prior, "round_id").select(
        "target_round", F.col("round_id").alias("focus_round"), F.col("task_id").alias("focus_task"), "round_seq"
    )
    events = reviews.join(prior, "round_id")
    key = ["target_round", "focus_round", "focus_task"]
    latest = events.groupBy("target_round").agg(
        F.max_by(F.struct("focus_round", "focus_task", "disposition"), F.struct("round_seq", "run_seq")).alias("e")
    ).select("target_round", "e.*").filter("disposition <> 'resolved'")
    going_on = latest.join(required.select(*key), key, "left_semi").select("target_round", F.struct("focus_round", "focus_task").alias("f1"))
    resolved = events.filter("disposition = 'resolved'").select(*key).distinct()
    waiting = required.join(resolved, key, "left_anti").groupBy("target_round").agg(
        F.max_by(F.struct("focus_round", "focus_task"), F.struct("round_seq", "focus_task")).alias("f2")
    )
    chosen = targets.select(F.col("round_id").alias("target_round")).join(going_on, "target_round", "left").join(waiting, "target_round", "left")
    return chosen.withColumn("f", F.coalesce("f1", "f2")).select("target_round", "f.focus_round", "f.focus_task")


def report_attempts(reports: DataFrame) -> DataFrame:
    """Running number of each report among those of its round and stage."""
    return numbered(reports, ["round_id", "stage"], ["seq"], "before").withColumn("attempt", F.col("before") + 1).drop("before")


def ready_reports(rounds: DataFrame, reports: DataFrame) -> DataFrame:
    """Rounds with a completed project report built on the latest completed performance report."""
    latest = reports.filter("stage = 'performance'").groupBy("round_id").agg(
        F.max_by(F.struct("report_id", "status"), "seq").alias("latest")
    )
    done = reports.filter("stage = 'project' AND status = 'completed'").join(latest, "round_id", "left")
    based = F.col("latest").isNull() | ((F.col("latest.status") == "completed") & (F.col("parent_report_id") == F.col("latest.report_id")))
    ready = done.filter(F.coalesce(based, F.lit(False))).select("round_id").distinct().withColumn("ready", F.lit(True))
    return rounds.select("round_id").join(ready, "round_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def select_reports(selections: DataFrame, reports: DataFrame) -> DataFrame:
    """One or two reports of a recording; two must be parent and child.

    ``selections``: selection_id, capture_id, report_ids.  One row per selection
    with ``status`` ok or the broken rule, and the ids in creation order.
    """
    asked = selections.select("selection_id", "capture_id", F.explode("report_ids").alias("report_id"))
    usable = reports.filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    found = asked.join(usable.select("report_id", "capture_id", "parent_report_id", "created_at"), ["report_id", "capture_id"])
    listed = F.array_sort(F.collect_list(F.struct("created_at", "report_id", "parent_report_id")))
    # More than two ids are refused, so only selections of one or two are gathered.
    small = selections.filter(F.size("report_ids").between(1, 2)).select("selection_id")
    gathered = found.join(small, "selection_id", "left_semi").groupBy("selection_id").agg(listed.alias("r"))
    size = F.size("report_ids")
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    linked = (first["parent_report_id"] == second["report_id"]) | (second["parent_report_id"] == first["report_id"])
    status = (
        F.when(~size.between(1, 2), F.lit("choose_one_or_two"))
        .when(F.coalesce(F.size("r"), F.lit(-1)) != size, F.lit("missing_empty_or_foreign"))
        .when((size == 2) & ((first["report_id"] == second["report_id"]) | ~F.coalesce(linked, F.lit(False))), F.lit("not_parent_and_child"))
        .otherwise(F.lit("ok"))
    )
    joined = selections.join(gathered, "selection_id", "left").withColumn("status", status)
    ordered = F.transform("r", lambda r: r["report_id"])
    return joined.select("selection_id", "status", F.when(F.col("status") == "ok", ordered).alias("ordered_ids"))


def replay_rows(items: DataFrame, log: DataFrame) -> DataFrame:
    """Verdict on every journal row: append, duplicate, gap or uncommitted.

    ``items``: item_id, text, status.  ``log``: item_id, line_no, offset, chunk,
    terminated.  Offsets are bytes; a row below the length reached so far is a
    duplicate and dropped whole, above it is a gap.  A last line without its end was
    never committed.  What a row reaches depends on the verdicts before it, so the
    offsets and sizes of one item's rows (not their chunks) are walked in order.
    """
    saved = items.select("item_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("saved"))
    rows = log.join(saved, "item_id")
    places = rows.select("item_id", "line_no", F.col("offset").cast("bigint").alias("offset"), F.octet_length("chunk").cast("bigint").alias("size"), "terminated", "saved")
    key, line = (places.schema[c].dataType.simpleString() for c in ("item_id", "line_no"))
    verdicts = places.groupBy("item_id").applyInPandas(_walk_journal, f"item_id {key}, line_no {line}, verdict string")
    return log.join(verdicts, ["item_id", "line_no"])


def _walk_journal(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("line_no", kind="stable")
    length, verdicts = int(rows["saved"].iloc[0]), []
    for offset, size, terminated in zip(rows["offset"].tolist(), rows["size"].tolist(), rows["terminated"].tolist(), strict=True):
        if not terminated:
            verdicts.append("uncommitted")
        elif offset != length:
            verdicts.append("gap" if offset > length else "duplicate")
        else:
            verdicts.append("append")
            length += size
    return rows[["item_id", "line_no"]].assign(verdict=verdicts)


def replay_chunks(items: DataFrame, log: DataFrame) -> DataFrame:
    """Saved text plus the appended chunks of every item; running items become interrupted.

    An item with a gap keeps its saved text and is reported.  A text
    holds at most ``MAX_TEXT_BYTES``, so only chunks that start below that are
    gathered, and the last one is cut between characters.
    """
    rows = replay_rows(items, log)
    bad = rows.filter(F.col("verdict") == "gap").groupBy("item_id").agg(F.min("verdict").alias("problem"))
    useful = (F.col("verdict") == "append") & (F.col("offset") < MAX_TEXT_BYTES) & (F.length("chunk") > 0)
    chunks = rows.filter(useful).join(bad, "item_id", "left_anti").groupBy("item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "chunk"))), lambda c: c["chunk"]), "").alias("added")
    )
    joined = items.join(chunks, "item_id", "left").join(bad, "item_id", "left")
    status = F.when(F.col("status") == "running", F.lit("interrupted")).otherwise(F.col("status"))
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce("added", F.lit("")))
    return joined.select("item_id", preview_bytes(text, MAX_TEXT_BYTES).alias("text"), status.alias("status"), "problem")


