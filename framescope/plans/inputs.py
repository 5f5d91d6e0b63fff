"""Canonical tables of one input folder, derived once per application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.windows import running
from framescope.operators import frames as frame_ops
from framescope.operators import tree as tree_ops
from framescope.operators import validate
from framescope.plans import adapters
from framescope.sources.tables import derived


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "samples", lambda: adapters.samples(spark, sf))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with parent, depth, owner and path."""
    columns = ("parent_index", "depth", "owner_name", "path")
    return derived(
        spark, sf, "tree",
        lambda: tree_ops.with_tree(samples(spark, sf), columns, adapters.long_threads(spark, sf)),
    )


def timed_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The tree with self time."""
    return derived(spark, sf, "timed_tree", lambda: tree_ops.self_time(tree(spark, sf).drop("owner_name")))


def threads(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "threads", lambda: adapters.threads(spark, sf, samples(spark, sf)))


def dump_frames(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "dump_frames", lambda: adapters.dump_frames(spark, sf, threads(spark, sf)))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "frames", lambda: adapters.frames(spark, sf))


def full_frames(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "full_frames", lambda: adapters.frames(spark, sf, flawed=False))


def gc_flags(spark: SparkSession, sf: str) -> DataFrame:
    return derived(
        spark, sf, "gc_flags",
        lambda: validate.reconcile_gc(dump_frames(spark, sf), threads(spark, sf), samples(spark, sf)),
    )


def main_cpu(spark: SparkSession, sf: str) -> DataFrame:
    return validate.main_root(dump_frames(spark, sf), threads(spark, sf), tree(spark, sf))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """F6 level: main-thread markers compacted per frame."""
    return derived(
        spark, sf, "markers",
        lambda: frame_ops.compact_markers(frame_ops.main_markers(tree(spark, sf), main_cpu(spark, sf))),
    )


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    owner = F.coalesce("owner_name", F.lit("unattributed"))
    return tree(spark, sf).filter(F.col("marker_name") == "GC.Alloc").withColumn("site_name", owner)


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """F7 level: allocation sites compacted per frame."""
    return derived(
        spark, sf, "sites",
        lambda: frame_ops.compact_sites(
            frame_ops.alloc_sites(attributed(spark, sf), threads(spark, sf), gc_flags(spark, sf))
        ),
    )


def render_markers(spark: SparkSession, sf: str) -> DataFrame:
    return derived(
        spark, sf, "render_markers",
        lambda: frame_ops.compact_markers(frame_ops.render_events(samples(spark, sf), threads(spark, sf))),
    )


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """One row per recording: declared frames, platform and version by recording."""
    counted = frames(spark, sf).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    newer = F.col("capture_id") == "O"
    return counted.select(
        "capture_id",
        (F.col("n") + F.when(newer, 3).otherwise(0)).alias("declared_frame_count"),
        F.lit("desktop").alias("platform"),
        F.when(newer, F.lit("6000.3.23f1")).otherwise(F.lit("6000.3.9f1")).alias("version"),
    )


# Counter recorded by each kind of event.
EVENT_KINDS = ["view", "click", "purchase", "signup", "error"]


def epoch_micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = F.hour(name) * 3600 + F.minute(name) * 60
    parts = F.date_part(F.lit("SECOND"), F.col(name)) * 1_000_000
    return (F.unix_date(F.to_date(name)).cast("bigint") * 86_400 + seconds) * 1_000_000 + parts.cast("bigint")


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames of one recording per user, numbered in time order."""

    def build() -> DataFrame:
        events = adapters.table(spark, sf, "events").select(
            F.col("user_id").cast("string").alias("capture_id"), "event_id", "ts", "event_type", "value",
            epoch_micros("ts").alias("epoch_us"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        )
        numbered = running(events, ["capture_id"], ["ts", "event_id"], {"frame_index": ("count", None)})
        return numbered.withColumn("position", F.col("frame_index"))

    return derived(spark, sf, "event_frames", build)
