"""Editor-dump JSON to frames, threads and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.sources.dump_reader import read_pieces, read_texts
from framescope.sources.tables import materialize


def file_capture_id(path):
    """Recording id of a file: its name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_dump(spark: SparkSession, paths: str | list[str], capture_id: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Read dump files, each one recording, frame by frame; no file is ever held whole.

    ``capture_id`` makes the recording's id of the file's path, by default its name.
    The frames are stored once, so that the tables taken from them do not parse the
    texts again.  Recordings that are broken have rows in ``violations``;
    ``validate.reject`` drops them.
    """
    named = capture_id or (lambda path: file_capture_id(F.url_decode(path)))
    return dump_tables(materialize(read_pieces(spark, paths, named)))


def parse_dump(texts: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """The same from JSON texts with a ``capture_id`` column, one recording a row."""
    return dump_tables(read_texts(texts, column))


def dump_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Flatten parsed dumps: captures, frames, threads and samples with list positions, and violations."""
    docs = parsed.filter(F.col("f").isNull())
    frames = parsed.filter(F.col("f").isNotNull()).select("capture_id", "frame_pos", "f")
    threads = frames.select("capture_id", "frame_pos", F.col("f.frame_index").alias("frame_index"), F.posexplode("f.threads").alias("thread_pos", "t"))
    samples = threads.select(
        "capture_id", "frame_index", F.col("t.thread_index").alias("thread_index"), F.posexplode("t.samples").alias("pos", "s")
    )
    return {
        "captures": docs.select("capture_id", F.col("frame_count").alias("declared_frame_count"), F.lit(None).cast("string").alias("platform"),
                                F.col("unity_version").alias("version")),
        "violations": docs.select("capture_id", F.inline("violations")),
        "frames": frames.select(
            "capture_id", F.col("frame_pos").cast("bigint").alias("position"),
            "f.frame_index", "f.frame_time_ms", "f.sample_count_total", "f.gc_alloc_bytes_total", F.size("f.threads").alias("thread_count"),
        ),
        "threads": threads.select(
            "capture_id", "frame_index", F.col("thread_pos").cast("bigint").alias("thread_pos"),
            "t.thread_index", "t.thread_id", "t.thread_name", "t.thread_group_name", "t.gc_alloc_total_bytes",
            F.size("t.samples").cast("bigint").alias("sample_count"),
        ),
        "samples": samples.select(
            "capture_id", "frame_index", "thread_index", F.col("pos").cast("bigint").alias("pos"),
            "s.*", F.lit(False).alias("is_counter"),
            F.lit(None).cast("decimal(20,0)").alias("raw_start_ns"), F.lit(None).cast("float").alias("raw_duration_ns"),
        ),
    }


def canonical_frames(tables: dict[str, DataFrame], cpu: DataFrame, gc: DataFrame) -> DataFrame:
    """Frames table of a dump from the main-root and allocation checks (V6, V7)."""
    none = F.lit(None).cast("bigint")
    key = ["capture_id", "frame_index"]
    joined = tables["frames"].join(cpu, key, "left").join(gc, key, "left")
    return joined.select(
        "capture_id", "position", "frame_index", "cpu_ms", F.col("frame_time_ms").alias("frame_ms"), "gc_bytes",
        *[none.alias(c) for c in ("draw_calls", "set_pass_calls", "batches", "triangles", "vertices")],
        F.col("cpu_valid").alias("samples_valid"), F.col("gc_valid").alias("sites_valid"), F.lit(False).alias("render_valid"),
        F.lit(False).alias("estimated"), F.lit(None).cast("boolean").alias("version_verified"), F.lit("unity-editor-dump").alias("source"),
        F.concat(F.coalesce("gc_reasons", F.array().cast("array<string>")), F.array_compact(F.array("cpu_reason"))).alias("reasons"),
    )
