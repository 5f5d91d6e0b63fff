"""Convention JSON (frame lists and flat sample lists) to canonical tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.scalars import alloc_bytes
from framescope.schemas import (
    CONVENTION, CONVENTION_FRAME, FRAME_ALIASES, FRAME_LIST_ALIASES, META_ALIASES, SAMPLE, SAMPLE_ALIASES, U64_MAX, UNATTRIBUTED,
)
from framescope.sources.dump_reader import VIOLATION
from framescope.sources.dumps import file_capture_id
from framescope.sources.json_rules import check_convention
from framescope.sources.tables import materialize


def _first(base: Column, spellings: list[str]) -> Column:
    return F.coalesce(*[base[s] for s in spellings])


def violations(texts: DataFrame) -> DataFrame:
    """What breaks each text: no JSON, values of another class than declared, fields given twice or under two spellings.

    Rows carry the frame's number (its position where it has none) and the sample's
    position.  The tables of a text with violations are what could be read of it;
    ``validate.reject`` drops them.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, *row) for c, text in zip(*(x.to_pylist() for x in batch.columns), strict=True) for row in check_convention(text).rows]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*found, strict=True) if found else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[*SAMPLE, "rule"])

    return texts.select("capture_id", "json").mapInArrow(checked, f"capture_id STRING, {VIOLATION}")


def read_convention(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole texts of convention files with their recording id, for ``parse_convention``."""
    raw = spark.read.text(paths, wholetext=True)
    named = raw.select(F.url_decode(F.col("_metadata.file_name")).alias("f"), F.col("value").alias("json"))
    return named.select(file_capture_id(F.col("f")).alias("capture_id"), "json")


def read_frames_json(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    return parse_frames(read_convention(spark, paths), store=True)


def read_flat_samples(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    return parse_flat_samples(read_convention(spark, paths), store=True)


def _meta(base: Column) -> list[Column]:
    return [_first(base, names).alias(f"meta_{c}") for c, (_, names) in META_ALIASES.items()]


def _parsed(texts: DataFrame, store: bool) -> DataFrame:
    """Root object, or a bare array of frames under the same columns.

    ``store`` keeps the parsed form on disk, so that several tables taken from
    it do not parse the texts again.
    """
    is_list = F.ltrim("json").startswith("[")
    root = F.when(~is_list, F.from_json("json", CONVENTION))
    bare = F.when(is_list, F.from_json("json", f"ARRAY<STRUCT<{CONVENTION_FRAME}>>"))
    parsed = texts.select("capture_id", root.alias("r"), bare.alias("b"))
    return materialize(parsed) if store else parsed


def _items(frame: Column, name: str) -> Column:
    return F.coalesce(*[frame[s] for s in FRAME_LIST_ALIASES[name]])


def _number_present(samples: Column) -> Column:
    """At least one sample, and each with a duration."""
    timed = F.forall(samples, lambda s: _first(s, SAMPLE_ALIASES["total_ms"][1]).isNotNull())
    return F.coalesce((F.size(samples) > 0) & timed, F.lit(False))


def _site_bytes(s: Column) -> Column:
    fallback = F.coalesce(alloc_bytes(_first(s, SAMPLE_ALIASES["metadata"][1])), _first(s, SAMPLE_ALIASES["total_ms"][1]))
    return F.coalesce(_first(s, SAMPLE_ALIASES["total_bytes"][1]), _saturated(fallback), F.lit(0).cast("decimal(20,0)"))


def _saturated(value: Column) -> Column:
    """Truncate a double into the unsigned 64-bit range."""
    whole = F.floor(value.cast("decimal(38,6)")).cast("decimal(20,0)")
    return F.when(F.isnan(value) | (value <= 0), F.lit(0).cast("decimal(20,0)")).when(
        value >= float(U64_MAX), F.lit(U64_MAX)
    ).when(value.isNotNull(), whole)


def _markers(rows: DataFrame, fallback_name: str) -> DataFrame:
    s = F.col("s")
    total = F.coalesce(_first(s, SAMPLE_ALIASES["total_ms"][1]), F.lit(0.0))
    return rows.select(
        "capture_id", "frame_index",
        F.coalesce(_first(s, SAMPLE_ALIASES["name"][1]), F.lit(fallback_name)).alias("name"),
        total.alias("total_ms"),
        F.coalesce(_first(s, SAMPLE_ALIASES["call_count"][1]), F.lit(1)).cast("bigint").alias("call_count"),
        F.coalesce(_first(s, SAMPLE_ALIASES["max_ms"][1]), total).alias("max_ms"),
    )


def parse_frames(texts: DataFrame, store: bool = False) -> dict[str, DataFrame]:
    """Frames, markers, allocation sites and rendering events of frame-list texts."""
    parsed = _parsed(texts, store)
    docs = parsed.select("capture_id", F.coalesce("b", "r.frames").alias("frames"), *_meta(F.col("r.meta")))
    exploded = docs.select("capture_id", F.posexplode("frames").alias("pos", "f"))
    f = F.col("f")
    field = {c: _first(f, names) for c, (_, names) in FRAME_ALIASES.items()}
    main = F.when(F.size(_items(f, "main_thread_samples")) > 0, _items(f, "main_thread_samples")).otherwise(_items(f, "samples"))
    sites = _items(f, "gc_alloc_sites")

    def site_known(s: Column) -> Column:
        return (
            _first(s, SAMPLE_ALIASES["total_bytes"][1]).isNotNull()
            | F.coalesce(_first(s, SAMPLE_ALIASES["total_ms"][1]) >= 0, F.lit(False))
            | F.coalesce(alloc_bytes(_first(s, SAMPLE_ALIASES["metadata"][1])) >= 0, F.lit(False))
        )

    rows = exploded.select(
        "capture_id",
        F.col("pos").cast("bigint").alias("position"),
        F.coalesce(field["index"], field["frame_index"], F.col("pos").cast("bigint")).alias("frame_index"),
        field["cpu_ms"].alias("cpu_ms"),
        field["duration_ms"].alias("frame_ms"),
        field["gc_alloc_bytes"].alias("gc_bytes"),
        field["draw_calls"].alias("draw_calls"),
        field["set_pass_calls"].alias("set_pass_calls"),
        main.alias("main"), sites.alias("sites"), _items(f, "render_events").alias("render"),
    )
    none = F.lit(None).cast("bigint")
    frames = rows.select(
        "capture_id", "position", "frame_index", "cpu_ms", "frame_ms", "gc_bytes", "draw_calls", "set_pass_calls",
        *[none.alias(c) for c in ("batches", "triangles", "vertices")],
        _number_present(F.col("main")).alias("samples_valid"),
        F.coalesce((F.size("sites") > 0) & F.forall("sites", site_known), F.lit(False)).alias("sites_valid"),
        _number_present(F.col("render")).alias("render_valid"),
        F.lit(False).alias("estimated"), F.lit(None).cast("boolean").alias("version_verified"), F.lit("json-v1").alias("source"),
        F.array().cast("array<string>").alias("reasons"),
    )
    counts = docs.select("capture_id", F.size("frames").cast("bigint").alias("n"), "meta_platform", "meta_version", "meta_frame_count")
    s = F.col("s")
    total_bytes = _site_bytes(s)
    return {
        "captures": counts.select("capture_id", F.coalesce("meta_frame_count", "n").alias("declared_frame_count"),
                                  F.col("meta_platform").alias("platform"), F.col("meta_version").alias("version")),
        "frames": frames,
        "markers": _markers(rows.select("capture_id", "frame_index", F.explode("main").alias("s")), "sample"),
        "render_events": _markers(rows.select("capture_id", "frame_index", F.explode("render").alias("s")), "render"),
        "sites": rows.select("capture_id", "frame_index", F.explode("sites").alias("s")).select(
            "capture_id", "frame_index", F.lit("not provided").alias("thread"),
            F.coalesce(_first(s, SAMPLE_ALIASES["name"][1]), F.lit(UNATTRIBUTED)).alias("name"),
            total_bytes.alias("total_bytes"),
            F.coalesce(_first(s, SAMPLE_ALIASES["call_count"][1]), F.lit(1)).cast("bigint").alias("call_count"),
            F.coalesce(
                _first(s, SAMPLE_ALIASES["max_bytes"][1]), _saturated(_first(s, SAMPLE_ALIASES["max_ms"][1])), total_bytes
            ).alias("max_bytes"),
        ),
        "violations": violations(texts),
        "warnings": counts.filter(F.coalesce("n", F.lit(0)) < 1).select("capture_id", F.lit("no frames parsed").alias("warning")),
    }


def parse_flat_samples(texts: DataFrame, store: bool = False) -> dict[str, DataFrame]:
    """S3: a flat sample list becomes one estimated frame per recording."""
    parsed = _parsed(texts, store)
    docs = parsed.select("capture_id", F.col("r.samples").alias("samples"), *_meta(F.col("r.header")))
    duration = F.coalesce("meta_duration_ms", "meta_total_time_ms")
    totals = F.transform("samples", lambda s: F.coalesce(_first(s, SAMPLE_ALIASES["total_ms"][1]), F.lit(0.0)))
    valid = _number_present(F.col("samples"))
    cpu = F.greatest(F.aggregate(totals, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    none = F.lit(None).cast("bigint")
    frames = docs.select(
        "capture_id", F.lit(0).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("frame_index"),
        F.when(valid, cpu).alias("cpu_ms"), duration.alias("frame_ms"), F.lit(None).cast("decimal(20,0)").alias("gc_bytes"),
        *[none.alias(c) for c in ("draw_calls", "set_pass_calls", "batches", "triangles", "vertices")],
        valid.alias("samples_valid"), F.lit(False).alias("sites_valid"), F.lit(False).alias("render_valid"),
        F.lit(True).alias("estimated"), F.lit(None).cast("boolean").alias("version_verified"), F.lit("json-v2").alias("source"),
        F.array().cast("array<string>").alias("reasons"),
    )
    rows = docs.select("capture_id", F.lit(0).cast("bigint").alias("frame_index"), F.explode("samples").alias("s"))
    return {
        "captures": docs.select("capture_id", F.coalesce("meta_frame_count", F.lit(1)).alias("declared_frame_count"),
                                F.col("meta_platform").alias("platform"), F.col("meta_version").alias("version")),
        "frames": frames,
        "markers": _markers(rows, "sample"),
        "violations": violations(texts),
        "warnings": docs.select("capture_id", F.lit("flat samples: one estimated frame").alias("warning")),
    }
