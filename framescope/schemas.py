"""Explicit schemas of every source and canonical table (never inferred)."""

from __future__ import annotations

from decimal import Decimal

# Unsigned 64-bit values are DECIMAL(20,0); their differences DECIMAL(21,0).
U64_MAX = Decimal(2**64 - 1)

# Keys that identify a frame, a thread inside it and a sample inside that.
FRAME = ["capture_id", "frame_index"]
THREAD = [*FRAME, "thread_index"]
SAMPLE = [*THREAD, "sample_index"]

MAIN_THREAD = "Main Thread"
ALLOC_MARKER = "GC.Alloc"
UNATTRIBUTED = "unattributed"

# Field names of the editor-dump JSON format (fixed values).
DUMP_SAMPLE = (
    "sample_index BIGINT, marker_id INT, marker_name STRING, category_index INT, time_ms DOUBLE, "
    "start_time_ms DOUBLE, children_count BIGINT, metadata_count BIGINT, gc_alloc_bytes DECIMAL(20,0)"
)
DUMP_THREAD = (
    "thread_index BIGINT, thread_id DECIMAL(20,0), thread_name STRING, thread_group_name STRING, "
    f"gc_alloc_total_bytes DECIMAL(20,0), samples ARRAY<STRUCT<{DUMP_SAMPLE}>>"
)
DUMP_FRAME = (
    "frame_index BIGINT, frame_time_ms DOUBLE, sample_count_total BIGINT, "
    f"gc_alloc_bytes_total DECIMAL(20,0), threads ARRAY<STRUCT<{DUMP_THREAD}>>"
)
DUMP = f"input_file STRING, unity_version STRING, frame_count BIGINT, frames ARRAY<STRUCT<{DUMP_FRAME}>>"

# Field aliases of the convention JSON format (fixed values): column -> spellings.
META_ALIASES = {
    "platform": ("STRING", ["platform"]),
    "version": ("STRING", ["unityVersion", "unity"]),
    "frame_count": ("BIGINT", ["frameCount", "frame_count"]),
    "duration_ms": ("DOUBLE", ["durationMs", "duration_ms", "duration"]),
    "total_time_ms": ("DOUBLE", ["totalTime", "total_time_ms", "totalTimeMs"]),
}
SAMPLE_ALIASES = {
    "name": ("STRING", ["name", "functionName", "markerName"]),
    "total_ms": ("DOUBLE", ["totalMs", "durationMs", "duration_ms", "ms"]),
    "call_count": ("BIGINT", ["callCount", "call_count"]),
    "max_ms": ("DOUBLE", ["maxMs", "max_ms"]),
    "category": ("STRING", ["category", "categoryName"]),
    "metadata": ("STRING", ["metadata", "meta", "payload"]),
    "total_bytes": ("DECIMAL(20,0)", ["totalBytes"]),
    "max_bytes": ("DECIMAL(20,0)", ["maxBytes"]),
}
FRAME_ALIASES = {
    "index": ("BIGINT", ["index"]),
    "frame_index": ("BIGINT", ["frameIndex", "frame_index"]),
    "duration_ms": ("DOUBLE", ["durationMs", "duration_ms", "ms"]),
    "cpu_ms": ("DOUBLE", ["cpuMs", "cpu_ms"]),
    "gc_alloc_bytes": ("DECIMAL(20,0)", ["gcAlloc", "gc_alloc_bytes", "gcAllocBytes"]),
    "draw_calls": ("BIGINT", ["drawCalls", "draw_calls"]),
    "set_pass_calls": ("BIGINT", ["setPassCalls", "set_pass_calls"]),
}
FRAME_LIST_ALIASES = {
    "main_thread_samples": ["mainThreadSamples", "main_thread_samples"],
    "gc_alloc_sites": ["gcAllocSites", "gc_alloc_sites"],
    "render_events": ["renderEvents", "render_events"],
    "samples": ["samples"],
}


def alias_ddl(aliases: dict[str, tuple[str, list[str]]]) -> str:
    """DDL that declares every spelling of every field as its own column."""
    return ", ".join(f"`{spelling}` {kind}" for kind, names in aliases.values() for spelling in names)


CONVENTION_SAMPLE = alias_ddl(SAMPLE_ALIASES)
CONVENTION_FRAME = ", ".join(
    [alias_ddl(FRAME_ALIASES)]
    + [f"`{s}` ARRAY<STRUCT<{CONVENTION_SAMPLE}>>" for names in FRAME_LIST_ALIASES.values() for s in names]
)
CONVENTION = (
    f"meta STRUCT<{alias_ddl(META_ALIASES)}>, header STRUCT<{alias_ddl(META_ALIASES)}>, "
    f"frames ARRAY<STRUCT<{CONVENTION_FRAME}>>, samples ARRAY<STRUCT<{CONVENTION_SAMPLE}>>"
)

# The eight memory counters and five rendering counters (fixed values).
MEMORY_COUNTERS = [
    "Total Used Memory", "Total Reserved Memory", "GC Used Memory", "GC Reserved Memory",
    "Gfx Used Memory", "Profiler Used Memory", "Profiler Reserved Memory", "System Used Memory",
]
RENDER_COUNTERS = [
    "Draw Calls Count", "SetPass Calls Count", "Batches Count", "Triangles Count", "Vertices Count",
]
# The metrics of a cross-recording comparison (fixed values): name -> frames column.
COMPARED_METRICS = {
    "cpuMs": "cpu_ms",
    "frameMs": "frame_ms",
    "gcBytes": "gc_bytes",
    "Draw Calls Count": "draw_calls",
    "SetPass Calls Count": "set_pass_calls",
    "Batches Count": "batches",
    "Triangles Count": "triangles",
    "Vertices Count": "vertices",
}
CONDITION_FIELDS = [
    "device", "platform", "scenario", "operation", "build", "quality", "resolution", "profiling",
]
VERIFIED_VERSIONS = ["6000.3.9f1", "6000.3.23f1"]

# Canonical frames table.  A metric column is NULL when its validity flag is off.
FRAMES = (
    "capture_id STRING, position BIGINT, frame_index BIGINT, cpu_ms DOUBLE, frame_ms DOUBLE, "
    "gc_bytes DECIMAL(20,0), draw_calls BIGINT, set_pass_calls BIGINT, batches BIGINT, triangles BIGINT, "
    "vertices BIGINT, samples_valid BOOLEAN, sites_valid BOOLEAN, render_valid BOOLEAN, estimated BOOLEAN, "
    "version_verified BOOLEAN, source STRING, reasons ARRAY<STRING>"
)
