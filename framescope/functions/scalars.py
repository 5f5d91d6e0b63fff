"""Scalar column functions; all stay inside JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker name -> diagnostic category (fixed values).
MARKER_CATEGORIES = {
    "Memory": ["GC.Alloc", "GC.Collect", "GC.Alloc.Sample", "UnsafeUtility.Malloc"],
    "Scripting": [
        "PlayerLoop", "BehaviourUpdate", "Update.ScriptRunBehaviourUpdate", "FixedBehaviourUpdate",
        "PreLateUpdate.ScriptRunBehaviourLateUpdate", "CoroutinesDelayedCalls",
    ],
    "Rendering": [
        "Camera.Render", "Render.Mesh", "Render.OpaqueGeometry", "Render.TransparentGeometry", "Render.UI",
    ],
    "GfxWait": [
        "Gfx.WaitForPresentOnGfxThread", "Gfx.WaitForRenderThread", "Gfx.PresentFrame",
        "Gfx.WaitForCommands", "Gfx.ProcessCommands", "WaitForTargetFPS",
    ],
    "RenderGraph": [
        "RenderGraph.Execute", "RenderGraph.Compile", "RenderGraph.Prepare", "RenderGraph.Dispatch",
        "RenderGraph.Reset",
    ],
    "Physics": [
        "Physics.FetchResults", "Physics.Processing", "Physics.Simulate", "Physics.UpdateBodies",
        "Physics.SimulateCloth",
    ],
    "Jobs": ["JobHandle.Complete", "Semaphore.WaitForSignal", "WaitForJobGroupID"],
    "Editor": ["EditorLoop", "Profiler.CollectEditorStats", "Profiler.CollectGlobalStats"],
}
# Category id -> name (fixed values).
CATEGORY_NAMES = {
    0: "Render", 1: "Scripts", 4: "Gui", 5: "Physics", 6: "Animation", 17: "GC", 18: "VSync",
    26: "UI Layout", 27: "UI Render", 33: "Physics2D", 35: "UI Details",
}
RELEASE_SUFFIXES = {0: "a", 1: "b", 2: "f", 3: "c"}
METADATA_UNITS = {1: "nanoseconds", 2: "bytes", 3: "count", 4: "percent", 5: "hertz"}
FLOW_KINDS = {0: "Begin", 1: "ParallelNext", 2: "End", 3: "Next"}

KB, MB, GB = 1024, 1024**2, 1024**3


def choose(key: Column, mapping: dict, default: Column | None = None) -> Column:
    """``CASE key WHEN ... END`` over a small fixed mapping."""
    items = list(mapping.items())
    expr = reduce(lambda e, kv: e.when(key == kv[0], F.lit(kv[1])), items[1:], F.when(key == items[0][0], F.lit(items[0][1])))
    return expr if default is None else expr.otherwise(default)


def _fixed(value: Column, digits: int) -> Column:
    """Decimal text of a non-negative double, rounded half up on its exact binary value.

    Whole and fraction part exactly; the fraction times a power of two is exact,
    so the rounding is done on integers, for values of any size.
    """
    scale = 10**digits
    whole = F.floor(value).cast("decimal(38,0)")
    fraction = ((value - F.floor(value)) * float(2**52)).cast("bigint").cast("decimal(20,0)")
    units = F.call_function("div", fraction * (2 * scale) + 2**52, F.lit(2**53).cast("decimal(20,0)"))
    text = (whole + F.floor(units / scale)).cast("decimal(38,0)").cast("string")
    return text if digits == 0 else F.concat(text, F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))


def format_bytes(n: Column) -> Column:
    value = n.cast("double")
    return (
        F.when(value < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(value < MB, F.concat(_fixed(value / KB, 1), F.lit(" KB")))
        .when(value < GB, F.concat(_fixed(value / MB, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(value / GB, 2), F.lit(" GB")))
    )


def format_ms(ms: Column) -> Column:
    return (
        F.when(ms < 1, F.concat(_fixed(ms * 1000, 0), F.lit(" μs")))
        .when(ms < 1000, F.concat(_fixed(ms, 2), F.lit(" ms")))
        .otherwise(F.concat(_fixed(ms / 1000, 2), F.lit(" s")))
    )


def format_count(n: Column) -> Column:
    value = n.cast("double")
    return (
        F.when(value < 1000, n.cast("string"))
        .when(value < 1_000_000, F.concat(_fixed(value / 1000, 1), F.lit("K")))
        .otherwise(F.concat(_fixed(value / 1_000_000, 1), F.lit("M")))
    )


def marker_category_table(spark) -> DataFrame:
    rows = [(name, category) for category, names in MARKER_CATEGORIES.items() for name in names]
    return spark.createDataFrame(rows, "marker_name STRING, marker_category STRING")


def with_marker_category(df: DataFrame, name: str = "marker_name") -> DataFrame:
    """Join the marker dimension, a fixed table of a few dozen rows."""
    table = marker_category_table(df.sparkSession).withColumnRenamed("marker_name", name)
    joined = df.join(F.broadcast(table), name, "left")
    return joined.withColumn("marker_category", F.coalesce("marker_category", F.lit("Other")))


def category_name(category_id: Column) -> Column:
    return choose(category_id, CATEGORY_NAMES)


def is_known_category(category_id: Column) -> Column:
    return category_id.isin(list(CATEGORY_NAMES))


def release_suffix(release_type: Column) -> Column:
    return choose(release_type, RELEASE_SUFFIXES, F.lit("?"))


def version_string(major: Column, minor: Column, patch: Column, release_type: Column, number: Column) -> Column:
    return F.concat(F.concat_ws(".", major, minor, patch), release_suffix(release_type), number.cast("string"))


def metadata_unit(descriptor: Column) -> Column:
    return choose(F.shiftright(descriptor, 8).bitwiseAND(F.lit(255)), METADATA_UNITS)


def flow_kind(event_type: Column) -> Column:
    return choose(event_type, FLOW_KINDS, F.lit("Unknown"))


def counter_kind(counter_id: Column, value_type: Column) -> Column:
    """Range classes of raw counter ids (fixed values)."""
    return (
        F.when((counter_id == 0x64) & (value_type == 4), F.lit("TotalUsed"))
        .when(counter_id.between(0x68, 0x6D), F.lit("GcUsed"))
        .when(counter_id.between(0x6E, 0x73), F.lit("GcReserved"))
        .when(counter_id.between(0x74, 0x79), F.lit("TextureMemory"))
        .otherwise(F.lit("Unknown"))
    )


def alloc_bytes(metadata: Column) -> Column:
    """Bytes carried by an allocation's metadata JSON, or NULL.

    Array: the last number strictly between 0 and 1e12.  Object: ``bytes``,
    else ``size``.
    """
    items = F.from_json(metadata, "array<variant>", {"mode": "PERMISSIVE"})
    numbers = F.transform(
        items,
        lambda v: F.when(
            F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double")
        ),
    )
    usable = F.filter(numbers, lambda n: (n > 0) & (n < 1e12))
    obj = F.from_json(metadata, "bytes variant, size variant", {"mode": "PERMISSIVE"})

    def field(name: str) -> Column:
        v = obj[name]
        return F.when(
            F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double")
        )

    return F.when(F.ltrim(metadata).startswith("["), F.get(usable, F.size(usable) - 1)).when(
        F.ltrim(metadata).startswith("{"), F.coalesce(field("bytes"), field("size"))
    )


def severity(value: Column, status: Column, warning: Column, danger: Column) -> Column:
    """``danger`` / ``warning`` only for a finite value of available (or unstated) quality."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    usable = finite & (F.coalesce(status, F.lit("available")) == "available")
    return (
        F.when(usable & (value >= danger), F.lit("danger"))
        .when(usable & (value >= warning), F.lit("warning"))
        .otherwise(F.lit("normal"))
    )


def truncate_text(text: Column, length: int, marker: str) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(marker))).otherwise(text)


def preview_bytes(text: Column, length: int) -> Column:
    """At most ``length`` UTF-8 bytes of ``text``, never cutting a character."""
    head = F.substring(F.encode(text, "UTF-8"), 1, length)
    whole = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(
        F.regexp_replace(F.make_valid_utf8(head.cast("string")), "�+$", "")
    )
    return F.when(F.octet_length(text) <= length, text).otherwise(whole)


def editor_ms(duration_ns: Column) -> Column:
    """Single-precision nanoseconds to milliseconds, as the recorder rounds them."""
    return (duration_ns.cast("float") * F.lit(1e-6).cast("float")).cast("double")


def editor_start_ms(start_ns: Column) -> Column:
    return (start_ns.cast("double") / F.lit(1e6)).cast("float").cast("double")


def thread_role(name: Column) -> Column:
    """Worker threads of one pool share one role."""
    return F.when(name.startswith("Job.Worker"), F.lit("Job.Worker")).otherwise(name)


def path_key(group: Column, role: Column, path: Column) -> Column:
    """Identity of a call path across recordings, as JSON ``[group, role, path]``."""
    quoted = F.to_json(F.array(role))
    group_json = F.when(group.isNull(), F.lit("null")).otherwise(
        F.regexp_extract(F.to_json(F.array(group)), r"(?s)^\[(.*)\]$", 1)
    )
    role_json = F.regexp_extract(quoted, r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("["), group_json, F.lit(","), role_json, F.lit(","), F.to_json(path), F.lit("]"))
