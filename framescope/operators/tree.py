"""Call-tree operators over samples stored in pre-order.

A thread is cut into blocks of ``block_rows`` samples, each in its own task slot and
matched with whole arrays (``brackets``).  Only the calls still open cross from one block
to the next, as rows in front of it, so a very long thread is never gathered into one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions.scalars import category_name
from framescope.functions.windows import running
from framescope.operators.brackets import Blocks, chains, depths, ends, nearest, taken_and_open
from framescope.schemas import ALLOC_MARKER, FRAME, MAIN_THREAD, SAMPLE, THREAD, UNATTRIBUTED

BLOCK_ROWS = 65_536
BLOCK_CONF = "spark.framescope.treeBlockRows"
MAX_DEPTH = 64
MAX_PATH_BYTES = 4096

_OPEN = "ARRAY<STRUCT<idx: BIGINT, left: BIGINT, name: STRING>>"
_PLACE = [*THREAD, "__block"]
_TREE = [
    ("parent_index", pa.int64(), T.LongType()),
    ("depth", pa.int32(), T.IntegerType()),
    ("owner_name", pa.string(), T.StringType()),
    ("path", pa.list_(pa.string()), T.ArrayType(T.StringType())),
    ("ancestors", pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    ("subtree_bytes", pa.decimal128(38, 0), T.DecimalType(38, 0)),
]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a block ends, with their first rows of blocks marked."""

    def marks(batch: pa.RecordBatch) -> np.ndarray:
        found = np.ones(batch.num_rows, bool)
        for name in ("__key", "__block"):
            column = np.asarray(batch.column(name))
            same = column[1:] == column[:-1]
            found[1:] = ~same if name == "__key" else found[1:] | ~same
        return found

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = marks(batch)
        if held:
            before = held[-1]
            ends[0] = any(before.column(n)[before.num_rows - 1] != batch.column(n)[0] for n in ("__key", "__block"))
        cuts = np.flatnonzero(ends)
        cuts = cuts[cuts > 0] if not held else cuts
        if not len(cuts):
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]).combine_chunks().to_batches()[0]
        yield whole, marks(whole)
        held = [batch.slice(cuts[-1])]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield whole, marks(whole)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(0)).astype(np.int64)


def _listed(rows: np.ndarray, begins: np.ndarray, column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), column.take(pa.array(rows)))


def _prefix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of earlier rows of non-negative decimals below 2^64, as two parts: the upper and the lower 32 bits of each value."""
    values = values.fill_null(0)
    low = np.frombuffer(values.buffers()[1], np.uint64)[2 * values.offset :: 2][: len(values)]
    return tuple(np.concatenate([[0], np.cumsum((low >> np.uint64(shift) & np.uint64(0xFFFFFFFF)).astype(np.int64))]) for shift in (32, 0))


def _decimals(upper: np.ndarray, lower: np.ndarray) -> pa.Array:
    """upper * 2^32 + lower as decimals."""
    out = np.empty((len(upper), 2), np.uint64)
    shifted = (upper.astype(np.uint64) & np.uint64(0xFFFFFFFF)) << np.uint64(32)
    out[:, 0] = shifted + lower.astype(np.uint64)
    out[:, 1] = (upper >> 32).astype(np.uint64) + (out[:, 0] < shifted)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(out), [None, pa.py_buffer(out.tobytes())])


def _scan(batches: Iterator[pa.RecordBatch], wanted: list[str], entries: bool) -> Iterator[pa.RecordBatch]:
    """Tree columns of whole blocks; ``entries``: of the calls carried into blocks instead of the blocks' own."""
    for batch, starts in _whole_blocks(batches):
        carried = np.asarray(batch.column("__order").fill_null(0)) < 0
        blocks = Blocks.of(starts, _numbers(batch.column("children_count")), carried)
        parents = blocks.parents()
        keep = np.flatnonzero(carried if entries else ~carried)
        own = parents[keep]
        around = pa.array(own, mask=own < 0)
        names, made = batch.column("marker_name"), {}
        if {"depth", "path", "ancestors"} & {*wanted}:
            depth = depths(parents)
            made["depth"] = pa.array(depth[keep].astype(np.int32))
        if "parent_index" in wanted:
            made["parent_index"] = batch.column("sample_index").take(around)
        if "owner_name" in wanted:
            owner = nearest(parents, np.asarray(pc.fill_null(pc.equal(names, ALLOC_MARKER), False).to_numpy(zero_copy_only=False)))[keep]
            made["owner_name"] = names.take(pa.array(owner, mask=owner < 0))
        if {"path", "ancestors"} & {*wanted}:
            rows, begins = chains(keep, parents, depth)
            made |= {n: _listed(rows, begins, batch.column(c)) for n, c in (("path", "marker_name"), ("ancestors", "sample_index")) if n in wanted}
        if "subtree_bytes" in wanted:
            behind = ends(parents)[keep]
            made["subtree_bytes"] = _decimals(*(p[behind] - p[keep] for p in _prefix(batch.column("gc_alloc_bytes"))))
        kept = batch if len(keep) == batch.num_rows else batch.take(pa.array(keep))
        fields = [n for n in kept.schema.names if not n.startswith("__")]
        yield pa.RecordBatch.from_arrays([kept.column(n) for n in fields] + [made[n] for n in wanted], names=fields + wanted)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: child slots taken from calls opened earlier, and calls left open."""
    open_type = pa.list_(pa.struct([("idx", pa.int64()), ("left", pa.int64()), ("name", pa.string())]))
    for batch, starts in _whole_blocks(batches):
        blocks = Blocks.of(starts, _numbers(batch.column("children_count")), np.zeros(batch.num_rows, bool))
        taken, opened, left = taken_and_open(blocks)
        rows = np.concatenate(opened)
        calls = pa.StructArray.from_arrays(
            [batch.column("sample_index").take(pa.array(rows)), pa.array(left[rows]), batch.column("marker_name").take(pa.array(rows))], names=["idx", "left", "name"]
        )
        begins = np.concatenate([[0], np.cumsum([len(o) for o in opened])])
        places = [batch.column(n).take(pa.array(np.flatnonzero(starts))) for n in _PLACE]
        yield pa.RecordBatch.from_arrays(
            [*places, pa.array(taken, pa.int64()), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), calls).cast(open_type)], names=[*_PLACE, "taken", "opened"]
        )


def _take_children(stack: list, many: int) -> None:
    """Use up child slots of the innermost open calls, dropping finished ones."""
    while many and stack:
        if stack[-1][1] == 0:
            stack.pop()
            continue
        step = min(stack[-1][1], many)
        stack[-1][1] -= step
        many -= step


def _carry_stacks(group: pd.DataFrame) -> pd.DataFrame:
    """Calls open at the start of every later block of one thread, outermost first."""
    stack: list = []
    rows = []
    for capture, frame, thread, block, taken, opened in group.sort_values("__block").itertuples(index=False):
        rows += [(capture, frame, thread, block, at - len(stack), idx, left, name) for at, (idx, left, name) in enumerate(stack)]
        _take_children(stack, taken)
        stack.extend([o["idx"], o["left"], o["name"]] for o in opened)
    return pd.DataFrame(rows, columns=[*_PLACE, "__order", "sample_index", "children_count", "marker_name"])


def _carried(samples: DataFrame, long_threads: DataFrame | None, block_rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples with their block, the threads of more than one block, and one more row in front of a block for each call open at its start."""
    size = block_rows or int(samples.sparkSession.conf.get(BLOCK_CONF, str(BLOCK_ROWS)))
    blocked = samples.withColumns(
        {"__key": F.xxhash64(*THREAD), "__block": F.floor(F.col("sample_index") / size).cast("long"), "__order": F.lit(0).cast("long")}
    )
    if long_threads is None:
        long_threads = samples.filter(F.col("sample_index") >= size).select(*THREAD).distinct()
    # at most one thread for every block of samples; the shuffle keeps finding them out of the broadcast's time
    long_threads = F.broadcast(long_threads.repartition(1))
    summaries = (
        blocked.select(*_PLACE, "__key", "sample_index", "children_count", "marker_name")
        .join(long_threads, THREAD, "left_semi")
        .repartition(*_PLACE)
        .sortWithinPartitions(*_PLACE, "sample_index")
        .mapInArrow(_summarise, f"capture_id STRING, frame_index BIGINT, thread_index BIGINT, __block BIGINT, taken BIGINT, opened {_OPEN}")
    )
    entries = summaries.groupBy(*THREAD).applyInPandas(
        _carry_stacks,
        "capture_id STRING, frame_index BIGINT, thread_index BIGINT, __block BIGINT, __order BIGINT, sample_index BIGINT, children_count BIGINT, marker_name STRING",
    )
    return blocked, long_threads, entries.withColumn("__key", F.xxhash64(*THREAD))


def _scanned(rows: DataFrame, fields: list, wanted: list[str], entries: bool = False) -> DataFrame:
    schema = T.StructType(fields + [T.StructField(n, t) for n, _, t in _TREE if n in wanted])
    ordered = rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "__order", "sample_index")
    return ordered.mapInArrow(lambda batches: _scan(batches, wanted, entries), schema)


def with_tree(
    samples: DataFrame,
    columns: tuple[str, ...] = ("parent_index", "depth"),
    long_threads: DataFrame | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``parent_index`` and ``depth`` and, on request, ``owner_name``
    (nearest enclosing call that is not an allocation), ``path`` (marker names
    root to self) and ``ancestors`` (sample indexes root to self).

    ``long_threads`` names the threads with more than ``block_rows`` samples;
    by default they are found by a filter on ``sample_index``.
    """
    blocked, _, carried = _carried(samples, long_threads, block_rows)
    wanted = [n for n, _, _ in _TREE if n in columns]
    return _scanned(blocked.unionByName(carried, allowMissingColumns=True), samples.schema.fields, wanted)


def attribute_alloc(samples: DataFrame, **kw) -> DataFrame:
    """Each allocation goes to its nearest enclosing call that is not one itself."""
    tree = with_tree(samples, ("owner_name",), **kw).filter(F.col("marker_name") == ALLOC_MARKER)
    return tree.withColumn("site_name", F.coalesce("owner_name", F.lit(UNATTRIBUTED))).drop("owner_name")


def _millis(raw_ns: Column, millis: Column) -> Column:
    return F.coalesce(raw_ns.cast("double") / F.lit(1e6), millis)


def self_time(tree: DataFrame) -> DataFrame:
    """``self_ms`` = duration minus direct children, or NULL with ``self_reason``.

    Needs ``parent_index``.  The children must be as many as declared, lie in
    the parent and not overlap in start order, all within a small tolerance.
    Raw nanosecond offsets are used where both sides have them.
    """
    duration = _millis(F.col("raw_duration_ns"), F.col("time_ms"))
    timed = tree.withColumn("__dur", duration)
    parents = timed.filter(F.col("children_count") > 0).select(
        *THREAD,
        F.col("sample_index").alias("parent_index"),
        F.col("start_time_ms").alias("p_start"),
        F.col("raw_start_ns").alias("p_raw"),
        F.col("__dur").alias("p_dur"),
        F.col("children_count").alias("p_children"),
    )
    parent_key = [*THREAD, "parent_index"]
    children = timed.filter(F.col("parent_index").isNotNull()).select(
        *parent_key, "sample_index", "start_time_ms", "raw_start_ns", F.col("__dur").alias("dur")
    )
    offset = F.coalesce(
        ((F.col("raw_start_ns") - F.col("p_raw")).cast("double") / F.lit(1e6)), F.col("start_time_ms") - F.col("p_start")
    )
    tolerance = F.greatest(F.lit(2e-5), F.abs("p_dur") * 1e-5)
    placed = (
        children.join(parents, parent_key)
        .withColumns({"start": offset, "tol": tolerance})
        .select(*parent_key, "sample_index", "start", "dur", "p_dur", "tol", (F.col("start") + F.col("dur")).alias("finish"))
    )
    ordered = running(placed, parent_key, ["start", "sample_index"], {"before": ("max", F.col("finish"))})
    infinite = float("inf")
    inside = (
        (F.abs("start") < infinite)
        & (F.abs("finish") < infinite)
        & (F.col("dur") >= 0)
        & (F.col("start") >= -F.col("tol"))
        & (F.col("finish") <= F.col("p_dur") + F.col("tol"))
        & (F.col("start") >= F.greatest(F.lit(0.0), F.col("before")) - F.col("tol"))
    )
    checked = ordered.groupBy(*parent_key).agg(
        F.count(F.lit(1)).alias("__found"), F.sum("dur").alias("__sum"), F.bool_and(inside).alias("__inside")
    ).withColumnRenamed("parent_index", "sample_index")
    # ``checked`` holds calls with declared children only; the others, most of the samples, are not moved to meet it
    declared = F.coalesce(F.col("children_count") > 0, F.lit(False))
    joined = timed.filter(declared).join(checked, SAMPLE, "left").unionByName(timed.filter(~declared), allowMissingColumns=True)
    total = F.coalesce("__sum", F.lit(0.0))
    tol = F.greatest(F.lit(2e-5), F.abs("__dur") * 1e-5)
    valid = (
        (F.col("__dur") >= 0)
        & (F.col("__dur") < infinite)
        & (F.coalesce("__found", F.lit(0)) == F.col("children_count"))
        & F.coalesce("__inside", F.lit(True))
        & (total <= F.col("__dur") + tol)
        & ~F.col("is_counter")
    )
    ok = F.coalesce(valid, F.lit(False))
    return joined.withColumns(
        {
            "self_ms": F.when(ok, F.greatest(F.col("__dur") - total, F.lit(0.0))),
            "self_reason": F.when(~ok, F.lit("counter, or child count or intervals do not fit")),
        }
    ).drop("__dur", "__found", "__sum", "__inside")


def call_paths(samples: DataFrame, **kw) -> DataFrame:
    """T4: path of marker names, plus ``path_rule`` where the path is too deep or too long."""
    tree = with_tree(samples, ("parent_index", "depth", "path"), **kw)
    size = F.aggregate("path", F.lit(0), lambda acc, name: acc + F.octet_length(name))
    rule = F.when(F.col("depth") > MAX_DEPTH, F.lit("depth")).when(size > MAX_PATH_BYTES, F.lit("path_bytes"))
    return tree.withColumn("path_rule", rule)


def rollup_bytes(samples: DataFrame, long_threads: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """T5: inclusive allocation of every sample (its own bytes and all descendants').

    A subtree is a run of rows, so inside a block its bytes are the difference of
    two running sums.  Later blocks add what lies under the calls carried into
    them: one row per open call and block, of long threads only.
    """
    blocked, long_threads, carried = _carried(samples, long_threads, block_rows)
    fields = samples.schema.fields
    here = _scanned(blocked.unionByName(carried, allowMissingColumns=True), fields, ["subtree_bytes"])
    long_rows = blocked.join(long_threads, THREAD, "left_semi").unionByName(carried, allowMissingColumns=True)
    later = _scanned(long_rows, fields, ["subtree_bytes"], entries=True).groupBy(*SAMPLE).agg(F.sum("subtree_bytes").alias("__later"))
    total = F.col("subtree_bytes") + F.coalesce("__later", F.lit(0).cast("decimal(38,0)"))
    return here.join(later, SAMPLE, "left").withColumn("inclusive_bytes", total.cast("decimal(30,0)")).drop("subtree_bytes", "__later")


CPU_BUCKETS = {
    "rendering": ["Render"],
    "scripts": ["Scripts"],
    "physics": ["Physics", "Physics2D"],
    "animation": ["Animation"],
    "gc": ["GC"],
    "vsync": ["VSync"],
    "ui": ["Gui", "UI Layout", "UI Render", "UI Details"],
}


def cpu_by_category(tree: DataFrame) -> DataFrame:
    """Self milliseconds per frame and category; unknown categories are dropped.

    Self here is ``max(total - sum of direct children, 0)`` without interval checks.
    """
    spent = (
        tree.filter(F.col("parent_index").isNotNull())
        .groupBy(*THREAD, F.col("parent_index").alias("sample_index"))
        .agg(F.sum("time_ms").alias("__children"))
    )
    own = F.greatest(F.col("time_ms") - F.coalesce("__children", F.lit(0.0)), F.lit(0.0))
    named = tree.join(spent, SAMPLE, "left").select(
        *FRAME, own.alias("self_ms"), category_name(F.col("category_index")).alias("category")
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("category").isin(names), F.col("self_ms"))), F.lit(0.0)).alias(f"{bucket}_ms")
        for bucket, names in CPU_BUCKETS.items()
    ]
    return named.groupBy(*FRAME).agg(*sums, F.lit(0.0).alias("others_ms"))


def select_thread(threads: DataFrame, frames: DataFrame, thread_index: int | None = None) -> DataFrame:
    """The wanted thread of every frame, by default the only one named Main Thread.

    ``status`` is ok, ambiguous or not_found; ``thread_index`` is NULL unless ok.
    """
    match = F.col("thread_name") == MAIN_THREAD if thread_index is None else F.col("thread_index") == thread_index
    found = threads.filter(match).groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("matches"), F.min("thread_index").alias("candidate")
    )
    matches = F.coalesce("matches", F.lit(0))
    return frames.select(*FRAME).join(found, FRAME, "left").select(
        *FRAME,
        F.when(matches == 1, F.col("candidate")).alias("thread_index"),
        F.when(matches == 1, F.lit("ok")).when(matches == 0, F.lit("not_found")).otherwise(F.lit("ambiguous")).alias("status"),
    )


def keep_threads(samples: DataFrame, chosen: DataFrame) -> DataFrame:
    return samples.join(chosen.filter(F.col("status") == "ok").select(*THREAD), THREAD, "left_semi")
