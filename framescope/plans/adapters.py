"""Canonical tables derived from the driver's tables, for checks at any scale.

recording = line status, frame = part, thread = line number modulo two, samples
= line items of the thread in a fixed order with a closed call tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.windows import running
from framescope.operators.tree import BLOCK_CONF, BLOCK_ROWS
from framescope.schemas import ALLOC_MARKER, FRAME, MAIN_THREAD, THREAD

LINE_ORDER = [
    "l_linenumber", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("capture_id"),
        F.col("l_partkey").alias("frame_index"),
        (F.col("l_linenumber") % 2).cast("long").alias("thread_index"),
        *LINE_ORDER,
        "l_returnflag",
    )


def long_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads longer than one scan block, counted without building the samples."""
    size = int(spark.conf.get(BLOCK_CONF, str(BLOCK_ROWS)))
    lines = _keyed_lines(spark, sf_dir)
    return lines.groupBy(*THREAD).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select(*THREAD)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-order samples with child counts, times and allocation bytes."""
    quantity = F.col("l_quantity")
    lines = running(
        _keyed_lines(spark, sf_dir),
        THREAD,
        LINE_ORDER,
        prefix={"i": ("count", None), "start": ("sum", quantity)},
        totals={"n": ("count", None), "thread_total": ("sum", quantity)},
        # a head and its up to two leaves
        ahead={"group_total": (2, quantity)},
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("frame_index"), "p_brand", "p_type", "p_size"
    )
    i, n = F.col("i"), F.col("n")
    head = i % 3 == 1
    children = F.when(i == 0, F.ceil((n - 1) / 3)).when(head, F.least(F.lit(2), n - 1 - i)).otherwise(0).cast("long")
    joined = lines.join(parts, "frame_index", "left")
    is_alloc = F.when(i == 0, F.lit(False)).when(head, F.col("p_size") % 5 == 0).otherwise(F.col("l_returnflag") == "R")
    thread_name = F.when(F.col("thread_index") == 0, F.lit(MAIN_THREAD)).otherwise(F.lit("Job.Worker 1"))
    name = (
        F.when(i == 0, thread_name)
        .when(is_alloc, F.lit(ALLOC_MARKER))
        .when(head, F.concat(F.lit("Update."), F.col("p_brand")))
        .otherwise(F.col("p_type"))
    )
    overlap = (F.col("l_returnflag") == "A") & (i % 3 == 0) & (i > 0)
    return joined.select(
        *THREAD,
        i.alias("sample_index"),
        (F.col("l_suppkey") % 1000).cast("int").alias("marker_id"),
        name.alias("marker_name"),
        (F.col("l_suppkey") % 40).cast("int").alias("category_index"),
        F.when(i == 0, F.col("thread_total")).when(head, F.col("group_total")).otherwise(quantity).alias("time_ms"),
        (F.col("start") - F.when(overlap, F.lit(0.5)).otherwise(0.0)).alias("start_time_ms"),
        children.alias("children_count"),
        F.when(is_alloc & (F.col("frame_index") % 7 != 0), 1).otherwise(0).cast("long").alias("metadata_count"),
        F.when(is_alloc, F.floor("l_extendedprice").cast("decimal(20,0)")).alias("gc_alloc_bytes"),
        F.lit(False).alias("is_counter"),
        F.lit(None).cast("decimal(20,0)").alias("raw_start_ns"),
        F.lit(None).cast("float").alias("raw_duration_ns"),
        F.col("l_returnflag").alias("flag"),
        quantity.alias("q"),
    )


def threads(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per thread with its declared allocation total (right in all but some frames)."""
    rows = samples(spark, sf_dir) if rows is None else rows
    off_by_one = F.when(F.col("frame_index") % 23 == 0, 1).otherwise(0)
    return rows.groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.sum("gc_alloc_bytes"), F.lit(0).cast("decimal(30,0)")).alias("actual"),
    ).select(
        *THREAD,
        (F.lit(1000) + F.col("thread_index")).cast("decimal(20,0)").alias("thread_id"),
        F.when(F.col("thread_index") == 0, F.lit(MAIN_THREAD)).otherwise(F.lit("Job.Worker 1")).alias("thread_name"),
        F.when(F.col("thread_index") == 1, F.lit("Jobs")).alias("thread_group_name"),
        (F.col("actual") + off_by_one).cast("decimal(20,0)").alias("gc_alloc_total_bytes"),
        "sample_count",
    )


def dump_frames(spark: SparkSession, sf_dir: str, thread_rows: DataFrame | None = None) -> DataFrame:
    """One row per frame as a dump declares it; some declarations are off on purpose."""
    thread_rows = threads(spark, sf_dir) if thread_rows is None else thread_rows
    true_total = F.sum(F.col("gc_alloc_total_bytes") - F.when(F.col("frame_index") % 23 == 0, 1).otherwise(0))
    return thread_rows.groupBy(*FRAME).agg(
        F.sum("sample_count").alias("n"), true_total.alias("b")
    ).select(
        *FRAME,
        F.when(F.col("frame_index") % 5 != 0, F.col("n").cast("double") * 2).alias("frame_time_ms"),
        (F.col("n") + F.when(F.col("frame_index") % 97 == 0, 1).otherwise(0)).alias("sample_count_total"),
        (F.col("b") + F.when(F.col("frame_index") % 31 == 0, 1).otherwise(0)).cast("decimal(20,0)").alias("gc_alloc_bytes_total"),
    )


def _when_not(divisor: int, value: Column) -> Column:
    return F.when(F.col("frame_index") % divisor != 0, value)


def frames(spark: SparkSession, sf_dir: str, flawed: bool = True, position: bool = True) -> DataFrame:
    """Canonical per-frame metrics; validity comes from the frame number.

    ``flawed=False`` leaves every metric valid, for rules that need full coverage.
    """
    lines = _keyed_lines(spark, sf_dir)
    main = F.sum(F.when(F.col("thread_index") == 0, F.col("l_quantity")))
    sums = lines.groupBy(*FRAME).agg(
        main.alias("cpu"),
        F.sum("l_quantity").alias("total"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.floor("l_extendedprice"))), F.lit(0)).alias("bytes"),
        F.sum("l_suppkey").alias("supp"),
        F.count(F.lit(1)).alias("n"),
        F.max("l_quantity").alias("top"),
    )
    keep = (lambda d, v: _when_not(d, v)) if flawed else (lambda d, v: v)
    out = sums.select(
        *FRAME,
        keep(6, F.coalesce("cpu", F.lit(0.0))).alias("cpu_ms"),
        keep(5, F.col("total") + 1).alias("frame_ms"),
        keep(7, F.col("bytes").cast("decimal(20,0)")).alias("gc_bytes"),
        keep(8, F.col("supp")).alias("draw_calls"),
        keep(9, F.col("n")).alias("set_pass_calls"),
        keep(10, F.col("top").cast("long")).alias("batches"),
        keep(12, F.col("supp") * F.col("n")).alias("triangles"),
        keep(14, F.col("supp") * 3).alias("vertices"),
        (F.col("frame_index") % 6 != 0).alias("samples_valid") if flawed else F.lit(True).alias("samples_valid"),
        (F.col("frame_index") % 7 != 0).alias("sites_valid") if flawed else F.lit(True).alias("sites_valid"),
        F.lit(True).alias("render_valid"),
        ((F.col("frame_index") % 11 == 0) if flawed else F.lit(False)).alias("estimated"),
        (F.when(F.col("frame_index") % 13 == 0, False) if flawed else F.lit(None).cast("boolean")).alias("version_verified"),
        F.concat(F.lit("dump-"), F.lower("capture_id")).alias("source"),
        F.array_compact(
            F.array(
                F.when(F.col("frame_index") % 6 == 0, F.lit("main thread missing, duplicated or root not unique")),
                F.when(F.col("frame_index") % 7 == 0, F.lit("allocation total missing or inconsistent")),
                F.when(F.col("frame_index") % 8 == 0, F.lit("Draw Calls Count: not recorded")),
            )
        ).alias("reasons"),
    )
    if not position:
        return out
    return running(out, ["capture_id"], ["frame_index"], {"position": ("count", None)})
