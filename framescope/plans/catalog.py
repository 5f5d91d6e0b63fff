"""All registered queries; importing this module fills the registry."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.operators import metrics, ranking
from framescope.plans import (  # noqa: F401
    compare_queries, frame_queries, history_queries, metric_queries, project_queries, ranking_queries, scalar_queries, source_queries, stream_queries, tree_queries,
)
from framescope.plans import inputs
from framescope.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest CPU hotspots of each recording with its frame-time percentiles."""
    frames = inputs.frames(spark, sf_dir)
    hotspots = metrics.cpu_hotspots(inputs.markers(spark, sf_dir), frames)
    rated = metrics.quality(frames, F.col("samples_valid"))
    stats = metrics.metric_rank_stats(frames, "cpu_ms")
    named = stats.select("capture_id", *[F.col(c).alias(f"frame_{c}_ms") for c in metrics.STATS])
    return ranking.hotspots_page(hotspots, rated, "cpu", 0, 10).join(named, "capture_id")


__all__ = ["ORACLES", "QUERIES", "flagship"]
