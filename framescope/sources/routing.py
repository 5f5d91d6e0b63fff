"""Which reader a file needs, and whether files changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Recording formats by extension (fixed values); only json is read here.
BINARY_EXTENSIONS = ["raw", "data", "pd3u", "uppc"]


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def route_format(files: DataFrame) -> DataFrame:
    """``route`` is dump, frames, samples or rejected, with a reason.

    A dump has a root key ``input_file`` or ``unity_version``, or a frame with
    the key ``threads``; a key whose value is null counts.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    is_list = F.ltrim("json").startswith("[")
    keys = F.json_object_keys("json")
    frames = F.from_json("json", "frames ARRAY<STRING>").getField("frames")
    has_threads = F.exists(frames, lambda f: F.array_contains(F.json_object_keys(f), "threads"))
    has = lambda key: F.coalesce(F.array_contains("keys", key), F.lit(False))
    marked = files.withColumns({"ext": extension, "keys": keys, "frame_threads": F.coalesce(has_threads, F.lit(False))})
    valid_list = is_list & F.from_json("json", "ARRAY<STRING>").isNotNull()
    route = (
        F.when(F.col("ext") != "json", F.lit("rejected"))
        .when(~is_list & (has("input_file") | has("unity_version") | F.col("frame_threads")), F.lit("dump"))
        .when(has("frames") | valid_list, F.lit("frames"))
        .when(has("samples"), F.lit("samples"))
        .otherwise(F.lit("rejected"))
    )
    reason = (
        F.when(F.col("ext").isin(BINARY_EXTENSIONS), F.lit("binary recording"))
        .when(F.col("ext") != "json", F.lit("unsupported extension"))
        .when(F.col("keys").isNull() & ~valid_list, F.lit("not a JSON object or list"))
        .when(route == "rejected", F.lit("unknown shape"))
    )
    return marked.withColumns({"route": route, "reason": reason}).drop("ext", "keys", "frame_threads")


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of each file's bytes."""
    return files.select("path", F.sha2(F.col(content), 256).alias("sha256"))


def fingerprint_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    loaded = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return fingerprint(loaded)


def changed(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Each path as unchanged, changed, added or removed against the expected hashes."""
    joined = actual.withColumnRenamed("sha256", "now").join(expected.withColumnRenamed("sha256", "before"), "path", "full_outer")
    state = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("removed"))
        .when(F.col("before") == F.col("now"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return joined.select("path", state.alias("state"))


def reject_changed(files: DataFrame, states: DataFrame) -> DataFrame:
    """Only the files whose content is what was recorded."""
    return files.join(states.filter("state = 'unchanged'").select("path"), "path", "left_semi")
