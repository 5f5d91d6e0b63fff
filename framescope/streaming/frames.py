"""ST1/ST2: recordings that arrive as files, and intervals with carried state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framescope.sources.dump_reader import read_texts
from framescope.sources.dumps import dump_tables, file_capture_id


def stream_dumps(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """New dump files of a folder as rows of ``dump_reader.PARSED``.

    A multi-line file is one recording named by the file; with
    ``multi_line=False`` every line is one, named by its ``input_file`` or, where
    that cannot be read, by a hash of the line.
    """
    raw = spark.readStream.option("wholetext", str(multi_line).lower()).text(folder)
    if multi_line:
        name = file_capture_id(F.url_decode(F.col("_metadata.file_name")))
    else:
        given = F.try_variant_get(F.try_parse_json("value"), "$.input_file", "string")
        name = F.coalesce(file_capture_id(given), F.concat(F.lit("line "), F.substring(F.sha2("value", 256), 1, 16)))
    return read_texts(raw.select(name.alias("capture_id"), F.col("value").alias("json")))


def _written(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_frames(spark: SparkSession, folder: str, target: str, checkpoint: str, multi_line: bool = True) -> StreamingQuery:
    """ST1: write the frame rows of each new file once to a Parquet table.

    The checkpoint remembers the files read and the file sink commits each
    batch once, so a restart neither loses nor repeats a file.
    """
    return _written(dump_tables(stream_dumps(spark, folder, multi_line))["frames"], target, checkpoint)


def stream_violations(spark: SparkSession, folder: str, target: str, checkpoint: str, multi_line: bool = True) -> StreamingQuery:
    """ST1: write what breaks the recordings of each new file once to a Parquet table."""
    return _written(dump_tables(stream_dumps(spark, folder, multi_line))["violations"], target, checkpoint)


INTERVALS = "capture_id STRING, frame_index BIGINT, frame_ms DOUBLE, reason STRING"
STATE = "frame_index BIGINT, raw_frame_id BIGINT, start_ns STRING, skipped BOOLEAN"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """The new frames of one recording; the state is its last frame seen."""
    if state.hasTimedOut:
        state.remove()
        return
    last = tuple(state.get) if state.exists else None
    rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable")
    behind = rows["frame_index"].duplicated().to_numpy()
    if last:
        behind |= (rows["frame_index"] <= last[0]).to_numpy()
    late, new = rows[behind], rows[~behind]
    if len(late):
        yield pd.DataFrame({"capture_id": key[0], "frame_index": late["frame_index"], "frame_ms": None, "reason": "frame arrived after a later one"})
    if last:
        before = pd.DataFrame([last], columns=["frame_index", "raw_frame_id", "start_ns", "skipped"])
        new = pd.concat([before, new[before.columns]])
    if len(new) > 1:
        start = new["start_ns"].map(int).to_numpy(object)  # exact integers of any size
        ids, skipped = new["raw_frame_id"].to_numpy(np.int64), new["skipped"].to_numpy(bool)
        step = start[1:] - start[:-1]
        reason = np.select(
            [skipped[:-1], skipped[1:], ids[1:] != ids[:-1] + 1, (step < 0).astype(bool)],
            ["frame not recorded", "no next frame start", "raw frame ids not consecutive", "frame start goes back"], "",
        ).astype(object)
        good = reason == ""
        ms = np.full(len(step), np.nan)
        ms[good] = (step[good].astype(np.float64).astype(np.float32) * np.float32(1e-6)).astype(np.float64)
        reason[good] = None
        frame_ms = pd.Series(ms, dtype=object).where(good, None)
        yield pd.DataFrame({"capture_id": key[0], "frame_index": new["frame_index"].to_numpy()[:-1], "frame_ms": frame_ms.to_numpy(), "reason": reason})
    end = new.iloc[-1]  # without a new frame this is the one carried
    state.update((int(end["frame_index"]), int(end["raw_frame_id"]), str(end["start_ns"]), bool(end["skipped"])))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def stream_intervals(headers: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """ST2: F3 over a stream of frame headers, carrying each recording's last frame seen.

    A frame's interval is emitted when the next frame arrives, however far its
    number is; the last one stays open.  A frame that is not after the last seen
    of its recording is reported, not reordered.  One small state is kept for a
    recording; with ``idle_ms`` it goes when nothing has come for so long (a stream
    with a time limit runs on without data, so it does not suit a trigger that
    ends).  A task takes the new frames of a recording in one batch; how many that
    are is the source's batch limit.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = headers.select("capture_id", "frame_index", F.col("raw_frame_id").cast("bigint").alias("raw_frame_id"), F.col("start_ns").cast("string").alias("start_ns"), "skipped")
    return rows.groupBy("capture_id").applyInPandasWithState(partial(_advance, idle_ms=idle_ms), INTERVALS, STATE, "append", timeout)
