import json
from decimal import Decimal

from framescope.operators.frames import frame_intervals
from framescope.plans import stream_queries
from framescope.plans.source_queries import dump_texts
from framescope.streaming import activity, frames
from tests.test_dump import small_dump

HEADERS = "capture_id STRING, frame_index BIGINT, raw_frame_id BIGINT, start_ns DECIMAL(20,0), skipped BOOLEAN"


def run(stream, base):
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_intervals_equal_the_batch_over_two_arrivals(spark, tmp_path):
    rows = [(c, i, i + (i > 5), Decimal(2**63 + i * 1000 - (5000 if i == 8 else 0)), i == 3) for c in ("a", "b") for i in range(11)]
    base = str(tmp_path)
    for part in (rows[:4] + rows[11:20], rows[4:11] + rows[20:]):
        spark.createDataFrame(part, HEADERS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run(frames.stream_intervals(spark.readStream.schema(HEADERS).parquet(f"{base}/in")), base)
    streamed = {(r.capture_id, r.frame_index): (r.frame_ms, r.reason) for r in spark.read.schema(frames.INTERVALS).parquet(f"{base}/out").collect()}
    batch = {(r.capture_id, r.frame_index): (r.frame_ms, r.reason) for r in frame_intervals(spark.createDataFrame(rows, HEADERS)).collect() if r.frame_index < 10}
    assert streamed == batch


def test_gaps_over_thousands_of_frames(spark, tmp_path):
    numbers = [4093, 4094, 4097, 4098, 20_000, 20_001, 90_000]
    rows = [("a", i, i, Decimal(i * 1000), False) for i in numbers]
    base = str(tmp_path)
    for part in (rows[:2], rows[2:3], rows[3:6], rows[6:]):
        spark.createDataFrame(part, HEADERS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run(frames.stream_intervals(spark.readStream.schema(HEADERS).parquet(f"{base}/in")), base)
    found = {r.frame_index: r.reason for r in spark.read.schema(frames.INTERVALS).parquet(f"{base}/out").collect()}
    gap = "raw frame ids not consecutive"
    assert found == {4093: None, 4094: gap, 4097: None, 4098: gap, 20_000: None, 20_001: gap}


def test_late_frame_is_reported(spark, tmp_path):
    base = str(tmp_path)
    for ids in ((0, 2), (1,)):
        spark.createDataFrame([("a", i, i, Decimal(i * 1000), False) for i in ids], HEADERS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run(frames.stream_intervals(spark.readStream.schema(HEADERS).parquet(f"{base}/in")), base)
    found = {r.frame_index: r.reason for r in spark.read.schema(frames.INTERVALS).parquet(f"{base}/out").collect()}
    assert found == {0: "raw frame ids not consecutive", 1: "frame arrived after a later one"}


def test_each_dump_file_counts_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("one", "two"):
        (folder / f"{name}.json").write_text(json.dumps(small_dump(), indent=1))
        frames.stream_frames(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.capture_id, r.frame_index) for r in rows) == [("one", 10), ("one", 12), ("two", 10), ("two", 12)]


def test_streamed_dumps_are_written_packed_in_files_of_some(spark, tmp_path, monkeypatch):
    """Plain text of all dumps was nearly all the disk that the query used."""
    orders = [(k, k % 31, "O", "1-URGENT") for k in range(600)]
    spark.createDataFrame(orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    base = tmp_path / "base"
    monkeypatch.setattr(stream_queries, "_folder", lambda spark: str(base))
    monkeypatch.setattr(stream_queries, "FILE_DUMPS", 250)
    rows = stream_queries.stream_frames(spark, str(tmp_path)).collect()
    assert sorted((r.capture_id, r.position, r.frame_index, r.frame_time_ms, r.bytes) for r in rows if r.frame_time_ms) == sorted(
        (f"order{k}", n, 10 + 3 * n, c / 8, (k + n) * 2) for k, c, *_ in orders for n in range(k % 3 + 1) if k % 5 and c
    )
    assert len(rows) == sum(k % 3 + 1 for k, *_ in orders)
    parts = [p for p in (base / "in").iterdir() if p.name.startswith("part-")]
    plain = sum(len(r.json) + 1 for r in dump_texts(spark, str(tmp_path)).collect())
    assert len(parts) == 3 and sum(p.stat().st_size for p in parts) * 5 < plain


def test_log_stream_pages(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    at, lines = 0, []
    for n in range(5):
        line = json.dumps({"runId": "r", "sequence": at, "event": {"n": n}})
        lines.append(line)
        at += len(line) + 1
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n")
    activity.stream_log(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 5
    log = stored.withColumn("line_no", stored["sequence"])
    checked = activity.checked_log(log)
    assert [r.verdict for r in checked.collect()] == ["kept"] * 5
    second = sorted(r.sequence for r in stored.collect())[1]
    page = activity.log_page(checked, spark.createDataFrame([("r", second)], "log_id STRING, cursor BIGINT"), rows=2).collect()
    assert sorted(r.row_pos for r in page) == [0, 1] and min(r.start for r in page) == second
    assert activity.log_page(checked, spark.createDataFrame([("r", 1)], "log_id STRING, cursor BIGINT")).count() == 0
