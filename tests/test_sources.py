import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framescope.functions import scalars as fn
from framescope.operators import metrics, project, validate
from framescope.plans import source_queries
from framescope.sources import convention, project_files, routing


def texts(spark, **docs):
    return spark.createDataFrame(list(docs.items()), "capture_id STRING, json STRING")


V1 = """{"meta": {"platform": "p", "frameCount": 9}, "frames": [
 {"index": 4, "cpuMs": 0, "gcAlloc": 0, "mainThreadSamples": [{"name": "Update", "totalMs": 2, "callCount": 2, "maxMs": 1}]},
 {"cpu_ms": 10, "gc_alloc_bytes": 1024, "samples": [{"markerName": "Update", "ms": 3}], "gcAllocSites": [{"metadata": [7, 0]}]},
 {"durationMs": 5, "gcAllocBytes": 2048}]}"""


def test_frame_list_facts(spark):
    found = convention.parse_frames(texts(spark, one=V1))
    frames = found["frames"]
    rows = frames.orderBy("position").collect()
    assert [(r.frame_index, r.cpu_ms, r.frame_ms) for r in rows] == [(4, 0.0, None), (1, 10.0, None), (2, None, 5.0)]
    stats = metrics.metric_rank_stats(frames, "cpu_ms").first()
    assert stats.p95 == 10.0
    assert metrics.quality(frames, F.col("cpu_ms").isNotNull()).first().valid_frames == 2
    hot = metrics.cpu_hotspots(found["markers"], frames).first()
    assert (hot.total_ms, hot.call_count, hot.max_ms) == (5.0, 3, 3.0)
    totals = metrics.gc_totals(frames).first()
    assert (int(totals.total_alloc_bytes), totals.p50) == (3072, 1024.0)
    site = found["sites"].first()
    assert (site.name, int(site.total_bytes), site.call_count) == ("unattributed", 7, 1)
    assert found["captures"].first().declared_frame_count == 9


def test_convention_rules(spark):
    doc = '[{"cpuMs": -1, "drawCalls": 1, "draw_calls": 1, "samples": [{"ms": 2, "maxMs": -3}]}]'
    found = convention.parse_frames(texts(spark, one=doc))
    assert found["violations"].first().rule == "duplicate_field:drawCalls"
    assert {r.rule for r in validate.negative_times(found["markers"], found["frames"]).collect()} == {"frame_time", "marker_time"}


def test_flat_samples_are_one_estimated_frame(spark):
    doc = '{"header": {"totalTime": 7}, "samples": [{"name": "a", "ms": 1.5}, {"totalMs": 2, "callCount": 4}]}'
    found = convention.parse_flat_samples(texts(spark, one=doc))
    row = found["frames"].first()
    assert (row.cpu_ms, row.frame_ms, row.estimated, row.frame_index) == (3.5, 7.0, True, 0)
    assert metrics.metric_stats(found["frames"]).filter("metric = 'cpuMs'").first().valid_frames == 0
    assert metrics.quality(found["frames"], F.col("cpu_ms").isNotNull()).first().status == "estimated"


@pytest.mark.parametrize(
    "text, route",
    [
        ('{"unity_version": null}', "dump"), ('{"frames": [{"threads": null}]}', "dump"), ('{"frames": []}', "frames"), ("[]", "frames"),
        ('{"header": {}, "samples": []}', "samples"), ("{}", "rejected"), ("{", "rejected"),
    ],
)
def test_routing(spark, text, route):
    assert routing.route_format(spark.createDataFrame([("a/b.JSON", text)], "path STRING, json STRING")).first().route == route


def test_convention_files(spark, tmp_path):
    (tmp_path / "my rec.json").write_text(V1)
    assert convention.read_frames_json(spark, str(tmp_path))["frames"].first().capture_id == "my rec"


def test_text_tree_and_encodings(spark, tmp_path):
    (tmp_path / "Assets" / "obj").mkdir(parents=True)
    (tmp_path / "Assets" / "obj" / "x.cs").write_text("skipped folder")
    (tmp_path / "Assets" / "a.cs").write_bytes("één\r\ntwo\n".encode())
    (tmp_path / "Assets" / "b.txt").write_bytes("﻿hé😀\nz".encode("utf-16-le"))
    (tmp_path / "Assets" / "c.mat").write_bytes(b"ok\0no")
    (tmp_path / "Assets" / "d.json").write_bytes(b"\xff\xfe\x00\xd8")
    (tmp_path / "Assets" / "e.png").write_bytes(b"\x89")
    (tmp_path / "Assets" / "f.txt").write_bytes(b"bad \xc3")
    listed = {r.path: r.is_text for r in project_files.scan_text_tree(spark, str(tmp_path)).collect()}
    assert listed == {"Assets/a.cs": True, "Assets/b.txt": True, "Assets/c.mat": True, "Assets/d.json": True, "Assets/e.png": False, "Assets/f.txt": True}
    files = project_files.read_text_files(spark, str(tmp_path))
    lines = [(r.path, r.line, r.text) for r in project_files.explode_lines(files).filter("path LIKE 'Assets/_.%'").orderBy("path", "line").collect()]
    assert lines == [("Assets/a.cs", 1, "één"), ("Assets/a.cs", 2, "two"), ("Assets/b.txt", 1, "hé😀"), ("Assets/b.txt", 2, "z")]
    reasons = {r.path: r.reason for r in project_files.with_text(files).collect()}
    assert reasons["Assets/c.mat"] == "binary content" and reasons["Assets/d.json"] and reasons["Assets/f.txt"]


def test_texts_are_decoded_once_and_cut_like_their_lines(spark):
    long = "x" * project_files.MAX_LINE_BYTES
    contents = [
        b"", b"\n", b"a", b"a\n", b"a\r\r\n\r\nb\r", b"\xef\xbb\xbfu\n\n", b"\xff\xfe", b"\xff\xfea", b"\xfe\xff\x00a\x00\n\xd8\x3d\xde\x00", b"\xfe\xff\xde\x00",
        b"\xed\xa0\x80", None, long.encode() + b"\ny", long.encode() + b"xy", b"\xff\xfe" + long[: len(long) // 2 + 1].encode("utf-16-le"), b"\xff\xfe" + (long[: len(long) // 2] + "\n").encode("utf-16-le"),
    ]
    files = spark.createDataFrame(list(enumerate(contents)), "path LONG, content BINARY")
    reasons = {r.path: r.reason for r in project_files.with_text(files).collect()}
    broken = "not UTF-8 or marked UTF-16 text"
    assert {k: v for k, v in reasons.items() if v} == {7: broken, 9: broken, 10: broken, 11: broken, 13: "line over the size limit", 14: "line over the size limit"}
    rows = project_files.explode_lines(files)
    found = {}
    for r in rows.orderBy("path", "line").collect():
        found.setdefault(r.path, []).append(r.text)
    assert {k: v for k, v in found.items() if k < 12} == {1: [""], 2: ["a"], 3: ["a"], 4: ["a", "", "b"], 5: ["u", ""], 8: ["a", "😀"]}
    assert found[12] == [long, "y"] and found[15] == [long[: len(long) // 2]]
    plan = rows.filter("line < 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "decode(" not in plan and "rlike" not in plan.lower()


def test_read_lines_makes_the_lines_once(spark):
    lines = spark.createDataFrame([("a", n, f"t{n}") for n in range(1, 8)] + [("b", 2, "t2"), ("b", 3, "y" * 2001), (None, 2, "t2")], "path STRING, line INT, text STRING")
    page = project.read_lines(lines, start_line=2, limit=3)
    rows = sorted((r.path, r.line, r.text[:3], r.line_truncated, r.next_line) for r in page.collect())
    assert rows == [("a", 2, "t2", False, 5), ("a", 3, "t3", False, 5), ("a", 4, "t4", False, 5), ("b", 2, "t2", False, None), ("b", 3, "yyy", True, None)]
    assert page._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_formatting(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert one(fn.format_bytes(F.lit(1280))) == "1.3 KB"
    assert one(fn.format_bytes(F.lit(5 * 1024**3))) == "5.00 GB"
    assert [one(fn.format_ms(F.lit(x))) for x in (0.5, 1.005, 2500.0)] == ["500 μs", "1.00 ms", "2.50 s"]
    assert [one(fn.format_count(F.lit(x))) for x in (999, 1150, 2_500_000)] == ["999", "1.1K", "2.5M"]
    assert one(fn.preview_bytes(F.lit("aé"), 2)) == "a"
    assert one(fn.alloc_bytes(F.lit('{"bytes": true, "size": 3}'))) == 3.0


def test_refused_files_are_not_opened(spark, tmp_path):
    kept = {"a.cs": b"class A", "Sub/B.CS": b"x", "Sub/c.Prefab": b"--- !u!1 &1", "d.json": b"{}"}
    refused = {"e.png": b"x", "cs": b"x", ".cs": b"x", "Library/f.cs": b"x", "Sub/obj/g.json": b"x"}
    for name, content in (kept | refused).items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    (tmp_path / "large.cs").write_bytes(b"x" * (project_files.CODE_BYTES + 1))
    (tmp_path / "large.txt").write_bytes(b"x" * (project_files.CODE_BYTES + 1))
    files = project_files.read_text_files(spark, str(tmp_path))
    assert {r.path: r.size for r in files.collect()} == {n: len(c) for n, c in kept.items()} | {"large.txt": project_files.CODE_BYTES + 1}
    assert files._jdf.queryExecution().executedPlan().toString().count("LessThanOrEqual(length") == 2


@pytest.mark.parametrize("name, joins", [("s2_read_frames_json", 3), ("s3_read_flat_samples", 1)])
def test_tables_of_frame_lists_are_not_sent_through_the_driver(spark, tmp_path, name, joins):
    from framescope.plans.catalog import QUERIES

    orders = [(k, k % 5, "F", "1-URGENT") for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING").write.parquet(f"{tmp_path}/orders.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == joins and "Broadcast" not in plan


def test_dump_files_are_written_packed(spark, tmp_path):
    """Plain text of all dumps was most of the disk of S1's queries."""
    orders = [(k, k % 120, "O", "1-URGENT") for k in range(960)] + [(5, None, "O", "1-URGENT"), (None, 7, "O", "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING").write.parquet(str(tmp_path / "orders.parquet"))
    folder = Path(source_queries.dump_files(spark, str(tmp_path)).removeprefix("file:"))
    parts = list(folder.rglob("part-*"))
    texts = {p.parent.name.removeprefix("capture_id="): gzip.decompress(p.read_bytes()).decode() for p in parts}
    assert len(texts) == len(parts) and sum(p.stat().st_size for p in parts) * 5 < sum(map(len, texts.values()))
    assert set(texts) == {"rec0", "rec1", "rec2", "rec3", "__HIVE_DEFAULT_PARTITION__"}
    for r in (1, 2):
        doc = json.loads(texts[f"rec{r}"])
        mine = [(k, c) for k, c, *_ in orders if c is not None and c // 30 == r]
        assert doc["frame_count"] == len(mine) and doc["end"] == [None]
        assert [(f["frame_index"], f["frame_time_ms"]) for f in doc["frames"]] == [(k, c + 0.5) for k, c in sorted(mine)]
    assert texts["rec3"].startswith('{"unity_version"') and texts["rec3"].endswith("}\n") and '"end"' not in texts["rec3"]
