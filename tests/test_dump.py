import json

from pyspark.sql import functions as F

from framescope.operators import frames as frame_ops
from framescope.operators import metrics, ranking, tree, validate
from framescope.sources import dumps, routing, tables


def sample(i, name, ms, kids, size=None, meta=None):
    meta = (0 if size is None else 1) if meta is None else meta
    return dict(sample_index=i, marker_id=i, marker_name=name, category_index=1, time_ms=ms, start_time_ms=0.0, children_count=kids, metadata_count=meta, gc_alloc_bytes=size)


def thread(i, name, total, samples):
    return dict(thread_index=i, thread_id=1000 + i, thread_name=name, thread_group_name=None, gc_alloc_total_bytes=total, samples=samples)


def small_dump(**changes):
    main = [sample(0, "Main Thread", 12.0, 1), sample(1, "Update", 8.0, 1), sample(2, "GC.Alloc", 0.0, 1, 20), sample(3, "GC.Alloc", 0.0, 0, 4), ]
    first = dict(frame_index=10, frame_time_ms=16.0, sample_count_total=6, gc_alloc_bytes_total=32,
                 threads=[thread(0, "Main Thread", 24, main), thread(1, "Worker", 8, [sample(0, "Work", 3.0, 1), sample(1, "GC.Alloc", 0.0, 0, 8)])])
    second = dict(frame_index=12, frame_time_ms=None, sample_count_total=1, gc_alloc_bytes_total=0, threads=[thread(0, "Main Thread", 0, [sample(0, "Main Thread", 1.0, 0)])])
    return dict(input_file="x", captured_at="now", unity_version="6000.3.9f1", frame_count=20, frames=[first, second], **changes)


def write(tmp_path, docs):
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return str(tmp_path)


def analysed(found):
    paths = tree.with_tree(found["samples"], ("parent_index", "depth", "owner_name"))
    cpu = validate.main_root(found["frames"], found["threads"], paths)
    gc = validate.reconcile_gc(found["frames"], found["threads"], found["samples"])
    return paths, cpu, gc, dumps.canonical_frames(found, cpu, gc)


def test_dump_totals_sites_and_ranks(spark, tmp_path):
    found = dumps.read_dump(spark, write(tmp_path, {"one": small_dump()}))
    paths, cpu, gc, frames = analysed(found)
    rows = {r.frame_index: r for r in frames.collect()}
    assert (rows[10].cpu_ms, int(rows[10].gc_bytes), rows[10].capture_id) == (12.0, 32, "one")
    assert int(rows[12].gc_bytes) == 0 and rows[12].frame_ms is None
    sites = frame_ops.alloc_sites(tree.attribute_alloc(found["samples"]), found["threads"], gc)
    hot = {(r.thread, r.name): (int(r.total_bytes), r.call_count) for r in metrics.gc_hotspots(sites).collect()}
    assert hot == {("Main Thread #0", "Update"): (24, 2), ("Worker #1", "Work"): (8, 1)}
    totals = metrics.gc_totals(frames).first()
    assert (int(totals.total_alloc_bytes), totals.p50) == (32, 32.0)
    assert validate.partial_export(found["captures"], found["frames"]).first().exported == 2
    assert validate.sample_totals(found["frames"], found["threads"]).count() == 0
    assert metrics.session_meta(frames, found["captures"]).first().duration_ms == 16.0


def test_missing_metadata_distrusts_the_frame(spark, tmp_path):
    doc = small_dump()
    doc["frames"][0]["threads"][0]["samples"][2]["metadata_count"] = 0
    found = dumps.read_dump(spark, write(tmp_path, {"one": doc}))
    _, _, gc, frames = analysed(found)
    rows = {r.frame_index: r for r in gc.collect()}
    assert not rows[10].gc_valid and rows[10].gc_bytes is None and rows[12].gc_valid
    assert metrics.quality(frames, F.col("gc_bytes").isNotNull()).first().status == "partial"
    assert validate.visible_bytes(found["samples"], gc).filter("gc_alloc_bytes IS NOT NULL").count() == 0


def test_structural_rules_reject_only_the_bad_recording(spark, tmp_path):
    bad = small_dump()
    bad["frames"][0]["threads"][0]["samples"][1]["sample_index"] = 5
    bad["frames"][1]["frame_index"] = 10
    found = dumps.read_dump(spark, write(tmp_path, {"good": small_dump(), "bad": bad}))
    broken = validate.union_all([validate.sample_positions(found["samples"]), validate.duplicate_ids(found["frames"], found["threads"])])
    assert {r.capture_id for r in broken.collect()} == {"bad"}
    assert {r.capture_id for r in validate.reject(found["frames"], broken).collect()} == {"good"}


def test_duplicate_main_thread_has_no_cpu(spark, tmp_path):
    doc = small_dump()
    doc["frames"][0]["threads"][1]["thread_name"] = "Main Thread"
    _, cpu, _, _ = analysed(dumps.read_dump(spark, write(tmp_path, {"one": doc})))
    assert {r.frame_index: r.cpu_ms for r in cpu.collect()} == {10: None, 12: 1.0}


def peak_dump():
    frames = []
    for n in range(21):
        last = n == 20
        main = [sample(0, "Main Thread", 40.0 if last else 1.0, 1 if last else 0)] + ([sample(1, "GC.Alloc", 0.0, 0, 8388600)] if last else [])
        threads = [thread(0, "Main Thread", 8388600 if last else 0, main)] + ([thread(1, "Worker", 8, [sample(0, "W", 1.0, 1), sample(1, "GC.Alloc", 0.0, 0, 8)])] if last else [])
        frames.append(dict(frame_index=100 + 3 * n, frame_time_ms=50.0 if last else 16.0, sample_count_total=4 if last else 1, gc_alloc_bytes_total=8388608 if last else 0, threads=threads))
    return dict(unity_version="6000.3.9f1", frame_count=21, frames=frames)


def test_isolated_peak(spark, tmp_path):
    _, _, _, frames = analysed(dumps.read_dump(spark, write(tmp_path, {"peak": peak_dump()})))
    cpu = metrics.metric_rank_stats(frames, "cpu_ms").first()
    assert (cpu.p95, cpu.max) == (1.0, 40.0)
    gc = metrics.gc_totals(frames).first()
    assert (gc.p95, int(gc.total_alloc_bytes)) == (0.0, 8388608)
    issues = {r.area: r for r in ranking.analysis(frames).collect()}
    assert set(issues) == {"cpu", "gc"}
    assert all(i.trigger == "isolated-peak" and i.affected_frames == 1 and i.evidence_frames[0].frame_index == 160 for i in issues.values())


def test_table_round_trip_and_change_detection(spark, tmp_path):
    folder = write(tmp_path, {"a": small_dump(), "b": peak_dump()})
    found = dumps.read_dump(spark, folder)
    tables.write_capture_tables(found, str(tmp_path / "out"))
    for name, df in found.items():
        stored = tables.load_capture_table(spark, str(tmp_path / "out" / name), df.schema)
        assert stored.exceptAll(df).count() == 0 and df.exceptAll(stored).count() == 0
    one = tables.point_lookup(tables.load_capture_table(spark, str(tmp_path / "out" / "samples"), found["samples"].schema), "a", 10)
    assert one.count() == 6
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_id" in plan and "PushedFilters: [IsNotNull(frame_index)" in plan
    before = spark.createDataFrame(routing.fingerprint_files(spark, folder + "/*.json").collect())
    (tmp_path / "a.json").write_text("{}")
    states = routing.changed(routing.fingerprint_files(spark, folder + "/*.json"), before)
    assert sorted(r.state for r in states.collect()) == ["changed", "unchanged"]
