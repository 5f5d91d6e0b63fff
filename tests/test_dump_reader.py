"""The dump reader, piece by piece, and what breaks recordings."""

import json

import pyarrow as pa
import pytest

from framescope.operators import validate
from framescope.sources import convention, dump_reader, dumps
from framescope.sources.dump_reader import FrameScanner
from framescope.sources.json_rules import check_convention
from framescope.streaming import frames as frame_streams
from tests.test_dump import small_dump


def scan(text, size):
    scanner, found = FrameScanner(), []
    for k in range(0, len(text), size):
        found += scanner.feed(text[k : k + size])
    return [f for _, f in [*found, *scanner.finish()]], scanner


def odd_dump():
    doc = small_dump(other={"a]": [1, "}]\\\"", {"b": []}]})
    doc["frames"][0]["threads"][0]["thread_group_name"] = 'a "quoted" ]} \\ name é'
    return doc | {"frame_count": 2012}


@pytest.mark.parametrize("size", [1, 3, 50, 10**6])
@pytest.mark.parametrize("indent", [None, 1])
def test_frames_do_not_depend_on_pieces(size, indent):
    doc = odd_dump()
    found, scanner = scan(json.dumps(doc, indent=indent), size)
    assert found == doc["frames"] and scanner.findings.rows == [] and scanner.root["frame_count"] == 2012


def test_a_text_that_ends_too_early_is_broken():
    text = json.dumps(odd_dump())
    for cut in range(0, len(text) - 1, 17):
        assert scan(text[:cut], 40)[1].findings.rows == [(None, None, None, "malformed_json")]


def test_scanning_holds_a_frame_not_the_file():
    frame = json.dumps(small_dump()["frames"][0])
    scanner, held = FrameScanner(), 0
    found = list(scanner.feed('{"unity_version": "x", "frame_count": 1, "frames": ['))
    for k in range(3_000):
        found += scanner.feed(("," if k else "") + frame)
        held = max(held, len(scanner._text))
    found += [*scanner.feed("]}"), *scanner.finish()]
    assert len(found) == 3_000 and held <= 2 * len(frame) and scanner.findings.rows == []


@pytest.mark.parametrize(
    "text, rules",
    [
        ("[]", {"malformed_json"}), ('{"a": 1,}', {"malformed_json"}), ("{} x", {"malformed_json"}), ('{"frames": [], "unity_version": NaN}', {"malformed_json"}),
        ('{"frames": [], "frames": [], "unity_version": "", "frame_count": 1}', {"duplicate_field:frames"}),
        ('{"frames": null, "unity_version": 1, "frame_count": -1}', {"ill_typed:frames", "ill_typed:unity_version", "ill_typed:frame_count"}),
        ('{"unity_version": "x", "frame_count": 1.0}', {"ill_typed:frame_count", "missing:frames"}),
        ('{"frames": [1, {"frame_index": 3}], "unity_version": "x", "frame_count": 2}', {"ill_typed:frame", "missing:frame.sample_count_total", "missing:frame.threads"}),
    ],
)
def test_rules_of_a_dump(text, rules):
    assert {rule for *_, rule in scan(text, 5)[1].findings.rows} == rules


def test_files_in_blocks_and_only_the_broken_recordings_go(spark, tmp_path):
    docs = {f"good{k}": odd_dump() for k in range(4)} | {"typed": odd_dump(), "sample": odd_dump(), "twice": odd_dump()}
    docs["typed"]["frames"][1]["frame_time_ms"] = "fast"
    docs["sample"]["frames"][0]["threads"][0]["samples"][2]["gc_alloc_bytes"] = 2**64
    for name, doc in docs.items():
        text = json.dumps(doc, indent=1)
        (tmp_path / f"{name}.json").write_text(text.replace('"frame_index": 12', '"frame_index": 12, "frame_index": 12') if name == "twice" else text)
    (tmp_path / "cut.json").write_text(json.dumps(odd_dump())[:-40])
    (tmp_path / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = dumps.read_dump(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    broken = {tuple(r) for r in found["violations"].collect()}
    assert broken == {
        ("typed", 12, None, None, "ill_typed:frame.frame_time_ms"), ("sample", 10, 0, 2, "ill_typed:sample.gc_alloc_bytes"),
        ("twice", 12, None, None, "duplicate_field:frame.frame_index"), ("cut", None, None, None, "malformed_json"),
    }
    kept = validate.reject(found["samples"], found["violations"])
    assert {(r.capture_id, r["count"]) for r in kept.groupBy("capture_id").count().collect()} == {(f"good{k}", 7) for k in range(4)}
    assert {r.declared_frame_count for r in validate.reject(found["captures"], found["violations"]).collect()} == {2012}


def test_streamed_violations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(odd_dump(), indent=1))
    (tmp_path / "in" / "b.json").write_text("{")
    for name, start in (("frames", frame_streams.stream_frames), ("violations", frame_streams.stream_violations)):
        start(spark, str(tmp_path / "in"), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    assert {(r.capture_id, r.frame_index) for r in spark.read.parquet(str(tmp_path / "frames")).collect()} == {("a", 10), ("a", 12)}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "violations")).collect()] == [("b", None, None, None, "malformed_json")]


def test_rules_of_convention_texts(spark):
    rules = lambda text: {rule for *_, rule in check_convention(text).rows}
    assert rules(None) == rules("") == rules("{") == {"malformed_json"} and rules("1") == {"ill_typed:root"}
    assert rules('{"frames": [{"metadata": 5, "x": {"cpuMs": "a"}}]}') == rules("[]") == rules('{"header": {}, "samples": []}') == set()
    assert rules('{"frames": [{"cpuMs": true, "cpu_ms": null}]}') == {"duplicate_field:cpuMs"}
    assert rules('[{"index": 3, "index": 3}]') == {"duplicate_field:index"}
    assert check_convention('[{"index": 9, "samples": [{"ms": 1}, 5, {"name": 3, "totalBytes": -1}]}]').rows == [
        (9, None, 1, "ill_typed:samples"), (9, None, 2, "ill_typed:samples.name"), (9, None, 2, "ill_typed:samples.totalBytes"),
    ]
    assert rules('[{"samples": null}]') == {"ill_typed:samples"} and rules('{"meta": null, "frames": []}') == {"ill_typed:meta"}
    texts = spark.createDataFrame([("good", '[{"index": 1}]'), ("flat", '{"samples": [{"ms": 1}]}'), ("none", "[]"), ("bad", "[{]")], "capture_id STRING, json STRING")
    found = convention.parse_frames(texts)
    assert [(r.capture_id, r.rule) for r in found["violations"].collect()] == [("bad", "malformed_json")]
    assert {r.capture_id for r in validate.reject(found["frames"], found["violations"]).collect()} == {"good"}
    assert "none" in {r.capture_id for r in found["warnings"].collect()}
    assert {r.capture_id for r in convention.parse_flat_samples(texts.filter("capture_id = 'flat'"))["warnings"].collect()} == {"flat"}


def test_frames_that_come_in_pieces_are_decoded_about_once():
    from framescope.sources.dump_reader import FrameScanner

    thread = {"thread_index": 0, "thread_id": 1, "thread_name": "Main Thread", "samples": []}
    frames = [{"frame_index": k, "sample_count_total": 0, "threads": [thread | {"thread_index": t} for t in range(5)]} for k in range(200)]
    pieces = json.dumps({"unity_version": "x", "frame_count": 200, "frames": frames}).split("]")
    scanner, tries = FrameScanner(), []
    whole = scanner._decoder.raw_decode
    scanner._decoder.raw_decode = lambda *place: tries.append(1) or whole(*place)
    found = [f for n, p in enumerate(pieces) for f in scanner.feed(p + ("]" if n + 1 < len(pieces) else ""))] + [*scanner.finish()]
    assert [(at, f["frame_index"]) for at, f in found] == [(k, k) for k in range(200)] and not scanner.findings.rows
    assert len(tries) < 220


def test_sound_frames_are_not_looked_at_field_by_field(monkeypatch):
    """Every field of a frame and thread was looked up by its class and spellings, sound or not."""
    from framescope.sources import json_rules as rules

    def frame(**sample):
        base = {"sample_index": 0, "marker_id": 1, "marker_name": "m", "time_ms": 1, "start_time_ms": 0.5, "children_count": 0, "metadata_count": 0}
        thread = {"thread_index": 0, "thread_id": 7, "thread_name": "t", "thread_group_name": None, "samples": [base, base | sample]}
        return {"frame_index": 3, "sample_count_total": 2, "threads": [thread]}

    def plain(found, position):
        """The rules applied to each object in turn."""
        findings = rules.Findings()
        if findings.check(found, rules.DUMP_FRAME_FIELDS, (rules._number(found, "frame_index", position),), "frame."):
            for t, thread in enumerate(found["threads"]):
                place = (found["frame_index"], rules._number(thread, "thread_index", t))
                if findings.check(thread, rules.DUMP_THREAD_FIELDS, place, "thread."):
                    for k, sample in enumerate(thread["samples"]):
                        findings.check(sample, rules.DUMP_SAMPLE_FIELDS, (*place, k), "sample.")
        return findings.rows

    whole = frame()
    cases = [whole, None, [], {}, whole | {"threads": None}, whole | {"threads": [None, {}]}, whole | {"frame_time_ms": float("inf")}, whole | {"frame_index": True},
             whole | {rules.TWICE: ["other"]}, whole | {rules.TWICE: ["threads"]}, whole | {"gc_alloc_bytes_total": 2**64}, whole | {"frame_time_ms": None}]
    values = [None, True, 0, -1, 2**31, 2**63, 2**64, 0.5, float("nan"), "x", [], {}]
    cases += [frame(**{f.name: v}) for f in rules.DUMP_SAMPLE_FIELDS for v in values] + [frame(**{rules.TWICE: n}) for n in (["time_ms"], ["other"])]
    cases += [whole | {"threads": [whole["threads"][0] | {f.name: v}]} for f in rules.DUMP_THREAD_FIELDS for v in values]
    for case in cases:
        findings = rules.Findings()
        assert rules.check_dump_frame(case, 5, findings) == (not plain(case, 5))
        assert findings.rows == plain(case, 5)

    asked = []
    monkeypatch.setattr(rules.Findings, "check", lambda *a: asked.append(a) or True)
    assert rules.check_dump_frame(whole, 0, rules.Findings()) and not asked


@pytest.mark.parametrize("most", [1, 300, 1 << 18])
def test_packs_give_the_texts_back(monkeypatch, most):
    monkeypatch.setattr(dump_reader, "PACKED", most)
    doc = odd_dump()
    doc["frames"] *= 40
    texts = {"x": json.dumps(doc), "y": '{"é": []}', "z": "[]]]"}
    pieces = [(c, f"file:/{c}", 0 if k < 50 else 1000, k, t) for c, text in texts.items() for k, t in enumerate(text.removesuffix("]").split("]"))]
    names = ["capture_id", "__file", "__block", "__order", "text"]

    def batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(names, p, strict=True)) for p in rows], schema=pa.schema([*[(n, pa.string()) for n in names[:2]], *[(n, pa.int64()) for n in names[2:4]], (names[4], pa.string())]))

    # the second block is read by another task
    packs = [r for rows in (pieces[50:], pieces[:50], []) for b in dump_reader._packed([batch(rows)]) for r in b.to_pylist()]
    assert all(p["size"] < most + max(len(p[-1].encode()) for p in pieces) for p in packs) and (most > 1 or len(packs) == len(pieces))
    packs.sort(key=lambda p: (p["__file"], p["__block"], p["__order"]))
    sent = pa.RecordBatch.from_pylist(packs).select(["capture_id", "size", "packed"])
    found = {}
    for capture, text in dump_reader._unpacked([sent.slice(0, 1), sent.slice(1, 0), sent.slice(1)]):
        found[capture] = found.get(capture, "") + text
    assert found == {c: t.removesuffix("]") for c, t in texts.items()}
    assert most < 1 << 18 or sum(len(p["packed"]) for p in packs) * 5 < sum(map(len, texts.values()))


def test_texts_are_moved_packed_and_files_may_be_cut(spark, tmp_path):
    """The shuffle of plain pieces, each with its path, was most of what S1 moved and spilled."""
    doc = odd_dump()
    doc["frames"] = [f | {"frame_index": n} for n, f in enumerate(doc["frames"] * 30)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        parsed = dump_reader.read_pieces(spark, str(tmp_path), dumps.file_capture_id)
        rows = parsed.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan, moved = parsed._jdf.queryExecution().optimizedPlan(), []

    def walk(node):
        if node.nodeName() == "RepartitionByExpression":
            moved.append(node.output().toString())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    assert len(moved) == 1 and "packed#" in moved[0] and "text#" not in moved[0]
    assert sorted((r.capture_id, r.frame_pos, r.f.frame_index) for r in rows if r.f) == [(c, n, n) for c in "ab" for n in range(len(doc["frames"]))]
    assert [r.violations for r in rows if not r.f] == [[], []]
