"""Registered queries: sources and sinks.

Every order becomes one small recording text; its shape follows the order key.
"""

import uuid

from pyspark.sql import functions as F

from framescope.operators import validate
from framescope.plans import adapters, inputs
from framescope.plans.oracle import SAMPLES
from framescope.plans.registry import check
from framescope.schemas import SAMPLE
from framescope.sources import convention, dumps, routing, tables


def orders(spark, sf):
    rows = adapters.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return rows


def dump_thread(n, name, frame, key, cust):
    """A thread of two samples: a root and an allocation in it."""

    def sample(index, name, ms, kids, size):
        return F.struct(
            F.lit(index).alias("sample_index"), (cust % 100).alias("marker_id"), name.alias("marker_name"), (cust % 40).alias("category_index"),
            ms.alias("time_ms"), F.lit(0.25 * index).alias("start_time_ms"), F.lit(kids).alias("children_count"),
            F.lit(1 if size is not None else 0).alias("metadata_count"), (F.lit(None).cast("bigint") if size is None else size).alias("gc_alloc_bytes"),
            F.lit("ignored").alias("extra"),
        )

    ms = (cust % 50 + frame).cast("double") + 0.5
    size = key + frame
    return F.struct(
        F.lit(n).alias("thread_index"), (F.lit(1000 + n)).alias("thread_id"), F.lit(name).alias("thread_name"), F.lit(None if n == 0 else "Jobs").alias("thread_group_name"),
        size.alias("gc_alloc_total_bytes"),
        F.array(sample(0, F.lit(name), ms, 1, None), sample(1, F.lit("GC.Alloc"), F.lit(0.125), 0, size)).alias("samples"),
    )


def dump_texts(spark, sf):
    """A dump of one to three frames with two threads of two samples."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    thread = lambda n, name, frame: dump_thread(n, name, frame, key, cust)
    frames = F.transform(
        F.sequence(F.lit(0), key % 3),
        lambda n: F.struct(
            (n * 3 + 10).alias("frame_index"), F.when(key % 5 != 0, cust.cast("double") / 8).alias("frame_time_ms"), F.lit(4).alias("sample_count_total"),
            ((key + n) * 2).alias("gc_alloc_bytes_total"), F.array(thread(0, "Main Thread", n), thread(1, "Worker", n)).alias("threads"),
        ),
    )
    doc = F.struct(
        F.concat(F.lit("rec/order"), key, F.lit(".data")).alias("input_file"), F.lit("6000.3.9f1").alias("unity_version"), (key % 3 + 1 + (key % 7 == 0).cast("int")).alias("frame_count"), frames.alias("frames")
    )
    return orders(spark, sf).select(F.concat(F.lit("order"), key).alias("capture_id"), F.to_json(doc).alias("json"))


DUMPED = """fd AS (SELECT o_orderkey AS k, o_custkey AS c, n FROM orders, (VALUES (0), (1), (2)) v(n) WHERE n <= o_orderkey % 3),
  sd AS (SELECT 'order' || k AS capture_id, 10 + 3 * n AS frame_index, t AS thread_index, s AS sample_index, CASE WHEN s = 1 THEN 'GC.Alloc' WHEN t = 0 THEN 'Main Thread' ELSE 'Worker' END AS marker_name,
    CAST(c % 40 AS INTEGER) AS category_index, CASE WHEN s = 0 THEN c % 50 + n + 0.5::DOUBLE ELSE 0.125::DOUBLE END AS time_ms, 1 - s AS children_count, CASE WHEN s = 1 THEN k + n END AS bytes
    FROM fd, (VALUES (0), (1)) tt(t), (VALUES (0), (1)) ss(s))"""


#: Customers of one recording file; every order is a frame of its customer's recording.
FILE_CUSTOMERS = 30


def dump_files(spark, sf):
    """The folder of dump files, one per recording, written line by line; some are broken by recording number.

    Of ten recordings one ends too early, one has frame times that are text, one
    gives frame numbers twice and one has samples without time.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders(spark, sf).withColumn("r", F.floor(cust / FILE_CUSTOMERS).cast("bigint")).select("r", "o_orderkey", "o_custkey")
    first = rows.groupBy("r").agg(F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("n"))
    body = rows.join(first, "r").select("r", key.alias("pos"), F.lit("frame").alias("part"), key, cust, "first")
    head = first.select("r", F.lit(-1).cast("bigint").alias("pos"), F.lit("head").alias("part"), "n")
    tail = first.filter("r % 10 != 3").select("r", F.lit(1 << 60).alias("pos"), F.lit("tail").alias("part"))
    placed = head.unionByName(body, True).unionByName(tail, True).withColumn("capture_id", F.concat(F.lit("rec"), "r"))
    # only keys are moved; a line is made where it is written
    ordered = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "capture_id").sortWithinPartitions("capture_id", "pos")
    folder = f"{tables.shared_folder(spark)}/framescope-{uuid.uuid4().hex}"
    ordered.select("capture_id", dump_line().alias("value")).write.options(**tables.PACKED_TEXT).partitionBy("capture_id").text(folder)
    return folder


def dump_line():
    """The line of a recording's head, of one of its frames or of its end."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    threads = F.array(dump_thread(0, "Main Thread", F.lit(0), key, cust), dump_thread(1, "Worker", F.lit(0), key, cust))
    frame = F.to_json(F.struct(key.alias("frame_index"), (cust + 0.5).alias("frame_time_ms"), F.lit(4).alias("sample_count_total"), (key * 2).alias("gc_alloc_bytes_total"), threads.alias("threads")))
    kind = F.col("r") % 10
    broken = (
        F.when((kind == 5) & (key % 8 == 1), F.regexp_replace(frame, r'"frame_time_ms":[0-9.]+', '"frame_time_ms":"fast"'))
        .when((kind == 7) & (key % 8 == 2), F.concat(F.lit('{"frame_index":0,'), F.substring(frame, 2, 1 << 30)))
        .when((kind == 9) & (key % 8 == 3), F.regexp_replace(frame, '"time_ms":0.125,', ""))
        .otherwise(frame)
    )
    head = F.concat(F.lit('{"unity_version": "6000.3.9f1", "notes": {"a]": [1, "}"]},\n "frame_count": '), F.col("n"), F.lit(', "frames": ['))
    body = F.concat(F.when(key == F.col("first"), F.lit("")).otherwise(F.lit(",")), broken)
    return F.when(F.col("part") == "head", head).when(F.col("part") == "tail", F.lit(']\n, "end": [null]}')).otherwise(body)


def read_dump_files(spark, sf):
    return dumps.read_dump(spark, dump_files(spark, sf), lambda path: F.regexp_extract(path, "capture_id=([^/]+)/", 1))


FILED = f"fo AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey // {FILE_CUSTOMERS} AS r FROM orders)"


@check(
    "s1_read_dump",
    f"""WITH {FILED}, ok AS (SELECT r FROM fo GROUP BY r HAVING r % 10 <> 3 AND NOT bool_or(r % 10 = 5 AND k % 8 = 1 OR r % 10 = 7 AND k % 8 = 2 OR r % 10 = 9 AND k % 8 = 3))
    SELECT 'rec' || r AS capture_id, k AS frame_index, CAST(t AS BIGINT) AS thread_index, CAST(s AS BIGINT) AS sample_index, CAST(s AS BIGINT) AS pos, CASE WHEN s = 1 THEN 'GC.Alloc' WHEN t = 0 THEN 'Main Thread' ELSE 'Worker' END AS marker_name,
      CAST(c % 40 AS INTEGER) AS category_index, CASE WHEN s = 0 THEN c % 50 + 0.5::DOUBLE ELSE 0.125::DOUBLE END AS time_ms, CAST(1 - s AS BIGINT) AS children_count, CASE WHEN s = 1 THEN k END AS bytes
    FROM fo SEMI JOIN ok USING (r), (VALUES (0), (1)) tt(t), (VALUES (0), (1)) ss(s)""",
)
def read_dump(spark, sf):
    """Samples of the recordings that nothing breaks."""
    found = read_dump_files(spark, sf)
    rows = validate.reject(found["samples"], found["violations"])
    return rows.select(*SAMPLE, "pos", "marker_name", "category_index", "time_ms", "children_count", F.col("gc_alloc_bytes").cast("bigint").alias("bytes"))


@check(
    "s1_broken_dumps",
    f"""WITH {FILED}
    SELECT 'rec' || r AS capture_id, k AS frame_index, CAST(NULL AS BIGINT) AS thread_index, CAST(NULL AS BIGINT) AS sample_index, CASE r % 10 WHEN 5 THEN 'ill_typed:frame.frame_time_ms' ELSE 'duplicate_field:frame.frame_index' END AS rule
    FROM fo WHERE r % 10 = 5 AND k % 8 = 1 OR r % 10 = 7 AND k % 8 = 2
    UNION ALL SELECT 'rec' || r, k, CAST(t AS BIGINT), 1::BIGINT, 'missing:sample.time_ms' FROM fo, (VALUES (0), (1)) tt(t) WHERE r % 10 = 9 AND k % 8 = 3
    UNION ALL SELECT DISTINCT 'rec' || r, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 'malformed_json' FROM fo WHERE r % 10 = 3""",
)
def broken_dumps(spark, sf):
    return read_dump_files(spark, sf)["violations"]


def frame_texts(spark, sf):
    """Frame lists under changing field spellings; every fourth is a bare list."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))
    q = lambda name: F.concat(F.lit('"'), name, F.lit('":'))
    optional = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise(F.lit(""))
    marker = F.concat(
        F.lit('{"'), pick("name", "functionName", "markerName"), F.lit('":"'), F.col("o_orderpriority"), F.lit('",'), q(pick("totalMs", "durationMs", "duration_ms", "ms")), cust, F.lit(".5"),
        optional(key % 2 == 0, F.lit(',"callCount":'), key % 9), F.lit("}"),
    )
    site = F.concat(F.lit('{"name":"Site'), key % 4, F.lit('","metadata":[1,'), cust, F.lit(',0]}'))
    frame = lambda n: F.concat(
        F.lit("{"), optional(key % 3 != 0, q(pick("frameIndex", "frame_index", "index")), F.lit(n * 5 + 2), F.lit(",")),
        q(pick("durationMs", "duration_ms", "ms")), cust, F.lit("."), F.lit(n), optional(key % 5 != 0, F.lit(","), q(pick("cpuMs", "cpu_ms")), key % 40),
        optional(key % 7 != 0, F.lit(","), q(pick("gcAlloc", "gc_alloc_bytes", "gcAllocBytes")), key), optional(key % 11 == 0, F.lit(',"drawCalls":1,"draw_calls":2')),
        F.lit(',"unknown":{"a":1},'), q(pick("mainThreadSamples", "main_thread_samples", "samples")), F.lit("["), marker, F.lit('],"gcAllocSites":['), site, F.lit("]}"),
    )
    frames = F.concat(F.lit("["), frame(0), F.lit(","), frame(1), F.lit("]"))
    text = F.when(key % 4 == 0, frames).otherwise(F.concat(F.lit('{"meta":{"platform":"p","unityVersion":"v'), key % 3, F.lit('","frameCount":7},"frames":'), frames, F.lit("}")))
    return orders(spark, sf).select(F.concat(F.lit("order"), key).alias("capture_id"), text.alias("json"))


@check(
    "s2_read_frames_json",
    """WITH f AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS pr, n FROM orders, (VALUES (0), (1)) v(n))
    SELECT 'order' || k AS capture_id, CAST(n AS BIGINT) AS position, CAST(CASE WHEN k % 3 <> 0 THEN n * 5 + 2 ELSE n END AS BIGINT) AS frame_index, CASE WHEN k % 5 <> 0 THEN CAST(k % 40 AS DOUBLE) END AS cpu_ms,
      CAST(c || '.' || n AS DOUBLE) AS frame_ms, CASE WHEN k % 7 <> 0 THEN k END AS gc_bytes, true AS samples_valid, c > 0 AS sites_valid, pr AS marker, c + 0.5::DOUBLE AS total_ms,
      CASE WHEN k % 2 = 0 THEN k % 9 ELSE 1 END AS call_count, 'Site' || k % 4 AS site, CASE WHEN c > 0 THEN c ELSE 1 END AS site_bytes, CASE WHEN k % 11 = 0 THEN 'duplicate_field:drawCalls' END AS rule FROM f""".replace("c > 0 AS sites_valid", "true AS sites_valid"),
)
def read_frames_json(spark, sf):
    found = convention.parse_frames(frame_texts(spark, sf), store=True)
    key = ["capture_id", "frame_index"]
    frames = found["frames"].select(*key, "position", "cpu_ms", "frame_ms", F.col("gc_bytes").cast("bigint").alias("gc_bytes"), "samples_valid", "sites_valid")
    markers = found["markers"].select(*key, F.col("name").alias("marker"), "total_ms", "call_count")
    sites = found["sites"].select(*key, F.col("name").alias("site"), F.col("total_bytes").cast("bigint").alias("site_bytes"))
    # files tell too little about the rows of nested lists: without the hints Spark would send whole tables through the driver
    found_rules = found["violations"].select(*key, "rule")
    return frames.join(markers.hint("merge"), key).join(sites.hint("merge"), key).join(found_rules.hint("merge"), key, "left")


@check(
    "s2_broken_texts",
    """WITH t AS (SELECT o_orderkey AS k FROM orders)
    SELECT 'order' || k AS capture_id, frame_index, CAST(NULL AS BIGINT) AS thread_index, sample_index, rule FROM (
      SELECT k, NULL::BIGINT AS frame_index, NULL::BIGINT AS sample_index, 'malformed_json' AS rule FROM t WHERE k % 8 IN (0, 1)
      UNION ALL SELECT k, k % 5, NULL, 'ill_typed:cpuMs' FROM t WHERE k % 8 = 2
      UNION ALL SELECT k, k % 5, 1, 'duplicate_field:mainThreadSamples.totalMs' FROM t WHERE k % 8 = 3
      UNION ALL SELECT k, 0, NULL, 'ill_typed:drawCalls' FROM t WHERE k % 8 = 3
      UNION ALL SELECT k, NULL, NULL, 'duplicate_field:meta.unityVersion' FROM t WHERE k % 8 = 4
      UNION ALL SELECT k, NULL, NULL, 'missing:frames' FROM t WHERE k % 8 = 5
      UNION ALL SELECT k, 0, 1, 'ill_typed:samples.callCount' FROM t WHERE k % 8 = 6)""",
)
def broken_texts(spark, sf):
    """Texts broken by the order's key: truncated, ended by a comma, ill-typed, double-spelled, of another shape; one in eight is sound."""
    key = F.col("o_orderkey")
    frame = F.concat(F.lit('{"index": '), key % 5, F.lit(', "cpuMs": '))
    shapes = [
        F.concat(F.lit('{"frames": ['), frame, key), F.concat(F.lit("["), frame, F.lit("1},]")), F.concat(F.lit("["), frame, F.lit('"1"}]')),
        F.concat(F.lit("["), frame, F.lit('2, "samples": [], "mainThreadSamples": [{"ms": 1}, {"ms": 1, "totalMs": 1}]}, {"index": 0, "drawCalls": -1}]')),
        F.concat(F.lit('{"meta": {"unity": "a", "unityVersion": "a"}, "frames": ['), frame, F.lit("2.5}]}")), F.concat(F.lit('{"meta": {"frameCount": '), key, F.lit("}}")),
        F.concat(F.lit('{"samples": [{"name": "a", "ms": '), key, F.lit('}, {"ms": 1, "callCount": 1.5}]}')), F.concat(F.lit('{"frames": ['), frame, F.lit("null}]}")),
    ]
    text = F.get(F.array(*shapes), (key % 8).cast("int"))
    return convention.violations(orders(spark, sf).select(F.concat(F.lit("order"), key).alias("capture_id"), text.alias("json")))


@check(
    "v3_negative_times",
    """WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
    SELECT 'order' || k AS capture_id, k % 5 AS frame_index, CAST(NULL AS BIGINT) AS thread_index, CAST(NULL AS BIGINT) AS sample_index, rule FROM (
      SELECT k, 'frame_time' AS rule FROM t WHERE c % 7 = 0 OR k % 11 = 0 UNION ALL SELECT k, 'marker_time' FROM t WHERE k % 3 = 0 OR k % 5 = 0)""",
)
def negative_times(spark, sf):
    """Frame lists whose times fall below zero for some customers and orders."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit('[{"index": '), key % 5, F.lit(', "cpuMs": '), cust % 7 - 1, F.when(key % 11 == 0, F.lit(', "ms": -0.5')).otherwise(F.lit(', "ms": null')),
        F.lit(', "samples": [{"name": "m", "ms": '), key % 3 - 1, F.lit(', "maxMs": '), key % 5 - 1, F.lit("}]}]"),
    )
    found = convention.parse_frames(orders(spark, sf).select(F.concat(F.lit("order"), key).alias("capture_id"), text.alias("json")), store=True)
    return validate.negative_times(found["markers"], found["frames"])


@check(
    "s3_read_flat_samples",
    """SELECT 'order' || o_orderkey AS capture_id, CASE WHEN o_orderkey % 5 NOT IN (0, 1) THEN o_custkey + 0.25::DOUBLE + o_orderkey % 10 END AS cpu_ms, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) WHEN o_orderkey % 3 = 0 THEN 8.5::DOUBLE END AS frame_ms,
      o_orderkey % 5 NOT IN (0, 1) AS samples_valid, true AS estimated, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS declared_frame_count FROM orders""",
)
def read_flat_samples(spark, sf):
    """Two samples; with key mod 5 = 1 the second has no duration, with 0 there are none."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    header = F.when(key % 2 == 0, F.concat(F.lit('{"duration":'), cust, F.lit(',"frame_count":3}'))).when(key % 3 == 0, F.lit('{"totalTime":8.5}')).otherwise(F.lit("{}"))
    second = F.when(key % 5 == 1, F.lit('{"name":"b"}')).otherwise(F.concat(F.lit('{"name":"b","ms":'), key % 10, F.lit("}")))
    samples = F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('{"name":"a","totalMs":'), cust, F.lit(".25},"), second))
    texts = orders(spark, sf).select(F.concat(F.lit("order"), key).alias("capture_id"), F.concat(F.lit('{"header":'), header, F.lit(',"samples":['), samples, F.lit("]}")).alias("json"))
    found = convention.parse_flat_samples(texts)
    frames = found["frames"].select("capture_id", "cpu_ms", "frame_ms", "samples_valid", "estimated")
    return frames.join(found["captures"].select("capture_id", "declared_frame_count").hint("merge"), "capture_id")


ROUTES = [
    ('{"input_file": null}', "dump", None), ('{"unity_version": "x", "frames": []}', "dump", None), ('{"frames": [{"index": 1}, {"threads": null}]}', "dump", None),
    ('{"frames": [{"cpuMs": 1}]}', "frames", None), (' [ {"ms": 1} ]', "frames", None), ('{"samples": []}', "samples", None), ('{"other": {"threads": 1}}', "rejected", "unknown shape"),
    ("not json", "rejected", "not a JSON object or list"),
]


@check(
    "s4_route_format",
    f"""WITH t AS (SELECT o_orderkey AS k, o_orderkey % {len(ROUTES)} AS shape, CASE WHEN o_orderkey % 29 = 0 THEN 'data' WHEN o_orderkey % 31 = 0 THEN 'txt' ELSE 'JSON' END AS ext FROM orders)
    SELECT 'f' || k || '.' || ext AS path, CASE WHEN ext <> 'JSON' THEN 'rejected' ELSE {[r for _, r, _ in ROUTES]}[CAST(shape AS INTEGER) + 1] END AS route,
      CASE ext WHEN 'data' THEN 'binary recording' WHEN 'txt' THEN 'unsupported extension' ELSE CASE shape WHEN 6 THEN 'unknown shape' WHEN 7 THEN 'not a JSON object or list' END END AS reason FROM t""",
)
def route_format(spark, sf):
    key = F.col("o_orderkey")
    text = F.get(F.lit([t for t, _, _ in ROUTES]), (key % len(ROUTES)).cast("int"))
    ext = F.when(key % 29 == 0, F.lit("data")).when(key % 31 == 0, F.lit("txt")).otherwise(F.lit("JSON"))
    files = orders(spark, sf).select(F.concat(F.lit("f"), key, F.lit("."), ext).alias("path"), text.alias("json"))
    return routing.route_format(files).select("path", "route", "reason")


@check(
    "s5_fingerprint",
    """WITH a AS (SELECT 'doc' || doc_id AS path, sha256(text) AS h, doc_id FROM documents)
    SELECT path, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE h END AS sha256, CASE WHEN doc_id % 7 = 3 THEN 'removed' WHEN doc_id % 7 = 4 THEN 'added' WHEN doc_id % 7 = 5 THEN 'changed' ELSE 'unchanged' END AS state FROM a""",
)
def fingerprint(spark, sf):
    """Expected hashes are of another text for some documents and missing for others."""
    documents = adapters.table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("path"), "text", "doc_id")
    actual = routing.fingerprint(documents.filter("doc_id % 7 <> 3"), "text")
    before = F.when(F.col("doc_id") % 7 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    expected = routing.fingerprint(documents.filter("doc_id % 7 <> 4").withColumn("text", before), "text")
    return routing.changed(actual, expected).join(actual, "path", "left").select("path", "sha256", "state")


@check(
    "s6_capture_tables",
    f"WITH {SAMPLES} SELECT capture_id, frame_index, count(*) AS samples, sum(q) AS q, CAST(sum(bytes) AS BIGINT) AS bytes FROM smp GROUP BY 1, 2",
)
def capture_tables(spark, sf):
    """Write the samples as a canonical table, read it back and aggregate it."""
    samples = inputs.samples(spark, sf)
    path = f"{tables.shared_folder(spark)}/framescope-{uuid.uuid4().hex}/samples"
    tables.write_capture_table(samples, path)
    stored = tables.load_capture_table(spark, path, samples.schema)
    return stored.groupBy("capture_id", "frame_index").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("q").alias("q"), F.sum("gc_alloc_bytes").cast("bigint").alias("bytes")
    )
