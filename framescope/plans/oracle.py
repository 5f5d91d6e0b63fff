"""SQL fragments that derive the canonical tables a second way (closed forms)."""

ORDER = "l_linenumber, l_orderkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

# Samples: position in the thread decides parent, depth and children.
SAMPLES = f"""
li AS (
  SELECT l_linestatus AS capture_id, l_partkey AS frame_index, CAST(l_linenumber % 2 AS BIGINT) AS thread_index,
    l_quantity AS q, l_returnflag AS flag, l_suppkey AS supp, CAST(floor(l_extendedprice) AS BIGINT) AS price,
    row_number() OVER w - 1 AS i,
    count(*) OVER (PARTITION BY l_linestatus, l_partkey, l_linenumber % 2) AS n,
    coalesce(sum(l_quantity) OVER (PARTITION BY l_linestatus, l_partkey, l_linenumber % 2 ORDER BY {ORDER}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start0,
    sum(l_quantity) OVER (PARTITION BY l_linestatus, l_partkey, l_linenumber % 2) AS thread_total,
    coalesce(lead(l_quantity, 1) OVER w, 0) AS q1, coalesce(lead(l_quantity, 2) OVER w, 0) AS q2,
    lead(l_returnflag, 2) OVER w AS flag2
  FROM lineitem
  WINDOW w AS (PARTITION BY l_linestatus, l_partkey, l_linenumber % 2 ORDER BY {ORDER})
), named AS (
  SELECT li.*, p_brand, p_type, p_size,
    CASE WHEN thread_index = 0 THEN 'Main Thread' ELSE 'Job.Worker 1' END AS thread_name,
    CASE WHEN i = 0 THEN false WHEN i % 3 = 1 THEN p_size % 5 = 0 ELSE flag = 'R' END AS is_alloc
  FROM li LEFT JOIN part ON p_partkey = frame_index
), smp AS (
  SELECT capture_id, frame_index, thread_index, i AS sample_index, n, q, flag, flag2, supp, thread_name, is_alloc,
    CAST(supp % 40 AS INTEGER) AS category_index, p_size, p_brand,
    CASE WHEN i = 0 THEN thread_name WHEN is_alloc THEN 'GC.Alloc'
         WHEN i % 3 = 1 THEN 'Update.' || p_brand ELSE p_type END AS marker_name,
    CASE WHEN i = 0 THEN thread_total WHEN i % 3 = 1 THEN q + q1 + q2 ELSE q END AS time_ms,
    start0 - CASE WHEN flag = 'A' AND i % 3 = 0 AND i > 0 THEN 0.5::DOUBLE ELSE 0 END AS start_time_ms,
    CAST(CASE WHEN i = 0 THEN ceil((n - 1) / 3.0) WHEN i % 3 = 1 THEN least(2, n - 1 - i) ELSE 0 END AS BIGINT) AS children_count,
    CASE WHEN is_alloc AND frame_index % 7 <> 0 THEN 1 ELSE 0 END AS metadata_count,
    CASE WHEN is_alloc THEN price END AS bytes,
    CASE WHEN i = 0 THEN NULL WHEN i % 3 = 1 THEN 0 ELSE i - (i - 1) % 3 END AS parent_index,
    CASE WHEN i = 0 THEN 0 WHEN i % 3 = 1 THEN 1 ELSE 2 END AS depth,
    CASE WHEN p_size % 5 = 0 THEN 'GC.Alloc' ELSE 'Update.' || p_brand END AS head_name,
    CASE WHEN i % 3 = 1 AND flag2 IS NOT DISTINCT FROM 'A' THEN NULL ELSE q END AS self_ms
  FROM named
), thr AS (
  SELECT capture_id, frame_index, thread_index, 1000 + thread_index AS thread_id, any_value(thread_name) AS thread_name,
    count(*) AS sample_count, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes,
    CAST(coalesce(sum(bytes), 0) AS BIGINT) + CASE WHEN frame_index % 23 = 0 THEN 1 ELSE 0 END AS declared_bytes,
    count(*) FILTER (is_alloc AND metadata_count = 0) AS unrecorded
  FROM smp GROUP BY 1, 2, 3
), dfr AS (
  SELECT capture_id, frame_index, CASE WHEN frame_index % 5 <> 0 THEN 2.0::DOUBLE * sum(sample_count) END AS frame_time_ms,
    CAST(sum(sample_count) AS BIGINT) AS n,
    CAST(sum(sample_count) AS BIGINT) + CASE WHEN frame_index % 97 = 0 THEN 1 ELSE 0 END AS sample_count_total,
    CAST(sum(bytes) AS BIGINT) AS bytes,
    sum(unrecorded) > 0 AS incomplete, count(*) FILTER (declared_bytes <> bytes) > 0 AS thread_off,
    frame_index % 31 = 0 AS frame_off
  FROM thr GROUP BY 1, 2
), gcv AS (
  SELECT capture_id, frame_index, bytes, incomplete, thread_off, frame_off,
    NOT (incomplete OR thread_off OR frame_off) AS gc_valid FROM dfr
)
"""

# Frames: metrics are NULL where the frame number says so.
FRAMES = """
fsum AS (
  SELECT l_linestatus AS capture_id, l_partkey AS frame_index,
    coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END), 0) AS cpu, sum(l_quantity) AS total,
    CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) END), 0) AS BIGINT) AS bytes,
    CAST(sum(l_suppkey) AS BIGINT) AS supp, count(*) AS n, max(l_quantity) AS top
  FROM lineitem GROUP BY 1, 2
), fr AS (
  SELECT capture_id, frame_index, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS position,
    CASE WHEN frame_index % 6 <> 0 THEN cpu END AS cpu_ms,
    CASE WHEN frame_index % 5 <> 0 THEN total + 1 END AS frame_ms,
    CASE WHEN frame_index % 7 <> 0 THEN bytes END AS gc_bytes,
    CASE WHEN frame_index % 8 <> 0 THEN supp END AS draw_calls,
    CASE WHEN frame_index % 9 <> 0 THEN n END AS set_pass_calls,
    CASE WHEN frame_index % 10 <> 0 THEN CAST(top AS BIGINT) END AS batches,
    CASE WHEN frame_index % 12 <> 0 THEN supp * n END AS triangles,
    CASE WHEN frame_index % 14 <> 0 THEN supp * 3 END AS vertices,
    frame_index % 6 <> 0 AS samples_valid, frame_index % 7 <> 0 AS sites_valid,
    frame_index % 11 = 0 AS estimated, CASE WHEN frame_index % 13 = 0 THEN false END AS version_verified,
    'dump-' || lower(capture_id) AS source
  FROM fsum
)
"""


def frames_without_flaws(name: str = "fr") -> str:
    """FRAMES with every metric valid."""
    return f"""
fsum AS (
  SELECT l_linestatus AS capture_id, l_partkey AS frame_index,
    coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END), 0) AS cpu_ms, sum(l_quantity) + 1 AS frame_ms,
    CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) END), 0) AS BIGINT) AS gc_bytes,
    CAST(sum(l_suppkey) AS BIGINT) AS draw_calls, count(*) AS n, max(l_quantity) AS top
  FROM lineitem GROUP BY 1, 2
), {name} AS (
  SELECT capture_id, frame_index, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS position,
    cpu_ms, frame_ms, gc_bytes, draw_calls, n AS set_pass_calls, CAST(top AS BIGINT) AS batches,
    draw_calls * n AS triangles, draw_calls * 3 AS vertices, false AS estimated, CAST(NULL AS BOOLEAN) AS version_verified,
    'dump-' || lower(capture_id) AS source
  FROM fsum
)
"""


def ranks(values: str, keys: str, value: str = "v", extra: str = "") -> str:
    """Nearest-rank statistics of ``values`` (a CTE name) per ``keys``."""
    pick = "max(CASE WHEN rn = CAST(round((n - 1) * {q}::DOUBLE) AS BIGINT) THEN {v} END)"
    return f"""
SELECT {keys}, {pick.format(q="0.5", v=value)} AS p50, {pick.format(q="0.95", v=value)} AS p95,
  {pick.format(q="0.99", v=value)} AS p99, max({value}) AS "max"{extra}
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rn, count(*) OVER (PARTITION BY {keys}) AS n
      FROM {values} WHERE {value} IS NOT NULL)
GROUP BY {keys}
"""
