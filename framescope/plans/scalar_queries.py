"""Registered queries: scalar functions (X)."""

from pyspark.sql import functions as F

from framescope.functions import scalars as fn
from framescope.plans import adapters
from framescope.plans.registry import check

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE_KEY)


def lines(spark, sf, *columns):
    return adapters.table(spark, sf, "lineitem").select(*LINE_KEY, *columns)


def whens(mapping: dict, key: str, default: str = "NULL") -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def fixed_sql(numerator: str, denominator: int, digits: int) -> str:
    """Half-up decimal text of an integer ratio, in integers."""
    units = f"(({numerator}) * {2 * 10**digits} + {denominator}) // {2 * denominator}"
    return f"(CAST(({units}) // {10**digits} AS VARCHAR) || '.' || lpad(CAST(({units}) % {10**digits} AS VARCHAR), {digits}, '0'))"


B = "CAST(floor(l_extendedprice) AS HUGEINT) * CAST(l_suppkey * l_suppkey + 1 AS HUGEINT) // 7"


@check(
    "x1_format_bytes",
    f"""WITH b AS (SELECT {KEYS}, {B} AS n FROM lineitem) SELECT {KEYS}, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {fixed_sql('n', 1024, 1)} || ' KB'
    WHEN n < 1073741824 THEN {fixed_sql('n', 1048576, 1)} || ' MB' ELSE {fixed_sql('n', 1073741824, 2)} || ' GB' END AS shown FROM b""",
)
def format_bytes(spark, sf):
    n = F.floor(F.floor("l_extendedprice").cast("bigint") * (F.col("l_suppkey") * F.col("l_suppkey") + 1) / F.lit(7).cast("decimal(10,0)")).cast("bigint")
    return lines(spark, sf, fn.format_bytes(n).alias("shown"))


@check(
    "x2_format_ms",
    f"""WITH b AS (SELECT {KEYS}, l_extendedprice * l_quantity * 31 / 997 / nullif(l_suppkey, 0) AS ms FROM lineitem) SELECT {KEYS}, CASE WHEN ms < 1 THEN printf('%.0f μs', ms * 1000)
    WHEN ms < 1000 THEN printf('%.2f ms', ms) ELSE printf('%.2f s', ms / 1000) END AS shown FROM b""",
)
def format_ms(spark, sf):
    """No supplier number, no time: shown as NULL.  The longest times are over 2,048 s."""
    ms = F.col("l_extendedprice") * F.col("l_quantity") * 31 / 997 / F.nullif(F.col("l_suppkey"), F.lit(0))
    return adapters.table(spark, sf, "lineitem").select(*LINE_KEY, fn.format_ms(ms).alias("shown"))


# Exact ties (a quarter or three quarters of the unit's tenth) round up; printf alone rounds them to even.
@check(
    "x3_format_count",
    f"""WITH b AS (SELECT {KEYS}, l_partkey * l_suppkey * 3 AS n FROM lineitem) SELECT {KEYS}, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR)
    WHEN n < 1000000 THEN printf('%.1fK', (n + CASE WHEN n % 1000 IN (250, 750) THEN 1 ELSE 0 END) / 1000)
    ELSE printf('%.1fM', (n + CASE WHEN n % 1000000 IN (250000, 750000) THEN 1 ELSE 0 END) / 1000000) END AS shown FROM b""",
)
def format_count(spark, sf):
    return lines(spark, sf, fn.format_count(F.col("l_partkey") * F.col("l_suppkey") * 3).alias("shown"))


MARKERS = [name for names in fn.MARKER_CATEGORIES.values() for name in names]
NAME_OF = {name: category for category, names in fn.MARKER_CATEGORIES.items() for name in names}


@check(
    "x4_marker_category",
    f"""WITH n AS (SELECT {KEYS}, {MARKERS}[CAST(l_partkey % {len(MARKERS) + 10} AS INTEGER) + 1] AS m FROM lineitem)
    SELECT {KEYS}, coalesce(m, 'Custom.' || l_partkey % 10) AS marker_name, {whens(NAME_OF, 'm', "'Other'")} AS marker_category FROM n""",
)
def marker_category(spark, sf):
    known = F.get(F.lit(MARKERS), (F.col("l_partkey") % (len(MARKERS) + 10)).cast("int"))
    rows = lines(spark, sf, F.coalesce(known, F.concat(F.lit("Custom."), F.col("l_partkey") % 10)).alias("marker_name"))
    return fn.with_marker_category(rows)


@check(
    "x5_category_name",
    f"SELECT {KEYS}, {whens(fn.CATEGORY_NAMES, 'l_suppkey % 40')} AS category, l_suppkey % 40 IN {tuple(fn.CATEGORY_NAMES)} AS known FROM lineitem",
)
def category_name(spark, sf):
    key = F.col("l_suppkey") % 40
    return lines(spark, sf, fn.category_name(key).alias("category"), fn.is_known_category(key).alias("known"))


@check(
    "x6_version_string",
    f"SELECT {KEYS}, '6000.' || l_linenumber || '.' || l_suppkey || {whens(fn.RELEASE_SUFFIXES, 'l_partkey % 6', chr(39) + '?' + chr(39))} || l_orderkey % 9 AS version FROM lineitem",
)
def version_string(spark, sf):
    version = fn.version_string(F.lit(6000).cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_partkey") % 6, F.col("l_orderkey") % 9)
    return lines(spark, sf, version.alias("version"))


@check("x7_metadata_unit", f"SELECT {KEYS}, {whens(fn.METADATA_UNITS, '(l_orderkey * 256 + l_suppkey) // 256 % 256')} AS unit FROM lineitem")
def metadata_unit(spark, sf):
    return lines(spark, sf, fn.metadata_unit(F.col("l_orderkey") * 256 + F.col("l_suppkey")).alias("unit"))


@check("x8_flow_kind", f"SELECT {KEYS}, {whens(fn.FLOW_KINDS, 'l_suppkey % 6', chr(39) + 'Unknown' + chr(39))} AS kind FROM lineitem")
def flow_kind(spark, sf):
    return lines(spark, sf, fn.flow_kind(F.col("l_suppkey") % 6).alias("kind"))


@check(
    "x9_alloc_bytes",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_custkey + 0.5::DOUBLE WHEN 1 THEN CAST(o_orderkey + 1 AS DOUBLE) WHEN 2 THEN CAST(o_custkey AS DOUBLE)
      WHEN 3 THEN CAST(o_custkey + 7 AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE NULL END AS bytes FROM orders""",
)
def alloc_bytes(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(key % 7 == 0, F.concat(F.lit('[1, "a", '), cust + F.lit(0.5), F.lit(", 0, 2000000000000, true]")))
        .when(key % 7 == 1, F.concat(F.lit("["), key + 1, F.lit(", -5, null, {\"bytes\": 9}]")))
        .when(key % 7 == 2, F.concat(F.lit('{"size": 4, "bytes": '), cust, F.lit("}")))
        .when(key % 7 == 3, F.concat(F.lit('{"bytes": "12", "size": '), cust + 7, F.lit("}")))
        .when(key % 7 == 4, F.lit("[0, -1, 1000000000000]"))
        .when(key % 7 == 5, F.lit("12"))
    )
    return adapters.table(spark, sf, "orders").select("o_orderkey", fn.alloc_bytes(text).alias("bytes"))


@check(
    "x10_counter_kind",
    f"""WITH c AS (SELECT {KEYS}, 96 + l_partkey % 32 AS id, CASE WHEN l_suppkey % 2 = 0 THEN 4 ELSE 2 END AS t FROM lineitem) SELECT {KEYS}, CASE WHEN id = 100 AND t = 4 THEN 'TotalUsed'
    WHEN id BETWEEN 104 AND 109 THEN 'GcUsed' WHEN id BETWEEN 110 AND 115 THEN 'GcReserved' WHEN id BETWEEN 116 AND 121 THEN 'TextureMemory' ELSE 'Unknown' END AS kind FROM c""",
)
def counter_kind(spark, sf):
    kind = fn.counter_kind(F.col("l_partkey") % 32 + 96, F.when(F.col("l_suppkey") % 2 == 0, 4).otherwise(2))
    return lines(spark, sf, kind.alias("kind"))


@check(
    "x11_severity",
    f"""WITH s AS (SELECT {KEYS}, l_quantity AS v, CASE l_suppkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'partial' END AS st FROM lineitem)
    SELECT {KEYS}, CASE WHEN coalesce(st, 'available') <> 'available' THEN 'normal' WHEN v >= 40 THEN 'danger' WHEN v >= 20 THEN 'warning' ELSE 'normal' END AS severity FROM s""",
)
def severity(spark, sf):
    status = F.when(F.col("l_suppkey") % 3 == 0, F.lit("available")).when(F.col("l_suppkey") % 3 == 1, F.lit("partial"))
    return lines(spark, sf, fn.severity(F.col("l_quantity"), status, F.lit(20.0), F.lit(40.0)).alias("severity"))


def preview_sql(text: str, size: int) -> str:
    """Longest prefix of whole characters within ``size`` UTF-8 bytes."""
    return f"CASE WHEN strlen({text}) <= {size} THEN {text} ELSE left({text}, list_max(list_filter(range({size + 1}), lambda n: strlen(left({text}, n)) <= {size}))) END"


@check(
    "x12_truncate_text",
    f"SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS cut, {preview_sql('text', 150)} AS preview FROM documents",
)
def truncate_text(spark, sf):
    text = F.col("text")
    return adapters.table(spark, sf, "documents").select(
        "doc_id", fn.truncate_text(text, 100, "...").alias("cut"), fn.preview_bytes(text, 150).alias("preview")
    )


@check(
    "x13_editor_ms",
    f"""SELECT {KEYS}, CAST(CAST(l_extendedprice * 100 AS FLOAT) * CAST(1e-6 AS FLOAT) AS DOUBLE) AS ms,
    CAST(CAST(CAST(l_orderkey * 1000003 + l_partkey AS DOUBLE) / 1e6::DOUBLE AS FLOAT) AS DOUBLE) AS start_ms FROM lineitem""",
)
def editor_ms(spark, sf):
    start = (F.col("l_orderkey") * 1000003 + F.col("l_partkey")).cast("decimal(20,0)")
    return lines(
        spark, sf, fn.editor_ms((F.col("l_extendedprice") * 100).cast("float")).alias("ms"), fn.editor_start_ms(start).alias("start_ms")
    )


@check(
    "x14_thread_role",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Job.Worker' ELSE p_name END AS role,
    '[' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',"' || CASE WHEN p_size % 3 = 0 THEN 'Job.Worker' ELSE p_name END || '",["' || p_name || '","a \\"b\\" \\\\ c"]]' AS key FROM part""",
)
def thread_role(spark, sf):
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Job.Worker "), F.col("p_size"))).otherwise(F.col("p_name"))
    group = F.when(F.col("p_size") % 2 != 0, F.col("p_brand"))
    role = fn.thread_role(name)
    return adapters.table(spark, sf, "part").select(
        "p_partkey", role.alias("role"), fn.path_key(group, role, F.array("p_name", F.lit('a "b" \\ c'))).alias("key")
    )
