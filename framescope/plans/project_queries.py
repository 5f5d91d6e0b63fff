"""Registered queries: project text (S7, S8, P)."""

from pyspark.sql import functions as F

from framescope.operators import project as ops
from framescope.plans import adapters
from framescope.plans.registry import check
from framescope.plans.scalar_queries import preview_sql
from framescope.sources import project_files
from framescope.sources.tables import derived

FOLDERS = ["Assets", "Assets/Library", "Packages/.git/x", "ProjectSettings", "Assets/obj.d"]
EXTENSIONS = ["cs", "unity", "PNG", "mat", "meta", "dll", "Shader"]


@check(
    "s7_scan_text_tree",
    f"""WITH f AS (SELECT doc_id, {FOLDERS}[CAST(doc_id % 5 AS INTEGER) + 1] || '/' || source || '/f' || doc_id || '.' || {EXTENSIONS}[CAST(doc_id % 7 AS INTEGER) + 1] AS path,
      n_chars * (doc_id % 11) * 1000 AS size, doc_id % 7 AS e FROM documents WHERE doc_id % 5 NOT IN (1, 2)),
    r AS (SELECT *, CASE WHEN e IN (2, 5) THEN 'binary or not an allowed text kind' WHEN size > CASE WHEN e = 0 THEN 2097152 ELSE 67108864 END THEN 'text over the size limit' END AS reason FROM f)
    SELECT path, size, reason IS NULL AS is_text, reason FROM r""",
)
def scan_text_tree(spark, sf):
    documents = adapters.table(spark, sf, "documents")
    key = F.col("doc_id")
    path = F.concat(
        F.get(F.lit(FOLDERS), (key % 5).cast("int")), F.lit("/"), F.col("source"), F.lit("/f"), key, F.lit("."), F.get(F.lit(EXTENSIONS), (key % 7).cast("int"))
    )
    return project_files.inventory(documents.select(path.alias("path"), (F.col("n_chars") * (key % 11) * 1000).alias("size")))


def encoded_documents(spark, sf):
    """Documents as bytes: UTF-8, marked UTF-8, both UTF-16 orders, and some with a NUL or broken bytes."""
    key, text = F.col("doc_id"), F.regexp_replace("text", "\n", "\r\n")
    content = (
        F.when(key % 5 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(key % 5 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(key % 5 == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(key % 17 == 0, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00"))))
        .when(key % 19 == 0, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("C3"))))
        .otherwise(F.encode(text, "UTF-8"))
    )
    documents = adapters.table(spark, sf, "documents").select("doc_id", "text")
    return documents.select(F.concat(F.lit("doc"), key).alias("path"), content.alias("content"))


LINES = """ok AS (SELECT doc_id, 'doc' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents WHERE NOT (doc_id % 5 NOT IN (1, 2, 3) AND (doc_id % 17 = 0 OR doc_id % 19 = 0))),
  tl AS (SELECT path, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM ok),
  nl AS (SELECT path, unnest(ls) AS text, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line FROM tl)"""


def document_lines(spark, sf):
    return project_files.explode_lines(encoded_documents(spark, sf))


@check("s8_explode_lines", f"WITH {LINES} SELECT path, line, text FROM nl")
def explode_lines(spark, sf):
    return document_lines(spark, sf)


GUID = "md5('page' || ({}))"


def project_lines(spark, sf):
    """Two files per page: a serialised asset with three references, and its meta file."""

    def build():
        i = F.col("page_id")
        guid = lambda n: F.md5(F.concat(F.lit("page"), n.cast("string")))
        target = lambda k: (i * 7 + k * 13) % (i + 3) + (F.when(i % 4 == 0, 10_000_000).otherwise(0) if k == 2 else 0)
        ref = lambda k: F.concat(F.lit(f"  m_Ref{k}: {{fileID: "), target(k) + 1, F.lit(", guid: "), F.upper(guid(target(k))), F.lit(", type: 2}"))
        header = lambda n: F.concat(F.lit("--- !u!114 &"), n)
        body = F.concat(
            F.array(
                F.lit("%YAML 1.1"), header(i + 1), F.concat(F.lit("  m_Name: Page "), i), ref(0), ref(1), F.concat(F.lit("  -"), F.substring(ref(2), 2, 1000)),
                F.concat(F.lit("  m_Local: {fileID: "), i + 1, F.lit("}")), F.lit("  m_None: {fileID: 0}"),
            ),
            F.when(i % 5 == 0, F.array(header(i + 900_000), F.lit("  m_Name: Second"), F.lit("  m_Name: Third"), F.concat(F.lit("  m_Up: {fileID: "), i + 900_000, F.lit("}"))))
            .otherwise(F.array().cast("array<string>")),
            F.when(i % 17 == 0, F.array(header(i + 1))).otherwise(F.array().cast("array<string>")),
            F.when(i % 19 == 0, F.array(F.lit("--- !u!abc &x"))).otherwise(F.array().cast("array<string>")),
            F.array(F.concat(F.lit("  m_Html: "), F.regexp_replace("html", "[\r\n]+", " "))),
        )
        own = F.when((i % 23 == 0) & (i > 0), i - 1).otherwise(i)
        meta = F.array(F.lit("fileFormatVersion: 2"), F.concat(F.lit("guid: "), guid(own)))
        name = F.concat(F.lit("Assets/p"), i, F.lit(".asset"))
        files = F.array(
            F.struct(name.alias("path"), F.when(i % 29 != 0, body).alias("body")), F.struct(F.concat(name, F.lit(".meta")).alias("path"), meta.alias("body"))
        )
        pages = adapters.table(spark, sf, "pages").select(F.inline(files)).filter("body IS NOT NULL")
        folder = F.when(i % 31 == 0, F.array(F.struct(F.lit("Assets.meta").alias("path"), F.lit("guid: " + "a" * 32).alias("text")), F.struct(F.concat(F.lit("Gone"), i, F.lit(".meta")).alias("path"), F.concat(F.lit("guid: "), F.md5(F.concat(F.lit("gone"), i.cast("string")))).alias("text"))))
        metas = adapters.table(spark, sf, "pages").select(F.inline(folder)).distinct()
        rows = pages.select("path", F.posexplode("body").alias("n", "text")).unionByName(metas.select("path", F.lit(1).alias("n"), "text"))
        return rows.select("path", (F.col("n") + 1).alias("line"), "text")

    return derived(spark, sf, "project_lines", build)


PROJECT = f"""pg AS (SELECT page_id AS i, 'Assets/p' || page_id || '.asset' AS path, {GUID.format('CASE WHEN page_id % 23 = 0 AND page_id > 0 THEN page_id - 1 ELSE page_id END')} AS own FROM pages),
  gn AS (SELECT 'Gone' || page_id AS path, md5('gone' || page_id) AS guid FROM pages WHERE page_id % 31 = 0),
  gd AS (SELECT own AS guid, path FROM pg UNION ALL SELECT guid, path FROM gn UNION ALL SELECT repeat('a', 32), 'Assets' FROM gn GROUP BY 1),
  fl AS (SELECT path FROM pg WHERE i % 29 <> 0 UNION ALL SELECT path || '.meta' FROM pg UNION ALL SELECT path || '.meta' FROM gn UNION ALL SELECT 'Assets.meta' FROM gn GROUP BY 1),
  okp AS (SELECT * FROM pg WHERE i % 29 <> 0 AND i % 17 <> 0 AND i % 19 <> 0),
  ob AS (SELECT path, i + 1 AS id, 2 AS line, 'Page ' || i AS name FROM okp UNION ALL SELECT path, i + 900000, 9, 'Second' FROM okp WHERE i % 5 = 0),
  rf AS (SELECT path AS source, i + 1 AS object_id, 4 + k AS line, CASE k WHEN 2 THEN 'm_Ref2' ELSE 'm_Ref' || k END AS property, t AS tgt, {GUID.format('t')} AS guid, t + 1 AS file_id
      FROM (SELECT *, (i * 7 + k * 13) % (i + 3) + CASE WHEN k = 2 AND i % 4 = 0 THEN 10000000 ELSE 0 END AS t FROM okp, (VALUES (0), (1), (2)) v(k))
    UNION ALL SELECT path, i + 1, 7, 'm_Local', NULL, NULL, i + 1 FROM okp
    UNION ALL SELECT path, i + 900000, 12, 'm_Up', NULL, NULL, i + 900000 FROM okp WHERE i % 5 = 0)"""


@check("p1_guids", f"WITH {PROJECT} SELECT guid, path FROM gd")
def guids(spark, sf):
    return ops.guids(project_lines(spark, sf))


@check("p2_objects", f"WITH {PROJECT} SELECT path, CAST(id AS VARCHAR) AS file_id, '114' AS class_id, CAST(line AS INTEGER) AS line, name FROM ob")
def objects(spark, sf):
    return ops.objects(project_lines(spark, sf))


@check("p3_refs", f"WITH {PROJECT} SELECT source, CAST(object_id AS VARCHAR) AS object_id, CAST(line AS INTEGER) AS line, property, guid, CAST(file_id AS VARCHAR) AS file_id FROM rf")
def refs(spark, sf):
    return ops.refs(project_lines(spark, sf))


def project_file_table(spark, sf):
    paths = project_lines(spark, sf).groupBy("path").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    return project_files.inventory(paths)


WARNINGS = f"""{PROJECT}, wn AS (SELECT 'duplicate_guid' AS kind, guid AS subject, count(*) AS n FROM gd GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'orphan_meta', path, 1 FROM pg WHERE i % 29 = 0 UNION ALL SELECT 'orphan_meta', path, 1 FROM gn
  UNION ALL SELECT 'unresolved_refs', guid, count(*) FROM rf WHERE guid IS NOT NULL AND guid NOT LIKE '0000000000000000%' AND guid NOT IN (SELECT guid FROM gd) GROUP BY 2)"""


def warnings_table(spark, sf):
    lines = project_lines(spark, sf)
    return ops.index_warnings(project_file_table(spark, sf), ops.guids(lines), ops.refs(lines))


@check("p4_index_warnings", f"WITH {WARNINGS} SELECT kind, subject, n FROM wn")
def index_warnings(spark, sf):
    return warnings_table(spark, sf)


RESOLVED = f"""{PROJECT}, oc AS (SELECT guid, count(*) AS k FROM gd GROUP BY 1),
  rs AS (SELECT rf.*, CASE WHEN rf.guid IS NULL THEN source ELSE gd.path END AS target, CASE WHEN rf.guid IS NULL THEN 1 ELSE coalesce(k, 0) END AS target_count FROM rf LEFT JOIN gd ON gd.guid = rf.guid LEFT JOIN oc ON oc.guid = rf.guid),
  rv AS (SELECT rs.*, target_count = 1 AND ob.path IS NOT NULL AS object_resolved FROM rs LEFT JOIN ob ON ob.path = rs.target AND ob.id = rs.file_id)"""


def resolved(spark, sf):
    lines = project_lines(spark, sf)
    return ops.resolved_references(ops.refs(lines), ops.guids(lines), ops.objects(lines))


@check(
    "p5_references_incoming",
    f"""WITH {RESOLVED}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source, line) - 1 AS row_pos, count(*) OVER (PARTITION BY target) AS total FROM rv WHERE target IS NOT NULL)
    SELECT target AS path, source, CAST(line AS INTEGER) AS line, property, CAST(file_id AS VARCHAR) AS file_id, target_count, object_resolved, row_pos, total, CASE WHEN total > 3 THEN CAST(3 AS BIGINT) END AS next_start FROM r WHERE row_pos < 3""",
)
def references_incoming(spark, sf):
    rows = ops.references(resolved(spark, sf), "incoming", 0, 3)
    return rows.select("path", "source", "line", "property", "file_id", "target_count", "object_resolved", "row_pos", "total", "next_start")


@check(
    "p5_references_outgoing",
    f"""WITH {RESOLVED}, d AS (SELECT source, line, property, file_id, max(target_count) AS target_count, coalesce(string_agg(target, ';' ORDER BY target), '') AS targets, bool_or(object_resolved) AS object_resolved FROM rv GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line) - 1 AS row_pos, count(*) OVER (PARTITION BY source) AS total FROM d)
    SELECT source AS path, CAST(line AS INTEGER) AS line, property, CAST(file_id AS VARCHAR) AS file_id, target_count, targets, object_resolved, row_pos, total FROM r""",
)
def references_outgoing(spark, sf):
    rows = ops.references(resolved(spark, sf), "outgoing")
    targets = F.array_join("targets", ";").alias("targets")
    return rows.select("path", "line", "property", "file_id", "target_count", targets, "object_resolved", "row_pos", "total")


@check("p6_search_counts", f"WITH {LINES} SELECT path, count(*) AS hits, min(line) AS first_line FROM nl WHERE contains(text, 'the ') GROUP BY 1")
def search_counts(spark, sf):
    return ops.search_counts(document_lines(spark, sf), "the ")


@check(
    "p6_search_page",
    f"WITH {LINES}, h AS (SELECT * FROM nl WHERE contains(text, 'the ') ORDER BY path, line LIMIT 50 OFFSET 20) SELECT path, line, {preview_sql('text', 1500)} AS text, strlen(text) > 1500 AS line_truncated FROM h",
)
def search_page(spark, sf):
    return ops.search(document_lines(spark, sf), "the ", start=20, limit=50)


@check(
    "p7_read_lines",
    f"""WITH {LINES}, m AS (SELECT path, max(line) AS mx FROM nl GROUP BY 1), w AS (SELECT nl.*, CASE WHEN mx >= 6 THEN CAST(6 AS INTEGER) END AS next_line FROM nl JOIN m USING (path) WHERE line BETWEEN 2 AND 5)
    SELECT path, line, {preview_sql('text', 2000)} AS text, strlen(text) > 2000 AS line_truncated, next_line FROM w""",
)
def read_lines(spark, sf):
    return ops.read_lines(document_lines(spark, sf), start_line=2, limit=4)


@check(
    "p8_asset",
    f"""WITH {PROJECT}, c AS (SELECT path, string_agg(guid, ',' ORDER BY guid) AS guid_candidates FROM gd GROUP BY 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS row_pos, count(*) OVER (PARTITION BY path) AS total FROM ob)
    SELECT fl.path, guid_candidates, CAST(o.id AS VARCHAR) AS file_id, o.name, row_pos, total, CASE WHEN total > 1 THEN CAST(1 AS BIGINT) END AS next_start
    FROM fl LEFT JOIN c ON c.path = fl.path LEFT JOIN o ON o.path = fl.path AND row_pos < 1""",
)
def asset(spark, sf):
    lines = project_lines(spark, sf)
    rows = ops.asset(project_file_table(spark, sf), ops.objects(lines), ops.guids(lines), 0, 1)
    return rows.select("path", F.array_join("guid_candidates", ",").alias("guid_candidates"), "file_id", "name", "row_pos", "total", "next_start")


@check(
    "p9_project_summary",
    f"""WITH {WARNINGS}, t AS (SELECT kind || ' ' || subject || ' ' || n AS w FROM wn)
    SELECT (SELECT count(*) FROM fl) AS file_count, (SELECT count(*) FROM fl) AS text_files, CAST(0 AS BIGINT) AS skipped_files, (SELECT count(*) FROM ob) AS object_count,
      (SELECT count(*) FROM rf) AS reference_count, (SELECT count(*) FROM wn) AS warning_count, (SELECT string_agg(w, ';' ORDER BY w) FROM (SELECT w FROM t ORDER BY w LIMIT 12)) AS warnings,
      (SELECT count(*) > 12 FROM wn) AS warnings_truncated""",
)
def project_summary(spark, sf):
    lines = project_lines(spark, sf)
    rows = ops.project_summary(project_file_table(spark, sf), ops.objects(lines), ops.refs(lines), warnings_table(spark, sf))
    return rows.withColumn("warnings", F.array_join("warnings", ";"))


@check("p9_files_page", f"WITH {PROJECT} SELECT path, (SELECT count(*) FROM fl) AS total FROM (SELECT path FROM fl ORDER BY path LIMIT 40 OFFSET 10)")
def files_page(spark, sf):
    return ops.files_page(project_file_table(spark, sf), 10, 40).select("path", "total")
