"""Index over project text: ids of assets, objects, references, search and reading.

Works on numbered lines (path, line, text); see ``sources.project_files``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.scalars import preview_bytes
from framescope.functions.windows import global_page, running
from framescope.operators.ranking import check_page, paged
from framescope.operators.validate import union_all

BUILTIN_PREFIX = "0" * 16
INT64 = (-(2**63), 2**63 - 1)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def guids(lines: DataFrame) -> DataFrame:
    """Owner path of every asset id declared in a ``.meta`` file (the last one counts)."""
    value = F.lower(_trim(F.substring("text", 6, 2**31 - 1)))
    found = lines.filter(F.col("path").endswith(".meta") & F.col("text").startswith("guid:")).select(
        "path", "line", value.alias("guid")
    ).filter(F.col("guid").rlike("^[0-9a-f]{32}$"))
    last = found.groupBy("path").agg(F.max_by("guid", "line").alias("guid"))
    return last.select("guid", F.regexp_replace("path", r"(\.meta)+$", "").alias("path"))


def _is_integer(text: Column, low: int, high: int) -> Column:
    number = text.try_cast("decimal(38,0)")
    return F.coalesce(text.rlike("^[+-]?[0-9]+$") & number.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), F.lit(False))


def object_headers(lines: DataFrame) -> DataFrame:
    """Headers ``--- !u!<class> &<id>`` with ``problem`` where one is malformed."""
    trimmed = _trim(F.col("text"))
    found = lines.filter(trimmed.startswith("--- !u!")).withColumn(
        "parts", F.filter(F.split(F.substring(trimmed, 8, 2**31 - 1), r"\s+"), lambda p: p != "")
    )
    file_id = F.regexp_replace(F.get("parts", F.lit(1)), "^&+", "")
    class_id = F.get("parts", F.lit(0))
    problem = F.when(F.size("parts") < 2, F.lit("incomplete header")).when(
        ~(_is_integer(file_id, *INT64) & _is_integer(class_id, 0, 2**32 - 1)), F.lit("malformed header")
    )
    return found.select("path", "line", class_id.alias("class_id"), file_id.alias("file_id"), problem.alias("problem"))


def bad_files(headers: DataFrame) -> DataFrame:
    """Files with a malformed header or an object id that occurs twice."""
    malformed = headers.filter(F.col("problem").isNotNull()).select("path", "problem")
    repeated = headers.filter(F.col("problem").isNull()).groupBy("path", "file_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = malformed.unionByName(repeated.select("path", F.lit("duplicate object id").alias("problem")))
    return both.groupBy("path").agg(F.min("problem").alias("problem"))


def with_current_object(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Marked lines with the object they belong to: the last header at or above them."""
    good = headers.filter(F.col("problem").isNull()).select("path", "line", "file_id", "class_id")
    joined = lines.join(good, ["path", "line"], "left")
    # The last header so far is the largest header line: a running maximum.
    # The lines of a file were one row before they were parted.
    own = F.when(F.col("file_id").isNotNull(), F.struct("line", "file_id"))
    placed = running(joined, ["path"], ["line"], {"above": ("max", own)}, bounded=True)
    return placed.withColumn("object_id", F.coalesce("file_id", F.col("above.file_id"))).withColumn(
        "object_line", F.when(F.col("file_id").isNotNull(), F.col("line")).otherwise(F.col("above.line"))
    ).drop("above")


def relevant_lines(lines: DataFrame) -> DataFrame:
    """Only headers, names and inline maps matter; everything else is filtered out early."""
    text = F.col("text")
    return lines.filter(text.contains("--- !u!") | text.contains("m_Name:") | (text.contains("{") & text.contains(":")))


def objects(lines: DataFrame) -> DataFrame:
    """Objects of every file with their name; a file with a bad header has none."""
    kept = relevant_lines(lines)
    headers = object_headers(kept)
    placed = with_current_object(kept, headers)
    trimmed = _trim(F.col("text"))
    name = F.when(trimmed.startswith("m_Name:"), F.left(_trim(F.substring(trimmed, 8, 2**31 - 1)), F.lit(256)))
    named = placed.withColumn("found_name", name).filter(F.col("object_line").isNotNull())
    names = named.filter(F.col("found_name").isNotNull()).groupBy("path", "object_line").agg(F.min_by("found_name", "line").alias("name"))
    good = headers.filter(F.col("problem").isNull()).join(bad_files(headers), "path", "left_anti")
    return good.join(names.withColumnRenamed("object_line", "line"), ["path", "line"], "left").select("path", "file_id", "class_id", "line", "name")


def refs(lines: DataFrame) -> DataFrame:
    """References ``property: {fileID: n, guid: g}`` with the object they stand in; id 0 is none."""
    kept = relevant_lines(lines)
    headers = object_headers(kept)
    placed = with_current_object(kept, headers)
    trimmed = _trim(F.col("text"))
    colon = F.instr(trimmed, ":")
    body = _trim(F.substring(trimmed, colon + 1, F.lit(2**31 - 1)))
    inline = (colon > 0) & body.startswith("{") & body.endswith("}")
    fields = F.transform(
        F.split(F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0))), ","),
        lambda f: F.struct(
            _trim(F.regexp_extract(f, r"(?s)^([^:]*):", 1)).alias("k"), _trim(F.regexp_extract(f, r"(?s)^[^:]*:(.*)$", 1)).alias("v")
        ),
    )

    def last_value(key: str, valid) -> Column:
        values = F.filter("fields", lambda f: (f["k"] == key) & valid(f["v"]))
        return F.get(values, F.size(values) - 1)["v"]

    found = placed.filter(inline).withColumns({"fields": fields, "property": F.substring(trimmed, F.lit(1), colon - 1)})
    valued = found.withColumns(
        {
            "file_id": last_value("fileID", lambda v: _is_integer(v, *INT64)),
            "guid": F.lower(last_value("guid", lambda v: v.rlike("^[0-9A-Fa-f]{32}$"))),
        }
    ).filter(F.col("file_id").isNotNull() & (F.col("file_id") != "0"))
    return valued.join(bad_files(headers), "path", "left_anti").select(
        F.col("path").alias("source"), "object_id", "line",
        F.left(F.regexp_replace("property", "^(- )+", ""), F.lit(256)).alias("property"), "guid", "file_id",
    )


def is_builtin(guid: Column) -> Column:
    return guid.startswith(BUILTIN_PREFIX)


def index_warnings(files: DataFrame, guid_rows: DataFrame, ref_rows: DataFrame) -> DataFrame:
    """Repeated asset ids, ids without their file or folder, and references to unknown ids.

    Folders are those on the way to a file; their ``.meta`` files are no orphans.
    """
    repeated = guid_rows.groupBy("guid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("duplicate_guid").alias("kind"), F.col("guid").alias("subject"), "n"
    )
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = files.filter(F.col("path").contains("/")).select(F.explode(folders).alias("path"))
    there = files.select("path").union(inside).distinct()
    orphans = guid_rows.select("path").join(there, "path", "left_anti").select(
        F.lit("orphan_meta").alias("kind"), F.col("path").alias("subject"), F.lit(1).cast("bigint").alias("n")
    )
    known = guid_rows.select("guid").distinct()
    missing = (
        ref_rows.filter(F.col("guid").isNotNull() & ~is_builtin(F.col("guid")))
        .join(known, "guid", "left_anti")
        .groupBy(F.lit("unresolved_refs").alias("kind"), F.col("guid").alias("subject"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return union_all([repeated, orphans, missing])




def resolved_references(ref_rows: DataFrame, guid_rows: DataFrame, object_rows: DataFrame) -> DataFrame:
    """P5: every reference with each of its target paths; one row per target.

    A reference without asset id points into its own file.  ``object_resolved``
    holds only with exactly one target that has the object.  References to an
    unknown id keep one row with NULL target.
    """
    owners = guid_rows.groupBy("guid").agg(F.count(F.lit(1)).alias("owner_count"))
    outward = ref_rows.filter(F.col("guid").isNotNull())
    counted = outward.join(owners, "guid", "left").join(guid_rows.withColumnRenamed("path", "target"), "guid", "left")
    local = ref_rows.filter(F.col("guid").isNull()).withColumns({"owner_count": F.lit(1).cast("bigint"), "target": F.col("source")})
    both = counted.unionByName(local).withColumn("target_count", F.coalesce("owner_count", F.lit(0))).drop("owner_count")
    has_object = object_rows.select(F.col("path").alias("target"), "file_id", F.lit(True).alias("present")).distinct()
    joined = both.join(has_object, ["target", "file_id"], "left")
    resolved = (F.col("target_count") == 1) & F.coalesce("present", F.lit(False))
    return joined.withColumn("object_resolved", resolved).drop("present")


def references(resolved: DataFrame, direction: str, start: int = 0, limit: int = 100) -> DataFrame:
    """P5: a page of references per file, going out of it or coming in to it."""
    check_page(start, limit, 100)
    if direction not in ("incoming", "outgoing"):
        raise ValueError("direction must be incoming or outgoing")
    if direction == "outgoing":
        # one row a reference, with all its targets
        whole = [c for c in resolved.columns if c not in ("target", "object_resolved")]
        one_each = resolved.groupBy(*whole).agg(
            F.array_sort(F.collect_set("target")).alias("targets"), F.max("object_resolved").alias("object_resolved")
        ).withColumn("path", F.col("source"))
    else:
        one_each = resolved.filter(F.col("target").isNotNull()).withColumn("path", F.col("target"))
    return paged(one_each, ["path"], ["source", "line", "property", "file_id"], start, limit)


def search(lines: DataFrame, query: str, start: int = 0, limit: int = 100) -> DataFrame:
    """Lines that contain the literal, case-sensitive, by path and line."""
    if not 1 <= len(query.encode()) <= 256:
        raise ValueError("query needs 1..256 bytes")
    check_page(start, limit, 100)
    hits = lines.filter(F.col("text").contains(query))
    return global_page(hits.select("path", "line", "text"), ["path", "line"], start, limit).select(
        "path", "line", preview_bytes(F.col("text"), 1500).alias("text"), (F.octet_length("text") > 1500).alias("line_truncated")
    )


def search_counts(lines: DataFrame, query: str) -> DataFrame:
    """Hits per file over the whole index."""
    return lines.filter(F.col("text").contains(query)).groupBy("path").agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first_line"))


def read_lines(lines: DataFrame, start_line: int = 1, limit: int = 100) -> DataFrame:
    """Lines ``start_line ..`` of each file in the input, with the next line number."""
    if start_line < 1 or not 1 <= limit <= 400:
        raise ValueError("lines start at 1 and limit must be in 1..400")
    stop = start_line + limit
    # A page and the line after it are few rows a file, cut before they move; the lines are made only once.
    wanted = lines.filter(F.col("path").isNotNull() & (F.col("line") >= start_line) & (F.col("line") < stop + 1)).select(
        "path", "line", preview_bytes(F.col("text"), 2000).alias("text"), (F.octet_length("text") > 2000).alias("line_truncated")
    )
    following = F.max(F.when(F.col("line") == stop, F.col("line"))).over(Window.partitionBy("path"))
    return wanted.withColumn("next_line", following).filter(F.col("line") < stop)


def asset(files: DataFrame, object_rows: DataFrame, guid_rows: DataFrame, start: int = 0, limit: int = 20) -> DataFrame:
    """Each file with its id candidates and a page of its objects."""
    check_page(start, limit, 100)
    candidates = guid_rows.groupBy("path").agg(F.array_sort(F.collect_set("guid")).alias("guid_candidates"))
    shown = paged(object_rows, ["path"], ["line"], start, limit)
    return files.join(candidates, "path", "left").join(shown, "path", "left")


MAX_WARNINGS, WARNING_BYTES = 12, 600


def project_summary(files: DataFrame, object_rows: DataFrame, ref_rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row of counts, and the first twelve warnings cut to 600 bytes."""
    text = F.concat_ws(" ", "kind", "subject", "n")
    first = warnings.select(text.alias("w")).orderBy("w").limit(MAX_WARNINGS)
    listed = first.agg(F.array_sort(F.collect_list(preview_bytes(F.col("w"), WARNING_BYTES))).alias("warnings"))
    counts = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if("is_text").alias("text_files"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped_files"),
    )
    one_row = [object_rows.agg(F.count(F.lit(1)).alias("object_count")), ref_rows.agg(F.count(F.lit(1)).alias("reference_count")),
               warnings.agg(F.count(F.lit(1)).alias("warning_count")), listed]
    out = counts.select("*", *[df.scalar().alias(df.columns[0]) for df in one_row])
    return out.withColumn("warnings_truncated", F.col("warning_count") > MAX_WARNINGS)


def files_page(files: DataFrame, start: int = 0, limit: int = 100) -> DataFrame:
    """Files of the project by path, with the total in ``total``."""
    check_page(start, limit, 100)
    total = files.agg(F.count(F.lit(1)).alias("total")).scalar()
    return global_page(files, ["path"], start, limit).withColumn("total", total)


