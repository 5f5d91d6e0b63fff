"""Project text files: inventory, decoding and numbered lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File kinds read as text and folders never read (fixed values).
TEXT_EXTENSIONS = [
    "cs", "shader", "hlsl", "cginc", "compute", "unity", "prefab", "mat", "asset", "meta", "json", "asmdef", "asmref",
    "txt", "controller", "overridecontroller", "anim", "rendertexture", "shadervariants", "shadergraph", "shadersubgraph",
]
SKIPPED_FOLDERS = [".git", "library", "temp", "obj", "logs", "build", "builds", "bin", "node_modules"]
CODE_BYTES, TEXT_BYTES = 2 * 1024 * 1024, 64 * 1024 * 1024
#: Of a line: bytes in UTF-8 files, bytes of 16-bit units in UTF-16 files.
MAX_LINE_BYTES = 1024 * 1024
UTF8_MARK, WIDE_MARKS = b"\xef\xbb\xbf", {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
NOT_TEXT = "not UTF-8 or marked UTF-16 text"
#: Bytes of files decoded and sent on together.
SENT_BYTES = 16 * 1024 * 1024


def extension(path: Column) -> Column:
    """Lower-case extension of the file name; a leading dot alone is no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def size_limit(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".cs"), CODE_BYTES).otherwise(TEXT_BYTES)


def inventory(files: DataFrame) -> DataFrame:
    """Which of the files (path, size) are text to read, and why the others are not."""
    folders = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    parents = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    kept = files.filter(~F.arrays_overlap(parents, F.lit(SKIPPED_FOLDERS)))
    is_text = extension(F.col("path")).isin(TEXT_EXTENSIONS)
    too_large = F.col("size") > size_limit(F.col("path"))
    reason = F.when(~is_text, F.lit("binary or not an allowed text kind")).when(too_large, F.lit("text over the size limit"))
    return kept.withColumns({"is_text": is_text & ~too_large, "reason": reason})


def scan_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of a folder tree with paths relative to it; contents are not read."""
    base = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(base) + "/", "")
    return inventory(listed.select(relative.alias("path"), F.col("length").alias("size"), F.col("path").alias("location")))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _any_case(word: str) -> str:
    """A file name pattern for ``word`` in upper or lower case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def read_text_files(spark: SparkSession, root: str) -> DataFrame:
    """Contents of the text files (S7) of a folder tree: path relative to it, size and bytes.

    Names and sizes are decided before a file is opened: by a name pattern and by a
    filter on the length that the scan takes.  Files in skipped folders go after it.
    """
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(base) + "/", "")

    def named(extensions: list[str], most: int) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(_any_case(e) for e in extensions) + "}")
        found = reader.load(base).filter(F.col("length") <= most)
        return found.select(relative.alias("path"), F.col("length").alias("size"), "content")

    others = [e for e in TEXT_EXTENSIONS if e != "cs"]
    files = named(["cs"], CODE_BYTES).unionByName(named(others, TEXT_BYTES))
    return inventory(files).filter("is_text").select("path", "size", "content")


def decode_text(content: bytes | None) -> tuple[str | None, str | None]:
    """Text of UTF-8 or byte-order-marked UTF-16 bytes, or why it is none to read."""
    if content is None:
        return None, NOT_TEXT
    wide = WIDE_MARKS.get(content[:2])
    raw = content[2 if wide else 3 if content.startswith(UTF8_MARK) else 0 :]
    try:
        text = raw.decode(wide or "utf-8")
    except UnicodeDecodeError:
        return None, NOT_TEXT
    if "\0" in text:
        return None, "binary content"
    # a text with no more bytes than a line may have has no longer line
    if len(raw) > MAX_LINE_BYTES and max(len(line.encode(wide or "utf-8")) for line in text.split("\n")) > MAX_LINE_BYTES:
        return None, "line over the size limit"
    return text, None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "content"]
        contents = batch.column("content")
        begin = 0
        while begin < batch.num_rows:
            found, size, end = [], 0, begin
            while end < batch.num_rows and size < SENT_BYTES:
                content = contents[end].as_py()
                found.append(decode_text(content))
                size += len(content or b"")
                end += 1
            made = [pa.array(column, pa.string()) for column in zip(*found, strict=True)]
            part = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *made], names=[*kept, "text", "reason"])
            begin = end


def with_text(files: DataFrame) -> DataFrame:
    """Decoded ``text`` of each file, or ``reason`` why it is not text.

    A file is decoded once, in one pass over its bytes; as an expression the decoding
    would be repeated wherever text and reason are used.
    """
    fields = [f for f in files.schema.fields if f.name != "content"]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])
    return files.mapInArrow(_decoded, schema)


def explode_lines(files: DataFrame) -> DataFrame:
    """Numbered lines (from 1) of the readable files, without their line ends."""
    texts = with_text(files).filter(F.col("reason").isNull())
    pieces = F.col("__pieces")
    # Text that ends in a line end has no further, empty line.
    last = F.size(pieces)
    lines = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, last - 1)).otherwise(pieces)
    kept = [c for c in texts.columns if c not in ("text", "reason")]
    parted = texts.select(*kept, F.split("text", "\n").alias("__pieces"))
    rows = parted.select(*kept, F.posexplode(lines).alias("n", "line_text"))
    return rows.select(*kept, (F.col("n") + 1).alias("line"), F.rtrim("line_text", F.lit("\r")).alias("text"))
