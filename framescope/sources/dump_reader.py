"""Editor dumps read piece by piece: a row per frame while the text goes by.

A file is never held whole.  Spark's text reader cuts it at every closing bracket (so a
piece ends where a thread's sample list ends) and any number of tasks read pieces and pack
those that follow each other; packs of one file are then sorted by their place, which
spills to disk, and one task scans them with a buffer that holds one frame.  What breaks a
recording becomes violation rows; other recordings are not touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from framescope.schemas import DUMP_FRAME
from framescope.sources.json_rules import DUMP_ROOT, TWICE, Findings, check_dump_frame, decoder

CUT = "]"
VIOLATION = "frame_index BIGINT, thread_index BIGINT, sample_index BIGINT, rule STRING"
PARSED = f"capture_id STRING, unity_version STRING, frame_count BIGINT, frame_pos BIGINT, f STRUCT<{DUMP_FRAME}>, violations ARRAY<STRUCT<{VIOLATION}>>"
#: Samples of the frames sent on together.
SENT_SAMPLES = 20_000
#: Bytes of text that are packed together, and one piece more at most.
PACKED = 1 << 18
PACKS = "capture_id STRING, __file STRING, __block BIGINT, __order BIGINT, size BIGINT, packed BINARY"
#: A syntax error this far from the end of the buffer is no matter of missing text.
SLACK = 1 << 16

_SPACE = re.compile(r"[ \t\n\r]*")
_DIGITS = re.compile(r"[-+.eE0-9]*")


class _More(Exception):
    """The buffer ends before the value does."""


class _Broken(Exception):
    pass


class FrameScanner:
    """Scans one dump; ``feed`` and ``finish`` give (position, frame or None) as frames end."""

    def __init__(self) -> None:
        self._decoder = decoder()
        self.root: dict = {}
        self.findings = Findings()
        self.frames = 0
        self._text, self._wanted, self._last = "", SLACK, False
        self._held: list[str] = []
        self._held_size = 0
        self._step = self._begin
        self._over = False

    def feed(self, text: str) -> Iterator[tuple[int, dict | None]]:
        if self._over:
            return
        # pieces are short against a frame: taken one by one, each would mean one more try to decode a frame that has not ended
        self._held.append(text)
        self._held_size += len(text)
        if len(self._text) + self._held_size < self._wanted and not self._last:
            return
        self._text = "".join([self._text, *self._held])
        self._held, self._held_size = [], 0
        at = 0
        try:
            while True:
                at = _SPACE.match(self._text, at).end()
                at, frame = self._step(at)
                if frame is not None:
                    sound = check_dump_frame(frame[0], self.frames, self.findings)
                    yield self.frames, frame[0] if sound else None
                    self.frames += 1
        except _More:
            self._text = self._text[at:]
            # a value that did not end is tried again when half as much text has come, so the work stays in proportion
            self._wanted = len(self._text) + max(len(self._text) >> 1, SLACK)
        except _Broken:
            self.findings.add((), "malformed_json")
            self._over, self._text = True, ""

    def finish(self) -> Iterator[tuple[int, dict | None]]:
        self._last = True
        yield from self.feed("")
        if not self._over:
            if self._step != self._end:
                self.findings.add((), "malformed_json")
            else:
                self.findings.check(self.root, DUMP_ROOT, (), "")
                if "frames" not in self.root:
                    self.findings.add((), "missing:frames")
        self._over = True

    def _char(self, at: int) -> str:
        if at >= len(self._text):
            raise _More
        return self._text[at]

    def _value(self, at: int):
        self._char(at)
        try:
            value, end = self._decoder.raw_decode(self._text, at)
        except json.JSONDecodeError as error:
            if self._last or error.pos < len(self._text) - SLACK and "string" not in error.msg:
                raise _Broken from error
            raise _More from error
        except (ValueError, RecursionError) as error:
            raise _Broken from error
        if type(value) in (int, float) and not self._last and _DIGITS.fullmatch(self._text, end):
            raise _More  # more of the number may follow
        return value, end

    def _begin(self, at: int):
        if self._char(at) != "{":
            raise _Broken
        self._step = self._key
        return at + 1, None

    def _key(self, at: int):
        if self._char(at) == "}" and not self.root:
            self._step = self._end
            return at + 1, None
        name, at = self._value(at)
        at = _SPACE.match(self._text, at).end()
        if type(name) is not str or self._char(at) != ":":
            raise _Broken
        at = _SPACE.match(self._text, at + 1).end()
        listed = name == "frames" and self._char(at) == "["
        value, at = (True, at + 1) if listed else self._value(at)
        if name in self.root:
            self.root.setdefault(TWICE, []).append(name)
            if name == "frames":
                self.findings.add((), "duplicate_field:frames")
        if name == "frames" and not listed:
            self.findings.add((), "ill_typed:frames")
        self.root[name] = value
        self._step = self._first if listed else self._after
        return at, None

    def _after(self, at: int):
        char = self._char(at)
        if char not in ",}":
            raise _Broken
        self._step = self._key if char == "," else self._end
        return at + 1, None

    def _first(self, at: int):
        if self._char(at) == "]":
            self._step = self._after
            return at + 1, None
        return self._element(at)

    def _element(self, at: int):
        frame, at = self._value(at)
        self._step = self._between
        return at, (frame,)

    def _between(self, at: int):
        char = self._char(at)
        if char not in ",]":
            raise _Broken
        self._step = self._element if char == "," else self._after
        return at + 1, None

    def _end(self, at: int):
        if at < len(self._text):
            raise _Broken
        raise _More


def _schema() -> pa.Schema:
    """``PARSED`` for Arrow; made on the driver, where types can be parsed."""
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(PARSED).fields])


def _scan(pieces: Iterator[tuple[str | None, str]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces (recording, text) in order to frames, and one more row per recording with its root."""
    rows: list[dict] = []
    samples, current, scanner = 0, None, None

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def add(found: Iterator[tuple[int, dict | None]]) -> Iterator[pa.RecordBatch]:
        nonlocal rows, samples
        for position, frame in found:
            if frame is not None:
                rows.append({"capture_id": current, "frame_pos": position, "f": frame})
                samples += 1 + sum(len(t["samples"]) for t in frame["threads"])
                if samples >= SENT_SAMPLES:
                    yield sent()
                    rows, samples = [], 0

    def end() -> Iterator[pa.RecordBatch]:
        if scanner is None:
            return
        yield from add(scanner.finish())
        names = [f.split(" ")[0] for f in VIOLATION.split(", ")]
        root = {f.name: scanner.root.get(f.name) for f in DUMP_ROOT if f.fits(scanner.root.get(f.name))}
        rows.append({"capture_id": current, **root, "violations": [dict(zip(names, v, strict=True)) for v in scanner.findings.rows]})

    for capture, text in pieces:
        if scanner is None or capture != current:
            yield from end()
            current, scanner = capture, FrameScanner()
        yield from add(scanner.feed(text))
    yield from end()
    if rows:
        yield sent()


def read_pieces(spark: SparkSession, paths: str | list[str], capture_id) -> DataFrame:
    """Dump files as ``PARSED`` rows; ``capture_id`` makes a recording's id of a file's path, which must be its own."""
    raw = spark.read.option("lineSep", CUT).text(paths)
    pieces = raw.select(
        capture_id(F.col("_metadata.file_path")).alias("capture_id"), F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__order"), F.col("value").alias("text"),
    )
    # rows of a file come in order inside its blocks; all but a file's last piece were cut at a bracket
    packs = pieces.mapInArrow(_packed, PACKS)
    # the number is given, as packs tell little of the work that their texts are
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = packs.repartition(many, "__file").sortWithinPartitions("__file", "__block", "__order")
    schema = _schema()
    return ordered.select("capture_id", "size", "packed").mapInArrow(lambda batches: _scan(_unpacked(batches), schema), PARSED)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that follow each other in a block of a file, joined by the cuts between them and packed."""
    names = [c.split(" ")[0] for c in PACKS.split(", ")]
    codec = pa.Codec("zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        capture, file, block, order, text = batch.columns
        nth = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64) + len(CUT)) // PACKED
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, other | (nth[1:] != nth[:-1])))
        pieces = pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows), pa.int32()), text)
        plain = [t.as_buffer() for t in pc.binary_join(pieces, pa.scalar(CUT, text.type))]
        sizes, packed = pa.array([len(t) for t in plain], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in plain], pa.binary())
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in (capture, file, block, order)), sizes, packed], names=names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str]]:
    """Recording and text of one pack after the other, unpacked as they are asked for.

    A cut follows all but a recording's last one: a dump ends with a brace, so no bracket followed it.
    """
    codec, held = pa.Codec("zstd"), None
    for batch in batches:
        for capture, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None:
                yield held[0], held[1] + (CUT if capture == held[0] else "")
            held = capture, codec.decompress(packed, decompressed_size=size, asbytes=True).decode()
    if held is not None:
        yield held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str]]:
    for batch in batches:
        for capture, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield capture, text or ""


def read_texts(texts: DataFrame, column: str = "json") -> DataFrame:
    """Dump texts, one recording a row, as ``PARSED`` rows."""
    schema = _schema()
    return texts.select("capture_id", F.col(column).alias("text")).mapInArrow(lambda batches: _scan(_texts(batches), schema), PARSED)
