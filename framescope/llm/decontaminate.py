"""Benchmark decontamination with spaced seeds.

Words are lower-case runs between ASCII white space and punctuation.  A seed is a
mask laid over a text: the words at its 1s make a hash, those at its 0s may be
anything.  Hashes of all places of the benchmark items are joined with those of
all places of every document; a document and an item that share one are a
candidate.  Candidates are compared on every shift at which a seed of one lies on
the same seed of the other, over the whole overlap, word by word: any stretch with
at least ``MIN_EQUAL`` equal words that make up ``MIN_PERCENT`` percent of it is a
leak.  All stretches are tested, so a long poor one hides no short good one.  Of a
document and an item the stretch with the most equal words is reported.

Any stretch with one substitution in five words or fewer holds a hit of the mask
1111; the others find hits across substitutions that lie closer.

Everything is a Spark job.  A bit map of ``1 << MAP_BITS`` bits, the same for a
benchmark of any size, goes to the tasks, so that hashes of documents that cannot
be in the benchmark are not moved; the others meet the benchmark's in a join.  The
benchmark's side is broadcast up to ``SENT_SEEDS`` seeds and ``SENT_BYTES`` bytes;
beyond, rows are dealt by key and a salt.  Runs of one seed are compared as runs, so
a document of one word repeated costs no more than its length.

Nulls, empty texts and texts without words have no leak; items of fewer than
``MIN_EQUAL`` words cannot leak.  Null ids are reported like any id.  Repeated
rows are reported each, also those of the benchmark.  Empty tables give no rows.
Other columns are not read.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, fresh

MASKS = ("1111", "110101", "1100101", "1001011")
MIN_EQUAL, MIN_PERCENT = 10, 75
MAP_BITS = 26
SENT_SEEDS, SENT_BYTES, SENT_KEYS = 500_000, 32 << 20, 200_000
#: Into how many parts rows of one key are dealt where a side is too large to send, and about how many items a row of candidates holds.
SALTS, ITEMS = 16, 1000
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PARTED).split()


def seeds(hashes: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of every place at which it fits."""
    parts = [hashes * odd for odd in _ODD]
    out = []
    for number, mask in enumerate(MASKS):
        count = max(0, len(hashes) - len(mask) + 1)
        total = np.full(count, number, np.uint64)
        for part, at in zip(parts, (k for k, used in enumerate(mask) if used == "1"), strict=True):
            total += part[at : at + count]
        out.append(total)
    return out


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of consecutive ones."""
    gaps = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], gaps + 1])], places[np.concatenate([gaps, [len(places) - 1]])]


def shifts(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The shifts (place in the document less place in the item) at which a seed lies on its like.

    Two runs of one seed meet at a range of shifts, which is marked by its ends.
    """
    ends = np.zeros(len(doc) + len(item) + 2, np.int64)
    for of_doc, of_item in zip(seeds(doc), seeds(item), strict=True):
        at = np.flatnonzero(np.isin(of_doc, of_item))
        at = at[np.argsort(of_doc[at], kind="stable")]
        for places in np.split(at, np.flatnonzero(np.diff(of_doc[at])) + 1) if len(at) else ():
            first, last = _runs(places)
            for a, b in zip(*_runs(np.flatnonzero(of_item == of_doc[places[0]])), strict=True):
                ends[first - b + len(item)] += 1
                ends[last - a + len(item) + 1] -= 1
    return np.flatnonzero(np.cumsum(ends) > 0) - len(item)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int] | None:
    """Begin, end and equal words of the stretch with the most, among those with ``MIN_PERCENT`` percent equal; None below ``MIN_EQUAL``."""
    if np.count_nonzero(equal) < MIN_EQUAL:
        return None
    same = np.concatenate([[0], np.cumsum(equal)])
    # a stretch has enough equal words where this does not fall from its begin to its end
    level = 100 * same - MIN_PERCENT * np.arange(len(same))
    lowest = np.minimum.accumulate(level)
    begin = np.searchsorted(-lowest, -level, "left")  # the earliest begin for each end
    last = int(np.argmax(same - same[begin]))
    n = int(same[last] - same[begin[last]])
    if n < MIN_EQUAL:
        return None
    inside = np.flatnonzero(equal[begin[last] : last]) + begin[last]
    return int(inside[0]), int(inside[-1]) + 1, n


def leak(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int] | None:
    """(first word in the document, first word in the item, words, equal words) of the best stretch of all shifts."""
    best = None
    for shift in shifts(doc, item).tolist():
        begin, end = max(0, shift), min(len(doc), shift + len(item))
        found = best_stretch(doc[begin:end] == item[begin - shift : end - shift])
        if found and (best is None or (found[2], found[0] - found[1]) > (best[3], -best[2])):
            best = (begin + found[0], begin + found[0] - shift, found[1] - found[0], found[2])
            if best[3] == len(item):
                break
    return best


def _seed_rows(texts: DataFrame, key: str, least: int, bit_map=None) -> DataFrame:
    """(``seed``, ``key``): the distinct seeds of each row's text that the bit map, if given, lets through."""
    own = texts.select(F.col(key), F.col("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known = None if bit_map is None else bit_map.value
        for batch in batches:
            at, found = [], [np.zeros(0, np.uint64)]
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = words(t) if t else ()
                if len(own) < least:
                    continue
                made = np.concatenate(seeds(hashes.of(own)))
                if known is not None:
                    bit = made >> np.uint64(64 - MAP_BITS)
                    made = made[(known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                if len(made):
                    found.append(np.unique(made))
                    at.append(np.full(len(found[-1]), k))
            chosen = batch.column(0).take(pa.array(np.concatenate(at) if at else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), chosen], ["seed", key])

    return own.mapInArrow(rows, f"seed long, {key} string")


def _bit_map(found: DataFrame) -> np.ndarray:
    """Which values the first ``MAP_BITS`` bits of the seeds take; its size does not depend on their number."""
    at = F.shiftrightunsigned("seed", 64 - MAP_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - MAP_BITS}) & 63 AS int))")
    held = found.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[held["at"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return out


def _met(many: DataFrame, few: DataFrame, key: str, small: bool, spread: str) -> DataFrame:
    """The join by ``key``: ``few`` is sent to all tasks if ``small``, else rows of a key are dealt to ``SALTS`` tasks."""
    if small:
        return many.join(F.broadcast(few), key)
    few = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt_", F.pmod(F.hash(spread), F.lit(SALTS))).join(few, [key, "salt_"]).drop("salt_")


def _candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(``text_md5``, ``items``): lists of about ``ITEMS`` items (key, text) that share a seed with the text."""
    of_items = checkpointed(_seed_rows(items, "item_md5", MIN_EQUAL))
    n_seeds, n_items = of_items.agg(F.count(F.lit(1)), F.approx_count_distinct("item_md5")).first()
    bit_map = docs.sparkSession.sparkContext.broadcast(_bit_map(of_items))
    pairs = _met(_seed_rows(docs, "text_md5", MIN_EQUAL, bit_map), of_items, "seed", n_seeds <= SENT_SEEDS, "text_md5")
    pairs = pairs.select("text_md5", "item_md5").distinct()
    part = F.pmod(F.xxhash64("item_md5"), F.lit(-(-n_items // ITEMS) or 1))
    held = _met(pairs, items, "item_md5", n_seeds <= SENT_SEEDS, "text_md5")
    return held.groupBy("text_md5", part.alias("part")).agg(F.collect_list(F.struct("item_md5", F.col("text").alias("item"))).alias("items")).drop("part")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``doc_word``, ``item_word``, ``n_words``, ``n_equal`` and ``text_md5``: one row for a document and an item in it."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    bench = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    bench = bench.withColumn("item_md5", F.md5(F.col("text").cast("binary")))
    items = bench.groupBy("item_md5").agg(F.first("text").alias("text"))
    held = checkpointed(_candidates(own, items))
    size = held.agg(F.sum(F.lit(100) + F.aggregate("items", F.lit(0), lambda n, i: n + 100 + F.octet_length(i["item"])))).first()[0] or 0
    spread = own.withColumn("spread_", F.xxhash64("doc_id", "text_md5"))
    compared = _met(spread, held, "text_md5", size <= SENT_BYTES, "spread_").select("doc_id", "text", "items", "text_md5")
    kind = own.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at, found = [], []
            for k in range(len(batch)):
                doc = hashes.of(words(batch.column(1)[k].as_py()))
                for i in batch.column(2)[k].as_py():
                    best = leak(doc, hashes.of(words(i["item"])))
                    if best:
                        at.append(k)
                        found.append((i["item_md5"], *best))
            chosen = batch.take(pa.array(at, pa.int64()))
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [chosen.column(0), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:]), chosen.column(3)],
                ["doc_id", "item_md5", "doc_word", "item_word", "n_words", "n_equal", "text_md5"],
            )

    found = compared.mapInArrow(rows, f"doc_id {kind}, item_md5 string, doc_word long, item_word long, n_words long, n_equal long, text_md5 string")
    return found.join(bench.select("item_id", "item_md5"), "item_md5").select("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal", "text_md5")


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with their own columns."""
    key, found_key = fresh(docs, "_text_md5", "_leak_md5")
    found = checkpointed(leaks(docs, benchmark, doc_id, text).select(F.col("text_md5").alias(found_key)).distinct())
    if found.count() <= SENT_KEYS:
        found = F.broadcast(found)  # else whole texts move, dealt by key
    keyed = docs.withColumn(key, F.md5(F.col(text).cast("string").cast("binary")))
    return keyed.join(found, F.col(key) == F.col(found_key), "left_anti").select(*(F.col(c) for c in docs.columns))
