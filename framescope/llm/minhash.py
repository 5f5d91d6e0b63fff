"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

*Sets.*  Words are runs of characters other than space and U+0009-U+000D, with A-Z
in lower case.  A document's set are its distinct runs of five words; with fewer
words, the whole sequence; without words (null, empty or blank text) the set is
empty and linked with nothing.  Documents link when 100 * intersection >= least *
union; ``least`` is 85 for the query op4 and 80 for the stage of the pipeline.  Documents with equal sets are one *node* (named by a 128-bit fingerprint
of the set); everything below works on nodes, so copies never meet each other.

*Signatures.*  One hash of a shingle gives its bin (upper bits) and its rank in
the bin.  The least rank of each bin is its value; an empty bin takes the value
of the first bin with a value along its own random sequence of bins (optimal
densification).  Bands of ``ROWS`` values are the buckets: a pair at the
threshold shares none of ``BANDS`` buckets with a chance of about 2e-8 (3e-6 at 80).

*Candidates.*  In a bucket every node is tested with the bucket's centre only, so
there are fewer pairs than bucket entries.  Tests compare whole sets.  Links give
components.  A link between two nodes that both miss their centres would be lost,
so the rest is handled exactly: where the other nodes of a bucket lie in two or
more components, they are compared in blocks, many tasks for a large bucket, and
only links that connect components are emitted.  Nothing is capped, no group
comes to one task, and pairs are not rows; but the comparing itself grows with
the square of such a bucket.

Nulls: a null id takes part, and is above all others as a component's name.
Repeated rows get equal rows.  Empty tables give no rows.  Other columns are not
read.  A text is hashed whole, in one task, a set is as large as its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, fresh, mixed, shingle_hashes
from .components import components

SHINGLE = 5
#: Links have 100 * intersection >= least * union; this is the default of ``least``.
LEAST = 85
BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
#: Nodes of an open bucket that are compared at a time, and shingles of a matrix.
BLOCK, COLUMNS = 512, 4096


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), SHINGLE))


@lru_cache(maxsize=1)
def _walks() -> np.ndarray:
    """For each bin the bins it asks for a value when empty, one after the other (the last ones in turn, so one is found)."""
    steps = np.arange(4 * BINS, dtype=np.uint64)[None, :] + np.arange(1, BINS + 1, dtype=np.uint64)[:, None] * np.uint64(1 << 32)
    random = (mixed(steps) % np.uint64(BINS)).astype(np.int64)
    return np.concatenate([random, np.tile(np.arange(BINS), (BINS, 1))], axis=1)


@lru_cache(maxsize=1)
def _bin_starts() -> np.ndarray:
    return np.array([(k << 64) // BINS for k in range(BINS)], np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, not empty set."""
    starts = _bin_starts()
    first = np.searchsorted(found, starts)
    full = np.diff(np.append(first, len(found))) > 0
    values = found[np.minimum(first, len(found) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        walks = _walks()[empty]
        source = walks[np.arange(len(empty)), np.argmax(full[walks], axis=1)]
        values[empty] = values[source]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket key for each band; the band is part of the key."""
    rows = values.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = mixed(total ^ rows[:, k])
    return total.view(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` (null for empty sets), ``keys`` (one for each band) and ``text_md5`` of every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    own = own.withColumn("text_md5", F.md5("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text or b"", hashes)
                sizes.append(len(found))
                nodes.append(hashlib.blake2b(found, digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "n_shingles", "node", "keys", "text_md5"])

    return own.mapInArrow(rows, f"doc_id {kind}, n_shingles long, node binary, keys array<long>, text_md5 string")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``node`` and ``shingles`` (sorted 64-bit hashes as bytes) of the nodes of ``wanted`` (``node``, ``first_id``)."""
    own = docs.select(F.col(doc_id).alias("id_"), F.col(text).cast("string").cast("binary").alias("text"))
    own = own.join(wanted, F.col("id_").eqNullSafe(F.col("first_id"))).select("node", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(text or b"", hashes) for text in batch.column(1).to_pylist()]
            # an id can stand for several texts: only the node's own counts
            own = pa.array([bool(len(s)) and hashlib.blake2b(s, digest_size=16).digest() == n for s, n in zip(found, batch.column(0).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(own), pa.array([s.tobytes() for s in found], pa.binary()).filter(own)], ["node", "shingles"])

    return own.mapInArrow(rows, "node binary, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the (``a``, ``b``) pairs of nodes whose whole sets reach the threshold."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) >= least * max(len(a), len(b)):
                    joined = np.concatenate([a, b])
                    joined.sort(kind="stable")  # two sorted runs: one merge
                    shared = int(np.count_nonzero(joined[1:] == joined[:-1]))
                    passed[k] = 100 * shared >= least * (len(joined) - shared)
            chosen = pa.array(passed)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], ["a", "b"])

    return both.mapInArrow(rows, "a binary, b binary")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket entries with their node's ``label``; a node without a link is its own."""
    return entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(entries: DataFrame) -> DataFrame:
    """The labelled entries of buckets that hold two or more components."""
    buckets = entries.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    return entries.join(buckets, "bucket")


def _rest_linked(entries: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links (``a``, ``b``) among the nodes of the same bucket of labelled entries that join different labels.

    A bucket of n nodes is cut into blocks of about ``BLOCK`` nodes, and every two
    blocks (and each block with itself) are compared in a task of their own, all
    intersections of two blocks as one product of their incidence matrices.  Only
    links that connect what was apart are emitted, fewer than two blocks have nodes.
    """
    sized = entries.join(entries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "label", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    whole = dealt.join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes = np.array(table["node"].to_pylist(), object)
        labels = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        lengths = np.array([len(f) for f in found], np.int64)
        left, right = (np.flatnonzero(np.asarray(table[c])) for c in ("left", "right"))
        a, b = _spread(found, left), _spread(found, right)
        common = np.intersect1d(a[0], b[0])
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(common), COLUMNS):
            part = common[at : at + COLUMNS]
            shared += _incidence(a, len(left), part) @ _incidence(b, len(right), part).T
        union = lengths[left][:, None] + lengths[right][None, :] - shared
        near = (100 * shared >= least * union) & (labels[left][:, None] != labels[right][None, :])
        parent = list(range(labels.max() + 1 if len(labels) else 0))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: tuple[list, list] = ([], [])
        for x, y in np.argwhere(near).tolist():
            x, y = left[x], right[y]
            p, q = root(labels[x]), root(labels[y])
            if p != q:
                parent[p] = q
                out[0].append(nodes[x])
                out[1].append(nodes[y])
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])

    return whole.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def _spread(sets: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the chosen sets in a row, and the place of each one's set."""
    if not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([sets[k] for k in chosen]), np.repeat(np.arange(len(chosen)), [len(sets[k]) for k in chosen])


def _incidence(spread: tuple[np.ndarray, np.ndarray], rows: int, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, len(columns)), np.float32)
    at = np.searchsorted(columns, spread[0])
    hit = at < len(columns)
    hit[hit] = columns[at[hit]] == spread[0][hit]
    out[spread[1][hit], at[hit]] = 1
    return out


def links(docs: DataFrame, signed: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Tested links (``a``, ``b``) between nodes that connect all nodes that the links of the whole table connect.

    ``signed`` is what ``signatures`` returned for ``docs``, persisted.
    """
    rows = signed.filter(F.col("node").isNotNull())
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"))
    entries = nodes.select("node", F.explode("keys").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre != last").drop("last")
    starred = checkpointed(entries.join(buckets, "bucket"))
    pairs = starred.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    wanted = starred.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    sets = checkpointed(_sets(docs, wanted, doc_id, text))
    found = checkpointed(_linked(pairs, sets, least).distinct())
    # a centre's pairs are all tested: what the others have with each other is open
    rest = _open(_labelled(starred.filter("node != centre").select("bucket", "node"), components(found)))
    return found.union(_rest_linked(rest, sets, least))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable), ``kept`` and ``text_md5``."""
    signed = signatures(docs, doc_id, text).persist()
    labels = components(links(docs, signed, doc_id, text, least))
    placed = _labelled(signed.drop("keys"), labels)
    first = placed.filter(F.col("node").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(first, "label", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_md5")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their own columns.

    Rows of the same id and text are one document and stay once.
    """
    key, key_id, key_text = fresh(docs, "_text_md5", "_kept_id", "_kept_md5")
    found = near_duplicates(docs, doc_id, text, least).filter("kept").select(F.col("doc_id").alias(key_id), F.col("text_md5").alias(key_text)).distinct()
    keyed = docs.withColumn(key, F.md5(F.col(text).cast("string").cast("binary")))
    stays = keyed.join(found, F.col(doc_id).eqNullSafe(F.col(key_id)) & F.col(key).eqNullSafe(F.col(key_text)), "left_semi")
    return stays.dropDuplicates([doc_id, key]).select(*(F.col(c) for c in docs.columns))
