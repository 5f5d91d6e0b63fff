"""Language-model scoring with an n-gram trie of Elias-Fano levels, built and queried in slices.

Tokens are the words of a text, A-Z in lower case, and one end.  The lowest level is the
contract's additive estimate, p1(w) = (c(w) + 1) / (N + V + 1).  Every higher level k
holds the k-grams of the training documents with absolute discounting and is
interpolated with the one below,

    p_k(w | h) = max(c(hw) - D, 0) / c(h) + D T(h) / c(h) * p_{k-1}(w | h'),

T(h) being the number of different successors of h; unknown contexts leave p_{k-1}.
The two parts, the first per successor and the second per context, are what the trie
stores, as 16-bit logarithms.

The corpus's n-grams grow with the corpus and so does the trie; no task and not the
driver ever holds it whole:

1. documents are cut into blocks of about ``BLOCK_TOKENS`` tokens, as numbers into the
   block's own sorted list of word hashes, written once to the shared folder;
2. words meet in slices of the hash range; every block gets its words' counts back;
3. n-grams, counted per block, are sorted by context and code and cut at quantiles of
   a sample into even slices, so a context with a third of all n-grams is spread over
   many slices.  Only large contexts are cut, fewer than there are slices or a hundred;
   they get their totals from a sum over (context, code) beforehand.  A slice's task merges its blocks'
   runs, builds its part of the level, and answers each block by searching contexts and,
   relative to each context, successors;
4. blocks meet their answers and add up logarithms per document.

Levels are read in place in one buffer: the task's own, as executors share no disk that
can be mapped; ``elias_fano.Level.opened`` takes a memory-mapped file as well.

Words are known by 64-bit hashes and contexts by 56 bits.  Among the successors of one
context the most frequent words are known by rank and others by 32 bits of their hashes:
two of n such successors are taken for one with a chance of n^2 / 2^33.  What is stored or
moved is packed by bytes of equal weight: ranks, counts and steps between sorted hashes.  Counts of words and
the base score do not depend on these codes.

Nulls: a null text is empty, one end; a null id is scored, and is trained on unless
``held_out`` says otherwise; null there counts as false.  Repeated rows count each time.
Texts are scored whole: a block is as large as its largest document.  Without training
documents every token has c = N = V = 0.  Empty tables give no rows.  Columns besides
the named ones are not read, so no name can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mixed, shared_folder
from .elias_fano import Level

ORDER = 2
DISCOUNT = 0.75
#: Tokens of a block, n-grams of a slice as counted by block, and sampled n-grams for each slice.
BLOCK_TOKENS, SLICE_ROWS, SAMPLED = 1 << 20, 1 << 20, 256
#: Words with short codes, and how many of its most frequent words a block proposes for that.
RANKED, PROPOSED = 1 << 16, 1 << 13
#: A context with this part of all n-grams, or as many as two slices, may be cut.
HOT = 0.01
#: Logarithms are kept in steps of 1 / STEPS; the last code means zero.
STEPS, ZERO = 2000, 65535
#: Contexts are known by 56 bits.
CONTEXT_BITS = np.uint64(2**64 - 256)
START, END = (np.uint64(xxhash.xxh64_intdigest(name, seed=1)) for name in (b"start", b"end"))
_ANSWER = "block long, level int, slice int, data binary"


def held_out_sevenths(doc_id: str) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# -- packed numbers


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes of equal weight side by side, compressed: upper bytes of small numbers take next to nothing."""
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return np.array([len(values)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int(np.frombuffer(data, "<i8", 1)[0]), np.dtype(kind).itemsize
    raw = pa.decompress(memoryview(data)[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, small where values rise; where they fall, modulo 2^64."""
    return np.diff(values, prepend=np.uint64(0))


def _joined(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *(len(p) for p in parts)], "<i8").tobytes() + b"".join(parts)


def _parted(data: bytes) -> list[bytes]:
    many = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * (1 + many) + np.cumsum([0, *np.frombuffer(data, "<i8", many, 8)])
    return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


# -- blocks


@dataclass(frozen=True)
class Common:
    """The most frequent words, sorted by hash, with their ranks: short codes for them."""

    words: np.ndarray
    ranks: np.ndarray

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Each word's code among the successors of a context: its rank, or 32 bits of its hash above all ranks."""
        codes = (words >> np.uint64(32)) % np.uint64((1 << 32) - RANKED) + np.uint64(RANKED)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            codes = np.where(self.words[at] == words, self.ranks[at], codes)
        return codes.astype(np.uint32)


@dataclass(frozen=True)
class Block:
    """Documents' tokens as numbers into sorted word hashes."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    trained: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        sizes = np.asarray(row["sizes"], np.int64)
        trained = np.repeat(~np.asarray(row["held_out"], bool), sizes)
        stored = np.cumsum(_unpacked(row["words"], "<u8"), dtype=np.uint64)
        order = np.argsort(stored)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(stored[order], place[_unpacked(row["tokens"], "<u4")], sizes, trained)

    def stored(self) -> tuple[np.ndarray, bytes]:
        """Words, the most frequent first, and tokens as numbers into them."""
        order = np.argsort(-np.bincount(self.tokens, minlength=len(self.words)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        return self.words[order], _packed(place[self.tokens])

    def word_counts(self) -> np.ndarray:
        """Occurrences of each word in training documents."""
        return np.bincount(self.tokens[self.trained], minlength=len(self.words))

    def contexts(self, level: int) -> np.ndarray:
        """The hash of the ``level`` - 1 words before each token."""
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        context = np.zeros(len(self.tokens), np.uint64)
        for back in range(level - 1, 0, -1):
            before = np.full(len(self.tokens), START)
            there = np.flatnonzero(place >= back)
            before[there] = self.words[self.tokens[there - back]]
            context = mixed(context * np.uint64(0x9E3779B97F4A7C15) + before)
        return context & CONTEXT_BITS

    def sampled(self, level: int, least: int, common: Common) -> np.ndarray:
        """The keys of one in ``least`` of the different ``level``-grams, chosen by hash; the others are not sorted."""
        keys = (self.contexts(level) >> np.uint64(32) << np.uint64(32)) | common.codes(self.words)[self.tokens]
        return np.unique(keys[mixed(keys) % np.uint64(least) == 0])

    def grams(self, level: int, common: Common) -> Grams:
        """Different ``level``-grams by context and code, and each token's number among them."""
        codes = common.codes(self.words)
        # words by code, so the numbers of one context's n-grams rise with their codes
        order = np.argsort(codes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        context = self.contexts(level)
        contexts, owner = np.unique(context, return_inverse=True)
        found, token_gram = np.unique(owner * len(self.words) + place[self.tokens], return_inverse=True)
        own, word = np.divmod(found, max(len(self.words), 1))
        return Grams(contexts, own, codes[order[word]], np.bincount(token_gram[self.trained], minlength=len(found)), token_gram)


@dataclass(frozen=True)
class Grams:
    """n-grams sorted by context and code: the context's number, the code, the count in training documents."""

    contexts: np.ndarray
    owner: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    token_gram: np.ndarray

    def keys(self) -> np.ndarray:
        """64 bits that rise with the order of slices."""
        return (self.contexts[self.owner] >> np.uint64(32) << np.uint64(32)) | self.codes

    def slices(self, borders: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The n-grams of each slice in the order of keys: their own order but for contexts with equal upper halves, where it is by code."""
        keys = self.keys()
        order = np.argsort(keys, kind="stable")
        bounds = [0, *np.searchsorted(keys[order], borders, "left").tolist(), len(order)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                yield k, order[a:b]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    numbers = count(TaskContext.get().partitionId() << 32)
    hashes, ids, held, texts, total = WordHashes(), [], [], [], 0

    def made() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
        sizes = np.array([len(t) for t in texts], np.int64)
        block = Block(words, tokens, sizes, np.repeat(~np.array(held, bool), sizes))
        own_words, own_tokens = block.stored()
        columns = {
            "block": pa.array([next(numbers)], pa.int64()), "doc_ids": _list(pa.concat_arrays(ids)), "held_out": _list(pa.array(held, pa.bool_())),
            "sizes": _list(pa.array(sizes, pa.int64())), "words": pa.array([_packed(_steps(own_words))], pa.binary()), "tokens": pa.array([own_tokens], pa.binary()),
            "n_words": pa.array([len(words)], pa.int64()), "top": _list(pa.array(own_words[:PROPOSED].view(np.int64), pa.int64())), "top_counts": _list(pa.array(np.bincount(tokens)[np.searchsorted(words, own_words[:PROPOSED])], pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    for batch in batches:
        for k, (text, out) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            ids.append(batch.column(0).slice(k, 1))
            held.append(bool(out))
            texts.append(np.append(hashes.of((text or "").encode("utf-8", "replace").lower().split()), END))
            total += len(texts[-1])
            if total >= most:
                yield made()
                ids, held, texts, total = [], [], [], 0
    if texts:
        yield made()


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/language-model-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(docs: DataFrame, held_out: Column, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    fields = "held_out array<boolean>, sizes array<long>, words binary, tokens binary, n_words long, top array<long>, top_counts array<long>"
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(own.schema["doc_id"].dataType)), *T.StructType.fromDDL(fields).fields])
    most = BLOCK_TOKENS
    return _stored(own.mapInArrow(lambda batches: _blocks(batches, most), schema))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["block"], Block.read(row)


_READ = ["block", "held_out", "sizes", "words", "tokens"]


def _sent(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


# -- words


def word_answers(found: DataFrame, slices: int) -> DataFrame:
    """Each block's word counts over the whole training part, by slice of the hash range; block -1: tokens and words of a slice."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _rows(batches):
            counts = block.word_counts().astype("<u4")
            ends = np.searchsorted(block.words, np.array([(k << 64) // slices for k in range(1, slices)], np.uint64))
            bounds = [0, *ends.tolist(), len(block.words)]
            sent = [(k, number, _joined([_packed(_steps(block.words[a:b])), _packed(counts[a:b])])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
            yield _sent(sent, ["slice", "block", "data"], [pa.int32(), pa.int64(), pa.binary()])

    def counted(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        data = table.column("data").to_pylist()
        parted = [_parted(d) for d in data]
        runs = [np.cumsum(_unpacked(steps, "<u8"), dtype=np.uint64) for steps, _ in parted]
        sizes = [len(r) for r in runs]
        words, counts = np.concatenate(runs), np.concatenate([_unpacked(c, "<u4") for _, c in parted])
        known, which = np.unique(words, return_inverse=True)
        totals = np.zeros(len(known), np.int64)
        np.add.at(totals, which, counts)
        answers = np.split(totals[which], np.cumsum(sizes)[:-1])
        stats = np.array([totals.sum(), (totals > 0).sum()], "<i8").tobytes()
        blocks_ = [*table.column("block").to_pylist(), -1]
        return pa.table({
            "block": pa.array(blocks_, pa.int64()), "level": pa.array([1] * len(blocks_), pa.int32()), "slice": pa.array([number] * len(blocks_), pa.int32()),
            "data": pa.array([*(_packed(a.astype("<i8")) for a in answers), stats], pa.binary()),
        })

    return found.select(*_READ).mapInArrow(parts, "slice int, block long, data binary").groupBy("slice").applyInArrow(counted, _ANSWER)


# -- n-grams


def common_words(found: DataFrame) -> Common:
    """The ``RANKED`` most frequent of the words that blocks propose; no more reach the driver."""
    proposed = found.select(F.explode(F.arrays_zip("top", "top_counts")).alias("word")).groupBy("word.top").agg(F.sum("word.top_counts").alias("many"))
    words = np.array([r["top"] for r in proposed.orderBy(F.desc("many"), "top").limit(RANKED).collect()], np.int64).view(np.uint64)
    ranks = np.argsort(words)
    return Common(words[ranks], ranks.astype(np.uint64))


def _borders(found: DataFrame, level: int, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the n-grams into slices of about ``SLICE_ROWS``, and the upper halves of contexts that may be cut.

    Other contexts stay whole: a border inside one moves to its start.  One number
    a slice, and at most one for two slices or 1 / ``HOT``, reaches the driver.
    """
    least = max(1, SLICE_ROWS // SAMPLED)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _rows(batches):
            chosen = block.sampled(level, least, common) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.view(np.int64))], names=["key"])

    sample = _stored(found.select(*_READ).mapInArrow(sampled, "key long"))
    slices = -(-sample.count() * least // SLICE_ROWS)
    if slices < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    wanted = [k / slices for k in range(1, slices)]
    head = sample.agg(F.percentile_approx("key", wanted, max(10_000, 10 * slices)), F.count(F.lit(1))).head()
    cuts = np.array(head[0] or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    many = sample.groupBy(F.shiftright("key", 32).alias("half")).agg(F.count(F.lit(1)).alias("many"))
    large = many.filter(F.col("many") >= min(head[1] * HOT, 2 * SAMPLED)).collect()
    hot = np.sort(np.array([r["half"] + (1 << 31) for r in large], np.uint64))
    inside = np.isin(cuts >> np.uint64(32), hot)
    return np.unique(np.where(inside, cuts, cuts >> np.uint64(32) << np.uint64(32))), hot


def _totals(found: DataFrame, level: int, halves: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with the given upper halves: occurrences in training and different successors."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _rows(batches):
            context = block.contexts(level)
            chosen = np.flatnonzero(block.trained & np.isin(context >> np.uint64(32), halves))
            context, code = context[chosen], common.codes(block.words)[block.tokens[chosen]].astype(np.int64)
            order = np.lexsort((code, context))
            context, code = context[order], code[order]
            begins = np.flatnonzero((np.diff(context, prepend=np.uint64(0)) != 0) | (np.diff(code, prepend=-1) != 0))
            many = np.diff(np.append(begins, len(code)))
            yield pa.RecordBatch.from_arrays([pa.array(context[begins].view(np.int64)), pa.array(code[begins]), pa.array(many)], names=["context", "code", "many"])

    rows = found.select(*_READ).mapInArrow(parts, "context long, code long, many long").groupBy("context", "code").agg(F.sum("many").alias("many"))
    totals = rows.groupBy("context").agg(F.sum("many").alias("many"), F.count(F.lit(1)).alias("kinds")).collect()  # about one row a half
    contexts = np.array([r["context"] for r in totals], np.int64).view(np.uint64)
    order = np.argsort(contexts)
    return contexts[order], np.array([r["many"] for r in totals], np.int64)[order], np.array([r["kinds"] for r in totals], np.int64)[order]


def _run(grams: Grams, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts along a run of n-grams and how many follow each."""
    owner = grams.owner[order]
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    return grams.contexts[owner[begins]], np.diff(np.append(begins, len(owner)))


def gram_answers(found: DataFrame, level: int, borders: np.ndarray, hot: np.ndarray, discount: float, common: Common) -> DataFrame:
    """For each block and slice: the stored logarithms of its n-grams and of its contexts."""
    totals = _totals(found, level, hot, common) if len(hot) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _rows(batches):
            grams = block.grams(level, common)
            sent = []
            for k, part in grams.slices(borders):
                contexts, sizes = _run(grams, part)
                data = [_packed(_steps(contexts)), _packed(sizes.astype("<u4")), _packed(grams.codes[part]), _packed(grams.counts[part].astype("<u4"))]
                sent.append((k, number, _joined(data)))
            yield _sent(sent, ["slice", "block", "data"], [pa.int32(), pa.int64(), pa.binary()])

    def answered(table: pa.Table) -> pa.Table:
        return _slice_answers(table, level, totals, discount)

    return found.select(*_READ).mapInArrow(parts, "slice int, block long, data binary").groupBy("slice").applyInArrow(answered, _ANSWER)


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, how many n-grams each has, codes and counts of one block's run."""
    steps, sizes, codes, counts = _parted(data)
    return np.cumsum(_unpacked(steps, "<u8"), dtype=np.uint64), _unpacked(sizes, "<u4").astype(np.int64), _unpacked(codes, "<u4"), _unpacked(counts, "<u4").astype(np.int64)


def _logged(values: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit logarithms."""
    with np.errstate(divide="ignore"):
        steps = np.round(-np.log10(values) * STEPS)
    return np.where(values > 0, np.minimum(steps, ZERO - 1), ZERO).astype("<u2")


def _value(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == ZERO, 0.0, 10.0 ** (codes.astype(np.float64) / -STEPS))


def trie_level(contexts: np.ndarray, codes: np.ndarray, counts: np.ndarray, totals: tuple[np.ndarray, np.ndarray, np.ndarray], discount: float) -> Level:
    """A level from n-grams with counts, in any order and with repeats; ``totals`` holds what is known of contexts that lie in several slices."""
    seen, order = contexts, np.lexsort((codes, contexts))
    contexts, codes, counts = contexts[order], codes[order], counts[order]
    begins = np.flatnonzero((np.diff(contexts, prepend=np.uint64(0)) != 0) | (np.diff(codes.astype(np.int64), prepend=-1) != 0))
    merged = np.add.reduceat(counts, begins) if len(begins) else counts
    contexts, codes, counts = (a[merged > 0] for a in (contexts[begins], codes[begins], merged))
    # a context in several slices may have no trained successor in this one
    own = np.union1d(contexts, totals[0][np.isin(totals[0], seen)])
    owner = np.searchsorted(own, contexts)
    sizes = np.bincount(owner, minlength=len(own))
    many, kinds = np.bincount(owner, weights=counts, minlength=len(own)), sizes.astype(np.float64)
    if len(totals[0]):
        at = np.minimum(np.searchsorted(totals[0], own), len(totals[0]) - 1)
        cut = totals[0][at] == own
        many, kinds = np.where(cut, totals[1][at], many), np.where(cut, totals[2][at], kinds)
    return Level.of(own, sizes, codes.astype(np.uint64), _logged(discount * kinds / many), _logged((counts - discount) / many[owner]))


def _slice_answers(table: pa.Table, level: int, totals: tuple, discount: float) -> pa.Table:
    runs = [_opened(d) for d in table.column("data").to_pylist()]
    contexts, sizes, codes, counts = (np.concatenate(c) for c in zip(*runs, strict=True))
    built = trie_level(np.repeat(contexts, sizes), codes, counts, totals, discount)
    part = Level.opened(built.image())
    numbers = part.context(contexts)
    places = part.successor(np.repeat(numbers, sizes), codes)
    of_gram = np.where(places >= 0, np.append(part.of_successor, ZERO)[places], ZERO).astype("<u2")
    of_context = np.where(numbers >= 0, np.append(part.of_context, 0)[numbers], 0).astype("<u2")
    data, a, b = [], 0, 0
    for c, _, k, _ in runs:
        data.append(_packed(np.concatenate([of_context[a : a + len(c)], of_gram[b : b + len(k)]])))
        a, b = a + len(c), b + len(k)
    many = len(runs)
    return pa.table({
        "block": table.column("block").cast(pa.int64()), "level": pa.array([level] * many, pa.int32()),
        "slice": table.column("slice").cast(pa.int32()), "data": pa.array(data, pa.binary()),
    })


# -- scores


def _scores(own: pa.Table, answers: pa.Table, tokens: int, words: int, borders: dict[int, np.ndarray], common: Common, schema: T.StructType) -> pa.Table:
    if not own.num_rows:
        return pa.table({f.name: [] for f in schema.fields})
    block = Block.read({name: own.column(name)[0].as_py() for name in _READ})
    data = {(r["level"], r["slice"]): r["data"] for r in answers.to_pylist()}
    counts = np.concatenate([_unpacked(data[key], "<i8") for key in sorted(data) if key[0] == 1])
    p1 = (counts + 1) / (tokens + words + 1)
    p = p1[block.tokens]
    for level, cuts in borders.items():
        grams = block.grams(level, common)
        first, second = np.zeros(len(grams.codes)), np.ones(len(grams.codes))
        for k, part in grams.slices(cuts):
            _, sizes = _run(grams, part)
            codes = _unpacked(data[level, k], "<u2")
            second[part] = np.repeat(_value(codes[: len(sizes)]), sizes)
            first[part] = _value(codes[len(sizes) :])
        p = first[grams.token_gram] + second[grams.token_gram] * p
    begins = np.cumsum(block.sizes) - block.sizes
    known = counts[block.tokens] > 0
    columns = [
        own.column("doc_ids").combine_chunks().flatten(), own.column("held_out").combine_chunks().flatten(), pa.array(block.sizes, pa.int64()),
        pa.array(np.add.reduceat(known.astype(np.int64), begins), pa.int64()), pa.array(np.full(len(begins), tokens, np.int64)),
        pa.array(np.add.reduceat(np.log10(p1)[block.tokens], begins)), pa.array(np.add.reduceat(np.log10(p), begins)),
    ]
    return pa.table(columns, names=schema.names)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document.

    ``held_out`` is true for documents that the model may not learn from.
    ``base_score`` is the text's log10 probability by p1, ``score`` that by level ``order``.
    """
    found = blocks(docs, held_out, doc_id, text)
    words = found.agg(F.sum("n_words")).head()[0] or 0
    by_word = _stored(word_answers(found, max(1, -(-words // SLICE_ROWS))))
    answers = by_word.filter("block >= 0")
    stats = np.sum([np.frombuffer(r["data"], "<i8") for r in by_word.filter("block < 0").select("data").toLocalIterator()] or [[0, 0]], axis=0)
    common = common_words(found) if order > 1 else Common(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    borders = {level: _borders(found, level, common) for level in range(2, order + 1)}
    for level, (cuts, hot) in borders.items():
        answers = answers.unionByName(gram_answers(found, level, cuts, hot, discount, common))
    cut = {level: cuts for level, (cuts, _) in borders.items()}
    more = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = T.StructType([T.StructField("doc_id", found.schema["doc_ids"].dataType.elementType), *T.StructType.fromDDL(more).fields])
    tokens, kinds = (int(v) for v in stats)

    def scored(own: pa.Table, given: pa.Table) -> pa.Table:
        return _scores(own, given, tokens, kinds, cut, common, schema)

    own = found.select("doc_ids", *_READ).groupBy("block")
    return own.cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
