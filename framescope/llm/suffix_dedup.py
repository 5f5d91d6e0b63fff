"""Exact removal of repeated byte strings, by suffix arrays over what may repeat.

Every text is UTF-8 bytes; a byte goes when a string of ``LENGTH`` bytes that
covers it also starts anywhere else, in the same text or in another.

*Seeds.*  A window is a string of LENGTH bytes.  Its seed is its ``GRAM``-byte
string with the least hash (the rightmost of equals), so equal windows have equal
seeds at equal places.  Windows in a row with the same seed make one *context*:
the bytes they cover.  Every window belongs to one context.  Only contexts whose
seed occurs again can hold a repeated window, and contexts that occur twice as
they are hold nothing else; what is left are different contexts with equal seeds.

*Suffix arrays.*  These contexts meet by seed.  A task joins many seeds' contexts
to one string of symbols, each context ended by a symbol of its own; the bytes
that all windows of a seed share become one symbol.  The string's suffixes are
grouped by Lyndon prefix: groups are taken in descending order, and each moves the
suffixes that its members' previous-smaller pointers lead to into groups of their
own; then, from the least suffix on, every suffix puts the one before it, and what
that one's pointers lead to, at the next free place of its group.  Both passes are
linear and nothing is renamed or sorted again.  A window repeats exactly when a
neighbour in the suffix array begins with it.

Seeds with more than ``MOST`` contexts are not brought to one task: each of their
windows goes by itself, named by its place and 128 bits of a hash, and contexts are
counted for each name, in parts first.  No text of such a window is moved, and
however many contexts hold a window, a task meets about ``MOST`` of them at a time.

Texts are named by 79 bits of hashes.  Null texts are empty; texts shorter than
LENGTH keep all.  Equal texts remove each other entirely.  Repeated rows get equal
results; null ids are ordinary.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, even_slices

LENGTH, GRAM = 200, 64
PLACES = LENGTH - GRAM + 1
#: Contexts of a seed that one task takes; symbols of one suffix array.
MOST, BLOCK = 2048, 60_000
#: Bytes of texts handled at a time.
SLICE = 2_000_000
_BYTES = np.random.Generator(np.random.Philox(key=64)).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on, by doubling."""
    h, size = _BYTES[data], 1
    for step in _STEPS:
        h = h[:-size] * step + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    padded = np.concatenate([values, np.full(-len(values) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    to_right = np.minimum.accumulate(padded, axis=1).ravel()
    to_left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_left[: len(values) - width + 1], to_right[width - 1 : len(values)])


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, seed place, first and last window of each context of a text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    h = gram_hashes(np.frombuffer(data, np.uint8))
    # hash first, then the later place
    keyed = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    least = _sliding_least(keyed, PLACES)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = (_LOW - (least[first] & _LOW)).astype(np.int64)
    return h[place], place, first, np.append(first[1:], len(least)) - 1


def suffix_array(text: list[int] | np.ndarray) -> list[int]:
    """The suffixes of ``text`` (numbers below its length or not) in order.

    Its last symbol must be the least and occur once.
    """
    n = len(text)
    symbols = np.asarray(text)
    first = np.argsort(symbols, kind="stable")
    begins = np.concatenate([[True], symbols[first[1:]] != symbols[first[:-1]]])
    begin = np.flatnonzero(begins)
    order = first.tolist()
    places = np.empty(n, np.int64)
    places[first] = np.arange(n)
    where = places.tolist()  # place of a suffix
    start = begin[np.cumsum(begins) - 1][places].tolist()  # first place of a suffix's group
    sizes = np.zeros(n, np.int64)
    sizes[begin] = np.diff(np.append(begin, n))
    size = sizes.tolist()  # members of the group that begins at a place
    previous = [-1] * n
    end = n
    while end > 0:
        group = start[order[end - 1]]
        if group == end - 1:  # a group of one leads to one suffix at most
            end = group
            s = order[group]
            p = s - 1
            while p >= 0 and start[p] >= group:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                g = start[p]
                left = size[g] - 1
                if left:
                    size[g] = left
                    to = g + left
                    at = where[p]
                    if at != to:
                        other = order[to]
                        order[at] = other
                        where[other] = at
                        order[to] = p
                        where[p] = to
                    size[to] = 1
                    start[p] = to
            continue
        members = order[group:end]
        if len(members) > 1:
            members.sort()
        end = group
        counts: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and start[p] >= group:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if len(counts) == len(members) or max(counts.values(), default=1) == 1:
            parts = [list(counts)]
        else:  # the suffixes that most members lead to come last in their group
            levels: dict[int, list[int]] = {}
            for p, count in counts.items():
                levels.setdefault(count, []).append(p)
            parts = [levels[c] for c in sorted(levels, reverse=True)]
        for part in parts:
            touched: dict[int, int] = {}
            for p in part:
                g = start[p]
                size[g] = left = size[g] - 1
                to = g + left
                at = where[p]
                if at != to:
                    other = order[to]
                    order[at] = other
                    where[other] = at
                    order[to] = p
                    where[p] = to
                touched[g] = touched.get(g, 0) + 1
            for p in part:
                g = start[p]
                if g in touched:
                    many = touched.pop(g)
                    new = g + size[g]
                    size[new] = many
                    for q in order[new : new + many]:
                        start[q] = new
    # from the least suffix on
    free = list(range(n))
    placed = bytearray(n + 1)
    placed[n] = 1  # ends a walk: it is what -1 stands for
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    free[start[n - 1]] += 1
    for place in range(n):
        s = out[place] - 1
        while not placed[s]:
            g = start[s]
            to = free[g]
            out[to] = s
            free[g] = to + 1
            placed[s] = 1
            s = previous[s]
    return out


def comparable(group: list[tuple[bytes, int, int]]) -> list[tuple[list[int], int, int]]:
    """Contexts that can share a window: (members, bytes before and after the seed's start that all their windows hold).

    Contexts of one seed are parted by those bytes, and the parts again by the
    more that they hold; a context left alone shares no window.
    """
    done, open_parts = [], [list(range(len(group)))]
    while open_parts:
        part = open_parts.pop()
        before = min(group[k][2] for k in part)
        after = LENGTH - max(group[k][1] for k in part)
        cores: dict[bytes, list[int]] = {}
        for k in part:
            data, left, _ = group[k]
            cores.setdefault(data[left - before : left + after], []).append(k)
        if len(cores) == 1:
            done.append((part, before, after))
        else:
            open_parts += [c for c in cores.values() if len(c) > 1]
    return done


def _longest_shared(parts: list[bytes]) -> list[int]:
    """How many first bytes each string has in common with another one: a neighbour in sorted order shares the most."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    found = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        size = min(len(parts[i]), len(parts[j]))
        differ = int.from_bytes(parts[i][:size], "big") ^ int.from_bytes(parts[j][:size], "big")
        same = size - (differ.bit_length() + 7) // 8
        found[i] = max(found[i], same)
        found[j] = same
    return found


def repeated_windows(groups: list[list[tuple[bytes, int, int]]]) -> list[list[np.ndarray]]:
    """For each context of each group, which of its windows occur in another context of the group.

    A group's contexts (bytes, bytes before the seed, the same for the last
    window) have equal seeds and differ.
    """
    flags = [[np.zeros(left - last + 1, bool) for _, left, last in group] for group in groups]
    parts: list[np.ndarray] = []
    core_of, widths, cores_at, owners, many_windows = [], [], [], [], []
    core = 0
    for g, group in enumerate(groups):
        for members, before, after in comparable(group):
            # a window that another context holds lies in what is shared on either side of the core; the rest is not sorted
            shared_left = _longest_shared([group[k][0][: group[k][1] - before][::-1] for k in members])
            shared_right = _longest_shared([group[k][0][group[k][1] + after :] for k in members])
            for k, more_left, more_right in zip(members, shared_left, shared_right, strict=True):
                data, left, last = group[k]
                most, least = min(left, before + more_left), max(last, LENGTH - after - more_right)
                if most < least:
                    continue
                b = np.frombuffer(data, np.uint8).astype(np.int64)
                parts.append(np.concatenate([b[left - most : left - before], [-1], b[left + after : left + LENGTH - least], [-2]]))
                core_of.append(core)
                widths.append(LENGTH + 1 - before - after)
                cores_at.append(most - before)
                many_windows.append(most - least + 1)
                owners.append((g, k, left - most))
            core += 1
    many = len(parts)
    if not many:
        return flags
    lengths = np.array([len(p) for p in parts])
    text = np.concatenate(parts) + many
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cores_of, at_core, widths_of = np.array(core_of), np.array(cores_at), np.array(widths)
    windows_of = np.array(many_windows)
    text[starts + at_core] = many + 256 + cores_of
    text[starts + lengths - 1] = np.arange(many)[::-1]
    order = np.array(suffix_array(text))
    owner = np.repeat(np.arange(many), lengths)
    offset = np.arange(len(text)) - starts[owner]
    a, b = order[:-1], order[1:]
    ca, cb = owner[a], owner[b]
    near = (offset[a] < windows_of[ca]) & (offset[b] < windows_of[cb]) & (cores_of[ca] == cores_of[cb]) & (at_core[ca] - offset[a] == at_core[cb] - offset[b])
    a, b, ca = a[near], b[near], ca[near]
    found = np.zeros(len(text), bool)
    last = len(text) - 1
    for at in range(0, len(a), 4096):
        x, y, w = a[at : at + 4096], b[at : at + 4096], widths_of[ca[at : at + 4096]]
        step = np.arange(int(w.max()))
        inside = step[None, :] < w[:, None]
        same = ((text[np.minimum(x[:, None] + step, last)] == text[np.minimum(y[:, None] + step, last)]) | ~inside).all(axis=1)
        found[x[same]] = True
        found[y[same]] = True
    for (g, k, at), s, windows in zip(owners, starts.tolist(), many_windows, strict=True):
        flags[g][k][at : at + windows] = found[s : s + windows]
    return flags


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    return own.select("doc_id", "text", F.xxhash64("text").alias("doc"), F.crc32("text").bitwiseAND(F.lit(0x7FFF)).alias("tag"))


# a context's place in one number: 15 bits that name the text, 32 of the seed's place, 8 and 8 of the bytes before it
def _tag(at: Column) -> Column:
    return F.shiftright(at, 48)


def _seeds(named: DataFrame) -> DataFrame:
    """``seed``, ``context`` (hashes), ``doc`` and ``at`` of every context of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(0)).to_pylist()
            for begin, end in even_slices(sizes, SLICE):  # a few texts at a time, so a worker stays small
                parts: list[list[np.ndarray]] = [[], [], [], []]
                for k in range(begin, end):
                    data, doc, tag = (c[k].as_py() for c in batch.columns)
                    seed, place, first, last = contexts(data)
                    if len(seed):
                        hashes = [xxhash.xxh64_intdigest(data[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                        parts[0].append(seed.view(np.int64))
                        parts[1].append(np.array(hashes, np.uint64).view(np.int64))
                        parts[2].append(np.full(len(seed), doc))
                        parts[3].append((tag << 48) | (place << 16) | ((place - first) << 8) | (place - last))
                if parts[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["seed", "context", "doc", "at"])

    return named.select("text", "doc", "tag").mapInArrow(rows, "seed long, context long, doc long, at long")


def _pieces(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """What the wanted contexts (``seed``, ``context``, ``doc``, ``at``, ``split``) are compared by, from one reading of the texts.

    A context of a seed with a ``split`` of 1 is one row: ``left`` and ``last``
    (bytes before the seed) and its bytes in ``data``; ``part`` is null.  Any other
    is a row for each of its windows: ``left`` and ``last`` are the same, ``data``
    is 128 bits of the window's hash, and ``part``, below ``split``, deals the
    contexts of a window evenly.
    """
    firsts = named.groupBy("doc", "tag").agg(F.min("doc_id").alias("first_id"))
    lists = wanted.groupBy("doc", _tag(F.col("at")).alias("tag")).agg(F.collect_list(F.struct("seed", "context", "at", "split")).alias("list"))
    lists = lists.join(firsts, ["doc", "tag"]).withColumnsRenamed({"doc": "doc_", "tag": "tag_"})
    joined = named.join(lists, (F.col("doc") == F.col("doc_")) & (F.col("tag") == F.col("tag_")) & F.col("doc_id").eqNullSafe(F.col("first_id")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seeds, contexts_, lefts, lasts, bytes_, parts = [], [], [], [], [], []
                for c in found:
                    place, left, last = (c["at"] >> 16) & 0xFFFFFFFF, (c["at"] >> 8) & 0xFF, c["at"] & 0xFF
                    if c["split"] == 1:
                        many = 1
                        lefts.append(left)
                        lasts.append(last)
                        bytes_.append(data[place - left : place - last + LENGTH])
                        parts.append(None)
                    else:
                        many = left - last + 1
                        lefts += range(last, left + 1)
                        lasts += range(last, left + 1)
                        bytes_ += [xxhash.xxh3_128_digest(data[place - k : place - k + LENGTH]) for k in range(last, left + 1)]
                        parts += [(c["context"] & 0x7FFFFFFFFFFFFFFF) % c["split"]] * many
                    seeds += [c["seed"]] * many
                    contexts_ += [c["context"]] * many
                columns = [pa.array(x, pa.int64()) for x in (seeds, contexts_, lefts, lasts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bytes_, pa.binary()), pa.array(parts, pa.int64())], ["seed", "context", "left", "last", "data", "part"])

    return joined.select("text", "list").mapInArrow(rows, "seed long, context long, left long, last long, data binary, part long")


def _counted_repeats(windows: DataFrame) -> DataFrame:
    """``seed``, ``context``, ``first``, ``last`` (both the same) of the windows that two or more contexts hold."""
    name = ["seed", "before", "window"]
    parts = windows.groupBy(*name, "part").agg(F.count(F.lit(1)).alias("n"))
    again = parts.groupBy(*name).agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).filter("n > 1")
    again = again.select(*name, F.explode("parts").alias("part"))
    found = windows.join(again, [*name, "part"])
    return found.select("seed", "context", F.col("before").alias("first"), F.col("before").alias("last"))


def _sorted_repeats(texts: DataFrame) -> DataFrame:
    """``seed``, ``context``, ``first``, ``last``: stretches of repeated windows, as bytes before the seed."""

    def solve(groups: list[list[tuple[int, int, bytes, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
        hard = []
        for group in groups:
            # a text that stands in several rows of one id comes more than once
            by_data: dict[bytes, list] = {}
            for c in group:
                by_data.setdefault(c[2], []).append(c)
            for same in by_data.values():
                if len(same) > 1:
                    yield from ((c[0], c[1], c[3], c[4]) for c in same)
            rest = [same[0] for same in by_data.values()]
            if len(rest) > 1:
                hard.append(rest)
        if hard:
            for group, flags in zip(hard, repeated_windows([[c[2:] for c in g] for g in hard]), strict=True):
                for c, own in zip(group, flags, strict=True):
                    yield from ((c[0], c[1], c[3] - i, c[3] - j) for i, j in _runs(own))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list] = []
        size, key = 0, None

        def batch_of(found: Iterator[tuple[int, int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seed", "context", "first", "last"])

        for batch in batches:
            for seed, context, left, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seed != key:
                    if size >= BLOCK:
                        yield batch_of(solve(groups))
                        groups, size = [], 0
                    key = seed
                    groups.append([])
                groups[-1].append((seed, context, data, left, last))
                size += len(data)
        yield batch_of(solve(groups))

    dealt = texts.repartition("seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(rows, "seed long, context long, first long, last long")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``tag`` and ``spans`` (begin, end in bytes; they may overlap) of every text with repeated strings."""
    named = _named(docs, doc_id, text)
    every = _seeds(named)
    again = every.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    seeds = checkpointed(every.join(again, "seed").groupBy("seed", "context", "doc", "at").agg(F.count(F.lit(1)).alias("n")))
    distinct = seeds.groupBy("seed", "context").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "at")).alias("of"))
    several = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    wanted = distinct.join(several, "seed").select("seed", "context", "of.doc", "of.at", F.ceil(F.col("many") / MOST).cast("long").alias("split"))
    pieces = checkpointed(_pieces(named, wanted))
    whole_contexts = pieces.filter("part is null").select("seed", "context", "left", "last", "data")
    windows = pieces.filter("part is not null").select("seed", "context", F.col("left").alias("before"), F.col("data").alias("window"), "part")
    partly = checkpointed(_sorted_repeats(whole_contexts).unionByName(_counted_repeats(windows)))
    left, right = F.shiftright("at", 8).bitwiseAND(F.lit(0xFF)), F.col("at").bitwiseAND(F.lit(0xFF))
    whole = distinct.filter("n > 1").select("seed", "context", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    found = seeds.drop("n").join(whole.unionByName(partly), ["seed", "context"])
    place = F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    span = F.struct((place - F.coalesce(F.col("first"), left)).alias("begin"), (place - F.coalesce(F.col("last"), right) + LENGTH).alias("end"))
    return found.groupBy("doc", _tag(F.col("at")).alias("tag")).agg(F.collect_set(span).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs: begin, end) and ``kept`` (the bytes left)."""
    named = _named(docs, doc_id, text)
    kind = named.schema["doc_id"].dataType.simpleString()
    joined = named.join(repeats(docs, doc_id, text), ["doc", "tag"], "left").select("doc_id", "text", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for begin, end in even_slices(sizes, SLICE):
                spans, kept = [], []
                for k in range(begin, end):
                    data, own = batch.column(1)[k].as_py(), _merged(batch.column(2)[k].as_py() or [])
                    parts, at = [], 0
                    for b, e in own:
                        parts.append(data[at:b])
                        at = e
                    spans.append([{"begin": b, "end": e} for b, e in own])
                    kept.append(b"".join([*parts, data[at:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes[begin:end], pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(rows, f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
