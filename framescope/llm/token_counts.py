"""Token counts by prefix dynamic programming over a byte-pair vocabulary of pieces.

A text is encoded as pieces: a blank becomes the mark U+2581, one mark is put
before a text that is not empty, and characters without a piece become one token
for each of their UTF-8 bytes.  No piece has a mark after another character, so
merges never cross from a character to a mark, nor over a character without a
piece: the text falls apart into *segments* that are encoded independently.

In a segment, the encoding of a prefix is the encoding of a shorter prefix and
one last piece.  Of the pieces that end there, the last one is the one that stays
apart from the last piece of the shorter prefix when both are encoded together
(two neighbours that stay apart alone also stay apart in any longer text).  So
one pass over a segment gives, for every prefix, the last piece and the count.
A prefix of a text is whole segments and a prefix of one more; counts add up.

Null texts count as empty, empty texts have no token.  Repeated rows are counted
each.  Other columns are not read.  Texts are never cut: only distinct segments
are kept, up to a limit, so memory does not follow the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Distinct segments and pairs remembered by one task's process.
SEGMENT_LIMIT, PAIR_LIMIT = 1_000_000, 600_000


class PrefixCounter:
    """Counts tokens at every prefix of a text, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.score):
            raise ValueError("this vocabulary has pieces that reach over a blank")
        known = "".join(re.escape(c) for c in self.score if len(c) == 1)
        self.known_only = re.compile(f"[{known}]+").fullmatch
        self.runs = re.compile(f"[{known}]+|[^{known}]+").findall
        self.pieces = [piece for piece in self.score if self.merged(piece) == [piece]]
        self.ends: list[tuple[list[str], list[str]] | None] = [None] * len(self.pieces)
        self.apart: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, (len(piece), number))
        self.automaton.make_automaton()

    def merged(self, text: str, outer: tuple[set[str], set[str]] | None = None) -> list[str]:
        """The pieces of a short text of known characters: best score first, leftmost of equals.

        ``outer`` gathers the first and the last part seen after each step.
        """
        parts, score = list(text), self.score
        while True:
            if outer:
                outer[0].add(parts[0])
                outer[1].add(parts[-1])
            best, at = None, -1
            for k in range(len(parts) - 1):
                value = score.get(parts[k] + parts[k + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def outer_parts(self, number: int) -> tuple[list[str], list[str]]:
        """All that the first and the last part of a piece are while it is merged."""
        found = self.ends[number]
        if found is None:
            outer: tuple[set[str], set[str]] = (set(), set())
            self.merged(self.pieces[number], outer)
            found = self.ends[number] = (list(outer[0]), list(outer[1]))
        return found

    def stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay two pieces when encoded together."""
        a, b, score = self.pieces[left], self.pieces[right], self.score
        if a + b in score:
            return False
        heads, tails = self.outer_parts(right)[0], self.outer_parts(left)[1]
        if not any(x + y in score for x in tails for y in heads):
            return True  # nothing ever merges over the border
        return self.merged(a + b) == [a, b]

    def _run(self, text: str) -> list[int]:
        """Counts after 1, 2, ... characters of a text of known characters."""
        size, apart = len(self.pieces), self.apart
        last, count, done = [-1] * (len(text) + 1), [0] * (len(text) + 1), 0
        for end, (length, number) in self.automaton.iter(text):
            end += 1
            if end <= done:
                continue
            begin = end - length
            if begin:
                key = last[begin] * size + number
                stays = apart.get(key)
                if stays is None:
                    if len(apart) >= PAIR_LIMIT:
                        apart.clear()
                    stays = apart[key] = self.stays(last[begin], number)
                if not stays:
                    continue
            last[end], count[end], done = number, count[begin] + 1, end
        if done != len(text):
            raise AssertionError(f"no encoding for a prefix of {text!r}")
        return count[1:]

    def segment(self, text: str) -> list[int]:
        """Counts after 1, 2, ... characters of a segment; unknown characters part it."""
        if self.known_only(text):
            return self._run(text)
        counts: list[int] = []
        base = 0
        for run in self.runs(text):
            if self.known_only(run):
                counts += [base + n for n in self._run(run)]
            else:
                counts += [base + n for n in accumulate(len(c.encode()) for c in run)]
            base = counts[-1]
        return counts

    def total(self, text: str) -> int:
        """Tokens of a segment, remembered."""
        if len(self.totals) >= SEGMENT_LIMIT:
            self.totals.clear()
        found = self.totals[text] = self.segment(text)[-1]
        return found

    def parts(self, text: str) -> list[str]:
        """The segments of a text, each but its first mark given as it is encoded."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        joined, blanks = [], 0
        for word in words:
            if word:
                joined.append(MARK * blanks + word)
                blanks = 0
            else:
                blanks += 1
        if blanks:
            joined.append(MARK * (blanks - 1))
        return joined

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        get, total = self.totals.get, 0
        for part in self.parts(text or ""):
            part = MARK + part
            total += get(part) or self.total(part)
        return total

    def prefixes(self, text: str | None) -> np.ndarray:
        """Exact counts of ``text[:0]``, ``text[:1]``, ... ``text`` (length: characters + 1)."""
        text = text or ""
        out, at, base = np.zeros(len(text) + 1, np.int64), 0, 0
        for k, part in enumerate(self.parts(text)):
            counts = self.segment(MARK + part)
            # the first segment's first mark is put before the text, it is no character of it
            own = counts[1:] if k == 0 else counts
            out[at + 1 : at + 1 + len(own)] = np.add(own, base)
            at, base = at + len(own), base + counts[-1]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and file."""
    return PrefixCounter(path)


def _path(model: str) -> str:
    from .common import public_tokenizer

    return model if "/" in model else public_tokenizer(model)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL, limit: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    ``model`` is a path, or the name of a public vocabulary file that every
    machine has.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(_path(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = np.fromiter((found.count(t) for t in texts), np.int64, len(texts))
            sizes = np.fromiter((len((t or "").encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return own.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``doc_id`` and ``counts``: the token count of every prefix of the text, from no to all characters."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(_path(model))
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([found.prefixes(t)], pa.list_(pa.int64()))], ["doc_id", "counts"])

    return own.mapInArrow(rows, f"doc_id {kind}, counts array<long>")


def truncate(docs: DataFrame, budget: int, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``doc_id``, ``text`` cut to its longest prefix of at most ``budget`` tokens, and ``n_tokens`` of that prefix.

    Null texts stay null with no token.  Nothing is encoded again: the cut is read
    off the prefix table.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(_path(model))
        for batch in batches:
            cut, tokens = [], []
            for t in batch.column(1).to_pylist():
                counts = found.prefixes(t)
                end = int(np.flatnonzero(counts <= budget)[-1])
                cut.append(None if t is None else t[:end])
                tokens.append(int(counts[end]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string()), pa.array(tokens, pa.int64())], ["doc_id", "text", "n_tokens"])

    return own.mapInArrow(rows, f"doc_id {kind}, text string, n_tokens long")


def budget_positions(docs: DataFrame, block: int, doc_id: str = "doc_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``doc_id`` and ``ends``: for every multiple of ``block`` tokens, the longest prefix within it (characters)."""
    table = prefix_table(docs, doc_id, text, model)
    kind = table.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for counts in batch.column(1).to_pylist():
                floor = list(accumulate(reversed(counts), min))[::-1]  # a longer prefix can have fewer tokens
                ends.append([int(np.searchsorted(floor, n, "right")) - 1 for n in range(block, counts[-1] + block, block)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "ends"])

    return table.mapInArrow(rows, f"doc_id {kind}, ends array<long>")
