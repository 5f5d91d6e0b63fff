"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its
letters: the product of their vectors, each rotated by its place in the n-gram.
A text's profile is the bundle (sum) of its n-grams' vectors, a language's
prototype the bundle of all its training texts.  A text gets the language whose
prototype is nearest by cosine, prototypes and profile taken from their common
mean (what all languages share says nothing); equal cosines go to the first
language by code point.  The score is that cosine, from 0 to 1.

Letters are the characters that Unicode calls so, in lower case; runs of all
others are one blank, which has a vector too.  Latin letters up to U+00FF have
vectors of their own; others share ``SHARED`` vectors by code point, so tables
stay bounded for any script.

Bundles add up, so training is one pass that emits one vector for each task and
language, and their sum; the driver gets languages times ``DIMENSIONS`` numbers.

Nulls: a null text, or one without a letter, is ``und`` with score 0; training
leaves out null languages and texts.  Without training rows all is ``und``.
Repeated rows count each time.  Texts are read whole; n-grams are counted first,
so a text's work beyond counting follows its distinct n-grams.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
#: Letters with a vector of their own, in lower case; the vectors that all others share.
ALPHABET = [c for c in range(0x100) if chr(c).isalpha() and chr(c) == chr(c).lower()]
SHARED = 127 - len(ALPHABET)
LETTERS = 128
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for at in range(0x110000):
        c = chr(at)
        if c.isalpha():
            low = c.lower()
            out[at] = ord(low) if len(low) == 1 else ord(low[0])
    return out


def _letters(text: str) -> np.ndarray:
    """Lower-case letters with one 0 for each run of other characters, and at both ends."""
    points = np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le"), np.uint32)
    found = np.concatenate([[0], _lower_letters()[points], [0]])
    return found[(found != 0) | np.append(True, found[:-1] != 0)]


class Profiles:
    """Counts of n-grams and their vectors."""

    KEPT = 60_000

    def __init__(self) -> None:
        self.number = (len(ALPHABET) + 1 + np.arange(0x110000) % SHARED).astype(np.int32)
        self.number[0] = 0
        self.number[ALPHABET] = np.arange(1, len(ALPHABET) + 1)
        random = np.random.Generator(np.random.Philox(key=2024))
        vectors = random.integers(0, 2, (LETTERS, DIMENSIONS), np.int8) * 2 - 1
        self.rotated = [np.roll(vectors, place, axis=1).astype(np.int8) for place in range(GRAM)]
        self.row = np.full(LETTERS**GRAM, -1, np.int32)
        self.vectors = np.zeros((0, DIMENSIONS), np.float32)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text and their counts."""
        letters = self.number[_letters(text)].astype(np.int64)
        if len(letters) < GRAM or not letters.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.zeros(len(letters) - GRAM + 1, np.int64)
        for place in range(GRAM):
            codes = codes * LETTERS + letters[place : place + len(codes)]
        return np.unique(codes, return_counts=True)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-grams: products of rotated letter vectors."""
        out = np.ones((len(codes), DIMENSIONS), np.int8)
        for place in reversed(range(GRAM)):
            out *= self.rotated[GRAM - 1 - place][codes // LETTERS ** (GRAM - 1 - place) % LETTERS]
        return out

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """The bundle of each text, one row a text; zeros without a letter."""
        found = [self.grams(t) if t else None for t in texts]
        every = [f[0] for f in found if f is not None and len(f[0])]
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        if not every:
            return out
        codes = np.unique(np.concatenate(every))
        fresh = codes[self.row[codes] < 0]
        if len(self.vectors) + len(fresh) > self.KEPT:
            self.row[:] = -1
            self.vectors, fresh = self.vectors[:0], codes
        if len(fresh):
            self.row[fresh] = np.arange(len(self.vectors), len(self.vectors) + len(fresh))
            self.vectors = np.concatenate([self.vectors, self.bound(fresh).astype(np.float32)])
        for k, f in enumerate(found):
            if f is not None and len(f[0]):
                out[k] = f[1].astype(np.float32) @ self.vectors[self.row[f[0]]]
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Each language's prototype, from all rows with text and language."""
    own = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, total = _maker(), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                found = maker.profiles(texts[at : at + 256]).astype(np.float64)
                norms = np.linalg.norm(found, axis=1)
                found /= np.where(norms > 0, norms, 1)[:, None]  # each text has one vote, however long
                for name in set(langs[at : at + 256]):
                    own = np.array([x == name for x in langs[at : at + 256]])
                    total[name] = total.get(name, 0.0) + found[own].sum(axis=0)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(np.rint(vector * 1e6).astype(np.int64))], ["lang", "at", "value"])

    summed = own.mapInArrow(bundles, "lang string, at long, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages times DIMENSIONS numbers
        prototypes.setdefault(r.lang, np.zeros(DIMENSIONS))[r["at"]] = r.value
    return {k: prototypes[k] for k in sorted(prototypes)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every row; only the text is looked at."""
    names = list(prototypes)
    own = docs.select(F.col(text).cast("string").alias("text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    units = np.array([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]).reshape(len(names), DIMENSIONS)
    centre = units.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    apart = units - centre
    apart /= np.maximum(np.linalg.norm(apart, axis=1), 1e-9)[:, None]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _maker()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), 256):
                found = maker.profiles(texts[at : at + 256]).astype(np.float64)
                norms = np.linalg.norm(found, axis=1)
                moved = found / np.where(norms > 0, norms, 1)[:, None] - centre
                cosines = (moved / np.maximum(np.linalg.norm(moved, axis=1), 1e-9)[:, None]) @ apart.T
                best = np.argmax(np.round(cosines, 12), axis=1) if names else np.zeros(len(found), int)
                for k, b in enumerate(best):
                    known = bool(names) and norms[k] > 0
                    langs.append(names[b] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, cosines[k, b]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    return own.mapInArrow(rows, ", ".join([fields] * bool(fields) + ["lang_pred string, score double"]))


@lru_cache(maxsize=1)
def _maker() -> Profiles:
    """One table of vectors for each worker process."""
    return Profiles()
