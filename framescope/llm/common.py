"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: White space that parts words, as characters of a regular expression class.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: what ``spark.checkpoint.dir`` names.

    Only where the session names none is one set: a temporary folder in local
    mode, else a folder in the warehouse, which all machines share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            local = (context.master or "").startswith("local") and "cluster" not in context.master
            named = tempfile.mkdtemp(prefix="llm-checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) from 52 bits of a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") / float(1 << 52)


def ordered_sum(df: DataFrame, key: str, place: Column, ties: list[str], value: str, before: str, rows: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same key that come earlier.

    Rows of a key are ordered by ``place`` (a double in [0, 1), spread evenly, as
    from ``unit_hash``) and then by ``ties``.  Keys are cut into about sqrt(rows)
    even stretches of ``place`` (``rows``: about how many rows ``df`` has), so
    neither a stretch nor the list of a key's stretches is as large as a large
    key.  Rows equal in place and ties are interchangeable.  Keys may be null.
    """
    at, cut, part, offset, k2, cut2 = fresh(df, "_place", "_cut", "_part", "_offset", "_key2", "_cut2")
    cuts = df.withColumn(at, place).withColumn(cut, F.floor(F.col(at) * max(1, math.isqrt(rows))).cast("long"))
    parts = cuts.groupBy(F.col(key).alias(k2), F.col(cut).alias(cut2)).agg(F.sum(value).alias(part))
    parts = parts.withColumn(offset, F.coalesce(F.sum(part).over(Window.partitionBy(k2).orderBy(cut2).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(key, cut).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = cuts.withColumn(before, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    out = out.join(parts, F.col(key).eqNullSafe(F.col(k2)) & (F.col(cut) == F.col(cut2)))
    return out.withColumn(before, F.col(before) + F.col(offset)).drop(at, cut, k2, cut2, part, offset)


def row_key(*parts: Column) -> Column:
    """One string for equal rows of ``parts``, never null: nulls are like nulls and unlike all else."""
    texts = [p.cast("string") for p in parts]
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"))


def text_md5(text: str) -> Column:
    return F.md5(F.col(text).cast("string").cast("binary"))


def handed_out(docs: DataFrame, key: Column, slots: DataFrame, slot_key: str, names: list[str]) -> DataFrame:
    """``docs`` with the columns ``names`` of ``slots``: each row takes one row of ``slots`` with its key.

    Rows of a key may take each other's; those that find none left go, as do slots
    left over.  Both kinds of rows lie in one table, dealt by key once, so texts
    cross one shuffle, not one to number them and another to join them.  Rows stand
    by a hash of their columns (maps left out), so a task run again deals as before.
    The new columns get names that ``docs`` does not use.
    """
    held = [f"c{k}_" for k in range(len(docs.columns))]
    given = fresh(docs, *names)
    hashed = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(key.alias("key_"), F.lit(1).alias("kind_"), F.xxhash64(*hashed).alias("hash_"), F.struct(*(F.col(c).alias(h) for c, h in zip(docs.columns, held, strict=True))).alias("row_"))
    places = slots.select(F.col(slot_key).alias("key_"), F.lit(0).alias("kind_"), F.xxhash64(*names).alias("hash_"), F.struct(*names).alias("slot_"))
    both = rows.unionByName(places, allowMissingColumns=True).repartition("key_")
    both = both.withColumn("number_", F.row_number().over(Window.partitionBy("key_", "kind_").orderBy("hash_")))
    pair = Window.partitionBy("key_", "number_").orderBy("kind_").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("slot_", F.first("slot_").over(pair)).filter((F.col("kind_") == 1) & F.col("slot_").isNotNull())
    return both.select(*(F.col(f"row_.{h}").alias(c) for c, h in zip(docs.columns, held, strict=True)), *(F.col(f"slot_.{n}").alias(g) for n, g in zip(names, given, strict=True)))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a limit in words and bytes, so memory stays bounded."""

    LIMIT, LIMIT_BYTES = 400_000, 32 << 20

    def __init__(self) -> None:
        super().__init__()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT or self.held >= self.LIMIT_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word)
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all bits."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words; with fewer words, of the whole sequence as one; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for k in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[k : k + count]
        total ^= total >> np.uint64(29)
    return mixed(total)


def even_slices(values: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Ranges of positions whose values add up to about ``most`` at a time."""
    begin, total, end = 0, 0, 0
    for end, value in enumerate(values, 1):
        total += value
        if total >= most:
            yield begin, end
            begin, total = end, 0
    if begin < end:
        yield begin, end


def public_tokenizer(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
