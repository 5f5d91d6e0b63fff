"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked.  Each starts in a shard given by a hash.
In every round a document asks for the shard in which most of its neighbours are;
a shard takes in no more than the room its quota leaves at the start of the round
(requests stand in a fixed random order, a group may move in part).  A group whose
favourite is full asks for the shard with most of its documents among those with
room.  The rounds end when nothing moves, or after ``ROUNDS``.  Each round is a
few joins over one row for each (group, shard), as all neighbours of a document
are the documents of its group: a group of n documents is never n^2 edges.

The law is ``rows``: with n documents, shard j holds ``floor(n / shards)``, and one
more where j is below the remainder.  What a shard holds beyond its quota, and the
documents without a link, fill the room that is left.  Slots are gapless from 0.

Nulls: a null text has size 1, no checksum and no link; null ids are ordinary.
Empty texts are equal texts.  Repeated rows are linked documents.  Empty tables
give no rows.  All by DataFrame functions: running sums go through
``ordered_sum``, so neither a group nor a shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, handed_out, ordered_sum, row_key, text_md5, unit_hash

SHARDS = 16
ROUNDS = 10


def _used(state: DataFrame, shards: int) -> list[int]:
    """Linked documents in each shard: one row a shard."""
    found = dict(state.groupBy("shard").agg(F.sum("c")).collect())
    return [found.get(j, 0) for j in range(shards)]


def _by_shard(values: list[int], shard: str) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col(shard))


def _moves(state: DataFrame, free: list[int], rows: int) -> DataFrame:
    """The moves of one round: ``c`` documents of group ``g`` from ``shard`` to ``target``."""
    room = _by_shard(free, "shard") > 0
    best = state.groupBy("g").agg(F.max_by("shard", F.struct(room, "c", -F.col("shard"))).alias("target"), F.max(room).alias("any")).filter("any")
    asked = state.join(best, "g").filter("shard != target").select("g", "shard", "target", "c")
    asked = ordered_sum(asked, "target", unit_hash(F.col("g"), F.col("shard")), ["g", "shard"], "c", "before", rows)
    left = _by_shard(free, "target") - F.col("before")
    return asked.select("g", "shard", "target", F.greatest(F.lit(0).cast("long"), F.least("c", left)).alias("c")).filter("c > 0")


def _pick(places: Column, rank: Column) -> Column:
    """The entry (``shard``, ``begin``, ``end``, ``slot``) whose range holds the rank, or null."""
    return F.get(F.filter(places, lambda p: (p["begin"] <= rank) & (rank < p["end"])), 0)


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row a document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``text_md5``."""
    raw = F.col(text).cast("string").cast("binary")
    own = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("text_md5"))
    own = checkpointed(own.withColumn("one", F.lit(1).cast("long")))
    n = own.count()
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    copies = own.filter(F.col("text_md5").isNotNull()).groupBy(F.col("text_md5").alias("g")).agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("g")
    marked = checkpointed(own.join(copies, F.col("text_md5") == F.col("g"), "left").withColumn("place", unit_hash(F.col("doc_id"), F.col("text_md5"))))
    linked = marked.filter(F.col("g").isNotNull())
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(shards)).cast("int")
    state = checkpointed(linked.groupBy("g", start.alias("shard")).agg(F.count(F.lit(1)).alias("c")))
    for _ in range(ROUNDS):
        free = [q - u for q, u in zip(quota, _used(state, shards), strict=True)]
        moves = checkpointed(_moves(state, free, n))
        if moves.isEmpty():
            break
        after = state.union(moves.select("g", "shard", -F.col("c"))).union(moves.select("g", F.col("target").alias("shard"), "c"))
        state = checkpointed(after.groupBy("g", "shard").agg(F.sum("c").alias("c")).filter("c > 0"))

    # where each (group, shard) part stands in its shard; what is beyond the quota has no place
    used = _used(state, shards)
    parts = ordered_sum(state, "shard", unit_hash(F.col("g")), ["g"], "c", "slot", n)
    parts = parts.withColumn("held", F.greatest(F.lit(0).cast("long"), F.least("c", _by_shard(quota, "shard") - F.col("slot"))))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("begin", before)  # a group has one row for each shard at most
    places = parts.groupBy(F.col("g").alias("g2")).agg(F.collect_list(F.struct("shard", "begin", (F.col("begin") + F.col("held")).alias("end"), "slot")).alias("places"))
    ranked = ordered_sum(linked, "g", F.col("place"), ["doc_id", "size"], "one", "rank", n).join(places, F.col("g") == F.col("g2"), "left")
    ranked = checkpointed(ranked.withColumn("at", _pick(F.col("places"), F.col("rank"))).select(*marked.columns, "rank", "at"))

    # the rest fills up the shards one after the other
    pool = marked.filter(F.col("g").isNull()).unionByName(ranked.filter(F.col("at").isNull()).drop("rank", "at"))
    pool = ordered_sum(pool.withColumn("all", F.lit(0)), "all", F.col("place"), ["doc_id", "size"], "one", "rank", n).drop("all")
    gaps, begin = [], 0
    for j in range(shards):
        held = min(used[j], quota[j])
        gaps.append((j, begin, begin + quota[j] - held, held))
        begin = gaps[-1][2]
    entries = F.array(*(F.struct(F.lit(j).alias("shard"), F.lit(b).cast("long").alias("begin"), F.lit(e).cast("long").alias("end"), F.lit(s).cast("long").alias("slot")) for j, b, e, s in gaps))
    filled = pool.withColumn("at", _pick(entries, F.col("rank")))

    both = ranked.filter(F.col("at").isNotNull()).unionByName(filled.select(*ranked.columns))
    slot = F.col("at.slot") + F.col("rank") - F.col("at.begin")
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("at.shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), "text_md5")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: ``links`` between equal texts and those ``cut`` (ends in two shards), counted from group sizes."""
    parts = placed.filter(F.col("text_md5").isNotNull()).groupBy("text_md5", "shard").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c"))
    groups = parts.groupBy("text_md5").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("inside"))
    return groups.agg(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).alias("links"), F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("cut"))


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` in shard and slot order, with the shard and the slot as two more columns.

    Places are found from short rows; then each document takes one of the places
    found for its id and text.
    """
    found = shard_documents(docs, doc_id, text, shards)
    found = found.select(row_key(F.col("doc_id"), F.col("text_md5")).alias("key"), "shard", "slot")
    out = handed_out(docs, row_key(F.col(doc_id), text_md5(text)), found, "key", ["shard", "slot"])
    shard, slot = out.columns[-2:]
    return out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
