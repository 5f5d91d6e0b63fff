"""Mixing sources to target weights along a time-varying curriculum.

Every source has a size (the words of its documents), a weight and a schedule: a
piecewise linear rate over training time 0 to 1.  The mix is ``share`` times the
words of all sources, dealt out by weight; a source's target stops at ``most``
times its size, the excess is dealt anew by weight until no source is above (the
level at which the targets fill up is found in one pass over the sources, sorted
by how soon they stop).

A source's schedule is integrated: ``demand(t)`` is the part of its target used up
by time t.  Its documents stand in a fixed order that looks random (by hash), end
to end on a line of words; the line is read from its start until the target is
reached, over again after its end.  A document's training position is the time at
which the demand reaches the document's start: the inverse of the integral, in
closed form on each linear piece.  Sorting by position gives the training order.

The document at which the target is reached is taken in part, so taken words add
up to the target (rounded).  No document is taken more than ``most`` times.

Nulls: a null text has size 0 and is not taken; null sources form a source, last
in order; null ids are ordered like the text "".  Repeated rows count each time.
Empty tables give no rows.  All by DataFrame functions; running sums go through
``ordered_sum``, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh, handed_out, ordered_sum, row_key, text_md5

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Rates at evenly spaced times for the sources in turn: early, late, rising to the middle.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (0.6, 1.4, 0.6))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (``source``, ``size``) rows: one row a source with ``number``, ``source_size`` and ``target``.

    The window is over one row a source, not over documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    out = sources.withColumn("number", F.row_number().over(by_name) - 1)
    given = F.array(*(F.lit(float(w)) for w in weights))
    out = out.withColumn("weight", F.get(given, F.col("number") % len(weights)))
    out = out.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("mix", F.sum("source_size").over(everything) * float(share))
    # sources in the order in which they stop: k of them stopped leave this level for the others
    soonest = everything.orderBy(F.col("cap") / F.col("weight"), "number")
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(soonest.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("mix") - capped) / open_weight
    out = out.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    # the first source that doesn't stop sets the level for all; none does only where there are no words
    reached = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("target", F.least(reached * F.col("weight"), F.col("cap")))
    return out.select("source", "number", "source_size", "target")


def demand_inverse(part: Column, number: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time in [0, 1] at which a schedule's integral reaches ``part`` of the whole.

    On a piece of length d with rates a to b, the integral after time x is
    ``a x + (b - a) x^2 / (2 d)``.
    """
    found = None
    for k, rates in enumerate(schedules):
        d = 1.0 / (len(rates) - 1)
        areas = [(a + b) / 2 * d for a, b in zip(rates, rates[1:], strict=False)]
        whole, done, time = sum(areas), 0.0, None
        for piece, (a, b, area) in enumerate(zip(rates, rates[1:], areas, strict=False)):
            left = part * whole - done
            slope = (b - a) / d
            x = left / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * left, F.lit(0.0))) - a) / slope
            x = F.lit(piece * d) + x
            time = F.when(left < area, x) if time is None else time.when(left < area, x)
            done += area
        time = F.least(time.otherwise(F.lit(1.0)), F.lit(1.0))
        found = F.when(number % len(schedules) == k, time) if found is None else found.when(number % len(schedules) == k, time)
    return found


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``position``, ``again_position`` and ``keep``.

    ``position`` is null for documents that are not taken; ``again_position`` is
    the position of the second reading of a document, null where there is none.
    Texts are read once, to be measured; what is ordered and joined is short.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *keep)
    return _mixture(checkpointed(own), keep, weights, share, most, schedules)


def _mixture(own: DataFrame, keep: Sequence[str], weights: Sequence[int], share: float, most: int, schedules: Sequence[Sequence[float]]) -> DataFrame:
    targets = source_targets(own, weights, share, most).withColumnRenamed("source", "source_")
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = own.withColumn("order_", name)
    place = F.conv(F.substring("order_", 1, 8), 16, 10).cast("double") / float(1 << 32)
    lined = ordered_sum(own, "source", place, ["order_", "size"], "size", "begin_", own.count())
    lined = lined.join(targets, F.col("source").eqNullSafe(F.col("source_")))
    budget = F.round("target").cast("long")
    words = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("begin_") - F.col("source_size") * turn)) for turn in range(most)]
    taken = words[0]
    for more in words[1:]:
        taken = taken + more
    at = [F.when(w > 0, demand_inverse((F.col("begin_") + F.col("source_size") * turn) / F.col("target"), F.col("number"), schedules)) for turn, w in enumerate(words)]
    return lined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), at[0].alias("position"), (at[1] if most > 1 else F.lit(None).cast("double")).alias("again_position"), *keep)


def in_training_order(found: DataFrame, tie: str = "doc_id") -> DataFrame:
    """The rows of ``mixture`` sorted by ``position`` over all partitions; those not taken come last."""
    # those not taken are spread by hash, or they would all be in one range
    order = (F.col("position").asc_nulls_last(), F.when(F.col("position").isNull(), F.xxhash64(tie)), F.col(tie))
    return found.repartitionByRange(*order[:2]).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``.

    A document is read as often as most of it is taken: not at all below half of
    its words, once, or twice from one and a half of them on.  Documents without
    words take no part of the mix and go.
    """
    # texts are measured where they lie; only short rows are ordered
    key = row_key(F.col(doc_id), F.col(source), text_md5(text))
    sized = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("key_")))
    found = _mixture(sized, ("key_",), WEIGHTS, SHARE, MOST, SCHEDULES).filter("size > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    read = F.when(times >= 2, F.array("position", "again_position")).when(times == 1, F.array("position"))
    taken = found.select("key_", read.alias("when")).filter(F.col("when").isNotNull())
    out = handed_out(docs, key, taken, "key_", ["when"])
    position, = fresh(out, "_position")
    out = out.withColumn(position, F.explode(out.columns[-1]))
    return out.repartitionByRange(position).sortWithinPartitions(position, doc_id).select(*docs.columns)


def _inverse_sql(part: str, number: str) -> str:
    """``demand_inverse`` with ``SCHEDULES`` as SQL: the quadratic of each linear piece, solved."""
    by_source = []
    for k, rates in enumerate(SCHEDULES):
        d = 1.0 / (len(rates) - 1)
        areas = [(a + b) / 2 * d for a, b in zip(rates, rates[1:], strict=False)]
        pieces, done = [], 0.0
        for piece, (a, b, area) in enumerate(zip(rates, rates[1:], areas, strict=False)):
            left, slope = f"({part} * {sum(areas)!r}::DOUBLE - {done!r}::DOUBLE)", (b - a) / d
            solved = f"(sqrt(greatest({a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * {left}, 0)) - {a!r}::DOUBLE) / {slope!r}::DOUBLE" if slope else f"{left} / {a!r}::DOUBLE"
            pieces.append(f"WHEN {left} < {area!r}::DOUBLE THEN {piece * d!r}::DOUBLE + {solved}")
            done += area
        by_source.append(f"WHEN {k} THEN least(CASE {' '.join(pieces)} ELSE 1.0::DOUBLE END, 1.0::DOUBLE)")
    return f"CASE {number} % {len(SCHEDULES)} {' '.join(by_source)} END"


#: The same targets, taken words and positions for DuckDB; the level is found by comparing all sources with all (there are few).
MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT *, [5, 2, 1][1 + (number % 3)::INT]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source)),
levels AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS stop FROM sources),
tried AS (
  SELECT a.stop AS stop_at, (SELECT sum(source_size) FROM sources) * 1.5 AS mix, sum(least(b.cap, b.weight * a.stop)) AS filled,
         coalesce(sum(b.cap) FILTER (b.stop < a.stop), 0) AS capped, sum(b.weight) FILTER (b.stop >= a.stop) AS open_weight
  FROM levels a CROSS JOIN levels b GROUP BY a.stop),
chosen AS (SELECT (mix - capped) / open_weight AS level FROM tried WHERE filled >= mix ORDER BY stop_at LIMIT 1),
targets AS (SELECT source, number, source_size, least(cap, weight * level) AS target FROM levels, chosen),
lined AS (
  SELECT s.doc_id, s.size, t.number, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, budget - begin)) + greatest(0, least(size, budget - begin - source_size)))::BIGINT AS taken,
       CASE WHEN least(size, budget - begin) > 0 THEN {first} END AS position,
       CASE WHEN least(size, budget - begin - source_size) > 0 THEN {again} END AS again_position
FROM lined
""".replace("{first}", _inverse_sql("(begin::DOUBLE / target)", "number")).replace("{again}", _inverse_sql("((begin + source_size)::DOUBLE / target)", "number"))
