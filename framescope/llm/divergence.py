"""How far the sources of each language are from each other, over exact sparse document vectors.

Every document becomes a sparse vector of term counts, as ``CountVectorizer`` makes
them: one vocabulary per language of the terms in at least ``min_df`` of its
documents, of any size up to ``VOCAB_SIZE``.  Vectors are added up per (language,
source), as ``Summarizer`` does, and sources are compared on the sums.  Spark's own
``CountVectorizer`` keeps its vocabulary in the driver and sends it to every task,
and ``Summarizer`` adds dense vectors; with a vocabulary that grows with the corpus
neither is possible, so here the vocabulary is a table and all sums stay sparse:

* a task counts the terms of its documents and the documents that hold them, and
  hands on sums per (language, source, term): vectors added up before any shuffle;
* one shuffle by (language, term) gives each term's documents, total and counts by
  source: a row of the term-by-source matrix, as long as a language has sources;
* a pair of sources is evaluated on the terms both hold, counted by their two counts;
  terms that one or none of them holds follow from each source's own histogram of
  counts by subtraction.  No dense vector and no zero is ever written down.

With N the occurrences of kept terms in a group and V the language's kept terms, a term
occurring ``count`` times has p = 1 + floor(SCALE * (count + 1) / (N + V)), and p
differs from q by floor((p - q)^2 / q).  All numbers are whole and exact (decimals
where a long may not do).

Nulls: null text, language or source is ''.  Texts without terms add nothing; their
group still appears.  Repeated rows count each time; ties are ordered by item.  Very
long texts are counted whole, in memory that follows the text.  Empty tables give no
rows.  Columns besides the named ones are not read, so no name can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

MIN_DF = 3
#: The most terms of one language's vocabulary, as an integer index can number them.
VOCAB_SIZE = 2**31 - 1
SCALE = 1_000_000_000
TOP_TERMS = 200
#: A group's terms are ranked in so many parts before they are ranked together.
PARTS = 64
#: Bytes of counted terms a task holds before it hands its sums on.
HELD_BYTES = 48 << 20
ENTRY_BYTES = 120

#: A-Z in lower case; every ASCII character that is no letter parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SUMS = "lang string, source string, term string, count long, docs long"


def terms(text: str) -> list[bytes]:
    """Runs of letters A-Z, a-z and characters beyond ASCII, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            n = len(counts)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                        pa.array([t.decode("utf-8", "replace") for t in counts], pa.string()),
                        pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64()),
                    ],
                    names=["lang", "source", "term", "count", "docs"],
                )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = terms(text)
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(counts)
            counts.update(found)
            docs.update(set(found))
            size += (len(counts) - before) * ENTRY_BYTES
            if size > HELD_BYTES:
                yield from hand_on()
                size = 0
    yield from hand_on()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def term_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_df: int = MIN_DF) -> DataFrame:
    """One row per kept term of a language: ``lang``, ``term``, ``total`` and ``held``, its count in every source that has it."""
    own = docs.select(_text(lang).alias("lang"), _text(source).alias("source"), _text(text).alias("text"))
    # one shuffle serves both groupings: rows of a term are together, whatever their source
    sums = own.mapInArrow(_add_up, _SUMS).repartition("lang", "term")
    by_source = sums.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    rows = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("held")
    )
    return rows.filter(F.col("docs") >= min_df).select("lang", "term", "total", "held")


def probability(count: Column, size: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (size + kept)), in whole numbers; null where both are 0."""
    share = F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", share, F.nullif((size + kept).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most ``SCALE`` + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _many(n: Column, value: Column) -> Column:
    return n.cast("decimal(18,0)") * value.cast("decimal(19,0)")


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_df: int = MIN_DF, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every (language, source) that occurs.

    Part ``pair``: the item is another source of the language, the value the sum of
    differences of the group from it over all kept terms.  Part ``term``: the items
    are the ``top`` terms that the group holds more often than its language.
    """
    rows = checkpointed(term_rows(docs, text, lang, source, min_df))
    if rows.groupBy("lang").count().filter(F.col("count") > VOCAB_SIZE).limit(1).count():
        raise ValueError(f"a language has more than {VOCAB_SIZE} kept terms")
    held = rows.select("lang", "term", "total", F.inline("held"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("all"))
    sizes = held.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    zero = F.lit(0).cast("long")
    groups = docs.select(_text(lang).alias("lang"), _text(source).alias("source")).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("kept", zero).alias("kept"), F.coalesce("all", zero).alias("all"))
    groups = checkpointed(groups.withColumn("none", probability(zero, F.col("size"), F.col("kept"))))
    found = _pairs(rows, held, groups).unionByName(_terms(held, groups, top))
    return found.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def _side(groups: DataFrame, end: str) -> DataFrame:
    """The groups as one end of a pair."""
    return groups.select("lang", *(F.col(c).alias(f"{c}_{end}") for c in ("source", "size", "none")), *(["kept"] if end == "a" else []))


def _pairs(rows: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of differences over all kept terms.

    The sum over all terms is that of a pair without any shared term plus, for every
    shared one, what sharing it changes.  Terms enter as numbers of terms with equal
    counts, so a pair costs as much as it has different counts.
    """
    a, b = _side(groups, "a"), _side(groups, "b")
    pairs = a.join(b, "lang").filter(F.col("source_a") != F.col("source_b"))
    neither = difference(F.col("none_a"), F.col("none_b"))
    nothing = pairs.select("lang", "source_a", "source_b", F.coalesce(_many(F.col("kept"), neither), F.lit(0).cast("decimal(38,0)")).alias("part"))
    histogram = checkpointed(held.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n")))
    only_a = histogram.withColumnRenamed("source", "source_a").join(pairs, ["lang", "source_a"])
    only_a = only_a.select("lang", "source_a", "source_b", _many(F.col("n"), difference(probability(F.col("count"), F.col("size_a"), F.col("kept")), F.col("none_b")) - neither).alias("part"))
    only_b = histogram.withColumnRenamed("source", "source_b").join(pairs, ["lang", "source_b"])
    only_b = only_b.select("lang", "source_a", "source_b", _many(F.col("n"), difference(F.col("none_a"), probability(F.col("count"), F.col("size_b"), F.col("kept"))) - neither).alias("part"))
    # terms that both hold, by their two counts; sums of equal counts are combined before the shuffle
    first = rows.select("lang", "held", F.inline("held").alias("source_a", "count_a"))
    shared = first.select("lang", "source_a", "count_a", F.inline("held").alias("source_b", "count_b")).filter("source_a != source_b")
    shared = shared.groupBy("lang", "source_a", "source_b", "count_a", "count_b").agg(F.count(F.lit(1)).alias("n")).join(pairs, ["lang", "source_a", "source_b"])
    p = probability(F.col("count_a"), F.col("size_a"), F.col("kept"))
    q = probability(F.col("count_b"), F.col("size_b"), F.col("kept"))
    change = difference(p, q) - difference(p, F.col("none_b")) - difference(F.col("none_a"), q) + neither
    both = shared.select("lang", "source_a", "source_b", _many(F.col("n"), change).alias("part"))
    summed = nothing.union(only_a).union(only_b).union(both).groupBy("lang", "source_a", "source_b").agg(F.sum("part").alias("value"))
    order = Window.partitionBy("lang", "source_a").orderBy(F.col("value").desc(), "source_b")
    return summed.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value", F.row_number().over(order).alias("rank"))


def _terms(held: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms a group holds more often than its language, the largest differences first."""
    # a group's terms lie in PARTS pieces, each joined and ranked apart: no task sees a hot group whole
    copies = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    placed = held.withColumn("piece", F.pmod(F.xxhash64("term"), F.lit(PARTS))).join(copies, ["lang", "source", "piece"])
    placed = placed.withColumn("p", probability(F.col("count"), F.col("size"), F.col("kept"))).withColumn("q", probability(F.col("total"), F.col("all"), F.col("kept")))
    above = placed.filter("p > q").withColumn("value", difference(F.col("p"), F.col("q")).cast("decimal(38,0)"))
    order = (F.col("value").desc(), "term")
    best = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "piece").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


#: The same rows for DuckDB.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM counts x WHERE x.lang = g.lang AND x.source = g.source), 0)::HUGEINT AS n,
    (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v, coalesce((SELECT sum(total) FROM kept k WHERE k.lang = g.lang), 0)::HUGEINT AS all_n
  FROM (SELECT DISTINCT lang, source FROM d) g),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p, 1 + (1000000000 * (k.total + 1)) // (g.all_n + g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value,
      row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term) AS rank
    FROM dense WHERE c > 0 AND p > q) WHERE rank <= 200)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM found
"""
