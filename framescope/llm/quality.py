"""Quality rules with thresholds that follow the data, by DataFrame functions only.

Two parts decide on a document:

* the *base* rule, the same everywhere: fewer than ``MIN_WORDS`` words, or more
  than half of its words in 3-word windows that occur twice or more in it;
* *adaptive* fences per language and source.  Every measure of ``MEASURES`` is
  summed up as mergeable quantile sketches (KLL) of the documents that pass the
  base rule.  A document is rejected where a measure lies outside
  ``[q25 - FENCE * spread, q75 + FENCE * spread]`` of its group; the spread is the
  distance of the quartiles, at least the measure's least spread, so a group whose
  documents are all alike does not reject its own.  A group of fewer than
  ``GROUP_ROWS`` documents takes the sketches of its language, merged from the
  groups', and a small language those of all documents.

Words are runs of characters other than space and U+0009-U+000D.  Null, empty and
blank texts have no word: all counts are 0 and the base rule rejects them.  Null
languages and sources form groups of their own.  Repeated rows count each time.
Other columns are carried along untouched, whatever their names.  A text is one
row: its arrays live in one task while it is measured, nothing is collected.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh

MIN_WORDS = 50
REPEAT_PERCENT = 50
FENCE = 3.0
GROUP_ROWS = 100
#: Size parameter of a sketch: quantile error well under one percent of the ranks.
SKETCH_K = 400
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
#: Measure: (numerator, denominator, least spread).
MEASURES = {
    "word_length": ("word_chars", "n_words", 0.5),
    "symbols": ("n_symbols", "n_words", 0.1),
    "dup_lines": ("n_dup_lines", "n_lines", 0.2),
    "repeats": ("n_repeat_words", "n_words", 0.1),
}


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and the names of its added columns (by name in ``COUNTS``), all long.

    ``word_chars``: code points in words.  ``n_symbols``: characters of
    ``#*$%&|<>``.  ``n_lines``: lines (parted by \\n) that hold a word;
    ``n_dup_lines``: those equal to an earlier line.  ``n_repeat_words``: words in
    3-word windows found twice or more in the text, the first included.
    """
    names = fresh(docs, "_words", "_lines", "_windows", "_again", *(prefix + c for c in COUNTS))
    words, lines, windows, again = names[:4]
    named = dict(zip(COUNTS, names[4:], strict=True))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumns({
        words: F.array_remove(F.split(whole, f"[{SPACE}]+"), ""),
        lines: F.filter(F.split(whole, "\n"), lambda line: line.rlike(f"[^{SPACE}]")),
    })
    last = F.size(words) - F.lit(3)
    w = F.col(words)
    out = out.withColumns({
        named["n_words"]: F.size(words).cast("long"),
        named["word_chars"]: F.length(F.array_join(words, "")).cast("long"),
        named["n_symbols"]: (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
        named["n_lines"]: F.size(lines).cast("long"),
        named["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        # a window's words as one hash, and where it starts, sorted so that equal windows are neighbours
        windows: F.when(last >= 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("at"))))),
    })
    s = F.col(windows)
    repeated = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    out = out.withColumn(again, F.sort_array(F.transform(repeated, lambda x: x["at"])))
    covered = F.aggregate(
        F.col(again), F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
        lambda seen, at: F.struct((seen["total"] + F.least(F.lit(3), at - seen["last"])).alias("total"), at.alias("last")),
        lambda seen: seen["total"],
    )
    out = out.withColumn(named["n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop(words, lines, windows, again), named


def base_failed(named: dict[str, str]) -> Column:
    words, repeats = F.col(named["n_words"]), F.col(named["n_repeat_words"])
    return (words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


def _measure(name: str, named: dict[str, str]) -> Column:
    above, below, _ = MEASURES[name]
    return F.col(named[above]).cast("double") / F.nullif(F.col(named[below]), F.lit(0))


def fences(counted: DataFrame, named: dict[str, str], lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each (``lang``, ``source``): ``<measure>_low`` and ``<measure>_high``, null without any document."""
    passed = ~base_failed(named)
    measures = list(MEASURES)
    own = counted.select(F.col(lang).alias("lang"), F.col(source).alias("source"), passed.alias("passed"), *(F.when(passed, _measure(m, named)).alias(m) for m in measures))
    groups = own.groupBy("lang", "source").agg(F.count_if("passed").alias("rows"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in measures))

    def merged(keys: list[str], mark: str) -> DataFrame:
        return groups.groupBy(*(F.col(k).alias(k + mark) for k in keys)).agg(F.sum("rows").alias("rows" + mark), *(F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m + mark) for m in measures))

    found = groups.join(merged(["lang"], "_l"), F.col("lang").eqNullSafe(F.col("lang_l"))).join(merged([], "_a"), F.lit(True))

    def sketch(m: str) -> Column:
        return F.when(F.col("rows") >= GROUP_ROWS, F.col(m)).when(F.col("rows_l") >= GROUP_ROWS, F.col(m + "_l")).otherwise(F.col(m + "_a"))

    found = found.select("lang", "source", *(sketch(m).alias(m) for m in measures))

    def quantile(m: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(m) > 0, F.kll_sketch_get_quantile_double(m, F.lit(q)))

    found = found.select("lang", "source", *(quantile(m, q).alias(f"{m}_{at}") for m in measures for at, q in (("q1", 0.25), ("q3", 0.75))))
    spread = {m: F.greatest(F.col(f"{m}_q3") - F.col(f"{m}_q1"), F.lit(MEASURES[m][2])) * FENCE for m in measures}
    return found.select("lang", "source", *((F.col(f"{m}_q1") - spread[m]).alias(f"{m}_low") for m in measures), *((F.col(f"{m}_q3") + spread[m]).alias(f"{m}_high") for m in measures))


def judged(counted: DataFrame, named: dict[str, str], limits: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, str, str]:
    """``counted`` with a base verdict and a final verdict; returned with the two columns' names."""
    failed, kept = fresh(counted, "base_failed", "kept")
    mark = "_limit"
    while any(f"{c}{mark}".lower() in {x.lower() for x in counted.columns} for c in limits.columns):
        mark += "_"
    limits = limits.select(*(F.col(c).alias(c + mark) for c in limits.columns))
    inside = F.lit(True)
    for m in MEASURES:
        value = _measure(m, named)
        inside &= F.coalesce((value >= F.col(f"{m}_low{mark}")) & (value <= F.col(f"{m}_high{mark}")), F.lit(True))
    joined = counted.join(limits, F.col(lang).eqNullSafe(F.col("lang" + mark)) & F.col(source).eqNullSafe(F.col("source" + mark)), "left")
    out = joined.withColumn(failed, base_failed(named)).withColumn(kept, ~F.col(failed) & inside)
    return out.drop(*limits.columns), failed, kept


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: ``doc_id``, ``lang``, ``source``, the counts, ``base_failed`` and ``kept``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted, named = with_counts(own)
    counted = counted.drop("text").persist()  # measured once: read for the sketches and again for the verdict
    return judged(counted, named, fences(counted, named))[0]


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that both rules keep, with their own columns."""
    counted, named = with_counts(docs, text, "_q_")
    counted = counted.persist(StorageLevel.DISK_ONLY)  # with whole texts; a lost part is measured again
    out, _, kept = judged(counted, named, fences(counted, named, lang, source), lang, source)
    return out.filter(F.col(kept)).select(*(out[c] for c in docs.columns))
