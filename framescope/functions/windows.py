"""Order-dependent building blocks that stay parallel inside one large group.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here large keys
are cut into range buckets at splitters sampled from the rows, about one for every
``BUCKET_ROWS`` rows, so their number follows the input: each bucket is scanned on
its own and only one carry row per bucket crosses over.  Keys without a splitter
are small and stay whole; their rows are shuffled once.  It is one lazy plan for
groups of any size; nothing runs while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket on average; a setting for tests, results do not depend on it.
BUCKET_ROWS_CONF = "spark.framescope.bucketRows"
BUCKET_ROWS = 250_000
#: Splitters that a row is held against at once.
LISTED = 32
GROUP_LIMIT_ROWS = 900


def bucket_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BUCKET_ROWS_CONF, str(BUCKET_ROWS)))


def _aggregate(kind: str, value: Column, order: Column | None = None) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "last":
        return F.last(value) if order is None else F.max_by(value, order)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(before, F.lit(0)) + here
    if kind == "max":
        return F.greatest(before, here)
    return F.coalesce(here, before)


def _same_key(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{prefix}{n}"))
    return same


def _not_above(splitters: str, key: Column) -> Column:
    """How many splitters are not above a row, by binary search in as many steps as their number asks for; NULL without a list."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(splitters) + 1)).cast("int"), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    found = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(F.get(F.col(splitters), pos + step - 1) <= key, pos + step).otherwise(pos))
    return F.when(F.col(splitters).isNotNull(), found)


def with_range_bucket(df: DataFrame, keys: list[str], order: list[str], name: str = "__b") -> DataFrame:
    """Number each row's bucket among the splitters of its key, -1 for keys without any.

    The splitters are the rows whose hash falls on one value in ``bucket_rows``, so
    the choice depends on the data alone.  A row meets those of its own key only, and
    of them every ``LISTED``-th and then the few behind the one it reached: a row that
    carried them all would grow with the input.
    """
    key = F.struct(*order)
    chosen = F.pmod(F.xxhash64(*keys, *order), F.lit(bucket_rows(df))) == 0
    own = [F.col(k).alias(f"__s{n}") for n, k in enumerate(keys)]
    listed = df.filter(chosen).groupBy(*own).agg(F.array_sort(F.collect_set(key)).alias("__all")).filter(F.size("__all") > 0)
    # as few rows as there are splitters; the shuffle keeps the choosing out of the broadcast's time
    listed = listed.repartition(1)
    names = [f"__s{n}" for n in range(len(keys))]
    coarse = listed.select(*names, F.filter("__all", lambda _, at: at % LISTED == 0).alias("__coarse"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / LISTED).cast("int")), lambda k: F.slice("__all", k * LISTED + 1, LISTED))
    fine = listed.select(*[F.col(n).alias(f"__f{n[3:]}") for n in names], F.posexplode(parts).alias("__at", "__fine"))
    reached = df.join(F.broadcast(coarse), _same_key(keys, "__s"), "left").select(*df.columns, (_not_above("__coarse", key) - 1).alias("__part"))
    inside = reached.join(F.broadcast(fine), _same_key(keys, "__f") & (F.col("__part") == F.col("__at")), "left")
    bucket = F.when(F.col("__part").isNull(), F.lit(-1)).otherwise(F.coalesce(F.col("__part") * LISTED + _not_above("__fine", key), F.lit(0)))
    return inside.select(*df.columns, bucket.alias(name))


def _behind_buckets(cut: DataFrame, keys: list[str], order: list[str], ahead: dict[str, tuple[int, Column]]) -> DataFrame:
    """For each bucket of the cut keys, the values of the rows right behind it.

    They are among the first rows of later buckets, as many of each as the longest look ahead.
    """
    most = max(k for k, _ in ahead.values())
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    fronts = cut.select(*keys, "__b", *[v.alias(f"__v_{n}") for n, (_, v) in ahead.items()], place.alias("__n")).filter(F.col("__n") <= most)
    along = Window.partitionBy(*keys).orderBy("__b", "__n")
    found = fronts.select(
        *[F.col(k).alias(f"__d{n}") for n, k in enumerate(keys)],
        F.col("__b").alias("__db"),
        F.lead("__b").over(along).alias("__next"),
        *[F.collect_list(F.struct(F.col(f"__v_{n}").alias("value"))).over(along.rowsBetween(1, most)).alias(f"__behind_{n}") for n in ahead],
    )
    return found.filter(~F.col("__db").eqNullSafe(F.col("__next"))).drop("__next")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    prefix: dict[str, tuple[str, Column | None]] | None = None,
    totals: dict[str, tuple[str, Column | None]] | None = None,
    bounded: bool = False,
    ahead: dict[str, tuple[int, Column]] | None = None,
) -> DataFrame:
    """Add aggregates over the rows *before* each row, and over its whole group.

    ``prefix`` maps a new column to ``(kind, value)`` with kind count, sum, max
    or last; ``totals`` likewise for the whole group.  ``ahead`` maps one to
    ``(k, value)``: the sum over the row and the ``k`` rows after it.  ``order`` is
    ascending and must be total inside a group; NULL is a key like any other.

    ``bounded``: the caller knows that a group fits in a task whatever the input
    (it came out of one row, say); then one plain window does, and the rows are
    neither sampled nor joined.
    """
    prefix, totals, ahead = prefix or {}, totals or {}, ahead or {}
    order_names = [o if isinstance(o, str) else f"__o{n}" for n, o in enumerate(order)]
    values = {name: F.lit(1) if value is None else value for name, (_, value) in {**prefix, **totals}.items()}
    work = df.select("*", *[o.alias(n) for o, n in zip(order, order_names) if not isinstance(o, str)])
    output = [F.col(c) for c in df.columns]

    def prefix_over(window):
        found = {n: _aggregate(kind, values[n]).over(window) for n, (kind, _) in prefix.items()}
        # The sum of no rows is zero; the maximum and last of no rows stay NULL.
        return [F.coalesce(c, F.lit(0)) if prefix[n][0] == "sum" else c for n, c in found.items()]

    if bounded:
        whole = Window.partitionBy(*keys)
        found = prefix_over(whole.orderBy(*order_names).rowsBetween(Window.unboundedPreceding, -1))
        found += [F.sum(value).over(whole.orderBy(*order_names).rowsBetween(0, k)) for k, value in ahead.values()]
        every = [_aggregate(kind, values[n], F.struct(*order_names)).over(whole).alias(n) for n, (kind, _) in totals.items()]
        return work.select(*output, *[c.alias(n) for n, c in zip([*prefix, *ahead], found)], *every)

    # a key with a splitter is cut into buckets; what came before is added to each.  Other keys are one bucket.
    order_key = F.struct(*order_names)
    bucketed = with_range_bucket(work, keys, order_names)
    per_bucket = bucketed.filter("__b >= 0").groupBy(*keys, "__b").agg(
        *[_aggregate(kind, values[n], order_key).alias(f"__c_{n}") for n, (kind, _) in {**prefix, **totals}.items()],
    )
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)

    def carry(kind: str, column: str) -> Column:
        value = F.col(column)
        if kind in ("count", "sum"):
            return F.sum(value).over(across)
        return (F.max(value) if kind == "max" else F.last(value)).over(across)

    def whole_total(kind: str, column: str) -> Column:
        return (F.max if kind == "max" else F.sum)(F.col(column)).over(Window.partitionBy(*keys))

    carries = per_bucket.select(
        *[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)],
        F.col("__b").alias("__cb"),
        *[carry(kind, f"__c_{n}").alias(f"__carry_{n}") for n, (kind, _) in prefix.items()],
        *[whole_total(kind, f"__c_{n}").alias(f"__whole_{n}") for n, (kind, _) in totals.items()],
    )
    whole = Window.partitionBy(*keys, "__b")
    inside = whole.orderBy(*order_names).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select(
        *output, "__b", *[c.alias(f"__here_{n}") for n, c in zip(prefix, prefix_over(inside))],
        *[_aggregate(kind, values[n], order_key).over(whole).alias(f"__own_{n}") for n, (kind, _) in totals.items()],
        *[F.sum(value).over(whole.orderBy(*order_names).rowsBetween(0, k)).alias(f"__near_{n}") for n, (k, value) in ahead.items()],
        *[(F.lit(k) - F.count(F.lit(1)).over(whole.orderBy(*order_names).rowsBetween(1, k))).cast("int").alias(f"__short_{n}") for n, (k, _) in ahead.items()],
    )
    # as few rows as there are buckets of cut keys
    joined = local.join(F.broadcast(carries.repartition(1)), (F.col("__b") == F.col("__cb")) & _same_key(keys, "__k"), "left")
    if ahead:
        behind = _behind_buckets(bucketed.filter("__b >= 0"), keys, order_names, ahead)
        joined = joined.join(F.broadcast(behind.repartition(1)), (F.col("__b") == F.col("__db")) & _same_key(keys, "__d"), "left")

    def reached(n: str) -> Column:
        more = F.aggregate(
            F.slice(f"__behind_{n}", 1, F.col(f"__short_{n}")), F.lit(None).cast(joined.schema[f"__near_{n}"].dataType),
            lambda found, row: F.coalesce(found + row["value"], found, row["value"]),
        )
        return F.coalesce(F.col(f"__near_{n}") + more, F.col(f"__near_{n}"), more)

    return joined.select(
        *output,
        *[_combine(kind, F.col(f"__carry_{n}"), F.col(f"__here_{n}")).alias(n) for n, (kind, _) in prefix.items()],
        *[F.coalesce(f"__whole_{n}", f"__own_{n}").alias(n) for n in totals],
        *[reached(n).alias(n) for n in ahead],
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "row_pos") -> DataFrame:
    """Zero-based position of each row inside its group."""
    return running(df, keys, order, {name: ("count", None)})


def page(df: DataFrame, keys: list[str], order: list[Column | str], start: int, limit: int, name: str = "row_pos") -> DataFrame:
    """Rows ``start .. start+limit-1`` of every group in the given order.

    Shallow pages rank with a row-number filter, which Spark evaluates as a
    bounded per-task top-k before the shuffle; deep pages use ``numbered``.
    """
    if start < 0 or limit <= 0:
        raise ValueError("start must be >= 0 and limit > 0")
    stop = start + limit
    if keys and stop <= GROUP_LIMIT_ROWS:
        ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter((F.col(name) <= stop) & (F.col(name) > start)).withColumn(
            name, (F.col(name) - 1).cast("long")
        )
    positions = numbered(df, keys, order, name)
    return positions.filter((F.col(name) >= start) & (F.col(name) < stop))


def global_page(df: DataFrame, order: list[Column | str], start: int, limit: int) -> DataFrame:
    """One page of the whole input: a bounded top-k when shallow, positions when deep."""
    if start + limit <= GROUP_LIMIT_ROWS:
        return df.orderBy(*order).offset(start).limit(limit)
    return page(df, [], order, start, limit).drop("row_pos")


RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SPLIT_FRACTIONS = [k / 64 for k in range(1, 64)]


def rank_stats(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Nearest-rank p50/p95/p99, max, mean and count of the non-null values per key.

    The rank of ``q`` is ``round((n-1)*q)`` with halves up and no interpolation.
    Values are first counted per (key, value), so repeated values cost one row;
    every key is cut at approximate quantiles of its distinct values and only the
    pieces that hold a wanted rank are ordered.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    summary = counted.groupBy(*keys).agg(
        F.sum("__c").alias("valid"),
        F.max("__v").alias("max"),
        (F.sum(F.col("__v").cast("double") * F.col("__c")) / F.sum("__c")).alias("mean"),
        F.percentile_approx("__v", SPLIT_FRACTIONS, 1000).alias("__cuts"),
    )
    targets = {name: F.round((F.col("valid") - 1) * F.lit(q)).cast("long") for name, q in RANKS.items()}
    pieces = counted.join(
        summary.select(*keys, "__cuts", *[t.alias(f"__t_{n}") for n, t in targets.items()]), keys
    ).withColumn("__piece", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))))
    sizes = pieces.groupBy(*keys, "__piece").agg(
        F.sum("__c").alias("__size"), *[F.first(f"__t_{n}").alias(f"__t_{n}") for n in RANKS]
    )
    before = F.coalesce(
        F.sum("__size").over(
            Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    wanted = F.lit(False)
    for name in RANKS:
        wanted = wanted | ((F.col(f"__t_{name}") >= F.col("__before")) & (F.col(f"__t_{name}") < F.col("__before") + F.col("__size")))
    kept = sizes.withColumn("__before", before).filter(wanted).select(*keys, "__piece", "__before")
    inside = Window.partitionBy(*keys, "__piece").orderBy("__v")
    reached = F.col("__before") + F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.join(kept, [*keys, "__piece"]).withColumn("__stop", reached)
    hit = {
        name: F.max(F.when((F.col(f"__t_{name}") < F.col("__stop")) & (F.col(f"__t_{name}") >= F.col("__stop") - F.col("__c")), F.col("__v")))
        for name in RANKS
    }
    ranks = placed.groupBy(*keys).agg(*[h.alias(n) for n, h in hit.items()])
    return summary.join(ranks, keys).select(*keys, "valid", *RANKS, "max", "mean")
