"""Operators that look across documents: mixing, near-duplicates, decontamination, sharding, repeated strings, pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from framescope.llm import common, components, decontaminate, minhash, mixing, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, Shard long, _row_number int, size int"


def docs(spark, rows):
    """(doc_id, text, source) rows with more columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, None, s, 0, "x", 1, 1, 1) for i, t, s in rows], DOC)


def words(rng, n, many=400):
    return [f"w{rng.randrange(many)}" for _ in range(n)]


# -- running sums and components

def test_ordered_sum_with_a_hot_and_a_null_key(spark):
    from pyspark.sql import functions as F

    rows = [("hot" if k % 3 else None, k, k % 5) for k in range(900)]
    table = spark.createDataFrame(rows, "k string, id long, v long")
    got = common.ordered_sum(table, "k", common.unit_hash(F.col("id")), ["id"], "v", "before", 900).withColumn("at", common.unit_hash(F.col("id"))).collect()
    for key in ("hot", None):
        total = 0
        for r in sorted((r for r in got if r.k == key), key=lambda r: (r.at, r.id)):
            assert r.before == total
            total += r.v
    assert len(got) == 900


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200}


# -- near-duplicates

def brute_components(rows, least_similar=85):
    sets = {}
    for k, (_, t, _) in enumerate(rows):
        w = [x.lower() for x in (t or "").encode().split()]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least_similar * (len(sets[a]) + len(sets[b]) - both):
                label[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[root(k)], rows[k][0] == least[root(k)]) for k in range(len(rows)))


def group_of_copies(rng, n, length):
    base, out = words(rng, length), []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(length)] = rng.choice(["edit", "other", "new"])
        out.append(" ".join(own))
    return out


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(5)
    texts = group_of_copies(rng, 60, 90) + group_of_copies(rng, 30, 40) + [" ".join(words(rng, 50)) for _ in range(40)]
    texts += [None, "", " ", "one", "ONE", "one two three", "a b c d e", "A B c d e", "É x y z w", "é x y z w"]
    rows = [(1000 - k, t, "s") for k, t in enumerate(texts)] + [(7, "the same row here twice", "s")] * 2 + [(None, "a null id stays alone here", "s")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_components(rows)


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(6)
    rows = [(k, t, "s") for k, t in enumerate(group_of_copies(rng, 80, 60))]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == brute_components(rows)


def test_one_of_each_group_is_kept(spark):
    rows = [(3, "a b c d e f", "s"), (2, "A b c d e f", "s"), (5, "else", "s"), (5, "else", "s"), (5, "other text", "s"), (None, None, None), (9, "", "s")]
    table = docs(spark, rows)
    kept = minhash.keep_one(table)
    assert kept.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(2, "A b c d e f"), (5, "else"), (5, "other text"), (None, None), (9, "")])
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_the_pipeline_links_from_80_percent_on(spark):
    import corpus_pipeline

    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = words(rng, 100, 5000)
        edited = list(base)
        for k in rng.sample(range(8, 92), rng.choice([1, 2, 3])):
            edited[k] = "edit"
        texts += [" ".join(base), " ".join(edited)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for t in texts]
    shares = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.8 <= x < 0.85 for x in shares) > 3 and min(shares) < 0.8
    got = corpus_pipeline.near_duplicates(spark, docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), SF)
    want = set(range(0, 80, 2)) | {2 * k + 1 for k, x in enumerate(shares) if x < 0.8}
    assert {r.doc_id for r in got.collect()} == want


def test_signatures_estimate_the_resemblance():
    rng = np.random.default_rng(1)
    for size in (3, 30, 3000):
        agree = []
        for _ in range(60):
            values = np.unique(rng.integers(0, 2**63, size * 2).astype(np.uint64) * np.uint64(2))
            a, b = values[: int(size * 1.5)], values[int(size * 0.5) :]
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - 0.5) < 0.12


# -- mixing

def test_mixture_is_its_sql(spark):
    from tests.compare import connect, differences, kinds

    from framescope.llm import queries

    got = queries.op2_mixing(spark, SF)
    con = connect(SF)
    assert not differences(got, con, mixing.MIXTURE_SQL) + kinds(got, con, mixing.MIXTURE_SQL)


def test_mixture_reaches_its_targets(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(words(rng, rng.randint(1, 60))), rng.choice(["hot", "hot", "hot", "b", "c", "tiny", None])) for k in range(400)]
    rows += [(1, None, "b"), (2, "", "hot"), (3, "three words here", "tiny"), (3, "three words here", "tiny")]
    got = mixing.mixture(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    total, size, target = Counter(), {}, {}
    for r in got:
        total[r.target] += r.taken
        size[r.target], target[r.target] = r.source_size, r.target
    assert all(abs(total[t] - t) <= 1 and t <= 2 * size[t] + 1e-6 for t in total)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all((r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1) for r in got)


def test_the_query_is_in_training_order(spark):
    from framescope.llm import queries

    at = {r.doc_id: r.position for r in mixing.mixture(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    found = [at[r.doc_id] for r in queries.op2_mixing(spark, SF).collect()]
    want = sorted(found, key=lambda p: (p is None, p))
    assert found == want and len({p for p in found if p is not None}) > 100


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    for k, rates in enumerate(mixing.SCHEDULES):
        d = 1 / (len(rates) - 1)

        def area(t):
            total = 0.0
            for j, (a, b) in enumerate(zip(rates, rates[1:])):
                x = min(max(t - j * d, 0), d)
                total += a * x + (b - a) * x * x / (2 * d)
            return total

        parts = [x / 20 for x in range(20)]
        row = spark.range(1).select(*(mixing.demand_inverse(F.lit(p), F.lit(k)).alias(f"t{n}") for n, p in enumerate(parts))).first()
        assert all(abs(area(t) / area(1.0) - p) < 1e-9 for t, p in zip(row, parts))


def test_mixed_documents_repeat_and_keep_columns(spark):
    rows = [(k, f"word number {k}", "a" if k < 4 else "b") for k in range(20)] + [(1, "word number 1", "a"), (None, None, None)]
    table = docs(spark, rows)
    got = mixing.mixed_documents(table)
    taken = Counter((r.doc_id, r.size) for r in mixing.mixture(table).collect())
    assert got.columns == table.columns and taken
    copies = Counter(r.doc_id for r in got.collect())
    assert copies[1] == 4 and copies[None] == 0  # two equal rows, each twice
    assert mixing.mixed_documents(docs(spark, [])).collect() == []


# -- decontamination

def test_leaks_with_substitutions(spark, monkeypatch):
    rng = random.Random(8)
    item = words(rng, 30, 10_000)
    changed = list(item)
    for k in (4, 11, 12, 20, 27):
        changed[k] = "changed"
    rows = [
        (1, " ".join(["before"] * 9 + item + ["after"] * 3), "s"), (2, ", ".join(x.upper() for x in changed), "s"), (3, " ".join(words(rng, 300, 10_000)), "s"),
        (4, " ".join(item[8:20]), "s"), (5, " ".join(item[:6]), "s"), (6, None, None), (7, "", "s"), (None, " ".join(item), "s"), (1, " ".join(item[::-1]), "s"),
        (8, " ".join(item), "s"), (8, " ".join(item), "s"), (9, " ".join(words(rng, 40_000, 10_000) + item), "s"),
    ]
    bench = spark.createDataFrame([(70, " ".join(item), 1), (71, "too short", 1), (72, None, 1), (73, "", 1)], "item_id long, text string, doc_id int")
    table = docs(spark, rows)
    got = decontaminate.leaks(table, bench).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, 4, None, 8, 8, 9]) and {r.item_id for r in got} == {70}
    one = next(r for r in got if r.doc_id == 1)
    assert (one.doc_word, one.item_word, one.n_words, one.n_equal) == (9, 0, 30, 30)
    two = next(r for r in got if r.doc_id == 2)
    assert two.n_equal >= 20
    with monkeypatch.context() as patched:  # nothing is small enough to send: all goes through salted joins
        for name in ("SENT_SEEDS", "SENT_BYTES", "SENT_KEYS", "ITEMS"):
            patched.setattr(decontaminate, name, 1 if name == "ITEMS" else -1)
        assert Counter(decontaminate.leaks(table, bench).collect()) == Counter(got)
        assert Counter(r.doc_id for r in decontaminate.keep_clean(table, bench).collect()) == Counter([3, 5, 6, 7, 1])
    clean = decontaminate.keep_clean(table, bench)
    assert clean.columns == table.columns and Counter(r.doc_id for r in clean.collect()) == Counter([3, 5, 6, 7, 1])
    assert decontaminate.leaks(table, bench.filter("item_id = 0")).collect() == [] and decontaminate.leaks(docs(spark, []), bench).collect() == []


def test_leaks_of_the_tables_are_brute_force(spark):
    table, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: decontaminate.words(r.text) for r in bench.collect()}
    want = set()
    for r in table.collect():
        doc = decontaminate.words(r.text or "")
        for i, item in items.items():
            for shift in range(-len(item) + 10, len(doc) - 9):
                lo, hi = max(0, shift), min(len(doc), shift + len(item))
                if sum(doc[k] == item[k - shift] for k in range(lo, hi)) >= 10:
                    want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == want


@pytest.mark.parametrize("run", [10, 11, 12])
def test_an_exact_run_inside_a_poor_stretch_leaks(spark, run):
    rng = random.Random(run)
    item = words(rng, 130, 10_000)
    doc = [w if k % 7 in (0, 1, 2, 4, 5) or 60 <= k < 60 + run else "other" for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (None, " ".join(item[::-1]))], "item_id long, text string")
    rows = [(1, " ".join(doc), "s"), (2, " ".join(item[60 : 60 + run]), "s"), (3, " ".join(item[60:69]), "s")]
    got = decontaminate.leaks(docs(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (1, 2), (2, 1), (2, 2)])
    assert all(100 * r.n_equal >= 75 * r.n_words and r.n_equal >= run for r in got)


def test_stretches_and_shifts_are_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 60)) < rng.choice([0.5, 0.7, 0.8, 0.95])
        most = max((int(equal[a:b].sum()) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 100 * equal[a:b].sum() >= 75 * (b - a)), default=0)
        got = decontaminate.best_stretch(equal)
        assert (got[2] if got else 0) == (most if most >= 10 else 0)
        if got:
            assert equal[got[0] : got[1]].sum() == got[2] and 100 * got[2] >= 75 * (got[1] - got[0])
        doc, item = (rng.integers(1, rng.choice([2, 3, 9]), rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        want = {a - b for x, y in zip(decontaminate.seeds(doc), decontaminate.seeds(item)) for a in range(len(x)) for b in range(len(y)) if x[a] == y[b]}
        assert set(decontaminate.shifts(doc, item).tolist()) == want


def test_repeated_words_cost_their_length(spark):
    import time

    start = time.time()
    hashes = common.WordHashes()
    item, doc = hashes.of([b"same"] * 300), hashes.of([b"same"] * 200_000)
    assert decontaminate.leak(doc, item)[2:] == (300, 300)
    few = hashes.of([b"same"] * 9 + [b"%d" % k for k in range(100)])
    assert decontaminate.leak(hashes.of([b"same"] * 20_000), few) is None
    assert time.time() - start < 20


# -- sharding

def check_shards(got, rows, shards=16):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[j]) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(by[j]) == list(range(len(by[j]))) for j in by)


def test_groups_stay_together_under_quotas(spark):
    rng = random.Random(9)
    rows = [(k, "hot text", "s") for k in range(300)] + [(1000 + k, f"pair {k // 2}", "s") for k in range(200)] + [(5000 + k, " ".join(words(rng, 5)), "s") for k in range(390)]
    rows += [(None, None, None), (1, None, "s"), (2, "", "s"), (3, "", "s"), (9, "twice", "s"), (9, "twice", "s")]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    check_shards(got, rows)
    where = defaultdict(set)
    for r in got:
        where[r.text_md5].add(r.shard)
    hot = where[hashlib.md5(b"hot text").hexdigest()]
    assert len(hot) <= 9  # of 16; 300 documents need seven shards beside the pairs
    pairs = [where[hashlib.md5(f"pair {k}".encode()).hexdigest()] for k in range(100)]
    assert sum(len(p) > 1 for p in pairs) <= 10
    assert Counter(r.size for r in got)[1] == 4 and sum(r.text_crc32 is None for r in got) == 2


def test_sharded_documents_keep_their_columns(spark):
    rows = [(k // 2, f"text {k // 3}", "s") for k in range(50)] + [(1, "x", "s")] * 3 + [(None, None, None)]
    table = docs(spark, rows)
    got = sharding.sharded(table)
    assert got.columns == [*table.columns, "shard_", "slot"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t, _ in rows)
    assert sharding.shard_documents(docs(spark, [])).collect() == []


# -- repeated strings

def brute_repeats(rows):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    n = suffix_dedup.LENGTH
    seen = Counter(t[k : k + n] for _, t in data for k in range(len(t) - n + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((i, len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return Counter(out)


def passages(rng, n):
    shared = [" ".join(words(rng, 60, 5000)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [" ".join(words(rng, rng.randint(0, 60), 5000)) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.randint(0, 40) : -rng.randint(1, 40)])
        out.append("é".join(parts))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 3])
def test_repeats_are_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(10)
    texts = passages(rng, 40) + ["a" * 450, "a" * 150 + "b" * 300, "ab" * 180, "x" * 199, "short", "", None]
    loop = " ".join(words(rng, 50, 5000))
    texts += [loop * 3, "copy " + loop * 2, loop[:250] + "y" + loop[:250], "lead " + loop[50:]]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(2, texts[0], "s"), (None, texts[5], "s"), (8, loop * 3, None), (8, loop * 3, None)]
    got = suffix_dedup.without_repeats(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows)


def test_no_task_gathers_the_contexts_of_a_common_window(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    gathered, sort, count = [], suffix_dedup._sorted_repeats, getattr(suffix_dedup, "_counted_repeats", None)

    def largest(made, *key):
        return made.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def sorting(texts):
        gathered.append(largest(texts, *(c for c in ("seed", "salt") if c in texts.columns)))
        return sort(texts)

    def counting(windows):
        gathered.append(largest(windows, "seed", "before", "window", "part"))
        assert largest(windows, "seed", "before", "window") == 60 and "data" not in windows.columns
        return count(windows)

    monkeypatch.setattr(suffix_dedup, "_sorted_repeats", sorting)
    monkeypatch.setattr(suffix_dedup, "_counted_repeats", counting, raising=False)
    rng = random.Random(13)
    passage = " ".join(words(rng, 80, 5000))
    rows = [(k, " ".join(words(rng, 40, 5000) + [passage] + words(rng, 40, 5000)), "s") for k in range(60)]
    got = suffix_dedup.without_repeats(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows)
    assert max(gathered) <= 4 * 3


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.without_repeats(docs(spark, [])).collect() == []


def test_suffix_arrays():
    rng = random.Random(11)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


# -- pipeline

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_counts

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs_.columns
    rows = {r.doc_id: r for r in docs_.collect()}
    good = corpus_pipeline.STAGES[0][1](spark, docs_, SF).cache()
    failed = {i for i, r in rows.items() for n, _, _, _, _, again in [brute_counts(r.text)] if n < 50 or 100 * again > 50 * n}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and not kept & failed
    one = corpus_pipeline.STAGES[1][1](spark, good, SF).cache()
    want = {i for i, _, _, k in brute_components([(i, rows[i].text, None) for i in sorted(kept)], 80) if k}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want
    clean = corpus_pipeline.STAGES[2][1](spark, one, SF).cache()
    leaking = {r.doc_id for r in decontaminate.leaks(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want - leaking
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, SF).cache()
    taken = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mixture(clean).collect() if r.size}
    got = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and got == Counter({i: k for i, k in taken.items() if k})
    placed = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    check_shards(placed, list(mixed.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 0


def test_only_what_contexts_share_around_a_seed_is_sorted(monkeypatch):
    sorted_symbols, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sorted_symbols.append(len(text)) or sort(text))
    rng = np.random.default_rng(5)
    seed, length = rng.bytes(suffix_dedup.GRAM), suffix_dedup.LENGTH

    def context(left: bytes, right: bytes) -> tuple[bytes, int, int]:
        return left + seed + right, len(left), length - len(seed) - len(right)

    # 20 bytes on either side of the seed are shared: too few for a window
    near = [rng.bytes(20), rng.bytes(20)]
    apart = [context(rng.bytes(80) + near[0], near[1] + rng.bytes(80)) for _ in range(2)]
    assert not any(flags.any() for flags in suffix_dedup.repeated_windows([apart])[0]) and not sorted_symbols
    # 90 and 70 bytes are shared: 25 windows, where the third context has 15 of them
    left, right = rng.bytes(90), rng.bytes(70)
    group = [context(b"a" * 10 + left, right + b"b" * 20), context(b"c" * 5 + left, right + b"d" * 3), context(b"e" * 30 + left[10:], right)]
    found = suffix_dedup.repeated_windows([group])[0]
    for (data, own_left, own_last), flags in zip(group, found, strict=True):
        others = [d for d, _, _ in group if d != data]
        windows = [data[own_left - k : own_left - k + length] for k in range(own_left, own_last - 1, -1)]
        assert flags.tolist() == [any(w in d for d in others) for w in windows]
    assert [int(f.sum()) for f in found] == [25, 25, 15]
