"""Operators on statistics of the whole corpus: whitening, language-model scoring, source divergence."""

import numpy as np
import pytest
from framescope.llm import divergence, queries, whitening

SF = "/root/testdata/sf0.001"


# -- whitening

def brute_whitening(rows):
    """n x - S exactly, eigenvalues and directions of the covariance, by NumPy."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in rows]
    n = len(x)
    sums = [sum(column) for column in zip(*x, strict=True)]
    apart = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array(apart, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    return [sum(a * a for a in r) for r in apart], centred, values[order], vectors[:, order]


def check_whitening(found, rows, components=8):
    deviation, centred, values, vectors = brute_whitening([v for _, v in rows])
    many = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(found) == len(rows) * many
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, {})[r.vec_id] = r
    for k in range(1, many + 1):
        got = by_component[k]
        w = np.array([got[i].whitened for i, _ in rows])
        want = centred @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-6
        assert [got[i].deviation for i, _ in rows] == [d if d < 1 << 63 else None for d in deviation]
        assert all(r.n == len(rows) and abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in got.values())


def test_whitening_query_against_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(found.collect(), rows)


@pytest.mark.parametrize("kind", ["long scales", "dependent", "constant", "few", "huge"])
def test_whitening_of_bad_shapes(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 6))
    if kind == "long scales":
        v *= [1e4, 1e3, 1e2, 10, 1, 0.1]
    elif kind == "dependent":
        v[:, 3] = v[:, 1]
        v = np.round(v * 1024) / 1024
    elif kind == "constant":
        v[:, [0, 4]] = 3.25
    elif kind == "few":
        v = v[:3]
    else:
        v[0] *= 1e9
    rows = [(k, list(map(float, r))) for k, r in enumerate(v)]
    table = spark.createDataFrame([(i, r, 1, 1) for i, r in rows], "vec_id long, embedding array<double>, n int, component int")
    found = whitening.whiten(table.repartition(5)).collect()
    if kind == "huge":
        assert {r.deviation for r in found if r.vec_id == 0} == {None} and all(r.identity_error < 1e-6 for r in found)
        return
    check_whitening(found, rows)


def test_whitening_drops_what_it_cannot_use(spark):
    rng = np.random.default_rng(6)
    good = [(k, list(map(float, rng.normal(size=4)))) for k in range(40)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 30
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [1.0, float("inf"), 0.0, 0.0]), (104, [1.0]), (105, []), (106, [0.0] * 5)]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    found = whitening.whiten(table).collect()
    assert len(found) == 4 * len(good) and {r.n for r in found} == {len(good)}
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


# -- source divergence

def brute_divergence(rows, min_df=3, top=200):
    import re
    from collections import Counter, defaultdict

    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, total, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in pattern.findall(text or "")]
        groups.add((lang, source))
        df[lang].update(set(words))
        total[lang].update(words)
        counts[lang, source].update(words)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        p = {}
        for name, c in [(s, counts[lang, s]) for g, s in groups if g == lang] + [(None, total[lang])]:
            size = sum(c[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (c[t] + 1) // (size + len(kept)) for t in kept}
        own = p[source]
        pairs = [(-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), name.encode(), name) for name, q in p.items() if name not in (None, source)]
        terms = [(-((own[t] - p[None][t]) ** 2 // p[None][t]), t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > p[None][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)}
    return out


def test_divergence_of_odd_tables(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):
        words = [f"{'Ab' if w % 3 else 'é'}{'xyz'[w % 3]}{chr(97 + w // 3)}" for w in rng.zipf(1.5, size=30) % 40]
        rows.append((" ".join(words) + "\n\tDon't 42 ÀÉ ß", ["en", "fr", None][k % 3], ["hot", "hot", "b", None, "c\x01d"][k % 5]))
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("one two", "xx", "b"), ("word " * 40_000, "en", "b")] + [("same text here", "en", "b")] * 4
    table = spark.createDataFrame([(t, lang, s, "x", 1, 2) for t, lang, s in rows], "text string, lang string, source string, term string, count int, rank int").repartition(7)
    monkeypatch.setattr(divergence, "HELD_BYTES", 2_000)
    found = divergence.divergences(table, top=25).collect()
    assert {tuple(r) for r in found} == brute_divergence(rows, top=25) and len(found) == len({tuple(r) for r in found})


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


# -- language-model scoring

def tokens_of(text):
    import re

    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def brute_scores(rows, order=2, discount=0.75):
    """(id, held out) -> the contract's base numbers and the interpolated model's score, with plain dictionaries."""
    from collections import Counter, defaultdict
    from math import log10

    words = Counter(w for _, t, out in rows if not out for w in tokens_of(t))
    total, kinds = sum(words.values()), len(words)
    counts = [defaultdict(Counter) for _ in range(order + 1)]

    def context(found, at, level):
        return tuple(found[j] if j >= 0 else "start" for j in range(at - level + 1, at))

    for _, t, out in rows:
        found = tokens_of(t)
        for at, w in enumerate(found):
            for level in range(2, order + 1):
                counts[level][context(found, at, level)][w] += not out
    result = []
    for i, t, out in rows:
        found, base, model = tokens_of(t), 0.0, 0.0
        for at, w in enumerate(found):
            p = (words[w] + 1) / (total + kinds + 1)
            base += log10(p)
            for level in range(2, order + 1):
                after = counts[level][context(found, at, level)]
                many = sum(after.values())
                if many:
                    p = max(after[w] - discount, 0) / many + discount * sum(c > 0 for c in after.values()) / many * p
            model += log10(p)
        result.append((i, out, len(found), sum(words[w] > 0 for w in found), total, base, model))
    return result


def check_scores(found, rows, order=2):
    found = sorted((tuple(r) for r in found), key=lambda r: (repr(r[0]), r[2], r[5]))
    want = sorted(brute_scores(rows, order), key=lambda r: (repr(r[0]), r[2], r[5]))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5] == pytest.approx(b[5], abs=1e-6) and abs(a[6] - b[6]) <= 3e-4 * b[2] + 1e-6


def test_scores_of_the_query_against_dictionaries(spark):
    import zlib

    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.QUERIES["op12_lm_scoring"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = found.collect()
    check_scores(found, rows, 3)
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_the_query_learns_more_than_pairs_of_words(spark, tmp_path):
    # after "a b" always c, after "x b" always d: pairs alone cannot tell them apart
    rows = [(k, "a b c" if k % 2 else "x b d") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    flagged = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    found = queries.QUERIES["op12_lm_scoring"](spark, str(tmp_path)).collect()
    check_scores(found, flagged, 3)
    pairs = {r[0]: r[6] for r in brute_scores(flagged, 2)}
    assert all(r.score > pairs[r.doc_id] + 0.2 for r in found)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_with_many_slices_and_a_hot_context(spark, monkeypatch, order):
    from framescope.llm import language_model
    from pyspark.sql import functions as F

    rng = np.random.default_rng(order)
    rows = []
    for k in range(120):
        words = [w for n in rng.zipf(1.4, size=40) % 300 for w in ("the", f"W{n}É")]
        rows.append((k % 50, " ".join(words), k % 6 == 0))
    rows += [(None, None, False), (500, "", True), (501, " \t\n", False), (502, "Never seen BEFORE", True), (503, "the end " * 9_000, False)] + [(7, "the same text again", False)] * 5
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(language_model, "SLICE_ROWS", 256)
    table = spark.createDataFrame([(i, t, out, "x", 1) for i, t, out in rows], "doc_id long, text string, out boolean, block string, slice int").repartition(3)
    check_scores(language_model.score(table, F.col("out"), order=order).collect(), rows, order)


def test_scores_without_training_and_without_rows(spark):
    from framescope.llm import language_model
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in language_model.score(table, F.lit(True)).collect()) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert language_model.score(table.filter("doc_id > 5"), F.lit(None).cast("boolean")).collect() == []


def test_blocks_are_stored_and_moved_in_few_bytes():
    from framescope.llm import language_model

    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 2**64 - 1, 3_000, dtype=np.uint64))
    tokens = np.minimum(rng.zipf(1.3, 60_000), len(words)) - 1
    block = language_model.Block(words, tokens, np.array([40_000, 20_000]), np.repeat([True, False], [40_000, 20_000]))
    own, packed = block.stored()
    assert len(packed) < 2 * len(tokens)  # four bytes a token before
    row = {"sizes": [40_000, 20_000], "held_out": [False, True], "words": language_model._packed(language_model._steps(own)), "tokens": packed}
    back = language_model.Block.read(row)
    assert (back.words == words).all() and (back.tokens == tokens).all() and (back.trained == block.trained).all()
    order = np.argsort(own[:1000])
    common = language_model.Common(own[:1000][order], order.astype(np.uint64))
    codes = common.codes(words)
    assert len(np.unique(codes)) == len(words) and sorted(codes)[:1000] == list(range(1000)) and sorted(codes)[1000] >= language_model.RANKED
    grams = block.grams(3, common)
    assert (np.diff(grams.keys().astype(object)) >= 0).mean() > 0.99 and grams.counts.sum() == 40_000
    for values in (np.zeros(0, "<u4"), np.array([7], "<i8"), rng.integers(0, 2**16, 999).astype("<u2")):
        assert (language_model._unpacked(language_model._packed(values), values.dtype.str) == values).all()


def test_levels_in_a_mapped_file(tmp_path):
    import mmap

    from framescope.llm.elias_fano import Level, Rising

    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64))
    sizes = rng.geometric(0.1, len(contexts))
    codes = np.concatenate([np.sort(rng.choice(2**32, n, replace=False)) for n in sizes]).astype(np.uint64)
    (tmp_path / "level").write_bytes(Level.of(contexts, sizes, codes, np.arange(len(contexts)), np.arange(len(codes)) % 60_000).image())
    with open(tmp_path / "level", "rb") as file:
        level = Level.opened(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    numbers = level.context(np.repeat(contexts, sizes))
    assert (numbers == np.repeat(np.arange(len(contexts)), sizes)).all() and (level.successor(numbers, codes) == np.arange(len(codes))).all()
    assert (level.context(contexts + np.uint64(1)) == -1).all() and (level.successor(numbers, codes ^ np.uint64(1 << 31)) == -1).mean() > 0.99
    for values in ([], [0], [5, 5, 5], [2**64 - 1], list(range(300))):
        rising = Rising.of(np.array(values, np.uint64))
        assert rising.get(np.arange(len(values))).tolist() == values and all(values[k] == v for k, v in zip(rising.find(np.array(values, np.uint64)), values, strict=True))
