import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from captionlake.llm import jaccard_join as jj
from captionlake.llm.common import Scratch, mix


def brute(texts, percent, words):
    sets = {}
    for i, t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    out = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "two words"), (5, " \n")]
    bases = [[rng.choice(vocab) for _ in range(size)] for size in (12, 14, 22, 25, 31, 33, 44, 60, 95, 150, 400)]
    while len(out) < n:
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5, 8))):
            k = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[k] = rng.choice(vocab)
            else:
                w[k:k] = [rng.choice(vocab)]
        if rng.random() < 0.2:
            w += rng.choice(bases)
        out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("percent,words,seed,common", [(90, 3, 1, 4), (80, 5, 2, 1), (80, 1, 3, 1), (55, 2, 4, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent, words, seed, common):
    """With common at 1 every counter over the mean is taken as common, and its elements are listed directly."""
    monkeypatch.setattr(jj, "COMMON", common)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, node int, n int, key int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(docs, percent, words).collect()}
    assert got == brute(texts, percent, words)


@given(st.integers(1, 60), st.integers(0, 14), st.integers(0, 10**6), st.sampled_from([60, 80, 90]))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_subset_and_have_near_sketches(n, changes, seed, percent):
    rng = np.random.default_rng(seed)
    pool = np.unique(mix(rng.integers(0, 2**62, n + changes + 5).astype(np.uint64)))
    a, cut = pool[:n], rng.integers(0, changes + 1)
    b = np.sort(np.concatenate([a[cut:], pool[n : n + changes - cut]]))
    t = jj.Threshold(percent)
    both = len(np.intersect1d(a, b))
    if len(b) and t.linked(both, len(a), len(b)):
        if max(jj.subsets(len(x), t) for x in (a, b)) <= jj.MOST_SUBSETS:
            assert len(np.intersect1d(*(jj.subset_keys(x, t.drops(len(x))) for x in (a, b))))
        size = min(len(jj.sketch(a)), len(jj.sketch(b)))
        x, y = (jj.folded(np.frombuffer(jj.sketch(s), np.uint8), size) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * both <= t.apart(min(len(a), len(b)))


def test_boundary_is_where_all_sets_cost_least():
    t = jj.Threshold(90)
    assert jj.boundary({15: 100, 60: 5}, 2.0, t) > 15  # 16 subsets against 15 elements and two lists of 2
    assert jj.boundary({15: 100, 25: 100}, 2.0, t) in range(16, 26) and jj.boundary({25: 100}, 500.0, t) > 25
    assert jj.subsets(30, jj.Threshold(80)) > jj.MOST_SUBSETS


def test_both_sides_are_in_use_on_the_test_tables(spark):
    """Sets on each side of the boundary that the costs give, at both thresholds that are used."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for percent, words in ((90, 3), (80, 5)):
        t, scratch = jj.Threshold(percent), Scratch(spark)
        surveyed = scratch.table(jj.survey(docs, words, docs.count()), "sets")
        _, elements, sizes, length = jj.statistics(surveyed)
        below = jj.boundary(sizes, length, t)
        assert elements > 100_000 and t.drops(below - 1) >= 1
        light = surveyed.where(f"kind = 0 AND n > 0 AND n < {below}")
        assert [r.n for r in light.collect() if t.drops(r.n)], "no small set lacks an element"
        assert jj.subset_lists(surveyed, t, below).count() > light.count()
        assert surveyed.where(f"kind = 0 AND n >= {below}").count() > 100
        scratch.release()


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (None, ""), (9, text + " x")], "doc_id long, text string")
    rows = jj.join(docs, 90, 3).collect()
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.n_shingles) == [(38, 7)] * 3 + [(39, 7)]
    assert jj.join(docs.limit(0), 90, 3).count() == 0
    assert sorted(r.doc_id or -1 for r in jj.keep_one(docs, 90, 3).collect()) in ([-1, -1, 7], [-1, 7])


def test_one_row_of_each_component_stays(spark):
    base = [f"w{k}" for k in range(200)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (20, 90, 150)]
    docs = spark.createDataFrame([(4, near[0]), (4, near[1]), (9, near[2]), (None, near[2]), (5, "alone in the world"), (5, "alone in the world"), (6, None), (None, "")], "doc_id long, text string")
    kept = sorted(((r.doc_id or -1), r.text or "") for r in jj.keep_one(docs).collect())
    assert [i for i, _ in kept] == [-1, 4, 5, 6]
