import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from captionlake.llm import substring_dedup as sd


def brute(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80, 200)]
    texts = [None, "", " \n ", "short text", "Same " * 80, "same " * 80, " ".join(passages[3])]
    for _ in range(60):
        w = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            w += p[a : len(p) - rng.randrange(len(p) // 4)]
            w += [word() for _ in range(rng.randrange(40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return texts + rng.sample(texts, 10)


@pytest.mark.parametrize("window,seed,crowd", [(35, 1, 4096), (12, 2, 4096), (35, 3, 3), (12, 4, 0)])
def test_removed_words_are_those_of_all_windows(spark, monkeypatch, window, seed, crowd):
    """Also where anchors count as crowded from a few different blocks on, and their windows are counted instead."""
    monkeypatch.setattr(sd, "CROWD", crowd)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, lo int, s string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.digest(docs, window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_text_is_cut(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"a  b {passage} c", 99), (2, f"{passage} d", 99), (3, "x  y", 99), (None, None, 99)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in sd.remove(docs).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[2].text, rows[3].text, rows[None].text) == ("a b c", 5, "d", "x  y", None)


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(f"p{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "q " * 3)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in sd.digest(docs).collect()) == [(3, 0), (50, 50), (50, 50)]
    assert sd.digest(docs.limit(0)).count() == 0


def test_factors_are_greedy_longest_matches():
    """parse() against a plain greedy parse of blocks of one anchor."""
    import pyarrow as pa

    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    blocks = []  # (words before the anchor, words); the anchor is base[30:33], and windows of 8 words hold it
    for _ in range(40):
        a, b = rng.randrange(25, 31), rng.randrange(33, 39)
        w = base[a:b]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            if not 30 <= a + k < 33:
                w[k] = f"x{rng.randrange(4)}"
        if len(w) >= 8 and (30 - a, w) not in blocks:
            blocks.append((30 - a, w))
    window, want = 8, []
    for x, (lead, w) in enumerate(blocks):
        i = 0
        while i + window <= len(w):
            best = 0
            for y, (other, v) in enumerate(blocks):
                j = i - lead + other
                n = 0
                while x != y and 0 <= j and i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                best = max(best, n)
            if best >= window:
                want.append((x, i, i + best))
            i += best - window + 1 if best >= window else 1
    got = sd.parse(np.zeros(len(blocks), np.int64), np.array([x for x, _ in blocks]), pa.array([" ".join(w).encode() for _, w in blocks], pa.binary()), window)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want) and max(e - b for _, b, e in want) > window


def test_smallest_is_the_first_of_each_stretch():
    h = np.array([5, 3, 3, 9, 1, 1, 7, 2], dtype=np.uint64)
    for width in range(1, 9):
        assert sd.smallest(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]
