"""Retiming by emissions against one plain loop over the lines of a file."""

import numpy as np
import pytest

from captionlake.operators import align
from captionlake.plans import retime
from captionlake.sources.work import Work

VOCABULARY = {c: k for k, c in enumerate("abcdef", 1)}


def random_emission(rng, frames, said=""):
    e = rng.dirichlet(np.ones(len(VOCABULARY) + 1) * 0.3, frames)
    for k, c in enumerate(said):
        at = k * frames // max(1, len(said))
        e[at] = 0.01
        e[at, VOCABULARY[c]] = 0.94
    return np.log(e + 1e-9)


@pytest.mark.parametrize("seed", range(12))
def test_padded_scores_equal_single_ones(seed):
    rng = np.random.default_rng(seed)
    e = random_emission(rng, int(rng.integers(1, 30)))
    lines = [rng.integers(0, 7, int(n)) for n in rng.integers(0, 12, 15)] + [np.arange(1, 7).repeat(6)]
    want = [align.path_score(align.backtrack(align.trellis(e, list(x)), e, list(x))) if 0 < len(x) <= len(e) else -np.inf for x in lines]
    assert np.allclose(retime.scores(e, lines), want) and np.allclose(retime.scores(e, lines, cells=50), want)


def plain_retime(lines, heard, look_back=5.0, window=120.0, threshold=-5.0):
    out, offset = [], 0.0
    for n, (seg, start, end, text) in enumerate(lines):
        tokens = align.alignable(text or "", VOCABULARY)[1]
        begin = 0.0 if n == 0 else max(0.0, start + offset - look_back)
        best = None
        for ref, s, e, emission in heard if tokens else ():
            if e > begin and s < begin + window and len(tokens) <= len(emission):
                v = align.path_score(align.backtrack(align.trellis(emission, tokens), emission, tokens))
                if v > threshold and (best is None or v > best[0]):
                    best = (v, ref, s, e)
        if best:
            offset = (best[2] + best[3]) / 2 - (start + end) / 2
            out.append((seg, best[2], best[3], offset, best[1]))
        else:
            out.append((seg, max(0.0, start + offset), max(0.0, end + offset), offset, -1))
    return out


@pytest.mark.parametrize("shift,slack,threshold", [(0.0, 60.0, -5.0), (40.0, 10.0, 0.6), (300.0, 10.0, 0.6)])
def test_retime_equals_the_loop(spark, shift, slack, threshold):
    rng = np.random.default_rng(int(shift))
    files = {}
    for name in ("x", "y"):
        texts = ["".join(rng.choice(list("abcdef"), 6)) for _ in range(40)]
        lines = [(k, 7.0 * k, 7.0 * k + 3, t if k % 9 else rng.choice(["…", "??", ""])) for k, t in enumerate(texts)]
        # later lines are said later and later, the first at once
        heard = [(k, s, s + 3.0, random_emission(rng, 24, t if k % 5 else "")) for k, t in enumerate(texts) for s in [7.0 * k + (shift if k > 12 else 2.0)]]
        files[name] = lines, heard
    files["silent"] = [(0, 1.0, 2.0, "abc"), (1, 3.0, 4.0, None)], []
    rows = spark.createDataFrame([(f, *x, "s") for f, (a, _) in files.items() for x in a], "file_id string, seg_idx int, start double, end double, text string, speaker string")
    sounds = spark.createDataFrame([(f, k, s, e, m.tolist()) for f, (_, b) in files.items() for k, s, e, m in b], "file_id string, ref_idx int, start double, end double, emission array<array<double>>")
    got = retime.retime(rows, sounds, VOCABULARY, threshold=threshold, slack=slack).collect()
    for f, (a, b) in files.items():
        want = plain_retime(a, b, threshold=threshold)
        assert sorted((r.seg_idx, r.start, r.end, r.offset, r.matched) for r in got if r.file_id == f) == want
    assert retime.retime(rows.limit(0), sounds, VOCABULARY).count() == 0


def drifting(n, step, rng):
    """A file whose lines are said `step` seconds apart, though they are written 2 seconds apart."""
    texts = ["".join(rng.choice(list("abcdef"), 6)) for _ in range(n)]
    lines = [(k, 2.0 * k, 2.0 * k + 1, t) for k, t in enumerate(texts)]
    return lines, [(k, step * k, step * k + 1.5, random_emission(rng, 12, t)) for k, t in enumerate(texts)]


def retimed(spark, lines, heard, **options):
    rows = spark.createDataFrame([("f", *x) for x in lines], "file_id string, seg_idx int, start double, end double, text string")
    sounds = spark.createDataFrame([("f", k, s, e, m.tolist()) for k, s, e, m in heard], "file_id string, ref_idx int, start double, end double, emission array<array<double>>")
    work = Work(spark)
    return sorted((r.seg_idx, r.start, r.end, r.offset, r.matched) for r in retime.retime(rows, sounds, VOCABULARY, work=work, **options).collect()), len(work.paths) - 1


def test_an_offset_that_grows_takes_one_round(spark):
    lines, heard = drifting(150, 7.0, np.random.default_rng(1))
    got, rounds = retimed(spark, lines, heard, window=20.0, threshold=0.3, slack=10.0)
    assert got == plain_retime(lines, heard, window=20.0, threshold=0.3) and got[-1][3] > 500
    assert rounds == 1


def test_lines_that_go_back_take_another_round(spark):
    lines, heard = drifting(40, 7.0, np.random.default_rng(2))
    lines = [(k, s - 60.0 * (k >= 20), e - 60.0 * (k >= 20), t) for k, s, e, t in lines]
    got, rounds = retimed(spark, lines, heard, window=20.0, threshold=0.3, slack=1.0)
    assert got == plain_retime(lines, heard, window=20.0, threshold=0.3)
    assert rounds > 1


def test_one_line_in_stretches_of_all_lengths():
    rng = np.random.default_rng(3)
    heard = [random_emission(rng, int(n)) for n in rng.integers(0, 30, 40)]
    for line in (rng.integers(0, 7, 5), rng.integers(0, 7, 20), np.array([], dtype=int)):
        want = [retime.scores(e, [line])[0] for e in heard]
        assert np.array_equal(retime.scores_among(heard, line), want) and np.array_equal(retime.scores_among(heard, line, cells=200), want)


def test_waiting_lines_keep_their_order():
    q, got = retime._Queue(3), []
    for k in range(20):
        q.add(k)
        if k % 4 == 3:
            got.append(q.head())
            q.pop()
    while q.head() is not None:
        got.append(q.head())
        q.pop()
    assert got == list(range(20)) and q.written
