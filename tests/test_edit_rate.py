"""Subtitle edit rate: hand-worked cases, and the grid against a plain table."""

import random
import time

import pytest

from captionlake import score
from captionlake.operators import edit_rate as er
from captionlake.operators.edit_rate import EOB, EOL, Token


def plain_cost(h, r):
    d = [[0] * (len(r) + 1) for _ in range(len(h) + 1)]
    for i in range(len(h) + 1):
        for j in range(len(r) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            a, b = h[i - 1], r[j - 1]
            may = a.is_break == b.is_break and a.start < b.end and a.end > b.start
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a.text != b.text) if may else 10**9)
    return d[-1][-1]


def random_tokens(rng, n):
    out = []
    for k in range(n):
        start = k // 4 * 2.0 + rng.choice([0, 1.5])
        out.append(Token(rng.choice(["a", "b", "c", EOL, EOB]), start, start + rng.choice([1.0, 3.0])))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_grid_equals_a_plain_table(seed):
    rng = random.Random(seed)
    h, r = random_tokens(rng, rng.randint(0, 14)), random_tokens(rng, rng.randint(0, 14))
    grid = er.Grid(r)
    assert grid.cost(h) == plain_cost(h, r)
    hit_h, hit_r, before = grid.alignment(h)
    assert hit_h.sum() == hit_r.sum() and list(before) == sorted(before)
    cost, moved = er.edits(h, r)
    assert cost + moved <= plain_cost(h, r)
    if moved == 0:
        assert cost == plain_cost(h, r)


def test_breaks_and_times():
    words = lambda text, s=0.0, e=1.0: er.tokens(s, e, text)
    assert [t.text for t in words("Hello, you!\nAll well?")] == ["hello", "you", EOL, "all", "well", EOB]
    assert [t.text for t in er.tokens(0, 1, "Hello, you!", cased=True)] == ["Hello,", "you!", EOB]
    assert words(" \n ") == [] and er.tokens(0, 1, None) == []
    assert er.edits(words("a b"), words("a\nb")) == (1, 0)  # a line end is missing
    assert er.edits(words("a\nb"), words("a b")) == (1, 0)
    assert er.edits(words("a b"), words("a c")) == (1, 0)
    # not at the same time: all of both is edited
    assert er.edits(words("a b", 0, 1), words("a b", 1, 2)) == (6, 0)


def test_a_phrase_is_moved_for_one_edit():
    h = er.tokens(0, 1, "d e f a b c")
    r = er.tokens(0, 1, "a b c d e f")
    assert plain_cost(h, r) == 6 and er.edits(h, r) == (0, 1)
    # not out of its time: the reference has the phrase in a caption that the hypothesis' does not overlap
    late = er.tokens(0, 1, "x y z") + er.tokens(5, 6, "p q")
    early = er.tokens(0, 1, "p q x y z") + er.tokens(5, 6, "w")
    assert er.edits(late, early)[1] == 0
    # a single wrong place costs two edits, and a shift costs one
    assert er.edits(er.tokens(0, 1, "b a c"), er.tokens(0, 1, "a b c")) == (0, 1)


def test_rates(spark, tmp_path):
    kind = "file_id string, seg_idx long, start double, end double, text string"
    ref = [("f", 0, 0.0, 2.0, "one two\nthree"), ("f", 1, 2.0, 4.0, "four five"), ("f", 2, 9.0, 10.0, "six"), ("g", 0, 0.0, 1.0, "seven"), ("e", 0, 0.0, 1.0, None)]
    hyp = [("f", 0, 0.0, 2.0, "One, two three"), ("f", 1, 2.1, 4.0, "five four"), ("f", 2, 20.0, 21.0, "six")]
    got = {r.file_id: tuple(r)[1:] for r in er.subtitle_edit_rates(spark.createDataFrame(hyp, kind), spark.createDataFrame(ref, kind)).collect()}
    # f: a line end is missing; one shift; "six" and its break are at another time: 2 out, 2 in
    assert got == {"f": (5, 1, 10, 60.0), "g": (2, 0, 2, 100.0)}
    cased = {r.file_id: r.edits for r in er.subtitle_edit_rates(spark.createDataFrame(hyp, kind), spark.createDataFrame(ref, kind), True).collect()}
    assert cased["f"] == 6
    for name, text in (("h.srt", "1\n00:00:00,000 --> 00:00:01,000\nhello word\n"), ("r.srt", "1\n00:00:00,000 --> 00:00:01,000\nHello, world\n")):
        (tmp_path / name).write_text(text)
    rate = {m: [r.rate for r in score.rates(spark, str(tmp_path / "h.srt"), str(tmp_path / "r.srt"), m).collect()] for m in er.METRICS}
    assert rate == {"SubER": [33.333], "SubER-cased": [66.667], "CER": [round(100 / 11, 3)], "CER-cased": [25.0]}


def test_lines_of_files_are_kept(spark, tmp_path):
    for name, text in (("h.srt", "1\n00:00:00,000 --> 00:00:01,000\none  two\n three\n"), ("r.srt", "1\n00:00:00,000 --> 00:00:01,000\none two three\n")):
        (tmp_path / name).write_text(text)
    assert [(r.edits, r.tokens) for r in score.rates(spark, str(tmp_path / "h.srt"), str(tmp_path / "r.srt")).collect()] == [(1, 4)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nhello\n")
    score.main([str(tmp_path / "a.srt"), str(tmp_path / "a.srt")])
    assert "SubER: 0.0" in capsys.readouterr().out


def test_a_long_caption_is_searched_near_its_errors():
    """Each move's cost was found over the whole caption, and moves were tried after one had left nothing to save."""
    rng = random.Random(8)
    said = " ".join(f"w{k}{rng.choice('abc')}" for k in range(3000))
    words = said.split()
    for k in (0, 3, 6, 9):
        words[k], words[k + 1] = words[k + 1], words[k]
    began = time.perf_counter()
    assert er.edits(er.tokens(0, 1, " ".join(words)), er.tokens(0, 1, said)) == (0, 4)
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("seed", range(20))
def test_moves_equal_trying_each_over_the_whole(seed):
    rng = random.Random(100 + seed)
    r = [Token(rng.choice("abcde"), k // 6 * 2.0, k // 6 * 2.0 + rng.choice([1.0, 3.0])) for k in range(rng.randint(2, 16))]
    h = list(r)
    for _ in range(3):
        i, j = rng.randrange(len(h)), rng.randrange(len(h))
        h.insert(j, h.pop(i))
    left, cost, moved = h, plain_cost(h, r), 0
    while cost > 1:
        best = min(((plain_cost(x, r), k, x) for k, x in enumerate(er.shifts_of(er.Grid(r), left))), key=lambda x: x[:2], default=None)
        if best is None or best[0] + 1 >= cost:
            break
        cost, _, left = best
        moved += 1
    assert er.edits(h, r) == (cost, moved)
