"""Subtitle edit rate (Wilken et al., 2022): edits of words and breaks and shifts of phrases, between captions that overlap in time.

Words can only stand for words of a caption at the same time, so captions that are linked by overlaps in time are a
problem of their own, however long the file is. Both sides of a file pass once, sorted by time; an island of captions is
solved when a caption begins that overlaps none of it.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.functions.text import edit_distance
from captionlake.operators.metrics import align_to_reference
from captionlake.operators.stream import fold_rows

EOL, EOB = "<eol>", "<eob>"
#: A shift moves at most so many words (fixed value of the translation edit rate), over at most so many.
LONGEST, FARTHEST = 10, 50
_PUNCTUATION = re.compile(f"[{re.escape(string.punctuation + '，。？！；：、…“”‘’（）「」『』《》·—')}]+")


class Token(NamedTuple):
    text: str
    start: float
    end: float

    @property
    def is_break(self) -> bool:
        return self.text in (EOL, EOB)

    def matches(self, other: Token) -> bool:
        return self.text == other.text and self.start < other.end and self.end > other.start


def normal(text: str, cased: bool) -> str:
    return text if cased else _PUNCTUATION.sub("", text.lower())


def tokens(start: float, end: float, text: str | None, cased: bool = False) -> list[Token]:
    """Words of a caption, with a break after each line and another after the last one; no words, no breaks."""
    lines = [x for x in (normal(line, cased).split() for line in (text or "").split("\n")) if x]
    out = [Token(w, start, end) for k, line in enumerate(lines) for w in [*line, EOL if k + 1 < len(lines) else EOB]]
    return out


class Grid:
    """The cheapest edits from one row of tokens to another: both are words or both breaks, of times that overlap."""

    def __init__(self, reference: list[Token]) -> None:
        self.r = reference
        self._prices: dict[Token, np.ndarray] = {}

    @cached_property
    def _columns(self) -> tuple[np.ndarray, ...]:
        starts, ends = (np.array([getattr(t, k) for t in self.r], dtype=float) for k in ("start", "end"))
        return starts, ends, np.array([t.is_break for t in self.r], dtype=bool), np.array([self._names[t.text] for t in self.r], dtype=np.int64)

    @cached_property
    def _names(self) -> dict[str, int]:
        return {text: k for k, text in enumerate(dict.fromkeys(t.text for t in self.r))}

    @cached_property
    def words(self) -> dict[str, list[int]]:
        """The places of each word."""
        out: dict[str, list[int]] = {}
        for j, t in enumerate(self.r):
            if not t.is_break:
                out.setdefault(t.text, []).append(j)
        return out

    def price(self, t: Token) -> np.ndarray:
        """What it costs that the token stands for each of the reference's: 0 if equal, 1 if it may, 2 (as good as both out) if not."""
        if (out := self._prices.get(t)) is None:
            starts, ends, breaks, names = self._columns
            near = (breaks == t.is_break) & (t.start < ends) & (t.end > starts)
            out = self._prices[t] = np.where(near, (names != self._names.get(t.text, -1)).astype(np.int64), 2)
        return out

    def rows(self, hypothesis: list[Token], begin: int, end: int) -> Iterator[np.ndarray]:
        """The rows of the table for the reference's tokens from begin to end."""
        at = np.arange(end - begin + 1)
        above = at
        yield above
        for t in hypothesis:
            new = above + 1
            new[1:] = np.minimum(new[1:], above[:-1] + self.price(t)[begin:end])
            above = np.minimum.accumulate(new - at) + at
            yield above

    def _end(self, hypothesis: list[Token]) -> int:
        """How many tokens match at the end of both: a cheapest way, and the way back, go through all of them."""
        n = 0
        for a, b in zip(reversed(hypothesis), reversed(self.r)):
            if not a.matches(b):
                break
            n += 1
        return n

    def cost(self, hypothesis: list[Token]) -> int:
        end = self._end(hypothesis)
        i, j, begin = len(hypothesis) - end, len(self.r) - end, 0
        while begin < i and begin < j and hypothesis[begin].matches(self.r[begin]):
            begin += 1
        if begin in (i, j):
            return max(i, j) - begin
        for row in self.rows(hypothesis[begin:i], begin, j):
            pass
        return int(row[-1])

    def alignment(self, hypothesis: list[Token]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hypothesis tokens that match, reference tokens that match, how many hypothesis tokens stand before each place of the reference)."""
        end = self._end(hypothesis)
        i, j = len(hypothesis) - end, len(self.r) - end
        grid = [x.tolist() for x in self.rows(hypothesis[:i], 0, j)]
        hit_h, hit_r, before = np.zeros(i + end, dtype=bool), np.zeros(j + end, dtype=bool), np.zeros(j + end + 1, dtype=np.int64)
        hit_h[i:], hit_r[j:], before[j:] = True, True, np.arange(i, i + end + 1)
        while i or j:
            if i and j and (price := int(self.price(hypothesis[i - 1])[j - 1])) < 2 and grid[i][j] == grid[i - 1][j - 1] + price:
                i, j = i - 1, j - 1
                hit_h[i] = hit_r[j] = not price
                before[j] = i
            elif i and grid[i][j] == grid[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
                before[j] = i
        return hit_h, hit_r, before


def shifts_of(grid: Grid, hypothesis: list[Token]) -> Iterator[list[Token]]:
    """The hypothesis with a phrase moved to where the reference has it; the phrase and its place both hold an error."""
    hit_h, hit_r, before = (x.tolist() for x in grid.alignment(hypothesis))
    # errors before each place; a place without an error in reach begins no phrase
    wrong_h, wrong_r = ([0, *accumulate(not x for x in hits)] for hits in (hit_h, hit_r))
    n, m = len(hit_h), len(hit_r)
    for i, t in enumerate(hypothesis):
        if wrong_h[i] == wrong_h[min(i + LONGEST, n)]:
            continue
        for j in grid.words.get(t.text, ()):
            if wrong_r[j] == wrong_r[min(j + LONGEST, m)]:
                continue
            size = 0
            while size < LONGEST and i + size < n and j + size < m:
                a, b = hypothesis[i + size], grid.r[j + size]
                if a.is_break or not a.matches(b):
                    break
                size += 1
                to = before[j]
                if abs(to - i) > FARTHEST or i <= to <= i + size or wrong_h[i] == wrong_h[i + size] or wrong_r[j] == wrong_r[j + size]:
                    continue
                rest = hypothesis[:i] + hypothesis[i + size :]
                to -= size if to > i else 0
                yield rest[:to] + hypothesis[i : i + size] + rest[to:]


def edits(hypothesis: list[Token], reference: list[Token]) -> tuple[int, int]:
    """(edits, shifts): phrases are moved one at a time, the one that saves most first, as long as a move saves more than itself."""
    grid, moved = Grid(reference), 0
    cost = grid.cost(hypothesis)
    if cost <= 1:
        return cost, moved
    # moves change no words: what one side has more of stays an edit, so no move comes below this
    both = Counter(t.text for t in hypothesis) & Counter(t.text for t in reference)
    least = max(len(hypothesis), len(reference)) - both.total()
    while cost > least + 1:
        best, found = cost, hypothesis
        for h in shifts_of(grid, hypothesis):
            if (new := grid.cost(h)) < best:
                best, found = new, h
                if best == least:
                    break
        if best + 1 >= cost:
            break
        cost, hypothesis = best, found
        moved += 1
    return cost, moved


class Islands:
    """Captions of both sides, sorted by their starts: the edits of each island."""

    def __init__(self, cased: bool) -> None:
        self.cased, self.end_at, self.sides = cased, None, ([], [])

    def row(self, start: float, end: float, said: bool, text: str | None) -> Iterator[tuple]:
        if self.end_at is not None and start >= self.end_at:
            yield from self.end()
            self.end_at, self.sides = None, ([], [])
        self.end_at = end if self.end_at is None else max(self.end_at, end)
        self.sides[not said].extend(tokens(start, end, text, self.cased))

    def end(self) -> Iterator[tuple]:
        h, r = self.sides
        if h or r:
            yield *edits(h, r), len(r)


def subtitle_edit_rates(hypothesis: DataFrame, reference: DataFrame, cased: bool = False) -> DataFrame:
    """file_id, edits, shifts, tokens (of the reference), rate: 100 (edits + shifts) / tokens; null where there are none.

    Both: file_id, seg_idx, start, end, text. Defined cases: nulls have no words; a file of one side only counts each of its
    tokens as an edit; captions of no length overlap nothing; files without words give no row.
    """
    side = lambda x, said: x.select("file_id", "seg_idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(said).alias("said"), "text")
    rows = side(hypothesis, True).unionByName(side(reference, False))
    found = fold_rows(rows, ["start", "end", "said", "text"], ["start", "end", "said", "seg_idx"], lambda: Islands(cased), "edits long, shifts long, tokens long")
    sums = found.groupBy("file_id").agg(*(F.sum(c).alias(c) for c in ("edits", "shifts", "tokens")))
    return sums.withColumn("rate", F.when(F.col("tokens") > 0, F.round(100 * (F.col("edits") + F.col("shifts")) / F.col("tokens"), 3)))


def char_error_rates(hypothesis: DataFrame, reference: DataFrame, cased: bool = False) -> DataFrame:
    """file_id, edits, chars, rate (percent): the hypothesis' words are dealt to the reference's lines first."""
    dealt = align_to_reference(hypothesis, reference).select("file_id", "seg_idx", F.col("text").alias("said"))
    plain = lambda c: F.coalesce(c, F.lit("")) if cased else F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Punct}，。？！；：、…“”‘’（）「」『』《》·—]", ""))
    spaced = lambda c: F.trim(F.regexp_replace(plain(c), r"\s+", " "))
    rows = reference.select("file_id", "seg_idx", "text").join(dealt, ["file_id", "seg_idx"]).select("file_id", spaced(F.col("said")).alias("h"), spaced(F.col("text")).alias("r"))
    sums = rows.select("file_id", edit_distance(F.col("h"), F.col("r")).alias("d"), F.length("r").alias("n")).groupBy("file_id").agg(F.sum("d").cast("long").alias("edits"), F.sum("n").alias("chars"))
    return sums.withColumn("rate", F.when(F.col("chars") > 0, F.round(100 * F.col("edits") / F.col("chars"), 3)))


#: The four metrics of a hypothesis and a reference.
METRICS = {
    "SubER": lambda h, r: subtitle_edit_rates(h, r),
    "SubER-cased": lambda h, r: subtitle_edit_rates(h, r, True),
    "CER": lambda h, r: char_error_rates(h, r),
    "CER-cased": lambda h, r: char_error_rates(h, r, True),
}
