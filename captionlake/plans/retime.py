"""Subtitles timed anew by acoustic emissions: each line is searched for among the stretches of speech near where it is expected.

Where a line is expected depends on what was found for the lines before it, so a file is one pass: its lines wait in their
order while its stretches pass by time, and a line is decided when the stretches that begin in its window have passed. It
is compared with these alone, in one padded trellis; what is held are the stretches of one window and some before it. A
line whose window begins before what is still held stops the pass for its file, and the next round starts there from the
offset reached; every round decides at least one more line of each file that is left.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionlake.functions.text import SPLIT_CHARS
from captionlake.operators import align
from captionlake.operators.stream import fold_rows
from captionlake.sources.work import Work

#: Cells of the padded trellis that are held at once.
CELLS = 1 << 22


def scores(emission: np.ndarray, lines: list[np.ndarray], blank: int = 0, cells: int = CELLS) -> np.ndarray:
    """Of each line's tokens the mean probability along its best path through all of the emission; -inf where there is none.

    Lines are padded to the longest and searched together, some at a time so that at most about `cells` cells are held.
    """
    return _scores([emission] * len(lines), lines, blank, cells)


def scores_among(emissions: list[np.ndarray], line: np.ndarray, blank: int = 0, cells: int = CELLS) -> np.ndarray:
    """scores() of one line in each of several emissions, padded to the longest of them."""
    return _scores(emissions, [line] * len(emissions), blank, cells)


def _scores(emissions: list[np.ndarray], lines: list[np.ndarray], blank: int, cells: int) -> np.ndarray:
    out = np.full(len(lines), -np.inf)
    size_of = [len(e) * (len(x) + 1) for e, x in zip(emissions, lines, strict=True)]
    order = sorted((k for k, x in enumerate(lines) if 0 < len(x) <= len(emissions[k])), key=lambda k: size_of[k])
    while order:
        # from the largest down, as many as fit beside it
        size = max(1, cells // max(1, size_of[order[-1]]))
        part, order = order[-size:], order[:-size]
        out[part] = _padded([emissions[k] for k in part], [lines[k] for k in part], blank)
    return out


def _padded(emissions: list[np.ndarray], lines: list[np.ndarray], blank: int) -> np.ndarray:
    n, lasts = np.array([len(x) for x in lines]), np.array([len(e) for e in emissions])
    tokens = np.full((len(lines), n.max()), blank)
    for k, x in enumerate(lines):
        tokens[k, : len(x)] = x
    frames, rows, last = int(lasts.max()), np.arange(len(lines)), n.copy()
    if all(e is emissions[0] for e in emissions):
        emission, own = emissions[0][None], np.zeros(len(lines), dtype=int)
    else:
        emission, own = np.zeros((len(lines), frames, emissions[0].shape[1])), rows
        for k, e in enumerate(emissions):
            emission[k, : len(e)] = e
    quiet = emission[own, :, blank]
    silence = np.concatenate([np.zeros((len(lines), 1)), np.cumsum(quiet, axis=1)], axis=1)
    now = np.full((len(lines), n.max() + 1), -np.inf)
    now[:, 0] = np.where(n > lasts, np.inf, 0.0)
    ends, changed = np.empty((frames + 1, len(lines))), np.empty((frames, len(lines), n.max()), dtype=bool)
    ends[0] = now[rows, last]
    for t in range(frames):
        stay, change = now[:, 1:] + quiet[:, t, None], now[:, :-1] + emission[own[:, None], t, tokens]
        changed[t] = change > stay
        now[:, 1:] = np.maximum(stay, change)
        now[:, 0] = np.where(t + 1 > lasts - n, np.inf, silence[:, t + 1])  # the text begins while there is time for it
        ends[t + 1] = np.where(t < lasts, now[rows, last], -np.inf)
    begun, left = ends.argmax(axis=0), n.copy()
    total, steps = np.zeros(len(lines)), np.zeros(len(lines))
    for t in range(frames, 0, -1):
        on = np.flatnonzero((t <= begun) & (left > 0))
        moved = changed[t - 1, on, left[on] - 1]
        total[on] += np.exp(np.where(moved, emission[own[on], t - 1, tokens[on, left[on] - 1]], quiet[on, t - 1]))
        steps[on] += 1
        left[on] -= moved
    return np.where(left == 0, total / np.maximum(steps, 1), -np.inf)


#: Waiting lines that are held in memory; more wait in a file.
WAITING = 1 << 14
_STATE, _LINE, _SOUND = range(3)


class _Queue:
    """First in, first out: runs of rows wait in a file of the worker's own once there are many."""

    def __init__(self, most: int) -> None:
        self.most, self.file, self.read, self.written = most, None, 0, 0
        self.first, self.new, self.at = [], [], 0

    def add(self, x) -> None:
        self.new.append(x)
        if len(self.new) >= self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(self.written)
            pickle.dump(self.new, self.file)
            self.written, self.new = self.file.tell(), []

    def head(self):
        """The row that waits longest, or None."""
        if self.at == len(self.first):
            self.at, self.first = 0, []
            if self.read < self.written:
                self.file.seek(self.read)
                self.first = pickle.load(self.file)
                self.read = self.file.tell()
            else:
                self.first, self.new = self.new, []
        return self.first[self.at] if self.first else None

    def pop(self) -> None:
        self.at += 1


class _Pass:
    """One file from a state on: rows of (what, seg_idx, start, end, tokens, value, ref_idx, emission), the lines in order
    before the stretches by their starts. A state's value is the offset, and its ref_idx is 1 for a file's first line."""

    def __init__(self, look_back: float, window: float, threshold: float, slack: float, blank: int, waiting: int = WAITING) -> None:
        self.look_back, self.window, self.threshold, self.slack, self.blank = look_back, window, threshold, slack, blank
        self.offset, self.first, self.lines, self.near = 0.0, False, _Queue(waiting), []
        self.kept, self.gone = 0, -np.inf

    def row(self, what, seg_idx, start, end, tokens, value, ref_idx, emission) -> Iterable[tuple]:
        if what == _STATE:
            self.offset, self.first = value, bool(ref_idx)
        elif what == _LINE:
            self.lines.add((seg_idx, start, end, tokens))
        else:
            yield from self.decide(start)
            if (line := self.lines.head()) is not None:
                self.near.append((start, end, ref_idx, align._matrix(emission)))
                if len(self.near) > 2 * self.kept + 16:
                    self.forget(self.begin(line) - self.slack)

    def end(self) -> Iterable[tuple]:
        yield from self.decide(np.inf)

    def begin(self, line: tuple) -> float:
        return 0.0 if self.first else max(0.0, line[1] + self.offset - self.look_back)

    def forget(self, before: float) -> None:
        self.gone = max([self.gone, *(e for _, e, _, _ in self.near if e <= before)])
        self.near = [x for x in self.near if x[1] > before]
        self.kept = len(self.near)

    def decide(self, heard: float) -> Iterable[tuple]:
        """Lines whose windows end up to `heard`, where the stretches have come to, and lines that need none."""
        while (line := self.lines.head()) is not None:
            (seg_idx, start, end, tokens), begin = line, self.begin(line)
            good = []
            if tokens:
                if self.gone > begin:
                    yield seg_idx, None, None, self.offset, None
                    self.lines = _Queue(1)
                    return
                if heard < begin + self.window:
                    return
                near = [x for x in self.near if x[1] > begin and x[0] < begin + self.window]
                found = scores_among([x[3] for x in near], np.asarray(tokens, dtype=int), self.blank).tolist()
                good = [(v, -ref, s, e) for v, (s, e, ref, _) in zip(found, near, strict=True) if v > self.threshold]
            self.lines.pop()
            self.first = False
            if good:
                _, ref, s, e = max(good, key=lambda x: x[:2])
                self.offset = (s + e) / 2 - (start + end) / 2
                yield seg_idx, s, e, self.offset, -ref
            else:
                yield seg_idx, max(0.0, start + self.offset), max(0.0, end + self.offset), self.offset, -1


def retime(lines: DataFrame, heard: DataFrame, vocabulary: dict[str, int], look_back: float = 5.0, window: float = 120.0, threshold: float = -5.0, slack: float = 60.0, blank: int = 0, split_chars: str = SPLIT_CHARS, spaced: bool = False, work: Work | None = None) -> DataFrame:
    """file_id, seg_idx, start, end, offset, matched: each line at the stretch that fits it best, or moved by the offset.

    The first line searches `window` seconds from 0, later ones from start + offset - look_back, not under 0. Of the stretches
    that reach into the window the best fit over the threshold counts, of equal ones the one with the smallest ref_idx; the
    distance of the middles is the offset from then on. matched is the stretch's ref_idx, else -1.
    lines: file_id, seg_idx, start, end, text; heard: file_id, ref_idx, start, end, emission. slack: how many seconds of
    stretches before a window are held for lines that go back; it changes the number of rounds, not the result.
    Defined cases: lines without a character to align, null texts and files without speech are only moved; no lines give none.
    """
    work = work or Work(lines.sparkSession)

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["tokens"] = [align.alignable(t or "", vocabulary, blank, split_chars, spaced)[1] for t in f["text"]]
            yield f.drop(columns="text")

    kind = lines.schema["file_id"]
    said = lines.select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text")
    said = work.table(said.mapInPandas(tokens, T.StructType([kind, *T._parse_datatype_string("seg_idx long, start double, end double, tokens array<int>").fields])), "lines")
    sounds = heard.where("start IS NOT NULL AND end IS NOT NULL").select("file_id", F.col("ref_idx").cast("long").alias("ref_idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("emission").cast("array<array<double>>").alias("emission"))
    state = said.groupBy("file_id").agg(F.min("seg_idx").alias("at"), F.lit(0.0).alias("offset"), F.lit(1).cast("long").alias("first"))
    columns = ["what", "seg_idx", "start", "end", "tokens", "value", "ref_idx", "emission"]
    decided: list[DataFrame] = []
    while True:
        rows = state.select("file_id", F.lit(_STATE).alias("what"), F.col("at").alias("seg_idx"), F.col("offset").alias("value"), F.col("first").alias("ref_idx"))
        left = said.join(state, "file_id").where("seg_idx >= at").select("file_id", F.lit(_LINE).alias("what"), "seg_idx", "start", "end", "tokens")
        near = sounds.join(state, "file_id").select("file_id", F.lit(_SOUND).alias("what"), "ref_idx", "start", "end", "emission", F.col("start").alias("passes"))
        rows = rows.unionByName(left, allowMissingColumns=True).unionByName(near, allowMissingColumns=True)
        found = fold_rows(rows, columns, ["what", "passes", "seg_idx", "ref_idx"], lambda: _Pass(look_back, window, threshold, slack, blank), "seg_idx long, start double, end double, offset double, matched long")
        out = work.table(found, "round")
        decided.append(out.where("start IS NOT NULL"))
        state = out.where("start IS NULL").select("file_id", F.col("seg_idx").alias("at"), "offset", F.lit(0).cast("long").alias("first"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, decided)
