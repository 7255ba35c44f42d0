"""Ordered folds with carried state: each is one pass over a file's rows in order (see stream.py)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from captionlake.operators.stream import fold_rows


class Chunks:
    """Greedy chunks: a segment whose end lies over `longest` from the chunk's start begins the next, if the chunk has length."""

    def __init__(self, longest: float) -> None:
        self.longest, self.idx, self.now = longest, 0, None

    def row(self, member, s, e) -> Iterator[tuple]:
        if self.now and e - self.now[0] > self.longest and self.now[1] > self.now[0]:
            yield from self.end()
            self.now, self.idx = None, self.idx + 1
        if self.now is None:
            self.now = [s, e, []]
        self.now[1] = e
        self.now[2].append(member)

    def end(self) -> Iterator[tuple]:
        if self.now:
            s, e, members = self.now
            yield self.idx, s, e, len(members), members


def merge_chunks(segments: DataFrame, chunk_us: int) -> DataFrame:
    """file_id, chunk_idx, s, e, n, members (seg_idx) of Chunks. segments: file_id, seg_idx, s, e."""
    return fold_rows(segments, ["seg_idx", "s", "e"], ["seg_idx"], lambda: Chunks(chunk_us), "chunk_idx long, s long, e long, n long, members array<long>")


def mergeable(a: str, b: str, split_chars: str, merge_chars: str, max_length: int) -> bool:
    """Whether two caption texts may join: either is empty, or the first ends in no split character and both fit."""
    if not a or not b:
        return True
    return (a[-1] not in split_chars or a[-1] in merge_chars) and len(a) + len(b) <= max_length


class Captions:
    """Captions joined to the one before while the gap is at most max_gap and the texts are mergeable; the joined text decides on."""

    def __init__(self, max_gap: int, sep: str, rule: Callable[[str, str], bool]) -> None:
        self.max_gap, self.sep, self.rule = max_gap, sep, rule
        self.idx, self.now = 0, None

    def row(self, s: int, e: int, text: str | None, *lists) -> Iterator[tuple]:
        text = (text or "").strip()
        now = self.now
        if now and s - now[1] <= self.max_gap and self.rule(now[2], text):
            now[1:4] = e, now[2] + (self.sep if now[2] and text else "") + text, now[3] + 1
            for have, more in zip(now[4], lists, strict=True):
                have += more or []
        else:
            yield from self.end()
            self.idx += bool(now)
            self.now = [s, e, text, 1, [list(x or []) for x in lists]]

    def end(self) -> Iterator[tuple]:
        if self.now:
            yield self.idx, *self.now[:4], *self.now[4]


def merge_captions(rows: DataFrame, max_gap: int, max_length: int = 18, split_chars: str = "，。？！；…", merge_chars: str = "，", sep: str = "") -> DataFrame:
    """file_id, caption_idx, s, e, text, n of Captions, and words and chars, one after the other, where rows have them.

    rows: file_id, seg_idx, s, e, text.
    """
    lists = [c for c in ("words", "chars") if c in rows.columns]
    out = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in lists)
    rule = lambda a, b: mergeable(a, b, split_chars, merge_chars, max_length)
    return fold_rows(rows, ["s", "e", "text", *lists], ["seg_idx"], lambda: Captions(max_gap, sep, rule), f"caption_idx long, s long, e long, text string, n long{out}")


#: Regions no longer than this are none (fixed value): a cut may lie before the frame that began its region.
SHORTEST = 1e-6


class Regions:
    """Hysteresis with a longest region: one that grows over it is cut where the score is least in its second half.

    A region begins with a score over onset and ends at the first frame under offset. The cut is sought among the frames
    held when a frame makes the region too long; that frame is not tested for the region's end. Held are the frames since
    the region began, without the one that began it, after the last frame of the gap before; never more than a longest region.
    """

    def __init__(self, onset: float, offset: float | None = None, longest: float = float("inf")) -> None:
        self.onset, self.offset, self.longest = onset, offset or onset, longest
        self.start: float | None = None  # of the region that is open
        self.held: list[tuple[float, float]] = []  # (score, time), so that the least of them is the cut
        self.idx, self.last = 0, None

    def _closed(self, at: float) -> Iterator[tuple]:
        if at - self.start > SHORTEST:
            yield self.idx, self.start, at
            self.idx += 1

    def row(self, t: float, y: float) -> Iterator[tuple]:
        first, self.last = self.last is None, t
        if self.start is None:
            if y > self.onset:
                self.start = t
            if first:
                self.held = [(y, t)]
            return
        if t - self.start > self.longest:
            half = len(self.held) // 2
            cut = min(range(half, len(self.held)), key=lambda k: self.held[k][0])
            yield from self._closed(self.held[cut][1])
            self.start = self.held[cut][1]
            del self.held[: cut + 1]
        elif y < self.offset:
            yield from self._closed(t)
            self.start, self.held = None, []
        self.held.append((y, t))

    def end(self) -> Iterator[tuple]:
        if self.start is not None:
            yield from self._closed(self.last)


def regions_of(t: np.ndarray, y: np.ndarray, onset: float, offset: float | None, longest: float) -> list[tuple[float, float]]:
    """Regions of one sorted sequence of frames."""
    fold = Regions(onset, offset, longest)
    found = [x for frame in zip(map(float, t), map(float, y), strict=True) for x in fold.row(*frame)]
    return [(s, e) for _, s, e in [*found, *fold.end()]]


def speech_regions(frames: DataFrame, onset: float = 0.5, offset: float = 0.363, max_duration: float = 30.0) -> DataFrame:
    """file_id, region, start, end of Regions. frames: file_id, t, y (seconds, score)."""
    return fold_rows(frames, ["t", "y"], ["t", "y"], lambda: Regions(onset, offset, max_duration), "region long, start double, end double")


class SpeechChunks:
    """Regions put into Chunks as they end."""

    def __init__(self, onset: float, offset: float, chunk: float) -> None:
        self.regions, self.chunks = Regions(onset, offset, chunk), Chunks(chunk)

    def _passed(self, regions: Iterable[tuple]) -> Iterator[tuple]:
        for idx, start, end in regions:
            yield from self.chunks.row((start, end), start, end)

    def row(self, t: float, y: float) -> Iterator[tuple]:
        yield from self._passed(self.regions.row(t, y))

    def end(self) -> Iterator[tuple]:
        yield from self._passed(self.regions.end())
        yield from self.chunks.end()


def speech_chunks(frames: DataFrame, onset: float = 0.5, offset: float = 0.363, chunk: float = 30.0) -> DataFrame:
    """file_id, seg_idx, start, end, n, parts (the regions of a chunk): voice activity in one pass over a file's sorted frames."""
    if not 0 < onset < 1:
        raise ValueError("onset must lie between 0 and 1")
    if chunk <= 0:
        raise ValueError("chunks must have a length")
    return fold_rows(frames, ["t", "y"], ["t", "y"], lambda: SpeechChunks(onset, offset, chunk), "seg_idx long, start double, end double, n long, parts array<struct<start:double,end:double>>")


def speaks(line: dict) -> bool:
    """Whether a line has a letter or digit to align."""
    return any(c.isalnum() for c in line.get("text") or "")


def retime(lines: DataFrame, candidates: DataFrame, score: Callable[[dict, dict], float], look_back: float = 5.0, window: float = 120.0, threshold: float = -5.0, alignable: Callable[[dict], bool] = speaks) -> DataFrame:
    """Find each line's speech again: of the candidates within its search window the best-scored; the shift found moves later searches.

    The first line searches from 0, later ones from start + offset - look_back, not under 0, over `window` seconds. A score
    over the threshold gives the line the candidate's times, and the distance of their middles is the offset from then on. A
    line without a match, or that is not alignable, is moved by the offset. Of equal scores the first candidate counts.
    lines: file_id, seg_idx, start, end and what score needs; candidates: file_id, ref_idx, start, end and the like.
    Out: file_id, seg_idx, start, end (not under 0), offset, matched (ref_idx, else -1). One file is one group in memory.
    """
    kind = lines.schema["file_id"].dataType.simpleString()
    names = candidates.columns
    right = candidates.toDF(*[f"r{k}" for k in range(len(names))])  # both sides may come from one DataFrame

    def fold(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("seg_idx"), b.set_axis(names, axis=1).sort_values(["start", "ref_idx"])
        starts, reach = b["start"].to_numpy(float), np.maximum.accumulate(b["end"].to_numpy(float)) if len(b) else np.empty(0)
        b = b.to_dict("records")
        offset, out = 0.0, []
        for n, line in enumerate(a.to_dict("records")):
            begin = 0.0 if n == 0 else max(0.0, line["start"] + offset - look_back)
            found = None
            if alignable(line):
                # no candidate before the first whose reach passes `begin`, and none that starts after the window
                near = (c for c in b[np.searchsorted(reach, begin, "right") : np.searchsorted(starts, begin + window)] if c["end"] > begin)
                found = max(((score(line, c), -c["ref_idx"], c) for c in near), key=lambda x: x[:2], default=None)
            if found and found[0] > threshold:
                c = found[2]
                offset = (c["start"] + c["end"]) / 2 - (line["start"] + line["end"]) / 2
                times = c["start"], c["end"], offset, int(c["ref_idx"])
            else:
                times = max(0.0, line["start"] + offset), max(0.0, line["end"] + offset), offset, -1
            out.append((line["file_id"], line["seg_idx"], *times))
        return pd.DataFrame(out, columns=["file_id", "seg_idx", "start", "end", "offset", "matched"])

    cogroups = lines.groupBy("file_id").cogroup(right.groupBy(f"r{names.index('file_id')}"))
    return cogroups.applyInPandas(fold, f"file_id {kind}, seg_idx long, start double, end double, offset double, matched long")
