"""Caption metrics: character error rate, alignment of a hypothesis to a reference's lines, subtitle edit rate."""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from captionlake.functions.text import edit_distance


def char_error_rate(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", by: list[str] | None = None) -> DataFrame:
    """Edits over reference characters, of all pairs or by group: edits, chars, cer."""
    rows = pairs.select(*(by or []), edit_distance(F.col(hypothesis), F.col(reference)).alias("d"), F.length(reference).alias("n"))
    out = rows.groupBy(*(by or [])).agg(F.sum("d").alias("edits"), F.sum("n").alias("chars"))
    return out.withColumn("cer", F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")))


def align_words(hypothesis: list[str], reference: list[str]) -> list[int]:
    """For each hypothesis word the index of the reference word that a cheapest alignment puts it at (insertions: the one before)."""
    n, m = len(hypothesis), len(reference)
    names: dict[str, int] = {}
    h, r = (np.array([names.setdefault(w, len(names)) for w in x], dtype=np.int64) for x in (hypothesis, reference))
    at = np.arange(m + 1, dtype=np.int64)

    def row(i: int, above: np.ndarray) -> np.ndarray:
        new = above + 1
        new[1:] = np.minimum(new[1:], above[:-1] + (r != h[i - 1]))
        return np.minimum.accumulate(new - at) + at  # words of the reference left out

    # of about the square root of n rows one is kept; the rows after it are found again when the way back comes to them
    step = max(1, isqrt(n))
    kept = [last := at]
    for i in range(1, n + 1):
        last = row(i, last)
        if i % step == 0:
            kept.append(last)
    out, i, j = [0] * n, n, m
    block: dict[int, np.ndarray] = {}
    while i:
        if i - 1 not in block:
            first = (i - 1) // step
            block = {first * step: kept[first]}
            for k in range(first * step + 1, i + 1):
                block[k] = row(k, block[k - 1])
        cost, above = block[i], block[i - 1]
        if j and cost[j] == above[j - 1] + (h[i - 1] != r[j - 1]):
            i, j = i - 1, j - 1
            out[i] = j
        elif cost[j] == above[j] + 1:
            i -= 1
            out[i] = max(0, j - 1)
        else:
            j -= 1
    return out


def align_to_reference(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """The hypothesis' words dealt to the reference's lines: file_id, seg_idx, text. Both: file_id, seg_idx, text."""
    kind = reference.schema["file_id"].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg_idx")
        h, r = rows[rows["said"]], rows[~rows["said"]]
        words, owner = [], []
        for k, t in enumerate(r["text"]):
            for w in (t or "").split():
                words.append(w), owner.append(k)
        said = [w for t in h["text"] for w in (t or "").split()]
        lines: list[list[str]] = [[] for _ in range(len(r))]
        if words:
            for w, at in zip(said, align_words(said, words), strict=True):
                lines[owner[at]].append(w)
        return pd.DataFrame({"file_id": r["file_id"], "seg_idx": r["seg_idx"], "text": [" ".join(x) for x in lines]})

    side = lambda x, said: x.select("file_id", "seg_idx", "text", F.lit(said).alias("said"))
    return side(hypothesis, True).unionByName(side(reference, False)).groupBy("file_id").applyInPandas(fold, f"file_id {kind}, seg_idx long, text string")


def subtitle_edit_rate(hypothesis: list[tuple[float, float, str]], reference: list[tuple[float, float, str]]) -> float:
    """Edits of words, line ends and block ends over their number in the reference (Wilken et al., 2022), without shifts.

    A word matches only one whose caption overlaps its own in time.
    """

    def flat(rows: list[tuple[float, float, str]]) -> list[tuple[str, float, float]]:
        return [(w, s, e) for s, e, text in rows for line in text.split("\n") for w in [*line.split(), "<eol>"]]

    h, r = flat(hypothesis), flat(reference)
    row = np.arange(len(r) + 1)
    for w, s, e in h:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, (x, a, b) in enumerate(r, 1):
            new[j] = min(row[j - 1] + (w != x or not (s < b and e > a)), row[j] + 1, new[j - 1] + 1)
        row = new
    return float(row[-1]) / max(1, len(r))


def compression_ratio(text: Column) -> Column:
    """UTF-8 bytes over zlib bytes."""

    @pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else len(t.encode()) / len(zlib.compress(t.encode())))

    return run(text)
