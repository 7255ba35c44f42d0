"""Log-mel spectrograms of audio in blocks: frames are made by stretches, so that a file of any length is spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionlake.operators import audio, blocks
from captionlake.sources.work import Work


def stretches(audio_blocks: DataFrame, n_fft: int, hop: int, frames: int, size: int = blocks.SIZE) -> DataFrame:
    """file_id, k, a, b, left, right, samples: what the frames k * frames and following need, up to `frames` of them.

    A frame is n_fft samples around hop times its number, so neighbours share a halo of n_fft - hop samples. left and right:
    samples before the beginning and after the end of the file, which mirror those inside.
    """
    half = n_fft // 2
    n = F.expr(f"CASE WHEN total > {half} THEN total div {hop} ELSE 0 END")
    files = blocks.lengths(audio_blocks, size).select("file_id", "total", n.alias("n")).where("n > 0")
    spans = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {frames}"))).alias("k"))
    first, end = F.col("k") * (frames * hop) - half, (F.least((F.col("k") + 1) * frames, F.col("n")) - 1) * hop + n_fft - half
    spans = spans.select("file_id", "k", "total", first.alias("first"), end.alias("last"))
    # One sample more than the last frame has: the mirror at the beginning leaves the first sample out.
    inside = spans.select(
        "file_id", "k", F.greatest("first", F.lit(0)).alias("a"), F.least(F.col("last") + 1, "total").alias("b"), F.greatest(-F.col("first"), F.lit(0)).alias("left"), F.greatest(F.col("last") - F.col("total"), F.lit(0)).alias("right"), (F.col("last") - F.col("first")).alias("length")
    )
    return blocks.slices(audio_blocks, inside, size)


def log_powers(x: np.ndarray, filters: np.ndarray, hop: int) -> np.ndarray:
    """frames x mels: Hann windows, power, filters, log10 over 1e-10."""
    n_fft = 2 * (filters.shape[1] - 1)
    view = np.lib.stride_tricks.sliding_window_view(x.astype(float), n_fft)[::hop]
    power = np.abs(np.fft.rfft(view * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    return np.log10(np.maximum(power @ filters.T, 1e-10))


def log_mel(audio_blocks: DataFrame, n_fft: int = 400, hop: int = 160, mels: int = 80, rate: int = 16_000, frames: int = 2_048, size: int = blocks.SIZE, work: Work | None = None) -> DataFrame:
    """file_id, k, first, values: the log-mel values of the frames from `first` on, frame by frame (arrays of `mels` numbers).

    What falls over 8 under the highest of its whole file is raised to that; then (x + 4) / 4. A file has length div hop
    frames, none if it is no longer than half a window (n_fft even). Only one number a file moves between the stretches;
    with a work folder the unscaled values are written once instead of being computed for it a second time.
    """
    cut = stretches(audio_blocks, n_fft, hop, frames, size)
    schema = T.StructType([audio_blocks.schema["file_id"], *T._parse_datatype_string("k long, raw binary, top double").fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = audio.mel_filters(rate, n_fft, mels)
        for part in parts:
            raw, tops = [], []
            for x, left, right, length in zip(part["samples"], part["left"], part["right"], part["length"], strict=True):
                y = log_powers(np.pad(np.frombuffer(x, "<f4"), (left, right), mode="reflect")[:length], filters, hop)
                raw.append(y.astype("<f8").tobytes())
                tops.append(float(y.max()))
            yield pd.DataFrame({"file_id": part["file_id"], "k": part["k"], "raw": raw, "top": tops})

    done = cut.select("file_id", "k", "left", "right", "length", "samples").mapInPandas(run, schema)
    done = work.table(done, "log_powers") if work else done
    top = done.groupBy(F.col("file_id").alias("_file")).agg(F.max("top").alias("_top"))
    rows = done.join(top, F.col("file_id").eqNullSafe(F.col("_file")))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def scaled(raw: pd.Series, highest: pd.Series) -> pd.Series:
        return pd.Series([list(((np.maximum(np.frombuffer(x, "<f8"), t - 8) + 4) / 4).astype("<f4").reshape(-1, mels)) for x, t in zip(raw, highest, strict=True)])

    return rows.select("file_id", "k", (F.col("k") * frames).alias("first"), scaled("raw", "_top").alias("values"))
