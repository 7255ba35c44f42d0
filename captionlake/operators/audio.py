"""Audio kernels: fades, chunks, overlap-add, mono, mel spectrograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fade_window(size: int, fade: int | None = None) -> np.ndarray:
    """Ones with linear ramps of size // 10 at both ends."""
    fade = size // 10 if fade is None else fade
    w = np.ones(size)
    w[:fade] *= np.linspace(0, 1, fade)
    w[size - fade :] *= np.linspace(1, 0, fade)
    return w


def chunk_starts(total: int, size: int, overlap: int = 2) -> list[int]:
    return list(range(0, total, size // overlap))


def pad_tail(part: np.ndarray, size: int) -> np.ndarray:
    """Up to size: by reflection where the tail is over half of it, else by zeros."""
    gap = size - len(part)
    if gap <= 0:
        return part[:size]
    return np.pad(part, (0, gap), mode="reflect") if len(part) > size // 2 + 1 else np.pad(part, (0, gap))


def overlap_add(samples: DataFrame) -> DataFrame:
    """file_id, pos, value: sum(weight * x) / sum(weight) over the chunks that cover a sample; 0 where the weights are 0.

    samples: file_id, pos (absolute), x, weight. Partial sums are made before the shuffle.
    """
    sums = samples.groupBy("file_id", "pos").agg(F.sum(F.col("x") * F.col("weight")).alias("wx"), F.sum("weight").alias("w"))
    return sums.select("file_id", "pos", F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(0.0).alias("value"))


def chunk_samples(chunks: DataFrame, size: int, fade: int) -> DataFrame:
    """Rows (file_id, pos, x, weight) of chunks (file_id, start, values): the weight rises and falls linearly over `fade` samples."""
    x = chunks.select("file_id", "start", F.posexplode("values").alias("i", "x"))
    up, down = F.col("i") / F.lit(float(fade - 1)), (F.lit(size - 1) - F.col("i")) / F.lit(float(fade - 1))
    return x.select("file_id", (F.col("start") + F.col("i")).alias("pos"), F.col("x").cast("double").alias("x"), F.least(F.lit(1.0), up, down).alias("weight"))


def mono(channels: DataFrame) -> DataFrame:
    """Mean over channels of (file_id, pos, channel, x)."""
    return channels.groupBy("file_id", "pos").agg(F.avg("x").alias("x"))


def mel_filters(rate: int = 16_000, n_fft: int = 400, mels: int = 80) -> np.ndarray:
    """Triangular filters, evenly spaced on the Slaney mel scale and of equal area."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f >= 1000, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step, f * 3 / 200)
    to_hz = lambda m: np.where(m >= 15, 1000 * np.exp(step * (m - 15)), m * 200 / 3)
    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(rate / 2)), mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(wave: np.ndarray, n_fft: int = 400, hop: int = 160, mels: int = 80) -> np.ndarray:
    """mels x frames: Hann windows, power, filters, log10 over 1e-10, at most 8 under the maximum, (x + 4) / 4."""
    padded = np.pad(np.asarray(wave, float), n_fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][:-1]
    power = np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    x = np.log10(np.maximum(mel_filters(16_000, n_fft, mels) @ power.T, 1e-10))
    return (np.maximum(x, x.max() - 8) + 4) / 4
