"""Media files: listing, stream choice, and decoding of PCM audio."""

from __future__ import annotations

import io
import json
import shutil
import subprocess
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators import blocks

#: Fixed value: file extensions taken as media.
MEDIA = ("mp4", "mkv", "avi", "mov", "webm", "ts", "m2ts", "wav", "mp3", "flac", "aac", "ogg", "m4a", "opus")
RATE = 16_000


def is_media(path: Column, extensions=MEDIA) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def discover_media(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Paths of media files in order; the contents are never read. An empty result is an error, as is a missing directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory if recursive else f"{directory.rstrip('/')}/*")
    out = files.select("path", "length").where(is_media(F.col("path"))).orderBy("path")
    if out.isEmpty():
        raise FileNotFoundError(f"no media files in {directory}")
    return out


def parse_streams(probe: Column) -> Column:
    """Streams of a probe's JSON; an empty array where it can't be read."""
    kind = "struct<streams:array<struct<index:int,tags:struct<language:string,title:string>>>>"
    return F.coalesce(F.from_json(probe, kind)["streams"], F.array().cast("array<struct<index:int,tags:struct<language:string,title:string>>>"))


def probe_tracks(path: str) -> list[dict]:
    """Audio streams by ffprobe; without it a RuntimeError, and [] for what it can't read."""
    if not shutil.which("ffprobe"):
        raise RuntimeError("ffprobe is not installed")
    out = subprocess.run(["ffprobe", "-v", "quiet", "-print_format", "json", "-show_streams", "-select_streams", "a", path], capture_output=True, text=True)
    try:
        return json.loads(out.stdout).get("streams", [])
    except ValueError:
        return []


def _pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mean of the channels in [-1, 1) of integer samples of 1 (unsigned) to 4 bytes."""
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(float)
    return ((x - 128 if width == 1 else x) / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1)


def wav_pieces(content: bytes, rate: int = RATE, size: int = blocks.SIZE) -> Iterator[np.ndarray]:
    """Mono float32 in [-1, 1) of PCM in pieces of `size` samples, the last perhaps shorter; other rates by linear interpolation."""
    with wave.open(io.BytesIO(content)) as w:
        have, n, form = w.getframerate(), w.getnframes(), (w.getsampwidth(), w.getnchannels())
        total = n if have == rate else int(n * rate / have)
        for a in range(0, total, size):
            at = np.arange(a, min(a + size, total)) * have / rate
            first, last = int(at[0]), min(int(at[-1]) + 1, n - 1)
            w.setpos(first)
            x = _pcm(w.readframes(last - first + 1), *form)
            if not len(x):
                return
            yield (x[: len(at)] if have == rate else np.interp(at, np.arange(first, first + len(x)), x)).astype(np.float32)


def decode_wav(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float32 in [-1, 1) of PCM; other rates by linear interpolation."""
    return np.concatenate([np.zeros(0, np.float32), *wav_pieces(content, rate)])


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes())
    return out.getvalue()


def load_audio(files: DataFrame) -> DataFrame:
    """path, samples (little-endian float32) of binaryFile rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "samples": [decode_wav(bytes(c)).tobytes() for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, samples binary")


def decode_blocks(files: DataFrame, rate: int = RATE, size: int = blocks.SIZE) -> DataFrame:
    """file_id, block, samples of WAV files (path, content): a block at a time, so that no file is held as numbers.

    The file_id is the path's last part. A file that is no PCM WAV is a ValueError that names it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    for k, x in enumerate(wav_pieces(bytes(content), rate, size)):
                        yield pd.DataFrame({"file_id": [path.rpartition("/")[2]], "block": [k], "samples": [x.astype("<f4").tobytes()]})
                except (wave.Error, EOFError) as e:
                    raise ValueError(f"{path}: {e}") from e

    return files.select("path", "content").mapInPandas(run, "file_id string, block long, samples binary")


def probe(files: DataFrame, reader: Callable[[str], list[dict]] = probe_tracks) -> DataFrame:
    """path, streams: the audio streams of each file as parse_streams gives them, [] where they can't be read.

    files: path. reader: path -> streams, called in the tasks; what it raises ends the job, as a missing ffprobe does.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "probe": [json.dumps({"streams": reader(p.removeprefix("file:"))}) for p in f["path"]]})

    return files.select("path").mapInPandas(run, "path string, probe string").select("path", parse_streams(F.col("probe")).alias("streams"))
