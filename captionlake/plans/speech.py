"""Voice activity and vocal isolation, with the models injected.

Voice activity: windows of a file's audio are scored in batches, scores that fall on one frame are averaged, and one pass
over a file's sorted frames makes regions, cuts those that grow too long, and joins them to chunks. Isolation: each
segment becomes overlapping pieces that are dealt to tasks on their own, and their answers are weighted and added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionlake.operators import audio, blocks, folds
from captionlake.plans.stages import infer

RATE = 16_000
Batch = Callable[[list[dict]], list[dict]]


def frame_scores(scored: DataFrame, frames_per_hop: int) -> DataFrame:
    """file_id, frame, y: the mean score of each frame over the windows that cover it. scored: file_id, k, scores."""
    each = scored.select("file_id", F.col("k") * frames_per_hop, F.posexplode("scores").alias("i", "y")).toDF("file_id", "first", "i", "y")
    return each.groupBy("file_id", (F.col("first") + F.col("i")).alias("frame")).agg(F.avg("y").alias("y"))


def detect(scored: DataFrame, frames_per_hop: int, frame_seconds: float, onset: float = 0.5, offset: float = 0.363, chunk: float = 30.0) -> DataFrame:
    """file_id, seg_idx, start, end, n, parts: chunks of speech by the scores of overlapping windows; a frame's time is its middle."""
    frames = frame_scores(scored, frames_per_hop)
    return folds.speech_chunks(frames.select("file_id", ((F.col("frame") + 0.5) * frame_seconds).alias("t"), "y"), onset, offset, chunk)


def with_audio(chunks: DataFrame, audio_blocks: DataFrame, rate: int = RATE, size: int = blocks.SIZE) -> DataFrame:
    """Add audio (binary) to rows file_id, seg_idx, start, end."""
    spans = chunks.select("file_id", "seg_idx", "start", "end", (F.col("start") * rate).cast("long").alias("a"), (F.col("end") * rate).cast("long").alias("b"))
    return blocks.slices(audio_blocks, spans, size).select("file_id", "seg_idx", "start", "end", F.col("samples").alias("audio"))


def voice_activity(
    audio_blocks: DataFrame,
    score: Batch | None = None,
    segments: DataFrame | None = None,
    window: float = 5.0,
    hop: float = 0.5,
    frame: int = 320,
    onset: float = 0.5,
    offset: float = 0.363,
    chunk: float = 30.0,
    batch: int = 32,
    rate: int = RATE,
    size: int = blocks.SIZE,
) -> DataFrame:
    """file_id, seg_idx, start, end, audio: stretches of speech of at most about `chunk` seconds.

    score: windows (dicts of samples) -> scores, one for each `frame` samples. In its place, segments: file_id, seg_idx,
    start, end of another detector, which are only joined to chunks. Both onset and offset are between 0 and 1.
    """
    if (score is None) == (segments is None):
        raise ValueError("give either a score function or segments")
    if segments is not None:
        us = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
        merged = folds.merge_chunks(segments.select("file_id", "seg_idx", us("start").alias("s"), us("end").alias("e")), round(chunk * 1_000_000))
        found = merged.select("file_id", F.col("chunk_idx").alias("seg_idx"), (F.col("s") / 1e6).alias("start"), (F.col("e") / 1e6).alias("end"))
        return with_audio(found, audio_blocks, rate, size)
    step = round(hop * rate)
    if step % frame:
        raise ValueError("a hop must be whole frames")
    cut = blocks.windows(audio_blocks, round(window * rate), step, size)
    scored = infer(cut, score, ["samples"], "scores array<double>", batch, key=lambda x: len(x["samples"])).select("file_id", "k", "scores")
    return with_audio(detect(scored, step // frame, frame / rate, onset, offset, chunk), audio_blocks, rate, size)


# ------------------------------------------------------------------- isolation


def pieces(segments: DataFrame, size: int, overlap: int = 2) -> DataFrame:
    """file_id, seg_idx, off, total, samples: each segment's audio in pieces of `size` samples every size // overlap.

    A segment of over twice the border (size less a step) is mirrored by it at both ends first; the last pieces are filled up
    by a mirror where over half of them is there, else by zeros. total: samples of the segment with its borders.
    """
    step = size // overlap
    border = size - step
    schema = T.StructType([segments.schema["file_id"], *T._parse_datatype_string("seg_idx long, off long, total long, samples binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[k].as_py() or b"", "<f4")
                x = np.pad(x, border, mode="reflect") if len(x) > 2 * border > 0 else x
                offs = list(range(0, len(x), step))
                if offs:
                    cut = [audio.pad_tail(x[o : o + size], size).astype("<f4").tobytes() for o in offs]
                    one = batch.slice(k, 1)
                    same = [pa.concat_arrays([one.column(c)] * len(offs)) for c in range(2)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(offs, pa.int64()), pa.array([len(x)] * len(offs), pa.int64()), pa.array(cut, pa.binary())], ["file_id", "seg_idx", "off", "total", "samples"])

    return segments.select("file_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("audio").alias("samples")).mapInArrow(run, schema)


def gather(answers: DataFrame, size: int, overlap: int = 2) -> DataFrame:
    """file_id, seg_idx, audio: the pieces' answers (file_id, seg_idx, off, total, samples), weighted and added up in order.

    A piece fades in and out over a tenth of its size, but for the beginning of the first and the end of the last. What is
    held is one segment's sums; a sample without weight is 0, and the border of a mirrored segment goes.
    """
    step = size // overlap
    border, fade = size - step, size // 10
    schema = T.StructType([answers.schema["file_id"], *T._parse_datatype_string("seg_idx long, audio binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = audio.fade_window(size, fade)
        key, sums, weights, names = None, None, None, ["file_id", "seg_idx", "audio"]

        def ended() -> tuple:
            with np.errstate(all="ignore"):
                x = np.nan_to_num(sums / weights, nan=0.0, posinf=0.0, neginf=0.0)
            x = x[border : len(x) - border] if len(x) - 2 * border > 2 * border > 0 else x
            return *key, x.astype("<f4").tobytes()

        def rows(found: list[tuple], kind) -> pa.RecordBatch:
            ids, seg, x = list(zip(*found, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(seg, pa.int64()), pa.array(x, pa.binary())], names)

        kind = None
        for batch in batches:
            found, kind = [], batch.column(0).type
            for file_id, seg, off, total, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sums is None or key != (file_id, seg):
                    if sums is not None:
                        found.append(ended())
                    key, sums, weights = (file_id, seg), np.zeros(total), np.zeros(total)
                w = base.copy()
                if off == 0:
                    w[:fade] = 1
                elif off + size >= total:
                    w[size - fade :] = 1
                n = min(size, total - off)
                sums[off : off + n] += np.frombuffer(samples, "<f4")[:n] * w[:n]
                weights[off : off + n] += w[:n]
            yield rows(found, kind)
        if sums is not None:
            yield rows([ended()], kind)

    ordered = answers.select("file_id", "seg_idx", "off", "total", "samples").repartition("file_id", "seg_idx").sortWithinPartitions("file_id", "seg_idx", "off")
    return ordered.mapInArrow(run, schema)


def isolate(segments: DataFrame, model: Batch, size: int = 352_800, overlap: int = 2, batch: int = 4) -> DataFrame:
    """Segments (file_id, seg_idx, start, end, audio) with the model's audio in place of theirs.

    model: pieces (dicts of samples) -> samples of the same size. Pieces of all segments are dealt out evenly, so that a
    batch mixes files and a long segment is no task of its own; a segment without audio keeps none.
    """
    dealt = pieces(segments, size, overlap).repartition(F.xxhash64("file_id", "seg_idx", "off"))
    asked = infer(dealt, lambda part: [{"answer": x["samples"]} for x in model(part)], ["samples"], "answer binary", batch)
    done = gather(asked.select("file_id", "seg_idx", "off", "total", F.col("answer").alias("samples")), size, overlap)
    return segments.drop("audio").join(done, ["file_id", "seg_idx"], "left").withColumn("audio", F.coalesce("audio", F.lit(b"")))
