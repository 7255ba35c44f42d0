"""The whole path from speech segments to cleaned captions, with the models injected.

Every step is lazy; a checkpoint folder makes the model steps resumable per file. Rows carry file_id and seg_idx
throughout, so batches mix files freely and nothing depends on row order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions import profiles, rules, steps, text
from captionlake.operators import align, folds, intervals, sequence
from captionlake.plans.stages import Stage, infer
from captionlake.sources import config

Batch = Callable[[list[dict]], list[dict]]


@dataclass(frozen=True)
class Options:
    """Times in milliseconds, as the defaults of the layered configuration have them."""

    padding: int = 40
    release: int = 640
    merge_distance: int = 80
    max_length: int = 18
    width: int = 18
    batch: int = 15
    reference_limit: int = 2_000
    rules: str | None = None
    #: Whether words are set apart by blanks, and how sentences without times get them.
    spaced: bool = False
    interpolate: str = "nearest"
    #: Profile of the recognising model (config.profile), and the tables that it asks for.
    model: str = "default"
    script: steps.LongestMatch | None = None
    variants: dict[str, str] | None = None


def recognise(vad: DataFrame, asr: Batch, batch: int = 15, checkpoint: str | None = None, name: str = "asr", failed: dict | None = None) -> DataFrame:
    """Add text to segments (file_id, seg_idx, start, end, audio); longest audio first within a batch window.

    failed: what a segment has on which the model raises, as {"text": ""}; then there is a column `error`.
    """
    stage = Stage(name, lambda df: infer(df, asr, ["file_id", "seg_idx", "audio"], "text string", batch, key=lambda x: len(x["audio"] or b""), failed=failed).drop("audio"))
    return stage.run(vad, checkpoint)


def ensemble(segments: DataFrame, other: DataFrame) -> DataFrame:
    """A second hypothesis by position; '' where it has none."""
    return segments.join(other.select("file_id", "seg_idx", F.col("text").alias("alternative")), ["file_id", "seg_idx"], "left").withColumn("alternative", F.coalesce("alternative", F.lit("")))


def settle(segments: DataFrame, generate: Batch, batch: int = 15) -> DataFrame:
    """Ask for each line between its two hypotheses (text, alternative), with its neighbours as context; keep the answer's first
    line unless it is empty, a label, or far longer than the line."""
    rows = sequence.context(segments).withColumn("prompt", text.prompt(F.col("prev_text"), F.col("text"), F.col("alternative"), F.col("next_text"))).drop("prev_text", "next_text")
    asked = infer(rows, generate, ["prompt"], "response string", batch)
    return asked.withColumn("text", text.accept_rewrite(F.col("text"), F.coalesce(text.strip_thinking(F.col("response")), F.lit("")))).drop("prompt", "response", "alternative")


def add_references(segments: DataFrame, lines: DataFrame, limit_ms: int = 2_000) -> DataFrame:
    """Add reference: overlapping lines (file_id, seg_idx, start, end, text), else the nearest within the limit, else ''."""
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    left = segments.select("file_id", "seg_idx", us("start").alias("s"), us("end").alias("e"))
    right = lines.select("file_id", F.col("seg_idx").alias("ref_idx"), us("start").alias("rs"), us("end").alias("re"), F.col("text").alias("rtext"))
    return segments.join(intervals.match_references(left, right, limit_ms * 1000), ["file_id", "seg_idx"])


def correct(segments: DataFrame, generate: Batch, batch: int = 15, semantic: bool = False) -> DataFrame:
    """Ask for a rewrite of each line that has a reference, with its neighbours as context; keep it where the guards accept it.

    generate gets dicts with `prompt` and returns dicts with `response`. Lines without a reference make no call.
    """
    rows = sequence.context(segments).withColumn("prompt", text.prompt(F.col("prev_text"), F.col("text"), F.col("reference"), F.col("next_text"))).drop("prev_text", "next_text")
    asked = infer(rows.where("reference <> ''"), generate, ["prompt"], "response string", batch)
    fixed = asked.withColumn("text", text.accept_reference(F.col("text"), text.strip_thinking(F.col("response")), semantic)).drop("response")
    return fixed.unionByName(rows.where("reference = ''")).drop("prompt")


def substitute(segments: DataFrame, generate: Batch) -> DataFrame:
    """One request per file over all its numbered lines; the substitutions it returns apply to every line in order."""
    numbered = segments.select("file_id", "seg_idx", F.concat((F.col("seg_idx") + 1).cast("string"), F.lit(". "), F.col("text")).alias("x"))
    whole = numbered.groupBy("file_id").agg(F.expr("listagg(x, '\n') WITHIN GROUP (ORDER BY seg_idx)").alias("prompt"))
    pairs = infer(whole, generate, ["prompt"], "response string", 1).select("file_id", text.parse_substitutions(text.strip_thinking(F.col("response"))).alias("pairs"))
    return segments.join(pairs, "file_id", "left").withColumn("text", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(text.apply_substitutions(F.col("text"), F.col("pairs")))).drop("pairs")


def aligned_lines(segments: DataFrame, vocabulary: dict[str, int], options: Options = Options(), split_chars: str | None = None) -> DataFrame:
    """file_id, seg_idx, s, e (milliseconds), text, words: sentences with times from the emissions; unaligned segments keep their own.

    segments: file_id, seg_idx, start, end, text, emission. Sentences are made inside their row; only the times of the
    file's lines meet, to let ends go and to trim them to the next line.
    """
    known = config.profile(options.model)
    split_chars = split_chars or known.get("split_chars", text.SPLIT_CHARS)
    parts = align.align_sentences(segments, vocabulary, candidates=known["spot_checks"], split_chars=split_chars, spaced=options.spaced, interpolate=options.interpolate)
    ms = lambda c: F.bround(F.col(c) * 1000).cast("bigint")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_idx", "part")) - 1
    rows = parts.select("file_id", place.cast("bigint").alias("seg_idx"), ms("start").alias("s"), ms("end").alias("e"), "text", ms("release_from").alias("release_from"), "words")
    return sequence.release_and_trim(rows, options.release, options.padding).select("file_id", "seg_idx", "s", "e", "text", "words")


def captions(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Merge, clean and drop lines without speech: file_id, seg_idx, start, end (seconds), text, and words where lines have them."""
    merged = folds.merge_captions(lines, options.merge_distance - options.padding, options.max_length)
    todo = rules.load_steps(options.rules, steps.builtin_steps(options.width))
    cleaned = merged.withColumn("text", rules.clean(F.col("text"), todo)).where(~text.is_removable(F.col("text")))
    return cleaned.select("file_id", F.col("caption_idx").alias("seg_idx"), (F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end"), "text", *(c for c in ("words",) if c in merged.columns))


def transcribe(
    vad: DataFrame,
    asr: Batch,
    emit: Batch,
    vocabulary: dict[str, int],
    options: Options = Options(),
    references: DataFrame | None = None,
    generate: Batch | None = None,
    checkpoint: str | None = None,
    second: Batch | None = None,
) -> DataFrame:
    """Captions of segments (file_id, seg_idx, start, end, audio): file_id, seg_idx, start, end, text, words.

    asr: audio -> text; emit: audio -> emission (log-probabilities by frame); second: audio -> text of another model, whose
    failures leave a line without an alternative. generate: prompt -> response, asked between the two hypotheses where there
    are two, then about lines that have a reference, then once a file for names to make alike. With a checkpoint, model
    steps are resumed by file (texts are normalised after that, so that other tables count at once), and the captions before cleaning are kept as a stage of their own.
    """
    said = recognise(vad, asr, options.batch, checkpoint)
    said = said.withColumn("text", profiles.normalise(F.col("text"), config.profile(options.model), options.script, options.variants))
    if second is not None:
        other = recognise(vad, second, options.batch, checkpoint, "second", failed={"text": ""})
        said = ensemble(said, other)
        said = settle(said, generate, options.batch) if generate is not None else said.drop("alternative")
    if references is not None:
        said = add_references(said, references, options.reference_limit)
        if generate is not None:
            said = correct(said, generate, options.batch)
        said = said.drop("reference")
    if generate is not None:
        said = substitute(said, generate)
    heard = Stage("emissions", lambda df: infer(df, emit, ["file_id", "seg_idx", "audio"], "emission array<array<double>>", options.batch, key=lambda x: len(x["audio"] or b"")).select("file_id", "seg_idx", "emission")).run(vad, checkpoint)
    rows = said.join(heard, ["file_id", "seg_idx"]).select("file_id", "seg_idx", "start", "end", "text", "emission")
    lines = Stage("before_cleaning", lambda df: aligned_lines(df, vocabulary, options)).run(rows, checkpoint)
    return captions(lines, options)
