"""Timestamps, caption lines and small numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE, HOP, CHUNK_SECONDS = 16_000, 160, 30


def milliseconds(seconds: Column) -> Column:
    """Half-even, as bigint."""
    return F.bround(seconds * F.lit(1000.0)).cast("bigint")


def timestamp(ms: Column, always_hours: bool = False, decimal: str = ".") -> Column:
    """HH:MM:SS.mmm of whole milliseconds; hours are left out at 0 unless asked for, and may pass 99. Negative: an error."""
    h, m, s, r = (F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.when(h > 99, h.cast("string")).otherwise(two(h))
    tail = F.concat(two(m), F.lit(":"), two(s), F.lit(decimal), F.lpad(r.cast("string"), 3, "0"))
    whole = F.concat(hours, F.lit(":"), tail)
    out = whole if always_hours else F.when(h > 0, whole).otherwise(tail)
    return F.when(ms >= 0, out).when(ms < 0, F.raise_error("negative timestamp").cast("string"))


def format_timestamp(seconds: Column, always_hours: bool = False, decimal: str = ".") -> Column:
    return timestamp(milliseconds(seconds), always_hours, decimal)


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def caption_text(text: Column, speaker: Column | None = None) -> Column:
    """Stripped text without an arrow that would end a cue; '[speaker]: ' in front where there is one."""
    safe = F.replace(strip(text), F.lit("-->"), F.lit("->"))
    return safe if speaker is None else F.when(speaker.isNotNull(), F.concat(F.lit("["), speaker, F.lit("]: "), safe)).otherwise(safe)


def srt_block(number: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), timestamp(start_ms, True, ","), F.lit(" --> "), timestamp(end_ms, True, ","), F.lit("\n"), text, F.lit("\n"))


def vtt_cue(start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(timestamp(start_ms), F.lit(" --> "), timestamp(end_ms), F.lit("\n"), text, F.lit("\n"))


def tsv_line(start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat_ws("\t", start_ms.cast("string"), end_ms.cast("string"), F.replace(strip(text), F.lit("\t"), F.lit(" ")))


def aud_line(start: Column, end: Column, text: Column, speaker: Column | None = None) -> Column:
    body = F.replace(strip(text), F.lit("\t"), F.lit(" "))
    body = body if speaker is None else F.when(speaker.isNotNull(), F.concat(F.lit("[["), speaker, F.lit("]]"), body)).otherwise(body)
    return F.concat_ws("\t", start.cast("string"), end.cast("string"), body)


def shifted(time: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0), time + offset)


def exact_div(x: Column, y: Column) -> Column:
    """Whole quotient; an error where there is a remainder."""
    return F.when(x % y == 0, F.floor(x / y)).otherwise(F.raise_error("not a whole quotient").cast("bigint"))


def sample_range(start: Column, end: Column, rate: int = SAMPLE_RATE) -> tuple[Column, Column]:
    """First sample and number of samples of a stretch of seconds; both ends are cut, not rounded."""
    a, b = F.floor(start * rate).cast("int"), F.floor(end * rate).cast("int")
    return a, b - a


def slice_audio(audio: Column, start: Column, end: Column, rate: int = SAMPLE_RATE) -> Column:
    a, n = sample_range(start, end, rate)
    return F.slice(audio, a + 1, F.greatest(n, F.lit(0)))


def pad_or_trim(values: Column, length: int = SAMPLE_RATE * CHUNK_SECONDS) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(values)))), 1, length)


def duration_mismatch(samples: Column, start: Column, end: Column, rate: int = SAMPLE_RATE, tolerance: float = 0.005) -> Column:
    return F.abs(samples / F.lit(float(rate)) - (end - start)) > tolerance


def memory_fraction(reserved: Column, free: Column, total: Column, headroom: Column) -> Column:
    """Share of memory that one process may take, in [0.05, 1]; 1 where the total is unknown."""
    return F.when(total <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.05), (reserved + free - headroom) / total)))


def extent_of_stamps(stamps: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First start and last end of an array of time stamps; the segment's own where there are none."""
    some = F.size(stamps) > 0
    return F.when(some, stamps[0]["start"]).otherwise(start), F.when(some, F.try_element_at(stamps, F.lit(-1))["end"]).otherwise(end)
