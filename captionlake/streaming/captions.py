"""Row-wise caption steps on streams. The steps keep no state across rows, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.functions import rules, steps
from captionlake.functions.text import is_removable


def clean_captions(rows: DataFrame, directory: str | None = None, width: int = 18) -> DataFrame:
    """`text` cleaned by the manifest's steps, rows without speech dropped; for static and streaming tables alike."""
    todo = rules.load_steps(directory, steps.builtin_steps(width))
    return rows.withColumn("text", rules.clean(F.col("text"), todo)).where(~is_removable(F.col("text")))
