"""Audio in blocks: a file's samples as rows of a fixed size, so that long files are spread over tasks and cut without being whole.

blocks: file_id, block, samples (little-endian 32-bit floats; all but the last have the full size).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of a block: 256 KB.
SIZE = 1 << 16


def to_blocks(audio: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of rows file_id, samples."""
    last = (F.length("samples") / 4 - 1) / size
    cut = audio.where(F.length("samples") >= 4).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last).cast("long"))).alias("block"), "samples")
    return cut.select("file_id", "block", F.expr(f"substring(samples, cast(block * {size * 4} + 1 as int), {size * 4})").alias("samples"))


def lengths(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """file_id, total: samples of each file."""
    return blocks.groupBy("file_id").agg(F.max(F.col("block") * size + F.expr("length(samples) div 4")).alias("total"))


def slices(blocks: DataFrame, spans: DataFrame, size: int = SIZE) -> DataFrame:
    """Add samples to spans (file_id, a, b and what tells them apart): those from a up to b of their file, as far as there are any.

    A null file_id is a file as any other. A span meets only the blocks that it covers, by (file, block): no file is gathered, and a span's own pieces are put
    together in its row.
    """
    a, b, block = F.col("a"), F.col("b"), F.col("_block")
    covered = F.when(b > a, F.sequence(F.expr(f"a div {size}"), F.expr(f"(b - 1) div {size}")))
    parts = spans.withColumn("_block", F.explode_outer(covered))
    held = blocks.select(F.col("file_id").alias("_file"), F.col("block").alias("_at"), "samples")
    found = parts.join(held, F.col("file_id").eqNullSafe(F.col("_file")) & (block == F.col("_at")), "left").drop("_file", "_at")
    first = F.greatest(a - block * size, F.lit(0))
    piece = F.coalesce(F.col("samples").substr((first * 4 + 1).cast("int"), ((F.least(b - block * size, F.lit(size)) - first) * 4).cast("int")), F.lit(b""))
    names = spans.columns
    pieces = found.select(*names, F.struct(block.alias("at"), piece.alias("x")).alias("_piece")).groupBy(*names).agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    return pieces.withColumn("samples", F.aggregate("_pieces", F.lit(b""), lambda acc, p: F.concat(acc, p["x"]))).drop("_pieces")


def windows(blocks: DataFrame, length: int, hop: int, size: int = SIZE) -> DataFrame:
    """file_id, k, a, b, samples: windows of `length` samples every `hop`; the last covers the end and may be shorter."""
    n = F.greatest(F.ceil((F.col("total") - length) / hop), F.lit(0))
    spans = lengths(blocks, size).select("file_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("k"))
    spans = spans.select("file_id", "k", (F.col("k") * hop).alias("a"), F.least(F.col("k") * hop + length, F.col("total")).alias("b"))
    return slices(blocks, spans, size)


def pack(values: Column) -> Column:
    """Samples of arrays of numbers."""
    return _pack(values.cast("array<float>"))


@F.pandas_udf(T.BinaryType())
def _pack(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(samples: pd.Series) -> pd.Series:
    """Samples as arrays of numbers."""
    return samples.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))
