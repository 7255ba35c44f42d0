"""Schemas. Rows of a DataFrame have no order of their own, so file_id and seg_idx travel with every row."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

KEYS = ["file_id", "seg_idx"]
WORD = StructType([StructField("word", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("score", DoubleType())])
CHAR = StructType([StructField("char", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("score", DoubleType())])
SEGMENT = StructType([StructField("file_id", StringType()), StructField("seg_idx", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("text", StringType()), StructField("speaker", StringType()), StructField("avg_logprob", DoubleType())])
ALIGNED = StructType([*SEGMENT.fields, StructField("words", ArrayType(WORD)), StructField("chars", ArrayType(CHAR))])
VAD = StructType([StructField("file_id", StringType()), StructField("seg_idx", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("audio", BinaryType())])
TURN = StructType([StructField("file_id", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("speaker", StringType())])
EMISSION = StructType([StructField("file_id", StringType()), StructField("vad_idx", IntegerType()), StructField("frame_rate", DoubleType()), StructField("emission", ArrayType(ArrayType(DoubleType())))])
FILE = StructType([StructField("file_id", StringType()), StructField("audio_path", StringType()), StructField("audio_track", IntegerType()), StructField("size", LongType())])
