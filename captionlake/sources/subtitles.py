"""Subtitle files: readers of SRT and VTT, and writers of one named file per file_id."""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from captionlake.functions.formatting import aud_line, caption_text, milliseconds, srt_block, strip, tsv_line, vtt_cue
from captionlake.sources import files

FORMATS = ("txt", "vtt", "srt", "tsv", "json", "aud")
#: What the selection `all` writes.
ALL = ("txt", "vtt", "srt", "tsv", "json")


def parse_time(s: str) -> float:
    """[HH:]MM:SS[.,]mmm in seconds."""
    parts = s.replace(",", ".").split(":")
    return sum(float(x) * 60**k for k, x in enumerate(reversed(parts)))


def read_subtitles(spark: SparkSession, path: str, keep_lines: bool = False) -> DataFrame:
    """file_id, seg_idx, start, end, text of SRT or VTT files. Words are joined by one space (keep_lines: within their line);
    empty blocks are dropped.

    A path without a file extension is a ValueError.
    """
    if not re.search(r"\.\w+$|[*}]$", path) and not os.path.isdir(path):
        raise ValueError(f"{path}: the format comes from the file extension")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_id"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    blocks = whole.select("file_id", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("block", "body"))
    stamp = r"((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*"
    parts = blocks.select("file_id", "block", F.regexp_extract("body", stamp, 1).alias("a"), F.regexp_extract("body", stamp, 2).alias("b"), F.regexp_extract("body", rf"(?s){stamp}\n?(.*)", 3).alias("text"))
    seconds = lambda c: F.aggregate(F.split(F.replace(F.col(c), F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    joined = (F.regexp_replace("text", r"(?U)[^\S\n]+", " "), r" ?\n\s*", "\n") if keep_lines else ("text", r"(?U)\s+", " ")
    rows = parts.where("a != ''").select("file_id", "block", seconds("a").alias("start"), seconds("b").alias("end"), strip(F.regexp_replace(*joined)).alias("text")).where("text != ''")
    from pyspark.sql import Window

    return rows.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("block")) - 1).alias("seg_idx"), "start", "end", "text")


def render(rows: DataFrame, form: str, speaker: str | None = None) -> DataFrame:
    """file_id, n, line: the text of each row in one of FORMATS, numbered from 0 in its file, with headers as line -1.

    rows: file_id, seg_idx, start, end (seconds), text and perhaps a speaker column.
    """
    from pyspark.sql import Window

    who = F.col(speaker) if speaker else None
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_idx"))
    s, e = milliseconds(F.col("start")), milliseconds(F.col("end"))
    line = {
        "txt": lambda: F.when(who.isNotNull(), F.concat(F.lit("["), who, F.lit("]: "), strip(F.col("text")))).otherwise(strip(F.col("text"))) if speaker else strip(F.col("text")),
        "srt": lambda: srt_block(n, s, e, caption_text(F.col("text"), who)),
        "vtt": lambda: vtt_cue(s, e, caption_text(F.col("text"), who)),
        "tsv": lambda: tsv_line(s, e, F.col("text")),
        "aud": lambda: aud_line(F.col("start"), F.col("end"), F.col("text"), who),
        "json": lambda: F.to_json(F.struct(*[c for c in rows.columns if c not in ("file_id", "seg_idx")])),
    }
    if form not in line:
        raise ValueError(f"unknown format {form!r}")
    out = rows.select("file_id", (n - 1).cast("long").alias("n"), line[form]().alias("line"))
    head = {"vtt": "WEBVTT\n", "tsv": "start\tend\ttext"}.get(form)
    return out if head is None else out.unionByName(rows.select("file_id").distinct().select("file_id", F.lit(-1).cast("long").alias("n"), F.lit(head).alias("line")))


class _Commit(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.names = names


class CaptionWriter(DataSourceWriter):
    """One file per file_id on any file system: rows are streamed to a staging folder of the job, from which the commit moves them.

    What failed or repeated tasks leave is only in that folder, which goes with the commit or the abort. Two file_ids of one
    name end the job before any file is moved, a null file_id when it is met.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.form, self.language = options["path"].rstrip("/"), options.get("form", "txt"), options.get("language")
        self.opener, self.staging = options.get("opener"), f"_staging-{uuid.uuid4().hex}"

    def store(self):
        fs, root = files.open_store(self.root, self.opener)
        return fs, root, f"{root}/{self.staging}"

    def write(self, rows: Iterator) -> _Commit:
        fs, _, staging = self.store()
        fs.create_dir(staging, recursive=True)
        head, between, tail = ('{"segments": [', ", ", f'], "language": {json.dumps(self.language, ensure_ascii=False)}}}') if self.form == "json" else ("", "\n", "\n")
        names: list[tuple[str, str]] = []
        for file_id, part in itertools.groupby(rows, key=lambda r: r["file_id"]):
            if file_id is None:
                raise ValueError("captions without a file_id have no file to go to")
            names.append((uuid.uuid4().hex, f"{Path(file_id).stem}.{self.form}"))
            with fs.open_output_stream(f"{staging}/{names[-1][0]}", compression=None, buffer_size=1 << 16) as f:
                f.write(head.encode())
                for k, r in enumerate(part):
                    f.write(((between if k else "") + r["line"]).encode("utf-8", "replace"))
                f.write(tail.encode())
        return _Commit(names)

    def commit(self, messages: list) -> None:
        fs, root, staging = self.store()
        names = [x for m in messages if m for x in m.names]
        if twice := sorted(n for n, k in Counter(n for _, n in names).items() if k > 1):
            fs.delete_dir(staging)
            raise ValueError(f"several files would be {', '.join(twice[:5])}")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.move(f"{staging}/{x[0]}", f"{root}/{x[1]}"), names))
        self.clear(fs, staging)

    def abort(self, messages: list) -> None:
        fs, _, staging = self.store()
        self.clear(fs, staging)

    def clear(self, fs, staging: str) -> None:
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)


class CaptionSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return "file_id string, n long, line string"

    def writer(self, schema, overwrite: bool) -> CaptionWriter:
        return CaptionWriter(dict(self.options))


def write_subtitles(rows: DataFrame, directory: str, form: str = "srt", speaker: str | None = None, language: str | None = None, opener: str | None = None) -> None:
    """One file per file_id in a directory or URI that all executors reach, in one format, or in ALL of them for 'all'.

    opener: see files.open_store.
    """
    rows.sparkSession.dataSource.register(CaptionSink)
    for f in ALL if form == "all" else (form,):
        lines = render(rows, f, speaker).select(F.col("file_id").cast("string").alias("file_id"), "n", "line")
        out = lines.repartition("file_id").sortWithinPartitions("file_id", "n").write.format("captions").option("form", f).mode("append")
        for name, value in (("language", language), ("opener", opener)):
            out = out.option(name, value) if value else out
        out.save(directory)
