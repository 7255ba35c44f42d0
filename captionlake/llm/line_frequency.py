"""Quality rules with cross-document line frequency.

A line that many different documents of one host share is boilerplate. Lines are normalised and hashed where the
documents lie; for each (host, line) the distinct documents are counted; lines above the limits are removed, and a
document that loses most of its words is rejected, as is one that fails the base rules. Exact copies of a document count
once, so that a copied document is not taken for boilerplate. The limit is a number of documents, alike for hosts of
every size: a line that 11 documents of a host share goes whether the host has 30 documents or 30 million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import BASE2, Prefix, Scratch, renamed, renamed_column, row_key, signed, slices, string_bytes, word_hashes, word_spans


@dataclass(frozen=True)
class Limits:
    """A line goes if more than max_documents different documents of its host hold it; see verdict() for the rest."""

    max_documents: int = 10
    min_kept_share: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50


_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_SPACES = " \t\n\x0b\x0c\r"


def normal_line(line: str) -> str:
    return " ".join(line.lower().split())


def line_hashes(lines: list[str]) -> np.ndarray:
    """64-bit hashes of normalised lines; 0 for lines without text."""
    data = [normal_line(x).encode("utf-8", "replace") for x in lines]
    sizes = np.array([len(x) for x in data], dtype=np.int64)
    ends = np.cumsum(sizes)
    out = word_hashes(np.frombuffer(b"".join(data), dtype=np.uint8), ends - sizes, ends) if ends[-1:].sum() else np.zeros(len(lines), np.uint64)
    return signed(np.where(sizes > 0, out, np.uint64(0)))


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols and n_repeat_words (words in 3-word windows found twice in it)."""
    n = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])
    solid = np.zeros(len(data) + 1, dtype=np.int8)
    solid[starts] += 1
    np.add.at(solid, ends, -1)
    chars = (np.cumsum(solid[:-1], dtype=np.int8) > 0) & (data & 0xC0 != 0x80)
    covered = np.zeros(len(starts), dtype=bool)
    if len(starts) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        h = Prefix(word_hashes(data, starts, ends), BASE2).hashes(at, at + 3) + doc[at].astype(np.uint64) * np.uint64(BASE2)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        for k in range(3):
            covered[twice + k] = True
    return {"n_words": np.bincount(doc, minlength=n), "word_chars": per(chars), "n_symbols": per(_SYMBOL[data]), "n_repeat_words": np.bincount(doc[covered], minlength=n)}


_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, _rk, _tk (of the text alone: copies count once), host, the base counts, and lines (hash and words of each distinct normalised line)."""
    names = ["doc_id", "_rk", "_tk", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = base_counts(*string_bytes(part.column(4)))
            dup, lines = [], []
            for text in part.column(4).to_pylist():
                own = [x for x in (text or "").split("\n") if x.strip(_SPACES)]
                dup.append(len(own) - len(set(own)))
                words: dict[int, int] = {}
                for h, x in zip(line_hashes(own).tolist(), own, strict=True):
                    words[h] = words.get(h, 0) + len(x.encode("utf-8", "replace").split())
                words.pop(0, None)
                lines.append([{"h": h, "w": w} for h, w in words.items()])
            counts["n_dup_lines"] = dup
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *(pa.array(counts[k], pa.int64()) for k in names[4:9]), pa.array(lines, _LINES)], names)

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("_rk"), F.xxhash64("text").alias("_tk"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, _rk long, _tk long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>")


def frequent_lines(measured: DataFrame, limits: Limits) -> DataFrame:
    """(host, h) of the lines above the limits. Counts are pre-aggregated; no host or line meets in one task unsummed."""
    exploded = measured.select("host", "_tk", F.explode("lines").alias("line")).select("host", F.col("line.h").alias("h"), "_tk")
    return exploded.groupBy("host", "h").agg(F.countDistinct("_tk").alias("n")).where(F.col("n") > limits.max_documents).select("host", "h")


def verdict(limits: Limits, words: Column, repeats: Column, removed: Column) -> tuple[Column, Column]:
    """(base_failed, kept)."""
    failed = (words < limits.min_words) | (repeats * 100 > words * limits.max_repeat_percent)
    return failed, ~failed & (words - removed >= words * limits.min_kept_share)


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _rk, base counts, n_removed_words, base_failed, kept; removed line hashes by doc_id and _rk).

    Defined cases: a null text has no words and fails; a null host is the empty host; null ids stay null; repeated rows
    each get a row and count as one document; no rows give none; other columns are not read.
    """
    measured = (scratch or Scratch(docs.sparkSession)).table(measure(docs, host), "lines")
    return judged(measured, frequent_lines(measured, limits), limits)


def judged(measured: DataFrame, heavy: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    # each row's lines once: repeated rows share _rk, so they are made distinct before the join back
    lines = measured.select("doc_id", "_rk", "host", F.explode("lines").alias("line")).select("doc_id", "_rk", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    removed = lines.join(heavy, ["host", "h"], "left_semi").distinct()
    sums = removed.groupBy("doc_id", "_rk").agg(F.sum("w").alias("_removed"))
    a, b = measured.drop("lines", "_tk").alias("a"), sums.withColumnRenamed("doc_id", "_id").withColumnRenamed("_rk", "_k").alias("b")
    out = a.join(b, (F.col("a._rk") == F.col("b._k")) & F.col("a.doc_id").eqNullSafe(F.col("b._id")), "left").drop("_id", "_k")
    out = out.withColumn("n_removed_words", F.coalesce("_removed", F.lit(0).cast("long"))).drop("_removed")
    failed, kept = verdict(limits, F.col("n_words"), F.col("n_repeat_words"), F.col("n_removed_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", kept), removed.select("doc_id", "_rk", "h")


def digest(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return judge(docs, limits)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


#: Frequent lines that are sent to all workers at most (24 bytes each); more of them are joined to the documents.
MOST_SENT = 200_000


def clean(docs: DataFrame, limits: Limits = Limits(), host: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The kept documents, in the columns given, without the lines above the limits; n_chars, if there, follows the text.

    Defined cases: those of judge(); repeated rows are judged alike, and stay or go together; columns may have any names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    measured = scratch.table(measure(docs, host), "lines")
    heavy = scratch.table(frequent_lines(measured, limits), "heavy")
    sent = heavy.limit(MOST_SENT + 1).collect()
    if len(sent) <= MOST_SENT:
        scratch.drop(measured, heavy)
        return _strip_sent(docs, {(r["host"], r["h"]) for r in sent}, limits, host)
    return _strip_joined(docs, measured, heavy, limits)


def _without(text: str, gone) -> tuple[str, int]:
    """(text without the lines whose hash is gone, words removed)."""
    lines = text.split("\n")
    out = [(x in gone and bool(x), y) for x, y in zip(line_hashes(lines).tolist(), lines, strict=True)]
    return "\n".join(y for off, y in out if not off), sum(len(y.encode("utf-8", "replace").split()) for off, y in out if off)


def _rewritten(part: pa.RecordBatch, docs_columns: list[str], schema, texts: list) -> pa.RecordBatch:
    """The batch's first columns with other texts; n_chars follows."""
    cols = [part.column(k) for k in range(len(schema))]
    for k, name in enumerate(docs_columns):
        if name == "text":
            cols[k] = pa.array(texts, cols[k].type)
        elif name == "n_chars":
            cols[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[k].type)
    return pa.RecordBatch.from_arrays(cols, names=schema.names)


def _strip_sent(docs: DataFrame, heavy: set, limits: Limits, host: str) -> DataFrame:
    """One pass over the texts, without a shuffle."""
    at, where, schema, names = docs.columns.index("text"), docs.columns.index(host), docs.schema, docs.columns
    by_host: dict[str, set[int]] = {}
    for h, line in heavy:
        by_host.setdefault(h, set()).add(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            counts = base_counts(*string_bytes(part.column(at)))
            texts, keep = part.column(at).to_pylist(), []
            for k, (text, source) in enumerate(zip(texts, part.column(where).cast(pa.string()).to_pylist(), strict=True)):
                n, removed = int(counts["n_words"][k]), 0
                if text and (gone := by_host.get(source or "")):
                    cut, removed = _without(text, gone)
                    texts[k] = cut if removed else text
                failed = n < limits.min_words or 100 * int(counts["n_repeat_words"][k]) > limits.max_repeat_percent * n
                keep.append(not failed and n - removed >= n * limits.min_kept_share)
            yield _rewritten(part, names, schema, texts).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def _strip_joined(docs: DataFrame, measured: DataFrame, heavy: DataFrame, limits: Limits) -> DataFrame:
    rows, removed = judged(measured, heavy, limits)
    kept = rows.where("kept").select(F.col("doc_id").alias("id"), F.col("_rk").alias("k")).distinct()
    gone = removed.groupBy("doc_id", "_rk").agg(F.collect_set("h").alias("gone"))
    kept = kept.join(gone, (F.col("k") == F.col("_rk")) & F.col("id").eqNullSafe(F.col("doc_id")), "left").select("id", "k", "gone")
    own = renamed_column(docs, "doc_id")
    joined = renamed(docs).join(kept, (F.xxhash64(own, renamed_column(docs, "text")) == F.col("k")) & own.cast("long").eqNullSafe(F.col("id")))
    at, schema, names = docs.columns.index("text"), docs.schema, docs.columns

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts, gones = part.column(at).to_pylist(), part.column(len(schema)).to_pylist()
            for k, g in enumerate(gones):
                if g:
                    texts[k] = _without(texts[k], set(g))[0]
            yield _rewritten(part, names, schema, texts)

    return joined.select(*renamed(docs).columns, "gone").mapInArrow(strip, schema)
