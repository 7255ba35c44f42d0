"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its distinct words share one unit of length over 2**14 hashed places, and each statistic
of its structure and each metadata column puts a 1 at the place of its level. The machine gives every place a weight w and
a short vector v, so that any two features have an interaction v_i . v_j, and scores

    b + sum_i w_i x_i + sum_{i<j} (v_i . v_j) x_i x_j.

The double sum is half of (sum_i v_i x_i)**2 - sum_i (v_i x_i)**2 over the vectors' places, so a score takes one pass over
the document's features. Everything but the fit runs over whole texts of all rows in the tasks; the fit gets the places of
a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import Scratch, lower_ascii, slices, string_bytes, word_hashes, word_spans

WORD_PLACES, LEVELS = 1 << 14, 32
#: Bytes of one text that are measured at once; a longer text is cut at blanks and its counts are summed.
PIECE = 1 << 22
#: Shares of the words, or of the bytes, each as levels of its square root.
STATISTICS = ("words", "word_length", "distinct", "most_frequent", "lines", "symbols", "digits", "capitals", "stops", "not_ascii")


def _marks(of: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(of)] = True
    return out


_CLASSES = {"lines": _marks(b"\n"), "symbols": _marks(b"#*$%&|<>"), "digits": _marks(b"0123456789"), "capitals": _marks(bytes(range(65, 91))), "stops": _marks(b".!?"), "not_ascii": _marks(bytes(range(128, 256)))}


@dataclass(frozen=True)
class Settings:
    """The fit reads at most sample_per_label labelled rows of each label; everything else covers all rows."""

    sample_per_label: int = 3000
    factors: int = 6
    steps: int = 80
    rate: float = 0.15
    penalty: float = 1e-4
    threshold: float = 0.5


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, whose features are (rows, places, values)."""
        return _sigmoid(margins(self.bias, self.weights, self.vectors, rows, places, values, n)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def margins(bias, weights, vectors, rows, places, values, n) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic function, sum of v x of each document), by the identity of the sum of squares."""
    z = bias + np.bincount(rows, weights[places] * values, n)
    sums = np.empty((n, vectors.shape[1]))
    for k in range(vectors.shape[1]):
        vx = vectors[places, k] * values
        sums[:, k] = np.bincount(rows, vx, n)
        z += 0.5 * (sums[:, k] ** 2 - np.bincount(rows, vx**2, n))
    return z, sums


def fit(labels: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray, size: int, settings: Settings = Settings()) -> Machine:
    """Full-batch steps with rates by each place's past gradients; both labels weigh the same; the same rows give the same machine."""
    n, pos = len(labels), float(np.sum(labels))
    if pos in (0, n):
        return Machine(float(np.log((pos + 0.5) / (n - pos + 0.5))), np.zeros(size), np.zeros((size, settings.factors)))
    share = np.where(labels == 1, 0.5 / pos, 0.5 / (n - pos))
    used, at = np.unique(places, return_inverse=True)
    bias, w = 0.0, np.zeros(len(used))
    v = np.random.default_rng(11).normal(0, 0.05, (len(used), settings.factors))
    past_b, past_w, past_v = 1e-8, np.full(len(used), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(settings.steps):
        z, sums = margins(bias, w, v, rows, at, values, n)
        error = (_sigmoid(z) - labels) * share
        ex = error[rows] * values
        grad_w = np.bincount(at, ex, len(used)) + settings.penalty * w
        exx = np.bincount(at, ex * values, len(used))
        grad_v = settings.penalty * v - exx[:, None] * v
        for k in range(v.shape[1]):
            grad_v[:, k] += np.bincount(at, ex * sums[rows, k], len(used))
        past_b, past_w, past_v = past_b + error.sum() ** 2, past_w + grad_w**2, past_v + grad_v**2
        bias -= settings.rate * error.sum() / np.sqrt(past_b)
        w -= settings.rate * grad_w / np.sqrt(past_w)
        v -= settings.rate * grad_v / np.sqrt(past_v)
    weights, vectors = np.zeros(size), np.zeros((size, settings.factors))
    weights[used], vectors[used] = w, v
    return Machine(float(bias), weights, vectors)


# ------------------------------------------------------------------- features


def _measured(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(document * WORD_PLACES + place of each distinct word place, how often each, counts of each document)."""
    n = len(offs) - 1
    low = lower_ascii(data)
    starts, ends, doc = word_spans(low, offs)
    places = (word_hashes(low, starts, ends) & np.uint64(WORD_PLACES - 1)).astype(np.int64)
    keys, times = np.unique(doc * WORD_PLACES + places, return_counts=True)
    counts = {"words": np.bincount(doc, minlength=n), "word_bytes": np.bincount(doc, ends - starts, n).astype(np.int64), "bytes": np.diff(offs)}
    for name, marks in _CLASSES.items():
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(marks[data], out=total[1:])
        counts[name] = np.diff(total[offs])
    return keys, times, counts


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text, cut at blanks."""
    start = 0
    while start < len(data):
        blanks = np.flatnonzero(data[start + PIECE :][: 1 << 16] == 32)
        end = start + PIECE + int(blanks[0]) if len(blanks) else start + PIECE if start + PIECE < len(data) else len(data)
        yield data[start:end]
        start = end


def _measured_whole(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    if len(offs) != 2 or len(data) <= PIECE:
        return _measured(data, offs)
    total, counts = np.zeros(WORD_PLACES, dtype=np.int64), None
    for piece in _pieces(data):
        keys, times, more = _measured(piece, np.array([0, len(piece)]))
        total[keys] += times
        counts = more if counts is None else {k: counts[k] + more[k] for k in more}
    keys = np.flatnonzero(total)
    return keys, total[keys], counts


def _level(share: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(LEVELS * np.sqrt(share)), 0, LEVELS - 1).astype(np.int64)


def _log_level(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(np.maximum(x, 0) + 1) * 1.25), 0, LEVELS - 2).astype(np.int64)


def places_of(data: np.ndarray, offs: np.ndarray, metadata: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, values) of the features of a batch of texts; metadata: floats, NaN where there is none."""
    n = len(offs) - 1
    keys, times, c = _measured_whole(data, offs)
    doc = keys // WORD_PLACES
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, doc, times)
    words, size = np.maximum(c["words"], 1), np.maximum(c["bytes"], 1)
    levels = {
        "words": _log_level(c["words"]),
        "word_length": _level(np.minimum(c["word_bytes"] / words / 32, 1)),
        "distinct": _level(distinct / words),
        "most_frequent": _level(most / words),
        "lines": _level(np.minimum(c["lines"] / words, 1)),
        **{k: _level(np.minimum(c[k] / words, 1)) for k in ("symbols", "digits", "stops")},
        **{k: _level(c[k] / size) for k in ("capitals", "not_ascii")},
    }
    extra = [levels[k] for k in STATISTICS] + [np.where(np.isnan(x), LEVELS - 1, _log_level(np.nan_to_num(x))) for x in metadata]
    rows = [doc, *([np.arange(n)] * len(extra))]
    places = [keys % WORD_PLACES, *(WORD_PLACES + k * LEVELS + level for k, level in enumerate(extra))]
    values = [1 / np.sqrt(distinct[doc]), *([np.ones(n)] * len(extra))]
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def size_of(metadata: Sequence[str]) -> int:
    return WORD_PLACES + (len(STATISTICS) + len(metadata)) * LEVELS


def _numbers(part: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(first, part.num_columns)]


# ---------------------------------------------------------------------- Spark


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _metadata(docs: DataFrame, metadata: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") if c in docs.columns else F.lit(None).cast("double") for c in metadata]


def train(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = (), settings: Settings = Settings(), scratch: Scratch | None = None) -> Machine:
    """The machine of a bounded sample of the labelled rows that are not held out.

    A label without its document, without an id or other than 0 and 1 is left out; of an id labelled twice the lower label
    counts; repeated rows count once, and never more texts are used than ids could be picked. The driver gets two bytes for
    each distinct word place of a sampled text. Without one of the labels the score is their smoothed share.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(~held_out())
    picks = None
    for y in (0, 1):
        some = marked.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_per_label)
        picks = some if picks is None else picks.unionByName(some)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(c.alias(f"_m{k}") for k, c in enumerate(_metadata(docs, metadata))))
    found = found.join(F.broadcast(picks), "doc_id")  # at most 2 * sample_per_label ids
    rows = found.select("quality", "doc_id", F.xxhash64("text").alias("key"), "text", *(f"_m{k}" for k in range(len(metadata))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            r, p, _ = places_of(*string_bytes(part.column(3)), _numbers(part, 4))
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(part.num_rows + 1))
            p = p[order].astype("<u2")
            out = [p[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(out, pa.binary())], ["quality", "doc_id", "key", "places"])

    scratch = scratch or Scratch(docs.sparkSession)
    table = scratch.table(rows.mapInArrow(run, "quality int, doc_id long, key long, places binary"), "places")
    sample = table.dropDuplicates(["doc_id", "key"]).orderBy("doc_id", "key").limit(2 * settings.sample_per_label).collect()
    scratch.drop(table)
    extra = len(STATISTICS) + len(metadata)
    places = [np.frombuffer(r["places"], "<u2").astype(np.int64) for r in sample]
    values = [np.concatenate([np.full(len(p) - extra, 1 / np.sqrt(max(1, len(p) - extra))), np.ones(extra)]) for p in places]
    of = np.repeat(np.arange(len(sample)), [len(p) for p in places])
    whole = lambda x: np.concatenate([np.empty(0), *x])
    return fit(np.array([r["quality"] for r in sample], dtype=float), of, whole(places).astype(np.int64), whole(values), size_of(metadata), settings)


def score(docs: DataFrame, machine: Machine, metadata: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; one pass, without a shuffle.

    Defined cases: a null or empty text has the score of no words; null metadata, or a column that is not there, has a level
    of its own; null ids stay null; repeated rows each give a row; no rows give none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            found = machine.scores(*places_of(*string_bytes(part.column(2)), _numbers(part, 3)), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"), *(c.alias(f"_m{k}") for k, c in enumerate(_metadata(docs, metadata))))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
