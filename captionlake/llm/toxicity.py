"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition, then a linear model scores.

Most words pass unchanged: they have only letters and none twice in a row, so their lattice has one path. Any other word,
and any run of single characters set apart, whatever its length, becomes a lattice: each sign may stand for itself or for the letters that it
is used for, marks between letters may be nothing, and a repeated letter may be one. Viterbi search picks the path that
a character trigram model, counted over all documents, and the channel's prices make likeliest. The score is a logistic
regression on presence of words and word beginnings of the restored text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import BASE1, BASE3, Memo, Scratch, held, lower_ascii, slices, string_bytes, word_hashes

#: What a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "§": "s", "¢": "c", "#": "h", "%": "o", "&": "a"}
#: What may be nothing between letters (fixed values).
MARKS = ".-_*~'`,:;/\\^=·•|+"
KEEP, SUBSTITUTE, DROP_MARK, DROP_REPEAT, BREAK = -0.05, -1.0, -0.3, -0.2, -6.0

CLASSES = 64
#: A run of three or more single signs set apart by spaces; else a word.
_TOKEN = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}|\S+")
#: Every run has this at its second sign; a text without it has only words.
_RUN = re.compile(r"[ \t]\S[ \t]+\S(?!\S)")
#: A letter twice in a row, blanks, and signs that may stand for something else or for nothing: a lattice of several paths.
_ODD = re.compile(rf"([^\W\d_])\1|[ \t{re.escape(''.join(LEET) + MARKS)}]")
#: A letter twice in a row; three times or more; words that are counted; addresses, and numbers with a letter after them.
_TWICE, _LONGER, _KNOWABLE = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1{2,}"), re.compile(r"[^\W_]+(?:'[^\W_]+)*\Z")
_PLAIN = re.compile(r"://|^www\.|\S@\S+\.\w|^\d+(?:[.,:/-]\d+)*[a-zµ°%]{0,3}$|^[0-9a-f]{12,}$")
#: Signs that may decorate the end of a word.
_DECORATION = "!$|+€£<>(§¢#%&@"
#: Occurrences from which a word with odd signs counts as known; times that a plain word's new form must be more frequent.
KNOWN, DOUBTFUL = 5, 4
#: Signs after which the search sets aside what all its paths have in common.
COMMIT = 32


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text) if _RUN.search(text) else text.split()


def _class_table() -> np.ndarray:
    """Code point -> class: 1 to 26 are a to z, 0 is a boundary, other letters share 27 to 63."""
    table = np.zeros(0x10000, dtype=np.int32)
    for cp in range(0x10000):
        c = chr(cp)
        if "a" <= c <= "z":
            table[cp] = cp - 96
        elif c.isalpha():
            table[cp] = 27 + cp % 37
    return table


_CLASS: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _CLASS:
        _CLASS.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(points < 0x10000, _CLASS[0][np.minimum(points, 0xFFFF)], 0)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character-class trigrams over every whole text; 64**3 cells however many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for part in slices(batches):
            c = classes("\n\n" + "\n\n".join(x.lower() for x in part.column(0).to_pylist() if x) + "\n\n")
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # at most 64**3 rows of 12 bytes
    out = np.zeros(CLASSES**3, dtype=np.int64)
    out[table["gram"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out


#: Cells of the words' counts: a fixed table, in which rare words share cells and frequent ones stand out.
WORD_CELLS = 1 << 18
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256), ord("'")]] = True
_M64 = (1 << 64) - 1
#: Powers of the hash's base for words of up to 64 bytes, and what the bytes' own ones add to a word of so many bytes.
_POWERS = tuple(pow(BASE1, k, 1 << 64) for k in range(64))
_OFFSETS = tuple((sum(_POWERS[:k]) + k * BASE3) & _M64 for k in range(65))


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of words (letters, digits and apostrophes, small) in every whole text, by hashed cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_CELLS, dtype=np.int64)
        for part in slices(batches):
            data, offs = string_bytes(part.column(0))
            low = lower_ascii(data)
            inside = np.zeros(len(low) + 2, dtype=bool)
            inside[1:-1] = _WORD[low]
            starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            cells = word_hashes(low, starts, ends) & np.uint64(WORD_CELLS - 1)
            np.add.at(total, cells.astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])

    # a blank after each text, so that words of two texts don't meet
    rows = docs.select(F.concat(F.col("text").cast("string"), F.lit(" ")).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # at most WORD_CELLS rows of 12 bytes
    out = np.zeros(WORD_CELLS, dtype=np.int64)
    out[table["cell"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out


def word_cell(word: str) -> int:
    """The cell of one word, as word_counts() has it."""
    data = word.encode("utf-8", "replace")
    if len(data) <= 64:
        x = sum(map(mul, data, _POWERS)) + _OFFSETS[len(data)] & _M64
    else:
        x, power = len(data) * BASE3, 1
        for b in data:
            x += (b + 1) * power
            power = power * BASE1 & _M64
        x &= _M64
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M64
    return (x ^ x >> 31) & (WORD_CELLS - 1)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), each order smoothed by the one below it."""
    n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
    p3 = (n3 + 8 * p2) / (n3.sum(2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Restores words under one language model and, where they are given, the words' counts."""

    def __init__(self, lm: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.lm, self.counts = lm, counts
        self._flat = lm.ravel().tolist()
        self._code: dict[str, int] = {}

    @staticmethod
    def suspicious(word: str) -> bool:
        """Whether the lattice of a word (without marks at its ends) has more than one path."""
        return bool(_ODD.search(word))

    @staticmethod
    def lattice(word: str, twice: bool = False) -> list[list[tuple[str, float]]]:
        """twice: a letter that stands twice in a row stays so."""
        out, last = [], ""
        for c in word:
            if c.isalpha():
                arcs = [(c, KEEP)] + ([("", DROP_REPEAT)] if c == last and not twice else [])
                last = c
            elif c in " \t":
                arcs = [("", DROP_MARK), (" ", BREAK)]
            else:
                arcs = [(x, SUBSTITUTE) for x in LEET.get(c, "")]
                if any(x == last for x, _ in arcs):
                    arcs.append(("", SUBSTITUTE + DROP_REPEAT))
                arcs += [("", DROP_MARK)] if c in MARKS else []
                arcs.append((c, KEEP + BREAK))
            out.append(arcs)
        return out

    def decode(self, word: str, twice: bool = False) -> str:
        """The likeliest path; a state is the last two classes, and ties keep the path found first.

        What all paths have in common is set aside as the search goes on, so a path holds only its own end.
        """
        lm, codes, done = self._flat, self._code, []
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for at, arcs in enumerate(self.lattice(word, twice), 1):
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for c, price in arcs:
                if c and c not in codes:
                    codes[c] = int(classes(c)[0])
                k = codes[c] if c else -1
                for (a, b), (p, said) in best.items():
                    state, q = ((a, b), p + price) if k < 0 else ((b, k), p + price + lm[(a * CLASSES + b) * CLASSES + k])
                    if state not in step or q > step[state][0]:
                        step[state] = (q, said + c)
            best = step
            if at % COMMIT == 0 and (common := commonprefix([said for _, said in best.values()])):
                done.append(common)
                best = {state: (p, said[len(common) :]) for state, (p, said) in best.items()}
        return "".join(done) + max(best.items(), key=lambda x: x[1][0] + lm[(x[0][0] * CLASSES + x[0][1]) * CLASSES])[1][1]

    def word(self, token: str) -> list[str]:
        """Restored words of a token, without marks at their ends."""
        token = token.lower()
        bare = token.strip(".,;:?\"'()[]{}<>*%&#~_-=/\\`…«»¿")
        if not self.suspicious(bare):
            return [bare] if bare else []
        if self.counts is not None:
            return self._likeliest(bare)
        return self._words(self.decode(bare))

    @staticmethod
    def _words(said: str) -> list[str]:
        return [x for x in (y.strip(".,;:!?") for y in said.split()) if x]

    def known(self, words: list[str]) -> int:
        """How often the rarest of the words occurs in all documents."""
        least = 0
        for k, w in enumerate(words):
            n = int(self.counts[word_cell(w)]) if _KNOWABLE.match(w) else 0
            least = min(least, n) if k else n
        return least

    def _likeliest(self, bare: str) -> list[str]:
        """The search's word, or what it is if letters stay that stand twice, whichever is known better; but the word as it
        stands if it has no letters, is an address or a number, or is known better than what it would become."""
        if _PLAIN.search(bare) or not any(c.isalpha() for c in bare):
            return [bare]
        if bare.isalpha() and not _LONGER.search(bare):
            return self._once(bare)
        found = [self._words(self.decode(bare))]
        if _TWICE.search(bare):
            found.append(self._words(self.decode(_LONGER.sub(r"\1\1", bare), True)))
        best = max(found, key=self.known)  # of equals the first
        if (trimmed := bare.rstrip(_DECORATION)) != bare and trimmed:
            # signs at the end mean nothing, unless they make a word that is known far better
            plain = self._likeliest(trimmed) if self.suspicious(trimmed) else [trimmed]
            best = best if self.known(best) >= max(KNOWN, DOUBTFUL * self.known(plain)) else plain
        own, new = self.known([bare]), self.known(best)
        return [bare] if own >= KNOWN and new < own else best

    def _once(self, bare: str) -> list[str]:
        """A word of letters, some of them twice: what the search makes of it if that is known far better.

        The search can only leave out one of each two; where no such word is known far better, it need not run.
        """
        least, spots = DOUBTFUL * self.known([bare]) + 1, [m.start() for m in _TWICE.finditer(bare)]
        if len(spots) <= 4:
            forms, start = [""], 0
            for at in spots:
                forms = [x + bare[start:at] + c for c in (bare[at], "") for x in forms]
                start = at + 1
            # the first has lost nothing
            if not any(self.known([x + bare[start:]]) > least for x in forms[1:]):
                return [bare]
        best = self._words(self.decode(bare))
        return best if self.known(best) > least else [bare]

    def restore(self, text: str) -> str:
        return " ".join(x for t in tokens_of(text) for x in self.word(t))


def feature(name: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace")) - (1 << 63)


#: Letters of the beginnings that are features of longer words.
BEGINNINGS = (4, 5)


def word_features(word: str) -> list[int]:
    """The word and its beginnings."""
    return [feature(f"={word}"), *(feature(f"^{word[:n]}") for n in BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class Settings:
    """The fit reads at most sample_per_label labelled rows of each label; everything else covers all rows."""

    sample_per_label: int = 3000
    max_features: int = 4096
    min_documents: int = 4
    min_association: float = 12.0
    threshold: float = 0.5


@dataclass
class Model:
    lm: np.ndarray
    features: dict[int, float]
    bias: float
    words: np.ndarray | None = None

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.features[f] for f in found)
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))


class Beginnings(Memo):
    """Beginning of a longer word -> the model's features in it."""

    def __init__(self, model: Model) -> None:
        super().__init__(20_000)
        self.model = model

    def compute(self, key: str) -> tuple[int, ...]:
        return tuple(f for n in BEGINNINGS if n <= len(key) and (f := feature(f"^{key[:n]}")) in self.model.features)


class Scorer(Memo):
    """token -> the model's features in its restored words, filled as tokens come up."""

    def __init__(self, model: Model) -> None:
        super().__init__(100_000)
        self.model, self.restorer, self.beginnings = model, Restorer(model.lm, model.words), Beginnings(model)

    def compute(self, key: str) -> tuple[int, ...]:
        found: set[int] = set()
        for w in self.restorer.word(key):
            if (f := feature(f"={w}")) in self.model.features:
                found.add(f)
            if len(w) > BEGINNINGS[0] and (more := self.beginnings[w[: min(len(w) - 1, BEGINNINGS[-1])]]):
                found.update(more)
        return tuple(found)

    def score(self, text: str) -> float:
        found: set[int] = set()
        for fs in map(self.__getitem__, set(tokens_of(text))):
            if fs:
                found.update(fs)
        return self.model.score(found)


def scorer_of(model: Model) -> Scorer:
    """One table for all tasks of a Python worker that score by the same model."""
    return held(("scorer", model.bias, tuple(model.features.items()), model.lm.tobytes(), None if model.words is None else model.words.tobytes()), lambda: Scorer(model))


def chosen_features(found: DataFrame, n_pos: int, n: int, settings: Settings) -> list[int]:
    """The features most tied to the label, by G-test; ties by number. found: doc rows of toxic and found (distinct features)."""
    counts = found.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("all")).where(F.col("all") >= settings.min_documents)
    pos, neg, all_ = (x.cast("double") for x in (F.col("pos"), F.col("all") - F.col("pos"), F.col("all")))
    g = F.lit(0.0)
    for seen, rows in ((pos, n_pos), (neg, n - n_pos)):
        for o, e in ((seen, all_ * rows / n), (F.lit(rows) - seen, (F.lit(n) - all_) * rows / n)):
            g = g + F.when(o > 0, 2 * o * F.log(o / F.greatest(e, F.lit(1e-9)))).otherwise(0.0)
    best = counts.withColumn("g", F.round(g, 9)).where(F.col("g") >= settings.min_association).orderBy(F.desc("g"), "f").limit(settings.max_features)
    return [r["f"] for r in best.select("f").collect()]


def fit(rows: list[tuple[int, np.ndarray]], features: list[int], lm: np.ndarray, words: np.ndarray | None = None) -> Model:
    """Logistic regression; rows are (label, places of its features in `features`)."""
    labels = np.array([y for y, _ in rows], dtype=float)
    n_pos, n = labels.sum(), len(rows)
    if not n or n_pos in (0, n):
        return Model(lm, {}, float(np.log((n_pos + 0.5) / (n - n_pos + 0.5))), words)
    c = np.concatenate([f for _, f in rows]).astype(np.int64)
    r = np.repeat(np.arange(n), [len(f) for _, f in rows])
    w, b = np.zeros(len(features)), 0.0
    share = np.where(labels == 1, 0.5 / n_pos, 0.5 / (n - n_pos))
    sum_w, sum_b = np.full(len(features), 1e-8), 1e-8
    for _ in range(400):
        z = b + np.bincount(r, w[c], n)
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * share
        gw, gb = np.bincount(c, e[r], len(features)) + 1e-5 * w, e.sum()
        sum_w, sum_b = sum_w + gw**2, sum_b + gb**2
        w, b = w - 0.5 * gw / np.sqrt(sum_w), b - 0.5 * gb / np.sqrt(sum_b)
    return Model(lm, dict(zip(features, w.tolist(), strict=True)), float(b), words)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> Model:
    """The language model and the words' counts of all documents, and the classifier of a bounded sample of the labelled rows not held out.

    A label without its document, without an id or other than 0 and 1 is left out; of an id labelled twice the higher label
    counts; different texts of one id are all used, repeated rows once, and never more texts than ids could be picked. What comes to the driver:
    two tables of 2**18 counts, max_features features, and for each sampled text the places of those among them.
    """
    lm, counts = language_model(trigram_counts(docs)), word_counts(docs)
    words = np.minimum(counts, (1 << 31) - 1).astype(np.int32)
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    picks = None
    for y in (0, 1):
        some = marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_per_label)
        picks = some if picks is None else picks.unionByName(some)
    sample = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id")  # at most 2 * sample_per_label ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(lm, words)
        for part in slices(batches):
            out = [sorted({f for t in set(tokens_of(text or "")) for w in restorer.word(t) for f in word_features(w)}) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "toxic", "key", "found"])

    found = sample.select("doc_id", F.col("text").cast("string"), "toxic", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, "doc_id long, toxic int, key long, found array<long>")
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(found, "features")
    # the order is by numbers alone: the texts' features don't pass through it
    kept = scratch.table(found.select("doc_id", "key").distinct().orderBy("doc_id", "key").limit(2 * settings.sample_per_label), "sampled")
    tables = (found, kept)
    found = found.join(F.broadcast(kept), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    totals = found.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n = totals["pos"] or 0, totals["n"]
    features = chosen_features(found, n_pos, n, settings) if 0 < n_pos < n else []
    at = {f: k for k, f in enumerate(features)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array([at[f] for f in found if f in at], dtype="<u2").tobytes() for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["toxic", "places"])

    rows = [(r["toxic"], np.frombuffer(r["places"], "<u2")) for r in found.select("toxic", "found").mapInArrow(places, "toxic int, places binary").collect()]
    scratch.drop(*tables)
    return fit(sorted(rows, key=lambda x: (x[0], x[1].tobytes())), features, lm, words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Defined cases: a null or empty text has the score of no features; null ids stay null and count as held out;
    repeated rows each give a row; no rows give none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for part in slices(batches, keep=True):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([scorer.score(x or "") for x in part.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold, in the columns given, whatever their names; see score()."""
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for part in slices(batches, at, keep=True):
            yield part.filter(pa.array([scorer.score(x or "") < threshold for x in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
