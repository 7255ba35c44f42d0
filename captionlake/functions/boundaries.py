"""Sentence boundaries of spaced languages, learnt from texts without labels (after Kiss and Strunk, 2006).

A word that nearly always ends in a period, and is short, is an abbreviation: its counts with and without a period are
compared by a log-likelihood ratio. Words that follow certain sentence ends far more often than chance are starters. All
counts are made in Spark over whole texts, by language; what is kept are the words above the thresholds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.sources.work import Work, small_batches

#: Least score of an abbreviation, and least log-likelihood of a starter (fixed values of the method).
ABBREVIATION, STARTER = 0.3, 30.0
#: What may stand around a word, and what ends a sentence for certain.
_AROUND = "\"'()\\[\\]{}«»“”‘’,;:"
_END = re.compile(rf"[.!?…](?<![.!?…](?s:.))[.!?…]*+[{_AROUND}]*+(?![^\x20\x09-\x0D])")
_NO_WORD = re.compile(rf"[{_AROUND}]*+[.!?…]*+[{_AROUND}]*+")
_OUTER, _MARKS, _LEADING, _TRAILING = (re.compile(x) for x in (rf"^[{_AROUND}]+|[{_AROUND}]+$", r"[.!?…]+$", rf"^[{_AROUND}]+", rf"[.!?…{_AROUND}]+$"))
#: First bytes of tokens of marks alone, and what a token has to hold to end a sentence.
_FIRST = frozenset(x.encode()[0] for x in "\"'()[]{}«»“”‘’,;:.!?…")
_ENDING = tuple(x.encode() for x in ".!?…")
_BLANKS = " \t\n\v\f\r"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def word(token: Column) -> Column:
    """struct<w,dot,sure>: lower-cased and without marks around it or a last period; dot: a period followed the word; sure:
    another mark that ends a sentence did."""
    bare = F.regexp_replace(token, rf"^[{_AROUND}]+|[{_AROUND}]+$", "")
    sure = bare.rlike(r"[!?…]$")
    dot = bare.endswith(".") & ~bare.rlike(r"(^|\.)\.+$")
    name = F.lower(F.regexp_replace(bare, r"[.!?…]+$", ""))
    return F.struct(name.alias("w"), dot.alias("dot"), sure.alias("sure"))


#: Different tokens or pairs that a task holds before it gives their counts on.
HELD = 200_000


def _counts(texts: DataFrame, pairs: bool) -> DataFrame:
    """lang, a, b, n: how often token a occurs (b is null) and, with pairs, how often b comes after a; a is '' there if it has
    no mark that may end a sentence. Tokens of marks alone are passed over. Tokens are counted as they are written, so that
    what is worked out of a word is worked out once for each spelling. A task counts text by text and gives its counts on
    when they are many; Spark sums them up."""
    out = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}

        def given() -> pa.RecordBatch:
            rows = [(lang, *key, n) for lang, c in held.items() for key, n in c.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.binary()).cast(pa.string()) for c in columns[1:3]), pa.array(columns[3], pa.int64())], schema=out)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                found = text.as_py().split()  # at the blanks of the pattern, as these are bytes
                spelt = set(found)
                marks = {x for x in spelt if x[0] in _FIRST and _NO_WORD.fullmatch(x.decode())}
                found = [x for x in found if x not in marks] if marks else found
                counter = held.setdefault(lang.as_py(), Counter())
                counter.update(zip(found, repeat(None)))
                if pairs:
                    before = {x: x if any(m in x for m in _ENDING) else b"" for x in spelt}
                    counter.update(zip(map(before.__getitem__, found), found[1:]))
                if sum(map(len, held.values())) >= HELD:
                    yield given()
        yield given()

    small_batches(texts.sparkSession)
    each = texts.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, a string, b string, n long")
    return each.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def token_pairs(texts: DataFrame) -> DataFrame:
    """lang, a, b, n: how often token b comes after a, which is '' if it has no mark that may end a sentence; of tokens alone
    b is null."""
    return _counts(texts, True)


def abbreviations(texts: DataFrame) -> DataFrame:
    """lang, word, with_dot, without_dot, score of the words taken for abbreviations. texts: lang, text.

    Score: the log-likelihood that a period always follows against that it follows as it does anywhere, times e to the minus
    number of letters, times the periods (the last included), times letters to the minus number of times without one.
    """
    return _abbreviations(_counts(texts, False))


def _abbreviations(tokens: DataFrame) -> DataFrame:
    """tokens: lang, a, n; a token's counts may be in several rows."""
    each = tokens.groupBy("lang", "a").agg(F.sum("n").alias("n")).select("lang", "n", word(F.col("a")).alias("x")).select("lang", "n", "x.w", "x.dot").where("w <> ''")
    counts = each.groupBy("lang", "w").agg(*(F.sum(F.when(F.col("dot") == dot, F.col("n")).otherwise(0)).alias(name) for name, dot in (("with_dot", True), ("without_dot", False))))
    sums = counts.groupBy("lang").agg(F.sum("with_dot").alias("dots"), F.sum(F.col("with_dot") + F.col("without_dot")).alias("n"))
    # languages are few: one row each
    rows = counts.where((F.col("with_dot") > 0) & F.col("w").rlike(r"^[^\d]*\p{L}[^\d]*$")).join(F.broadcast(sums), "lang")
    p = F.least(F.col("dots") / F.col("n"), F.lit(1 - 1e-9))
    yes, no = F.col("with_dot"), F.col("without_dot")
    ratio = -2 * (yes * F.log(p) + no * F.log(1 - p) - yes * F.log(F.lit(0.99)) - no * F.log(F.lit(0.01)))
    inner = F.length("w") - F.length(F.replace(F.col("w"), F.lit("."), F.lit("")))
    letters = F.length("w") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -no.cast("double"))
    return rows.select("lang", F.col("w").alias("word"), "with_dot", "without_dot", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def starters(texts: DataFrame, known: DataFrame) -> DataFrame:
    """lang, word, after_end, n, score of the words that begin sentences. known: abbreviations() of the texts."""
    return _starters(token_pairs(texts), known)


def _starters(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs: token_pairs()."""
    each = pairs.where("b IS NOT NULL").select("lang", "n", word(F.col("a")).alias("x"), word(F.col("b"))["w"].alias("word"))
    each = each.select("lang", F.col("x.w").alias("before"), (F.col("x.dot") | F.col("x.sure")).alias("end"), F.col("x.dot").alias("dot"), "word", "n")
    short = known.select("lang", F.col("word").alias("before"), F.lit(True).alias("short"))
    # words are counted by what stands before them, so that the join has a row for each pair of words
    pairs_n = each.groupBy("lang", "before", "end", "dot", "word").agg(F.sum("n").alias("n"))
    marked = pairs_n.join(short, ["lang", "before"], "left").withColumn("ends", F.col("end") & ~(F.col("dot") & F.coalesce("short", F.lit(False))))
    counts = marked.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("after_end"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("after_end").alias("all_ends"))
    rows = counts.where((F.col("after_end") > 0) & F.col("word").rlike(r"^\p{L}")).join(F.broadcast(sums), "lang")
    a, b, ab, n = (F.col(c).cast("double") for c in ("all_ends", "n", "after_end", "all_n"))
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    term = lambda k, m, q: F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(m - k > 0, (m - k) * F.log(1 - q)).otherwise(0.0)
    score = F.when(n > a, -2 * (term(ab, a, p) + term(b - ab, n - a, p) - term(ab, a, p1) - term(b - ab, n - a, p2)))
    return rows.withColumn("score", score).where((F.col("score") >= STARTER) & (p1 > p)).select("lang", "word", "after_end", "n", "score")


@dataclass(frozen=True)
class Boundaries:
    """What was learnt of one language."""

    short: frozenset[str] = field(default_factory=frozenset)
    starts: frozenset[str] = field(default_factory=frozenset)

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between two words: at marks other than a period always; at a period unless the word is an
        abbreviation or one letter, and then only before a capitalised starter."""
        if not _END.search(token):
            return False
        bare = _OUTER.sub("", token)
        if not bare.endswith(".") or bare.endswith(".."):
            return True
        word = _MARKS.sub("", bare).lower()
        if word in self.short or len(word) == 1 and word.isalpha():
            first = _LEADING.sub("", following)
            return first[:1].isupper() and _TRAILING.sub("", first).lower() in self.starts
        return True

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(first, end) of each sentence, without the blanks around it; together they hold all words. Only tokens that end with
        a mark are looked at."""
        last = len(text.rstrip(_BLANKS))
        if not last:
            return []
        out, begin = [], _TOKEN.search(text).start()
        for m in _END.finditer(text):
            end = m.end()
            if end >= last:
                break
            following = _TOKEN.search(text, end)
            at = m.start()
            while at > begin and text[at - 1] not in _BLANKS:
                at -= 1
            if self.ends(text[at:end], following.group()):
                out.append((begin, end))
                begin = following.start()
        return [*out, (begin, last)]


#: Words of all languages that are sent to the tasks at most; more are an error, as a learnt list is short.
MOST_WORDS = 200_000


def learn(texts: DataFrame) -> dict[str, Boundaries]:
    """What texts (lang, text) teach of each language. The driver gets the words above the thresholds, not their counts.

    Defined cases: null texts teach nothing; a null language is one of its own; repeated texts count each; of no texts nothing.
    """
    texts = texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    work = Work(texts.sparkSession)
    pairs = work.table(token_pairs(texts), "pairs")
    known = work.table(_abbreviations(pairs.where("b IS NULL").select("lang", "a", "n")), "abbreviations")
    rows = known.select("lang", "word", F.lit(True).alias("short")).unionByName(_starters(pairs, known).select("lang", "word", F.lit(False).alias("short"))).limit(MOST_WORDS + 1).collect()
    work.release()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} abbreviations and starters: the texts are no sentences")
    langs = {r["lang"] for r in rows}
    return {x: Boundaries(frozenset(r["word"] for r in rows if r["lang"] == x and r["short"]), frozenset(r["word"] for r in rows if r["lang"] == x and not r["short"])) for x in langs}


def sentence_spans(rows: DataFrame, learnt: dict[str, Boundaries], text: str = "text", lang: str = "lang") -> DataFrame:
    """Add spans, array<struct<a,b>>: offsets of the sentences of each text, by what was learnt of its language."""
    plain = Boundaries()
    small_batches(rows.sparkSession)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        def each() -> Iterator[list[dict]]:
            for t, x in zip(texts, langs, strict=True):
                yield [{"a": a, "b": b} for a, b in learnt.get(x or "", plain).spans(t or "")]

        return pd.Series(list(each()), dtype=object)

    return rows.withColumn("spans", run(F.col(text).cast("string"), F.col(lang).cast("string")))
