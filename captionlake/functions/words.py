"""Characters with times to words and sentences, inside a row: chars are array<struct<char,start,end,score>>, null where unknown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from captionlake.functions.text import SPLIT_CHARS

WORDS = "array<struct<word:string,start:double,end:double,score:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def cut(chars: Column, at: Callable[[Column], Column], keep: bool) -> Column:
    """Parts of chars between those for which at() holds; keep: these end the part before them."""

    def parts(cs: Column, places: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
        ends = F.concat(places, F.array(F.size(cs)))
        return F.zip_with(starts, ends, lambda a, b: F.slice(cs, a + 1, b - a + (1 if keep else 0)))

    places = lambda cs: F.filter(F.transform(cs, lambda c, i: F.when(at(c["char"]), i)), lambda i: i.isNotNull())
    return let(chars, lambda cs: let(places(cs), lambda p: parts(cs, p)))


def joined(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda c: c["char"]), "")


def _mean(values: Column, digits: int = 3) -> Column:
    known = F.filter(values, lambda v: v.isNotNull())
    return let(known, lambda vs: F.when(F.size(vs) > 0, F.round(F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) / F.size(vs), digits)))


def _solid(chars: Column) -> Column:
    return F.filter(chars, lambda c: c["char"] != " ")


def words_of(chars: Column, spaced: bool) -> Column:
    """The words of a run of characters: between blanks where words are spaced, else each character.

    A word has the earliest start, the latest end and the mean score of its characters with times.
    """

    def word(cs: Column) -> Column:
        field = lambda name: F.transform(cs, lambda c: c[name])
        return F.struct(F.regexp_replace(joined(cs), r"(?U)^\s+|\s+$", "").alias("word"), F.array_min(field("start")).alias("start"), F.array_max(field("end")).alias("end"), _mean(field("score")).alias("score"))

    parts = cut(chars, lambda c: c == " ", keep=False) if spaced else F.transform(_solid(chars), lambda c: F.array(c))
    return F.filter(F.transform(parts, word), lambda w: w["word"] != "")


def filled(values: Column, method: str = "nearest") -> Column:
    """An array without its nulls: nearest (ties: the earlier), linear, or ignore; ends by the closest value."""
    if method == "ignore":
        return values
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown method {method!r}")

    def fill(vs: Column, known: Column) -> Column:
        def at(i: Column, a: Column, b: Column) -> Column:
            va, vb = F.get(vs, a), F.get(vs, b)
            inner = F.when(i - a <= b - i, va).otherwise(vb) if method == "nearest" else va + (vb - va) * (i - a) / (b - a)
            return F.when(a.isNull(), vb).when(b.isNull(), va).otherwise(inner)

        around = lambda i: F.struct(F.array_max(F.filter(known, lambda k: k < i)).alias("a"), F.array_min(F.filter(known, lambda k: k > i)).alias("b"))
        return F.transform(vs, lambda v, i: F.when(v.isNotNull(), v).otherwise(let(around(i), lambda x: at(i, x["a"], x["b"]))))

    known = lambda vs: F.filter(F.transform(vs, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    return let(values, lambda vs: let(known(vs), lambda k: fill(vs, k)))


def sentences(chars: Column, spaced: bool = False, split_chars: str = SPLIT_CHARS) -> Column:
    """array<struct<text,start,end,release_from,words>>: the sentences of a segment, each ending with a split character.

    Those of blanks alone are left out. release_from is the start of the last character where that is a split character.
    """

    def sentence(cs: Column) -> Column:
        last = F.element_at(_solid(cs), -1)
        return F.struct(
            joined(cs).alias("text"),
            F.array_min(F.transform(cs, lambda c: c["start"])).alias("start"),
            F.array_max(F.transform(_solid(cs), lambda c: c["end"])).alias("end"),
            let(last, lambda c: F.when(c["char"].isin(*split_chars), c["start"])).alias("release_from"),
            words_of(cs, spaced).alias("words"),
        )

    parts = F.filter(cut(chars, lambda c: c.isin(*split_chars), keep=True), lambda cs: F.exists(cs, lambda c: c["char"] != " "))
    return F.transform(parts, sentence)


def timed(parts: Column, method: str = "nearest", spaced: bool = False) -> Column:
    """Sentences with starts and ends filled in from their neighbours; those of one span become one, in order of time.

    Texts are joined (by a blank where words are spaced), words follow each other, the first release_from that is known
    counts. What still has no times is left out.
    """
    with_times = let(parts, lambda ps: F.zip_with(F.zip_with(ps, filled(F.transform(ps, lambda p: p["start"]), method), lambda p, s: p.withField("start", s)), filled(F.transform(ps, lambda p: p["end"]), method), lambda p, e: p.withField("end", e)))

    def merged(ps: Column) -> Column:
        spans = F.array_sort(F.array_distinct(F.filter(F.transform(ps, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))), lambda k: k["start"].isNotNull() & k["end"].isNotNull())))
        same = lambda k: F.filter(ps, lambda p: (p["start"] == k["start"]) & (p["end"] == k["end"]))
        one = lambda g, k: F.struct(
            F.array_join(F.transform(g, lambda p: p["text"]), " " if spaced else "").alias("text"),
            k["start"].alias("start"),
            k["end"].alias("end"),
            F.get(F.filter(F.transform(g, lambda p: p["release_from"]), lambda r: r.isNotNull()), F.lit(0)).alias("release_from"),
            F.flatten(F.transform(g, lambda p: p["words"])).alias("words"),
        )
        return F.transform(spans, lambda k: let(same(k), lambda g: one(g, k)))

    return let(with_times, merged)


def word_places(text: Column, vocabulary: list[str], spaced: bool) -> Column:
    """Places of the words (between blanks where words are spaced, else characters) that have a character to align."""
    parts = F.split(text, " ", -1) if spaced else F.filter(F.split(text, ""), lambda c: c != "")
    known = lambda w: F.exists(F.split(F.lower(w), ""), lambda c: c.isin(*vocabulary))
    return F.filter(F.transform(parts, lambda w, i: F.when(known(w), i)), lambda i: i.isNotNull())
