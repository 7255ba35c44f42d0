"""Text predicates, guards and splitting as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from captionlake.functions.edits import distance

#: Fixed values of the written-Cantonese conventions.
SPLIT_CHARS = "，。？！；…"
MERGE_CHARS = "，"
MAX_MERGED = 18
#: Lines of these alone carry no speech.
INTERJECTIONS = ("噢", "嗯", "哦", "嘩", "嗌", "唉", "誒", "哎", "啊", "嘿", "吓")
#: Sentence particles (own list), and those that a correction may not lose (fixed values).
PARTICLES = "呀啦喎咩㗎嘅囉喇啩吖嘛呢噃添咋喳哩咯哋咧啫嗱"
GUARDED = "嘅喎囉啦㗎呀喇吖咋咩乜"
#: What makes a segment with a question mark a question.
QUESTION_WORDS = ("做乜", "係咪", "未", "有冇", "好冇", "邊", "咩", "邊個", "點解", "幾歲", "幾耐", "幾時", "邊度", "點", "點樣", "幾多", "乜嘢", "嗎")
#: Language codes and title words of a Chinese stream.
CHINESE_CODES = ("yue", "zh", "zho", "chi", "cmn", "nan", "hak", "wuu", "zh-hans", "zh-hant", "zh-hk", "zh-tw", "zh-cn", "zh-sg")
CHINESE_TITLES = ("chinese", "cantonese", "mandarin", "putonghua", "guoyu", "huayu", "中文", "汉语", "漢語", "华语", "華語", "国语", "國語", "普通话", "普通話", "粤", "粵", "粵語", "粤语", "廣東話", "广东话")


def contains_char(chars: str, c: Column) -> Column:
    return (F.length(c) == 1) & (F.instr(F.lit(chars), c) > 0)


def is_mergeable(a: Column, b: Column, split_chars: str = SPLIT_CHARS, merge_chars: str = MERGE_CHARS, max_length: int = MAX_MERGED) -> Column:
    last = F.right(a, F.lit(1))
    joins = ~contains_char(split_chars, last) | contains_char(merge_chars, last)
    return (F.length(a) == 0) | (F.length(b) == 0) | (joins & (F.length(a) + F.length(b) <= max_length))


def is_removable(text: Column, words=INTERJECTIONS) -> Column:
    return (F.length(text) == 0) | text.isin(*words)


def is_non_chinese(text: Column) -> Column:
    """Begins with a Latin letter or a digit."""
    return text.rlike(r"(?U)^[A-Za-z\d]")


def is_punctuation(text: Column) -> Column:
    """Begins with one of the marks of captions, white space or a hyphen."""
    return text.rlike(r"(?U)^[，？！…：；\s\-]")


def split_segments(text: Column, marks: str = "？！。：；") -> Column:
    """Cut after each run of marks; what is cut keeps its marks, empty parts go."""
    return F.filter(F.split(text, f"(?<=[{marks}])(?![{marks}])"), lambda x: x != "")


def is_question(text: Column, mark: str = "？", words=QUESTION_WORDS, negation: str = "唔", char: str = "[一-鿿]") -> Column:
    """Ends with the mark, and holds an A-not-A pattern of a character of the class, or a question word."""
    words_ = "|".join(words)
    return text.endswith(mark) & (text.rlike(f"({char}){negation}\\1") | text.rlike(words_))


def sentence_spans(text: Column, split_chars: str = SPLIT_CHARS) -> Column:
    """Spans (a, b): b is the place of a split character; the last span ends with the text and may be empty."""
    marks = "".join(f"\\{c}" if not c.isalnum() else c for c in split_chars)
    lengths = F.transform(F.split(text, f"[{marks}]", -1), lambda x: F.length(x))

    def add(acc: Column, n: Column) -> Column:
        start = F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.try_element_at(acc, F.lit(-1))["b"] + 1)
        return F.concat(acc, F.array(F.struct(start.alias("a"), (start + n).alias("b"))))

    return F.aggregate(lengths, F.array().cast("array<struct<a:int,b:int>>"), add)


def trailing_particles(text: Column, chars: str = PARTICLES) -> tuple[Column, Column, Column]:
    """(text before, run of particles at the end, where the run begins)."""
    run = F.regexp_extract(text, f"[{chars}]+$", 0)
    at = F.length(text) - F.length(run)
    return F.substring(text, F.lit(1), at), run, at


def sentence_extents(text: Column, marks: str = ".!?") -> Column:
    """array<struct<first,end,mark,n>> of the parts of a text that end with a mark: places of the first and past the last
    character other than a blank (null where there is none), of a last mark (else null), and the number of characters."""
    pieces = F.filter(F.split(text, f"(?<=[{marks}])"), lambda x: x != "")
    short = F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), F.length(F.ltrim(x)).alias("l"), F.length(F.rtrim(x)).alias("r"), F.right(x, F.lit(1)).isin(*marks).alias("m")))

    def add(acc: Column, p: Column) -> Column:
        at, solid = acc["at"], p["l"] > 0
        row = F.struct(F.when(solid, at + p["n"] - p["l"]).alias("first"), F.when(solid, at + p["r"]).alias("end"), F.when(p["m"], at + p["n"] - 1).alias("mark"), p["n"].alias("n"))
        return F.struct((at + p["n"]).alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int,mark:int,n:int>>").alias("rows"))
    return F.aggregate(short, none, add)["rows"]


def translate_chars(text: Column, pairs: dict[str, str]) -> Column:
    """One-to-one variants in one pass; an output that is another's input would depend on order, and is refused."""
    if set(pairs) & set(pairs.values()) or any(len(a) != 1 or len(b) != 1 for a, b in pairs.items()):
        raise ValueError("variants must be single characters and independent of order")
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def in_vocabulary(text: Column, vocabulary: list[str], split_chars: str = SPLIT_CHARS) -> Column:
    """Structs (i, c) of the lower-cased characters kept for alignment: in the vocabulary or a split character, no outer blanks."""
    lower = F.lower(text)
    lead = F.length(lower) - F.length(F.regexp_replace(lower, r"(?U)^\s+", ""))
    end = F.length(F.regexp_replace(lower, r"(?U)\s+$", ""))
    chars = F.transform(F.split(lower, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    # the slice is taken once; in the filter, both ends would be searched for again at every character
    inner = F.slice(chars, lead + 1, F.greatest(end - lead, F.lit(0)))
    return F.filter(inner, lambda x: x["c"].isin(*vocabulary, *split_chars))


def tokens(chars: Column, ids: dict[str, int], blank: int = 0) -> Column:
    """Ids of characters; those without one are blank."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(blank)))


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped; '' if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, exact; see edits.distance. Spark's own bounded search goes over all of a string for each of the
    other's characters, so its time is the square of the length however few the edits are."""

    @pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(a, b)


def if_close(a: Column, b: Column, ratio: float) -> Column:
    """b if its edit distance from a is at most `ratio` of a's length (of 1 for an empty a), else null."""

    @pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def close(x: str, y: str) -> bool:
            length = max(len(x), 1)
            return distance(x, y, int(ratio * length) + 1) / length <= ratio

        return pd.Series([y if x is not None and y is not None and close(x, y) else None for x, y in zip(a, b, strict=True)], dtype=object)

    return run(a, b)


def accept_rewrite(primary: Column, response: Column, ratio: float = 2.5) -> Column:
    """The response's first line; the primary where that is empty, begins with 【 or is over `ratio` times as long."""
    line = first_line(response)
    bad = (line == "") | line.startswith("【") | (F.length(line) > F.length(primary) * ratio)
    return F.when(bad, primary).otherwise(line)


def accept_reference(primary: Column, response: Column, semantic: bool = False, guarded: str = GUARDED, length_ratio: float = 1.5) -> Column:
    """As accept_rewrite at 1.5; also rejected: an edit distance over 0.4 (semantic: 0.6) of the length, or a lost guarded particle."""

    def fits(line: Column) -> Column:
        kept = [~primary.contains(c) | line.contains(c) for c in guarded]
        return reduce(and_, kept, (line != "") & ~line.startswith("【") & (F.length(line) <= F.length(primary) * length_ratio))

    # an array of one, so that the line is looked for once; what other reasons reject is not compared
    line = F.try_element_at(F.filter(F.array(first_line(response)), fits), F.lit(1))
    return F.coalesce(if_close(primary, line, 0.6 if semantic else 0.4), primary)


def parse_substitutions(response: Column, arrow: str = "→", nothing: str = "無需修正") -> Column:
    """Structs (wrong, right) of lines 'wrong→right' with two characters or more that differ."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.split(response, "\n"), lambda x: x.contains(arrow) & (strip(x) != nothing))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.split(x, arrow)[0]).alias("wrong"), strip(F.split(x, arrow)[1]).alias("right")))
    return F.filter(pairs, lambda p: (F.length(p["wrong"]) >= 2) & (p["wrong"] != p["right"]))


def apply_substitutions(text: Column, pairs: Column) -> Column:
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["wrong"], p["right"]))


def prompt(prev: Column, text: Column, alternative: Column, following: Column, labels=("Before", "Line", "Alternative", "After")) -> Column:
    """Labelled lines; empty context lines are left out."""
    line = lambda label, x: F.when(F.length(x) > 0, F.concat(F.lit(f"{label}: "), x))
    return F.concat_ws("\n", line(labels[0], prev), F.concat(F.lit(f"{labels[1]}: "), text), line(labels[2], alternative), line(labels[3], following))


def choose_track(language: Column, title: Column, index: Column, native: str = "yue", native_title: str = "cantonese", family: tuple[str, ...] = CHINESE_CODES, words: tuple[str, ...] = CHINESE_TITLES) -> Column:
    """Aggregate: the first native stream, else the first of its family, else 0. Native codes compare exactly, others lower-cased."""
    own = (language == native) | F.lower(title).contains(native_title)
    kin = F.lower(language).isin(*family)
    for w in words:
        kin = kin | F.lower(title).contains(w)
    return F.coalesce(F.min(F.when(own, index)), F.min(F.when(kin, index)), F.lit(0))
