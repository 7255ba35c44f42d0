"""Text steps that need more than a pattern: acronyms, numerals, question particles, line breaks, script conversion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from captionlake.functions import text as T

_SPACED_CAPITALS = re.compile(r"[A-Z][.\s]+[A-Z]")


def acronyms(text: str) -> str:
    """'U. S.A' becomes 'USA'. Capitals belong together across stops and blanks, but not across the end of a sentence (a stop
    and one blank). A capital that touches a lower-case letter stays out, at either end of such a run."""
    if not _SPACED_CAPITALS.search(text):
        return text
    capitals = [i for i, c in enumerate(text) if "A" <= c <= "Z"]
    runs: list[list[int]] = []
    for i in capitals:
        gap = text[runs[-1][-1] + 1 : i] if runs else None
        if gap is not None and all(c == "." or c.isspace() for c in gap):
            runs[-1].append(i)
        else:
            runs.append([i])
    gone: set[int] = set()
    for run in runs:
        low, high = text[run[0] - 1 : run[0]] if run[0] else "", text[run[-1] + 1 : run[-1] + 2]
        run = run["a" <= low <= "z" :] if len(low) else run
        run = run[: len(run) - ("a" <= high <= "z")] if len(high) else run
        for a, b in zip(run, run[1:], strict=False):
            gap = text[a + 1 : b]
            if not (len(gap) == 2 and gap[0] == "." and gap[1].isspace()):
                gone.update(range(a + 1, b))
    return "".join(c for i, c in enumerate(text) if i not in gone)


#: Numerals, units, and the round numbers that stay.
DIGITS = {"零": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "萬": 10000}
ROUND_NUMBERS = {100, 1000, 10000, 20000, 30000, 40000, 50000, 60000, 70000, 80000, 90000, 100000}
_RUN = re.compile(f"([{''.join(DIGITS)}{''.join(UNITS)}]+)([月號]?)")
_YEAR = re.compile(f"([{''.join(c for c in DIGITS if c not in '兩两')}]{{2,4}})(?=年)")


def parse_number(s: str, dated: bool = False) -> int | None:
    """The sum of a numeral's digits times their units. A unit without a digit counts at the start only. None for what begins
    with another unit than ten, for digits in a row (but after a zero), and, if dated, for what does not end with a digit."""
    if not s or s[0] not in DIGITS and s[0] != "十" or dated and s[-1] not in DIGITS:
        return None
    total, before = 0, ""  # before: the digit that stands without a unit just before
    for k, c in enumerate(s):
        if c in DIGITS:
            if before and before != "零":
                return None
            unit = UNITS.get(s[k + 1 : k + 2])
            total += DIGITS[c] * (unit or 1)
            before = "" if unit else c
        else:
            total += UNITS[c] if k == 0 else 0
            before = ""
    return total


def numerals(text: str) -> str:
    """Numerals over 10 and under 100000 that are not round become digits, as do all that end with a digit before 月 or 號;
    then years, digit by digit. What is not converted keeps its date suffix once."""

    def fix(m: re.Match) -> str:
        n = parse_number(m[1], bool(m[2]))
        return m[0] if n is None or not m[2] and (not 10 < n < 100_000 or n in ROUND_NUMBERS) else f"{n}{m[2]}"

    return _YEAR.sub(lambda m: "".join(str(DIGITS[c]) for c in m[1]), _RUN.sub(fix, text))


def break_line(text: str, width: int = 21, is_word: Callable[[str], bool] | None = None, marks: str = "，？！…。：；", punctuation: str = "，？！…：；-") -> str:
    """At most one break in a line over `width`: after a mark near the middle, else further right, else after punctuation or a
    blank, or where two characters are no word together. All characters stay."""
    n = len(text)
    if n <= width or "\n" in text:
        return text
    low, high, far = max(n // 4, 4), min(n // 2, width - 1), min(n // 4 * 3, width)
    joined = is_word or (lambda two: two.isascii() and two.isalnum() and len(two) == 2)
    back = range(high, low - 1, -1)
    place = next((i for span in (back, range(high, far + 1)) for i in span if text[i] in marks), None)
    if place is None:
        place = next((i for i in back if text[i] in punctuation or text[i].isspace() or not joined(text[i : i + 2])), None)
    return text if place is None else text[: place + 1] + "\n" + text[place + 1 :]


class LongestMatch:
    """Dictionary conversion: at each place the longest entry, else the character itself; then an optional second dictionary."""

    def __init__(self, table: dict[str, str], then: dict[str, str] | None = None) -> None:
        self.table, self.longest = table, max(map(len, table), default=0)
        self.then = LongestMatch(then) if then else None

    @classmethod
    def read(cls, path: str, then: str | None = None) -> LongestMatch:
        """Tab-separated key and values, of which the first counts."""

        def load(p: str) -> dict[str, str]:
            with open(p, encoding="utf-8") as f:
                return {k: v.split()[0] for k, _, v in (line.rstrip("\n").partition("\t") for line in f) if v.split()}

        return cls(load(path), load(then) if then else None)

    def __call__(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if (hit := self.table.get(text[i : i + n])) is not None:
                    out.append(hit)
                    i += n
                    break
            else:
                out.append(text[i])
                i += 1
        s = "".join(out)
        return self.then(s) if self.then else s


def python_step(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function as a column step, in Arrow batches; null stays null."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(x))

    return run


#: How particles are written in a question, under a question mark alone, and in a statement.
IN_QUESTION = {"呀": "啊", "嘎": "㗎", "啫？": "唧？"}
UNDER_MARK = {"㗎？": "嘎？", "啊？": "呀？"}
IN_STATEMENT = {"呀": "啊", "嘎": "㗎"}
#: A question that begins with the first word, but not with the second, ends as under a mark alone.
OPENING, NOT_OPENING, AFTER_OPENING = "乜", "乜嘢", {"啊？": "呀？"}


def question_particles(text: Column, question: dict[str, str] | None = None, mark_only: dict[str, str] | None = None, statement: dict[str, str] | None = None) -> Column:
    """Write particles of each cut-off segment as befits a question, a question mark alone, or a statement."""

    def swap(s: Column, table: dict[str, str] | None, else_: dict[str, str]) -> Column:
        for a, b in (else_ if table is None else table).items():
            s = F.replace(s, F.lit(a), F.lit(b))
        return s

    def segment(s: Column) -> Column:
        asked = swap(s, question, IN_QUESTION)
        opened = s.startswith(OPENING) & ~s.startswith(NOT_OPENING) & (F.length(s) > 1)
        asked = F.when(opened, swap(asked, None, AFTER_OPENING)).otherwise(asked) if question is None else asked
        return F.when(T.is_question(s), asked).when(s.endswith("？"), swap(s, mark_only, UNDER_MARK)).otherwise(swap(s, statement, IN_STATEMENT))

    return F.array_join(F.transform(T.split_segments(text), segment), "")


def trim_lines(text: Column) -> Column:
    """Comma and white space off both ends of each line."""
    return F.regexp_replace(F.regexp_replace(text, r"(?mU)^[，\s&&[^\n]]+", ""), r"(?mU)[，\s&&[^\n]]+$", "")


def builtin_steps(width: int = 21, is_word: Callable[[str], bool] | None = None) -> dict[str, Callable[[Column], Column]]:
    return {"acronyms": python_step(acronyms), "question_particles": question_particles, "chinese_numbers": python_step(numerals), "linebreak": python_step(lambda t: break_line(t, width, is_word)), "trim": trim_lines}
