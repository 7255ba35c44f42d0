"""Edit distances: against a plain table, and long strings in time by their length."""

import random
import time

from pyspark.sql import functions as F

from captionlake.functions import text
from captionlake.functions.edits import by_bits, by_diagonals, distance
from captionlake.operators import metrics


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def pairs(n=3000):
    rng = random.Random(5)
    for _ in range(n):
        letters = rng.choice(["ab", "abcdé😀行"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        b = list(a) if rng.random() < 0.5 else rng.choices(letters, k=rng.randint(0, 12))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices(letters, k=rng.randint(0, 2))
        yield a, "".join(b), rng.randint(0, 6)


def test_both_ways_equal_a_plain_table():
    for a, b, most in pairs():
        want = plain(a, b)
        assert distance(a, b) == by_bits(a, b) == want
        assert by_diagonals(a, b, most) == (want if want <= most else None)
        got = distance(a, b, most)
        assert got == want if want <= most else got > most


#: Long lines without marks, as junk has them, and the same with five edits apart from each other.
LONG = "".join(random.Random(6).choices("abcdefgh ", k=60_000))
EDITED = LONG[3:20_000] + "é" + LONG[20_000:40_000] + LONG[40_001:]


def timed(run):
    began = time.perf_counter()
    return run(), time.perf_counter() - began


def test_a_long_response_is_judged_in_time(spark):
    """The bands that compared it went over all of the string for each character: 3.6 thousand million steps a pair."""
    rows = spark.createDataFrame([(LONG, EDITED), (LONG, LONG[30_000:]), ("ab", None), (None, "ab"), ("", "")], "a string, b string").coalesce(1)
    got, seconds = timed(lambda: [r[0] for r in rows.select(text.accept_reference(F.col("a"), F.col("b"), guarded="e")).collect()])
    assert got == [EDITED.strip(), LONG, "ab", None, ""] and seconds < 8


def test_long_strings_in_time(spark):
    rows = spark.createDataFrame([(LONG, EDITED), (LONG, LONG[2:]), ("ab", None), (None, "ab"), ("", "é😀")], "a string, b string").coalesce(1)
    got, seconds = timed(lambda: [r[0] for r in rows.select(text.edit_distance(F.col("a"), F.col("b"))).collect()])
    assert got == [5, 2, None, None, 2] and seconds < 8


def test_error_rate_of_long_lines_in_time(spark):
    rows = spark.createDataFrame([(1, LONG, EDITED), (1, "abc", "abd"), (2, LONG[2:], LONG)], "g int, hypothesis string, reference string").coalesce(1)
    got, seconds = timed(lambda: sorted(tuple(r) for r in metrics.char_error_rate(rows, by=["g"]).collect()))
    chars = len(EDITED) + 3
    assert got == [(1, 6, chars, 6 / chars), (2, 2, 60_000, 2 / 60_000)] and seconds < 8
