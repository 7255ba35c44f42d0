"""Operators over whole texts of all rows, against brute force in Python."""

import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from captionlake.functions import rules, steps
from captionlake.operators import metrics
from captionlake.plans import queries
from captionlake.sources.work import BATCH_BYTES

md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
DOCS = [
    (1, "The boat is going home. We were singing!! Then\nthe  rain came,, and nobody was there to see it... " * 3 + "End", "en"),
    (2, "Où étaient-ils allés? Personne ne le savait. 中文行在此! 😀 naïve co-operation " * 4, "fr"),
    (3, "", "de"),
    (4, None, "de"),
    (5, "Überraschung ohne Satzzeichen " * 30, "de"),
]
TURNS = [(c, t, " ".join(random.Random(10 * c + t).choices("one three five eleven seven tree house e river there, stone. Here!".split(), k=70))) for c in range(3) for t in range(4)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def found(spark, sf, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, sf).collect())


def parts(whole):
    return [x for x in re.split(r"(?<=[.!?\n])(?![.!?\n])", whole) if x]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


LINES = [(d, k, x) for d, t, _ in DOCS if t for k, x in enumerate(parts(t))]


def test_lines_are_the_whole_text(spark, sf):
    got = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", queries.caption_parts("text")).orderBy("doc_id", "part").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.line
    assert got == {d: t for d, t, _ in DOCS if t}


def test_edit_distance_and_error_rate(spark, sf):
    want = [(d, k, distance(x, x[2:])) for d, k, x in LINES]
    assert found(spark, sf, "edit_distance") == sorted(want)
    sums = {}
    for (d, _, n), (_, _, x) in zip(want, LINES, strict=True):
        e, c = sums.get(d % 10, (0, 0))
        sums[d % 10] = (e + n, c + len(x[2:]))
    assert found(spark, sf, "char_error_rate") == sorted((g, e, c, round(e / c, 6)) for g, (e, c) in sums.items())


def test_sanitize(spark, sf):
    want = []
    for d, k, x in LINES:
        response = [x[2:], "", x + x, x.replace("e", "x")][k % 4]
        line = next((y.strip() for y in response.split("\n") if y.strip()), "")
        lost = any(c in x and c not in line for c in "eo")
        bad = not line or line.startswith("【") or len(line) > 1.5 * len(x) or distance(x, line) / len(x) > 0.4 or lost
        want.append((d, k, x if bad else line))
    assert found(spark, sf, "sanitize") == sorted(want)
    assert any(got != x for (_, _, got), (_, _, x) in zip(want, LINES, strict=True))


def test_substitutions(spark, sf):
    pairs, fixed = [], []
    for d, t, _ in DOCS:
        if t is None:
            continue
        words = re.sub(r"\s+", " ", t).split(" ")
        for k in range(0, len(words), 4):
            w = [*words[k : k + 4], "", "", ""][:4]
            line = " ".join(words[k : k + 4])
            for wrong, right in ((w[0], w[1]), (w[3], "ok")):
                if len(wrong) >= 2 and wrong != right:
                    pairs.append((d, k // 4, wrong, right))
                    line = line.replace(wrong, right)
            fixed.append((d, k // 4, md5(line)))
    assert found(spark, sf, "parse_substitutions") == sorted(pairs)
    assert found(spark, sf, "apply_substitutions") == sorted(fixed)


def test_words_rules_and_vocabulary(spark, sf):
    want = []
    for d, t, _ in DOCS:
        for k, w in enumerate(re.findall(r"[^\W\d_]+", t or "")):
            run = re.search("[aeiou]*$", w)[0]
            want.append((d, k, run, len(w) - len(run)))
    assert found(spark, sf, "trailing_particles") == sorted(want)
    cleaned = {r.doc_id: r.cleaned for r in queries.QUERIES["rules_basic"](spark, sf).collect()}
    assert cleaned == {d: None if t is None else md5(rules.apply_rules_python(t, queries.BASIC)) for d, t, _ in DOCS}
    ids = dict(zip("aeoth.", "123450", strict=True))
    texts = {d: [ids[c] for c in (t or "").lower() if c in ids] for d, t, _ in DOCS}
    assert found(spark, sf, "vocabulary_tokens") == sorted((d, " ".join(x)) for d, x in texts.items() if x)


def test_every_line_of_a_turn_is_broken(spark, sf):
    want = [(c, t, k, steps.break_line(x.strip(" "), 42)) for c, t, said in TURNS for k, x in enumerate(parts(said))]
    assert found(spark, sf, "linebreak") == sorted(want)


def full_matrix(h, r):
    cost = [list(range(len(r) + 1))]
    for i, x in enumerate(h, 1):
        cost.append([i])
        for j, y in enumerate(r, 1):
            cost[i].append(min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1))
    out, i, j = [0] * len(h), len(h), len(r)
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + (h[i - 1] != r[j - 1]):
            i, j = i - 1, j - 1
            out[i] = j
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out[i] = max(0, j - 1)
        else:
            j -= 1
    return out


def test_alignment_covers_every_word(spark, sf):
    rng = random.Random(2)
    for _ in range(200):
        h, r = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        assert metrics.align_words(h, r) == full_matrix(h, r)
    want = []
    for c in {c for c, _, _ in TURNS}:
        mine = [(t, x.split()) for k, t, x in TURNS if k == c]
        owner = [t for t, ws in mine for _ in ws]
        said = [w for _, ws in mine for w in (x.replace("e", "") for x in ws) if w]
        lines = {t: [] for t, _ in mine}
        for w, at in zip(said, full_matrix(said, [w for _, ws in mine for w in ws]), strict=True):
            lines[owner[at]].append(w)
        want += [(c, t, " ".join(x)) for t, x in lines.items()]
    assert found(spark, sf, "reference_word_alignment") == sorted(want)


@pytest.mark.parametrize("name", ["numerals", "rules_full", "acronyms", "linebreak"])
def test_long_texts_pass_python_in_small_batches(spark, sf, name):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    queries.QUERIES[name](spark, sf)
    assert int(spark.conf.get(setting)) == BATCH_BYTES
    rows = spark.range(200, numPartitions=1).selectExpr("repeat(char(65 + id % 26), 100000) AS text")

    @F.pandas_udf("long")
    def together(s: pd.Series) -> pd.Series:
        return pd.Series([int(s.str.len().sum())] * len(s))

    assert rows.select(F.max(together("text"))).first()[0] <= BATCH_BYTES + 100_000
