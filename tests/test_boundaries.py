"""Learnt sentence boundaries against plain counting."""

import time
import math
import random
import re
from collections import Counter

from captionlake.functions import boundaries as bd

AROUND = "\"'()[]{}«»“”‘’,;:"


def plain_words(text):
    out = []
    for token in re.split(r"[\x20\x09-\x0D]+", text):
        bare = token.strip(AROUND)
        word = re.sub(r"[.!?…]+$", "", bare).lower()
        if word:
            out.append((word, bare.endswith(".") and not re.search(r"(^|\.)\.+$", bare), bare[-1] in "!?…"))
    return out


def plain_abbreviations(texts):
    yes, no = Counter(), Counter()
    for t in texts:
        for w, dot, _ in plain_words(t):
            (yes if dot else no)[w] += 1
    p = min(sum(yes.values()) / (sum(yes.values()) + sum(no.values())), 1 - 1e-9)
    out = {}
    for w, k in yes.items():
        if not re.search(r"[^\W\d_]", w) or re.search(r"\d", w):
            continue
        ratio = -2 * (k * math.log(p) + no[w] * math.log(1 - p) - k * math.log(0.99) - no[w] * math.log(0.01))
        letters = len(w.replace(".", ""))
        score = ratio * math.exp(-letters) * (w.count(".") + 1) * letters ** -no[w]
        if score >= 0.3:
            out[w] = score
    return out


def plain_starters(texts, short):
    n, after = Counter(), Counter()
    for t in texts:
        found = plain_words(t)
        for (w, dot, sure), (x, _, _) in zip(found, found[1:]):
            n[x] += 1
            after[x] += (dot or sure) and not (dot and w in short)
    total, ends = sum(n.values()), sum(after.values())
    term = lambda k, m, q: (k * math.log(q) if k else 0) + ((m - k) * math.log(1 - q) if m > k else 0)
    out = set()
    for w, ab in after.items():
        if not ab or not w[0].isalpha():
            continue
        p, p1, p2 = n[w] / total, ab / ends, (n[w] - ab) / (total - ends)
        score = -2 * (term(ab, ends, p) + term(n[w] - ab, total - ends, p) - term(ab, ends, p1) - term(n[w] - ab, total - ends, p2))
        if score >= 30 and p1 > p:
            out.add(w)
    return out


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["house", "tree", "goes", "over", "red", "small", "door", "walks", "n.b", "river"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            body = [rng.choice(words) for _ in range(rng.randint(3, 9))]
            if rng.random() < 0.5:
                body.insert(rng.randrange(len(body)), rng.choice(["Dr. Smith", "etc.", "e.g. red", "J. Doe"]))
            parts.append(rng.choice(["The", "The", "However,", "Then"]) + " " + " ".join(body) + rng.choice([".", ".", "!", '."', "?"]))
        out.append(rng.choice([" ", "\n"]).join(parts))
    return out


def test_learning_equals_plain_counts(spark):
    known = {"en": texts(1), "xx": texts(2, 60), "": ["One. Two."]}
    rows = [(k, t or None) for k, ts in known.items() for t in ts] + [("en", None), ("en", "")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = bd.abbreviations(df.fillna("", ["text"])).collect()
    learnt = bd.learn(df)
    for lang, own in known.items():
        want = plain_abbreviations(own)
        found = {r.word: r.score for r in got if r.lang == lang}
        assert found.keys() == want.keys() and all(math.isclose(found[w], want[w], rel_tol=1e-9) for w in want)
        if lang:
            assert learnt[lang].short == want.keys() and learnt[lang].starts == plain_starters(own, want)
    assert {"dr", "etc", "e.g", "j"} <= learnt["en"].short and "the" in learnt["en"].starts and "house" not in learnt["en"].short


def test_spans(spark):
    b = bd.Boundaries(frozenset({"dr", "etc"}), frozenset({"the"}))
    text = ' Ask Dr. Smith etc. The end!  "So?" he said... J. Doe (left.) \n ok'
    parts = [text[x:y] for x, y in b.spans(text)]
    assert parts == ["Ask Dr. Smith etc.", "The end!", '"So?"', "he said...", "J. Doe (left.)", "ok"]
    assert b.spans("") == [] and b.spans(" \n ") == []
    df = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "Dr. No.", None)], "id int, text string, lang string")
    got = {r.id: [tuple(s) for s in r.spans] for r in bd.sentence_spans(df, {"en": b}).collect()}
    assert got == {1: b.spans(text), 2: [], 3: [(0, 3), (4, 7)]}
    words = text.split()
    assert " ".join(parts).split() == words  # no word is lost


def test_no_texts_teach_nothing(spark):
    assert bd.learn(spark.createDataFrame([], "lang string, text string")) == {}


def test_pairs_are_counted_by_spelling_and_only_ends_keep_their_word(spark):
    texts = spark.createDataFrame([("en", "He said , “Stop.” Then e.g. he said (...) stop"), ("en", None), ("en", ""), (None, "He said")], "lang string, text string")
    got = {(r.lang, r.a, r.b): r.n for r in bd.token_pairs(texts).collect()}
    assert {k: n for k, n in got.items() if k[0] == "en" and k[2] is None} == {("en", a, None): n for a, n in (("He", 1), ("said", 2), ("“Stop.”", 1), ("Then", 1), ("e.g.", 1), ("he", 1), ("stop", 1))}
    assert {k: n for k, n in got.items() if k[0] == "en" and k[2] is not None} == {("en", a, b): 1 if b != "said" else 2 for a, b in (("", "said"), ("", "“Stop.”"), ("“Stop.”", "Then"), ("", "e.g."), ("e.g.", "he"), ("", "stop"))}
    assert got[None, "He", None] == got[None, "", "said"] == 1


def test_long_runs_of_marks_and_long_words_take_linear_time():
    began = time.perf_counter()
    plain = bd.Boundaries()
    assert plain.spans("a" + "!" * 200_000 + "x b") == [(0, 200_004)]
    assert plain.spans(" a.b" * 1000 + "?! B. ")[-1] == (4003, 4005)
    assert time.perf_counter() - began < 5
