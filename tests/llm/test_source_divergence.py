import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from captionlake.llm import source_divergence as sd
from captionlake.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, min_documents=3, most=200):
    docs = [tuple(x or "" for x in r) for r in rows]  # text, lang, source
    out = []
    for lang in {d[1] for d in docs}:
        count, seen = defaultdict(Counter), Counter()
        for text, _, source in (d for d in docs if d[1] == lang):
            found = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            count[source].update(found)
            seen.update(set(found))
        kept = {t for t, d in seen.items() if d >= min_documents}
        total = Counter()
        for c in count.values():
            total.update({t: n for t, n in c.items() if t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, most)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcäéß𠻹") for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["prefix" * 9 + x for x in "abcdefghij"]
    text = lambda n: rng.choice([" ", "\n", "1", "-"]).join(rng.choice(words[: rng.choice([20, 310])]).title() for _ in range(n))
    rows = [(text(rng.choice([0, 5, 80])), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", None, *(["hot"] * 4)])) for _ in range(400)]
    return rows + [(None, "en", "no text"), ("", "xx", "a"), ("one", "xx", "b"), ("same text", "yy", "a"), ("same text", "yy", "a"), ("same text", "yy", "a"), ("wort " * 300_000, "en", "long")]


def test_audit(spark, rows):
    df = spark.createDataFrame([(k, *r, 1, "t", 2) for k, r in enumerate(rows)], SCHEMA)
    want = plain_audit(rows)
    assert got(sd.audit(df)) == want
    assert got(sd.audit(df.repartition(7), most=5)) == plain_audit(rows, most=5)
    assert got(sd.audit(df.limit(0))) == []


def test_pairs_over_several_blocks(spark, rows):
    many = [(t, "en", f"s{k % 23}") for k, (t, _, _) in enumerate(rows[:200])]
    df = spark.createDataFrame([(k, *r, 1, "t", 2) for k, r in enumerate(many)], SCHEMA)
    kept = sd.Kept(df, 3, Scratch(spark))
    name = {r.sid: r.source for r in kept.groups.collect()}
    found = {(name[r.a], name[r.b], r.value) for r in sd.pair_sums(kept, block=4, at_once=50).collect()}
    assert found == {(s, item, value) for _, s, part, item, value, _ in plain_audit(many) if part == "pair"}


@pytest.mark.parametrize("k", [1, 2, 5, 30, 1000])
def test_radix_selection(spark, k):
    rng = random.Random(k)
    rows = [(g, rng.choice([0, 1, 4095, 4096, 5, 2**59 + 1, 2**60 - 1, rng.randrange(2**60)]), t) for g in range(5) for t in {f"{'x' * rng.randint(0, 3)}{rng.randrange(400)}".encode() for _ in range(g * 60 + 1)}]
    scratch = Scratch(spark)
    df = scratch.table(spark.createDataFrame(rows, "g int, value long, item binary"), "rows")
    found = {(r.g, r.value, bytes(r["item"])) for r in sd.top_by_group(df, ["g"], k, scratch).collect()}
    want = {x for g in range(5) for x in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]}
    assert found == want


def test_shares_of_large_counts(spark):
    df = spark.createDataFrame([(c, t) for c, t in [(0, 1), (5, 7), (8_999_999_999, 10**11), (9_000_000_000, 10**11), (10**15, 10**15 + 3)]], "c long, t long")
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in df.select("c", "t", F.expr(sd.share("c", "t")).alias("p")).collect())
