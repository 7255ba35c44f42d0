import hashlib
import itertools
import random
import re
import zlib

import pytest

from captionlake.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, pos long, kinds string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_audit(turns):
    """(cost, audit, repaired) by trying every sequence of edits, with runs of at most two inserted turns."""
    marks, best = faults(turns), None
    options = [[run + e for run in ("", "I", "II") for e in ("D" if f in ("blank", "duplicate") else "DKR")] for f in marks]
    for way in itertools.product(*options, ("", "I", "II")):
        audit = "".join(way)
        cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit)
        cost += sum(3 for w, f in zip(way, marks) if f == "truncated" and w[-1] != "D")
        if best is not None and (cost, audit) >= best[:2]:
            continue
        repaired, k = [], 0
        for e in audit:
            role, text = turns[k] if e != "I" and k < len(turns) else ("", "")
            k += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if repaired and repaired[-1][0][:1] == "u" else "user"
            repaired.append((role, text if e != "I" else ""))
        if LEGAL.match("".join(r[:1] or "?" for r, _ in repaired)):
            best = (cost, audit, repaired)
    return best


def plain_search(turns):
    """best_audit() for long conversations: the same states, with whole audit strings."""
    best = {0: (0, "")}
    for kind in kinds_of(turns):
        step = {}
        for before, after, price, code in cr.moves(kind):
            if before in best:
                c = (best[before][0] + price, best[before][1] + cr.CODES[code])
                step[after] = min(step.get(after, c), c)
        best = step
    return min((c + 3 * n, a + "I" * n) for s, n in ((0, 0), (1, 2), (2, 1), (3, 0)) if s in best for c, a in [best[s]])


def kinds_of(turns):
    return bytes(4 * ("sua".find(r[:1]) if r and r[0] in "sua" else 3) + cr.FAULTS.index(f) for (r, _), f in zip(turns, faults(turns)))


ROLES = ["system", "user", "assistant", "tool", "", " "]
WORDS = ["Yes.", "No", "", " \n", "What?", "again.", "again."]


def random_turns(rng, n):
    return [(rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(WORDS)) for _ in range(n)]


def test_codes_are_ordered_and_prefix_free():
    assert list(cr.CODES) == sorted(cr.CODES)
    assert not any(a != b and b.startswith(a) for a in cr.CODES for b in cr.CODES)


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_all_edits(seed):
    rng = random.Random(seed)
    turns = random_turns(rng, rng.randint(0, 4))
    kinds, search = kinds_of(turns), cr.Search()
    way, tail = cr.joined([search.table(kinds, True)])
    codes = search.codes(kinds, True, *way[0])
    cost, audit, repaired = best_audit(turns)
    assert "".join(cr.CODES[c] for c in codes) + "I" * tail == audit
    repair, got = cr.Repair(), []
    repair.begin(kinds, codes, tail)
    for turn in turns:
        got += repair.turn(*turn)
    got += repair.end()
    assert [(r, t) for e, r, t in got if e != "D"] == repaired


@pytest.mark.parametrize("seed", range(40))
def test_runs_join_to_the_whole(seed):
    rng = random.Random(seed)
    turns = [(r, f"{k} {t}" if t.strip() and rng.random() < 0.8 else t) for k, (r, t) in enumerate(random_turns(rng, rng.randint(1, 40)))]
    kinds, search = kinds_of(turns), cr.Search()
    cuts = [0, *sorted(rng.sample(range(len(kinds)), min(len(kinds), 5))), len(kinds)]
    parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
    way, tail = cr.joined([search.table(p, False) for p in parts])
    audit = "".join(cr.CODES[c] for p, (a, b) in zip(parts, way) for c in search.codes(p, False, a, b)) + "I" * tail
    assert audit == plain_search(turns)[1]


def expected(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [(r[2], r[3]) for r in own]
        marks, known = faults(turns), [r[1] for r in own if r[1] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        cost, audit = plain_search(turns)
        repair, got = cr.Repair(), []
        way, tail = cr.joined([cr.Search().table(kinds_of(turns), True)])
        repair.begin(kinds_of(turns), cr.Search().codes(kinds_of(turns), True, *way[0]), tail)
        for turn in turns:
            got += repair.turn(*turn)
        text = "\n".join(f"{r}:{t}" for e, r, t in [*got, *repair.end()] if e != "D")
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_digest(spark):
    rng = random.Random(7)
    rows = [(c, t, *x) for c in range(60) for t, x in enumerate(random_turns(rng, rng.randint(1, 9)))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"line {t}." if t % 7 else "same") for t in range(9000)]  # over several chunks
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", None), (101, None, None, None), (101, None, None, "x" * 200_000), (102, 5, "user", "Hi."), (102, 5, "user", "Hi."), (102, 9, "assistant", "Ho.")]
    rows += [(103, 3, "user", "a.")] * 5000
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in cr.digest(cr.damage(df), df).collect()}
    want = expected(damaged(rows), {r[0] for r in rows})
    assert got == want
    assert cr.digest(cr.damage(df.limit(0)), df.limit(0)).count() == 0
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    lost = spark.createDataFrame([(gone, 0, "user", "Hi.", 0, "")], SCHEMA)
    assert [tuple(r) for r in cr.digest(cr.damage(lost), lost).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [("a", 0, "assistant", "Hello."), ("a", 1, "assistant", "Hello."), ("a", 2, "user", "Why?"), ("b", 1, "system", "Be good."), ("c", 0, "user", "x."), ("c", 1, "assistant", "y.")]
    out = cr.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).orderBy("conv_id", "place").collect()
    assert "".join(r.edit for r in out if r.conv_id == "a") == best_audit([r[2:] for r in rows[:3]])[1]
    assert [r.place for r in out if r.conv_id == "a"] == list(range(sum(r.conv_id == "a" for r in out)))
    assert [(r.role, r.text) for r in out if r.conv_id == "a" and r.edit != "D"] == best_audit([r[2:] for r in rows[:3]])[2]
    assert "".join(r.edit for r in out if r.conv_id == "b") == best_audit([rows[3][2:]])[1]
    assert "".join(r.edit for r in out if r.conv_id == "c") == "KK"
