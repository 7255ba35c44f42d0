import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from captionlake.llm import line_frequency as lf
from captionlake.llm import toxicity as tox
from captionlake.llm.common import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def judged(rows, limits):
    """(kept, removed words) by plain counting."""
    texts = {}
    for doc_id, t, source in rows:
        for x in {lf.normal_line(x) for x in (t or "").split("\n")} - {""}:
            texts.setdefault((source or "", x), set()).add(t)
    hosts = Counter(h for h, _ in {(s or "", t) for _, t, s in rows})
    heavy = {k for k, v in texts.items() if len(v) > limits.max_documents}
    out = {}
    for doc_id, t, source in rows:
        b = base(t)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (source or "", lf.normal_line(x)) in heavy)
        failed = b["n_words"] < limits.min_words or 100 * b["n_repeat_words"] > limits.max_repeat_percent * b["n_words"]
        out[doc_id] = (failed, not failed and b["n_words"] - gone >= limits.min_kept_share * b["n_words"], gone)
    return out


def corpus():
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    boiler = [line(9), line(12), "Cookie  Policy ACCEPT"]
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t", None), (3, "a b c " * 40, "a"), (4, "é ö # $ %\n" * 3, "b")]
    for i in range(5, 120):
        lines = [line(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 12))]
        if i % 2:
            lines += rng.sample(boiler, rng.randrange(1, 4))
            lines.append(boiler[2].lower())
        if i % 11 == 0:
            lines = boiler * 3
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice("aab")))
    return rows + [(200 + k, rows[30][1], "a") for k in range(20)]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_rules_equal_plain_counting(spark, monkeypatch, sent):
    monkeypatch.setattr(lf, "MOST_SENT", sent)
    rows, limits = corpus(), lf.Limits(max_documents=10, min_words=20)
    docs = spark.createDataFrame([(*r, 9, 1) for r in rows], "doc_id long, text string, source string, h long, w long").repartition(3)
    want = judged(rows, limits)
    assert any(g for _, _, g in want.values()) and {k for _, k, _ in want.values()} == {True, False}
    got = {r.doc_id: r for r in lf.digest(docs, limits).collect()}
    assert len(got) == len(rows)
    for doc_id, t, _ in rows:
        r = got[doc_id]
        assert {k: r[k] for k in base(t)} == base(t)
        assert (r.base_failed, r.kept, r.n_removed_words) == want[doc_id]
    cleaned = {r.doc_id: r for r in lf.clean(docs.withColumnRenamed("h", "n_chars"), limits).collect()}
    assert sorted(cleaned) == sorted(i for i, (_, k, _) in want.items() if k)
    for i, r in cleaned.items():
        assert len(WORD.findall(r.text)) == base(dict((a, b) for a, b, _ in rows)[i])["n_words"] - want[i][2] and r.n_chars == len(r.text)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "\n".join(f"line {k} of many words here" for k in range(20))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, None)], "doc_id long, text string, source string")
    rows = lf.digest(docs, lf.Limits(max_documents=0)).collect()
    assert len(rows) == 3 and lf.digest(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 120), (1, 120), (1, 120)]


def test_depleted_documents_are_rejected_as_in_sql(spark):
    """The query's SQL on a table where lines go and documents are depleted."""
    import duckdb

    from captionlake.llm.queries import ORACLE_SQL

    rng = random.Random(2)
    line = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(15))
    nav = [line() for _ in range(5)]
    rows = [(i, "\n".join([*nav, line()] if i % 3 == 0 else [nav[i % 5], *(line() for _ in range(6))]), f"h{i % 2}") for i in range(60)]
    rows += [(100, "\n".join(nav), "h9"), (101, None, None), (102, rows[1][1], "h1")]
    got = sorted(tuple(r) for r in lf.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "n_words", "n_removed_words", "base_failed", "kept").collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(db.sql(f"SELECT doc_id, n_words, n_removed_words, base_failed, kept FROM ({ORACLE_SQL['op6_line_frequency']})").fetchall())
    assert got == want
    assert sum(not failed and not kept for *_, failed, kept in got) == 20 and sum(removed > 0 and kept for _, _, removed, _, kept in got) > 20


TOXIC = ["idiot", "moron", "stupid", "pathetic", "worthless"]


def hidden(word, rng):
    how = rng.randrange(5)
    if how == 0:
        return word.translate(str.maketrans("oiast", "01@$7"))
    if how == 1:
        return " ".join(word)
    if how == 2:
        return "".join(c * 3 if i == 2 else c for i, c in enumerate(word))
    if how == 3:
        return ".".join(word)
    return word.upper() + "!!"


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(3)
    vocab = ["the", "house", "is", "near", "river", "and", "people", "walk", "there", "in", "spring", "with", "their", "dogs", "apples", "trees", "2020", "3rd"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), hidden(rng.choice(TOXIC), rng) if i % 2 else rng.choice(TOXIC))
        docs.append((i, " ".join(words), "en", 1.0))
        labels.append((i, int(bad)))
    docs += [(1000, None, "en", 1.0), (1001, "", "en", 1.0), (None, "the river", "en", 1.0), (5, "the river", "en", 1.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), labels


def test_toxic_text_is_told_apart_on_held_out_rows(spark, talk):
    docs, labels, truth = talk
    model = tox.train(docs, labels)
    rows = tox.score(docs, model).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    truth = dict(truth)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = tox.reject_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r.predicted for r in rows)
    restorer = tox.Restorer(model.lm)
    for given, want in (("1d10t", "idiot"), ("m o r o n", "moron"), ("stuuupid", "stupid"), ("p.a.t.h.e.t.i.c", "pathetic"), ("w0rthle$$", "worthless")):
        assert model.score({f for w in restorer.restore(given).split() for f in tox.word_features(w) if f in model.features}) > model.score(set()), (given, restorer.restore(given), want)
    assert restorer.restore("the river, near trees") == "the river near trees"


def test_search_takes_the_best_path(spark, talk):
    """Against all paths of the lattice."""
    import itertools

    lm = tox.language_model(tox.trigram_counts(talk[0]))
    r = tox.Restorer(lm)

    def price(arcs):
        a = b = 0
        p = 0.0
        for c, x in arcs:
            p += x
            if c:
                k = int(tox.classes(c)[0])
                p += float(lm[a, b, k])
                a, b = b, k
        return p + float(lm[a, b, 0])

    for word in ("1d10t", "h0u$3", "m o r", "a.b!", "sttt0p"):
        lattice = r.lattice(word)
        best = max(price(p) for p in itertools.product(*lattice))
        said = {"".join(c for c, _ in p) for p in itertools.product(*lattice) if price(p) > best - 1e-4}
        assert r.decode(word) in said


def test_long_and_lightly_repeated_words_are_restored(spark, talk):
    model = tox.train(talk[0], talk[1])
    r = tox.Restorer(model.lm)
    hit = lambda t: model.score({f for w in r.restore(t).split() for f in tox.word_features(w) if f in model.features}) > model.score(set())
    for given, want in (("stuupid", "stupid"), ("iddiot", "idiot"), ("moronn", "moron"), ("stu" + "u" * 80 + "pid", "stupid"), ("s" + "." * 90 + "tupid", "stupid")):
        assert r.restore(given) == want and hit(given), (given, r.restore(given))
    spaced = " ".join("stupid" * 12)
    assert len(spaced) > 64 and hit(spaced) and len(r.restore(spaced)) > 20 and "stupid" in r.restore(spaced), r.restore(spaced)


def test_every_lattice_of_several_paths_is_searched_and_commits_change_nothing(spark, talk, monkeypatch):
    r = tox.Restorer(tox.language_model(tox.trigram_counts(talk[0])))
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeo01$.-é_¿ ", k=rng.randrange(1, 6))).strip() for _ in range(400)]
    for w in words:
        assert r.suspicious(w) == any(len(arcs) > 1 for arcs in r.lattice(w)), w
    long = ["".join(rng.choices("aabbdiot01$.", k=300)) for _ in range(20)]
    monkeypatch.setattr(tox, "COMMIT", 10**9)
    whole = [r.decode(w) for w in long]
    monkeypatch.setattr(tox, "COMMIT", 7)
    assert [r.decode(w) for w in long] == whole


def test_scores_are_those_of_a_plain_fit(spark, talk):
    """Features, G-test, gradient steps and scores, restated with dictionaries and loops."""
    docs, labels, truth = talk
    docs = docs.where("doc_id < 240 AND doc_id <> 5")
    model = tox.train(docs, labels, tox.Settings(max_features=60))
    r, truth = tox.Restorer(model.lm, model.words), dict(truth)
    found = {d.doc_id: {f for w in r.restore(d.text).split() for f in tox.word_features(w)} for d in docs.collect()}
    fitted = sorted(i for i in found if zlib.crc32(str(i).encode()) % 5)
    n, pos = len(fitted), sum(truth[i] for i in fitted)
    g = {}
    for f in set().union(*found.values()):
        a, c = sum(f in found[i] and truth[i] for i in fitted), sum(f in found[i] for i in fitted)
        if c >= 4:
            cells = [(a, c * pos / n), (pos - a, (n - c) * pos / n), (c - a, c * (n - pos) / n), (n - pos - c + a, (n - c) * (n - pos) / n)]
            g[f] = round(sum(2 * o * np.log(o / max(e, 1e-9)) for o, e in cells if o), 9)
    chosen = [f for f in sorted(g, key=lambda f: (-g[f], f)) if g[f] >= 12][:60]
    assert set(chosen) == set(model.features) and chosen
    w, b, sw, sb = dict.fromkeys(chosen, 0.0), 0.0, dict.fromkeys(chosen, 1e-8), 1e-8
    for _ in range(400):
        gw, gb = {f: 1e-5 * w[f] for f in chosen}, 0.0
        for i in fitted:
            z = b + sum(w[f] for f in found[i] if f in w)
            e = (1 / (1 + np.exp(-z)) - truth[i]) * (0.5 / pos if truth[i] else 0.5 / (n - pos))
            gb += e
            for f in found[i] & w.keys():
                gw[f] += e
        sb += gb**2
        b -= 0.5 * gb / sb**0.5
        for f in chosen:
            sw[f] += gw[f] ** 2
            w[f] -= 0.5 * gw[f] / sw[f] ** 0.5
    for row in tox.score(docs, model).collect():
        assert abs(row.score - 1 / (1 + np.exp(-b - sum(w.get(f, 0) for f in found[row.doc_id])))) < 1e-6


def test_word_counts_are_those_of_plain_counting(spark, talk):
    texts = [r.text for r in talk[0].collect()] + ["Don't  stop.Now é_é 3rd", "ÀB", None, ""]
    counts = tox.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = Counter(w.decode() for t in texts if t for w in re.findall(rb"[0-9a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())))
    cells = Counter()
    for w, n in want.items():
        cells[tox.word_cell(w)] += n
    assert {k: n for k, n in enumerate(counts.tolist()) if n} == dict(cells)


def test_ordinary_words_and_numbers_stay(spark, talk):
    docs = talk[0].select("text").unionByName(spark.createDataFrame([("good letters well running free committee happen worthless " * 3,)] * 20, "text string"))
    r = tox.Restorer(tox.language_model(tox.trigram_counts(docs)), tox.word_counts(docs))
    same = "good letters well running free committee apples trees 2024 100 10:30 3.14 3rd 2020 12kg http://a.b/c?x=1 a.b@c.org www.x.yy 0123456789abcdef"
    assert r.restore(same) == same.lower()
    for given, want in (("1d10t", "idiot"), ("m o r o n", "moron"), ("stuuupid", "stupid"), ("stuupid", "stupid"), ("goood", "good"), ("s.t.u.p.i.d", "stupid"), ("w0rthle$$", "worthless"), ("stupid!!", "stupid"), ("river$$$", "river"), ("STUPID!!!", "stupid")):
        assert r.restore(given) == want, (given, r.restore(given))


def test_a_search_is_left_out_only_where_it_changes_nothing(spark, talk):
    docs = talk[0].select("text")
    r = tox.Restorer(tox.language_model(tox.trigram_counts(docs)), tox.word_counts(docs))
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(c * rng.choice([1, 1, 1, 2]) for c in rng.choice(["river", "moron", "idiot", "house", "walk", "xyz"]))
        if tox._TWICE.search(word) and not tox._LONGER.search(word):
            searched = r._words(r.decode(word))
            assert r.word(word) == (searched if r.known(searched) > tox.DOUBTFUL * r.known([word]) + 1 else [word]), word


def test_restoring_tells_hidden_words(spark):
    """Held-out rows of the tables, their toxic words hidden: with the search nearly all are found again, without it few."""
    rng, sf = random.Random(1), "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tox.train(docs, labels)
    words = [w for w in ("worthless", "stupid", "loser", "scum", "idiot", "moron", "pathetic", "trash", "disgusting") if any(model.features.get(f, 0) > 0.3 for f in tox.word_features(w))]
    hide = (lambda w: w.translate(str.maketrans("oieas", "013@$")), " ".join, ".".join, lambda w: "".join(c * 3 if i == 1 else c for i, c in enumerate(w)))
    pattern = re.compile(rf"\b({'|'.join(words)})\b", re.I)
    rows = docs.join(labels.where("toxic = 1"), "doc_id").where(tox.held_out()).select("text").collect()
    shown = [r.text for r in rows if pattern.search(r.text)]
    hidden = [pattern.sub(lambda m: rng.choice(hide)(m[0].lower()), t) for t in shown]
    scorer, plain = tox.Scorer(model), tox.Scorer(model)
    plain.restorer = type("Plain", (tox.Restorer,), {"suspicious": staticmethod(lambda word: False)})(model.lm)
    share = lambda s, texts: np.mean([s.score(t) >= 0.5 for t in texts])
    assert len(words) > 5 and len(shown) > 50
    assert share(scorer, hidden) >= 0.95 * share(scorer, shown) > 0.8 and share(plain, hidden) < 0.5


def test_odd_texts_have_a_score(spark, talk):
    model = tox.train(*talk[:2])
    odd = [(1, "... --- !!! ***"), (2, "@" * 300), (3, "s" + "t" * 5000 + "upid"), (4, " ".join("stupid" * 400)), (5, "\U0001f600 \u202e \x00")]
    rows = {x.doc_id: x.score for x in tox.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert len(rows) == 5 and all(0 <= x <= 1 for x in rows.values()) and rows[1] == model.score(set()) and rows[4] > rows[1]


def test_no_labels_no_rows(spark, talk):
    docs, labels, _ = talk
    model = tox.train(docs.limit(0), labels.limit(0))
    assert tox.score(docs.limit(0), model).count() == 0 and 0 <= model.score(set()) <= 1


def test_tokens_cells_and_features_by_the_short_way():
    """Texts without spaced signs are only split, cells are sums of products, and beginnings are looked up; all as written out plainly."""
    rng = random.Random(4)
    for _ in range(20_000):
        said = "".join(rng.choices("ab! \t\n　\x1cé", k=rng.randint(0, 12)))
        assert tox.tokens_of(said) == tox._TOKEN.findall(said)
    for n in (0, 1, 5, 63, 64, 65, 80):
        word = "".join(rng.choices("abé行'9", k=n))
        counts = np.zeros(tox.WORD_CELLS, dtype=np.int32)
        data = np.frombuffer(word.encode(), np.uint8)
        if n:
            cell = int(word_hashes(data, np.array([0]), np.array([len(data)]))[0]) & (tox.WORD_CELLS - 1)
            counts[cell] = 3
            assert tox.word_cell(word) == cell
    names = ("=annoyed", "^anno", "^annoy", "=annoy", "=anno", "^ann")
    model = tox.Model(np.zeros((64, 64, 64), np.float32), {tox.feature(x): 1.0 for x in names}, 0.0)
    scorer = tox.Scorer(model)
    for word in ("annoyed", "annoy", "anno", "ann", "annoys", "other"):
        assert set(scorer.compute(word)) == {f for w in scorer.restorer.word(word) for f in tox.word_features(w) if f in model.features}
    assert scorer.compute("annoys") and not scorer.compute("other")
