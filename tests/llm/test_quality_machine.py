import itertools
import zlib

import numpy as np
import pytest

from captionlake.llm import quality_machine as qm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, quality int"


def test_linear_time_score_equals_the_pairwise_sum():
    rng = np.random.default_rng(1)
    machine = qm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 5)))
    sizes = [0, 1, 2, 9, 30]
    docs = [(rng.choice(50, n, replace=False), rng.normal(size=n)) for n in sizes]
    want = []
    for p, x in docs:
        z = machine.bias + sum(machine.weights[i] * a for i, a in zip(p, x))
        z += sum(machine.vectors[p[i]] @ machine.vectors[p[j]] * x[i] * x[j] for i, j in itertools.combinations(range(len(p)), 2))
        want.append(1 / (1 + np.exp(-z)))
    rows = np.repeat(np.arange(len(docs)), sizes)
    got = machine.scores(rows, np.concatenate([p for p, _ in docs]).astype(int), np.concatenate([x for _, x in docs]), len(docs))
    assert np.allclose(got, want)


def test_interactions_tell_what_weights_can_not():
    """The label is whether exactly one of two features is there: no weights alone can say so."""
    docs = [(a, b, c) for a in (0, 1) for b in (2, 3) for c in range(4, 14)]
    labels = np.array([float((a == 0) != (b == 2)) for a, b, _ in docs])
    rows, places = np.repeat(np.arange(len(docs)), 3), np.array(docs).ravel()
    settings = qm.Settings(steps=400)
    machine = qm.fit(labels, rows, places, np.ones(len(places)), 14, settings)
    assert ((machine.scores(rows, places, np.ones(len(places)), len(docs)) >= 0.5) == labels).all()
    flat = qm.fit(labels, rows, places, np.ones(len(places)), 14, qm.Settings(steps=400, factors=0))
    assert ((flat.scores(rows, places, np.ones(len(places)), len(docs)) >= 0.5) == labels).mean() < 0.8


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_rows(tables):
    docs, labels = tables
    rows = qm.score(docs, qm.train(docs, labels, ("n_chars",)), ("n_chars",)).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    score, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    order = score.argsort()
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print("AUC", auc, "accuracy", ((score >= 0.5) == y).mean(), len(y), (y == 0).sum())
    assert auc > 0.97
    assert (score[y == 1] >= 0.5).mean() > 0.97


def test_defined_cases(spark):
    rows = [(1, "good words here. And more", "en", "s", 25, 0.5, 1), (2, "bad### $$$ |||", None, None, None, 0.5, 0), (2, "bad### $$$ |||", None, None, None, 0.5, 0), (3, None, "de", "s", 3, 0.1, 0), (4, "", "de", "s", 3, 0.1, 0)]
    rows += [(None, "no id", "en", "s", 1, 0.0, 1), (5, "w" * 3_000_000 + " x", "en", "s", 1, 0.0, 1), (6, "wort " * 1_200_000, "en", "s", 1, 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    machine = qm.train(docs, labels, ("n_chars", "not_there"))
    out = qm.score(docs, machine, ("n_chars", "not_there")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id == 2}) == 1
    empty = qm.train(docs.limit(0), labels)
    assert qm.score(docs.limit(0), empty).count() == 0 and {r.score for r in qm.score(docs, empty).collect()} == {0.5}


def test_pieces_count_as_the_whole(monkeypatch):
    text = ("Some Words, 12 and ### é\n" * 200).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = qm.places_of(data, offs, [np.array([np.nan])])
    monkeypatch.setattr(qm, "PIECE", 300)
    assert all((a == b).all() for a, b in zip(whole, qm.places_of(data, offs, [np.array([np.nan])])))
