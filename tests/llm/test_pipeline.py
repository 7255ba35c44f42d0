import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: "\n".join(" ".join(f"w{rng.randrange(2000)}" for _ in range(12)) for _ in range(n))
    clean = [(i, prose(12)) for i in range(30)]
    base = prose(20)
    near = [(100 + k, base.replace(base.split()[7 * k + 3], "changed", 1)) for k in range(6)]
    passage = " ".join(f"p{k}" for k in range(60))
    shared = [(200 + k, prose(15) + "\n" + passage + "\n" + prose(15)) for k in range(4)]
    toxic = [(300 + k, prose(10) + " you stupid idiot, pathetic scum, worthless moron " + prose(3)) for k in range(25)]
    short = [(400, "too short")]
    rows = [(i, t, "en", "src", len(t)) for i, t in clean + near + shared + toxic + short]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(i, int(300 <= i < 400)) for i, *_ in rows], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "substring_dedup":
            texts = {r.doc_id: r for r in docs.collect()}
            assert all(passage.split()[30] not in texts[200 + k].text.split() and len(texts[200 + k].text.split()) == 360 for k in range(4))
            assert all(texts[i].text == t and r == len(t) for i, t in clean for r in [texts[i].n_chars])
    ids = {i for i, _ in clean + near + shared}
    assert {i for i, _ in clean + near + shared} <= seen["toxicity"] and not set(range(300, 325)) & seen["toxicity"]
    assert seen["quality_rules"] == ids
    assert seen["jaccard_join"] == ids - {101, 102, 103, 104, 105}
    packed = docs.collect()
    assert {r.doc_id for r in packed} == seen["substring_dedup"] and len({r.sequence_id for r in packed}) <= sum(r.length for r in packed) // 2048 + 2


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with names that work tables use as well, stage by stage."""
    rng = random.Random(2)
    prose = lambda n: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(12)) for _ in range(n))
    texts = {k: prose(12) for k in range(8)}
    rows = [(k, t, "en", "s", len(t), k, "r") for k, t in texts.items()]
    rows += [(20, None, None, None, None, None, None), (21, "", "en", None, 0, 1, ""), (None, prose(9), None, "s", None, None, "q"), (None, None, None, None, None, None, None), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label long, rk string")
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    whole = docs
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, whole, sf).count()
        assert n >= 8 if name != "toxicity" else n <= len(rows)  # each stage on all of the odd rows
        assert stage(spark, docs.limit(0), sf).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == whole.columns
        kept = docs.select("doc_id").collect()
        if name == "quality_rules":  # null, empty and short texts fail; repeated rows stay together
            assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == sorted([-1, *range(8), 3])
        if name == "jaccard_join":  # rows of equal id and text become one
            assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, *range(8)]
        if name == "substring_dedup":
            assert {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()} == {k: t for k, t in texts.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
