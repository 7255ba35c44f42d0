"""Voice activity, isolation, words of alignments: against plain loops on whole arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionlake.functions import words
from captionlake.operators import align, audio, blocks, folds
from captionlake.plans import pipeline, speech
from captionlake.sources import subtitles


def signal(n, seed=0):
    return np.random.default_rng(seed).normal(size=n).astype("<f4")


def plain_regions(t, y, onset, offset, longest):
    """Scores and times since the region began, in two lists, cut at the least score of their second half."""
    out, active, start, held = [], y[0] > onset, t[0], [(t[0], y[0])]
    for now, value in list(zip(t, y))[1:]:
        if not active:
            if value > onset:
                active, start = True, now
            continue
        if now - start > longest:
            late = held[len(held) // 2 :]
            at = len(held) // 2 + [v for _, v in late].index(min(v for _, v in late))
            out.append((start, held[at][0]))
            start, held = held[at][0], held[at + 1 :]
        elif value < offset:
            out.append((start, now))
            active, held = False, []
        held.append((now, value))
    if active:
        out.append((start, t[-1]))
    return [(a, b) for a, b in out if b - a > 1e-6]


@pytest.mark.parametrize("seed", range(8))
def test_regions_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    y = [rng.random() for _ in range(300)]
    t = [k * 0.5 for k in range(300)]
    want = plain_regions(t, y, 0.5, 0.2, 4.0)
    assert folds.regions_of(np.array(t), np.array(y), 0.5, 0.2, 4.0) == want
    if seed == 0:
        rows = spark.createDataFrame([(f, a, b) for f in ("x", None) for a, b in zip(t, y)], "file_id string, t double, y double").repartition(5)
        got = folds.speech_regions(rows, 0.5, 0.2, 4.0).orderBy("region").collect()
        assert all([(r.start, r.end) for r in got if r.file_id == f] == want for f in ("x", None))


def test_slices_and_windows(spark):
    x, y = signal(1000), signal(130, 1)
    whole = blocks.to_blocks(spark.createDataFrame([("x", x.tobytes()), ("y", y.tobytes()), ("none", b"")], "file_id string, samples binary"), 64)
    assert {r.file_id: r.total for r in blocks.lengths(whole, 64).collect()} == {"x": 1000, "y": 130}
    spans = [("x", 0, 0, 1000), ("x", 1, 63, 65), ("x", 2, 64, 128), ("x", 3, 990, 2000), ("x", 4, 5, 5), ("y", 0, 129, 130), ("none", 0, 0, 9), ("x", 5, 5000, 5001)]
    got = {(r.file_id, r.k): r.samples for r in blocks.slices(whole, spark.createDataFrame(spans, "file_id string, k long, a long, b long"), 64).collect()}
    assert got == {(f, k): {"x": x, "y": y, "none": x[:0]}[f][a:b].tobytes() for f, k, a, b in spans}
    cut = blocks.windows(whole, 300, 100, 64).orderBy("file_id", "k").collect()
    assert [(r.file_id, r.a, r.b) for r in cut] == [*(("x", k, k + 300) for k in range(0, 800, 100)), ("y", 0, 130)]
    assert all(r.samples == {"x": x, "y": y}[r.file_id][r.a : r.b].tobytes() for r in cut)


def loudness(part):
    return [{"scores": [float(np.abs(np.frombuffer(x["samples"], "<f4")[k : k + 10]).mean()) for k in range(0, len(x["samples"]) // 4, 10)]} for x in part]


def test_voice_activity(spark):
    x = signal(6000, 2) * np.repeat(np.random.default_rng(3).choice([0.1, 0.9], 60), 100).astype("<f4")
    whole = blocks.to_blocks(spark.createDataFrame([("x", x.tobytes())], "file_id string, samples binary"), 512)
    got = speech.voice_activity(whole, loudness, window=5.0, hop=1.0, frame=10, onset=0.5, offset=0.3, chunk=8.0, rate=100, size=512).orderBy("seg_idx").collect()
    sums, n = np.zeros(600), np.zeros(600)
    for k in range(0, 5501, 100):
        s = loudness([{"samples": x[k : k + 500].tobytes()}])[0]["scores"]
        sums[k // 10 : k // 10 + len(s)] += s
        n[k // 10 : k // 10 + len(s)] += 1
    regions = plain_regions([(k + 0.5) * 0.1 for k in range(600)], list(sums / n), 0.5, 0.3, 8.0)
    chunks = []
    for s, e in regions:
        if not chunks or (e - chunks[-1][0] > 8.0 and chunks[-1][1] > chunks[-1][0]):
            chunks.append([s, e])
        chunks[-1][1] = e
    assert len(got) > 2 and np.allclose([(r.start, r.end) for r in got], chunks)
    assert all(r.audio == x[int(r.start * 100) : int(r.end * 100)].tobytes() for r in got)
    theirs = spark.createDataFrame([("x", 0, 1.0, 4.0), ("x", 1, 5.0, 9.5), ("x", 2, 20.0, 21.0)], "file_id string, seg_idx long, start double, end double")
    own = speech.voice_activity(whole, segments=theirs, chunk=9.0, rate=100, size=512).orderBy("seg_idx").collect()
    assert [(r.start, r.end, len(r.audio)) for r in own] == [(1.0, 9.5, 3400), (20.0, 21.0, 400)]
    with pytest.raises(ValueError, match="onset"):
        speech.voice_activity(whole, loudness, onset=1.5)
    with pytest.raises(ValueError, match="either"):
        speech.voice_activity(whole)


def plain_isolation(x, model, size, overlap):
    step, fade = size // overlap, size // 10
    border = size - step
    mirrored = len(x) > 2 * border
    x = np.pad(x, border, mode="reflect") if mirrored else x
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for off in range(0, len(x), step):
        w = audio.fade_window(size, fade)
        if off == 0:
            w[:fade] = 1
        elif off + size >= len(x):
            w[-fade:] = 1
        n = min(size, len(x) - off)
        total[off : off + n] += model(audio.pad_tail(x[off : off + size], size))[:n] * w[:n]
        weight[off : off + n] += w[:n]
    out = np.divide(total, weight, out=np.zeros(len(x)), where=weight > 0)
    return out[border:-border] if mirrored else out


def test_isolation(spark):
    lengths = [0, 1, 30, 99, 100, 101, 149, 1000]
    rows = [("f", k, float(k), k + n / 100, signal(n, k).tobytes()) for k, n in enumerate(lengths)] + [("g", 0, 0.0, 1.0, None)]
    segs = spark.createDataFrame(rows, "file_id string, seg_idx int, start double, end double, audio binary")
    same = {(r.file_id, r.seg_idx): np.frombuffer(r.audio, "<f4") for r in speech.isolate(segs, lambda part: part, size=100).collect()}
    assert len(same) == len(rows)
    for k, n in enumerate(lengths):
        assert len(same["f", k]) == n
        if n > 100:
            assert np.allclose(same["f", k], signal(n, k), atol=1e-5)
    fading = lambda x: x * np.linspace(0, 1, len(x))
    model = lambda part: [{"samples": fading(np.frombuffer(x["samples"], "<f4")).astype("<f4").tobytes()} for x in part]
    got = {r.seg_idx: np.frombuffer(r.audio, "<f4") for r in speech.isolate(segs.where("file_id = 'f'"), model, size=100, overlap=4).collect()}
    for k, n in enumerate(lengths):
        assert np.allclose(got[k], plain_isolation(signal(n, k), fading, 100, 4), atol=1e-5), n


def emission(spans, vocabulary, frames):
    e = np.full((frames, len(vocabulary) + 1), 0.001)
    e[:, 0] = 0.9
    for at, c in spans.items():
        e[at] = 0.001
        e[at, vocabulary[c]] = 0.9
    return np.log(e).tolist()


VOCABULARY = {c: k for k, c in enumerate("abcd|", 1)}


def test_words_of_an_alignment(spark):
    spaced = emission({2: "a", 3: "b", 6: "|", 8: "c", 12: "|", 14: "d", 15: "a"}, VOCABULARY, 20)
    rows = [("f", 0, 10.0, 12.0, " ab c. dA?", spaced), ("f", 1, 20.0, 21.0, "zz", spaced), ("f", 2, 30.0, 31.0, "", None), ("g", 0, 0.0, 2.0, "ab！z z！c", emission({2: "a", 3: "b", 12: "c"}, VOCABULARY, 20))]
    df = spark.createDataFrame(rows, "file_id string, seg_idx long, start double, end double, text string, emission array<array<double>>")
    found = {(r.file_id, r.seg_idx, r.part): r for r in align.align_sentences(df, VOCABULARY, spaced=True, split_chars=".?！").collect()}
    first, second = found["f", 0, 0], found["f", 0, 1]
    assert (first.text, [w.word for w in first.words]) == (" ab c.", ["ab", "c."])
    assert [(w.start, w.end) for w in first.words][0] == (10.2, 10.6) and first.start == 10.2
    # the point is aligned as a blank, between c and the next word
    assert first.release_from is not None and 10.8 < first.release_from <= first.end
    assert (second.text, [w.word for w in second.words]) == (" dA?", ["dA?"]) and second.words[0].start == 11.4
    assert (found["f", 1, 0].text, found["f", 1, 0].start, found["f", 1, 0].words) == ("zz", 20.0, []) and found["f", 2, 0].end == 31.0
    one = align.align_sentences(df.where("file_id = 'g'"), VOCABULARY, split_chars="！").collect()
    assert [(r.text, [w.word for w in r.words]) for r in one] == [("ab！", ["a", "b", "！"]), ("z z！", ["z", "z", "！"]), ("c", ["c"])]
    assert all(r.start <= r.end for r in one)
    flat = align.flat_words(align.align_sentences(df, VOCABULARY, spaced=True, split_chars=".?！").withColumn("seg_idx", F.col("seg_idx") * 100 + F.col("part"))).where("file_id = 'f'").orderBy("word_idx").collect()
    assert [(r.word_idx, r.word) for r in flat] == [(0, "ab"), (1, "c."), (2, "dA?")]


def test_filled_and_joined_sentences(spark):
    word = lambda w: [(w, None, None, None)]
    kind = f"v array<double>, parts array<struct<text:string,start:double,end:double,release_from:double,words:{words.WORDS}>>"
    parts = [("a", 1.0, 2.0, None, word("a")), ("b", None, None, 7.0, word("b")), ("c", 5.0, 6.0, 8.0, word("c")), ("d", None, 9.0, None, word("d"))]
    df = spark.createDataFrame([([None, 1.0, None, None, None, 5.0, None], parts), ([None], parts[1:2]), ([], []), ([None, 2.0], parts[:1])], kind)
    col = lambda c: [r[0] for r in df.select(c).collect()]
    assert col(words.filled(F.col("v"))) == [[1, 1, 1, 1, 5, 5, 5], [None], [], [2, 2]]
    assert col(words.filled(F.col("v"), "linear"))[0] == [1, 1, 2, 3, 4, 5, 5] and col(words.filled(F.col("v"), "ignore"))[1] == [None]
    got = col(words.timed(F.col("parts")))
    assert [(p.text, p.start, p.end, p.release_from, [w.word for w in p.words]) for p in got[0]] == [("ab", 1, 2, 7, ["a", "b"]), ("c", 5, 6, 8, ["c"]), ("d", 5, 9, None, ["d"])]
    assert got[1] == [] and got[2] == []
    with pytest.raises(ValueError, match="unknown method"):
        words.filled(F.col("v"), "cubic")
    assert spark.range(1).select(words.word_places(F.lit("ab zz Cx "), ["a", "c"], True), words.word_places(F.lit("xaC"), ["a", "c"], False)).first()[:] == ([0, 2], [1, 2])


def test_emissions_by_interval(spark):
    e = [[float(k)] for k in range(40)]
    heard = spark.createDataFrame([("f", 0, 1.0, 3.0, 10.0, e[:20]), ("f", 1, 3.0, 5.0, 10.0, e[20:])], "file_id string, vad_idx long, start double, end double, frame_rate double, emission array<array<double>>")
    segs = spark.createDataFrame([("f", 0, 1.2, 1.75, "x"), ("f", 1, 3.0, 3.01, "x"), ("f", 2, 9.0, 9.5, "x")], "file_id string, seg_idx long, start double, end double, text string")
    got = {r.seg_idx: r.emission for r in align.emissions_of(segs, heard).collect()}
    assert got == {0: e[1:7] if int((1.2 - 1.0) * 10) == 1 else e[2:7], 1: e[20:21], 2: None}
    late = align.align_sentences(align.emissions_of(segs, heard), {"x": 0}).where("seg_idx = 2").first()
    assert (late.start, late.end, late.text, late.words) == (9.0, 9.5, "x", [])


def test_captions_carry_words_to_json(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, 0.0, 2.0, "ab，c。", emission({2: "a", 3: "b", 8: "c"}, VOCABULARY, 20))], "file_id string, seg_idx long, start double, end double, text string, emission array<array<double>>")
    out = pipeline.captions(pipeline.aligned_lines(rows, VOCABULARY))
    got = out.collect()
    assert [w.word for r in got for w in r.words] == list("ab，c。")
    subtitles.write_subtitles(out, str(tmp_path), "json")
    import json

    found = json.loads((tmp_path / "f.json").read_text())["segments"]
    assert [w["word"] for s in found for w in s["words"]] == list("ab，c。") and found[0]["words"][0]["start"] == 0.2
