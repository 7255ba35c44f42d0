import numpy as np
from pyspark.sql import functions as F

import captionlake
from captionlake.__main__ import main
from captionlake.plans import pipeline

VOCAB = {c: i for i, c in enumerate("我哋去食飯啦好呀", 1)}
SAID = {("a", 0): "我哋去食飯，好呀。", ("a", 1): "嗯", ("b", 0): "好呀"}


def asr(part):
    return [{"text": SAID[x["file_id"], x["seg_idx"]]} for x in part]


def emit(part):
    out = []
    for x in part:
        e = np.full((20, len(VOCAB) + 1), 0.01)
        e[:, 0] = 0.9
        for k, c in enumerate(c for c in SAID[x["file_id"], x["seg_idx"]] if c in VOCAB):
            e[2 * k + 1] = 0.01
            e[2 * k + 1, VOCAB[c]] = 0.9
        out.append({"emission": np.log(e).tolist()})
    return out


def rows(spark):
    return spark.createDataFrame([("a", 0, 0.0, 2.0, b"x" * 9), ("a", 1, 5.0, 6.0, b"x"), ("b", 0, 1.0, 3.0, b"x" * 3)], "file_id string, seg_idx long, start double, end double, audio binary")


def test_speech_to_captions(spark, tmp_path):
    got = {}
    for _ in range(2):  # the second time from the checkpoint
        out = captionlake.transcribe(rows(spark), asr, emit, VOCAB, checkpoint=str(tmp_path)).orderBy("file_id", "seg_idx").collect()
        got = [(r.file_id, r.text, round(r.start, 2)) for r in out]
    assert got == [("a", "我哋去食飯，好啊。", 0.1), ("b", "好啊", 1.1)]


def test_two_hypotheses_and_names(spark, tmp_path):
    def second(part):
        if any((x["file_id"], x["seg_idx"]) == ("a", 1) for x in part):
            raise RuntimeError("no speech")
        return [{"text": SAID[x["file_id"], x["seg_idx"]].replace("好", "去")} for x in part]

    asked = []

    def generate(part):
        out = []
        for x in part:
            asked.append(x["prompt"])
            between = "Alternative: 我哋去食飯，去呀。" in x["prompt"] and "Line: 我哋" in x["prompt"]
            out.append({"response": "我哋去食飯，去呀。" if between else "食飯→飯食" if x["prompt"].startswith("1. 我哋") else ""})
        return out

    heard = pipeline.recognise(rows(spark), second, failed={"text": ""})
    lost = {(r.file_id, r.seg_idx): (r.text, r.error) for r in heard.collect()}
    assert lost["a", 1] == ("", "RuntimeError: no speech") and lost["b", 0] == ("去呀", None)
    settled = pipeline.settle(pipeline.ensemble(pipeline.recognise(rows(spark), asr), heard), generate)
    assert {(r.file_id, r.seg_idx): r.text for r in settled.collect()} == {("a", 0): "我哋去食飯，去呀。", ("a", 1): "嗯", ("b", 0): "好呀"}
    out = captionlake.transcribe(rows(spark), asr, emit, VOCAB, generate=generate, second=second, checkpoint=str(tmp_path)).collect()
    assert {r.text for r in out if r.file_id == "a"} == {"我哋去飯食，去啊。"} and all(r.words for r in out)
    assert {p.name for p in tmp_path.iterdir()} == {"stage=asr", "stage=second", "stage=emissions", "stage=before_cleaning"}


def test_references_and_guards(spark):
    said = pipeline.recognise(rows(spark), asr)
    lines = spark.createDataFrame([("a", 0, 0.5, 1.0, "我哋去食飯，好呀！")], "file_id string, seg_idx long, start double, end double, text string")
    named = pipeline.add_references(said, lines)
    assert {(r.file_id, r.seg_idx): r.reference for r in named.collect()} == {("a", 0): "我哋去食飯，好呀！", ("a", 1): "", ("b", 0): ""}
    fixed = pipeline.correct(named, lambda part: [{"response": "<think>x</think>\n我哋去飲茶，好呀。"} for _ in part])
    assert {r.text for r in fixed.collect()} == {"我哋去飲茶，好呀。", "嗯", "好呀"}
    swapped = pipeline.substitute(said, lambda part: [{"response": "食飯→飲茶"} for _ in part])
    assert {r.text for r in swapped.collect()} == {"我哋去飲茶，好呀。", "嗯", "好呀"}
    both = pipeline.ensemble(said, said.where("file_id = 'b'").withColumn("text", F.lit("好吖")))
    assert {r.alternative for r in both.collect()} == {"", "好吖"}


def test_command_line(spark, tmp_path):
    (tmp_path / "x.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n好 好!\n\n2\n00:00:03,000 --> 00:00:04,000\n嗯\n")
    main([str(tmp_path / "x.srt"), str(tmp_path / "out"), "--clean", "--shift", "-1.5", "--output-format", "vtt"])
    assert (tmp_path / "out" / "x.vtt").read_text() == "WEBVTT\n\n00:00.000 --> 00:00.500\n好好！\n\n"
