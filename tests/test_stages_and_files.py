import io
import json
import wave

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from captionlake.plans import stages
from captionlake.sources import config, media, subtitles
from captionlake.streaming.captions import clean_captions


def test_batches_are_longest_first_and_halved():
    sizes = []

    def fn(part):
        if len(part) > 2:
            raise stages.OutOfMemory
        sizes.append(len(part))
        return [x * 10 for x in part]

    assert dict(stages.run_batches([3, 1, 2, 5, 4], fn, 4, key=lambda x: x)) == {1: 10, 2: 20, 3: 30, 4: 40, 5: 50}
    assert sizes == [2, 2, 1]

    def never(part):
        raise stages.OutOfMemory

    with pytest.raises(stages.OutOfMemory):
        list(stages.run_batches([1], never, 4))
    flushed = []
    list(stages.run_batches(range(6), lambda p: p, 1, flush_every=2, flush=lambda: flushed.append(1)))
    assert len(flushed) == 3


def test_inference_keeps_rows(spark):
    rows = spark.range(20).select(F.col("id").alias("seg_idx"), F.lit("f").alias("file_id"), F.col("id").cast("string").alias("text")).repartition(3)
    out = stages.infer(rows, lambda part, model: [{"upper": x["text"] + model} for x in part], ["text"], "upper string", 4, key=lambda x: len(x["text"]), load=lambda: "!")
    assert all(r.upper == r.text + "!" for r in out.collect()) and out.count() == 20


def test_a_failing_job_stands_alone():
    tried = []

    def fn(part):
        tried.append(len(part))
        if 7 in part or 12 in part:
            raise RuntimeError(f"no {part}")
        return [x * 10 for x in part]

    got = dict(stages.run_batches(range(16), fn, 8, failed=lambda job, e: str(e)))
    assert got == {k: k * 10 for k in range(16)} | {7: "no [7]", 12: "no [12]"}
    assert tried.count(8) == 2 and max(tried) == 8
    with pytest.raises(RuntimeError):
        list(stages.run_batches(range(16), fn, 8))

    def large(part):
        if len(part) > 1 or part == [3]:
            raise stages.OutOfMemory
        return part

    assert dict(stages.run_batches(range(5), large, 4, failed=lambda job, e: None)) == {0: 0, 1: 1, 2: 2, 3: None, 4: 4}


def test_a_failing_row_loses_only_itself(spark):
    def fn(part):
        if any(x["text"] == "5" for x in part):
            raise ValueError("bad row")
        return [{"upper": x["text"] + "!"} for x in part]

    rows = spark.range(20).select(F.col("id").alias("seg_idx"), F.col("id").cast("string").alias("text")).repartition(2)
    out = {r.seg_idx: (r.upper, r.error) for r in stages.infer(rows, fn, ["text"], "upper string", 8, failed={"upper": ""}).collect()}
    assert out == {k: (f"{k}!", None) for k in range(20)} | {5: ("", "ValueError: bad row")}


def test_checkpoints_are_few_folders_and_only_whole_runs_count(spark, tmp_path):
    stage = stages.Stage("asr", lambda df: df.where("NOT startswith(text, '1')").withColumn("n", F.length("text")), buckets=8, drops=F.col("text").startswith("1"))
    rows = spark.range(3000).select(F.concat(F.lit("f"), F.col("id")).alias("file_id"), F.col("id").cast("string").alias("text"), F.lit(b"audio").alias("audio"))
    assert stage.run(rows, str(tmp_path)).count() == 3000 - 1111
    assert {k: stage.metrics[k] for k in ("rows_in", "dropped", "rows_out")} == {"rows_in": 3000, "dropped": 1111, "rows_out": 1889} and stage.metrics["seconds"] > 0
    run = next((tmp_path / "stage=asr").iterdir())
    assert len([p for p in run.iterdir() if p.is_dir()]) == 8 and len(list(run.rglob("*.parquet"))) == 8
    table = {(r.stage, r.metric): r.value for r in stages.metrics_table(spark, [stage]).collect()}
    assert table["asr", "dropped"] == 1111 and len(table) == 4
    (run / "_SUCCESS").unlink()
    assert stages.read_checkpoint(spark, f"{tmp_path}/stage=asr") is None
    # a bucket for every row that the first run had computed, and none again afterwards
    assert stage.run(rows.where("text = '2'"), str(tmp_path)).collect()[0].audio == b"audio"
    assert stage.run(rows.where("text = '2'"), str(tmp_path)).count() == 1 and stage.metrics["rows_out"] == 0


def test_stage_computes_only_what_is_missing(spark, tmp_path):
    asked = []

    def compute(df):
        asked.append(sorted(r.file_id for r in df.collect()))
        return df.withColumn("n", F.length("text"))

    stage = stages.Stage("asr", compute)
    rows = lambda *names: spark.createDataFrame([(n, n * 2) for n in names], "file_id string, text string")
    stage.run(rows("a", "b"), str(tmp_path))
    out = stage.run(rows("b", "c"), str(tmp_path))
    assert asked == [["a", "b"], ["c"]] and sorted(r.file_id for r in out.collect()) == ["b", "c"]
    assert not stages.needs_run(rows("a"), stages.read_checkpoint(spark, f"{tmp_path}/stage=asr"))


def test_subtitles_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x.mp4", i, i * 2.0, i * 2 + 1.5, f"line {i}", None if i % 2 else "S") for i in range(12)], "file_id string, seg_idx int, start double, end double, text string, speaker string").repartition(4)
    subtitles.write_subtitles(rows, str(tmp_path), "all")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.json", "x.srt", "x.tsv", "x.txt", "x.vtt"]
    for form in ("srt", "vtt"):
        back = subtitles.read_subtitles(spark, f"{tmp_path}/x.{form}").orderBy("seg_idx").collect()
        assert [(r.start, r.end, r.text) for r in back] == [(i * 2.0, i * 2 + 1.5, f"line {i}") for i in range(12)]
    assert (tmp_path / "x.vtt").read_text().startswith("WEBVTT\n\n00:00.000 --> 00:01.500\nline 0\n")
    assert (tmp_path / "x.tsv").read_text().startswith("start\tend\ttext\n0\t1500\tline 0\n")
    subtitles.write_subtitles(rows, str(tmp_path), "aud", speaker="speaker")
    assert (tmp_path / "x.aud").read_text().startswith("0.0\t1.5\t[[S]]line 0\n2.0\t3.5\tline 1\n")
    with pytest.raises(ValueError):
        subtitles.read_subtitles(spark, f"{tmp_path}/none")


SHELF = "shelf://"


def shelf(uri):
    """A scheme that Arrow doesn't know."""
    assert uri.startswith(SHELF)
    root, _, rest = uri.removeprefix(SHELF).partition("!")
    return fs.SubTreeFileSystem(root, fs.LocalFileSystem()), rest


def test_writer_on_other_file_systems(spark, tmp_path):
    rows = spark.createDataFrame([(f"{f}.mp4", i, i * 1.0, i + 0.5, f"{f} “{i}”\n好") for f in "ab" for i in range(3)], "file_id string, seg_idx int, start double, end double, text string").repartition(3)
    subtitles.write_subtitles(rows, f"{SHELF}{tmp_path}!out/deep", "json", language="yue", opener=f"{__name__}:shelf")
    subtitles.write_subtitles(rows, f"file://{tmp_path}/uri", "srt")
    assert sorted(p.name for p in (tmp_path / "out/deep").iterdir()) == ["a.json", "b.json"]
    found = json.loads((tmp_path / "out/deep/b.json").read_text(encoding="utf-8"))
    assert found["language"] == "yue" and [x["text"] for x in found["segments"]] == [f"b “{i}”\n好" for i in range(3)]
    assert sorted(p.name for p in (tmp_path / "uri").iterdir()) == ["a.srt", "b.srt"]
    subtitles.write_subtitles(rows.where("file_id = 'a.mp4' AND seg_idx = 0"), f"file://{tmp_path}/uri", "srt")
    assert (tmp_path / "uri/a.srt").read_text(encoding="utf-8").count("-->") == 1
    subtitles.write_subtitles(rows.where("false"), str(tmp_path / "empty"), "json")
    assert not list((tmp_path / "empty").iterdir())


def test_writer_moves_nothing_of_a_failed_job(spark, tmp_path):
    schema = "file_id string, seg_idx int, start double, end double, text string"
    for files in (("x.mp4", "x.mkv"), ("x.mp4", None)):
        with pytest.raises(Exception, match="x.srt|file_id"):
            subtitles.write_subtitles(spark.createDataFrame([(f, 0, 0.0, 1.0, "a") for f in files], schema), str(tmp_path))
        assert not list(tmp_path.iterdir())


def wav(x, width, channels, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(b"".join((int(v * 2 ** (8 * width - 1)) + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in x for _ in range(channels)))
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("rate", [16_000, 8_000, 44_100])
def test_decoding_in_pieces(width, rate):
    x = np.sin(np.arange(1_000) / 40) * 0.9
    for size in (7, 64, 5_000):
        pieces = list(media.wav_pieces(wav(x, width, 2, rate), size=size))
        total = int(1_000 * 16_000 / rate)
        assert all(len(p) == size for p in pieces[:-1]) and sum(map(len, pieces)) == total
        want = np.interp(np.arange(total) * rate / 16_000, np.arange(1_000), x)
        assert np.abs(np.concatenate(pieces) - want).max() < 2.0 ** (2 - 8 * width) + 1e-6
    assert not list(media.wav_pieces(wav([], width, 1, rate)))


def test_decode_and_probe_tables(spark, tmp_path):
    x = np.sin(np.arange(300) / 9).astype(np.float32) / 2
    for name, samples in (("a", x), ("b", x[:64]), ("none", x[:0])):
        (tmp_path / f"{name}.wav").write_bytes(media.encode_wav(samples))
    read = spark.read.format("binaryFile")
    got = {(r.file_id, r.block): np.frombuffer(r.samples, "<f4") for r in media.decode_blocks(read.load(str(tmp_path)), size=64).collect()}
    assert sorted(got) == [*(("a.wav", k) for k in range(5)), ("b.wav", 0)]
    assert np.allclose(np.concatenate([got["a.wav", k] for k in range(5)]), x, atol=1e-4)
    paths = read.load(str(tmp_path)).select("path")
    reader = lambda p: [] if p.endswith("b.wav") else [{"index": 1, "codec": "pcm", "tags": {"language": "yue"}}, {"index": 2}]
    found = {r.path.rpartition("/")[2]: [(s["index"], s.tags and s.tags.language) for s in r.streams] for r in media.probe(paths, reader).collect()}
    assert found == {"a.wav": [(1, "yue"), (2, None)], "b.wav": [], "none.wav": [(1, "yue"), (2, None)]}
    (tmp_path / "broken.wav").write_bytes(b"no sound")
    with pytest.raises(Exception, match="broken.wav"):
        media.decode_blocks(read.load(f"{tmp_path}/broken.wav")).collect()


def test_media(spark, tmp_path):
    sound = np.sin(np.arange(1600) / 10).astype(np.float32) / 2
    (tmp_path / "b.WAV").write_bytes(media.encode_wav(sound))
    (tmp_path / "a.wav").write_bytes(media.encode_wav(sound))
    (tmp_path / "c.txt").write_text("no")
    found = media.discover_media(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in found.collect()] == ["a.wav", "b.WAV"]
    audio = media.load_audio(spark.read.format("binaryFile").load(f"{tmp_path}/a.wav")).first()
    assert np.allclose(np.frombuffer(audio.samples, np.float32), sound, atol=1e-4)
    streams = spark.createDataFrame([('{"streams":[{"index":1,"tags":{"language":"yue"}}]}',), ("broken",)], "p string").select(F.size(media.parse_streams(F.col("p"))).alias("n")).collect()
    assert [r.n for r in streams] == [1, 0]


def test_config(tmp_path):
    assert config.write_default(tmp_path / "c" / "default.cfg") and not config.write_default(tmp_path / "c" / "default.cfg")
    assert config.read_file(tmp_path / "c" / "default.cfg")["vad_offset"] == 0.363
    (tmp_path / "own.cfg").write_text("[x]\nvad_onset = 0.7\nlanguage = None\n")
    merged = config.resolve({"vad_onset": 0.9}, config.read_file(tmp_path / "own.cfg"), [{"chunk_size": 20}])
    assert (merged["vad_onset"], merged["chunk_size"], merged["language"]) == (0.9, 20, None)
    for key, value in (("none", "1"), ("vad_onset", "x"), ("output_format", "doc")):
        with pytest.raises(ValueError):
            config.coerce(key, value)
    with pytest.raises(ValueError):
        config.config_path("../x", tmp_path)
    assert config.profile("org/unknown") == config.PROFILES["default"]


def test_streaming_cleans_rows(spark, tmp_path):
    spark.createDataFrame([("f", 0, "好 好!"), ("f", 1, "嗯")], "file_id string, seg_idx int, text string").write.parquet(str(tmp_path / "in"))
    stream = clean_captions(spark.readStream.schema("file_id string, seg_idx int, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [r.text for r in spark.table("cleaned").collect()] == ["好好！"]
