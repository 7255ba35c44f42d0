"""Profiles of models and names of languages."""

import pytest
from pyspark.sql import functions as F

from captionlake.functions import languages, profiles, steps
from captionlake.plans import pipeline
from captionlake.sources import config

SCRIPT, VARIANTS = steps.LongestMatch({"头发": "頭髮", "头": "頭", "发": "發"}), {"裏": "裡"}
KNOWN = {"both": {"convert_script": True, "variants": True}, "script": {"convert_script": True}, "plain": {}, "org/plain": {"variants": True}}


def test_normalise_by_each_rows_model(spark):
    s = "头发发头裏"
    cases = [("both", "頭髮發頭裡"), ("org/both", "頭髮發頭裡"), ("script", "頭髮發頭裏"), ("plain", s), ("org/plain", "头发发头裡"), ("other", s), (None, s), ("both/", s)]
    rows = spark.createDataFrame([(m, s, want) for m, want in cases] + [("both", None, None), ("both", "", "")], "model string, text string, want string")
    got = rows.select("model", "want", profiles.normalise_by(F.col("text"), F.col("model"), KNOWN, SCRIPT, VARIANTS).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    for m, want in cases:
        if m:
            assert rows.where(F.col("model") == m).select(profiles.normalise(F.col("text"), config.profile(m, KNOWN), SCRIPT, VARIANTS)).first()[0] == want


def test_tables_that_a_profile_asks_for(spark):
    for name in ("both", "script"):
        with pytest.raises(ValueError):
            profiles.normalise(F.col("x"), KNOWN[name], None, VARIANTS)
    with pytest.raises(ValueError):
        profiles.normalise_by(F.col("x"), F.col("m"), KNOWN, SCRIPT, None)


def test_transcribe_follows_the_profile(spark):
    vad = spark.createDataFrame([("f", 0, 0.0, 0.4, b"x")], "file_id string, seg_idx int, start double, end double, audio binary")
    emission = [[-9.0, -0.1, -9.0, -9.0], [-9.0, -9.0, -0.2, -0.5]]
    for model, want in (("default", "头咁"), ("Qwen3-ASR", "頭噉")):
        options = pipeline.Options(model=model, script=SCRIPT, variants=VARIANTS)
        out = pipeline.transcribe(vad, lambda part: [{"text": "头咁"} for _ in part], lambda part: [{"emission": emission} for _ in part], {"頭": 1, "头": 1, "咁": 2, "噉": 3}, options)
        assert [r.text for r in out.collect()] == [want]


def test_languages(spark):
    cases = [("yue", "yue", "Cantonese", False), ("Flemish", "nl", "Flemish", True), ("HAITIAN", "ht", "Haitian", True), ("ht", "ht", "Haitian creole", True), ("chinese", "zh", "Chinese", False), ("xx", None, "Xx", True), ("", None, "", True), (None, None, None, True)]
    rows = spark.createDataFrame(cases, "x string, code string, name string, spaced boolean")
    x = F.col("x")
    for r in rows.select("*", languages.code(x), languages.long_name(x), languages.spaced(x)).collect():
        assert tuple(r)[4:] == tuple(r)[1:4]
    assert len(languages.NAMES) == 100 and all(c in languages.NAMES for c in languages.ALIASES.values())
