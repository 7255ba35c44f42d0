import pytest
from pyspark.sql import functions as F

from captionlake.functions import formatting, rules, steps, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rules_in_order_and_as_python(spark, tmp_path):
    f = tmp_path / "r.toml"
    f.write_text("[[rules]]\npattern = 'a'\nreplace = 'b'\n[[rules]]\npattern = 'b'\nreplace = 'c'\n[[rules]]\npattern = '(x+)\\s$'\nreplace = '<\\1$>'\n")
    loaded = rules.load_rules(f)
    for s in ("aab", "xx　", "xx \n", "x \r", "$x \\"):
        assert one(spark, rules.apply_rules(F.lit(s), loaded)) == rules.apply_rules_python(s, loaded)


@pytest.mark.parametrize("body,message", [("[[rules]]\npattern = 'a'\n", "rule #1"), ("[[rules]]\npattern = 'a'\nreplace = ''\n[[rules]]\npattern = '('\nreplace = ''\n", "rule #2")])
def test_bad_rules_are_named(tmp_path, body, message):
    (tmp_path / "bad.toml").write_text(body)
    with pytest.raises(ValueError, match=f"bad.toml: {message}"):
        rules.load_rules(tmp_path / "bad.toml")


def test_many_rules_do_not_deepen_the_plan(spark):
    many = tuple(rules.Rule(f"q{k}z", "") for k in range(500))
    assert one(spark, rules.apply_rules(F.lit("q7z ok"), many)) == " ok"


def test_manifest_errors(tmp_path):
    with pytest.raises(ValueError, match="no step manifest"):
        rules.load_steps(tmp_path, {})
    for body in ("type = 'rules'\nfile = 'none.toml'", "type = 'builtin'\nname = 'none'", "type = 'other'"):
        (tmp_path / "pipeline.toml").write_text(f"[[steps]]\n{body}\n")
        with pytest.raises(ValueError):
            rules.load_steps(tmp_path, {})
    assert "linebreak" not in [n for n, _ in rules.load_steps(None, steps.builtin_steps(), 1)]


def test_cleaning(spark):
    todo = rules.load_steps(None, steps.builtin_steps(18))
    assert one(spark, rules.clean(F.lit("我 哋 去U.S.A.睇,好唔好?"), todo)) == "我哋去USA.睇，好唔好？"
    assert one(spark, rules.clean(F.lit("三十五個人，係呀係呀係呀"), todo)) == "35個人，係啊…"


@pytest.mark.parametrize(
    "given,want",
    [
        ("U.S.A", "USA"), ("A B C", "ABC"), ("Xi A", "Xi A"), ("USA. UK", "USA. UK"), ("one A two", "one A two"), ("AB\nC", "ABC"),
        ("去T V B. OK未", "去TVB. OK未"), ("N.B .  A", "NBA"), ("C,D", "C,D"), ("C，D", "C，D"), ("買B Bag", "買B Bag"), ("睇D V disc", "睇DV disc"), ("drXY", "drXY"), ("hi X Y", "hi XY"),
    ],
)
def test_acronyms(given, want):
    assert steps.acronyms(given) == want


@pytest.mark.parametrize(
    "given,want",
    [
        ("三十五", "35"), ("十", "十"), ("二十", "20"), ("三百", "300"), ("二千", "2000"), ("一百", "一百"), ("五萬", "五萬"), ("一百零五", "105"), ("一二三", "一二三"), ("五號", "5號"), ("十二月", "12月"), ("一九九七年", "1997年"),
        ("三萬五千", "35000"), ("十萬", "十萬"), ("两百三十", "230"), ("幾十個", "幾十個"), ("二零二", "二零二"), ("七千零二十", "7020"), ("十月二十二號", "十月22號"), ("四個", "四個"), ("百五", "百五"),
    ],
)
def test_numerals(given, want):
    assert steps.numerals(given) == want


def test_line_breaks():
    a, b = "甲" * 8, "乙" * 20
    assert steps.break_line("甲" * 21) == "甲" * 21
    assert steps.break_line(f"{a}，{b}") == f"{a}，\n{b}"
    assert steps.break_line("甲" * 21 + "，" + "乙" * 8, is_word=lambda x: True) == "甲" * 21 + "，\n" + "乙" * 8  # the last place of the second pass
    assert steps.break_line(f"{a} ，{b}，", is_word=lambda x: True) == f"{a} ，\n{b}，"
    assert steps.break_line("甲" * 12 + " " + "乙" * 14, is_word=lambda x: True) == "甲" * 12 + " \n" + "乙" * 14  # the blank stays
    assert steps.break_line("甲" * 10 + "-" + "乙" * 14, is_word=lambda x: True) == "甲" * 10 + "-\n" + "乙" * 14
    assert steps.break_line("甲" * 30) == "甲" * 16 + "\n" + "甲" * 14
    assert steps.break_line("a" * 30) == "a" * 30


def test_character_classes(spark):
    rows = spark.createDataFrame([("a",), ("７",), ("甲",), ("é",), ("，",), ("。",), ("-",), ("\u3000",)], "c string")
    got = {r.c: (r.x, r.y) for r in rows.select("c", text.is_non_chinese(F.col("c")).alias("x"), text.is_punctuation(F.col("c")).alias("y")).collect()}
    assert {c for c, (x, _) in got.items() if x} == {"a", "７"} and {c for c, (_, y) in got.items() if y} == {"，", "-", "\u3000"}


def test_line_break_places():
    assert steps.break_line("短句", 18) == "短句"
    assert steps.break_line("一二三四五六，七八九十一二三四五六七", 10) == "一二三四五六，\n七八九十一二三四五六七"
    assert steps.break_line("甲" * 20, 18).count("\n") == 1
    assert steps.break_line("甲" * 20, 18, lambda w: True) == "甲" * 20


def test_script_conversion_takes_the_longest_entry(tmp_path):
    (tmp_path / "d.txt").write_text("发\t發\n头发\t頭髮 x\n")
    conv = steps.LongestMatch.read(str(tmp_path / "d.txt"))
    assert conv("头发发布") == "頭髮發布"


def test_segments_questions_and_spans(spark):
    assert one(spark, text.split_segments(F.lit("a？？b！c。d"))) == ["a？？", "b！", "c。", "d"]
    assert one(spark, text.is_question(F.lit("好唔好？"))) and one(spark, text.is_question(F.lit("邊個？"))) and not one(spark, text.is_question(F.lit("好。")))
    assert [tuple(x) for x in one(spark, text.sentence_spans(F.lit("ab，c。")))] == [(0, 2), (3, 4), (5, 5)]
    assert not one(spark, text.is_question(F.lit("a唔a？"))) and one(spark, text.is_question(F.lit("a唔a？"), char="."))
    for given, want in (
        ("去唔去呀？好嘎。", "去唔去啊？好㗎。"),  # asked; stated
        ("點解啫？", "點解唧？"),
        ("真㗎？好啊？", "真嘎？好呀？"),  # a mark alone
        ("乜你有冇食啊？", "乜你有冇食呀？"),  # asked, opened by the word
        ("乜嘢嚟㗎呀？", "乜嘢嚟㗎啊？"),
        ("好呀！去呀", "好啊！去啊"),
        ("", ""),
    ):
        assert one(spark, steps.question_particles(F.lit(given))) == want
    assert one(spark, steps.trim_lines(F.lit("，a \n 　b，"))) == "a\nb"
    assert one(spark, text.trailing_particles(F.lit("係啦喎"))[1]) == "啦喎"


def test_guards(spark):
    ok = lambda p, r, **k: one(spark, text.accept_reference(F.lit(p), F.lit(r), **k))
    assert ok("我哋去食飯啦", "我哋去食飯喇") == "我哋去食飯啦"
    assert ok("我哋去食飯", "\n 我哋去飲茶 \nx") == "我哋去飲茶"
    assert ok("我哋去食飯", "佢唔去") == "我哋去食飯" and ok("我哋去食飯", "【註】我哋去食飯") == "我哋去食飯"
    assert one(spark, text.accept_rewrite(F.lit("ab"), F.lit("abcdef"))) == "ab"
    pairs = text.parse_substitutions(F.lit("甲乙→甲丙\n無需修正\n丁→戊\n己庚→己庚"))
    assert [tuple(x) for x in one(spark, pairs)] == [("甲乙", "甲丙")]
    assert one(spark, text.apply_substitutions(F.lit("甲乙丙"), pairs)) == "甲丙丙"
    assert one(spark, text.strip_thinking(F.lit("a<think>b\nc</think>d"))) == "ad"


def test_variants_must_not_chain(spark):
    assert one(spark, text.translate_chars(F.lit("abc"), {"a": "x", "b": "y"})) == "xyc"
    with pytest.raises(ValueError):
        text.translate_chars(F.lit("a"), {"a": "b", "b": "c"})


@pytest.mark.parametrize("seconds,hours,want", [(0.0, False, "00:00.000"), (3599.9996, False, "01:00:00.000"), (0.0005, True, "00:00:00.000"), (0.0015, True, "00:00:00.002"), (360000.0, True, "100:00:00.000")])
def test_timestamps(spark, seconds, hours, want):
    assert one(spark, formatting.format_timestamp(F.lit(seconds), hours)) == want


def test_formatting_cases(spark):
    assert one(spark, formatting.caption_text(F.lit("　a --> b "), F.lit("S"))) == "[S]: a -> b"
    assert one(spark, formatting.tsv_line(F.lit(1), F.lit(2), F.lit("a\tb"))) == "1\t2\ta b"
    assert one(spark, formatting.pad_or_trim(F.array(F.lit(1.0), F.lit(2.0)), 3)) == [1, 2, 0]
    assert one(spark, formatting.memory_fraction(F.lit(5399.0), F.lit(5338.0), F.lit(10737.0), F.lit(512.0))) == pytest.approx(0.9523, abs=1e-3)
    with pytest.raises(Exception, match="negative"):
        one(spark, formatting.format_timestamp(F.lit(-1.0)))


def test_tracks(spark):
    rows = spark.createDataFrame([(1, 0, "eng", None), (1, 1, "chi", "x"), (1, 2, "yue", None), (2, 0, None, None), (2, 1, "ZHO", None), (3, 0, "YUE", "Cantonese dub"), (4, 0, "eng", "English")], "f int, i int, language string, title string")
    got = {r.f: r.t for r in rows.groupBy("f").agg(text.choose_track(F.col("language"), F.col("title"), F.col("i")).alias("t")).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 0}
