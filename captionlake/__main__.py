"""Command line: convert subtitle files between formats, optionally cleaned and shifted."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from captionlake.functions import formatting, rules, steps, text
from captionlake.sources import config, subtitles


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="captionlake", description=__doc__, argument_default=argparse.SUPPRESS)
    p.add_argument("input", help="subtitle file, folder or pattern (.srt, .vtt)")
    p.add_argument("output_dir")
    p.add_argument("--output-format", choices=config.OPTIONS["output_format"].choices)
    p.add_argument("--max-line-width", type=int)
    p.add_argument("--config", help="configuration file; flags count over it")
    p.add_argument("--rules", help="folder of rule files")
    p.add_argument("--clean", action="store_true")
    p.add_argument("--shift", type=float, help="seconds")
    given = vars(p.parse_args(argv))
    own = {k: given.pop(k, None) for k in ("input", "output_dir", "config", "rules", "clean", "shift")}
    options = config.resolve(given, config.read_file(own["config"]) if own["config"] else None)
    spark = SparkSession.builder.appName("captionlake").getOrCreate()
    rows = subtitles.read_subtitles(spark, own["input"])
    if own["shift"]:
        rows = rows.withColumn("start", formatting.shifted(F.col("start"), F.lit(own["shift"]))).withColumn("end", formatting.shifted(F.col("end"), F.lit(own["shift"])))
    if own["clean"]:
        todo = rules.load_steps(own["rules"], steps.builtin_steps(options["max_line_width"]), options["max_line_count"])
        rows = rows.withColumn("text", rules.clean(F.col("text"), todo)).where(~text.is_removable(F.col("text")))
    subtitles.write_subtitles(rows, own["output_dir"], options["output_format"], language=options["language"])


if __name__ == "__main__":
    main()
