"""Command line: the edit rate between two subtitle files, or between the files of the same name of two folders."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators.edit_rate import METRICS
from captionlake.sources.subtitles import read_subtitles


def rates(spark: SparkSession, hypothesis: str, reference: str, metric: str = "SubER") -> DataFrame:
    """file_id and rate of subtitle files (.srt, .vtt); of two single files, file_id is the reference's."""
    h, r = (read_subtitles(spark, path, keep_lines=True) for path in (hypothesis, reference))
    single = [x for x in (hypothesis, reference) if x.lower().endswith((".srt", ".vtt")) and "*" not in x]
    if len(single) == 2:
        only = r.select("file_id").limit(1)
        h = h.drop("file_id").crossJoin(F.broadcast(only))  # one row
    return METRICS[metric](h, r)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="captionlake.score", description=__doc__)
    p.add_argument("hypothesis", help="subtitle file or folder")
    p.add_argument("reference", help="subtitle file or folder")
    p.add_argument("--metric", choices=METRICS, default="SubER")
    given = p.parse_args(argv)
    spark = SparkSession.builder.appName("captionlake").getOrCreate()
    for row in rates(spark, given.hypothesis, given.reference, given.metric).orderBy("file_id").toLocalIterator():
        print(f"{row.file_id}\t{given.metric}: {row.rate}")


if __name__ == "__main__":
    main()
