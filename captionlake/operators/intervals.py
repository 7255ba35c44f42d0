"""Interval joins within a file: overlap, nearest, dominant label, point in interval, bounded best candidate.

Times are whole microseconds in columns s and e. A plain inequality join is a nested loop; here both sides are dealt to
time buckets, joined by (file_id, bucket), checked, and kept only in the first bucket that the pair shares, so that no
pair comes twice and none is lost. Nearest rows come from one sort per file instead of a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Near the usual length of a row: longer rows lie in several buckets, shorter buckets make fewer pairs to check.
BUCKET_US = 600_000_000


def _bucket(x: Column, size: int) -> Column:
    return F.floor(x / F.lit(size)).cast("bigint")


def _spread(df: DataFrame, s: Column, e: Column, size: int) -> DataFrame:
    return df.withColumn("_first", _bucket(s, size)).withColumn("bucket", F.explode(F.sequence("_first", F.greatest(_bucket(e, size), F.col("_first")))))


def overlap_pairs(left: DataFrame, right: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Pairs with right.s < left.e and right.e > left.s (strict), of the same file.

    left: file_id, seg_idx, s, e, ...; right: file_id, ref_idx, rs, re, ... (other names must differ).
    """
    a = _spread(left, F.col("s"), F.col("e"), bucket_us)
    b = _spread(right, F.col("rs"), F.col("re"), bucket_us).withColumnRenamed("_first", "_rfirst")
    both = a.join(b, ["file_id", "bucket"])
    return both.where((F.col("rs") < F.col("e")) & (F.col("re") > F.col("s")) & (F.col("bucket") == F.greatest("_first", "_rfirst"))).drop("bucket", "_first", "_rfirst")


def overlap_text(left: DataFrame, right: DataFrame, sep: str = "，", bucket_us: int = BUCKET_US) -> DataFrame:
    """file_id, seg_idx, texts: the texts of all overlapping references in their order."""
    return overlap_pairs(left, right, bucket_us).groupBy("file_id", "seg_idx").agg(F.expr(f"listagg(rtext, '{sep}') WITHIN GROUP (ORDER BY ref_idx)").alias("texts"))


def nearest(left: DataFrame, right: DataFrame, t: str = "t", rt: str = "rt") -> DataFrame:
    """Each left row with the right row of its file whose rt is nearest to t: ref_idx, dist. Ties: the smaller ref_idx.

    left: file_id, seg_idx, t; right: file_id, ref_idx, rt. Rows of files without a right row do not come. One sort per file.
    """
    points = right.groupBy("file_id", F.col(rt).alias("at")).agg(F.min("ref_idx").alias("ref_idx"))
    both = left.select("file_id", F.col(t).alias("at"), "seg_idx", F.lit(None).cast("struct<at:bigint,ref_idx:bigint>").alias("r")).unionByName(
        points.select("file_id", "at", F.lit(None).cast("bigint").alias("seg_idx"), F.struct(F.col("at").cast("bigint").alias("at"), F.col("ref_idx").cast("bigint").alias("ref_idx")).alias("r"))
    )
    w = Window.partitionBy("file_id").orderBy("at")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    near = both.select("file_id", "seg_idx", "at", F.last("r", True).over(before).alias("b"), F.first("r", True).over(after).alias("a")).where(F.col("seg_idx").isNotNull())
    cand = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.abs(F.col(f"{r}.at") - F.col("at")).alias("dist"), F.col(f"{r}.ref_idx").alias("ref_idx")))
    best = near.withColumn("best", F.least(cand("b"), cand("a"))).where(F.col("best").isNotNull())
    return best.select("file_id", "seg_idx", F.col("best.ref_idx").alias("ref_idx"), F.col("best.dist").alias("dist"))


def with_midpoints(df: DataFrame, s: str, e: str, out: str) -> DataFrame:
    """Twice the midpoint, so that it stays whole."""
    return df.withColumn(out, F.col(s) + F.col(e))


def match_references(left: DataFrame, right: DataFrame, limit_us: int = 2_000_000, sep: str = "，", bucket_us: int = BUCKET_US) -> DataFrame:
    """file_id, seg_idx, reference: overlapping texts; else the nearest by midpoint within limit_us, inclusive; else ''."""
    texts = overlap_text(left, right, sep, bucket_us)
    alone = left.join(texts.select("file_id", "seg_idx"), ["file_id", "seg_idx"], "left_anti")
    near = nearest(with_midpoints(alone, "s", "e", "t"), with_midpoints(right, "rs", "re", "rt")).where(F.col("dist") <= 2 * limit_us)
    near = near.join(right.select("file_id", "ref_idx", F.col("rtext").alias("near_text")), ["file_id", "ref_idx"]).select("file_id", "seg_idx", "near_text")
    out = left.select("file_id", "seg_idx").join(texts, ["file_id", "seg_idx"], "left").join(near, ["file_id", "seg_idx"], "left")
    return out.select("file_id", "seg_idx", F.coalesce("texts", "near_text", F.lit("")).alias("reference"))


def dominant_label(left: DataFrame, turns: DataFrame, fill_nearest: bool = False, bucket_us: int = BUCKET_US) -> DataFrame:
    """file_id, seg_idx, label: the label with most shared time; ties go to the label first seen in start order.

    A segment or turn without length shares no time with what it lies in, but overlaps it; its label counts with 0.
    Segments that no turn overlaps have a null label, or with fill_nearest that of the turn whose midpoint is nearest.
    turns: file_id, ref_idx (in start order), rs, re, label.
    """
    shared = overlap_pairs(left, turns, bucket_us).withColumn("shared", F.least("e", "re") - F.greatest("s", "rs"))
    per = shared.groupBy("file_id", "seg_idx", "label").agg(F.sum("shared").alias("total"), F.min("ref_idx").alias("seen"))
    best = per.groupBy("file_id", "seg_idx").agg(F.max_by("label", F.struct(F.col("total"), -F.col("seen"))).alias("label"), F.max("total").alias("total"))
    out = left.select("file_id", "seg_idx", "s", "e").join(best, ["file_id", "seg_idx"], "left")
    if fill_nearest:
        lost = out.where(F.col("label").isNull()).select("file_id", "seg_idx", "s", "e")
        near = nearest(with_midpoints(lost, "s", "e", "t"), with_midpoints(turns, "rs", "re", "rt")).join(turns.select("file_id", "ref_idx", F.col("label").alias("near_label")), ["file_id", "ref_idx"])
        out = out.join(near.select("file_id", "seg_idx", "near_label"), ["file_id", "seg_idx"], "left").withColumn("label", F.coalesce("label", "near_label"))
    return out.select("file_id", "seg_idx", "label", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))


def word_labels(words: DataFrame, turns: DataFrame, fill_nearest: bool = False, bucket_us: int = BUCKET_US) -> DataFrame:
    """dominant_label for words (file_id, seg_idx, word_idx, s, e): words without s are skipped, a missing e counts as s."""
    timed = words.where(F.col("s").isNotNull()).withColumn("e", F.coalesce("e", "s"))
    keyed = timed.withColumn("_w", F.struct("seg_idx", "word_idx")).select("file_id", F.col("_w").alias("seg_idx"), "s", "e")
    return dominant_label(keyed, turns, fill_nearest, bucket_us).select("file_id", F.col("seg_idx.seg_idx").alias("seg_idx"), F.col("seg_idx.word_idx").alias("word_idx"), "label", "total")


def point_in_interval(points: DataFrame, intervals: DataFrame, slack_us: int = 5000, bucket_us: int = BUCKET_US) -> DataFrame:
    """file_id, seg_idx, vad_idx: the first interval with s - slack <= t < e; else the last one if t <= its e + slack; else null.

    points: file_id, seg_idx, t; intervals: file_id, ref_idx, rs, re.
    """
    a = points.withColumn("bucket", _bucket(F.col("t"), bucket_us))
    b = _spread(intervals, F.col("rs") - slack_us, F.col("re"), bucket_us)
    hit = a.join(b, ["file_id", "bucket"]).where((F.col("t") >= F.col("rs") - slack_us) & (F.col("t") < F.col("re"))).groupBy("file_id", "seg_idx").agg(F.min("ref_idx").alias("hit"))
    last = intervals.groupBy("file_id").agg(F.max(F.struct("ref_idx", "re")).alias("last"))
    out = points.join(hit, ["file_id", "seg_idx"], "left").join(last, "file_id", "left")
    return out.select("file_id", "seg_idx", F.coalesce("hit", F.when(F.col("t") <= F.col("last.re") + slack_us, F.col("last.ref_idx"))).alias("vad_idx"))


def best_candidate(searches: DataFrame, candidates: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """file_id, seg_idx, ref_idx, score: of the candidates that reach into [s, e), the best score; ties: the first.

    searches: file_id, seg_idx, s, e; candidates: file_id, ref_idx, rs, re, score.
    """
    return overlap_pairs(searches, candidates, bucket_us).groupBy("file_id", "seg_idx").agg(F.max_by("ref_idx", F.struct(F.col("score"), -F.col("ref_idx"))).alias("ref_idx"), F.max("score").alias("score"))
