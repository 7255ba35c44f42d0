"""Windows over the rows of a file: state, islands, runs, trimming, context and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def hysteresis(score: Column, order: WindowSpec, onset: float, offset: float | None = None) -> Column:
    """1 while active: from a score over onset until one under offset; 0 before the first. An offset of 0 or None is the onset."""
    offset = offset or onset
    change = F.when(score > onset, 1).when(score < offset, 0)
    return F.coalesce(F.last(change, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def islands(df: DataFrame, value: str, partition: list[str], order: list[str], out: str = "run") -> DataFrame:
    """Number the runs of equal values, from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def active_regions(frames: DataFrame, onset: float, offset: float, min_us: int = 0) -> DataFrame:
    """file_id, region, s, e of each active stretch; it ends at the frame that ends it, or at the file's last frame.

    frames: file_id, t, k (breaks ties of t), y.
    """
    w = Window.partitionBy("file_id").orderBy("t", "k")
    rows = frames.withColumn("active", hysteresis(F.col("y"), w, onset, offset)).withColumn("next_t", F.lead("t").over(w))
    runs = islands(rows, "active", ["file_id"], ["t", "k"]).where("active = 1")
    regions = runs.groupBy("file_id", "run").agg(F.min("t").alias("s"), F.max_by(F.coalesce("next_t", "t"), F.struct("t", "k")).alias("e")).where(F.col("e") - F.col("s") >= min_us)
    return regions.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("run")) - 1).alias("region"), "s", "e")


def fill_gaps(regions: DataFrame, gap_us: int, pad_before: int = 0, pad_after: int = 0) -> DataFrame:
    """Pad regions and merge those closer than gap_us: file_id, region, s, e."""
    padded = regions.select("file_id", (F.col("s") - pad_before).alias("s"), (F.col("e") + pad_after).alias("e"))
    w = Window.partitionBy("file_id").orderBy("s", "e")
    far = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = padded.withColumn("_new", F.when(F.col("s") - far <= gap_us, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("file_id", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("_run")) - 1).alias("region"), "s", "e")


def merge_repeats(path: DataFrame) -> DataFrame:
    """Runs of one token on a path: file_id, run, token, first_frame, end_frame, score (mean), n. path: file_id, frame, token, score."""
    return islands(path, "token", ["file_id"], ["frame"]).groupBy("file_id", "run").agg(F.first("token").alias("token"), F.min("frame").alias("first_frame"), (F.max("frame") + 1).alias("end_frame"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def merge_words(runs: DataFrame, separator: str) -> DataFrame:
    """Words between separators: joined tokens, frame span and mean score weighted by length. runs: as merge_repeats gives."""
    w = Window.partitionBy("file_id").orderBy("run")
    parts = runs.withColumn("word", F.sum((F.col("token") == separator).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("token") != separator)
    length = F.col("end_frame") - F.col("first_frame")
    return parts.groupBy("file_id", "word").agg(F.expr("listagg(token, '') WITHIN GROUP (ORDER BY run)").alias("text"), F.min("first_frame").alias("first_frame"), F.max("end_frame").alias("end_frame"), (F.sum(F.col("score") * length) / F.sum(length)).alias("score"))


def release_and_trim(rows: DataFrame, release: int, padding: int) -> DataFrame:
    """First e = release_from + release where release_from is known; then e is cut to the next row's s - padding if over it.

    rows: file_id, seg_idx, s, e, release_from. The last row of a file is not cut.
    """
    released = rows.withColumn("e", F.when(F.col("release_from").isNotNull(), F.col("release_from") + release).otherwise(F.col("e")))
    limit = F.lead("s").over(Window.partitionBy("file_id").orderBy("seg_idx")) - padding
    return released.withColumn("_limit", limit).withColumn("e", F.when(F.col("e") > F.col("_limit"), F.col("_limit")).otherwise(F.col("e"))).drop("_limit")


def context(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add prev_text and next_text, empty at a file's ends."""
    w = Window.partitionBy("file_id").orderBy("seg_idx")
    return rows.withColumn("prev_text", F.lag(text, 1, "").over(w)).withColumn("next_text", F.lead(text, 1, "").over(w))


def interpolate(rows: DataFrame, value: str, method: str = "nearest", out: str = "filled") -> DataFrame:
    """Fill nulls of a file's sequence (file_id, seg_idx): nearest (ties: the earlier), linear, or ignore; ends by the closest value.

    With at most one value in a file, that value fills all.
    """
    if method == "ignore":
        return rows.withColumn(out, F.col(value))
    w = Window.partitionBy("file_id").orderBy("seg_idx")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    x = rows.withColumn("_i", F.row_number().over(w))
    x = x.withColumn("_pv", F.last(value, True).over(back)).withColumn("_pi", F.last(at, True).over(back)).withColumn("_nv", F.first(value, True).over(ahead)).withColumn("_ni", F.first(at, True).over(ahead))
    before, after = F.col("_i") - F.col("_pi"), F.col("_ni") - F.col("_i")
    if method == "nearest":
        inner = F.when(before <= after, F.col("_pv")).otherwise(F.col("_nv"))
    elif method == "linear":
        inner = F.when(before == 0, F.col("_pv")).otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * before / (before + after))
    else:
        raise ValueError(f"unknown method {method!r}")
    return x.withColumn(out, F.when(F.col("_pv").isNull(), F.col("_nv")).when(F.col("_nv").isNull(), F.col("_pv")).otherwise(inner)).drop("_i", "_pv", "_pi", "_nv", "_ni")


def running_sum(rows: DataFrame, value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy("file_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)))


def carried(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The last known value up to each row."""
    return rows.withColumn(out, F.last(value, True).over(Window.partitionBy("file_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays; null where either is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def adjacent_cosine(rows: DataFrame, vector: str, out: str = "similarity") -> DataFrame:
    """Similarity of each row's vector to the row before in its file; null for the first."""
    w = Window.partitionBy("file_id").orderBy("seg_idx")
    return rows.withColumn("_p", F.lag(vector).over(w)).withColumn(out, cosine(F.col("_p"), F.col(vector))).drop("_p")


def concat_same_span(rows: DataFrame, sep: str = "") -> DataFrame:
    """One row for each (file_id, s, e) that is known: texts in order, release_from and avg_logprob of the first row."""
    timed = rows.where(F.col("s").isNotNull() & F.col("e").isNotNull())
    return timed.groupBy("file_id", "s", "e").agg(F.expr(f"listagg(text, '{sep}') WITHIN GROUP (ORDER BY seg_idx)").alias("text"), F.count(F.lit(1)).alias("n"), F.min("seg_idx").alias("first_idx"))


def group_extents(chars: DataFrame, group: str, split_chars: str) -> DataFrame:
    """Per (file_id, group): earliest start, latest end and mean score of its timed characters other than spaces, text, release_from.

    release_from is the start of the last character where that is a split character. chars: file_id, group, pos, char, s, e, score.
    """
    solid = F.col("char") != " "
    last = F.max_by(F.struct("char", "s"), F.col("pos"))
    out = chars.groupBy("file_id", group).agg(
        F.min(F.when(solid, F.col("s"))).alias("s"), F.max(F.when(solid, F.col("e"))).alias("e"), F.round(F.avg(F.when(solid, F.col("score"))), 3).alias("score"), F.expr("listagg(char, '') WITHIN GROUP (ORDER BY pos)").alias("text"), last.alias("_last")
    )
    return out.withColumn("release_from", F.when(F.instr(F.lit(split_chars), F.col("_last.char")) > 0, F.col("_last.s"))).drop("_last")
