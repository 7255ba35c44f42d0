"""One query for each operator, on the star-schema tables that stand in for captions, with its SQL.

events are timed segments (file: user, start: ts, length: value * 600 s), conversations are ordered lines (file:
conversation), documents are free text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.functions import boundaries, formatting, languages, profiles, rules, steps, text, words
from captionlake.operators import align, audio, blocks, edit_rate, folds, intervals, metrics, sequence, spectra
from captionlake.plans import retime, speech, stages
from captionlake.sources import config, media
from captionlake.sources.work import small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Segments last 8 hours on average.
BUCKET = 28_800_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str, label: str | None = None) -> DataFrame:
    """file_id, seg_idx, s, e, label, value, event_id; numbered within the file by time."""
    e = table(spark, sf, "events")
    if label:
        e = e.where(F.col("event_type") == label)
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").alias("file_id"), s.alias("s"), (s + F.floor(F.col("value") * 600_000_000).cast("bigint")).alias("e"), F.col("event_type").alias("label"), "value", "event_id")
    return rows.withColumn("seg_idx", (F.row_number().over(Window.partitionBy("file_id").orderBy("s", "event_id")) - 1).cast("bigint"))


def references(spark: SparkSession, sf: str, label: str) -> DataFrame:
    return segments(spark, sf, label).select("file_id", F.col("seg_idx").alias("ref_idx"), F.col("s").alias("rs"), F.col("e").alias("re"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rtext"), "label", "value")


def _seg(name: str, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx, epoch_us(ts) AS s,
      epoch_us(ts) + CAST(floor(value * 600000000) AS BIGINT) AS e, event_type AS label, value, event_id, 'r' || event_id AS rtext FROM events WHERE {where})"""


VIEW, BUY = _seg("a", "event_type = 'view'"), _seg("b", "event_type = 'purchase'")
OVERLAP = "a.file_id = b.file_id AND b.s < a.e AND b.e > a.s"


# ------------------------------------------------------------ interval joins


@query(f"WITH {VIEW}, {BUY} SELECT a.file_id, a.seg_idx, string_agg(b.rtext, '|' ORDER BY b.seg_idx) AS texts, count(*) AS n FROM a JOIN b ON {OVERLAP} GROUP BY ALL")
def interval_overlap_join(spark, sf):
    pairs = intervals.overlap_pairs(segments(spark, sf, "view").select("file_id", "seg_idx", "s", "e"), references(spark, sf, "purchase").drop("label", "value"), BUCKET)
    return pairs.groupBy("file_id", "seg_idx").agg(F.expr("listagg(rtext, '|') WITHIN GROUP (ORDER BY ref_idx)").alias("texts"), F.count(F.lit(1)).alias("n"))


_NEAR = f"""WITH {VIEW}, {BUY}, c AS (SELECT a.file_id, a.seg_idx, b.seg_idx AS ref_idx, abs((a.s + a.e) - (b.s + b.e)) AS dist FROM a JOIN b USING (file_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY file_id, seg_idx ORDER BY dist, ref_idx) AS k FROM c)"""


@query(f"{_NEAR} SELECT file_id, seg_idx, ref_idx, dist FROM r WHERE k = 1")
def nearest_reference(spark, sf):
    a = intervals.with_midpoints(segments(spark, sf, "view"), "s", "e", "t").select("file_id", "seg_idx", "t")
    return intervals.nearest(a, intervals.with_midpoints(references(spark, sf, "purchase"), "rs", "re", "rt"))


@query(
    f"{_NEAR}, o AS (SELECT a.file_id, a.seg_idx, string_agg(b.rtext, '，' ORDER BY b.seg_idx) AS texts FROM a JOIN b ON {OVERLAP} GROUP BY ALL) "
    "SELECT a.file_id, a.seg_idx, coalesce(o.texts, n.rtext, '') AS reference FROM a LEFT JOIN o ON a.file_id = o.file_id AND a.seg_idx = o.seg_idx "
    "LEFT JOIN (SELECT r.file_id, r.seg_idx, b.rtext FROM r JOIN b ON r.file_id = b.file_id AND r.ref_idx = b.seg_idx WHERE k = 1 AND dist <= 2 * 36000000000) n ON a.file_id = n.file_id AND a.seg_idx = n.seg_idx"
)
def reference_match_full(spark, sf):
    a = segments(spark, sf, "view").select("file_id", "seg_idx", "s", "e")
    return intervals.match_references(a, references(spark, sf, "purchase").drop("label", "value"), limit_us=36_000_000_000, bucket_us=BUCKET)


_ALL_TURNS = _seg("t", "event_type <> 'view'")


def turns(spark, sf):
    t = segments(spark, sf).where("label <> 'view'").drop("seg_idx")
    t = t.withColumn("ref_idx", (F.row_number().over(Window.partitionBy("file_id").orderBy("s", "event_id")) - 1).cast("bigint"))
    return t.select("file_id", "ref_idx", F.col("s").alias("rs"), F.col("e").alias("re"), "label")


_DOM = f"""WITH {VIEW}, {_ALL_TURNS}, p AS (SELECT a.file_id, a.seg_idx, t.label, sum(least(a.e, t.e) - greatest(a.s, t.s)) AS total, min(t.seg_idx) AS seen
 FROM a JOIN t ON a.file_id = t.file_id AND t.s < a.e AND t.e > a.s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY file_id, seg_idx ORDER BY total DESC, seen) AS k FROM p)"""


@query(f"{_DOM} SELECT a.file_id, a.seg_idx, k.label, CAST(coalesce(k.total, 0) AS BIGINT) AS total FROM a LEFT JOIN k ON a.file_id = k.file_id AND a.seg_idx = k.seg_idx AND k.k = 1")
def dominant_label(spark, sf):
    return intervals.dominant_label(segments(spark, sf, "view").select("file_id", "seg_idx", "s", "e"), turns(spark, sf), bucket_us=BUCKET)


@query(
    f"""WITH {VIEW}, {_ALL_TURNS}, w AS (SELECT file_id, seg_idx, i AS word_idx, s + i * (e - s) // 3 AS s, s + (i + 1) * (e - s) // 3 AS e FROM a, range(3) x(i)),
 p AS (SELECT w.file_id, w.seg_idx, w.word_idx, t.label, sum(least(w.e, t.e) - greatest(w.s, t.s)) AS total, min(t.seg_idx) AS seen FROM w JOIN t ON w.file_id = t.file_id AND t.s < w.e AND t.e > w.s GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY file_id, seg_idx, word_idx ORDER BY total DESC, seen) AS k FROM p)
 SELECT w.file_id, w.seg_idx, w.word_idx, k.label, CAST(coalesce(k.total, 0) AS BIGINT) AS total FROM w LEFT JOIN k ON w.file_id = k.file_id AND w.seg_idx = k.seg_idx AND w.word_idx = k.word_idx AND k.k = 1"""
)
def word_label(spark, sf):
    w = segments(spark, sf, "view").select("file_id", "seg_idx", "s", "e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("word_idx"))
    words = w.select("file_id", "seg_idx", "word_idx", F.expr("s + word_idx * (e - s) div 3").alias("s"), F.expr("s + (word_idx + 1) * (e - s) div 3").alias("e"))
    return intervals.word_labels(words, turns(spark, sf), bucket_us=BUCKET)


@query(
    f"""WITH {VIEW}, {BUY}, h AS (SELECT a.file_id, a.seg_idx, min(b.seg_idx) AS hit FROM a JOIN b ON a.file_id = b.file_id AND a.s >= b.s - 5000 AND a.s < b.e GROUP BY ALL),
 l AS (SELECT file_id, max(seg_idx) AS li, arg_max(e, seg_idx) AS le FROM b GROUP BY ALL)
 SELECT a.file_id, a.seg_idx, coalesce(h.hit, CASE WHEN a.s <= l.le + 5000 THEN l.li END) AS vad_idx FROM a LEFT JOIN h ON a.file_id = h.file_id AND a.seg_idx = h.seg_idx LEFT JOIN l ON a.file_id = l.file_id"""
)
def point_in_interval(spark, sf):
    points = segments(spark, sf, "view").select("file_id", "seg_idx", F.col("s").alias("t"))
    return intervals.point_in_interval(points, references(spark, sf, "purchase"), bucket_us=BUCKET)


@query(
    f"""WITH {VIEW}, {BUY}, c AS (SELECT a.file_id, a.seg_idx, b.seg_idx AS ref_idx, b.value AS score, row_number() OVER (PARTITION BY a.file_id, a.seg_idx ORDER BY b.value DESC, b.seg_idx) AS k
 FROM a JOIN b ON a.file_id = b.file_id AND b.e > a.s - 5000000 AND b.s < a.s + 120000000000) SELECT file_id, seg_idx, ref_idx, score FROM c WHERE k = 1"""
)
def bounded_candidates_top1(spark, sf):
    search = segments(spark, sf, "view").select("file_id", "seg_idx", (F.col("s") - 5_000_000).alias("s"), (F.col("s") + 120_000_000_000).alias("e"))
    cand = references(spark, sf, "purchase").select("file_id", "ref_idx", "rs", "re", F.col("value").alias("score"))
    return intervals.best_candidate(search, cand, BUCKET)


# ---------------------------------------------------------- folds and windows


@query(
    f"""WITH RECURSIVE {_seg("g")}, n AS (SELECT file_id, max(seg_idx) AS last FROM g GROUP BY ALL),
 f AS (SELECT file_id, seg_idx, 0::BIGINT AS chunk_idx, s AS cs, e AS ce FROM g WHERE seg_idx = 0
  UNION ALL SELECT g.file_id, g.seg_idx, CASE WHEN g.e - f.cs > 86400000000 AND f.ce - f.cs > 0 THEN f.chunk_idx + 1 ELSE f.chunk_idx END,
   CASE WHEN g.e - f.cs > 86400000000 AND f.ce - f.cs > 0 THEN g.s ELSE f.cs END, g.e FROM f JOIN g ON g.file_id = f.file_id AND g.seg_idx = f.seg_idx + 1)
 SELECT file_id, chunk_idx, min(cs) AS s, arg_max(ce, seg_idx) AS e, count(*) AS n FROM f GROUP BY ALL"""
)
def caption_chunk_merge(spark, sf):
    return folds.merge_chunks(segments(spark, sf), 86_400_000_000).select("file_id", "chunk_idx", "s", "e", "n")


_LINES = "l AS (SELECT conv_id AS file_id, turn AS seg_idx, turn * 2000 AS s, turn * 2000 + least(1990, 1400 + length(text)) AS e, trim(text, E' \\n') AS text, role FROM conversations)"


def lines(spark, sf):
    c = table(spark, sf, "conversations")
    e = F.col("turn") * 2000 + F.least(F.lit(1990), F.lit(1400) + F.length("text"))
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), (F.col("turn") * 2000).alias("s"), e.cast("bigint").alias("e"), F.expr("trim(BOTH ' \n' FROM text)").alias("text"), "role")


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seg_idx) AS i FROM l)"


@query(
    f"""WITH RECURSIVE {_LINES}, {_NUMBERED}, f AS (SELECT file_id, i, 0::BIGINT AS caption_idx, s AS cs, e AS ce, text AS t, 1::BIGINT AS k FROM n WHERE i = 1
 UNION ALL SELECT n.file_id, n.i, CASE WHEN m THEN f.caption_idx ELSE f.caption_idx + 1 END, CASE WHEN m THEN f.cs ELSE n.s END, n.e, CASE WHEN m THEN f.t || n.text ELSE n.text END, CASE WHEN m THEN f.k + 1 ELSE 1 END
 FROM (SELECT f.*, n.s - f.ce <= 400 AND (f.t = '' OR n.text = '' OR (right(f.t, 1) NOT IN ('?', '!') AND length(f.t) + length(n.text) <= 900)) AS m FROM f JOIN n ON n.file_id = f.file_id AND n.i = f.i + 1) f JOIN n ON n.file_id = f.file_id AND n.i = f.i + 1)
 SELECT file_id, caption_idx, min(cs) AS s, arg_max(ce, i) AS e, arg_max(t, i) AS text, max(k) AS n FROM f GROUP BY ALL"""
)
def caption_text_merge(spark, sf):
    return folds.merge_captions(lines(spark, sf), 400, 900, split_chars="?!", merge_chars="")


_Y = "y AS (SELECT user_id AS file_id, epoch_us(ts) AS t, event_id AS k, value / 100 AS y FROM events)"
_STATE = f"""{_Y}, st AS (SELECT *, coalesce(last_value(CASE WHEN y > 0.5 THEN 1 WHEN y < 0.363 THEN 0 END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS active,
 lead(t) OVER (PARTITION BY file_id ORDER BY t, k) AS nt FROM y)"""


def frames(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("k"), (F.col("value") / 100).alias("y"))


@query(f"WITH {_STATE} SELECT file_id, k, CAST(active AS INTEGER) AS active FROM st")
def hysteresis_state(spark, sf):
    w = Window.partitionBy("file_id").orderBy("t", "k")
    return frames(spark, sf).select("file_id", "k", sequence.hysteresis(F.col("y"), w, 0.5, 0.363).alias("active"))


_REGIONS = f"""{_STATE}, c AS (SELECT *, CASE WHEN lag(active) OVER w IS NOT DISTINCT FROM active AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM st WINDOW w AS (PARTITION BY file_id ORDER BY t, k)),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY file_id ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS run FROM c),
 g AS (SELECT file_id, run, min(t) AS s, arg_max(coalesce(nt, t), t) AS e FROM r WHERE active = 1 GROUP BY ALL HAVING arg_max(coalesce(nt, t), t) - min(t) >= 1000000)"""


@query(f"WITH {_REGIONS} SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY run) - 1 AS INTEGER) AS region, s, e FROM g")
def active_regions(spark, sf):
    return sequence.active_regions(frames(spark, sf), 0.5, 0.363, 1_000_000)


@query(
    f"""WITH {_REGIONS}, p AS (SELECT file_id, s - 3600000000 AS s, e + 3600000000 AS e FROM g), q AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM p),
 z AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM q), m AS (SELECT file_id, n, min(s) AS s, max(e) AS e FROM z GROUP BY ALL)
 SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n) - 1 AS INTEGER) AS region, s, e FROM m"""
)
def filled_regions(spark, sf):
    return sequence.fill_gaps(sequence.active_regions(frames(spark, sf), 0.5, 0.363, 1_000_000), 7_200_000_000, 3_600_000_000, 3_600_000_000)


def _regions(onset: float, offset: float, longest: float) -> str:
    """Regions with a longest duration, of frames n(file_id, i from 1, t, y), by one step a frame: z(file_id, region, start, end)."""
    return f"""f AS (SELECT file_id, i, t, CASE WHEN y > {onset} THEN t END AS start, [{{'y': y, 't': t}}] AS held, CAST(NULL AS DOUBLE) AS was, CAST(NULL AS DOUBLE) AS done FROM n WHERE i = 1
  UNION ALL SELECT file_id, i, t, CASE WHEN start IS NULL THEN CASE WHEN y > {onset} THEN t END WHEN long THEN held[cut].t WHEN y < {offset} THEN NULL ELSE start END,
   CASE WHEN start IS NULL THEN held WHEN long THEN list_append(held[cut + 1 :], {{'y': y, 't': t}}) WHEN y < {offset} THEN [{{'y': y, 't': t}}] ELSE list_append(held, {{'y': y, 't': t}}) END,
   CASE WHEN long OR y < {offset} THEN start END, CASE WHEN start IS NULL THEN NULL WHEN long THEN held[cut].t WHEN y < {offset} THEN t END
   FROM (SELECT *, coalesce(t - start > {longest}, FALSE) AS long, half + list_position(late, list_min(late)) AS cut FROM (SELECT n.file_id, n.i, n.t, n.y, start, held, len(held) // 2 AS half,
    list_transform(held[len(held) // 2 + 1 :], lambda x: x.y) AS late FROM f JOIN n ON n.file_id = f.file_id AND n.i = f.i + 1))),
 x AS (SELECT file_id, i, 0 AS k, was AS start, done AS "end" FROM f WHERE was IS NOT NULL UNION ALL SELECT file_id, i, 1, start, t FROM f WHERE start IS NOT NULL AND i = (SELECT max(i) FROM n WHERE n.file_id = f.file_id)),
 z AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i, k) - 1 AS region, start, "end" FROM x WHERE "end" - start > 0.000001)"""


@query(f"WITH RECURSIVE {_Y}, n AS (SELECT file_id, t / 1e6 AS t, y, row_number() OVER (PARTITION BY file_id ORDER BY t, y) AS i FROM y), {_regions(0.3, 0.1, 172_800.0)} SELECT * FROM z")
def min_cut_regions(spark, sf):
    f = frames(spark, sf).select("file_id", (F.col("t") / 1e6).alias("t"), "y")
    return folds.speech_regions(f, 0.3, 0.1, 172_800.0)


_BLOCKS = "w AS (SELECT label AS file_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, embedding FROM embeddings)"


def signal_blocks(spark, sf):
    """The vectors of a label, one after the other, are a file's signal in blocks of 64 samples."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf, "embeddings").select(F.col("label").alias("file_id"), (F.row_number().over(w) - 1).cast("bigint").alias("k"), "embedding")


@query(
    f"""WITH RECURSIVE {_BLOCKS}, e AS (SELECT file_id, k * 32 + generate_subscripts(embedding, 1) - 1 AS frame, abs(CAST(unnest(embedding) AS DOUBLE)) * 4 AS v FROM w),
 n AS (SELECT file_id, (CAST(frame AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(0.02 AS DOUBLE) AS t, avg(v) AS y, row_number() OVER (PARTITION BY file_id ORDER BY frame) AS i FROM e GROUP BY file_id, frame), {_regions(0.5, 0.2, 2.0)},
 c AS (SELECT file_id, region, 0::BIGINT AS seg_idx, start AS cs, "end" AS ce, 1::BIGINT AS n FROM z WHERE region = 0
  UNION ALL SELECT z.file_id, z.region, CASE WHEN z."end" - cs > 2.0 AND ce > cs THEN seg_idx + 1 ELSE seg_idx END, CASE WHEN z."end" - cs > 2.0 AND ce > cs THEN z.start ELSE cs END, z."end", CASE WHEN z."end" - cs > 2.0 AND ce > cs THEN 1 ELSE n + 1 END
   FROM c JOIN z ON z.file_id = c.file_id AND z.region = c.region + 1),
 g AS (SELECT file_id, seg_idx, min(cs) AS start, arg_max(ce, region) AS "end", max(n) AS n FROM c GROUP BY ALL),
 a AS (SELECT file_id, flatten(list(embedding ORDER BY k)) AS x FROM w GROUP BY file_id)
 SELECT file_id, seg_idx, start, "end", len(x[CAST(trunc(start * 100) AS BIGINT) + 1 : CAST(trunc("end" * 100) AS BIGINT)]) AS n_samples, coalesce(round(list_sum(list_transform(x[CAST(trunc(start * 100) AS BIGINT) + 1 : CAST(trunc("end" * 100) AS BIGINT)], lambda v: CAST(v AS DOUBLE))), 5), 0.0) AS total FROM g JOIN a USING (file_id)"""
)
def voice_segments(spark, sf):
    """Overlapping windows of scores to segments with their audio."""
    rows = signal_blocks(spark, sf)
    scored = rows.select("file_id", "k", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4).alias("scores"))
    found = speech.detect(scored, 32, 0.02, 0.5, 0.2, 2.0)
    cut = speech.with_audio(found, rows.select("file_id", F.col("k").alias("block"), blocks.pack(F.col("embedding")).alias("samples")), 100, 64)
    total = F.aggregate(blocks.unpack("audio"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cut.select("file_id", "seg_idx", "start", "end", F.expr("cast(length(audio) div 4 as bigint)").alias("n_samples"), F.round(total, 5).alias("total"))


@query(f"WITH {_BLOCKS} SELECT file_id, k // 20 AS seg_idx, k % 20 * 64 + generate_subscripts(embedding, 1) - 1 AS pos, round(CAST(unnest(embedding) AS DOUBLE), 5) AS value FROM w")
def isolated_audio(spark, sf):
    """Isolation by a model that leaves audio as it is: what is dealt out, weighted and gathered is the signal again."""
    rows = signal_blocks(spark, sf).withColumn("seg_idx", F.expr("k div 20"))
    whole = rows.groupBy("file_id", "seg_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "embedding"))), lambda x: x["embedding"])).alias("x"))
    segs = whole.select("file_id", "seg_idx", F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), blocks.pack(F.col("x")).alias("audio"))
    done = speech.isolate(segs, lambda part: part, size=100)
    return done.select("file_id", "seg_idx", F.posexplode(blocks.unpack("audio")).alias("p", "v")).select("file_id", "seg_idx", F.col("p").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("value"))


@query(f"WITH {_BLOCKS} SELECT file_id || '.wav' AS file_id, pos // 100 AS block, pos % 100 AS i, round_even(least(greatest(v, CAST(-1 AS DOUBLE)), CAST(32767 AS DOUBLE) / 32768) * 32768, 0) / 32768 + CAST(0 AS DOUBLE) AS value FROM (SELECT file_id, k * 64 + generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM w)")
def decoded_audio(spark, sf):
    """Each label's signal as a WAV file, decoded to blocks of 100 samples."""
    whole = signal_blocks(spark, sf).groupBy("file_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "embedding"))), lambda x: x["embedding"])).alias("x"))

    @F.pandas_udf("binary")
    def wav(x: pd.Series) -> pd.Series:
        return x.map(media.encode_wav)

    stored = whole.select(F.concat(F.lit("/sound/"), F.col("file_id"), F.lit(".wav")).alias("path"), wav("x").alias("content"))
    done = media.decode_blocks(stored, size=100)
    return done.select("file_id", "block", F.posexplode(blocks.unpack("samples")).alias("i", "v")).select("file_id", "block", F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("value"))


@query(
    f"""WITH {_BLOCKS}, s AS (SELECT file_id, k * 64 + generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM w),
 t AS (SELECT file_id, max(pos) + 1 AS total FROM s GROUP BY file_id), f AS (SELECT file_id, total, unnest(range(total // 8)) AS frame FROM t),
 q AS (SELECT file_id, frame, i, CASE WHEN p < 0 THEN -p WHEN p >= total THEN 2 * total - 2 - p ELSE p END AS pos FROM (SELECT *, frame * 8 - 8 + i AS p FROM f, range(16) r(i))),
 x AS (SELECT file_id, frame, i, v * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS v FROM q JOIN s USING (file_id, pos)),
 d AS (SELECT file_id, frame, b, pow(sum(v * cos(2 * pi() * i * b / 16)), 2) + pow(sum(v * sin(2 * pi() * i * b / 16)), 2) AS p FROM x, range(9) r(b) GROUP BY ALL),
 m AS (SELECT j, (15 + ln(CAST(8 AS DOUBLE)) / (ln(CAST(6.4 AS DOUBLE)) / 27)) * j / 5 AS m FROM range(6) r(j)),
 h AS (SELECT j, CASE WHEN m >= 15 THEN 1000 * exp(ln(CAST(6.4 AS DOUBLE)) / 27 * (m - 15)) ELSE m * 200 / 3 END AS hz FROM m),
 g AS (SELECT l.j AS mel, b, greatest(0, least((b * 1000 - l.hz) / (c.hz - l.hz), (u.hz - b * 1000) / (u.hz - c.hz))) * 2 / (u.hz - l.hz) AS g FROM h l JOIN h c ON c.j = l.j + 1 JOIN h u ON u.j = l.j + 2, range(9) r(b)),
 y AS (SELECT file_id, frame, mel, log10(greatest(sum(p * g), CAST(1e-10 AS DOUBLE))) AS y FROM d JOIN g USING (b) GROUP BY ALL)
 SELECT file_id, frame, mel, round(CAST(CAST((greatest(y, max(y) OVER (PARTITION BY file_id) - 8) + 4) / 4 AS FLOAT) AS DOUBLE), 5) + CAST(0 AS DOUBLE) AS value FROM y"""
)
def mel_frames(spark, sf):
    """Log-mel values of each label's signal: windows of 16 samples every 8, stretches of 50 frames over blocks of 64 samples."""
    rows = signal_blocks(spark, sf).select("file_id", F.col("k").alias("block"), blocks.pack(F.col("embedding")).alias("samples"))
    done = spectra.log_mel(rows, n_fft=16, hop=8, mels=4, frames=50, size=64)
    each = done.select("file_id", "first", F.posexplode("values").alias("i", "v")).select("file_id", (F.col("first") + F.col("i")).alias("frame"), F.posexplode("v").alias("mel", "x"))
    return each.select("file_id", "frame", F.col("mel").cast("bigint").alias("mel"), F.round(F.col("x").cast("double"), 5).alias("value"))


_ISLES = f"""{_seg("g")}, c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY file_id ORDER BY seg_idx) = label THEN 0 ELSE 1 END AS ch FROM g),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY file_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS run FROM c), m AS (SELECT file_id, CAST(run AS BIGINT) AS run, min(label) AS token, min(seg_idx) AS first_frame, max(seg_idx) + 1 AS end_frame, avg(value) AS score, count(*) AS n FROM r GROUP BY ALL)"""


def paths(spark, sf):
    return segments(spark, sf).select("file_id", F.col("seg_idx").alias("frame"), F.col("label").alias("token"), F.col("value").alias("score"))


@query(f"WITH {_ISLES} SELECT file_id, run, token, first_frame, end_frame, round(score, 6) AS score, n FROM m")
def run_length_collapse(spark, sf):
    return sequence.merge_repeats(paths(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_ISLES}, w AS (SELECT *, CAST(sum(CASE WHEN token = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word FROM m)
 SELECT file_id, word, string_agg(token, '' ORDER BY run) AS text, min(first_frame) AS first_frame, max(end_frame) AS end_frame, round(sum(score * (end_frame - first_frame)) / sum(end_frame - first_frame), 6) AS score FROM w WHERE token <> 'signup' GROUP BY ALL"""
)
def weighted_mean_runs(spark, sf):
    return sequence.merge_words(sequence.merge_repeats(paths(spark, sf)), "signup").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_seg("g")}, r AS (SELECT *, CASE WHEN label IN ('view', 'click') THEN s + 100000000 ELSE e END AS x, lead(s) OVER (PARTITION BY file_id ORDER BY seg_idx) - 40000 AS lim FROM g)
 SELECT file_id, seg_idx, s, CASE WHEN x > lim THEN lim ELSE x END AS e FROM r"""
)
def overlap_trim(spark, sf):
    rows = segments(spark, sf).withColumn("release_from", F.when(F.col("label").isin("view", "click"), F.col("s")))
    return sequence.release_and_trim(rows, 100_000_000, 40_000).select("file_id", "seg_idx", "s", "e")


@query(
    f"""WITH {_LINES}, c AS (SELECT file_id, seg_idx, text, coalesce(lag(text) OVER w, '') AS p, coalesce(lead(text) OVER w, '') AS n FROM l WINDOW w AS (PARTITION BY file_id ORDER BY seg_idx))
 SELECT file_id, seg_idx, md5(concat_ws(E'\\n', CASE WHEN p <> '' THEN 'Before: ' || p END, 'Line: ' || text, CASE WHEN n <> '' THEN 'After: ' || n END)) AS prompt FROM c"""
)
def context_window(spark, sf):
    rows = sequence.context(lines(spark, sf).select("file_id", "seg_idx", "text"))
    return rows.select("file_id", "seg_idx", F.md5(text.prompt(F.col("prev_text"), F.col("text"), F.lit(None).cast("string"), F.col("next_text"))).alias("prompt"))


_GAPS = f"""{_seg("g")}, v AS (SELECT file_id, seg_idx, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM g), x AS (SELECT *, seg_idx AS i, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN seg_idx END IGNORE NULLS) OVER b AS pi,
 first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN seg_idx END IGNORE NULLS) OVER a AS ni FROM v
 WINDOW b AS (PARTITION BY file_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY file_id ORDER BY seg_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(
    f"""WITH {_GAPS} SELECT file_id, seg_idx, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN i - pi <= ni - i THEN pv ELSE nv END AS nearest,
 round(CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN i = pi THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS linear FROM x"""
)
def fill_nearest_gap(spark, sf):
    rows = segments(spark, sf).select("file_id", "seg_idx", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    out = sequence.interpolate(sequence.interpolate(rows, "v", "nearest", "nearest"), "v", "linear", "linear")
    return out.select("file_id", "seg_idx", "nearest", F.round("linear", 6).alias("linear"))


@query(f"WITH {_seg('g')} SELECT file_id, seg_idx, round(sum(ln(1 + value)) OVER (PARTITION BY file_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING), 6) AS blank_sum FROM g")
def running_blank_sum(spark, sf):
    rows = segments(spark, sf).select("file_id", "seg_idx", F.log1p("value").alias("v"))
    return sequence.running_sum(rows, "v", "x").select("file_id", "seg_idx", F.round("x", 6).alias("blank_sum"))


@query(f"WITH {_seg('g')} SELECT file_id, seg_idx, coalesce(last_value(CASE WHEN label = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING), 0) AS shift FROM g")
def rolling_offset(spark, sf):
    rows = segments(spark, sf).withColumn("v", F.when(F.col("label") == "purchase", F.col("value")))
    return sequence.carried(rows, "v", "x").select("file_id", "seg_idx", F.coalesce("x", F.lit(0.0)).alias("shift"))


@query(
    """WITH x AS (SELECT label AS file_id, vec_id AS seg_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
 SELECT file_id, seg_idx, round(list_cosine_similarity(lag(v) OVER (PARTITION BY file_id ORDER BY seg_idx), v), 6) AS similarity FROM x"""
)
def cosine_adjacent(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("seg_idx"), "embedding")
    return sequence.adjacent_cosine(rows, "embedding").select("file_id", "seg_idx", F.round("similarity", 6).alias("similarity"))


# ------------------------------------------------- aggregations and positions


@query(
    """WITH h AS (SELECT user_id AS file_id, epoch_us(date_trunc('hour', ts)) AS s, event_type AS text, event_id AS i FROM events)
 SELECT file_id, s, s + 3600000000 AS e, string_agg(text, ' ' ORDER BY i) AS text, count(*) AS n, min(i) AS first_idx FROM h GROUP BY file_id, s"""
)
def group_concat_same_span(spark, sf):
    s = F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seg_idx"), s.alias("s"), (s + 3_600_000_000).alias("e"), F.col("event_type").alias("text"))
    return sequence.concat_same_span(rows, " ")


@query(
    """WITH w AS (SELECT doc_id AS file_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents),
 g AS (SELECT *, CAST(coalesce(sum(CASE WHEN ch IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM w)
 SELECT file_id, sentence, min(pos * 80) FILTER (ch <> ' ') AS s, max(pos * 80 + 80) FILTER (ch <> ' ') AS e, CASE WHEN arg_max(ch, pos) IN ('.', '!', '?') THEN max(pos) * 80 END AS release_from, length(string_agg(ch, '' ORDER BY pos)) AS n FROM g GROUP BY file_id, sentence"""
)
def sentence_extent(spark, sf):
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(text.sentence_extents(F.col("text"))).alias("k", "x"))
    ms = lambda c: F.col(c).cast("bigint") * 80
    return found.select("file_id", F.col("k").cast("bigint").alias("sentence"), ms("x.first").alias("s"), ms("x.end").alias("e"), ms("x.mark").alias("release_from"), F.col("x.n").cast("bigint").alias("n"))


_TIMED = r"""t AS (SELECT conv_id AS file_id, turn AS seg_idx, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM conversations),
 u AS (SELECT *, ch <> ' ' AS solid, CASE WHEN lower(ch) IN ('a', 'e', 'o', 't', 'n') THEN pos * 80 END AS ms,
  coalesce(sum(CASE WHEN ch IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, seg_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
  sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, seg_idx ORDER BY pos) AS w FROM t)"""


def timed_chars(spark, sf):
    """Lines with characters of which some letters have times: 80 ms for each place."""
    at = lambda c, i, plus: F.when(F.lower(c).isin("a", "e", "o", "t", "n"), (i * 80 + plus) / 1000)
    one = lambda c, i: F.struct(c.alias("char"), at(c, i, 0).alias("start"), at(c, i, 80).alias("end"), at(c, i % 10, 100).alias("score"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), F.transform(F.filter(F.split("text", ""), lambda c: c != ""), one).alias("chars"))


@query(
    rf"""WITH {_TIMED}, g AS (SELECT file_id, seg_idx, part, w, regexp_replace(string_agg(ch, '' ORDER BY pos), '^\s+|\s+$', '', 'g') AS word, CAST(min(ms) FILTER (solid) AS BIGINT) AS s, CAST(max(ms) FILTER (solid) + 80 AS BIGINT) AS e,
  round(avg((pos % 10 * 80 + 100) / 1000.0) FILTER (ms IS NOT NULL), 3) AS score, min(pos) AS p FROM u GROUP BY ALL)
 SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seg_idx, p) - 1 AS word_idx, word, s, e, score FROM g WHERE word <> ''"""
)
def word_extents(spark, sf):
    rows = timed_chars(spark, sf).select("file_id", "seg_idx", F.flatten(F.transform(words.sentences(F.col("chars"), True, ".!?"), lambda x: x["words"])).alias("words"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return align.flat_words(rows).select("file_id", "word_idx", "word", ms("start").alias("s"), ms("end").alias("e"), "score")


@query(
    rf"""WITH {_TIMED}, g AS (SELECT file_id, seg_idx, part, string_agg(ch, '' ORDER BY pos) AS text, CAST(min(ms) AS BIGINT) AS s, CAST(max(ms) FILTER (solid) + 80 AS BIGINT) AS e, count(DISTINCT CASE WHEN solid THEN w END) AS n FROM u GROUP BY ALL HAVING count(*) FILTER (solid) > 0),
 i AS (SELECT *, row_number() OVER (PARTITION BY file_id, seg_idx ORDER BY part) AS i FROM g),
 k AS (SELECT *, last_value(i IGNORE NULLS) OVER b AS pi, last_value(ps IGNORE NULLS) OVER b AS pv, last_value(pe IGNORE NULLS) OVER b AS pw, first_value(i2 IGNORE NULLS) OVER a AS ni, first_value(ps IGNORE NULLS) OVER a AS nv, first_value(pe IGNORE NULLS) OVER a AS nw
  FROM (SELECT file_id, seg_idx, i AS place, CASE WHEN s IS NOT NULL THEN i END AS i, CASE WHEN s IS NOT NULL THEN i END AS i2, s AS ps, e AS pe, text, n FROM i)
  WINDOW b AS (PARTITION BY file_id, seg_idx ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY file_id, seg_idx ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 f AS (SELECT file_id, seg_idx, place, text, n, CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL OR place - pi <= ni - place THEN pv ELSE nv END AS s, CASE WHEN pi IS NULL THEN nw WHEN ni IS NULL OR place - pi <= ni - place THEN pw ELSE nw END AS e FROM k)
 SELECT file_id, seg_idx, s, e, md5(string_agg(text, ' ' ORDER BY place)) AS text, CAST(sum(n) AS BIGINT) AS n_words FROM f WHERE s IS NOT NULL GROUP BY file_id, seg_idx, s, e"""
)
def timed_sentences(spark, sf):
    """Sentences with times from their characters; those without any get their neighbour's and join it."""
    rows = timed_chars(spark, sf).select("file_id", "seg_idx", F.inline(words.timed(words.sentences(F.col("chars"), True, ".!?"), "nearest", True)))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return rows.select("file_id", "seg_idx", ms("start").alias("s"), ms("end").alias("e"), F.md5("text").alias("text"), F.size("words").cast("bigint").alias("n_words"))


@query("WITH u AS (SELECT conv_id AS file_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id AS file_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') SELECT u.file_id, u.turn AS seg_idx, length(u.text) AS primary_length, length(a.text) AS other_length FROM u LEFT JOIN a USING (file_id, turn)")
def positional_zip(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), F.length("text").cast("bigint").alias("primary_length"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("file_id"), (F.col("turn") - 1).alias("seg_idx"), F.length("text").cast("bigint").alias("other_length"))
    return u.join(a, ["file_id", "seg_idx"], "left")


@query("SELECT doc_id, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' ELSE 'computed' END AS origin FROM documents")
def cache_split(spark, sf):
    hit, miss = stages.split_cached(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id")
    return hit.withColumn("origin", F.lit("cached")).unionByName(miss.withColumn("origin", F.lit("computed")))


@query(
    """SELECT source AS file_id, coalesce(min(doc_id) FILTER (lang = 'es' OR lower(left(text, 40)) LIKE '%ción%'), min(doc_id) FILTER (lower(lang) IN ('fr', 'de') OR lower(left(text, 40)) LIKE '%the%'), 0) AS track FROM documents GROUP BY source"""
)
def track_choice(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("file_id")).agg(text.choose_track(F.col("lang"), F.left("text", F.lit(40)), F.col("doc_id"), "es", "ción", ("fr", "de"), ("the",)).alias("track"))


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) // 8 AS batch FROM documents")
def batch_plan(spark, sf):
    jobs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), "n_chars")
    return stages.batch_plan(jobs, "n_chars", 8, "source").select("source", F.col("id").alias("doc_id"), "batch")


@query(
    """WITH x AS (SELECT label AS file_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 32 AS start, embedding FROM embeddings),
 s AS (SELECT file_id, start + i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x, least(1.0, i / 5.0, (63 - i) / 5.0) AS w FROM x, range(64) r(i))
 SELECT file_id, pos, round(CASE WHEN sum(w) > 0 THEN sum(x * w) / sum(w) ELSE 0 END, 5) AS value FROM s GROUP BY ALL"""
)
def overlap_add(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    chunks = table(spark, sf, "embeddings").select(F.col("label").alias("file_id"), ((F.row_number().over(w) - 1).cast("bigint") * 32).alias("start"), F.col("embedding").alias("values"))
    return audio.overlap_add(audio.chunk_samples(chunks, 64, 6)).withColumn("value", F.round("value", 5))


@query(f"WITH {_LINES} SELECT file_id, md5(string_agg(CAST(seg_idx + 1 AS VARCHAR) || '. ' || text, E'\\n' ORDER BY seg_idx)) AS prompt, count(*) AS n FROM l GROUP BY file_id")
def document_prompt(spark, sf):
    rows = lines(spark, sf).select("file_id", "seg_idx", F.concat((F.col("seg_idx") + 1).cast("string"), F.lit(". "), F.col("text")).alias("x"))
    return rows.groupBy("file_id").agg(F.md5(F.expr("listagg(x, '\n') WITHIN GROUP (ORDER BY seg_idx)")).alias("prompt"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ formatting


_MS = "m AS (SELECT event_id, CAST(round_even(value * 1000 * 500, 0) AS BIGINT) AS ms FROM events)"


@query(f"WITH {_MS} SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS stamp FROM m")
def timestamp_srt(spark, sf):
    return table(spark, sf, "events").select("event_id", formatting.timestamp(F.bround(F.col("value") * 1000 * 500).cast("bigint"), True, ",").alias("stamp"))


@query("WITH m AS (SELECT event_id, CAST(round_even(value * 1000 * 50, 0) AS BIGINT) AS ms FROM events) SELECT event_id, CASE WHEN ms >= 3600000 THEN lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS stamp FROM m")
def timestamp_vtt(spark, sf):
    return table(spark, sf, "events").select("event_id", formatting.timestamp(F.bround(F.col("value") * 1000 * 50).cast("bigint")).alias("stamp"))


@query("SELECT event_id, CAST(CAST(round_even(value * 1000.5, 0) AS BIGINT) AS VARCHAR) || chr(9) || CAST(CAST(round_even(value * 2000.5, 0) AS BIGINT) AS VARCHAR) || chr(9) || event_type AS line FROM events")
def tsv_ms(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", formatting.tsv_line(F.bround(v * 1000.5).cast("bigint"), F.bround(v * 2000.5).cast("bigint"), F.col("event_type")).alias("line"))


def _stamp(ms: str, hours: bool, mark: str) -> str:
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return (f"{two(f'{ms} // 3600000')} || ':' || " if hours else "") + f"{two(f'{ms} // 60000 % 60')} || ':' || {two(f'{ms} // 1000 % 60')} || '{mark}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


_SAFE = "'[' || role || ']: ' || replace(text, '-->', '->')"


@query(f"WITH {_LINES} SELECT file_id, seg_idx, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seg_idx) AS VARCHAR) || chr(10) || {_stamp('s', True, ',')} || ' --> ' || {_stamp('e', True, ',')} || chr(10) || {_SAFE} || chr(10) AS block FROM l")
def srt_blocks(spark, sf):
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_idx"))
    return lines(spark, sf).select("file_id", "seg_idx", formatting.srt_block(n, F.col("s"), F.col("e"), formatting.caption_text(F.col("text"), F.col("role"))).alias("block"))


@query(f"WITH {_LINES} SELECT file_id, seg_idx, {_stamp('s', False, '.')} || ' --> ' || {_stamp('e', False, '.')} || chr(10) || {_SAFE} || chr(10) AS cue FROM l")
def vtt_cues(spark, sf):
    return lines(spark, sf).select("file_id", "seg_idx", formatting.vtt_cue(F.col("s"), F.col("e"), formatting.caption_text(F.col("text"), F.col("role"))).alias("cue"))


@query(f"WITH {_LINES} SELECT file_id, seg_idx, CAST(s AS VARCHAR) || chr(9) || CAST(e AS VARCHAR) || chr(9) || '[[' || role || ']]' || replace(text, chr(9), ' ') AS line FROM l")
def aud_labels(spark, sf):
    return lines(spark, sf).select("file_id", "seg_idx", formatting.aud_line(F.col("s"), F.col("e"), F.col("text"), F.col("role")).alias("line"))


@query(f"WITH {_LINES} SELECT file_id, CAST(to_json({{'segments': list({{'seg_idx': seg_idx, 's': s, 'e': e, 'text': text}} ORDER BY seg_idx, s, e, text), 'language': 'yue'}}) AS VARCHAR) AS result FROM l GROUP BY file_id")
def json_result(spark, sf):
    rows = lines(spark, sf).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "s", "e", "text"))).alias("segments"))
    return rows.select("file_id", F.to_json(F.struct("segments", F.lit("yue").alias("language"))).alias("result"))


@query("WITH a AS (SELECT event_id, value, CAST(floor(value * 16000) AS BIGINT) AS a, CAST(floor(value * 1.5 * 16000) AS BIGINT) AS b FROM events) SELECT event_id, a AS first_sample, b - a AS n_samples, greatest(0, value - 20) AS shifted, abs((b - a) / 16000.0 - value * 0.5) > 0.00003 AS differs FROM a")
def audio_slices(spark, sf):
    v = F.col("value")
    a, n = formatting.sample_range(v, v * 1.5)
    rows = table(spark, sf, "events").select("event_id", "value", a.cast("bigint").alias("first_sample"), n.cast("bigint").alias("n_samples"))
    return rows.select("event_id", "first_sample", "n_samples", formatting.shifted(F.col("value"), F.lit(-20)).alias("shifted"), (F.abs(F.col("n_samples") / F.lit(16000.0) - F.col("value") * 0.5) > 0.00003).alias("differs"))


# ------------------------------------------------------------------------ text


def caption_parts(column: str):
    """(part, line): the caption lines of a text, cut after sentence marks and line ends; together they are the whole text."""
    return F.posexplode(text.split_segments(F.col(column), ".!?\n")).alias("part", "line")


BASIC = (rules.Rule("[\r\n\t]+", " "), rules.Rule("[*#$%&]{2,}", ""), rules.Rule("([.,!?])[.,!?]+", r"\1"), rules.Rule(" {2,}", " "), rules.Rule(r"(\w+)ing\b", r"\1in'"))


_WORD = r"\p{L}\p{M}\p{Nd}_\p{Pc}"


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '[*#$%&]{{2,}}', '', 'g'), '([.,!?])[.,!?]+', '\1', 'g'), ' {{2,}}', ' ', 'g'), '([{_WORD}]+)ing($|[^{_WORD}])', '\1in''\2', 'g')) AS cleaned FROM documents")
def rules_basic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(rules.apply_rules(F.col("text"), BASIC)).alias("cleaned"))


@query()
def rules_full(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", rules.clean(F.col("text"), rules.load_steps(None, steps.builtin_steps(18))).alias("cleaned"))


VARIANTS = {"é": "e", "è": "e", "ü": "u", "ö": "o", "ä": "a", "ñ": "n", "ó": "o", "í": "i", "á": "a", "ç": "c"}


@query("SELECT doc_id, md5(translate(text, 'éèüöäñóíáç', 'eeuoanoiac')) AS plain FROM documents")
def char_variants(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.translate_chars(F.col("text"), VARIANTS)).alias("plain"))


@query(
    "SELECT doc_id, md5(CASE WHEN lang IN ('de', 'es') THEN translate(t, 'éèüöäñóíáç', 'eeuoanoiac') ELSE t END) AS plain"
    " FROM (SELECT doc_id, lang, CASE WHEN lang IN ('de', 'fr') THEN replace(replace(text, 'the', 'ze'), 'th', 'z') ELSE text END AS t FROM documents)"
)
def profile_text(spark, sf):
    """The language stands for the model: each has its own profile, others the default one."""
    known = {"de": {"convert_script": True, "variants": True}, "fr": {"convert_script": True}, "es": {"variants": True}, "en": {}}
    value = profiles.normalise_by(F.col("text"), F.concat(F.lit("models/"), F.col("lang")), known, steps.LongestMatch({"the": "ze", "th": "z"}), VARIANTS)
    return table(spark, sf, "documents").select("doc_id", F.md5(value).alias("plain"))


@query(
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'zh' THEN 'Chinese' ELSE upper(lang[1]) || lower(lang[2:]) END AS name,"
    " coalesce(lang NOT IN ('zh', 'ja', 'yue'), true) AS spaced FROM documents"
)
def language_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", languages.long_name(F.col("lang")).alias("name"), languages.spaced(F.col("lang")).alias("spaced"))


@query("SELECT doc_id, len(parts) AS n, parts[1] AS first_part FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents)")
def split_segments(spark, sf):
    parts = text.split_segments(F.col("text"), ".!?")
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("bigint").alias("n"), F.try_element_at(parts, F.lit(1)).alias("first_part"))


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+')) AS p FROM documents)
 SELECT doc_id, count(*) FILTER (p LIKE '%.' AND (regexp_matches(p, 'th|ou') OR len(list_filter(range(1, length(p) - 2), lambda i: substr(p, i + 1, 2) = 'on' AND substr(p, i, 1) = substr(p, i + 3, 1) AND NOT regexp_matches(substr(p, i, 1), '[\\n\\r\\x{85}\\x{2028}\\x{2029}]'))) > 0)) AS questions,
 count(*) AS n FROM p GROUP BY doc_id""")
def question_class(spark, sf):
    """Every part of every document."""
    part = F.explode(text.split_segments(F.col("text"), ".!?"))
    rows = table(spark, sf, "documents").select("doc_id", part.alias("part"))
    return rows.groupBy("doc_id").agg(F.count_if(text.is_question(F.col("part"), ".", ("th", "ou"), "on", ".")).alias("questions"), F.count(F.lit(1)).alias("n"))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS w, generate_subscripts(regexp_extract_all(text, '\p{L}+'), 1) - 1 AS word FROM documents) SELECT doc_id, word, regexp_extract(w, '[aeiou]+$') AS run, length(w) - length(regexp_extract(w, '[aeiou]+$')) AS at FROM w")
def trailing_particles(spark, sf):
    """Every word of every document."""
    w = table(spark, sf, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word", "w"))
    _, run, at = text.trailing_particles(F.col("w"), "aeiou")
    return w.select("doc_id", "word", run.alias("run"), at.cast("bigint").alias("at"))


@query()
def acronyms(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", F.md5(steps.python_step(steps.acronyms)(F.col("text"))).alias("text_md5"))


#: Letters that stand for digits, units and signs of dates.
NUMERAL_LETTERS = ("thenrdaiso", "十二年三百月一千零號")
_DIGITS = "零一二兩两三四五六七八九"


def _looked_up(char: str, signs: str, values: str) -> str:
    """SQL: the value of a character that is one of signs, else null."""
    return f"([{values}])[nullif(strpos('{signs}', {char}), 0)]"


_NUMERALS = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{NUMERAL_LETTERS[0]}', '{NUMERAL_LETTERS[1]}') AS t FROM documents),
 part AS (SELECT doc_id, i, p, rtrim(p, '月號') AS s, regexp_matches(p, '[月號]$') AS dated FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[{_DIGITS}十百千萬]+[月號]?|[^{_DIGITS}十百千萬]+')) AS p, generate_subscripts(regexp_extract_all(t, '[{_DIGITS}十百千萬]+[月號]?|[^{_DIGITS}十百千萬]+'), 1) AS i FROM d)),
 summed AS (SELECT *, CASE WHEN regexp_matches(s, '^[{_DIGITS}十]') AND regexp_full_match(s, '[{_DIGITS}十百千萬]+') AND NOT regexp_matches(s, '[{_DIGITS[1:]}][{_DIGITS}]') AND (NOT dated OR regexp_matches(s, '[{_DIGITS}]$'))
  THEN list_sum(list_transform(range(1, length(s) + 1), lambda k: coalesce({_looked_up("substr(s, k, 1)", _DIGITS, "0, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 9")}, 0) * coalesce({_looked_up("nullif(substr(s, k + 1, 1), '')", "十百千萬", "10, 100, 1000, 10000")}, 1))) + CASE WHEN s LIKE '十%' THEN 10 ELSE 0 END END AS n FROM part),
 fixed AS (SELECT doc_id, string_agg(CASE WHEN n IS NULL OR NOT dated AND (n <= 10 OR n >= 100000 OR n IN (100, 1000) OR n % 10000 = 0) THEN p ELSE CAST(n AS BIGINT) || CASE WHEN dated THEN right(p, 1) ELSE '' END END, '' ORDER BY i) AS t FROM summed GROUP BY doc_id)
 SELECT d.doc_id, md5(coalesce(array_to_string(list_transform(regexp_extract_all(fixed.t, '[零一二三四五六七八九]{{2,4}}年|[^零一二三四五六七八九]+|[零一二三四五六七八九]'), lambda x: CASE WHEN regexp_full_match(x, '[零一二三四五六七八九]{{2,4}}年') THEN translate(x, '零一二三四五六七八九', '0123456789') ELSE x END), ''), '')) AS text_md5
 FROM d LEFT JOIN fixed ON d.doc_id = fixed.doc_id"""


@query(_NUMERALS)
def numerals(spark, sf):
    """Every whole text, of which ten letters stand for digits, units and signs of dates."""
    small_batches(spark)
    value = F.translate(F.coalesce("text", F.lit("")), *NUMERAL_LETTERS)
    return table(spark, sf, "documents").select("doc_id", F.md5(steps.python_step(steps.numerals)(value)).alias("text_md5"))


@query()
def linebreak(spark, sf):
    """Every caption line of every turn."""
    small_batches(spark)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", caption_parts("text"))
    return rows.select("conv_id", "turn", "part", steps.python_step(lambda t: steps.break_line(t, 42))(F.trim("line")).alias("broken"))


@query("WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '[.!?]', chr(1), 'g'), chr(1)) AS parts FROM documents) SELECT doc_id, len(parts) AS n, list_sum(list_transform(parts, lambda x, i: i * length(x))) AS weighted FROM p")
def sentence_spans(spark, sf):
    spans = table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentence_spans(F.col("text"), ".!?")).alias("i", "x"))
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("i") + 1) * (F.col("x.b") - F.col("x.a"))).cast("bigint").alias("weighted"))


def shifted_lines(spark, sf):
    """Every caption line of every document, and the line without its first two characters."""
    d = table(spark, sf, "documents").select("doc_id", caption_parts("text"))
    return d.select("doc_id", "part", F.col("line").alias("a"), F.expr("substring(line, 3)").alias("b"))


@query()
def edit_distance(spark, sf):
    small_batches(spark)
    return shifted_lines(spark, sf).select("doc_id", "part", text.edit_distance(F.col("a"), F.col("b")).cast("bigint").alias("distance"))


@query()
def sanitize(spark, sf):
    small_batches(spark)
    r = F.when(F.col("part") % 4 == 0, F.col("b")).when(F.col("part") % 4 == 1, F.lit("")).when(F.col("part") % 4 == 2, F.concat("a", "a")).otherwise(F.replace(F.col("a"), F.lit("e"), F.lit("x")))
    return shifted_lines(spark, sf).select("doc_id", "part", text.accept_reference(F.col("a"), r, guarded="eo").alias("accepted"))


def substitution_lines(spark, sf):
    """Every word of every document, four to a line, with a response made of them."""
    w = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    fours = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 4).cast("int")), lambda k: F.slice("w", k * 4 + 1, F.lit(4)))
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", w.alias("w")).select("doc_id", F.posexplode(fours).alias("line", "w"))
    at = lambda k: F.coalesce(F.try_element_at("w", F.lit(k)), F.lit(""))
    resp = F.concat(at(1), F.lit("→"), at(2), F.lit("\nno arrow\n"), at(3), F.lit("→"), at(3), F.lit("\n"), at(4), F.lit("→ok"))
    return d.select("doc_id", "line", F.array_join("w", " ").alias("text"), resp.alias("resp"))


_FOURS = r"""t AS (SELECT doc_id, string_split(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT *, unnest(range((len(w) + 3) // 4)) AS line FROM t),
 l AS (SELECT doc_id, line, array_to_string(list_slice(w, line * 4 + 1, line * 4 + 4), ' ') AS text, coalesce(w[line * 4 + 1], '') AS w1, coalesce(w[line * 4 + 2], '') AS w2, coalesce(w[line * 4 + 4], '') AS w4 FROM k)"""


@query(
    f"""WITH {_FOURS}, p AS (SELECT doc_id, line, unnest([{{'x': w1, 'y': w2}}, {{'x': w4, 'y': 'ok'}}]) AS s FROM l)
 SELECT doc_id, line, s.x AS wrong, s.y AS "right" FROM p WHERE length(s.x) >= 2 AND s.x <> s.y"""
)
def parse_substitutions(spark, sf):
    rows = substitution_lines(spark, sf).select("doc_id", "line", F.explode(text.parse_substitutions(F.col("resp"))).alias("p"))
    return rows.select("doc_id", "line", F.col("p.wrong").alias("wrong"), F.col("p.right").alias("right"))


@query(
    f"""WITH {_FOURS}, a AS (SELECT doc_id, line, CASE WHEN length(w1) >= 2 AND w1 <> w2 THEN replace(text, w1, w2) ELSE text END AS t, w4 FROM l)
 SELECT doc_id, line, md5(CASE WHEN length(w4) >= 2 AND w4 <> 'ok' THEN replace(t, w4, 'ok') ELSE t END) AS fixed FROM a"""
)
def apply_substitutions(spark, sf):
    return substitution_lines(spark, sf).select("doc_id", "line", F.md5(text.apply_substitutions(F.col("text"), text.parse_substitutions(F.col("resp")))).alias("fixed"))


@query()
def char_error_rate(spark, sf):
    small_batches(spark)
    rows = shifted_lines(spark, sf).select((F.col("doc_id") % 10).alias("grp"), F.col("a").alias("hypothesis"), F.col("b").alias("reference"))
    return metrics.char_error_rate(rows, by=["grp"]).withColumn("cer", F.round("cer", 6))


@query("SELECT doc_id, length(text) = 0 OR text IN ('the', 'of') AS removable, left(text, 1) IN ('.', ',', '*', '#') AS punctuation FROM documents")
def removable_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_removable(F.col("text"), ("the", "of")).alias("removable"), F.left("text", F.lit(1)).isin(".", ",", "*", "#").alias("punctuation"))


@query(
    """WITH v AS (SELECT doc_id, regexp_replace(lower(text), '[^aeoth.]', '', 'g') AS c FROM documents)
 SELECT doc_id, array_to_string(string_split(translate(c, 'aeoth.', '123450'), ''), ' ') AS ids FROM v WHERE c <> ''"""
)
def vocabulary_tokens(spark, sf):
    vocab = {"a": 1, "e": 2, "o": 3, "t": 4, "h": 5}
    d = table(spark, sf, "documents").select("doc_id", text.in_vocabulary(F.col("text"), list(vocab), ".").alias("c")).where("size(c) > 0")
    return d.select("doc_id", F.array_join(F.transform(text.tokens(F.col("c.c"), vocab), lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT page_id, regexp_extract(url, '\\.([^./?#]+)(?:[?#].*)?$', 1) IN ('html', 'mp4') AS wanted FROM pages")
def media_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", media.is_media(F.regexp_replace("url", "[?#].*$", ""), ("html", "mp4")).alias("wanted"))


# --------------------------------------------------------- kernels and layers


@query()
def ctc_align(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("file_id"), F.col("vec_id").alias("seg_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("v", i * 4 + 1, F.lit(4)), lambda x: -F.abs(x)))
    return align.align(e.select("file_id", "seg_idx", F.lit(0.0).alias("start"), F.lit(1.6).alias("end"), F.lit("abca").alias("text"), rows.alias("emission")), {"a": 1, "b": 2, "c": 3})


@query(
    f"""WITH RECURSIVE {VIEW}, {BUY}, u AS (SELECT file_id, seg_idx, s / 1e6 - CAST(1704067200.0 AS DOUBLE) AS start, e / 1e6 - CAST(1704067200.0 AS DOUBLE) AS "end" FROM a),
 v AS (SELECT file_id, list({{'r': seg_idx, 's': s / 1e6 - CAST(1704067200.0 AS DOUBLE), 'e': e / 1e6 - CAST(1704067200.0 AS DOUBLE)}} ORDER BY seg_idx) AS cs FROM b GROUP BY file_id),
 f AS (SELECT DISTINCT file_id, CAST(-1 AS BIGINT) AS seg_idx, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS "end", CAST(0.0 AS DOUBLE) AS "offset", CAST(-1 AS BIGINT) AS matched FROM u
  UNION ALL SELECT file_id, seg_idx, CASE WHEN x IS NULL THEN greatest(0.0, us + o) ELSE x.s END, CASE WHEN x IS NULL THEN greatest(0.0, ue + o) ELSE x.e END, CASE WHEN x IS NULL THEN o ELSE (x.s + x.e) / 2 - (us + ue) / 2 END, coalesce(x.r, -1)
   FROM (SELECT *, list_sort(list_filter(list_transform(list_filter(coalesce(cs, []), lambda c: c.e > b AND c.s < b + 172800.0), lambda c: {{'d': abs((c.e - c.s) - (ue - us)), 'r': c.r, 's': c.s, 'e': c.e}}), lambda c: c.d < 40000.0))[1] AS x
    FROM (SELECT u.file_id, u.seg_idx, u.start AS us, u."end" AS ue, f."offset" AS o, cs, CASE WHEN u.seg_idx = 0 THEN CAST(0.0 AS DOUBLE) ELSE greatest(0.0, u.start + f."offset" - 3600.0) END AS b
     FROM f JOIN u ON u.file_id = f.file_id AND u.seg_idx = f.seg_idx + 1 LEFT JOIN v ON v.file_id = u.file_id)))
 SELECT file_id, seg_idx, start, "end", "offset", matched FROM f WHERE seg_idx >= 0"""
)
def retime_fold(spark, sf):
    a = segments(spark, sf, "view").select("file_id", "seg_idx", (F.col("s") / 1e6).alias("start"), (F.col("e") / 1e6).alias("end"))
    b = segments(spark, sf, "purchase").select("file_id", F.col("seg_idx").alias("ref_idx"), (F.col("s") / 1e6).alias("start"), (F.col("e") / 1e6).alias("end"))
    base = 1_704_067_200.0
    a, b = (x.withColumn("start", F.col("start") - base).withColumn("end", F.col("end") - base) for x in (a, b))
    fit = lambda line, c: -abs((c["end"] - c["start"]) - (line["end"] - line["start"]))
    return folds.retime(a, b, fit, 3600.0, 172_800.0, -40_000.0, alignable=lambda line: True)


@query()
def retime_emissions(spark, sf):
    """Lines searched for by their letters among stretches of 16 frames of 4 ids: the vectors of a label are its sound."""
    rows = signal_blocks(spark, sf)
    frames_ = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: -F.abs(x.cast("double")) * 8))
    heard = rows.select("file_id", F.col("k").alias("ref_idx"), (F.col("k") * 2.0).alias("start"), (F.col("k") * 2.0 + 1.5).alias("end"), frames_.alias("emission"))
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(F.array(*map(F.lit, "abc")), ((F.col("k") * 7 + i * i) % 3 + 1).cast("int"))), "")
    lines_ = rows.select("file_id", F.col("k").alias("seg_idx"), (F.col("k") * 2.0 + 11).alias("start"), (F.col("k") * 2.0 + 12.5).alias("end"), letters.alias("text"))
    return retime.retime(lines_, heard, {"a": 1, "b": 2, "c": 3}, window=20.0, threshold=0.3)


@query("SELECT n.n_name AS \"key\", coalesce(CASE WHEN n.n_nationkey % 3 = 0 THEN 'explicit' END, CASE WHEN n.n_nationkey % 2 = 0 THEN r.r_name END, 'default') AS value FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def layered_config(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    layer = lambda cond, value: n.where(cond).select(F.col("n_name").alias("key"), value.alias("value"))
    return config.layered(layer(F.lit(True), F.lit("default")), layer(F.col("n_nationkey") % 2 == 0, F.col("r_name")), layer(F.col("n_nationkey") % 3 == 0, F.lit("explicit")))


@query()
def reference_word_alignment(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), "text")
    return metrics.align_to_reference(rows.withColumn("text", F.regexp_replace("text", "e", "")), rows)


_PUNCT = "\"'()\\[\\]{}«»“”‘’,;:"
_WORDS = rf"""t AS (SELECT lang, doc_id, unnest(x) AS token, generate_subscripts(x, 1) AS i FROM (SELECT lang, doc_id, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS x FROM documents)),
 b AS (SELECT lang, doc_id, i, regexp_replace(token, '^[{_PUNCT.replace("'", "''")}]+|[{_PUNCT.replace("'", "''")}]+$', '', 'g') AS bare FROM t),
 w AS (SELECT lang, doc_id, i, lower(regexp_replace(bare, '[.!?…]+$', '')) AS w, bare LIKE '%.' AND NOT regexp_matches(bare, '(^|\.)\.+$') AS dot FROM b WHERE regexp_replace(bare, '[.!?…]+$', '') <> '')"""


@query(
    rf"""WITH {_WORDS}, c AS (SELECT lang, w, count(*) FILTER (dot) AS yes, count(*) FILTER (NOT dot) AS nay FROM w GROUP BY ALL), s AS (SELECT lang, sum(yes) AS dots, sum(yes + nay) AS n FROM c GROUP BY lang),
 x AS (SELECT lang, w, yes, nay, dots / n AS p, length(w) - length(replace(w, '.', '')) AS dots_in FROM c JOIN s USING (lang) WHERE yes > 0 AND regexp_matches(w, '^[^\d]*\p{{L}}[^\d]*$')),
 y AS (SELECT *, -2 * (yes * ln(p) + nay * ln(1 - p) - yes * ln(0.99) - nay * ln(0.01)) * exp(dots_in - length(w)) * (dots_in + 1) * pow(length(w) - dots_in, -nay) AS score FROM x)
 SELECT lang, w AS word, yes AS with_dot, nay AS without_dot, round(score, 4) AS score FROM y WHERE score >= 0.3"""
)
def learnt_abbreviations(spark, sf):
    d = table(spark, sf, "documents").select("lang", "text")
    return boundaries.abbreviations(d).withColumn("score", F.round("score", 4))


@query()
def sentence_offsets(spark, sf):
    """Sentences of all documents by what they teach of their languages."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return boundaries.sentence_spans(d, boundaries.learn(d)).select("doc_id", F.posexplode("spans").alias("sentence", "x")).select("doc_id", "sentence", "x.a", "x.b")


@query()
def subtitle_edit_rate(spark, sf):
    """Sentences of conversations as captions, the first two words of each swapped."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), "turn", caption_parts("text"))
    at = (F.col("turn") * 100_000 + F.col("part")).cast("bigint")
    ref = c.select("file_id", at.alias("seg_idx"), (at * 2.0).alias("start"), (at * 2.0 + 1.9).alias("end"), F.col("line").alias("text"))
    return edit_rate.subtitle_edit_rates(ref.withColumn("text", F.regexp_replace("text", r"^(\S+) (\S+)", "$2 $1")), ref)


# -------------------------------------------------------------------- flagship


@query(
    f"""WITH RECURSIVE {_seg("g")}, {BUY}, f AS (SELECT file_id, seg_idx, 0::BIGINT AS chunk_idx, s AS cs, e AS ce FROM g WHERE seg_idx = 0
  UNION ALL SELECT g.file_id, g.seg_idx, CASE WHEN g.e - f.cs > 86400000000 AND f.ce - f.cs > 0 THEN f.chunk_idx + 1 ELSE f.chunk_idx END,
   CASE WHEN g.e - f.cs > 86400000000 AND f.ce - f.cs > 0 THEN g.s ELSE f.cs END, g.e FROM f JOIN g ON g.file_id = f.file_id AND g.seg_idx = f.seg_idx + 1),
 a AS (SELECT file_id, chunk_idx AS seg_idx, min(cs) AS s, arg_max(ce, seg_idx) AS e FROM f GROUP BY file_id, chunk_idx),
 o AS (SELECT a.file_id, a.seg_idx, string_agg(b.rtext, '，' ORDER BY b.seg_idx) AS texts FROM a JOIN b ON {OVERLAP} GROUP BY ALL),
 c AS (SELECT a.file_id, a.seg_idx, b.rtext, abs((a.s + a.e) - (b.s + b.e)) AS dist, row_number() OVER (PARTITION BY a.file_id, a.seg_idx ORDER BY abs((a.s + a.e) - (b.s + b.e)), b.seg_idx) AS k FROM a JOIN b USING (file_id)),
 r AS (SELECT a.file_id, a.seg_idx, (a.s - 1704067200000000) // 1000 AS s, (a.e - 1704067200000000) // 1000 AS e, coalesce(o.texts, c.rtext, '') AS reference FROM a LEFT JOIN o ON a.file_id = o.file_id AND a.seg_idx = o.seg_idx LEFT JOIN c ON a.file_id = c.file_id AND a.seg_idx = c.seg_idx AND c.k = 1 AND c.dist <= 4000000)
 SELECT file_id, seg_idx, CAST(seg_idx + 1 AS VARCHAR) || chr(10) || lpad(CAST(s // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || {_stamp('s', False, ',')} || ' --> ' || lpad(CAST(e // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(e // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || {_stamp('e', False, ',')} || chr(10) || reference || chr(10) AS block FROM r"""
)
def caption_pipeline(spark, sf):
    """Merge speech turns into chunks, give each its reference lines, and format SRT blocks."""
    chunks = folds.merge_chunks(segments(spark, sf), 86_400_000_000).select("file_id", F.col("chunk_idx").alias("seg_idx"), "s", "e")
    named = intervals.match_references(chunks, references(spark, sf, "purchase").drop("label", "value"), bucket_us=BUCKET)
    rows = chunks.join(named, ["file_id", "seg_idx"])
    ms = lambda c: F.floor((F.col(c) - 1_704_067_200_000_000) / 1000).cast("bigint")
    return rows.select("file_id", "seg_idx", formatting.srt_block(F.col("seg_idx") + 1, ms("s"), ms("e"), F.col("reference")).alias("block"))
