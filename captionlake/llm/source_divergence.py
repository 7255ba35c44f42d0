"""Source divergence audit: how far each source's words stand from those of the language and of its other sources.

Shares are whole numbers of a 1,000,000,001st: p = 1 + floor(10**9 (count + 1) / (N + V)) over the V kept terms, and one
term's divergence is floor((p - q)**2 / q); all of it in 64-bit integers, wider only where a count needs it.

Pairs of sources are summed sparsely. A term that neither source has counts the baseline f(p0, q0) of their two shares
of a count of 0; a term that one of them has replaces one side of that; only terms that both have need the two shares
together. So the pair's sum is the baseline times V, corrected by each source's own histogram of shares against the
other's baseline, and by the terms they share, which meet in blocks of 256 sources and are summed per block as a matrix.

The ranking is a radix selection. Histograms over 12 bits of the values, highest first, narrow down each group's k-th
value; ties at that value are narrowed down in the same way by two bytes of the term, past what all of them have in
common. Only the at most k rows of a group above the threshold are ever sorted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm.common import Scratch, checked_broadcast

SCALE = 1_000_000_000
#: Bytes that are no letter become a blank, A-Z become small; what is left between blanks is a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at once, and entries of a task's counts before they are sent on.
PIECE, MOST_ENTRIES = 1 << 20, 200_000
#: Sources of a block; pairs of shares that are computed at once.
BLOCK, PAIRS_AT_ONCE = 256, 1 << 20
DIGIT, VALUE_BITS = 12, 60

# --------------------------------------------------------------------- counts


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, a piece at a time."""
    data, start = text.translate(_TERM), 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (bytes), n (occurrences), d (documents); and a row with a null term for each group there is.

    Counted in each task before the shuffle, so that a group with a third of all documents sends each term once a task.
    """
    names = ["lang", "source", "term", "n", "d"]

    def rows(counts: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), (n, d) in counts.items():
            size = len(n) + 1
            for column, more in zip(out, ([lang] * size, [source] * size, [None, *n], [0, *n.values()], [0, *map(d.__getitem__, n)]), strict=True):
                column += more
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                entries -= len(n)
                own: set[bytes] = set()
                for terms in terms_of(text):
                    n.update(terms)
                    own.update(terms)
                d.update(own)
                entries += len(n)
                if entries > MOST_ENTRIES:
                    yield rows(counts)
                    counts, entries = {}, 0
        if counts:
            yield rows(counts)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return found.mapInArrow(run, "lang string, source string, term binary, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str) -> str:
    """SQL of 1 + floor(SCALE * (count + 1) / total), exact at any size; total is of terms and kept terms."""
    wide = f"(cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast({total} as decimal(20, 0))"
    return f"(1 + if({count} < 9000000000, ({SCALE}L * ({count} + 1)) div ({total}), {wide}))"


def divergence(p: str, q: str) -> str:
    """SQL of floor((p - q)**2 / q), exact for shares."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


class Kept:
    """The kept terms of each language and what the groups have of them, as written tables.

    kept: lang, source, sid, term, p and q (the group's and the language's share); groups: lang, source, sid (a number within
    the language), v (kept terms of the language), support (those the group has), p0 (its share of a count of 0).
    """

    def __init__(self, docs: DataFrame, min_documents: int, scratch: Scratch) -> None:
        counts = scratch.table(term_counts(docs), "terms")
        term = Window.partitionBy("lang", "term")
        first = F.row_number().over(term.orderBy("source")) == 1
        found = counts.where("term IS NOT NULL").withColumns({"l": F.sum("n").over(term), "all": F.sum("d").over(term), "first": first.cast("long")})
        raw = scratch.table(found.where(F.col("all") >= min_documents).drop("all", "d"), "raw")
        langs = raw.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("all_n"))
        sums = raw.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("support"))
        groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_n", "support", "v", "all_n"])
        groups = groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        groups = groups.withColumn("p0", F.when(F.col("v") > 0, F.expr(share("0L", "(own_n + v)"))))
        self.groups = scratch.table(groups, "groups")
        numbers = checked_broadcast(self.groups.select("lang", "source", "sid", "v", "own_n", "all_n"))
        shares = raw.join(numbers, ["lang", "source"]).select("lang", "source", "sid", "term", F.expr(share("n", "(own_n + v)")).alias("p"), F.expr(share("l", "(all_n + v)")).alias("q"))
        self.kept = scratch.table(shares, "kept")


# ---------------------------------------------------------------------- pairs


def pair_sums(kept: Kept, block: int = BLOCK, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """lang, a, b (sids) and value of every ordered pair of sources of a language."""
    groups = kept.groups.select("lang", "sid", "v", "support", "p0")
    other = checked_broadcast(groups.select("lang", F.col("sid").alias("b"), F.col("support").alias("support_b"), F.col("p0").alias("q0")))
    base = groups.withColumnRenamed("sid", "a").join(other, "lang").where("a <> b")
    lacking = base.select("lang", "a", "b", F.expr(f"if(v = 0, 0L, (v - support - support_b) * {divergence('p0', 'q0')})").alias("value"))
    # how often a source has each share, against the baselines of the others, in both directions
    own = kept.kept.groupBy("lang", "sid", "p").agg(F.count(F.lit(1)).alias("m"))
    met = own.join(other, "lang").where("sid <> b").groupBy("lang", "sid", "b").agg(F.sum(F.expr(f"m * {divergence('p', 'q0')}")).alias("to"), F.sum(F.expr(f"m * {divergence('q0', 'p')}")).alias("from"))
    sides = met.select("lang", F.inline(F.array(F.struct(F.col("sid").alias("a"), "b", F.col("to").alias("value")), F.struct(F.col("b").alias("a"), F.col("sid").alias("b"), F.col("from").alias("value")))))
    return lacking.unionByName(sides).unionByName(_shared(kept, block, at_once)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _shared(kept: Kept, block: int, at_once: int) -> DataFrame:
    """lang, a, b, value: what terms that two sources share add to the baseline and the two one-sided corrections."""
    zero = checked_broadcast(kept.groups.select("lang", "sid", "p0"))
    rows = kept.kept.select("lang", "sid", "term", "p").join(zero, ["lang", "sid"])
    item = F.struct((F.col("sid") % block).cast("int").alias("s"), "p", "p0")
    blocks = rows.repartition("lang", "term").groupBy("lang", "term", F.expr(f"sid div {block}").alias("x")).agg(F.collect_list(item).alias("items"))
    met = blocks.join(blocks.select("lang", "term", F.col("x").alias("y"), F.col("items").alias("others")), ["lang", "term"])
    met = met.where((F.col("x") != F.col("y")) | (F.size("items") > 1)).select("lang", "x", "y", "items", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def ended() -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for (lang, x, y), matrix in sums.items():
                at = np.flatnonzero(matrix)
                out[0] += [lang] * len(at)
                for column, more in zip(out[1:], (x * block + at // block, y * block + at % block, matrix[at]), strict=True):
                    column.append(more)
            columns = [pa.array(out[0], pa.string()), *(pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in out[1:])]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

        for batch in batches:
            for key, value in zip(*_block_sums(batch, block, at_once), strict=True):
                if key not in sums:
                    if len(sums) >= 64:
                        yield ended()
                    sums[key] = np.zeros(block * block, dtype=np.int64)
                sums[key] += value
        yield ended()

    return met.sortWithinPartitions("lang", "x", "y").mapInArrow(run, "lang string, a long, b long, value long").select("lang", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "value")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _block_sums(batch: pa.RecordBatch, block: int, at_once: int) -> tuple[list[tuple], list[np.ndarray]]:
    """Sums by (lang, block, block) of a batch of terms; all pairs of the two lists of a row, some at_once at a time."""
    keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
    number = {key: k for k, key in enumerate(dict.fromkeys(keys))}
    row_key = np.array([number[k] for k in keys], dtype=np.int64)
    sides = []
    for column in (batch.column(3), batch.column(4)):
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values
        sides.append((offsets, *(values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))))
    (off_a, s_a, p_a, z_a), (off_b, s_b, p_b, z_b) = sides
    n_b = np.diff(off_b)
    # left entries one by one, each against its row's whole right list
    row = np.repeat(np.arange(len(keys)), np.diff(off_a))
    left = np.arange(off_a[0], off_a[-1]) if len(keys) else np.empty(0, np.int64)
    ends = np.cumsum(n_b[row])
    sums = np.zeros((len(number), block * block), dtype=np.int64)
    begin = 0
    while begin < len(row):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + at_once, "right")))
        size = n_b[row[begin:end]]
        i = np.repeat(left[begin:end], size)
        r = np.repeat(row[begin:end], size)
        j = off_b[r] + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
        p, q, p0, q0 = p_a[i], p_b[j], z_a[i], z_b[j]
        value = _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)
        np.add.at(sums.reshape(-1), row_key[r] * (block * block) + s_a[i] * block + s_b[j], value)
        begin = end
    for key, k in number.items():
        if key[1] == key[2]:
            sums[k][:: block + 1] = 0  # a source and itself
    return list(number), list(sums)


# -------------------------------------------------------------------- ranking


def top_by_group(rows: DataFrame, keys: list[str], k: int, scratch: Scratch) -> DataFrame:
    """The rows of each group with its k largest values (0 to 2**60 - 1), ties by item (bytes, each once a group) ascending.

    rows: a written table of keys, value (long) and item (binary). Each round is a histogram of at most 2**12 digits, or
    2**16 pairs of bytes, of a group; nothing but those and one state a group is gathered.
    """
    state = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("at"), F.lit(k).cast("long").alias("need"))
    done: list[DataFrame] = []

    def narrowed(matched: DataFrame, digit: Column, ends: bool) -> DataFrame:
        """keys, at, need (before), found: the first digit at which the counts reach need, with its count and ends."""
        lo_hi = [F.min("item").alias("lo"), F.max("item").alias("hi")] if ends else [F.lit(None).cast("binary").alias("lo"), F.lit(None).cast("binary").alias("hi")]
        bars = matched.groupBy(*keys, "at", "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), *lo_hi)
        lists = bars.groupBy(*keys, "at", "need").agg(F.sort_array(F.collect_list(F.struct("digit", "n", "lo", "hi"))).alias("bars"))
        none = "cast(null as struct<digit:{0},n:bigint,lo:binary,hi:binary>)".format(dict(bars.dtypes)["digit"])
        found = F.expr(
            f"aggregate(bars, named_struct('before', 0L, 'bar', {none}), "
            "(s, x) -> if(s.bar is not null, s, if(s.before + x.n >= need, named_struct('before', s.before, 'bar', x), named_struct('before', s.before + x.n, 'bar', s.bar))))"
        )
        return lists.select(*keys, "at", "need", found.alias("f")).select(*keys, "at", (F.col("need") - F.col("f.before")).alias("need"), F.col("f.bar").alias("bar"))

    def go_on(found: DataFrame, name: str, closed: Column, floor: Column, last: Column) -> DataFrame:
        """Sets aside the groups that are settled (rows above `floor`, and at it up to the item `last`); the others."""
        written = scratch.table(found, name)
        done.append(written.where(closed).select(*keys, floor.cast("long").alias("floor"), last.alias("last")))
        return written.where(~closed)

    null = F.lit(None).cast("binary")
    for shift in range(VALUE_BITS - DIGIT, -1, -DIGIT):
        here = rows.join(checked_broadcast(state), keys).where(F.shiftright("value", shift + DIGIT) == F.col("at"))
        digit = -F.shiftright("value", shift).bitwiseAND((1 << DIGIT) - 1)  # largest first
        found = narrowed(here, digit, ends=shift == 0)
        at = F.shiftleft("at", DIGIT) - F.col("bar.digit")
        found = found.select(*keys, F.coalesce(at, F.lit(-1).cast("long")).alias("at"), "need", "bar")
        closed = F.col("bar").isNull() | (F.col("bar.n") == F.col("need"))
        state = go_on(found, "digits", closed, F.when(F.col("bar").isNull(), F.lit(-1)).otherwise(F.shiftleft("at", shift) - 1), null).select(*keys, "at", "need", *([F.col("bar.lo").alias("lo"), F.col("bar.hi").alias("hi")] if shift == 0 else []))
    while state.limit(1).count():
        # of more ties than are needed: the next two bytes after what the least and the greatest have in common
        same = F.expr("filter(sequence(1, least(length(lo), length(hi)) + 1), i -> substring(lo, i, 1) <> substring(hi, i, 1) or i > length(lo) or i > length(hi))[0]")
        state = state.withColumn("from", same)
        here = rows.join(checked_broadcast(state), keys).where((F.col("value") == F.col("at")) & F.col("item").between(F.col("lo"), F.col("hi")))
        found = narrowed(here, F.expr("substring(item, from, 2)"), ends=True)
        state = go_on(found, "ties", (F.col("bar.n") == F.col("need")) | (F.col("bar.lo") == F.col("bar.hi")), F.col("at"), F.col("bar.hi")).select(*keys, "at", "need", F.col("bar.lo").alias("lo"), F.col("bar.hi").alias("hi"))
    limits = scratch.table(reduce(DataFrame.unionByName, done), "limits")
    kept = rows.join(checked_broadcast(limits), keys).where((F.col("value") > F.col("floor")) | (F.col("value") == F.col("floor")) & (F.col("item") <= F.col("last")))
    return kept.drop("floor", "last")


def audit(docs: DataFrame, min_documents: int = 3, most: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part ('pair': each other source of the language; 'term': terms more frequent here than in the language,
    the `most` largest), item, value, rank.

    Defined cases: nulls of text, lang and source are empty strings; a group without kept terms has pairs all the same, and a
    language without any has pairs of 0; repeated rows count as documents each; one source has no pairs; ties of the value
    go by the item's UTF-8 bytes; no rows give none; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kept = Kept(docs, min_documents, scratch)
    names = lambda sid, name: checked_broadcast(kept.groups.select("lang", F.col("sid").alias(sid), F.col("source").alias(name)))
    pairs = pair_sums(kept).join(names("a", "source"), ["lang", "a"]).join(names("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    gains = scratch.table(kept.kept.where("p > q").select("lang", "sid", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value")), "gains")
    best = top_by_group(gains, ["lang", "sid"], most, scratch).join(names("sid", "source"), ["lang", "sid"])
    terms = best.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
