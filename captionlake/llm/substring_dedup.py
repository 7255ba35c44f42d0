"""Substring dedup by Relative Lempel-Ziv parsing of a corpus against itself, distributed.

A document is factored against reference blocks: stretches of text around an anchor. Anchors are chosen by content (the
smallest hash of GRAM words among the neighbouring ones), so that equal texts choose equal anchors wherever they stand,
and every window of `window` words has exactly one. The block of an anchor holds all windows that chose it, and a window
that occurs elsewhere occurs there under the same anchor, at the same distance from it.

1. Index: every block of every document, by its anchor's hash. A hash that occurs once has no duplicate and goes.
2. A block that occurs again as a whole is one factor, however often it is copied.
3. Where an anchor has different blocks, these are factored greedily, left to right: at a position the longest match with
   another block of the anchor is found by hashes of ranges, from `window` words on and word by word further. A factor of
   `window` words or more is a duplicate span; parsing goes on at the factor's end, where it is checked whether the last
   words of the factor begin another match: the next position is the first whose window reaches beyond the factor.
   Without a match the position moves on by one word.
4. Factors that touch or overlap, within a block and across neighbouring blocks, join into spans, and the spans' words go.

Documents are long and rows are small: an anchor row is a few numbers; words travel only for one copy of each block whose
anchor has different ones; texts meet their spans where they lie if the spans are counted to be small. An anchor with more
than CROWD different blocks is not parsed in one task: its windows are counted by anchor and hash, which gives the same
words, and factors of `window` words each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import BASE2, BASE3, Prefix, Scratch, checked_broadcast, mix, partitions, renamed, renamed_column, row_key, runs_of, signed, slices, string_bytes, word_hashes, word_spans

WINDOW, GRAM = 35, 10
#: Different blocks of one anchor that are parsed in one task at most, and words of blocks that are parsed at once.
CROWD, AT_ONCE = 1024, 1 << 17
#: Bytes of spans that are sent to all workers at most.
SENT = 16 << 20


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the smallest of h[i : i + width] is; the first of equal ones. By doubling: O(n log width)."""
    at = np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


class Words:
    """Word hashes of a run of documents, and hashes of any stretch of them."""

    def __init__(self, column: pa.Array) -> None:
        data, offs = string_bytes(column)
        starts, ends, self.doc = word_spans(data, offs)
        h = word_hashes(data, starts, ends)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(offs) - 1))])
        self.one, self.two = Prefix(h, BASE2), Prefix(h, BASE3)

    def anchors(self, window: int, gram: int) -> dict[str, np.ndarray]:
        """doc, lo, hi (first and last window start that chose it), lead (words from lo to the anchor), anchor and block hashes."""
        n = len(self.doc)
        empty = {k: np.empty(0, np.int64) for k in ("doc", "lo", "hi", "lead", "anchor", "block")}
        if n < window:
            return empty
        i = np.arange(n - gram + 1)
        g = self.one.hashes(i, i + gram)
        at = smallest(g, window - gram + 1)[: n - window + 1]
        start = np.flatnonzero(self.doc[window - 1 :] == self.doc[: n - window + 1])
        if not len(start):
            return empty
        at = at[start]
        # windows of one anchor follow each other: runs of equal anchors
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        lo, hi = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
        # the offset of the anchor belongs to the block's name: equal blocks choose equal anchors, but not at the ends of a document
        return {"doc": self.doc[lo], "lo": lo, "hi": hi, "lead": at[new] - lo, "anchor": signed(g[at[new]]), "block": signed(self.two.hashes(lo, hi + window) ^ (at[new] - lo).astype(np.uint64))}


def folded(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each (doc, anchor, block) once, with its count n; what a document repeats in itself follows as ranges with n = 0.

    So a document that says one thing a thousand times gives a few rows, not a thousand rows of one anchor.
    """
    order = np.lexsort((a["lo"], a["block"], a["anchor"], a["doc"]))
    x = {k: v[order] for k, v in a.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[k][1:] != x[k][:-1] for k in ("doc", "anchor", "block")], axis=0)
    group = np.cumsum(new) - 1
    n = np.bincount(group)
    again = np.sort(order[n[group] > 1]) if len(order) else order
    doc, lo, hi = (a[k][again] for k in ("doc", "lo", "hi"))
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)])) if len(again) else again
    ends = np.concatenate([starts[1:], [len(again)]])[: len(starts)] - 1
    none = np.zeros(len(starts), dtype=np.int64)
    own = {k: x[k][new] for k in ("doc", "lo", "hi", "lead", "anchor", "block")} | {"n": n}
    return {k: np.concatenate([own[k], v]) for k, v in {"doc": doc[starts], "lo": lo[starts], "hi": hi[ends], "lead": none, "anchor": none, "block": none, "n": none}.items()}


#: Over any number of words of a document.
_FAR = 1 << 32
#: A place packs lo, hi - lo and lead: the last two are under the window, which is at most FIELD.
FIELD = 1 << 10


def anchor_rows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, block, rk, place, n of each block; lo counts from the document's first word. See folded(): rows with n = 0 are
    repeats within a document, from window start `place` to window start `block`."""
    if not gram <= window < FIELD:
        raise ValueError(f"windows have {gram} to {FIELD - 1} words")
    names = ["anchor", "block", "rk", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words(part.column(1))
            a = folded(w.anchors(window, gram))
            lo, hi = (a[k] - w.first[a["doc"]] for k in ("lo", "hi"))
            own = a["n"] == 0
            place = np.where(own, lo, (lo * FIELD + hi - lo) * FIELD + a["lead"])
            yield pa.RecordBatch.from_arrays([pa.array(a["anchor"]), pa.array(np.where(own, hi, a["block"])), part.column(0).take(pa.array(a["doc"])), pa.array(place), pa.array(a["n"].astype(np.int32))], names)

    return _keyed(docs).mapInArrow(run, "anchor long, block long, rk long, place long, n int")


def _lo_hi(lo, hi) -> list:
    return [lo.cast("int").alias("lo"), hi.cast("int").alias("hi")]


def _unpacked(df: DataFrame) -> DataFrame:
    """rk, lo, hi of blocks."""
    lo = F.floor(F.col("place") / (FIELD * FIELD))
    return df.select("rk", *_lo_hi(lo, lo + F.floor(F.col("place") / FIELD) % FIELD))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("rk"), F.col("text").cast("string").alias("text"))


def _asked(docs: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """rk, text, blocks (anchor, place): the texts from which words of blocks are needed; no others move, if these are few."""
    own = scratch.table(blocks.groupBy("rk").agg(F.collect_list(F.struct("anchor", "place")).alias("blocks")), "asked")
    texts = _keyed(docs).join(checked_broadcast(own.select("rk")), "rk", "left_semi")
    return texts.join(own, "rk").select("rk", "text", "blocks")


def _each_block(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, anchor, lo, hi, lead) of the blocks asked of a batch of _asked()."""
    lists = part.column(2)
    ends = lists.offsets.to_numpy()
    flat = lists.values.slice(ends[0], ends[-1] - ends[0])
    place = flat.field("place").to_numpy()
    lo = place // (FIELD * FIELD)
    return np.repeat(np.arange(part.num_rows), np.diff(ends)), flat.field("anchor").to_numpy(), lo, lo + place // FIELD % FIELD, place % FIELD


def block_words(asked: DataFrame, window: int) -> DataFrame:
    """anchor, rk, lo, lead, body (the words, joined by a space) of each block."""
    names = ["anchor", "rk", "lo", "lead", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [(t or "").encode("utf-8", "replace").split() for t in part.column(1).to_pylist()]
            row, anchor, lo, hi, lead = _each_block(part)
            bodies = [b" ".join(words[r][a : b + window]) for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(0).take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(bodies, pa.binary())], names)

    return asked.mapInArrow(run, "anchor long, rk long, lo int, lead int, body binary")


def _repeated(keys: np.ndarray) -> np.ndarray:
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[back] > 1


def parse(anchor: np.ndarray, lead: np.ndarray, bodies: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, begin, end) of the factors of `window` words or more of each block, greedily from its first word on.

    Blocks of one anchor are references to each other; anchor and lead say which, and how they lie to each other.
    """
    w = Words(bodies)
    size = np.diff(w.first)
    places = np.maximum(size - window + 1, 0)
    first = np.concatenate([[0], np.cumsum(places)])
    block = np.repeat(np.arange(len(size)), places)
    at = np.arange(first[-1]) - first[block]
    start = w.first[block] + at
    where = mix(anchor[block].view(np.uint64) + (lead[block] - at + FIELD).astype(np.uint64) * np.uint64(BASE2))
    longest = np.zeros(len(block), dtype=np.int64)
    alive, length = np.arange(len(block)), window
    while len(alive):
        alive = alive[_repeated(where[alive] ^ w.two.hashes(start[alive], start[alive] + length))]
        longest[alive] = length
        length += 1
        alive = alive[at[alive] + length <= size[block[alive]]]
    found, pos = [], np.zeros(len(size), dtype=np.int64)
    open_ = np.flatnonzero(places > 0)
    while len(open_):
        match = longest[first[open_] + pos[open_]]
        hit = match > 0
        found.append(np.stack([open_[hit], pos[open_][hit], (pos[open_] + match)[hit]]))
        # at a factor's end the next window to check is the first that reaches beyond it
        pos[open_] += np.where(hit, match - window + 1, 1)
        open_ = open_[pos[open_] < places[open_]]
    out = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    return out[0], out[1], out[2]


def factors(bodies: DataFrame, window: int) -> DataFrame:
    """rk, lo, hi (window starts) of the factors in the blocks of block_words()."""
    names = ["rk", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for group in runs_of(batches, 0):
            held += group
            words += sum(x.num_rows for x in group) * 2 * window
            if words > AT_ONCE:
                yield emit(held)
                held, words = [], 0
        if held:
            yield emit(held)

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        anchor, lo, lead = (t.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3))
        block, begin, end = parse(anchor, lead, t.column(4).chunk(0), window)
        return pa.RecordBatch.from_arrays([t.column(1).chunk(0).take(pa.array(block)), pa.array((lo[block] + begin).astype(np.int32)), pa.array((lo[block] + end - window).astype(np.int32))], names)

    dealt = bodies.repartition(partitions(bodies.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "rk long, lo int, hi int")


def window_rows(asked: DataFrame, window: int) -> DataFrame:
    """rk, anchor, lo and hash of each window of the given blocks."""
    names = ["rk", "anchor", "lo", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words(part.column(1))
            doc, anchor, lo, hi, _ = _each_block(part)
            count = hi - lo + 1
            row = np.repeat(np.arange(len(lo)), count)
            start = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = start + w.first[doc[row]]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[row])), pa.array(anchor[row]), pa.array(start.astype(np.int32)), pa.array(signed(w.two.hashes(at, at + window)))], names)

    return asked.mapInArrow(run, "rk long, anchor long, lo int, hash long")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """rk, spans: the joined word ranges of the factors copied from elsewhere, as pairs of 32-bit numbers, ascending."""
    scratch = scratch or Scratch(docs.sparkSession)
    index = scratch.table(anchor_rows(docs, window, gram), "anchors")
    often = index.where("n > 0").groupBy("anchor").agg(F.sum("n").alias("all"), (F.min("block") != F.max("block")).alias("differ")).where("all > 1").select("anchor", "differ")
    again = scratch.table(index.where("n > 0").join(often, "anchor"), "again")
    own = scratch.table(index.where("n = 0").select("rk", *_lo_hi(F.col("place"), F.col("block"))), "own")
    scratch.drop(index)
    # blocks of anchors that have different ones: each once, with its count and one place
    blocks = again.where("differ").groupBy("anchor", "block").agg(F.sum("n").alias("n"), F.min(F.struct("rk", "place")).alias("x"))
    blocks = scratch.table(blocks.select("anchor", "block", "n", "x.rk", "x.place"), "blocks")
    copied = checked_broadcast(blocks.where("n > 1").select("anchor", "block"), 100_000)
    whole = scratch.table(_unpacked(again.where("NOT differ").select("rk", "place").unionByName(again.where("differ").join(copied, ["anchor", "block"], "left_semi").select("rk", "place"))), "whole")
    scratch.drop(again)
    crowds = scratch.table(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("anchor"), "crowds")
    some = not crowds.isEmpty()
    usual = blocks.join(checked_broadcast(crowds), "anchor", "left_anti") if some else blocks
    found = own.unionByName(whole).unionByName(factors(block_words(_asked(docs, usual, scratch), window), window))
    if some:
        windows = scratch.table(window_rows(_asked(docs, blocks.join(checked_broadcast(crowds), "anchor", "left_semi"), scratch), window), "windows")
        twice = windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", "hash")
        found = found.unionByName(windows.join(twice, ["anchor", "hash"], "left_semi").select("rk", "lo", F.col("lo").alias("hi")))
    # a document's factors are as many as its words at most
    return scratch.table(joined_spans(found.groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("lo", (F.col("hi") + window).alias("end")))).alias("s"))), "spans")


def joined_spans(factors: DataFrame) -> DataFrame:
    """rk, spans: ranges that touch or overlap as one. factors: rk, s (array of lo, end, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            ends = part.column(1).offsets.to_numpy()
            flat = part.column(1).values.slice(ends[0], ends[-1] - ends[0])
            lo, end = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            doc = np.repeat(np.arange(part.num_rows), np.diff(ends))
            far = np.maximum.accumulate(doc * _FAR + end)  # how far the document is covered so far
            new = np.flatnonzero(np.concatenate([[True], doc[1:] * _FAR + lo[1:] > far[:-1]]))
            last = far[np.append(new[1:], len(far)) - 1] - doc[new] * _FAR
            pairs = np.stack([lo[new], last], axis=1).astype("<i4")
            cut = np.searchsorted(doc[new], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["rk", "spans"])

    return factors.mapInArrow(run, "rk long, spans binary")


def _with_spans(docs: DataFrame, window: int, gram: int, scratch: Scratch | None) -> DataFrame:
    """docs (with a column rk) and their spans; the spans go to the texts where they are counted to be few bytes."""
    spans = duplicate_spans(docs, window, gram, scratch)
    size = spans.agg((F.sum(F.length("spans")) + F.count(F.lit(1)) * 16).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(spans) if size <= SENT else spans


def _kept(text: str | None, spans: bytes | None) -> tuple[list[bytes], list[bytes], int]:
    """(all words, kept words, number of spans)."""
    words = (text or "").encode("utf-8", "replace").split()
    pairs = np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist()
    kept, at = [], 0
    for b, e in pairs:
        kept += words[at:b]
        at = e
    return words, kept + words[at:], len(pairs)


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """The given columns with `text` cut to its kept words, joined by one space; n_chars, if there, follows the text.

    Defined cases: those of digest(); a text of which nothing goes, or null, is left as it is, with its own spacing; a text
    of which all goes is empty; columns may have any names.
    """
    spans = _with_spans(docs, window, gram, scratch)
    schema, at = docs.schema, docs.columns.index("text")
    sizes = [k for k, name in enumerate(docs.columns) if name == "n_chars"]
    joined = renamed(docs).withColumn("rk", F.xxhash64(renamed_column(docs, "doc_id"), renamed_column(docs, "text"))).join(spans, "rk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            texts = [b" ".join(_kept(t, s)[1]).decode("utf-8", "replace") if s else t for t, s in zip(part.column(at).to_pylist(), part.column(len(schema)).to_pylist(), strict=True)]
            cols = [part.column(k) for k in range(len(schema))]
            cols[at] = pa.array(texts, cols[at].type)
            for k in sizes:
                cols[k] = pa.array([None if t is None else len(t) for t in texts]).cast(cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.select(*renamed(docs).columns, "spans").mapInArrow(run, schema)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans of every row.

    Defined cases: a null text has no words; repeated rows are documents of their own, and so each other's duplicates;
    null ids stay null; documents of fewer words than the window lose nothing; no rows give none; other columns are not
    read. A row is known by 64 bits of its id and text, words by 64 bits.
    """
    spans = _with_spans(docs, window, GRAM, None)
    joined = docs.select(F.col("doc_id").cast("long"), row_key().alias("rk"), F.col("text").cast("string")).join(spans, "rk", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words, kept, n = _kept(t, s)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), n))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")
