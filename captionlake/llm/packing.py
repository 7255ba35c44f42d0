"""Best-fit packing of token pieces into sequences of bounded length.

Only lengths decide a packing, and there are at most `capacity` of them. So the documents are tokenised and measured
where they lie, a histogram of at most `capacity` counts goes to the driver, and the driver packs counts, not documents:
Martello and Toth's dominance reduction first fixes small sets that some best packing must hold, then best fit
decreasing packs the rest. What comes back is a table of runs (length, first rank, sequence, copies, offset) whose size
depends on the capacity alone; each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm.common import Memo, Scratch, held, partitions, slices

CAPACITY = 2048
_WS = r"\t-\r \x85\xa0  -     　"
#: Cuts a text only where the byte-level pre-tokenizer cuts it as well.
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def _library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _merger(path: str):
    """The same vocabulary and merge order in a library with a cheaper call; None where that is not proved.

    Proved is: byte-level pieces without normaliser or other steps, and merges that make the ids in ascending order.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        tok = json.load(f)
    model, pre = tok["model"], tok["pre_tokenizer"]
    plain = tok["normalizer"] is None and tok["post_processor"] is None and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges"))
    if not plain or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    special = {t["content"] for t in tok["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(made) + 256 != len(ranks) or any(ranks[bytes([b])] >= made[0] for b in range(256)):
        return None
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Ids(Memo):
    """chunk -> its ids as little-endian unsigned 32-bit numbers, filled as chunks come up."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tok, self.merger = _library(path), _merger(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def compute(self, key: str) -> bytes:
        return np.array(self.merger.encode_ordinary(key), dtype="<u4").tobytes() if self.merger else self.whole(key)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _CHUNKS.findall(text)))


def ids_of(path: str) -> Ids:
    """One table for all tasks of a Python worker."""
    return held(("ids", path), lambda: Ids(path))


def piece_starts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole but for the first, which takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and then end_id, cut where longer than capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(path), end_id.to_bytes(4, "little")
        for part in slices(batches, keep=True):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                data = memoryview(ids.encode(text or "") + end)
                rows += [(doc_id, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(piece_starts(len(data) // 4, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------- packing of counts

#: (number of sequences, [(length, copies in each), ...])
Pattern = tuple[int, list[tuple[int, int]]]


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets that dominate every other set with the same largest item; takes them out of counts, in place.

    With j the largest item left and `room` beside it, some best packing holds: {j} if nothing fits; {j, k}, k the
    largest that fits, if it fills the room, or no two items fit, or no three fit and no pair sums to more than k;
    {j, k, b} if no three fit and no feasible pair has a smaller item over b, b being the largest beside k.
    """
    fixed: list[Pattern] = []

    def take(*items: int) -> int:
        need = {x: items.count(x) for x in items}
        n = min(int(counts[x]) // m for x, m in need.items())
        if n:
            for x, m in need.items():
                counts[x] -= n * m
            fixed.append((n, list(need.items())))
        return n

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1
            sizes = np.flatnonzero(counts[: room + 1])
            copies = counts[sizes].copy()
            counts[j] += 1
            if not len(sizes):
                take(j)
                continue
            k = int(sizes[-1])
            low = np.repeat(sizes[:3], np.minimum(copies[:3], 3))[:3]
            if k == room or len(low) < 2 or low[:2].sum() > room:
                if not take(j, k):
                    break
                continue
            if len(low) == 3 and low.sum() <= room:
                break  # three or more fit beside j: no set is proved
            # the largest partner, not over itself, of each size
            most = np.minimum(sizes, room - sizes)
            at = np.searchsorted(sizes, most, "right") - 1
            alone = (at >= 0) & (sizes[at] == sizes) & (copies < 2)
            at = at - alone
            fits = at >= 0
            pairs = sizes + sizes[np.maximum(at, 0)]
            if not fits.any() or k >= pairs[fits].max():
                if not take(j, k):
                    break
                continue
            lesser = sizes[at[fits]].max()
            left = np.array([c - (s == k) for s, c in zip(sizes, copies, strict=True)])
            beside = sizes[(left > 0) & (sizes <= room - k)]
            if not len(beside) or beside[-1] < lesser or not take(j, k, int(beside[-1])):
                break
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing over equal bins at once: the same bins as one by one."""
    groups: dict[int, list] = {}  # room left -> [(bins, chain)], chain = (earlier chain, length, copies)
    rooms: list[int] = []

    def put(room: int, bins: int, chain: tuple) -> None:
        if bins:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((bins, chain))

    for w in range(capacity, 0, -1):
        left = int(counts[w])
        while left:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                room, bins, chain = capacity, left, None
            else:
                room = rooms[i]
                bins, chain = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            each = room // w
            full = min(bins, left // each)
            put(room - each * w, full, (chain, w, each))
            left -= full * each
            if full < bins and 0 < left < each:
                put(room - left * w, 1, (chain, w, left))
                full, left = full + 1, 0
            if chain is not None:
                put(room, bins - full, chain)
    out = []
    for room in rooms:
        for bins, chain in groups[room]:
            items = []
            while chain:
                chain, w, n = chain
                items.append((w, n))
            out.append((bins, items[::-1]))
    return out


def pack_counts(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each, first offset), sorted; at most a few for each two lengths."""
    rows, used, sequence = [], {}, 0
    for bins, items in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + bins * each
            offset += length * each
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and others).

    Ranks among equal lengths come from counts of hashed buckets and numbering within each, so that no length, however
    common, is numbered by one task. Read twice: pass a written table.
    """
    table = runs(pack_counts({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity))
    keys = table[:, 0] << 44 | table[:, 1]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(pieces.sparkSession))).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).select(*pieces.columns, (F.col("_before") + F.col("_rank")).alias("_rank"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(np.int64), f.pop("_rank").to_numpy(np.int64)
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            k = rank - row[:, 1]
            yield f.assign(sequence_id=row[:, 2] + k // row[:, 3], offset=row[:, 4] + k % row[:, 3] * length)

    return ranked.mapInPandas(find, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Defined cases: a null text is empty and gives a piece of its end id alone; a null doc_id stays null; repeated rows
    are packed each; no rows give none; other columns are not read.
    """
    pieces = (scratch or Scratch(docs.sparkSession)).table(token_pieces(docs, path, capacity), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
