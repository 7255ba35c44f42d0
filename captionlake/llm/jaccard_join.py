"""N-gram Jaccard self-join by a size-aware heavy-light scheme, and its connected components.

A link needs |r & s| >= t |r | s|, so each side lacks at most (1 - t) of its own elements.

- Small sets enumerate subsets of fixed size: the set without each choice of as many elements as it may lack. Linked sets
  share such a subset.
- Large sets go into inverted lists of elements. With all elements in one order, linked sets share one among their first
  (1 - t) n + 1, so only these are listed. The order is by the number of documents that hold an element, which is counted
  for every element: a document whose own words suffice for the first places is in no list at all, however many passages
  it shares with others.

The boundary between the two is the size at which, summed over the sizes that the corpus has, enumerating subsets comes to
cost more than counting elements and scanning lists (see boundary()).

Counting moves four bytes an element, not the documents: a slice of documents sends, for each bucket of elements, the
elements' hashes and their places, and gets back the shared ones with their counts. The number of buckets follows the
number of elements, so a bucket stays as large as it is. Elements that a bounded table of counters shows to be in very many
documents are not sent: they come last in the order, and are listed only for sets that have too few others.

Copies are one node. In each list first only the links to its best-connected node are verified; components follow. Members
that still lie in different components of a list, unless a sketch of parities proves them too far apart from all others, are
held against each other in blocks by their whole sets, and a block gives a forest of links. No list is expanded into rows of
pairs, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import BASE2, BASE3, Prefix, Scratch, checked_broadcast, lower_ascii, mix, partitions, renamed, renamed_column, row_key, runs_of, signed, slices, string_bytes, word_hashes, word_spans

#: Sizes below which a set may count as small, and the most subsets of one set that are enumerated.
MOST_SMALL, MOST_SUBSETS = 64, 10_000
#: Counters of element frequencies; elements of one counter share its count, and are common from so many times the mean.
COUNTERS, COMMON = 1 << 18, 4
#: Elements of one bucket on average, and of the sample whose lists are measured for the boundary.
BUCKET, SAMPLE = 1_500_000, 50_000
#: Members of one list that meet in a task at most; larger lists are cut into blocks, and blocks meet in pairs.
BLOCK = 512
#: Elements whose incidence is held at once, for at most 2 * BLOCK sets.
COLUMNS = 2048


class Threshold:
    """Jaccard similarity of percent / 100 or more, in whole numbers."""

    def __init__(self, percent: int) -> None:
        if not 0 < percent <= 100:
            raise ValueError("similarity must be a percentage over 0")
        self.percent = percent

    def drops(self, n):
        """Elements of a set of n that a linked set may lack."""
        return n * (100 - self.percent) // 100

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def least(self, n: int) -> int:
        """The smallest size that may link to one of n."""
        return -(-n * self.percent // 100)

    def apart(self, n):
        """Elements that two linked sets, the smaller of n, may differ in."""
        return n * (100 - self.percent) // self.percent


def subsets(n: int, t: Threshold) -> int:
    return sum(comb(n, i) for i in range(t.drops(n) + 1))


def boundary(sizes: dict[int, int], list_length: float, t: Threshold) -> int:
    """The size from which sets count as large: where all sets of the corpus cost least. sizes: how many sets of each size.

    A small set costs its subsets, which are rows; a large one its elements, which are counted, and the scan of the lists
    it is in. Sets just under the boundary may link across it, and cost both.
    """
    best, found = None, 1
    for below in range(1, MOST_SMALL + 1):
        if below > 1 and subsets(below - 1, t) > MOST_SUBSETS:
            break
        cost = sum(c * subsets(n, t) for n, c in sizes.items() if n < below)
        cost += sum(c * (n + (t.drops(n) + 1) * list_length) for n, c in sizes.items() if n >= t.least(below))
        if best is None or cost <= best:
            best, found = cost, below
    return found


# ----------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles in ascending order; with fewer words, all of them as one."""
    data = lower_ascii(data)
    starts, ends, doc = word_spans(data, offs)
    n = len(offs) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    prefix = Prefix(word_hashes(data, starts, ends), BASE2)
    at = np.flatnonzero(doc[words - 1 :] == doc[: len(doc) - words + 1]) if len(doc) >= words else np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    h = np.concatenate([prefix.hashes(at, at + words), prefix.hashes(first[short], first[short + 1])])
    d = np.concatenate([doc[at], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])


def set_names(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(BASE3)))])
    return np.where(np.diff(offs) > 0, signed(mix(sums[offs[1:]] - sums[offs[:-1]])), 0)


def subset_keys(h: np.ndarray, drops: int) -> np.ndarray:
    """A key of each subset that lacks at most `drops` elements."""
    m = mix(h ^ np.uint64(BASE2))
    total, out, n = np.sum(m), [np.array([np.sum(m)], dtype=np.uint64)], len(m)
    index = np.arange(n)[:, None]
    for _ in range(drops):
        if len(index) == 0:
            break
        out.append(total - m[index].sum(axis=1))
        # append every later element to each choice
        last = index[:, -1]
        more = n - 1 - last
        grown = np.repeat(index, more, axis=0)
        new = np.concatenate([np.arange(x + 1, n) for x in last]) if len(last) else np.empty(0, np.int64)
        index = np.concatenate([grown, new[:, None]], axis=1)
    return mix(np.concatenate(out) ^ np.uint64(0x5BD1E995))


def sketch(h: np.ndarray) -> bytes:
    """Parities of counts of elements in 2**b cells, 2**b >= 4 n: cells that differ are at most the symmetric difference."""
    bits = max(64, 4 << max(0, (len(h) - 1).bit_length()))
    return np.packbits((np.bincount((mix(h) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("rk"), F.col("text").cast("string"))


def survey(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """One pass over the texts. kind 0: a row's set (key: its name, n, sketch, items of small ones); 1: an element counter and
    its count; 2: an element of a sample of the hash space that shrinks as rows grow, and its count."""
    names = ["kind", "key", "n", "doc_id", "rk", "sketch", "items"]
    sample = np.uint64(max(1, rows * 500 // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for part in slices(batches):
            h, offs = shingle_sets(*string_bytes(part.column(2)), words)
            total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            own = [h[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            kept = [x.tobytes() if len(x) < MOST_SMALL else None for x in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(own), np.int32)), pa.array(set_names(h, offs)), pa.array(np.diff(offs)), part.column(0), part.column(1), pa.array([sketch(x) for x in own], pa.binary()), pa.array(kept, pa.binary())], names
            )
            some, count = np.unique(h[(h >> np.uint64(20)) % sample == 0], return_counts=True)
            if len(some):
                yield counts(2, signed(some), count)
        at = np.flatnonzero(total)
        yield counts(1, at, total[at])

    def counts(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(key), x) for x in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n.astype(np.int64)), *none], names)

    return _keyed(docs).mapInArrow(run, "kind int, key long, n long, doc_id long, rk long, sketch binary, items binary")


def statistics(surveyed: DataFrame) -> tuple[np.ndarray, int, dict[int, int], float]:
    """(rank of each counter, elements, how many small sets of each size, mean length of an element's list).

    A counter's rank is the power of two by which its count is over the mean, for common ones; 0 for all others. What comes
    to the driver is bounded: COUNTERS counts, MOST_SMALL sizes, and two sums.
    """
    table = surveyed.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS)
    counts[table["key"].to_numpy(np.int64)] = table["n"].to_numpy(float)
    over = counts / max(1.0, counts.mean())
    rank = np.where(over >= COMMON, np.log2(np.maximum(over, 1)), 0).astype(np.int8)
    sizes = {r["n"]: r["c"] for r in surveyed.where(f"kind = 0 AND n > 0 AND n < {MOST_SMALL}").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    x = surveyed.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different")).first()
    return rank, int(counts.sum()), sizes, (x["all"] or 1) / (x["different"] or 1)


# --------------------------------------------------------------- lists


def _grouped(values: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct `by`, offsets into values): values come sorted by `by`."""
    new = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.empty(0, np.int64)
    return by[new], np.append(new, len(values))


def _binaries(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """values[offs[i]:offs[i + 1]] as bytes, one array of binaries."""
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


_ENTRY = "bucket int, slice long, low binary, place binary, freq binary"


def element_entries(docs: DataFrame, t: Threshold, words: int, below: int, rank: np.ndarray, buckets: int) -> DataFrame:
    """What a slice of documents sends. For each bucket: low and place, the hash's low 32 bits and the document's number in
    the slice, of each element of a large set that is not common. And for the slice itself, once (bucket -1): in `low` the
    name of each set, in `place` how many of its elements may be shared before it must be listed, and in `freq` the
    (number, key) of common elements that are listed in any case."""
    names = ["bucket", "slice", "low", "place", "freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for at, part in enumerate(slices(batches)):
            h, offs = shingle_sets(*string_bytes(part.column(2)), words)
            n = np.diff(offs)
            doc = np.repeat(np.arange(len(n)), n)
            r = rank[h & np.uint64(COUNTERS - 1)]
            large = (n >= t.least(below))[doc]
            cold = np.flatnonzero(large & (r == 0))
            have = np.bincount(doc[cold], minlength=len(n))
            slack = have - np.minimum(have, t.drops(n) + 1)
            # sets with too few other elements list common ones, the least common first
            lacks = np.where(n >= t.least(below), np.maximum(t.drops(n) + 1 - have, 0), 0)
            hot = np.flatnonzero(large & (r > 0) & (lacks[doc] > 0))
            hot = hot[np.lexsort((h[hot], r[hot], doc[hot]))]
            first = np.searchsorted(doc[hot], doc[hot])
            hot = hot[np.arange(len(hot)) - first < lacks[doc[hot]]]
            direct = np.stack([doc[hot], signed(h[hot])], axis=1).astype(np.int64) if len(hot) else np.empty((0, 2), np.int64)
            x = mix(h[cold])
            bucket = ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            which, ends = _grouped(order, bucket[order])
            number = task + at
            rows = [pa.array(np.append(which, -1).astype(np.int32)), pa.array(np.full(len(which) + 1, number))]
            low, place = x[order].astype(np.uint32), doc[cold][order].astype(np.uint32)
            own = (set_names(h, offs), slack.astype(np.uint32), direct)
            cols = [pa.concat_arrays([_binaries(v, ends), pa.array([o.tobytes()], pa.binary())]) for v, o in zip((low, place), own, strict=False)]
            yield pa.RecordBatch.from_arrays([*rows, *cols, pa.array([None] * len(which) + [direct.tobytes()], pa.binary())], names)

    return _keyed(docs).mapInArrow(run, _ENTRY)


def shared_entries(entries: DataFrame, buckets: int) -> DataFrame:
    """The entries whose element is in two documents or more, with freq; slices' own rows as they are."""
    names = ["bucket", "slice", "low", "place", "freq"]

    def counted(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(group).combine_chunks()
        if table.column(0)[0].as_py() < 0:
            yield from group
            return
        low, offs = _flat(table.column(2).chunk(0), np.uint32)
        place, _ = _flat(table.column(3).chunk(0), np.uint32)
        order = np.argsort(low)
        s = low[order]
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(new, len(s))).astype(np.uint32)
        freq = np.empty(len(low), np.uint32)
        freq[order] = np.repeat(count, count)
        at = np.flatnonzero(freq > 1)
        row = np.searchsorted(offs, at, "right") - 1
        which, ends = _grouped(at, row)
        if len(which):
            yield pa.RecordBatch.from_arrays([table.column(0).chunk(0).take(pa.array(which)), table.column(1).chunk(0).take(pa.array(which)), *(_binaries(v[at], ends) for v in (low, place, freq))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 0):
            yield from counted(group)

    # a slice's own row has no bucket, and may lie anywhere
    dealt = entries.repartitionById(min(buckets, partitions(entries.sparkSession)), F.pmod(F.when(F.col("bucket") < 0, _spread()).otherwise(F.col("bucket")), F.lit(min(buckets, partitions(entries.sparkSession)))).cast("int"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, _ENTRY)


def _spread() -> Column:
    """Slices are numbered by task and then by place in it: neighbours go to different partitions."""
    return F.shiftright("slice", 32) + F.col("slice").bitwiseAND((1 << 32) - 1) * 7


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of binaries, offsets)."""
    data, offs = string_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=kind), offs // np.dtype(kind).itemsize


def element_lists(shared: DataFrame) -> DataFrame:
    """(node, key) of the large sets in their elements' lists: each set's first elements, by frequency, that are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 1):
            table = pa.Table.from_batches(group).combine_chunks()
            bucket = table.column(0).to_numpy()
            own = int(np.flatnonzero(bucket < 0)[0])
            nodes = np.frombuffer(table.column(2)[own].as_py(), np.int64)
            slack = np.frombuffer(table.column(3)[own].as_py(), np.uint32).astype(np.int64)
            direct = np.frombuffer(table.column(4)[own].as_py(), np.int64).reshape(-1, 2)
            rest = table.filter(pa.array(bucket >= 0)).combine_chunks()
            out_node, out_key = [nodes[direct[:, 0]]], [direct[:, 1]]
            if rest.num_rows:
                low, offs = _flat(rest.column(2).chunk(0), np.uint32)
                place = _flat(rest.column(3).chunk(0), np.uint32)[0].astype(np.int64)
                freq, _ = _flat(rest.column(4).chunk(0), np.uint32)
                key = np.repeat(rest.column(0).to_numpy().astype(np.uint64), np.diff(offs)) << np.uint64(32) | low
                lists = np.bincount(place, minlength=len(nodes)) - slack  # how many of its shared elements a set lists
                some = np.flatnonzero((lists > 0)[place])
                some = some[np.lexsort((key[some], freq[some], place[some]))]
                p = place[some]
                some = some[np.arange(len(some)) - np.searchsorted(p, p) < lists[p]]
                out_node.append(nodes[place[some]]), out_key.append(signed(mix(key[some])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_node, out_key)], ["node", "key"])

    n = partitions(shared.sparkSession)
    return shared.repartitionById(n, F.pmod(_spread(), F.lit(n)).cast("int")).sortWithinPartitions("slice").mapInArrow(run, "node long, key long")


def subset_lists(surveyed: DataFrame, t: Threshold, below: int) -> DataFrame:
    """(node, key) of the small sets by the subsets that they enumerate."""
    small = surveyed.where(f"kind = 0 AND n > 0 AND n < {below}").groupBy("key").agg(F.first("items").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(items, np.uint64)
                keys = subset_keys(h, t.drops(len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), node, np.int64)), pa.array(signed(keys))], ["node", "key"])

    return small.mapInArrow(run, "node long, key long")


# ----------------------------------------------------------- verification


def sets_of(docs: DataFrame, surveyed: DataFrame, nodes: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, items): the sorted hashes of each named set, from one document that has it."""
    want = surveyed.where("kind = 0").withColumnRenamed("key", "node").join(checked_broadcast(nodes), "node", "left_semi").groupBy("node").agg(F.min(F.struct("rk", "doc_id")).alias("x"))
    want = checked_broadcast(scratch.table(want.select("node", F.col("x.rk").alias("k"), F.col("x.doc_id").alias("id")), "want"))
    found = _keyed(docs).join(want, (F.col("rk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, offs = shingle_sets(*string_bytes(part.column(1)), words)
            same = pa.array(set_names(h, offs) == part.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(0), _binaries(h, offs)], ["node", "items"]).filter(same)

    return found.mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The linked ones of pairs (a, b), by their whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "x"):
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(t.linked(int((y[at] == x).sum()), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, info: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow: whole sets are joined only to these. info: node, n, sketch."""
    side = lambda k: info.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * t.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if len(x) != len(y):
                    size = min(len(x), len(y))
                    x, y = (folded(np.frombuffer(z, np.uint8), size).tobytes() for z in (x, y))
                keep.append((int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= t.apart(min(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node with an edge; label is the component's smallest node.

    Each round a node takes the smallest label among its own and its neighbours' and then that label's label; rounds
    end when no label changes. Edges are first thinned to a forest within each partition. Every round is a written table;
    labels are sent to all workers where they are counted to be few, so that a hub's edges need not meet in one task.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch at a time: memory is bounded, and a forest of a part loses no connection
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = up[y]
                    x = up[x]
                return x

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["a", "b"])

    thin = scratch.table(edges.select("a", "b").mapInArrow(forest, "a long, b long").where("a != b").distinct(), "edges")
    both = thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(checked_broadcast(labels.select(F.col("node").alias("b"), F.col("label").alias("l"))), "b").groupBy("a").agg(F.min("l").alias("m"))
        took = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        took = scratch.table(took, "labels")
        jumped = took.join(checked_broadcast(took.select(F.col("node").alias("label"), F.col("label").alias("next"))), "label").select("node", "old", F.least("label", "next").alias("label"))
        jumped = scratch.table(jumped, "labels")
        scratch.drop(labels, took)
        labels = jumped
        if jumped.where("old != label").isEmpty():
            scratch.drop(thin)
            return jumped.select("node", "label")


def in_blocks(members: DataFrame, columns: list[str], judge, out: str) -> DataFrame:
    """judge(rows of one block, or of two that meet; the blocks i and j) over every two members of each list `key`.

    Lists over BLOCK members are cut into blocks, and a member goes to the groups of its own and each other block. judge
    gets arrays of `columns` and two index arrays, the rows to be held against each other, and returns arrays for `out`.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("_g"))
    dealt = members.join(sizes, "key").withColumn("_blocks", F.ceil(F.col("_g") / F.lit(BLOCK)).cast("int")).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("key", (F.least("_b", "_o") * F.col("_blocks") + F.greatest("_b", "_o")).alias("pair"), F.col("_b").alias("block"), *columns)
    met = met.repartition(partitions(members.sparkSession), "key", "pair").withColumn("group", F.xxhash64("key", "pair")).sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 0):
            t = pa.Table.from_batches(group).combine_chunks()
            block = t.column(1).to_numpy()
            # rows of the lower block against those of the higher; within one block, all against all
            yield judge(t, np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()))

    return met.select("group", "block", *columns).mapInArrow(run, out)


def hopeful(members: DataFrame, t: Threshold) -> DataFrame:
    """(key, node) of members (key, node, label, n, sketch) for which size and sketch allow a link across components."""

    def judge(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        label, n = table.column(4).to_numpy(), table.column(5).to_numpy()
        sk = table.column(6).to_pylist()
        size = min(map(len, sk))
        cells = np.stack([folded(np.frombuffer(x, np.uint8), size) for x in sk])
        found = np.zeros(len(sk), dtype=bool)
        for a in left.tolist():
            lo, hi = np.minimum(n[right], n[a]), np.maximum(n[right], n[a])
            other = right[(label[right] != label[a]) & (100 * lo >= t.percent * hi)]
            if len(other):
                far = np.bitwise_count(cells[other] ^ cells[a]).sum(axis=1, dtype=np.int64)
                other = other[far <= t.apart(np.minimum(n[other], n[a]))]
                found[other] = True
                found[a] |= len(other) > 0
        return pa.RecordBatch.from_arrays([table.column(k).combine_chunks().filter(pa.array(found)) for k in (2, 3)], ["key", "node"])

    return in_blocks(members.withColumn("list", F.col("key")), ["list", "node", "label", "n", "sketch"], judge, "key long, node long").distinct()


def links_across(members: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) between components, by whole sets: enough of them to connect what any link connects within a block.

    members: key, node, label, items. Common elements are counted by products of incidence matrices, COLUMNS at a time.
    """

    def judge(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        node, label = table.column(2).to_numpy(), table.column(3).to_numpy()
        flat, offs = _flat(table.column(4).combine_chunks(), np.uint64)
        n = np.diff(offs)
        row = np.repeat(np.arange(len(n)), n)
        _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[element]
        both = np.zeros((len(n), len(n)), dtype=np.float32)
        row, rank = row[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        row, rank = row[order], rank[order]
        for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
            x, y = np.searchsorted(rank, (low, low + COLUMNS))
            has = np.zeros((len(n), COLUMNS), dtype=np.float32)
            has[row[x:y], rank[x:y] - low] = 1
            both += has @ has.T
        both = both[np.ix_(left, right)].astype(np.int64)
        linked = (100 * both >= t.percent * (n[left][:, None] + n[right] - both)) & (label[left][:, None] != label[right])
        up = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for a, b in zip(*np.nonzero(linked), strict=True):
            a, b = int(left[a]), int(right[b])
            x, y = root(int(label[a])), root(int(label[b]))
            if x != y:
                up[x] = y
                out.append((int(node[a]), int(node[b])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return in_blocks(members, ["node", "label", "items"], judge, "a long, b long").distinct()


def stars(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each list's pivot with its other members.

    The pivot is the member that meets most others over all its lists: among near copies that is the text they were made
    from, to which nearly all of them link, so that one round leaves little for the pairs of a list.
    """
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = lists.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = lists.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    return lists.join(pivots, "key").where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def classes(docs: DataFrame, percent: int, words: int, scratch: Scratch) -> DataFrame:
    """doc_id, rk, n and label (shared by all rows that links connect; null for rows without words) of every row."""
    t = Threshold(percent)
    surveyed = scratch.table(survey(docs, words, docs.count()), "sets")
    rank, elements, sizes, list_length = statistics(surveyed)
    below = boundary(sizes, list_length, t)
    parts = partitions(docs.sparkSession)
    buckets = parts * max(1, -(-elements // (BUCKET * parts)))
    shared = shared_entries(element_entries(docs, t, words, below, rank, buckets), buckets)
    entries = scratch.table(element_lists(shared).unionByName(subset_lists(surveyed, t, below)), "entries")
    both = entries.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("key")
    lists = scratch.table(entries.join(both, "key", "left_semi").distinct(), "lists")
    scratch.drop(entries)
    named = scratch.table(lists.select("node").distinct(), "nodes")
    info = surveyed.where("kind = 0").select(F.col("key").alias("node"), "n", "sketch")
    info = scratch.table(info.join(checked_broadcast(named), "node", "left_semi").dropDuplicates(["node"]), "info")
    near = scratch.table(plausible(stars(lists), info, t), "near")
    ends = scratch.table(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "ends")
    links = scratch.table(verified(near, sets_of(docs, surveyed, ends, words, scratch), t), "links")
    scratch.drop(ends)
    labels = components(links, scratch)
    marked = lists.join(checked_broadcast(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_ = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    across = scratch.table(marked.join(open_, "key", "left_semi"), "across")
    rest = scratch.table(hopeful(across.join(info, "node"), t), "rest")
    if not rest.isEmpty():
        ends = scratch.table(rest.select("node").distinct(), "ends")
        members = rest.join(across, ["key", "node"]).join(sets_of(docs, surveyed, ends, words, scratch), "node")
        more = scratch.table(links_across(members, t), "links")
        scratch.drop(ends)
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)
    scratch.drop(near, across)
    scratch.drop(lists, named, info, links, rest)
    sets = surveyed.where("kind = 0").select("doc_id", "rk", F.col("key").alias("node"), "n")
    return sets.join(checked_broadcast(labels), "node", "left").select("doc_id", "rk", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def join(docs: DataFrame, percent: int = 90, words: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, rk, n_shingles and component_id (the smallest doc_id that links reach) of every row.

    Defined cases: a null or wordless text has n_shingles 0 and links to nothing; equal sets link; repeated rows each
    give a row; a null doc_id takes part, but never names a component that has another id; no rows give none; other
    columns are not read. Shingles are compared by 64-bit hashes.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = classes(docs, percent, words, scratch)
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("label", "least")
    least = checked_broadcast(scratch.table(least, "least"))
    alone = F.coalesce("least", "doc_id")
    return rows.join(least, "label", "left").select("doc_id", "rk", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    return join(docs, 90, 3).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """One row of each component, in the columns given: that of the smallest doc_id; null ids come last, then the text decides.

    Rows of equal id and text are one; rows without words stay, but for such repeats. The rows to drop are few against the
    texts: they are sent to the texts, if counted to be small, and not the other way.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(classes(docs, percent, words, scratch), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    first = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = checked_broadcast(scratch.table(first.select("label", F.col("x.doc_id").alias("first"), F.col("x.rk").alias("frk")), "first"))
    key = [F.col("doc_id").alias("id"), F.col("rk").alias("k")]
    drop = checked_broadcast(scratch.table(rows.join(first, "label").where((F.col("rk") != F.col("frk")) | ~F.col("doc_id").eqNullSafe(F.col("first"))).select(*key).distinct(), "drop"))
    twice = scratch.table(rows.groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*key), "twice")
    keyed = renamed(docs).withColumn("own", renamed_column(docs, "doc_id").cast("long")).withColumn("own_rk", F.xxhash64(renamed_column(docs, "doc_id"), renamed_column(docs, "text")))
    same = (F.col("own_rk") == F.col("k")) & F.col("own").eqNullSafe(F.col("id"))
    kept = keyed.join(drop, same, "left_anti")
    if not twice.isEmpty():
        twice = checked_broadcast(twice)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["own", "own_rk"]))
    return kept.drop("own", "own_rk").toDF(*docs.columns)
