"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model at hand is a BPE model, whose encoding is not the best-scored split. But it is the one path through the
lattice of pieces on which every two neighbours are compatible, that is, merging their joint text gives back just the
two. So the search runs over the same lattice with that condition in place of a sum of scores: each boundary keeps one
backpointer, namely the last piece of the encoding of the text up to there.

A window holds the boundaries that a later piece can still reach: those from which the text read so far begins some piece,
none further back than the longest piece, and those on the paths to them. Each boundary knows where its path leaves the
last certain one; as soon as all paths that a later piece can still continue leave it by the same piece, that piece is
certain, its id is committed, and what lies before its end goes. Characters outside the vocabulary are bytes and end every path. A text is read once, from left to right;
where the window is empty before a mark, what it committed for the same word before is taken from a table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import Memo, slices

MARK = "▁"
#: Pairs of pieces whose compatibility a worker remembers; about 100 bytes each.
MOST_PAIRS = 1_000_000


class Model:
    """Pieces, ranks and byte ids of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.bytes = {}, [0] * 256
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[sp.id_to_piece(i)] = i
        self.ranks = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.pieces = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word boundary")
        self.fits: dict[str, dict[str, bool]] = {p: {} for p in self.ids}  # piece -> whether it is compatible with a piece before it
        self.start = self._automaton()
        self.pairs = 0
        self.segments = Segments(self)

    def _automaton(self) -> list:
        """Nodes for the longest end of the text read so far that begins some piece. A node has the nodes of one more
        character, the pieces that end here, longest first, as (length, piece, its fits), how far back the boundaries lie
        from which a longer piece may come, furthest first, and the node of the next shorter such end."""
        start: list = [{}, (), (0,), None]
        for p in self.ids:
            node = start
            for c in p:
                node = node[0].setdefault(c, [{}, (), (), start])
            node[1] = ((len(p), p, self.fits[p]),)
        if any(c not in start[0] or not start[0][c][1] for p in self.ids for c in p):
            raise ValueError("a piece holds a character that is none itself")
        level, depth = [(c, start, node) for c, node in start[0].items()], 1
        while level:
            below = []
            for c, parent, node in level:
                shorter = parent[3]
                while shorter is not None and c not in shorter[0]:
                    shorter = shorter[3]
                node[3] = start if shorter is None else shorter[0][c]
                node[1] += node[3][1]
                node[2] = ((depth,) if node[0] else ()) + node[3][2]
                below += [(d, node, n) for d, n in node[0].items()]
            level, depth = below, depth + 1
        return start

    def merge(self, text: str) -> list[str]:
        """Plain BPE, for the joint text of two pieces: the best-ranked, then leftmost, pair first."""
        parts = list(text)
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == np.inf:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the encoding of the joint text is these two; b alone at the start."""
        if not a:
            return self.merge(b) == [b]
        return a + b not in self.ids and self.merge(a + b) == [a, b]  # a pair that is a piece merges

    def fit(self, fits: dict[str, bool], a: str, b: str) -> bool:
        """compatible(), kept in fits, which is b's; at most MOST_PAIRS are kept."""
        self.pairs += 1
        if self.pairs > MOST_PAIRS:
            self.pairs = 0
            for known in self.fits.values():
                known.clear()
        out = fits[a] = self.compatible(a, b)
        return out

    def stream(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(characters read, ids that this makes certain) of a marked text, and at its end the rest."""
        w = Window(self)
        for at, c in enumerate(text, 1):
            if ids := w.read(c):
                yield at, ids
        yield len(text), w.rest()

    def encode(self, text: str) -> bytes:
        """All ids, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.segments.__getitem__, _SEGMENTS.findall(MARK + text.replace(" ", MARK))))

    def decode(self, ids: bytes) -> str:
        """The text of the ids: bytes are joined, marks become spaces, and the dummy prefix goes."""
        out = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return out.replace(MARK, " ")[1:] if out.startswith(MARK) else out.replace(MARK, " ")


class Window:
    """The boundaries that the search still needs; see the module."""

    def __init__(self, m: Model) -> None:
        self.m, self.done = m, 0
        self._empty("")

    @property
    def at(self) -> int:
        """Characters read."""
        return self.done + len(self.back) - 1

    def _empty(self, tail: str) -> None:
        """Everything read is certain; tail is the piece that ends there, or nothing after bytes."""
        self.back = [tail]  # boundary, counted from `done` -> last piece of the encoding up to it
        self.first = [0]  # boundary -> the first one on the path to it from `done`
        self.node = self.m.start

    def read(self, text: str) -> list[int]:
        """Read on; the ids that are certain now and were not before."""
        m, start, ids, out = self.m, self.m.start, self.m.ids, []
        back, first, node, n = self.back, self.first, self.node, len(self.back) - 1
        for c in text:
            after = node[0].get(c)
            while after is None and node is not start:
                node = node[3]
                after = node[0].get(c)
            if after is None:
                out += self.rest()
                out += [m.bytes[b] for b in c.encode()]
                self.done += n + 1
                self._empty("")
                back, first, n = self.back, self.first, 0
                continue
            node = after
            n += 1
            for size, piece, fits in node[1]:
                a = back[n - size]
                fit = fits.get(a)
                if fit is None:
                    fit = m.fit(fits, a, piece)
                if fit:
                    break
            else:
                raise ValueError("no piece fits")
            back.append(piece)
            first.append(first[n - size] or n)
            open_ends = node[2]
            while open_ends[0] < n:
                k = first[n]
                for d in open_ends:
                    if first[n - d] != k:
                        break
                else:
                    d = -1
                if d >= 0:
                    break
                out.append(ids[back[k]])
                del back[:k], first[:k]
                n -= k
                self.done += k
                first[0] = 0
                for i in range(1, n + 1):  # a path that leaves before `done` stays at no boundary: nothing hangs on it
                    s = i - len(back[i])
                    first[i] = -1 if s < 0 else first[s] or i
        self.node = node
        return out

    def rest(self) -> list[int]:
        """The ids that are certain if the text ends here."""
        out, end = [], len(self.back) - 1
        while end > 0:
            out.append(self.m.ids[self.back[end]])
            end -= len(self.back[end])
        return out[::-1]


class Segments(Memo):
    """A word with its mark -> the ids that an empty window commits for it when the next mark comes."""

    def __init__(self, m: Model) -> None:
        super().__init__(900_000)  # words are many; about 400 MB a worker
        self.model = m

    def compute(self, key: str) -> bytes:
        w = Window(self.model)
        if key[-1] == MARK:  # marks at the end of a text
            ids = w.read(key) + w.rest()
        else:
            ids = w.read(key + MARK)
            if w.done != len(key):
                raise ValueError("paths do not meet before a mark")
        return array("I", ids).tobytes()


_SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@cache
def model(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids (array<int>) of every whole text; see digest() for the defined cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in slices(batches):
            ids = [np.frombuffer(m.encode(x or ""), dtype="<i4") for x in part.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_ids, ids_crc32, decoded_sha256 and exact (whether decoding gives the text back).

    Defined cases: a null text is empty (no ids); a null doc_id stays null; repeated rows each give a row; no rows give
    none; other columns are not read; a text that holds the mark itself decodes to a space there, and so is not exact.
    """
    names = ["doc_id", "n_bytes", "n_ids", "ids_crc32", "decoded_sha256", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            for text in part.column(1).to_pylist():
                text = text or ""
                ids = m.encode(text)
                out = m.decode(ids)
                for col, x in zip(cols, (len(text.encode()), len(ids) // 4, zlib.crc32(ids), hashlib.sha256(out.encode()).hexdigest(), out == text), strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
