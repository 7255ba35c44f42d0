"""Token counts by a whole-token shortcut.

Offline, every vocabulary string that ends a word is put through the library by itself; those that come back as just
their own id are proved single. Texts are cut at white space (no pre-token of these tokenizers crosses it), then by the
tokenizer's own pre-tokenizer; a pre-token among the proved strings counts as one, and only the rest is merged by the
library. Texts that hold a special token's string (or one of four separators on which
the two notions of white space differ) go to the library whole, which treats them by its default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.common import Memo, slices

#: White space to str.split(), but not to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


@cache
def library(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@cache
def proved_single(path: str) -> frozenset[str]:
    """Pre-tokens (in the byte alphabet of the pre-tokenizer) that are one token by proof, not by assumption."""
    tok = library(path)
    end = getattr(tok.model, "end_of_word_suffix", None) or ""
    out = set()
    for piece in tok.get_vocab():
        if piece.endswith(end) and (bare := piece[: len(piece) - len(end)]) and [t.value for t in tok.model.tokenize(bare)] == [piece]:
            out.add(bare)
    return frozenset(out)


class Counter(Memo):
    """chunk -> number of tokens, filled as chunks come up."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tok, self.single = library(path), proved_single(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def compute(self, key: str) -> int:
        text = self.tok.normalizer.normalize_str(key) if self.tok.normalizer is not None else key
        return sum(1 if piece in self.single else len(self.tok.model.tokenize(piece)) for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials) or _ODD.search(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, text.split()))


@cache
def counter_of(path: str) -> Counter:
    """One table for all tasks of a Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Defined cases: a null text is empty (0 tokens); a null doc_id stays null; repeated rows each give a row; no rows
    give none; other columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for part in slices(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            counts = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array((len(x.encode()) for x in texts), pa.int64()), pa.array(counts, pa.int64()), pa.array((n > limit for n in counts), pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
