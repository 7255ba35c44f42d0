from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from captionlake.llm import packing, sentence_pieces

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.one_of(st.text(max_size=80), st.text(alphabet="abeinrst  \n\t .,'1é", max_size=80), st.lists(st.sampled_from(["the", "ing", "erst", "  ", " ", "\n\n ", "it's", "▁", "aaaa", "<|endoftext|>", "　 x"]), max_size=12).map("".join))
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_chunked_ids_are_the_librarys(text):
    ids = packing.ids_of(BPE)
    assert ids.encode(text) == ids.whole(text)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_streamed_pieces_are_the_librarys(text):
    m = sentence_pieces.model(PIECES)
    ids = m.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == SP.encode(text)
    if "▁" not in text:
        assert m.decode(ids) == text


@given(st.text(alphabet="abcdefghiaaeinrst", min_size=60, max_size=400))
@settings(max_examples=100, deadline=None)
def test_long_words_are_committed_early(text):
    m = sentence_pieces.model(PIECES)
    seen = list(m.stream("▁" + text))
    assert [i for _, ids in seen for i in ids] == SP.encode(text) and seen[0][0] < 60


def test_ordinary_documents_run_through_a_small_window():
    """Whole documents, without the table of words: ids come as soon as paths meet, and the window stays small."""
    import pyarrow.parquet as pq

    m = sentence_pieces.model(PIECES)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist() if t and "▁" not in t][:40]
    longest, early, total = max(map(len, m.ids)), 0, 0
    for text in texts:
        marked, w, out = "▁" + text.replace(" ", "▁"), sentence_pieces.Window(m), []
        for at, c in enumerate(marked, 1):
            ids = w.read(c)
            out += ids
            total += len(ids)
            early += len(ids) * (at < len(marked) and marked[at] != "▁")
            assert w.at - w.done <= 2 * longest + 2 and len(w.back) <= 2 * longest + 2
        assert out + w.rest() == SP.encode(text) == np.frombuffer(m.encode(text), "<u4").tolist()
    assert early > total / 3  # most ids are certain before the word ends


def check_packing(lengths, capacity):
    counts = Counter(lengths)
    patterns = packing.pack_counts(counts, capacity)
    used = Counter()
    for bins, items in patterns:
        assert bins > 0 and sum(w * n for w, n in items) <= capacity
        for w, n in items:
            used[w] += bins * n
    assert used == counts
    return sum(bins for bins, _ in patterns)


def fewest(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_reduction_keeps_a_best_packing(lengths):
    counts = np.bincount(lengths, minlength=21)
    fixed = packing.reduce_dominated(counts, 20)
    rest = [w for w in range(21) for _ in range(counts[w])]
    assert sum(n for n, _ in fixed) + (fewest(rest, 20) if rest else 0) == fewest(lengths, 20)
    check_packing(lengths, 20)


@given(st.lists(st.integers(1, 50), max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_fit_is_the_one_by_one_rule(lengths):
    rooms = []
    for w in sorted(lengths, reverse=True):
        k = min((r, i) for i, r in enumerate(rooms) if r >= w)[1] if any(r >= w for r in rooms) else None
        if k is None:
            rooms.append(50 - w)
        else:
            rooms[k] -= w
    patterns = packing.best_fit(np.bincount(lengths, minlength=51), 50)
    got = Counter()
    for n, items in patterns:
        got[50 - sum(w * c for w, c in items)] += n
    assert got == Counter(rooms)


@pytest.mark.parametrize("n,starts", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (4096, [(0, 2048), (2048, 2048)])])
def test_piece_starts(n, starts):
    assert packing.piece_starts(n, 2048) == starts


def test_packed_documents(spark):
    texts = [None, "", "a b", "same text", "same text", "word " * 5000, *["the cat sat " * k for k in range(1, 300, 7)]]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)] + [(3, "same text", 5, 6), (None, "x", 5, 6)], "doc_id long, text string, offset int, piece int")
    rows = packing.pack_documents(docs, BPE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 2048
    tokens = sum(r.length for r in rows)
    assert len(by) <= -(-tokens // 2048) + 1
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [r.length for r in long][1:] == [2048] * (len(long) - 1) and sum(r.length for r in long) == len(packing.ids_of(BPE).whole(texts[5])) // 4 + 1
    assert sum(r.doc_id == 3 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_pieces_of_odd_tables(spark):
    long = " ".join(f"word{k} and another" for k in range(30_000))
    rows = [(None, "a b", 1), (1, "same", 2), (1, "same", 2), (2, None, 3), (3, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int")
    got = sentence_pieces.digest(docs, PIECES).collect()
    assert sorted((r.doc_id or 0, r.n_ids) for r in got) == sorted([(0, len(SP.encode("a b"))), (1, len(SP.encode("same"))), (1, len(SP.encode("same"))), (2, 0), (3, len(SP.encode(long)))])
    assert sentence_pieces.digest(docs.limit(0), PIECES).count() == 0


def test_piece_digest(spark):
    texts = [None, "", " two  words\n", "x" * 500, "𠻹 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentence_pieces.digest(docs, PIECES).collect():
        assert r.exact and r.n_ids == len(SP.encode(texts[r.doc_id] or ""))
    assert sum(len(r.ids) for r in sentence_pieces.encode_documents(docs, PIECES).collect()) == sum(len(SP.encode(t or "")) for t in texts)
