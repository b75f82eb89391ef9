"""Encoding, sequence files and piece counts against the library and plain loops."""

import hashlib
import os
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionlog.llm import arrowseq, bpe, wordpiece


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_digests(docs, texts, vocabulary, library, empty):
    want = Counter()
    for i, t, _ in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert rows_of(bpe.encode_digests(docs, vocabulary)) == want
    assert bpe.encode_digests(empty, vocabulary).count() == 0


def test_ids_as_arrays(docs, texts, vocabulary, library):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["tk"]) for r in bpe.encode(docs, vocabulary, ["tk"]).collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), "tk") for i, t, _ in texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "a", "B", "é", "1", "'s", "'",
                                 "!", "<|endoftext|>", "日", "🙂", "abc", " the"]), max_size=14))
def test_any_white_space(vocabulary, library, parts):
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    for encoder in (bpe.rank_array_encoder(vocabulary)[0], bpe.library_encoder(vocabulary)):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


def test_long_words_by_heap(vocabulary, library):
    word = "".join(chr(97 + i * i % 26) for i in range(3000))
    ids = bpe.RankArrays(vocabulary).encode_words([word.encode()])[word.encode()]
    assert ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_sequence_files(docs, texts, vocabulary, library, empty):
    folder = tempfile.mkdtemp(prefix="sequences-")
    manifest = arrowseq.write_sequences(docs, vocabulary, folder, length=64, batch_rows=4, partitions=3)
    start, want = 0, Counter()
    stream = []
    for i, t, _ in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, start, len(ids), zlib.crc32(u32(ids))] += 1
        start += len(ids)
        stream += ids
    assert rows_of(arrowseq.read_documents(manifest)) == want
    # Sequences and masks of the files, one after the other, are the whole stream.
    seen = []
    for row in manifest.orderBy("part").collect():
        file = arrowseq.SequenceFile(row["ids_file"])
        for i in range(row["n_sequences"]):
            ids, mask = file.sequence(i)
            assert len(ids) == 64 and mask.sum() == len(mask) or i == row["n_sequences"] - 1
            seen += ids[mask].tolist()
    assert seen == stream
    none = arrowseq.write_sequences(empty, vocabulary, os.path.join(folder, "none"))
    assert none.count() == 0 and arrowseq.read_documents(none).count() == 0


def greedy(word, pieces, inner):
    at, n = 0, 0
    while at < len(word):
        fit = [k for k in range(1, len(word) - at + 1) if word[at:at + k] in (inner if at else pieces)]
        if not fit:
            return 0
        at, n = at + max(fit), n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4)), st.sets(st.text("abc", min_size=1, max_size=4)),
       st.lists(st.text("abcd", max_size=9), max_size=20))
def test_automaton(pieces, inner, found):
    both = {p.encode() for p in pieces}, {p.encode() for p in inner}
    one, two = wordpiece.PieceAutomaton(both[0]), wordpiece.PieceAutomaton(*both)
    for w in map(str.encode, found):
        assert one.count(w) == greedy(w, both[0], both[0])
        assert two.count(w) == greedy(w, *both)


def test_piece_counts(docs, texts, vocabulary, empty):
    pieces = set(wordpiece.vocabulary(vocabulary))
    want = Counter()
    for i, t, _ in texts:
        found = (t or "").encode().split()
        want[i, len(found), sum(greedy(b" " + w, pieces, pieces) for w in found), 0] += 1
    assert rows_of(wordpiece.token_counts(docs, vocabulary)) == want
    assert wordpiece.token_counts(empty, vocabulary).count() == 0


def test_the_cache_is_not_walked_for_each_batch():
    """A batch looks its own words up; how many others are known does not matter."""
    class Known(dict):
        def keys(self):
            raise AssertionError("walks all known words")

    encoder = bpe.CachedEncoder(lambda words: [w.encode() for w in words], {})
    encoder.cache = Known()
    assert encoder.encode(["a b", "b\tc d", None]) == encoder.encode(["a b", "b\tc d", None])
