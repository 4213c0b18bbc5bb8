"""Byte-level BPE against the tiktoken library."""

import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cytoplane.llm import bytebpe as b


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.read_ranks(b.vocabulary_path()), special_tokens={})


CODER = b.ByteIds(b.vocabulary_path())


def ids(text):
    data = CODER.encode([text])[0]
    return list(struct.unpack(f"<{len(data) // 4}I", data))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("abcAB 'stl\n\t\x85é中12,."), st.lists(st.sampled_from([t.decode("utf-8", "ignore") for t in CODER.coder.ranks])).map("".join)))
def test_same_ids(library, text):
    assert ids(text) == library.encode_ordinary(text)


def test_every_token_is_a_merge_of_two_before_it():
    assert all(CODER.coder.halves[t] is None or max(CODER.coder.halves[t]) < t for t in CODER.coder.ranks.values())


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 9_999, "\n " * 5_000, "x  y   z ", "'S's'LL", "\U00010940ab՘", "  　x", "ｱ" * 3000])
def test_long_and_odd_texts(library, text):
    assert ids(text) == library.encode_ordinary(text)


def test_backtracking_alone_gives_the_same(library):
    text = "".join(t.decode("utf-8", "ignore").strip() for t in list(CODER.coder.ranks)[300:2000:7])
    for piece in library.decode_tokens_bytes(list(range(400, 900))) + [text.encode(), b"\xff\xfe" * 50]:
        assert CODER.coder._backtrack(piece.decode("latin-1")) == CODER.coder.ids(piece)


def test_small_memos_change_nothing(library):
    small = b.ByteIds(b.vocabulary_path(), entries=2)
    for text in ("the cat sat on the mat", "unbelievably incomprehensible nonsensewords"):
        assert list(struct.unpack(f"<{len(library.encode_ordinary(text))}I", small.encode([text])[0])) == library.encode_ordinary(text)


def test_a_vocabulary_without_merges_of_two_is_refused():
    bad = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError, match="not a merge"):
        b.Backtracker(bad).halves[256]


def test_documents(spark, make, odd, library):
    docs = make(odd, ids=[*range(len(odd) - 1), None])
    got = b.decode(b.encode(docs)).collect()
    want = sorted((struct.pack(f"<{len(i)}I", *i), (t or "").encode()) for t in odd for i in [library.encode_ordinary(t or "")])
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(len(odd) - 1))
    assert b.decode(b.encode(docs.limit(0))).count() == 0
