import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cytoplane.llm import bpe, packing
from cytoplane.llm.tokens import ChunkIds, Merger, vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())
MERGER = Merger(vocabulary_path())
WORDS = sorted({b"the", b"then", b"there", b"a", b"an", b"other", "è".encode(), b"thereby"})
LEXICON = bpe.compile_lexicon((w, tuple(MERGER.ids(w))) for w in WORDS)
CODERS = [bpe.Coder(vocabulary_path(), x) for x in (LEXICON, None, bpe.compile_lexicon([]))]
CHUNKS = ChunkIds(vocabulary_path())


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def same(text):
    want = library(text)
    for coder in CODERS:
        assert coder.encode(text) == want
        assert coder.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)
        n, ids, decoded = coder.digests([text])
        assert n == [len(want)]
        assert ids == [hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()]
        assert decoded == [hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()]
    assert CHUNKS.encode([text]) == [struct.pack(f"<{len(want)}I", *want)]


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b<|startoftext|>", "ΑΣ Σ İ ǅ ﬀ ẞ", "don't we'll I'D", "12３ ④ 👍🏽", "é é ́a", "x\x1cy z　q", "a" * 3000])
def test_same_as_the_library(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("abnthe", max_size=50), st.text(max_size=6)), max_size=30))
def test_merges_of_many_words(words):
    words = [w.encode() for w in words]
    assert MERGER.many(words) == [MERGER.ids(w) if w else [] for w in words]


def test_many_texts_through_small_memos():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abehnt'.,1éΣ", k=rng.randint(1, 5))) for _ in range(60)) for _ in range(40)]
    texts += ["the <|endoftext|>x 👍🏽y the", "", "the"]
    coder = ChunkIds(vocabulary_path(), 100)
    for at in range(0, len(texts), 3):
        want = [library(x) for x in texts[at : at + 3]]
        assert coder.encode(texts[at : at + 3]) == [struct.pack(f"<{len(x)}I", *x) for x in want]
        assert CODERS[0].digests(texts[at : at + 3])[0] == [len(x) for x in want]


def test_lexicon_shares_and_refuses():
    lexicon = bpe.Lexicon(LEXICON)
    assert lexicon.look_up(WORDS) == [MERGER.ids(w) for w in WORDS]
    assert lexicon.look_up([b"th", b"theree", b"", b"z" * 100]) == [None] * 4
    assert lexicon.states() < sum(map(len, WORDS))


def test_encode_query_on_odd_rows(make, odd):
    docs = make(odd)
    rows = bpe.encode_decode(docs, bpe.fit_lexicon(docs)).collect()
    want = sorted((i, len(library(t or ""))) for i, t in enumerate(odd))
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == want
    back = {r.doc_id: r for r in bpe.encode_ids(docs, b"").collect()}
    assert [back[i].ids for i in range(len(odd))] == [library(t or "") for t in odd]
    assert bpe.encode_decode(docs.limit(0), bpe.fit_lexicon(docs.limit(0))).count() == 0


def check_packing(rows, texts, ids, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in zip(ids, texts):
        want = library(text or "") + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(range(0, len(want), capacity))
        for p in pieces:
            part = want[p.start : p.start + capacity]
            assert (p.length, p.ids_crc32) == (len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        assert sum(r.length for r in held) <= capacity


def test_packing_rows(make, odd):
    rows = packing.pack_documents(make(odd)).collect()
    check_packing(rows, odd, range(len(odd)), packing.CAPACITY)
    assert packing.pack_documents(make([])).count() == 0


def test_packing_repeated_rows(make):
    rows = packing.pack_documents(make(["a b c"] * 5, ids=[1, 1, None, None, 2])).collect()
    assert sorted((r.sequence_id, r.offset) for r in rows) == [(0, 4 * k) for k in range(5)]


@pytest.mark.parametrize("low,high,n", [(1, 4096, 20_000), (1, 300, 5000), (4096, 4096, 7), (1500, 4096, 4000), (1, 1, 3)])
def test_plan_covers_everything_and_wastes_little(low, high, n):
    draw = random.Random(5)
    counts = {}
    for _ in range(n):
        x = draw.randint(low, high)
        counts[x] = counts.get(x, 0) + 1
    lines, sequences = packing.plan(counts)
    fill, at = {}, 0
    order = [x for x in sorted(counts, reverse=True) for _ in range(counts[x])]
    for position, m, first, offset in lines.tolist():
        assert position == at
        at += m
        for k in range(m):
            fill.setdefault(first + k, []).append((offset, order[position + k]))
    assert at == n and sorted(fill) == list(range(sequences))
    for held in fill.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    if high > 3 * low:  # with large lengths only, a sequence cannot be filled
        assert sequences <= 1.02 * sum(order) / 4096 + 1
