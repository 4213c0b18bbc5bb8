"""Byte-level BPE by longest matches and backtracking.

Bytes are read as Latin-1 letters, so that an Aho-Corasick automaton over the vocabulary finds, for every start, the
longest token there. A row of tokens is what the ranked merges would give exactly if every two neighbours are
compatible: encoded together they come out as these two. So the longest matches are taken from left to right; where two
neighbours are not compatible, a shorter prefix is tried, and a position from which nothing leads on is never entered
again. Whether two tokens are compatible follows from their edges: the tokens that stood at the seam while both were
built. Each pair is settled once and kept, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import MEMO_ENTRIES, Memo, slices

FILE = "byte_bpe_50k.tiktoken"
_NEVER = 1 << 62
#: A character that is no letter, number or space in any version of Unicode.
_OTHER = "�"


def vocabulary_path(name: str = FILE) -> str:
    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Backtracker:
    """Ids of a byte string that is encoded as one piece."""

    def __init__(self, ranks: dict[bytes, int], entries: int = MEMO_ENTRIES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.found = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.found.add_word(token.decode("latin-1"), rank)
        self.found.make_automaton()
        # One entry per token each, so bounded by the vocabulary.
        self.shorter, self.halves = Memo(self._shorter, _NEVER), Memo(self._halves, _NEVER)
        self.left, self.right = Memo(self._left, _NEVER), Memo(self._right, _NEVER)
        self.fits = Memo(self._fits, entries)

    def ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        letters, tokens, fits = piece.decode("latin-1"), self.tokens, self.fits
        greedy = [rank for _, rank in self.found.iter_long(letters)]
        if all(fits[pair] for pair in zip(greedy, greedy[1:])) and sum(len(tokens[x]) for x in greedy) == len(piece):
            return greedy
        return self._backtrack(letters)

    def _backtrack(self, letters: str) -> list[int]:
        size, tokens, shorter, fits = len(letters), self.tokens, self.shorter, self.fits
        longest: list[int | None] = [None] * size
        for last, rank in self.found.iter(letters):
            # Matches that end later are longer than those before with the same start.
            longest[last + 1 - len(tokens[rank])] = rank
        dead, out, at = bytearray(size + 1), [], 0
        token = longest[0]
        while at < size:
            while token is not None:
                end = at + len(tokens[token])
                if not dead[end] and (not out or fits[out[-1], token]):
                    break
                token = shorter[token]
            if token is None:
                if not out:
                    raise ValueError("the vocabulary does not hold every byte")
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < size else None
        return out

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        data = self.tokens[token]
        return next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte."""
        data = self.tokens[token]
        if len(data) == 1:
            return None
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= token:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        a, b = (self.ranks.get(x, _NEVER) for x in parts) if len(parts) == 2 else (_NEVER, _NEVER)
        if max(a, b) >= token:
            raise ValueError(f"token {token} is not a merge of two tokens before it")
        return a, b

    def _left(self, token: int) -> list[int]:
        """The tokens at the left edge while this one was built, oldest first."""
        halves = self.halves[token]
        return [*self.left[halves[0]], token] if halves else [token]

    def _right(self, token: int) -> list[int]:
        halves = self.halves[token]
        return [*self.right[halves[1]], token] if halves else [token]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave the two tokens apart.

        Merges happen in order of rank, of equals the left one first. At each moment one token ends at the seam and one
        begins there; they would merge if that comes before the next merge on either side.
        """
        before, after = self.right[pair[0]], self.left[pair[1]]
        i = j = 0
        while True:
            across = self.ranks.get(self.tokens[before[i]] + self.tokens[after[j]], _NEVER)
            next_before = before[i + 1] if i + 1 < len(before) else _NEVER
            next_after = after[j + 1] if j + 1 < len(after) else _NEVER
            if across < next_before and across <= next_after:
                return False
            if next_before == next_after == _NEVER:
                return True
            if next_before <= next_after:
                i += 1
            else:
                j += 1


class Pieces:
    """The matches of the vocabulary's pattern, with classes of characters as the tiktoken library has them."""

    def __init__(self):
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # For white space both libraries agree; a text cut before single spaces gives the same matches part by part.
        self.uneven = regex.compile(r" \s| \Z")
        alone = {bytes([i]): i for i in range(256)}
        self.library = tiktoken.Encoding("letters", pat_str=r"\p{L}|\p{N}", mergeable_ranks=alone, special_tokens={})
        self.known: set[str] = set(map(chr, range(128)))
        self.strange: dict[int, str] = {}

    def _plain(self, text: str) -> str:
        """The text with characters that only this pattern's library takes for letters or numbers put aside."""
        for c in set(text) - self.known:
            self.known.add(c)
            if regex.match(r"[\p{L}\p{N}]", c) and not self.library.encode_ordinary(c):
                self.strange[ord(c)] = _OTHER
        return text.translate(self.strange) if self.strange else text

    def split(self, text: str) -> list[str]:
        plain = text if text.isascii() else self._plain(text)
        if plain == text:
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(plain)]

    def chunks(self, text: str) -> list[str]:
        """Parts of the text which can be split one by one: words, each with the space before it."""
        if self.uneven.search(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]


class ByteIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, with bounded memos of chunks and of pieces."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES * 3 // 4):
        self.coder, self.pieces = Backtracker(read_ranks(path), entries), Pieces()
        self.by_piece = Memo(self._piece, entries)
        self.by_chunk = Memo(self._chunk, entries)

    def _piece(self, piece: str) -> bytes:
        ids = self.coder.ids(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.by_piece[x] for x in self.pieces.split(chunk)])

    def encode(self, texts: list[str]) -> list[bytes]:
        for memo in (self.by_chunk, self.by_piece, self.coder.fits):
            memo.trim()
        get = self.by_chunk.__getitem__
        return [b"".join(map(get, self.pieces.chunks(x))) for x in texts]


@lru_cache(maxsize=2)
def _ids_of(path: str) -> ByteIds:
    return ByteIds(path)


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): each whole text's token ids, as little-endian unsigned 32-bit integers in one binary.

    A null text is an empty one and has no ids. Ids of documents may be null or repeat: rows are encoded one by one.
    Other columns are ignored whatever their names, and an empty table gives an empty one. Every worker reads the
    vocabulary from ``path`` once.
    """
    file = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ids_of(file)
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(coder.encode(texts), pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encoded`` with the bytes of their ids as ``decoded``; null ids give no bytes.

    The columns doc_id and ids are kept, others ignored. Ids outside the vocabulary are an error.
    """
    file = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _bytes_of(file).__getitem__
        for batch in batches:
            for part, _ in slices(batch, "ids"):
                decoded = [b"".join(map(get, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
