"""BPE encoding and decoding through a minimal acyclic transducer.

Frequent words of the corpus and their ids are compiled into a transducer whose words share prefixes and suffixes; ids
lie on its arcs, as far to the front as they are certain. Workers memory-map it and walk all new words of a batch at
once. Words outside it are merged exactly, by the file's ranks. The lexicon only saves work: any lexicon, also an empty
one, gives the same ids.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import MEMO_ENTRIES, Memo, chunks, slices, stored
from cytoplane.llm.tokens import Merger, Words, vocabulary_path

#: Words that make up this share of the corpus are in the lexicon (so at most 1 / share are), if they have so few bytes.
LEXICON_SHARE, WORD_BYTES = 2e-6, 48


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """A minimal subsequential transducer of (word, ids), sorted by word, as one block of bytes.

    Words come in order, so a state is final once the next word leaves it: then it is looked up among the finished ones,
    and an equal one takes its place. Outputs common to all words through an arc are moved onto it.
    """
    known: dict[tuple, int] = {}
    arcs: list[tuple[int, int, int, tuple]] = []
    finals: list[tuple[int, tuple]] = []

    def settle(node: list) -> int:
        key = (node[1], tuple((b, out, to) for b, (out, to) in node[0].items()))
        if (at := known.get(key)) is None:
            at = known[key] = len(known) + 1
            arcs.extend((at, b, to, out) for b, (out, to) in node[0].items())
            if node[1] is not None:
                finals.append((at, node[1]))
        return at

    path: list[list] = [[{}, None]]  # each: arcs {byte: [output, target]}, final output or None
    last = b""

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            done = settle(path.pop())
            path[-1][0][last[len(path) - 1]][1] = done

    for word, ids in entries:
        shared = len(os.path.commonprefix([word, last]))
        fold(shared)
        rest = tuple(ids)
        for k in range(shared):
            arc = path[k][0][word[k]]
            same = 0
            while same < min(len(arc[0]), len(rest)) and arc[0][same] == rest[same]:
                same += 1
            back, arc[0], rest = arc[0][same:], arc[0][:same], rest[same:]
            if back:
                below = path[k + 1]
                for x in below[0].values():
                    x[0] = back + x[0]
                if below[1] is not None:
                    below[1] = back + below[1]
        for k in range(shared, len(word)):
            path[k][0][word[k]] = [rest, 0]
            path.append([{}, None])
            rest = ()
        path[-1][1] = rest
        last = word
    fold(0)
    root = settle(path[0])
    arcs.sort(key=lambda x: (x[0], x[1]))
    finals.sort()
    pool: list[int] = []
    places: dict[tuple, int] = {}

    def place(out: tuple) -> int:
        if out not in places:
            places[out] = len(pool)
            pool.extend(out)
        return places[out]

    columns = [
        np.array([(s << 8) | b for s, b, _, _ in arcs], np.int64), np.array([t for _, _, t, _ in arcs], np.int64),
        np.array([place(o) for *_, o in arcs], np.int64), np.array([len(o) for *_, o in arcs], np.int64),
        np.array([s for s, _ in finals], np.int64), np.array([place(o) for _, o in finals], np.int64),
        np.array([len(o) for _, o in finals], np.int64), np.array(pool, np.int64),
    ]
    head = np.array([root, *map(len, columns)], np.int64)
    return head.tobytes() + b"".join(x.tobytes() for x in columns)


class Lexicon:
    """A compiled lexicon, memory-mapped from an unnamed file: nothing is left behind when the worker ends."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 9)
        self.root, at, columns = int(head[0]), 72, []
        for n in head[1:].tolist():
            columns.append(np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        self.keys, self.to, self.out, self.n_out, self.ends, self.end_out, self.n_end, self.pool = columns

    def states(self) -> int:
        return int(max(self.to.max(initial=0), self.root))

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, or None; all words take a step at a time."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((lengths <= WORD_BYTES) & (lengths > 0))
        letters = np.zeros((len(short), WORD_BYTES), np.int64)
        for row, k in enumerate(short.tolist()):
            letters[row, : lengths[k]] = np.frombuffer(words[k], np.uint8)
        lengths = lengths[short]
        state = np.full(len(short), self.root, np.int64)
        out: list[list[int]] = [[] for _ in words]
        live = np.arange(len(short))
        done: list[list[int] | None] = [None] * len(words)

        def emit(rows: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
            for k in np.flatnonzero(n).tolist():
                out[short[rows[k]]].extend(self.pool[at[k] : at[k] + n[k]].tolist())

        for step in range(WORD_BYTES + 1):
            over = live[lengths[live] == step]
            if len(over):
                k = np.minimum(np.searchsorted(self.ends, state[over]), len(self.ends) - 1)
                hit = self.ends[k] == state[over]
                emit(over[hit], self.end_out[k[hit]], self.n_end[k[hit]])
                for row in over[hit].tolist():
                    done[short[row]] = out[short[row]]
            live = live[lengths[live] > step]
            if not len(live):
                break
            key = (state[live] << 8) | letters[live, step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            live, k = live[hit], k[hit]
            emit(live, self.out[k], self.n_out[k])
            state[live] = self.to[k]
        return done


class Coder:
    """Encodes and decodes texts; memo of chunks, lexicon, then merges.

    Memos hold the ids of a word or chunk as decimal numbers and as tokens, each with a space behind it.
    """

    def __init__(self, path: str, lexicon: bytes | None = None):
        self.merger = Merger(path)
        self.words = Words(self.merger.added, path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.by_word = Memo(lambda w: self._texts(self.merger.ids(w.encode())))
        self.ids: dict[str, str] = {}
        self.names: dict[str, str] = {}

    def _texts(self, ids: list[int]) -> tuple[str, str]:
        name = self.merger.strings
        return "".join([f"{i} " for i in ids]), "".join([f"{name[i]} " for i in ids])

    def prepare(self, parts: Iterable[list[str]]) -> None:
        """Ids of all chunks that the memo lacks; a full memo keeps what these parts use."""
        used = set().union(*parts)
        if len(self.ids) > MEMO_ENTRIES:
            kept = used & self.ids.keys()
            self.ids, self.names = {k: self.ids[k] for k in kept}, {k: self.names[k] for k in kept}
        self.by_word.trim()
        plain, words, rest = self.words.many(used - self.ids.keys())
        distinct = set(words) - {"\n"}
        new = self.by_word.missing(distinct)
        coded = [w.encode() for w in new]
        ids = self.lexicon.look_up(coded) if self.lexicon else [None] * len(new)
        unseen = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(unseen, self.merger.many([coded[k] for k in unseen]), strict=True):
            ids[k] = x
        self.by_word.update(zip(new, map(self._texts, ids), strict=True))
        if plain:
            found = [(w, *self.by_word[w]) for w in distinct]
            for memo, k in ((self.ids, 1), (self.names, 2)):
                of = {x[0]: x[k] for x in found} | {"\n": "\n"}
                memo.update(zip(plain, "".join(map(of.__getitem__, words)).split("\n"), strict=True))
        for key in rest:
            each = [self._texts([w]) if isinstance(w, int) else self.by_word[w.decode()] for w in self.words(key)]
            self.ids[key], self.names[key] = "".join([x for x, _ in each]), "".join([x for _, x in each])

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, and the digests of ids and of the decoded text."""
        parts = [chunks(x) for x in texts]
        self.prepare(parts)
        n, ids, decoded = [], [], []
        for part in parts:
            numbers = "".join(map(self.ids.__getitem__, part))
            n.append(numbers.count(" "))
            ids.append(hashlib.sha256(numbers[:-1].encode()).hexdigest())
            decoded.append(hashlib.sha256("".join(map(self.names.__getitem__, part))[:-1].encode()).hexdigest())
        return n, ids, decoded

    def encode(self, text: str) -> list[int]:
        parts = chunks(text)
        self.prepare([parts])
        return [int(i) for x in parts for i in self.ids[x].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """As the file's library joins tokens without a decoder: by single spaces."""
        return " ".join([self.merger.strings[i] for i in ids if i in self.merger.strings])


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word (binary), n: over the whole texts of all documents; counted in tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words({})
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            by_word: Counter = Counter()
            many = iter(found.values())
            n = next(many, 0)
            for w in words.many(found)[1]:
                if w == "\n":
                    n = next(many)
                else:
                    by_word[w] += n
            found.clear()
            short = {k: n for w, n in by_word.items() if len(k := w.encode()) <= WORD_BYTES}
            return pa.RecordBatch.from_arrays([pa.array(short.keys(), pa.binary()), pa.array(short.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, texts in slices(batch):
                for x in texts:
                    found.update(chunks(x))
                if len(found) > 1_000_000:
                    yield flush()
        yield flush()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, path: str | None = None, share: float = LEXICON_SHARE, text_col: str = "text") -> bytes:
    """The words that are at least ``share`` of all words of the corpus, as a compiled transducer."""
    path = path or vocabulary_path()
    counts = stored(word_counts(docs, path, text_col), "bpe-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.filter(F.col("n") >= share * total).select("word").collect()
    merger = Merger(path)
    return compile_lexicon((w, tuple(merger.ids(w))) for w in sorted(bytes(r.word) for r in top))


def encode_decode(docs: DataFrame, lexicon: bytes, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null and empty texts have no ids."""
    path = path or vocabulary_path()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, shared.value)
        for batch in batches:
            for part, texts in slices(batch):
                n, ids, decoded = coder.digests(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        code, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_ids(docs: DataFrame, lexicon: bytes, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""
    path = path or vocabulary_path()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, shared.value)
        for batch in batches:
            for part, texts in slices(batch):
                ids = [coder.encode(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        code, f"doc_id {kind}, ids array<int>, decoded string"
    )
