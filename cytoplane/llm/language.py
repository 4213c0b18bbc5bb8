"""Language of a text by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces (a forward pass over its bytes); a text's is the product over its words. The probabilities
come from expectation maximisation over all segmentations of the training words.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import MEMO_ENTRIES, chunks, fold, offsets_of, segment_sum, slices
from cytoplane.llm.tokens import byte_letters, vocabulary_path

UNKNOWN = "und"
#: Bounds of the training sample: documents per language (expected), and distinct (language, word) rows.
FIT_DOCS, FIT_WORDS = 3000, 120_000
#: Bytes of a piece, and of a word: longer words are scored in parts of this size.
PIECE_BYTES, WORD_BYTES = 8, 32
ROUNDS, PRIOR = 4, 0.01
_LETTERS = regex.compile(r"\p{L}+")


def piece_keys(path: str | None = None) -> np.ndarray:
    """The vocabulary's pieces of at most eight bytes, packed into sorted integers; a word ends with a space."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, byte_of = model.get("end_of_word_suffix") or "", {c: b for b, c in enumerate(byte_letters())}
    keys = {b for b in range(1, 256)} | {b << 8 | 32 for b in range(1, 256)}
    for piece in model["vocab"]:
        ends = bool(suffix) and piece.endswith(suffix)
        letters = piece[: len(piece) - len(suffix)] if ends else piece
        if letters and all(c in byte_of for c in letters):
            data = bytes(byte_of[c] for c in letters) + b" " * ends
            if len(data) <= PIECE_BYTES and 0 not in data:
                keys.add(int.from_bytes(data, "big"))
    return np.array(sorted(keys), dtype=np.uint64)


def words_of(chunk: str) -> list[bytes]:
    """Lower-case letter runs with the end mark, cut into parts where they are very long."""
    out = []
    for w in _LETTERS.findall(chunk.lower()):
        data = w.encode() + b" "
        out += [data[k : k + WORD_BYTES] for k in range(0, len(data), WORD_BYTES)]
    return out


def _lattice(keys: np.ndarray, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For words of one length: (start, bytes) to the piece there, or to one past the last piece."""
    out, n = {}, words.shape[1]
    wide = words.astype(np.uint64)
    for at in range(n):
        key = np.zeros(len(words), np.uint64)
        for k in range(1, min(PIECE_BYTES, n - at) + 1):
            key = (key << np.uint64(8)) | wide[:, at + k - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            if hit.any():
                out[at, k] = np.where(hit, place, len(keys))
    return out


def _forward(lattice: dict, p: np.ndarray, rows: int, n: int) -> np.ndarray:
    alpha = np.zeros((n + 1, rows, p.shape[1]))
    alpha[0] = 1
    for (at, k), piece in sorted(lattice.items()):
        alpha[at + k] += alpha[at] * p[piece]
    return alpha


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, letters) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        for some in np.array_split(rows := np.flatnonzero(lengths == n), max(1, len(rows) // 50_000)):
            yield some, np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8).reshape(len(some), n)


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of each language among training documents
    keys: np.ndarray
    pieces: np.ndarray  # (pieces + 1) x languages; the last row is zero

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word in each language, over all its segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for rows, letters in _by_length(words):
            n = letters.shape[1]
            out[rows] = np.log(_forward(_lattice(self.keys, letters), self.pieces, len(rows), n)[n])
        return out


class Scorer:
    """Scores texts; a bounded memo keeps the sums of chunks."""

    def __init__(self, model: LanguageModel, entries: int = MEMO_ENTRIES):
        self.model, self.entries, self.memo = model, entries, {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Per text: log-likelihood in each language, and the number of words."""
        parts = [chunks(x) for x in texts]
        used = set().union(*parts)
        if len(self.memo) > self.entries:  # a full memo keeps what these texts use
            keep = list(used & self.memo.keys())
            self.rows = self.rows[np.fromiter(map(self.memo.__getitem__, keep), np.int64, len(keep))]
            self.memo = dict(zip(keep, range(len(keep))))
        new = list(used - self.memo.keys())
        split = [words_of(x) for x in new]
        words = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        logs = self.model.log_words(list(words))
        each = np.fromiter((words[w] for x in split for w in x), np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        sums = segment_sum(logs[each], offsets_of(counts))
        self.rows = np.concatenate([self.rows, np.column_stack([sums, counts])])
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(parts)), np.int64)
        return segment_sum(self.rows[at], offsets_of([len(x) for x in parts]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        sums = self.totals(texts)
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        logs = sums[:, :-1] + self.model.prior
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        known = sums[:, -1] > 0
        names = [self.model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())]
        return names, np.where(known, score, 0.0).tolist()


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over whole texts, counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for part, texts in slices(batch):
                for lang, x in zip(part.column("lang").to_pylist(), texts):
                    found.setdefault(lang, Counter()).update(chunks(x))
        for lang, counter in found.items():
            words: Counter = Counter()
            for chunk, n in counter.items():
                for w in words_of(chunk):
                    words[w] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(training: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on rows (doc_id, text, lang) with a language; others are left out.

    The sample is drawn by a hash of id and text, ``fit_docs`` documents per language as expected, and keeps the
    ``fit_words`` most frequent (language, word) rows: what reaches the driver is bounded. No rows: a model without languages.
    """
    rows = training.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, keys = sorted(shares), piece_keys(path)
    if not languages:
        return LanguageModel([], np.zeros(0), keys, np.zeros((len(keys) + 1, 0)))
    cut = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, fit_docs / n))) for k, n in shares.items()))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    counts = _word_counts(rows.filter(draw < cut[F.col("lang")])).orderBy(F.desc("n"), "lang", "word").limit(fit_words).toPandas()
    words = {bytes(w): k for k, w in enumerate(dict.fromkeys(map(bytes, counts["word"])))}
    weight = np.zeros((len(words), len(languages)))
    at = {x: k for k, x in enumerate(languages)}
    for lang, w, n in zip(counts["lang"], map(bytes, counts["word"]), counts["n"]):
        weight[words[w], at[lang]] += n

    p = np.full((len(keys) + 1, len(languages)), 1 / len(keys))
    p[-1] = 0
    groups = [(rows, letters.shape[1], _lattice(keys, letters)) for rows, letters in _by_length(list(words))]
    for _ in range(rounds):
        expected = np.zeros_like(p)
        for rows, n, lattice in groups:
            alpha = _forward(lattice, p, len(rows), n)
            beta = np.zeros_like(alpha)
            beta[n] = weight[rows] / alpha[n]
            for (at_, k), piece in sorted(lattice.items(), reverse=True):
                step = p[piece] * beta[at_ + k]
                beta[at_] += step
                share = alpha[at_] * step
                for j in range(len(languages)):
                    expected[:, j] += np.bincount(piece, share[:, j], len(p))
        p = expected + PRIOR
        p[-1] = 0
        p /= p.sum(axis=0)
    total = sum(shares.values())
    return LanguageModel(languages, np.log([shares[x] / total for x in languages]), keys, p)


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows whose language cannot be told (null texts, texts without a letter); a null language gets the predicted one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                names, _ = scorer.predict(texts)
                at = part.schema.get_field_index(lang_col)
                lang = [x if x is not None else new for x, new in zip(part.column(at).to_pylist(), names)]
                part = part.set_column(at, part.schema.field(at), pa.array(lang, part.schema.field(at).type))
                yield part.filter(pa.array([bool(_LETTERS.search(x)) for x in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; null texts and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in slices(batch):
                names, scores = scorer.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        score, f"doc_id {kind}, lang_pred string, score double"
    )


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from documents outside the held-out fold, then predict every document."""
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
