"""Toxic passages by maximum-scoring segments of token log-odds.

A word's log-odds come from its counts in toxic and clean training documents under a Dirichlet prior whose mean is that
of the words which start alike, so rare forms lean on their stem. Each token costs a little, so the mean score is
negative; one linear scan finds all maximal segments. Their scores are made comparable between texts of any length by
extreme-value statistics (expected number of clean segments at least as good), and a logistic curve turns the best one
and the sum of the significant ones into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import MEMO_ENTRIES, chunks, fold, offsets_of, slices
from cytoplane.session import materialize

#: Expected documents per class in the training sample.
FIT_DOCS = 10_000
#: Hashed features; the model is a table of this size, whatever the corpus.
BUCKETS = 1 << 20
STEM, STRENGTH, STEM_STRENGTH, COST = 5, 3.0, 2.0, 1.0
#: A passage is significant if at most this many as good are expected in a clean text of the same length.
EXPECTED = 0.01
THRESHOLD = 0.3
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def features(chunk: str) -> tuple[int, int] | None:
    """Buckets of the word and of its stem; None without a letter or digit."""
    word = _OTHER.sub("", chunk.lower())
    if not word:
        return None
    stem = f"{word[:STEM]}\x00"
    return zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(stem.encode()) % BUCKETS


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    A segment is kept if its score is positive and none that holds it, nor part of it, scores more (ties: the shorter).
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # Each kept segment: start, end, sum before it, sum at its end, and the nearest earlier one with a smaller sum before.
    kept: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, low, high = at, sums[at], sums[at + 1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, at + 1, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
    return [(a, b, float(high - low)) for a, b, low, high, _ in kept]


@dataclass
class ToxicityModel:
    word: np.ndarray  # toxic and clean mass of each bucket, balanced
    rate: float = 1.0  # lambda of the score distribution in clean text
    log_k: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0]))

    def weight(self, chunk: str) -> float:
        found = features(chunk)
        if found is None:
            return -COST
        word, stem = self.word[found[0]], self.word[found[1]]
        mean = (stem[0] + STEM_STRENGTH / 2) / (stem[0] + stem[1] + STEM_STRENGTH)
        share = (word[0] + STRENGTH * mean) / (word[0] + word[1] + STRENGTH)
        return float(np.log(share / (1 - share))) - COST

    def bits(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Score of the best segment less what a clean text of ``n`` tokens reaches by chance."""
        return np.where(best > 0, self.rate * best - self.log_k - np.log(np.maximum(n, 1)), -20.0)

    def probability(self, best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(best)), np.clip(self.bits(best, n), -20, 40), np.log1p(total)])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


class Scanner:
    """Passages and their sums for whole texts."""

    def __init__(self, model: ToxicityModel, entries: int = MEMO_ENTRIES):
        self.model, self.entries, self.memo = model, entries, {}
        self.rows = np.zeros(0)

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        parts = [chunks(x) for x in texts]
        used = set().union(*parts)
        if len(self.memo) > self.entries:  # a full memo keeps what these texts use
            keep = list(used & self.memo.keys())
            self.rows = self.rows[np.fromiter(map(self.memo.__getitem__, keep), np.int64, len(keep))]
            self.memo = dict(zip(keep, range(len(keep))))
        new = list(used - self.memo.keys())
        self.rows = np.concatenate([self.rows, np.array([self.model.weight(x) for x in new])])
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(parts)), np.int64)
        offsets = offsets_of([len(x) for x in parts])
        return [self.rows[at[a:b]] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def passages(self, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Best score, sum of the significant passages' excess, and these passages (token positions)."""
        if not len(scores) or scores.max() <= 0:
            return 0.0, 0.0, []
        found = segments(scores)
        enough = (-np.log(EXPECTED) + self.model.log_k + np.log(len(scores))) / self.model.rate
        good = [x for x in found if x[2] >= enough]
        return max(x[2] for x in found), sum(x[2] for x in good), good


def _sample(docs: DataFrame, labels: DataFrame, fit_docs: int) -> tuple[DataFrame, dict[int, float]]:
    """Labelled documents (text, toxic, half) and the share drawn of each class."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {k: min(1.0, fit_docs / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = marks.filter(draw < F.when(F.col("toxic") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0)))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    # Hinted because the sample has about 2 * fit_docs rows of three numbers, however many labels there are.
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return joined.select("text", "toxic", half.alias("half")), shares


def _counts(sample: DataFrame) -> np.ndarray:
    """Tokens by half, class and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for part, texts in slices(batch):
                for toxic, half, x in zip(part.column("toxic").to_pylist(), part.column("half").to_pylist(), texts):
                    found.setdefault((half, toxic), Counter()).update(chunks(x))
        out: Counter = Counter()
        for (half, toxic), words in found.items():
            for w, n in words.items():
                for bucket in features(w) or ():
                    out[(half * 2 + toxic) * BUCKETS + bucket] += n
        yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.int64())], ["cell", "n"])

    rows = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * BUCKETS)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(2, 2, BUCKETS)


def _balanced(counts: np.ndarray) -> np.ndarray:
    """(bucket, toxic and clean mass): clean counts are scaled to the toxic total."""
    clean, toxic = counts
    scale = toxic.sum() / max(clean.sum(), 1)
    return np.column_stack([toxic, clean * scale])


def _clean_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) over clean tokens is 1."""
    p = counts / max(counts.sum(), 1)
    if not (p[values > 0]).any() or (p * values).sum() >= 0:
        return 5.0
    low, high = 1e-3, 5.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(mid * values)).sum() > 1 else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = weight * p * (1 - p)
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (weight * (y - p)) - 1e-2 * b)
        b += np.clip(step, -5, 5)
    return b


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Fit on documents (doc_id, text) with a label (doc_id, toxic 0 or 1).

    About ``fit_docs`` documents of each class are drawn by a hash of the id. Each half of them is scanned with weights
    from the other half for the extreme-value statistics and the curve; the weights kept are those of both halves.
    Without labelled documents of both classes every text gets a low constant score.
    """
    sample, shares = _sample(docs, labels, fit_docs)
    counts = _counts(sample)
    if not counts.sum(axis=(0, 2)).all() or len(shares) < 2:
        return ToxicityModel(np.zeros((BUCKETS, 2)))
    crossed = [ToxicityModel(_balanced(counts[1 - h])) for h in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(crossed)
    edges = np.arange(-12, 12, 0.05)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(m) for m in shared.value]
        for batch in batches:
            for part, texts in slices(batch):
                rows = [scanners[h].scores([x])[0] for h, x in zip(part.column("half").to_pylist(), texts)]
                hist = [np.histogram(s, edges)[0] for s in rows]
                found = [segments(s) for s in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.array(map(len, rows), pa.int64()),
                     pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64())), pa.array(hist, pa.list_(pa.int64()))],
                    ["toxic", "n", "found", "hist"],
                )

    got = sample.mapInArrow(scan, "toxic int, n long, found array<double>, hist array<long>")
    # Histograms are summed by bin before they come here; of each sampled document come three numbers.
    got = materialize(got)
    bins = got.filter("toxic = 0").select(F.posexplode("hist")).groupBy("pos").agg(F.sum("col").alias("n")).toPandas()
    weight = np.zeros(len(edges) - 1)
    weight[bins["pos"]] = bins["n"]
    model = ToxicityModel(_balanced(counts.sum(axis=0)))
    model.rate = _clean_rate(edges[:-1] + 0.025, weight)
    best = F.coalesce(F.array_max("found"), F.lit(0.0)).alias("best")
    clean = got.filter("toxic = 0 AND n > 0").select(best, "n").toPandas()
    hits = clean[clean.best > 0]
    if len(hits):
        # Rate of clean segments per token that reach their own score, the Karlin-Altschul constant.
        model.log_k = float(np.log(np.exp(model.rate * np.minimum(hits.best, 8 / model.rate)).mean() * len(hits) / clean.n.sum()))
    enough = (F.lit(-np.log(EXPECTED) + model.log_k) + F.log(F.greatest("n", F.lit(1)))) / F.lit(model.rate)
    total = F.aggregate("found", F.lit(0.0), lambda a, s: a + F.when(s >= enough, s).otherwise(0.0)).alias("total")
    rows = got.select("toxic", "n", best, total).toPandas()
    x = np.column_stack([np.ones(len(rows)), np.clip(model.bits(rows.best.to_numpy(), rows.n.to_numpy()), -20, 40), np.log1p(rows.total)])
    model.curve = _logistic(x, rows.toxic.to_numpy(), np.array([1 / shares[t] for t in rows.toxic]))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_passages, passages (token start, end, score) of every row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            for part, texts in slices(batch):
                rows = scanner.scores(texts)
                got = [scanner.passages(s) for s in rows]
                best, total, n = (np.array(x, dtype=float) for x in ([g[0] for g in got], [g[1] for g in got], list(map(len, rows))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(shared.value.probability(best, total, n), pa.float64()),
                     pa.array([len(g[2]) for g in got], pa.int64()),
                     pa.array([[dict(zip(("start", "end", "score"), p)) for p in g[2]] for g in got], kind)],
                    ["doc_id", "score", "n_passages", "passages"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {dict(docs.dtypes)[id_col]}, score double, n_passages long, passages array<struct<start:long,end:long,score:double>>"
    )


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents outside the held-out fold, then score every document."""
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held), labels.filter(~held))
    return score_documents(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "passages"
    )
