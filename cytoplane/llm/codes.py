"""Product codes of vectors in exact integers, with norm-of-sum bounds.

Components become integers, vectors are cut into equal parts, and every part position has a codebook that a few rounds
of assignment and averaging refine. All codebooks of earlier rounds are kept. A vector's part carries, for each group of
entries, a lower bound of the distance to all entries of the group but its own, and the round in which that distance was
computed. Later the bound is lowered by how far the group's entries lie from where they were in that round: the norm of
the sum of their moves, which is never more than the sum of the norms. Only groups whose bound does not exceed the exact
distance to the own entry are searched again, and only these get a new bound and stamp.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries of one bound.
GROUP = 32
#: Vectors that a task works on at once.
CHUNK = 4096
#: Relative error allowed for in square roots and single-precision bounds.
SLACK = 1e-6


def number_type(largest: int, size: int) -> type:
    """Doubles where squared distances of ``size`` components up to ``largest`` are exact in them, else 64-bit integers."""
    worst = size * (2 * largest) ** 2
    if worst >= 1 << 63:
        raise ValueError(f"components up to {largest} are too large for 64-bit distances")
    return np.float64 if worst < 1 << 53 else np.int64


class Bounds:
    """Codes of a chunk of vectors, found through codebooks (parts x entries x size), one per round so far."""

    def __init__(self, history: list[np.ndarray], dtype: type, group: int = GROUP):
        self.books, self.dtype, self.group = [x.astype(dtype) for x in history], dtype, group
        self.entries = history[0].shape[1]
        self.groups = -(-self.entries // group)
        self.now = len(history) - 1
        # How far the group's farthest entry lies from its place in each round.
        self.moved = np.zeros((len(history), history[0].shape[0], self.groups))
        for then, book in enumerate(self.books):
            step = np.sqrt(((self.books[-1] - book).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLACK)
            for g in range(self.groups):
                self.moved[then, :, g] = step[:, g * group:(g + 1) * group].max(axis=1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes, bounds and stamps by comparing with every entry."""
        n, parts = x.shape[:2]
        codes = np.empty((n, parts), np.uint8)
        low, stamp = np.empty((n, parts, self.groups), np.float32), np.full((n, parts, self.groups), self.now, np.uint8)
        rows = np.arange(n)
        for p in range(parts):
            d2 = self._squares(x[:, p], self.books[-1][p])
            own = d2.argmin(axis=1)
            codes[:, p] = own
            rest = d2.astype(np.float64)
            rest[rows, own] = np.inf
            for g in range(self.groups):
                low[:, p, g] = self._floor(rest[:, g * self.group:(g + 1) * self.group].min(axis=1))
        return codes, low, stamp

    @staticmethod
    def _floor(d2: np.ndarray) -> np.ndarray:
        return np.sqrt(d2) * (1 - SLACK)

    def own(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Exact squared distances to the own entries."""
        return ((x - self.books[-1][np.arange(x.shape[1])[None, :], codes]) ** 2).sum(axis=2)

    def again(self, x: np.ndarray, codes: np.ndarray, low: np.ndarray, stamp: np.ndarray) -> int:
        """Bring codes, bounds and stamps up to date after the codebooks moved; the number of groups searched."""
        parts, group, searched = x.shape[1], self.group, 0
        place = np.arange(parts)[None, :, None], np.arange(self.groups)[None, None, :]
        bound = low - self.moved[(stamp, *place)]
        own = self.own(x, codes)
        # A bound must be larger, not equal: an equally near entry with a lower index would win.
        need = bound <= np.sqrt(own.astype(np.float64))[:, :, None] * (1 + SLACK)
        for p in range(parts):
            before, best, code = codes[:, p].astype(np.int64), own[:, p].copy(), codes[:, p].astype(np.int64)
            seen = []
            for g in range(self.groups):
                rows = np.flatnonzero(need[:, p, g])
                if not len(rows):
                    continue
                d2 = self._squares(x[rows, p], self.books[-1][p, g * group:(g + 1) * group])
                near = d2.argmin(axis=1)
                least, entry = d2[np.arange(len(rows)), near], near + g * group
                better = (least < best[rows]) | ((least == best[rows]) & (entry < code[rows]))
                best[rows[better]], code[rows[better]] = least[better], entry[better]
                seen.append((g, rows, d2))
                searched += len(rows)
            for g, rows, d2 in seen:
                rest = d2.astype(np.float64)
                inside = np.flatnonzero(code[rows] // group == g)
                rest[inside, code[rows[inside]] - g * group] = np.inf
                low[rows, p, g], stamp[rows, p, g] = self._floor(rest.min(axis=1)), self.now
            # Where a part left its entry and that entry's group was not searched, the entry joins the others there.
            left = np.flatnonzero((code != before) & ~need[np.arange(len(x)), p, before // group])
            g = before[left] // group
            low[left, p, g] = np.minimum(bound[left, p, g] * (1 - SLACK), self._floor(own[left, p].astype(np.float64)))
            stamp[left, p, g] = self.now
            codes[:, p] = code
        return searched

    @staticmethod
    def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (x**2).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book**2).sum(axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary a row."""
    data = np.ascontiguousarray(rows).reshape(len(rows), -1)
    width = data.shape[1] * data.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _rows(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, *shape)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, CHUNK):
        yield batch.slice(at, CHUNK)


class Model:
    """Codebooks of all rounds so far, and how vectors are stored between rounds."""

    def __init__(self, first: np.ndarray, largest: int, kinds: tuple[str, str]):
        self.history, self.kinds = [first], kinds
        self.parts, self.entries, self.size = first.shape
        self.dtype = number_type(largest, self.size)
        self.stored_as = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
        self.groups = -(-self.entries // GROUP)

    def state_schema(self) -> str:
        return f"vec_id {self.kinds[0]}, label {self.kinds[1]}, ints binary, codes binary, low binary, stamp binary"

    def integers(self, column: pa.Array) -> np.ndarray:
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return np.floor(values * SCALE).astype(self.dtype).reshape(-1, self.parts, self.size)

    def start(self, kept: DataFrame) -> DataFrame:
        """Vectors with their first codes, bounds and stamps."""
        names = [x.split()[0] for x in self.state_schema().split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(self.history, self.dtype)
            for batch in batches:
                for part in _cut(batch):
                    x = self.integers(part.column("vector"))
                    made = (x.astype(self.stored_as), *bounds.first(x))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *map(_binary, made)], names)

        return kept.mapInArrow(run, self.state_schema())

    def read(self, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Integers, codes, bounds and stamps of stored vectors, all free to change."""
        x = _rows(part.column("ints"), self.stored_as, self.parts, self.size).astype(self.dtype)
        codes = _rows(part.column("codes"), np.uint8, self.parts).copy()
        low = _rows(part.column("low"), np.float32, self.parts, self.groups).copy()
        return x, codes, low, _rows(part.column("stamp"), np.uint8, self.parts, self.groups).copy()

    def refine(self, state: DataFrame) -> DataFrame:
        """The state after the codebooks moved."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(self.history, self.dtype)
            for batch in batches:
                for part in _cut(batch):
                    x, codes, low, stamp = self.read(part)
                    bounds.again(x, codes, low, stamp)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(_binary, (codes, low, stamp))], part.schema.names)

        return state.mapInArrow(run, self.state_schema())

    def finish(self, state: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) by the last codebooks."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(self.history, self.dtype)
            for batch in batches:
                for part in _cut(batch):
                    x, codes, low, stamp = self.read(part)
                    bounds.again(x, codes, low, stamp)
                    error = bounds.own(x, codes).sum(axis=1).astype(np.int64)
                    text = [x.tobytes().hex() for x in codes]
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

        return state.mapInArrow(run, f"vec_id {self.kinds[0]}, label {self.kinds[1]}, code string, error bigint")

    def average(self, state: DataFrame) -> None:
        """Add a codebook: each entry the mean of its parts, rounded down. Sums are merged in tasks before the shuffle."""
        parts, entries, size = self.history[-1].shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
            for batch in batches:
                for part in _cut(batch):
                    x = _rows(part.column("ints"), self.stored_as, parts, size).astype(np.float64)
                    codes = _rows(part.column("codes"), np.uint8, parts)
                    for p in range(parts):
                        count[p] += np.bincount(codes[:, p], minlength=entries)
                        for i in range(size):
                            total[p, :, i] += np.bincount(codes[:, p], x[:, p, i], entries).astype(np.int64)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"])

        sums = state.select("ints", "codes").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
        wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        book = self.history[-1].copy()
        for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # parts x entries rows
            book[row.part, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(size)]
        self.history.append(book)

    def digest(self) -> str:
        return sha256(",".join(map(str, self.history[-1].reshape(-1).tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    def fine(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    return vectors.filter(F.col(vector_col).isNotNull() & F.forall(vector_col, fine))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    A vector that is null, or holds a null or a number that is not finite, is dropped. The dimension is that of the
    smallest id's vector and must be a multiple of ``parts``; vectors of another length are dropped too. The first codebook
    is the parts of the ``entries`` smallest ids (nulls last; of equal ids the smaller vector first), or of all vectors,
    if there are fewer. Repeated ids are rows of their own. Nulls share a label. An empty table gives an empty result.
    Other columns are ignored whatever their names. Components so large that squared distances leave 64 bits are an error.
    """
    rows = usable(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")), "vector")
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    head = rows.orderBy(*order).limit(1).collect()
    dimension = len(head[0].vector) if head else parts
    if dimension == 0 or dimension % parts:
        raise ValueError(f"{dimension} components do not make {parts} equal parts")
    kept = rows.filter(F.size("vector") == dimension)
    first = [x.vector for x in kept.orderBy(*order).limit(entries).collect()]
    largest = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    book = np.array([[math.floor(SCALE * v) for v in x] for x in first], dtype=object).reshape(-1, parts, dimension // parts)
    kinds = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()
    number_type(math.ceil(SCALE * largest), dimension // parts)
    if not first:
        book = np.zeros((1, parts, dimension // parts), dtype=object)
    model = Model(book.astype(np.int64).transpose(1, 0, 2).copy(), math.ceil(SCALE * largest) + 1, kinds)
    state = stored(model.start(kept), "codes-0")
    for number in range(1, rounds + 1):
        model.average(state)
        if number < rounds:
            state = stored(model.refine(state), f"codes-{number}")
    done = stored(model.finish(state), "codes-done")
    by_label = done.groupBy(F.struct("label").alias("_key")).agg(F.sum("error").alias("label_error"))
    # Structs with a null in them are equal, so nulls meet their sum as well.
    return done.withColumn("_key", F.struct("label")).join(by_label, "_key").select(
        "vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
