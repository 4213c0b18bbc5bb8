"""Packing documents into token sequences of bounded length.

Lengths are at most the capacity, so their histogram is a few thousand numbers whatever the corpus. The plan is made
from it: large lengths are rounded up within groups of equal cardinality, configurations of the few rounded sizes are
filled by dynamic programming, actual documents take their places (which leaves room), and small documents go best-fit
into what is left. The plan says "documents a..b in length order go to sequences s.. at offset o"; documents find their
line by their position in that order, which a range-partitioned sort gives without a single task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import slices
from cytoplane.llm.tokens import ChunkIds, vocabulary_path
from cytoplane.operators.ordering import global_index
from cytoplane.session import materialize

CAPACITY = 4096
END = 1
#: Groups of large lengths; lengths from this share of the capacity up count as large.
GROUPS, LARGE = 512, 1 / 3


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null and empty texts are the end id alone."""
    path = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = ChunkIds(path), np.uint32(end).astype("<u4").tobytes()
        for batch in batches:
            for part, texts in slices(batch):
                which, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(coder.encode(texts)):
                    data = ids + tail
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        one = data[at : at + 4 * capacity]
                        which.append(row), piece.append(k), start.append(at // 4)
                        length.append(len(one) // 4), crc.append(zlib.crc32(one))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class _Pool:
    """Documents by length, longest first; each is known by its position in that order."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = sorted(counts, reverse=True)
        self.counts = [counts[x] for x in self.lengths]
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).tolist()

    def spans(self, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(position, how many, length) of the ``n`` documents from ``at`` on."""
        k = max(0, int(np.searchsorted(self.first, at, side="right")) - 1)
        while n:
            some = min(n, self.first[k + 1] - at)
            if some:
                yield at, some, self.lengths[k]
            at, n, k = at + some, n - some, k + 1


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill the capacity best, within what is left of each (bounded knapsack)."""
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[0] = True
    steps = []
    for k, size in enumerate(sizes):
        for _ in range(min(left[k], capacity // size)):
            new = np.zeros_like(reach)
            new[size:] = reach[:-size]
            new &= ~reach
            if not new.any():
                break
            steps.append((k, size, new))
            reach |= new
        if reach[capacity]:
            break
    at = int(np.flatnonzero(reach)[-1])
    used = [0] * len(sizes)
    for k, size, new in reversed(steps):
        if at and new[at]:
            used[k] += 1
            at -= size
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (position, count, sequence, offset) over documents from the longest to the shortest, and how many sequences.

    ``counts`` maps lengths (1 to capacity) to numbers of documents; the work depends on it alone, not on the documents.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    pool, out, sequences = _Pool(counts), [], 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    large = sum(n for x, n in counts.items() if x >= capacity * LARGE)

    # Linear grouping: groups of equal cardinality, each rounded up to its longest document.
    bounds = np.unique(np.linspace(0, large, min(groups, large) + 1).astype(np.int64)).tolist() if large else [0]
    cursor, left = bounds[:-1], np.diff(bounds).tolist()
    sizes = [next(pool.spans(x, 1))[2] for x in cursor]
    while any(left):
        # The longest group that has documents left always takes part, so configurations never strand it.
        lead = next(k for k, n in enumerate(left) if n)
        rest = [n if k > lead else n - 1 if k == lead else 0 for k, n in enumerate(left)]
        open_ = capacity - sizes[lead]
        used = _configuration(sizes[lead:], rest[lead:], open_) if open_ else [0] * (len(sizes) - lead)
        used = [0] * lead + used
        used[lead] += 1
        times = min(left[k] // u for k, u in enumerate(used) if u)
        bins = [(sequences, times, 0)]
        for k, u in enumerate(used):
            for _ in range(u):
                # Actual documents: bins split where their lengths change.
                next_bins, spans = [], pool.spans(cursor[k], times)
                at, n, length = next(spans)
                for first, m, fill in bins:
                    while m:
                        if not n:
                            at, n, length = next(spans)
                        some = min(m, n)
                        out.append((at, some, first, fill))
                        next_bins.append((first, some, fill + length))
                        first, m, at, n = first + some, m - some, at + some, n - some
                bins = next_bins
                cursor[k] += times
                left[k] -= times
        for first, m, fill in bins:
            free[capacity - fill].append((first, m))
        sequences += times

    # Small documents, longest first, into the fullest sequence that has room.
    rooms = sorted(x for x in free if x)
    for k, length in enumerate(pool.lengths):
        if length >= capacity * LARGE:
            continue
        at, n = pool.first[k], pool.counts[k]
        while n:
            where = bisect_left(rooms, length)
            if where == len(rooms):
                opened = -(-n // (capacity // length))
                free[capacity].append((sequences, opened))
                sequences += opened
                insort(rooms, capacity)
                continue
            room = rooms[where]
            first, m = free[room].pop()
            some = min(m, n)
            if m > some:
                free[room].append((first + some, m - some))
            if not free[room]:
                rooms.pop(where)
            out.append((at, some, first, capacity - room))
            if room - length:
                if not free[room - length]:
                    insort(rooms, room - length)
                free[room - length].append((first, some))
            at, n = at + some, n - some
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4), sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to rows with ``length``; all rows stay, an empty table gives an empty one.

    Ties in length are settled by doc_id and piece; the number of sequences does not depend on them.
    """
    fixed = materialize(pieces)
    counts = {r.length: r.n for r in fixed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines, _ = plan(counts, capacity, groups)
    shared = fixed.sparkSession.sparkContext.broadcast(lines)  # at most a few lines per length and configuration

    @F.pandas_udf("sequence_id long, offset long")
    def place(at: pd.Series) -> pd.DataFrame:
        rows = shared.value
        k = np.searchsorted(rows[:, 0], at.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[k, 2] + at.to_numpy() - rows[k, 0], "offset": rows[k, 3]})

    ordered = global_index(fixed.withColumn("_down", -F.col("length")), ["_down", "doc_id", "piece"], "_at").drop("_down")
    return ordered.withColumn("_p", place("_at")).select("*", "_p.sequence_id", "_p.offset").drop("_at", "_p")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(docs, capacity, path), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
