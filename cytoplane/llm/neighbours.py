"""Nearest vectors by cosine: inverted lists scanned a block of rotated dimensions at a time.

Unit vectors are rotated at random, so a distance over the first d dimensions, scaled up, estimates the whole one. In
each probed list a hypothesis test drops candidates whose partial distance is already too large for the query's running
k-th distance; the survivors are scored exactly, in double precision, on the original vectors. Lists and queries are cut
into blocks, so a list that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.common import stored

#: Vectors for the rotation's lists and for choosing how many to probe; every vector is indexed.
FIT_VECTORS, LISTS, TARGET = 16_384, 64, 0.985
#: Candidates and queries of a task, and candidates between two updates of a query's k-th distance.
CANDIDATES, QUERIES, STEP = 4096, 1024, 512
DIMENSIONS, EPSILON = 16, 3.0


@dataclass
class Lists:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def order(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles): neither null nor zero, all components finite, of the most frequent length (ties: the longer)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == (size.d if size else -1))


def fit(vectors: DataFrame, k: int, sample: int = FIT_VECTORS, lists: int = LISTS, target: float = TARGET, seed: int = 5) -> Lists | None:
    """Rotation, list centres (spherical k-means) and probes from ``sample`` vectors, drawn by a hash of the id.

    ``probes`` is the least number of lists that holds ``target`` of the sample's own k nearest.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(rows):
        return None
    x = _unit(np.stack(rows.v.to_numpy()).astype(np.float64))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    n = min(lists, max(1, len(x) // 32))
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    model = Lists(rotation, centres, n)
    own = (x @ centres.T).argmax(axis=1)
    probe = min(512, len(x))
    close = x[:probe] @ x.T
    close[np.arange(probe), np.arange(probe)] = -2
    nearest = np.argsort(-close, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(model.order(x[:probe]), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    if len(ranks):
        model.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1
    return model


def scan(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, k: int,
         epsilon: float = EPSILON, block: int = DIMENSIONS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best candidates of one block of one list, best first."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    qr = ((q / qn[:, None]) @ rotation).astype(np.float32)
    vr = ((v / vn[:, None]) @ rotation).astype(np.float32)
    dim = v.shape[1]
    distance = np.full((len(q), len(v)), np.inf, np.float32)
    limit = np.full(len(q), np.inf, np.float32)
    for at in range(0, len(v), STEP):
        to = min(at + STEP, len(v))
        partial = np.zeros((len(q), to - at), np.float32)
        alive = query_ids[:, None] != ids[None, at:to]
        for d in range(0, dim, block):
            a, b = qr[:, d : d + block], vr[at:to, d : d + block]
            if alive.mean() > 0.2:
                partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            else:
                i, j = np.nonzero(alive)
                partial[i, j] += ((a[i] - b[j]) ** 2).sum(axis=1)
            seen = min(d + block, dim)
            slack = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dim else 1 + 1e-4
            alive &= partial * (dim / seen) <= (slack * limit + 1e-5)[:, None]
        distance[:, at:to] = np.where(alive, partial, np.inf)
        if to >= k:
            limit = np.partition(distance[:, :to], k - 1, axis=1)[:, k - 1]
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(np.isfinite(distance[i]) & (distance[i] <= limit[i] * (1 + 1e-4) + 1e-5))
        score = (v[near] * q[i]).sum(axis=1) / (vn[near] * qn[i])
        best = np.lexsort((ids[near], -score))[:k]
        out.append((query_ids[i], ids[near[best]], score[best]))
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found to each row that the condition ``queries`` selects.

    A row is no candidate of a query with its own id. Ties go to the smaller id. Unusable vectors (see ``usable``) take no part
    on either side; ids may repeat. An empty table gives an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = stored(usable(vectors, id_col, vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")
    model = fit(rows, k)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most LISTS centres and one square matrix

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            if len(v):
                order = shared.value.order(_unit(v))
                data = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(data, pa.binary()), pa.array(order[:, 0], pa.int32()),
                     pa.array(list(order[:, : shared.value.probes].astype(np.int32)), pa.list_(pa.int32()))],
                    ["vec_id", "data", "list", "probes"],
                )

    placed = stored(rows.mapInArrow(assign, "vec_id long, data binary, list int, probes array<int>"), "vector-lists")
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("parts"))
    asked = placed.filter(queries).select("vec_id", "data", F.explode("probes").alias("list"))
    crowds = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("crowds"))
    # At most one row per list.
    both = F.broadcast(stored(sizes.join(crowds, "list"), "list-sizes"))
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.select("vec_id", "data", "list").join(both, "list").select(
        "vec_id", "data", "list", salt(F.col("parts")).alias("part"), each(F.col("crowds")).alias("crowd")
    )
    right = asked.join(both, "list").select("vec_id", "data", "list", salt(F.col("crowds")).alias("crowd"), each(F.col("parts")).alias("part"))
    right = right.toDF("q_id", "q_data", "q_list", "q_crowd", "q_part")

    def compare(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        q, v = (np.stack([np.frombuffer(x) for x in data]) for data in (wanted.q_data, candidates.data))
        found = scan(wanted.q_id.to_numpy(), q, candidates.vec_id.to_numpy(), v, shared.value.rotation, k)
        return pd.DataFrame({
            "query_id": np.repeat([x[0] for x in found], [len(x[1]) for x in found]),
            "vec_id": np.concatenate([x[1] for x in found]), "score": np.concatenate([x[2] for x in found]),
        })

    asking = right.groupBy("q_list", "q_part", "q_crowd")
    found = left.groupBy("list", "part", "crowd").cogroup(asking).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
