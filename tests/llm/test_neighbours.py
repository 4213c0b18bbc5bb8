import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.llm import neighbours
from cytoplane.llm.common import table


def test_recall_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    rows = df.toPandas().sort_values("vec_id")
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    norm, hits = np.linalg.norm(v, axis=1), 0
    for q in ids[ids % 50 == 0]:
        i = int(np.searchsorted(ids, q))
        score = (v * v[i]).sum(axis=1) / (norm * norm[i])
        score[i] = -2
        best = np.lexsort((ids, -score))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for vec, s in got[q].values():
            assert abs(s - score[np.searchsorted(ids, vec)]) < 1e-12
        hits += len({x for x, _ in got[q].values()} & set(ids[best].tolist()))
    assert hits >= 0.95 * 5 * len(got)


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("list", F.lit("clash"))
    return make


def test_odd_vectors(vectors):
    good = [(k, [1.0, float(k)], 0) for k in range(4)]
    bad = [(50, None, 1), (51, [0.0, 0.0], 1), (52, [1.0, None], 1), (53, [float("nan"), 1.0], 1), (54, [float("inf"), 1.0], 1), (55, [1.0], 1), (None, [1.0, 1.0], 1)]
    rows = neighbours.nearest(vectors(good + bad), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert neighbours.nearest(vectors([]), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors(bad[:2]), F.lit(True)).count() == 0


def test_ties_go_to_the_smaller_id(vectors):
    rows = neighbours.nearest(vectors([(k, [1.0, 2.0], 0) for k in range(300)]), F.col("vec_id") == 7).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [0, 1, 2, 3, 4]


def test_scan_is_exact_without_early_stops():
    draw = np.random.default_rng(1)
    v, q = draw.standard_normal((1500, 24)), draw.standard_normal((20, 24))
    found = neighbours.scan(np.arange(20) + 10_000, q, np.arange(1500), v, np.linalg.qr(draw.standard_normal((24, 24)))[0], 5, epsilon=50)
    score = (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    assert [x[1].tolist() for x in found] == [np.argsort(-s)[:5].tolist() for s in score]
