"""Product codes against every distance, and the bounds themselves."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.llm import codes

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """{row: (code, error)} in the order of ids, and the digest, in Python integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(np.float64(np.float32(v)) * 256)) for v in r[1]] for r in kept]
    size = len(x[0]) // parts
    cut = [[row[p * size:(p + 1) * size] for p in range(parts)] for row in x]
    book = [[list(row[p]) for row in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row[p], e)), k) for k, e in enumerate(book[p])) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [row[p] for row, n in zip(cut, near) if n[p][1] == k]
                if mine:
                    book[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    text = ",".join(str(v) for p in book for e in p for v in e)
    return [(r[0], "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), r[2]) for r, n in zip(kept, assign())], sha256(text.encode()).hexdigest()


def vectors(n, scale=1.0, size=32, seed=0):
    rng = np.random.default_rng(seed)
    data = (rng.normal(size=(n, size)) * scale).astype(np.float32)
    data[n // 2:n // 2 + n // 3] = data[n // 2]  # a third are copies
    return [(i, [float(v) for v in row], i % 3 if i % 4 else None) for i, row in enumerate(data)]


def check(spark, rows):
    want, digest = brute(rows)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    df = spark.createDataFrame(rows, KIND).repartition(3).withColumns({c: F.lit("clash") for c in ("code", "error", "vector", "low", "_key")})
    got = [tuple(r) for r in codes.compress(df).collect()]
    assert sorted(got, key=str) == sorted(((i, c, e, sums[label], digest) for i, c, e, label in want), key=str)


@pytest.mark.parametrize("scale", [1.0, 0.004, 5_000.0, 900_000.0])
def test_same_as_every_distance(spark, scale):
    check(spark, vectors(300, scale))


def test_odd_rows(spark):
    rows = vectors(20)
    rows += [(100, None, 1), (101, [*rows[0][1][:-1], None], 1), (102, [*rows[0][1][:-1], float("inf")], 1), (103, [float("nan")] * 32, 1)]
    check(spark, rows + [(3, rows[3][1], None), (3, rows[4][1], 7), (None, rows[5][1], None)])
    short = codes.compress(spark.createDataFrame([*rows, (200, [1.0] * 16, 0), (201, [], 0)], KIND))
    assert short.count() == 20


def test_empty_table_and_uneven_parts(spark):
    assert codes.compress(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(0, [1.0] * 17, 0)], KIND))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(0, [1e12] * 16, 0)], KIND))


def test_bounds_spare_work_and_net_moves_are_tighter():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 300, (2000, 4, 4)).round()
    there = rng.normal(0, 300, (4, 64, 4)).round().astype(np.int64)
    back = there + rng.integers(-3, 4, there.shape)
    first = codes.Bounds([there], np.float64)
    c, low, stamp = first.first(x)
    searched = codes.Bounds([there, back], np.float64).again(x, c, low, stamp)
    assert 0 < searched < 2000 * 4 * 2 / 2
    # Back at the start, a bound of round 0 has not moved at all.
    last = codes.Bounds([there, back, there], np.float64)
    assert last.moved[0].max() == 0 and last.moved[1].max() > 0
    last.again(x, c, low, stamp)
    assert (c == first.first(x)[0]).all()
