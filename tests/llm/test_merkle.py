"""The manifest against a plain tree, and the layout itself."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.llm import merkle as m

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n):
    return digest("".join(map(field, (doc_id, source, lang, n, text))))


def tree(nodes):
    """The root, and each node's siblings left and right, level by level."""
    ways, places, row = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(row) > 1:
        for k, at in enumerate(places):
            first = at - at % 16
            ways[k].append(("".join(row[first:at]), "".join(row[at + 1:first + 16])))
            places[k] = at // 16
        row = [digest("".join(row[i:i + 16])) for i in range(0, len(row), 16)]
    return row[0], ways


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held, subroots = [], []
    for s in sources:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(*r)), r) for r in rows if r[3] == s)
        root, ways = tree([x[0][2] for x in mine])
        subroots.append(root)
        held += [(r, x[2], root, way, len(subroots) - 1) for (x, r), way in zip(mine, ways)]
    root, tops = tree(subroots)
    out = []
    for r, own, sub, way, k in held:
        way = way + tops[k]
        told = own
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0 and r[1] is not None:
            told = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
        for a, b in way:
            told = digest(a + told + b)
        out.append((r[0], own, sub, root, digest("".join(a + b for a, b in way)), told, told == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(3).withColumns({c: F.lit("clash") for c in ("pos", "total", "leaf", "block", "_row", "told", "order")})
    got = [tuple(r) for r in m.verify_documents(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_odd_rows(spark, odd):
    rows = [(i, t, None, ("a", "é", None, "")[i % 4], None if t is None else len(t)) for i, t in enumerate(odd)]
    check(spark, rows + [rows[0], rows[3], rows[3], (None, "X", "en", "a", 1), (None, None, None, None, None), (2**60 + 1, "B", "de", "a", 1)])


def test_one_hot_source_and_many_small_ones(spark):
    hot = [(i, f"Text {i}", "en", "hot", 6) for i in range(5000)]
    check(spark, hot + [(10_000 + i, f"t{i}", "en", f"s{i:03d}", 2) for i in range(300)])


@pytest.mark.parametrize("sources", [1, 16, 17])
def test_numbers_of_sources(spark, sources):
    check(spark, [(i, "A", None, f"s{i % sources}", 1) for i in range(sources * 17)])


def test_rounds_of_blocks(spark, monkeypatch):
    """With small blocks a few thousand rows need several rounds."""
    monkeypatch.setattr(m, "HEIGHT", 1)
    check(spark, [(i, f"T{i}", None, "hot" if i % 3 else f"s{i}", 2) for i in range(1500)])


def test_empty_table(spark):
    assert m.verify_documents(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_one_to_one_and_subtrees_lie_together(levels):
    places = [m.address(levels, d, np.arange(16**d)) for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range(m.subtree(levels)))
    if levels == 4:
        # Root and children first; then each of 256 subtrees of a node and its 16 leaves in a row.
        assert list(places[1]) == list(range(1, 17))
        assert all(list(places[3][k * 16:k * 16 + 16]) == list(range(places[2][k] + 1, places[2][k] + 17)) for k in (0, 7, 255))


def test_stored_blocks_answer_for_any_leaf():
    rng = np.random.default_rng(0)
    for count in (1, 2, 16, 17, 255, 257):
        leaves = rng.integers(0, 256, (count, 32)).astype(np.uint8)
        levels = m.levels_of(count)
        block = m.Block(m.build(leaves, levels), count, levels)
        root, ways = tree([x.tobytes().hex() for x in leaves])
        assert block.root.hex() == root
        got = [[(a.decode(), b.decode()) for a, b in way] for way in block.paths()]
        assert got == ways
        packed = [m.unpack_path(m.pack_path(way)) for way in block.paths()]
        assert [m.fold(x.tobytes().hex(), way) for x, way in zip(leaves, packed)] == [root] * count
