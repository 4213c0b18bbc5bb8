import glob
import random
from collections import Counter

import numpy as np
import pytest
import regex

from cytoplane.llm import jaccard, suffix
from cytoplane.llm.common import Shelf, chunks
from cytoplane.llm.components import components
from cytoplane.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def texts(odd):
    """Copies, a crowd of near copies, shared passages and unrelated texts."""
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    fresh = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    base, passage = fresh(120), fresh(60)
    out = [" ".join(base), " ".join(base).upper()]
    for _ in range(40):
        words = list(base)
        for _ in range(draw.randint(1, 3)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append(" ".join(words))
    for k in range(20):
        out.append(" ".join(fresh(draw.randint(20, 90)) + (passage if k % 3 else passage[:49]) + fresh(draw.randint(5, 70))))
    out += [" ".join(fresh(draw.randint(1, 200))) for _ in range(30)]
    twice = fresh(55)
    return [*out, " ".join(twice + fresh(9) + twice), *odd]


def links(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    degree, root = Counter(), list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in near:
        degree[a] += 1
        degree[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    return sets, degree, [find(k) for k in range(len(sets))]


def test_near_duplicates_against_all_pairs(make, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # the crowd is dealt into blocks
    sets, degree, roots = links(texts)
    rows = {r.doc_id: r for r in jaccard.near_duplicates(make(texts)).collect()}
    assert len(rows) == len(texts)
    assert {i: r.n_links for i, r in rows.items()} == {i: degree[i] for i in range(len(texts))}
    worded = [i for i in rows if sets[i]]
    assert all(rows[i].class_id is None for i in rows if not sets[i])
    groups = lambda key: {frozenset(k for k in worded if key(k) == v) for v in map(key, worded)}
    assert groups(lambda i: rows[i].class_id) == groups(lambda i: roots[i])


def test_keep_one(make, texts):
    sets, _, roots = links(texts)
    kept = {r.doc_id for r in jaccard.keep_one(make(texts)).collect()}
    last = {}
    for i in range(len(texts)):
        last[roots[i] if sets[i] else ("blank", i)] = i
    assert kept == set(last.values())
    assert jaccard.keep_one(make([])).count() == 0
    repeated = jaccard.keep_one(make(["a b", "a b", None, " "], ids=[4, 4, 4, None])).collect()
    assert sorted(str(r.text) for r in repeated) == [" ", "None", "a b"]


def test_recall_of_the_bands():
    bands, rows = jaccard.bands_and_rows(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages_against_all_windows(make, texts):
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[k : k + 50]) for w in words for k in range(len(w) - 49))
    want = {}
    for i, w in enumerate(words):
        marked = {p for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] > 1 for p in range(k, k + 50)}
        if marked:
            want[i] = marked
    rows = suffix.repeated_passages(make(texts)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert texts[r.doc_id][r.start : r.end].split() == words[r.doc_id][r.start_word : r.end_word]
    assert got == want
    assert suffix.repeated_passages(make([])).count() == 0


def test_passages_of_frequent_lines(spark):
    """Two contexts share 42 words around the gram and 8 of it; in both orders others stand between them."""
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    after, before = line("a", 30), line("b", 30)  # 60 words in a row, the gram begins the last 30
    rows = [(1, 9, f"{after} m1", f"{before} m1"), (2, 9, f"{after} m3", f"{before} m3")]
    rows += [(3, 9, f"{after} m2", "m2"), (4, 9, "m2 x", f"{before} m2"), (5, 9, f"{after} m2 y", "m4")]
    contexts = spark.createDataFrame([(c, -c, h, x, y) for c, h, x, y in rows], "c1 long, c2 long, h long, after string, before string").coalesce(1)
    near = {}
    for by in (["h", "after", "before"], ["h", "before", "after"]):
        near |= {r.c1: r for r in suffix._neighbours(contexts, by, 50, Shelf(spark)).collect()}
    assert not near  # neighbours alone do not find it
    got = {r.c1: (r.lefts, r.rights) for r in suffix._windows(contexts, 50, 8, Shelf(spark)).collect()}
    assert got == {1: (30, 30), 2: (30, 30)}


def test_passages_between_frequent_lines(make):
    draw = random.Random(5)
    lines = [" ".join(f"{c}{k}" for k in range(20)) for c in "pqr"]
    fresh = lambda n: " ".join(f"z{draw.randrange(10**9)}" for _ in range(n))
    texts = [f"{fresh(60)} {' '.join(lines)} {fresh(60)}" for _ in range(2)]
    texts += [f"{fresh(60)} {lines[1]} {lines[2]} {fresh(60)}" for _ in range(60)]
    texts += [f"{fresh(60)} {lines[0]} {lines[1]} {fresh(60)}" for _ in range(60)]
    rows = suffix.repeated_passages(make(texts)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in rows) == [(0, 60, 120), (1, 60, 120)]


def test_rows_that_repeat_are_one_document(make):
    text = " ".join(f"v{k}" for k in range(70))
    assert suffix.repeated_passages(make([text, text], ids=[5, 5])).count() == 0
    rows = suffix.repeated_passages(make([text, text, text], ids=[5, 5, 6])).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in rows) == [(5, 0, len(text)), (6, 0, len(text))]


def test_common_words():
    assert suffix._common("a b c", "a b d") == 2
    assert suffix._common("a b", "a bc") == 1
    assert suffix._common("a b", "a b c") == 2
    assert suffix._common("", "a") == 0
    assert suffix._common("x", "x") == 1


def test_word_bounds_are_those_of_the_words():
    spaces = "".join(chr(c) for c in range(0x11000) if chr(c).isspace())
    for text in ("", " ", "a", f"a{spaces}b\u00a0\x1cc d\ud800 \U0001f600e ", "".join(f"{c}x" for c in spaces)):
        spans = suffix.word_bounds(text).tolist()
        assert [text[a:b] for a, b in spans] == chunks(text)
        assert [tuple(x) for x in spans] == [m.span() for m in regex.finditer("(?:[^\\s]|[\x1c-\x1f])+", text)]


def test_windows_have_one_digest_wherever_they_stand():
    rng = random.Random(4)
    line = [f"w{rng.randrange(5)}" for _ in range(300)]
    cases = []
    for _ in range(60):
        at, lefts, rights = rng.randrange(50, 240), rng.randrange(0, 43), rng.randrange(8, 51)
        cases.append((line[at - lefts : at + rights], lefts, rights))
    where, i, digest = suffix.window_digests([c[0] for c in cases], np.array([c[1] for c in cases]), np.array([c[2] for c in cases]), 50, 8)
    want = [
        (k, j, (j, *words[lefts - j : lefts - j + 50]))
        for k, (words, lefts, rights) in enumerate(cases)
        for j in range(max(0, 50 - rights), min(lefts, 42) + 1)
    ]
    assert list(zip(where.tolist(), i.tolist())) == [x[:2] for x in want]
    seen = {}
    for x, d in zip(want, digest.tolist()):
        assert seen.setdefault(x[2], d) == d
    assert len(set(seen.values())) == len(seen)


def test_only_the_tables_of_the_result_are_left(make, spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/cytoplane-suffix-*"))
    passage = " ".join(f"p{k}" for k in range(70))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    rows = suffix.repeated_passages(make([f"a {passage} b", f"c {passage} d", "short"])).collect()
    assert len(rows) == 2 and spark.conf.get(key) == setting
    left = {x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in set(glob.glob(f"{folder}/cytoplane-suffix-*")) - before}
    assert left == {"cytoplane-suffix-ids", "cytoplane-suffix-marked"}


@pytest.mark.parametrize("window", (1, 2, 3, 43))
def test_minimisers_are_the_leftmost_least_of_every_run(window):
    rng = np.random.default_rng(window)
    for n in (0, 1, window, window + 1, 200):
        h = rng.integers(0, 9, n).astype(np.uint64)
        want = sorted({int(h[k : k + window].argmin()) + k for k in range(max(1, n - window + 1))}) if n else []
        assert suffix.minimisers(h, window).tolist() == want
