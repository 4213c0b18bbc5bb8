import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.llm import language, lm, toxicity
from cytoplane.llm.common import fold, stored, table

SF = "/root/testdata/sf0.01"


def crc(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


def test_segments_against_all_segments():
    draw = np.random.default_rng(2)
    for _ in range(200):
        s = draw.integers(-3, 4, 12).astype(float)
        got = toxicity.segments(s)
        best = max([0.0] + [s[a:b].sum() for a in range(12) for b in range(a + 1, 13)])
        assert max([0.0] + [x[2] for x in got]) == best
        for a, b, total in got:
            assert total == s[a:b].sum() > 0
            # every proper start and end of a maximal segment scores more than nothing
            assert all(s[a:k].sum() > 0 for k in range(a + 1, b)) and all(s[k:b].sum() > 0 for k in range(a + 1, b))
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.predict_toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    wrong = sum(r.predicted != r.toxic for r in held)
    assert wrong <= 0.05 * len(held)


def test_toxicity_without_labels(make, odd, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.predict_toxicity(make(odd), none).collect()
    assert len(rows) == len(odd) and len({r.score for r in rows}) == 1


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    rows = language.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(make, odd, spark):
    training = make(["the cat sat on the mat"] * 3 + ["le chat est sur le tapis"] * 3, langs=["en"] * 3 + ["fr"] * 3)
    model = language.fit(training)
    rows = {r.doc_id: r for r in language.identify(make(odd), model).collect()}
    for i, text in enumerate(odd):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    left = language.keep_known(make([None, "12", "the mat", "le tapis"], langs=["en", None, None, "fr"]), model).collect()
    assert sorted((r.text, r.lang) for r in left) == [("le tapis", "fr"), ("the mat", "en")]
    nothing = language.fit(make([]))
    assert {r.lang_pred for r in language.identify(make(odd), nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    keys = np.array(sorted(int.from_bytes(x, "big") for x in (b"a", b"b", b" ", b"ab", b"b ", b"ba", b"aba")), dtype=np.uint64)
    p = np.linspace(0.05, 0.2, len(keys))[:, None]
    model = language.LanguageModel(["x"], np.zeros(1), keys, np.vstack([p, np.zeros((1, 1))]))
    at = {int(k).to_bytes(8, "big").lstrip(b"\0"): float(v) for k, v in zip(keys, p[:, 0])}

    def total(w):
        return 1.0 if not w else sum(at[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in at)

    words = [b"ababab ", b"ba ", b"b ", b"abaab "]
    assert np.allclose(np.exp(model.log_words(words)[:, 0]), [total(w) for w in words])


def automaton(docs, keep):
    import pandas as pd

    key, n = lm.gram_counts(docs)
    rows = []
    for size in range(2, lm.ORDER + 1):
        cut = pd.DataFrame({"gram": np.bitwise_and(key, (1 << 8 * size) - 1), "n": n}).groupby("gram", as_index=False).n.sum()
        cut["context"] = np.right_shift(cut.gram.to_numpy(), 8)
        stats = cut.groupby("context").n.agg(["sum", "count"])
        rows.append(cut[cut.n >= keep].join(stats, on="context").assign(size=size)[["size", "gram", "n", "sum", "count"]])
    return lm.build(pd.concat(rows), np.bincount(np.bitwise_and(key, 255), weights=n, minlength=256))


def walk(a, data):
    """Symbol by symbol, from left to right."""
    state, out = 0, []
    for b in data:
        now, gained = state, 0.0
        while True:
            k = int(np.searchsorted(a.keys, now * 256 + b))
            if k < len(a.keys) and a.keys[k] == now * 256 + b:
                break
            gained, now = gained + a.backoff[now], a.fail[now]
        out.append(gained + a.cost[k])
        state = a.to[k]
    return out


@pytest.mark.parametrize("keep", [1, 4])
def test_automaton(keep):
    draw = np.random.default_rng(4)
    docs = [b" ".join(draw.choice([b"ab", b"a", b"cab"], draw.integers(0, 6)).tolist()) for _ in range(200)]
    a = automaton(docs, keep)
    for state in range(0, len(a.fail), 11):
        total = 0.0
        for b in range(256):
            now, gained = state, 0.0
            while a.keys[k := min(int(np.searchsorted(a.keys, now * 256 + b)), len(a.keys) - 1)] != now * 256 + b:
                gained, now = gained + a.backoff[now], a.fail[now]
            total += 10 ** (gained + a.cost[k])
        assert abs(total - 1) < 1e-6
    texts = [b"", b"zz \xc3\xa9", b" ".join([b"ab cab"] * 300), *docs[:20]]
    logs, _, starts = a.read(texts)
    for i, d in enumerate(texts):
        assert np.allclose(logs[starts[i] + 5 : starts[i + 1]], walk(a, b"\n" * 5 + d + b"\n")[5:])


def test_automaton_reads_an_n_gram_once(monkeypatch):
    a = automaton([b"ab a cab"] * 20, 1)
    asked = []
    arcs = lm.Automaton.arcs
    monkeypatch.setattr(lm.Automaton, "arcs", lambda self, keys: asked.append(len(keys)) or arcs(self, keys))
    once = a.read([b"cab ab a cab"])[0]
    few, asked[:] = sum(asked), []
    often = a.read([b"cab ab a cab"] * 500)[0]
    assert np.array_equal(often, np.tile(once, 500)[: len(often)]) and sum(asked) < 3 * few


def test_scores(make, spark):
    texts = [t[:400] for (t,) in table(spark, SF, "documents").select("text").limit(60).collect()] + [None, "", " \t", "ABC abc\x0bé"]
    docs = make(texts)
    rows = {r.doc_id: r for r in lm.score_documents(docs, fold(F.col("doc_id"), 7) == 2).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) + [""] for t in texts]
    counts = Counter(w for i, x in enumerate(words) if crc(i, 7) != 2 for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in enumerate(words):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(x), sum(counts[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert r.score < 0
    empty = lm.score_documents(make([]), F.lit(False))
    assert empty.count() == 0
    alone = lm.score_documents(make(["a b"]), F.lit(True)).first()
    assert (alone.n_known, alone.train_tokens) == (0, 0) and math.isfinite(alone.score)


def test_pairs_raise_scores(make, monkeypatch):
    """Words that begin and end alike: bytes at their borders tell nothing of the order in which the words stood."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 300)  # several blocks
    w = [f"qqqqqq{c}qqqqqq" for c in "abcdefgh"]
    train = [" ".join([w[0], w[1], w[2]])] * 9 + [" ".join([w[k], w[(3 * k + 2) % 8]]) for k in range(8)] * 2
    texts = [*train, " ".join([w[0], w[1], w[2]]), " ".join([w[1], w[0], w[2]])]
    held = F.col("doc_id") >= len(train)
    rows = {r.doc_id: r for r in lm.score_documents(make(texts), held).collect()}
    seen, other = rows[len(train)], rows[len(train) + 1]
    assert math.isclose(seen.base_score, other.base_score)
    assert seen.score > other.score + 0.2


def test_words_and_pairs_are_counted_whole(make, monkeypatch):
    """The counts that blocks get back are those of all words and pairs in all training texts, also of the rarest."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 300)
    draw = np.random.default_rng(8)
    texts = [" ".join(draw.choice([f"w{k}" for k in range(40)], draw.integers(0, 30)).tolist()) for _ in range(120)]
    docs = make(texts).select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    blocks = stored(lm._blocks(docs).withColumn("block", F.monotonically_increasing_id()), "test-lm")
    assert blocks.count() > 3
    want = Counter(x for i, t in enumerate(texts) if i % 7 != 2 for x in zip(["", *t.split()], [*t.split(), ""]))
    single = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in (*t.split(), ""))
    bits = lm.group_bits(blocks.count())
    counts = stored(lm._counts(blocks, bits), "test-lm")
    totals = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    assert (totals.n, totals.v) == (sum(single.values()), len(single))
    for r in blocks.join(lm._returned(counts), "block").collect():
        words, each = lm._tokens(lm._texts({"data": r.data, "n": r.n}))
        h = lm.digests_of(words)
        assert lm.word_counts(h, r.words, bits).tolist() == [single[w.decode()] for w in words]
        pair = lm.pairs_of(h, each)
        found = np.concatenate([lm._numbers(x, np.int64) for x in r.pairs])
        at = dict(zip(np.unique(pair).tolist(), found.tolist(), strict=True))
        flat = ["", *(words[k].decode() for k in each)]
        assert all(at[int(x)] == want[flat[k], flat[k + 1]] for k, x in enumerate(pair))
