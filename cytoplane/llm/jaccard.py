"""Near duplicates: n-gram Jaccard join by MinHash banding.

Texts with the same set of n-grams are one class, known by a digest of the set. Each class has a MinHash signature cut
into bands; the numbers of bands and rows come from the recall wanted at the threshold. Classes meet by the hash of a
band, and every two of a bucket are compared on their full n-gram sets.

A bucket is never expanded into pairs of rows: its members go to one task (a large bucket to a triangle of blocks), are
compared there on a matrix of the n-grams they share, and each task returns one row per member: how many links it has
and the smallest member it hangs together with. A pair is compared only in its first common band. So the rows stay
linear in the members however many links there are, and no link is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import Memo, chunks, offsets_of, slices
from cytoplane.llm.components import components
from cytoplane.session import materialize

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 4) -> tuple[int, int]:
    """Bands of ``rows`` hashes so that a pair exactly at the threshold meets with probability ``recall``."""
    miss = math.log1p(-(threshold**rows))
    return math.ceil(math.log(1 - recall) / miss), rows


class Shingler:
    """Sets of hashed n-grams of words: lower case, split at white space; a shorter text is one n-gram."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.memo = Memo(xxhash.xxh64_intdigest)
        steps = np.arange(words, dtype=np.uint64)
        self.mix = np.resize(_MIX, words) * (steps * np.uint64(2) + np.uint64(1))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        parts = [chunks(x.lower()) for x in texts]
        self.memo.trim()
        each = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(parts)), np.uint64)
        out, at = [], 0
        for part in parts:
            h = each[at : at + len(part)]
            at += len(part)
            if len(part) == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            if len(part) < self.words:
                h = np.concatenate([h, np.zeros(self.words - len(part), np.uint64)])
            n = len(h) - self.words + 1
            s = h[:n] * self.mix[0]
            for k in range(1, self.words):
                s += h[k : n + k] * self.mix[k]
            s ^= s >> np.uint64(29)
            s *= np.uint64(0xBF58476D1CE4E5B9)
            s ^= s >> np.uint64(32)
            out.append(np.unique(s))
        return out


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash per set and band; sets must not be empty."""
    draw = np.random.default_rng(20)
    a = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    flat, starts = np.concatenate(sets), offsets_of([len(s) for s in sets])[:-1]
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(sets), band, np.uint64)
        for k in range(band * rows, band * rows + rows):
            low = np.minimum.reduceat((flat * a[k]) ^ b[k], starts)
            h = (h ^ low) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, band] = h
    return out


def sketches(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, t1, t2 (fingerprints of the text), digest of the n-gram set (null without words) and band hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingler.sets(texts)
                full = [k for k, s in enumerate(sets) if len(s)]
                hashes: list = [None] * len(sets)
                if full:
                    for k, h in zip(full, _band_hashes([sets[k] for k in full], bands, rows).view(np.int64)):
                        hashes[k] = h
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array(digest, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "t1", "t2", "digest", "bands"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "t1", "t2").mapInArrow(sketch, f"doc_id {kind}, t1 long, t2 long, digest binary, bands array<long>")


def _compare(sets: list[np.ndarray], weight: np.ndarray, allowed, threshold: float, left: np.ndarray, right: np.ndarray):
    """Links (weight of partners) of each member and the smallest member it hangs together with.

    ``left`` and ``right`` list the members on either side; ``allowed(i, js)`` says which pairs count here.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    owner, new = owner[order], np.concatenate([[True], np.diff(flat[order]) != 0])
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    owner, group = owner[shared], np.unique(group[shared], return_inverse=True)[1] if shared.any() else group[:0]
    same = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    width = 4096
    for a in range(0, int(group.max(initial=-1)) + 1, width):
        k = slice(np.searchsorted(group, a), np.searchsorted(group, a + width))
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        own, col = owner[k], group[k] - a
        in_l, in_r = place_l[own] >= 0, place_r[own] >= 0
        x[place_l[own[in_l]], col[in_l]] = 1
        y[place_r[own[in_r]], col[in_r]] = 1
        same += x @ y.T
    links, parent = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, one in zip(left.tolist(), same):
        union = size[i] + size[right] - one
        close = right[one >= threshold * union - 1e-6 * union]
        close = close[close != i]
        if len(close):
            close = close[allowed(i, close)]
        for j in close.tolist():
            links[i] += weight[j]
            links[j] += weight[i]
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return links, np.array([root(k) for k in range(len(sets))])


def _links(members: DataFrame, threshold: float, words: int) -> DataFrame:
    """node, other, links per member and task, from rows (bucket, band, x, y, node, size, bands, text)."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        band, x, y = int(pdf.band[0]), int(pdf.x[0]), int(pdf.y[0])
        sets = [np.frombuffer(s, np.uint64) for s in pdf.shingles]
        bands = np.stack(pdf.bands.to_numpy())
        own = pdf.own.to_numpy()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)

        def first_here(i: int, js: np.ndarray) -> np.ndarray:
            fresh = ~(bands[js, :band] == bands[i, :band]).any(axis=1)
            return fresh & (js > i) if x == y else fresh

        links, roots = _compare(sets, pdf["size"].to_numpy(), first_here, threshold, left, right)
        out = pd.DataFrame({"node": pdf.node, "other": pdf.node.to_numpy()[roots], "links": links})
        return out[links > 0]

    return members.groupBy("bucket", "band", "x", "y").applyInPandas(compare, "node long, other long, links long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, set_id, class_id, n_links, t1, t2.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least ``threshold``; ``n_links`` counts
    the other documents linked to this one, ``class_id`` is shared by all that hang together and ``set_id`` by those
    with equal sets (numbers without meaning). Texts that are null or without words link to nothing: each has null
    ids and no links. Repeated rows count as documents. Other columns are ignored.
    """
    bands, rows = bands_and_rows(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")
    )
    all_rows = materialize(sketches(source, bands, rows, words))
    sets = all_rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "t1", "t2", "bands")).alias("one")
    )
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()).select("digest", "node", "size", "one.*"))

    meet = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    full = meet.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("who2")
    ).filter("n > 1")
    # Buckets with the same members would be compared to the same end; the lowest band has all their first meetings.
    kept = materialize(full.groupBy("n", "who", "who2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("n", "b.*"))
    inside = materialize(meet.join(kept, ["band", "bucket"]))

    # Full sets of those that meet anybody.
    wanted = inside.select("node").distinct().join(nodes, "node").select("node", "size", "bands", "doc_id", "t1", "t2")
    key = [source["doc_id"].eqNullSafe(wanted["doc_id"]), source["t1"] == wanted["t1"], source["t2"] == wanted["t2"]]
    texts = source.join(wanted, key).select("node", "size", "bands", "text")
    shingled = materialize(_shingles(texts, words))
    # A bucket of more than BLOCK members is dealt into blocks, which meet two at a time.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = inside.select("*", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), blocks.alias("blocks")).select(
        "band", "bucket", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    ).select("*", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    found = materialize(_links(dealt.join(shingled, "node"), threshold, words))

    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = materialize(
        nodes.join(degree, "node", "left").join(roots, "node", "left").select(
            "digest", F.col("node").alias("set_id"), F.coalesce("root", "node").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        )
    )
    return all_rows.select("doc_id", "t1", "t2", "digest").join(classes, "digest", "left").select(
        "doc_id", "set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "t1", "t2"
    )


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part, some in slices(batch):
                data = [s.tobytes() for s in shingler.sets(some)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("node", "size", "bands")), pa.array(data, pa.binary())], ["node", "size", "bands", "shingles"]
                )

    return texts.mapInArrow(shingle, "node long, size long, bands array<long>, shingles binary")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the largest id (nulls last); texts without words all stay."""
    found = materialize(near_duplicates(docs, threshold, id_col=id_col, text_col=text_col))
    best = found.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.max(F.struct("doc_id", "t1", "t2")).alias("one"))
    stays = best.select("one.*").union(found.filter("class_id IS NULL").select("doc_id", "t1", "t2").distinct())
    stays = stays.toDF("_stays", "_t1", "_t2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(7), text)})
    same = keyed[id_col].eqNullSafe(F.col("_stays")) & (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2"))
    kept = keyed.join(stays, same, "left_semi")
    if not found.filter("class_id IS NOT NULL").groupBy("doc_id", "t1", "t2").count().filter("count > 1").isEmpty():
        worded = text.rlike(r"(?U)\S")
        kept = kept.filter(worded).dropDuplicates([id_col, "_k1", "_k2"]).union(kept.filter(~worded))
    return kept.drop("_k1", "_k2")
