"""Repeated passages by a sparse suffix array.

Suffixes begin only at minimiser positions: of any run of ``WINDOW`` word k-grams, the one with the smallest hash. A
passage of ``WINDOW + GRAM - 1`` words has the same minimisers wherever it stands, so every repeated passage of
``MIN_WORDS`` holds a retained suffix in each of its places. Suffixes whose first k-gram occurs once in the corpus end
there. The others are sorted with a bounded context on both sides, once by what follows and once by what precedes;
each is compared with its neighbours and the match extended to the right and the left. A partner need not be a neighbour
where a gram stands in more than two contexts; there, all windows of the least length that hold it are counted by their
digests. The context is long enough to certify a passage of the least length; longer passages are the union of the matches at their many retained positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.common import Shelf, chunks, offsets_of, shuffles_released, slices

MIN_WORDS, GRAM = 50, 8
#: Text that a task looks at together.
TASK_CHARS = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: White space that parts words, by code point: what ``chunks`` splits at.
_SPACE = np.array([chr(c).isspace() and not 0x1C <= c <= 0x1F for c in range(0x3002)])


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some run of ``window`` (the leftmost of equals); all of a shorter array's minimum."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([int(h.argmin())])
    # Least value and its leftmost place of runs that double in length up to the window.
    least, at, size = h, np.arange(len(h)), 1
    while size < window:
        step = min(size, window - size)
        at = np.where(least[:-step] <= least[step:], at[:-step], at[step:])
        least = np.minimum(least[:-step], least[step:])
        size += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]  # places of later runs are never further left


def word_hashes(parts: list[list[str]]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(parts)), np.uint64)


def gram_hashes(parts: list[list[str]], gram: int) -> Iterator[np.ndarray]:
    """Hashes of the k-grams of words of each text."""
    each = word_hashes(parts)
    joined = each[: max(0, len(each) - gram + 1)].copy()
    for k in range(1, gram):
        joined *= _MULTIPLIER
        joined += each[k : len(joined) + k]
    joined ^= joined >> np.uint64(31)
    joined *= _MULTIPLIER
    at = 0
    for part in parts:
        yield joined[at : at + max(0, len(part) - gram + 1)]
        at += len(part)


def _positions(texts: DataFrame, gram: int, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in slices(batch, chars=TASK_CHARS):
                words = [chunks(x) for x in some]
                at, hashes = [], []
                left = [x.find(w[0]) if w else 0 for x, w in zip(some, words)]
                right = [x.rfind(w[-1]) + len(w[-1]) if w else 0 for x, w in zip(some, words)]
                for h in gram_hashes(words, gram):
                    k = minimisers(h, window)
                    at.append(k.astype(np.int32))
                    hashes.append(h[k].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array(map(len, words), pa.int64()),
                     pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "t1", "t2", "n", "first", "last", "at", "h"],
                )

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(find, f"doc_id {kind}, t1 long, t2 long, n long, first long, last long, at array<int>, h array<long>")


def _packed(texts: DataFrame) -> DataFrame:
    """``texts`` with ``data``, the compressed text, in place of ``text``: what the join below has to move."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, some in slices(batch, chars=TASK_CHARS):
                data = pa.array([press.compress(x.encode("utf-8", "surrogatepass")) for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "t1", "t2")), data], ["doc_id", "t1", "t2", "data"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("doc_id", "t1", "t2", "text").mapInArrow(pack, f"doc_id {kind}, t1 long, t2 long, data binary")


def _contexts(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """Per text: its node, code-point bounds of its words (``gaps``, ``sizes``), and the context of each position in ``at``.

    ``after`` begins at the position; ``before`` has the words before it in reverse.
    """
    kind = "node long, gaps array<int>, sizes array<int>, places array<struct<at:int,h:long,after:string,before:string>>"
    places = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64()), ("after", pa.string()), ("before", pa.string())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 20):
                part = batch.slice(k, 20)
                gaps, sizes, found = [], [], []
                for data, at, h in zip(*(part.column(c).to_pylist() for c in ("data", "at", "h"))):
                    text = press.decompress(data).decode("utf-8", "surrogatepass")
                    bounds = word_bounds(text)
                    gaps.append(np.diff(bounds[:, 0], prepend=0).astype(np.int32))
                    sizes.append((bounds[:, 1] - bounds[:, 0]).astype(np.int32))
                    words = chunks(text)
                    found.append([
                        {"at": p, "h": v, "after": " ".join(words[p : p + min_words]), "before": " ".join(words[max(0, p - min_words + gram) : p][::-1])}
                        for p, v in zip(at, h)
                    ])
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(gaps, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), pa.array(found, places)],
                    ["node", "gaps", "sizes", "places"],
                )

    return texts.select("node", "at", "h", "data").mapInArrow(cut, kind)


def _common(a: str, b: str) -> int:
    """Words that two lists of words, joined by spaces, begin with in common."""
    if a == b:
        return a.count(" ") + 1 if a else 0
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    n = a.count(" ", 0, low)
    # The word at which they part counts if both end there.
    return n + 1 if low and (low == len(a) or a[low] == " ") and (low == len(b) or b[low] == " ") else n


def match(x: tuple, y: tuple, min_words: int) -> tuple[int, int]:
    """Words in common before and after two suffixes (h, after, before); none if together they are too few."""
    if x[0] != y[0]:
        return 0, 0
    right, left = _common(x[1], y[1]), _common(x[2], y[2])
    return (left, right) if left + right >= min_words else (0, 0)


def _neighbours(contexts: DataFrame, by: list[str], min_words: int, shelf: Shelf) -> DataFrame:
    """h, after, before (as digests c1, c2), lefts, rights: the best matches with the neighbours in the order of ``by``."""
    kinds = "c1 long, c2 long, lefts int, rights int, part int, side int, h long, after string, before string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, last_id, best = TaskContext.get().partitionId(), None, None, (0, 0)

        def rows(out: list, edges: list) -> pa.RecordBatch:
            table = [(*i, *b, None, None, None, None, None) for i, b in out] + [(*i, 0, 0, part, side, *x) for i, x, side in edges]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            names = ["c1", "c2", "lefts", "rights", "part", "side", "h", "after", "before"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table) if table else [[]] * 9, types)], names)

        for batch in batches:
            out, edges = [], []
            for c1, c2, *x in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "h", "after", "before"))):
                if last is None:
                    edges.append(((c1, c2), x, 0))
                    now = (0, 0)
                else:
                    now = match(last, x, min_words)
                    best = (max(best[0], now[0]), max(best[1], now[1]))
                    if best != (0, 0):
                        out.append((last_id, best))
                last, last_id, best = x, (c1, c2), now
            yield rows(out, edges)
        if last is not None:
            yield rows([(last_id, best)] if best != (0, 0) else [], [(last_id, last, 1)])

    ordered = contexts.repartitionByRange(*by).sortWithinPartitions(*by)
    found = shelf.put(ordered.select("c1", "c2", "h", "after", "before").mapInArrow(compare, kinds), f"suffix-by-{by[1]}")
    # The last suffix of a partition and the first of the next one that has any; one row of numbers per partition is
    # ordered in one task, the suffixes themselves meet by a join.
    first, end = found.filter("side = 0"), found.filter("side = 1")
    follows = first.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part"))).filter("next IS NOT NULL")
    pairs = end.join(follows, "part").select("next", *(F.col(c).alias(f"l_{c}") for c in ("c1", "c2", "h", "after", "before")))
    pairs = pairs.join(first.withColumnRenamed("part", "next"), "next")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = match((r["l_h"], r["l_after"], r["l_before"]), (r["h"], r["after"], r["before"]), min_words)
                if right:
                    out += [(r["l_c1"], r["l_c2"], left, right), (r["c1"], r["c2"], left, right)]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["c1", "c2", "lefts", "rights"]
            )

    plain = found.filter("side IS NULL").select("c1", "c2", "lefts", "rights")
    return plain.union(pairs.mapInArrow(across, "c1 long, c2 long, lefts int, rights int"))


def window_digests(words: list[list[str]], lefts: np.ndarray, rights: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of contexts (``lefts`` words before the gram, ``rights`` from it on): number of the context, words before the gram
    and digest of each window of ``min_words`` that holds the gram."""
    each = word_hashes(words)
    # Sums of hash times power; dividing by the power at the window's start makes a digest the same at every place.
    powers, backs = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(each), x)]), dtype=np.uint64) for x in (_MULTIPLIER, _INVERSE))
    run = np.concatenate([[np.uint64(0)], np.cumsum(each * powers[:-1], dtype=np.uint64)])
    low, high = np.maximum(0, min_words - rights), np.minimum(lefts, min_words - gram)
    counts = np.maximum(0, high - low + 1)
    where, ends = np.repeat(np.arange(len(words)), counts), offsets_of(counts)
    i = low[where] + np.arange(ends[-1]) - ends[:-1][where]
    start = offsets_of(lefts + rights)[:-1][where] + lefts[where] - i
    x = (run[start + min_words] - run[start]) * backs[start] + i.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return where, i, x ^ (x >> np.uint64(29))


def _windows(contexts: DataFrame, min_words: int, gram: int, shelf: Shelf) -> DataFrame:
    """c1, c2, lefts, rights: what the windows of ``min_words`` around the gram that another context holds too cover together.

    Windows are counted by digests alone, and cut again to be met with those that stand more than once: none is stored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                right = [x.split(" ") for x in part.column("after").to_pylist()]
                left = [x.split(" ")[::-1] if x else [] for x in part.column("before").to_pylist()]
                where, lefts, digests = window_digests(
                    [a + b for a, b in zip(left, right)], np.array([len(x) for x in left]), np.array([len(x) for x in right]), min_words, gram
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(where)) for c in ("c1", "c2", "h")), pa.array(lefts.astype(np.int32)), pa.array(digests.view(np.int64))],
                    ["c1", "c2", "h", "lefts", "w"],
                )

    each = contexts.select("c1", "c2", "h", "after", "before").mapInArrow(cut, "c1 long, c2 long, h long, lefts int, w long")
    often = shelf.put(each.groupBy("h", "w").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h", "w"), "suffix-windows")
    # All these windows hold the gram, so that together they are one run.
    return each.join(often, ["h", "w"]).groupBy("c1", "c2").agg(
        F.max("lefts").alias("lefts"), (F.lit(min_words) - F.min("lefts")).alias("rights")
    )


def _merge(spans):
    """Sorted spans with those that touch made one."""
    start = F.array_sort(spans)
    one = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    empty = F.filter(F.array(one), lambda x: F.lit(False))
    return F.aggregate(
        start,
        F.struct(empty.alias("done"), one.alias("open")),
        lambda acc, s: F.when(
            s["a"] <= acc["open"]["b"],
            F.struct(acc["done"].alias("done"), F.struct(acc["open"]["a"].alias("a"), F.greatest(acc["open"]["b"], s["b"]).alias("b")).alias("open")),
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.struct(s["a"].alias("a"), s["b"].alias("b")).alias("open"))),
        lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: x["a"] >= 0),
    )


def _bounds(spans: DataFrame) -> DataFrame:
    """Word spans of texts with their code-point bounds."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gaps, sizes, spans in zip(*(batch.column(c) for c in ("gaps", "sizes", "spans"))):
                starts, sizes = np.cumsum(gaps.values.to_numpy(), dtype=np.int64), sizes.values
                out.append([
                    {"start": int(starts[x["a"]]), "end": int(starts[x["b"] - 1]) + sizes[x["b"] - 1].as_py(), "start_word": x["a"], "end_word": x["b"]}
                    for x in spans.as_py()
                ])
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "start_word", "end_word")]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, kind)], ["node", "spans"])

    return spans.mapInArrow(place, "node long, spans array<struct<start:long,end:long,start_word:long,end_word:long>>")


def word_bounds(text: str) -> np.ndarray:
    """Code-point start and end of each word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ~_SPACE[np.minimum(points, len(_SPACE) - 1)]
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return turns.reshape(-1, 2)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage of a document: doc_id, start, end (code points), start_word, end_word (ends exclusive).

    A passage is a run of at least ``min_words`` white-space separated words that stands in the corpus more than once,
    in different documents or twice in one; passages that touch or overlap are one row. Every place is listed, also
    the first. Null and short texts have none. Rows that repeat id and text are one document. An empty table gives no rows.
    Tables between the steps are deleted after their last reader, and shuffle files with the job that wrote them.
    """
    with shuffles_released(docs.sparkSession):
        return _repeated(docs, min_words, gram, id_col, text_col, Shelf(docs.sparkSession))


def _repeated(docs: DataFrame, min_words: int, gram: int, id_col: str, text_col: str, shelf: Shelf) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")
    )
    rows = shelf.put(_positions(source, gram, min_words - gram + 1).filter(F.col("n") >= min_words), "suffix-positions")
    # Equal texts are one node: the whole text is repeated, and one copy of it stands for all in the sort.
    nodes = shelf.put(
        rows.groupBy("t1", "t2").agg(
            F.min(F.struct("doc_id", "n", "first", "last", "at", "h")).alias("one"), F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"),
            F.max(F.col("doc_id").isNull()).alias("_null"),
        ).select("t1", "t2", "one.*", (F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)) | (F.col("_null") & F.col("_lo").isNotNull())).alias("copied"),
                 F.monotonically_increasing_id().alias("node")),
        "suffix-nodes",
    )
    once = _once(source, rows)
    ids = shelf.put(rows.select("doc_id", "t1", "t2").distinct(), "suffix-ids")
    shelf.drop("suffix-positions")
    each = nodes.select("node", F.explode(F.arrays_zip("at", "h")).alias("s")).select("node", "s.at", "s.h")
    often = shelf.put(each.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h"), "suffix-grams")
    alive = each.join(often, "h").groupBy("node").agg(F.collect_list(F.struct("at", "h")).alias("s"))
    wanted = shelf.put(
        alive.join(nodes.select("node", "t1", "t2", "doc_id"), "node").select("node", "t1", "t2", F.col("doc_id").alias("_id"), F.col("s.at").alias("at"), F.col("s.h").alias("h")),
        "suffix-wanted",
    )
    heads = shelf.put(nodes.select("t1", "t2", "n", "first", "last", "copied", "node"), "suffix-heads")
    shelf.drop("suffix-nodes", "suffix-grams")
    packed = _packed(once)
    same = (packed["t1"] == wanted["t1"]) & (packed["t2"] == wanted["t2"]) & packed["doc_id"].eqNullSafe(wanted["_id"])
    texts = shelf.put(_contexts(packed.join(wanted, same), min_words, gram), "suffix-texts")
    shelf.drop("suffix-wanted")
    places = texts.select("node", F.explode("places").alias("p")).select("node", "p.*")
    places = places.withColumns({"c1": F.xxhash64("h", "after", "before"), "c2": F.xxhash64(F.lit(7), "before", "h", "after")})
    contexts = shelf.put(places.groupBy("c1", "c2", "h", "after", "before").agg(F.count(F.lit(1)).alias("times")), "suffix-contexts")
    spots = shelf.put(places.select("node", "at", "c1", "c2"), "suffix-spots")
    bounds = shelf.put(texts.select("node", "gaps", "sizes"), "suffix-bounds")
    shelf.drop("suffix-texts")
    words = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    whole = contexts.filter("times > 1").select("c1", "c2", words("before").alias("lefts"), words("after").alias("rights")).filter(
        F.col("lefts") + F.col("rights") >= min_words
    )
    distinct = contexts.drop("times")
    found = whole
    for by in (["h", "after", "before"], ["h", "before", "after"]):
        found = found.union(_neighbours(distinct, by, min_words, shelf))
    best = shelf.put(found.groupBy("c1", "c2").agg(F.max("lefts").alias("lefts"), F.max("rights").alias("rights")), "suffix-best")
    shelf.drop("suffix-by-after", "suffix-by-before")
    # What is left: grams with more than two contexts, of which some are not matched on their whole length.
    done = best.select("c1", "c2", F.col("lefts").alias("_l"), F.col("rights").alias("_r"))
    part = F.coalesce((F.col("_l") < words("before")) | (F.col("_r") < words("after")), F.lit(True))
    open_grams = distinct.join(done, ["c1", "c2"], "left").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(part).alias("open"))
    left = shelf.put(distinct.join(open_grams.filter("n > 2 AND open").select("h"), "h"), "suffix-open")
    shelf.drop("suffix-contexts")
    more = _windows(left, min_words, gram, shelf)
    best = shelf.put(best.union(more).groupBy("c1", "c2").agg(F.max("lefts").alias("lefts"), F.max("rights").alias("rights")), "suffix-matches")
    shelf.drop("suffix-best", "suffix-open", "suffix-windows")
    spans = spots.join(best, ["c1", "c2"]).select(
        "node", F.struct((F.col("at") - F.col("lefts")).alias("a"), (F.col("at") + F.col("rights")).alias("b")).alias("span")
    )
    by_node = spans.groupBy("node").agg(_merge(F.collect_list("span")).alias("spans"))
    bounded = _bounds(bounds.join(by_node, "node"))
    everything = F.struct(
        F.col("first").alias("start"), F.col("last").alias("end"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word")
    )
    marked = heads.join(bounded, "node", "left").filter("copied OR spans IS NOT NULL")
    marked = shelf.put(marked.select("t1", "t2", F.when(F.col("copied"), F.array(everything)).otherwise(F.col("spans")).alias("spans")), "suffix-marked")
    shelf.drop("suffix-spots", "suffix-matches", "suffix-bounds", "suffix-heads")
    return ids.join(marked, ["t1", "t2"]).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def _once(source: DataFrame, rows: DataFrame) -> DataFrame:
    """``source`` without rows that repeat both id and text, which are looked for only where there are any."""
    if rows.groupBy("doc_id", "t1", "t2").count().filter("count > 1").isEmpty():
        return source
    return source.dropDuplicates(["doc_id", "t1", "t2"])
