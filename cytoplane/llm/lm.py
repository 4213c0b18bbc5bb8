"""Language-model scores by a weighted backoff automaton.

The automaton has an arc from its root for every word of the training text, and a failure arc from there into the
spelling of words, which reads the text (words joined by spaces and closed by an end mark) byte by byte. Its n-grams are
counted over all training text and smoothed (Witten-Bell); those that make up at least ``SHARE`` of all positions become
states and arcs. An arc carries a symbol's log-probability; where a state has none, its failure arc leads to the next shorter
context and adds the backoff weight. A share bounds the automaton (at most 1 / SHARE n-grams of each order) and means
the same at every size. A traversal from left to right is, before any symbol, in the state that the ``ORDER - 1`` symbols
before it lead to; so the different n-grams of a run of texts are traversed once each, all of them in step.

Words and pairs of words are not bounded by anything, so they are not broadcast: all of them are counted, and every block
of documents gets back the counts of those it holds. Automaton and word counts are the shorter context of the pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import Shelf, offsets_of, segment_sum, shuffles_released, slices

ORDER, SHARE, WORD_WEIGHT = 6, 1e-6, 0.1
#: What a context's counts may weigh next to the shorter context; chosen by how often the context was met (powers of two).
WEIGHTS, LEVELS = np.array([0, 0.003, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97]), 40
#: Groups that words and pairs are dealt into; more where there are more blocks.
GROUPS = 1024
END = 10  # the byte that ends a text; words never hold it
#: Text of a block, and of what is read at once.
BLOCK_CHARS, READ_CHARS = 3_000_000, 2_000_000
_LN10 = np.log(10)


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z, split at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def stream(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each after ORDER - 1 end marks and closed by one; and where each text's symbols start."""
    pad = bytes([END]) * (ORDER - 1)
    data = b"".join([x for d in docs for x in (pad, d, b"\n")])
    return np.frombuffer(data, np.uint8), offsets_of([len(d) + ORDER for d in docs])


def packed(symbols: np.ndarray) -> np.ndarray:
    """The ORDER symbols that end at each place, as one number; none for the first places."""
    wide = symbols.astype(np.int64)
    key = np.zeros(max(0, len(wide) - ORDER + 1), np.int64)
    for k in range(ORDER):
        key = (key << 8) | wide[k : len(wide) - ORDER + 1 + k]
    return key


def gram_counts(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of ORDER bytes that end in a symbol of a text, and how often."""
    symbols, starts = stream(docs)
    key = packed(symbols)
    ends = np.ones(len(key), bool)
    for s in starts[1:-1].tolist():
        ends[s - ORDER + 1 : s] = False  # n-grams that end in the marks before a text
    return np.unique(key[ends], return_counts=True)


@dataclass
class Automaton:
    """States are contexts, numbered; arc keys are state * 256 + symbol, sorted."""

    keys: np.ndarray
    cost: np.ndarray  # log10 probability of each arc
    to: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray  # log10 weight of each state's failure arc
    space: np.ndarray  # log10 probability of a space and of the end mark in each state
    end: np.ndarray

    def __post_init__(self):
        # Arcs by open addressing: at most a quarter of the slots is taken, so most look-ups end at once.
        self.bits = max(8, (4 * len(self.keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_arc = np.zeros(1 << self.bits, np.int32)
        at, todo = self._slot(self.keys), np.arange(len(self.keys))
        while len(todo):
            free = todo[self.slot_key[at[todo]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            self.slot_key[slots], self.slot_arc[slots] = self.keys[free[first]], free[first]
            todo = todo[self.slot_key[at[todo]] != self.keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def arcs(self, keys: np.ndarray) -> np.ndarray:
        """The arc of each key, or -1."""
        at = self._slot(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_arc[at], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.slot_arc[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of a symbol in each state, and the state after it."""
        gained, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo, now = np.arange(len(state)), state
        while len(todo):
            k = self.arcs(now * 256 + symbol[todo])
            hit = k >= 0
            found = todo[hit]
            gained[found] += self.cost[k[hit]]
            after[found] = self.to[k[hit]]
            todo, now = todo[~hit], now[~hit]
            gained[todo] += self.backoff[now]
            now = self.fail[now]
        return gained, after

    def read(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts in a row: log10 probability of each symbol, the state before it, and where texts start."""
        symbols, starts = stream(docs)
        key = packed(np.concatenate([np.full(ORDER - 1, END, np.uint8), symbols]))
        where, grams = pd.factorize(key)
        behind, before = pd.factorize(grams >> 8)
        state = np.zeros(len(before), np.int64)
        for k in range(ORDER - 2, -1, -1):
            _, state = self.step(state, before >> 8 * k & 255)
        gained, _ = self.step(state[behind], grams & 255)
        return gained[where], state[behind].astype(np.int32)[where], starts

    def spell(self, docs: list[bytes]) -> np.ndarray:
        """log10 probability of each token of the texts, words and then the end, as the automaton spells them.

        A word is its bytes and the fact that it ends; before it stands the choice that the text goes on, in place of
        the choice that it ends, which is the end token.
        """
        logs, states, starts = self.read(docs)
        run = np.concatenate([[0.0], np.cumsum(logs)])
        symbols, _ = stream(docs)
        given = np.zeros(len(symbols), bool)
        for k in range(ORDER - 1):
            given[starts[:-1] + k] = True
        # Symbols after which nothing more of a word comes: spaces and ends of texts.
        stop = np.flatnonzero(((symbols == 32) | (symbols == END)) & ~given)
        first = np.zeros(len(stop), bool)
        begins = starts[:-1] + ORDER - 1
        where = np.searchsorted(stop, begins)
        first[where] = True
        word_at = np.where(first, np.repeat(begins, np.diff(np.append(where, len(stop)))), np.concatenate([[0], stop[:-1] + 1]))
        space, end = self.space[states[stop]], self.end[states[stop]]
        stops = np.logaddexp(space * _LN10, end * _LN10) / _LN10
        # The choice before each word: at the start of a text, or where the word before it stopped.
        start_end = self.end[states[begins]]
        on = np.empty(len(stop))
        on[~first] = (space - stops)[np.flatnonzero(~first) - 1]
        on[first] = np.log10(np.maximum(1 - 10**start_end, 1e-12))
        empty = stop == word_at  # only where a text has no word
        words = run[stop] - run[word_at] + stops + on
        last = symbols[stop] == END
        ends = np.where(empty, start_end[np.repeat(np.arange(len(begins)), np.diff(np.append(where, len(stop))))], end - stops)
        # Tokens in order: every word, and after the last of a text its end.
        token, kind = np.concatenate([stop[~empty] * 2, stop[last] * 2 + 1]), np.concatenate([words[~empty], ends[last]])
        return kind[np.argsort(token, kind="stable")]


def build(grams: pd.DataFrame, single: np.ndarray) -> Automaton:
    """From rows (size, gram, n, total, kinds) of the kept n-grams of two and more symbols, and counts of single symbols.

    ``total`` and ``kinds`` are those of the n-gram's context: its count and its number of different successors, before
    anything was left out.
    """
    p1 = (single + 1) / (single.sum() + 256)
    number: dict[tuple[int, int], int] = {(0, 0): 0} | {(1, b): b + 1 for b in range(256)}
    prob: dict[tuple[int, int], float] = {(1, b): float(p) for b, p in enumerate(p1)}
    by_context: dict[tuple[int, int], list[tuple[int, float]]] = {}
    grams = grams.sort_values(["size", "gram"])
    for size, gram, n, total, kinds in grams.itertuples(index=False):
        if (size - 1, gram >> 8) not in number:
            continue  # begins with two of the marks before a text, which tell no more than one
        if size < ORDER:
            number[size, gram] = len(number)
        prob[size, gram] = n / (total + kinds)
        by_context.setdefault((size - 1, gram >> 8), []).append((gram & 255, prob[size, gram]))
    count = len(number)
    fail, weight = np.zeros(count, np.int64), np.zeros(count)

    def shorter(size: int, gram: int) -> tuple[int, int]:
        """The longest proper suffix that is a context."""
        while size:
            size -= 1
            gram &= (1 << 8 * size) - 1
            if (size, gram) in number:
                break
        return size, gram

    # Lower orders first: the weight needs what the shorter context gives to the successors that are kept here.
    full: dict[tuple[int, int], float] = {}

    def smoothed(context: tuple[int, int], b: int) -> float:
        factor = 1.0
        while True:
            size, gram = context
            p = prob.get((size + 1, gram << 8 | b))
            if p is not None:
                return factor * p
            factor *= full.get(context, 1.0)
            context = shorter(*context)

    for context in sorted(number):
        if context == (0, 0):
            continue
        back = shorter(*context)
        fail[number[context]] = number[back]
        arcs = by_context.get(context, [])
        if arcs:
            rest = 1 - sum(p for _, p in arcs)
            below = 1 - sum(smoothed(back, b) for b, _ in arcs)
            full[context] = max(rest, 1e-12) / max(below, 1e-12)
            weight[number[context]] = np.log10(full[context])
    keys, cost, to = [], [], []
    for (size, gram), p in prob.items():
        source = number[size - 1, gram >> 8]
        target = (size, gram) if (size, gram) in number else shorter(size, gram)
        keys.append(source * 256 + (gram & 255))
        cost.append(np.log10(p))
        to.append(number[target])
    order = np.argsort(keys)
    space, end = (np.array([np.log10(smoothed(x, b)) for x in number]) for b in (32, END))
    return Automaton(np.array(keys)[order], np.array(cost)[order], np.array(to)[order], fail, weight, space, end)


def contexts(times: np.ndarray, texts: float) -> np.ndarray:
    """How often the token before each token was met in training; before the first of a text stands an end."""
    return np.concatenate([[texts], times])[:-1].astype(np.int64)


def _level(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1]


def left_out(train: np.ndarray, times: np.ndarray, n: int, v: int, before: np.ndarray, met: np.ndarray) -> np.ndarray:
    """By level and weight: log-probability of the training tokens, each from the counts of all the others."""
    out = np.zeros((LEVELS, len(WEIGHTS)))
    at = np.flatnonzero(train & (before > 1))
    context = before[at] - 1
    hit, level, alone = (met[at] - 1) / context, _level(context), times[at] / (n + v)
    for k, w in enumerate(WEIGHTS):
        out[:, k] = np.bincount(level, np.log(w * hit + (1 - w) * alone), LEVELS)
    return out


def in_context(alone: np.ndarray, weights: np.ndarray, before: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of tokens after the one before them, from those of the tokens ``alone``."""
    w = np.where(before > 0, weights[_level(before)], 0)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(w * met / np.maximum(before, 1)), np.log(1 - w) + alone)


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block of documents: their ids, compressed texts, numbers of tokens and whether held out."""
    kind = dict(docs.dtypes)["doc_id"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, texts in slices(batch, chars=BLOCK_CHARS):
                split = [words_of(x) for x in texts]
                data = press.compress(b"\n".join(map(b" ".join, split)))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part.column("doc_id")),
                     pa.array([part.column("held_out").to_pylist()], pa.list_(pa.bool_())),
                     pa.array([[len(x) + 1 for x in split]], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                    ["doc_id", "held_out", "n", "data"],
                )

    return docs.mapInArrow(gather, f"doc_id array<{kind}>, held_out array<boolean>, n array<long>, data binary")


def _texts(row: dict) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(row["data"]).split(b"\n")[: len(row["n"])]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about READ_CHARS bytes together."""
    ends, at = np.cumsum([len(x) for x in texts]), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + READ_CHARS, side="right")))
        yield at, to
        at = to


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words in the order in which they are met, then the end, and the number of each token."""
    flat = list(chain.from_iterable((*d.split(), b"") for d in texts))
    order: dict[bytes, int] = defaultdict(count().__next__)
    each = np.fromiter(map(order.__getitem__, flat), np.int64, len(flat))
    end = order.pop(b"")
    each = np.where(each == end, len(order), each - (each > end))
    return [*order, b""], each


def digests_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pairs_of(h: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Digests of the pair that ends in each token, from the words' digests. The end of a text stands before the next one."""
    x = np.concatenate([h[-1:], h[each[:-1]]]) * np.uint64(0x9E3779B97F4A7C15) + h[each]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits byte by byte, so that high bytes that are zero lie together and compress."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def group_bits(blocks: int) -> int:
    """Groups, as a power of two, that words and pairs are dealt into by the highest bits of their digests."""
    return (max(GROUPS, 2 * blocks) - 1).bit_length()


def _counts(blocks: DataFrame, bits: int) -> DataFrame:
    """block, pairs, part, c, n, v: the training counts of what a block has in a group, its different pairs of words in the
    order of their digests or its words as they are met; in one row of a group of words, N and V of the group.

    A group is added up at once; a row is all that a block has in it, so the commonest word weighs no more than any other.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, every = ["block", "pairs", "part", "keys", "counts"], np.arange((1 << bits) + 1, dtype=np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("block", "held_out", "n", "data")}
                words, each = _tokens(_texts(row))
                h = digests_of(words)
                train = np.repeat(~np.array(row["held_out"], bool), row["n"])
                keys, where = np.unique(pairs_of(h, each), return_inverse=True)
                by_group = np.argsort(h >> np.uint64(64 - bits), kind="stable")
                spelled = [words[x] for x in by_group.tolist()]
                for pairs, digests, n in (
                    (True, keys, np.bincount(where, train, len(keys))), (False, h[by_group], np.bincount(each, train, len(words))[by_group])
                ):
                    n, cuts = n.astype(np.int64), np.searchsorted(digests >> np.uint64(64 - bits), every)
                    full = np.flatnonzero(np.diff(cuts))
                    bounds = list(zip(cuts[full].tolist(), cuts[full + 1].tolist()))
                    held = [_planes(np.diff(keys[a:b], prepend=np.uint64(0))) if pairs else b"\n".join(spelled[a:b]) for a, b in bounds]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(full), row["block"])), pa.array(np.full(len(full), pairs)), pa.array(full),
                         pa.array(held, pa.binary()), pa.array([_planes(n[a:b]) for a, b in bounds], pa.binary())],
                        names,
                    )

    def add(group: pa.Table) -> pa.Table:
        counts = [_numbers(x, np.int64) for x in group.column("counts").to_pylist()]
        blobs, pairs = group.column("keys").to_pylist(), group.column("pairs")[0].as_py()
        if pairs:
            _, where = np.unique(np.concatenate([np.cumsum(_numbers(x, np.uint64), dtype=np.uint64) for x in blobs]), return_inverse=True)
        else:
            order: dict[bytes, int] = {}
            where = np.array([order.setdefault(w, len(order)) for x in blobs for w in x.split(b"\n")])
        total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        of_group = np.zeros((2, len(blobs)), np.int64)
        if not pairs:
            of_group[:, 0] = total.sum(), (total > 0).sum()
        ends = np.cumsum([len(x) for x in counts])
        return pa.table({
            **{c: group.column(c) for c in ("block", "pairs", "part")},
            "c": pa.array([_planes(x) for x in np.split(total[where], ends[:-1])], pa.binary()), "n": of_group[0], "v": of_group[1],
        })

    dealt = blocks.select("block", "held_out", "n", "data").mapInArrow(deal, "block long, pairs boolean, part long, keys binary, counts binary")
    return dealt.groupBy("pairs", "part").applyInArrow(add, "block long, pairs boolean, part long, c binary, n long, v long")


def _returned(counts: DataFrame) -> DataFrame:
    """block, words, pairs: the counts of a block in the order of the groups."""
    lists = (F.array_sort(F.collect_list(F.when(x, F.struct("part", "c")))) for x in (~F.col("pairs"), F.col("pairs")))
    found = counts.groupBy("block").agg(*(x.alias(name) for x, name in zip(lists, ("words", "pairs"))))
    return found.select("block", *(F.transform(name, lambda x: x["c"]).alias(name) for name in ("words", "pairs")))


def word_counts(h: np.ndarray, found: list[bytes], bits: int) -> np.ndarray:
    """The counts that came back for a block's words, in the order of the words."""
    c = np.zeros(len(h), np.int64)
    c[np.argsort(h >> np.uint64(64 - bits), kind="stable")] = np.concatenate([_numbers(x, np.int64) for x in found])
    return c


def _grams(blocks: DataFrame) -> DataFrame:
    """gram, n over training texts, merged within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                some = [d for d, out in zip(_texts(row), row["held_out"]) if not out]
                if not some:
                    continue
                new, n = gram_counts(some)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    return blocks.select("held_out", "n", "data").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(blocks: DataFrame, shelf: Shelf, share: float = SHARE) -> Automaton:
    """The automaton of the training texts of ``blocks``; without any, every symbol is equally likely."""
    grams = shelf.put(_grams(blocks), "lm-grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    parts = []
    for size in range(2, ORDER + 1):
        cut = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        context = F.shiftright("gram", 8).alias("context")
        often = cut.filter(F.col("n") >= share * total).select(context, "gram", "n")
        stats = cut.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter(F.col("total") >= share * total)
        parts.append(often.join(stats, "context").select(F.lit(size).alias("size"), "gram", "n", "total", "kinds"))
    kept = parts[0]
    for x in parts[1:]:
        kept = kept.union(x)
    single = np.zeros(256)
    for r in grams.groupBy(F.col("gram").bitwiseAND(F.lit(255)).alias("b")).agg(F.sum("n").alias("n")).collect():
        single[r.b] = r.n
    return build(kept.toPandas(), single)


def score_documents(docs: DataFrame, held_out: Column, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows for which ``held_out`` is false. Null and empty texts are the end alone. ``base_score`` is the
    add-one unigram of words; ``score`` the log10 probability by pairs of words, with the automaton and the words' own
    counts as shorter context. Without training rows N is 0 and all are unknown. Rows that repeat each count; an empty table gives no rows.
    """
    with shuffles_released(docs.sparkSession):
        return _scored(docs, held_out, share, id_col, text_col, Shelf(docs.sparkSession))


def _scored(docs: DataFrame, held_out: Column, share: float, id_col: str, text_col: str, shelf: Shelf) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))
    blocks = shelf.put(_blocks(rows).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    bits = group_bits(blocks.count())
    counts = shelf.put(_counts(blocks, bits), "lm-counts")
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v"))).first()
    n, v = totals.n, totals.v
    # Each block gets the counts of its own words and pairs back, in their order.
    whole = blocks.join(_returned(counts), "block")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {x: batch.column(x)[k].as_py() for x in ("held_out", "n", "data", "words", "pairs")}
                words, each = _tokens(_texts(row))
                h = digests_of(words)
                c = word_counts(h, row["words"], bits)
                _, where = np.unique(pairs_of(h, each), return_inverse=True)
                met = np.concatenate([_numbers(x, np.int64) for x in row["pairs"]])[where]
                train = np.repeat(~np.array(row["held_out"], bool), row["n"])
                sums = left_out(train, c[each], n, v, contexts(c[each], c[-1]), met)
                # By token, so that texts need not be split into words again.
                told = [pa.array([press.compress(_planes(x))], pa.binary()) for x in (c[each], met)]
                columns = ("doc_id", "held_out", "n", "data")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(k, 1) for x in columns), *told, pa.array([sums.ravel()], pa.list_(pa.float64()))],
                    [*columns, "times", "pairs", "sums"],
                )

    whole = shelf.put(
        whole.mapInArrow(
            align,
            f"doc_id array<{kind}>, held_out array<boolean>, n array<long>, data binary, times binary, pairs binary, sums array<double>",
        ),
        "lm-pairs",
    )
    likely = np.zeros(LEVELS * len(WEIGHTS))
    for r in whole.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        likely[r.k] = r.x
    weights = WEIGHTS[likely.reshape(LEVELS, len(WEIGHTS)).argmax(axis=1)]
    shelf.drop("lm-counts")
    model = fit(blocks, shelf, share)
    shelf.drop("lm-grams", "lm-blocks")
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))  # at most ORDER / share n-grams

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, weights = shared.value
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("n", "data", "times", "pairs")}
                texts = _texts(row)
                times, met = (_numbers(press.decompress(row[x]), np.int64) for x in ("times", "pairs"))
                base = np.log10((times + 1.0) / (n + v + 1))
                spelled = np.concatenate([automaton.spell(texts[a:b]) for a, b in _runs(texts)])
                # A word's own arc next to the arcs that spell it, with fixed weights (Jelinek-Mercer).
                share = WORD_WEIGHT if n else 0.0
                with np.errstate(divide="ignore"):
                    own = np.log(times * share / max(n, 1))
                scores = np.logaddexp(own, np.log(1 - share) + spelled * _LN10)
                # The last token of a block is an end.
                scores = in_context(scores, weights, contexts(times, times[-1]), met)
                sums = segment_sum(np.column_stack([base, times > 0, scores / _LN10]), offsets_of(row["n"]))
                ids = batch.column("doc_id")[k].values
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column("held_out")[k].values, pa.array(row["n"], pa.int64()), pa.array(np.rint(sums[:, 1]).astype(np.int64)),
                     pa.array(np.full(len(texts), n, np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return whole.drop("sums").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
