"""A Merkle manifest of a dataset: one tree per source, one over the sources, stored in van Emde Boas order.

Trees have 16 children a node. Leaves are numbered per source from one range-partitioned sort, and every 16**3 in a row
form an aligned block, which a task builds alone. A block keeps its nodes in one binary: the tree is cut at half its
height, the upper part stored first and then each lower subtree, each cut again in the same way. The address of any node
follows from its level and index alone, and serves to write a level as well as to read siblings. Roots of blocks are the
leaves of the next round, until a tree is one block; then the way back down gives each block the siblings above it.

A source with a third of all rows is a third of all blocks, so no task ever holds more than one block's leaves at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cytoplane.llm.common import stored
from cytoplane.operators.ordering import running_in_group

#: Children of a node, and levels from a block's leaves to its root.
ARITY = 16
HEIGHT = 3
#: Bytes of a digest as hex text.
HEX = 64


@lru_cache(maxsize=64)
def subtree(levels: int) -> int:
    """Nodes of a full tree with this many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes in the van Emde Boas order of a full tree of ``levels`` levels; the root has depth 0.

    The upper half of the levels comes first. Then come the subtrees under it, from left to right.
    """
    index, base = np.asarray(index, dtype=np.int64), 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        under = ARITY ** (depth - upper)
        base = base + subtree(upper) + index // under * subtree(lower)
        index, depth, levels = index % under, depth - upper, lower
    return base + np.zeros_like(index)


def levels_of(count: int) -> int:
    """Levels of the smallest tree for this many leaves, the leaves' own included."""
    levels = 1
    while ARITY ** (levels - 1) < count:
        levels += 1
    return levels


def join_hex(digests: np.ndarray) -> bytes:
    return digests.tobytes().hex().encode()


def build(leaves: np.ndarray, levels: int) -> bytes:
    """Nodes over ``leaves`` (n x 32 bytes) in van Emde Boas order; what lies beyond the last used place is left off."""
    nodes = np.zeros((subtree(levels), 32), dtype=np.uint8)
    row, used = leaves, 0
    for depth in range(levels - 1, -1, -1):
        at = address(levels, depth, np.arange(len(row)))
        nodes[at] = row
        used = max(used, int(at.max()) + 1)
        if depth:
            text = join_hex(row)
            run = ARITY * HEX
            row = np.frombuffer(b"".join(sha256(text[i:i + run]).digest() for i in range(0, len(text), run)), np.uint8).reshape(-1, 32)
    return nodes[:used].tobytes()


class Block:
    """The nodes of one block, read by address."""

    def __init__(self, nodes: bytes, count: int, levels: int):
        self.nodes, self.levels = np.frombuffer(nodes, np.uint8).reshape(-1, 32), levels
        self.counts = [count]
        for _ in range(levels - 1):
            self.counts.append(-(-self.counts[-1] // ARITY))

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def run(self, depth: int, first: int) -> bytes:
        """The hex digests of the siblings from ``first`` on, in one row."""
        last = min(first + ARITY, self.counts[self.levels - 1 - depth])
        return join_hex(self.nodes[address(self.levels, depth, np.arange(first, last))])

    def paths(self) -> Iterator[list[tuple[bytes, bytes]]]:
        """Of each leaf, the siblings left and right of its way up, level by level below the root."""
        kept: dict[int, tuple[int, bytes]] = {}
        for leaf in range(self.counts[0]):
            way, index = [], leaf
            for depth in range(self.levels - 1, 0, -1):
                first = index - index % ARITY
                if kept.get(depth, (-1, b""))[0] != first:
                    kept[depth] = first, self.run(depth, first)
                text, own = kept[depth][1], (index - first) * HEX
                way.append((text[:own], text[own + HEX:]))
                index //= ARITY
            yield way


def pack_path(way: list[tuple[bytes, bytes]]) -> bytes:
    """A way up as one value: how many siblings are left and right of it on each level, and their digests."""
    shape = bytes(n for a, b in way for n in (len(a) // HEX, len(b) // HEX))
    return bytes([len(way)]) + shape + b"".join(a + b for a, b in way)


def unpack_path(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 1 + 2 * data[0]
    for left, right in zip(data[1:at:2], data[2:at:2]):
        cut, end = at + left * HEX, at + (left + right) * HEX
        out.append((data[at:cut], data[cut:end]))
        at = end
    return out


def fold(leaf: str, way: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its siblings give."""
    digest = leaf.encode()
    for left, right in way:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest.decode()


def encoded_field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded_field, fields)).cast("binary"), 256)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _tree(nodes: DataFrame, key: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round over ``nodes`` (key, pos, total, digest), and each key's root as (key, root).

    ``total`` is the number of a key's nodes in the round. A key leaves the rounds once it has one block.
    """
    span, rounds, roots, number = ARITY**HEIGHT, [], None, 0
    schema = f"{key} {_kind(nodes, key)}, block bigint, total bigint, count int, levels int, nodes binary, root string"
    types = _arrow(schema)

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        count, total = block.num_rows, block.column("total")[0].as_py()
        levels = levels_of(count) if total <= span else HEIGHT + 1
        made = build(np.frombuffer(bytes.fromhex("".join(block.column("digest").to_pylist())), np.uint8).reshape(-1, 32), levels)
        values = (block.column(key)[0].as_py(), block.column("block")[0].as_py(), total, count, levels, made, made[:32].hex())
        return pa.table([[x] for x in values], schema=types)

    while True:
        grouped = nodes.select(key, F.floor(F.col("pos") / span).alias("block"), "pos", "total", "digest").groupBy(key, "block")
        made = stored(grouped.applyInArrow(one, schema), f"{name}-{number}")
        rounds.append(made)
        done = made.filter(F.col("total") <= span).select(key, "root")
        roots = done if roots is None else roots.unionByName(done)
        more = made.filter(F.col("total") > span)
        if more.isEmpty():
            return rounds, roots
        nodes = more.select(
            key, F.col("block").alias("pos"), F.ceil(F.col("total") / span).alias("total"), F.col("root").alias("digest"))
        number += 1


def _spread(blocks: DataFrame, key: str) -> DataFrame:
    """(_key, _block, above): the packed way of every leaf of ``blocks``, each of which knows its own."""
    schema = f"_key {_kind(blocks, key)}, _block bigint, above binary"
    types = _arrow(schema)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rest = unpack_path(row["above"])
                made = [pack_path(way + rest) for way in Block(row["nodes"], row["count"], row["levels"]).paths()]
                first = row["block"] * ARITY**HEIGHT
                yield pa.record_batch([[row[key]] * len(made), range(first, first + len(made)), made], schema=types)

    return blocks.mapInArrow(down, schema)


def _ways(rounds: list[DataFrame], key: str, above: DataFrame | None, name: str) -> DataFrame:
    """Blocks of the first round with ``above``, the packed way from the block's root to the root of everything.

    ``above`` has the way from each key's root on, as (_key, above); without it that way is empty.
    """
    span, ways = ARITY**HEIGHT, None
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number]
        tops = blocks.filter(F.col("total") <= span)
        if above is None:
            placed = tops.withColumn("above", F.lit(pack_path([])))
        else:
            placed = tops.join(above, tops[key].eqNullSafe(above["_key"])).drop("_key")
        if ways is not None:
            inner = blocks.filter(F.col("total") > span)
            met = inner[key].eqNullSafe(ways["_key"]) & (inner["block"] == ways["_block"])
            placed = placed.unionByName(inner.join(ways, met).drop("_key", "_block"))
        if number:
            ways = stored(_spread(placed, key), f"{name}-ways-{number}")
    return placed


@dataclass
class Manifest:
    """Stored tables of a dataset's tree.

    leaves   one row per row: its key columns, ``pos`` in its source, ``leaf`` and what else was kept
    rounds   blocks of the sources' trees, one table per round: source, block, count, levels, nodes
    tops     the same for the tree over sources, whose position is ``order``
    sources  source, order, subroot
    root     one row with the root, none for an empty dataset
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    tops: list[DataFrame]
    sources: DataFrame
    root: DataFrame


def build_manifest(rows: DataFrame, source: str = "source", order: str = "doc_id", leaf: str = "leaf") -> Manifest:
    """Trees over rows that carry their ``leaf`` digest as hex text.

    Leaves of a source ascend by ``order``, nulls first; rows with the same are ordered by their digest, so that copies
    may stand in any order. Sources are ordered by their bytes, null first. An empty table gives empty tables.
    Other columns are kept with the leaves; they must not be named pos, total, block or _row.
    """
    fixed = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    # The row number stands last so that even a third of all rows being one copy is spread over partitions.
    placed = running_in_group(fixed.withColumn("_one", F.lit(1)).withColumn("_src", F.struct(source)), ["_src"], [order, leaf, "_row"], "_one", "pos")
    leaves = stored(placed.drop("_one", "_src", "_row"), "merkle-leaves")
    totals = leaves.groupBy(source).agg(F.count(F.lit(1)).alias("total"))
    sized = leaves.join(totals.withColumnRenamed(source, "_s"), leaves[source].eqNullSafe(F.col("_s"))).drop("_s")
    rounds, subroots = _tree(sized.select(source, "pos", "total", F.col(leaf).alias("digest")), source, "merkle-source")
    ranked = running_in_group(
        subroots.select(F.struct(source).alias("_src"), F.lit(0).alias("all"), F.col("root").alias("subroot"), F.lit(1).alias("_one")),
        ["all"], ["_src"], "_one", "order")
    sources = stored(ranked.select("all", F.col(f"_src.{source}").alias(source), "order", "subroot"), "merkle-sources")
    count = sources.groupBy("all").agg(F.count(F.lit(1)).alias("total"))
    tops, root = _tree(sources.join(count, "all").select("all", F.col("order").alias("pos"), "total", F.col("subroot").alias("digest")), "all", "merkle-top")
    return Manifest(leaves, rounds, tops, sources.drop("all"), root.select("root"))


def prove(manifest: Manifest, schema: str, answer: Callable, source: str = "source") -> DataFrame:
    """``answer(row, way, subroot, root)`` for every leaf, as rows of ``schema``; ``row`` is a dict.

    ``way`` lists the siblings left and right of the leaf's way to the root, level by level; all are read by address
    from stored blocks. A leaf meets its block by source and position.
    """
    span, types = ARITY**HEIGHT, _arrow(schema)
    tops = _spread(_ways(manifest.tops, "all", None, "merkle-top"), "all").select(F.col("_block").alias("order"), "above")
    ends = stored(
        manifest.sources.join(tops, "order").select(F.col(source).alias("_key"), "subroot", "above").withColumn("top", manifest.root.scalar()),
        "merkle-ends")
    blocks = _ways(manifest.rounds, source, ends.select("_key", "above"), "merkle-source")
    named = ends.select("_key", "subroot", "top")
    # As JSON, so that a null source is a key like any other.
    key = F.to_json(F.struct(source)).alias("_source")
    heads = blocks.join(named, blocks[source].eqNullSafe(named["_key"])).select(
        key, "block", "count", "levels", "nodes", "above", "subroot", "top")
    rows = manifest.leaves.select(key, F.floor(F.col("pos") / span).alias("block"), *(c for c in manifest.leaves.columns if c != "block"))

    def one(leaves: pa.Table, head: pa.Table) -> pa.Table:
        top = head.to_pylist()[0]
        rest = unpack_path(top["above"])
        ways = Block(top["nodes"], top["count"], top["levels"]).paths()
        made = [answer(row, way + rest, top["subroot"], top["top"]) for row, way in zip(leaves.sort_by("pos").to_pylist(), ways)]
        return pa.table([list(x) for x in zip(*made)], schema=types)

    return rows.groupBy("_source", "block").cogroup(heads.groupBy("_source", "block")).applyInArrow(one, schema)


def manifest_of(docs: DataFrame) -> Manifest:
    """The manifest of a documents table, each leaf with the digest of a row whose text was put in lower case.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Nulls are told from empty texts; rows may repeat,
    doc_id and source may be null; other columns are ignored whatever their names.
    """
    def leaf(text: Column) -> Column:
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    own = leaf(F.col("text"))
    return build_manifest(docs.select("doc_id", "source", own.alias("leaf"), F.when(touched, leaf(lower)).otherwise(own).alias("told")))


def verify_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, subroot, root and proof, and whether the row as told still leads to the root.

    An empty table gives an empty result.
    """
    def answer(row, way, subroot: str, root: str):
        proof = sha256(b"".join(a + b for a, b in way)).hexdigest()
        folded = fold(row["told"], way)
        return row["doc_id"], row["leaf"], subroot, root, proof, folded, folded == root

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return prove(manifest_of(docs), f"doc_id {kind}, {text}, verified boolean", answer)
