"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered, so each has an
integer name; then adjacent names are paired and the distinct pairs numbered, again and again, until every document has
one name. Equal names mean equal texts: a name stands for one block or one pair, never for a hash.

Only distinct blocks and pairs are numbered (merged before each shuffle), so a text with a third of all rows costs one
row per task. Blocks travel once; names return to documents over a 128-bit fingerprint, after a check that no two
distinct blocks share it (else the fingerprint is taken anew with another seed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.session import materialize

#: Bytes of a block.
BLOCK = 4096


def _blocks(text: str, size: int):
    data = F.col(text).cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(text) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _prints(block, seed: int):
    return F.xxhash64(block, F.lit(seed)), F.xxhash64(F.lit(seed + 1), block)


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number sorted rows; stored at once, so the numbers never change."""
    return materialize(distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()))


def _name_blocks(texts: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(p, q, name) of every distinct block, and the seed under which p, q tell all blocks apart."""
    for seed in range(0, 64, 2):
        blocks = texts.select(F.explode(_blocks("_text", size)).alias("block"))
        p, q = _prints(F.col("block"), seed)
        names = _numbered(blocks.select(p.alias("p"), q.alias("q"), "block").distinct(), ["p", "q", "block"]).drop("block")
        if names.groupBy("p", "q").count().filter("count > 1").isEmpty():
            return names, seed
    raise RuntimeError("no fingerprint tells the blocks apart")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: row (unique), doc_id, text_sha256, depth and name.

    Two rows have the same (depth, name) exactly if their texts are identical. Null and empty texts are one text, which
    is one empty block. Ids may be null or repeat; other columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names, seed = _name_blocks(texts.select("_text"), size)
    rows = materialize(texts.select(
        "doc_id",
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
        F.transform(_blocks("_text", size), lambda b: F.struct(*(x.alias(n) for x, n in zip(_prints(b, seed), "pq")))).alias("prints"),
    ).withColumn("row", F.monotonically_increasing_id()))

    parts = rows.select("row", F.size("prints").alias("left"), F.posexplode("prints").alias("pos", "print"))
    parts = parts.select("row", "left", "pos", "print.p", "print.q")
    named = materialize(parts.join(names, ["p", "q"]).select("row", "pos", "left", "name"))
    longest = rows.select(F.max(F.size("prints"))).first()[0] or 1
    found, depth = None, 0
    while True:
        # A document with one name left is done; the others go on with half as many.
        done = named.filter("left = 1").select("row", F.lit(depth).alias("depth"), "name")
        found = done if found is None else found.unionByName(done)
        if longest <= 1:
            break
        pairs = (
            named.filter("left > 1")
            .groupBy("row", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.max(F.shiftright(F.col("left") + 1, 1)).alias("left"),
            )
        )
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        named = materialize(pairs.join(names, ["a", "b"]).select("row", "pos", "left", "name"))
        longest, depth = (longest + 1) // 2, depth + 1
    return rows.select("row", "doc_id", "text_sha256").join(found, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays (nulls last; of rows with the same id, one). keep_id
    is null only where all ids of a group are null.
    """
    rows = materialize(identities(docs, id_col, text_col, size))
    # Stored, so that the join deals both sides out and can split a group that is most of a partition.
    groups = materialize(rows.groupBy("depth", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")
    ))
    return rows.join(groups, ["depth", "name"]).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = materialize(exact_duplicates(docs, id_col, text_col, size))
    kept = found.filter("kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_kept_sha"))
    keyed = docs.withColumn("_sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    same = keyed.join(kept, keyed[id_col].eqNullSafe(F.col("_kept")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    if not found.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        same = same.dropDuplicates([id_col, "_sha"])  # rows that repeat both id and text
    return same.drop("_sha")
