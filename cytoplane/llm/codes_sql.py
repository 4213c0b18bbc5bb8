"""Product codes in SQL: every distance of every round."""

from __future__ import annotations

from cytoplane.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE


def _nearest(k: int) -> str:
    """The nearest entry of each part by codebook ``k``, ties to the lower index."""
    return f"""near_{k} AS MATERIALIZED (
        SELECT row, part, arg_min(entry, (d2, entry)) AS entry, min(d2) AS d2 FROM
          (SELECT x.row, x.part, b.entry, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d2
           FROM cut AS x JOIN book_{k} AS b ON b.part = x.part) AS q GROUP BY row, part)"""


def _average(k: int) -> str:
    """Codebook ``k + 1``; entries without a part stay."""
    return f"""book_{k + 1} AS MATERIALIZED (
        SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book_{k} AS b LEFT JOIN
          (SELECT part, entry, list(mean ORDER BY place) AS v FROM
             (SELECT n.part, n.entry, place, CAST(floor(CAST(sum(x.v[place]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
              FROM near_{k} AS n JOIN cut AS x ON x.row = n.row AND x.part = n.part,
                   (SELECT unnest(range(1, (SELECT any_value(len(v)) FROM cut) + 1)) AS place) AS places GROUP BY n.part, n.entry, place) AS q
           GROUP BY part, entry) AS m ON m.part = b.part AND m.entry = b.entry)"""


SQL = "WITH " + ",\n".join([
    f"""kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label,
               list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS ints
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
    f"""cut AS MATERIALIZED (
        SELECT row, part, ints[part * (len(ints) // {PARTS}) + 1 : (part + 1) * (len(ints) // {PARTS})] AS v
        FROM kept, (SELECT unnest(range({PARTS})) AS part) AS parts)""",
    f"book_0 AS MATERIALIZED (SELECT part, row AS entry, v FROM cut WHERE row < {ENTRIES})",
    *(x for k in range(ROUNDS) for x in (_nearest(k), _average(k))),
    _nearest(ROUNDS),
    f"""coded AS MATERIALIZED (
        SELECT vec_id, label, code, error FROM kept JOIN
          (SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d2) AS BIGINT) AS error
           FROM near_{ROUNDS} GROUP BY row) AS q USING (row))""",
]) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book_{ROUNDS}) AS codebooks_sha256
FROM coded"""
