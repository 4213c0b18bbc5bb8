from cytoplane.llm import exact


def test_groups(make, odd):
    texts = [*odd, "x" * 49_999 + "y", "ab" * 5000, "ab" * 5000, "ab" * 4999 + "ac"]
    rows = {r.doc_id: r for r in exact.exact_duplicates(make(texts), size=16).collect()}
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        same = [k for k, x in enumerate(plain) if x == text]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(same), len(same), i == max(same))
    assert exact.exact_duplicates(make([])).count() == 0


def test_null_and_repeated_ids(make):
    docs = make(["a", "a", "a", "b", "b", None, ""], ids=[3, 3, None, None, None, 1, None])
    rows = exact.exact_duplicates(docs).collect()
    assert len(rows) == 7 and sum(r.kept for r in rows) == 3
    assert sorted((r.keep_id is None, r.keep_id or 0, r.group_size) for r in rows if r.kept) == [(False, 1, 2), (False, 3, 3), (True, 0, 2)]
    left = exact.drop_duplicates(docs).collect()
    assert sorted((r.text or "") for r in left) == ["", "a", "b"]
