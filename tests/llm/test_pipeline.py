import pytest

import corpus_pipeline
from cytoplane.llm import pii
from test_duplicates import links


@pytest.fixture(scope="module")
def folder(make, tmp_path_factory):
    base = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    texts = [None, "12 34", "", base, base, base.replace("wordaa", "other"), "Write to jane@example.com today", "the cat sat on the mat", base[:300]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    make(texts, langs=["en"] * len(texts)).write.parquet(f"{path}/documents.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        seen.append((name, {r.doc_id for r in docs.collect()}))
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS
    lettered = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    assert seen[0][1] == lettered
    assert seen[1][1] == {i for i in lettered if not any(texts[k] == texts[i] and k > i for k in lettered)}
    ids = sorted(seen[1][1])
    _, _, roots = links([texts[i] for i in ids])
    assert seen[2][1] == {ids[max(k for k in range(len(ids)) if roots[k] == r)] for r in set(roots)}
    assert seen[3][1] == seen[4][1] == seen[2][1]


def test_run(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and all(r.length <= 4096 for r in rows)
    masked = corpus_pipeline.mask_personal_data(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert all(not pii.find_spans(r.text or "")[1] for r in masked.collect())


def test_odd_documents(spark, make, odd, tmp_path):
    path = str(tmp_path)
    make([*odd, *odd], ids=[*range(len(odd)), *range(len(odd))]).write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() > 0
    make([]).write.parquet(f"{path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{path}/empty").count() == 0
