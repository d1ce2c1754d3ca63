import random

import pytest

import corpus_pipeline
from trailmark.llm import queries

WORDS = [a + b + c for a in ("ba", "ko", "ri", "tu") for b in ("lan", "dor", "wit", "pes") for c in ("", "a", "os", "en")]


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    passage = prose(90)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = prose(rng.randint(60, 120))
        if toxic:
            text += " dimwit scoundrel " + prose(10)
        labels.append((i, 1, int(toxic)))
        texts.append(text)
    texts[1] = texts[2]
    words = texts[3].split()
    texts[4] = " ".join([*words[:-1], "changed"])
    texts[6] += " " + passage
    texts[7] = passage + " " + texts[7]
    make_docs([*texts, "", None, "dup", "dup"], ids=[*range(400), 400, 401, 402, 402]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), texts, passage


def test_stages(spark, folder, tmp_path):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = docs.collect()
    clean = {r["doc_id"] for r in seen["toxicity"]}
    assert sum(i in clean for i in range(400) if i % 5) >= 315 and sum(i in clean for i in range(400) if i % 5 == 0) <= 4
    assert {400, 401, 402} <= clean
    kept = [r["doc_id"] for r in seen["near_dedup"]]
    assert len(kept) == len(set(kept)) and (1 in kept) and (2 not in kept) and (3 in kept) and (4 not in kept) and kept.count(402) == 1
    left = {r["doc_id"]: r for r in seen["suffix_dedup"]}
    assert set(left) == set(kept) and passage not in left[6]["text"] + left[7]["text"] and left[8]["text"] == texts[8]
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in left.values())
    mixed = [r["doc_id"] for r in seen["mixing"]]
    assert max(mixed.count(i) for i in set(mixed)) <= 2 and set(mixed) <= set(left)
    assert sorted(mixed) == sorted(r["doc_id"] for r in seen["packing"])


def test_run_and_queries(spark, folder):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 300
    assert set(queries.QUERIES) >= {"op1_toxicity", "op10_minhash_near_dedup"} and len(queries.QUERIES) == 10


def test_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
