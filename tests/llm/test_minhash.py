import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import components, minhash
from trailmark.llm.textcore import slices


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(text, idf_of):
    words = word_list(text)
    if not words:
        return {}
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)]
    out = Counter(grams)
    return {g: c * sum(idf_of(w) for w in g) / len(g) for g, c in out.items()}


def brute(ids, texts, similarity=0.8):
    """The least id of every text's component under exact weighted Jaccard similarity."""
    n = len(texts)
    df = Counter(w for t in texts for w in {bucket(w) for w in word_list(t)})
    idf_of = lambda w: float(np.log(1 + n / (1 + df[bucket(w)])))
    bags = [bag(t, idf_of) for t in texts]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = bags[i], bags[j]
            both = sum(min(a[g], b[g]) for g in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - both
            if (texts[i] or "") == (texts[j] or "") or (total and both / total >= similarity):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(ids[i])
    return sorted((ids[i], min(x for x in groups[find(i)] if x is not None) if any(x is not None for x in groups[find(i)]) else None) for i in range(n))


def bucket(word):
    (piece,) = slices(pa.array([word]))
    return int(minhash._words(piece)[0][0] >> np.uint64(64 - minhash.IDF_BITS))


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts = []
    for _ in range(n):
        base = sentence(rng.randint(1, 150))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(near) // 60))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" \n".join(near))
    return [*texts, texts[0], texts[0], "", "", None, "one", "one", "two words", "two  words", "a " * 50, "a " * 51, "#" * 300]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(make_docs, seed):
    texts = corpus(seed)
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(make_docs(texts)).collect())
    assert got == brute(list(range(len(texts))), texts)


def test_chain_of_changes_is_one_class(make_docs, monkeypatch):
    """Neighbours are similar, ends are not: the least text's star alone would miss the far ones."""
    monkeypatch.setattr(minhash, "CROWD", 4)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(30):
        words = list(words)
        for j in range(3):
            words[(i * 9 + j) % 300] = f"x{i}-{j}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(make_docs(texts)).collect())
    assert got == brute(list(range(30)), texts)
    assert {c for _, c in got} == {0}


def test_null_and_repeated_ids(make_docs):
    text = "the same five words and a few more"
    rows = minhash.near_duplicates(make_docs([text, text, text, "other", None], ids=[None, 4, 4, None, None])).collect()
    assert sorted((r["doc_id"] is None, r["class_id"], r["class_size"]) for r in rows if r["class_id"] is not None) == [(False, 4, 3), (False, 4, 3), (True, 4, 3)]
    assert len(rows) == 5


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []


def test_samples_agree_as_often_as_the_similarity():
    rng = random.Random(0)
    words = [f"v{i}" for i in range(400)]
    other = [w if rng.random() < 0.97 else w + "x" for w in words]
    idf = np.random.default_rng(1).uniform(1, 8, 1 << minhash.IDF_BITS).astype(np.float32)
    (piece,) = slices(pa.array([" ".join(words), " ".join(other)]))
    bags = minhash.Bags(piece, idf)
    _, found = minhash.samples(bags)
    true = minhash.weighted_jaccard(bags.of(0), bags.of(1))
    assert 0.5 < true < 0.95
    assert abs((found[0] == found[1]).mean() - true) < 0.2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    for node, root in least.items():
        assert got.get(node, node) == root


def test_texts_with_equal_hashes_are_told_apart(make_docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "_hashes", lambda t: (F.pmod(F.xxhash64(t), F.lit(3)), F.xxhash64(F.lit(7), t)))
    texts = [f"word{i} " * 9 for i in range(12)]
    docs = make_docs([*texts, *texts[:5], None, "", "long text " * 30_000]).withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
    rows = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert rows == {**{i: i for i in range(12)}, **{12 + i: i for i in range(5)}, 17: 17, 18: 17, 19: 19}
    kept = minhash.deduplicated(docs.drop("node", "root").withColumn("band", F.lit(2))).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(12), 17, 19] and all(r["band"] == 2 for r in kept)
