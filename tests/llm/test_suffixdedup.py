import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import suffixdedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(d, cover) if not c)
        spans = int((cover[:-1] & ~np.concatenate([[False], cover[:-1]])[:-1]).sum())
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.orderBy("doc_id", "n_bytes").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


def corpus(seed, n=60, alphabet="ab cé\n"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(30, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            part = rng.choice(shared) if rng.random() < 0.5 else word(rng.randint(1, 80))
            cut = rng.randint(0, len(part))
            parts.append(part[cut:] if rng.random() < 0.3 else part)
        texts.append("".join(parts))
    return [*texts, texts[0], texts[3], texts[3], "", None, "a" * 300, "ab" * 100, "x" * 39, "y" * 40, "y" * 40]


@pytest.mark.parametrize("seed,in_range", [(1, 10_000), (2, 100), (3, 20), (4, 7)])
def test_matches_brute_force(make_docs, seed, in_range):
    texts = corpus(seed)
    got = result(sd.removed(make_docs(texts), length=40, gram=16, in_range=in_range))
    assert got == brute(texts, 40)


def test_full_length_boundaries(make_docs):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    p399, p400, p401 = word(399), word(400), word(401)
    texts = [word(50) + p + word(70) for p in (p399, p399, p400, p400, p401, p401)] + [p400]
    assert result(sd.removed(make_docs(texts))) == brute(texts, 400)


def test_kept_text_null_ids_and_clashing_columns(make_docs, spark):
    from pyspark.sql import functions as F

    shared = "né " * 20
    texts = [shared + "left over", "start " + shared, None, "short", "short"]
    docs = make_docs(texts, ids=[None, 1, 2, 7, 7]).withColumn("spans", F.lit("mine"))
    got = {(r["doc_id"], r["text"]) for r in sd.removed(docs, length=30, gram=8, kept_text=True).collect()}
    assert (2, None) in got and (7, "short") in got
    assert any(i is None and t.endswith("left over") and len(t) < 14 for i, t in got)


def test_empty_table(make_docs):
    assert result(sd.removed(make_docs([]))) == []


@pytest.mark.parametrize("seed", range(5))
def test_deep_shallow_is_the_sorted_order(seed):
    rng = random.Random(seed)
    base = bytes(rng.randrange(2) for _ in range(200))
    strings = [base[: rng.randint(0, 200)] + bytes(rng.randrange(3) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    order = sd.deep_shallow(strings)
    assert sorted(order) == list(range(300))
    # padding ties: strings that differ only by trailing zero bytes within the shallow depth
    assert [strings[i] for i in order] == sorted(strings)


def test_common_prefix():
    assert [sd.common(a, b) for a, b in ((b"", b"x"), (b"abc", b"abd"), (b"ab", b"abz"), (b"\0a", b"\0b"), (b"q", b"q"))] == [0, 2, 2, 1, 1]


def test_long_texts_are_read_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(sd, "_PLACE", 9)  # parts of 256 bytes
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choice("abcd") for _ in range(2000)).encode(), np.uint8)

    class Piece:
        starts, ends = np.array([0]), np.array([2000])

    Piece.data = data
    found = set()
    for offset, part, starts, ends in sd._parts(Piece, 40):
        found |= set((sd.anchors(part, starts, ends, 40, 16)[0] + offset).tolist())
    for s in range(2000 - 39):
        assert any(s <= a <= s + 24 for a in found)


@pytest.mark.parametrize("in_range", [5, 10_000])
def test_periodic_texts(make_docs, in_range):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    texts = [word(20) + "spam eggs" * rng.randint(1, 30) + word(20) + ("spam eggs" * 9 if i % 3 else "") for i in range(12)] + ["spam eggs" * 12, word(60), "xy" * 60 + word(9) + "xy" * 30]
    assert result(sd.removed(make_docs(texts), length=40, gram=16, in_range=in_range)) == brute(texts, 40)


@pytest.mark.parametrize("n", [20, 150])
def test_one_anchor_over_many_ranges(make_docs, n):
    """A passage in every text, between words that some texts share: its anchor's strings fill many ranges."""
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage, starts, ends = word(38), [word(30) for _ in range(5)], [word(30) for _ in range(5)]
    texts = [word(rng.randint(0, 9)) + rng.choice(starts)[rng.randint(0, 25) :] + passage + rng.choice(ends)[: rng.randint(0, 25)] + word(rng.randint(0, 9)) for _ in range(n)]
    assert result(sd.removed(make_docs(texts), length=40, gram=16, in_range=9)) == brute(texts, 40)


@pytest.mark.parametrize("seed", range(20))
def test_nodes_over_ranges_are_those_of_one_order(seed):
    """Classes of every depth, as the ranges know them, against common prefixes of all pairs."""
    import pandas as pd

    rng = random.Random(seed)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) for _ in range(40)})
    cuts = sorted(rng.sample(range(1, len(strings)), min(5, len(strings) - 1)))
    held = []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(strings)])):
        own = strings[a:b]
        shared = np.array([-1] + [sd.common(x, y) for x, y in zip(own, own[1:])])
        depth, first, parent, leaf = sd.nodes(shared)
        for i, s in enumerate(own):
            path, at = [], leaf[i]
            while at >= 0:
                path.append((depth[at], a + first[at]))
                at = parent[at]
            path.sort()
            held.append({"h": 1, "side": 0, "id": a + i, "part": part, "size": len(s), "n": 1, "before": sd.common(own[0], s), "after": sd.common(own[-1], s), "depths": [d for d, _ in path], "lows": [x for _, x in path], "first": i == 0, "last": i == len(own) - 1, "s": s})
    borders = {r[2]: r for r in sd.resolve(pd.DataFrame([r for r in held if r["first"] or r["last"]])).values.tolist()}
    for r in held:
        depths, lows = sd.completed(r["depths"], r["lows"], r["id"], r["before"], r["after"], borders[r["part"]])
        others = [x for x in strings if x != r["s"]]
        assert depths == sorted({sd.common(r["s"], x) for x in others})
        assert lows == [min(i for i, x in enumerate(strings) if x[:d] == r["s"][:d] and len(x) >= d) for d in depths]


def test_runs_of_few_words_stay(make_docs):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([passage + " one two", "three " + passage])
    assert [r[1] > 0 for r in result(sd.removed(docs, length=40, gram=16, least_words=30))] == [True, True]
    assert [r[1] for r in result(sd.removed(docs, length=40, gram=16, least_words=33))] == [0, 0]
