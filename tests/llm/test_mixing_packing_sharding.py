import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import frames, mixing, packing, sharding


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by the rule as it is told: share by weight, stop at the cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def corpus(seed, n, n_sources=5):
    rng = random.Random(seed)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 3, 20, rng.randint(1, 90)]))) for _ in range(n)] + [None, "", "same text", "same text"]
    names = [f"s{i}" for i in range(n_sources)] + [None, "é"]
    sources = [names[0] if rng.random() < 0.35 else rng.choice(names) for _ in texts]
    return texts, sources


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(make_docs, seed):
    texts, sources = corpus(seed, 900)
    docs = make_docs(texts, sources=sources).repartition(5)
    rows = mixing.fair_mix(docs).collect()
    total = defaultdict(int)
    for t, s in zip(texts, sources):
        total[s] += size(t)
    want, taken, by_id = water(total), defaultdict(int), {r["doc_id"]: r for r in rows}
    for i, (t, s) in enumerate(zip(texts, sources)):
        r = by_id[i]
        assert (r["size"], r["source_size"]) == (size(t), total[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, size(t), 2 * size(t))
        taken[s] += r["taken"]
    for s, words in taken.items():
        assert abs(words - want[s]) <= max(size(t) for t, o in zip(texts, sources) if o == s)
    assert sum(taken.values()) <= 1.5 * sum(total.values()) + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.fair_mix(docs.repartition(3)).collect()}
    assert again == {i: r["taken"] for i, r in by_id.items()}


def test_mix_of_nothing(make_docs):
    assert mixing.fair_mix(make_docs([])).collect() == []
    assert [r["taken"] for r in mixing.fair_mix(make_docs(["", None, "  "])).collect()] == [0, 0, 0]


def test_null_and_repeated_ids(make_docs):
    rows = mixing.fair_mix(make_docs(["a b c"] * 6, ids=[None, None, 1, 1, 2, 3], sources=["x"] * 6)).collect()
    assert len(rows) == 6 and sum(r["taken"] for r in rows) <= 27


def queue_by_queue(rows, budget):
    """Taken words by the rule as it is told, from the queues' order: serve the least (time, source, place) until one does not fit."""
    visits = sorted((((r["_sent"] + r["size"] + i * r["source_size"]) / r["target"], r["source"] is None, r["source"] or "", r["_sent"]), r["doc_id"], r["size"]) for r in rows if r["size"] and r["target"] for i in (0, 1))
    taken, total = defaultdict(int), 0
    for _, i, words in visits:
        if total + words > budget:
            break
        total += words
        taken[i] += words
    return taken


@pytest.mark.parametrize("alike", [False, True])
def test_taken_is_a_prefix_of_all_visits(make_docs, alike):
    texts, sources = corpus(5, 400)
    if alike:  # every finish time is shared by all three sources
        texts, sources = ["ten words are in each of these texts " + "x y"] * 300, ["a", "b", None] * 100
    mix = mixing.Mix(make_docs(texts, sources=sources), (1, 1, 1) if alike else (5, 2, 1), 1.4905 if alike else 1.5, 2, 17, (), None)
    rows = mix.rows.collect()
    for source in {r["source"] for r in rows}:  # each queue holds every document once
        own = sorted((r["_sent"], r["size"]) for r in rows if r["source"] == source)
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    budget = sum({r["source"]: r["target"] for r in rows}.values())
    want = queue_by_queue(rows, budget)
    got = {r["doc_id"]: r["n"] * r["size"] for r in mix.rows.withColumn("n", F.size(F.filter(mix.finish(), mix.within))).collect()}
    assert got == {i: want.get(i, 0) for i in got}


def test_mix_ignores_clashing_columns_and_counts_long_texts(make_docs):
    docs = make_docs(["a b c", "w " * 200_000, "a"], sources=["x", "x", "y"]).withColumn("size", F.lit(5)).withColumn("target", F.lit("no")).withColumn("times", F.lit(1))
    assert sorted(r["size"] for r in mixing.fair_mix(docs).collect()) == [1, 3, 200_000]


def test_served_rows_come_as_often_as_they_are_taken(make_docs):
    texts, sources = corpus(6, 200)
    docs = make_docs([*texts, "x y z", "x y z"], ids=[*range(len(texts)), 7000, 7000], sources=[*sources, "s1", "s1"]).withColumn("node", F.lit(1)).withColumn("times", F.lit(2))
    got = mixing.served(docs).collect()
    assert got[0].asDict().keys() == set(docs.columns)
    also = [F.xxhash64(F.lit(k), *docs.columns) for k in (1, 2)]
    taken = defaultdict(int)
    for r in mixing.fair_mix(docs, also=also).collect():
        taken[r["doc_id"]] += r["times"]
    count = defaultdict(int)
    for r in got:
        count[r["doc_id"]] += 1
    assert count == {i: n for i, n in taken.items() if n}


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_waste_least(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 60, 11))
    counts = rng.integers(1, 9, len(lengths))

    def waste(bounds):
        upper = np.asarray(bounds)[np.searchsorted(bounds, lengths)]
        return int(((upper - lengths) * counts).sum())

    for k in (1, 2, 3, 4, 20):
        got = packing.boundaries(lengths, counts, k)
        assert got[-1] == lengths[-1] and len(got) <= k
        best = min(waste(np.array([*c, lengths[-1]])) for c in combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert waste(got) == best


def test_batches_keep_the_budget(make_docs):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, rng.randint(1, 300), 2000])) for _ in range(700)] + [None]
    rows = packing.batches(make_docs(texts), buckets=5, budget=1000).collect()
    assert len(rows) == 701 and {r["doc_id"]: r["n_tokens"] for r in rows} == {i: size(t) for i, t in enumerate(texts)}
    groups = defaultdict(list)
    for r in rows:
        assert 0 <= r["padding"] == r["bucket_tokens"] - r["n_tokens"]
        groups[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), own in groups.items():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) * own[0]["bucket_tokens"] <= 1000 or len(own) == 1
        later = [b for b in groups if b[0] == bucket and b[1] > batch]
        if later:
            assert (len(own) + 1) * own[0]["bucket_tokens"] > 1000
    assert packing.batches(make_docs([])).collect() == []


def test_boundaries_are_those_of_the_plain_recurrence():
    rng = np.random.default_rng(8)
    lengths = np.unique(rng.integers(0, 4000, 300))
    counts = rng.integers(1, 90, len(lengths))
    texts = np.concatenate([[0], np.cumsum(counts)])
    best = lengths * texts[1:]
    for _ in range(6):
        best = np.array([min([best[i - 1] + lengths[j] * (texts[j + 1] - texts[i]) for i in range(1, j + 1)] + [lengths[j] * texts[j + 1]]) for j in range(len(lengths))])
    bounds = packing.boundaries(lengths, counts, 7)
    assert int((bounds[np.searchsorted(bounds, lengths)] * counts).sum()) == best[-1]


def test_packing_clashing_columns_and_null_ids(make_docs):
    docs = make_docs(["a b", "a", "a"], ids=[None, 1, 1]).withColumn("bucket", F.lit("x")).withColumn("n_tokens", F.lit(7))
    assert sorted(r["n_tokens"] for r in packing.batches(docs).collect()) == [1, 1, 2]


def slow_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(room, i) for i, room in enumerate(bins) if room >= s]
        if fits:
            _, i = min(fits)
        else:
            bins.append(max(capacity, s))
            i = len(bins) - 1
        bins[i] -= s
        out.append(i)
    return out


def plain(classes):
    return sorted((s for s, c in classes for _ in range(c)), reverse=True)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_tightest_bin(seed):
    rng = random.Random(seed)
    classes = [(s, rng.randint(1, 9)) for s in sorted(rng.sample(range(1, 130), 60), reverse=True)]
    got = sharding.best_fit(classes, 100)
    assert [b for s, b, many in got for _ in range(many)] == slow_best_fit(plain(classes), 100)


@pytest.mark.parametrize("seed", range(4))
def test_tree_keeps_the_order(seed):
    rng, tree, held = random.Random(seed), sharding.Tree(), []
    for i in range(600):
        if rng.random() < 0.6:
            held.append((rng.randint(0, 50), i))
            tree.add(held[-1])
        else:
            size = rng.randint(0, 50)
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take(size) == want
            held = [x for x in held if x != want]


def load_of(packed, bins):
    return np.bincount([b for _, b, _ in packed], [s * many for s, _, many in packed], bins)


def test_pack_is_even():
    rng = random.Random(2)
    classes = [(s, rng.randint(1, 9)) for s in range(1, 500)]
    load = load_of(sharding.pack(classes, 40), 40)
    assert load.max() <= 1.001 * load.mean() and sharding.pack([], 40) == []
    # a group larger than a share has a bin to itself and the rest are even
    load = np.sort(load_of(sharding.pack([(10**6, 1), *classes], 40), 40))
    assert load[-1] == 10**6 and load[-2] <= 1.001 * load[:-1].mean()


def test_shards_keep_groups_and_count_slots(make_docs):
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 300) + str(rng.randint(0, 40)) for _ in range(1500)] + ["hot text"] * 500 + [None, "", "long " * 3000]
    docs = make_docs(texts, ids=[*range(2000), None, None, 2002]).withColumn("size", F.lit("mine")).withColumn("weight", F.lit(1))
    rows = sharding.shards(docs, 7).collect()
    assert len(rows) == 2003
    shard_of, slots, load, whole = defaultdict(set), defaultdict(list), defaultdict(int), defaultdict(int)
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
        shard_of[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        whole[text] += r["size"]
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert max(load.values()) <= 1.001 * sum(load.values()) / 7
    # the same loads as packing all groups one by one at that capacity
    got = sorted(load.values())
    one_by_one = sorted(whole.values(), reverse=True)
    capacity = next(c for c in range(-(-sum(got) // 7), sum(got)) if max(slow_best_fit(one_by_one, c)) < 7)
    assert sorted(np.bincount(slow_best_fit(one_by_one, capacity), one_by_one).astype(int).tolist()) == got or max(got) <= capacity * (1 + 2 * sharding.EVEN)
    assert sharding.shards(make_docs([]), 7).collect() == []


def test_fixed_capacity_opens_few_shards(make_docs):
    rows = sharding.shards(make_docs(["a" * 34, "b" * 34, "c" * 84, "d" * 184]), capacity=100).collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {0: 2, 1: 2, 2: 1, 3: 0}


@pytest.mark.parametrize("per_cell", [1, 7, 10_000])
def test_running_sums_are_those_of_the_whole_order(spark, per_cell):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 9), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, o bigint, v int, i int").repartition(6)
    got = {r["i"]: r["s"] for r in frames.running(frame, ["k"], "o", F.col("v"), "s", 300, per_cell).collect()}
    for k, o, v, i in rows:
        assert got[i] == sum(w for k2, o2, w, _ in rows if k2 == k and o2 < o)


def test_tables_in_between_can_be_forgotten(spark):
    from pathlib import Path

    kept = frames.written(spark.range(3), "some")
    folder = Path(frames.own_folder(spark))
    assert kept.count() == 3 and list(folder.iterdir())
    frames.forget(spark)
    assert not folder.exists()
