"""Optimal length buckets and token-budget batches.

The histogram of lengths over the whole table is cut into at most ``buckets``
ranges by dynamic programming, so that padding every text to its bucket's
longest wastes the fewest tokens. Inside a bucket the texts, in shuffled order,
form batches of as many as the token budget holds at the padded length (one at
least).

The histogram is exact: it has an entry for each length that occurs, so no more
than the longest text has words, and the cut is optimal.

A length is the number of words; null text counts as empty. Empty texts have
length 0 and their own share of a bucket. Repeated rows are separate texts. An
empty table gives an empty result. Extra columns are ignored; a null doc_id is
an id like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import running, written
from .mixing import n_words

BUCKETS, BUDGET = 16, 65_536


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most buckets ranges of lengths (ascending) with the least padding.

    cost(i, j) = lengths[j] * (texts in i..j) - (tokens in i..j) obeys the
    quadrangle inequality, so each layer's best cuts ascend and are found by
    divide and conquer, a level of all middles at once: buckets * n * log n steps.
    """
    n = len(lengths)
    if n <= buckets:
        return np.asarray(lengths)
    texts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    best = lengths * texts[1:]  # without the tokens themselves, which every cut shares
    cuts = np.zeros((buckets, n), np.int32)
    for layer in range(1, buckets):
        new = np.empty(n, best.dtype)
        lo, hi, left, right = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            middle = (lo + hi) // 2
            size = np.minimum(middle, right) - left + 1  # candidates: the first entry of the last range
            at = np.cumsum(size) - size
            start = np.arange(int(size.sum())) - np.repeat(at - left, size)
            end = np.repeat(middle, size)
            cost = np.where(start > 0, best[np.maximum(start, 1) - 1], 0) + lengths[end] * (texts[end + 1] - texts[start])
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, size))
            found = start[hit[np.searchsorted(hit, at)]]
            new[middle], cuts[layer][middle] = least, found
            lo, hi, left, right = (np.concatenate(x) for x in ((lo, middle + 1), (middle - 1, hi), (left, found), (found, right)))
            ok = lo <= hi
            lo, hi, left, right = lo[ok], hi[ok], left[ok], right[ok]
        best = new
    out, end = [], n - 1
    for layer in range(buckets - 1, -1, -1):
        out.append(lengths[end])
        if cuts[layer][end] == 0:
            break
        end = cuts[layer][end] - 1
    return np.array(out[::-1])


def batches(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 3) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (its longest), batch (in the bucket), slot (in the batch), padding of every row."""
    rows = written(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")), "pack-lengths")
    # an entry a length: no more than the longest text has words
    found = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = (found.column(c).to_numpy() for c in ("n_tokens", "n"))
    bounds = boundaries(lengths, counts, buckets).tolist()
    if not bounds:
        bounds = [0]
    upper = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds])
    bucket = F.size(F.filter(upper, lambda b: b < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", F.element_at(upper, F.col("bucket") + 1))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "n_tokens"))
    ranked = running(rows, ["bucket"], "_order", F.lit(1), "_rank", int(counts.sum()))
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("bigint")
    rank = F.col("_rank").cast("bigint")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(rank / holds).cast("bigint").alias("batch"), (rank % holds).cast("bigint").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
