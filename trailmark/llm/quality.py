"""Quality scores by non-negative positive-unlabelled learning.

Trusted good texts are set against unlabelled ones; the share of good texts
among these is estimated, and the non-negative unbiased risk is minimised in
numpy. A text is seen through what holds in any language: which byte classes
follow each other and how often, word shapes, the share of symbols, capitals,
digits and repeated lines and words, and common words.

Nulls and texts without words are scored like any other, very long texts whole;
equal texts get equal scores (there are no other ties); an empty table gives an
empty result. A null doc_id counts as the empty text when folds are dealt. Extra
columns of the inputs are ignored, also those with the name of a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pu
from .frames import fold
from .textcore import BYTE_KEY, BYTE_KEY_LOWER, U64, Slice, mix, prefix_hash, span_hash

#: Default bounds of the training sample, in texts.
POSITIVES, UNLABELLED = 2500, 5000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

#: Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 line feed, 6 from 128 on; 7 + i is mark i.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10], CLASS[128:] = 1, 2, 3, 4, 5, 6
CLASS[list(_MARKS)] = 7 + np.arange(len(_MARKS))
_N = 7 + len(_MARKS)


def _log_bucket(share: np.ndarray) -> np.ndarray:
    """0 for none, else 1 to 12, two to the octave of the share."""
    return np.where(share > 0, np.clip(13 + np.floor(2 * np.log2(np.maximum(share, 1e-9))), 1, 12), 0).astype(np.int64)


def repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many items of each text equal an earlier one of it."""
    found = np.lexsort((hashes, owner))
    a, h = owner[found], hashes[found]
    again = (a[1:] == a[:-1]) & (h[1:] == h[:-1])
    return np.bincount(a[1:][again], minlength=n)


def features(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    n = len(piece)
    start, end, owner = piece.words()
    size = np.maximum(piece.ends - piece.starts, 1)
    n_words = np.maximum(np.bincount(owner, minlength=n), 1)
    every = np.arange(n)
    of, ids = [], []

    def add(kind: int, row: np.ndarray, value: np.ndarray) -> None:
        of.append(row)
        ids.append((mix(value.astype(np.uint64) * U64(64) + U64(kind)) >> U64(64 - pu.BITS)).astype(np.int64))

    def steps(kind: int, row: np.ndarray, value: np.ndarray) -> None:
        """A number as all steps up to it, so that near numbers share most of them."""
        size = value.astype(np.int64) + 1
        add(kind, np.repeat(row, size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))

    # pairs of byte classes, with their share of the text
    kind = CLASS[piece.data]
    if len(kind) > 1:
        text = np.repeat(every, piece.ends - piece.starts)
        within = text[:-1] == text[1:]
        pair = (text[:-1] * (_N * _N) + kind[:-1] * _N + kind[1:])[within]
        seen, count = np.unique(pair, return_counts=True)
        row, which = seen // (_N * _N), seen % (_N * _N)
        bucket = _log_bucket(count / size[row])
        add(1, row, which * 16 + bucket)
        add(2, row, which)
    for number, members in ((3, kind >= 7), (4, kind == 2), (5, kind == 3), (6, kind == 5), (7, kind == 6)):
        upto = np.concatenate([[0], np.cumsum(members)])
        steps(number, every, _log_bucket((upto[piece.ends] - upto[piece.starts]) / size))
    # repeated lines, words and runs of five words
    l_start, l_end, l_owner = piece.lines()
    raw = prefix_hash(BYTE_KEY[piece.data])
    full = l_end > l_start
    n_lines = np.maximum(np.bincount(l_owner[full], minlength=n), 1)
    steps(8, every, _log_bucket(repeats(l_owner[full], span_hash(raw, l_start[full], l_end[full]), n) / n_lines))
    lower = prefix_hash(BYTE_KEY_LOWER[piece.data])
    words = span_hash(lower, start, end)
    steps(9, every, _log_bucket(repeats(owner, words, n) / n_words))
    if len(words) >= 5:
        five = owner[:-4] == owner[4:]
        grams = words[:-4] + words[1:-3] * U64(3) + words[2:-2] * U64(5) + words[3:-1] * U64(7) + words[4:] * U64(11)
        steps(10, every, _log_bucket(repeats(owner[:-4][five], grams[five], n) / n_words))
    # sizes
    steps(11, every, np.minimum(np.log2(n_words + 1).astype(np.int64), 14))
    length = np.bincount(owner, end - start, n) / n_words
    steps(12, every, np.minimum(length.astype(np.int64), 30))
    # words, and the last byte of each with its share
    add(13, owner, words)
    if len(end):
        last, count = np.unique(owner * 256 + piece.data[end - 1], return_counts=True)
        add(14, last // 256, (last % 256) * 16 + _log_bucket(count / n_words[last // 256]))
    return np.concatenate(of), np.concatenate(ids)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> pu.Model:
    """positives, unlabelled: the most texts of each kind that are learnt from."""
    learn = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return pu.train(docs, labels, "quality", learn, features, positives=positives, unlabelled=unlabelled, threshold=THRESHOLD, least_z=3.0, decay=0.1, varied=False)


def quality(docs: DataFrame, labels: DataFrame, model: pu.Model | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score in 0 to 1, predicted (1 if score >= 0.7) of every text."""
    model = model or fit(docs, labels, positives, unlabelled)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return pu.score(rows, model, features, THRESHOLD)
