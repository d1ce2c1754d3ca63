"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts and texts
without labels. It sees words and word beginnings, so that inflected or
compounded insults that were never seen whole still count.

Nulls and texts without words get the bias alone, very long texts are read whole;
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
from .textcore import BYTE_KEY_LOWER, U64, Slice, mix, prefix_hash, span_hash

#: Default bounds of the training sample, in texts.
POSITIVES, UNLABELLED = 2500, 5000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5


def features(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Words and their first four and five bytes, A-Z lowered."""
    start, end, owner = piece.words()
    prefix = prefix_hash(BYTE_KEY_LOWER[piece.data])
    kinds = [(end, 1), (np.minimum(end, start + 4), 2), (np.minimum(end, start + 5), 3)]
    ids = [mix(span_hash(prefix, start, stop) + U64(kind)) >> U64(64 - pu.BITS) for stop, kind in kinds]
    return np.tile(owner, len(kinds)), np.concatenate(ids).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> pu.Model:
    """positives, unlabelled: the most texts of each kind that are learnt from."""
    learn = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    return pu.train(docs, labels, "toxic", learn, features, positives=positives, unlabelled=unlabelled, threshold=THRESHOLD, decay=0.1)


def toxicity(docs: DataFrame, labels: DataFrame, model: pu.Model | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score in 0 to 1, predicted (1 if score >= 0.5) of every text."""
    model = model or fit(docs, labels, positives, unlabelled)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return pu.score(rows, model, features, THRESHOLD)
