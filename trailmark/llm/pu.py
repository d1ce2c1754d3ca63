"""Non-negative positive-unlabelled learning of sparse linear classifiers in numpy.

The learner sees trusted positives and texts without labels, never a negative.
With prior p, loss l and scores g it minimises (Kiryo et al., 2017)

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

in mini-batches; where the second part is below zero, the step climbs out of it
instead. The prior is estimated from the same two samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches
from .textcore import BYTE_KEY, U64, Slice, mix, prefix_hash, slices, span_hash

#: Feature numbers are hashed to so many bits.
BITS = 18

#: What a text gives: text numbers and feature numbers, with repeats.
Features = Callable[[Slice], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Sample:
    """Texts as rows of feature numbers: row i has ids[at[i]:at[i + 1]]."""

    at: np.ndarray
    ids: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Sample:
        size = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])
        return Sample(at, self.ids[pick])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def presence(self) -> np.ndarray:
        return np.bincount(self.ids, minlength=1 << BITS)


@dataclass(frozen=True)
class Model:
    """A linear score over the features with a weight; others count nothing."""

    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, piece: Slice, features: Features) -> np.ndarray:
        owner, ids = features(piece)
        kept = self.weights[ids] != 0
        pairs = np.unique((owner[kept].astype(np.uint64) << U64(BITS)) | ids[kept].astype(np.uint64))
        row, ids = (pairs >> U64(BITS)).astype(np.int64), (pairs & U64((1 << BITS) - 1)).astype(np.int64)
        return np.bincount(row, self.weights[ids], len(piece)) + self.bias


def distinct(piece: Slice, features: Features) -> tuple[np.ndarray, np.ndarray]:
    owner, ids = features(piece)
    pairs = np.unique((owner.astype(np.uint64) << U64(BITS)) | ids.astype(np.uint64))
    return (pairs >> U64(BITS)).astype(np.int64), (pairs & U64((1 << BITS) - 1)).astype(np.uint32)


def sketches(piece: Slice) -> np.ndarray:
    """[n, 2]: the two least hashes of each text's runs of five words (of its words, if it has fewer): near copies share them."""
    start, end, owner = piece.words()
    words = span_hash(prefix_hash(BYTE_KEY[piece.data]), start, end)
    runs = words.copy()
    for j in range(1, min(5, len(words))):
        runs[: len(words) - j] += mix(words[j:] + U64(j))
    count = np.bincount(owner, minlength=len(piece))
    whole = np.concatenate([owner[:-4] == owner[4:], np.zeros(4, bool)]) if len(words) > 4 else np.zeros(len(words), bool)
    short = (count < 5)[owner]
    of, key = owner[whole | short], mix(np.where(short, words, runs))[whole | short]
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    out = np.zeros((len(piece), 2), np.uint64)
    for j in range(2):
        at = np.searchsorted(of, np.arange(len(piece))) + j
        has = at < np.searchsorted(of, np.arange(len(piece)), "right")
        out[has, j] = key[at[has]]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The positives' share of the unlabelled scores.

    Above any threshold the unlabelled hold at least prior times what the
    positives hold there, so the least ratio of the two upper tails bounds the
    prior from above and reaches it where no negative scores as high. Each
    ratio counts with two standard errors, so that thin tails do not win.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.9, 46)))
    tail = lambda x: (len(x) - np.searchsorted(np.sort(x), cuts)) / len(x)
    p, u = tail(positive), tail(unlabelled)
    error = 2 * (np.sqrt(u * (1 - u) / len(unlabelled)) + u / p * np.sqrt(p * (1 - p) / len(positive)) * 0.5)
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def place(positive: np.ndarray, unlabelled: np.ndarray, prior: float, slack: float = 0.002) -> float:
    """The cut with the least non-negative risk for the 0-1 loss, in the middle of its plateau."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    cuts = np.concatenate([cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1])
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    p, u = tail(positive), tail(unlabelled)
    risk = prior * (1 - p) + np.maximum(0, u - prior * p)
    best = int(np.argmin(risk))
    near = risk <= risk[best] + slack
    lo = best - int(np.argmin(np.append(near[best::-1], False))) + 1
    hi = best + int(np.argmin(np.append(near[best:], False))) - 1
    return float((cuts[lo] + cuts[hi]) / 2)


def fit(positive: Sample, unlabelled: Sample, *, threshold: float = 0.5, least_z: float = 4.0, epochs: int = 40, rate: float = 0.05, decay: float = 0.03, seed: int = 11) -> Model:
    """The nnPU minimiser over features whose presence differs between the samples.

    The convex loss leaves the bias conservative; it is moved at the end so that
    the cut with the least risk stands at the threshold. least_z: standard errors
    by which presence must differ.
    """
    rng = np.random.default_rng(seed)
    weights = np.zeros(1 << BITS, np.float64)
    if not len(positive) or not len(unlabelled):
        return Model(weights, 0.0, 0.5)

    def contrast(p: Sample, u: Sample) -> tuple[np.ndarray, np.ndarray]:
        a, b, n, m = p.presence(), u.presence(), len(p), len(u)
        odds = np.log((a + 0.5) / (n + 1)) - np.log((b + 0.5) / (m + 1))
        share = (a + b + 1) / (n + m + 2)
        z = ((a + 0.5) / (n + 1) - (b + 0.5) / (m + 1)) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
        return odds, z

    # the prior comes from scores that were not fitted to the texts they score
    own, other = (np.arange(len(x)) % 3 for x in (positive, unlabelled))
    scored: list[list[np.ndarray]] = [[], []]
    for part in range(3):
        odds, z = contrast(positive.take(np.flatnonzero(own != part)), unlabelled.take(np.flatnonzero(other != part)))
        odds[np.abs(z) < least_z] = 0
        for out, sample, of in ((scored[0], positive, own), (scored[1], unlabelled, other)):
            piece = sample.take(np.flatnonzero(of == part))
            out.append(np.bincount(piece.owner(), odds[piece.ids], len(piece)))
    prior = estimate_prior(np.concatenate(scored[0]), np.concatenate(scored[1]))

    odds, z = contrast(positive, unlabelled)
    chosen = np.abs(z) >= least_z
    spot = np.flatnonzero(chosen)
    slot = np.cumsum(chosen) - 1
    slim = []
    for sample in (positive, unlabelled):
        kept = chosen[sample.ids]
        upto = np.concatenate([[0], np.cumsum(kept)])
        slim.append(Sample(upto[sample.at], slot[sample.ids[kept]]))
    (pos, unl), scale = slim, odds[spot]

    theta, bias = np.zeros(len(spot)), 0.0
    first, second = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    step, batches = 0, max(1, len(unl) // 512)
    for _ in range(epochs):
        p_parts = np.array_split(rng.permutation(len(pos)), batches)
        u_parts = np.array_split(rng.permutation(len(unl)), batches)
        for p_rows, u_rows in zip(p_parts, u_parts, strict=True):
            if not len(p_rows) or not len(u_rows):
                continue
            p, u = pos.take(p_rows), unl.take(u_rows)
            p_of, u_of = p.owner(), u.owner()
            gp = np.bincount(p_of, (theta * scale)[p.ids], len(p)) + bias
            gu = np.bincount(u_of, (theta * scale)[u.ids], len(u)) + bias
            soft = lambda x: np.logaddexp(0, x)
            negative = soft(gu).mean() - prior * soft(gp).mean()
            if negative >= 0:
                dp = prior * (-sigmoid(-gp) - sigmoid(gp)) / len(p)
                du = sigmoid(gu) / len(u)
            else:
                dp = prior * sigmoid(gp) / len(p)
                du = -sigmoid(gu) / len(u)
            grad = np.zeros(len(theta) + 1)
            grad[:-1] = scale * (np.bincount(p.ids, dp[p_of], len(theta)) + np.bincount(u.ids, du[u_of], len(theta)))
            grad[:-1] += decay * theta
            grad[-1] = dp.sum() + du.sum()
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            theta -= move[:-1]
            bias -= move[-1]
    weights[spot] = theta * scale
    cut = place(*(np.bincount(x.owner(), (theta * scale)[x.ids], len(x)) for x in (pos, unl)), prior)
    bias = float(np.log(threshold / (1 - threshold)) - cut)
    return Model(weights.astype(np.float32), float(bias), prior)


def _sample(packed: list[bytes]) -> Sample:
    ids = [np.frombuffer(x, np.uint32).astype(np.int64) for x in sorted(packed)]
    return Sample(np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64), np.concatenate([*ids, np.zeros(0, np.int64)]))


def fitted(docs: DataFrame, features: Features, varied: bool = True, **options: float) -> Model:
    """The model of docs (kind: 1 positive, 0 unlabelled; text), which must be bounded.

    Features are made where the texts are; one task gathers them and trains, and
    the driver gets the weights. varied: of near copies one counts, for copies
    would teach their words; of use where features are words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0)
            for piece in slices(batch.column(1)):
                row, ids = distinct(piece, features)
                upto = np.searchsorted(row, np.arange(len(piece) + 1))
                packed = [ids[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                sketch = [x.tobytes() for x in sketches(piece)]
                yield pa.record_batch([kind.slice(piece.lo, len(piece)), pa.array(packed, pa.binary()), pa.array(sketch, pa.binary())], ["kind", "ids", "sketch"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {0: [], 1: []}
        seen: set[tuple[int, bytes]] = set()
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "ids", "sketch")), strict=True))
        for kind, ids, sketch in sorted(rows):
            if not varied or (kind, sketch) not in seen:
                packed[kind].append(ids)
            seen.add((kind, sketch))
        model = fit(_sample(packed.pop(1)), _sample(packed.pop(0)), **options)
        spot = np.flatnonzero(model.weights)
        yield pa.record_batch([pa.array([spot.astype(np.uint32).tobytes()], pa.binary()), pa.array([model.weights[spot].tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.prior])], ["spot", "weights", "bias", "prior"])

    made = small_batches(docs).select("kind", "text").mapInArrow(rows, "kind int, ids binary, sketch binary")
    got = made.repartition(1).mapInArrow(learn, "spot binary, weights binary, bias double, prior double").collect()
    weights = np.zeros(1 << BITS, np.float32)
    if not got:
        return Model(weights, 0.0, 0.5)
    weights[np.frombuffer(got[0]["spot"], np.uint32)] = np.frombuffer(got[0]["weights"], np.float32)
    return Model(weights, got[0]["bias"], got[0]["prior"])


def train(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, features: Features, *, positives: int, unlabelled: int, **options: float | bool) -> Model:
    """A model of label from a bounded sample of the rows for which learn holds.

    positives: most texts labelled 1; unlabelled: most texts whose labels, if
    any, stay hidden. Both are the rows with the least hash of doc_id.
    """
    by_hash = [F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id")]
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col(label) == 1) & learn).select("doc_id")
    # the least few of each partition: no shuffle of ids; repeated ids take places but count once
    trusted = known.orderBy(*by_hash).limit(positives).distinct().select(F.lit(1).alias("kind"), "doc_id")
    hidden = docs.filter(F.col("doc_id").isNotNull() & learn).select("doc_id")
    hidden = hidden.orderBy(*(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.col("doc_id"))).limit(unlabelled).distinct().select(F.lit(0).alias("kind"), "doc_id")
    # at most positives + unlabelled ids: small whatever the corpus
    chosen = F.broadcast(trusted.unionByName(hidden))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["kind", "doc_id"])
    return fitted(texts, features, **options)


def score(docs: DataFrame, model: Model, features: Features, threshold: float, keep_text: bool = False) -> DataFrame:
    """Every row of docs (text, other columns) with score and predicted in place of text, or besides it."""
    docs = small_batches(docs).drop("score", "predicted")
    kept = [c for c in docs.columns if keep_text or c != "text"]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    spot = np.flatnonzero(model.weights)
    packed = (spot, model.weights[spot], model.bias, model.prior)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[packed[0]] = packed[1]
        own = Model(weights, packed[2], packed[3])
        for batch in batches:
            z = [own.logits(piece, features) for piece in slices(batch.column("text"))]
            p = sigmoid(np.concatenate([*z, np.zeros(0)]))
            columns = [batch.column(c) for c in kept]
            yield pa.record_batch([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return (docs if keep_text else docs.select(*kept, "text")).mapInArrow(rows, schema)
