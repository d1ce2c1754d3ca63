"""Content and boilerplate lines by a linear-chain conditional random field.

Every line of a text is a position of the chain, described by indicators of its
size, make-up and repetition. The weights are fitted in numpy by maximum
likelihood (forward-backward) on a bounded sample of texts with a quality
label: in a good text a line is content unless it repeats an earlier one, in a
bad text it is boilerplate. Viterbi decoding marks the lines of every text, and
the share of bytes in content lines decides whether the text is kept.

Null text counts as empty: no words, base_failed, not kept. A text of blank
lines has content share 0. Repeated rows are scored alike; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches
from .textcore import BYTE_KEY, SEPARATOR, U64, Slice, mix, prefix_hash, slices, span_hash

#: Bound of the training sample, in texts of each label; a longer training chain is taught in pieces of so
#: many pairs of lines, which share a line, so that every pair of neighbours teaches its transition.
TEXTS, CHAIN = 1500, 64
#: A text is kept if at least this share of its line bytes is content.
CONTENT_SHARE = 0.5
#: The base rules: words in a window, fewest words, most repeated words in a hundred.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_END = np.full(256, 3)
_END[list(b".!?")] = 0
_END[list(b",;:")] = 1
_END[_LOWER | (np.arange(256) >= 128)] = 2

#: Values of each indicator, in the order of ``describe``.
_SIZES = (16, 8, 8, 8, 8, 8, 4, 8, 2, 3, 8)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_FIRST[-1])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then 1 to 7 by doublings up to all."""
    share = part / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(8 + np.floor(np.log2(np.maximum(share, 1e-9))), 1, 7), 0).astype(np.int64)


@dataclass
class Lines:
    """Lines with a word or without: bounds, text number, indicators, and whether one repeats an earlier line."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    features: np.ndarray
    again: np.ndarray
    n_words: np.ndarray


def describe(piece: Slice, words: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray, hashes: np.ndarray) -> Lines:
    start, end, owner = piece.lines()
    w_start, w_end, _ = words
    size = end - start
    first, last = np.searchsorted(w_start, start), np.searchsorted(w_start, end)
    n_words = last - first

    def inside(members: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(members[piece.data])])
        return upto[end] - upto[start]

    upper, lower, chars = inside(_UPPER), inside(_LOWER), inside(~SEPARATOR)
    # a line with words that equals an earlier one of its text
    key = mix(span_hash(raw, start, end) ^ (owner.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    again = np.zeros(len(start), bool)
    again[order] = same
    again &= n_words > 0
    # words of the line that equal the word two places before
    echo = np.zeros(len(w_start) + 1, np.int64)
    if len(hashes) > 2:
        echo[3:] = np.cumsum(hashes[2:] == hashes[:-2])
    echoes = np.maximum(echo[last] - echo[np.minimum(first + 2, last)], 0)
    mean = chars / np.maximum(n_words, 1)
    tail = piece.data[np.maximum(end - 1, 0)] if len(piece.data) else np.zeros(len(end), np.uint8)
    edge = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), 0, np.where(np.concatenate([owner[1:] != owner[:-1], [True]]), 2, 1))
    columns = (
        np.minimum(np.log2(size + 1).astype(np.int64), 15),
        _share(inside(SYMBOL), size),
        _share(upper, upper + lower),
        _share(inside(_DIGIT), size),
        _share(inside(_MARK), size),
        np.minimum(np.log2(n_words + 1).astype(np.int64), 7),
        np.where(size > 0, _END[tail], 3),
        np.minimum((mean / 2).astype(np.int64), 7),
        again.astype(np.int64),
        edge,
        _share(echoes, n_words),
    )
    return Lines(start, end, owner, np.stack(columns, axis=1) + _FIRST[:-1], again, n_words)


def repeated_words(owner: np.ndarray, hashes: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows of so many words that occur twice or more in it."""
    count = len(hashes) - window + 1
    if count <= 0:
        return np.zeros(n, np.int64)
    key = np.zeros(count, np.uint64)
    for j in range(window):
        key = (key ^ hashes[j : j + count]) * U64(0x9E3779B97F4A7C15)
        key ^= key >> U64(29)
    whole = owner[:count] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    key = mix(key[at] ^ (owner[at].astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    ranked = key[order]
    twin = np.zeros(len(at), bool)
    equal = ranked[1:] == ranked[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    found = at[order[twin]]
    edge = np.bincount(found, minlength=len(hashes) + 1)[: len(hashes) + 1] - np.bincount(found + window, minlength=len(hashes) + 1)[: len(hashes) + 1]
    return np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=n)


@dataclass(frozen=True)
class Chain:
    """Weights of the field: unary of (feature, label), and label pairs. Label 1 is content."""

    unary: np.ndarray
    pairs: np.ndarray


def viterbi(model: Chain, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The likeliest labels of every text's chain; the chains go side by side."""
    scores = model.unary[features].sum(axis=1)
    length = np.bincount(owner, minlength=n)
    first = np.cumsum(length) - length
    rank = np.argsort(-length, kind="stable")
    first, length = first[rank], length[rank]
    labels = np.zeros(len(owner), np.int8)
    back = np.zeros((len(owner), 2), np.int8)
    best = np.zeros((n, 2))
    most = int(length[0]) if n else 0
    alive = np.searchsorted(-length, -np.arange(most), "left")  # chains longer than t
    for t in range(most):
        k = alive[t]
        at = first[:k] + t
        if t == 0:
            best[:k] = scores[at]
            continue
        step = best[:k, :, None] + model.pairs[None]
        back[at] = step.argmax(axis=1)
        best[:k] = step.max(axis=1) + scores[at]
    state = best.argmax(axis=1).astype(np.int8)
    for t in range(most - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


def fit(chains: list[tuple[np.ndarray, np.ndarray]], *, steps: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum likelihood of the given (features, labels) chains, by forward-backward and Adam."""
    unary, pairs = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    chains = [(f[i : i + CHAIN + 1], y[i : i + CHAIN + 1]) for f, y in chains for i in range(0, max(1, len(y) - 1), CHAIN) if len(y)]
    if not chains:
        return Chain(unary, pairs)
    chains.sort(key=lambda c: -len(c[1]))  # the chains that reach step t come first
    n, length = len(chains), np.array([len(y) for _, y in chains])
    most = int(length[0])
    alive = np.searchsorted(-length, -np.arange(most), "left")
    live = np.arange(most)[None] < length[:, None]
    features, truth = np.concatenate([f for f, _ in chains]), np.concatenate([y for _, y in chains])
    weight = 1 / n
    seen_pairs = np.zeros((2, 2))
    for _, y in chains:
        np.add.at(seen_pairs, (y[:-1], y[1:]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (unary, pairs)]
    flat = features.reshape(-1)
    for step in range(1, steps + 1):
        score = np.zeros((n, most, 2))
        score[live] = unary[features].sum(axis=1)
        fore, aft = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fore[:, 0] = score[:, 0]
        for t in range(1, most):
            k = alive[t]
            fore[:k, t] = np.logaddexp(fore[:k, t - 1, 0, None] + pairs[0], fore[:k, t - 1, 1, None] + pairs[1]) + score[:k, t]
        for t in range(most - 2, -1, -1):
            k = alive[t + 1]
            onward = aft[:k, t + 1] + score[:k, t + 1]
            aft[:k, t] = np.logaddexp(onward[:, 0, None] + pairs[:, 0], onward[:, 1, None] + pairs[:, 1])
        final = fore[np.arange(n), length - 1]
        total = np.logaddexp(final[:, 0], final[:, 1])
        share = np.exp(fore + aft - total[:, None, None])[live]
        share[np.arange(len(truth)), truth] -= 1
        grad = np.stack([np.bincount(flat, np.repeat(share[:, y], features.shape[1]), N_FEATURES) for y in (0, 1)], axis=1) * weight + decay * unary
        both = live[:, 1:]
        joint = fore[:, :-1, :, None] + pairs + (score + aft)[:, 1:, None, :] - total[:, None, None, None]
        grad_pairs = (np.exp(joint[both]).sum(axis=0) - seen_pairs) * weight + decay * pairs
        for x, g, (a, b) in zip((unary, pairs), (grad, grad_pairs), moments, strict=True):
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.99 * b + 0.01 * g * g
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Chain(unary, pairs)


def _pieces(column: pa.Array) -> Iterator[tuple[Slice, tuple, np.ndarray, np.ndarray]]:
    for piece in slices(column):
        words = piece.words()
        raw = prefix_hash(BYTE_KEY[piece.data])
        yield piece, words, raw, span_hash(raw, words[0], words[1])


def train(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Chain:
    """The field fitted to at most 2 * texts labelled texts, those with the least hash of doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality").dropDuplicates(["doc_id"])
    parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64(F.lit("lines"), "doc_id"), "doc_id").limit(texts) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * texts rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("quality").to_numpy() == 1
            out = []
            for piece, words, raw, hashes in _pieces(batch.column("text")):
                lines = describe(piece, words, raw, hashes)
                y = good[piece.lo : piece.hi][lines.owner] & ~lines.again
                upto = np.searchsorted(lines.owner, np.arange(len(piece) + 1))
                out += [(lines.features[a:b].astype(np.uint8).tobytes(), y[a:b].astype(np.int8).tobytes()) for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["features", "labels"])

    sample = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        model = fit([(np.frombuffer(f, np.uint8).reshape(-1, len(_SIZES)).astype(np.int64), np.frombuffer(y, np.int8).astype(np.int64)) for f, y in got])
        yield pa.record_batch([pa.array([model.unary.tobytes()], pa.binary()), pa.array([model.pairs.tobytes()], pa.binary())], ["unary", "pairs"])

    # one task gathers the lines' features and trains; the driver gets the weights
    made = sample.select("quality", "text").mapInArrow(rows, "features binary, labels binary")
    got = made.repartition(1).mapInArrow(learn, "unary binary, pairs binary").collect()
    if not got:
        return fit([])
    return Chain(np.frombuffer(got[0]["unary"]).reshape(-1, 2).copy(), np.frombuffer(got[0]["pairs"]).reshape(2, 2).copy())


def marked(docs: DataFrame, model: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Every row of docs (doc_id, text) with its counts, base_failed, content share and verdict."""
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_lines bigint, n_content_lines bigint, content_share double, kept boolean"
    schema = schema.replace("doc_id bigint", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for piece, words, raw, hashes in _pieces(batch.column("text")):
                n, (_, _, owner) = len(piece), words
                lines = describe(piece, words, raw, hashes)
                count = lambda members: np.diff(np.concatenate([[0], np.cumsum(members)])[np.concatenate([piece.starts, piece.ends[-1:]])])  # noqa: B023, E731
                n_words = np.bincount(owner, minlength=n)
                chars = count(~SEPARATOR[piece.data] & ((piece.data & 0xC0) != 0x80))
                repeated = repeated_words(owner, hashes, n)
                failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
                content = viterbi(model, lines.features, lines.owner, n).astype(bool) & (lines.n_words > 0)
                size = lines.end - lines.start
                share = np.bincount(lines.owner[content], size[content], n) / np.maximum(np.bincount(lines.owner, size, n), 1)
                yield pa.record_batch(
                    [ids.slice(piece.lo, n), *(pa.array(x) for x in (
                        n_words, chars, count(SYMBOL[piece.data]), np.bincount(lines.owner[lines.again], minlength=n), repeated, failed,
                        np.bincount(lines.owner, minlength=n), np.bincount(lines.owner[content], minlength=n), share, ~failed & (share >= content_share),
                    ))], names)

    return small_batches(docs).select("doc_id", "text").mapInArrow(rows, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return marked(docs, train(docs, labels))
