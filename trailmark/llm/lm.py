"""Language-model scores by a log-bilinear neural model with noise-contrastive training.

Tokens are words (A-Z lowered) and an end. The network predicts a token's class
from the classes of the tokens before it: the most frequent words are classes
by themselves, all others fall into groups by their last two bytes. A group's
words of the broadcast table stand in cells of CELL words, by frequency; one
more cell stands for the words outside the table. The network predicts the cell
in the group and the word in the cell too, and every word of the table has
vectors of its own, as context and as what is predicted. Only a word outside the
table has its share of such words' training counts in the group, with half a
count added to each and half for what was never seen. So every text has a
normalised probability:

    log P(token) = log softmax(r . Q + b)[class] + log softmax(r . Q + b)[cell of class]
                   + log softmax(r . Q + b)[word of cell], or + log share(word outside the table)
    r = sum over the last CONTEXT tokens of (position weights * (class vector + word vector))

Training goes over all training texts: each task runs noise-contrastive
estimation in numpy on its part from a common start, and the parameters are
averaged, those of classes by numbers of tokens and those of words and cells by
how often they were met, in two steps, so the driver gets a bounded number of
small arrays and one row for each word of the table. Softmax sums are taken in full, by batched matrix
products.

Counts are those of all training tokens. The most frequent words' counts (at
most ``TABLE``) go to every task; the other words of each text meet their
counts in a join by word.

Null text counts as empty: one end token. Rows with null or equal ids are
separate rows; a null id counts as the empty text when folds are dealt. An
empty table gives an empty result; without training texts all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, small_batches, written
from .textcore import BYTE_KEY_LOWER, U64, Slice, mix, prefix_hash, signed, slices, span_hash

FOLDS, HELD_OUT = 5, 1
HEADS, GROUPS, CONTEXT, WIDTH = 111, 48, 3, 8
#: Classes: heads, groups, end. One more number stands for what precedes a text.
END = HEADS + GROUPS
CLASSES = END + 1
NOISE, BATCH, RATE = 24, 16384, 0.03
#: Words of a cell at most, and noise drawn for each word and each cell.
CELL, NOISE_BELOW = 64, 2
#: The first steps take so many tokens, every so many steps twice as many, up to BATCH.
FIRST_BATCH, DOUBLING = 256, 64
#: Most words whose counts go to every task; averaging goes through so many rows.
TABLE, SLOTS = 1 << 16, 32
_LEADING = 18
#: Bytes of text and tokens that are looked at together: the more, the longer the matrices of each cell.
_SLICE, _AT_ONCE = 1 << 22, 1 << 18


def tokens(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, group and text number of every word."""
    start, end, owner = piece.words()
    h = span_hash(prefix_hash(BYTE_KEY_LOWER[piece.data]), start, end)
    if not len(h):
        return signed(h), np.zeros(0, np.int64), owner
    last = BYTE_KEY_LOWER[piece.data[end - 1]]
    second = np.where(end - start > 1, BYTE_KEY_LOWER[piece.data[np.maximum(end - 2, 0)]], U64(0))
    group = (mix(last ^ mix(second)) % U64(GROUPS)).astype(np.int64)
    return signed(h), group, owner


def counts(texts: DataFrame) -> DataFrame:
    """h, g, c: every word's hash, group and number of occurrences in texts (text)."""

    def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, g, c = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, g, c = h[order], g[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.record_batch([pa.array(h[new]), pa.array(g[new].astype(np.int32)), pa.array(np.add.reduceat(c, new))], ["h", "g", "c"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for piece in slices(batch.column(0), _SLICE):
                h, g, _ = tokens(piece)
                if len(h):
                    u, first, c = np.unique(h, return_index=True, return_counts=True)
                    found.append((u, g[first], c))
                    held += len(u)
            if held > _AT_ONCE * 8:  # words that a task holds before it sends their counts
                yield merged(found)
                found, held = [], 0
        if found:
            yield merged(found)

    partial = texts.select("text").mapInArrow(rows, "h bigint, g int, c bigint")
    return partial.groupBy("h").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


@dataclass(frozen=True)
class Tree:
    """What stands below the groups: words, cell by cell, then cells, group by group. Siblings are neighbours."""

    words: int
    lo: np.ndarray  # of words and cells: their siblings, at most CELL or a group's cells, are lo to hi
    hi: np.ndarray
    cell: np.ndarray  # of words: the number of their cell
    rest: np.ndarray  # of groups: the cell of the words outside the table
    share: np.ndarray  # among the siblings, by counts

    @classmethod
    def of(cls, group: np.ndarray, count: np.ndarray, rest_counts: np.ndarray) -> Tree:
        """group and count of the words, by group; rest_counts are those of the words outside the table, by group."""
        sizes = np.bincount(group, minlength=GROUPS)
        rank = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        n_cells = 1 + -(-sizes // CELL)
        first = np.cumsum(n_cells) - n_cells  # the first cell of a group is for the words outside the table
        cell = first[group] + 1 + rank // CELL
        cell_counts = np.bincount(cell, count, int(n_cells.sum()))
        cell_counts[first] = rest_counts
        starts, n = np.searchsorted(cell, np.arange(len(cell_counts) + 1)), len(group)
        lo = np.concatenate([starts[cell], n + np.repeat(first, n_cells)])
        hi = np.concatenate([starts[cell + 1], n + np.repeat(first + n_cells, n_cells)])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([count, cell_counts + 0.5]))])
        return cls(n, lo, hi, n + cell, n + first, np.diff(upto) / (upto[hi] - upto[lo]))

    def draw(self, node: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """NOISE_BELOW siblings of each node, all alike likely, itself among them."""
        lo, size = self.lo[node][:, None], (self.hi - self.lo)[node][:, None]
        return lo + (rng.random((len(node), NOISE_BELOW), np.float32) * size).astype(np.int64) % size


@dataclass(frozen=True)
class Vocabulary:
    """Training totals and the frequent words, by ascending hash."""

    n: int  # tokens
    v: int  # distinct tokens
    ends: int
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray  # of the words of hashes: a head's number or the group's
    masses: np.ndarray  # by group: sum of (count + 0.5) of its words outside hashes, and 0.5
    frequency: np.ndarray  # by class
    nodes: np.ndarray  # of the words of hashes: the number in tree, -1 for heads
    tree: Tree
    #: Where the hashes with each value of their leading bits start; found by ``indexed``.
    starts: np.ndarray | None = None

    def indexed(self) -> Vocabulary:
        """With an index of leading bits, four times as many values as words, which makes ``find`` short."""
        starts = np.searchsorted(self.hashes.astype(np.int64) >> (64 - _LEADING), np.arange(-(1 << _LEADING - 1), (1 << _LEADING - 1) + 1))
        return replace(self, starts=starts.astype(np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in hashes, -1 if absent."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        if self.starts is None:
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            return np.where(self.hashes[at] == h, at, -1)
        value = (h >> (64 - _LEADING)) + (1 << _LEADING - 1)
        at, end = self.starts[value], self.starts[value + 1]
        out = np.full(len(h), -1)
        todo = np.flatnonzero(at < end)
        while len(todo):
            own = at[todo]
            hit = self.hashes[own] == h[todo]
            out[todo[hit]] = own[hit]
            at[todo] += 1
            todo = todo[~hit & (own + 1 < end[todo])]
        return out

    def classed(self, h: np.ndarray, g: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        place = self.find(h) if place is None else place
        return np.where(place >= 0, self.classes[place] if len(self.classes) else 0, HEADS + g)


def vocabulary(table: DataFrame, n_texts: int) -> Vocabulary:
    """table: h, g, c of the training words."""
    level = F.floor(F.log2("c") * 8).cast("int")
    steps = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()  # 8 an octave
    n, v, kept, least = sum(r["c"] for r in steps), sum(r["words"] for r in steps), 0, None
    for r in steps:
        kept += r["words"]
        if kept > TABLE:
            break
        least = r["level"]
    frequent = table.filter(level >= (least if least is not None else 1 << 30)).toArrow()  # TABLE rows at most
    h, g, c = (frequent.column(k).to_numpy().astype(np.int64) for k in ("h", "g", "c"))
    order = np.argsort(h)
    h, g, c = h[order], g[order], c[order]
    heads = np.lexsort((h, -c))[:HEADS]
    classes = HEADS + g
    classes[heads] = np.arange(len(heads))
    masses, group_counts = np.full(GROUPS, 0.5), np.zeros(GROUPS)
    for r in table.groupBy("g").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("w")).collect():
        masses[r["g"]] += r["c"] + 0.5 * r["w"]
        group_counts[r["g"]] += r["c"]
    np.subtract.at(masses, g[heads], c[heads] + 0.5)
    np.subtract.at(group_counts, g[heads], c[heads])
    frequency = np.zeros(CLASSES)
    frequency[: len(heads)] = c[heads]
    frequency[HEADS:END] = group_counts
    frequency[END] = n_texts
    below = np.flatnonzero(classes >= HEADS)
    below = below[np.lexsort((h[below], -c[below], g[below]))]
    np.subtract.at(masses, g[below], c[below] + 0.5)
    nodes = np.full(len(h), -1)
    nodes[below] = np.arange(len(below))
    tree = Tree.of(g[below], c[below], group_counts - np.bincount(g[below], c[below], GROUPS))
    return Vocabulary(n + n_texts, v + (n_texts > 0), n_texts, h, c, classes, masses, frequency, nodes, tree).indexed()


def before(target: np.ndarray, since: np.ndarray, none: int) -> np.ndarray:
    """What stands before each token, the nearest first; since counts the tokens before it in its text."""
    context = np.full((len(target), CONTEXT), none, np.int32)
    for i in range(CONTEXT):
        if len(target) > i:
            context[i + 1 :, i] = np.where(since[i + 1 :] > i, target[: len(target) - i - 1], none)
    return context


def sequence(piece: Slice, words: Vocabulary, place: np.ndarray, h: np.ndarray, g: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, each text's end included, and the classes before each; then words (tree numbers or -1) likewise."""
    n = len(piece)
    size = np.bincount(owner, minlength=n) + 1
    target, word = np.full(int(size.sum()), END, np.int64), np.full(int(size.sum()), -1, np.int64)
    at = np.arange(len(h)) + owner
    target[at] = words.classed(h, g, place)
    word[at] = np.where(place >= 0, words.nodes[place] if len(words.nodes) else -1, -1)
    since = np.arange(len(target)) - np.repeat(np.cumsum(size) - size, size)
    return target, before(target, since, CLASSES), word, before(word, since, -1)


class Network:
    """Class vectors r, position weights p, output vectors q and biases b, float32."""

    def __init__(self, r: np.ndarray, p: np.ndarray, q: np.ndarray, b: np.ndarray):
        self.r, self.p, self.q, self.b = r, p, q, b

    @classmethod
    def start(cls, frequency: np.ndarray) -> Network:
        rng = np.random.default_rng(31)
        share = (frequency + 0.5) / (frequency + 0.5).sum()
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(draw(CLASSES + 1, WIDTH), (1 + draw(CONTEXT, WIDTH)) / 2, draw(CLASSES, WIDTH), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.p, self.q, self.b]

    def pack(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in self.parts())

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Network:
        shapes = [(CLASSES + 1, WIDTH), (CONTEXT, WIDTH), (CLASSES, WIDTH), (CLASSES,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*(x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))

    def predicted(self, context: np.ndarray) -> np.ndarray:
        out = self.r[context[:, 0]] * self.p[0]
        for i in range(1, CONTEXT):
            out += self.r[context[:, i]] * self.p[i]
        return out

    def log10(self, target: np.ndarray, context: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """Normalised log10 probabilities of the target classes; more: what word vectors add to the prediction."""
        out = np.empty(len(target))
        for lo in range(0, len(target), 2048):  # so that the logits stay near the processor
            part = slice(lo, lo + 2048)
            guess = self.predicted(context[part])
            out[part] = _log_softmax(self.q, self.b, guess if more is None else guess + more[part], target[part])
        return out / np.log(10)


def _log_softmax(q: np.ndarray, b: np.ndarray, guess: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each row's target; candidates lie in rows, so that sums over them run along the memory."""
    logits = q @ guess.T
    logits += b[:, None]
    own = logits[target, np.arange(len(target))]
    top = logits.max(axis=0)
    logits -= top
    np.exp(logits, out=logits)
    return (own - top - np.log(logits.sum(axis=0))).astype(np.float64)


class Below:
    """Of every word and cell of a tree: what it adds to a prediction as context (e), output vector q and bias b, float32."""

    def __init__(self, tree: Tree, e: np.ndarray, q: np.ndarray, b: np.ndarray):
        self.tree, self.e, self.q, self.b = tree, e, q, b

    @classmethod
    def start(cls, tree: Tree) -> Below:
        n = len(tree.share)
        # e has one more row, of zeros, which -1 meets
        return cls(tree, np.zeros((n + 1, WIDTH), np.float32), np.zeros((n, WIDTH), np.float32), np.log(tree.share).astype(np.float32))

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([self.e[at], self.q[at], self.b[at, None]], axis=1)

    def put(self, at: np.ndarray, rows: np.ndarray) -> None:
        self.e[at], self.q[at], self.b[at] = rows[:, :WIDTH], rows[:, WIDTH:-1], rows[:, -1]

    def added(self, p: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = self.e[words[:, 0]] * p[0]
        for i in range(1, CONTEXT):
            out += self.e[words[:, i]] * p[i]
        return out

    def log10(self, guess: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        """By row of guess: the sum of normalised log10 probabilities of the nodes (at: their rows) among their siblings."""
        out, lo = np.zeros(len(guess)), self.tree.lo[node]
        if not len(node):
            return out
        order = np.argsort(lo, kind="stable")
        lo, rows, node = lo[order], at[order], node[order]
        near = guess[rows]
        starts = np.flatnonzero(np.diff(lo, prepend=-1)).tolist()
        found = np.empty(len(node))
        for start, end in zip(starts, [*starts[1:], len(node)], strict=True):
            first, last = lo[start], self.tree.hi[node[start]]
            found[start:end] = _log_softmax(self.q[first:last], self.b[first:last], near[start:end], node[start:end] - first)
        out[rows] = found
        return out / np.log(10)


def log10(net: Network, below: Below, target: np.ndarray, context: np.ndarray, word: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 probabilities of tokens, those of words outside the table without their share in it."""
    out = np.empty(len(target))
    for lo in range(0, len(target), _AT_ONCE):
        part = slice(lo, lo + _AT_ONCE)
        more = below.added(net.p, words[part])
        out[part] = net.log10(target[part], context[part], more)
        guess = net.predicted(context[part]) + more
        for at, node in nodes_of(below.tree, target[part], word[part]):
            out[part] += below.log10(guess, at, node)
    return out


def nodes_of(tree: Tree, target: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The cells of tokens that are in groups, then the words of those in the table: places of the tokens, numbers in tree."""
    grouped, known = np.flatnonzero((target >= HEADS) & (target < END)), np.flatnonzero(word >= 0)
    cell = tree.rest[target[grouped] - HEADS]
    own = word[grouped]
    cell[own >= 0] = tree.cell[own[own >= 0]]
    return [(grouped, cell), (known, word[known])]


class Trainer:
    """Noise-contrastive estimation by Adam; the noise among classes is shared by a batch."""

    def __init__(self, network: Network, below: Below, frequency: np.ndarray, seed: int):
        self.net, self.rng = network, np.random.default_rng(seed)
        self.below, n = below, len(below.b)
        self.below_offset = np.log(NOISE_BELOW / (below.tree.hi - below.tree.lo)).astype(np.float32)
        self.met, self.number = np.zeros(n, np.int64), np.zeros(n + 1, np.int32)
        self.squares = {"e": np.zeros_like(below.e), "q": np.zeros_like(below.q), "b": np.zeros_like(below.b)}
        share = (frequency + 0.5) / (frequency + 0.5).sum()
        self.upto = np.cumsum(share)
        self.offset = np.log(NOISE * share).astype(np.float32)
        self.first = [np.zeros_like(x) for x in network.parts()]
        self.second = [np.zeros_like(x) for x in network.parts()]
        self.step, self.tokens = 0, 0

    def batch(self) -> int:
        return min(BATCH, FIRST_BATCH << min(self.step // DOUBLING, 16))

    def learn(self, target: np.ndarray, context: np.ndarray, word: np.ndarray, words: np.ndarray) -> None:
        net, low, n = self.net, self.below, len(target)
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), CLASSES - 1)
        vectors = [net.r[context[:, i]] + low.e[words[:, i]] for i in range(CONTEXT)]
        guess = sum(v * p for v, p in zip(vectors, net.p, strict=True))
        own, other = net.q[target], net.q[noise]
        up = _sigmoid(np.einsum("nw,nw->n", guess, own) + net.b[target] - self.offset[target]) - 1
        down = guess @ other.T
        down += net.b[noise] - self.offset[noise]
        down = _sigmoid(down)
        pull = up[:, None] * own + down @ other
        ids, errors, rows = [], [], []
        for at, node in nodes_of(low.tree, target, word):
            both = np.concatenate([node[:, None], low.tree.draw(node, self.rng)], axis=1)
            outputs, here = low.q[both], guess[at]
            gap = np.einsum("nkw,nw->nk", outputs, here) + low.b[both] - self.below_offset[both]
            error = _sigmoid(gap)
            error[:, 0] -= 1
            pull[at] += np.einsum("nk,nkw->nw", error, outputs)
            ids.append(both.ravel())
            errors.append(error.ravel())
            rows.append((error[:, :, None] * here[:, None, :]).reshape(-1, WIDTH))
        grads = [np.zeros_like(x) for x in net.parts()]
        for i in range(CONTEXT):
            pulled = pull * net.p[i]
            grads[0] += _scatter(context[:, i], pulled, CLASSES + 1)
            grads[1][i] = np.einsum("nw,nw->w", vectors[i], pull)
        grads[2] = _scatter(target, up[:, None] * guess, CLASSES)
        np.add.at(grads[2], noise, down.T @ guess)
        grads[3] = np.bincount(target, up, CLASSES).astype(np.float32)
        np.add.at(grads[3], noise, down.sum(axis=0))
        self.step += 1
        rate = RATE / (1 + self.step / 500) ** 0.5
        for x, g, a, b in zip(net.parts(), grads, self.first, self.second, strict=True):
            g = g / n
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.99**self.step)) + 1e-8)
        # words and cells that the batch did not meet stay as they are
        met, at = self.numbered(np.concatenate(ids))
        self.met[met] += np.bincount(at, minlength=len(met))
        self.move("q", met, _scatter(at, np.concatenate(rows), len(met)), rate)
        self.move("b", met, np.bincount(at, np.concatenate(errors), len(met)).astype(np.float32), rate)
        known = words >= 0
        met, at = self.numbered(words[known])
        self.move("e", met, _scatter(at, (pull[:, None, :] * net.p)[known], len(met)), rate)
        self.tokens += n

    def numbered(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ids, and the place of each id among them."""
        self.number[ids] = 1
        met = np.flatnonzero(self.number)
        self.number[met] = np.arange(len(met), dtype=np.int32)
        at = self.number[ids]
        self.number[met] = 0
        return met, at

    def move(self, name: str, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Adagrad for rows that few batches meet."""
        x, squares = getattr(self.below, name), self.squares[name]
        squares[at] += grad * grad
        x[at] -= 5 * rate * grad / (np.sqrt(squares[at]) + 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    flat = (at[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat, rows.ravel(), size * WIDTH).reshape(size, WIDTH).astype(np.float32)


def train(texts: DataFrame, words: Vocabulary) -> tuple[Network, Below]:
    """The network after one pass over texts (text), averaged over tasks."""
    start, below = Network.start(words.frequency), Below.start(words.tree)
    wide, step = 2 * WIDTH + 1, -(-len(below.b) // SLOTS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(Network.start(words.frequency), Below.start(words.tree), words.frequency, 7)
        for batch in batches:
            for piece in slices(batch.column(0), _SLICE):
                h, g, owner = tokens(piece)
                parts = sequence(piece, words, words.find(h), h, g, owner)
                order = trainer.rng.permutation(len(parts[0]))  # neighbours in a batch tell little
                lo = 0
                while lo < len(order):
                    part = order[lo : lo + trainer.batch()]
                    trainer.learn(*(x[part] for x in parts))
                    lo += len(part)
        if trainer.tokens:
            slot = int(trainer.net.b.view(np.uint32).sum() % SLOTS)
            yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([trainer.tokens]), pa.array([trainer.net.pack()], pa.binary())], ["slot", "tokens", "network"])
            for slot in range(SLOTS):  # tokens -1: rows of words and cells that were met, their numbers and weights before them
                at = slot * step + np.flatnonzero(trainer.met[slot * step : (slot + 1) * step])
                if len(at):
                    packed = at.astype("<i4").tobytes() + trainer.met[at].astype("<f4").tobytes() + trainer.below.rows(at).astype("<f4").tobytes()
                    yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([-1]), pa.array([packed], pa.binary())], ["slot", "tokens", "network"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, sums = 0.0, 0, {}
        for batch in batches:
            for slot, tokens_, packed in zip(*(batch.column(k).to_pylist() for k in ("slot", "tokens", "network")), strict=True):
                if tokens_ >= 0:
                    total, weight = total + tokens_ * np.frombuffer(packed, "<f4").astype(np.float64), weight + tokens_
                    continue
                n = len(packed) // (4 * (wide + 2))
                at, w = np.frombuffer(packed, "<i4", n) - slot * step, np.frombuffer(packed, "<f4", n, 4 * n).astype(np.float64)
                into = sums.setdefault(slot, np.zeros((step, wide + 1)))
                into[at, :wide] += w[:, None] * np.frombuffer(packed, "<f4", n * wide, 8 * n).reshape(n, wide)
                into[at, wide] += w
        names = ["slot", "tokens", "network"]
        if weight:
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([weight]), pa.array([(total / weight).tobytes()], pa.binary())], names)
        for slot, into in sums.items():
            at = np.flatnonzero(into[:, wide])
            packed = (at + slot * step).astype("<i4").tobytes() + (into[at, :wide] / into[at, wide:]).astype("<f4").tobytes()
            yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([-1]), pa.array([packed], pa.binary())], names)

    schema = "slot int, tokens bigint, network binary"
    # the network of a task and its rows, in SLOTS ranges, go to SLOTS tasks, and the averages to the driver
    got = texts.select("text").mapInArrow(learn, schema).repartition(SLOTS, "slot").mapInArrow(average, schema).collect()
    for r in got:
        if r["tokens"] < 0:
            packed = bytes(r["network"])
            n = len(packed) // (4 * (wide + 1))
            below.put(np.frombuffer(packed, "<i4", n), np.frombuffer(packed, "<f4", n * wide, 4 * n).reshape(n, wide))
    got = sorted((r["tokens"], bytes(r["network"])) for r in got if r["tokens"] >= 0)
    if not got:
        return start, below
    total = sum(t * np.frombuffer(x, np.float64) for t, x in got)
    return Network.unpack(total / sum(t for t, _ in got)), below


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    training = small_batches(docs).filter(~out).select("text")
    table = written(counts(training), "lm-words")
    words = vocabulary(table, training.count())
    network, below = train(training, words)
    log_total = np.log10(words.n + 0.5 * (words.v + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ln = np.log10(words.counts + 0.5)
        mass = np.log10(words.masses)
        names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "h", "tf"]
        for batch in batches:
            for piece in slices(batch.column("text"), _SLICE):
                n = len(piece)
                h, g, owner = tokens(piece)
                place = words.find(h)
                target, context, word, near = sequence(piece, words, place, h, g, owner)
                size = np.bincount(owner, minlength=n) + 1
                of = np.repeat(np.arange(n), size)
                score = np.bincount(of, log10(network, below, target, context, word, near), n)
                frequent = place >= 0
                log_count = np.where(frequent, ln[place] if len(ln) else 0.0, 0.0)
                base = np.bincount(owner, log_count, n) + np.log10(words.ends + 0.5) - size * log_total
                score -= np.bincount(owner, np.where(frequent, 0.0, mass[g]), n)
                known = np.bincount(owner, frequent, n).astype(np.int64) + (words.ends > 0)
                # the words whose counts are not here
                rare = np.flatnonzero(~frequent)
                order = rare[np.lexsort((h[rare], owner[rare]))]
                new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])) if len(order) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(order))).astype(np.int32)
                upto = pa.array(np.searchsorted(owner[order[new]], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(upto, pa.array(x)) for x in (h[order[new]], tf)]
                own = [batch.column(c).slice(piece.lo, n) for c in names[:3]]
                yield pa.record_batch([*own, *(pa.array(x) for x in (size, known, base, score)), *lists], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double, h array<bigint>, tf array<int>"
    # the row numbers are written with the rows, so they hold whatever runs again later
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", out.alias("held_out"), "text")
    scored = written(numbered.mapInArrow(rows, schema), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("h", "tf")).alias("w")).select("row", F.col("w.h").alias("h"), F.col("w.tf").alias("tf"))
    met = rare.join(table.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("also"),
    )
    more, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0))
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + also).cast("bigint").alias("n_known"), F.lit(words.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
