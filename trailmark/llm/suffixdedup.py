"""Removal of repeated byte strings by sorting sampled suffixes.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed. Sorting all suffixes is not needed for that. In each window of
``length`` bytes one run of ``gram`` bytes, its anchor, is chosen by least
hash: a choice of the window's content alone, so that equal windows have equal
anchors at equal places. Anchors that occur once are dropped; about one
position in 137 is an anchor at all.

A window around an anchor is r bytes to its left and the rest to its right. So
the suffixes that start behind the anchors, and the reversed texts before them,
are sorted by the deep-shallow method: multikey quicksort down to a shallow
depth, then a blind trie for every group that is still equal. Equal strings are
merged before they move, and an anchor whose strings would fill more than a
task is dealt by ranges of them, so that any number of occurrences is many
tasks. The common prefixes of neighbours give the inner nodes of the two sorted
orders; ``resolve`` carries them over the borders of the ranges. Two occurrences share a window where they share a
node on the left and one on the right whose depths add up to it, so every
occurrence has a few pairs of nodes instead of its windows, and the pairs that
others have too are the repeats.

Equal texts are read once, and are wholly repeated by themselves. Strings are
told apart by the hash of their anchor and one of their own, 64 bits each.

Null text counts as empty. Rows with null or equal ids are separate rows, equal
rows too. Texts shorter than ``length`` stay whole. An empty table gives an
empty result. Very long texts are read in overlapping parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import WORD, discard, small_batches, written
from .textcore import BYTE_KEY, U64, Slice, mix, powers, prefix_hash, signed, slices, span_hash

LENGTH, GRAM = 400, 128
#: Multikey quicksort compares so many bytes, eight at a time; smaller parts are sorted by insertion.
SHALLOW, SMALL = 64, 12
#: Strings of a range, which a task sorts at once, and strings that a task merges before they move.
RANGE, HELD = 1 << 15, 1 << 16
_WORD = re.compile(WORD.encode())
_PLACE = 24  # bits of a position; longer texts are read in overlapping parts


def keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


# ---------------------------------------------------------------- anchors


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def minimizers(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of length bytes in data its anchor's position, and the hashes of all runs of gram bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(BYTE_KEY[data])
    m = len(data) - gram + 1
    hashes = mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][:m])
    low = U64((1 << _PLACE) - 1)
    least = window_minima((hashes & ~low) | np.arange(m, dtype=np.uint64), length - gram + 1)
    return (least & low).astype(np.int64), hashes


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in data (ascending) and hashes of the anchors of all windows inside the texts."""
    least, hashes = minimizers(data, length, gram)
    if not len(least):
        return least, hashes
    edge = np.zeros(len(least) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    at = least[np.cumsum(edge[:-1]) > 0]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, hashes[at]


def _overlapping(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that share length - 1 bytes: every window lies in one."""
    most = 1 << (_PLACE - 1)
    for lo in range(0, max(len(data), 1), most):
        yield lo, data[lo : lo + most + length - 1]


def _parts(piece: Slice, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The slice whole, or one long text in parts: offset, data, starts, ends."""
    if len(piece.data) <= 1 << (_PLACE - 1):
        yield 0, piece.data, piece.starts, piece.ends
        return
    for lo, part in _overlapping(piece.data, length):  # a slice this long holds one text, and perhaps empty ones
        yield lo, part, np.array([0]), np.array([len(part)])


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """h, k1, k2, pos: every anchor of every text of texts (k1, k2, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for piece in slices(batch.column(2)):
                for offset, data, starts, ends in _parts(piece, length):
                    at, h = anchors(data, starts, ends, length, gram)
                    at = at + offset
                    if len(at):
                        owner = np.searchsorted(piece.ends, at, "right")
                        row = owner + piece.lo
                        yield pa.record_batch([pa.array(signed(h)), pa.array(k1[row]), pa.array(k2[row]), pa.array((at - piece.starts[owner]).astype(np.int32))], ["h", "k1", "k2", "pos"])

    return texts.mapInArrow(rows, "h bigint, k1 bigint, k2 bigint, pos int")


# ---------------------------------------------------------------- deep-shallow sorting


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the positions where they part; inner nodes hold no text.

    A node is [depth, children], a leaf a list of equal strings' numbers. The
    search for a string looks only at the bytes at the nodes' depths and ends at
    some leaf; one comparison with that leaf's string tells where the new string
    parts from the path.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:
            children = node[1]
            byte = s[node[0]] if node[0] < len(s) else -1
            node = children[byte] if byte in children else next(iter(children.values()))
        other = self.strings[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        parent, branch, node = None, 0, self.root
        while 0 <= node[0] < depth:
            parent, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = parent[1][branch]
        own = s[depth] if depth < len(s) else -1
        if node[0] == depth:
            node[1][own] = [-1, [i]]
            return
        split = [depth, {own: [-1, [i]], (other[depth] if depth < len(other) else -1): node}]
        if parent is None:
            self.root = split
        else:
            parent[1][branch] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            depth, below = stack.pop()
            if depth < 0:
                out += below
            else:
                stack += [below[k] for k in sorted(below, reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of the strings; equal ones stay in the order given."""
    words = SHALLOW // 8
    heads = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(len(strings), words).astype(np.uint64) if strings else np.zeros((0, words), np.uint64)
    out: list[int] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) <= 1:
            out += part.tolist()
        elif depth == words:
            trie = BlindTrie(strings)
            for i in part.tolist():
                trie.insert(i)
            out += trie.ordered()
        elif len(part) <= SMALL:
            # insertion up to the shallow depth, then the groups that are still equal
            rest = sorted((strings[i][:SHALLOW], i) for i in part.tolist())
            lo = 0
            while lo < len(rest):
                hi = lo + 1
                while hi < len(rest) and rest[hi][0] == rest[lo][0]:
                    hi += 1
                if hi - lo == 1:
                    out.append(rest[lo][1])
                else:
                    trie = BlindTrie(strings)
                    for _, i in rest[lo:hi]:
                        trie.insert(i)
                    out += trie.ordered()
                lo = hi
        else:
            column = heads[part, depth]
            pivot = np.partition(column, len(column) // 2)[len(column) // 2]
            less, more = column < pivot, column > pivot
            stack += [(part[more], depth), (part[~less & ~more], depth + 1), (part[less], depth)]
    return out


# ---------------------------------------------------------------- strings beside the anchors


def contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows from texts (k1, k2, text, spots).

    Places: h, k1, k2, pos of every anchor with the numbers of the reversed
    bytes before it (lid) and of the bytes behind it (rid) that its windows can
    reach. Strings (side 0: before, 1: behind): h, side, id, s, and n, how often;
    each once for about HELD of them in a task, so that a frequent one is merged here.
    """
    names = ["h", "k1", "k2", "pos", "lid", "rid", "side", "id", "s", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    reach = length - gram
    held: dict[tuple[int, int, int], list] = {}

    def strings() -> pa.RecordBatch:
        rows = [(h, side, i, s, n) for (h, side, i), (s, n) in held.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        made = {"h": columns[0], "side": columns[1], "id": columns[2], "s": columns[3], "n": columns[4]}
        held.clear()
        return pa.record_batch([pa.array(made[c], t) if c in made else pa.nulls(len(rows), t) for c, t in zip(names, types, strict=True)], names)

    for batch in batches:
        lists, k1, k2 = batch.column("spots"), batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        pos, h = flat.field("pos").to_numpy().astype(np.int64), flat.field("h").to_numpy()
        for piece in slices(batch.column("text")):
            own = slice(*np.searchsorted(row, [piece.lo, piece.hi]))
            of = row[own] - piece.lo
            at = piece.starts[of] + pos[own]
            prefix = prefix_hash(BYTE_KEY[piece.data])
            bounds = ((np.maximum(at - reach, piece.starts[of]), at), (at + gram, np.minimum(at + length, piece.ends[of])))
            ids = [signed(span_hash(prefix, lo, hi)) for lo, hi in bounds]
            none = [pa.nulls(len(at), t) for t in types[6:]]
            yield pa.record_batch([pa.array(h[own]), pa.array(k1[row[own]]), pa.array(k2[row[own]]), pa.array(pos[own].astype(np.int32)), pa.array(ids[0]), pa.array(ids[1]), *none], names)
            data = piece.data.tobytes()
            for side, (lo, hi) in enumerate(bounds):
                for key_h, key_id, a, b in zip(h[own].tolist(), ids[side].tolist(), lo.tolist(), hi.tolist(), strict=True):
                    met = held.get((key_h, side, key_id))
                    if met is None:
                        held[key_h, side, key_id] = [data[a:b][::-1] if side == 0 else data[a:b], 1]
                    else:
                        met[1] += 1
            if len(held) > HELD:
                yield strings()
    yield strings()


def nodes(shared: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """The inner nodes of a sorted order: depth, first string and parent (-1: none) of each; and each string's node.

    shared: common prefix of each string with its predecessor, -1 at the start of a group.
    """
    depth: list[int] = []
    first: list[int] = []
    parent: list[int] = []
    leaf: list[int] = []
    stack: list[int] = []
    now = -1
    for i, d in enumerate([*shared[1:].tolist(), -1] if len(shared) else []):
        held, low, last = stack[-1] if stack else -1, i, -1
        while stack and depth[stack[-1]] > d:
            top = stack.pop()
            if last >= 0:
                parent[last] = top
            low, last = first[top], top
        if d >= 0 and (not stack or depth[stack[-1]] < d):
            depth.append(d)
            first.append(low)
            parent.append(-1)
            stack.append(len(depth) - 1)
        if last >= 0 and d >= 0:
            parent[last] = stack[-1]
        leaf.append(stack[-1] if d >= now and d >= 0 else held if now >= 0 else -1)
        now = d
    return depth, first, parent, leaf


def ragged(row: np.ndarray, value: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Lists of the values of rows 0 to n - 1; row ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(value, kind))


PATHS = "h bigint, side int, id bigint, part int, size int, n bigint, before int, after int, depths array<int>, lows array<bigint>, first boolean, last boolean, s binary"


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of one range (h, side, id, s, n) in order, each once, with the nodes above it.

    depths, lows: a node's depth and the number of its first string in the range,
    from the shallowest on. before, after: the prefix shared with the first and
    the last string of the range, -1 in another group. These two carry their
    bytes, for the neighbouring ranges.
    """
    from pyspark import TaskContext

    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    part = TaskContext.get().partitionId()
    h, side, ids, s, n = (table.column(c).to_pylist() for c in ("h", "side", "id", "s", "n"))
    merged: dict[tuple[int, int, int], list[int]] = {}
    for i, key in enumerate(zip(h, side, ids, strict=True)):
        met = merged.setdefault(key, [i, 0])
        met[1] += n[i]
    found = list(merged.values())
    keyed = [(h[i] + (1 << 63)).to_bytes(8, "big") + bytes([side[i]]) + s[i] for i, _ in found]
    order = deep_shallow(keyed)
    head = 9
    shared = np.array([-1, *(common(keyed[a], keyed[b]) - head for a, b in pairwise(order))], np.int64)
    shared = np.maximum(shared, -1)
    rows = [found[i][0] for i in order]
    m = len(rows)
    depth, first, parent, leaf = (np.array(x, np.int64) for x in nodes(shared))
    number = np.array([ids[i] for i in rows], np.int64)
    of, at = np.arange(m), leaf.copy()
    climbed: list[tuple[np.ndarray, np.ndarray]] = []
    while len(of := of[at >= 0]):
        at = at[at >= 0]
        climbed.append((of, at))
        at = parent[at]
    size, many = np.array([len(s[i]) for i in rows], np.int64), np.array([found[i][1] for i in order], np.int64)
    # a string that occurs more than once is a node of its own
    own = np.flatnonzero((many > 1) & (np.append(depth, -1)[leaf] < size))
    of = np.concatenate([own, *(x for x, _ in climbed)])
    at_depth = np.concatenate([size[own], *(depth[x] for _, x in climbed)])
    low = np.concatenate([number[own], *(number[first[x]] for _, x in climbed)])
    by = np.lexsort((at_depth, of))
    of, at_depth, low = of[by], at_depth[by], low[by]
    before = np.minimum.accumulate(np.concatenate([size[:1], shared[1:]]))
    after = np.minimum.accumulate(np.concatenate([size[-1:], shared[:0:-1]]))[::-1]
    ends = [i in (0, m - 1) for i in range(m)]
    yield pa.record_batch(
        [
            pa.array([h[i] for i in rows], pa.int64()), pa.array([side[i] for i in rows], pa.int32()), pa.array(number), pa.array(np.full(m, part, np.int32)), pa.array(size.astype(np.int32)),
            pa.array(many), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)),
            ragged(of, at_depth.astype(np.int32), m, pa.int32()), ragged(of, low, m, pa.int64()),
            pa.array([i == 0 for i in range(m)]), pa.array([i == m - 1 for i in range(m)]), pa.array([s[i] if e else None for i, e in zip(rows, ends, strict=True)], pa.binary()),
        ],
        [x.split()[0] for x in PATHS.split(", ")],
    )


def _class(depths: list[int], lows: list[int], own: int, d: int) -> int:
    """The first string that shares d bytes with a string: its least node of depth d or more, else itself."""
    return next((low for depth, low in zip(depths, lows, strict=True) if depth >= d), own)


BORDERS = "h bigint, side int, part int, cut int, t_depths array<int>, t_lows array<bigint>, t_own bigint, x_left array<int>, x_right array<int>"


def resolve(group: pd.DataFrame) -> pd.DataFrame:
    """What the ranges that share a group (h, side) must know of each other.

    group: the first and last rows of the ranges. For every range: cut, the
    prefix that its first string shares with the string before it (-1: none);
    t_depths, t_lows, t_own: the nodes of that string, whose first strings hold
    up to the cut; x_left, x_right: the depths at which the first string parts
    from strings before it, and the last string from those behind it.
    """
    group = group.sort_values(["part", "last"])
    by_part = {}
    for r in group.to_dict("records"):
        ends = by_part.setdefault(r["part"], {})
        if r["first"]:
            ends["first"] = r
        if r["last"]:
            ends["last"] = r
    parts = sorted(by_part)
    out = {p: [int(group["h"].iloc[0]), int(group["side"].iloc[0]), p, -1, [], [], 0, [], []] for p in parts}
    cuts = [common(by_part[a]["last"]["s"], by_part[b]["first"]["s"]) for a, b in pairwise(parts)]
    # forwards: all nodes of the last string of each range so far
    known: tuple[list[int], list[int], int, int] | None = None
    for j, p in enumerate(parts):
        row = out[p]
        if known is not None:
            depths, lows, own, size = known
            cut = cuts[j - 1]
            row[3:7] = [cut, depths, lows, own]
            row[7] = sorted({min(cut, d) for d in [*depths, size]})
        if "last" in by_part[p]:
            last = by_part[p]["last"]
            at, low = completed(list(last["depths"]), list(last["lows"]), last["id"], last["before"], -1, row)
            known = (at, low, last["id"], last["size"])
    beyond: list[int] | None = None
    for j in range(len(parts) - 1, -1, -1):
        p = parts[j]
        if beyond is not None:
            out[p][8] = sorted({min(cuts[j], d) for d in beyond})
        if "first" in by_part[p]:
            first = by_part[p]["first"]
            beyond = sorted({*first["depths"], first["size"], *(min(first["after"], d) for d in out[p][8] if first["after"] >= 0)})
    return pd.DataFrame([out[p] for p in parts], columns=[x.split()[0] for x in BORDERS.split(", ")])


def completed(depths: list[int], lows: list[int], own: int, before: int, after: int, border: list) -> tuple[list[int], list[int]]:
    """A string's nodes over all ranges. border: a row of BORDERS."""
    cut, t_depths, t_lows, t_own, x_left, x_right = border[3:]
    every = set(depths)
    if before >= 0:
        every |= {min(before, x) for x in x_left}
    if after >= 0:
        every |= {min(after, x) for x in x_right}
    reach = min(before, cut)
    at = sorted(every)
    return at, [_class(t_depths, t_lows, t_own, d) if d <= reach else _class(depths, lows, own, d) for d in at]


def whole_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, side, id, depths, lows of strings with the nodes of all ranges."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("depths", "lows", "id", "before", "after", "cut", "t_depths", "t_lows", "t_own", "x_left", "x_right")]
        # a group inside one range has no border
        made = [x[:2] if x[5] is None else completed(*x[:5], [0, 0, 0, *x[5:]]) for x in zip(*columns, strict=True)]
        yield pa.record_batch([batch.column("h"), batch.column("side"), batch.column("id"), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.int64()))], ["h", "side", "id", "depths", "lows"])


def pairs(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """h, pair, lid, rid, low, high: the pairs of nodes of every context (h, lid, rid, n and both sides' nodes).

    A pair holds for the windows with low to high bytes before the anchor: all
    that share as many bytes before it and the rest behind it.
    """
    for batch in batches:
        row, depth, low = [], [], []
        for side in ("l", "r"):
            lists = batch.column(f"{side}_depths")
            row.append(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()))
            depth.append(lists.flatten().to_numpy().astype(np.int64))
            low.append(batch.column(f"{side}_lows").flatten().to_numpy())
        new = [np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool) for r in row]
        above = [np.where(f, -1, np.concatenate([[-1], d[:-1]])) if len(d) else d for f, d in zip(new, depth, strict=True)]
        wide = reach + 2
        # a node before the anchor holds from above + 1 bytes to its depth, one behind it for reach less as many
        starts = np.unique(np.concatenate([row[0] * wide + above[0] + 1, row[1] * wide + np.maximum(reach - depth[1], 0)]))
        of, r = starts // wide, starts % wide
        left = np.searchsorted(row[0] * wide + depth[0], starts)
        right = np.searchsorted(row[1] * wide + depth[1], of * wide + reach - r)
        ok = (left < len(row[0])) & (right < len(row[1])) & (r <= reach)
        of, r, left, right = of[ok], r[ok], left[ok], right[ok]
        ok = (row[0][left] == of) & (row[1][right] == of) if len(of) else np.zeros(0, bool)
        of, r, left, right = of[ok], r[ok], left[ok], right[ok]
        high = np.minimum(depth[0][left], reach - above[1][right] - 1)
        key = [(low[0][left], depth[0][left]), (low[1][right], depth[1][right])]
        pair = np.zeros(len(of), np.uint64)
        for number, d in key:
            pair = mix(mix(pair ^ number.view(np.uint64)) + d.astype(np.uint64))
        take = pa.array(of)
        yield pa.record_batch([batch.column("h").take(take), pa.array(signed(pair)), batch.column("lid").take(take), batch.column("rid").take(take), batch.column("n").take(take), pa.array(r.astype(np.int32)), pa.array(high.astype(np.int32))], ["h", "pair", "lid", "rid", "n", "low", "high"])


# ---------------------------------------------------------------- the operator


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept_text: bool = False, least_words: int = 0, in_range: int = RANGE) -> DataFrame:
    """Every row of docs (columns that include text) with n_bytes, spans, n_removed, n_spans and kept_sha256.

    spans: the maximal removed runs, as structs of from and to (exclusive).
    least_words: runs that touch fewer words stay. kept_text: the text is what is
    left of it, less bytes that no longer make a character. in_range: strings
    that one task sorts. Columns of docs with the name of a result are replaced.
    """
    raw = F.coalesce("text", F.lit(""))
    docs = small_batches(docs).drop("n_bytes", "spans", "n_removed", "n_spans", "kept_sha256", "_k1", "_k2", "_whole", "_kept")
    keyed = docs.withColumns({"_k1": keys(F.col("text"))[0], "_k2": keys(F.col("text"))[1], "n_bytes": F.octet_length(raw).cast("bigint")})
    long = keyed.filter(F.col("n_bytes") >= length).select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    texts = long.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    spans = covered(long, texts, length, gram, in_range).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("covered"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists, copies = batch.column("text"), batch.column("covered"), batch.column("copies").to_pylist()
            for start in range(0, batch.num_rows, 256):
                some = range(start, min(start + 256, batch.num_rows))
                made = [_settled(column[i].as_py().encode(), copies[i], lists[i].as_py(), kept_text, least_words) for i in some]
                columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.record_batch([batch.column("k1").slice(start, len(some)), batch.column("k2").slice(start, len(some)), *columns], ["_k1", "_k2", "spans", "n_removed", "kept_sha256", "_kept"])

    schema = "_k1 bigint, _k2 bigint, spans array<struct<from: int, to: int>>, n_removed bigint, kept_sha256 string, _kept string"
    settled = texts.join(spans, ["k1", "k2"], "left").filter("copies > 1 or covered is not null").mapInArrow(settle, schema)
    settled = settled.filter("n_removed > 0")
    whole = F.sha2(raw.cast("binary"), 256)
    columns = [c for c in docs.columns if c != "text"]
    left = keyed.withColumn("_whole", whole)
    left = left if kept_text else left.drop("text")
    joined = left.join(settled, ["_k1", "_k2"], "left")
    out = {
        "spans": F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>")),
        "n_removed": F.coalesce("n_removed", F.lit(0).cast("bigint")),
        "kept_sha256": F.coalesce("kept_sha256", "_whole"),
    }
    text = [F.when(F.col("n_removed") > 0, F.coalesce("_kept", F.lit(""))).otherwise(F.col("text")).alias("text")] * kept_text
    joined = joined.withColumns(out).withColumn("n_spans", F.size("spans").cast("bigint"))
    return joined.select(*columns, *text, "n_bytes", "spans", "n_removed", "n_spans", "kept_sha256")


def covered(long: DataFrame, texts: DataFrame, length: int, gram: int, in_range: int) -> DataFrame:
    """k1, k2, lo, hi: the bytes of texts that repeated windows cover around each anchor."""
    reach = length - gram
    found = written(anchor_rows(long, length, gram), "suffix-anchors")
    # anchors at two places at least: partial sums first, then a join that Spark splits where one is frequent
    place = F.xxhash64("k1", "k2", "pos")
    several = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("h")
    several = written(several, "suffix-several")  # apart from its grouping, so that the join below can split a frequent anchor
    spots = found.join(several, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "h")).alias("spots"))
    met = texts.join(spots, ["k1", "k2"])
    kinds = "h bigint, k1 bigint, k2 bigint, pos int, lid bigint, rid bigint, side int, id bigint, s binary, n bigint"
    near = written(met.mapInArrow(lambda batches: contexts(batches, length, gram), kinds), "suffix-contexts")
    discard(found, several)
    places = near.filter("side is null").select("h", "k1", "k2", "pos", "lid", "rid")
    strings = near.filter("side is not null").select("h", "side", "id", "s", "n")

    every = written(all_nodes(strings, in_range).filter(F.size("depths") > 0), "suffix-nodes")

    met = written(places.groupBy("h", "lid", "rid").agg(F.count(F.lit(1)).alias("n")), "suffix-pairs")
    sides = [every.filter(F.col("side") == k).select("h", F.col("id").alias(i), F.col("depths").alias(f"{p}_depths"), F.col("lows").alias(f"{p}_lows")) for k, i, p in ((0, "lid", "l"), (1, "rid", "r"))]
    deep = F.element_at("l_depths", -1) + F.element_at("r_depths", -1) >= reach
    both = met.join(sides[0], ["h", "lid"]).join(sides[1], ["h", "rid"]).filter(deep)
    held = written(both.mapInArrow(lambda batches: pairs(batches, reach), "h bigint, pair bigint, lid bigint, rid bigint, n bigint, low int, high int"), "suffix-held")
    discard(met, every)
    twice = written(held.groupBy("h", "pair").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "pair"), "suffix-twice")
    # all windows of an anchor share it, so what they cover is one run
    runs = held.join(twice, ["h", "pair"]).groupBy("h", "lid", "rid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    runs = written(runs, "suffix-runs")
    discard(held, twice)
    return places.join(runs, ["h", "lid", "rid"]).select("k1", "k2", (F.col("pos") - F.col("high")).alias("lo"), (F.col("pos") - F.col("low") + length).alias("hi"))


def all_nodes(strings: DataFrame, in_range: int) -> DataFrame:
    """h, side, id, depths, lows of the strings (h, side, id, s, n): the nodes above each in the order of its group."""
    sizes = strings.groupBy("h", "side").agg(F.count(F.lit(1)).alias("m"))
    sizes = written(sizes.groupBy((F.col("m") > in_range).alias("large"), F.when(F.col("m") > in_range, F.struct("h", "side")).alias("g")).agg(F.sum("m").alias("m")), "suffix-groups")
    count = {r["large"]: r["m"] for r in sizes.groupBy("large").agg(F.sum("m").alias("m")).collect()}
    # groups that fill more than a range: as many as there are ranges at most
    large = F.broadcast(sizes.filter("large").select("g.h", "g.side"))
    ranges = lambda n: -(-n // in_range)
    columns = ["h", "side", "id", "depths", "lows"]
    small = strings.join(large, ["h", "side"], "left_anti").repartition(max(1, ranges(count.get(False, 0))), "h", "side")
    small = small.mapInArrow(paths, PATHS).select(columns)
    if True not in count:
        return small
    cut = strings.join(large, ["h", "side"], "left_semi").repartitionByRange(ranges(count[True]) + 1, "h", "side", "s")
    above = written(cut.mapInArrow(paths, PATHS), "suffix-paths")
    # two rows of each range meet by their group: as many as there are ranges in it
    borders = above.filter(F.col("s").isNotNull()).groupBy("h", "side").applyInPandas(resolve, BORDERS)
    whole = above.drop("s", "first", "last").join(borders, ["h", "side", "part"], "left")
    return small.unionByName(whole.mapInArrow(whole_paths, "h bigint, side int, id bigint, depths array<int>, lows array<bigint>"))


def _settled(text: bytes, copies: int, covered: list[dict] | None, kept_text: bool, least_words: int) -> tuple:
    merged: list[list[int]] = []
    for c in [{"lo": 0, "hi": len(text)}] if copies > 1 else covered or []:
        if merged and c["lo"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], c["hi"])
        else:
            merged.append([c["lo"], c["hi"]])
    if least_words:
        merged = [m for m in merged if sum(1 for _ in _WORD.finditer(text, *m)) >= least_words]
    at, left = 0, []
    for lo, hi in merged:
        left.append(text[at:lo])
        at = hi
    kept = b"".join([*left, text[at:]])
    return [{"from": a, "to": b} for a, b in merged], len(text) - len(kept), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if kept_text else None
