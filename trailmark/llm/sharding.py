"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays together. Groups are sorted by
size, the largest first, and each enters the bin with the least remaining
capacity that still holds it, found in a balanced tree. With a fixed number of
bins the capacity is the least (by bisection) for which all groups find room;
with a fixed capacity, bins are opened as needed, which best fit keeps few. A
group larger than the capacity has a bin's capacity raised to its own size.

Every group is packed by its size. Groups of one size follow each other, and
the tightest bin stays the tightest while they enter it, so a size with its
count is one entry of the list that is packed: as many entries as there are
different sizes. Each group then finds its bin by its rank, in order of a hash,
among those of its size.

Null text counts as empty. Rows with null or equal ids are separate members of
their group. Very long texts are groups like others. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import running, text_key, written

#: Bytes that a row costs besides its text.
OVERHEAD = 16
#: The capacity is found to this share of a bin's even load.
EVEN = 1 / 20_000


class Tree:
    """(remaining, bin) in the order of a treap: a search tree that priorities keep balanced.

    Priorities are a hash of the bin, so that the tree, too, is the same in every run.
    A node is [key, priority, left, right].
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """The nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def _merged(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merged(low[3], high)
            return low
        high[2] = self._merged(low, high[2])
        return high

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        priority = ((key[1] + 1) * 0x9E3779B97F4A7C15 >> 7) & 0xFFFFFFFF
        self.root = self._merged(self._merged(low, [key, priority, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with room for size."""
        above, node, found, parent = None, self.root, None, None
        while node is not None:
            if node[0][0] >= size:
                found, parent, above, node = node, above, node, node[2]
            else:
                above, node = node, node[3]
        if found is None:
            return None
        rest = self._merged(found[2], found[3])
        if parent is None:
            self.root = rest
        else:
            parent[2 if parent[2] is found else 3] = rest
        return found[0]


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, how many) for classes of (size, count), largest size first; new bins are opened as needed.

    bins: None if this many do not suffice. A size over the capacity opens a bin of its own.
    """
    tree, out, opened = Tree(), [], 0
    for size, count in classes:
        while count:
            found = tree.take(size)
            if found is None:
                if bins is not None and opened == bins:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            many = min(count, found[0] // size)
            out.append((size, found[1], many))
            tree.add((found[0] - many * size, found[1]))
            count -= many
    return out


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best-fit-decreasing with the least capacity that needs no more than bins."""
    down = sorted(classes, reverse=True)
    total = sum(size * count for size, count in down)
    if not total:
        return []
    step = max(1, int(total / bins * EVEN))
    # what is larger than an even share has a bin for itself: the even share of the rest is the least capacity
    low, left, rest = 0, bins, total
    for size, count in down:
        if left <= count or size * left <= rest:
            break
        left, rest = left - count, rest - size * count
    low = max(1, -(-rest // left))
    high, best = low, best_fit(down, low, bins)
    while best is None:
        low, high = high + 1, high + step
        step, best = step * 2, best_fit(down, high, bins)
    step = max(1, int(total / bins * EVEN))
    while high - low > step:
        middle = (low + high) // 2
        found = best_fit(down, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def shards(docs: DataFrame, bins: int = 40, seed: int = 5, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text).

    capacity: bytes of a shard, in place of the number of bins; as few shards as best fit needs.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("_key"),
    ), "shard-rows")
    groups = written(rows.groupBy("_key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "shard-groups")
    # an entry for each size of a group: text sizes times copies, far fewer than groups
    sizes = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).toArrow()
    weights, counts, n = (sizes.column(c).to_pylist() for c in ("weight", "groups", "n"))
    classes = list(zip(weights, counts, strict=True))
    packed = pack(classes, bins) if capacity is None else best_fit(sorted(classes, reverse=True), capacity)
    plan: dict[int, list[tuple[int, int]]] = {}
    for size, shard, many in packed:
        runs = plan.setdefault(size, [])
        runs.append((many + (runs[-1][0] if runs else 0), shard))
    entries = docs.sparkSession.createDataFrame([(size, runs) for size, runs in plan.items()], "weight bigint, runs array<struct<upto: bigint, shard: int>>")
    ranked = running(groups.withColumn("_order", F.xxhash64(F.lit(seed), "_key")), ["weight"], "_order", F.lit(1), "_rank", sum(counts))
    mine = F.filter("runs", lambda r: r["upto"] > F.col("_rank"))[0]["shard"]
    homes = written(ranked.join(entries, "weight").select("_key", mine.alias("shard")), "shard-homes")
    placed = rows.join(homes, "_key").withColumn("_order", F.xxhash64(F.lit(seed), "_key", "doc_id"))
    return running(placed, ["shard"], "_order", F.lit(1), "slot", sum(n)).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"))
