"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the bag of its five-word shingles (of all its words if it has fewer).
A shingle weighs its count in the text times the mean inverse document
frequency of its words, counted over all documents in 65,536 hashed buckets: a
table of fixed size. Ioffe's sampling gives two texts equal samples with the
probability of their weighted Jaccard similarity. ``ROWS`` samples make a band
and texts that agree in any of ``BANDS`` bands meet: 0.41 of the bands on
average at similarity 0.8, so 3 in 100,000 pairs just at the threshold meet in
none, and at 0.9 one in 10 ** 9.

What meets is verified by its exact weighted Jaccard similarity:

1. Equal texts are one text from the start.
2. In every band group each text is compared with the group's least one. The
   groups are spread by salts, so a group of any size is many small tasks.
3. Links are joined to components. In a group that still holds several, every
   text outside the least one's component is compared with all other texts of
   the group, in blocks of bounded size, and only a first link to each other
   component is kept. So no two similar texts that met stay apart, and no list
   of a group's pairs exists.

Null text counts as empty. Texts without words have no shingles and match only
equal texts. Rows with null or equal ids are separate rows; a class takes its
least non-null id as its number. Texts are told apart by 128 bits of hashes.
Very long texts are bags like others; extra columns are ignored, or kept by
``deduplicated``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import small_batches, written
from .textcore import BYTE_KEY, U64, Slice, mix, prefix_hash, signed, slices, span_hash

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Hash buckets of word frequencies, by bits.
IDF_BITS = 16
#: Texts of a salt or block: what a task holds of one group at once.
CROWD = 256
_POOL = 16
_ID_BITS = 44  # bits of a shingle's number

_rng = np.random.Generator(np.random.PCG64(97))
_R = (-np.log(_rng.random(1 << _POOL)) - np.log(_rng.random(1 << _POOL))).astype(np.float32)
_BETA = _rng.random(1 << _POOL).astype(np.float32)
_LN_C = np.log(-np.log(_rng.random(1 << _POOL)) - np.log(_rng.random(1 << _POOL))).astype(np.float32)
_ODD = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)


def _words(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    start, end, owner = piece.words()
    return span_hash(prefix_hash(BYTE_KEY[piece.data]), start, end), owner


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each bucket, and the number of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for piece in slices(batch.column(0)):
                words, owner = _words(piece)
                pairs = np.unique((owner.astype(np.uint64) << U64(IDF_BITS)) | (words >> U64(64 - IDF_BITS)))
                seen += np.bincount((pairs & U64((1 << IDF_BITS) - 1)).astype(np.int64), minlength=1 << IDF_BITS)
        spot = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(spot, -1)), pa.array(np.append(seen[spot], n))], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 65,537 rows at most
    out, total = np.zeros(1 << IDF_BITS, np.int64), 0
    for bucket, n in zip(sums.column("bucket").to_pylist(), sums.column("n").to_pylist(), strict=True):
        if bucket < 0:
            total = n
        else:
            out[bucket] = n
    return out, total


def inverse(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log(1 + n / (1 + frequencies)).astype(np.float32)


class Bags:
    """The weighted shingles of a slice's texts: text i has ids[at[i]:at[i + 1]], ascending, and their weights."""

    def __init__(self, piece: Slice, idf: np.ndarray):
        words, owner = _words(piece)
        n = len(piece)
        value = idf[(words >> U64(64 - IDF_BITS)).astype(np.int64)]
        count = np.bincount(owner, minlength=n)
        # windows end with the text; a short text has one window of all its words
        first = np.cumsum(count) - count
        short = (count > 0) & (count < WORDS)
        many = len(words) - WORDS + 1
        at = np.flatnonzero(owner[:many] == owner[WORDS - 1 :]) if many > 0 else np.zeros(0, np.int64)
        key, weight = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32)
        for j in range(WORDS):
            key = (key ^ words[at + j]) * U64(0x9E3779B97F4A7C15)
            key ^= key >> U64(31)
            weight += value[at + j]
        weight /= WORDS
        row = owner[at]
        if short.any():
            extra, heavy = [], []
            for i in np.flatnonzero(short):
                own = slice(first[i], first[i] + count[i])
                folded = U64(0)
                for w in words[own]:
                    folded = mix(np.array([folded ^ w], np.uint64))[0]
                extra.append(folded)
                heavy.append(value[own].mean())
            row = np.concatenate([row, np.flatnonzero(short)])
            key = np.concatenate([key, np.array(extra, np.uint64)])
            weight = np.concatenate([weight, np.array(heavy, np.float32)])
        ids = mix(key) >> U64(64 - _ID_BITS)
        both = (row.astype(np.uint64) << U64(_ID_BITS)) | ids
        order = np.argsort(both)
        both = both[order]
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(both)))
        self.ids = both[new] & U64((1 << _ID_BITS) - 1)
        self.weights = weight[order][new] * tf.astype(np.float32)
        self.at = np.searchsorted(both[new] >> U64(_ID_BITS), np.arange(n + 1, dtype=np.uint64))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.at[i], self.at[i + 1])
        return self.ids[own], self.weights[own]


def samples(bags: Bags) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their consistent weighted samples, one column each."""
    full = np.flatnonzero(np.diff(bags.at))
    out = np.zeros((len(full), BANDS * ROWS), np.uint64)
    if not len(full):
        return full, out
    start = bags.at[full]
    size = bags.at[full + 1] - start
    # rounded, so that the last bit of a logarithm never moves a sample
    ln_w = np.round(np.log(bags.weights.astype(np.float64)), 4).astype(np.float32)
    for k, odd in enumerate(_ODD):
        pick = ((bags.ids * odd) >> U64(64 - _POOL)).astype(np.int64)
        r, beta = _R[pick], _BETA[pick]
        t = np.floor(ln_w / r + beta)
        ln_a = _LN_C[pick] - r * (t - beta + 1)
        least = np.minimum.reduceat(ln_a, start)
        at = np.flatnonzero(ln_a == np.repeat(least, size))
        at = at[np.searchsorted(at, start)]
        out[:, k] = mix(bags.ids[at] ^ mix(t[at].astype(np.int64).view(np.uint64) + U64(k << 32)))
    return full, out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / total if total > 0 else 0.0


def band_rows(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """band, node: a row a band for each text of docs (node, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for piece in slices(batch.column(1)):
                full, found = samples(Bags(piece, idf))
                bands = []
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = mix(key * U64(3) ^ found[:, k])
                    bands.append(key)
                if len(full):
                    yield pa.record_batch([pa.array(signed(np.concatenate(bands))), pa.array(np.tile(node[piece.lo + full], BANDS))], ["band", "node"])

    return docs.select("node", "text").mapInArrow(rows, "band bigint, node bigint")


def _groups(bands: DataFrame) -> DataFrame:
    """band, node, least, crowd: the members of every group of two texts or more; of groups with the same members one."""
    own = F.xxhash64("node")
    several = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("crowd")).filter("least <> most").drop("most")
    members = written(bands.join(several, "band").distinct(), "band-members")
    marks = members.groupBy("band").agg(F.min("least").alias("least"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 8)).alias("s"), F.count(F.lit(1)).alias("crowd"))
    one = marks.groupBy("least", "x", "s", "crowd").agg(F.min("band").alias("band"))
    return members.drop("least", "crowd").join(one.select("band", "least", "crowd"), "band")


def _star_links(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """a, b: pairs (least, node) that are similar. texts: node, text."""
    crowd = pairs.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("salts"))
    salted = pairs.join(crowd, "least").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    members = salted.join(texts, "node").select("least", "salt", F.lit(1).alias("role"), "node", "text")
    heads = crowd.select("least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "least"), "least")
    heads = heads.select("least", "salt", F.lit(0).alias("role"), F.col("least").alias("node"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = None
        for batch in batches:
            least, salt, role, node = (batch.column(c).to_pylist() for c in ("least", "salt", "role", "node"))
            found: list[tuple[int, int]] = []
            for piece in slices(batch.column("text")):
                bags = Bags(piece, idf)
                for i in range(len(piece)):
                    j = piece.lo + i
                    if role[j] == 0:
                        key, head = (least[j], salt[j]), bags.of(i)
                    elif key == (least[j], salt[j]) and weighted_jaccard(head, bags.of(i)) >= similarity:
                        found.append((node[j], least[j]))
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    together = heads.unionByName(members).repartition("least", "salt").sortWithinPartitions("least", "salt", "role", "node")
    return together.mapInArrow(rows, "a bigint, b bigint")


def _cross_links(rest: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """a, b: links between components in groups that hold several.

    rest: band, node, root, asks (outside the least one's component). Those that
    ask and those that answer meet in blocks; both are dealt by hash.
    """
    counts = rest.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("t"), F.greatest(F.ceil(F.count_if("asks") / CROWD), F.lit(1)).cast("int").alias("q"))
    dealt = rest.join(counts, "band").join(texts, "node")
    at = lambda n: F.pmod(F.xxhash64(F.lit(n), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.filter("asks").select("band", at("q").alias("qb"), every("t").alias("tb"), F.lit(1).alias("role"), "node", "root", "text")
    answering = dealt.select("band", every("q").alias("qb"), at("t").alias("tb"), F.lit(0).alias("role"), "node", "root", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "qb", "tb")), strict=True))
            role, node, root = (batch.column(c).to_pylist() for c in ("role", "node", "root"))
            for piece in slices(batch.column("text")):
                bags = Bags(piece, idf)
                for i in range(len(piece)):
                    j = piece.lo + i
                    if keys[j] != key:
                        yield _block_links(block, similarity)
                        key, block = keys[j], []
                    block.append((role[j], node[j], root[j], *(x.copy() for x in bags.of(i))))
        yield _block_links(block, similarity)

    return asking.unionByName(answering).repartition("band", "qb", "tb").sortWithinPartitions("band", "qb", "tb", "role", "node").mapInArrow(rows, "a bigint, b bigint")


def _block_links(block: list[tuple], similarity: float) -> pa.RecordBatch:
    """For each asking text a link to the first similar text of every other component in the block."""
    found: list[tuple[int, int]] = []
    targets, queries = [x for x in block if x[0] == 0], [x for x in block if x[0] == 1]
    if targets and queries:
        size = np.array([len(x[3]) for x in targets])
        at = np.concatenate([[0], np.cumsum(size)])
        known, where = np.unique(np.concatenate([x[3] for x in targets]), return_inverse=True)
        weights = np.concatenate([x[4] for x in targets])
        total = np.add.reduceat(weights, at[:-1], dtype=np.float64)
        roots, nodes = np.array([x[2] for x in targets]), np.array([x[1] for x in targets])
        own = np.zeros(len(known), np.float32)
        for _, node, root, ids, heavy in queries:
            slot = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            hit = known[slot] == ids
            own[slot[hit]] = heavy[hit]
            both = np.add.reduceat(np.minimum(own[where], weights), at[:-1], dtype=np.float64)
            own[slot[hit]] = 0
            alike = (both >= similarity * (total + heavy.sum(dtype=np.float64) - both)) & (roots != root)
            for r in np.unique(roots[alike]):
                found.append((node, int(nodes[alike & (roots == r)].min())))
    return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs with a 64-bit number for each text, null counting as empty: different texts have different numbers.

    Texts with the same hash are told apart by a second one; all but those with its least value are numbered anew.
    """
    first, second = _hashes(F.coalesce("text", F.lit("")))
    marks = docs.select(first.alias("h"), second.alias("m")).groupBy("h").agg(F.min("m").alias("least"), F.max("m").alias("most"))
    clash = written(marks.filter("least <> most").select(F.col("h").alias("_h"), F.col("least").alias("_m")), "hash-clashes")
    if not clash.limit(1).count():
        return docs.withColumn(name, first)
    met = docs.withColumns({"_first": first, "_second": second}).join(clash, F.col("_first") == F.col("_h"), "left")
    own = F.when(F.col("_h").isNull() | (F.col("_second") == F.col("_m")), F.col("_first")).otherwise(F.xxhash64("_first", "_second"))
    return met.withColumn(name, own).select(*docs.columns, name)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (its text), root (of its class), class_id, class_size, n_links of every row of docs (doc_id, text, node if it has been numbered)."""
    named = docs if "node" in docs.columns else with_node(docs.select("doc_id", "text"), "node")
    named = small_batches(named).select("doc_id", "node", F.coalesce("text", F.lit("")).alias("text"))
    frequencies, n = document_frequencies(docs)
    idf = inverse(frequencies, n)
    bands = written(band_rows(named, idf), "bands")
    groups = written(_groups(bands), "band-groups")
    wanted = groups.select("node").distinct()
    texts = named.groupBy("node").agg(F.any_value("text").alias("text")).join(wanted, "node")
    texts = written(texts, "band-texts")
    pairs = groups.filter("node <> least").select("least", "node").distinct()
    links = written(_star_links(pairs, texts, idf, similarity), "links")
    roots = components(links)
    rooted = groups.join(roots.withColumnRenamed("root", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
    heads = rooted.filter("node = least").select("band", F.col("root").alias("head"))
    marked = rooted.join(heads, "band").withColumn("asks", F.col("root") != F.col("head"))
    several = marked.filter("asks").select("band").distinct()
    rest = written(marked.join(several, "band").select("band", "node", "root", "asks"), "band-rest")
    if rest.limit(1).count():
        links = written(links.unionByName(_cross_links(rest, texts, idf, similarity)).distinct(), "links")
        roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    found = written(roots.join(degree, "node", "left"), "roots")
    rows = written(named.select("doc_id", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    # written apart, so that the join below can split a large class
    sizes = written(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-sizes")
    return rows.join(sizes, "root").select("doc_id", "node", "root", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (its least id), class_size, n_links (verified ones that joined its text to others), kept (the class's first) of every row."""
    return classes(docs.select("doc_id", "text"), similarity).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))).drop("node", "root")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs (doc_id, text, other columns) of each class: the one with its least id, and of these its least text hash."""
    numbered = with_node(docs, "_text")
    rows = written(classes(numbered.select("doc_id", "text", F.col("_text").alias("node")), similarity).select("doc_id", "node", "root"), "classes")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.node").alias("_node"))
    same = rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    first = first.join(same, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_node") == F.col("node")), "left").select("_id", "_node", F.coalesce("_rows", F.lit(1)).alias("_rows"))
    met = numbered.join(first, F.col("_text") == F.col("_node"))
    met = met.filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    # rows that are equal in id and text stay one too
    single = met.filter("_rows = 1").select(docs.columns)
    return single.unionByName(met.filter("_rows > 1").dropDuplicates(["_node"]).select(docs.columns))
