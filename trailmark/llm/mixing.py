"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through at
most ``repeats`` times. A document's virtual finish time is the number of words
its source has sent by its end, divided by the source's target; all
visits are range-sorted by these times, and the mix ends where the next document
would exceed the total budget.

Null text counts as empty, a null source is a source of its own (the last).
Documents without words are never taken. Repeated rows are separate documents.
Equal finish times are ordered by source, and inside a source by queue: hash,
id and the other columns. Very long texts count like any other; one that does
not fit ends the mix. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import WORD, running, written

#: Weights dealt to the sources in turn, the budget as a share of all words, and how often a document may come.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """A row per source: source_size, weight, target. sizes: source, size.

    Targets are in proportion to the weights, none above repeats times the
    source's size; what a source can't take is shared among the others by
    weight. That is the level L with sum(min(cap, L * weight)) = budget; with
    the sources ordered by cap / weight, the first k are full and L follows.
    One row per source is all that is ordered in one place.
    """
    every = W.orderBy(F.lit(1))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * float(repeats))
    by_fill = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    full = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    budget = F.sum("source_size").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share)
    per = per.withColumn("_level", (budget - full) / F.sum("weight").over(after))
    # the first source that the level leaves unfilled fixes it; no such source: all are full
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.struct(F.row_number().over(by_fill).alias("i"), F.col("_level").alias("level")))
    found = F.min(fits).over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.coalesce(F.least(F.col("_cap"), found["level"] * F.col("weight")), F.col("_cap"))
    return per.select("source", "source_size", "weight", target.alias("target"))


class Mix:
    """The queues of docs (doc_id, source, text) and the place where the mix ends.

    rows: doc_id, source, size, source_size, target, _sent (words of its queue
    before it) of every row, and the columns of also. end: time, source and _sent
    of the first visit beyond the budget; None: all visits fit.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float], share: float, repeats: int, seed: int, also: Sequence[Column], size: Column | None):
        self.repeats, self.also = repeats, [f"_also{i}" for i in range(len(also))]
        size = n_words(F.col("text")) if size is None else size
        named = [c.alias(n) for c, n in zip(also, self.also, strict=True)]
        sizes = written(docs.select("doc_id", "source", size.cast("bigint").alias("size"), *named), "mix-sizes")
        # the sources' plan is a row a source; Spark decides by its size whether to send it everywhere
        plan = written(targets(sizes, weights, share, repeats).drop("weight"), "mix-targets")
        budget = float(plan.agg(F.sum("target")).first()[0] or 0.0)
        shuffled = sizes.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "size", *self.also))
        queued = running(shuffled, ["source"], "_order", F.col("size"), "_sent", sizes.count())
        met = queued.alias("q").join(plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source")))
        self.rows = written(met.select("q.doc_id", "q.source", "q.size", "p.source_size", "p.target", "q._sent", *[f"q.{c}" for c in self.also]).withColumn("_sent", F.col("_sent").cast("bigint")), "mix-queues")
        self.end = self._end(budget)

    def finish(self) -> Column:
        """The virtual finish times of a row's visits; none where it is never served."""
        ends = F.array(*[F.col("_sent") + F.col("size") + F.col("source_size") * i for i in range(self.repeats)])
        times = F.transform(ends, lambda e: e.cast("double") / F.col("target"))
        return F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(F.array().cast("array<double>"))

    def within(self, t: Column) -> Column:
        """Whether a row's visit at time t comes before the end."""
        if self.end is None:
            return F.lit(True)
        time, source, sent = (F.lit(x) for x in self.end)
        # a null source comes last
        earlier = F.col("source").isNotNull() if self.end[1] is None else F.coalesce(F.col("source") < source, F.lit(False))
        return (t < time) | ((t == time) & (earlier | (F.col("source").eqNullSafe(source) & (F.col("_sent") < sent))))

    def _end(self, budget: float) -> tuple | None:
        """All visits range-sorted by time, source and queue; the one at which their running sum passes the budget.

        The ranges grow with the square root of the visits, and so do their
        number and the one range that is summed row by row.
        """
        visits = self.rows.select(F.explode(self.finish()).alias("t"), F.col("source").isNull().alias("last"), "source", "_sent", "size")
        order = ["t", "last", "source", "_sent"]
        n = self.repeats * self.rows.count()
        ranges = max(8, math.isqrt(n) // 8)
        ordered = written(visits.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-order")
        sums = ordered.groupBy("range").agg(F.sum("size").alias("words"))
        upto = sums.withColumn("upto", F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)))
        cut = upto.filter(F.col("upto") > budget).orderBy("range").first()
        if cut is None:
            return None
        inside = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        before = cut["upto"] - cut["words"]
        found = ordered.filter(F.col("range") == cut["range"]).withColumn("upto", F.sum("size").over(inside) + F.lit(before))
        end = found.filter(F.col("upto") > budget).orderBy(*order).select("t", "source", "_sent").first()
        return tuple(end)


def fair_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17, also: Sequence[Column] = (), size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken (times * size) of every row of docs.

    docs: doc_id, source, text; other columns are ignored. size: in place of the number of words.
    also: more columns, which come as _also0, _also1 and so on; rows that are equal in id and size queue by them.
    """
    mix = Mix(docs, weights, share, repeats, seed, also, size)
    times = F.size(F.filter(mix.finish(), mix.within)).cast("int")
    rows = mix.rows.withColumn("times", times)
    return rows.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("bigint").alias("taken"), *mix.also)


def served(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 17, size: Column | None = None) -> DataFrame:
    """The rows of docs (doc_id, source, text, other columns) as often as the mix takes them, in the order in which it does."""
    every = [F.col(c) for c in docs.columns]
    same = [F.xxhash64(F.lit(k), *every) for k in (1, 2)]  # rows that are equal in all columns stand for each other
    mix = Mix(docs, weights, share, repeats, seed, same, size)
    visits = mix.rows.select(*[F.col(c) for c in mix.also], F.col("source"), "_sent", F.explode(F.filter(mix.finish(), mix.within)).alias("_t"))
    visits = visits.select(F.col("_also0").alias("_k1"), F.col("_also1").alias("_k2"), F.struct("_t", F.col("source").isNull().alias("last"), "source", "_sent").alias("_turn"))
    own = docs.select(F.struct(*every).alias("_row"), same[0].alias("_k1"), same[1].alias("_k2")).groupBy("_k1", "_k2").agg(F.any_value("_row").alias("_row"))
    met = own.join(visits, ["_k1", "_k2"])
    ranges = max(8, math.isqrt(mix.rows.count()) // 8)
    return met.repartitionByRange(ranges, "_turn").sortWithinPartitions("_turn").select("_row.*")
