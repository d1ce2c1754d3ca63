"""Messages with their calls, epochs and running token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def part_units(kind: str = "kind") -> F.Column:
    """The length of what a row adds to its message; a call adds its arguments."""
    return F.when(F.col(kind) == "call", T.units(F.coalesce("args", F.lit("{}")))).otherwise(T.units(F.coalesce("text", F.lit(""))))


def with_message(messages: DataFrame) -> DataFrame:
    """messages with msg, the number of the message that a row is part of; without one each row is its own."""
    return messages if "msg" in messages.columns else messages.withColumn("msg", F.col("ord"))


def paired(messages: DataFrame) -> DataFrame:
    """Each result with the arguments of the latest earlier call of its id ({} if none).

    One window over calls and results together: a left outer as-of join in a
    single shuffle.
    """
    before = W.partitionBy("session", "call_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    call = F.last(F.when(F.col("kind") == "call", F.col("args")), ignorenulls=True).over(before)
    some = messages.filter(F.col("kind").isin("call", "result"))
    return some.withColumn("args", F.coalesce(call, F.lit("{}"))).filter("kind = 'result'")


def placed(messages: DataFrame) -> DataFrame:
    """All messages with epoch (user messages so far) and upto (tokens up to and including this row).

    A message's tokens are those of its parts joined by line feeds, rounded up
    once; a row adds what they grow by.
    """
    so_far = W.partitionBy("session").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    parts = W.partitionBy("session", "msg").orderBy("ord")
    rounded = lambda end: F.ceil((F.sum(F.col("_units") + 1).over(parts.rowsBetween(W.unboundedPreceding, end)) - 1) / 4)
    grown = with_message(messages).withColumn("_units", part_units()).withColumn("_grown", (rounded(0) - F.coalesce(rounded(-1), F.lit(0))).cast("bigint"))
    return grown.withColumns({
        "epoch": F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).over(so_far),
        "upto": F.sum("_grown").over(so_far),
    }).drop("_units", "_grown").select(*messages.columns, "epoch", "upto")


def tool_events(messages: DataFrame) -> DataFrame:
    """Results with call arguments, epoch, token position and ordinal among the session's results.

    Windows within the session one after the other: the texts are neither dealt
    anew for a join nor made twice.
    """
    so_far = W.partitionBy("session").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    seq = F.count_if(F.col("kind") == "result").over(so_far).cast("int") - 1
    return paired(placed(messages.filter("session is not null and ord is not null")).withColumn("seq", seq)).select(*messages.columns, "epoch", "upto", "seq")


def idle_gaps(messages: DataFrame, cold_s: int = 300, observed_s: int = 60) -> DataFrame:
    """Pauses between messages: session, ord, gap_s, cold."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    gap = second - F.lag(second).over(W.partitionBy("session").orderBy("ord"))
    return messages.withColumn("gap_s", gap).filter(F.col("gap_s") >= observed_s).select("session", "ord", "gap_s", (F.col("gap_s") >= cold_s).alias("cold"))


def visible(entries: DataFrame, cuts: tuple[str, ...], roles: tuple[str, ...]) -> DataFrame:
    """Entries after the session's last one that ends read evidence: a cut type, or a message of another role."""
    cut = F.col("type").isin(*cuts) | ((F.col("type") == "message") & ~F.coalesce(F.col("role").isin(*roles), F.lit(False)))
    last = F.max(F.when(cut, F.col("ord"))).over(W.partitionBy("session"))
    return entries.withColumn("_cut", last).filter(F.col("_cut").isNull() | (F.col("ord") > F.col("_cut"))).filter("type = 'message'").drop("_cut")
