"""What to do with an old result: keep, truncate or drop.

A reading is a judge's answer about one result: choice, map of probabilities,
confidence, map of signals, and whether it saw an excerpt only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shell
from ..functions import text as X


@dataclass(frozen=True)
class Thresholds:
    drop: float = 0.7
    confidence: float = 0.5
    veto: float = 0.5
    noise: float = 0.7


@dataclass(frozen=True)
class Guard:
    drop: float = 0.8
    confidence: float = 0.7
    needed: float = 0.5
    user: float = 0.5
    durable: float = 0.8


def _of(column: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(0.0))


def probability(label: str) -> Column:
    return _of("probabilities", label)


def signal(name: str) -> Column:
    return _of("signals", name)


def keep_or_truncate() -> Column:
    return F.when(probability("TRUNCATE") > probability("KEEP"), "TRUNCATE").otherwise("KEEP")


def raw() -> Column:
    return F.col("choice")


def safe(t: Thresholds = Thresholds()) -> Column:
    """Uncertain results stay; a drop must be likely and confident."""
    sure = (probability("DROP") >= t.drop) & (F.col("confidence") >= t.confidence)
    return F.when(F.col("choice") == "UNCERTAIN", "KEEP").when(F.col("choice") != "DROP", F.col("choice")).when(sure, "DROP").otherwise(keep_or_truncate())


def composite(t: Thresholds = Thresholds()) -> Column:
    """safe, then signals protect from dropping, and long noise is truncated."""
    base = safe(t)
    wanted = (signal("needed_now") >= t.veto) | (signal("user_requested") >= t.veto)
    lasting = (signal("durable") >= t.veto) | ((signal("unique_fact") >= t.veto) & (signal("superseded") < 0.5))
    noisy = F.col("excerpted") & (signal("mostly_noise") >= t.noise)
    dropped = F.when(wanted, F.when(F.col("excerpted"), "TRUNCATE").otherwise("KEEP")).when(lasting, "TRUNCATE").otherwise("DROP")
    return F.when(base == "DROP", dropped).when((base == "KEEP") & noisy, "TRUNCATE").otherwise(base)


def guarded(t: Guard = Guard()) -> Column:
    unsure = (probability("DROP") < t.drop) | (F.col("confidence") < t.confidence)
    wanted = (signal("needed_now") >= t.needed) | (signal("user_requested") >= t.user)
    return (
        F.when(F.col("choice") == "UNCERTAIN", "KEEP").when(F.col("choice") != "DROP", F.col("choice"))
        .when(unsure | wanted, keep_or_truncate()).when(signal("durable") >= t.durable, "TRUNCATE").otherwise("DROP")
    )


def hybrid(t: Guard = Guard()) -> Column:
    """Needs the source facts too: durable, superseded, exact_repeat. A null choice is a missing reading."""
    g = guarded(t)
    return F.when(F.col("exact_repeat"), "DROP").when(F.col("choice").isNull(), "KEEP").when((g == "DROP") & F.col("durable") & ~F.col("superseded"), "TRUNCATE").otherwise(g)


def source_facts(events: DataFrame) -> DataFrame:
    """events (result of tool_events) with key, durable, superseded and exact_repeat.

    Later results of the same key and tool are looked for by the last position
    of the key, and of the key with this output: two windows, no self join.
    """
    path, command = X.arg(F.col("args"), "path"), F.trim(F.coalesce(X.arg(F.col("args"), "command"), F.lit("")))
    keyed = events.withColumns({"key": X.related_key(F.col("tool"), F.col("args")), "digest": F.sha2("text", 256)})
    by_key = W.partitionBy("session", "tool", "key")
    by_text = W.partitionBy("session", "tool", "key", "digest", "is_error")
    later = lambda w: F.col("key").isNotNull() & (F.max("seq").over(w) > F.col("seq"))
    return keyed.withColumns({
        "superseded": later(by_key),
        "exact_repeat": later(by_text),
        "durable": shell.durable_source(F.coalesce(path, F.lit("")), command),
    }).drop("digest")


def rules(events: DataFrame, long_lines: int = 150) -> DataFrame:
    """events with rule: what plain rules decide without a judge.

    Navigation with five later calls, an error that later went right, a read
    read again and a command run again are dropped; long results truncated.
    """
    keyed = events.withColumn("key", X.related_key(F.col("tool"), F.col("args")))
    key = W.partitionBy("session", "key")
    known, seq = F.col("key").isNotNull(), F.col("seq")
    after = lambda c: known & (F.coalesce(F.max(F.when(c, seq)).over(key), F.lit(-1)) > seq)
    command = X.arg(F.col("args"), "command")
    left = F.max("seq").over(W.partitionBy("session")) - seq
    rule = (
        F.when(shell.navigation(F.col("tool"), command) & (left >= 5), "DROP")
        .when(F.col("is_error") & after(~F.col("is_error")), "DROP")
        .when((F.col("tool") == "read") & after(F.col("tool") == "read"), "DROP")
        .when((F.col("tool") == "bash") & ~F.col("is_error") & after(F.lit(True)), "DROP")
        .when(X.line_count(F.col("text")) > long_lines, "TRUNCATE")
        .otherwise("KEEP")
    )
    return keyed.withColumn("rule", rule)


def relations(events: DataFrame, last: int = 6) -> DataFrame:
    """For each result the last later ones of its key: session, seq, later_seq, relation, outcome.

    relation says by the tools what was done again; outcome says how the later result compares.
    """
    keyed = events.withColumn("key", X.related_key(F.col("tool"), F.col("args"))).filter("key is not null").select("session", "key", "seq", "tool", "is_error", F.sha2("text", 256).alias("d"))
    # the last few of a key serve all its results, so a join by key meets few rows
    newest = keyed.withColumn("place", F.row_number().over(W.partitionBy("session", "key").orderBy(F.desc("seq")))).filter(F.col("place") <= last)
    later = newest.select("session", "key", F.col("seq").alias("later_seq"), F.col("tool").alias("l_tool"), F.col("is_error").alias("l_error"), F.col("d").alias("l_d"))
    both = keyed.join(later, ["session", "key"]).filter("later_seq > seq")
    relation = (
        F.when(F.col("l_tool").isin("edit", "write"), "the same file was modified later")
        .when((F.col("tool") == "read") & (F.col("l_tool") == "read"), "the same file was read again later")
        .when(F.col("tool") == "bash", "the same command was run again later")
        .otherwise("the same lookup was repeated later")
    )
    outcome = F.when((F.col("d") == F.col("l_d")) & (F.col("is_error") == F.col("l_error")), "identical").when(F.col("tool") != F.col("l_tool"), "other tool").when(F.col("is_error") & ~F.col("l_error"), "now succeeds").when(~F.col("is_error") & F.col("l_error"), "now fails").otherwise("changed")
    return both.select("session", "seq", "later_seq", relation.alias("relation"), outcome.alias("outcome"))
