"""Censuses over whole sessions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shell
from ..functions import text as X
from . import facts, sieve
from .events import tool_events, with_message

LONG = 3000


def _n(condition: F.Column, name: str) -> F.Column:
    return F.count_if(condition).alias(name)


def _t(condition: F.Column, name: str) -> F.Column:
    return F.coalesce(F.sum(F.when(condition, F.col("tok"))), F.lit(0)).cast("bigint").alias(name)


def results(messages: DataFrame) -> DataFrame:
    return tool_events(messages).withColumns({"tok": X.tokens(F.col("text")), "command": X.arg(F.col("args"), "command"), "path": X.arg(F.col("args"), "path"), "digest": F.sha2("text", 256)})


def marked_rereads(messages: DataFrame) -> DataFrame:
    """Results with again (same tool, arguments and output earlier) and, for reads, previous: same, changed or null."""
    twin = W.partitionBy("session", "tool", "args", "digest").orderBy("ord")
    path = W.partitionBy("session", "tool", F.coalesce("path", F.lit(""))).orderBy("ord")
    before = F.lag("digest").over(path)
    return results(messages).withColumns({
        "again": F.row_number().over(twin) > 1,
        "previous": F.when((F.col("tool") == "read") & before.isNotNull(), F.when(before == F.col("digest"), "same").otherwise("changed")),
    })


def reread_census(messages: DataFrame) -> DataFrame:
    """Per tool: results, repeats of all kinds, reads that match or differ from the previous read of the path."""
    every = F.lit(True)
    return marked_rereads(messages).groupBy("tool").agg(
        _n(every, "results"), _t(every, "tokens"), _n(F.col("again"), "repeats"), _t(F.col("again"), "repeat_tokens"),
        _n(F.col("previous") == "same", "same_reads"), _t(F.col("previous") == "same", "same_tokens"), _n(F.col("previous") == "changed", "changed_reads"), _t(F.col("previous") == "changed", "changed_tokens"),
    )


def session_census(messages: DataFrame) -> DataFrame:
    """Per tool: results, tokens, and those that a writing-time trim would consider."""
    found = results(messages).withColumn("eligible", shell.should_consider(F.col("tool"), F.col("command"), F.col("text")))
    return found.groupBy("tool").agg(_n(F.lit(True), "results"), _t(F.lit(True), "tokens"), _n(F.col("eligible"), "eligible"), _t(F.col("eligible"), "eligible_tokens"))


def role_tokens(messages: DataFrame) -> DataFrame:
    return messages.filter("kind <> 'call'").groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(X.tokens(F.col("text"))).alias("tokens"))


def repeated_line_tokens(text: F.Column) -> F.Column:
    """Tokens of lines that equal an earlier line of the text."""
    lines = X.pieces(text)
    all_ = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + X.tokens(x))
    once = F.aggregate(F.array_distinct(lines), F.lit(0).cast("bigint"), lambda a, x: a + X.tokens(x))
    return all_ - once


def output_profile(messages: DataFrame) -> DataFrame:
    """Per kind of output: count, tokens, long ones, errors, tokens of repeated lines, truncated and eligible ones."""
    found = results(messages).withColumns({
        "output": shell.profile_kind(F.col("tool"), F.col("command")),
        "rep": repeated_line_tokens(F.col("text")),
        "cut": X.has(F.col("text"), r"(?i)\[Showing |output truncated"),
        "fit": sieve.eligible(F.col("tool"), F.col("command"), F.col("text"), F.col("is_error")).isNotNull(),
    })
    return found.groupBy("output").agg(_n(F.lit(True), "n"), _t(F.lit(True), "tokens"), _n(F.col("tok") >= LONG, "long"), _n(F.col("is_error"), "errors"), F.sum("rep").cast("bigint").alias("repeated_line_tokens"), _n(F.col("cut"), "truncated"), _n(F.col("fit"), "eligible"))


def long_exclusions(messages: DataFrame) -> DataFrame:
    found = results(messages).filter((F.col("tool") == "bash") & (F.col("tok") >= LONG))
    return found.groupBy(shell.exclusion(F.coalesce("command", F.lit(""))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_inventory(messages: DataFrame) -> DataFrame:
    """Per kind of file: reads, long, unbounded and truncated ones, exact repeats of the latest read of the same place, also across requests.

    One session is one branch here; for trees, give the messages of a path.
    """
    limit = X.arg(F.col("args"), "limit")
    offset = F.coalesce(X.arg(F.col("args"), "offset"), F.lit("1"))
    found = results(messages).filter((F.col("tool") == "read") & ~F.col("is_error") & F.col("text_only") & F.col("path").isNotNull())
    place = W.partitionBy("session", "path", offset, F.coalesce(limit, F.lit(""))).orderBy("ord")
    found = found.withColumns({"prior": F.lag("digest").over(place), "prior_epoch": F.lag("epoch").over(place)})
    same = F.coalesce(F.col("prior") == F.col("digest"), F.lit(False))
    across = same & (F.col("prior_epoch") < F.col("epoch"))
    free = X.arg(F.col("args"), "offset").isNull() & limit.isNull()
    every, long = F.lit(True), F.col("tok") >= LONG
    return found.groupBy(shell.read_kind(F.col("path")).alias("kind")).agg(
        _n(every, "reads"), _t(every, "tokens"), _n(long, "long_reads"), _t(long, "long_tokens"), _n(same, "repeat_reads"), _t(same, "repeat_tokens"),
        _n(across, "cross_reads"), _t(across, "cross_tokens"), _n(free, "unbounded_reads"), _t(free, "unbounded_tokens"), _n(X.has(F.col("text"), r"(?i)\[Showing |output truncated"), "truncated"),
    )


def classifier_coverage(messages: DataFrame) -> DataFrame:
    """Earlier and present classifier over bash results."""
    found = results(messages).filter("tool = 'bash'").withColumns({"old": shell.old_kind(F.coalesce("command", F.lit(""))), "new": shell.kind_of(F.coalesce("command", F.lit("")))})
    old, new, long = F.col("old").isNotNull(), F.col("new").isNotNull(), F.col("tok") >= LONG
    return found.agg(_n(F.lit(True), "results"), _n(long, "long_results"), _n(old, "old_classified"), _n(new, "new_classified"), _n(new & ~old, "newly"), _n(new & ~old & long, "newly_long"), _n(old & ~new, "no_longer"))


def telemetry(log: DataFrame) -> DataFrame:
    """Per session: folded and shortened results, tokens saved, recalls. log: session, kind, acted, from, to."""
    acted = F.col("acted") & F.col("kind").isin("seen", "sieve")
    return log.groupBy("session").agg(
        _n((F.col("kind") == "seen") & F.col("acted"), "collapsed"), _n((F.col("kind") == "sieve") & F.col("acted"), "shortened"),
        F.coalesce(F.sum(F.when(acted, F.greatest(F.lit(0), F.col("from") - F.col("to")))), F.lit(0)).cast("bigint").alias("saved"),
        _n(F.col("kind") == "sieve", "evaluations"), _n(F.col("kind") == "recall", "recalls"),
    )


def would_save(decisions: DataFrame) -> DataFrame:
    """Per session: the latest decisions of its calls, and tokens that dropping and truncating by them would save. decisions: session, call_id, at, decision, tokens."""
    newest = decisions.groupBy("session", "call_id").agg(F.max_by(F.struct("decision", "tokens"), "at").alias("d")).select("session", "d.*")
    saved = F.when(F.col("decision") == "DROP", F.greatest(F.lit(0), F.col("tokens") - 40)).when(F.col("decision") == "TRUNCATE", F.greatest(F.lit(0), F.col("tokens") - 150)).otherwise(0)
    return newest.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), _n(F.col("decision") == "DROP", "drops"), _n(F.col("decision") == "TRUNCATE", "truncations"), F.sum(saved).cast("bigint").alias("would_save"))


def no_longer(messages: DataFrame) -> DataFrame:
    """Commands that only the earlier classifier knew: command, n, old_kind, reason."""
    old, new = shell.old_kind(F.coalesce("command", F.lit(""))), shell.kind_of(F.coalesce("command", F.lit("")))
    found = results(messages).filter("tool = 'bash'").groupBy("command").agg(F.count(F.lit(1)).alias("n")).withColumns({"old_kind": old, "kind": new})
    return found.filter("old_kind is not null and kind is null").select("command", "n", "old_kind", shell.no_longer_reason(F.col("command")).alias("reason"))


def changed_diffs(messages: DataFrame, contexts: tuple[int, ...] = (0, 3, 6)) -> DataFrame:
    """Per context size: reads that changed since the previous read of the path, their tokens, and what a clearly smaller diff would save."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def diff_tokens(before: pd.Series, after: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> list[int]:
            old, new = a.split("\n"), b.split("\n")
            return [-(-len("\n".join(difflib.unified_diff(old, new, n=c, lineterm=""))) // 4) for c in contexts]

        return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])

    path = W.partitionBy("session", "path").orderBy("ord")
    reads = results(messages).filter("tool = 'read' and path is not null and path <> ''").withColumn("before", F.lag("text").over(path))
    changed = reads.filter("before is not null and before <> text").withColumn("diffs", diff_tokens("before", "text"))
    each = changed.select("tok", F.posexplode("diffs").alias("i", "diff")).withColumn("context", F.element_at(F.array(*map(F.lit, contexts)), F.col("i") + 1))
    small = F.col("diff") < F.col("tok") * 0.5
    return each.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("tokens"), F.coalesce(F.sum(F.when(small, F.col("tok") - F.col("diff"))), F.lit(0)).alias("saved"), _n(~small, "kept_whole"))


def facts_used(messages: DataFrame, horizon: int = 80) -> DataFrame:
    """Per result: the facts that no earlier message of the session holds, and how many of them a later request, note or call used before another result gave them again.

    Facts meet messages by equality of extracted facts within the session; a
    fact inside a longer one does not count. Results without new facts are left out.
    """
    found = facts.uses(messages).filter(F.size("uses") > 0)
    used = facts.counted("uses", lambda u: facts.used_within(u, F.col("n"), horizon))
    return found.select("session", "ord", facts.counted("uses", lambda u: F.lit(True)).alias("new_facts"), used.alias("used_facts"))


def block_facts(messages: DataFrame, horizon: int = 80) -> DataFrame:
    """Per block of a command's output: the facts that neither another of its blocks nor an earlier message holds, and how many of them were used before another result gave them again."""
    found = facts.uses(messages, by_block=True).filter("blocks > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    own = lambda u: u["block"] == F.col("i")
    used = facts.counted("uses", lambda u: own(u) & facts.used_within(u, F.col("n"), horizon))
    return found.select("session", "ord", F.concat(F.lit("b"), F.col("i").cast("string")).alias("block"), facts.counted("uses", own).alias("own_facts"), used.alias("used_facts"))


def sole_sources(messages: DataFrame, horizon: int = 120, least: int = 150) -> DataFrame:
    """Per checkpoint and result before the request before it, of so many tokens: the facts no other message up to the checkpoint holds, and how many of them were used before another result gave them again."""
    at = W.partitionBy("session").orderBy("n")
    users = facts.numbered(messages).filter("kind = 'user'").select("session", "n", "ord").withColumns({"i": F.row_number().over(at) - 3, "previous": F.lag("n").over(at)}).filter("i >= 0")
    step = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(W.partitionBy("session")) / 8))
    points = users.withColumn("step", step).filter("i % step = 0").select("session", F.col("ord").alias("checkpoint"), F.col("n").alias("c_n"), "previous")  # 8 a session at most
    met = facts.uses(messages).filter(F.col("tokens") >= least).join(points, "session").filter("n < previous")
    # the only holder is the first one, and the next one comes after the checkpoint
    sole = lambda u: u["next_n"].isNull() | (u["next_n"] > F.col("c_n"))
    used = facts.counted("uses", lambda u: sole(u) & facts.used_within(u, F.col("c_n"), horizon))
    return met.select("session", "checkpoint", "ord", "tokens", facts.counted("uses", sole).alias("sole_facts"), used.alias("used_facts"))


def future_text(messages: DataFrame, horizon: int = 80) -> DataFrame:
    """Per result: what requests and the assistant say, and what calls ask, in the next messages: session, ord, future. Results say nothing."""
    part = F.when(F.col("kind") == "call", F.coalesce("args", F.lit("{}"))).when(F.col("kind") == "result", "").otherwise(F.coalesce("text", F.lit("")))
    parts = with_message(messages).groupBy("session", "msg").agg(F.max("ord").alias("ord"), F.max(F.col("kind") == "result").alias("is_result"), F.sort_array(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    said = parts.withColumn("said", F.array_join(F.transform("parts", lambda p: p["part"]), "\n")).drop("parts")
    ahead = W.partitionBy("session").orderBy("ord").rowsBetween(1, horizon)
    return said.withColumn("future", F.array_join(F.collect_list("said").over(ahead), "\n")).filter("is_result").select("session", "ord", "future")
