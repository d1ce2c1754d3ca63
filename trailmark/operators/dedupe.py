"""Folding of file lines that a reader has been shown before.

An arriving read is set against the newest earlier reads of the same path that
are still fresh: of the same request, within a token age, unfolded and without
error. Lines match at the same place in the file only. The first evidence with
a long enough run of matches decides.

Every join here carries the session and the path. Candidates are cut to the
newest few before any line is exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .events import placed, tool_events

# What folded results say; the tag's length counts in their tokens.
TAG = "[folded-context]"
RECALL = "context_recall"


@dataclass(frozen=True)
class Freshness:
    min_run: int = 30
    min_saved_share: float = 0.3
    min_lines: int = 60
    max_earlier: int = 4
    max_age: int = 12_000
    same_epoch: bool = True


DEFAULT = Freshness()


def reads(messages: DataFrame) -> DataFrame:
    """Reads without error and with a usable offset: their body, footer and first line."""
    found = tool_events(messages).filter((F.col("tool") == "read") & ~F.col("is_error") & F.col("text_only"))
    found = found.withColumns({"path": T.arg(F.col("args"), "path"), "first": T.read_offset(F.col("args"))})
    return found.filter("path is not null and first is not null").withColumns({"footer": T.footer(F.col("text")), "body": T.body(F.col("text"))})


def folded(text: F.Column) -> F.Column:
    return text.contains(f"{RECALL} with id") | text.startswith(TAG)


def evidence(found: DataFrame, cfg: Freshness = DEFAULT) -> DataFrame:
    """Pairs of a read and an earlier one that is evidence for it; rank 1 is the newest.

    found: the result of ``reads``. Age is the tokens after the earlier result up
    to the arriving one, the pending call included.
    """
    late = found.filter(F.size(T.pieces(F.col("body"))) >= cfg.min_lines).select("session", "path", "epoch", F.col("ord").alias("ord"), "call_id", (F.col("upto") - T.tokens(F.col("text"))).alias("before"))
    early = found.filter(~folded(F.col("text"))).select("session", "path", F.col("epoch").alias("e_epoch"), F.col("ord").alias("e_ord"), F.col("call_id").alias("e_call"), F.col("upto").alias("e_upto"))
    on = [F.col("late.session") == F.col("early.session"), F.col("late.path") == F.col("early.path"), F.col("e_ord") < F.col("ord"), F.col("before") - F.col("e_upto") <= cfg.max_age, F.col("call_id") != F.col("e_call")]
    if cfg.same_epoch:
        on.append(F.col("epoch") == F.col("e_epoch"))
    pairs = late.alias("late").join(early.alias("early"), on).select("late.session", "late.path", "ord", "e_ord", "e_call", (F.col("before") - F.col("e_upto")).alias("age"))
    newest = W.partitionBy("session", "ord").orderBy(F.desc("e_ord"))
    return pairs.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= cfg.max_earlier)


def matched_runs(found: DataFrame, pairs: DataFrame, min_run: int = DEFAULT.min_run) -> DataFrame:
    """Runs of at least min_run equal lines at equal places: session, ord, rank, e_ord, from, to (in the arriving text).

    The two texts of a pair are compared as arrays in place: no line is shuffled.
    """
    side = found.select("session", "ord", "first", "body")
    early = side.select("session", F.col("ord").alias("e_ord"), F.col("first").alias("e_first"), F.col("body").alias("e_body"))
    both = pairs.select("session", "ord", "rank", "e_ord").join(side, ["session", "ord"]).join(early, ["session", "e_ord"])
    both = both.withColumns({"lines": T.pieces(F.col("body")), "e_lines": T.pieces(F.col("e_body")), "shift": (F.col("first") - F.col("e_first")).cast("int")})
    # the earlier lines are moved to the places of the later ones, so both arrays are read once, side by side
    none = F.array_repeat(F.lit(None).cast("string"), F.greatest(-F.col("shift"), F.lit(0)))
    moved = F.concat(none, F.slice("e_lines", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("lines")))
    equal = both.select("session", "ord", "rank", "e_ord", F.zip_with("lines", moved, lambda x, y: F.coalesce(x == y, F.lit(False))).alias("same")).filter(F.exists("same", lambda x: x))
    edges = lambda beside: F.filter(F.transform(F.zip_with("same", beside, lambda x, y: x & ~F.coalesce(y, F.lit(False))), lambda x, i: F.when(x, i + 1)), lambda n: n.isNotNull())
    starts, ends = edges(F.concat(F.array(F.lit(False)), "same")), edges(F.slice("same", F.lit(2), F.size("same")))
    runs = equal.withColumn("run", F.explode(F.arrays_zip(starts.alias("from"), ends.alias("to"))))
    runs = runs.select("session", "ord", "rank", "e_ord", F.col("run.from").alias("from"), F.col("run.to").alias("to"))
    return runs.filter(F.col("to") - F.col("from") + 1 >= min_run)


def chosen_runs(runs: DataFrame) -> DataFrame:
    """Runs of the newest evidence that has any."""
    return runs.withColumn("best", F.min("rank").over(W.partitionBy("session", "ord"))).filter("rank = best").drop("best")


def collapse(found: DataFrame, runs: DataFrame, cfg: Freshness = DEFAULT, alias: F.Column | None = None) -> DataFrame:
    """Folded texts: session, ord, text, runs, folded_lines, total_lines, original_tokens, kept_tokens, worth.

    runs: the chosen runs. Arrays of one result's lines are folded in place, so
    no line is shuffled to render it.
    """
    per = runs.groupBy("session", "ord", "e_ord").agg(
        F.sort_array(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to")))).alias("runs"),
        F.sum(F.col("to") - F.col("from") + 1).cast("int").alias("folded_lines"),
    )
    source = found.select("session", F.col("ord").alias("e_ord"), F.col("call_id").alias("source"))
    full = per.join(source, ["session", "e_ord"]).join(found, ["session", "ord"])
    name = F.concat(F.lit("t"), (F.col("seq") + 1).cast("string")) if alias is None else alias
    full = full.withColumns({"lines": T.pieces(F.col("body")), "alias": name}).withColumn("total_lines", F.size("lines"))
    cover = lambda a, b: F.slice(F.col("lines"), a, F.greatest(b - a + 1, F.lit(0)))
    marker = lambda r: F.concat(
        F.lit("… [file lines "), (F.col("first") + r["from"] - 1).cast("string"), F.lit("-"), (F.col("first") + r["to"] - 1).cast("string"),
        F.lit(f' unchanged; {RECALL} with id "'), F.col("alias"), F.lit('"] …'),
    )
    start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get("runs", i - 1)["to"] + 1)
    kept = F.flatten(F.transform("runs", lambda r, i: F.concat(cover(start(i), r["from"] - 1), F.array(marker(r)))))
    tail = cover(F.element_at("runs", -1)["to"] + 1, F.col("total_lines"))
    hidden = F.array_join(F.transform("runs", lambda r: F.array_join(cover(r["from"], r["to"]), "\n")), "\n")
    last = (F.col("first") + F.col("total_lines") - 1).cast("string")
    header = F.concat(
        F.lit(f"{TAG} "), F.col("path"), F.lit(": file lines "), F.col("first").cast("string"), F.lit("-"), last, F.lit(". Folded "),
        F.col("folded_lines").cast("string"), F.lit("/"), F.col("total_lines").cast("string"), F.lit(" file lines matching read "), F.col("source"),
        F.lit(f' still in context. Full output: {RECALL} with id "'), F.col("alias"), F.lit('".'), T.reference_note(hidden),
        F.lit(f" Search original chunks with {RECALL} query."),
    )
    text = F.concat(F.array_join(F.concat(F.array(header), kept, tail), "\n"), F.col("footer"))
    full = full.withColumns({"out": text, "original_tokens": T.tokens(F.col("text"))}).withColumn("kept_tokens", T.tokens(F.col("out")))
    worth = F.col("kept_tokens") <= F.col("original_tokens") * (1 - cfg.min_saved_share)
    return full.select("session", "ord", "call_id", "alias", "source", "runs", "folded_lines", "total_lines", "original_tokens", "kept_tokens", worth.alias("worth"), F.col("out").alias("text"))


def plan(messages: DataFrame, cfg: Freshness = DEFAULT) -> DataFrame:
    """Folded texts of all reads that are worth it, each judged against the recorded context."""
    found = reads(messages)
    pairs = evidence(found, cfg)
    return collapse(found, chosen_runs(matched_runs(found, pairs, cfg.min_run)), cfg).filter("worth")


def savings(messages: DataFrame, cfg: Freshness = DEFAULT) -> DataFrame:
    """Per session: reads, read tokens, folded reads, tokens saved."""
    events = messages.filter("kind = 'result' and tool = 'read'").groupBy("session").agg(F.count(F.lit(1)).alias("reads"), F.sum(T.tokens(F.col("text"))).alias("read_tokens"))
    done = plan(messages, cfg).groupBy("session").agg(F.count(F.lit(1)).alias("collapsed"), F.sum(F.col("original_tokens") - F.col("kept_tokens")).alias("saved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return events.join(done, "session", "left").select("session", "reads", "read_tokens", zero("collapsed"), zero("saved"))


def cover(late: list[str], early: list[str], min_run: int) -> list[tuple[int, int, int]]:
    """Runs of late that stand together in early, blank lines like any other: from, to, first place in early.

    From the left, each place takes its longest run, if that is long enough, and
    goes on after it. Of equally long ones the first in early counts.
    """
    places: dict[str, list[int]] = {}
    for j, line in enumerate(early):
        places.setdefault(line, []).append(j)
    at = {line: np.array(found) for line, found in places.items()}
    best, where = np.zeros(len(late), np.int64), np.zeros(len(late), np.int64)
    after, none = np.zeros(len(early) + 1, np.int64), np.zeros(0, np.int64)
    set_ = none
    for i in range(len(late) - 1, -1, -1):
        found = at.get(late[i], none)
        lengths = 1 + after[found + 1]
        after[set_] = 0  # what the line below has set
        after[found], set_ = lengths, found
        if len(found):
            k = int(lengths.argmax())
            best[i], where[i] = lengths[k], found[k]
    runs, i = [], 0
    while i < len(late):
        if best[i] >= min_run:
            runs.append((i + 1, i + int(best[i]), int(where[i]) + 1))
            i += int(best[i])
        else:
            i += 1
    return runs


def content_runs(found: DataFrame, pairs: DataFrame, min_run: int = DEFAULT.min_run) -> DataFrame:
    """Runs of equal lines at any place (the archived rule): session, ord, rank, from, to, e_from.

    Blank lines match like others. The two texts of a pair are compared in one
    place, so common lines make no rows.
    """
    @F.pandas_udf("array<struct<from:int,to:int,e_from:int>>")
    def covered(late: pd.Series, early: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("from", "to", "e_from"), run, strict=True)) for run in cover(a.split("\n"), b.split("\n"), min_run)] for a, b in zip(late, early, strict=True)])

    early = found.select("session", F.col("ord").alias("e_ord"), F.col("body").alias("e_body"))
    both = pairs.select("session", "ord", "rank", "e_ord").join(found.select("session", "ord", "body"), ["session", "ord"]).join(early, ["session", "e_ord"])
    return both.select("session", "ord", "rank", F.explode(covered("body", "e_body")).alias("run")).select("session", "ord", "rank", "run.*")


def ages(messages: DataFrame) -> DataFrame:
    """Token position of every message."""
    return placed(messages).select("session", "ord", "kind", "epoch", "upto")
