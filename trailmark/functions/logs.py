"""Lines of command output: failures, stack regions, blocks and chunks.

``line_flags`` and ``regions`` do it for exploded lines with windows. The
greedy splitters work on one output at a time, as Arrow functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .memo import Memo

# Patterns of failures, warnings, locations, summaries and stack traces, and block headings.
FAILURE = r"\b(?:ERROR|FAIL|FAILED|Traceback|panic|fatal)\b|(?:Error|Exception)\b|[✗×✕✖✘❌]"
WARNING = r"\b(?:WARN(?:ING)?)\b"
LOCATION = r"(?:^|\s)[^\s:]+:\d+(?::\d+)?\b"
SUMMARY = r"\b(?:tests?|test files?|checks?|files?|errors?|failures?|passed|failed)\s*[:=]?\s*\d+|\bexit\s+code\s*[:=]?\s*\d+"
STACK_START = r"\b(?:Traceback \(most recent call last\)|Caused by:|panic:|goroutine \d+\b|panicked at)\b"
STACK_FRAME = (
    r"""^\s*(?:at\s+\S+|File\s+["'][^"']+["'],\s+line\s+\d+|Caused by:|goroutine\s+\d+\b"""
    r"""|[\w$./<>-]+(?:\([^)]*\))?\s*\(?[^\s()]+:\d+(?::\d+)?(?:\s+\+0x[\da-f]+)?\)?)"""
)
CAUSED = r"^\s*Caused by:"
WHOLE_TRACE = r"Traceback \(most recent call last\):|\b(?:panic:|panicked at|goroutine \d+\b)"
HEADING = r"^(?:\s*(?:Test Files?|Tests?|Build|Lint|Summary|Results?)\b|\s*(?:FAIL|PASS|ERROR)\b)"
PASS_LINE = r"^\s*PASS\s+"
ERROR_WORD = r"\b(?:FAIL|ERROR|Error|FAILED)\b"
#: The patterns above that ignore case.
_ANY_CASE = "(?i)"
NEAR = 6


def line_flags(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with failure, warning, place, summary, frame, cont, start, seed, whole and blank."""
    x = F.col(line)
    any_case = lambda p: X.has(x, _ANY_CASE + p)
    # cheap tests first: a place has a colon, and so has a frame that does not begin with one of three words
    colon = x.contains(":")
    framed = F.when(colon | x.rlike(rf"(?i)^{X.WS}*(?:at|File|goroutine){X.WS}"), any_case(STACK_FRAME)).otherwise(F.lit(False))
    tested = lines.withColumns({
        "failure": any_case(FAILURE),
        "warning": any_case(WARNING),
        "place": F.when(colon, X.has(x, LOCATION)).otherwise(F.lit(False)),
        "summary": any_case(SUMMARY),
        "blank": X.blank(x),
        "_frame": framed,
        "_caused": F.when(colon, any_case(CAUSED)).otherwise(F.lit(False)),
        "whole": any_case(WHOLE_TRACE),
    })
    # what the patterns found is used here, so that none runs twice
    start = ~F.col("blank") & (F.col("_frame") | F.col("_caused"))
    return tested.withColumns({
        "start": start,
        "cont": start | (~F.col("blank") & x.rlike(rf"^{X.WS}")),
        "seed": F.col("failure") | F.col("_frame") | any_case(STACK_START),
    }).drop("_frame", "_caused")


def regions(lines: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """lines (one row each, numbered by n from 1 within keys) with flags and ``stack``: part of a stack trace.

    A seed reaches to the next blank line in a traceback or panic, else through
    the frames that follow it at once; a line is in a region if the furthest
    reach of the seeds up to it covers it.
    """
    flagged = line_flags(lines)
    order = W.partitionBy(*keys).orderBy(n)
    # from the end on: a frame that grows is summed up once, one that shrinks anew for every row
    after = W.partitionBy(*keys).orderBy(F.desc(n)).rowsBetween(W.unboundedPreceding, -1)
    far = F.lit(1 << 60)
    next_blank = F.coalesce(F.min(F.when(F.col("blank"), F.col(n))).over(after), far)
    next_other = F.coalesce(F.min(F.when(~F.col("cont"), F.col(n))).over(after), far)
    reach = F.when(F.col("whole"), next_blank - 1).when(F.lead("start").over(order), next_other - 1).otherwise(F.col(n))
    marked = flagged.withColumn("reach", reach)
    furthest = F.max(F.when(F.col("seed"), F.col("reach"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("stack", F.coalesce(furthest >= F.col(n), F.lit(False))).drop("reach")


def keep_reason(marked: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The result of ``regions`` with the first reason why a line must stay, null if none."""
    near = F.max(F.col("failure")).over(W.partitionBy(*keys).orderBy(n).rowsBetween(-NEAR, NEAR))
    rules = (("stack", "stack trace"), ("failure", "failure"), ("warning", "warning"), ("place", "diagnostic location"), ("summary", "summary"))
    reason = F.when(F.col("stack"), "stack trace")
    for flag, name in rules[1:]:
        reason = reason.when(F.col(flag), name)
    return marked.withColumn("reason", reason.when(near, "failure context"))


# ---------------------------------------------------------------- one output at a time

_I = re.IGNORECASE | re.ASCII


def _ecma(pattern: str, flags: int = re.ASCII) -> re.Pattern:
    """ECMAScript white space in an ASCII pattern."""
    inside = X.WS[1:-1]
    out = re.sub(r"\[\^\\s", lambda _: f"[^{inside}", pattern)
    out = out.replace(r"\S", f"[^{inside}]").replace(r"\s", f"[{inside}]")
    return re.compile(out, flags)


_FAILURE, _WARNING, _SUMMARY = (_ecma(p, _I) for p in (FAILURE, WARNING, SUMMARY))
_LOCATION, _PASS = _ecma(LOCATION), _ecma(PASS_LINE)
_START, _FRAME, _CAUSED, _WHOLE, _HEADING = (_ecma(p, _I) for p in (STACK_START, STACK_FRAME, CAUSED, WHOLE_TRACE, HEADING))
_BLANK = _ecma(r"\s*\Z")
_INDENT = _ecma(r"\s")


def u16(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


class Line(NamedTuple):
    """What the rules ask of a line by itself; soft: the reason to keep it that is neither a failure nor a stack trace."""

    units: int
    blank: bool
    heading: bool
    start: bool
    cont: bool
    seed: bool
    whole: bool
    failed: bool
    soft: str | None


def _line(x: str) -> Line:
    blank, frame, failed = bool(_BLANK.match(x)), bool(_FRAME.match(x)), bool(_FAILURE.search(x))
    start = not blank and (frame or bool(_CAUSED.match(x)))
    cont = start or (not blank and bool(_INDENT.match(x)))
    soft = next((name for p, name in ((_WARNING, "warning"), (_LOCATION, "diagnostic location"), (_SUMMARY, "summary")) if p.search(x)), None)
    return Line(u16(x), blank, bool(_HEADING.match(x)), start, cont, failed or frame or bool(_START.search(x)), bool(_WHOLE.search(x)), failed, soft)


#: Lines of logs come again and again: the patterns run once for each of late.
_LINES = Memo(_line)


def stack_lines(lines: list[str]) -> list[bool]:
    """``regions`` for the lines of one output."""
    return _stacked([_LINES[x] for x in lines])


def _stacked(lines: list[Line]) -> list[bool]:
    n = len(lines)
    next_blank, next_other = [n] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        next_blank[i] = i if lines[i].blank else next_blank[i + 1]
        next_other[i] = next_other[i + 1] if lines[i].cont else i
    out, furthest = [], -1
    for i, x in enumerate(lines):
        if x.seed:
            if x.whole:
                reach = next_blank[i + 1] - 1
            elif i + 1 < n and lines[i + 1].start:
                reach = next_other[i + 1] - 1
            else:
                reach = i
            furthest = max(furthest, reach)
        out.append(furthest >= i)
    return out


def reasons(lines: list[str]) -> list[str | None]:
    """``keep_reason`` for the lines of one output."""
    return _reasons([_LINES[x] for x in lines])


def _reasons(lines: list[Line]) -> list[str | None]:
    stack = _stacked(lines)
    upto = [0]
    for x in lines:
        upto.append(upto[-1] + x.failed)
    out: list[str | None] = []
    for i, x in enumerate(lines):
        near = upto[min(len(lines), i + NEAR + 1)] > upto[max(0, i - NEAR)]
        out.append("stack trace" if stack[i] else "failure" if x.failed else x.soft or ("failure context" if near else None))
    return out


def _last_true(flags: list[bool]) -> list[int]:
    """At i the last place up to i where a flag is set, -1 if none."""
    out, last = [], -1
    for i, f in enumerate(flags):
        last = i if f else last
        out.append(last)
    return out


def split_blocks(text: str, block_units: int = 1500, max_blocks: int = 64) -> list[dict] | None:
    """Blocks of at most block_units: as many lines as fit, cut back to the last blank line or heading in them.

    The cutting line opens the next block. A longer line is a block by itself
    and incomplete. None if there are more than max_blocks.
    """
    lines = text.split("\n")
    known = [_LINES[x] for x in lines]
    spans = _block_spans(known, block_units, max_blocks)
    if spans is None:
        return None
    why = _reasons(known)
    out: list[dict] = []
    for at, end, complete in spans:
        own = [w for w in why[at:end] if w]
        body = "\n".join(lines[at:end])
        out.append({"id": f"b{len(out) + 1}", "from": at + 1, "to": end, "text": body, "complete": complete, "hard": bool(own), "reason": own[0] if own else None})
    return out


def block_spans(lines: list[str], block_units: int = 1500, max_blocks: int = 64) -> list[tuple[int, int, bool]] | None:
    """The first line, the line behind the last one, and whether it is complete, of each of the blocks of ``split_blocks``."""
    return _block_spans([_LINES[x] for x in lines], block_units, max_blocks)


def _block_spans(lines: list[Line], block_units: int, max_blocks: int) -> list[tuple[int, int, bool]] | None:
    ends = [0]
    for x in lines:
        ends.append(ends[-1] + x.units + 1)
    cut = _last_true([x.blank or x.heading for x in lines])
    out: list[tuple[int, int, bool]] = []
    at = 0
    while at < len(lines):
        end = bisect_right(ends, ends[at] + block_units + 1) - 1
        complete = end > at
        end = max(end, at + 1)
        if end < len(lines) and cut[end - 1] > at:
            end = cut[end - 1]
        if len(out) == max_blocks:
            return None
        out.append((at, end, complete))
        at = end
    return out


CHUNK, HALF = 24, 12


def chunks(text: str) -> list[dict]:
    """Chunks of 24 lines that close at the first blank line from the twelfth on and never inside a stack trace.

    The boundary rule follows a published chunker under the MIT licence (see NOTICE).
    """
    lines = text.split("\n")
    known = [_LINES[x] for x in lines]
    stack = _stacked(known)
    n = len(lines)
    next_blank = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        next_blank[i] = i if known[i].blank else next_blank[i + 1]
    out, at = [], 0
    while at < n:
        end = min(n, at + CHUNK)
        half = at + HALF - 1
        if half < end and next_blank[half] < end:
            end = next_blank[half] + 1
        while end < n and stack[end] and stack[end - 1]:
            end += 1
        out.append({"from": at + 1, "to": end, "text": "\n".join(lines[at:end])})
        at = end
    return out


BLOCKS = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("complete", T.BooleanType()), T.StructField("hard", T.BooleanType()), T.StructField("reason", T.StringType()),
]))
CHUNKS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("text", T.StringType())]))


_BLOCKS_OF = Memo(split_blocks)


@F.pandas_udf(BLOCKS)
def blocks_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _BLOCKS_OF[t or ""])


@F.pandas_udf(CHUNKS)
def chunks_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: chunks(t or ""))


def pass_only(text: Column) -> Column:
    """Every line is blank or a passed test."""
    return F.forall(X.pieces(text), lambda x: X.blank(x) | x.rlike(PASS_LINE))


def notable_lines(lines: DataFrame, keys: list[str], most: int, n: str = "n", line: str = "line") -> DataFrame:
    """The most notable lines of each output, in file order: keys, n, text, priority.

    Lines that differ only in numbers count twice at most; failures go before
    warnings where there are too many.
    """
    t = X.trim(F.col(line))
    found = lines.withColumn("t", t).filter(X.has(F.col("t"), X.NOTABLE)).withColumn("shape", X.shape(F.col("t")))
    twice = found.withColumn("again", F.row_number().over(W.partitionBy(*keys, "shape").orderBy(n))).filter("again <= 2")
    cut = twice.withColumn("text", X.truncate(F.col("t"), 200)).withColumn("priority", X.line_priority(F.col("text")))
    ranked = cut.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("priority"), n)))
    return ranked.filter(F.col("rank") <= most).select(*keys, n, "text", "priority")
