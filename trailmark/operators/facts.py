"""Facts of a session: which result holds each first, and which message holds it next.

One pass over the session's messages in order, with the facts that are known so
far: no row for each fact is made, and no message meets another by a join.
Facts never hold white space, so those of a text are those of its lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import logs
from ..functions import text as X
from ..functions.memo import Memo

_FACT = re.compile(X.FACT, re.ASCII)


def _of_line(line: str) -> frozenset[str]:
    return frozenset(f for f in _FACT.findall(line) if 5 <= len(f) <= 120 and not f.startswith(("http", "node_modules")))


_LINE_FACTS = Memo(_of_line)


def of_lines(lines: list[str]) -> frozenset[str]:
    """``text.facts`` of the joined lines, as a set."""
    return frozenset().union(*(_LINE_FACTS[x] for x in set(lines)))


def of_text(text: str) -> frozenset[str]:
    return of_lines(text.split("\n"))


def of_blocks(text: str) -> tuple[int, dict[str, int]]:
    """The number of the output's blocks (0: too many), and each fact that one block alone holds, with the number of that block."""
    lines = text.split("\n")
    spans = logs.block_spans(lines) or []
    alone: dict[str, int] = {}
    shared: set[str] = set()
    for i, (at, end, _) in enumerate(spans):
        for fact in of_lines(lines[at:end]):
            if fact in alone:
                shared.add(fact)
            else:
                alone[fact] = i + 1
    return len(spans), {fact: i for fact, i in alone.items() if fact not in shared}


_TEXT_FACTS, _BLOCK_FACTS = Memo(of_text), Memo(of_blocks)


def numbered(messages: DataFrame) -> DataFrame:
    return messages.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy("ord")))


USES = "session string, n bigint, ord bigint, tokens bigint, blocks int, uses array<struct<block: int, next_n: bigint, spoken: boolean, facts: bigint>>"


def uses(messages: DataFrame, by_block: bool = False) -> DataFrame:
    """Per result: the facts that no earlier message of its session holds, counted by the message that holds them next: session, n, ord, tokens, blocks, uses.

    n numbers the session's messages; next_n is null where no later message
    holds the facts, spoken false where a result does. by_block: only commands'
    outputs, with the number of their blocks, and only facts that one block
    alone holds, counted by that block too.
    """
    said = F.when(F.col("kind") == "call", F.coalesce("args", F.lit("{}"))).otherwise(F.coalesce("text", F.lit("")))
    result = F.col("kind") == "result"
    counts = (result & F.coalesce(F.col("tool") == "bash", F.lit(False))) if by_block else result
    # the window leaves each session's rows in one task, one after the other and in order
    rows = numbered(messages).select("session", "n", "ord", F.coalesce(~result, F.lit(False)).alias("spoken"), counts.alias("counts"), said.alias("said"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("session", pa.string()), ("n", pa.int64()), ("ord", pa.int64()), ("tokens", pa.int64()), ("blocks", pa.int32()), ("uses", pa.list_(pa.struct([("block", pa.int32()), ("next_n", pa.int64()), ("spoken", pa.bool_()), ("facts", pa.int64())])))])
        now: object = walk  # no session
        seen: set[str] = set()  # facts that wait for nothing more
        waiting: dict[str, tuple[dict, Counter, int | None]] = {}  # the others, with the result that holds them first
        session_rows: list[tuple[dict, Counter]] = []
        done: list[dict] = []

        def end() -> None:
            for _, met, block in waiting.values():
                met[block, None, None] += 1
            for row, met in session_rows:
                done.append(row | {"uses": [{"block": b, "next_n": n, "spoken": s, "facts": k} for (b, n, s), k in met.items()]})
            seen.clear()
            waiting.clear()
            session_rows.clear()

        for batch in batches:
            # equal texts of a batch are decoded once
            texts = batch.column("said").dictionary_encode()
            known = texts.dictionary.to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("session", "n", "ord", "spoken", "counts")]
            for session, n, at, spoken, own, text in zip(*columns, texts.indices.to_pylist(), strict=True):
                if session != now:
                    end()
                    now = session
                text = known[text]
                new = _TEXT_FACTS[text] - seen
                row, met, block_of = None, Counter(), None
                if own:
                    blocks, block_of = _BLOCK_FACTS[text] if by_block else (None, None)
                    row = {"session": session, "n": n, "ord": at, "tokens": -(-logs.u16(text) // 4), "blocks": blocks}
                    session_rows.append((row, met))
                for fact in new:
                    first = waiting.pop(fact, None)
                    if first is not None:
                        first[1][first[2], n, spoken] += 1
                    elif row is not None and (block_of is None or fact in block_of):
                        waiting[fact] = (row, met, block_of[fact] if block_of is not None else None)
                        continue
                    seen.add(fact)
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, fields)
                done.clear()
        end()
        yield pa.RecordBatch.from_pylist(done, fields)

    return rows.mapInArrow(walk, USES)


def counted(uses: str, condition) -> F.Column:
    """The number of facts in the array uses for which the condition on its elements holds."""
    return F.aggregate(F.filter(uses, condition), F.lit(0).cast("bigint"), lambda a, u: a + u["facts"])


def used_within(u: F.Column, after: F.Column, horizon: int) -> F.Column:
    return F.coalesce((u["next_n"] <= after + horizon) & u["spoken"], F.lit(False))
