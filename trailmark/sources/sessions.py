"""Session files: one JSON entry a line, in order; trees of entries; what of them a reader still sees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import events
from .model import ENTRY, EVIDENCE_CUTS, MESSAGE, ROLES

# Fixed value: working folders of tests, whose sessions do not count.
TEMPORARY = r"(?:private-tmp|--tmp-|pi-itest)"


def read_entries(spark: SparkSession, root: str, exclude: str | None = TEMPORARY) -> DataFrame:
    """Entries of all files under root: session (the path), ord (the line), type, id, parent_id, message, data.

    Whole files, because a line's place is its meaning; lines that are not JSON
    objects are left out. Files of one session stay one row until split, so the
    largest file bounds a task's memory.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    files = files.select(F.col("_metadata.file_path").alias("session"), "value")
    if exclude:
        files = files.filter(~F.col("session").rlike(exclude))
    lines = files.select("session", F.posexplode(F.split("value", "\n", -1)).alias("ord", "line"))
    parsed = lines.withColumn("e", F.from_json("line", ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.filter(F.col("e").isNotNull() & F.col("e._corrupt_record").isNull())
    return good.select("session", F.col("ord").cast("bigint").alias("ord"), "e.type", "e.id", F.col("e.parentId").alias("parent_id"), F.col("e.customType").alias("custom_type"), F.col("e.firstKeptEntryId").alias("first_kept"), "e.message", "e.data", F.get_json_object("e.message", "$.role").alias("role"))


def text_of(content: Column) -> Column:
    """The text of JSON content: a string, or text parts joined by line feeds; else empty."""
    parts = F.from_json(content, F.lit("array<struct<type: string, text: string>>"))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(content.startswith("["), F.coalesce(joined, F.lit(""))).when(content.startswith("{") | content.isNull(), "").otherwise(content)


def messages(entries: DataFrame) -> DataFrame:
    """Messages of the three modelled roles, each tool call as a row of its own before what follows (schema MESSAGE)."""
    own = entries.filter((F.col("type") == "message") & F.col("role").isin(*ROLES))
    get = lambda path: F.get_json_object("message", path)
    content = get("$.content")
    parts = F.from_json(content, F.lit(_parts()))
    shaped = own.withColumns({"content": content, "parts": F.when(content.startswith("["), parts)})
    blank = F.lit(None).cast("string")
    said = F.array_join(F.filter(F.transform(F.coalesce("parts", F.array().cast(_parts())), lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "thinking", p["thinking"])), lambda t: t.isNotNull()), "\n")
    calls = F.transform(F.filter(F.coalesce("parts", F.array().cast(_parts())), lambda p: p["type"] == "toolCall"), lambda p: F.struct(F.lit("call").alias("kind"), p["id"].alias("call_id"), p["name"].alias("tool"), F.coalesce(p["arguments"], F.lit("{}")).alias("args"), F.lit("").alias("text")))
    note = F.array(F.struct(F.lit("text").alias("kind"), blank.alias("call_id"), blank.alias("tool"), blank.alias("args"), said.alias("text")))
    single = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), get("$.toolCallId").alias("call_id"), get("$.toolName").alias("tool"), blank.alias("args"), text.alias("text")))
    rows = F.when(F.col("role") == "assistant", F.concat(F.when(said != "", note).otherwise(F.array().cast(_rows())), calls)).when(F.col("role") == "user", single("user", text_of(F.col("content")))).otherwise(single("result", text_of(F.col("content"))))
    only = F.col("content").startswith("[") & F.forall(F.coalesce("parts", F.array().cast(_parts())), lambda p: p["type"] == "text")
    found = shaped.select("session", (F.col("ord") * 1000).alias("base"), "role", F.posexplode(rows).alias("i", "m"), (get("$.isError") == "true").alias("e"), only.alias("text_only"))
    return found.select("session", (F.col("base") + F.col("i")).alias("ord"), "m.kind", "role", "m.call_id", "m.tool", "m.args", "m.text", F.coalesce("e", F.lit(False)).alias("is_error"), F.coalesce("text_only", F.lit(False)).alias("text_only"), F.col("base").alias("msg"))


def _parts() -> str:
    return "array<struct<type: string, text: string, thinking: string, id: string, name: string, arguments: string>>"


def _rows() -> str:
    return "array<struct<kind: string, call_id: string, tool: string, args: string, text: string>>"


def branch(entries: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """The entries from the root to each session's leaf (its last entry unless leaves: session, id says), depth from 0.

    A session's tree is walked in one task: ids and parents only, a few bytes an
    entry.
    """
    last = entries.filter("id is not null").groupBy("session").agg(F.max_by("id", "ord").alias("leaf"))
    leaf = last if leaves is None else leaves.select("session", F.col("id").alias("leaf"))
    edges = entries.filter("id is not null").select("session", "id", "parent_id").join(leaf, "session")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        parents = dict(zip(frame["id"], frame["parent_id"], strict=True))
        path, seen, at = [], set(), frame["leaf"].iloc[0]
        while at in parents and at not in seen:
            path.append(at)
            seen.add(at)
            at = parents[at]
        path.reverse()
        return pd.DataFrame({"session": frame["session"].iloc[0], "id": path, "depth": range(len(path))})

    paths = edges.groupBy("session").applyInPandas(walk, "session string, id string, depth bigint")
    return entries.join(paths, ["session", "id"])


def context(entries: DataFrame) -> DataFrame:
    """Entries of a branch that are still in the context: from the first kept entry of the latest compaction on.

    Assumption: what a compaction summarises is gone, the entry it names as first
    kept and all later ones stay, and so does the compaction itself.
    """
    by = W.partitionBy("session")
    last = F.max(F.when(F.col("type") == "compaction", F.struct("ord", "first_kept"))).over(by)
    marked = entries.withColumn("_c", last)
    kept = F.max(F.when(F.col("id") == F.col("_c.first_kept"), F.col("ord"))).over(by)
    start = F.coalesce(kept, F.col("_c.ord"))
    return marked.withColumn("_s", start).filter(F.col("_s").isNull() | (F.col("ord") >= F.col("_s"))).drop("_c", "_s")


def read_context(entries: DataFrame) -> DataFrame:
    """Messages that may be evidence for folding: after the last entry that hides what was before."""
    return messages(events.visible(context(entries), EVIDENCE_CUTS, ROLES))


def write_once(frame: DataFrame, path: str) -> None:
    """JSON output that refuses to replace what is there."""
    frame.write.mode("errorifexists").json(path)


__all__ = ["MESSAGE", "branch", "context", "messages", "read_context", "read_entries", "text_of", "write_once"]
