"""Schemas of session logs: entries as they are written, and messages as they are analysed."""

from __future__ import annotations

from pyspark.sql import types as T

#: One line of a session file. Content and arguments stay JSON text: both are open.
ENTRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("parentId", T.StringType()),
    T.StructField("customType", T.StringType()),
    T.StructField("firstKeptEntryId", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

#: One message or call. A tool call is a row of its own before its result: kind is user, text, call or result; msg numbers the message it is part of.
MESSAGE = "session string, ord bigint, kind string, role string, call_id string, tool string, args string, text string, is_error boolean, text_only boolean, msg bigint"

LABELS = ("KEEP", "TRUNCATE", "DROP")
PREDICTIONS = (*LABELS, "UNCERTAIN")
ROLES = ("user", "assistant", "toolResult")
EVIDENCE_CUTS = ("custom_message", "branch_summary", "compaction")
