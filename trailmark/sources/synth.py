"""Sessions made from the ``events`` table by a fixed formula.

A user's events in time order are a session: signups are requests, purchases
notes of the assistant, clicks and views reads of three files that change
slowly, errors test and build runs with long logs; every fifth call's message
says something before it. The same formula in SQL
(``SQL``) lets another engine check every query over these sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMMANDS = ("npm test", "cd app && CI=1 npm test 2>&1", "cargo check", "npm test | tail -5", "go build ./...", "echo npm test")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: session, ord, kind, role, call_id, tool, args, text, is_error, ts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    # dealt by session once, while rows are narrow: the texts below are made where all later windows need them,
    # in as many tasks as the session asks for, which a size measured here would not suggest
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = events.withColumn("session", F.col("user_id").cast("string")).repartition(tasks, "session")
    at = W.partitionBy("session").orderBy("ts", "event_id")
    e = events.withColumns({"k": k, "ver": F.floor(F.col("event_id") / 2500).cast("bigint"), "pos": F.row_number().over(at)})
    read, bash = F.col("event_type").isin("click", "view"), F.col("event_type") == "error"
    path = F.concat(F.lit("src/f"), (F.col("k") % 3).cast("string"), F.lit(".ts"))
    base = (F.col("k") % 4) * 20
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), F.col("k") % 6 + 1)
    args = F.when(read, F.concat(F.lit('{"path":"'), path, F.lit('","offset":'), (base + 1).cast("string"), F.lit("}"))).when(
        bash, F.concat(F.lit('{"command":"'), command, F.lit('"}'))
    )
    line = lambda p: F.concat(
        F.lit("export const v"), p.cast("string"), F.lit(" = compute("), p.cast("string"), F.lit(', "f'), (F.col("k") % 3).cast("string"),
        F.when((p * 7 + F.col("ver")) % 97 == 0, F.concat(F.lit("-edited-"), F.col("ver").cast("string"))).otherwise(""), F.lit('");'),
    )
    file = F.array_join(F.transform(F.sequence(base + 1, base + 90 + (F.col("k") % 5) * 10), line), "\n")
    log_line = lambda j: (
        F.when(j % 83 == F.col("k") % 83, F.concat(F.lit("FAIL suite case "), j.cast("string")))
        .when(j % 83 == (F.col("k") + 1) % 83, "Error: broken")
        .when(j % 83 == (F.col("k") + 2) % 83, F.concat(F.lit("    at run (src/auth.ts:"), j.cast("string"), F.lit(":7)")))
        .when(j % 97 == 0, F.concat(F.lit("WARN slow case "), j.cast("string")))
        .when(j % 40 == 0, "")
        .otherwise(F.concat(F.lit("PASS routine_case_"), j.cast("string"), F.lit(" completed with ordinary diagnostic padding")))
    )
    log = F.array_join(F.transform(F.sequence(F.lit(1), 160 + (F.col("k") % 5) * 30), log_line), "\n")
    said = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("task "), F.col("event_id").cast("string"), F.lit(" for `f"), (F.col("k") % 3).cast("string"), F.lit("`")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("note "), F.col("event_id").cast("string")))
        .when(read, file)
        .when(bash, log)
    )
    result = read | bash
    row = F.struct(
        (F.col("pos") * 4).cast("bigint").alias("ord"),
        F.when(F.col("event_type") == "signup", "user").when(result, "result").otherwise("text").alias("kind"),
        F.when(F.col("event_type") == "signup", "user").when(result, "toolResult").otherwise("assistant").alias("role"),
    )
    call = F.struct((F.col("pos") * 4 - 1).cast("bigint").alias("ord"), F.lit("call").alias("kind"), F.lit("assistant").alias("role"))
    note = F.struct((F.col("pos") * 4 - 2).cast("bigint").alias("ord"), F.lit("text").alias("kind"), F.lit("assistant").alias("role"))
    spoken = F.col("event_id") % 5 == 0  # the call's message says something, too
    # texts are made last, so that a query that filters messages, or reads no text, makes none for the rest
    out = e.withColumn("m", F.explode(F.when(result & spoken, F.array(note, call, row)).when(result, F.array(call, row)).otherwise(F.array(row))))
    step = F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" of the plan"))
    text = F.when(F.col("m.kind") == "call", "").when(result & (F.col("m.kind") == "text"), step).otherwise(said)
    called = lambda c: F.when(result & F.col("m.kind").isin("call", "result"), c)
    msg = F.when((F.col("m.role") == "assistant") & result, F.col("pos") * 4 - 1).otherwise(F.col("m.ord")).cast("bigint")
    return out.select(
        "session", "m.ord", "m.kind", "m.role",
        called(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("call_id"), called(F.when(read, "read").when(bash, "bash")).alias("tool"), called(args).alias("args"),
        text.alias("text"), (bash & (F.col("k") % 4 == 0) & (F.col("m.kind") == "result")).alias("is_error"), F.lit(True).alias("text_only"), "ts", msg.alias("msg"),
    )


#: The same messages in DuckDB, as the common table expression ``messages``.
SQL = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_id // 2500 AS ver, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
  FROM events
), made AS (
  SELECT *, event_type IN ('click', 'view') AS is_read, event_type = 'error' AS is_bash FROM e
), filled AS (
  SELECT *,
    CASE WHEN is_read THEN '{"path":"src/f' || (k % 3) || '.ts","offset":' || ((k % 4) * 20 + 1) || '}'
         WHEN is_bash THEN '{"command":"' || (['npm test', 'cd app && CI=1 npm test 2>&1', 'cargo check', 'npm test | tail -5', 'go build ./...', 'echo npm test'])[k % 6 + 1] || '"}' END AS args,
    CASE WHEN event_type = 'signup' THEN 'task ' || event_id || ' for `f' || (k % 3) || '`'
         WHEN event_type = 'purchase' THEN 'note ' || event_id
         WHEN is_read THEN array_to_string(list_transform(generate_series((k % 4) * 20 + 1, (k % 4) * 20 + 90 + (k % 5) * 10), lambda p:
              'export const v' || p || ' = compute(' || p || ', "f' || (k % 3) || CASE WHEN (p * 7 + ver) % 97 = 0 THEN '-edited-' || ver ELSE '' END || '");'), chr(10))
         WHEN is_bash THEN array_to_string(list_transform(generate_series(1, 160 + (k % 5) * 30), lambda j:
              CASE WHEN j % 83 = k % 83 THEN 'FAIL suite case ' || j WHEN j % 83 = (k + 1) % 83 THEN 'Error: broken'
                   WHEN j % 83 = (k + 2) % 83 THEN '    at run (src/auth.ts:' || j || ':7)' WHEN j % 97 = 0 THEN 'WARN slow case ' || j
                   WHEN j % 40 = 0 THEN '' ELSE 'PASS routine_case_' || j || ' completed with ordinary diagnostic padding' END), chr(10)) END AS body
  FROM made
), messages AS (
  SELECT CAST(user_id AS VARCHAR) AS session, 4 * pos - 1 AS ord, 'call' AS kind, 'assistant' AS role, 'c' || event_id AS call_id,
         CASE WHEN is_read THEN 'read' ELSE 'bash' END AS tool, args, '' AS text, false AS is_error, ts, 4 * pos - 1 AS msg
  FROM filled WHERE is_read OR is_bash
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), 4 * pos - 2, 'text', 'assistant', NULL, NULL, NULL, 'step ' || event_id || ' of the plan', false, ts, 4 * pos - 1
  FROM filled WHERE (is_read OR is_bash) AND event_id % 5 = 0
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), 4 * pos, CASE WHEN event_type = 'signup' THEN 'user' WHEN is_read OR is_bash THEN 'result' ELSE 'text' END,
         CASE WHEN event_type = 'signup' THEN 'user' WHEN is_read OR is_bash THEN 'toolResult' ELSE 'assistant' END,
         CASE WHEN is_read OR is_bash THEN 'c' || event_id END, CASE WHEN is_read THEN 'read' WHEN is_bash THEN 'bash' END,
         args, body, is_bash AND k % 4 = 0, ts, 4 * pos
  FROM filled
)"""
