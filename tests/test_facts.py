import random
import re

import pytest
from pyspark.sql import functions as F

from trailmark.functions import logs
from trailmark.functions import text as X
from trailmark.functions.memo import Memo
from trailmark.operators import analytics, facts
from trailmark.sources.model import MESSAGE


def message(session, ord_, kind, text):
    tool = "bash" if kind in ("call", "result") else None
    return (session, ord_, kind, "user" if kind == "user" else "assistant", f"c{ord_}" if tool else None, tool, text if kind == "call" else None, "" if kind == "call" else text, False, True, ord_)


def some_sessions(seed):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        for i in range(120):
            kind = rng.choice(["user", "text", "call", "result", "result"])
            words = [f"fact_{rng.randint(100, 400)}" for _ in range(rng.randint(0, 60))]
            rows.append(message(s, i, kind, None if i % 31 == 0 else "".join(w + rng.choice([" " * 40, "\n"]) for w in words)))
    rng.shuffle(rows)
    return rows


def held(row):
    said = (row[6] or "{}") if row[2] == "call" else row[7] or ""
    return set(re.findall(r"\w+_\w+", said))


def slowly(rows, horizon):
    """For each result: its facts that are new, and those of them that are used."""
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for i, row in enumerate(own):
            new = held(row).difference(*map(held, own[:i]))
            later = {f: next(((j, r) for j, r in enumerate(own) if j > i and f in held(r)), None) for f in new}
            if row[2] == "result":
                out[s, row[1]] = new, {f for f, x in later.items() if x and x[0] - i <= horizon and x[1][2] != "result"}
    return out


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("horizon", [7, 80])
def test_facts_used_as_by_definition(spark, horizon):
    rows = some_sessions(1)
    got = {(r["session"], r["ord"]): (r["new_facts"], r["used_facts"]) for r in analytics.facts_used(spark.createDataFrame(rows, MESSAGE), horizon).collect()}
    want = {k: (len(new), len(used)) for k, (new, used) in slowly(rows, horizon).items() if new}
    assert got == want and any(u for _, u in want.values())


def test_block_facts_as_by_definition(spark):
    rows = some_sessions(2)
    got = {(r["session"], r["ord"], r["block"]): (r["own_facts"], r["used_facts"]) for r in analytics.block_facts(spark.createDataFrame(rows, MESSAGE), 9).collect()}
    want, text = {}, {(r[0], r[1]): r[7] or "" for r in rows}
    for (s, i), (new, used) in slowly(rows, 9).items():
        blocks = {b["id"]: set(re.findall(r"\w+_\w+", b["text"])) for b in logs.split_blocks(text[s, i])}
        for b, mine in blocks.items():
            alone = {f for f in mine & new if sum(f in other for other in blocks.values()) == 1}
            want[s, i, b] = len(alone), len(alone & used)
    assert got == want and any(u for _, u in want.values())


def test_block_facts_of_equal_outputs_meet_in_no_join(spark):
    # 400 outputs of one session with the same 2,000 facts: pairs of outputs would be 320 million rows
    log = "\n".join(f"case name_{i} of suite" for i in range(2000))
    rows = [message("s", i, "result", log) for i in range(400)] + [message("s", 400, "text", "name_7")]
    found = analytics.block_facts(spark.createDataFrame(rows, MESSAGE))
    assert "Join" not in plan(found)
    got = found.groupBy("ord").agg(F.sum("own_facts").alias("own"), F.sum("used_facts").alias("used")).collect()
    assert {(r["ord"], r["own"], r["used"]) for r in got} == {(i, 2000 if i == 0 else 0, 0) for i in range(400)}


def test_facts_used_makes_no_row_for_each_fact(spark):
    found = analytics.facts_used(spark.createDataFrame(some_sessions(3), MESSAGE))
    assert "Generate" not in plan(found) and "Aggregate" not in plan(found)


def test_sole_sources_makes_no_row_for_each_fact(spark):
    found = analytics.sole_sources(spark.createDataFrame(some_sessions(3), MESSAGE))
    assert "Generate" not in plan(found) and "Aggregate" not in plan(found)


def test_facts_are_those_of_the_column_function(spark):
    texts = ["src/a.ts x.py TS2345 https://a.b 1234 node_modules/x my_var", "é_ü äbc_def x_yzab q/wer9", "a\tb_cdef\r\nERR_12345 fooBarBazzz WARN_X\n./x/y.z\n\n12345\n😀/abcd", "http://x.y/z " + "a_" * 70]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.facts(F.col("t")).alias("f"))
    for r in df.collect():
        assert facts.of_text(r["t"]) == set(r["f"])


def test_memo_is_bounded():
    memo = Memo(len, 1000)
    assert [memo["x" * n] for n in (5, 5000, 5)] == [5, 5000, 5] and "x" * 5000 not in memo
    for i in range(100):
        assert memo[str(i)] == len(str(i)) and len(memo) <= 4
