import random
import re

from pyspark.sql import functions as F

from trailmark.functions import text as X
from trailmark.operators import sieve
from trailmark.sources import synth


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def slow_outcome(text, is_error):
    blank = X.WS[1:-1]
    strip = lambda s: re.sub(rf"^[{blank}]+|[{blank}]+\Z", "", s)
    full = [strip(x) for x in text.split("\n") if strip(x)]
    if not full:
        return "(no output)"
    first = lambda p: next((x for x in full if re.search(p, x, re.ASCII)), None)
    pick = (first(X.NOTABLE) if is_error else None) or first(X.OUTCOME) or full[0]
    return pick + (f" (+{len(full) - 1} lines)" if len(full) > 1 else "")


def test_outcome_line_over_the_whole_text(spark):
    rng = random.Random(1)
    bits = ["passed", "Failed", "FAILED", "Tests: 3", "Tests:x", "Error", "ok", " ", "\t", " ", "\r", "\u0085", "﻿", "a.ts:12", "✗", "x_passed", "😀", *["\n"] * 9]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), rng.random() < 0.5) for _ in range(2000)] + [("", False), ("\n \n", True)]
    df = spark.createDataFrame(rows, "t string, e boolean").select("t", "e", X.outcome_line(F.col("t"), F.col("e")).alias("o"))
    assert all(r["o"] == slow_outcome(r["t"], r["e"]) for r in df.collect())
    # no line is taken out of the text to be tested by itself
    assert "split(" not in plan(df)


def test_sieve_plan_cuts_each_output_once(spark):
    done = sieve.plan(synth.sessions(spark, "/root/testdata/sf0.001"))
    assert plan(done).count("Join") == 2 and "Union" not in plan(done)


def test_a_judge_without_columns_is_asked(spark):
    asked = lambda plans: sieve.formula_judge(plans)
    messages = synth.sessions(spark, "/root/testdata/sf0.001")
    one, other = (sieve.plan(messages, judge).drop("blocks") for judge in (sieve.formula_judge, asked))
    assert one.count() and one.exceptAll(other).count() == other.exceptAll(one).count() == 0
