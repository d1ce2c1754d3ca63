import json
import math

import pytest
from pyspark.sql import functions as F

from trailmark import settings
from trailmark.operators import analytics, judge, metrics, policy, recall, sieve
from trailmark.workbench import Workbench

READING = "choice string, probabilities map<string,double>, confidence double, signals map<string,double>, excerpted boolean, durable boolean, superseded boolean, exact_repeat boolean"


def reading(choice="DROP", p=None, confidence=0.9, signals=None, excerpted=False, facts=(False, False, False)):
    return (choice, p or {"DROP": 0.9, "KEEP": 0.05, "TRUNCATE": 0.04}, confidence, signals or {}, excerpted, *facts)


@pytest.mark.parametrize(
    "row,safe,composite,guarded,hybrid",
    [
        (reading(), "DROP", "DROP", "DROP", "DROP"),
        (reading("UNCERTAIN"), "KEEP", "KEEP", "KEEP", "KEEP"),
        (reading("TRUNCATE"), "TRUNCATE", "TRUNCATE", "TRUNCATE", "TRUNCATE"),
        (reading(p={"DROP": 0.69, "TRUNCATE": 0.3}), "TRUNCATE", "TRUNCATE", "TRUNCATE", "TRUNCATE"),
        (reading(p={"DROP": 0.75}), "DROP", "DROP", "KEEP", "KEEP"),
        (reading(confidence=0.6), "DROP", "DROP", "KEEP", "KEEP"),
        (reading(signals={"needed_now": 0.5}), "DROP", "KEEP", "KEEP", "KEEP"),
        (reading(signals={"needed_now": 0.5}, excerpted=True), "DROP", "TRUNCATE", "KEEP", "KEEP"),
        (reading(signals={"durable": 0.8}), "DROP", "TRUNCATE", "TRUNCATE", "TRUNCATE"),
        (reading(signals={"unique_fact": 0.6, "superseded": 0.5}), "DROP", "DROP", "DROP", "DROP"),
        (reading("KEEP", signals={"mostly_noise": 0.7}, excerpted=True), "KEEP", "TRUNCATE", "KEEP", "KEEP"),
        (reading(facts=(True, False, False)), "DROP", "DROP", "DROP", "TRUNCATE"),
        (reading(facts=(True, True, False)), "DROP", "DROP", "DROP", "DROP"),
        (reading("KEEP", facts=(False, True, True)), "KEEP", "KEEP", "KEEP", "DROP"),
        (reading(None), None, None, "DROP", "KEEP"),
    ],
)
def test_policies(spark, row, safe, composite, guarded, hybrid):
    got = spark.createDataFrame([row], READING).select(policy.safe(), policy.composite(), policy.guarded(), policy.hybrid()).first()
    if row[0] is None:
        assert got[3] == hybrid
    else:
        assert tuple(got) == (safe, composite, guarded, hybrid)


def test_relations_by_tools(spark):
    path, grep, bash = '{"path":"a.ts"}', '{"pattern":"x"}', '{"command":"make"}'
    rows = [("s", 1, "read", path, False, "t"), ("s", 2, "edit", path, False, "t"), ("s", 3, "read", path, False, "u"), ("s", 4, "grep", grep, False, "t"), ("s", 5, "grep", grep, False, "t"), ("s", 6, "bash", bash, True, "t"), ("s", 7, "bash", bash, False, "t")]
    got = policy.relations(spark.createDataFrame(rows, "session string, seq long, tool string, args string, is_error boolean, text string")).collect()
    assert {(r["seq"], r["later_seq"]): r["relation"] for r in got} == {
        (1, 2): "the same file was modified later", (1, 3): "the same file was read again later", (2, 3): "the same lookup was repeated later",
        (4, 5): "the same lookup was repeated later", (6, 7): "the same command was run again later",
    }


def test_would_save_counts_the_latest_decision_of_a_call(spark):
    rows = [("s", "a", 1, "DROP", 900), ("s", "a", 2, "KEEP", 900), ("s", "b", 1, "DROP", 140), ("s", "c", 3, "TRUNCATE", 400), ("s", "d", 1, "TRUNCATE", 100), ("s", "e", 1, "DROP", 30)]
    got = analytics.would_save(spark.createDataFrame(rows, "session string, call_id string, at int, decision string, tokens int")).collect()
    assert [tuple(r) for r in got] == [("s", 5, 2, 2, 100 + 250)]


def test_misjudgements_hold_what_is_not_critical(spark):
    rows = [("a", "KEEP", ["KEEP"], True, "DROP", 1, 1), ("b", "KEEP", ["KEEP"], False, "TRUNCATE", 1, 1), ("b", "KEEP", ["KEEP"], False, "TRUNCATE", 1, 1), ("c", "DROP", ["DROP", "KEEP"], False, "KEEP", 1, 1)]
    got = metrics.misjudgements(spark.createDataFrame(rows, EVAL).withColumn("category", F.lit("x")), ["category"]).collect()
    assert sorted(tuple(r) for r in got) == [("x", "a", "KEEP", "DROP", True, 1), ("x", "b", "KEEP", "TRUNCATE", False, 2)]


EVAL = "key string, truth string, acceptable array<string>, critical boolean, pred string, tokens int, truncated_tokens int"


def test_summary(spark):
    rows = [("a", "KEEP", ["KEEP"], True, "DROP", 100, 10), ("b", "KEEP", ["KEEP"], True, "KEEP", 100, 10), ("c", "DROP", ["DROP"], False, "DROP", 100, 10), ("d", "TRUNCATE", ["TRUNCATE"], False, "TRUNCATE", 100, 20)]
    got = metrics.summary(spark.createDataFrame(rows, EVAL)).first()
    assert (got["n"], got["accuracy"], got["critical_false_drop_rate"], got["drop_precision"], got["token_savings"]) == (4, 0.75, 0.5, 0.5, 280 / 400)
    assert got["critical_false_drops"] == ["a"] and got["uncertain_rate"] == 0
    empty = metrics.summary(spark.createDataFrame([], EVAL)).first()
    assert empty["n"] == 0 and math.isnan(empty["accuracy"])


def test_confusion_fills_zeros(spark):
    got = {r["truth"]: (r["pred_keep"], r["pred_drop"], r["pred_uncertain"]) for r in metrics.confusion(spark.createDataFrame([("KEEP", "DROP"), ("KEEP", "KEEP")], "truth string, pred string")).collect()}
    assert got == {"KEEP": (1, 1, 0), "TRUNCATE": (0, 0, 0), "DROP": (0, 0, 0)}


@pytest.mark.parametrize("votes,winner", [(["DROP", "KEEP"], "KEEP"), (["DROP", "DROP", "KEEP"], "DROP"), (["UNCERTAIN", "DROP"], "UNCERTAIN"), (["TRUNCATE", "UNCERTAIN"], "TRUNCATE")])
def test_majority(spark, votes, winner):
    frame = spark.createDataFrame([(1, v) for v in votes], "k int, pred string")
    assert metrics.majority(frame, ["k"]).first()["pred"] == winner
    assert metrics.unanimous(frame, ["k"]).first()["unanimous"] is False


def test_order_statistics(spark):
    frame = spark.createDataFrame([(x,) for x in (5.0, 1.0, 3.0, 2.0, 4.0)], "x double")
    assert frame.agg(metrics.nearest_rank("x", 50), metrics.nearest_rank("x", 95)).first()[:] == (3.0, 5.0)
    assert metrics.floor_rank(frame, [], "x", {"a": 0.5, "b": 0.9, "c": 1.0}).first()[:] == (3.0, 5.0, 5.0)
    assert math.isnan(frame.limit(0).agg(metrics.nearest_rank("x", 50)).first()[0])


def originals(spark, rows):
    return spark.createDataFrame(rows, "alias string, summary string, text string")


def test_search_outcomes(spark):
    assert recall.search(originals(spark, []), "x")["status"] == "empty"
    some = originals(spark, [("t1", "read a", "\n".join(["retryLimit = 3"] + ["filler words"] * 30)), ("t2", "bash", "nothing else")])
    assert recall.search(some, "!!!")["status"] == "no_terms"
    none = recall.search(some, "zebra")
    assert none["status"] == "no_match" and none["missing"] == ["zebra"]
    full = recall.search(some, "retryLimit")
    assert full["status"] == "complete" and full["chunks"] == [("t1", 1, 24)]
    partial = recall.search(some, "retryLimit otherName")
    assert partial["status"] == "partial" and partial["missing"] == ["other", "name"] and partial["missing_identifiers"] == ["otherName"]
    assert recall.search(some, "retryLimi")["missing"] == ["limi"]


def test_search_pages_by_rank(spark):
    text = "\n".join(f"needle line {i} with some words" for i in range(72))
    some = originals(spark, [("t1", "bash: npm test", text)])
    size = -(-len("[context_recall t1] Historical bash: npm test: output lines 1-24\n" + "\n".join(text.split("\n")[:24])) // 4)
    first = recall.search(some, "needle", size + 10)
    assert (first["hits"], first["returned"], first["next"]) == (3, 1, 2)
    assert recall.search(some, "needle", size + 10, 2)["chunks"] == [("t1", 25, 48)]
    last = recall.search(some, "needle", 10_000, 3)
    assert (last["returned"], last["next"]) == (1, None)
    assert recall.search(some, "needle", 1)["returned"] == 0


MESSAGES = "session string, ord bigint, kind string, role string, call_id string, tool string, args string, text string, is_error boolean, text_only boolean"


def run(text, command="npm test", is_error=False, request="please run the suite"):
    args = json.dumps({"command": command})
    return [("s", 0, "user", "user", None, None, None, request, False, True), ("s", 1, "call", "assistant", "c", "bash", args, "", False, True), ("s", 2, "result", "toolResult", "c", "bash", None, text, is_error, True)]


def fixed(p, choice="specific_parts", asked=0.0):
    def answer(plans):
        return plans.select("session", "ord", F.lit(choice).alias("choice"), F.lit(0.9).alias("probability"), F.lit(0.9).alias("confidence"), F.lit(asked).alias("user_asked"), F.map_from_entries(F.transform("blocks", lambda b: F.struct(b["id"], F.lit(p)))).alias("p"))

    return answer


PASSED = "\n".join(f"PASS routine_case_{i} completed with ordinary diagnostic padding" for i in range(450))


def planned(spark, rows, judge_, cfg=sieve.DEFAULT):
    return sieve.plan(spark.createDataFrame(rows, MESSAGES), judge_, cfg).collect()


@pytest.mark.parametrize("p,hides", [(0.099, True), (0.10, False), (0.101, False)])
def test_threshold_is_strict(spark, p, hides):
    (row,) = planned(spark, run(PASSED), fixed(p))
    assert (row["skip"] is None) is hides


def test_failed_command_hides_only_passed_blocks(spark):
    lines = PASSED.split("\n")
    evidence = ["FAIL suite", "Error: broken", "    at run (a.ts:1:2)", "odd diagnostics", "Tests: 1 failed"]
    (row,) = planned(spark, run("\n".join(lines[:225] + evidence + lines[225:]), is_error=True), fixed(0.01))
    assert row["skip"] is None and all(x in row["out"] for x in evidence)
    kept = [b for b in row["blocks"] if b["id"] not in row["hidden"]]
    assert all(b["hard"] or not b["complete"] for b in kept)


@pytest.mark.parametrize(
    "rows,answer,skip",
    [
        (run(PASSED), fixed(0.01, "every_line"), "judge every_line"),
        (run(PASSED), fixed(0.01, asked=0.5), "user requested complete output"),
        (run(PASSED), fixed(2.0), "invalid block answer"),
        (run(PASSED), fixed(float("nan")), "invalid block answer"),
        (run(PASSED), fixed(0.01, "other"), "invalid complete answer"),
        (run(PASSED), fixed(0.01, None), "judge unavailable"),
        (run(PASSED), fixed(0.5), "no block passed hard guards and threshold"),
        (run(PASSED, request="explain `routine_case_`"), fixed(0.01), "no block passed hard guards and threshold"),
        (run("\n".join(["z" * 1600] * 65)), fixed(0.01), "uncertain block coverage"),
        (run("\n".join(["padding " * 150] * 64)), fixed(0.01), "request budget exceeded"),
    ],
)
def test_skip_reasons(spark, rows, answer, skip):
    (row,) = planned(spark, rows, answer)
    assert row["skip"] == skip and row["out"] is None


@pytest.mark.parametrize("rows", [run(PASSED, "cat log"), run("PASS a\n" * 20), run(PASSED + "\n[Showing lines 1-2. Full output: /x]"), run(PASSED, is_error=True)])
def test_not_eligible(spark, rows):
    assert planned(spark, rows, fixed(0.01)) == []


def test_benefit_gate(spark):
    (row,) = planned(spark, run(PASSED), fixed(0.01), sieve.Limits(min_saved=10**6))
    assert row["skip"] == "benefit gate failed"


QUESTION = {"b1": {"type": "noul"}}


def ok(p=0.5):
    return 200, {}, json.dumps({"answers": {"b1": {"type": "noul", "noul": p}}}).encode()


class Clock:
    now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


@pytest.mark.parametrize(
    "replies,result,slept",
    [
        ([ok()], "answers", 0), ([(429, {}, b""), ok()], "answers", 0.15), ([(503, {"Retry-After": "1"}, b""), ok()], "answers", 1), ([(500, {}, b"")] * 3, "status 500", 0.45),
        ([(400, {}, b"")], "status 400", 0), ([ok(1.5)], "invalid answer", 0), ([(200, {}, b"no json")], "invalid answer", 0), ([(503, {"Retry-After": "9"}, b"")], "timeout", 0), ([], "IndexError", 0),
    ],
)
def test_judge_calls(replies, result, slept):
    clock, left = Clock(), list(replies)
    got = judge.decide(lambda body, timeout: left.pop(0), {}, QUESTION, sleep=clock.sleep, clock=clock)
    assert ("answers" in got) if result == "answers" else got["error"] == result
    assert clock.now == pytest.approx(slept)


def test_answers_through_frames(spark):
    state = json.dumps({"a": 1}, sort_keys=True)
    frame = spark.createDataFrame([("k1", state, json.dumps(QUESTION)), ("k2", '{"b": 2}', json.dumps(QUESTION))], "key string, state string, questions string").coalesce(1)
    reply = {state: [ok(0.25)]}
    got = {r["key"]: r for r in judge.ask(frame, lambda: judge.Recorded(reply)).collect()}
    assert json.loads(got["k1"]["answers"])["b1"]["noul"] == 0.25 and got["k2"]["error"] == "KeyError"
    assert judge.clamped({"a": 1.5, "b": -1, "c": float("nan"), "d": True, "e": 0.3}) == {"a": 1.0, "b": 0.0, "e": 0.3}


def test_settings_layers(tmp_path):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"max_age": 5, "threshold": 2, "dedupe": "off", "min_share": 0.4, "unknown": 1}))
    got = settings.resolve({"max_age": 7}, {"TRAILMARK_MIN_SHARE": "0.5", "TRAILMARK_MAX_AGE": "6", "TRAILMARK_MIN_SAVED": "-1"}, file)
    assert (got.max_age, got.min_share, got.threshold, got.dedupe, got.min_saved, got.sieve) == (7, 0.5, 0.1, "off", 1000, "off")
    assert settings.resolve({}, {}) == settings.Settings()
    assert settings.resolve({"mode": "off"}, {}).dedupe == "off" and settings.resolve({"mode": "off", "dedupe": "on"}, {}).dedupe == "on"
    file.write_text("[broken")
    assert settings.from_file(file) == {} and settings.from_file(tmp_path / "none") == {}
    env = tmp_path / ".env"
    env.write_text("# c\nexport A='x'\nB=\"y=z\"\nbad line\n")
    assert settings.dotenv(env) == {"A": "x", "B": "y=z"}


def test_workbench(spark):
    saved = spark.createDataFrame([("s", "t1", "c1", "read a", "l1\nl2"), ("s", "t2", "c2", "bash", "x"), ("o", "t1", "c9", "read", "other")], "session string, alias string, call_id string, summary string, text string")
    log = spark.createDataFrame([("s", 1, "seen", True, 100, 40), ("s", 2, "sieve", False, 90, 10), ("s", 3, "recall", False, None, None), ("s", 4, "seen", True, 5, 9)], "session string, ord int, kind string, acted boolean, from int, to int")
    bench = Workbench(spark.createDataFrame([], MESSAGES), saved, log)
    r = bench.report().first()
    assert (r["collapsed"], r["shortened"], r["saved"], r["evaluations"], r["recalls"]) == (2, 0, 60, 1, 1)
    assert bench.status().first()["status"] == "ctx:on · 2 trimmed, 0.1k tok saved"
    assert bench.recall("s", "t1")["lines"] == ["l1", "l2"] and bench.recall("s", "c1", offset=2)["lines"] == ["l2"]
    assert bench.recall("s", "t1", limit=1)["next"] == 2
    past = bench.recall("s", "t1", offset=3)
    assert past["lines"] == [] and past["total"] == 2
    assert bench.recall("s", "zz") == {"status": "unknown", "known": ["t2", "t1"]}
    assert bench.recall("s", query="other")["status"] == "no_match" and bench.recall("s")["status"] == "nothing asked"
    assert bench.label("s", "bad").first()["target_ord"] == 4 and bench.label("none", "x").collect() == []
    assert bench.shortened(sieve.formula_judge) is None
    assert bench.set(sieve="on", dedupe="maybe").sieve == "on" and bench.settings.dedupe == "on"
