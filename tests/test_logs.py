import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import logs, research

PIECES = ["", "  ", "ok line", "  indented", "Error: boom", "    at f (a.js:1:2)", "Caused by: x", "Traceback (most recent call last):", '  File "a.py", line 3', "panic: no", "goroutine 7", "PASS a", "FAIL b", "WARN c", "src/a.ts:3:4 bad", "tests: 5", "exit code 3"]


def slow_stack(lines):
    """The region rule said forwards: every seed marks its own run."""
    frame, caused = logs._FRAME, logs._CAUSED
    blank = lambda s: not s.strip()
    marked = set()
    for i, x in enumerate(lines):
        if not (logs._FAILURE.search(x) or logs._START.search(x) or frame.match(x)):
            continue
        end, inside = i, False
        while end + 1 < len(lines) and not blank(lines[end + 1]):
            y = lines[end + 1]
            if not logs._WHOLE.search(x):
                if not (frame.match(y) or caused.match(y) or (inside and y[:1].isspace())):
                    break
                inside = True
            end += 1
        marked |= set(range(i, end + 1))
    return [i in marked for i in range(len(lines))]


@pytest.mark.parametrize("seed", range(200))
def test_stack_lines_match_the_forward_rule(seed):
    rng = random.Random(seed)
    lines = [rng.choice(PIECES) for _ in range(rng.randint(1, 30))]
    assert logs.stack_lines(lines) == slow_stack(lines)


def test_windows_agree_with_the_single_output_form(spark):
    rng = random.Random(1)
    outputs = {i: [rng.choice(PIECES) for _ in range(rng.randint(1, 40))] for i in range(60)}
    frame = spark.createDataFrame([(i, n, x) for i, xs in outputs.items() for n, x in enumerate(xs, 1)], "k int, n int, line string")
    got = logs.keep_reason(logs.regions(frame, ["k"]), ["k"]).collect()
    for i, xs in outputs.items():
        own = sorted((r["n"], r["stack"], r["reason"]) for r in got if r["k"] == i)
        assert [r[1] for r in own] == logs.stack_lines(xs)
        assert [r[2] for r in own] == logs.reasons(xs)


@pytest.mark.parametrize("seed", range(40))
def test_blocks_cover_every_line_once(seed):
    rng = random.Random(seed)
    lines = [rng.choice([*PIECES, "x" * 400, "y" * 1600]) for _ in range(rng.randint(1, 60))]
    blocks = logs.split_blocks("\n".join(lines), max_blocks=1000)
    assert [b["from"] for b in blocks] == [1, *(b["to"] + 1 for b in blocks[:-1])] and blocks[-1]["to"] == len(lines)
    assert "\n".join(b["text"] for b in blocks) == "\n".join(lines)
    assert all(len(b["text"]) <= 1500 for b in blocks if b["complete"])
    chunks = logs.chunks("\n".join(lines))
    assert "\n".join(c["text"] for c in chunks) == "\n".join(lines)
    research_blocks = research.sieve_blocks("\n".join(lines), "bash")
    assert "\n".join(b["text"] for b in research_blocks) == "\n".join(lines)


def test_block_limit_and_cuts():
    assert logs.split_blocks("\n".join(["z" * 1600] * 65)) is None
    blocks = logs.split_blocks("\n".join(["a" * 700, "", "b" * 700, "c" * 700]))
    assert [(b["from"], b["to"]) for b in blocks] == [(1, 1), (2, 4)]


def test_chunk_closes_at_a_blank_line_from_the_twelfth():
    chunks = logs.chunks("\n".join(["l"] * 13 + [""] + ["m"] * 20))
    assert [(c["from"], c["to"]) for c in chunks] == [(1, 14), (15, 34)]
    early = logs.chunks("\n".join(["l"] * 5 + [""] + ["m"] * 30))
    assert early[0]["to"] == 24


def test_failure_neighbourhood_is_six_lines():
    lines = ["x"] * 20
    lines[10] = "FAIL here"
    assert [i for i, r in enumerate(logs.reasons(lines)) if r] == list(range(4, 17))


def test_notable_lines_cap_shapes_and_rank(spark):
    lines = [f"warning {i}" for i in range(5)] + ["error: a", "plain", "2 failed", "FAIL z"]
    frame = spark.createDataFrame([(1, n, x) for n, x in enumerate(lines, 1)], "k int, n int, line string")
    got = [(r["n"], r["priority"]) for r in logs.notable_lines(frame, ["k"], 3).orderBy("n").collect()]
    assert got == [(6, 3), (8, 4), (9, 3)]
    assert research.notable(lines, 3) == [(6, "error: a"), (8, "2 failed"), (9, "FAIL z")]
    assert len(logs.notable_lines(frame, ["k"], 99).collect()) == len(research.notable(lines, 99)) == 5


def test_research_decision_keeps_the_likeliest_three():
    blocks = [{"id": f"b{i}", "from": i, "to": i, "text": f"text {i}"} for i in range(1, 8)]
    p = dict(zip((b["id"] for b in blocks), (0.01, 0.5, 0.6, 0.7, 0.4, 0.02, 0.14)))
    assert research.sieve_decide("specific_parts", 0, 0, blocks, p)[0] == ["b1", "b6", "b7"]
    low = dict.fromkeys(p, 0.05)
    assert research.sieve_decide("specific_parts", 0, 0, blocks, low)[0] == ["b4", "b5", "b6", "b7"]
    assert len(research.sieve_decide("outcome_only", 0, 0, blocks, low)[0]) == 7
    assert research.sieve_decide("every_line", 0.5, 0, blocks, low)[1] == "every_line"
    assert research.sieve_decide("specific_parts", 0, 0.5, blocks, low)[0] == []


def test_request_terms_name_few_blocks():
    assert research.request_terms("please fix `loadUser` in src/a.ts", ["has loaduser", "x", "src/a.ts here", "y", "z"]) == ["loaduser", "src/a.ts"]


def test_trim_keeps_failures_and_counts_lines():
    lines = [f"line {i}" for i in range(200)]
    lines[100] = "FAIL middle"
    done = research.render_trimmed("\n".join(lines), "lines", [], "t1")
    assert done["kept_lines"] == 5 + 8 + 3 and "FAIL middle" in done["text"] and done["worth"]
    assert research.decide_trim("specific_parts", 0.7, 0.6, 0.4, [{"id": "a"}, {"id": "b"}, {"id": "c"}], {"a": 0.45, "b": 0.4, "c": 0.1}) == (True, ["a", "b"])
    assert research.decide_trim("specific_parts", 0.69, 0.6, 0, [], {})[0] is False


def test_units_by_shape():
    mode, found = research.units("\n".join(["FAIL a", "x", "Error: b"]), "bash")
    assert mode == "lines" and [u["from"] for u in found] == [1, 3]
    mode, found = research.units("\n".join(f"src/d{i // 10}/f{i}.ts:{i}: hit" for i in range(60)), "grep")
    assert mode == "blocks" and len(found) <= 16 and found[0]["to"] == 10
