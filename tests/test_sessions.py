import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trailmark.functions import logs
from trailmark.operators import analytics, dedupe, events, metrics
from trailmark.sources import model, sessions
from trailmark.streaming import replay

COLUMNS = model.MESSAGE.removesuffix(", msg bigint")


def file_lines(a, b, edit=None):
    return "\n".join(f"const value{i} = compute({i}, 'some padding here');" + ("!" if i == edit else "") for i in range(a, b + 1))


def session(*steps, name="s"):
    """Rows from steps: ('user', text), ('text', text), ('read', id, path, offset, text, **more)."""
    rows, ord_ = [], 0
    for step in steps:
        if step[0] in ("user", "text"):
            rows.append((name, ord_, step[0], "user" if step[0] == "user" else "assistant", None, None, None, step[1], False, True))
        else:
            _, call, path, offset, text, *more = step
            more = more[0] if more else {}
            args = json.dumps({"path": path, "offset": offset} if offset else {"path": path}, separators=(",", ":"))
            rows.append((name, ord_, "call", "assistant", call, "read", args, "", False, True))
            ord_ += 1
            rows.append((name, ord_, "result", "toolResult", call, "read", None, text, more.get("error", False), more.get("text_only", True)))
        ord_ += 1
    return rows


def folds(spark, rows, cfg=dedupe.DEFAULT):
    return {r["call_id"]: r for r in dedupe.plan(spark.createDataFrame(rows, COLUMNS), cfg).collect()}


def test_overlap_folds_the_shared_lines(spark):
    got = folds(spark, session(("user", "go"), ("read", "a", "f.ts", 0, file_lines(1, 200)), ("read", "b", "f.ts", 101, file_lines(101, 300))))
    assert set(got) == {"b"}
    assert (got["b"]["folded_lines"], got["b"]["total_lines"], got["b"]["source"]) == (100, 200, "a")
    assert "[file lines 101-200 unchanged" in got["b"]["text"] and file_lines(201, 300) in got["b"]["text"]


def test_equal_text_elsewhere_in_the_file_is_no_match(spark):
    assert folds(spark, session(("read", "a", "f.ts", 0, file_lines(1, 200)), ("read", "b", "f.ts", 301, file_lines(1, 200)))) == {}
    assert folds(spark, session(("read", "a", "f.ts", 0, file_lines(1, 200)), ("read", "b", "f.ts", 0, "new\n" + file_lines(1, 199)))) == {}


def test_an_edited_line_stays(spark):
    got = folds(spark, session(("read", "a", "f.ts", 0, file_lines(1, 200)), ("read", "b", "f.ts", 0, file_lines(1, 200, edit=101))))
    assert got["b"]["folded_lines"] == 199 and "compute(101, 'some padding here');!" in got["b"]["text"]
    assert [(r["from"], r["to"]) for r in got["b"]["runs"]] == [(1, 100), (102, 200)]


def test_footer_is_no_file_line(spark):
    note = "\n\n[Showing lines 1-100 of 500 (x). Use offset=101 to continue.]"
    got = folds(spark, session(("read", "a", "f.ts", 0, file_lines(1, 100) + note), ("read", "b", "f.ts", 0, file_lines(1, 100) + note)))
    assert got["b"]["folded_lines"] == got["b"]["total_lines"] == 100 and got["b"]["text"].endswith(note)


@pytest.mark.parametrize("age,folded", [(11_999, True), (12_000, True), (12_001, False)])
def test_age_counts_the_pending_call_and_is_inclusive(spark, age, folded):
    pending = len('{"path":"f.ts"}')
    filler = "x" * (4 * (age - -(-pending // 4)))
    assert bool(folds(spark, session(("read", "a", "f.ts", 0, file_lines(1, 100)), ("text", filler), ("read", "b", "f.ts", 0, file_lines(1, 100))))) is folded


def test_evidence_is_of_the_same_request_path_and_without_error(spark):
    one = ("read", "a", "f.ts", 0, file_lines(1, 100))
    two = ("read", "b", "f.ts", 0, file_lines(1, 100))
    assert folds(spark, session(one, ("user", "next"), two)) == {}
    assert set(folds(spark, session(one, ("user", "next"), two), dedupe.Freshness(same_epoch=False))) == {"b"}
    assert folds(spark, session(("read", "a", "g.ts", 0, file_lines(1, 100)), two)) == {}
    assert folds(spark, session((*one, {"error": True}), two)) == {}
    assert folds(spark, session((*one, {"text_only": False}), two)) == {}
    assert folds(spark, session(("read", "a", "f.ts", 0, '[folded-context] context_recall with id "t1"\n' + file_lines(2, 100)), two)) == {}


def test_newest_evidence_with_a_run_decides(spark):
    got = folds(spark, session(("read", "a", "f.ts", 0, file_lines(1, 200)), ("read", "n", "f.ts", 80, file_lines(80, 130)), ("read", "b", "f.ts", 0, file_lines(1, 130))))
    assert got["b"]["source"] == "n" and got["b"]["folded_lines"] == 51


def test_call_pairing_takes_the_latest_earlier_call(spark):
    rows = [("s", 0, "call", "assistant", "x", "read", '{"path":"a"}', "", False, True), ("s", 1, "call", "assistant", "x", "read", '{"path":"b"}', "", False, True), ("s", 2, "result", "toolResult", "x", "read", None, "t", False, True), ("s", 3, "call", "assistant", "x", "read", '{"path":"c"}', "", False, True), ("s", 4, "result", "toolResult", "lost", "read", None, "t", False, True)]
    assert [r["args"] for r in events.paired(spark.createDataFrame(rows, COLUMNS)).orderBy("ord").collect()] == ['{"path":"b"}', "{}"]


LONG = session(
    ("user", "go"), ("read", "a", "f.ts", 0, file_lines(1, 150)), ("read", "b", "f.ts", 0, file_lines(1, 150)), ("read", "c", "f.ts", 0, file_lines(1, 150, edit=70)), ("text", "x" * 30_000),
    ("read", "d", "f.ts", 0, file_lines(1, 150)), ("read", "e", "f.ts", 0, file_lines(1, 150)), ("text", "y" * 40_000), ("read", "f", "f.ts", 0, file_lines(1, 150)), ("user", "more"), ("read", "g", "f.ts", 0, file_lines(1, 150)), ("read", "h", "f.ts", 50, file_lines(50, 260)),
)


def test_feedback_a_folded_read_never_renews_the_age(spark):
    frame = spark.createDataFrame(LONG, COLUMNS)
    exact = [r["call_id"] for r in replay.replay(frame).orderBy("ord").collect()]
    assert exact == ["b", "c", "d", "e", "h"]
    shadow = {(r["ord"], r["text"]) for r in replay.replay(frame, act=False).collect()}
    assert shadow == {(r["ord"], r["text"]) for r in dedupe.plan(frame).collect()}


def test_stream_equals_batch_and_late_rows_come_out(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame = spark.createDataFrame(LONG, COLUMNS).coalesce(1)
    half = LONG[len(LONG) // 2][1]
    for i, part in enumerate((frame.filter(F.col("ord") < half), frame.filter(F.col("ord") >= half), frame.filter(F.col("ord") == 2))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            replay.replay_stream(spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda b, n: replay.originals_first(b, n, str(tmp_path / "originals"), str(tmp_path / "log")))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
    log = spark.read.parquet(str(tmp_path / "log"))
    batch = {(r["ord"], r["alias"], r["kept_tokens"]) for r in replay.replay(frame).collect()}
    assert {(r["ord"], r["alias"], r["kept_tokens"]) for r in log.filter("status = 'folded'").collect()} == batch
    assert [r["ord"] for r in log.filter("status = 'late'").collect()] == [2]
    assert spark.read.parquet(str(tmp_path / "originals")).count() == len(batch)


def test_strange_arguments_pass_through(spark):
    rows = [("s", 0, "call", "assistant", "x", "read", '{"path":5,"offset":"a"}', "", False, True), ("s", 1, "result", "toolResult", "x", "read", None, file_lines(1, 90), False, True)]
    assert replay.replay(spark.createDataFrame(rows, COLUMNS)).collect() == []


def write_session(folder, name, entries):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.jsonl").write_text("\n".join(e if isinstance(e, str) else json.dumps(e, separators=(",", ":")) for e in entries) + "\n")


def entry(i, role, content, parent=None, **more):
    return {"type": "message", "id": i, "parentId": parent, "message": {"role": role, "content": content, **more}}


def test_files_trees_and_visibility(spark, tmp_path):
    tree = [
        entry("1", "user", "hello"),
        entry("2", "assistant", [{"type": "text", "text": "sure"}, {"type": "toolCall", "id": "c1", "name": "read", "arguments": {"path": "a.ts", "offset": 2}}], "1"),
        "{ not json",
        entry("3", "toolResult", [{"type": "text", "text": "l1"}, {"type": "text", "text": "l2"}], "2", toolCallId="c1", toolName="read", isError=False),
        entry("4", "user", [{"type": "text", "text": "other branch"}], "1"),
        entry("5", "toolResult", [{"type": "image"}, {"type": "text", "text": "t"}], "4", toolCallId="c2", toolName="read", isError=True),
    ]
    write_session(tmp_path / "root" / "deep", "one", tree)
    write_session(tmp_path / "root" / "--tmp-x", "gone", tree)
    found = sessions.read_entries(spark, str(tmp_path / "root"))
    assert [r["ord"] for r in found.orderBy("ord").collect()] == [0, 1, 3, 4, 5]
    rows = sessions.messages(found).orderBy("ord").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("user", "hello"), ("text", "sure"), ("call", ""), ("result", "l1\nl2"), ("user", "other branch"), ("result", "t")]
    assert json.loads(rows[2]["args"]) == {"path": "a.ts", "offset": 2} and rows[3]["text_only"] and not rows[5]["text_only"] and rows[5]["is_error"]
    assert [r["id"] for r in sessions.branch(found).orderBy("depth").collect()] == ["1", "4", "5"]
    leaf = found.select("session").distinct().select("session", F.lit("3").alias("id"))
    assert [r["id"] for r in sessions.branch(found, leaf).orderBy("depth").collect()] == ["1", "2", "3"]


@pytest.mark.parametrize("extra,left", [({"type": "custom", "id": "x"}, 2), ({"type": "custom_message", "id": "x"}, 1), ({"type": "branch_summary", "id": "x"}, 1), (entry("x", "system", "s"), 1), ({"type": "compaction", "id": "x", "firstKeptEntryId": "1"}, 1)])
def test_what_ends_read_evidence(spark, tmp_path, extra, left):
    write_session(tmp_path, "s", [entry("1", "user", "a"), extra, entry("2", "user", "b")])
    assert sessions.read_context(sessions.read_entries(spark, str(tmp_path))).count() == left


def test_compaction_keeps_from_the_first_kept_entry(spark, tmp_path):
    write_session(tmp_path, "s", [entry("1", "user", "a"), entry("2", "user", "b"), {"type": "compaction", "id": "3", "firstKeptEntryId": "2"}, entry("4", "user", "c")])
    found = sessions.read_entries(spark, str(tmp_path))
    assert [r["id"] for r in sessions.context(found).orderBy("ord").collect()] == ["2", "3", "4"]


def test_json_sink_refuses_to_overwrite(spark, tmp_path):
    sessions.write_once(spark.range(2), str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sessions.write_once(spark.range(2), str(tmp_path / "out"))


def held(texts):
    """Facts of the tests' texts: words with an underscore."""
    return set(re.findall(r"\w+_\w+", texts))


def slowly_used(rows, i, candidates, horizon):
    used = 0
    for fact in candidates:
        first = next((r for r in rows[i + 1 : i + 1 + horizon] if fact in held(r[7] if r[2] != "call" else r[6])), None)
        used += first is not None and first[2] != "result"
    return used


def test_sole_sources_at_checkpoints(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        kind = "user" if i % 9 == 0 else rng.choice(["text", "result"])
        text = " ".join(f"fact_{rng.randint(100, 260)}" for _ in range(3)) + (" pad" * (200 if i % 2 else 10) if kind == "result" else "")
        rows.append(("s", i, kind, "user" if kind == "user" else "assistant", f"c{i}" if kind == "result" else None, "bash" if kind == "result" else None, None, text, False, True))
    users = [i for i, r in enumerate(rows) if r[2] == "user"]
    points = users[2:]
    want = {}
    for u in points[:: max(1, -(-len(points) // 8))]:
        for i in range(users[users.index(u) - 1]):
            if rows[i][2] == "result" and len(rows[i][7]) > 596:
                sole = [f for f in held(rows[i][7]) if sum(f in held(r[7]) for r in rows[: u + 1]) == 1]
                want[u, i] = (len(sole), slowly_used(rows, u, sole, 20))
    got = analytics.sole_sources(spark.createDataFrame(rows, COLUMNS), horizon=20).collect()
    assert {(r["checkpoint"], r["ord"]): (r["sole_facts"], r["used_facts"]) for r in got} == want
    assert any(n for n, _ in want.values()) and any(k for _, k in want.values())


def test_facts_of_two_blocks_belong_to_neither(spark):
    lines = [f"step {i} name_{i} both_all {'seen_before' if i == 3 else ''}" for i in range(400)]
    rows = [("s", 0, "user", "user", None, None, None, "seen_before", False, True), ("s", 1, "result", "toolResult", "c", "bash", None, "\n".join(lines), False, True), ("s", 2, "text", "assistant", None, None, None, "name_5 both_all seen_before", False, True)]
    blocks = logs.split_blocks("\n".join(lines))
    assert len(blocks) > 1
    got = {r["block"]: (r["own_facts"], r["used_facts"]) for r in analytics.block_facts(spark.createDataFrame(rows, COLUMNS)).collect()}
    of = {b["id"]: held(b["text"]) for b in blocks}
    want = {}
    for k, facts in of.items():
        mine = [f for f in facts if len(f) >= 5 and f != "seen_before" and not any(f in other for x, other in of.items() if x != k)]
        want[k] = (len(mine), int("name_5" in mine))
    assert got == want


def slow_cover(late, early, min_run):
    """The definition, place by place: blank lines match too, each place takes its longest run."""
    def length(i, j):
        n = 0
        while i + n < len(late) and j + n < len(early) and late[i + n] == early[j + n]:
            n += 1
        return n

    out, i = [], 0
    while i < len(late):
        n, j = max(((length(i, j), -j) for j in range(len(early))), default=(0, 0))
        if n and n >= min_run:
            out.append((i + 1, i + n, -j + 1))
            i += n
        else:
            i += 1
    return out


def test_cover_of_texts_with_blank_and_common_lines():
    rng = random.Random(2)
    for _ in range(300):
        early = [rng.choice(["", "", "a", "b", "c"]) for _ in range(rng.randint(0, 30))]
        at = rng.randint(0, len(early))
        late = [rng.choice(["", "a", "d"]) for _ in range(rng.randint(0, 6))] + early[at:] + early[:at]
        for min_run in (1, 3, 6):
            assert dedupe.cover(late, early, min_run) == slow_cover(late, early, min_run)


def test_content_runs_go_on_over_blank_lines(spark):
    text = "\n".join("" if i % 20 == 0 else f"line {i}" for i in range(200))
    found = dedupe.reads(spark.createDataFrame(session(("user", "go"), ("read", "a", "f.ts", 0, text), ("read", "b", "f.ts", 0, text)), COLUMNS))
    assert [tuple(r)[2:] for r in dedupe.content_runs(found, dedupe.evidence(found)).collect()] == [(1, 1, 200, 1)]


def test_a_message_of_several_parts_is_rounded_once(spark):
    """9 + 1 + 9 characters are five tokens, not three and three."""
    rows = [("s", 1, "user", "user", None, None, None, "123456789", False, True, 1), ("s", 2, "text", "assistant", None, None, None, "123456789", False, True, 2), ("s", 3, "call", "assistant", "c", "read", '{"a":"b"}', "", False, True, 2), ("s", 4, "result", "toolResult", "c", "read", None, "1234", False, True, 4)]
    placed = events.placed(spark.createDataFrame(rows, model.MESSAGE)).orderBy("ord").collect()
    assert [r["upto"] for r in placed] == [3, 6, 8, 9]
    session = replay.Session()
    for r in spark.createDataFrame(rows, model.MESSAGE).orderBy("ord").toPandas().itertuples(index=False):
        session.take(r)
    assert session.upto == 9


def test_a_log_that_cannot_be_written_stops_nothing(spark, tmp_path):
    (tmp_path / "log").write_text("a file, not a folder")
    batch = spark.createDataFrame([("s", 1, "c", "folded", "t1", 1, 9, 3, "kept")], replay.OUTPUT)
    assert replay.originals_first(batch, 0, str(tmp_path / "originals"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "originals")).count() == 1


def test_future_text_and_ranking(spark):
    rows = [("s", 1, "result", "toolResult", "c", "read", None, "seen", False, True, 1), ("s", 2, "text", "assistant", None, None, None, "a", False, True, 2), ("s", 3, "call", "assistant", "d", "read", "{}", "", False, True, 2), ("s", 4, "result", "toolResult", "d", "read", None, "more", False, True, 4), ("s", 5, "user", "user", None, None, None, "b", False, True, 5)]
    got = {r["ord"]: r["future"] for r in analytics.future_text(spark.createDataFrame(rows, model.MESSAGE), 2).collect()}
    assert got == {1: "a\n{}\n", 4: "b"}
    ranks = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, v int")
    assert [r["k"] for r in metrics.top(ranks, "v", 2, "k").collect()] == ["a", "b"]
    assert metrics.markdown(metrics.top(ranks, "v", 1, "k"), "Best") == "## Best\n\n| k | v |\n| --- | --- |\n| a | 2 |\n"
