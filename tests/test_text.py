import pytest
from pyspark.sql import functions as F

from trailmark.functions import text as X


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,tokens,lines", [("", 0, 0), ("a", 1, 1), ("abcd\n", 2, 2), ("🤦a", 1, 1), ("🤦🤦🤦", 2, 1), ("a\n\nb", 1, 3)])
def test_lengths(spark, text, tokens, lines):
    assert value(spark, F.struct(X.tokens(F.col("t")), X.line_count(F.col("t"))), t=text) == (tokens, lines)


@pytest.mark.parametrize("n,name", [(3, "tiny"), (4, "short"), (30, "short"), (31, "medium"), (150, "medium"), (151, "long"), (400, "long"), (401, "very long")])
def test_size_class(spark, n, name):
    assert spark.range(1).select(X.size_class(F.lit(n))).first()[0] == name


def test_truncate_counts_utf16_units(spark):
    assert value(spark, X.truncate(F.col("t"), 5), t="abcde") == "abcde"
    assert value(spark, X.truncate(F.col("t"), 5), t="abcdef") == "abcd…"
    assert value(spark, X.truncate(F.col("t"), 5), t="🤦🤦🤦") == "🤦🤦…"


def test_command_space_is_unicode(spark):
    assert value(spark, X.normal_command(F.col("t")), t="﻿ npm \t test ") == "npm test"


@pytest.mark.parametrize(
    "name,args,summary,key",
    [
        ("bash", '{"command":" npm  test --x"}', "bash: npm test --x", "bash:npm test"),
        ("bash", '{"command":"make all"}', "bash: make all", "bash:make all"),
        ("read", '{"path":"./a.ts","offset":5}', "read ./a.ts (lines 5-5)", "file:a.ts"),
        ("read", '{"path":"a.ts","limit":9}', "read a.ts (lines 1-10)", "file:a.ts"),
        ("read", '{"path":"a.ts"}', "read a.ts", "file:a.ts"),
        ("grep", '{"pattern":"x"}', 'grep "x" in .', "grep:x:."),
        ("ls", "{}", "ls .", "ls:.:"),
        ("edit", '{"path":"b"}', "edit b", "file:b"),
        ("other", '{"a":1}', 'other: {"a":1}', None),
    ],
)
def test_call_summary_and_key(spark, name, args, summary, key):
    row = spark.createDataFrame([(name, args)], "n string, a string").select(X.summarize_call(F.col("n"), F.col("a")), X.related_key(F.col("n"), F.col("a"))).first()
    assert tuple(row) == (summary, key)


@pytest.mark.parametrize("args,offset", [("{}", 1), ('{"offset":7}', 7), ('{"offset":0}', None), ('{"offset":2.5}', None), ('{"offset":"3"}', None), ('{"offset":-1}', None), ('{"offset":4.0}', 4)])
def test_read_offset_is_a_whole_json_number(spark, args, offset):
    assert value(spark, X.read_offset(F.col("a")), a=args) == offset


def test_outcome_line(spark):
    out = lambda t, e: spark.createDataFrame([(t, e)], "t string, e boolean").select(X.outcome_line(F.col("t"), F.col("e"))).first()[0]
    assert out("", False) == "(no output)"
    assert out("start\n12 passed\nError: x", False) == "12 passed (+2 lines)"
    assert out("start\nError: x\n12 passed", True) == "Error: x (+2 lines)"
    assert out("only", False) == "only"


@pytest.mark.parametrize("line,rank", [("Tests: 3", 4), ("found 2 errors", 4), ("FAIL a", 3), ("✖ no", 3), ("see a.ts:4", 2), ("all Tests: here", 2), ("plain", 1), ("caféERR", 1)])
def test_line_priority(spark, line, rank):
    assert value(spark, X.line_priority(F.col("t")), t=line) == rank


def test_word_edges_are_ascii(spark):
    assert value(spark, X.has(F.col("t"), r"\bFAIL\b"), t="éFAILé") is True
    assert value(spark, X.has(F.col("t"), r"\bFAIL\b"), t="xFAIL") is False


def test_footer_only_at_the_very_end(spark):
    note = "\n\n[Showing lines 1-3 of 9 (limit)]"
    assert value(spark, X.body(F.col("t")), t="a\nb" + note) == "a\nb"
    assert value(spark, X.footer(F.col("t")), t="a\nb" + note + "\n") == ""


def test_words_terms_and_references(spark):
    assert value(spark, X.words(F.col("t")), t="getUser getUSER naïve_x 12") == ["get", "user", "naïve", "x", "12"]
    assert value(spark, X.request_terms(F.col("t")), t="see `a b` and src/Main.ts now") == ["a b", "src/main.ts"]
    assert value(spark, X.query_identifiers(F.col("t")), t="find getUser, foo/bar. plain MAX_SIZE:") == ["getUser", "foo/bar", "MAX_SIZE"]
    assert value(spark, X.hidden_references(F.col("t")), t="getUser plain a/b getUser MAX_SIZE x.y b/c d/e f/g") == ["getUser", "a/b", "MAX_SIZE", "x.y", "b/c", "d/e"]
    assert set(value(spark, X.facts(F.col("t")), t="src/a.ts x.py TS2345 https://a.b 1234 node_modules/x my_var")) == {"src/a.ts", "TS2345", "my_var", "//a.b"}
