"""Column functions over message text, with the string semantics of the logs' producer.

Lengths are UTF-16 units, ``\\b`` is ASCII, white space is the ECMAScript set,
and an empty string has no lines although splitting it gives one piece.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, word edges and line patterns of the log format.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NOTABLE = (
    r"\b(?:errors?|Errors?|ERRORS?|ERR!|FAIL|FAILED|failed|Exception|Traceback|panic|fatal|warning|Warning|WARN"
    r"|Expected|Received|expected|Tests?:|passed|Caused by|unmet)\b|[✗×✕✖✘❌⚠]|\.(?:ts|tsx|js|py|go|rs):\d+"
)
OUTCOME = r"(?i)\b(?:passed|failed|Tests?:)\b"
PRIORITY_SUMMARY = r"^(?:Found \d+ errors?|Test Files|Tests?:)|\b\d+ (?:failed|errors?)\b"
PRIORITY_FAILURE = (
    r"\b(?:FAIL|FAILED|failed|Error|ERROR|error|ERR!|Exception|Traceback|panic|fatal|FATAL|Expected|Received"
    r"|Caused by|unmet)\b|[✗×✕✖✘❌]"
)
PRIORITY_PLACE = r"\.(?:ts|tsx|js|py|go|rs):\d+"
PRIORITY_TESTS = r"\bTests?:"
FOOTER = r"\n\n\[(?:Showing lines \d+-\d+ of \d+[^\n]*|\d+ more lines in file\. Use offset=\d+ to continue\.)\]\z"
FACT = (
    r"(?:[\w@~.-]*\/[\w@.\/-]+|[A-Za-z_][\w-]*\.[\w.-]*[A-Za-z]\w*|\b[A-Z][A-Z0-9_]{3,}\b|\b(?:TS|E|ERR_)\d{3,}\b"
    r"|\b\d{4,}\b|\b[a-z]+[A-Z]\w{5,}\b|\b\w+_\w+\b)"
)
REFERENCE = r"[A-Za-z_$][\w$./:-]*"
IDENTIFIER = r"(?:\.{0,2}\/)?[A-Za-z_$][\w$./:-]*"
REQUEST_TERM = r"`[^`]+`|[A-Za-z_][\w./:-]{3,}"


def java(pattern: str) -> str:
    """The pattern for Java: ASCII word edges."""
    return pattern.replace(r"\b", EDGE)


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the length, rounded up."""
    return F.ceil(units(text) / 4).cast("bigint")


def pieces(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(pieces(text)))


def size_class(lines: Column) -> Column:
    return F.when(lines <= 3, "tiny").when(lines <= 30, "short").when(lines <= 150, "medium").when(lines <= 400, "long").otherwise("very long")


def head_units(text: Column, n: int) -> Column:
    """The first n UTF-16 units; the usual text has one a character."""
    plain = F.substring(text, 1, n)
    exact = F.decode(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * n), "UTF-16BE")
    return F.when(units(text) == F.length(text), plain).otherwise(exact)


def truncate(text: Column, n: int) -> Column:
    return F.when(units(text) <= n, text).otherwise(F.concat(head_units(text, n - 1), F.lit("…")))


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{WS}+", ""), rf"{WS}+\z", "")


def blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(rf"[^{WS[1:-1]}]"), F.lit(False))


def normal_command(command: Column) -> Column:
    return F.regexp_replace(trim(command), rf"{WS}+", " ")


def arg(args: Column, name: str) -> Column:
    """A JSON argument as text, null if absent."""
    return F.get_json_object(args, f"$.{name}")


def summarize_call(name: Column, args: Column) -> Column:
    """One line that names a tool call."""
    a = lambda k, default="undefined": F.coalesce(arg(args, k), F.lit(default))
    offset, limit = arg(args, "offset").cast("double"), arg(args, "limit").cast("double")
    truthy = (F.coalesce(offset, F.lit(0.0)) != 0) | (F.coalesce(limit, F.lit(0.0)) != 0)
    first = F.coalesce(offset, F.lit(1.0)).cast("bigint")
    last = (first + F.coalesce(limit, F.lit(0.0)).cast("bigint")).cast("string")
    span = F.when(truthy, F.concat(F.lit(" (lines "), first.cast("string"), F.lit("-"), last, F.lit(")"))).otherwise("")
    return (
        F.when(name == "bash", F.concat(F.lit("bash: "), truncate(normal_command(a("command", "")), 160)))
        .when(name == "read", F.concat(F.lit("read "), a("path"), span))
        .when(name.isin("grep", "find"), F.concat(name, F.lit(' "'), a("pattern"), F.lit('" in '), a("path", ".")))
        .when(name == "ls", F.concat(F.lit("ls "), a("path", ".")))
        .when(name.isin("edit", "write"), F.concat(name, F.lit(" "), a("path")))
        .otherwise(F.concat(name, F.lit(": "), truncate(args, 160)))
    )


def related_key(name: Column, args: Column) -> Column:
    """What a call looks at: a command or its runner and script, a file, a search; null for other tools."""
    a = lambda k, default="undefined": F.coalesce(arg(args, k), F.lit(default))
    command = normal_command(a("command", ""))
    runner = command.rlike(r"^(?:npm|pnpm|yarn|npx|bun)\s")
    return (
        F.when((name == "bash") & runner, F.concat(F.lit("bash:"), F.substring_index(command, " ", 2)))
        .when(name == "bash", F.concat(F.lit("bash:"), command))
        .when(name.isin("read", "edit", "write"), F.concat(F.lit("file:"), F.regexp_replace(a("path"), r"^\./", "")))
        .when(name == "grep", F.concat(F.lit("grep:"), a("pattern"), F.lit(":"), a("path", ".")))
        .when(name.isin("ls", "find"), F.concat(name, F.lit(":"), a("path", "."), F.lit(":"), a("pattern", "")))
    )


def outcome_line(output: Column, is_error: Column) -> Column:
    """The line that says what happened, and how many more there are.

    Patterns run over the text once, from the line's start to its first match,
    without lines in between; none crosses a line's end, and the white space
    that trimming takes is no part of a word.
    """
    line = lambda p: trim(F.nullif(F.regexp_extract(output, java(p), 0), F.lit("")))
    at = lambda p: rf"(?md)^[^\n]*?(?:{p})[^\n]*"
    full = rf"[^{WS[1:-1]}][^\n]*+"
    # cheap tests first: what the pattern finds holds one of these
    hinted = F.exists(F.array(F.lower(output)), lambda low: low.contains("passed") | low.contains("failed") | low.contains("test"))
    told = F.when(hinted, line(at(rf"(?i)(?=[pft]){OUTCOME}")))
    pick = F.coalesce(F.when(is_error, line(at(NOTABLE))), told, line(full))

    def shown(x: Column) -> Column:
        more = F.when(x["size"] > 1, F.concat(F.lit(" (+"), (x["size"] - 1).cast("string"), F.lit(" lines)"))).otherwise("")
        return F.when(x["size"] == 0, "(no output)").otherwise(F.concat(truncate(x["line"], 160), more))

    # an array of one, so that the line is looked for once
    return F.get(F.transform(F.array(F.struct(pick.alias("line"), F.regexp_count(output, F.lit(full)).alias("size"))), shown), 0)


def line_priority(line: Column) -> Column:
    return (
        F.when(has(line, PRIORITY_SUMMARY), 4)
        .when(has(line, PRIORITY_FAILURE), 3)
        .when(has(line, PRIORITY_PLACE) | has(line, PRIORITY_TESTS), 2)
        .otherwise(1)
    )


def shape(line: Column) -> Column:
    return F.regexp_replace(line, r"\d+", "#")


def hidden_references(text: Column) -> Column:
    """The first six distinct identifier-like spellings of at most 80 units."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    named = lambda t: (F.length(t) <= 80) & (t.rlike("[a-z][A-Z]") | t.rlike("[A-Z]+_[A-Z]+") | t.rlike(r"\w[/.]\w"))
    return F.slice(F.filter(found, named), 1, 6)


def reference_note(text: Column) -> Column:
    refs = hidden_references(text)
    return F.when(F.size(refs) > 0, F.concat(F.lit(" Hidden references (partial): "), F.array_join(refs, ", "), F.lit("."))).otherwise("")


def footer(text: Column) -> Column:
    """The continuation notice at the end of a limited read."""
    return F.regexp_extract(text, FOOTER, 0)


def body(text: Column) -> Column:
    return F.left(text, F.length(text) - F.length(footer(text)))


def read_offset(args: Column) -> Column:
    """The first line asked for: 1 if absent, null unless a JSON whole number of at least 1."""
    raw = F.regexp_extract(F.coalesce(args, F.lit("{}")), r'"offset"\s*:\s*("?[^,}]*)', 1)
    number = F.when(raw.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\s*$"), F.trim(raw).cast("double"))
    given = arg(args, "offset").isNotNull()
    return F.when(~given, F.lit(1).cast("bigint")).when((number >= 1) & (number == F.floor(number)), number.cast("bigint"))


def words(text: Column) -> Column:
    """Distinct lower-case words, camel case split."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def query_identifiers(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(IDENTIFIER), F.lit(0))
    cut = F.transform(found, lambda t: F.regexp_replace(t, r"[.:/-]+\z", ""))
    return F.array_distinct(F.filter(cut, lambda t: t.rlike(r"[a-z][A-Z]|_|[/.]")))


def request_terms(request: Column) -> Column:
    found = F.regexp_extract_all(request, F.lit(REQUEST_TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.replace(t, F.lit("`"), F.lit("")))))


def facts(text: Column) -> Column:
    """Distinctive tokens: paths, dotted and underscored names, codes, long numbers."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(java(FACT)), F.lit(0)))
    return F.filter(found, lambda f: F.length(f).between(5, 120) & ~f.rlike("^(?:https?|node_modules)"))
