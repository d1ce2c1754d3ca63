"""The same queries in DuckDB SQL, for the comparison of results.

Session queries start from the common table expressions of ``synth.SQL``. RE2
has ASCII word edges and no lookaround, so patterns are written for it here.
"""

from __future__ import annotations

from ..functions import shell as S
from ..functions import text as X
from ..sources.synth import SQL


def _q(pattern: str) -> str:
    """A pattern as an SQL string, for RE2."""
    return "'" + pattern.replace(r"\z", r"$").replace("'", "''") + "'"


def _tok(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4.0) AS BIGINT)"


def _distinct(x: str) -> str:
    """The first occurrence of each element, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


RESULTS = SQL + ", results AS (SELECT *, json_extract_string(args, '$.path') AS path, json_extract_string(args, '$.command') AS command, CAST(json_extract(args, '$.offset') AS BIGINT) AS first FROM messages WHERE kind = 'result')"
LINES = RESULTS + """, log_lines AS (
  SELECT session, ord, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM results WHERE tool = 'bash'
)"""
PLACED = RESULTS + """, whole AS (
  SELECT session, msg, max(ord) AS ord, ceil(length(string_agg(CASE WHEN kind = 'call' THEN args ELSE text END, chr(10) ORDER BY ord)) / 4.0) AS tokens
  FROM messages GROUP BY session, msg
), placed AS (
  SELECT m.*, CAST(sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER v AS BIGINT) AS epoch, CAST(sum(coalesce(w.tokens, 0)) OVER v AS BIGINT) AS upto
  FROM messages m LEFT JOIN whole w USING (session, ord) WINDOW v AS (PARTITION BY session ORDER BY ord)
), tool_events AS (
  SELECT r.*, p.epoch, p.upto, row_number() OVER (PARTITION BY r.session ORDER BY r.ord) - 1 AS seq FROM results r JOIN placed p USING (session, ord)
)"""
PAIRS = PLACED + f""", reads AS (SELECT * FROM tool_events WHERE tool = 'read'),
pairs AS (
  SELECT * FROM (
    SELECT l.session, l.ord, e.ord AS e_ord, e.call_id AS e_call, l.upto - {_tok('l.text')} - e.upto AS age,
           row_number() OVER (PARTITION BY l.session, l.ord ORDER BY e.ord DESC) AS rank
    FROM reads l JOIN reads e ON l.session = e.session AND l.path = e.path AND l.epoch = e.epoch AND e.ord < l.ord AND l.upto - {_tok('l.text')} - e.upto <= 12000
    WHERE len(string_split(l.text, chr(10))) >= 60) WHERE rank <= 4
)"""
RUNS = PAIRS + """, body AS (
  SELECT session, ord, first, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM reads
), matches AS (
  SELECT p.session, p.ord, p.rank, p.e_ord, a.i, a.i - row_number() OVER (PARTITION BY p.session, p.ord, p.rank ORDER BY a.i) AS island
  FROM pairs p JOIN body a ON a.session = p.session AND a.ord = p.ord
  JOIN body b ON b.session = p.session AND b.ord = p.e_ord AND b.first + b.i = a.first + a.i AND b.line = a.line
), runs AS (
  SELECT session, ord, rank, e_ord, min(i) + 1 AS "from", max(i) + 1 AS "to" FROM matches GROUP BY session, ord, rank, e_ord, island HAVING count(*) >= 30
), chosen AS (SELECT * FROM runs QUALIFY rank = min(rank) OVER (PARTITION BY session, ord))"""
_REFS = "[A-Za-z_$][A-Za-z0-9_$./:-]*"


def _refs(text: str) -> str:
    named = f"list_filter(regexp_extract_all({text}, '{_REFS}'), lambda v: length(v) <= 80 AND (regexp_matches(v, '[a-z][A-Z]') OR regexp_matches(v, '[A-Z]+_[A-Z]+') OR regexp_matches(v, '\\w[/.]\\w')))"
    return f"({_distinct(named)})[1:6]"


FOLDED = RUNS + f""", per AS (
  SELECT session, ord, e_ord, list({{'f': "from", 't': "to"}} ORDER BY "from") AS rs, sum("to" - "from" + 1) AS folded_lines FROM chosen GROUP BY ALL
), parts AS (
  SELECT p.*, r.text, r.path, r.first, r.seq, e.call_id AS source, string_split(r.text, chr(10)) AS lines, 't' || (r.seq + 1) AS alias
  FROM per p JOIN reads r USING (session, ord) JOIN reads e ON e.session = p.session AND e.ord = p.e_ord
), hidden AS (
  SELECT *, len(lines) AS total_lines,
    array_to_string(list_transform(rs, lambda x: array_to_string(lines[x.f:x.t], chr(10))), chr(10)) AS gone,
    flatten(list_transform(rs, lambda x, i: list_concat(lines[CASE WHEN i = 1 THEN 1 ELSE rs[i - 1].t + 1 END:x.f - 1],
      ['… [file lines ' || (first + x.f - 1) || '-' || (first + x.t - 1) || ' unchanged; context_recall with id "' || alias || '"] …']))) AS body
  FROM parts
), noted AS (SELECT *, {_refs('gone')} AS refs FROM hidden), rendered AS (
  SELECT session, ord, CAST(folded_lines AS BIGINT) AS folded_lines, total_lines, {_tok('text')} AS original_tokens,
    array_to_string(list_concat(['[folded-context] ' || path || ': file lines ' || first || '-' || (first + total_lines - 1) || '. Folded ' || folded_lines || '/' || total_lines
      || ' file lines matching read ' || source || ' still in context. Full output: context_recall with id "' || alias || '".'
      || CASE WHEN len(refs) > 0 THEN ' Hidden references (partial): ' || array_to_string(refs, ', ') || '.' ELSE '' END || ' Search original chunks with context_recall query.'],
      body, lines[rs[-1].t + 1:]), chr(10)) AS out
  FROM noted
), folds AS (SELECT *, {_tok('out')} AS kept_tokens FROM rendered WHERE {_tok('out')} <= original_tokens * (1 - 0.3))"""

_LITERAL = r"regexp_replace(regexp_replace(regexp_replace(command, '^cd [A-Za-z0-9_./-]+ && ', ''), ' 2>&1$', ''), '^([A-Za-z_][A-Za-z0-9_]*=[^ ]* )+', '')"
KIND = f"""CASE WHEN NOT regexp_full_match({_LITERAL}, '[A-Za-z0-9_./: =-]+') THEN NULL
  WHEN regexp_matches({_LITERAL}, '^(npm|pnpm|yarn|bun) (run )?test( |$)') OR regexp_matches({_LITERAL}, '^(cargo|go) test( |$)') THEN 'test'
  WHEN regexp_matches({_LITERAL}, '^cargo (check|clippy)( |$)') OR regexp_matches({_LITERAL}, '^go vet( |$)') THEN 'diagnostic'
  WHEN regexp_matches({_LITERAL}, '^(cargo|go) build( |$)') THEN 'build' END"""
_OLD = r"regexp_replace(trim(command), '^cd\s+[\w./~-]+\s*&&\s*', '')"
OLD_KIND = f"CASE WHEN {_OLD} = '' OR regexp_matches({_OLD}, {_q(S.OLD_VIEWER)}) OR regexp_matches({_OLD}, {_q(S.OLD_PIPE)}) OR NOT regexp_matches({_OLD}, {_q(S.OLD_TOOL)}) THEN NULL " + " ".join(
    f"WHEN regexp_matches({_OLD}, {_q(p)}) THEN '{k}'" for p, k in S.OLD_KINDS
) + " END"


def _case(column: str, rules: tuple, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(p)}) THEN '{k}'" for p, k in rules) + f" ELSE '{otherwise}' END"


def _any(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q('(?i)' + pattern)})"


def _flags() -> str:
    from ..functions import logs as L

    blank, frame, caused, failure = "trim(line) = ''", _any("line", L.STACK_FRAME), _any("line", L.CAUSED), _any("line", L.FAILURE)
    return LINES + f""", flags AS (
  SELECT *, {failure} AS failure, {_any('line', L.WARNING)} AS warning, regexp_matches(line, {_q(L.LOCATION)}) AS place, {_any('line', L.SUMMARY)} AS summary, {blank} AS blank,
    NOT {blank} AND ({frame} OR {caused}) AS start, NOT {blank} AND ({frame} OR {caused} OR regexp_matches(line, '^\\s')) AS cont,
    {failure} OR {_any('line', L.STACK_START)} OR {frame} AS seed, {_any('line', L.WHOLE_TRACE)} AS whole FROM log_lines
), reaches AS (
  SELECT *, CASE WHEN whole THEN coalesce(min(CASE WHEN blank THEN n END) OVER later, 1000000000) - 1
    WHEN lead(start) OVER w THEN coalesce(min(CASE WHEN NOT cont THEN n END) OVER later, 1000000000) - 1 ELSE n END AS reach,
    bool_or(failure) OVER (PARTITION BY session, ord ORDER BY n ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS near
  FROM flags WINDOW w AS (PARTITION BY session, ord ORDER BY n), later AS (PARTITION BY session, ord ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), marked AS (SELECT *, coalesce(max(CASE WHEN seed THEN reach END) OVER (PARTITION BY session, ord ORDER BY n) >= n, false) AS stack FROM reaches)
SELECT session, ord, CASE WHEN stack THEN 'stack trace' WHEN failure THEN 'failure' WHEN warning THEN 'warning' WHEN place THEN 'diagnostic location' WHEN summary THEN 'summary' WHEN near THEN 'failure context' ELSE 'none' END AS reason,
  count(*) AS n, CAST(sum(n) AS BIGINT) AS places FROM marked GROUP BY ALL"""


def _priority(t: str) -> str:
    hit = lambda p: f"regexp_matches({t}, {_q(p)})"
    return f"CASE WHEN {hit(X.PRIORITY_SUMMARY)} THEN 4 WHEN {hit(X.PRIORITY_FAILURE)} THEN 3 WHEN {hit(X.PRIORITY_PLACE)} OR {hit(X.PRIORITY_TESTS)} THEN 2 ELSE 1 END"


_PART = lambda m, d=100: f"((event_id * {m}) % {d} / {float(d)})"
READINGS = f"""readings AS (
  SELECT event_id, event_type, (['KEEP', 'TRUNCATE', 'DROP', 'UNCERTAIN'])[event_id % 4 + 1] AS choice, {_PART(7)} AS confidence, {_PART(13)} AS p_keep, {_PART(17)} AS p_truncate, {_PART(29)} AS p_drop,
    {_PART(31)} AS needed, {_PART(37)} AS asked, {_PART(41)} AS durable_s, {_PART(43)} AS uniq, {_PART(47)} AS sup, {_PART(53)} AS noise, event_id % 3 = 0 AS excerpted FROM events
), safe AS (
  SELECT *, CASE WHEN p_truncate > p_keep THEN 'TRUNCATE' ELSE 'KEEP' END AS kt,
    CASE choice WHEN 'UNCERTAIN' THEN 'KEEP' WHEN 'DROP' THEN CASE WHEN p_drop >= 0.7 AND confidence >= 0.5 THEN 'DROP' WHEN p_truncate > p_keep THEN 'TRUNCATE' ELSE 'KEEP' END ELSE choice END AS safe FROM readings
), decided AS (
  SELECT *, CASE WHEN safe = 'DROP' THEN CASE WHEN needed >= 0.5 OR asked >= 0.5 THEN CASE WHEN excerpted THEN 'TRUNCATE' ELSE 'KEEP' END
      WHEN durable_s >= 0.5 OR (uniq >= 0.5 AND sup < 0.5) THEN 'TRUNCATE' ELSE 'DROP' END
    WHEN safe = 'KEEP' AND excerpted AND noise >= 0.7 THEN 'TRUNCATE' ELSE safe END AS composite,
    CASE WHEN choice = 'UNCERTAIN' THEN 'KEEP' WHEN choice <> 'DROP' THEN choice WHEN p_drop < 0.8 OR confidence < 0.7 OR needed >= 0.5 OR asked >= 0.5 THEN kt
      WHEN durable_s >= 0.8 THEN 'TRUNCATE' ELSE 'DROP' END AS guarded FROM safe
)"""

_RATIO = lambda a, b: f"round(coalesce(CAST(count(*) FILTER ({a}) AS DOUBLE) / nullif(count(*) FILTER ({b}), 0), 'NaN'::DOUBLE), 9)"
_ALL = "true"
_MARKED = RESULTS + f""", marked AS (
  SELECT *, {_tok('text')} AS tok, row_number() OVER (PARTITION BY session, tool, args, md5(text) ORDER BY ord) > 1 AS again,
    CASE WHEN tool = 'read' THEN lag(text) OVER (PARTITION BY session, tool, coalesce(path, '') ORDER BY ord) END AS before FROM results
)"""
_SUM = lambda c, x="tok": f"CAST(coalesce(sum({x}) FILTER ({c}), 0) AS BIGINT)"
_LONG_LINES = "list_transform(string_split(text, chr(10)), lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT))"
_REPEATED = f"CAST(list_sum({_LONG_LINES}) - list_sum(list_transform(list_distinct(string_split(text, chr(10))), lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT))) AS BIGINT)"
_ELIGIBLE = f"(tool = 'bash' AND NOT (len(string_split(text, chr(10))) < 150 AND tok < 3000) AND (NOT is_error OR (regexp_matches(text, '(?m)^\\s*PASS\\s+') AND regexp_matches(text, '\\b(?:FAIL|ERROR|Error|FAILED)\\b'))) AND ({KIND}) IS NOT NULL)"

ORACLES = {
    "inv20_text_measures": f"""
        SELECT doc_id, {_tok('text')} AS tokens, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines,
          CASE WHEN lines <= 3 THEN 'tiny' WHEN lines <= 30 THEN 'short' WHEN lines <= 150 THEN 'medium' WHEN lines <= 400 THEN 'long' ELSE 'very long' END AS size_class,
          CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS preview FROM documents""",
    "inv25_call_summaries": RESULTS + """
        SELECT CASE tool WHEN 'bash' THEN 'bash: ' || command ELSE 'read ' || path || ' (lines ' || first || '-' || first || ')' END AS summary,
          CASE WHEN tool = 'read' THEN 'file:' || path WHEN regexp_matches(command, '^(?:npm|pnpm|yarn|npx|bun)\\s') THEN 'bash:' || array_to_string(string_split(command, ' ')[1:2], ' ') ELSE 'bash:' || command END AS key,
          count(*) AS n FROM results GROUP BY ALL""",
    "inv27_outcome_lines": RESULTS + f""", picked AS (
          SELECT is_error, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM results
        ), chosen AS (
          SELECT l, coalesce(CASE WHEN is_error THEN list_filter(l, lambda x: regexp_matches(x, {_q(X.NOTABLE)}))[1] END, list_filter(l, lambda x: regexp_matches(x, {_q(X.OUTCOME)}))[1], l[1]) AS p FROM picked
        ) SELECT CASE WHEN len(l) = 0 THEN '(no output)' ELSE CASE WHEN length(p) <= 160 THEN p ELSE substr(p, 1, 159) || '…' END || CASE WHEN len(l) > 1 THEN ' (+' || (len(l) - 1) || ' lines)' ELSE '' END END AS outcome,
          count(*) AS n FROM chosen GROUP BY ALL""",
    "inv28_line_priorities": LINES + f"""
        SELECT regexp_replace(trim(line), '\\d+', '#', 'g') AS shape, count(*) AS n, CAST(max({_priority('trim(line)')}) AS BIGINT) AS priority, max(regexp_matches(trim(line), {_q(X.NOTABLE)})) AS notable
        FROM log_lines GROUP BY ALL""",
    "inv31_hidden_references": RESULTS + f" SELECT tool, array_to_string({_refs('text')}, ', ') AS refs, count(*) AS n FROM results GROUP BY ALL",
    "inv35_document_words": f"""
        SELECT doc_id, len(list_distinct(regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+'))) AS words,
          len(list_filter(list_distinct(regexp_extract_all(text, {_q(X.FACT)})), lambda f: length(f) BETWEEN 5 AND 120 AND NOT regexp_matches(f, '^(?:https?|node_modules)'))) AS facts FROM documents""",
    "inv37_request_terms": f"""
        WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, {_q(X.REQUEST_TERM)}), lambda x: lower(replace(x, '`', ''))) AS a,
          list_filter(list_transform(regexp_extract_all(text, {_q(X.IDENTIFIER)}), lambda x: regexp_replace(x, '[.:/-]+$', '')), lambda x: regexp_matches(x, '[a-z][A-Z]|_|[/.]')) AS b FROM conversations)
        SELECT conv_id, turn, array_to_string({_distinct('a')}, ' ') AS terms, array_to_string({_distinct('b')}, ' ') AS identifiers FROM t""",
    "inv41_command_kinds": RESULTS + f" SELECT command, count(*) AS n, {KIND} AS kind, {OLD_KIND} AS old_kind FROM results WHERE tool = 'bash' GROUP BY command",
    "inv62_tool_events": PLACED + " SELECT session, ord, tool, args, epoch, upto, seq FROM tool_events",
    "inv63_evidence_pairs": PAIRS + " SELECT session, ord, e_ord, CAST(age AS BIGINT) AS age, rank FROM pairs",
    "inv64_matched_runs": RUNS + ' SELECT session, ord, e_ord, "from" AS run_from, "to" AS run_to FROM chosen',
    "inv65_content_runs": PAIRS + """, body AS (
          SELECT session, ord, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM reads
        ), matches AS (
          SELECT p.session, p.ord, p.rank, a.i, b.i AS j, a.i - row_number() OVER (PARTITION BY p.session, p.ord, p.rank, b.i - a.i ORDER BY a.i) AS island
          FROM pairs p JOIN body a ON a.session = p.session AND a.ord = p.ord JOIN body b ON b.session = p.session AND b.ord = p.e_ord AND b.line = a.line AND a.line <> ''
        ) SELECT session, ord, rank, min(i) + 1 AS run_from, max(i) + 1 AS run_to, min(j) + 1 AS run_e_from FROM matches GROUP BY session, ord, rank, j - i, island HAVING count(*) >= 30""",
    "inv73_relations": PLACED + """, keyed AS (
          SELECT session, seq, tool, is_error, text, CASE WHEN tool = 'read' THEN 'file:' || path WHEN regexp_matches(command, '^(?:npm|pnpm|yarn|npx|bun)\\s') THEN 'bash:' || array_to_string(string_split(command, ' ')[1:2], ' ') ELSE 'bash:' || command END AS key FROM tool_events
        ), newest AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY session, key ORDER BY seq DESC) <= 6)
        SELECT a.session, CASE WHEN a.text = b.text AND a.is_error = b.is_error THEN 'identical' WHEN a.tool <> b.tool THEN 'other tool' WHEN a.is_error AND NOT b.is_error THEN 'now succeeds' WHEN NOT a.is_error AND b.is_error THEN 'now fails' ELSE 'changed' END AS relation, count(*) AS n
        FROM keyed a JOIN newest b ON a.session = b.session AND a.key = b.key AND b.seq > a.seq GROUP BY ALL""",
    "inv88_stack_regions": _flags(),
    "inv92_key_runs": LINES + """, k AS (SELECT *, regexp_extract(trim(line), '^[A-Za-z]+') AS kind FROM log_lines),
        c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND n > 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY session, ord ORDER BY n)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY session, ord ORDER BY n) AS run FROM c), s AS (SELECT session, ord, run, kind, count(*) AS size FROM r GROUP BY ALL)
        SELECT kind, size, count(*) AS runs FROM s GROUP BY ALL""",
    "inv101_idle_gaps": SQL + """, g AS (SELECT session, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY session ORDER BY ord) AS gap FROM messages)
        SELECT session, count(*) AS gaps, count(*) FILTER (gap >= 300) AS cold, CAST(max(gap) AS BIGINT) AS longest FROM g WHERE gap >= 60 GROUP BY session""",
    "inv102_checkpoints": SQL + """, u AS (SELECT session, ord, row_number() OVER (PARTITION BY session ORDER BY ord) - 3 AS i FROM messages WHERE kind = 'user'),
        v AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY session) / 8.0)) AS step FROM u WHERE i >= 0) SELECT session, ord FROM v WHERE i % step = 0""",
    "inv104_seen_savings": FOLDED + f""", total AS (SELECT session, count(*) AS reads, CAST(sum({_tok('text')}) AS BIGINT) AS read_tokens FROM reads GROUP BY session),
        done AS (SELECT session, count(*) AS collapsed, CAST(sum(original_tokens - kept_tokens) AS BIGINT) AS saved FROM folds GROUP BY session)
        SELECT session, reads, read_tokens, coalesce(collapsed, 0) AS collapsed, coalesce(saved, 0) AS saved FROM total LEFT JOIN done USING (session)""",
    "inv105_reread_census": _MARKED + f"""
        SELECT tool, count(*) AS results, {_SUM(_ALL)} AS tokens, count(*) FILTER (again) AS repeats, {_SUM('again')} AS repeat_tokens, count(*) FILTER (before = text) AS same_reads, {_SUM('before = text')} AS same_tokens,
          count(*) FILTER (before <> text) AS changed_reads, {_SUM('before <> text')} AS changed_tokens FROM marked GROUP BY tool""",
    "inv107_session_census": RESULTS + f""", c AS (
          SELECT tool, {_tok('text')} AS tok, tool = 'bash' AND len(string_split(text, chr(10))) >= 150 AND NOT regexp_matches(command, {_q(S.VIEWERS.replace('(?=', '(?:'))}) AND NOT (
            len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 20 AND len(list_filter(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_matches(x, {_q(S.CODE_LINE)}))) / len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 0.3) AS fit FROM results
        ) SELECT tool, count(*) AS results, {_SUM(_ALL)} AS tokens, count(*) FILTER (fit) AS eligible, {_SUM('fit')} AS eligible_tokens FROM c GROUP BY tool""",
    "inv107_role_tokens": SQL + f" SELECT role, count(*) AS messages, CAST(sum({_tok('text')}) AS BIGINT) AS tokens FROM messages WHERE kind <> 'call' GROUP BY role",
    "inv108_output_profile": RESULTS + f""", f AS (SELECT *, {_tok('text')} AS tok FROM results), g AS (
          SELECT *, CASE WHEN tool = 'bash' THEN {_case("coalesce(command, '')", S.PROFILE_KINDS, 'bash/other')} ELSE tool END AS output, {_REPEATED} AS rep, regexp_matches(text, '(?i)\\[Showing |output truncated') AS cut, {_ELIGIBLE} AS fit FROM f
        ) SELECT output, count(*) AS n, {_SUM(_ALL)} AS tokens, count(*) FILTER (tok >= 3000) AS long, count(*) FILTER (is_error) AS errors, CAST(sum(rep) AS BIGINT) AS repeated_line_tokens, count(*) FILTER (cut) AS truncated, count(*) FILTER (fit) AS eligible
        FROM g GROUP BY output""",
    "inv108_long_exclusions": RESULTS + f" SELECT {_case('command', S.EXCLUSIONS, 'other unrecognized or guarded')} AS reason, count(*) AS n FROM results WHERE tool = 'bash' AND {_tok('text')} >= 3000 GROUP BY ALL",
    "inv108_repeated_lines": f"SELECT doc_id, {_REPEATED} AS tokens FROM documents",
    "inv109_read_inventory": PLACED + f""", f AS (
          SELECT *, {_tok('text')} AS tok, lag(text) OVER w AS prior, lag(epoch) OVER w AS prior_epoch FROM tool_events WHERE tool = 'read' WINDOW w AS (PARTITION BY session, path, first ORDER BY ord)
        ) SELECT {_case('path', S.READ_KINDS, 'other')} AS kind, count(*) AS reads, {_SUM(_ALL)} AS tokens, count(*) FILTER (tok >= 3000) AS long_reads, {_SUM('tok >= 3000')} AS long_tokens,
          count(*) FILTER (prior = text) AS repeat_reads, {_SUM('prior = text')} AS repeat_tokens, count(*) FILTER (prior = text AND prior_epoch < epoch) AS cross_reads, {_SUM('prior = text AND prior_epoch < epoch')} AS cross_tokens,
          0::BIGINT AS unbounded_reads, 0::BIGINT AS unbounded_tokens, count(*) FILTER (regexp_matches(text, '(?i)\\[Showing |output truncated')) AS truncated FROM f GROUP BY ALL""",
    "inv110_classifier_coverage": RESULTS + f""", c AS (SELECT {_tok('text')} AS tok, {OLD_KIND} AS old, {KIND} AS new FROM results WHERE tool = 'bash')
        SELECT count(*) AS results, count(*) FILTER (tok >= 3000) AS long_results, count(old) AS old_classified, count(new) AS new_classified, count(*) FILTER (new IS NOT NULL AND old IS NULL) AS newly,
          count(*) FILTER (new IS NOT NULL AND old IS NULL AND tok >= 3000) AS newly_long, count(*) FILTER (old IS NOT NULL AND new IS NULL) AS no_longer FROM c""",
    "inv111_confusion": """
        SELECT CAST(t.truth AS VARCHAR) AS truth, count(*) FILTER (l.toxic = 0) AS pred_0, count(*) FILTER (l.toxic = 1) AS pred_1 FROM (VALUES (0), (1)) t(truth) LEFT JOIN labels l ON l.quality = t.truth GROUP BY t.truth""",
    "inv112_metric_summary": f"""
        WITH r AS (SELECT doc_id, lang AS category, CASE WHEN toxic = 1 THEN 'DROP' WHEN quality = 1 THEN 'KEEP' ELSE 'TRUNCATE' END AS truth,
            CASE WHEN toxic = 1 THEN ['DROP'] WHEN doc_id % 2 = 0 THEN ['KEEP', 'TRUNCATE'] ELSE ['KEEP'] END AS ok, doc_id % 4 = 0 AS critical,
            CASE WHEN doc_id % 11 = 0 THEN 'UNCERTAIN' WHEN doc_id % 5 = 0 THEN 'DROP' WHEN doc_id % 3 = 0 THEN 'TRUNCATE' ELSE 'KEEP' END AS pred, {_tok('text')} AS tokens
          FROM labels JOIN documents USING (doc_id)), m AS (SELECT *, list_contains(ok, 'DROP') AS may FROM r)
        SELECT category, count(*) AS n, {_RATIO('pred = truth', _ALL)} AS accuracy, {_RATIO('list_contains(ok, pred)', _ALL)} AS lenient_accuracy, {_RATIO("truth = 'KEEP' AND pred = 'KEEP'", "truth = 'KEEP'")} AS keep_recall,
          {_RATIO("truth <> 'DROP' AND pred <> 'DROP'", "truth <> 'DROP'")} AS retention, {_RATIO("critical AND pred = 'DROP'", 'critical')} AS critical_false_drop_rate, {_RATIO("NOT may AND pred = 'DROP'", 'NOT may')} AS false_drop_rate,
          {_RATIO("truth = 'TRUNCATE' AND pred = 'TRUNCATE'", "truth = 'TRUNCATE'")} AS truncate_accuracy, {_RATIO("may AND pred = 'DROP'", "pred = 'DROP'")} AS drop_precision, {_RATIO("truth = 'DROP' AND pred = 'DROP'", "truth = 'DROP'")} AS drop_recall,
          {_RATIO("pred = 'UNCERTAIN'", _ALL)} AS uncertain_rate,
          round(CAST(sum(CASE pred WHEN 'DROP' THEN tokens WHEN 'TRUNCATE' THEN greatest(0, tokens - 40) ELSE 0 END) AS DOUBLE) / sum(tokens), 9) AS token_savings,
          coalesce(string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (critical AND pred = 'DROP'), '') AS critical_false_drops
        FROM m GROUP BY category""",
    "inv113_majority_votes": """
        WITH c AS (SELECT user_id AS "user", event_type AS pred, count(*) AS votes FROM events GROUP BY ALL), u AS (SELECT user_id AS "user", count(DISTINCT event_type) = 1 AS unanimous FROM events GROUP BY ALL)
        SELECT "user", pred, votes, unanimous FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY votes DESC, list_position(['click', 'view', 'error', 'signup', 'purchase'], pred)) AS r FROM c) JOIN u USING ("user") WHERE r = 1""",
    "inv114_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY event_type",
    "inv115_floor_quantiles": """
        WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, min(value) FILTER (i = floor(n * 0.5)) AS p50, min(value) FILTER (i = floor(n * 0.9)) AS p90, min(value) FILTER (i = floor(n * 0.99)) AS p99 FROM s GROUP BY event_type""",
    "inv119_threshold_sweep": f"""
        WITH {READINGS}, grid AS (SELECT d.d AS "drop", c.c AS conf FROM (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9)) d(d), (VALUES (0.5::DOUBLE), (0.7)) c(c))
        SELECT "drop", conf, count(*) FILTER (choice = 'DROP' AND p_drop >= "drop" AND confidence >= conf) AS dropped, count(*) FILTER (choice = 'DROP' AND p_drop >= "drop" AND confidence >= conf AND needed >= 0.5) AS regret,
          round(avg(needed) FILTER (choice = 'DROP' AND p_drop >= "drop" AND confidence >= conf), 6) AS mean_needed FROM readings, grid GROUP BY ALL""",
    "inv120_regret_cuts": f"""
        WITH {READINGS} SELECT event_type, choice, CAST(excerpted AS VARCHAR) AS excerpted, count(*) AS n, count(*) FILTER (guarded = 'DROP' AND needed >= 0.5) AS regret FROM decided GROUP BY GROUPING SETS ((event_type), (choice), (excerpted), ())""",
    "inv123_telemetry": """
        WITH l AS (SELECT CAST(user_id AS VARCHAR) AS session, CASE event_type WHEN 'click' THEN 'seen' WHEN 'error' THEN 'sieve' WHEN 'view' THEN 'recall' ELSE 'label' END AS kind, event_id % 2 = 0 AS acted,
          CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS f, event_id % 400 AS t FROM events)
        SELECT session, count(*) FILTER (kind = 'seen' AND acted) AS collapsed, count(*) FILTER (kind = 'sieve' AND acted) AS shortened, CAST(coalesce(sum(greatest(0, f - t)) FILTER (acted AND kind IN ('seen', 'sieve')), 0) AS BIGINT) AS saved,
          count(*) FILTER (kind = 'sieve') AS evaluations, count(*) FILTER (kind = 'recall') AS recalls FROM l GROUP BY session""",
    "inv126_notable_lines": LINES + f""", f AS (SELECT session, ord, n, trim(line) AS t, regexp_replace(trim(line), '\\d+', '#', 'g') AS shape FROM log_lines WHERE regexp_matches(trim(line), {_q(X.NOTABLE)})),
        g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session, ord, shape ORDER BY n) <= 2), h AS (SELECT session, ord, n, t AS text, CAST({_priority('t')} AS BIGINT) AS priority FROM g)
        SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session, ord ORDER BY priority DESC, n) <= 16""",
    "inv127_recall_reads": RESULTS + f""", o AS (SELECT session, call_id AS alias, 'read ' || path || ' (lines ' || first || '-' || first || ')' AS summary, string_split(text, chr(10)) AS lines FROM results WHERE tool = 'read'),
        cut AS (SELECT session, alias, summary, lines, unnest(generate_series(1, len(lines), 24)) AS f FROM o), d AS (SELECT session, alias, summary, f, least(f + 23, len(lines)) AS t, array_to_string(lines[f:least(f + 23, len(lines))], chr(10)) AS text FROM cut),
        scored AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')), ['v100', 'edited', 'compute'])) AS score FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, alias, f) AS rank, CAST(ceil(length('[context_recall ' || alias || '] Historical ' || summary || ': output lines ' || f || '-' || t || chr(10) || text) / 4.0) AS BIGINT) AS tok FROM scored WHERE score > 0),
        u AS (SELECT *, sum(tok) OVER (PARTITION BY session ORDER BY rank) AS used FROM r WHERE rank >= 2)
        SELECT session, alias, f AS chunk_from, CAST(score AS BIGINT) AS score, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 800""",
    "inv138_folded_reads": FOLDED + " SELECT session, ord, folded_lines, CAST(total_lines AS BIGINT) AS total_lines, original_tokens, kept_tokens, md5(out) AS digest FROM folds",
    "inv162_shadow_replay": FOLDED + " SELECT session, ord, folded_lines, original_tokens, kept_tokens, md5(out) AS digest FROM folds",
    "inv144_policies": f"WITH {READINGS} SELECT choice AS raw, safe, composite, guarded, count(*) AS n FROM decided GROUP BY ALL",
    "inv146_hybrid_policies": PLACED + f""", keyed AS (
          SELECT *, CAST(substr(call_id, 2) AS BIGINT) AS event_id, CASE WHEN tool = 'read' THEN 'file:' || path WHEN regexp_matches(command, '^(?:npm|pnpm|yarn|npx|bun)\\s') THEN 'bash:' || array_to_string(string_split(command, ' ')[1:2], ' ') ELSE 'bash:' || command END AS key FROM tool_events
        ), facts AS (
          SELECT *, max(seq) OVER (PARTITION BY session, tool, key) > seq AS superseded, max(seq) OVER (PARTITION BY session, tool, key, md5(text), is_error) > seq AS exact_repeat, false AS durable,
            CASE WHEN is_error AND coalesce(max(CASE WHEN NOT is_error THEN seq END) OVER (PARTITION BY session, key), -1) > seq THEN 'DROP' WHEN tool = 'read' AND max(seq) OVER (PARTITION BY session, key) > seq THEN 'DROP'
              WHEN tool = 'bash' AND NOT is_error AND max(seq) OVER (PARTITION BY session, key) > seq THEN 'DROP' WHEN len(string_split(text, chr(10))) > 150 THEN 'TRUNCATE' ELSE 'KEEP' END AS rule FROM keyed
        ), {READINGS}
        SELECT tool, durable, superseded, exact_repeat, rule, CASE WHEN exact_repeat THEN 'DROP' WHEN guarded = 'DROP' AND durable AND NOT superseded THEN 'TRUNCATE' ELSE guarded END AS hybrid, count(*) AS n
        FROM facts JOIN decided USING (event_id) GROUP BY ALL""",
}

ORACLES["inv132_top_sessions"] = f"SELECT * FROM ({ORACLES['inv104_seen_savings']}) ORDER BY saved DESC, session LIMIT 5"
ORACLES["inv132_top_tools"] = f"SELECT * FROM ({ORACLES['inv107_session_census']}) ORDER BY tokens DESC, tool LIMIT 10"
ORACLES["inv118_hidden_blocks"] = """
WITH blocks AS (SELECT event_id // 5 AS output, event_id % 400 + 1 AS tokens, ((event_id * 37) % 100) / 100.0 AS p, event_id % 7 = 0 AS needed FROM events),
per AS (
  SELECT d AS drop, output, count(*) FILTER (p < d) AS h, coalesce(sum(tokens) FILTER (p < d), 0) AS h_tokens, sum(tokens) AS all_tokens, count(*) FILTER (needed) AS n, count(*) FILTER (needed AND p < d) AS n_hidden
  FROM blocks, (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.5]) AS d) GROUP BY d, output
), marked AS (SELECT *, h > 0 AND h_tokens >= all_tokens * 0.3 AS done FROM per)
SELECT CAST(drop AS DOUBLE) AS drop, count(*) AS outputs, count(*) FILTER (done) AS rewritten, CAST(coalesce(sum(h) FILTER (done), 0) AS BIGINT) AS hidden_blocks, CAST(coalesce(sum(h_tokens) FILTER (done), 0) AS BIGINT) AS hidden_tokens,
       CAST(sum(n) AS BIGINT) AS needed_blocks, CAST(coalesce(sum(n_hidden) FILTER (done), 0) AS BIGINT) AS needed_hidden, count(*) FILTER (done AND n_hidden > 0) AS bad_outputs
FROM marked GROUP BY drop"""
ORACLES["inv122_write_time"] = f"""
WITH met AS (
  SELECT quality = 1 AS keep, {_tok('text')} AS tokens, list_filter(string_split(text, chr(10))[1:3], lambda x: x <> '') AS keys, doc_id % 3 <> 0 AS trimmed, substr(text, 1, 400) AS kept
  FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL
)
SELECT count(*) AS calls, count(*) FILTER (NOT keep) AS may_trim, count(*) FILTER (NOT keep AND trimmed) AS trimmed, count(*) FILTER (keep) AS must_keep, count(*) FILTER (keep AND trimmed) AS false_trims,
       CAST(coalesce(sum(len(keys)) FILTER (NOT keep AND trimmed), 0) AS BIGINT) AS key_lines, CAST(coalesce(sum(len(list_filter(keys, lambda x: contains(kept, x)))) FILTER (NOT keep AND trimmed), 0) AS BIGINT) AS key_lines_kept,
       CAST(sum(tokens) AS BIGINT) AS tokens_before, CAST(sum(CASE WHEN trimmed THEN {_tok('kept')} ELSE tokens END) AS BIGINT) AS tokens_after
FROM met"""
ORACLES["inv103_future_text"] = SQL + """, whole AS (
  SELECT session, msg, max(ord) AS ord, bool_or(kind = 'result') AS is_result, string_agg(CASE kind WHEN 'call' THEN args WHEN 'result' THEN '' ELSE text END, chr(10) ORDER BY ord) AS said
  FROM messages GROUP BY session, msg
), ahead AS (SELECT *, coalesce(string_agg(said, chr(10)) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), '') AS future FROM whole)
SELECT session, ord, md5(future) AS digest FROM ahead WHERE is_result"""
ORACLES["inv125_would_save"] = """
WITH newest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id DESC) AS place, (['DROP', 'TRUNCATE', 'KEEP'])[event_id % 3 + 1] AS decision, event_id % 400 AS tokens FROM events
)
SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS calls, count(*) FILTER (decision = 'DROP') AS drops, count(*) FILTER (decision = 'TRUNCATE') AS truncations,
       CAST(sum(CASE decision WHEN 'DROP' THEN greatest(0, tokens - 40) WHEN 'TRUNCATE' THEN greatest(0, tokens - 150) ELSE 0 END) AS BIGINT) AS would_save
FROM newest WHERE place = 1 GROUP BY user_id"""
ORACLES["inv73_later_relations"] = PLACED + """, keyed AS (
  SELECT session, seq, tool, CASE WHEN tool = 'read' THEN 'file:' || path WHEN regexp_matches(command, '^(?:npm|pnpm|yarn|npx|bun)\\s') THEN 'bash:' || array_to_string(string_split(command, ' ')[1:2], ' ') ELSE 'bash:' || command END AS key FROM tool_events
), newest AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY session, key ORDER BY seq DESC) <= 6)
SELECT a.session, CASE WHEN b.tool IN ('edit', 'write') THEN 'the same file was modified later' WHEN a.tool = 'read' AND b.tool = 'read' THEN 'the same file was read again later'
       WHEN a.tool = 'bash' THEN 'the same command was run again later' ELSE 'the same lookup was repeated later' END AS relation, count(*) AS n
FROM keyed a JOIN newest b ON a.session = b.session AND a.key = b.key AND b.seq > a.seq GROUP BY ALL"""
ORACLES["inv121_misjudgements"] = """
WITH rows AS (
  SELECT lang AS category, CAST(doc_id AS VARCHAR) AS key, CASE WHEN toxic = 1 THEN 'DROP' WHEN quality = 1 THEN 'KEEP' ELSE 'TRUNCATE' END AS truth,
         CASE WHEN doc_id % 11 = 0 THEN 'UNCERTAIN' WHEN doc_id % 5 = 0 THEN 'DROP' WHEN doc_id % 3 = 0 THEN 'TRUNCATE' ELSE 'KEEP' END AS pred,
         CASE WHEN toxic = 1 THEN ['DROP'] WHEN doc_id % 2 = 0 THEN ['KEEP', 'TRUNCATE'] ELSE ['KEEP'] END AS acceptable, doc_id % 4 = 0 AS critical
  FROM labels JOIN documents USING (doc_id)
)
SELECT category, key, truth, pred, critical AND pred = 'DROP' AS critical_drop, count(*) AS n FROM rows WHERE NOT list_contains(acceptable, pred) GROUP BY ALL"""
