"""Shared parts of the check SQL: the corpus built again in SQL, and named sub-queries over it."""

from __future__ import annotations

import re

from procatlas.functions import fixed_values as fv
from checks import corpus

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], sql: str) -> None:
    PARTS[name] = (needs, sql)


def with_parts(needs: list[str], body: str, recursive: bool = False) -> str:
    """``WITH`` every part in ``needs`` and what these need, then ``body`` (which may go on with ', x AS (...)')."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for inner in PARTS[name][0]:
            visit(inner)
        order.append(name)

    for name in needs:
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{PARTS[n][1]}\n)" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, ignore_case: bool = True) -> str:
    return q(("(?i)" if ignore_case else "") + pattern)


def words(items: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in items) + ")"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def line_sql(prefix: str) -> str:
    return f"cast(length({prefix}) - length(replace({prefix}, chr(10), '')) + 1 AS integer)"


def matches_sql(source: str, pattern: str, groups: int = 0, keep: str = "object_id", where: str = "true",
                text: str = "definition", flags: str = "(?i)") -> str:
    """Every match with pos, line, hit, prefix (text ahead of it) and g1..gn."""
    pat = q(flags + pattern)
    gs = "".join(f", regexp_extract(hit, {pat}, {n}) AS g{n}" for n in range(1, groups + 1))
    return f"""
SELECT {keep}, pos, hit, prefix, {text}, {line_sql('prefix')} AS line{gs} FROM (
  SELECT {keep}, {text}, cast(i AS integer) AS pos, ms[i] AS hit,
    array_to_string(list_transform(range(1, i + 1), lambda j: CASE WHEN j > 1 THEN ms[j - 1] ELSE '' END || ps[j]), '') AS prefix FROM (
    SELECT {keep}, {text}, ms, regexp_split_to_array({text}, {pat}) AS ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT {keep}, {text}, regexp_extract_all({text}, {pat}) AS ms FROM {source} WHERE {where}) a
    WHERE len(ms) > 0) b) c"""


def part_matches(name: str, source: str, pattern: str, groups: int = 0, keep: str = "object_id",
                 where: str = "true") -> None:
    part(name, [source], matches_sql(source, pattern, groups, keep, where))


def _corpus(suffix: str, snapshot: int) -> None:
    part(f"bodies{suffix}", [], f"""
SELECT k, string_agg(statement, chr(10) ORDER BY {', '.join(corpus.LINE_ORDER)}) AS text FROM (
  SELECT *, {corpus.STATEMENT} AS statement FROM (SELECT {corpus.columns_sql(corpus.STATEMENT_COLUMNS)} FROM lineitem) b
  WHERE {corpus.SNAPSHOT_LINES[snapshot]}) s
GROUP BY k""")
    part(f"objs{suffix}", [f"bodies{suffix}"], f"""
SELECT k AS object_id, cast(d AS integer) AS connection_id, dialect, s AS schema_name, n AS object_name,
  s || '.' || n AS fqn, kind AS object_type, {corpus.HEADER} || chr(10) || text || chr(10) || 'END;' AS definition, seen_at
FROM (SELECT k, text, o_orderdate AS seen_at, {corpus.OBJECT_KIND} AS kind, {corpus.OBJECT_NAME} AS n,
    {corpus.OBJECT_SCHEMA[snapshot]} AS s, {corpus.DIALECT} AS dialect, k % 3 AS d
  FROM bodies{suffix} JOIN orders ON o_orderkey = k WHERE {corpus.SNAPSHOT_ORDERS[snapshot]}) x""")


_corpus("", 1)
_corpus("2", 2)

part("code", ["objs"], "SELECT * FROM objs WHERE object_type <> 'view'")

# -- calls
for _rank, _kind, _pattern, _groups, _conf, _dialects in fv.CALL_PATTERNS:
    part_matches(f"m_{_kind}", "code", _pattern, _groups, "object_id, dialect",
                 f"dialect IN {words(_dialects)}" if _dialects else "true")
_sys = words(fv.SYSTEM_FUNCTIONS)
part("named_exec", ["m_exec"], f"""
SELECT * FROM (SELECT object_id, 1 AS rank, pos, line, 0.9 AS confidence,
  replace(replace(array_to_string(list_filter([g1, g2, g3], lambda g: g <> ''), '.'), '[', ''), ']', '') AS target_name
  FROM m_exec) x WHERE upper(target_name) NOT IN {words(fv.SYSTEM_FUNCTIONS + fv.EXECUTE_SYNTAX_WORDS)}""")
part("named_perform", ["m_perform"], f"""
SELECT object_id, 3 AS rank, pos, line, 0.95 AS confidence, g1 || '.' || g2 AS target_name FROM m_perform
WHERE upper(g2) NOT IN {_sys}""")
part("named_assigned", ["m_assigned"], f"""
SELECT object_id, 4 AS rank, pos, line, 0.85 AS confidence, g1 || '.' || g2 AS target_name FROM m_assigned
WHERE upper(g2) NOT IN {_sys}""")
part("named_bare", ["m_bare"], f"""
SELECT object_id, 5 AS rank, pos, line, 0.7 AS confidence, g1 AS target_name FROM m_bare
WHERE upper(g1) NOT IN {words(fv.SYSTEM_FUNCTIONS + fv.PLSQL_KEYWORDS)} AND length(g1) > 2
  AND left(g1, 2) NOT IN ('v_', 'p_', 'l_') AND left(upper(g1), 3) <> 'SYS'""")


def first_call(sources: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT object_id, rank, pos, line, confidence, target_name FROM {s}" for s in sources)
    return f"""
SELECT object_id, target_name, line, cast(confidence AS double) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id, target_name ORDER BY rank, pos) AS rn FROM ({union}) u) r
WHERE rn = 1"""


part("calls", ["named_exec", "named_perform", "named_assigned", "named_bare"],
     first_call(["named_exec", "named_perform", "named_assigned", "named_bare"]))
part_matches("m_dynamic", "code", fv.DYNAMIC_EXEC_PATTERN)
part_matches("m_linked", "objs", fv.LINKED_SERVER_PATTERN, 4, where="dialect = 'tsql'")
part("linked", ["m_linked"], """
SELECT object_id, target_name, min(line) AS line, cast(0.7 AS double) AS confidence FROM (
  SELECT object_id, line, g1 || '.' || g2 || '.' || g3 || '.' || g4 AS target_name FROM m_linked) x GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY object_id, target_name"))
part("facts", ["calls", "m_dynamic", "linked"], """
SELECT object_id, target_name, 'calls' AS dep_type, line, false AS is_dynamic, confidence FROM calls
UNION ALL SELECT object_id, '<dynamic_sql>', 'calls', line, true, 0.5 FROM m_dynamic
UNION ALL SELECT object_id, target_name, 'references', line, false, confidence FROM linked
  WHERE (object_id, target_name) NOT IN (SELECT (object_id, target_name) FROM calls)""")
part("keymap", ["objs"], """
SELECT connection_id, key, arg_max(object_id, (seen_at, object_id)) AS target_id FROM (
  SELECT connection_id, object_id, seen_at, unnest([fqn, lower(fqn), object_name, lower(object_name)]) AS key FROM objs) k
GROUP BY connection_id, key""")
part("deps", ["facts", "keymap", "objs"], """
SELECT f.*, o.connection_id, coalesce(a.target_id, b.target_id, c.target_id, d.target_id) AS target_id
FROM facts f JOIN objs o USING (object_id)
LEFT JOIN keymap a ON a.connection_id = o.connection_id AND a.key = target_name
LEFT JOIN keymap b ON b.connection_id = o.connection_id AND b.key = lower(target_name)
LEFT JOIN keymap c ON c.connection_id = o.connection_id AND c.key = string_split(target_name, '.')[-1]
LEFT JOIN keymap d ON d.connection_id = o.connection_id AND d.key = lower(string_split(target_name, '.')[-1])""")

# -- lines, statements, accesses
part("src_lines", ["objs"], f"""
SELECT object_id, dialect, object_type, cast(line AS integer) AS line, text, {strip_sql('text')} AS trimmed FROM (
  SELECT object_id, dialect, object_type, unnest(string_split(definition, chr(10))) AS text,
    unnest(range(1, len(string_split(definition, chr(10))) + 1)) AS line FROM objs) x""")
part("stmts", ["src_lines"], f"""
SELECT object_id, any_value(dialect) AS dialect, cast(min(line) AS integer) AS line, string_agg(trimmed, chr(10) ORDER BY line) AS text,
  cast(row_number() OVER (PARTITION BY object_id ORDER BY min(line)) AS integer) AS stmt_no
FROM (SELECT *, sum(CASE WHEN opens OR closes THEN 1 ELSE 0 END) OVER (PARTITION BY object_id ORDER BY line) AS seg FROM (
  SELECT *, regexp_matches(trimmed, {rx(fv.STATEMENT_OPENERS)}) AS opens,
    regexp_matches(trimmed, '(?i)^END\\b') OR upper({strip_sql("rtrim(trimmed, ';')")}) IN {words(fv.CLOSING_LINES)} AS closes
  FROM src_lines WHERE trimmed <> '' AND NOT starts_with(trimmed, '--') AND NOT starts_with(trimmed, '/*')) a) b
WHERE seg > 0 GROUP BY object_id, seg HAVING NOT bool_or(closes)""")
# Accesses as they were planted, not as a pattern finds them.
part("acc", ["bodies", "objs"], f"""
SELECT object_id, connection_id, full_table_name, table_name, operation, cast(min(line) AS integer) AS line,
  left(table_name, 1) IN ('#', '@') OR left(upper(table_name), 4) = 'TEMP' AS is_temp
FROM (SELECT k AS object_id, d, a[1] AS operation, a[2] AS full_table_name, string_split(a[2], '.')[-1] AS table_name,
    head + 1 + coalesce(before, 0) + cast(a[3] AS integer) AS line
  FROM (SELECT k, d, head, before, unnest(list_transform(string_split(planted, '|'), lambda p: string_split(p, '~'))) AS a FROM (
    SELECT s.k, s.d, s.planted, length(definition) - length(replace(definition, chr(10), '')) - length(text) + length(replace(text, chr(10), '')) - 1 AS head,
      sum(lines) OVER (PARTITION BY s.k ORDER BY {', '.join('s.' + c for c in corpus.LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT *, {corpus.ACCESSES} AS planted, {line_sql(corpus.STATEMENT)} AS lines
          FROM (SELECT {corpus.columns_sql(corpus.STATEMENT_COLUMNS)} FROM lineitem) b WHERE {corpus.SNAPSHOT_LINES[1]}) s
    JOIN bodies ON bodies.k = s.k JOIN objs ON object_id = s.k) x WHERE planted <> '') y) z
JOIN objs USING (object_id)
GROUP BY object_id, connection_id, full_table_name, table_name, operation""")

# -- findings and complexity
for _id, _dialect, _pattern, *_rest in fv.SECURITY_RULES:
    part_matches(f"rule_{_id}", "objs", _pattern, where="true" if _dialect == "*" else f"dialect = '{_dialect}'")
part("rule_hits", [f"rule_{r[0]}" for r in fv.SECURITY_RULES], "\nUNION ALL ".join(
    f"SELECT object_id, {i} AS rule_id, {q(sev)} AS severity, {q(kind)} AS finding_type, {q(msg)} AS message, "
    f"{q(adv)} AS recommendation, line FROM rule_{i}"
    for i, _d, _p, sev, kind, msg, adv in fv.SECURITY_RULES))
_c = fv.CREDENTIAL_FINDING
part("cred", ["objs"], f"""
SELECT object_id, 0 AS rule_id, {q(_c[0])} AS severity, {q(_c[1])} AS finding_type, {q(_c[2])} AS message,
  {q(_c[3])} AS recommendation, cast(NULL AS integer) AS line
FROM objs WHERE regexp_matches(definition, {rx(fv.CREDENTIAL_PATTERN)})""")
part("finds", ["rule_hits", "cred"], "SELECT * FROM rule_hits UNION ALL SELECT * FROM cred")
part("block_words", ["objs"], f"""
SELECT object_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (
  SELECT object_id, regexp_extract_all(definition, {rx(fv.BLOCK_WORDS)}) AS ws FROM objs) x""")
part("nesting", ["block_words"], """
SELECT object_id, cast(max(s - least(0, low)) AS integer) AS nesting FROM (
  SELECT *, min(s) OVER (PARTITION BY object_id ORDER BY pos) AS low FROM (
    SELECT *, sum(CASE WHEN upper(word) = 'END' THEN -1 ELSE 1 END) OVER (PARTITION BY object_id ORDER BY pos) AS s FROM block_words) a) b
GROUP BY object_id""")
part("cplx", ["objs", "nesting"], f"""
SELECT object_id, cast(b + 1 AS integer) AS cyclomatic, coalesce(nesting, 0) AS nesting, cast(b AS integer) AS branches,
  cast(l AS integer) AS loops, {line_sql('definition')} AS lines
FROM (SELECT object_id, definition, len(regexp_extract_all(definition, {rx(fv.BRANCH_WORDS)})) AS b,
  len(regexp_extract_all(definition, {rx(fv.LOOP_WORDS)})) AS l FROM objs) x LEFT JOIN nesting USING (object_id)""")
RISK_SQL = "CASE WHEN cyclomatic <= 5 THEN 'low' WHEN cyclomatic <= 10 THEN 'moderate' WHEN cyclomatic <= 20 THEN 'high' ELSE 'critical' END"


# -- parameters, as they were planted
part("params", ["bodies"], f"""
SELECT k AS object_id, cast(i AS integer) AS ordinal, p[1] AS name, p[2] AS data_type, p[3] AS mode, nullif(p[4], '') AS default_value FROM (
  SELECT k, i, string_split(planted[i], '~') AS p FROM (
    SELECT k, planted, unnest(range(1, len(planted) + 1)) AS i FROM (
      SELECT k, string_split({corpus.PARAMETERS}, '|') AS planted FROM (
        SELECT k, {corpus.OBJECT_KIND} AS kind, {corpus.OBJECT_NAME} AS n, {corpus.OBJECT_SCHEMA[1]} AS s, k % 3 AS d
        FROM bodies JOIN orders ON o_orderkey = k WHERE {corpus.SNAPSHOT_ORDERS[1]}) a) b) c) e
WHERE p[1] <> ''""")

# -- variables
for _rank, _kind, _pattern, _groups in fv.VARIABLE_PATTERNS:
    part_matches(f"v_{_kind}", "objs", _pattern, _groups)


def _var(kind: str, name: str, ref: str | None = None, dtype="NULL", target="NULL", proc="NULL", expr="NULL",
         where="true", sub="0", source: str | None = None) -> str:
    rank = next(r for r, k, *_ in fv.VARIABLE_PATTERNS if k == kind)
    return (f"SELECT object_id, {rank} AS rank, pos, {sub} AS sub, {name} AS variable_name, '{ref or kind}' AS reference_type, line, "
            f"{dtype} AS data_type, {target} AS target_variable, {proc} AS target_procedure, {expr} AS expression "
            f"FROM {source or 'v_' + kind} WHERE {where}")


_short = lambda g: f"left({strip_sql(g)}, 80)"
_named = fv.NAMED_ARGUMENT_PATTERN
_proc = "replace(replace(g1, '[', ''), ']', '')"
part("args_named", ["v_exec_named"], f"""
SELECT object_id, pos, line, {_proc} AS proc, unnest(a1) AS callee, unnest(a2) AS local, unnest(range(0, len(a1))) AS sub FROM (
  SELECT *, regexp_extract_all(g2, {rx(_named)}, 1) AS a1, regexp_extract_all(g2, {rx(_named)}, 2) AS a2 FROM v_exec_named) x""")
part("args_pos", ["v_exec_positional"], f"""
SELECT object_id, pos, line, {_proc} AS proc, {strip_sql('unnest(a)')} AS local, unnest(range(0, len(a))) AS sub FROM (
  SELECT *, string_split(g2, ',') AS a FROM v_exec_positional) x""")
part("vars_all", [f"v_{k}" for _, k, _, _ in fv.VARIABLE_PATTERNS] + ["args_named", "args_pos"], "\nUNION ALL ".join([
    _var("parameter_in", "'@' || g1", dtype="g2"), _var("parameter_out", "'@' || g1", dtype="g2"),
    _var("declare", "g1", dtype="g2"),
    _var("set", "g1", expr=_short("g2"), where=f"NOT regexp_matches(right(prefix, {fv.SET_LOOK_BACK}), {rx(fv.UPDATE_WORD)})"),
    _var("select_into", "g2", expr=_short("g1")), _var("where_clause", "g1"), _var("insert_value", "g1"),
    _var("update_set", "g1", where=f"regexp_matches(right(prefix, {fv.UPDATE_SET_LOOK_BACK}), {rx(fv.UPDATE_WORD)})"),
    _var("exec_named", "local", "exec_argument", target="'@' || callee", proc="proc", sub="sub", source="args_named"),
    _var("exec_positional", "local", "exec_argument", proc="proc", sub="sub", source="args_pos"),
    _var("condition", "g1"), _var("return", "g1")]))
part("vars", ["vars_all"], """
SELECT object_id, variable_name, reference_type, line, data_type, target_variable, target_procedure, expression FROM (
  SELECT *, row_number() OVER (PARTITION BY object_id, variable_name, reference_type, line ORDER BY rank, pos, sub) AS rn FROM vars_all) x
WHERE rn = 1""")

# -- comment-bearing documents
part("docs", [], f"""
SELECT doc_id AS object_id, lang, {corpus.COMMENT_PREFIX} || text AS definition FROM documents""")
part("doc_lines", ["docs"], f"""
SELECT object_id, cast(line AS integer) AS line, text, {strip_sql('text')} AS trimmed FROM (
  SELECT object_id, unnest(string_split(definition, chr(10))) AS text,
    unnest(range(1, len(string_split(definition, chr(10))) + 1)) AS line FROM docs) x""")
