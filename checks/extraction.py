"""Registered queries over source texts, each with its check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import register
from checks.sql_base import first_call, line_sql, q, rx, strip_sql, words
from procatlas.functions import fixed_values as fv
from procatlas.operators import document, extract
from checks.workspace import workspace


def _double(df):
    return df.withColumn("confidence", F.col("confidence").cast("double")) if "confidence" in df.columns else df


def _on_objects(fn):
    return lambda spark, sf: _double(fn(workspace(spark, sf).objects))


def _on_docs(fn):
    return lambda spark, sf: fn(workspace(spark, sf).commented)


for _name, _kinds, _part in [("x1_exec_calls", ["exec"], "named_exec"), ("x3_perform_calls", ["perform"], "named_perform"),
                             ("x4_assigned_calls", ["assigned"], "named_assigned"), ("x5_bare_calls", ["bare"], "named_bare")]:
    register(_name, _on_objects(lambda o, k=_kinds: extract.named_calls(o, k)), [_part], first_call([_part]))

register("x2_dynamic_exec", _on_objects(extract.dynamic_calls), ["m_dynamic"], """
SELECT object_id, '<dynamic_sql>' AS target_name, line, cast(0.5 AS double) AS confidence,
  substring(definition, length(prefix) + 1, 100) AS snippet FROM m_dynamic""")

register("x6_system_function_exclusion",
         _on_objects(lambda o: extract.call_matches(o).select("object_id", "rank", "pos", "line", "target_name")),
         ["named_exec", "named_perform", "named_assigned", "named_bare"],
         " UNION ALL ".join(f"SELECT object_id, rank, pos, line, target_name FROM {p}"
                            for p in ("named_exec", "named_perform", "named_assigned", "named_bare")))
register("x7_linked_server_references", _on_objects(extract.linked_server_references), ["linked"], "SELECT * FROM linked")

from checks.sql_base import part_matches  # noqa: E402

for _id, _pattern, _text in fv.DYNAMIC_SQL_PATTERNS:
    part_matches(f"dyn_{_id}", "objs", _pattern)
register("x8_dynamic_sql_census", _on_objects(extract.dynamic_sql_census), [f"dyn_{r[0]}" for r in fv.DYNAMIC_SQL_PATTERNS],
         " UNION ALL ".join(f"SELECT object_id, {i} AS rule_id, {q(t)} AS description, line, "
                            f"substring(definition, length(prefix) + 1, 120) AS snippet FROM dyn_{i}"
                            for i, _, t in fv.DYNAMIC_SQL_PATTERNS))

register("x9_table_accesses", lambda s, sf: workspace(s, sf).accesses, ["acc"], "SELECT * FROM acc")
register("x10_temp_tables",
         lambda s, sf: workspace(s, sf).accesses.groupBy("is_temp").agg(
             F.count(F.lit(1)).alias("accesses"), F.count_distinct("table_name").alias("names")),
         ["acc"], "SELECT is_temp, count(*) AS accesses, count(DISTINCT table_name) AS names FROM acc GROUP BY is_temp")
register("x11_parameters", _on_objects(extract.parameters), ["params"], "SELECT * FROM params")
register("x12_return_types", _on_objects(extract.return_types), ["objs"], "SELECT object_id, nullif(CASE dialect " + " ".join(
    f"WHEN '{d}' THEN regexp_extract(definition, {rx(p)}, 1)" for d, p in fv.RETURN_PATTERNS.items())
    + " END, '') AS return_type FROM objs WHERE object_type = 'function'")
register("x13_object_kinds",
         _on_objects(lambda o: o.select("object_id", extract.object_kind(F.col("definition")).alias("kind"))),
         ["objs"], "SELECT object_id, object_type AS kind FROM objs")
register("x14_rule_scan", _on_objects(extract.rule_findings), ["rule_hits"], "SELECT * FROM rule_hits")
register("x15_credential_scan", _on_objects(lambda o: extract.credential_findings(o).drop("line")), ["cred"],
         "SELECT * EXCLUDE (line) FROM cred")
register("x16_conditional_rules", _on_objects(extract.conditional_findings), ["objs"], " UNION ALL ".join(
    f"SELECT object_id, {i} AS rule_id, {q(sev)} AS severity, {q(kind)} AS finding_type, {q(msg)} AS message, {q(adv)} AS recommendation "
    f"FROM objs WHERE dialect = '{d}' AND regexp_matches(definition, {rx(p)})"
    + (f" AND NOT regexp_matches(definition, {rx(n)})" if n else "")
    + (" AND object_type <> 'view'" if d == "plpgsql" else "")
    for i, d, p, n, sev, kind, msg, adv in fv.CONDITIONAL_RULES))
register("x17_rules_per_dialect",
         lambda s, sf: workspace(s, sf).objects.groupBy("dialect").agg(F.count(F.lit(1)).alias("objects")).join(
             extract.rules_by_dialect(extract.rules(s)).select(
                 "rule_id", F.col("applies_to").alias("dialect"), "severity", "finding_type", "message"), "dialect"),
         ["objs"], "SELECT o.dialect, o.objects, r.* EXCLUDE (rule_dialect) FROM (SELECT dialect, count(*) AS objects FROM objs GROUP BY dialect) o JOIN ("
         + " UNION ALL ".join(f"SELECT {i} AS rule_id, '{d}' AS rule_dialect, {q(s)} AS severity, {q(k)} AS finding_type, {q(m)} AS message"
                              for i, d, _, s, k, m, _ in fv.SECURITY_RULES)
         + ") r ON r.rule_dialect IN ('*', o.dialect)")
register("x18_complexity_counts",
         lambda s, sf: workspace(s, sf).complexity.select("object_id", "cyclomatic", "branches", "loops", "lines"),
         ["cplx"], "SELECT object_id, cyclomatic, branches, loops, lines FROM cplx")
register("x19_nesting_depth", lambda s, sf: workspace(s, sf).complexity.select("object_id", "nesting"),
         ["cplx"], "SELECT object_id, nesting FROM cplx")
register("x20_variable_references", lambda s, sf: workspace(s, sf).variables, ["vars"], "SELECT * FROM vars")
register("x21_argument_mappings", _on_objects(extract.argument_mappings), ["args_named", "args_pos"], """
SELECT object_id, line, proc AS target_procedure, cast(sub + 1 AS integer) AS position, local AS variable_name, '@' || callee AS target_variable FROM args_named
UNION ALL SELECT object_id, line, proc, cast(sub + 1 AS integer), local, NULL FROM args_pos""")
_class = "CASE " + " ".join(
    f"WHEN regexp_matches(trimmed, {rx(p)}) THEN " + (
        "CASE WHEN contains(upper(trimmed), 'RETURN') THEN 'return' ELSE 'error_handler' END" if n == "raise" else q(n))
    for n, p in fv.LINE_CLASSES) + " END"
from checks.sql_base import part  # noqa: E402

part("classed", ["src_lines"], f"""
SELECT object_id, line, trimmed, CASE WHEN trimmed = '' OR starts_with(trimmed, '--') OR starts_with(trimmed, '/*') THEN NULL
  ELSE {_class} END AS node_type FROM src_lines WHERE object_type <> 'view'""")
register("x22_line_classes", _on_objects(extract.flow_lines), ["classed"], """
SELECT object_id, cast(row_number() OVER (PARTITION BY object_id ORDER BY is_end, line) AS integer) AS node_no, line, node_type, label FROM (
  SELECT object_id, 0 AS is_end, line, node_type, left(trimmed, 80) AS label FROM classed WHERE node_type IS NOT NULL
  UNION ALL SELECT object_id, 1, max(line), 'end', 'End' FROM classed GROUP BY object_id) x""")
register("x23_statement_variables",
         _on_objects(lambda o: extract.statement_variables(o).withColumn("variables", F.array_join("variables", ","))),
         ["stmts"], f"""
SELECT object_id, line, string_agg(v, ',' ORDER BY first) AS variables FROM (
  SELECT object_id, line, v, min(i) AS first FROM (
    SELECT object_id, line, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS i FROM (
      SELECT object_id, line, CASE WHEN dialect = 'tsql' THEN regexp_extract_all(text, {rx(fv.AT_VARIABLE)})
        ELSE list_concat(regexp_extract_all(text, {rx(fv.PREFIX_VARIABLE)}, 1), regexp_extract_all(text, {rx(fv.AT_VARIABLE)})) END AS vs
      FROM stmts) a) b GROUP BY object_id, line, v) c
GROUP BY object_id, line""")
register("w7_statement_assembly", _on_objects(extract.statements), ["stmts"], "SELECT object_id, stmt_no, line, text FROM stmts")
_op = "upper(regexp_extract(text, '^(\\w+)', 1))"
register("w6_statement_runs", _on_objects(extract.statement_runs), ["stmts"], f"""
SELECT object_id, cast(min(line) AS integer) AS line, operation, cast(count(*) AS integer) AS n_statements,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list(written)), lambda v: v <> ''))), ','), '') AS variables_written
FROM (SELECT *, sum(CASE WHEN operation = prev THEN 0 ELSE 1 END) OVER (PARTITION BY object_id ORDER BY stmt_no) AS run FROM (
  SELECT object_id, stmt_no, line, {_op} AS operation, lag({_op}, 1, '') OVER (PARTITION BY object_id ORDER BY stmt_no) AS prev,
    CASE WHEN {_op} = 'DECLARE' THEN CASE WHEN len(regexp_extract_all(text, {rx(fv.DECLARED_VARIABLE)})) > 0
        THEN regexp_extract_all(text, {rx(fv.DECLARED_VARIABLE)}, 1) ELSE regexp_extract_all(text, {rx(fv.AT_VARIABLE)}) END
      ELSE regexp_extract_all(text, {rx(fv.SET_ASSIGNMENT)}, 1) END AS written
  FROM stmts) a) b
WHERE operation IN ('DECLARE', 'SET') GROUP BY object_id, run, operation""")

# Nesting as numbers of a recursive walk over the lines: an independent form of the fold.
register("w8_block_paths", _on_objects(extract.block_paths), ["src_lines"], f"""
, marked AS MATERIALIZED (SELECT object_id, line, trimmed, regexp_extract_all(text, {rx(fv.BLOCK_WORDS)}) AS ws FROM src_lines WHERE object_type <> 'view'),
toks AS MATERIALIZED (SELECT object_id, line, w, row_number() OVER (PARTITION BY object_id ORDER BY line, j) AS n FROM (
  SELECT object_id, line, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM marked) t),
walk AS (
  SELECT object_id, cast(0 AS bigint) AS n, cast([] AS varchar[]) AS open FROM (SELECT DISTINCT object_id FROM marked) d
  UNION ALL
  SELECT k.object_id, k.n, CASE WHEN upper(k.w) = 'END' THEN walk.open[1:len(walk.open) - 1] ELSE list_append(walk.open, upper(k.w)) END
  FROM walk JOIN toks k ON k.object_id = walk.object_id AND k.n = walk.n + 1)
SELECT m.object_id, m.line, array_to_string(list_filter(w.open, lambda b: b <> 'BEGIN'), '>') AS path, cast(len(w.open) AS integer) AS depth FROM (
  SELECT object_id, line, trimmed, (SELECT count(*) FROM toks k WHERE k.object_id = marked.object_id AND k.line < marked.line) AS n FROM marked) m
JOIN walk w ON w.object_id = m.object_id AND w.n = m.n
WHERE regexp_matches(m.trimmed, '(?i)^(?:EXEC|EXECUTE|CALL|PERFORM|INSERT|UPDATE|DELETE|MERGE|TRUNCATE|SELECT)\\b')""", recursive=True)
