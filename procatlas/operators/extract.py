"""Facts read out of source texts.

Every function takes objects (``object_id``, ``dialect``, ``object_type``, ``definition``), one row
per object, and is a narrow pass over the texts: matches are found, ordered and freed of duplicates
inside the row, so extraction needs no shuffle.  ``keep`` names object columns to carry along, which
saves joining facts back to objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.functions import fixed_values as fv
from procatlas.functions.matching import (
    START, SEP, STOP, all_matches, first_of_each, has, java_pattern, let, line_numbers, newlines, occurrences, scan,
    strip,
)
from procatlas.operators.access import is_temp_table, table_accesses  # noqa: F401
from procatlas.operators.signature import parameters  # noqa: F401

CONFIDENCE = "decimal(3,2)"


def _bodies(objects: DataFrame) -> DataFrame:
    """Views carry no calls, parameters or control flow."""
    return objects.where(F.col("object_type") != "view")


def _rows(objects: DataFrame, facts: Column, keep) -> DataFrame:
    return objects.select(*keep, F.explode(facts).alias("_f")).select(*keep, "_f.*")


def _joined(groups: Column) -> Column:
    named = F.filter(groups, lambda g: g != "")
    return F.translate(F.array_join(named, "."), "[]", "")


def _all(arrays: list[Column]) -> Column:
    """One array out of several; an array guarded by a false condition is null and costs nothing."""
    return F.flatten(F.array_compact(F.array(*arrays)))


# -- calls ---------------------------------------------------------------------------------------

ID = ("object_id",)


def _call_array(kinds: list[str] | None = None) -> Column:
    """Call matches of a text that survive the name filters, all patterns in one pass."""
    text, found = F.col("definition"), []
    for rank, kind, pattern, groups, confidence, dialects in fv.CALL_PATTERNS:
        if kinds and kind not in kinds:
            continue
        searched = has(text, pattern)
        if dialects:
            searched = F.col("dialect").isin(dialects) & searched
        hits = F.transform(all_matches(text, pattern, groups), _call_row(rank, confidence))
        found.append(F.when(searched, F.filter(hits, _is_call(kind))))
    return _all(found)


def _call_row(rank: int, confidence: float):
    return lambda m: F.struct(
        _joined(m["g"]).alias("target_name"), F.lit(rank).alias("rank"), m["pos"].alias("pos"), m["line"].alias("line"),
        F.lit(confidence).cast(CONFIDENCE).alias("confidence"), F.lit("calls").alias("dep_type"))


def _is_call(kind: str):
    """Names that are calls.  The word lists are fixed and short, so they are literals in the plan."""
    def test(m: Column) -> Column:
        name = F.upper(m["target_name"])
        if kind == "exec":
            return ~name.isin(fv.SYSTEM_FUNCTIONS + fv.EXECUTE_SYNTAX_WORDS)
        last = F.substring_index(name, ".", -1)
        if kind == "bare":
            return (~last.isin(fv.SYSTEM_FUNCTIONS + fv.PLSQL_KEYWORDS) & ~m["target_name"].rlike("^(?:v_|p_|l_)")
                    & ~last.startswith("SYS") & (F.length(name) > 2))
        return ~last.isin(fv.SYSTEM_FUNCTIONS)
    return test


def call_matches(objects: DataFrame, kinds: list[str] | None = None, keep=ID) -> DataFrame:
    """Every call match: target_name, rank, pos, line, confidence."""
    return _rows(_bodies(objects), _call_array(kinds), keep).drop("dep_type")


def named_calls(objects: DataFrame, kinds: list[str] | None = None, keep=ID) -> DataFrame:
    """First match per (object, target) in pattern order."""
    return _rows(_bodies(objects), first_of_each(_call_array(kinds), ["target_name"]), keep).drop("rank", "pos", "dep_type")


def dynamic_calls(objects: DataFrame, keep=ID) -> DataFrame:
    """EXEC of a variable: one row per match, with the first 100 characters from the match on."""
    found = all_matches(F.col("definition"), fv.DYNAMIC_EXEC_PATTERN, after=100)
    return _rows(_bodies(objects).where(has(F.col("definition"), fv.DYNAMIC_EXEC_PATTERN)), found, keep).select(
        *keep, F.lit(fv.DYNAMIC_TARGET).alias("target_name"), "line",
        F.lit(0.5).cast(CONFIDENCE).alias("confidence"), F.col("after").alias("snippet"))


def _linked_array() -> Column:
    """Four-part names of a T-SQL text."""
    text = F.col("definition")
    hits = F.transform(all_matches(text, fv.LINKED_SERVER_PATTERN, 4), lambda m: F.struct(
        F.array_join(m["g"], ".").alias("target_name"), F.lit(9).alias("rank"), m["pos"].alias("pos"),
        m["line"].alias("line"), F.lit(0.7).cast(CONFIDENCE).alias("confidence"), F.lit("references").alias("dep_type")))
    return F.when((F.col("dialect") == "tsql") & has(text, fv.LINKED_SERVER_PATTERN), hits)


def linked_server_references(objects: DataFrame, keep=ID) -> DataFrame:
    """Four-part names in T-SQL texts, first per name."""
    return _rows(objects, first_of_each(_linked_array(), ["target_name"]), keep).drop("rank", "pos", "dep_type")


def dependencies(objects: DataFrame, keep=ID) -> DataFrame:
    """All dependency facts of a text: named calls, linked-server references and dynamic calls.

    A linked-server name ranks last, so one already found as a call stays a call.
    """
    text, body = F.col("definition"), F.col("object_type") != "view"
    found = first_of_each(_all([F.when(body, _call_array()), _linked_array()]), ["target_name"])
    named = F.transform(found, lambda m: F.struct(
        m["target_name"].alias("target_name"), m["dep_type"].alias("dep_type"), m["line"].alias("line"),
        m["confidence"].alias("confidence"), F.lit(False).alias("is_dynamic"), F.lit(None).cast("string").alias("snippet")))
    dynamic = F.transform(all_matches(text, fv.DYNAMIC_EXEC_PATTERN, after=100), lambda m: F.struct(
        F.lit(fv.DYNAMIC_TARGET).alias("target_name"), F.lit("calls").alias("dep_type"), m["line"].alias("line"),
        F.lit(0.5).cast(CONFIDENCE).alias("confidence"), F.lit(True).alias("is_dynamic"), m["after"].alias("snippet")))
    return _rows(objects, _all([named, F.when(body & has(text, fv.DYNAMIC_EXEC_PATTERN), dynamic)]), keep)


def dynamic_sql_census(objects: DataFrame) -> DataFrame:
    """Four dynamic-SQL shapes, one row per match, with a 120-character snippet."""
    text = F.col("definition")

    def row(rule: int, description: str):
        return lambda m: F.struct(F.lit(rule).alias("rule_id"), F.lit(description).alias("description"),
                                  m["line"].alias("line"), m["after"].alias("snippet"))

    arrays = [F.when(has(text, pattern), F.transform(all_matches(text, pattern, after=120), row(rule, description)))
              for rule, pattern, description in fv.DYNAMIC_SQL_PATTERNS]
    return objects.select("object_id", F.explode(_all(arrays)).alias("m")).select("object_id", "m.*")


# -- statements and table accesses ----------------------------------------------------------------

_IN_LINE = r"[^\S\n]*"  # white space within one line


def statement_array(text: Column) -> Column:
    """``array<struct<line,text>>``: statements of a text.

    A control word at line start opens a statement, END and ``)`` lines close it, blank and comment
    lines are skipped.  Openers and closers are marked by whole-text replacements; splitting on the
    marks gives the statements, so lines are grouped without a window.
    """
    opener = "(?m)^" + _IN_LINE + fv.STATEMENT_OPENERS.removeprefix(r"^\s*")
    bare = F.regexp_replace(text, java_pattern("(?m)^" + _IN_LINE + r"(?:--|/\*).*$"), "")
    closed = F.regexp_replace(
        bare, java_pattern("(?m)^" + _IN_LINE + r"(?:END\b|\)" + _IN_LINE + ";*" + _IN_LINE + "$)"), START + STOP + "$0")
    marked = F.regexp_replace(closed, java_pattern(opener), START + "$0")

    def cut_up(m: Column) -> Column:
        pieces = F.split(m, START, -1)
        return let(line_numbers(m), lambda at: F.transform(
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
            lambda piece, i: F.struct(F.get(at, i).alias("line"), piece.alias("text"))))

    opened = F.filter(let(marked, cut_up), lambda s: ~s["text"].startswith(STOP))
    return F.transform(opened, lambda s: F.struct(
        s["line"].alias("line"), strip(F.regexp_replace(s["text"], r"\s*\n\s*", "\n")).alias("text")))


def statements(objects: DataFrame) -> DataFrame:
    """object_id, stmt_no, line, text."""
    return objects.select("object_id", F.posexplode(statement_array(F.col("definition"))).alias("i", "s")).select(
        "object_id", (F.col("i") + 1).alias("stmt_no"), F.col("s.line").alias("line"), F.col("s.text").alias("text"))


def _clean_name(name: Column) -> Column:
    return F.translate(name, "[]", "")


def statement_runs(objects: DataFrame) -> DataFrame:
    """Adjacent DECLARE (or SET) statements as one row with the variables they write."""
    def written(op: Column, text: Column) -> Column:
        declared = F.regexp_extract_all(text, F.lit(java_pattern(fv.DECLARED_VARIABLE)), 1)
        named = F.regexp_extract_all(text, F.lit(java_pattern(fv.AT_VARIABLE)), 0)
        assigned = F.regexp_extract_all(text, F.lit(java_pattern(fv.SET_ASSIGNMENT)), 1)
        return F.when(op == "DECLARE", F.when(F.size(declared) > 0, declared).otherwise(named)).otherwise(assigned)

    def op_of(s: Column) -> Column:
        return F.upper(F.regexp_extract(s["text"], r"^(\w+)", 1))

    def encode(all_statements: Column):
        def one(s: Column, i: Column) -> Column:
            same = (i > 0) & (op_of(F.get(all_statements, i - 1)) == op_of(s))
            return F.concat(
                F.when(same & op_of(s).isin("DECLARE", "SET"), F.lit(STOP)).otherwise(F.lit(START)),
                s["line"].cast("string"), F.lit(SEP), op_of(s), F.lit(SEP),
                F.array_join(written(op_of(s), s["text"]), ","))
        return F.array_join(F.transform(all_statements, one), "")

    runs = F.split(let(statement_array(F.col("definition")), encode), START, -1)
    members = F.split(F.col("run"), STOP, -1)
    variables = F.flatten(F.transform(members, lambda m: F.split(F.substring_index(m, SEP, -1), ",", -1)))
    return (
        objects.select("object_id", F.explode(runs).alias("run"))
        .where(F.col("run") != "")
        .select(
            "object_id", F.substring_index("run", SEP, 1).cast("int").alias("line"),
            F.get(F.split("run", SEP, -1), F.lit(1)).alias("operation"),
            F.size(members).alias("n_statements"),
            F.array_join(F.array_sort(F.array_distinct(F.filter(variables, lambda v: v != ""))), ",").alias("variables_written"))
        .where(F.col("operation").isin("DECLARE", "SET")))


def statement_variables(objects: DataFrame) -> DataFrame:
    """Variables named in each statement, in first-seen order, by the naming rule of the dialect."""
    at = F.regexp_extract_all("text", F.lit(java_pattern(fv.AT_VARIABLE)), 0)
    prefixed = F.regexp_extract_all("text", F.lit(java_pattern(fv.PREFIX_VARIABLE)), 1)
    names = F.when(F.col("dialect") == "tsql", F.array_distinct(at)).otherwise(
        F.array_distinct(F.concat(prefixed, at)))
    return (
        objects.select("object_id", "dialect", F.explode(statement_array(F.col("definition"))).alias("s"))
        .select("object_id", "dialect", "s.*")
        .select("object_id", "line", names.alias("variables"))
        .where(F.size("variables") > 0))


# -- parameters, kinds, return types --------------------------------------------------------------

def return_types(objects: DataFrame) -> DataFrame:
    chosen = F.lit("")
    for dialect, pattern in fv.RETURN_PATTERNS.items():
        chosen = F.when(F.col("dialect") == dialect,
                        F.regexp_extract("definition", java_pattern(pattern), 1)).otherwise(chosen)
    return objects.where(F.col("object_type") == "function").select(
        "object_id", F.nullif(chosen, F.lit("")).alias("return_type"))


def object_kind(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, java_pattern(fv.OBJECT_KIND_PATTERN), 1))
    return F.when(found == "", "anonymous").when(found == "proc", "procedure").otherwise(found)


# -- security -------------------------------------------------------------------------------------

FINDING_COLUMNS = ["rule_id", "severity", "finding_type", "message", "recommendation"]


def rules(spark) -> DataFrame:
    """The built-in rule table; callers may union rows of their own."""
    return spark.createDataFrame(
        [(i, d, p, s, t, m, r) for i, d, p, s, t, m, r in fv.SECURITY_RULES],
        "rule_id int, dialect string, pattern string, severity string, finding_type string, "
        "message string, recommendation string")


def rules_by_dialect(rule_table: DataFrame) -> DataFrame:
    """One row per rule and dialect it applies to; ``applies_to`` is the dialect, ``*`` rules are repeated."""
    every = F.array(*[F.lit(d) for d in fv.DEFAULT_SCHEMAS])
    applies = F.when(F.col("dialect") == "*", every).otherwise(F.array("dialect"))
    return rule_table.select("*", F.explode(applies).alias("applies_to"))


def rule_findings(objects: DataFrame, rule_rows: list[tuple] | None = None) -> DataFrame:
    """One finding per rule match, with its line.

    Rules are unrolled into one projection over the text, so each text is read once whatever the
    number of rules, and nothing is joined.
    """
    text = F.col("definition")
    arrays = []
    for rule_id, dialect, pattern, severity, kind, message, advice in rule_rows or fv.SECURITY_RULES:
        applies = has(text, pattern)
        if dialect != "*":
            applies = (F.col("dialect") == dialect) & applies
        row = _finding_row(rule_id, severity, kind, message, advice)
        arrays.append(F.when(applies, F.transform(all_matches(text, pattern), row)))
    return objects.select("object_id", F.explode(_all(arrays)).alias("m")).select("object_id", "m.*")


def _finding_row(*values):
    return lambda m: F.struct(*[F.lit(v).alias(c) for v, c in zip(values, FINDING_COLUMNS)], m["line"].alias("line"))


def credential_findings(objects: DataFrame) -> DataFrame:
    """At most one finding per object for a quoted secret; it has no line."""
    severity, kind, message, advice = fv.CREDENTIAL_FINDING
    return objects.where(has(F.col("definition"), fv.CREDENTIAL_PATTERN)).select(
        "object_id", F.lit(0).alias("rule_id"), F.lit(severity).alias("severity"),
        F.lit(kind).alias("finding_type"), F.lit(message).alias("message"),
        F.lit(advice).alias("recommendation"), F.lit(None).cast("int").alias("line"))


def conditional_findings(objects: DataFrame) -> DataFrame:
    """Present-and-not-present checks: at most one finding per rule and object."""
    text = F.col("definition")
    checks = []
    for rule_id, dialect, present, absent, severity, kind, message, advice in fv.CONDITIONAL_RULES:
        holds = (F.col("dialect") == dialect) & has(text, present)
        if absent:
            holds = holds & ~has(text, absent)
        row = F.struct(*[F.lit(v).alias(c) for v, c in zip((rule_id, severity, kind, message, advice), FINDING_COLUMNS)])
        checks.append(F.when(holds, row))
    bodies = objects.where(~((F.col("dialect") == "plpgsql") & (F.col("object_type") == "view")))
    return bodies.select("object_id", F.explode(F.array_compact(F.array(*checks))).alias("m")).select("object_id", "m.*")


def findings(objects: DataFrame) -> DataFrame:
    return rule_findings(objects).unionByName(credential_findings(objects))


# -- complexity and structure ---------------------------------------------------------------------

def nesting_depth(text: Column) -> Column:
    """Deepest nesting: openers add one, END takes one away, never below zero."""
    words = F.regexp_extract_all(text, F.lit(java_pattern(fv.BLOCK_WORDS)), 1)

    def step(acc: Column, word: Column) -> Column:
        depth = F.when(F.upper(word) == "END", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"] + 1)
        return F.struct(depth.alias("depth"), F.greatest(acc["deepest"], depth).alias("deepest"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    return F.aggregate(words, start, step, lambda acc: acc["deepest"])


def complexity(objects: DataFrame) -> DataFrame:
    text = F.col("definition")
    branches = occurrences(text, fv.BRANCH_WORDS)
    return objects.select(
        "object_id", (branches + 1).alias("cyclomatic"), nesting_depth(text).alias("nesting"),
        branches.alias("branches"), occurrences(text, fv.LOOP_WORDS).alias("loops"),
        (newlines(text) + 1).alias("lines"))


def block_paths(objects: DataFrame) -> DataFrame:
    """For each call or table-access line: the blocks open around it, outermost first.

    ``depth`` counts every open block word, ``path`` names the conditional ones (BEGIN left out).

    The text is folded once, line by line, with the open blocks as state; a line is measured before
    the block words it carries itself.
    """
    target = r"^(?:EXEC|EXECUTE|CALL|PERFORM|INSERT|UPDATE|DELETE|MERGE|TRUNCATE|SELECT)\b"
    words = ["BEGIN", "IF", "WHILE", "LOOP", "FOR", "CASE"]

    # The state is a string with one digit per open block; it is spelt out only for the rows that leave.
    def push_or_pop(open_blocks: Column, word: Column) -> Column:
        code = F.lit("0")
        for n, w in enumerate(words):
            code = F.when(F.upper(word) == w, str(n)).otherwise(code)
        popped = F.left(open_blocks, F.greatest(F.length(open_blocks) - 1, F.lit(0)))
        return F.when(F.upper(word) == "END", popped).otherwise(F.concat(open_blocks, code))

    def step(open_blocks: Column, row: Column) -> Column:
        return F.aggregate(F.regexp_extract_all(row["text"], F.lit(java_pattern(fv.BLOCK_WORDS)), 1), open_blocks, push_or_pop)

    def emit(open_blocks: Column, row: Column) -> Column:
        hit = F.array(F.struct(row["line"].alias("line"), open_blocks.alias("open")))
        return F.when(has(strip(row["text"]), target), hit).otherwise(F.slice(hit, 1, 0))

    numbered = F.transform(F.split("definition", "\n", -1), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    found = let(numbered, lambda rows: scan(rows, F.lit(""), step, emit, "struct<line:int,open:string>"))
    path = F.replace("open", F.lit("0"), F.lit(""))
    for n, w in enumerate(words[1:], 1):
        path = F.replace(path, F.lit(str(n)), F.lit(w + ">"))
    return _rows(_bodies(objects), found, ID).select(
        "object_id", "line", F.rtrim(path, F.lit(">")).alias("path"), F.length("open").alias("depth"))


def line_class(trimmed: Column) -> Column:
    """Class of a trimmed line, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(fv.LINE_CLASSES):
        label = F.lit(name)
        if name == "raise":
            label = F.when(F.upper(trimmed).contains("RETURN"), "return").otherwise("error_handler")
        out = F.when(has(trimmed, pattern), label).otherwise(out)
    return out


def flow_lines(objects: DataFrame) -> DataFrame:
    """object_id, node_no, line, node_type, label: classified lines in order, closed by an end row."""
    def classify(raw: Column, i: Column) -> Column:
        return let(strip(raw), lambda t: F.struct(
            (i + 1).alias("line"), line_class(t).alias("node_type"), F.substring(t, 1, 80).alias("label")))

    def with_end(all_lines: Column) -> Column:
        kept = F.filter(all_lines, lambda x: x["node_type"].isNotNull())
        end = F.struct(F.size(all_lines).alias("line"), F.lit("end").alias("node_type"), F.lit("End").alias("label"))
        return F.concat(kept, F.array(end))

    rows = let(F.transform(F.split("definition", "\n", -1), classify), with_end)
    return _bodies(objects).select("object_id", F.posexplode(rows).alias("i", "r")).select(
        "object_id", (F.col("i") + 1).alias("node_no"), "r.*")


def structure_counts(objects: DataFrame) -> DataFrame:
    """Conditions, loops and TRY blocks per object, counted inside the row."""
    def count(test) -> Column:
        return F.size(F.filter(F.split("definition", "\n", -1), lambda raw: let(strip(raw), test)))

    def of(name: str):
        return lambda t: line_class(t).eqNullSafe(name)

    return _bodies(objects).select(
        "object_id", count(of("condition")).alias("conditions"), count(of("loop")).alias("loops"),
        count(lambda t: has(t, r"^BEGIN\s+TRY\b")).alias("try_blocks"))


# -- variables ------------------------------------------------------------------------------------

def _variable(m: Column, rank: int, kind: str, name: Column, *, data_type=None, target=None, procedure=None,
              expression=None, sub=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        name.alias("variable_name"), F.lit(kind).alias("reference_type"), m["line"].alias("line"),
        F.lit(rank).alias("rank"), m["pos"].alias("pos"), (sub if sub is not None else F.lit(0)).alias("sub"),
        (null if data_type is None else data_type).alias("data_type"),
        (null if target is None else target).alias("target_variable"),
        (null if procedure is None else procedure).alias("target_procedure"),
        (null if expression is None else expression).alias("expression"))


def _variable_rows(rank: int, kind: str, pattern: str, groups: int) -> Column:
    text = F.col("definition")
    look_back = {"set": fv.SET_LOOK_BACK, "update_set": fv.UPDATE_SET_LOOK_BACK}.get(kind, 0)
    hits = all_matches(text, pattern, groups, before=look_back)

    def g(m: Column, i: int) -> Column:
        return F.get(m["g"], F.lit(i - 1))

    def short(value: Column) -> Column:
        return F.substring(strip(value), 1, 80)

    if kind in ("parameter_in", "parameter_out"):
        return F.transform(hits, lambda m: _variable(m, rank, kind, F.concat(F.lit("@"), g(m, 1)), data_type=g(m, 2)))
    if kind == "declare":
        return F.transform(hits, lambda m: _variable(m, rank, kind, g(m, 1), data_type=g(m, 2)))
    if kind == "set":
        hits = F.filter(hits, lambda m: ~has(m["before"], fv.UPDATE_WORD))
        return F.transform(hits, lambda m: _variable(m, rank, kind, g(m, 1), expression=short(g(m, 2))))
    if kind == "select_into":
        return F.transform(hits, lambda m: _variable(m, rank, kind, g(m, 2), expression=short(g(m, 1))))
    if kind == "update_set":
        hits = F.filter(hits, lambda m: has(m["before"], fv.UPDATE_WORD))
    if kind == "exec_named":
        def pairs(m: Column) -> Column:
            named = F.lit(java_pattern(fv.NAMED_ARGUMENT_PATTERN))
            callee = F.regexp_extract_all(g(m, 2), named, 1)
            local = F.regexp_extract_all(g(m, 2), named, 2)
            return F.transform(local, lambda v, i: _variable(
                m, rank, "exec_argument", v, sub=i, target=F.concat(F.lit("@"), F.get(callee, i)),
                procedure=_clean_name(g(m, 1))))
        return F.flatten(F.transform(hits, pairs))
    if kind == "exec_positional":
        return F.flatten(F.transform(hits, lambda m: F.transform(
            F.split(g(m, 2), ",", -1), lambda v, i: _variable(
                m, rank, "exec_argument", strip(v), sub=i, procedure=_clean_name(g(m, 1))))))
    return F.transform(hits, lambda m: _variable(m, rank, kind, g(m, 1)))


def variable_references(objects: DataFrame) -> DataFrame:
    """Twelve passes over each text in one projection; first per (variable, type, line)."""
    text = F.col("definition")
    arrays = []
    for rank, kind, pattern, groups in fv.VARIABLE_PATTERNS:
        arrays.append(F.when(has(text, pattern), _variable_rows(rank, kind, pattern, groups)))
    return _rows(objects, first_of_each(_all(arrays), ["variable_name", "reference_type", "line"]), ID).drop(
        "rank", "pos", "sub")


def argument_mappings(objects: DataFrame) -> DataFrame:
    """Variables handed to callees: named (with the callee's parameter) and positional."""
    text = F.col("definition")
    arrays = [F.when(has(text, pattern), _variable_rows(rank, kind, pattern, groups))
              for rank, kind, pattern, groups in fv.VARIABLE_PATTERNS if kind.startswith("exec_")]
    return objects.select("object_id", F.explode(_all(arrays)).alias("v")).select(
        "object_id", F.col("v.line").alias("line"), F.col("v.target_procedure").alias("target_procedure"),
        (F.col("v.sub") + 1).alias("position"), F.col("v.variable_name").alias("variable_name"),
        F.col("v.target_variable").alias("target_variable"))
