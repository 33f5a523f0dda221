"""Which tables the statements of a text read and write.

A text is masked and cut into tokens: clause words with the name and alias behind them, brackets, commas and
semicolons.  One pass over the tokens keeps a stack with a letter for each open bracket, which says what a name means
there:

    -  nothing yet, or the arguments of a call      s  a query, outside its FROM list
    f  a FROM list, where a comma brings a table    d  the head of UPDATE, DELETE or MERGE
    i  the head of INSERT                           w  a WITH list, where a comma brings a query name
    c  CASE ... END

Query names of the statement's WITH list are no tables.  The target of UPDATE and DELETE waits until its FROM list says
whether it is an alias.

The pass is plain Python over Arrow batches: as a fold of column expressions each token cost an interpreted tree of
hundreds of nodes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procatlas.functions import fixed_values as fv
from procatlas.functions.matching import SEP, has
from procatlas.functions.plain import END, PART, masked, pattern, rows_of

_NAME = rf"{PART}(?:\.{{1,2}}{PART})*"
_TOP = r"(?:\s+TOP\s*\([^()]*\)(?:\s+PERCENT)?)?"
#: Words in front of a name that are not part of it, and words behind one that are no alias.
_AHEAD = rf"(?:(?:ONLY|LATERAL|RECURSIVE|TABLE){END}\s*)?"
_NO_ALIAS = frozenset(
    ("INNER LEFT RIGHT FULL CROSS OUTER NATURAL ON AS SET WHERE VALUES SELECT DEFAULT OUTPUT WHEN FOR THEN END BEGIN IF ELSE "
     "LOOP DO RETURN GO OF TABLESAMPLE PIVOT UNPIVOT").split())
#: Besides the words that are no tables anywhere: what follows UPDATE or INSERT outside statements of that kind.
_NO_TABLE = frozenset([*fv.NON_TABLE_WORDS, "OF", "NOWAIT", "STATISTICS", "CASCADE", "RESTRICT", "NO", "ACTION", "LATERAL", "ONLY",
                       "RECURSIVE", "UNNEST", "XMLTABLE"])


#: Tokens by their first word: forms of several words with the class of each, and the class of the word alone, if any.
_WORDS = {
    **{w: ((), k) for k, words in (
        ("S", "SELECT PERFORM"), ("F", "FROM"), ("U", "USING"), ("N", "INTO"), ("W", "WITH"), ("C", "CASE"), ("b", "THEN ELSE"),
        ("Q", "UNION EXCEPT INTERSECT MINUS"), ("E", "WHERE GROUP ORDER HAVING SET VALUES RETURNING OUTPUT WINDOW LIMIT"),
        ("X", "BEGIN DECLARE EXEC EXECUTE CALL RETURN IF ELSIF WHILE FETCH CREATE ALTER DROP GRANT REVOKE DENY RAISE RAISERROR "
              "THROW COMMIT ROLLBACK EXCEPTION"), ("J", "JOIN")) for w in words.split()},
    **{w: ((k, pattern(p)), alone) for w, k, p, alone in (
        ("IS", "0", rf"IS\s+(?:NOT\s+)?DISTINCT\s+FROM{END}", None), ("FOR", "0", rf"FOR\s+(?:NO\s+KEY\s+)?UPDATE{END}", None),
        ("LOOP", "J", rf"LOOP\s+JOIN{END}", "X"), ("HASH", "J", rf"HASH\s+JOIN{END}", None), ("REMOTE", "J", rf"REMOTE\s+JOIN{END}", None),
        ("CROSS", "J", rf"CROSS\s+APPLY{END}", None), ("OUTER", "J", rf"OUTER\s+APPLY{END}", None),
        ("END", "e", rf"END\s+(?:IF|LOOP|WHILE|CASE|TRY|CATCH){END}", "e"),
        ("INSERT", "I", rf"INSERT{_TOP}(?:\s+INTO{END})?", "I"), ("UPDATE", "P", rf"UPDATE{_TOP}", "P"),
        ("DELETE", "D", rf"DELETE{_TOP}(?:\s+FROM{END})?", "D"), ("TRUNCATE", "T", rf"TRUNCATE(?:\s+TABLE{END})?", "T"))},
    "MERGE": (("J", pattern(rf"MERGE\s+JOIN{END}")), ("M", pattern(rf"MERGE{_TOP}(?:\s+INTO{END})?"))),
}
_SINGLE = {SEP: "o", "(": "(", ")": ")", ",": ",", ";": ";"}
_OPERATIONS = {"P": "UPDATE", "D": "DELETE", "I": "INSERT", "M": "MERGE", "T": "TRUNCATE"}
_OPENER = pattern(r"(?m)^[^\S\n]*" + fv.STATEMENT_OPENERS.removeprefix(r"^\s*").replace(r"\b", END))
_PIECE = re.compile(rf"""[{SEP}(),;]|(?<![@#$.\w\["])[A-Za-z]\w*{END}""", re.ASCII)
_BEHIND = pattern(rf"(?s)\s*{_AHEAD}({_NAME})(?:\s+(?:AS\s+)?({PART}))?")
_OPENS_QUERY = pattern(rf"(?s)\s*{_AHEAD}{_NAME}\s*(?:AS\s*(?:(?:NOT\s+)?MATERIALIZED\s*)?)?$")
_ENDS_NAME = pattern(r"""[\w\]"]$""")
_NAMING = frozenset("FJUNIPDMTW,")
_QUOTES = str.maketrans("", "", '[]"')


def _tokens(text: str) -> list[tuple[str, int, int, int, bool]]:
    """Tokens of a text in order as (class, line, end, start of the next one, whether that is a bracket), closed by a semicolon.

    The places are those in the second value, the masked text; a token ``o`` opens each line that starts a statement (so does WITH).
    """
    out, free, at, line, kind, end = [], 0, 0, 1, "", 0
    words, puts, same = _WORDS, out.append, text.isascii()
    shouted = text.upper() if same else text
    for hit in _PIECE.finditer(shouted):
        start, stop = hit.span()
        if start < free:
            continue
        word = hit[0]
        found = _SINGLE.get(word)
        if found is None:
            entry = words.get(word if same else word.upper())
            if entry is None:
                continue
            longer, found = entry
            if longer:
                more = longer[1].match(text, start)
                if more:
                    found, stop = longer[0], more.end()
                elif type(found) is tuple:
                    found, stop = found[0], found[1].match(text, start).end()
                elif found is None:
                    continue
        if kind:
            puts((kind, line, end, start, found == "("))
        line += text.count("\n", at, start)
        at, free, kind, end = start, stop, found, stop
    if kind:
        puts((kind, line, end, len(text), False))
    puts((";", 0, len(text), len(text), False))
    return out


def _last(name: str) -> str:
    return name.rpartition(".")[2]


def _accesses(text: str, tsql: bool) -> list[tuple[str, str, int]]:
    """(full_table_name, operation, line) in text order, with repeats; ``line`` is that of the statement."""
    text = _OPENER.sub(rf"{SEP}\g<0>", masked(text.replace(SEP, "")))
    out: list[tuple[str, str, int]] = []
    stack, line, joined, queries, kind, target, target_line, target_depth = "-", 0, False, (), "", "", 0, 0
    for k, t_line, end, following, bracket in _tokens(text):
        top = stack[-1]
        # Most tokens change one thing at most.
        if k == "," and top not in "fw" or k == "0":
            continue
        if k == "(":
            stack += "-"
            continue
        if k == "o":
            line = t_line
            continue
        if k == ")" and not target:
            stack = stack[:-1] or stack
            continue
        # The name and alias behind the token, whether a query name is declared there, and whether the name is that of a function.
        name = alias = ""
        behind = _BEHIND.match(text, end, following) if k in _NAMING else None
        if behind:
            name, alias = behind[1].translate(_QUOTES), (behind[2] or "").translate(_QUOTES).upper()
            name = "" if _last(name).upper() in _NO_TABLE else name
            alias = "" if alias in _NO_ALIAS else alias
        named, upper, depth = name != "", name.upper(), len(stack)
        listed = top in "sfd"
        write = k in _OPERATIONS and named
        query = named and (k == "," and top == "w" or k == "W" and bracket and _OPENS_QUERY.match(text, end, following) is not None)
        ends = (k in ";X" or k == "e" and top != "c"
                or depth == 1 and (k == "b" and top != "c" or k == "S" and listed and not joined
                                   or write and top != "w" or query and k == "W" and top != "i"))
        source = (named and (k in "FJ" and listed or k == "," and top == "f" or k == "U" and top == "d")
                  and not (bracket and _ENDS_NAME.search(text, max(end, following - 2), following)))
        waits = target != ""
        own = target.upper()
        found = source and waits and depth == target_depth and own in (upper, _last(upper), alias)
        over = waits and not found and (ends or k == ")" and depth <= target_depth)
        table = "." in name or upper not in queries
        # The accesses that the token settles.
        place = line if line > 0 else t_line
        if found:
            out.append((name, _OPERATIONS[kind], target_line))
        elif over and own not in queries:
            out.append((target, _OPERATIONS[kind], target_line))
        if source and table and not found:
            out.append((name, "SELECT", place))
        elif tsql and k == "N" and named and top in "sfdi" and table:
            out.append((name, "INSERT", place))
        elif write and table and k in "IMT":
            out.append((name, _OPERATIONS[k], place))
        # The state behind the token.
        less = stack[:-1]
        if k == ")":
            stack = less or stack
        elif k in ";X":
            stack = "-"
        elif k == "C":
            stack += "c"
        elif k == "e":
            stack = less if top == "c" and depth > 1 else "-"
        elif k == "b" and ends:
            stack = "-"
        elif k == "S":
            stack = less + "s"
        elif source or k == "F" and top in "sd":
            stack = less + "f"
        elif write:
            stack = less + ("i" if k == "I" else "-" if k == "T" else "d")
        elif query and k == "W":
            stack = less + "w"
        elif k == "E" and top == "f":
            stack = less + "s"
        if ends:
            queries = ()
        if query:
            queries = (*queries, upper)
        if write and k in "PD":
            kind, target, target_line, target_depth = k, name, place, depth
        elif found or over:
            kind, target, target_line, target_depth = "", "", 0, 0
        joined = k == "Q" or joined and k not in "S;X"
        if k == "W" and query:
            line = t_line
    return out


def _first_accesses(text: str, dialect: str | None) -> list[tuple[str, str, int]]:
    """The first line of each table and operation, table variables left out."""
    first: dict[tuple[str, str], int] = {}
    for name, operation, line in _accesses(text, dialect == "tsql"):
        if not _last(name).startswith("@") and line < first.get((name, operation), line + 1):
            first[name, operation] = line
    return [(*key, line) for key, line in sorted(first.items())]


def is_temp_table(name: Column) -> Column:
    return name.rlike(fv.TEMP_TABLE_PATTERN)


def table_accesses(objects: DataFrame, keep=("object_id",)) -> DataFrame:
    """Distinct (object, table, operation) with the line of the first statement that has it.

    Targets of INSERT, UPDATE, DELETE, MERGE and TRUNCATE, with or without INTO, FROM and TABLE, and in T-SQL of SELECT
    ... INTO, are written; all other tables of a FROM list, a join or a USING are read.  Names in comments and strings,
    query names of a WITH list, functions, table variables and arguments such as ``extract(year FROM x)`` are no tables.
    A target that is an alias is the table behind it, and its place in the FROM list is no read.
    """
    text = F.col("definition")
    names_some = has(text, r"\b(?:FROM|INTO|INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b")
    facts = [T.StructField("full_table_name", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("line", T.IntegerType())]
    rows = rows_of(objects.where(names_some), [text, F.col("dialect")], list(keep), facts, _first_accesses)
    name = F.substring_index("full_table_name", ".", -1)
    return rows.withColumn("table_name", name).withColumn("is_temp", is_temp_table(F.col("table_name")))
