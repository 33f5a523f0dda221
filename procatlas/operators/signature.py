"""Parameters of a procedure or function, read from its header alone.

The header is found on a copy of the text without comments, with the insides of strings blanked and all positions kept.
The list ends where its bracket closes and is cut at the commas outside all inner brackets, and the grammar of the dialect
reads each piece from the text itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procatlas.functions.plain import PART, SPACE, masked, pattern, rows_of

_HEAD = pattern(
    r"(?<![\w@#.$])(?:CREATE(?:\s+OR\s+(?:REPLACE|ALTER))?|ALTER)(?:\s+(?:NON)?EDITIONABLE)?\s+(?:PROCEDURE|PROC|FUNCTION)\s+"
    rf"(?:IF\s+NOT\s+EXISTS\s+)?{PART}(?:\s*\.{{1,2}}\s*{PART})*(?:\s*;\s*\d+)?\s*")
#: A T-SQL list without brackets ends in front of one of these; AS behind a parameter's name is a part of it.
_OPEN_END = pattern(r"(?<![\w@#.$])(?:AS|WITH\s+(?:RECOMPILE|ENCRYPTION|EXECUTE|NATIVE_COMPILATION|SCHEMABINDING)|FOR\s+REPLICATION|BEGIN|GO)(?![\w@#$])")
_INNER_AS = pattern(r"(@\w+\s+)AS(\s)")
#: One parameter by dialect; groups are name, mode, type and default where the dialect has them in this order.
_GRAMMAR = {
    "tsql": (pattern(r"(?s)(@\w+)\s+(.+?)(?:\s+(?:NOT\s+)?NULL)?(?:\s*=\s*(.+?))?(?:\s+(OUTPUT|OUT|READONLY))?$"), (1, 4, 2, 3)),
    "plpgsql": (pattern(r"(?s)(?:(IN\s+OUT|INOUT|IN|OUT|VARIADIC)\s+)?(\w+|\"[^\"]+\")\s+(.+?)(?:\s+DEFAULT\s+(.+)|\s*:?=\s*(.+))?$"), (2, 1, 3, 4)),
    "plsql": (pattern(r"(?s)(\w+|\"[^\"]+\")\s+(?:(IN\s+OUT|IN|OUT)\s+)?(?:NOCOPY\s+)?(.+?)(?:\s+DEFAULT\s+(.+)|\s*:=\s*(.+))?$"), (1, 2, 3, 4)),
}
_ALONE = pattern(r"(?s)(?:(IN|OUT|INOUT|VARIADIC)\s+)?([\w.\"%\[\]]+(?:\s*\([^)]*\))?(?:\[\])*)(?:\s+DEFAULT\s+(.+)|\s*:?=\s*(.+))?$")
#: A mode and a type alone, which the grammar of PL/pgSQL would take for a name and a type.
_NO_NAME = pattern(r"(?:IN|OUT|INOUT|VARIADIC)\s+[\w.%\[\]]+(?:\s*\([^)]*\))?$")
_TYPE_AS = pattern(r"AS\s+")
_MARK = re.compile("[(),]")


def _list_end(head: str) -> int:
    """Place of the bracket that closes the one ``head`` begins with, 0 if none does."""
    depth = 0
    for hit in _MARK.finditer(head):
        depth += {"(": 1, ")": -1}.get(hit[0], 0)
        if not depth and hit[0] == ")":
            return hit.start()
    return 0


def _pieces(head: str, text: str) -> list[str]:
    """``text`` cut where ``head`` has a comma outside all brackets."""
    out, depth, start = [], 0, 0
    for hit in _MARK.finditer(head):
        if hit[0] != ",":
            depth += 1 if hit[0] == "(" else -1
        elif not depth:
            out.append(text[start:hit.start()])
            start = hit.end()
    return [p for p in (piece.strip(SPACE) for piece in [*out, text[start:len(head)]]) if p]


def parameter_list(text: str | None, dialect: str | None) -> list[str]:
    """The parameters of a text as written, in order, without comments; empty without a header or a list."""
    hidden = masked(text or "")
    found = _HEAD.search(hidden)
    if not found:
        return []
    hidden, shown = hidden[found.end():], masked(text, strings=False)[found.end():]
    if hidden.startswith("("):
        end = _list_end(hidden)
        return _pieces(hidden[1:end], shown[1:end]) if end else []
    if dialect != "tsql" or not hidden.startswith("@"):
        return []
    head = _INNER_AS.sub(r"\1  \2", hidden)
    end = _OPEN_END.search(head)
    return _pieces(head[:end.start()] if end else head, shown)


def parameter(piece: str, ordinal: int, dialect: str | None) -> tuple | None:
    """(ordinal, name, data_type, mode, default_value) of one parameter as written, by the grammar of the dialect; None if it does not fit."""
    if dialect not in _GRAMMAR:
        return None
    grammar, (name, mode, kind, default) = _GRAMMAR[dialect]
    found = grammar.match(piece)
    if found and not (dialect == "plpgsql" and _NO_NAME.match(piece)):
        name, mode, kind = found[name], found[mode], found[kind]
        default = found[default] if dialect == "tsql" else found[default] or found[default + 1]
    else:  # a type without a name is called by its place
        found = _ALONE.match(piece) if dialect == "plpgsql" else None
        if not found:
            return None
        name, mode, kind, default = f"${ordinal}", found[1], found[2], found[3] or found[4]
    mode = "".join((mode or "").upper().split())
    if dialect == "tsql":
        mode, kind = "INOUT" if mode in ("OUT", "OUTPUT") else "IN", _TYPE_AS.sub("", kind, count=1) if _TYPE_AS.match(kind) else kind
    return ordinal, name, kind.strip(SPACE), mode or "IN", (default or "").strip(SPACE) or None


def parameter_rows(text: str | None, dialect: str | None) -> list[tuple]:
    rows = (parameter(p, n, dialect) for n, p in enumerate(parameter_list(text, dialect), 1))
    return [r for r in rows if r]


def parameters(objects: DataFrame) -> DataFrame:
    """object_id, ordinal, name, data_type, mode, default_value of the parameters in the header of each text.

    Brackets may nest in types and defaults, and the body is never read; texts without CREATE or ALTER of a procedure or
    function have none.  ``mode`` is IN, OUT, INOUT or VARIADIC; T-SQL OUTPUT is INOUT.  A PL/pgSQL parameter without a name
    is called $1, $2...
    """
    fields = [T.StructField("ordinal", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("name", "data_type", "mode", "default_value")]
    return rows_of(objects.where(F.col("object_type") != "view"), [F.col("definition"), F.col("dialect")], ["object_id"], fields, parameter_rows)
