"""Find every match of a pattern in a text column, with line numbers and groups, inside the row.

Spark has no find-all that reports positions.  One ``regexp_replace`` writes a marker and the
captured groups in front of each match; splitting on the marker gives the matches, and splitting the
marked text on newlines gives their line numbers.  All work is linear in the text and stays in the
row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, STOP = "\u0001", "\u0002", "\u0003"
_FLAGS = "(?id)"  # ignore case; only \n ends a line


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    return (_FLAGS if ignore_case else "(?d)") + pattern


def clean(text: Column) -> Column:
    """Remove the marker characters; applied once where texts are loaded."""
    return F.translate(text, START + SEP + STOP, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(java_pattern(pattern))


_HIDDEN = r"""--[^\n]*|/\*(?s:.*?)\*/|'[^']*'|"[^"\n]*"|\[[^\]\n]*\]"""


def mask(text: Column, strings: bool = True) -> Column:
    """``text`` with comments, and the insides of string literals, as blanks; length and line breaks stay.

    Quoted and bracketed names are kept, and a comment sign or quote inside them opens nothing.
    """
    marked = F.regexp_replace(text, java_pattern(_HIDDEN), START + "$0" + STOP)

    def blank(piece: Column) -> Column:
        def shown(hit: Column) -> Column:
            blanks = F.regexp_replace(hit, r"[^\n]", " ")
            quoted = F.concat(F.lit("'"), F.substring(blanks, F.lit(2), F.length(hit) - 2), F.lit("'")) if strings else hit
            kept = F.when(hit.startswith("'"), quoted).when(hit.startswith('"') | hit.startswith("["), hit).otherwise(blanks)
            return F.concat(kept, F.substring(piece, F.length(hit) + 2, F.length(piece)))

        return let(F.substring_index(piece, STOP, 1), shown)

    def joined(pieces: Column) -> Column:
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(rest, blank)), "")

    return let(F.split(marked, START, -1), joined)


def occurrences(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(java_pattern(pattern, ignore_case)))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_numbers(marked: Column) -> Column:
    """Line (from 1) of every START mark of a text, in order."""
    return F.flatten(F.transform(
        F.split(marked, "\n", -1),
        lambda line, i: F.array_repeat(
            i + 1, F.length(line) - F.length(F.replace(line, F.lit(START), F.lit("")))),
    ))


def all_matches(
    text: Column,
    pattern: str,
    groups: int = 0,
    after: int = 0,
    before: int = 0,
) -> Column:
    """``array<struct<pos,line,g[,after][,before]>>``: one entry per match, in text order.

    ``g`` holds the captured groups ('' where a group took no part).  ``after``/``before`` give that
    many characters from the match on / ahead of it; every piece holds at least one character, so
    the neighbouring pieces needed are as many as the characters wanted.
    """
    captured = SEP.join(f"${i}" for i in range(1, groups + 1))
    marked = F.regexp_replace(text, java_pattern(pattern), f"{START}{captured}{STOP}$0")

    def without_groups(marked_text: Column) -> Column:
        if groups:
            return F.regexp_replace(marked_text, f"{START}[^{STOP}]*{STOP}", START)
        return F.replace(marked_text, F.lit(START + STOP), F.lit(START))

    def entries(p: Column) -> Column:
        def entry(head: Column, i: Column) -> Column:
            fields = [
                (i + 1).alias("pos"),
                F.get(p["lines"], i).alias("line"),
                F.split(F.substring_index(head, STOP, 1), SEP, -1).alias("g"),
            ]
            if after:
                window = F.slice(p["pieces"], i + 2, F.lit(after))
                fields.append(F.substring(F.array_join(window, ""), 1, after).alias("after"))
            if before:
                first = F.greatest(F.lit(1), i + 2 - before)
                window = F.slice(p["pieces"], first, F.least(i + 1, F.lit(before)))
                fields.append(F.right(F.array_join(window, ""), F.lit(before)).alias("before"))
            return F.struct(*fields)

        heads = F.slice(p["heads"], 2, F.greatest(F.size(p["heads"]) - 1, F.lit(0)))
        return F.transform(heads, entry)

    def parts(marked_text: Column, bare: Column) -> Column:
        fields = [line_numbers(bare).alias("lines"), F.split(marked_text, START, -1).alias("heads")]
        if after or before:
            fields.append(F.split(bare, START, -1).alias("pieces"))
        return F.struct(*fields)

    return let(marked, lambda m: let(without_groups(m), lambda b: let(parts(m, b), entries)))


def first_of_each(rows: Column, key: list[str]) -> Column:
    """First entry per key of an array of structs.

    The structs must start with the key fields, then the fields that order entries of one key.  All
    entries of a text sit in one row, so duplicates go here without any shuffle.
    """
    def differs(a: Column, b: Column) -> Column:
        out = F.lit(False)
        for k in key:
            out = out | ~a[k].eqNullSafe(b[k])
        return out

    return let(F.array_sort(rows), lambda s: F.filter(
        s, lambda r, i: (i == 0) | differs(r, F.get(s, i - 1))))


def scan(rows: Column, start: Column, step, emit, row_type: str, block: int = 128, both=None) -> Column:
    """What ``emit(state, row)`` (an array) gives at each row of a left-to-right pass, as one array.

    ``step(state, row)`` gives the next state, which must stay small; ``both(state, row)``, a struct of the next ``state``
    and the row's ``out``, can save work that the two share.  A first pass finds the state at the start of every block of
    rows; the blocks then collect their own short outputs, because an output kept in the state would be copied at every row.
    """
    def empty(t: str) -> Column:
        return F.expr(f"cast(array() as array<{t}>)")

    count = F.ceil(F.size(rows) / block).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.expr("cast(array() as array<int>)"))
    blocks = F.transform(numbers, lambda b: F.slice(rows, (b - 1) * block + 1, F.lit(block)))

    def advance(acc: Column, part: Column) -> Column:
        return F.struct(F.aggregate(part, acc["state"], step).alias("state"),
                        F.concat(acc["seen"], F.array(acc["state"])).alias("seen"))

    def collect(part: Column, first: Column) -> Column:
        def one(acc: Column, row: Column) -> Column:
            if both:
                return let(both(acc["state"], row), lambda r: F.struct(
                    r["state"].alias("state"), F.when(F.size(r["out"]) > 0, F.concat(acc["out"], r["out"])).otherwise(acc["out"]).alias("out")))
            return F.struct(step(acc["state"], row).alias("state"),
                            F.concat(acc["out"], emit(acc["state"], row)).alias("out"))

        return F.aggregate(part, F.struct(first.alias("state"), empty(row_type).alias("out")), one, lambda acc: acc["out"])

    def all_blocks(parts: Column) -> Column:
        none_seen = F.slice(F.array(start), 1, 0)
        all_but_last = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        firsts = F.aggregate(all_but_last, F.struct(start.alias("state"), none_seen.alias("seen")), advance,
                             lambda acc: F.concat(acc["seen"], F.array(acc["state"])))
        return F.flatten(F.zip_with(parts, F.slice(firsts, 1, F.size(parts)), collect))

    return let(blocks, all_blocks)


def explode_matches(df: DataFrame, pattern: str, keep: list[str], groups: int = 0,
                    text: str = "definition", after: int = 0, before: int = 0) -> DataFrame:
    """Rows of ``keep`` plus ``pos``, ``line``, ``g`` (and context); texts without a match are skipped early."""
    return (
        df.where(has(F.col(text), pattern))
        .select(*keep, F.explode(all_matches(F.col(text), pattern, groups, after, before)).alias("m"))
        .select(*keep, "m.*")
    )


def lines(df: DataFrame, keep: list[str], text: str = "definition") -> DataFrame:
    """One row per text line: ``keep``, ``line`` (from 1), ``text``."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "text")).select(
        *keep, (F.col("i") + 1).alias("line"), "text")
