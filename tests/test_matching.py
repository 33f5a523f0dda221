"""Matches, lines, groups and context against Python's own ``re`` on random texts."""

import random
import re

import pytest

from procatlas.functions import fixed_values as fv
from procatlas.functions.matching import explode_matches, lines

WORDS = ["EXEC", "execute", "CALL", "p1", "s1.p2", "[s1].[P3]", "(", ")", "@v", "@p", "=", "IF", "BEGIN", "END",
         "WHILE", "SELECT", "INTO", "x", ",", ";", "\n", "\n  ", " ", "SET", "UPDATE", "'a'", "PERFORM", "s.f(", ":=",
         "DECLARE", "INT", "VALUES(", "RETURN", "WHERE", "GRANT", "a.b.c.d"]


def texts(n=120):
    rnd = random.Random(7)
    return [(i, "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "\n"]) for _ in range(rnd.randint(0, 60))))
            for i in range(n)]


PATTERNS = [(p, g) for _, _, p, g, _, _ in fv.CALL_PATTERNS] + [(fv.DYNAMIC_EXEC_PATTERN, 0), (r"\bGRANT\b", 0),
                                                               (fv.LINKED_SERVER_PATTERN, 4)]
PATTERNS += [(p, g) for _, _, p, g in fv.VARIABLE_PATTERNS]


@pytest.mark.parametrize("pattern,groups", PATTERNS)
def test_matches_equal_finditer(spark, pattern, groups):
    rows = texts()
    df = spark.createDataFrame(rows, "id long, definition string")
    got = explode_matches(df, pattern, ["id"], groups, after=30, before=40).collect()
    want = []
    for i, t in rows:
        for n, m in enumerate(re.finditer(pattern, t, re.I), 1):
            want.append((i, n, t[: m.start()].count("\n") + 1, [g or "" for g in m.groups()] or [""],
                         t[m.start(): m.start() + 30], t[max(0, m.start() - 40): m.start()]))
    assert sorted((r.id, r.pos, r.line, r.g, r.after, r.before) for r in got) == sorted(want)


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\n\nb")], "id long, definition string")
    assert [(r.line, r.text) for r in lines(df, ["id"]).orderBy("line").collect()] == [(1, "a"), (2, ""), (3, "b")]
