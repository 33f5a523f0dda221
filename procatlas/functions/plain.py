"""Text work in plain Python over Arrow batches, for passes that keep state from token to token.

Patterns mean what they mean in ``matching``: ASCII classes, case ignored.  Rows of a batch are read as Python values and
never as pandas columns, so nulls stay None.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from procatlas.session import ship

#: The end of a word as the JVM has it, which takes letters and digits of all scripts for parts of a word.
END = r"(?u:\b)"
PART = r"""(?:\[[^\]\n]+\]|"[^"\n]+"|[#@$\w]+)"""
SPACE = " \t\n\r\f\v"


def pattern(text: str) -> re.Pattern:
    return re.compile(text, re.ASCII | re.IGNORECASE)


_HIDDEN = pattern(r"""--[^\n]*|/\*(?s:.*?)\*/|'[^']*'|"[^"\n]*"|\[[^\]\n]*\]""")
_SHOWN = re.compile(r"[^\n]")


def _blanks(text: str) -> str:
    return _SHOWN.sub(" ", text) if "\n" in text else " " * len(text)


def _hidden(hit: re.Match) -> str:
    found = hit[0]
    if found[0] in '"[':
        return found
    return f"'{_blanks(found[1:-1])}'" if found[0] == "'" else _blanks(found)


def _comment(hit: re.Match) -> str:
    return hit[0] if hit[0][0] in "\"['" else _blanks(hit[0])


def masked(text: str, strings: bool = True) -> str:
    """``matching.mask`` of one text."""
    return _HIDDEN.sub(_hidden if strings else _comment, text)


def rows_of(df: DataFrame, inputs: list[Column], keep: list, fields: list[T.StructField], rows: Callable[..., list[tuple]]) -> DataFrame:
    """The columns ``keep`` of ``df`` with a row for each tuple that ``rows`` gives for the values of ``inputs``."""
    ship(df.sparkSession)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    count = len(inputs)

    def batches(all_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in all_batches:
            at, found = [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[:count]))):
                own = rows(*values)
                at += [i] * len(own)
                found += own
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[count:]]
            new = [pa.array([r[n] for r in found], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(kept + new, names=names)

    out = T.StructType([*df.select(*keep).schema.fields, *fields])
    names = out.names
    return df.select(*(c.alias(f"_in{n}") for n, c in enumerate(inputs)), *keep).mapInArrow(batches, out)
