"""Terms of many texts: runs of ASCII letters and digits and of everything beyond ASCII, with A-Z lowered.

All bytes of a character beyond ASCII are above 0x7F in UTF-8, so cutting the bytes cuts the text as characters would.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Long texts are worked off in pieces, short ones together, of about so many bytes.
PIECE = 1 << 20
#: Rows of an Arrow batch whose texts are held as Python values at one time.
ROWS = 256
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[97:123] = _IN_TERM[128:] = True
#: The table of the CRC that crc32 names (reflected polynomial 0xEDB88320).
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_LONG = 64


def texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    """(row, text as UTF-8) of a batch, a few rows at a time; null is empty."""
    for at in range(0, batch.num_rows, ROWS):
        for row, text in enumerate(batch.column(column).slice(at, ROWS).cast(pa.binary()).to_pylist(), at):
            yield row, text or b""


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` in pieces cut between terms; a longer term makes a longer piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of one text in order, in lists of bounded size."""
    for piece in pieces(text):
        yield _TERM.findall(piece.lower())


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each range of ``data``: one byte of all ranges at a time, ranges beyond ``_LONG`` bytes alone."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    value = np.full(size.size, 0xFFFFFFFF, np.uint32)
    for k in range(min(_LONG, int(size[0])) if size.size else 0):
        open_ = int(np.searchsorted(-size, -k))
        value[:open_] = _CRC[(value[:open_] ^ data[start[:open_] + k]) & np.uint32(255)] ^ (value[:open_] >> np.uint32(8))
    value ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-size, -_LONG))):
        value[k] = zlib.crc32(data[start[k]:start[k] + size[k]].tobytes())
    out = np.empty_like(value)
    out[order] = value
    return out


def _runs(parts: list[bytes], known: list[int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, crc32) of every run of 1 to ``longest`` terms, joined by one space, of each part alone; runs that end
    within the first ``known`` terms of a part are left out."""
    low = np.frombuffer(b" ".join(parts).lower(), np.uint8)
    inside = np.concatenate([[False], _IN_TERM[low], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), edge[0::2], "right")
    kept = inside[1:-1] | inside[:-2]  # every term with one byte after it
    data = np.where(inside[1:-1], low, np.uint8(32))[kept]
    moved = np.cumsum(kept) - 1
    start, end = moved[edge[0::2]], moved[edge[1::2] - 1] + 1
    place = np.arange(part.size) - np.searchsorted(part, part)
    new = place >= np.array(known)[part] if part.size else place >= 0
    rows, values = [], []
    for k in range(1, longest + 1):
        count = max(0, part.size - k + 1)
        fits = (part[:count] == part[k - 1:]) & new[k - 1:] if count else np.zeros(0, bool)
        rows.append(part[:count][fits])
        values.append(crc32(data, start[:count][fits], end[k - 1:][fits]) if count else np.zeros(0, np.uint32))
    return np.concatenate(rows), np.concatenate(values)


def run_hashes(rows: Iterable[tuple[int, bytes]], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, crc32) of every run of 1 to ``longest`` terms of the texts, in arrays of bounded size."""
    parts, known, owner, size = [], [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        part, value = _runs(parts, known, longest)
        return np.array(owner, np.int64)[part], value

    for row, text in rows:
        carried: list[bytes] = []
        for piece in pieces(text):
            parts.append(b" ".join([*carried, piece]))
            known.append(len(carried))
            owner.append(row)
            size += len(parts[-1]) + 1
            if longest > 1 and len(piece) < len(text):
                carried = [*carried, *_TERM.findall(piece.lower())][1 - longest:]
            if size >= PIECE:
                yield flush()
                parts, known, owner, size = [], [], [], 0
    if parts:
        yield flush()
