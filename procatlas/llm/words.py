"""Words, word hashes and shingle hashes of many texts at once, as numpy arrays.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return, with A-Z lowered.
All of these are single bytes in UTF-8, so working on bytes cuts the text exactly as working on characters does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACES = (9, 10, 11, 12, 13, 32)
_CHUNK = 1 << 18
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (an invertible mixing step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table() -> dict[str, np.ndarray]:
    """Value of each byte, white space flags, and powers of an odd base and its inverse by position."""
    if not _tables:
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        values[65:91] = values[97:123]
        space = np.zeros(256, bool)
        space[list(_SPACES)] = True
        base = 0x9E3779B97F4A7C15 | 1
        power = np.full(_CHUNK, base, np.uint64)
        power[0] = 1
        inverse = np.full(_CHUNK, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _tables.update(values=values, space=space, power=np.cumprod(power), inverse=np.cumprod(inverse))
    return _tables


def _hash_long(word: bytes, t: dict[str, np.ndarray]) -> int:
    """Hash of one word of any length, in pieces, equal to what the block form gives."""
    total, shift, step = 0, 1, pow(int(t["power"][1]), _CHUNK, 1 << 64)
    for at in range(0, len(word), _CHUNK):
        b = np.frombuffer(word[at:at + _CHUNK], np.uint8)
        part = int((t["values"][b] * t["power"][:b.size]).sum(dtype=np.uint64))
        total = (total + part * shift) % (1 << 64)
        shift = shift * step % (1 << 64)
    return total


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw hashes, starts and ends of the words of one block of bytes."""
    t = _table()
    space = np.empty(data.size + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = t["space"][data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    sums = np.empty(data.size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(t["values"][data] * t["power"][:data.size], out=sums[1:])
    return (sums[end] - sums[start]) * t["inverse"][start], start, end


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word of one text; blocks are cut at white space."""
    size = len(text)
    if size <= _CHUNK:
        raw, start, end = _block(np.frombuffer(text, np.uint8))
        return mix(raw + (end - start).astype(np.uint64)), start, end
    t, parts, at = _table(), [], 0
    data = np.frombuffer(text, np.uint8)
    while at < size:
        stop = min(size, at + _CHUNK)
        if stop < size:
            spaces = np.flatnonzero(t["space"][data[at:stop]])
            if spaces.size:
                stop = at + int(spaces[-1]) + 1
            else:  # a word longer than a block
                rest = stop
                while rest < size and not t["space"][data[rest]]:
                    more = np.flatnonzero(t["space"][data[rest:rest + _CHUNK]])
                    rest += int(more[0]) if more.size else min(_CHUNK, size - rest)
                parts.append((np.array([_hash_long(text[at:rest], t)], np.uint64), np.array([at]), np.array([rest])))
                at = rest
                continue
        raw, start, end = _block(data[at:stop])
        parts.append((raw, start + at, end + at))
        at = stop
    raw, start, end = (np.concatenate(x) for x in zip(*parts))
    return mix(raw + (end - start).astype(np.uint64)), start, end


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words give the whole sequence as one, none give none."""
    words, _, _ = word_hashes(text)
    n = words.size
    if n == 0:
        return words
    count, short = max(1, n - width + 1), min(width, n)
    factor = mix(np.arange(short + 1, dtype=np.uint64) + np.uint64(1000 * short)) | np.uint64(1)
    out = np.full(count, factor[short], np.uint64)
    for k in range(short):
        out += words[k:k + count] * factor[k]
    return np.unique(mix(out))


def many(texts: Iterable[str | None]) -> Iterator[bytes]:
    """Texts as UTF-8; null is empty."""
    for text in texts:
        yield b"" if text is None else text.encode("utf-8", "surrogatepass")
