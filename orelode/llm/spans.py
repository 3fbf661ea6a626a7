"""Vectorised 64-bit digests of many spans of one array of codes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = n + n // 4 + 1
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over the others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_digests(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of ``codes[b:e]`` for each span: a polynomial over the codes plus one, modulo 2^64, mixed."""
    up, down = _tables(len(codes))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins])


def window_digests(values: np.ndarray, width: int) -> np.ndarray:
    """A digest of each run of ``width`` neighbouring values (fewer values: none)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + values[k : k + n]
    return mix(out)


def owner(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which text each place belongs to, of texts that begin at ``starts`` (with the end as last entry)."""
    return np.searchsorted(starts, places, side="right") - 1


def per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def white(codes: np.ndarray) -> np.ndarray:
    """Space and the control characters from tab to carriage return."""
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def runs(solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of set flags; a run never reaches over a text's end."""
    padded = np.zeros(len(solid) + 2, dtype=bool)
    padded[1:-1] = solid
    opens, closes = padded[1:] & ~padded[:-1], padded[:-1] & ~padded[1:]
    edge = starts[1:-1]
    edge = edge[(edge > 0) & (edge < len(solid))]
    inside = edge[padded[edge] & padded[edge + 1]]
    opens[inside] = True
    closes[inside] = True
    return np.nonzero(opens)[0], np.nonzero(closes)[0]


def word_spans(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: what stands between white space."""
    return runs(~white(codes), starts)


_tables_of: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if "letter" not in _tables_of:
        _tables_of["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables_of["letter"]


def lower_table() -> np.ndarray:
    """For each code point its lower case, where that is one code point."""
    if "lower" not in _tables_of:
        low = (chr(i).lower() for i in range(0x110000))
        _tables_of["lower"] = np.fromiter((ord(c) if len(c) == 1 else i for i, c in enumerate(low)), dtype=np.uint32, count=0x110000)
    return _tables_of["lower"]


def word_character_table() -> np.ndarray:
    """For each code point whether it is a letter or a numeral."""
    if "alnum" not in _tables_of:
        _tables_of["alnum"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables_of["alnum"]
