"""Rolling hashes over whole batches of text, in NumPy.

Strings are hashed by polynomials modulo 2**64 over random symbol values: prefix sums of value times power give
the hash of any span with one subtraction and one multiplication by an inverse power.
"""

from __future__ import annotations

import numpy as np

#: The base; odd, and 3 modulo 4, so that its powers differ in low bits too.
BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(BASE, -1, 1 << 64)
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Symbols hashed at once, few enough for a core's cache; longer inputs are cut between spans.
SEGMENT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of each at least."""
    if len(_tables["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: The same with A-Z read as a-z.
LOWERED_VALUES = BYTE_VALUES.copy()
LOWERED_VALUES[65:91] = BYTE_VALUES[97:123]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums that ``span`` takes hashes from; one longer than ``values``."""
    up, _ = powers(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the spans, equal for equal strings."""
    _, down = powers(len(sums))
    lengths = (stops - starts).astype(np.uint64)
    return mix((sums[stops] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Values of all spans of one width, equal for equal strings, whose high bits order them at random."""
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * powers(len(sums))[1][:n]


def hashed_spans(symbols: np.ndarray, values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of ordered spans of symbols, in segments of bounded memory (a longer span makes a segment of its own)."""
    if len(symbols) <= SEGMENT:
        return span(prefix(values[symbols]), starts, stops)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        end = max(at + 1, int(np.searchsorted(stops, low + SEGMENT, side="right")))
        sums = prefix(values[symbols[low : stops[end - 1]]])
        out[at:end] = span(sums, starts[at:end] - low, stops[at:end] - low)
        at = end
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    framed = np.zeros(len(inside) + 2, bool)
    framed[1:-1] = inside
    edge = np.flatnonzero(framed[1:] != framed[:-1])
    return edge[::2], edge[1::2]


_GRAM = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes."""
    if len(words) < n:
        return words[:0]
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _GRAM[k]
    return mix(total)


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def plain_words(data: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, cut at ASCII white space, with A-Z lowered."""
    return words_of_all([data])[0]


def words_of_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in a row, and where those of each text begin and the last end."""
    symbols = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, stops = runs(_WORD_BYTE[symbols])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashed_spans(symbols, LOWERED_VALUES, starts, stops), np.concatenate(([0], np.searchsorted(starts, ends)))
