"""Word and shingle hashes for the Python side of the corpus operators, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the linear hashes and of the finaliser (splitmix64).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed together; longer texts are taken in pieces that end between words.
SLICE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; base is odd."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        known = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, SLICE + 1) - 1, b)]).astype(np.uint64)) for b in (base, inverse))
        _POWERS[int(base)] = known
    return known


class RangeHash:
    """Hashes of any ranges of a sequence, from one prefix sum modulo 2**64. Equal ranges hash equally wherever they are; long ranges of a few distinct items may collide by their structure, so
    a PrimeRangeHash has to go with it."""

    def __init__(self, items: np.ndarray, base: np.uint64):
        up, self.down = powers(base, len(items) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * up[: len(items)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


#: A prime, and a base whose powers modulo it don't repeat in any sequence that fits in memory.
PRIME, _PRIME_BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
_P, _LOW = np.uint64(PRIME), np.uint64((1 << 31) - 1)
_PRIME_POWERS: list[np.ndarray] = []


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x >> np.uint64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def multiplied(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """x * y modulo PRIME, for values below it."""
    xh, xl, yh, yl = x >> np.uint64(31), x & _LOW, y >> np.uint64(31), y & _LOW
    middle = xl * yh + xh * yl
    return reduced(xh * yh * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + xl * yl)


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < n at least."""
    if not _PRIME_POWERS or len(_PRIME_POWERS[0]) < n:
        found = []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME)):
            one = np.ones(1, np.uint64)
            while len(one) < max(n, SLICE):
                one = np.concatenate([one, multiplied(one, np.uint64(pow(base, len(one), PRIME)))])
            found.append(one)
        _PRIME_POWERS[:] = found
    return _PRIME_POWERS[0], _PRIME_POWERS[1]


class PrimeRangeHash:
    """As RangeHash, modulo a prime: sequences collide by chance alone."""

    def __init__(self, items: np.ndarray):
        up, self.down = _prime_powers(len(items) + 1)
        terms = multiplied(reduced(items), up[: len(items)])
        low, high = np.cumsum(terms & _LOW, dtype=np.uint64), np.cumsum(terms >> np.uint64(31), dtype=np.uint64)
        total = reduced(multiplied(reduced(high), np.uint64(1 << 31)) + reduced(low))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), total])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        between = reduced(self.prefix[end] + _P - self.prefix[start])
        return mix(multiplied(between, self.down[start]) + (end - start).astype(np.uint64))


#: Values of a byte at each of the first places of a word; those of further places are worked out.
PLACES = 48
_PLACED = mix(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64)))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _hash_words(raw: np.ndarray, starts_at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of raw; a text begins at each of starts_at. A word's hash is a sum of values that depend on byte and place, so no structure of words makes them collide."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_GAP[raw]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edge = starts_at[starts_at < len(raw)]
    begin[edge] = inside[1:-1][edge]
    edge = edge[edge > 0]
    end[edge - 1] = inside[1:-1][edge - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if lower:
        raw = _LOWERED[raw]
    # gaps count as further places of the word before; no word's range reaches over them
    place = np.arange(len(raw), dtype=np.int32)
    if len(first):
        place -= np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(raw)]]))).astype(np.int32)
    code = place * 256 + raw
    values = _PLACED[np.minimum(code, len(_PLACED) - 1)]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = mix(mix(code[far].astype(np.int64).astype(np.uint64) + np.uint64(1)))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return first, mix(prefix[last] - prefix[first] + (last - first).astype(np.uint64))


def hashed_rows(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for each row of a text column; null has no words. Words are runs of anything but ASCII white space; lower: A-Z count as a-z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    none = np.zeros(0, np.uint64)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        raw = data[offsets[at] : offsets[end]]
        if len(raw) <= 2 * SLICE:
            first, found = _hash_words(raw, (offsets[at:end] - offsets[at]).astype(np.int64), lower)
            bounds = np.searchsorted(first, offsets[at : end + 1] - offsets[at])
            for k in range(end - at):
                yield at + k, none if null[at + k] else found[bounds[k] : bounds[k + 1]]
        else:  # one long text
            parts, begin = [], 0
            while begin < len(raw):
                stop = min(begin + SLICE, len(raw))
                while stop < len(raw) and not _GAP[raw[stop]]:
                    stop += 1
                parts.append(_hash_words(raw[begin:stop], np.zeros(1, np.int64), lower)[1])
                begin = stop
            yield at, none if null[at] else np.concatenate(parts)
        at = end


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, of the whole sequence; of none, empty."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = words[: n - width + 1].copy()
    for k in range(1, width):
        total *= _STEP
        total += words[k : n - width + 1 + k]
    if width < size:
        total += np.uint64(width)
    return distinct(mix(total))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
