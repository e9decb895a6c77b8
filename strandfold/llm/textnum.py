"""Words of many texts as numpy arrays: positions, 64-bit hashes, rolling windows.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}. UTF-8 never uses those
bytes inside a longer code point, so splitting bytes and splitting characters agree.
All functions work on a whole Arrow batch at once; the cost is a few machine
operations per byte, with no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240613))
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_Q = np.uint64(0xD1342543DE82EF95 | 1)
_Q_INV = np.uint64(pow(int(_Q), -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def power_at(base: np.uint64, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64, from two short tables however large the exponents are."""
    high = powers(np.uint64(pow(int(base), 1 << 16, 2**64)), int(at.max() >> 16) + 1 if len(at) else 1)
    return high[at >> 16] * powers(base, 1 << 16)[at & 0xFFFF]


def lines(raw: np.ndarray) -> np.ndarray:
    """A hash of each line of one text (bytes between newlines), the same wherever the line lies.

    Sums are taken over blocks, so a long text costs a few machine words a byte of one block.
    """
    starts = np.append(0, np.flatnonzero(raw == 10) + 1)
    sums = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(raw), _BLOCK):
        some = raw[lo : lo + _BLOCK]
        a, b = int(np.searchsorted(starts, lo, side="right")) - 1, int(np.searchsorted(starts, lo + len(some)))
        value = _TABLE[some] * powers(_R, len(some)) * power_at(_R, np.array([lo], np.int64))
        value[some == 10] = 0
        sums[a:b] += np.add.reduceat(value, np.maximum(starts[a:b], lo) - lo)
    length = np.diff(np.append(starts, len(raw) + 1)) - 1
    return mix(sums * power_at(_R_INV, starts) + length.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of a string column with about size bytes each; a longer text is a part by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, lo = len(column), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)))
        yield column.slice(lo, hi - lo)
        lo = hi


#: Bytes hashed at once; a few dozen bytes of memory each.
_BLOCK = 2 << 20


def _block_ends(raw: np.ndarray) -> list[int]:
    """Where blocks of about _BLOCK bytes may end: at white space, so that no word is cut."""
    ends, n = [], len(raw)
    at = _BLOCK
    while at < n:
        while at < n and not (some := _SPACE[raw[at : at + 65536]]).any():
            at += 65536
        at = min(n, at + int(some.argmax())) if at < n else n
        ends.append(at)
        at += _BLOCK
    return ends if ends and ends[-1] == n else [*ends, n]


def words(column: pa.Array, fold: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first, raw): a hash and byte range per word; words of row i are first[i]:first[i+1].

    fold=True hashes A-Z as a-z. marks=True makes a comma or full stop that ends a word after an
    ASCII letter a word of its own. Long columns and texts are taken in blocks.
    """
    raw, offsets = batch_bytes(column)
    table = _FOLDED if fold else _TABLE
    out: tuple[list, list, list] = ([], [], [])
    lo = 0
    for hi in _block_ends(raw):
        some = _block(raw[lo:hi], offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo, table, marks)
        for to, x, plus in zip(out, some, (None, lo, lo)):
            to.append(x if plus is None else x + plus)
        lo = hi
    hashes, starts, ends = (np.concatenate(x) if len(x) > 1 else x[0] for x in out)
    return hashes, starts, ends, np.searchsorted(starts, offsets), raw


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _block(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    cut = np.ones(n + 1, dtype=bool)  # a word can't run across position i
    cut[1:n] = ~inside[:-1] | ~inside[1:]
    cut[offsets] = True
    if marks:
        cut[1:n] |= ((raw[1:] == 44) | (raw[1:] == 46)) & _LETTER[raw[:-1]] & cut[2:]
    starts = np.flatnonzero(cut[:n] & inside)
    ends = np.flatnonzero(cut[1:] & inside) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(table[raw] * powers(_R, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_R_INV, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), starts, ends


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of size consecutive words (runs across rows too; the caller masks them)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    x = mix(hashes + np.uint64(salt)) if salt else hashes
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(x * powers(_Q, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_Q_INV, n)[: n - size + 1])


def window_rows(first: np.ndarray, size: int, n_windows: int) -> np.ndarray:
    """True for the windows that lie in one row."""
    ok = np.zeros(n_windows + 1, dtype=np.int64)
    lo, hi = first[:-1], first[1:] - size + 1
    keep = hi > lo
    ok[lo[keep]] += 1  # each position occurs once here
    ok[hi[keep]] -= 1
    return np.cumsum(ok)[:n_windows] > 0
