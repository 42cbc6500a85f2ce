"""Words, word hashes and n-gram hashes of whole Arrow columns, without a Python loop over words.

Texts stay in Arrow's UTF-8 buffer.  A hash folds the 64-bit lanes of a run pairwise, level by level, through a
mixing step that is not linear in them; so no structure of a text makes hashes meet (as words of the Thue-Morse
kind do for every polynomial modulo 2**64), and two different runs have equal hashes by chance alone, once in 2**64
pairs.  Where equality decides a result within a block, ``same_spans`` compares the bytes themselves.

Nothing is kept between blocks, and a block takes some ten arrays of eight bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LEFT, _LENGTH = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Keeps the first n bytes of a lane.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring runs from theirs."""
    return mix(left * _LEFT + right)


def fold(values: np.ndarray, count: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """One hash of each run of ``values``, which lie run after run, ``count`` in each; ``length`` goes in as well."""
    out, live, size = np.zeros(len(count), U), np.flatnonzero(count), count[count > 0]
    while len(live):
        begin = np.cumsum(size) - size
        one = size == 1
        out[live[one]] = values[begin[one]]
        live, size, begin = live[~one], size[~one], begin[~one]
        if len(live):
            half = (size + 1) // 2
            run = np.repeat(np.arange(len(size)), half)
            left = begin[run] + 2 * (np.arange(len(run)) - (np.cumsum(half) - half)[run])
            paired = left + 1 < (begin + size)[run]
            values, right = values[left], values[left[paired] + 1]
            values[paired] = joined(values[paired], right)
            size = half
    return mix(out + (count if length is None else length).astype(U) * _LENGTH)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(where):
        where = np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[where[0] : where[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, where - where[0]


def blocks(data: np.ndarray, where: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first text, end, their bytes, where each begins."""
    lo, n = 0, len(where) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[where[lo] : where[hi]], where[lo : hi + 1] - where[lo]
        lo = hi


def words(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte range of every word, and the index of each text's first word (one more than texts)."""
    return runs(~SPACE[data], where)


def runs(inside: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range of every run of ``inside`` within a text, and the index of each text's first (one more than texts)."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    seams = np.unique(where[1:-1])
    seams = seams[(seams > 0) & (seams < len(inside))]
    begin[seams] |= inside[seams]
    end[seams - 1] |= inside[seams - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, where)


def gathered(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 and so on, ``count`` of each."""
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each range as 64-bit lanes, zeros after the last, and how many lanes each has."""
    size = ends - starts
    count = (size + 7) >> 3
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    every = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
    if len(count) and count.min() == count.max() == 1:
        return every[starts] & _MASKS[size], count
    run = np.repeat(np.arange(len(size)), count)
    off = 8 * (np.arange(len(run)) - (np.cumsum(count) - count)[run])
    return every[starts[run] + off] & _MASKS[np.minimum(size[run] - off, 8)], count


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of ``data``; another one for another seed."""
    if data.itemsize > 1:
        width = data.itemsize
        data, starts, ends = np.ascontiguousarray(data).view(np.uint8), starts * width, ends * width
    values, count = lanes(data, starts, ends)
    return fold(mix(values + U(seed)), count, ends - starts)


def same_spans(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range [a, a_end) are those of [b, b_end)."""
    same = a_end - a == b_end - b
    rows = np.flatnonzero(same & (a_end > a) & (a != b))
    if len(rows):
        x, count = lanes(data, a[rows], a_end[rows])
        y, _ = lanes(data, b[rows], b_end[rows])
        same[np.repeat(rows, count)[x != y]] = False
    return same


def gram_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within a text, and the index of each text's first of them."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    if len(hashes) < k or not begin[-1]:
        return np.zeros(0, U), begin
    # runs of 1, 2, 4, ... words; those that k is the sum of, from the last on, make the run of k
    power, size, whole, have = hashes, 1, None, 0
    while True:
        if k & size:
            n = len(hashes) - have - size + 1
            whole = power[:n] if whole is None else joined(power[:n], whole[size : size + n])
            have += size
        size *= 2
        if size > k:
            break
        power = joined(power[: len(power) - size // 2], power[size // 2 :])
    return mix(whole[gathered(first[:-1], count)] + U(k)), begin


def owner(first: np.ndarray) -> np.ndarray:
    """For each item the text that holds it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def run_hashes(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``count`` word hashes from ``begin`` on."""
    return fold(values[gathered(begin, count)], count)


def strings(data: np.ndarray, where: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]


def rejoined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    starts, size = starts[keep], (ends - starts)[keep] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    source = gathered(starts, size)
    source[at[1:] - 1] = 0
    out = data[source] if len(source) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 0x20
    text, bound = out.tobytes(), at[np.concatenate([[0], np.cumsum(keep)])[first]]
    return [text[a : max(a, b - 1)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
