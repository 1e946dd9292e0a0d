"""64-bit hashes of all words of many texts at once, from their bytes.

A word's hash is the sum of a random number for each byte times a power of an odd constant,
read off running sums modulo 2^64 and scrambled. A-Z share the numbers of a-z, so hashes are
those of the lower-cased word. No word is ever made a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from larkspur.llm.common import mix64

_U = np.uint64
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 18), b, np.uint64)
            x[0] = 1
            _power[i] = np.multiply.accumulate(x)
    return _power[0], _power[1]


def _piece(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, beginning at `begin` (which ends with the length), and how many each has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(begin) - 1, np.int64)
    power, inverse = _powers(n)
    space = _SPACE[data]
    inside = ~space
    edge = np.r_[True, space]  # before each byte; last: after the end
    edge[begin] = True
    edge[n] = True
    start = np.flatnonzero(inside & edge[:-1])
    after = np.r_[space[1:], True]
    cut = begin[1:][begin[1:] > 0] - 1
    after[cut] = True
    end = np.flatnonzero(inside & after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, begin))


def hash_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, row after row, and the count of words of each row; null has none."""
    binary = column.cast(pa.large_binary())
    raw = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    offset = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    valid = np.ones(len(binary), bool) if not binary.null_count else np.asarray(binary.is_valid())
    out, counts = [], np.zeros(len(binary), np.int64)
    i = 0
    while i < len(binary):
        j = i + 1
        while j < len(binary) and offset[j + 1] - offset[i] <= PIECE:
            j += 1
        data = raw[offset[i] : offset[j]]
        if len(data) <= PIECE:
            h, counts[i:j] = _piece(data, offset[i : j + 1] - offset[i])
            out.append(h)
        else:  # one long text, in pieces that end at white space
            at = 0
            while at < len(data):
                stop = min(at + PIECE, len(data))
                while stop < len(data):
                    gap = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop = min(stop + PIECE, len(data))
                h, c = _piece(data[at:stop], np.array([0, stop - at]))
                out.append(h)
                counts[i] += c[0]
                at = stop
        i = j
    counts[~valid] = 0
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def hash_word(word: bytes) -> int:
    """The same hash of one word, plainly."""
    total, power = 0, 1
    for b in word:
        total += int(_TABLE[b]) * power
        power = power * _BASE % (1 << 64)
    return int(mix64(np.array([(total + len(word)) % (1 << 64)], np.uint64))[0])
