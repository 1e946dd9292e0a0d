"""Elias-Fano sequences over numpy: compact, memory-mapped, searched many values at a time."""

from __future__ import annotations

import numpy as np

_SELECT = np.full(8 << 8, 8, np.uint8)  # rank * 256 + byte -> position of that one
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_k * 256 + _b] = _i
_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
_M1, _M2, _M4 = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one (from 0) of each 64-bit word, by sums of byte counts."""
    c = x - ((x >> _U(1)) & _M1)
    c = (c & _M2) + ((c >> _U(2)) & _M2)
    sums = ((c + (c >> _U(4))) & _M4) * _ONES  # byte i: ones in bytes 0 to i
    k = k.astype(np.uint64)
    under = (((k * _ONES) | _TOPS) - sums) & _TOPS  # bytes whose sum is at most k
    at = (((under >> _U(7)) * _ONES) >> _U(53)) & _U(0x78)
    rest = k - (((sums << _U(8)) >> at) & _U(255))
    return (at + _SELECT[((rest << _U(8)) | ((x >> at) & _U(255))).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers.

    Each number's low bits are packed; the high parts are a bit vector in which a zero ends a
    bucket. A count of zeros per 64 bits makes it searchable: a bucket's bounds are two selects,
    and a binary search over low bits ends inside it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        l = max(0, min(63, (universe // max(n, 1)).bit_length() - 1))
        buckets = (universe >> l) + 1
        bits = np.zeros((n + buckets + 63) // 64 * 64, np.uint8)
        bits[((values >> _U(l)).astype(np.int64) + np.arange(n))] = 1
        bits[n + buckets :] = 1  # no zeros past the last bucket
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.zeros(len(high) + 1, np.int64)
        zeros[1:] = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l:
            out, step = low.view(np.uint8), 1 << 16
            for i in range(0, n, step):  # step * l bits are whole bytes
                v = np.ascontiguousarray(values[i : i + step], "<u8").view(np.uint8).reshape(-1, 8)[:, : (l + 7) // 8]
                piece = np.packbits(np.unpackbits(v, axis=1, count=l, bitorder="little").ravel(), bitorder="little")
                out[i * l // 8 : i * l // 8 + len(piece)] = piece
        return cls(n, l, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def from_arrays(cls, a: list[np.ndarray]) -> "EliasFano":
        return cls(int(a[0][0]), int(a[0][1]), *a[1:4])

    def _low(self, i: np.ndarray) -> np.ndarray:
        l = self.low_bits
        if not l:
            return np.zeros(len(i), np.uint64)
        bit = i * l
        w, s = bit >> 6, (bit & 63).astype(np.uint64)
        v = self.low[w] >> s
        over = np.where(s + _U(l) > _U(64), self.low[np.minimum(w + 1, len(self.low) - 1)] << ((_U(64) - s) & _U(63)), _U(0))
        return (v | over) & _U((1 << l) - 1)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the elements of each bucket begin, and where they end."""
        k = np.maximum(h - 1, 0)
        w = np.searchsorted(self.zeros, k, "right") - 1
        pos = np.where(h > 0, w * 64 + select_in_word(~self.high[w], k - self.zeros[w]) + 1, 0)
        # The run of ones from pos on: the bucket's elements.
        w, s = pos >> 6, (pos & 63).astype(np.uint64)
        top = len(self.high) - 1
        ahead = np.where(s > 0, self.high[np.minimum(w + 1, top)] << ((_U(64) - s) & _U(63)), _U(0))
        zero = ~((self.high[np.minimum(w, top)] >> s) | ahead)
        run = np.bitwise_count((zero & (~zero + _U(1))) - _U(1)).astype(np.int64)  # 64 if there is no zero
        lo = pos - h
        long = np.flatnonzero(run >= 64)
        if len(long):
            k = h[long]
            w = np.searchsorted(self.zeros, k, "right") - 1
            run[long] = w * 64 + select_in_word(~self.high[w], k - self.zeros[w]) - pos[long]
        return lo, np.minimum(lo + run, self.n)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of x, and whether x itself is there."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = (x >> _U(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        beyond = h > last
        lo, end = self._bucket(np.minimum(h, last))
        hi = end.copy()
        want = x & _U((1 << self.low_bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            a, b = lo[live], hi[live]
            mid = (a + b) >> 1
            under = self._low(mid) < want[live]
            a, b = np.where(under, mid + 1, a), np.where(under, b, mid)
            lo[live], hi[live] = a, b
            live = live[a < b]
        found = (lo < end) & ~beyond
        i = np.flatnonzero(found)
        found[i] = self._low(lo[i]) == want[i]
        return np.where(beyond, self.n, lo), found

    def lower_bound(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element not under x (n if none); x best sorted."""
        return self._search(x)[0]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements at indexes i."""
        i = np.asarray(i, np.int64)
        ones = self._ones()
        w = np.searchsorted(ones, i, "right") - 1
        pos = w * 64 + select_in_word(self.high[w], i - ones[w])
        return ((pos - i).astype(np.uint64) << _U(self.low_bits)) | self._low(i)

    def _ones(self) -> np.ndarray:
        """Counts of ones before each word: 64 less the zeros; kept once made."""
        if not hasattr(self, "_o"):
            self._o = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        return self._o

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        at, found = self._search(x)
        return np.where(found, at, -1)

    def values(self) -> np.ndarray:
        """All elements, decoded in one sweep."""
        n, l = self.n, self.low_bits
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[:n]
        out = (ones - np.arange(n)).astype(np.uint64) << _U(l)
        if l:
            low, step = self.low.view(np.uint8), 1 << 16
            for i in range(0, n, step):
                k = min(step, n - i)
                bits = np.unpackbits(low[i * l // 8 : (i + k) * l // 8 + 1], count=k * l, bitorder="little").reshape(k, l)
                whole = np.zeros((k, 8), np.uint8)
                whole[:, : (l + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
                out[i : i + k] |= whole.view("<u8")[:, 0]
        return out


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another at multiples of 64 bytes, after a table of kinds and lengths."""
    head = np.zeros(1 + 2 * len(arrays), np.int64)
    head[0] = len(arrays)
    kinds = [np.dtype(x) for x in ("uint64", "int64", "uint16", "float64", "uint8")]
    for i, a in enumerate(arrays):
        head[1 + 2 * i : 3 + 2 * i] = kinds.index(a.dtype), len(a)
    out = bytearray(head.tobytes())
    for a in arrays:
        out += b"\0" * (-len(out) % 64)
        out += a.tobytes()
    return bytes(out)


def from_buffer(buf) -> list[np.ndarray]:
    """The arrays, without copying them."""
    kinds = [np.dtype(x) for x in ("uint64", "int64", "uint16", "float64", "uint8")]
    n = int(np.frombuffer(buf, np.int64, 1)[0])
    head = np.frombuffer(buf, np.int64, 1 + 2 * n)
    at, out = head.nbytes, []
    for i in range(n):
        at += -at % 64
        kind, size = kinds[int(head[1 + 2 * i])], int(head[2 + 2 * i])
        out.append(np.frombuffer(buf, kind, size, at))
        at += kind.itemsize * size
    return out
