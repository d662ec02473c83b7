"""A serialisable Bloom filter over canonical key bytes, vectorised.

Keys are hashed by FNV-1a with 128 bits, in two 64-bit limbs for whole columns
at a time; the k indices of a key come from its two halves.  Bits, sizes and
estimates are those of the published formulas, bit for bit.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from tessera.errors import CorruptFilter, InvalidParameters
from tessera.schema import FLOAT64, INT64

# fixed values of the hash: offset basis and the low part of the prime 2**88 + 0x13b
_BASIS = 0x6C62272E07BB014262B821756295C58D
_LOW = np.uint64(0x13B)
_HALF, _32, _24 = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(24)


def key_bytes(value: int | float | str, kind: str) -> bytes:
    """Eight little-endian bytes of a number (of a float: its bits), or the UTF-8 of a string."""
    if kind == INT64:
        return struct.pack("<q", value)
    return struct.pack("<d", value) if kind == FLOAT64 else value.encode()


def key_matrix(values, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many keys as a padded matrix, and their lengths."""
    if kind in (INT64, FLOAT64):
        flat = np.ascontiguousarray(values, "<i8" if kind == INT64 else "<f8")
        return flat.view(np.uint8).reshape(len(flat), 8), np.full(len(flat), 8)
    raw = [v.encode() for v in values]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    wide = int(sizes.max(initial=0))
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raw), np.uint8).reshape(len(raw), wide) if wide else np.zeros((len(raw), 0), np.uint8), sizes


def hash128(matrix: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of each key's hash."""
    high = np.full(len(matrix), _BASIS >> 64, np.uint64)
    low = np.full(len(matrix), _BASIS & (1 << 64) - 1, np.uint64)
    for k in range(matrix.shape[1]):
        live = k < sizes
        x = low ^ matrix[:, k]
        # times 2**88 + 0x13b: a shift of the low limb into the high one, and a small product with carry
        a, b = (x & _HALF) * _LOW, (x >> _32) * _LOW
        lo = a + (b << _32)
        carry = (b >> _32) + (lo < a)
        hi = high * _LOW + carry + (x << _24)
        low, high = np.where(live, lo, low), np.where(live, hi, high)
    return high, low


#: Keys that are offered to a filter at once.
BLOCK = 1 << 13


class BloomFilter:
    def __init__(self, m: int, k: int, bits: np.ndarray | None = None, n_added: int = 0) -> None:
        self.m, self.k, self.n_added = m, k, n_added
        self.bits = np.zeros((m + 7) // 8, np.uint8) if bits is None else bits

    @classmethod
    def sized(cls, expected: int, rate: float) -> BloomFilter:
        """m = ceil(-n ln p / ln2**2) bits, k = round(m / n ln2) hashes, from 1 to 30."""
        if expected <= 0:
            raise InvalidParameters("expected items must be > 0")
        if not 0 < rate < 1:
            raise InvalidParameters(f"target rate must be in (0, 1), got {rate}")
        bits = -expected * math.log(rate) / (math.log(2) * math.log(2))
        if not 0 < bits <= (1 << 63) - 1:
            raise InvalidParameters(f"derived size {bits} out of range")
        m = max(1, math.ceil(bits))
        return cls(m, min(30, max(1, math.floor(m / expected * math.log(2) + 0.5))))

    def indices(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """keys x k bit places."""
        i = np.arange(self.k, dtype=np.uint64)
        return (high[:, None] + i * low[:, None]) % np.uint64(self.m)

    def contains_hashed(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = self.indices(high, low)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add_hashed(self, high: np.ndarray, low: np.ndarray) -> None:
        at = self.indices(high, low).ravel()
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.n_added += len(high)

    def admit(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Offer keys one after another: which were not contained (and are added).

        A key's verdict depends on those admitted before it.  In a block of keys
        most have a bit that neither the filter nor any key before them has, and
        are admitted together; only the others are looked at in turn.
        """
        out = np.zeros(len(high), bool)
        for start in range(0, len(high), BLOCK):
            at = self.indices(high[start : start + BLOCK], low[start : start + BLOCK]).astype(np.int64)
            missing = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
            owner = np.repeat(np.arange(len(at)), missing.sum(axis=1))
            kinds, first, bit = np.unique(at[missing], return_index=True, return_inverse=True)
            taken = np.zeros(len(at), bool)
            taken[owner[first]] = True
            rest = np.flatnonzero(missing.any(axis=1) & ~taken)
            if len(rest):
                # the first key admitted with each bit
                least = np.full(len(kinds), len(at))
                sure = taken[owner]
                np.minimum.at(least, bit[sure], owner[sure])
                for i, a, z in zip(rest.tolist(), np.searchsorted(owner, rest).tolist(), np.searchsorted(owner, rest, "right").tolist()):
                    if (least[bit[a:z]] > i).any():
                        taken[i] = True
                        least[bit[a:z]] = np.minimum(least[bit[a:z]], i)
            new = at[taken].ravel()
            np.bitwise_or.at(self.bits, new >> 3, (1 << (new & 7)).astype(np.uint8))
            out[start : start + BLOCK] = taken
        self.n_added += int(out.sum())
        return out

    def add(self, key: bytes) -> None:
        self.add_hashed(*self._one(key))

    def __contains__(self, key: bytes) -> bool:
        return bool(self.contains_hashed(*self._one(key))[0])

    @staticmethod
    def _one(key: bytes) -> tuple[np.ndarray, np.ndarray]:
        return hash128(np.frombuffer(key, np.uint8).reshape(1, -1), np.array([len(key)]))

    @property
    def estimated_rate(self) -> float:
        return estimated_rate(self.m, self.k, self.n_added)

    def to_bytes(self) -> bytes:
        """m u64, k u8, added u64, length as a varint, bits; little-endian."""
        return struct.pack("<QBQ", self.m, self.k, self.n_added) + varint(len(self.bits)) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BloomFilter:
        if len(raw) < 18:
            raise CorruptFilter("too short")
        m, k, added = struct.unpack_from("<QBQ", raw)
        size, at = read_varint(raw, 17, CorruptFilter)
        if not m or size != (m + 7) // 8 or not 1 <= k <= 30 or len(raw) - at != size:
            raise CorruptFilter(f"m={m} k={k} with {len(raw) - at} bytes of bits, {size} told")
        return cls(m, k, np.frombuffer(raw, np.uint8, offset=at).copy(), added)


def estimated_rate(m: int, k: int, added: int) -> float:
    return (1 - math.exp(-k * added / m)) ** k if added else 0.0


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(raw: bytes, at: int, error: type[Exception]) -> tuple[int, int]:
    """The number and the place after it."""
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise error("bad varint")
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
