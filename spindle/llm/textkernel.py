"""Words, hashes and packed arrays for the Arrow stages."""

from __future__ import annotations

import struct

import numpy as np
import xxhash
import zstandard

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; bytes.split() parts at U+0020 and U+0009 to U+000D only."""
    return text.lower().split() if text else []


class Vocabulary(dict):
    """Word to number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self), dtype=np.uint64, count=len(self))


def mix(a: np.ndarray, k: int = 0, bits: int = 64) -> np.ndarray:
    """Maps numbers of so many bits one to one onto such numbers."""
    mask = np.uint64((1 << bits) - 1)
    a = a ^ (a >> np.uint64(31))
    for step, shift in ((0, 29), (1, 32)):
        a *= MIX[(k + step) % 3]
        if bits < 64:
            a &= mask
        a ^= a >> np.uint64(shift)
    return a


def unmix(a: np.ndarray, k: int = 0, bits: int = 64) -> np.ndarray:
    """The numbers that ``mix`` maps to ``a``."""
    mask = np.uint64((1 << bits) - 1)
    back = [np.uint64(pow(int(m), -1, 1 << 64)) for m in MIX]
    a = ((a ^ (a >> np.uint64(32))) * back[(k + 1) % 3]) & mask
    a = ((a ^ (a >> np.uint64(29)) ^ (a >> np.uint64(58))) * back[k % 3]) & mask
    return a ^ (a >> np.uint64(31)) ^ (a >> np.uint64(62))


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), a.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    (n,), at, out = struct.unpack_from("<H", data), 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", data, at)
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(data, dtype, size, at + 10))
        at += 10 + size * dtype.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, one without words has none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    seen = Vocabulary()
    ids = np.fromiter(map(seen.__getitem__, w), np.int64, len(w))
    return np.unique(fold(seen.hashes()[ids], k))


def fold(h: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out + h[i : i + n], i)
    return out
