"""Words of many texts at once: their places and their XXH3 hashes, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that an array of texts needs after its last word, so that eight can be read anywhere.
PADDING = 8
U = np.uint64
_SECRET = bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c")
_FLIP_3 = U(int.from_bytes(_SECRET[:4], "little") ^ int.from_bytes(_SECRET[4:8], "little"))
_FLIP_8, _FLIP_LOW, _FLIP_HIGH = (U(int.from_bytes(_SECRET[k : k + 8], "little") ^ int.from_bytes(_SECRET[k + 8 : k + 16], "little")) for k in (8, 24, 40))


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words, in bytes."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = (data == 0x20) | (data - np.uint8(0x09) <= 0x0D - 0x09)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The halves of the products of 128 bits, one XOR the other."""
    half, low = U(32), U(0xFFFFFFFF)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    middle = a1 * b0
    cross = (a0 * b0 >> half) + (middle & low) + a0 * b1
    return a * b ^ (middle >> half) + (cross >> half) + a1 * b1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``xxhash.xxh3_64_intdigest`` of data[start:end] for each word, after which ``data`` has PADDING more bytes."""
    sizes = ends - starts
    out = np.empty(len(sizes), U)
    four, eight = (np.ndarray(len(data) - PADDING + 1, kind, data, 0, (1,)) for kind in ("<u4", "<u8"))
    if len(own := np.flatnonzero(sizes <= 3)):
        a, n = starts[own], sizes[own]
        h = data[a].astype(U) << U(16) | data[a + (n >> 1)].astype(U) << U(24) | data[a + n - 1] | n.astype(U) << U(8)
        h ^= _FLIP_3
        h = (h ^ h >> U(33)) * U(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> U(29)) * U(0x165667B19E3779F9)
        out[own] = h ^ h >> U(32)
    if len(own := np.flatnonzero((sizes > 3) & (sizes <= 8))):
        a, n = starts[own], sizes[own]
        h = (four[a + n - 4] + (four[a].astype(U) << U(32))) ^ _FLIP_8
        h ^= (h << U(49) | h >> U(15)) ^ (h << U(24) | h >> U(40))
        h *= U(0x9FB21C651E98DF25)
        h ^= (h >> U(35)) + n.astype(U)
        h *= U(0x9FB21C651E98DF25)
        out[own] = h ^ h >> U(28)
    if len(own := np.flatnonzero((sizes > 8) & (sizes <= 16))):
        a, n = starts[own], sizes[own]
        low, high = eight[a] ^ _FLIP_LOW, eight[a + n - 8] ^ _FLIP_HIGH
        h = n.astype(U) + low.byteswap() + high + _folded(low, high)
        h = (h ^ h >> U(37)) * U(0x165667919E3779F9)
        out[own] = h ^ h >> U(32)
    if len(own := np.flatnonzero(sizes > 16)):
        whole = memoryview(data)
        out[own] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
    return out
