"""MD5 of many short byte strings at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Strings up to this length fill one block of MD5, together with its padding.
ONE_BLOCK = 55
#: Strings per pass: enough that calls of numpy cost little beside their work.
_PASS = 65536
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _one_block(words: np.ndarray, used: int) -> np.ndarray:
    """First 64 bits of the digests of blocks (16, n); of their words, *used* and the length's may differ from 0."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _START)
    t = np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            f = np.bitwise_xor(c, d)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            f = np.bitwise_xor(b, c)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            f = np.bitwise_xor(b, c)
            f ^= d
        else:
            g = 7 * i % 16
            f = np.invert(d)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if g < used or g == 14:
            f += words[g]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        f <<= np.uint32(_TURNS[i])
        f |= t
        f += b
        a, d, c, b = d, c, b, f
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def md5_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of md5(data[start:end]), as numbers in the order of the hex digits, of bytes *data*."""
    out, lengths = np.empty(len(starts), np.uint64), ends - starts
    for i in np.flatnonzero(lengths > ONE_BLOCK):
        out[i] = int.from_bytes(hashlib.md5(data[starts[i]:ends[i]].tobytes()).digest()[:8], "big")
    # strings of like lengths go together, so that blocks are no wider than needed
    order = np.argsort(np.minimum(lengths, ONE_BLOCK + 1).astype(np.uint8), kind="stable")
    order = order[:len(order) - np.count_nonzero(lengths > ONE_BLOCK)]
    padded = np.concatenate([data, np.zeros(ONE_BLOCK + 1, np.uint8)])
    for at in range(0, len(order), _PASS):
        some = order[at:at + _PASS]
        size = lengths[some]
        width = (int(size[-1]) // 4 + 1) * 4
        block = np.lib.stride_tricks.sliding_window_view(padded, width)[starts[some]]
        block *= np.arange(width, dtype=np.uint8) < size.astype(np.uint8)[:, None]
        block[np.arange(len(some)), size] = 0x80
        words = np.zeros((16, len(some)), np.uint32)
        words[:width // 4] = block.view("<u4").T
        words[14] = size * 8
        out[some] = _one_block(words, width // 4)
    return out
