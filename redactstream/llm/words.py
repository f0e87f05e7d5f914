"""Words and word shingles of many texts at once, as arrays over their UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64
# Odd multipliers for the places in a shingle, from the base by powers.
PLACES = np.multiply.accumulate(np.full(16, BASE ^ 0x5851F42D4C957F2C | 1, U))


def mix(h):
    """Spread 64 bits over 64 bits, one to one."""
    h = np.asarray(h, U)
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Powers:
    """Hashes of byte spans from one running sum, with powers kept between calls."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def spans(self, data, begin, end):
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = (
                np.concatenate([[U(1)], np.multiply.accumulate(np.full(n, b, U))])
                for b in (U(BASE), U(pow(BASE, -1, 1 << 64)))
            )
        run = np.empty(n, U)
        run[0] = 0
        np.cumsum((data.astype(U) + U(1)) * self.up[: n - 1], out=run[1:])
        return (run[end] - run[begin]) * self.down[begin]


#: What is left of 8 bytes of which so many belong to a span.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
INLINE = 16


def word_keys(data, begin, end):
    """Two 64-bit numbers per byte span, which tell apart spans of one length.

    Spans of up to 16 bytes are the numbers themselves; of longer ones they are a cryptographic
    digest, as any sum over bytes can be made to collide on purpose.
    """
    size = end - begin
    words = np.ndarray(len(data) + 9, "<u8", np.concatenate([data, np.zeros(INLINE, np.uint8)]), strides=(1,))
    first = words[begin] & KEEP[np.minimum(size, 8)]
    second = np.zeros(len(size), U)
    wide = np.flatnonzero(size > 8)
    second[wide] = words[begin[wide] + 8] & KEEP[np.minimum(size[wide] - 8, 8)]
    long = np.flatnonzero(size > INLINE)
    if len(long):
        raw = memoryview(data.tobytes())
        digest = [
            hashlib.blake2b(raw[i:j], digest_size=16).digest()
            for i, j in zip(begin[long].tolist(), end[long].tolist())
        ]
        first[long], second[long] = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2).T
    return first, second


def fold(first, second, size, key: tuple[int, int] = (0, 0)):
    """One 64-bit hash of a word key and its length, under a key of two numbers."""
    h = mix(first ^ U(key[0])) + size.astype(U) * U(0xD6E8FEB86659FD93)
    wide = np.flatnonzero(second)
    h[wide] += mix(second[wide] ^ U(key[1])) * U(0xA0761D6478BD642F)
    return mix(h)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Splits texts at ASCII white space, lower-cases A-Z and hashes each word to 64 bits.

    Hashes agree between tasks that hold the same key. With a key drawn at random, no text can
    be written so that different words or shingles share a hash.
    """

    def __init__(self, key: tuple[int, int] = (0, 0)):
        self.key = key

    def split(self, texts: list):
        """Word hashes of all texts, and where each text's words start (one more entry ends them)."""
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        at = np.cumsum([0] + [len(b) + 1 for b in raw])
        gap = SPACE[data]
        before = np.concatenate([[True], gap[:-1]])
        begin, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        return fold(*word_keys(LOWER[data], begin, end), end - begin, self.key), np.searchsorted(begin, at)


def shingle_hashes(h, at, width: int = 5):
    """Shingle hashes of texts from their words, and where each text's shingles start.

    A text of fewer words than the width has one shingle, its whole sequence; a text without
    words has none.
    """
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - start[:-1], count) + np.arange(start[-1])
    size = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate([h, np.zeros(width, U)])
    out = size.astype(U)
    for j in range(width):
        out += np.where(size > j, padded[first + j] * PLACES[j], U(0))
    return mix(out), start
