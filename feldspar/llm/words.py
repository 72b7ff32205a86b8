"""Words of a text: as bytes, and as 64-bit hashes for shingles.

The hash of a word of up to eight bytes is a bijection of its bytes; that of a longer one is its BLAKE2b digest, so that no rule makes
two different words alike.  That any two of n long words or shingles are alike is a chance of n * n / 2 ** 65."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Digests of longer words that a worker keeps, and bytes of the longest word among them.
KNOWN, LONGEST = 200_000, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def table(ranges: list[tuple[int, int]]) -> bytes:
    """For each byte what to search words in: A-Z in lower case, and a blank for bytes that, lower-cased, are in none of the ranges."""
    low = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if any(x <= b <= y for x, y in ranges) else 0x20 for b in low)


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
NOT_SPACE = table([(0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF)])
WORD_BYTES = table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


def words(text: str | None, member: bytes) -> list[bytes]:
    """Every word in UTF-8, A-Z lower-cased, in order.  (The table has made blanks of \\x09-\\x0D, where split() splits too.)"""
    return text.encode("utf-8", "surrogatepass").translate(member).split() if text else []


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST:
            self[word] = h
        return h


_digests = _Digests()
#: For each length up to eight: the bits of so many bytes, and what tells lengths apart (a word has no byte 0x20).
_BITS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BLANKS = np.uint64(0x2020202020202020)


def word_hashes(text: str | None, member: bytes) -> np.ndarray:
    """The hash of every word, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").translate(member)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data, np.uint8) != 0x20
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    eight = np.ndarray(len(data), "<u8", data + bytes(8), 0, (1,))  # the eight bytes from each place on
    bits = _BITS[np.minimum(size, 8)]
    h = mix((eight[starts] & bits | _BLANKS & ~bits) + _STEP)
    long_ = np.flatnonzero(size > 8)
    h[long_] = [_digests[data[a:b]] for a, b in zip(starts[long_].tolist(), ends[long_].tolist())]
    return h


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of size words, sorted; of fewer words, but some, the whole as one."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _STEP + words[i : n - k + 1 + i])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]
