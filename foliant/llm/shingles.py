"""Word shingles as 64-bit names, and token orders over them."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words, so that each seed is an order without ties."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text, ascending; with fewer words than a shingle has, the whole sequence is one; without words there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        acc = mix(acc * _M[0] + names[k : len(words) - n + 1 + k])
    acc.sort()
    keep = np.empty(len(acc), bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


#: Tokens are counted by buckets of their names.
BUCKETS = 1 << 22


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(42)).astype(np.int64)


class Orders:
    """Total orders of the tokens: those of buckets that aren't full first, in an order of their own for each seed; then the others, those of less full buckets first.

    The counts decide how long lists of documents get, never what is found: any total order gives a valid prefix filter."""

    def __init__(self, buckets: np.ndarray, counts: np.ndarray):
        self.full = np.zeros(BUCKETS, np.uint32)
        self.full[buckets] = np.minimum(counts, 2**31)

    def __getstate__(self):
        at = np.flatnonzero(self.full)
        return at, self.full[at]

    def __setstate__(self, state):
        self.__init__(*state)

    def ranks(self, found: np.ndarray, seed: int) -> np.ndarray:
        key = mix(found, seed) >> np.uint64(1)
        counts = self.full[bucket(found)]
        often = counts > 0
        key[often] = np.uint64(1 << 63) | (counts[often].astype(np.uint64) << np.uint64(31)) | (key[often] >> np.uint64(32))
        return key

    def prefix(self, found: np.ndarray, seed: int) -> np.ndarray:
        """The tokens of the prefix in the order; found ascends, which settles equal ranks."""
        size = prefix_size(len(found))
        return found[np.argsort(self.ranks(found, seed), kind="stable")[:size]]


def need(a, b):
    """The least intersection of sets of these sizes with 100 * intersection >= 75 * union."""
    return -((a + b) * -3 // 7)


def prefix_size(n: int) -> int:
    """A linked set of any size shares at least ceil(3 n / 4) tokens with this one."""
    return n - -(n * -3 // 4) + 1 if n else 0


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each bucket holds an odd number of the tokens, as bits in 64-bit words; there are as many buckets as the next power of two.

    Two sets differ in at least as many tokens as their bits differ; the halves of a longer row of bits, one xor the other, are the next shorter row."""
    size = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)
