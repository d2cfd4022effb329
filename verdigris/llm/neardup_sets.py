"""Word shingles of whole texts as 64-bit hashes, and min-max signatures of the shingle sets, all in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

M64 = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed, by the splitmix sequence."""
    out = []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & M64
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


BYTE_CODE = _constants(256, 11)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE = BYTE_CODE[LOWER]
#: Powers of an odd multiplier and of its inverse modulo 2**64 let a prefix sum give the hash of any word.
_MULTIPLIER = 0x5851F42D4C957F2D
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
STRETCH = 1 << 19
PLACE = _constants(64, 23)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def run_hashes(values: np.ndarray, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[starts[i]:ends[i]], which come in order and do not overlap; ``code`` gives each value's number."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # runs in stretches of bounded length, so that the sums' room is bounded for any text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(code[values[low:high]] * _powers(_MULTIPLIER, high - low), out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * _powers(_INVERSE, high - low)[starts[i:j] - low]
        i = j
    hashes += (ends - starts).astype(np.uint64) * PLACE[63]
    return mix(hashes)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in the texts' order, and for each text the number of words before it (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets[:-1]] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    edge[offsets[1:]] = True
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return run_hashes(data, BYTE_CODE, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of each text, repeated ones included, and where each text's begin.

    A text of fewer than ``width`` words, but not none, has its whole sequence as one window.
    """
    counts = np.diff(first)
    own = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum(own, out=begin[1:])
    out = np.empty(begin[-1], dtype=np.uint64)
    if len(words) >= width:
        every = words[: len(words) - width + 1] * PLACE[0]
        for k in range(1, width):
            every += words[k : len(words) - width + 1 + k] * PLACE[k]
        long = counts >= width
        take = np.ones(len(every), dtype=bool)
        for back in range(1, width):  # windows that would run over a text's end
            at = first[1:] - back
            take[at[(at >= 0) & (at < len(every))]] = False
        spots = np.ones(len(out), dtype=bool)
        spots[begin[:-1][(counts > 0) & ~long]] = False
        out[spots] = every[take]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = words[first[i] : first[i + 1]]
        out[begin[i]] = (int((part * PLACE[: len(part)]).sum(dtype=np.uint64)) + len(part) * int(PLACE[62])) & M64
    return mix(out), begin


def distinct(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each text."""
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        own = np.sort(hashes[a:b])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if b - a > 1 else own)
    return out


def set_key(own: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set: equal sets and only those share it."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


class MinMax:
    """Signatures that keep both the smallest and the largest value under each permutation.

    Both ends of one random order hit the intersection with a chance equal (minimum or maximum
    alone) to the Jaccard similarity, so p permutations give 2p components for p hash
    evaluations a shingle. A band holds ``rows`` minima or ``rows`` maxima of different
    permutations; for one permutation, a lost minimum makes a kept maximum a little likelier,
    so the bands miss no more pairs than independent ones would.
    """

    def __init__(self, permutations: int = 64, rows: int = 4, seed: int = 5) -> None:
        if permutations % rows:
            raise ValueError("rows must divide permutations")
        self.p, self.rows = permutations, rows
        self.bands = 2 * permutations // rows
        self.xor, self.mul = _constants(permutations, seed), _constants(permutations, seed + 1)
        self.band_code = _constants(2 * permutations, seed + 2)

    def sign(self, hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Signatures of texts that all have shingles: minima in the first p columns, maxima in the others."""
        n = len(begin) - 1
        out = np.empty((n, 2 * self.p), dtype=np.uint64)
        i = 0
        while i < n:  # texts whose shingles fit the cache together
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + 32768, "right")) - 1)
            part, at = hashes[begin[i] : begin[j]], begin[i:j] - begin[i]
            room = np.empty_like(part)
            for k in range(self.p):
                np.bitwise_xor(part, self.xor[k], out=room)
                np.multiply(room, self.mul[k], out=room)
                out[i:j, k] = np.minimum.reduceat(room, at)
                out[i:j, self.p + k] = np.maximum.reduceat(room, at)
            i = j
        return out

    def band_hashes(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band; a band's number is part of it."""
        coded = mix(signatures) * self.band_code
        summed = coded.reshape(len(signatures), self.bands, self.rows).sum(axis=2, dtype=np.uint64)
        return mix(summed + np.arange(1, self.bands + 1, dtype=np.uint64) * PLACE[61])

    def sketch(self, signatures: np.ndarray) -> np.ndarray:
        """One byte of each component: enough to estimate a similarity, at an eighth of the size."""
        return (mix(signatures) >> np.uint64(56)).astype(np.uint8)
