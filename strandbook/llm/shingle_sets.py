"""Shingle sets of texts and their partition signatures: small helpers that run inside Spark tasks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash

# One odd multiplier for each place in a shingle, and the two multipliers of the finaliser (splitmix64): fixed values.
PLACES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are maximal runs without ASCII white space, with A-Z lower-cased. A text of fewer than
    ``width`` words has its whole word sequence as its only element; null or no words: empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words)
    span = min(n, width)
    total = np.full(n - span + 1, np.uint64(span), np.uint64)
    for place in range(span):
        total += hashes[place : n - span + 1 + place] * np.uint64(PLACES[place])
    return np.unique(mix(total))


def set_key(elements: np.ndarray) -> int:
    """Signed 64-bit identity of a set."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def parity(elements: np.ndarray, longs: int) -> np.ndarray:
    """Bits that say whether an odd number of elements falls on them, as signed 64-bit words.

    The Hamming distance of two such sketches is at most the size of the sets' symmetric difference.
    """
    bits = np.bincount((elements & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fine_parity(elements: np.ndarray) -> bytes:
    """A parity sketch that grows with the set: the power of two of at least twice as many bits, 512 at least."""
    longs = 8
    while 64 * longs < 2 * len(elements):
        longs *= 2
    return parity(elements, longs).tobytes()


def may_reach(a_size: int, a_fine: bytes, b_size: int, b_fine: bytes, num: int, den: int) -> bool:
    """Exact bound from two fine sketches; the longer one is folded onto the shorter."""
    a, b = np.frombuffer(a_fine, np.uint64), np.frombuffer(b_fine, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    apart = int(np.bitwise_count(a ^ folded).sum())
    return apart * (num + den) <= (a_size + b_size) * (den - num)


class Bands:
    """Size bands and their PartEnum parameters for a Jaccard threshold of num/den.

    Two sets that reach the threshold have sizes in one band or in neighbouring bands, and differ in at
    most ``allowed(band)`` = k elements, band being that of the larger one. The element domain is hashed
    into ``parts`` first-level parts of SUBPARTS second-level parts each. With k // (LOOSE + 1) + 1 + spare
    parts, the two sets differ in at most LOOSE elements in 1 + spare of them at least (else they would
    differ in more than k), and agree there on some subset of SUBPARTS - LOOSE second-level parts.
    """

    LOOSE, SUBPARTS = 1, 3

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den, self.tops = num, den, [1]
        while self.tops[-1] < largest:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * den // num))
        self._tops = np.array(self.tops)
        self.subsets = np.array([[j not in out for out in combinations(range(self.SUBPARTS), self.LOOSE)] for j in range(self.SUBPARTS)], np.uint64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self._tops, size))

    def allowed(self, band: int) -> int:
        return 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> tuple[int, int]:
        """First-level parts of a band, and how many of them are spare."""
        base = self.allowed(band) // (self.LOOSE + 1) + 1
        spare = (base + 4) // 8
        return base + spare, spare


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """Signed 64-bit signatures of one set, for its own band and the next one.

    A signature hashes the band, the first-level part, the subset of second-level parts, and the elements
    that fall into these. Signatures over few elements are shared by chance, so each set leaves out those
    below a count of its own, the largest that touches at most ``spare`` first-level parts. Of two near
    sets, the one with the higher count leaves out what both leave out together, so that in one of their
    1 + spare nearly equal parts everything is still there.
    """
    size = len(elements)
    found = []
    if size:
        own, width, subsets = bands.of(size), bands.SUBPARTS, bands.subsets
        for band in (own, own + 1):
            if bands.allowed(band) == 0 or band > own and size * bands.den // bands.num <= bands.tops[own]:
                continue
            parts, spare = bands.parts(band)
            tag = np.uint64(band * PLACES[1] & (1 << 64) - 1)
            hashed = mix(elements + tag)
            cell = (((hashed >> np.uint64(32)) * np.uint64(parts * width)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(cell.astype(np.uint16) if parts * width < 1 << 16 else cell, kind="stable")
            held = cell[order]
            first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            sums = np.zeros(parts * width, np.uint64)
            sums[held[first]] = np.add.reduceat(hashed[order], first)
            counts = np.bincount(cell, minlength=parts * width).astype(np.uint64)
            sums, counts = sums.reshape(parts, width) @ subsets, counts.reshape(parts, width) @ subsets
            least = np.partition(counts.min(1), spare)[spare]
            place = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape)
            found.append(mix(sums + mix(place + np.uint64(PLACES[3]) + tag))[counts >= least])
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def reaches(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets have den * intersection >= num * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * den < len(large) * num:
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return both * den >= num * (len(a) + len(b) - both)
