"""Word shingles and parity sketches of texts."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd multipliers without a pattern.
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct ``size``-word shingles of lower-cased (A-Z) words; the whole sequence
    where it has fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(len(w), size)
    h = np.full(len(w) - n + 1, n, dtype=np.uint64) * _P[3]
    for k in range(n):
        h = (h ^ w[k : len(w) - n + 1 + k]) * _P[k % 3] + _P[3]
    return np.unique(mixed(h))


def signature(s: np.ndarray) -> bytes:
    """A 128-bit identity of a set; zeros only for the empty one. The first half serves where a rare clash does no harm."""
    if not len(s):
        return bytes(16)
    both = np.array([mixed(s * _P[0]).sum(dtype=np.uint64), np.bitwise_xor.reduce(s) + np.uint64(len(s)), mixed(s + _P[1]).sum(dtype=np.uint64)], dtype=np.uint64)
    out = [mixed(both * p + np.roll(both, 1) * q).sum(dtype=np.uint64) for p, q in ((_P[1], _P[2]), (_P[3], _P[0]))]
    return np.array([out[0] or 1, out[1]], dtype=np.uint64).tobytes()


class Bands:
    """Size bands and blocks for a similarity of ``percent``: which sets can link, and how far apart they can be."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.blocks_of = percent, [1], {}

    def band(self, n: int) -> int:
        """The band of a set of ``n`` members; it links with sets of this band and the two beside it."""
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 100 // self.percent)))
        return bisect_right(self.starts, n) - 1

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks for pairs of which the larger lies in ``band``, and how many of them agree at least: linked sets
        differ in at most H members, and each spoils one block. The spare blocks outnumber the empty ones that a set
        of the pair is likely to have. (0, 0) where linked sets are equal."""
        if band not in self.blocks_of:
            self.band(self.starts[-1] + 1 if band + 1 >= len(self.starts) else 1)
            while band + 1 >= len(self.starts):
                self.band(self.starts[-1] + 1)
            far = 2 * (self.starts[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            least, spare = self.starts[max(band - 1, 0)], 2
            for _ in range(8):
                empty = (far + spare) * np.exp(-least / (far + spare))
                spare = int(np.ceil(empty + 5 * np.sqrt(empty))) + 2
            self.blocks_of[band] = (far + spare, spare) if far else (0, 0)
        return self.blocks_of[band]


@lru_cache(maxsize=None)
def bands_of(percent: int) -> Bands:
    return Bands(percent)


def sketch(s: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity sketch of a set: for each block 64 bits that the block's members toggled, the exclusive or of their
    hashes, and their number. Each member toggles one bit, so the bits in which two sketches differ are at most as
    many as the members that the sets do not share."""
    at = (s % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, m = at[order], mixed(s[order] ^ _P[3])
    begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    bits, check, number = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64), np.bincount(at, minlength=blocks)
    bits[at[begins]] = np.bitwise_xor.reduceat(np.uint64(1) << (m >> np.uint64(58)), begins)
    check[at[begins]] = np.bitwise_xor.reduceat(m, begins)
    return bits, check, number


def block_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set for the pigeonhole join: two sets that link share one at least, or are equal.

    A set is listed in the band of its size and the next, as a larger partner may lie there. A block's token is its number,
    parity and checksum. Linked sets agree in as many of a pair's blocks as there are spare ones; so if all tokens are put
    in one order, the same for every set, the two share one of the first ``far + 1``, and only these are listed. Empty
    blocks come last in that order; a set that has to list one of them lists a key that stands for any.
    """
    n, out = len(s), []
    if not n:
        return np.zeros(0, dtype=np.int64)
    of = bands_of(percent)
    own = of.band(n)
    for b in (own, own + 1):
        k, agree = of.blocks(b)
        if not k:
            continue
        bits, check, number = sketch(s, k)
        where = np.flatnonzero(number)
        place = np.column_stack([where, np.full(len(where), b + 1)]).astype(np.uint64)
        tokens = mixed((bits[where] ^ mixed(check[where])) + place[:, 0] * _P[0] + place[:, 1] * _P[1])
        first = k - agree + 1
        if len(tokens) < first:
            out += [tokens, mixed(np.array([b + 1], dtype=np.uint64) * _P[2])]
        else:
            out.append(np.partition(tokens, first - 1)[:first])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """The whole set's parity sketch of ``bits`` bits, as 64-bit words."""
    at = (mixed(s ^ _P[2]) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of ``n`` members: a power of two, twice the members at least."""
    return max(256, 1 << (2 * n - 1).bit_length())


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches at the length of the shortest: the halves of one, laid over each other, are the sketch of half the bits."""
    least, out = min(map(len, sketches)), []
    for x in sketches:
        while len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out)


def linked(n: np.ndarray, sketches: list[np.ndarray], percent: int, root: np.ndarray, sets: list[np.ndarray] | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places that connect all that link: a pair is tried only while its two sides are not connected. ``root``
    tells what is connected already. ``left`` (booleans) restricts pairs to those of one True and one False side.

    A pair is out where the sketches differ in more bits than linked sets of these sizes can differ in members. With
    ``sets``, what remains is counted exactly; without, every pair that remains counts as linked.
    """
    bits, root, out = folded(sketches), root.copy(), []
    for i in range(len(n) - 1):
        other = root[i + 1 :] != root[i]
        if left is not None:
            other &= left[i + 1 :] != left[i]
        far = (n[i + 1 :] + n[i]) * (100 - percent) // (100 + percent)
        at = np.flatnonzero(other & (np.abs(n[i + 1 :] - n[i]) <= far))
        if not len(at):
            continue
        apart = np.bitwise_count(bits[at + i + 1] ^ bits[i]).sum(1)
        for j in at[apart <= far[at]] + i + 1:
            if root[j] == root[i]:
                continue
            if sets is not None:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common < percent * (n[i] + n[j] - common):
                    continue
            out.append((i, int(j)))
            root[root == root[j]] = root[i]
    return out
