"""Fuzzy hashing of 64-bit fingerprints with the binary Golay code [23, 12, 7].

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword, so decoding maps words to the 4,096
codewords. The nearby keys of a word are the codewords that it and its one-bit neighbours decode to, six at most; two
words that differ in at most one bit have each other's codeword among their nearby keys.

A fingerprint is cut into segments of 21, 21 and 22 bits. Two fingerprints that differ in 3 bits or fewer have either a
segment without errors and another with at most one (A), or exactly one error in each segment (B):
A: the exact segment and a nearby key of another one, for the six ordered pairs of segments;
B: nearby keys of the first two segments with the parities of all three, all of which differ. Each fingerprint is
stored under its own codewords and parities and looked up with the opposite parities.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed value: a generator polynomial of the code.
GENERATOR = 0b110001110101
WIDTHS = (21, 21, 22)
SHIFTS = (0, 21, 42)
NEARBY = 6


def codewords() -> np.ndarray:
    """The codeword of each 12-bit message: the message, then the remainder of its division."""
    words = np.arange(4096, dtype=np.uint32) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0)).astype(np.uint32)
    return words | rest


@cache
def decoder() -> np.ndarray:
    """For each 23-bit word the message of the one codeword within 3 bits."""
    code, ids = codewords(), np.arange(4096, dtype=np.int16)
    table = np.full(1 << 23, -1, np.int16)
    bits = [0, *(1 << b for b in range(23))]
    errors = {a | b | c for a in bits for b in bits for c in bits}
    for e in errors:
        table[code ^ np.uint32(e)] = ids
    return table


def segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.uint32) for s, w in zip(SHIFTS, WIDTHS, strict=True)]


def nearby(values: np.ndarray, width: int) -> np.ndarray:
    """The distinct nearby keys of each value in a row of NEARBY places, unused ones -1."""
    flips = np.array([0, *(1 << b for b in range(width))], np.uint32)
    found = np.sort(decoder()[values[:, None] ^ flips[None, :]], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(values), NEARBY), -1, np.int64)
    rows, cols = np.nonzero(new)
    out[rows, (np.cumsum(new, axis=1) - 1)[rows, cols]] = found[rows, cols]
    return out


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the buckets of each fingerprint. Two within 3 bits of each other share one."""
    fps = np.asarray(fps, np.uint64)
    parts = segments(fps)
    near = [nearby(p, w) for p, w in zip(parts, WIDTHS, strict=True)]
    rows, out = [], []
    for j in range(3):
        r, c = np.nonzero(near[j] >= 0)
        for i in range(3):
            if i != j:
                rows.append(r)
                out.append((np.int64(3 * i + j) << 34) | (parts[i][r].astype(np.int64) << 12) | near[j][r, c])
    parity = sum((np.bitwise_count(p).astype(np.int64) & 1) << k for k, p in enumerate(parts))
    own = [decoder()[p].astype(np.int64) for p in parts[:2]]
    rows.append(np.arange(len(fps)))
    out.append((np.int64(9) << 34) | (parity << 24) | (own[0] << 12) | own[1])
    r, a, b = np.nonzero((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :])
    rows.append(r)
    out.append((np.int64(9) << 34) | ((7 - parity[r]) << 24) | (near[0][r, a] << 12) | near[1][r, b])
    return np.concatenate(rows), np.concatenate(out)


def wide_keys(fps: np.ndarray, word: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): buckets for larger distances. Words that differ in two bits or fewer share a nearby key (that of a word
    between them), so that two fingerprints meet if two of their segments differ in two bits or fewer each, or if one
    segment is equal; one of both holds for all that differ in 6 bits or fewer, and for many that differ in more. `word` keeps the keys of
    different words of a longer fingerprint apart."""
    fps = np.asarray(fps, np.uint64)
    parts = segments(fps)
    near = [nearby(p, w) for p, w in zip(parts, WIDTHS, strict=True)]
    rows = [np.arange(len(fps))] * 3
    out = [(np.int64(10 + 8 * word + i) << 34) | p.astype(np.int64) for i, p in enumerate(parts)]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        r, a, b = np.nonzero((near[i] >= 0)[:, :, None] & (near[j] >= 0)[:, None, :])
        rows.append(r)
        out.append((np.int64(13 + 8 * word + k) << 34) | (near[i][r, a] << 12) | near[j][r, b])
    return np.concatenate(rows), np.concatenate(out)


def mixtures(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Four words of 64 bits from the two halves of a fingerprint: the halves themselves, and the even bits of one with the
    odd bits of the other. Where errors are spread so that neither half gives two near segments, a mixture often does."""
    even = np.uint64(0x5555555555555555)
    return [first, second, (first & even) | (second & ~even), (first & ~even) | (second & even)]
