"""Vectorised word scanning: word bounds and 64-bit word hashes of many rows at once.

A word is read in steps of eight bytes. Each step mixes them into the hash by a
bijection that starts from the word's length, so two words of one length and at most
eight bytes never share a hash. Nothing wider than a byte is kept per byte of text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np

MASK = (1 << 64) - 1
U = np.uint64
STEP = 8
#: Steps that are taken for all words at once; what is left of longer words is hashed word by word.
MOST_STEPS = 64


def fold_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def word_class(kind: str) -> np.ndarray:
    """True for the bytes that words are made of, after A-Z are lower-cased."""
    inside = np.ones(256, bool)
    if kind == "space":
        inside[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":
        inside[:0x80] = False
        inside[ord("0") : ord("9") + 1] = True
        inside[ord("a") : ord("z") + 1] = True
        inside[ord("A") : ord("Z") + 1] = True
    else:
        raise ValueError(f"unknown word class {kind!r}")
    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def keep_masks() -> np.ndarray:
    """Masks that leave the first 0 to 8 bytes of a little-endian number."""
    return np.array([(1 << 8 * i) - 1 for i in range(STEP + 1)], np.uint64)


def eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``padded`` as one number, without copying."""
    return np.ndarray(len(padded) - STEP + 1, "<u8", padded, strides=(1,))


def padded_bytes(data: np.ndarray) -> np.ndarray:
    return np.concatenate((data, np.zeros(STEP, np.uint8)))


def short_hashes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of stretches of at most eight bytes."""
    return mix((eights(padded)[starts] & keep_masks()[sizes]) ^ mix(sizes.astype(np.uint64) + U(1)))


def span_hashes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of stretches of any size; ``padded`` ends in eight more bytes."""
    view, masks = eights(padded), keep_masks()
    out = mix(sizes.astype(np.uint64) + U(1))
    live, at, left = None, starts, sizes
    for _ in range(MOST_STEPS):
        step = view[at] & masks[np.minimum(left, STEP)]
        if live is None:
            out = mix(out ^ step)
            live = np.flatnonzero(sizes > STEP)
        else:
            out[live] = mix(out[live] ^ step)
            live = live[left > STEP]
        if not len(live):
            return out
        done = sizes[live] - (left[left > STEP] - STEP)
        at, left = starts[live] + done, sizes[live] - done
    for i, a, n in zip(live.tolist(), at.tolist(), left.tolist(), strict=True):
        rest = hashlib.blake2b(padded[a : a + n].tobytes(), digest_size=8).digest()
        out[i : i + 1] = mix(out[i : i + 1] ^ U(int.from_bytes(rest, "little")))
    return out


def same_spans(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray) -> bool:
    """Whether each stretch holds the bytes of its ``other`` one."""
    if not np.array_equal(sizes, other_sizes):
        return False
    apart = np.flatnonzero(starts != other)
    a, b, left = starts[apart], other[apart], sizes[apart]
    view, masks = eights(padded), keep_masks()
    while len(left):
        mask = masks[np.minimum(left, STEP)]
        if ((view[a] ^ view[b]) & mask).any():
            return False
        on = left > STEP
        a, b, left = a[on] + STEP, b[on] + STEP, left[on] - STEP
    return True


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    #: The rows' bytes, A-Z lower-cased, and eight more.
    data: np.ndarray
    heads: np.ndarray | None = None
    tails: np.ndarray | None = None


def scan(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, head: int = 0, tail: int = 0, breaks: np.ndarray | None = None) -> Words:
    """Words of every row; ``first[r]:first[r + 1]`` are row r's words.

    With ``head`` or ``tail``, also hashes of the words' first or last so many bytes, at
    most eight. A word is parted in two at each of ``breaks``.
    """
    n, rows = len(data), len(offsets) - 1
    folded = padded_bytes(fold_ascii()[data])
    word = np.zeros(n + 1, bool)
    word[:n] = inside[data]
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    begin, end = word & ~before, before & ~word
    cut = offsets[(offsets > 0) & (offsets < n)]
    cut = cut if breaks is None else np.concatenate((cut, breaks))
    begin[cut], end[cut] = word[cut], before[cut]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    first = np.searchsorted(starts, offsets)
    sizes = ends - starts
    hashes = span_hashes(folded, starts, sizes)
    heads = short_hashes(folded, starts, np.minimum(sizes, head)) if head else None
    tails = short_hashes(folded, ends - np.minimum(sizes, tail), np.minimum(sizes, tail)) if tail else None
    return Words(starts, ends, np.repeat(np.arange(rows), np.diff(first)), first, hashes, folded, heads, tails)


@cache
def gram_weights(k: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, MASK, k, np.uint64, endpoint=True) | U(1)


def join_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (runs may cross rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = gram_weights(k)
    out = np.full(n, U(k * 0x632BE59BD9B4E019 & MASK))
    for j in range(k):
        out += hashes[j : j + n] * w[j]
    return mix(out)


def row_grams(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles.

    A row of fewer words has its whole sequence as one; a row without words has none.
    """
    grams = join_hash(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            out.append(join_hash(words.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
