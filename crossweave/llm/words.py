"""Words and word shingles of whole batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# A word is a run of ASCII digits, ASCII letters and all characters from U+0080 up.
_WORD = np.ones(256, dtype=bool)
_WORD[0x00:0x30] = False
_WORD[0x3A:0x41] = False
_WORD[0x5B:0x61] = False
_WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers that a worker keeps; a longer table, for one very long text, is made anew each time.
MOST_KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal values stay equal, near values spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, int(n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= MOST_KEPT:
            _powers[base] = have
    return have[:n]


def sub_batches(rows: Iterable[tuple], size: int, limit: int = 750_000) -> Iterator[list[tuple]]:
    """Consecutive rows until their text (bytes at position `size`) reaches limit bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[size])
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to and with each text) of UTF-8 texts, A-Z lower-cased."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    step = powers(_BASE, len(data))
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * step, out=run[1:])
    hashes = mix((run[last] - run[first]) * powers(_INVERSE, len(data))[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(first, ends)


def shingles(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of `width` consecutive words within a text.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    starts = np.concatenate(([0], ends[:-1]))
    count = ends - starts
    n = len(hashes)
    run = np.zeros(n + 1, dtype=np.uint64)
    step = powers(_BASE, n + 1)[1:]
    np.cumsum(hashes * step, out=run[1:])
    shift = powers(_INVERSE, n + 1)
    full = np.maximum(count - width + 1, 0)
    made = np.where((full == 0) & (count > 0), 1, full)
    owner = np.repeat(np.arange(len(ends)), made)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    first = starts[owner] + offset
    last = np.minimum(first + width, ends[owner])
    return mix((run[last] - run[first]) * shift[first] + (last - first).astype(np.uint64)), owner
