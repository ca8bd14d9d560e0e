"""Simple-8b coding of unsigned integers in 64-bit words, encoded and decoded by whole arrays.

A word's top 4 bits select how many values its low 60 bits hold and how wide
they are, first value lowest. Selector 0 is the escape: the word after it is
one value as it stands, for those of 2^60 and more.
"""

from __future__ import annotations

import numpy as np

#: selector -> (values in a word, bits of each); selector 1 holds zeros only. Fixed values of the coding.
LAYOUT = {1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
SHIFT = np.uint64(60)


def _reach(small: np.ndarray, n: int) -> np.ndarray:
    """Places at which n values in a row are small."""
    at = np.flatnonzero(small)
    if len(at) < n:
        return at[:0]
    # at[i + n - 1] is n - 1 further on exactly if nothing between is left out.
    return at[: len(at) - n + 1][at[n - 1 :] - at[: len(at) - n + 1] == n - 1]


def encode(values: np.ndarray) -> np.ndarray:
    """Words of an array of unsigned integers; each place takes the selector that holds most values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    selector = np.zeros(n, np.uint8)
    for s in range(15, 0, -1):
        count, bits = LAYOUT[s]
        fits = values < (np.uint64(1) << np.uint64(bits))
        if fits.all():
            # Towards the end fewer values than the selector holds are left; then a sparser one stays.
            selector[: max(0, n - count + 1)] = s
        else:
            selector[_reach(fits, count)] = s
    step = np.ones(n, np.int64)
    for s, (count, _) in LAYOUT.items():
        step[selector == s] = count
    heads, at, nexts = [], 0, step.tolist()
    while at < n:
        heads.append(at)
        at += nexts[at]
    heads = np.array(heads, np.int64)
    chosen = selector[heads] if n else np.empty(0, np.uint8)
    place = np.arange(len(heads)) + np.concatenate(([0], np.cumsum(chosen == ESCAPE)[:-1])) if n else heads
    words = np.zeros(len(heads) + int((chosen == ESCAPE).sum()), np.uint64)
    raw = np.flatnonzero(chosen == ESCAPE)
    words[place[raw] + 1] = values[heads[raw]]
    for s, (count, bits) in LAYOUT.items():
        own = np.flatnonzero(chosen == s)
        if not len(own):
            continue
        word = np.full(len(own), np.uint64(s) << SHIFT, np.uint64)
        for k in range(count if bits else 0):
            word |= values[heads[own] + k] << np.uint64(k * bits)
        words[place[own]] = word
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The values of whole words, with one vectorised step for each selector and place in a word."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> SHIFT).astype(np.uint8)
    if (selector == ESCAPE).any():
        # A raw word may look like anything, an escape too: in a row, every other one is raw.
        raw = np.zeros(len(words), bool)
        for at in np.flatnonzero(selector == ESCAPE).tolist():
            if not raw[at] and at + 1 < len(words):
                raw[at + 1] = True
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    own_selector = selector[heads]
    counts = np.ones(len(heads), np.int64)
    for s, (count, _) in LAYOUT.items():
        counts[own_selector == s] = count
    start = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(start[-1], np.uint64)
    escaped = np.flatnonzero(own_selector == ESCAPE)
    out[start[escaped]] = words[heads[escaped] + 1]
    for s, (count, bits) in LAYOUT.items():
        own = np.flatnonzero(own_selector == s)
        if bits and len(own):
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[start[own] + k] = words[heads[own]] >> np.uint64(k * bits) & mask
    return out
