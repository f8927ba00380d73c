"""256-bit SimHash and MinHash routing keys of texts, a batch at a time in NumPy.

Features are pairs of neighbouring words (single words where there is only one), words being runs of
letters, digits and non-ASCII bytes in lower case; a text has each of them once. Every bit of the
SimHash is the sign of the features' votes. A key joins the minima of two permutations of the features:
texts of Jaccard similarity J share it with J * J, so frequent pairs of words bring few strangers together
and one of `KEYS` keys misses a pair of J = .7 in 3 of 10000 cases.
"""

from __future__ import annotations

import numpy as np

from echofold.llm.vectext import Slices, mixed, words

BITS, KEYS = 256, 12
_SEEDS = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mixed(np.arange(11, 11 + 2 * KEYS, dtype=np.uint64)) | np.uint64(1)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case (ASCII and the Latin-1 letters), everything but letters and digits a blank."""
    low = _LOWER[data]
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1 if len(low) > 1 else np.zeros(0, np.int64)
    low[latin] += 0x20
    low[_BLANK[low]] = 32
    return low


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, row of each), rows ascending, each feature of a row once."""
    low = folded(data)
    start, end, row = words(low, offsets)
    h = Slices(low).hashes(start, end)
    if not len(h):
        return h, row
    counts = np.bincount(row, minlength=len(offsets) - 1)
    last = np.append(row[1:] != row[:-1], True)
    alone = counts[row] == 1
    nxt = np.append(h[1:], np.uint64(0))
    pair = mixed(h * np.uint64(3) + nxt * np.uint64(0x9E3779B97F4A7C15))
    use = ~last | alone
    # each feature once a row: one sort of 24 bits of row and 40 bits of hash
    once = np.unique(row[use].astype(np.uint64) << np.uint64(40) | np.where(alone, h, pair)[use] >> np.uint64(24))
    return mixed(once & np.uint64((1 << 40) - 1)), (once >> np.uint64(40)).astype(np.int64)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n features, SimHash as 4 uint64, KEYS minima) of every row; zeros where there is no feature."""
    n_rows = len(offsets) - 1
    f, row = features(data, offsets)
    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    sig, keys = np.zeros((n_rows, 4), np.uint64), np.zeros((n_rows, KEYS), np.uint64)
    if not len(f):
        return counts, sig, keys
    starts = np.cumsum(counts) - counts
    has = np.flatnonzero(counts)
    for k in range(KEYS):
        a, b = (np.minimum.reduceat(f * _ODD[i], starts[has]) for i in (2 * k, 2 * k + 1))
        keys[has, k] = mixed(a * np.uint64(3) + b)
    # eight votes to a word: at most 255 features are added up before the lanes are widened
    place = np.arange(len(f)) - starts[row]
    seg = np.flatnonzero(place % 255 == 0)
    seg_row = row[seg]
    first = np.flatnonzero(np.append(True, seg_row[1:] != seg_row[:-1]))
    for k in range(4):
        octets = mixed(f ^ _SEEDS[k]).view(np.uint8).reshape(-1, 8)
        lanes = np.add.reduceat(_LANES[octets], seg, axis=0)
        votes = np.add.reduceat(lanes.view(np.uint8).reshape(len(seg), 64).astype(np.int64), first, axis=0)
        bits = votes * 2 > counts[has][:, None]
        sig[has, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return counts, sig, keys


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of SimHashes along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)
