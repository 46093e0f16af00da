"""Hashed byte n-grams of whole texts: sparse counts for fitting, and means of weights for scoring."""

from __future__ import annotations

import numpy as np

BITS = 17
DIMS = 1 << BITS
ORDERS = (1, 2, 3, 4)
PAD = b"\0\0\0"
#: Odd multipliers of the n-gram hash, by order.
MULTIPLIERS = {1: 2654435761, 2: 2246822519, 3: 3266489917, 4: 668265263}


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, each followed by padding, and where each begins and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    return np.frombuffer(PAD.join(texts) + PAD, dtype=np.uint8), begins, begins + sizes


def slots(data: np.ndarray, order: int) -> np.ndarray:
    """For each place but the last three, the slot of the n-gram that begins there."""
    n = len(data) - len(PAD)
    key = data[:n].astype(np.uint32)
    for i in range(1, order):
        key |= data[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    key *= np.uint32(MULTIPLIERS[order])
    key ^= key >> np.uint32(15)
    key *= np.uint32(2654435761)
    return key >> np.uint32(32 - BITS)


def span_means(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return (total[ends] - total[begins]) / np.maximum(ends - begins, 1)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """texts x columns of `weights` (columns, DIMS): sums over orders of the mean weight of the text's n-grams; 0 if empty."""
    data, begins, ends = laid_out(texts)
    out = np.zeros((len(texts), len(weights)))
    for order in ORDERS:
        at = slots(data, order)
        for c, w in enumerate(weights):
            out[:, c] += span_means(w[at], begins, ends)
    return out


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and relative frequencies of one text, all orders together."""
    data, _, ends = laid_out([text])
    n = int(ends[0])
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, count = np.unique(np.concatenate([slots(data, o)[:n] for o in ORDERS]), return_counts=True)
    return at.astype(np.int32), (count / n).astype(np.float32)
