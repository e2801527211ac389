"""Vectorised hashes of words and word shingles."""

from __future__ import annotations

import hashlib

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches without ASCII white space in the bytes ``raw``."""
    edge = np.diff(np.concatenate([[True], SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, from one running sum over all of them."""
    n = len(raw) + 1
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum(_powers(MULT, n)[:-1] * (raw.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(np.uint64(pow(int(MULT), -1, 1 << 64)), n)[start]
    return scramble(h + (end - start).astype(np.uint64))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``k`` words, A-Z in lower case; of all words, where there are fewer."""
    data = [t.encode() + b"\n" for t in texts]
    raw = LOWER[np.frombuffer(b"".join(data), dtype=np.uint8)]
    start, end = word_spans(raw)
    h = word_hashes(raw, start, end)
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    run = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        run = run * MULT + h[i : len(h) - k + 1 + i]
    run = scramble(run)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            few = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                few = few * MULT + h[i : i + 1]
            out.append(scramble(few))
        else:
            out.append(run[:0])
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
