"""Weighted word shingles and ProbMinHash signatures in numpy."""

from __future__ import annotations

import numpy as np

from .textkit import joined, mix64, prefix_hash, span_hash, words_of

#: Words of a shingle.
WORDS = 5
#: Registers of a signature: BANDS bands of ROWS. At a similarity of 0.8 a pair misses all bands with a chance of 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts (sorted within each), how often each occurs, and where each text's start (with the end).

    Words are runs of digits, letters and non-ASCII bytes with A-Z lowered. A text of fewer
    words than a shingle has one shingle, all its words; a text without words has none.
    """
    data, starts = joined(texts)
    low, begin, end, first = words_of(data, starts)
    word = span_hash(prefix_hash(low), begin, end)
    count = np.diff(first)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(edges[-1]) - edges[owner] + first[owner]
    value = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < first[owner + 1]
        value = np.where(inside, (value * _STEP) + word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else value, value)
    value = mix64(value + np.minimum(count, WORDS)[owner].astype(np.uint64))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(value)))
    return value[at], times, np.searchsorted(owner[at], np.arange(len(texts) + 1))


def signatures(value: np.ndarray, weight: np.ndarray, starts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: a row of ``registers`` 32-bit element hashes for each set with elements; equal entries estimate probability Jaccard.

    Each element is a Poisson process of rate ``weight``: its arrivals come at sums of
    exponential variables over the weight, and each arrival falls into a random register,
    which keeps the earliest. Arrivals are drawn in rounds for all sets at once; an element
    stops as soon as its last arrival is later than everything its set's registers hold.
    """
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    held = np.full(n * registers, np.iinfo(np.uint64).max, np.uint64)
    tag = (value >> np.uint64(32)).astype(np.uint64)
    time = np.zeros(len(value))
    seed, drawn, chunk = value, 0, 1
    while len(owner):
        for k in range(chunk):
            draw = mix64(seed + _STEP * np.full(1, drawn + k + 1, np.uint64))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            register = ((mix64(draw) >> np.uint64(33)) % np.uint64(registers)).astype(np.int64)
            packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | tag
            np.minimum.at(held, owner * registers + register, packed)
        drawn += chunk
        chunk = min(chunk * 2, 16)
        latest = (held.reshape(n, registers).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        go = time.astype(np.float32).view(np.uint32) <= latest[owner]
        owner, tag, time, seed, weight = owner[go], tag[go], time[go], seed[go], weight[go]
    return (held & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    part = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(ROWS):
        key = mix64(key * _STEP + part[:, :, k])
    return key
