"""Static membership filters: three-wise binary fuse filters over 64-bit keys, built with arrays.

A key is a member if the fingerprints at its three places, one in each of three neighbouring segments, add up
(by exclusive or) to its own. Keys of the set are always found; others with a chance of 1/256.
"""

from __future__ import annotations

import math

import numpy as np

from stratusqc.llm.common import mix64


def _places(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    first = ((hashes >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((hashes >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a filter over ``keys``; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(room / segment) - 2)
    for seed in range(1, 1000):
        hashes = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        places = _places(hashes, segment, segments)
        size = (segments + 2) * segment
        held = np.bincount(places.ravel(), minlength=size)
        # The sum of the numbers of the keys at a place is the key's number where one is left.
        sums = np.bincount(places.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
        layers, left, alone = [], n, np.flatnonzero(held == 1)
        while len(alone):
            chosen, at = np.unique(sums[alone], return_index=True)
            layers.append((chosen, alone[at]))
            left -= len(chosen)
            touched = places[:, chosen].ravel()
            np.subtract.at(held, touched, 1)
            np.subtract.at(sums, touched, np.tile(chosen, 3))
            touched = np.unique(touched)
            alone = touched[held[touched] == 1]
        if left:
            continue
        table, marks = np.zeros(size, np.uint8), _fingerprints(hashes)
        for chosen, at in reversed(layers):
            others = table[places[:, chosen]]
            table[at] = marks[chosen] ^ others[0] ^ others[1] ^ others[2]
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter")


def contains(built: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, segment, segments, raw = built
    table = np.frombuffer(raw, np.uint8)
    hashes = mix64(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    found = table[_places(hashes, segment, segments)]
    return (found[0] ^ found[1] ^ found[2]) == _fingerprints(hashes)
