"""Vectorised hashes of words and shingles over whole batches of texts."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Ranges up to this many bytes are told apart by their bytes themselves.
SHORT = 7
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(SHORT + 1)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which maps no two numbers to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array (null: empty) and the offset of each text, one more at the end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def short_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranges of at most ``SHORT`` bytes as numbers: their bytes and their length, so equal numbers are equal ranges."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    return (eight[starts] & _MASKS[sizes]) | (sizes.astype(np.uint64) << np.uint64(56))


def pair_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of at most ``2 * SHORT + 1`` bytes as two numbers: their bytes, and their length in the second."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))
    masks = np.concatenate([_MASKS, [np.uint64(2**64 - 1)]])
    low = eight[starts] & masks[np.minimum(sizes, 8)]
    high = eight[starts + np.minimum(sizes, 8)] & masks[np.maximum(sizes - 8, 0)]
    return low, high | (sizes.astype(np.uint64) << np.uint64(56))


def hashed_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes: one to one for short ranges, xxh3 of the bytes for others."""
    import xxhash

    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    short = sizes <= SHORT
    out[short] = short_keys(data, starts[short], sizes[short])
    long = np.flatnonzero(~short)
    if len(long):
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return mix(out)


def words(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text."""
    data, offsets = flat(texts)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return hashed_ranges(_LOWER[data] if lower else data, starts, ends), np.diff(np.searchsorted(starts, offsets))


def shingles(found: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its shingles' hashes with repeats; a text of fewer words has one shingle of all its words, without words none."""
    base = np.uint64(0xC2B2AE3D27D4EB4F)
    joined = np.empty(0, np.uint64)
    if len(found) >= size:
        joined = np.zeros(len(found) - size + 1, np.uint64)
        for k in range(size):
            joined = joined * base + found[k : len(found) - size + 1 + k]
        joined = mix(joined)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(joined[at : at + n - size + 1])
        elif n:
            short = np.zeros(1, np.uint64)
            for x in found[at : at + n]:
                short = short * base + x
            out.append(mix(short + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
