"""DartMinHash signatures of weighted sets.

Darts fall on the plane of weight and rank of every element, as a Poisson
process that depends on the element alone: the ranks of an element's darts are
sums of exponential steps drawn from hashes.  A set catches the darts below its
elements' weights; each dart belongs to one of ``k`` coordinates, and the
earliest dart of each coordinate is the signature there.  Two sets agree on a
coordinate with the probability of their weighted Jaccard similarity.  Only
``k (ln k + 3)`` darts are expected per set, however many elements it has; sets
that leave a coordinate empty throw up to twice the rank again.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix

_SLAB, _STEP, _PLACE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _throw(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, reach: np.ndarray, k: int):
    """All darts of rank below the owner's reach: (owner * k + coordinate, rank, dart)."""
    cells, ranks, darts = [], [], []
    low, width, slab = 0.0, 1.0, 0
    live = np.flatnonzero(weights > 0)
    while len(live):
        e, o, w = elements[live], owner[live], weights[live]
        rank, far, step = np.zeros(len(live)), reach[o], 0
        seed = e + np.uint64(int(_SLAB) * slab % (1 << 64))
        while len(e):
            dart = mix(seed + np.uint64(int(_STEP) * (step + 1) % (1 << 64)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
            near = rank < far
            if not near.all():
                e, o, w, rank, far, seed, dart = (x[near] for x in (e, o, w, rank, far, seed, dart))
            if not len(e):
                break
            place = mix(dart + _PLACE)
            cell, hit = o * k + (place >> np.uint64(32)).astype(np.int64) % k, low + width * ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < w
            if hit.all():
                cells.append(cell), ranks.append(rank), darts.append(dart)
            else:
                cells.append(cell[hit]), ranks.append(rank[hit]), darts.append(dart[hit])
            step += 1
        low, width, slab = low + width, low + width, slab + 1
        live = live[weights[live] > low]
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in ((cells, np.int64), (ranks, np.float64), (darts, np.uint64)))


def signatures(elements: np.ndarray, counts: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """One row of ``k`` darts for each set; ``counts`` says how many elements each has.

    A set without positive weight has a row of zeros.
    """
    n = len(counts)
    out = np.zeros((n, k), dtype=np.uint64)
    owner = np.repeat(np.arange(n), counts)
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=np.float64)
    total = np.bincount(owner, weights, n) if n else np.empty(0)
    todo = np.flatnonzero(total > 0)
    scale = k * (np.log(k) + 3.0)
    while len(todo):
        position = np.full(n, -1)
        position[todo] = np.arange(len(todo))
        use = position[owner] >= 0
        reach = scale / total[todo]
        cell, rank, dart = _throw(elements[use], position[owner[use]], weights[use], reach, k)
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, cell, rank)
        full = np.isfinite(earliest).reshape(len(todo), k).all(axis=1)
        keep = (rank == earliest[cell]) & full[cell // k]
        out[todo[cell[keep] // k], cell[keep] % k] = dart[keep]
        todo, scale = todo[~full], scale * 2
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; other bands never share a key by rule."""
    n, k = signature.shape
    parts = signature[:, : k // rows * rows].reshape(n, k // rows, rows)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _SLAB
    for r in range(rows):
        out = mix(out ^ parts[:, :, r]) + _STEP
    return mix(out)
