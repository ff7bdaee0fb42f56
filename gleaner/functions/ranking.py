"""The best columns of every row of a matrix of scores, ties by a given order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def best(scores: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest scores of each row; of equal ones at the edge those with the least ``order``."""
    rows, n = scores.shape
    if n <= k:
        return np.repeat(np.arange(rows), n), np.tile(np.arange(n), rows)
    edge = np.partition(scores, n - k, axis=1)[:, n - k, None]
    r, c = np.nonzero(scores > edge)
    missing = k - np.bincount(r, minlength=rows)
    tr, tc = np.nonzero(scores == edge)
    by = np.lexsort((order[tc], tr))
    tr, tc = tr[by], tc[by]
    nth = np.arange(len(tr)) - np.searchsorted(tr, tr)
    keep = nth < missing[tr]
    return np.concatenate([r, tr[keep]]), np.concatenate([c, tc[keep]])


def places(ids: pa.Array) -> np.ndarray:
    """The place of each id among all when they are sorted."""
    out = np.empty(len(ids), dtype=np.int64)
    out[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out
