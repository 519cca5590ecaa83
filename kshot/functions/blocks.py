"""Distance kernels on Arrow vectors as numpy matrices (E2, E4 in blocks; the core of F1 and K1).

A batch's ``list<float|double>`` column becomes matrices without a Python object per vector.  Sums run left to right over
the dimensions, as in ``functions.vectors``, so both give the same doubles.  Work is cut into blocks of ``BLOCK`` numbers.

A pair is undefined (null) when a vector is null, holds a null, or the lengths differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 1 << 18
GROUP = 64               # 16-bit differences that are added before they could overflow


def matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The complete vectors of a list column by length: row numbers and their matrix in doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offs = col.offsets.to_numpy()
    size = np.diff(offs)
    whole = np.ones(len(col), bool) if not col.null_count else col.is_valid().to_numpy(zero_copy_only=False)
    values = col.values
    if values.null_count:
        nulls = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
        whole &= nulls[offs[1:]] == nulls[offs[:-1]]
        values = values.fill_null(0)
    flat = values.to_numpy(zero_copy_only=False)
    for d in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == d))
        if d == 0:
            yield rows, np.zeros((len(rows), 0))
        elif len(rows) == len(col):
            yield rows, flat[offs[0]:offs[0] + d * len(col)].reshape(-1, d).astype(np.float64)
        else:
            yield rows, flat[offs[rows][:, None] + np.arange(d)].astype(np.float64)


def _sum_rows(terms: np.ndarray) -> np.ndarray:
    """Sum over the last axis, left to right (``np.sum`` adds in pairs)."""
    return np.add.accumulate(terms, axis=-1)[..., -1] if terms.shape[-1] else np.zeros(terms.shape[:-1])


def _outer(q: np.ndarray, s: np.ndarray, term) -> np.ndarray:
    """Sum over dimensions of ``term(q_j, s_j)`` for every row of ``q`` against every row of ``s``."""
    out = np.zeros((len(q), len(s)))
    if not q.shape[1]:
        return out
    cols = min(len(s), 4096) or 1
    rows = max(1, BLOCK // 8 // cols)
    st = np.ascontiguousarray(s.T)
    for a in range(0, len(q), rows):
        qt = np.ascontiguousarray(q[a:a + rows].T)
        for b in range(0, len(s), cols):
            part = out[a:a + rows, b:b + cols]
            acc, tmp = np.zeros(part.shape), np.empty(part.shape)
            for x, y in zip(qt, st[:, b:b + cols], strict=True):
                term(x[:, None], y[None, :], tmp)
                acc += tmp
            part[:] = acc
    return out


def _abs_difference(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    np.subtract(x, y, out=out)
    np.abs(out, out=out)


def _product(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    np.multiply(x, y, out=out)


def l1_block(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """L1 distances of every row of ``q`` to every row of ``s``."""
    return _outer(q, s, _abs_difference)


def l1_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distances row by row (either side may be one row)."""
    return _sum_rows(np.abs(a - b))


def _rounded_distances(q: np.ndarray, st: np.ndarray) -> np.ndarray:
    """L1 distances of rows of ``q`` to columns of ``st``, both whole numbers so small that ``GROUP`` differences fit 16 bits."""
    out = np.zeros((len(q), st.shape[1]), np.uint16 if q.shape[1] <= GROUP else np.uint32)
    cols = max(1, BLOCK // 2 // len(q))
    for b in range(0, st.shape[1], cols):
        part = out[:, b:b + cols]
        acc, tmp = np.empty(part.shape, np.int16), np.empty(part.shape, np.int16)
        for g in range(0, q.shape[1], GROUP):
            acc[:] = 0
            for x, y in zip(q.T[g:g + GROUP], st[g:g + GROUP, b:b + cols], strict=True):
                np.subtract(x[:, None], y[None, :], out=tmp)
                np.abs(tmp, out=tmp)
                np.add(acc, tmp, out=acc)
            part += acc.view(np.uint16)
    return out


def l1_least(q: np.ndarray, s: np.ndarray, classes: np.ndarray, rows: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``l1_block(q, s)`` in every row, the same double, and the lowest class at it.

    Numbers are rounded to a grid first: distances between grid points, in steps, are off by less than a step a dimension.
    Only pairs that come within that of a row's least are compared in doubles; where many do, as without a grid, all are."""
    n, dims = len(s), q.shape[1]
    least, found = np.empty(len(q)), np.empty(len(q), np.int64)
    lo, hi = (min(q.min(), s.min()), max(q.max(), s.max())) if q.size and s.size else (0.0, 0.0)
    steps = 65535 // max(2, min(dims, GROUP))
    grid = 1e-290 < hi - lo < 1e290 and len(q) >= rows
    if grid:
        def whole(m):
            return np.rint((m - lo) / (hi - lo) * steps).astype(np.int16)
        st, whole_q = np.ascontiguousarray(whole(s).T), whole(q)
    for a in range(0, len(q), rows):
        part = q[a:a + rows]
        i = None
        if grid:
            near = _rounded_distances(whole_q[a:a + rows], st)
            within = near.min(axis=1).astype(np.int64) + 2 * (dims + 1)
            i, j = np.divmod(np.flatnonzero(near <= np.minimum(within, np.iinfo(near.dtype).max).astype(near.dtype)[:, None]), n)
        if i is None or len(i) > near.size // 16 + rows:
            d = l1_block(part, s)
            least[a:a + rows] = d.min(axis=1)
            found[a:a + rows] = np.where(d == d.min(axis=1)[:, None], classes, np.iinfo(classes.dtype).max).min(axis=1)
            continue
        d, first = l1_rows(part[i], s[j]), np.searchsorted(i, np.arange(len(part)))
        least[a:a + rows] = low = np.minimum.reduceat(d, first)
        found[a:a + rows] = np.minimum.reduceat(np.where(d == low[i], classes[j], np.iinfo(classes.dtype).max), first)
    return least, found


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum_rows(a * a))


def _over(dot: np.ndarray, den: np.ndarray) -> np.ma.MaskedArray:
    """Cosines; undefined (masked) where a norm is zero."""
    return np.ma.masked_array(np.divide(dot, den, out=np.zeros(den.shape), where=den != 0), mask=den == 0)


def cosine_block(q: np.ndarray, s: np.ndarray) -> np.ma.MaskedArray:
    """Cosines of every row of ``q`` with every row of ``s``."""
    with np.errstate(all="ignore"):
        return _over(_outer(q, s, _product), _norms(q)[:, None] * _norms(s)[None, :])


def cosine_rows(a: np.ndarray, b: np.ndarray) -> np.ma.MaskedArray:
    """Cosines row by row."""
    with np.errstate(all="ignore"):
        return _over(_sum_rows(a * b), _norms(a) * _norms(b))


def _pairwise(a: pa.Array, b: pa.Array, kernel) -> pa.Array:
    out, known = np.zeros(len(a)), np.zeros(len(a), bool)
    right = {m.shape[1]: (rows, m) for rows, m in matrices(b)}
    for rows, m in matrices(a):
        if m.shape[1] not in right:
            continue
        theirs, n = right[m.shape[1]]
        both, i, j = np.intersect1d(rows, theirs, assume_unique=True, return_indices=True)
        step = max(1, BLOCK // max(1, m.shape[1]))
        for k in range(0, len(both), step):
            found = np.ma.asarray(kernel(m[i[k:k + step]], n[j[k:k + step]]))
            out[both[k:k + step]] = found.data
            known[both[k:k + step]] = ~np.ma.getmaskarray(found)
    return pa.array(out, mask=~known)


def l1_distance_blocks(a: Column, b: Column) -> Column:
    """``l1_distance`` in blocks."""
    @F.arrow_udf("double")
    def l1(x: pa.Array, y: pa.Array) -> pa.Array:
        return _pairwise(x, y, l1_rows)
    return l1(a, b)


def manhattan_similarity_blocks(a: Column, b: Column) -> Column:
    """E2 in blocks."""
    return F.exp(-l1_distance_blocks(a, b))


def cosine_similarity_blocks(a: Column, b: Column) -> Column:
    """E4 in blocks."""
    @F.arrow_udf("double")
    def cos(x: pa.Array, y: pa.Array) -> pa.Array:
        return _pairwise(x, y, cosine_rows)
    return cos(a, b)
