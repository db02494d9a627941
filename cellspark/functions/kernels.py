"""Arrow kernels for ring algorithms that Column expressions cannot state: hull, resampling and Fourier smoothing.

Rings cross to Python as Arrow lists. Rings of one length are stacked to one array and transformed together, so no vertex
becomes a Python object. Null rings give null; null vertices count as not a number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)  # types, not strings: workers import this module without a session


def _lengths(rings: pa.Array) -> np.ndarray:
    """Vertices of each ring; -1 for null."""
    return pc.fill_null(pc.list_value_length(rings), -1).to_numpy(zero_copy_only=False)


def _coordinates(rings: pa.Array) -> np.ndarray:
    """x and y of the vertices of all rings, one after another."""
    values = rings.flatten()
    return np.stack([pc.fill_null(pc.struct_field(values, [c]).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in "xy"], 1).reshape(-1, 2)


def stacked(*columns: pa.Array):
    """(rows, arrays of shape rows x vertices x 2) for each length that occurs; several columns must agree in it."""
    lengths = [_lengths(c) for c in columns]
    valid = np.logical_and.reduce([n >= 0 for n in lengths])
    if any((n[valid] != lengths[0][valid]).any() for n in lengths):
        raise ValueError("rings must have as many vertices as those they meet")
    points = [_coordinates(c) for c in columns]
    starts = [np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0) for n in lengths]
    for n in np.unique(lengths[0][valid]).tolist():
        rows = np.flatnonzero(valid & (lengths[0] == n))
        yield rows, *(p[s[rows][:, None] + np.arange(n)] for p, s in zip(points, starts, strict=True))


def _listed(total: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], make) -> pa.Array:
    """A column of lists from (rows, lengths, values row by row)."""
    length = np.full(total, -1)
    for rows, own, _ in parts:
        length[rows] = own
    ends = np.cumsum(np.maximum(length, 0))
    width = parts[0][2].shape[1:] if parts else (2,)
    out = np.zeros((int(ends[-1]) if total else 0, *width))
    for rows, own, values in parts:
        at = np.repeat((ends - np.maximum(length, 0))[rows], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[at] = values
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.concatenate((length < 0, [False])))
    return pa.ListArray.from_arrays(offsets, make(out))


def _rings(total: int, parts) -> pa.Array:
    return _listed(total, parts, lambda v: pa.StructArray.from_arrays([pa.array(v[:, k]) for k in (0, 1)], ["x", "y"]))


def _even(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part whose rows have lists of one length."""
    return rows, np.full(len(rows), values.shape[1]), values.reshape(-1, *values.shape[2:])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of points, counter-clockwise from the least (x, y); collinear points are left out."""
    own = points[np.lexsort((points[:, 1], points[:, 0]))]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]).any(1)
    own = own[new]
    if len(own) < 3:
        return own if len(own) == 2 else points[:2]
    chains = []
    for chain in (own, own[::-1]):
        for _ in range(64):  # a point that is not left of its neighbours' line is no corner: all such go at once
            (u, v), (a, b) = (chain[1:-1] - chain[:-2]).T.astype(float), (chain[2:] - chain[1:-1]).T.astype(float)
            bad = u * b - v * a <= 0
            if not bad.any():
                break
            chain = chain[np.concatenate(([True], ~bad, [True]))]
        else:
            left = np.vstack((chain, chains[0] if chains else own))  # of a long curve: point by point
            left = left[np.lexsort((left[:, 1], left[:, 0]))]
            index, size = hulls(left[None].astype(float))
            return left[index[0, : size[0]]]
        chains.append(chain)
    return np.vstack([c[:-1] for c in chains])


def hulls(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stacked points (rows x n x 2) the indices of each hull's corners and how many there are.

    All rows go through the two monotone chains in step."""
    k, n = p.shape[:2]
    if n < 2:
        return np.zeros((k, n), int), np.full(k, n)
    order = np.lexsort((p[:, :, 1], p[:, :, 0]), axis=1)
    row, out, total = np.arange(k), np.zeros((k, 2 * n), int), np.zeros(k, int)
    for way in (order, order[:, ::-1]):
        chain, size = np.zeros((k, n), int), np.zeros(k, int)
        for j in range(n):
            new = p[row, way[:, j]]
            open_ = row[size > 1]
            while len(open_):
                last, before = p[open_, chain[open_, size[open_] - 1]], p[open_, chain[open_, size[open_] - 2]]
                (u, v), (a, b) = (last - before).T, (new[open_] - last).T
                open_ = open_[u * b - v * a <= 0]
                size[open_] -= 1
                open_ = open_[size[open_] > 1]
            chain[row, size] = way[:, j]
            size += 1
        at, own = np.nonzero(np.arange(n) < (size - 1)[:, None])
        out[at, total[at] + own] = chain[at, own]
        total += size - 1
    return out, total


def shoelace(p: np.ndarray) -> np.ndarray:
    """Signed area of a ring, or of each of stacked rings."""
    q = np.roll(p, -1, -2)
    return 0.5 * np.sum(p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1], -1) if p.shape[-2] > 2 else np.zeros(p.shape[:-2])


def resampled(p: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc length along a counter-clockwise ring, in single precision."""
    return resample_all(p[None].astype(float), n)[0] if len(p) else np.zeros((0, 2))


def resample_all(p: np.ndarray, n: int) -> np.ndarray:
    """``resampled`` for stacked rings of at least one vertex."""
    closed = np.isclose(p[:, 0], p[:, -1]).all(1) if p.shape[1] > 2 else np.zeros(len(p), bool)
    out = np.zeros((len(p), n, 2))
    if closed.any():
        out[closed] = _resample_open(p[closed, :-1], n)
    out[~closed] = _resample_open(p[~closed], n)
    return out


def _resample_open(p: np.ndarray, n: int) -> np.ndarray:
    if p.shape[1] == 1:
        return np.repeat(p, n, 1)
    if p.shape[1] == 2:
        return p[:, :1] + (p[:, 1:] - p[:, :1]) * (np.arange(n) / max(1, n - 1))[None, :, None]
    p = p.astype(np.float32).astype(float)
    p = np.where((shoelace(p) < 0)[:, None, None], p[:, ::-1], p)
    ends = np.concatenate((p, p[:, :1]), 1)
    at = np.concatenate((np.zeros((len(p), 1)), np.cumsum(np.sqrt((np.diff(ends, axis=1) ** 2).sum(2)), 1)), 1)
    whole = at[:, -1:]
    to = whole * np.arange(n) / n
    place = np.stack([(at[:, 1:-1] <= to[:, j : j + 1]).sum(1) for j in range(n)], 1) if len(p) else np.zeros((0, n), int)
    row = np.arange(len(p))[:, None]
    a, b = at[row, place], at[row, place + 1]
    share = np.divide(to - a, b - a, out=np.zeros_like(to), where=b > a)[..., None]
    out = (ends[row, place] + (ends[row, place + 1] - ends[row, place]) * share).astype(np.float32).astype(float)
    return np.where((whole < 1e-12)[..., None], p.mean(1, keepdims=True), out)


def _complex(p: np.ndarray) -> np.ndarray:
    return p[..., 0] + 1j * p[..., 1]


def _real(z: np.ndarray) -> np.ndarray:
    return np.stack((z.real, z.imag), -1)


def smoothed(p: np.ndarray, keep: int) -> np.ndarray:
    """A ring, or stacked rings, without the frequencies from ``keep`` on."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    f = np.fft.fft(_complex(p), axis=-1)
    f[..., keep : f.shape[-1] - keep + 1] = 0
    return _real(np.fft.ifft(f, axis=-1))


def kappa(p: np.ndarray, keep: int = 16) -> np.ndarray:
    """1 - l1 / trace of the covariance of the mean-free, low-passed columns of a ring or of stacked rings; 0 for no
    trace, 0.5 if not finite."""
    n = p.shape[-2]
    x = p.astype(np.float32)
    x = x - x.mean(-2, keepdims=True)
    f = np.fft.fft(x, axis=-2)
    f[..., keep : n - keep + 1, :] = 0
    low = np.fft.ifft(f, axis=-2).real
    cov = np.swapaxes(low, -1, -2) @ low / max(1, n - 1)
    trace = cov[..., 0, 0] + cov[..., 1, 1]
    half = np.sqrt(((cov[..., 0, 0] - cov[..., 1, 1]) / 2) ** 2 + cov[..., 0, 1] ** 2)
    share = 1 - np.divide(trace / 2 + half, trace, out=np.zeros_like(trace), where=trace > 0)
    return np.where(np.isfinite(trace), np.where(trace > 0, np.clip(share, 0, 1), 0.0), 0.5)


def spectrum(p: np.ndarray) -> np.ndarray:
    """Power of a ring, or of stacked rings, as a complex signal."""
    return (np.abs(np.fft.fft(_complex(p), axis=-1)) ** 2).astype(np.float32)


def convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cyclic convolution of two rings, or of stacked rings, as complex signals."""
    return _real(np.fft.ifft(np.fft.fft(_complex(a), axis=-1) * np.fft.fft(_complex(b), axis=-1), axis=-1))


@F.arrow_udf(RING)
def hull_udf(rings: pa.Array) -> pa.Array:
    """Hull of each ring."""
    parts = []
    for rows, p in stacked(rings):
        index, size = hulls(p)
        at, own = np.nonzero(np.arange(index.shape[1]) < size[:, None])
        parts.append((rows, size, p[at, index[at, own]]))
    return _rings(len(rings), parts)


@F.arrow_udf(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("perimeter", T.DoubleType())]))
def hull_size_udf(rings: pa.Array) -> pa.Array:
    """Area and length of each ring's hull."""
    area, length, seen = np.zeros(len(rings)), np.zeros(len(rings)), np.zeros(len(rings), bool)
    for rows, p in stacked(rings):
        seen[rows] = True
        if not p.shape[1]:
            continue
        index, size = hulls(p)
        place = np.minimum(np.arange(index.shape[1]), size[:, None] - 1)  # the last corner again does no harm
        corner = p[np.arange(len(p))[:, None], index[np.arange(len(p))[:, None], place]]
        area[rows] = np.where(size > 2, np.abs(shoelace(corner)), 0)
        length[rows] = np.where(size > 1, np.sqrt(((np.roll(corner, -1, 1) - corner) ** 2).sum(2)).sum(1), 0)
    return pa.StructArray.from_arrays([pa.array(area), pa.array(length)], ["area", "perimeter"], mask=pa.array(~seen))


def _ring_udf(f: Callable[[np.ndarray], np.ndarray]):
    @F.arrow_udf(RING)
    def run(rings: pa.Array) -> pa.Array:
        return _rings(len(rings), [_even(rows, f(p) if p.shape[1] else p) for rows, p in stacked(rings)])

    return run


def resample(n: int):
    """A UDF that resamples rings to n vertices."""
    return _ring_udf(lambda p: resample_all(p, n))


def low_pass(keep: int):
    """A UDF that smooths rings."""
    return _ring_udf(lambda p: smoothed(p, keep))


def kappa_of(keep: int):
    """A UDF with the kappa of rings."""

    @F.arrow_udf(T.DoubleType())
    def f(rings: pa.Array) -> pa.Array:
        out, seen = np.zeros(len(rings)), np.zeros(len(rings), bool)
        for rows, p in stacked(rings):
            seen[rows] = True
            out[rows] = kappa(p, keep) if p.shape[1] else 0.0
        return pa.array(out, mask=~seen)

    return f


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def spectrum_udf(rings: pa.Array) -> pa.Array:
    """Power spectrum of each ring."""
    parts = [_even(rows, spectrum(p).astype(float) if p.shape[1] else np.zeros(p.shape[:2])) for rows, p in stacked(rings)]
    return _listed(len(rings), parts, pa.array)


@F.arrow_udf(RING)
def convolve_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cyclic convolution of two columns of rings."""
    return _rings(len(a), [_even(rows, convolved(p, q) if p.shape[1] else p) for rows, p, q in stacked(a, b)])
