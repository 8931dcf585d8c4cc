"""Signs that decide geometry, exact for any finite numbers.

A determinant in floating point is trusted where it exceeds a bound of its rounding error; the others are computed in whole
numbers, by which all finite doubles can be written with a common power of two.
"""

from __future__ import annotations

import numpy as np

Array = np.ndarray

#: Half the distance from one to the next larger double; bounds are multiples of it, for the number of roundings on the way.
ROUNDING = 2.0**-53
BOUND_2, BOUND_3 = (3 + 16 * ROUNDING) * ROUNDING, (7 + 56 * ROUNDING) * ROUNDING
#: Of whole numbers below this, determinants are exact in doubles.
SMALL = 2.0**15


def _whole(points: Array) -> Array:
    """Rows of doubles as whole numbers (Python's, of any size), each row times a power of two of its own."""
    mantissa, exponent = np.frexp(points)
    mantissa, exponent = np.ldexp(mantissa, 53).astype(np.int64), exponent.astype(np.int64) - 53
    exponent = np.where(mantissa == 0, np.iinfo(np.int64).max, exponent)
    shift = np.where(mantissa == 0, 0, exponent - exponent.reshape(len(points), -1).min(1).reshape(-1, *[1] * (points.ndim - 1)))
    flat = [m << s for m, s in zip(mantissa.ravel().tolist(), shift.ravel().tolist(), strict=True)]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(points.shape)


def _det(p: Array, magnitude: bool = False) -> Array:
    """Determinants of the differences of points (n, k + 1, k) from the last one; or the sum of what is added, without signs."""
    d = p[:, :-1] - p[:, -1:]
    size, add = (np.abs, np.add) if magnitude else (lambda x: x, np.subtract)
    minor = lambda i, j, x, y: add(size(d[:, i, x] * d[:, j, y]), size(d[:, j, x] * d[:, i, y]))
    if p.shape[2] == 2:
        return minor(0, 1, 0, 1)
    return size(d[:, 0, 2]) * minor(1, 2, 0, 1) + size(d[:, 1, 2]) * minor(2, 0, 0, 1) + size(d[:, 2, 2]) * minor(0, 1, 0, 1)


def orientation(*points: Array) -> Array:
    """-1, 0 or 1: the side of the last of three points (n, 2) or four (n, 3) on which the others turn counter-clockwise."""
    p = np.stack(points, axis=1).astype(np.float64)
    det = _det(p)
    sign = np.sign(det).astype(np.int8)
    sure = np.abs(det) > (BOUND_2 if p.shape[2] == 2 else BOUND_3) * _det(p, magnitude=True)
    sure |= (np.abs(p) < SMALL).all((1, 2)) & (p == np.rint(p)).all((1, 2))
    left = np.flatnonzero(~sure)
    if len(left):
        sign[left] = [(x > 0) - (x < 0) for x in _det(_whole(p[left])).tolist()]
    return sign


def _drop(p: Array, axis: Array) -> Array:
    """Points (n, 3) without the coordinate that axis names."""
    kept = np.array([(1, 2), (0, 2), (0, 1)])[axis]
    return np.take_along_axis(p, kept, axis=1)


def plane_axis(t: Array) -> Array:
    """A coordinate without which triangles (n, 3, 3) still have an area; -1 for those that have none."""
    out = np.full(len(t), -1)
    for k in (0, 1, 2):
        keep = np.full(len(t), k)
        flat = orientation(*(_drop(t[:, i], keep) for i in range(3)))
        out = np.where(flat != 0, k, out)
    return out


def _on(p: Array, a: Array, b: Array, side: Array) -> Array:
    """Whether points p with this side of a line lie on its segment a-b."""
    return (side == 0) & (p >= np.minimum(a, b)).all(1) & (p <= np.maximum(a, b)).all(1)


def _flat_meets(s: Array, e: Array, t: Array) -> Array:
    """Whether segments meet triangles, all in one plane of two coordinates."""
    turn = orientation(t[:, 0], t[:, 1], t[:, 2])
    sides = [(t[:, i], t[:, (i + 1) % 3]) for i in range(3)]
    at_s, at_e = ([orientation(a, b, p) for a, b in sides] for p in (s, e))
    out = np.all([x * turn >= 0 for x in at_s], axis=0) | np.all([x * turn >= 0 for x in at_e], axis=0)
    for (a, b), p, q in zip(sides, at_s, at_e, strict=True):
        x, y = orientation(s, e, a), orientation(s, e, b)
        out |= (x * y < 0) & (p * q < 0) | _on(s, a, b, p) | _on(e, a, b, q) | _on(a, s, e, x) | _on(b, s, e, y)
    return out


def segments_meet(s: Array, e: Array, t: Array) -> Array:
    """Whether segments s-e (n, 3) meet triangles t (n, 3, 3), touching included."""
    above, below = (orientation(t[:, 0], t[:, 1], t[:, 2], p) for p in (s, e))
    out = np.zeros(len(s), bool)
    k = np.flatnonzero((above * below <= 0) & ((above != 0) | (below != 0)))
    if len(k):
        turns = np.stack([orientation(s[k], e[k], t[k, i], t[k, (i + 1) % 3]) for i in range(3)])
        out[k] = (turns >= 0).all(0) | (turns <= 0).all(0)
    k = np.flatnonzero((above == 0) & (below == 0))
    if len(k):
        axis = plane_axis(t[k])
        k, axis = k[axis >= 0], axis[axis >= 0]
        flat = np.stack([_drop(t[k, i], axis) for i in range(3)], axis=1)
        out[k] = _flat_meets(_drop(s[k], axis), _drop(e[k], axis), flat)
    return out


def triangles_cross(p: Array, q: Array, vp: Array, vq: Array) -> tuple[Array, Array]:
    """For pairs of triangles (n, 3, 3) with the ids of their corners (n, 3): whether they meet, and how many corners they share.

    Triangles that share a corner must meet elsewhere too; those with a common side must lie in one plane, on the same side of it;
    equal ones meet. Triangles without an area meet nothing.
    """
    same = vp[:, :, None] == vq[:, None, :]
    shared = same.any(2).sum(1)
    out = shared == 3
    sound = (plane_axis(p) >= 0) & (plane_axis(q) >= 0)
    k = np.flatnonzero((shared == 0) & sound)
    for x, y in ((p[k], q[k]), (q[k], p[k])):
        for i in range(3):
            left = np.flatnonzero(~out[k])
            out[k[left]] = segments_meet(x[left, i], x[left, (i + 1) % 3], y[left])
    k = np.flatnonzero((shared == 1) & sound)
    if len(k):
        for x, y, at in ((p[k], q[k], same[k].any(2).argmax(1)), (q[k], p[k], same[k].any(1).argmax(1))):
            row = np.arange(len(k))
            out[k] |= segments_meet(x[row, (at + 1) % 3], x[row, (at + 2) % 3], y)
    k = np.flatnonzero((shared == 2) & sound)
    if len(k):
        row, own, other = np.arange(len(k)), (~same[k].any(2)).argmax(1), (~same[k].any(1)).argmax(1)
        a, b, c, d = p[k][row, (own + 1) % 3], p[k][row, (own + 2) % 3], p[k][row, own], q[k][row, other]
        j = np.flatnonzero(orientation(a, b, c, d) == 0)
        axis = plane_axis(p[k][j])
        a, b, c, d = (_drop(x[j], axis) for x in (a, b, c, d))
        out[k[j]] = orientation(a, b, c) == orientation(a, b, d)
    return out & ((shared == 3) | sound), shared
