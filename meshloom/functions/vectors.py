"""Geometry as column expressions. A vector is a tuple of three columns; everything here stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(prefix: str) -> Vector:
    """The columns prefix_x, prefix_y, prefix_z."""
    return tuple(F.col(f"{prefix}_{c}") for c in "xyz")


def field(struct: Column) -> Vector:
    return struct["x"], struct["y"], struct["z"]


def lits(x: float, y: float, z: float) -> Vector:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vector, s) -> Vector:
    return tuple(p * s for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.when(n > 0, p / n).otherwise(0.0) for p in a)


def distance(a: Vector, b: Vector) -> Column:
    return norm(sub(a, b))


def mean(points: list[Vector]) -> Vector:
    return tuple(sum((p[i] for p in points[1:]), points[0][i]) / len(points) for i in range(3))


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors, null if one has no length."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def translate(a: Vector, dx: float, dy: float, dz: float) -> Vector:
    return add(a, lits(dx, dy, dz))


def triangle_normal(a: Vector, b: Vector, c: Vector) -> Vector:
    """Unnormalised: its length is twice the area."""
    return cross(sub(b, a), sub(c, a))


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(triangle_normal(a, b, c)) / 2


def edge_lengths(a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    return distance(a, b), distance(b, c), distance(c, a)


def aspect_ratio(a: Vector, b: Vector, c: Vector) -> Column:
    """Longest edge over shortest altitude; null for degenerate triangles."""
    longest, area = F.greatest(*edge_lengths(a, b, c)), triangle_area(a, b, c)
    return F.when(area > 0, longest * longest / (2 * area))


def interior_angles(a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    return angle(sub(b, a), sub(c, a)), angle(sub(a, b), sub(c, b)), angle(sub(a, c), sub(b, c))


def shoelace(points: list[tuple[Column, Column]]) -> Column:
    """Area of a polygon in the plane, positive if it runs counter-clockwise."""
    pairs = zip(points, points[1:] + points[:1], strict=True)
    return sum((p[0] * q[1] - q[0] * p[1] for p, q in pairs), F.lit(0.0)) / 2


def polygon_area(points: list[Vector]) -> Column:
    """Area of a polygon in space, as a fan from its first point."""
    fan = [triangle_area(points[0], p, q) for p, q in zip(points[1:], points[2:], strict=False)]
    return reduce(lambda x, y: x + y, fan, F.lit(0.0))


def tetra_volume(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    return F.abs(dot(sub(b, a), cross(sub(c, a), sub(d, a)))) / 6


#: Corners of the faces and edges of a hexahedron, counted from 0.
HEX_FACES = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))
HEX_EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))


def hex_volume(corners: list[Vector]) -> Column:
    """Two tetrahedra for each face, all with the centroid as their fourth point."""
    center, parts = mean(corners), []
    for a, b, c, d in HEX_FACES:
        parts += [tetra_volume(corners[a], corners[b], corners[c], center), tetra_volume(corners[a], corners[c], corners[d], center)]
    return reduce(lambda x, y: x + y, parts)


def bounds(points: list[Vector]) -> tuple[Vector, Vector]:
    return tuple(F.least(*(p[i] for p in points)) for i in range(3)), tuple(F.greatest(*(p[i] for p in points)) for i in range(3))


def boxes_overlap(lo_a: Vector, hi_a: Vector, lo_b: Vector, hi_b: Vector) -> Column:
    return reduce(lambda x, y: x & y, [(lo_a[i] <= hi_b[i]) & (lo_b[i] <= hi_a[i]) for i in range(3)])


def point_in_box(p: Vector, lo: Vector, hi: Vector) -> Column:
    return reduce(lambda x, y: x & y, [(p[i] >= lo[i]) & (p[i] <= hi[i]) for i in range(3)])


def point_in_tetra(p: Vector, a: Vector, b: Vector, c: Vector, d: Vector, eps: float = 1e-10) -> Column:
    """All four barycentric coordinates lie in [-eps, 1 + eps]; false for flat tetrahedra."""
    u, v, w, r = sub(b, a), sub(c, a), sub(d, a), sub(p, a)
    det = dot(u, cross(v, w))
    l1, l2, l3 = dot(r, cross(v, w)) / det, dot(u, cross(r, w)) / det, dot(u, cross(v, r)) / det
    inside = [(x >= -eps) & (x <= 1 + eps) for x in (l1, l2, l3, 1 - l1 - l2 - l3)]
    return F.when(det == 0, F.lit(False)).otherwise(reduce(lambda x, y: x & y, inside))


def point_triangle_distance2(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Squared distance: to the plane where the foot lies inside, else to the nearest edge."""

    def to_segment(q: Vector, r: Vector) -> Column:
        d, e = sub(r, q), sub(p, q)
        length = dot(d, d)
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(e, d) / length))).otherwise(0.0)
        gap = sub(e, scale(d, t))
        return dot(gap, gap)

    n = triangle_normal(a, b, c)
    inside = reduce(lambda x, y: x & y, [dot(cross(sub(r, q), sub(p, q)), n) >= 0 for q, r in ((a, b), (b, c), (c, a))])
    height, area = dot(sub(p, a), n), dot(n, n)
    return F.when((area > 0) & inside, height * height / area).otherwise(F.least(to_segment(a, b), to_segment(b, c), to_segment(c, a)))


def closest_on_triangle(p: Vector, a: Vector, b: Vector, c: Vector) -> Vector:
    """The point of a triangle nearest to p, by the region of its plane that p lies over: a corner's, an edge's or its own."""
    u, v = sub(b, a), sub(c, a)
    (ua, va), (ub, vb), (uc, vc) = ((dot(u, sub(p, q)), dot(v, sub(p, q))) for q in (a, b, c))
    in_c, in_b, in_a = ua * vb - ub * va, uc * va - ua * vc, ub * vc - uc * vb
    whole = in_a + in_b + in_c
    s = F.when((ua <= 0) & (va <= 0), 0.0).when((ub >= 0) & (vb <= ub), 1.0).when((in_c <= 0) & (ua >= 0) & (ub <= 0), F.try_divide(ua, ua - ub))
    s = s.when((vc >= 0) & (uc <= vc), 0.0).when((in_b <= 0) & (va >= 0) & (vc <= 0), 0.0)
    t = F.when((ua <= 0) & (va <= 0), 0.0).when((ub >= 0) & (vb <= ub), 0.0).when((in_c <= 0) & (ua >= 0) & (ub <= 0), 0.0)
    t = t.when((vc >= 0) & (uc <= vc), 1.0).when((in_b <= 0) & (va >= 0) & (vc <= 0), F.try_divide(va, va - vc))
    far = F.try_divide(vb - ub, (vb - ub) + (uc - vc))  # on the edge from b to c
    beyond = (in_a <= 0) & (vb >= ub) & (uc >= vc)
    s = s.when(beyond, 1 - far).otherwise(F.try_divide(in_b, whole))
    t = t.when(beyond, far).otherwise(F.try_divide(in_c, whole))
    return add(a, add(scale(u, s), scale(v, t)))


def radial(p: Vector, center: tuple[float, float] = (0.0, 0.0)) -> Column:
    return F.hypot(p[0] - center[0], p[1] - center[1])


def cylindrical(p: Vector, center: tuple[float, float] = (0.0, 0.0)) -> Vector:
    """Radius, angle in (-pi, pi], height."""
    return radial(p, center), F.atan2(p[1] - center[1], p[0] - center[0]), p[2]


def unwrap(theta: Column, reference: Column) -> Column:
    """theta moved by whole turns to within half a turn of the reference."""
    turn = 2 * 3.141592653589793
    return theta - turn * F.floor((theta - reference) / turn + 0.5)


def project_to_plane(p: Vector, origin: Vector, normal: Vector) -> Vector:
    """The foot of p on a plane with a normal of any length."""
    return sub(p, scale(normal, dot(sub(p, origin), normal) / dot(normal, normal)))


def project_to_radius(p: Vector, radius, center: tuple[float, float] = (0.0, 0.0)) -> Vector:
    """p moved along its radius onto a cylinder around the z axis."""
    r = radial(p, center)
    f = F.when(r > 0, radius / r).otherwise(0.0)
    return (p[0] - center[0]) * f + center[0], (p[1] - center[1]) * f + center[1], p[2]


def trilinear(corners: list[Vector], s: Column, t: Column, u: Column) -> Vector:
    """The image of (s, t, u) in [-1, 1]^3 under the map that takes the reference cube's corners to these."""
    #: Signs of the reference cube's corners.
    signs = ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))
    weights = [(1 + a * s) * (1 + b * t) * (1 + c * u) / 8 for a, b, c in signs]
    return tuple(reduce(lambda x, y: x + y, [w * p[i] for w, p in zip(weights, corners, strict=True)]) for i in range(3))


def blend(linear: Vector, curved: Vector, r: Column, lo: float, hi: float) -> Vector:
    """linear up to radius lo, curved from hi on, and in proportion between."""
    alpha = F.when(r <= lo, 0.0).when(r >= hi, 1.0).otherwise((r - lo) / (hi - lo))
    return tuple((1 - alpha) * p + alpha * q for p, q in zip(linear, curved, strict=True))
